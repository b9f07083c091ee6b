"""Line deduplication by content-defined chunks of lines, in DataFrame operations alone.

A text's lines are hashed; a rolling hash over ``WINDOW`` line hashes ends a chunk where it is 0 modulo ``SPREAD``, so that
boundaries follow content and shift with it. A line of ``LONG_WORDS`` words or more is a chunk of its own. Chunks of two or
more lines, and long lines, that occur more than once in the corpus are removed but for their first occurrence (smallest
id, then place); equality is that of the bytes. All other chunks stay as they are.

Texts are dealt out once, by a hash of their id and content; hashes alone are grouped over all chunks (a row for each, combined
map-side), and only the bodies of chunks whose hash repeats travel for comparison. A null text stays null; an empty one is one empty line. Rows alike in id and text are one
document. A null id sorts before all others. All columns of the input pass through as one struct, ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, written

#: Lines of the rolling window, mean lines of a chunk, words that make a line long. The window is spelt out in ``_chunks``.
WINDOW, SPREAD, LONG_WORDS = 2, 3, 50


def _chunks(text: str) -> Column:
    """array<struct<pos, n_lines, body, whole>> of a text column; ``whole``: may be removed."""
    q = f"`{text}`"
    lines = f"split({q}, '\\n', -1)"
    # per line: hash and length class; then the 1-based ends of chunks
    marks = f"transform({lines}, l -> named_struct('h', cast(conv(substring(md5(l), 1, 7), 16, 10) AS bigint), 'w', length(l) - length(replace(l, ' ', '')) >= {LONG_WORDS - 1}))"
    return F.expr(f"""
        transform(array({marks}), m ->
          transform(array(filter(sequence(1, size(m)), i -> i = size(m) OR m[i - 1].w OR m[i].w
              OR (m[i - 1].h + 31 * coalesce(get(m, i - 2).h, 0L)) % {SPREAD} = 0)), ends ->
            transform(array({lines}), ls ->
              transform(ends, (e, k) -> named_struct(
                'pos', k,
                'n_lines', e - coalesce(get(ends, k - 1), 0),
                'whole', e - coalesce(get(ends, k - 1), 0) > 1 OR m[e - 1].w,
                'body', array_join(slice(ls, coalesce(get(ends, k - 1), 0) + 1, e - coalesce(get(ends, k - 1), 0)), '\\n'))))[0])[0])[0]
    """)


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(h, key, text, row): a document's key and its hash, its text, and its other columns as one struct, so that no names clash."""
    key = F.struct(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("m"))
    rows = docs.select(key.alias("key"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    return rows.select(F.xxhash64("key.id", "key.m").alias("h"), "key", "text", "row")


def _met(rows: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """``rows`` (dealt by h) with the array ``name`` that ``lists`` (h, key, pos) have for their key, sorted; null where none."""
    per = lists.groupBy("h").agg(F.collect_set(F.struct("key", "pos")).alias("found"))  # a text's places, and of a text with the same hash
    met = rows.join(per.withColumnRenamed("h", "of").hint("merge"), F.col("h") == F.col("of"), "left")
    own = F.expr("array_sort(transform(filter(found, x -> x.key <=> key), x -> x.pos))")
    return met.withColumn(name, F.when(F.size(own) > 0, own)).drop("of", "found")


def _repeats(found: DataFrame, by: str, what: str) -> DataFrame:
    """(h, key, pos) of rows whose ``by`` came before: at a smaller key, or earlier in the text.

    Firsts are found by sums of the tasks. They are a table of their own, so that what is very common can be split in the join.
    """
    found = written(found, what)
    first = found.groupBy("short", by).agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = written(first.select(F.col("short").alias("of"), F.col(by).alias("same"), "first"), f"first-{what}")
    met = found.join(first.hint("merge"), F.col("short") == F.col("of"))
    return met.filter((F.col(by) == F.col("same")) & (F.struct("key", "pos") != F.col("first"))).select("h", "key", "pos")


def _suspects(places: DataFrame) -> DataFrame:
    """The rows whose hash ``short`` several rows have."""
    several = written(places.groupBy("short").agg(F.count("*").alias("n")).filter("n > 1").select("short"), "several")
    return places.join(several, "short")


def _without_chunks(rows: DataFrame) -> DataFrame:
    """Rows (h, key, text, row) with ``kept``, n_lines, n_chunks, removed."""
    able = rows.filter("text IS NOT NULL").select("h", "key", "text")
    places = able.select("h", "key", F.explode(F.filter(_chunks("text"), lambda c: c.whole)).alias("c")).select("h", "key", F.col("c.pos").alias("pos"), F.xxhash64("c.body").alias("short"))
    # the suspects' bytes: a chunk of the corpus is the same only if its whole body is
    bodies = _met(able, _suspects(places).select("h", "key", "pos"), "suspects").filter("suspects IS NOT NULL")
    bodies = bodies.select("h", "key", F.explode(F.filter(_chunks("text"), lambda c: F.array_contains("suspects", c.pos))).alias("c")).select("h", "key", "c.pos", "c.body", F.xxhash64("c.body").alias("short"))
    out = _met(rows, _repeats(bodies, "body", "bodies"), "removed")
    out = out.withColumn("removed", F.coalesce("removed", F.expr("cast(array() AS array<int>)"))).withColumn("chunks", F.when(F.col("text").isNotNull(), _chunks("text")))
    stay = F.filter("chunks", lambda c: ~F.array_contains("removed", c.pos))
    return out.select(
        "row",
        "text",
        F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda c: c.body), "\n")).alias("kept"),
        F.coalesce(F.aggregate("chunks", F.lit(0), lambda a, c: a + c.n_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("chunks"), F.lit(0)).cast("long").alias("n_chunks"),
        "removed",
    )


def _without_runs(rows: DataFrame) -> DataFrame:
    """Rows (h, key, text, row) with ``kept`` and ``cut``, see ``without_repeated_runs``."""
    ls = "split(text, '\\n', -1)"
    # 1-based numbers of the lines that are not blank; a pair's number is its first line's index among them
    full = "filter(sequence(1, size(ls)), i -> ls[i - 1] RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    pairs = f"transform(array({ls}), ls -> transform(array({full}), f -> transform(slice(f, 1, greatest(size(f) - 1, 0)), (i, k) -> named_struct('pos', k, 'sha', unhex(sha2(array_join(slice(ls, i, f[k + 1] - i + 1), '\\n'), 256)))))[0])[0]"
    places = rows.filter("text IS NOT NULL").select("h", "key", F.explode(F.expr(pairs)).alias("p")).select("h", "key", "p.pos", "p.sha").withColumn("short", F.xxhash64("sha"))
    out = _met(rows, _repeats(_suspects(places), "sha", "pairs"), "pairs")
    # runs of pairs as first and last lines, then the lines between runs
    runs = f"""
        transform(array({full}), f -> filter(
          zip_with(filter(pairs, (k, i) -> i = 0 OR get(pairs, i - 1) <> k - 1), filter(pairs, (k, i) -> i = size(pairs) - 1 OR get(pairs, i + 1) <> k + 1),
            (a, b) -> named_struct('a', f[a], 'b', f[b + 1])),
          r -> size(filter(split(array_join(slice(ls, r.a, r.b - r.a + 1), ' '), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')) > {LONG_WORDS}))[0]"""
    out = out.withColumn("runs", F.when(F.col("pairs").isNotNull(), F.expr(f"transform(array({ls}), ls -> {runs})[0]")))
    stay = f"""
        transform(array({ls}), ls -> array_join(flatten(transform(sequence(0, size(runs)), j ->
          transform(array(if(j = 0, 1, get(runs, j - 1).b + 1)), a -> slice(ls, a, if(j = size(runs), size(ls) + 1, get(runs, j).a) - a))[0])), '\\n'))[0]"""
    out = out.withColumn("cut", F.coalesce(F.expr("aggregate(runs, 0, (n, r) -> n + r.b - r.a + 1)"), F.lit(0)))
    return out.select("h", "key", "row", F.when(F.col("cut") > 0, F.expr(stay)).otherwise(F.col("text")).alias("kept"), "cut")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (a struct of the document's other columns), ``text``, ``kept`` (what of it stays; null for null), n_lines, n_chunks,
    removed (places). Texts are dealt out once, by their key; hashes and repeated chunks travel to them."""
    return _without_chunks(dealt(_keyed(docs, id_col, text), "texts", "h"))


def without_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``kept`` (the text without runs of lines that came before), ``cut`` (how many lines went).

    Chunks are fused with unlike lines at a repeat's ends. Here every pair of neighbouring lines (with the blank ones between
    them) counts by itself: pairs that came before (smaller id, then place) make runs, and runs of more than ``LONG_WORDS``
    words go. A line that goes has come before in such a pair, so a line's first occurrence always stays. Pairs are equal by SHA-256.
    """
    return _without_runs(dealt(_keyed(docs, id_col, text), "texts", "h")).select("row", "kept", "cut")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents, with their columns, after repeated runs and then repeated chunks are gone; one of which nothing is left goes too."""
    rest = _without_runs(dealt(_keyed(docs, id_col, text), "texts", "h"))
    # written before it is filtered: a filter would move below the projection and work the runs out again, for each of their uses
    rest = dealt(rest.select("h", "key", F.col("kept").alias("text"), "row", "cut"), "rest", "h", again=False).filter("cut = 0 OR text <> ''").drop("cut")
    out = _without_chunks(rest).filter("size(removed) = 0 OR kept <> ''")
    own = {text: F.col("kept")} | ({length: F.length("kept").cast(docs.schema[length].dataType)} if length else {})
    return out.select(*[own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_lines, n_chunks, n_removed, kept_chars, kept_md5) of ``line_dedup``'s rows."""
    return out.select(F.col("row")[id_col].alias(id_col), "n_lines", "n_chunks", F.size("removed").cast("long").alias("n_removed"), F.coalesce(F.length("kept"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("kept", F.lit("")).cast("binary")).alias("kept_md5"))


#: The same rows in DuckDB's SQL.
ORACLE = f"""
WITH t AS (SELECT doc_id, text, md5(coalesce(text, '')) AS m, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT *, list_transform(ls, lambda l: ('0x' || substr(md5(l), 1, 7))::BIGINT) AS hs,
             list_transform(ls, lambda l: length(l) - length(replace(l, ' ', '')) >= {LONG_WORDS - 1}) AS ws FROM t),
e AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR ws[i] OR ws[i + 1]
             OR (hs[i] + 31 * coalesce(hs[i - 1], 0)) % {SPREAD} = 0) AS ends FROM h WHERE text IS NOT NULL),
c AS (SELECT doc_id, m, ls, ws, ends, unnest(range(1, len(ends) + 1)) AS k FROM e),
b AS (SELECT doc_id, m, k, ends[k] - coalesce(ends[k - 1], 0) AS n_lines, ws[ends[k]] AS w,
             array_to_string(ls[coalesce(ends[k - 1], 0) + 1 : ends[k]], chr(10)) AS body FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY n_lines > 1 OR w, body ORDER BY doc_id NULLS FIRST, m, k) > 1 AND (n_lines > 1 OR w) AS gone FROM b),
g AS (SELECT doc_id, m, sum(n_lines) AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id, m)
SELECT t.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_chunks, 0)::BIGINT AS n_chunks,
       coalesce(g.n_removed, 0)::BIGINT AS n_removed, coalesce(length(g.kept), 0)::BIGINT AS kept_chars, md5(coalesce(g.kept, '')) AS kept_md5
FROM t LEFT JOIN g ON t.doc_id IS NOT DISTINCT FROM g.doc_id AND t.m = g.m
"""

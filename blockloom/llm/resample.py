"""Importance resampling towards a target: documents whose hashed word n-grams are likelier in the target than in the corpus.

Features are all runs of 1 to ``WIDTH`` consecutive words of a text, repeats counted; a feature's bucket is the CRC-32 of its bytes
modulo the number of buckets. Within a task texts are gathered into slices; a slice's words are numbered and its word-id suffixes,
cut at ``WIDTH`` words and at their text's end, sorted. Neighbours in that suffix array that share their first n words (their common
prefix is n or longer) form a run: one n-gram with all its places. Each n-gram is hashed once a run, longer ones from the hash of the
next shorter one by a word's own (CRCs are linear, so lengths of words have tables). For the counts a run adds its length to its
bucket; for the scores its bucket is scattered back to its places, and each text adds up its places' gains.

Two passes read the texts: counts of buckets over all rows (a row for each bucket comes to the driver) and scores. Ranks come from the
order of all eligible rows over ranges, with the ranges' sizes as offsets; no task sees them all.

Words are lower-cased in A-Z only. A null or empty text, or one without words, has no features and weight 0. Each row is a document
of its own. A null id is hashed as no text and comes last among ties; other columns are ignored; of empty tables, an empty corpus
gives an empty result and an empty target counts 0 everywhere. Texts of any length are whole; one longer than a slice is a slice.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, written

WIDTH, BUCKETS, SEED, LEAST_WORDS, SHARE, SLICE = 3, 10_000, 42, 20, (5, 100), 8 << 20
#: Bytes of a word's table of CRC shifts are 4 KB a length; longer words are hashed by the library, run by run.
TABLED = 64
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Of each byte: itself in a word, lower-cased in A-Z, else a space.
_FOLD = bytes(b if b not in range(0x41, 0x5B) else b + 32 for b in range(256)).translate(bytes(b if b in _WORD else 32 for b in range(256)))


def _shifts() -> np.ndarray:
    """Tables [length][byte of a CRC][value]: that CRC's share after so many further zero bytes; by the CRC-32 polynomial, a byte at a time."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    out = np.zeros((TABLED + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> 8) ^ step[out[n - 1] & 255]
    return out


_SHIFTS = _shifts()


def _words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(ids, the words that they number, the text of each) of all words in order."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    raw, offsets = texts.buffers(), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer((raw[2] or b"")[offsets[0] : offsets[-1]] if raw[2] else b"", np.uint8)
    offsets = offsets - offsets[0]
    # a space behind each text, so that no word goes over its end
    flat = np.frombuffer(np.insert(data, offsets[1:], 32).tobytes().translate(_FOLD), np.uint8)
    inside = flat != 32
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # a word and one space behind it
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    of = np.searchsorted(offsets[1:] + np.arange(len(texts)), ends, "right")
    flat = flat[keep]
    bounds = np.concatenate([[0], np.flatnonzero(flat == 32) + 1])
    coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
    return coded.indices.to_numpy(), [w[:-1] for w in coded.dictionary.to_pylist()], of


def runs(ids: np.ndarray, of: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of a slice's words, cut at ``width`` words and texts' ends; for each n, the places in it where a run of suffixes
    with the same first n words begins, -1 standing for a word past the end."""
    n = len(ids)
    tail = [ids.astype(np.int64)]
    for k in range(1, width):
        word = np.full(n, -1, np.int64)
        same = of[k:] == of[: n - k] if k < n else np.zeros(0, bool)
        word[: n - k][same] = ids[k:][same] if k < n else word[:0]
        tail.append(word)
    bits = max(1, int(n and ids.max() + 2).bit_length())
    if bits * width <= 63:
        key = np.zeros(n, np.int64)
        for word in tail:
            key = (key << bits) | (word + 1)
        order = np.argsort(key)
    else:
        order = np.lexsort(tail[::-1])
    starts, fresh = [], np.zeros(n, bool)
    if n:
        fresh[0] = True
    for word in tail:
        own = word[order]
        fresh[1:] |= own[1:] != own[:-1]  # shorter than n words in common with the one before
        starts.append(np.flatnonzero(fresh))
    return order, starts


def buckets_of(texts: pa.Array, buckets: int = BUCKETS, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: (bucket of each run of n-grams, its first place in the suffix array, its length, the text at each place of that array)."""
    ids, words, of = _words(texts)
    order, starts = runs(ids, of, width)
    own = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)  # of a word behind a space
    alone, lens = np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words], np.int64)
    crc, before = alone, None
    at_text = of[order]
    for n, begin in enumerate(starts):
        size = np.diff(begin, append=len(order))
        first = order[begin]
        whole = np.ones(len(begin), bool)
        if n:
            whole[first + n >= len(ids)] = False
            whole[whole] = of[first[whole] + n] == of[first[whole]]
        begin, size, first = begin[whole], size[whole], first[whole]
        if n == 0:
            now = alone[ids[first]] if len(first) else np.zeros(0, np.uint32)
        else:
            last = ids[first + n]
            parent = crc[np.searchsorted(before, begin, "right") - 1]
            k = np.minimum(lens[last] + 1, TABLED + 1)
            now = own[last] ^ _SHIFTS[k, 0, parent & 255] ^ _SHIFTS[k, 1, (parent >> 8) & 255] ^ _SHIFTS[k, 2, (parent >> 16) & 255] ^ _SHIFTS[k, 3, parent >> 24]
            for i in np.flatnonzero(lens[last] > TABLED):
                now[i] = zlib.crc32(b" " + words[last[i]], int(parent[i]))
        crc, before = now, begin
        yield (now % np.uint32(buckets)).astype(np.int64), begin, size, at_text


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of a task's rows of about ``SLICE`` bytes each."""
    held, size = [], 0
    for batch in slices(batches, "text", SLICE):
        if held and size + batch.nbytes > SLICE:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in _gathered(batches):
            for bucket, _, size, _ in buckets_of(batch.column(0), buckets):
                seen += np.bincount(bucket, size, buckets).astype(np.int64)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: 1000 times the log of how much likelier a feature is in the target, smoothed by one, floored."""
    held, wanted, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (held + n) / ((s + 1) * (wanted + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of all rows; the gains are a number for each bucket."""
    kind, most = docs.schema[id_col].dataType.simpleString(), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            rows = batch.num_rows
            n_words, n_features, weight = (np.zeros(rows, np.int64) for _ in range(3))
            for n, (bucket, begin, size, of) in enumerate(buckets_of(batch.column(1), most)):
                # a run's places follow each other in the suffix array
                places = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                at = of[places]
                found = np.bincount(at, minlength=rows)
                n_features += found
                weight += np.bincount(at, np.repeat(gain[bucket], size), rows).astype(np.int64)  # sums of integers well below 2**53
                if n == 0:
                    n_words = found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition with their place in it, from 1."""
    at = 1
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "place"])
        at += batch.num_rows


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of all rows: rank 1, 2, 3 ... by falling score, then rising id, of the ``share`` of the rows
    with ``least_words`` words or more that is drawn; null for the others. Scores are weights with Gumbel noise from the seed and id,
    so the highest are a draw without replacement in proportion to the exponential of the weights' thousandths."""
    rows = weighed(docs, gains(bucket_counts(docs, text), bucket_counts(target, text)), id_col, text)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = written(rows.withColumn("score", (F.col("weight") + noise).cast("long")), "weighed")
    able = F.col("n_words") >= least_words
    drawn = rows.filter(able).count() * share[0] // share[1]
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features"), F.asc("row")]
    ranged = rows.filter(able).withColumn("row", F.monotonically_increasing_id())  # splits rows that are alike in all else
    ranged = ranged.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("row").withColumn("part", F.spark_partition_id())
    ranged = written(ranged.mapInArrow(_placed, ", ".join(f"{n} {t}" for n, t in ranged.dtypes) + ", place long"), "ranged")
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rank = F.col("base") + F.col("place")
    ranked = ranged.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= drawn, rank))  # a row for each range
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*columns).unionAll(rows.filter(~able).withColumn("rank", F.lit(None)).select(*columns))


#: The same rows in DuckDB SQL, CRC-32 by its polynomial over the bytes of each distinct feature.
ORACLE = """
WITH steps AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, row_number() OVER () AS r, id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM texts),
places AS (SELECT side, r, w, unnest(range(1, len(w) + 1)) AS i FROM words),
features AS (
  SELECT side, r, w[i] AS f FROM places
  UNION ALL SELECT side, r, w[i] || ' ' || w[i + 1] FROM places WHERE i + 1 <= len(w)
  UNION ALL SELECT side, r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(f))), lambda k: ('0x' || substr(hex(encode(f)), 2 * k + 1, 2))::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), steps),
placed AS (SELECT side, r, bucket FROM features JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counts),
scored AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(x.weight, 0)::BIGINT AS weight,
    (coalesce(x.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words w LEFT JOIN (SELECT r, count(*) AS n, sum(g) AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r) x USING (r) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 5 * n // 100 THEN k END AS rank FROM ranked
"""

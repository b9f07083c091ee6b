"""Mixing sources to target weights by blocks.

Each source's texts, in id order, form one stream of words that is cut into blocks of ``BLOCK`` words. A source's share of the
output is a number of block slots. The output's shards draw their sources multinomially, conditioned on these totals: a
binary tree over the shards splits every node's slots between its halves by a multivariate hypergeometric draw, one law and one
sampler at all sizes, seeded with the node, so each task finds its shard's counts and first slots by itself, in as many draws as the tree is deep. A slot's
number, taken modulo the source's number of blocks, goes through a keyed pseudorandom permutation of the block indexes (a Feistel
network with cycle walking, another key for each repeat) and blocks are joined by that index.

Targets: sources in code point order, null last, weigh ``WEIGHTS`` in turn and share all sizes; a target stops at
``REPEATS`` times its source's size, and the excess is shared again by weight until none is above. A source's slots are whole
passes over its blocks and as many blocks of one more pass as its target's words need, the last slot cut to what is left; as a
block comes at most once per pass, no document exceeds that multiple.

Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none and takes none, as does an empty one. Null ids come first in their
source; repeated ids are told apart by their texts' hashes, and rows alike in both share what falls to them in row order. An empty table gives
an empty result. Statistics of sources reach the driver (a row for each source, ``MOST_SOURCES`` at most), nothing per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import e, floor, lgamma, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, partitions, written

BLOCK, SHARD_SLOTS, WEIGHTS, REPEATS, SEED, MOST_SOURCES = 256, 4096, (5, 2, 1), 3, 20_240_501, 100_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight, each at most ``repeats`` times its size."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        whole = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / whole > repeats * sizes[i]}
        if not above:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in above:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        free -= above
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1, applied to ``index``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, low = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    keys = mix64(np.arange(1, 7, dtype=np.uint64) + np.uint64(key & (2**62 - 1)))
    while len(todo):
        x = out[todo]
        left, right = x >> low, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = (left << low) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def inverse_place(index: int, n: int, key: int) -> int:
    """The place that ``permuted`` sends to ``index``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    keys = mix64(np.arange(1, 7, dtype=np.uint64) + np.uint64(key & (2**62 - 1)))
    x = index
    while True:
        left, right = x >> half, x & mask
        for k in keys[::-1]:
            with np.errstate(over="ignore"):
                left, right = right ^ int(mix64(np.array([left], np.uint64) + k)[0] & np.uint64(mask)), left
        x = (left << half) | right
        if x < n:
            return x


def pass_key(source: int, repeat: int) -> int:
    """The key of a source's permutation in one pass over its blocks."""
    return int(mix64(mix64(np.array([SEED + (source << 8)], np.uint64)) + np.uint64(repeat))[0] >> np.uint64(2))


def _grown(a: int, d: int) -> float:
    """ln((a + d)! / a!) - d ln a (of which 0 takes nothing off), without the cancellation that two logarithms of large factorials would bring."""
    x = a + d
    if min(a, x) < 10**4:
        return lgamma(x + 1) - lgamma(a + 1) - (d * log(a) if a else 0.0)
    t = d / a
    # a ((1 + t) ln(1 + t) - t), by its series where t is small
    bulk = a * t * t * (1 / 2 - t * (1 / 6 - t * (1 / 12 - t * (1 / 20 - t / 30)))) if abs(t) < 1e-4 else a * ((1 + t) * log1p(t) - t)
    return bulk + log1p(t) / 2 + (1 / x - 1 / a) / 12


def hypergeometric(rng: np.random.Generator, own: int, rest: int, want: int) -> int:
    """How many of ``want`` items drawn without replacement from ``own`` and ``rest`` are of ``own``, for counts of any size.

    Rejection from a ratio of uniforms around the mean; the probability of a count is taken relative to the mode's, whose
    leading terms cancel in integers.
    """
    whole = own + rest
    low, high = max(0, want - rest), min(own, want)
    if low == high:
        return low
    mode = min(max((want + 1) * (own + 1) // (whole + 2), low), high)
    at = (mode, own - mode, want - mode, rest - want + mode)
    up, down = (at[0] or 1) * (at[3] or 1), (at[1] or 1) * (at[2] or 1)
    slope = log1p((up - down) / down)
    mean = want * own / whole
    spread = 2 * sqrt(2 / e) * sqrt(mean * (rest / whole) * ((whole - want) / max(whole - 1, 1)) + 0.5) + 3 - 2 * sqrt(3 / e)
    middle = mean - mode + 0.5
    while True:
        u, v = 1 - rng.random(), rng.random()
        d = floor(middle + spread * (v - 0.5) / u)
        if not low <= mode + d <= high:
            continue
        ratio = -d * slope - sum(_grown(a, s * d) for a, s in zip(at, (1, -1, -1, 1), strict=True))
        if 2 * log(u) <= ratio:
            return mode + d


def shard_draw(slots: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, count) per source of a shard: the same whoever asks, and adding up over all shards to ``slots``."""
    first, counts, lo, hi = np.zeros_like(slots), slots.copy(), 0, shards
    total = int(slots.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        cut = [total * k // shards for k in (lo, mid, hi)]
        rng, want, rest = np.random.default_rng([seed, lo, hi]), cut[1] - cut[0], cut[2] - cut[0]
        left = np.zeros_like(counts)
        for i in np.flatnonzero(counts):  # source by source, each given what the ones before have drawn
            rest -= int(counts[i])
            left[i] = hypergeometric(rng, int(counts[i]), rest, want)
            want -= int(left[i])
        if shard < mid:
            counts, hi = left, mid
        else:
            first, counts, lo = first + left, counts - left, mid
    return first, counts


def running_total(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``since``: the sum of ``value`` over the rows of the group before each one, in the given order.

    Rows are dealt into sorted ranges, each summed as a stream; a range's base comes from a table with a row for each group in
    each range. So ids may be anything, and a group may be spread over all tasks.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    at = rows.columns.index(value), rows.columns.index(group)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, g = batch.column(at[0]).to_numpy(), batch.column(at[1]).to_numpy()
            ends = np.cumsum(x)
            new = np.flatnonzero(np.r_[g[0] != now, g[1:] != g[:-1]])  # where another group begins
            carried = total if not len(new) or new[0] else 0
            since = ends - x + carried
            for k in new:
                since[k:] -= since[k]
            now, total = g[-1], int(since[-1] + x[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(since)], [*batch.schema.names, "_in"])

    ranged = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged.mapInArrow(summed, f"{kinds}, _part int, _in long"), "ranges")
    bases = ranged.groupBy(group, "_part").agg(F.sum(value).alias("_s")).withColumn("_base", F.sum("_s").over(Window.partitionBy(group).orderBy("_part")) - F.col("_s")).drop("_s")
    # ranges are contiguous: at most as many rows as there are partitions and groups
    return ranged.join(F.broadcast(bases), [group, "_part"]).withColumn("since", F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def passes(size: int, words: int, source: int) -> tuple[int, int]:
    """(slots, words of the last one) that take exactly ``words`` words from a stream of ``size``: whole passes, then blocks of one
    more in its permuted order, of which the stream's last block may be short."""
    blocks, (whole, rest) = -(-size // BLOCK), divmod(words, size) if size else (0, 0)
    if not rest:
        return whole * blocks, BLOCK
    short = BLOCK * blocks - size  # words that the stream's last block lacks
    met = inverse_place(blocks - 1, blocks, pass_key(source, whole))
    n = -(-rest // BLOCK)
    if BLOCK * n - (short if met < n else 0) < rest:
        n += 1
    return whole * blocks + n, rest - (BLOCK * (n - 1) - (short if met < n - 1 else 0))


def plan(docs: DataFrame, id_col: str, text: str, source: str, weights: tuple[float, ...], repeats: int) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(rows, slots, sources): rows with their place in the stream, slots with their block, and the sources' figures."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.xxhash64(text).alias("hash"), F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size"))
    rows = written(rows, "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(((r.source is None, r.source or "", r.size) for r in found))
    aims = targets([x[2] for x in found], [weights[i % len(weights)] for i in range(len(found))], repeats)
    sources = [{"source": None if none else name, "size": size, "target": t, "blocks": -(-size // BLOCK), "words": min(round(t), repeats * size), "s": i} for i, ((none, name, size), t) in enumerate(zip(found, aims, strict=True))]
    for x in sources:
        x["slots"], x["last"] = passes(x["size"], x["words"], x["s"])
    named = spark.createDataFrame([(x["s"], x["source"], x["size"], x["target"]) for x in sources], "s int, source string, source_size long, target double")
    rows = rows.join(F.broadcast(named), rows["source"].eqNullSafe(named["source"])).drop(named["source"])  # MOST_SOURCES rows at most
    return running_total(rows, "s", ["id", "hash", "size"], "size"), _slots(spark, sources), sources


def _slots(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """(shard, place, s, repeat, block, words): the output's blocks in order, ``words`` being how many a slot takes."""
    slots, blocks = (np.array([x[k] for x in sources] or [0], np.int64) for k in ("slots", "blocks"))
    last = np.array([x["last"] for x in sources] or [0], np.int64)
    shards = max(1, -(-int(slots.sum()) // SHARD_SLOTS))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, counts = shard_draw(slots, shards, shard, SEED)
                s = np.repeat(np.arange(len(slots)), counts)
                k = first[s] + np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts)
                repeat, block = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
                for i in np.flatnonzero(counts):
                    at = np.flatnonzero(s == i)
                    repeat[at] = k[at] // blocks[i]
                    for e in np.unique(repeat[at]):
                        own = at[repeat[at] == e]
                        block[own] = permuted(k[own] % blocks[i], int(blocks[i]), pass_key(int(i), int(e)))
                words = np.where(k == slots[s] - 1, last[s], BLOCK)
                order = np.random.default_rng([SEED, shard]).permutation(len(s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), shard, np.int64)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s[order].astype(np.int32)), pa.array(repeat[order].astype(np.int32)), pa.array(block[order]), pa.array(words[order].astype(np.int32))],
                    ["shard", "place", "s", "repeat", "block", "words"],
                )

    tasks = min(shards, max(partitions(spark), 1))
    return spark.range(0, shards, 1, tasks).mapInArrow(draw, "shard long, place int, s int, repeat int, block long, words int")


def taken_spans(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows' stretches of words that a slot takes: the rows' columns, repeat, lo, hi (word numbers within the text)."""
    cut = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(since DIV {BLOCK}, (since + size - 1) DIV {BLOCK})")))
    # slots are made from a short range, by whose size the planner would think them small enough to broadcast
    met = cut.join(slots.select("s", "repeat", "block", "words").hint("merge"), ["s", "block"])
    met = met.withColumn("lo", F.expr(f"greatest(since, block * {BLOCK}) - since")).withColumn("hi", F.expr(f"least(since + size, block * {BLOCK} + words) - since"))
    return met.filter("hi > lo")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(id, size, source_size, target, taken) of every row."""
    rows, slots, _ = plan(docs, id_col, text, source, weights, repeats)
    spans = taken_spans(rows.select("s", "id", "since", "size"), slots)
    taken = spans.groupBy("s", "since").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    out = rows.join(taken, ["s", "since"], "left")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars") -> DataFrame:
    """The mix as rows like the input's: for each document and repeat, the stretches of its text that the mix takes.

    A stretch runs from its first word to its last with what lies between; stretches that don't touch are put together with
    a line feed. Documents of which nothing is taken are not in the mix. ``length``, if given, is set to the new text's. All
    other columns stay, whatever their names: rows travel as one struct. Of rows alike in id and text one gives the others' columns.
    """
    rows, slots, _ = plan(docs, id_col, text, source, WEIGHTS, REPEATS)
    spans = taken_spans(rows.select("s", "id", "hash", "since", "size"), slots)
    # a document's spans: at most its words over BLOCK and two; rows alike in id and text pool theirs
    spans = spans.groupBy("id", "hash", "repeat").agg(F.sort_array(F.collect_list(F.struct("since", "lo", "hi"))).alias("spans"))
    keyed = docs.select(F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = keyed.dropDuplicates(["own_id", "own_hash"]).join(spans, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))

    @F.pandas_udf("string")
    def cut(texts, lists):
        import pandas as pd

        out = []
        for t, spans in zip(texts, lists, strict=True):
            at = [m.span() for m in _WORD.finditer(t)]
            parts, before = [], None
            for x in spans:
                since, lo, hi = x["since"], x["lo"], x["hi"]
                if before and before[0] == since and before[2] == lo:
                    before = parts[-1] = (since, before[1], hi)
                else:
                    before = (since, lo, hi)
                    parts.append(before)
            out.append("\n".join(t[at[lo][0] : at[hi - 1][1]] for _, lo, hi in parts))
        return pd.Series(out)

    out = met.select("row", cut(F.col("row")[text], F.col("spans")).alias("mixed"))
    own = {text: F.col("mixed")} | ({length: F.length("mixed").cast(docs.schema[length].dataType)} if length else {})
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

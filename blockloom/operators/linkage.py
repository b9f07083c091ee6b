"""Parent links between blocks: continuity, take-while, forks, equivocation, duplicates, finality bookkeeping.

A blocks table has chain_id, number, hash, parent_number, parent_hash. What needs the block or report before goes through the
segmented scan of ``scan``; ``with_breaks_by_join`` finds each block's parent by an equi-join; ancestors are walked through segments of
heights. So no task sees a whole chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from blockloom.operators.scan import carried, uncarried
from blockloom.storage import Kept

KEYS = ["chain_id"]
#: Parts that a chain's rows are dealt over where they are joined by their chain.
DEALT = 96


def is_link(number: Column, hash_: Column, parent_number: Column, parent_hash: Column) -> Column:
    """Whether (number, hash) is the parent that a block names; exact equality."""
    return (number == parent_number) & (hash_ == parent_hash)


def with_breaks(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``linked``: whether the block before it (by height) is its parent; true for the first."""
    rows, w = carried(blocks, KEYS, ["number", "hash"], last=["number", "hash"])
    link = is_link(F.lag("number").over(w), F.lag("hash").over(w), F.col("parent_number"), F.col("parent_hash"))
    return uncarried(rows.withColumn("linked", F.coalesce(link, F.lag("number").over(w).isNull())))


def with_breaks_by_join(blocks: DataFrame) -> DataFrame:
    """(block, ``linked``: its parent is in the table), as an equi-join: no order, so no task that sees a whole chain."""
    parents = blocks.select(*KEYS, F.col("number").alias("parent_number"), F.col("hash").alias("parent_hash"), F.lit(True).alias("_there")).distinct()
    return blocks.join(parents, [*KEYS, "parent_number", "parent_hash"], "left").withColumn("linked", F.coalesce("_there", F.lit(False))).drop("_there")


def linked_prefix(blocks: DataFrame, ignore_case: bool = False, contiguous: bool = False) -> DataFrame:
    """The blocks up to the first break: of hashes alone, without regard to case if so asked, and of heights if ``contiguous``."""
    rows, w = carried(blocks, KEYS, ["number"], last=["number", "hash"])
    a, b = F.lag("hash").over(w), F.col("parent_hash")
    bad = (F.lower(a) != F.lower(b)) if ignore_case else (a != b)
    if contiguous:
        bad = bad | (F.lag("number").over(w) + 1 != F.col("number"))
    marked = uncarried(rows.withColumn("_bad", F.coalesce(bad, F.lit(False))))
    first = marked.filter("_bad").groupBy(*KEYS).agg(F.min("number").alias("_broken"))  # a row a chain
    # each chain's rows are dealt over ``DEALT`` parts for the join, as one chain may be the whole table
    first = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = marked.withColumn("_part", F.pmod(F.xxhash64("number", "hash"), F.lit(DEALT)).cast("int"))
    return dealt.join(first, [*KEYS, "_part"], "left").filter("_broken IS NULL OR number < _broken").select(*blocks.columns)


def fork_signals(blocks: DataFrame) -> DataFrame:
    """(chain_id, number, hash): of the first block that doesn't follow its predecessor, the parent it asks for."""
    broken = with_breaks(blocks).filter(~F.col("linked"))
    return broken.groupBy(*KEYS).agg(F.min_by(F.struct((F.col("number") - 1).alias("number"), F.col("parent_hash").alias("hash")), "number").alias("f")).select(*KEYS, "f.*")


def batch_issues(batches: DataFrame) -> DataFrame:
    """(chain_id, batch, issue): why a batch can't be taken, null if it can. Batches are ordered by ``pos``.

    empty hash, unsafe hash, descending, unlinked: the first of these that holds anywhere in the batch.
    """
    from blockloom.functions.quantities import is_header_safe

    w = Window.partitionBy(*KEYS, "batch").orderBy("pos")
    rows = batches.withColumn("_up", F.coalesce(F.lag("number").over(w) < F.col("number"), F.lit(True)))
    rows = rows.withColumn("_link", F.coalesce(is_link(F.lag("number").over(w), F.lag("hash").over(w), F.col("parent_number"), F.col("parent_hash")), F.lit(True)))
    empty = (F.length("hash") == 0) | (F.length("parent_hash") == 0)
    flags = rows.groupBy(*KEYS, "batch").agg(F.bool_or(empty).alias("e"), F.bool_and(empty | (is_header_safe("hash") & is_header_safe("parent_hash"))).alias("s"), F.bool_and("_up").alias("u"), F.bool_and("_link").alias("l"))
    return flags.select(*KEYS, "batch", F.when(F.col("e"), "empty hash").when(~F.col("s"), "unsafe hash").when(~F.col("u"), "descending").when(~F.col("l"), "unlinked").alias("issue"))


def candidate_issue(expected: Column, number: Column, invalid: Column, parent_hash: Column, previous_hash: Column) -> Column:
    """Why a fetched block can't extend a range: missing, wrong number, invalid, parent mismatch; null if it can."""
    return F.when(number.isNull(), "missing").when(number != expected, "wrong number").when(invalid, "invalid").when(previous_hash.isNotNull() & (F.lower(parent_hash) != F.lower(previous_hash)), "parent mismatch")


def splice_issues(prefix: DataFrame, tail: DataFrame) -> DataFrame:
    """Blocks of an ordered prefix and tail, put together, that don't follow each other."""
    return with_breaks(prefix.unionByName(tail)).filter(~F.col("linked")).drop("linked")


def equivocations(blocks: DataFrame) -> DataFrame:
    """(chain_id, number, hash) of refs that come with different parents."""
    return blocks.groupBy(*KEYS, "number", "hash").agg(F.countDistinct("parent_number", "parent_hash").alias("n")).filter("n > 1").drop("n")


def absorbed(new: DataFrame, held: DataFrame) -> DataFrame:
    """New blocks that are not already held with the same parent."""
    return new.join(held, [*KEYS, "number", "hash", "parent_number", "parent_hash"], "left_anti")


def conflicting(new: DataFrame, held: DataFrame) -> DataFrame:
    """New blocks whose ref is held with another parent."""
    h = held.select(*KEYS, "number", "hash", F.col("parent_number").alias("_n"), F.col("parent_hash").alias("_h"))
    return new.join(h, [*KEYS, "number", "hash"]).filter("_n <> parent_number OR _h <> parent_hash").drop("_n", "_h")


def last_per_height(arrivals: DataFrame, order: str = "pos") -> DataFrame:
    """Of each height the block that arrived last: what reorganisations leave."""
    return arrivals.groupBy(*KEYS, "number").agg(F.max_by(F.struct("hash", "parent_number", "parent_hash", order), order).alias("b")).select(*KEYS, "number", "b.*")


#: Heights of a segment in the first round of ``_walked``, as a power of two; the power added each round; and the most.
SEGMENT, WIDER, WIDEST = 16, 3, 22
_WALKED = "chain_id {chain}, number long, hash string, parent_number long, parent_hash string, pair {pair}, a long, b long, found boolean"


def _sweep(batches: Iterator[pa.RecordBatch], depth: int, bits: int, meet: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Walks up through segments whose rows (chain_id, number, hash, parent_number, parent_hash, pair, a, b, waits) fall in height.

    Rows with a pair are walks, ahead of their block; those that wait come out as they are. Parents are lower than their children, so one pass meets a walk's blocks in order, and
    only the blocks that walks want next are held; walks that want the same block go on as one. Out come the walked blocks (``found``), or
    where ``meet`` the first block of a pair's two sides, and the walks that leave the segment.
    """
    place, here, wanted, out = None, None, {}, []  # wanted: (number, hash) -> [steps since, {pair: [a, b]}, fewest steps, pairs that met]

    def join(at, new):
        old = wanted.setdefault(at, new)
        if old is new:
            return
        if len(old[1]) < len(new[1]):
            old, new = new, old
            wanted[at] = old
        by = new[0] - old[0]
        for pair, sides in new[1].items():
            mine = old[1].setdefault(pair, [None, None])
            for i, n in enumerate(sides):
                if n is not None and (mine[i] is None or n + by < mine[i]):
                    mine[i] = n + by
            if None not in mine:
                old[3].add(pair)
        old[2] = min(old[2], new[2] + by)

    def left():
        for (number, hash_), (since, pairs, _, _) in wanted.items():
            if number >> bits < place[1]:
                for pair, sides in pairs.items():
                    a, b = (None if n is None or n + since > depth else n + since for n in sides)
                    if a is not None or b is not None:
                        out.append((place[0], number, hash_, None, None, pair, a, b, False))
        wanted.clear()

    def flushed():
        columns = zip(*out, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for chain, number, hash_, up, up_hash, pair, a, b, waits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (chain, number >> bits) != place:
                left()
                place, here = (chain, number >> bits), None
            at = (number, hash_)
            if waits:
                out.append((chain, number, hash_, None, None, pair, a, b, False))
            elif pair is not None:
                join(at, [0, {pair: [a, b]}, min(n for n in (a, b) if n is not None), {pair} if a is not None and b is not None else set()])
            if pair is not None:
                continue
            if at != here:
                here, walk, seen, passed = at, wanted.pop(at, None), None, []
                if walk is not None:
                    since, pairs, _, met = walk
                    if meet:
                        for p in met:
                            x, y = pairs.pop(p)
                            if x + since <= depth and y + since <= depth:
                                out.append((chain, number, hash_, None, None, p, x + since, y + since, True))
                        met.clear()
                    else:
                        passed = [(p, x + since) for p, (x, _) in pairs.items() if x + since <= depth]
                    walk[0] += 1
                    walk = walk if pairs and walk[2] + walk[0] <= depth else None
            if passed and (up, up_hash) != seen:  # a block may be there with several parents
                seen = (up, up_hash)
                out.extend((chain, number, hash_, up, up_hash, p, x, None, True) for p, x in passed)
            if walk is not None and up is not None and up < number:
                if up_hash is not None:
                    join((up, up_hash), walk)
                walk = None
            if len(out) > 20_000:
                yield flushed()
    left()
    if out:
        yield flushed()


def _waiting(walks: DataFrame, bits: int) -> DataFrame:
    """Walks of pairs that still have both sides; ``waits``: the other side is in a higher segment, and comes first."""
    w, segment = Window.partitionBy(*KEYS, "pair"), F.shiftright("number", bits)
    both = walks.withColumn("_both", (F.count("a").over(w) > 0) & (F.count("b").over(w) > 0)).withColumn("waits", segment < F.max(segment).over(w))
    return both.filter("_both").drop("_both")


def _walked(arrivals: DataFrame, walks: DataFrame, depth: int, meet: bool) -> DataFrame:
    """What ``_sweep`` finds for walks (chain_id, number, hash, pair, a, b: the steps of a pair's sides) up from known blocks.

    Blocks are shuffled once, by chain and segment of heights, and sorted; a task streams them. Walks that leave their segment go on in a
    next round, over the segments that they want alone; a round's are wider, so there are few rounds. A pair's sides go through a segment
    together. Each round is a table.
    """
    blocks = arrivals.select(*KEYS, F.col("number").cast("long").alias("number"), "hash", F.col("parent_number").cast("long").alias("parent_number"), "parent_hash").filter("chain_id IS NOT NULL AND number IS NOT NULL AND hash IS NOT NULL")
    names = [*KEYS, "number", "hash", "parent_number", "parent_hash", "pair", "a", "b", "waits"]
    walks = walks.select(*KEYS, F.col("number").cast("long").alias("number"), "hash", "pair", "a", "b").filter("chain_id IS NOT NULL AND number IS NOT NULL AND hash IS NOT NULL AND pair IS NOT NULL")
    schema = T.StructType.fromDDL(_WALKED.format(chain=blocks.schema["chain_id"].dataType.simpleString(), pair=walks.schema["pair"].dataType.simpleString()))
    own = to_arrow_schema(schema)
    near, bits, found = blocks, SEGMENT, None
    while True:
        walks = _waiting(walks, bits) if meet else walks.withColumn("waits", F.lit(False))
        if found is not None:
            wanted = walks.filter("NOT waits").select(F.col("chain_id").alias("_chain"), F.shiftright("number", bits).alias("_segment")).distinct()
            near = blocks.join(wanted, (F.col("chain_id") == F.col("_chain")) & (F.shiftright("number", bits) == F.col("_segment")), "left_semi")
        rows = near.unionByName(walks, allowMissingColumns=True).select(*names)
        rows = rows.repartition(*KEYS, F.shiftright("number", bits)).sortWithinPartitions(*KEYS, F.desc("number"), "hash", F.desc_nulls_last("pair"), "parent_number", "parent_hash")
        kept = Kept(rows.mapInArrow(lambda batches, n=bits: _sweep(batches, depth, n, meet, own), schema), "ancestors").df
        found = kept.filter("found") if found is None else found.unionByName(kept.filter("found"))
        walks = kept.filter("NOT found").select(*KEYS, "number", "hash", "pair", "a", "b")
        if walks.isEmpty():
            return found
        bits = min(bits + WIDER, WIDEST)


def canonical_from(arrivals: DataFrame, head: DataFrame, depth: int) -> DataFrame:
    """Ancestors of each chain's head over parent links, at most ``depth``, all chains at once, by a sweep through their heights."""
    walks = head.select(*KEYS, "number", "hash", F.concat_ws("/", "number", "hash").alias("pair"), F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    return _walked(arrivals, walks, depth, False).select(*KEYS, "number", "hash", "parent_number", "parent_hash", F.col("a").alias("depth"))


def common_ancestors(arrivals: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(chain_id, pair, number, hash, steps_a, steps_b): where the chains of two heads part; pairs (chain_id, pair, a_number, a_hash,
    b_number, b_hash). A pair that shares no known block within ``depth`` steps isn't there."""
    none, start = F.lit(None).cast("long"), F.lit(0).cast("long")
    sides = [pairs.select(*KEYS, "pair", F.col(f"{s}_number").alias("number"), F.col(f"{s}_hash").alias("hash"), *[(start if s == n else none).alias(n) for n in "ab"]) for s in "ab"]
    met = _walked(arrivals, sides[0].unionByName(sides[1]), depth, True)
    best = met.groupBy(*KEYS, "pair").agg(F.max_by(F.struct("number", "hash", F.col("a").alias("steps_a"), F.col("b").alias("steps_b")), "number").alias("b"))
    return best.select(*KEYS, "pair", "b.*")


def running_finality(reports: DataFrame, order: str = "pos") -> DataFrame:
    """``reports`` (chain_id, number, hash) with the highest height so far; reports lower than it are ``regressive``."""
    rows, w = carried(reports, KEYS, [order], most={"_top": F.col("number")})
    rows = rows.withColumn("highest", F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return uncarried(rows, "_top").withColumn("regressive", F.col("number") < F.col("highest"))


def finality_conflicts(reports: DataFrame) -> DataFrame:
    """Heights that were reported final with different hashes."""
    return reports.groupBy(*KEYS, "number").agg(F.countDistinct("hash").alias("hashes")).filter("hashes > 1")


def epoch_finality(answers: DataFrame) -> DataFrame:
    """A view of the finalized head: within an epoch it never falls; answers (chain_id, epoch, pos, number) of an older epoch than
    one before them don't count."""
    # the highest (epoch, number) so far: its epoch is the newest, and all rows of that epoch before count
    rows, w = carried(answers, KEYS, ["pos"], most={"_top": F.struct("epoch", "number")})
    rows = rows.withColumn("_top", F.max("_top").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return uncarried(rows.filter(F.col("_seed") | (F.col("epoch") == F.col("_top.epoch"))).withColumn("finalized", F.col("_top.number")), "_top")


def confirmed_finality(probes: DataFrame, upstream: DataFrame) -> DataFrame:
    """The highest probe that upstream has with the same hash, per chain."""
    return probes.join(upstream, [*KEYS, "number", "hash"]).groupBy(*KEYS).agg(F.max("number").alias("number"), F.max_by("hash", "number").alias("hash"))

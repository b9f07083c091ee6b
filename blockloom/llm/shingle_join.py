"""N-gram Jaccard join: equal-group cells, count-vector R-trees inside them, exact verification, components.

A text's set holds the hashes of its distinct ``width``-word shingles. Texts of one set collapse first, so that exact copies
never meet each other. Two sets with Jaccard t or more differ in at most D = (|A| + |B|)(1 - t)/(1 + t) tokens. Tokens are
hashed into G > D groups (ranges of the hash space; G by class of size), so of two linked sets some group is the same: a cell is one
group's content, and only sets that share a cell can link. A set with D full groups or fewer might share only empty ones
with a partner (whose full groups would then be as few), so such sets are grouped again by another hash, ``LEVELS`` times; only sets
that stay so in all of them, some in 10**8, meet in cells of empty groups.

In a cell, an R-tree over vectors of group counts is descended where the sum of coordinate minima can still reach the overlap
asked for. Cells of more than ``CELL`` sets are dealt into blocks, each pair of blocks being a task. Sets reachable from each
other over such candidate pairs form a bundle, which is dealt into blocks of bounded weight and verified in three passes, a
pass skipping what is connected already: each block by itself; one set of each block's largest group with those of the
other blocks; and then all sets outside the bundle's largest group with all sets. So a bundle of near copies costs its size
and not its square, and no pair that could link two groups is left out. A task returns a spanning forest of the links it
found, never all pairs; it too bounds pairs by an R-tree before it verifies them on the sets.

(A single R-tree over all vectors prunes next to nothing: at 0.9 the radius is n/9.5, and boxes after as many splits as a
corpus gives lie closer than that. The cells keep it exact and make it shardable.)

Empty and null texts have an empty set and link with nothing. A text of fewer words than the width is one shingle. Equal
sets link. Repeated ids are one node (their rows' sets link through the id); a null id is its own component (null), linked
with nothing. Other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, mix64, partitions, slices, written

#: Bytes of text worked on at once, tokens of a block, dimensions of its count vectors, entries of an R-tree's node, ids of a block
#: of a cell, groupings of sets that fill few groups.
SLICE, BLOCK_TOKENS, DIMS, FAN, CELL, LEVELS = 1 << 20, 1 << 16, 64, 16, 4096, 8
_U64 = np.uint64
_BYTE = mix64(np.arange(1, 257, dtype=_U64))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], _U64)
_BASE = _U64(0x9FB21C651E98DF25)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw = [x.encode() if x else b"" for x in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    out = [np.zeros(0, _U64)] * len(raw)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    inside = np.flatnonzero(~gap)
    if not len(inside):
        return out
    chars = data[inside]
    chars = np.where((chars >= 65) & (chars <= 90), chars + 32, chars)
    first = np.flatnonzero(np.r_[True, np.diff(inside) > 1])
    lens = np.diff(np.r_[first, len(inside)])
    place = np.arange(len(inside)) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lens.max()), _BASE, _U64))
        words = mix64(np.add.reduceat(_BYTE[chars] * powers[place], first) + lens.astype(_U64))
        ends = np.cumsum([len(x) + 1 for x in raw])
        of = np.searchsorted(ends, inside[first], "right")
        n = len(words)
        full = n - width + 1
        if full > 0:
            sums = np.zeros(full, _U64)
            for k in range(width):
                sums += words[k : k + full] * _ODD[k]
            sums = mix64(sums)
            whole = of[:full] == of[width - 1 :]
            sums, owner = sums[whole], of[:full][whole]
        else:
            sums, owner = np.zeros(0, _U64), np.zeros(0, np.int64)
        counts = np.bincount(of, minlength=len(raw))
        cuts = np.searchsorted(owner, np.arange(len(raw) + 1))
        starts = np.cumsum(counts) - counts
        for i in np.flatnonzero(counts):
            if counts[i] >= width:
                out[i] = np.unique(sums[cuts[i] : cuts[i + 1]])
            else:
                w = words[starts[i] : starts[i] + counts[i]]
                out[i] = mix64(np.array([(w * _ODD[: len(w)]).sum(dtype=_U64) + _U64(len(w))], _U64))
    return out


class Plan:
    """Classes of size with their number of groups, for similarity num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]
        t = num / den
        ratio = t ** (3 if t >= 0.85 else 1.5)
        while self.edges[-1] < 1 << 31:
            self.edges.append(max(self.edges[-1] + 1, int(np.ceil(self.edges[-1] / ratio))))

    def differ(self, total: int) -> int:
        """Most tokens in which two linked sets of ``total`` tokens together differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def overlap(self, total):
        """Least overlap of linked sets."""
        return -(-total * self.num // (self.num + self.den))

    @lru_cache(maxsize=512)  # noqa: B019
    def groups(self, k: int) -> tuple[int, int]:
        """(G, spare) of a class: of two linked sets at least spare + 1 of G groups are the same."""
        most = self.differ(2 * (self.edges[k + 1] - 1))
        spare = most // (16 if self.num / self.den >= 0.85 else 8)
        return (most + 1 + spare, spare) if most else (0, 0)

    def classes(self, n: int) -> list[int]:
        """A set's own class, and the next one if a larger partner can be there."""
        k = int(np.searchsorted(self.edges, n, "right")) - 1
        return [k, k + 1] if n * self.den >= self.num * self.edges[k + 1] else [k]

    def cells(self, tokens: np.ndarray) -> np.ndarray:
        """Keys of the cells of a set of tokens (sorted 64-bit hashes)."""
        out = []
        with np.errstate(over="ignore"):
            for k in self.classes(len(tokens)):
                g, spare = self.groups(k)
                if not g:
                    continue  # linked sets of this size are equal
                cuts = (np.arange(1, g, dtype=_U64) * _U64((1 << 64) // g)).astype(_U64)
                for level in range(LEVELS):
                    placed = np.sort(mix64(tokens + _U64(level) * _ODD[0])) if level else tokens
                    starts = np.r_[0, np.searchsorted(placed, cuts)]
                    sizes = np.diff(np.r_[starts, len(placed)])
                    held = np.flatnonzero(sizes)
                    sums = np.add.reduceat(mix64(placed ^ _ODD[1]), starts[held]) + sizes[held].astype(_U64)
                    salt = mix64(np.arange(g, dtype=_U64) + _U64((k << 32) + (level << 48)))
                    out.append(mix64(sums ^ salt[held]))
                    if g - len(held) <= spare:  # else all the same groups of a pair can be empty ones
                        break
                else:
                    out.append(salt[np.flatnonzero(sizes == 0)])
        return np.concatenate(out) if out else np.zeros(0, _U64)


class RTree:
    """Bulk-loaded over vectors of counts; a node keeps its coordinates' maxima and its smallest set's size."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        order = self._tiles(vectors, sizes)
        self.order, self.vectors, self.sizes = order, vectors[order], sizes[order]
        self.levels = []
        top, least = self.vectors, self.sizes
        while len(top) > FAN:
            starts = np.arange(0, len(top), FAN)
            top, least = np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(least, starts)
            self.levels.append((top, least))

    @staticmethod
    def _tiles(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: by size, then within slabs by the coordinate that varies most there."""
        order = np.argsort(sizes, kind="stable")
        slab = FAN * max(1, int(np.sqrt(len(order) / FAN)))
        parts = []
        for at in range(0, len(order), slab):
            own = order[at : at + slab]
            dim = int(np.argmax(vectors[own].var(axis=0)))
            parts.append(own[np.argsort(vectors[own, dim], kind="stable")])
        return np.concatenate(parts) if parts else order

    def query(self, vector: np.ndarray, size: int, plan: Plan) -> np.ndarray:
        """Indexes whose summed coordinate minima with the vector reach the overlap asked for."""
        live = None
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            below = len(self.levels[depth - 1][0]) if depth else len(self.vectors)
            at = np.arange(len(top)) if live is None else live
            good = np.minimum(top[at], vector).sum(axis=1) >= plan.overlap(size + least[at])
            at = at[good]
            live = (at[:, None] * FAN + np.arange(FAN)).ravel()
            live = live[live < below]
        at = np.arange(len(self.vectors)) if live is None else live
        good = np.minimum(self.vectors[at], vector).sum(axis=1) >= plan.overlap(size + self.sizes[at])
        return self.order[at[good]]


def count_vector(tokens: np.ndarray, dims: int = DIMS) -> np.ndarray:
    return np.bincount((tokens % _U64(dims)).astype(np.int64), minlength=dims).astype(np.int32)


def width_for(n: int) -> int:
    """Dimensions of a set's vector: more for larger sets, whose counts differ less from chance."""
    return 64 if n < 512 else 256 if n < 4096 else 1024


def folded(vector: np.ndarray, dims: int) -> np.ndarray:
    """A vector of fewer dimensions over the same tokens."""
    return vector.reshape(-1, dims).sum(axis=0)


class Forest:
    """Labels of what is known to be connected, so that a whole array of candidates is sifted at once."""

    def __init__(self, labels: np.ndarray):
        self.labels, self.parts = labels, len(np.unique(labels))

    def apart(self, a: int, near: np.ndarray) -> np.ndarray:
        return near[self.labels[near] != self.labels[a]]

    def join(self, a: int, b: int) -> None:
        self.labels[self.labels == self.labels[b]] = self.labels[a]
        self.parts -= 1


def reachable(ids: list[int], sizes: np.ndarray, vectors: list[np.ndarray], side: np.ndarray, plan: Plan) -> list[tuple[int, int]]:
    """Pairs that connect the ids of a cell (or side 0 with side 1 of two blocks of it) as all pairs within the bound would: a
    spanning forest of what may link."""
    n, two = len(ids), bool(side.any() and not side.all())
    dims = min(len(v) for v in vectors)
    points = np.array([folded(v, dims) for v in vectors])
    forest, found = Forest(np.arange(n)), []
    own = np.flatnonzero(side) if two else np.arange(n)
    tree = RTree(points[own], sizes[own])
    for a in np.flatnonzero(side == 0) if two else own:
        if forest.parts == 1:
            break
        near = forest.apart(a, own[tree.query(points[a], int(sizes[a]), plan)])
        while len(near):
            found.append((ids[a], ids[near[0]]))
            forest.join(a, near[0])
            near = forest.apart(a, near)
    return found


def links_within(sets: list[np.ndarray], side: np.ndarray, plan: Plan, labels: np.ndarray) -> np.ndarray:
    """The smallest label that each set reaches over links between sets of side 0 and side 1, or among all if there is but one side;
    sets of one label are connected already."""
    names, first = np.unique(labels, return_inverse=True)
    forest = Forest(first.copy())
    vectors, sizes = np.array([count_vector(s) for s in sets]), np.array([len(s) for s in sets], np.int64)
    two = side.any() and not side.all()
    own = np.flatnonzero(side) if two else np.arange(len(sets))
    tree = RTree(vectors[own], sizes[own])
    for a in np.flatnonzero(side == 0) if two else own:
        if forest.parts == 1:
            break
        near = own[tree.query(vectors[a], int(sizes[a]), plan)]
        if not two:
            near = near[near > a]
        near = forest.apart(a, near)
        for b in near:
            if forest.labels[a] == forest.labels[b]:
                continue
            x, y = (sets[a], sets[b]) if sizes[a] < sizes[b] else (sets[b], sets[a])
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            if int((y[at] == x).sum()) >= plan.overlap(int(sizes[a] + sizes[b])):
                forest.join(a, b)
    least = np.full(len(names), len(names))
    np.minimum.at(least, forest.labels, first)
    return names[least[forest.labels]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id reachable over links of Jaccard num/den or more."""
    spark = docs.sparkSession
    arrow_rows(spark)
    plan = Plan(num, den)
    n_parts = partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            f1, f2 = _prints(sets)
            vectors = [count_vector(s, width_for(len(s))).astype("<u2" if len(s) < 1 << 16 else "<u4").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), f1, f2, pa.array(vectors, pa.binary())], ["id", "n", "f1", "f2", "vec"])

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            cells = [plan.cells(s) for s in shingle_sets(batch.column(1).to_pylist(), width)]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(c) for c in cells])
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(cells)), pa.array(ids.astype(np.int64))], ["cell", "id"])

    signed = written(source.mapInArrow(described, "id long, n long, f1 long, f2 long, vec binary"), "signed")
    members = signed.select("id", "n", "f1", "f2")
    known = members.filter("n > 0 AND id IS NOT NULL")
    classes = known.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    reps = written(classes.select("f1", "f2", "n", "rep"), "classes")
    rows = source.filter("id IS NOT NULL").mapInArrow(in_cells, "cell long, id long").repartition(n_parts, "cell").sortWithinPartitions("cell", "id")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of cells that several ids share; of a run of rows, what came last waits for the next batch."""
        last: tuple[int, int] | None = None
        told = False  # whether the waiting row is known to share its cell
        for batch in batches:
            if not batch.num_rows:
                continue
            c, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                c, i = np.r_[last[0], c], np.r_[last[1], i]
            same = c[1:] == c[:-1]
            keep = np.r_[told, same] | np.r_[same, False]
            last, told = (int(c[-1]), int(i[-1])), bool(keep[-1])
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]), pa.array(i[keep])], ["cell", "id"])
        if last is not None and told:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["cell", "id"])

    meet = written(rows.mapInArrow(shared, "cell long, id long"), "cells")
    large = written(meet.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks")).filter("blocks > 1"), "large-cells")
    own = signed.join(reps.select(F.col("rep").alias("id"), "f1", "f2").hint("merge"), ["id", "f1", "f2"]).select("id", "n", "vec")
    meet = meet.join(large.hint("merge"), "cell", "left") if not large.isEmpty() else meet.withColumn("blocks", F.lit(None).cast("int"))
    meet = _in_pairs(meet.withColumn("blocks", F.coalesce("blocks", F.lit(1))), ["cell"])
    meet = meet.join(own.hint("merge"), "id").select("cell", "i", "j", "side", "id", "n", "vec").repartition(n_parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "id")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _runs(batches, 3):
            side, ids, sizes, vecs = zip(*rows, strict=True)
            if len(ids) > 1 and (i == j or side[0] != side[-1]):
                yield _pairs(reachable(ids, np.array(sizes, np.int64), [np.frombuffer(v, "<u2" if n < 1 << 16 else "<u4").astype(np.int32) for v, n in zip(vecs, sizes, strict=True)], np.array(side), plan))

    bundles = components(meet.mapInArrow(near, "a long, b long"), "bundles")
    held = bundles.select(F.col("node").alias("id"), F.col("component").alias("bundle")).join(reps.select(F.col("rep").alias("id"), "f1", "f2", "n"), "id")
    held = written(held, "held")
    weights = held.groupBy("bundle").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"))
    placed = written(held.join(weights, "bundle").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "placed")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            f1, f2 = _prints(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), f1, f2, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "f1", "f2", "tokens"])

    def with_sets(rows: DataFrame) -> DataFrame:
        """Rows (id, f1, f2, ...) with the tokens of the class's own set, however many texts the id has."""
        # merge joins whatever the sizes: ids grow with the input, and one plan serves a small corpus and a large one
        texts = source.join(rows.select("id").distinct().hint("merge"), "id").mapInArrow(sets_of, "id long, f1 long, f2 long, tokens binary")
        return texts.join(rows.hint("merge"), ["id", "f1", "f2"]).dropDuplicates(["id", "f1", "f2"])

    def verified(dealt: DataFrame, what: str, each: bool = False) -> DataFrame:
        """Smallest labels that labels reach over links of rows (bundle, i, j, side, id, label, tokens): as (a, b) of those that are
        not their own, or of each row of a block by itself with what else it holds."""
        rest = ["blocks", "f1", "f2", "n"] if each else []

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (bundle, i, j), rows in _runs(batches, 3):
                side, labels, raw, *more = zip(*rows, strict=True)
                labels = np.array(labels, np.int64)
                if len(labels) > 1 and (i == j or side[0] != side[-1]):
                    to = links_within([np.frombuffer(x, _U64) for x in raw], np.array(side), plan, labels)
                elif each:
                    to = labels
                else:
                    continue
                if each:
                    m = len(labels)
                    yield pa.RecordBatch.from_arrays([pa.array([bundle] * m, pa.int64()), pa.array([i] * m, pa.int32()), pa.array(labels), pa.array(to), pa.array(more[0], pa.int32()), *[pa.array(x, pa.int64()) for x in more[1:]]], ["bundle", "block", "id", "label", *rest])
                else:
                    yield _pairs(sorted({(x, y) for x, y in zip(labels.tolist(), to.tolist(), strict=True) if x != y}))

        dealt = dealt.select("bundle", "i", "j", "side", "label", "tokens", *rest).repartition(n_parts, "bundle", "i", "j").sortWithinPartitions("bundle", "i", "j", "side", "label")
        return written(dealt.mapInArrow(verify, "bundle long, block int, id long, label long, blocks int, f1 long, f2 long, n long" if each else "a long, b long"), what)

    # a set is in one block by itself, so what it reaches there is a label that holds for the whole block
    alone = placed.select("bundle", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"), "id", "f1", "f2", F.col("id").alias("label"), "blocks", "n")
    within = verified(with_sets(alone), "links-within", each=True)
    several = within.filter("blocks > 1")
    labels, links = within.select("id", "label"), None
    if not several.isEmpty():
        # one set of each block's largest group
        groups = several.groupBy("bundle", "block", "label").agg(F.count("*").alias("m"), F.min(F.struct("id", "f1", "f2")).alias("one"))
        chosen = groups.groupBy("bundle", "block").agg(F.max_by(F.struct("one", "label"), F.struct("m", "label")).alias("x"))
        chosen = written(chosen.select("bundle", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "x.one.id", "x.one.f1", "x.one.f2", "x.label"), "chosen")
        # those of a bundle meet in one block, and a label is in one bundle: its way is known after that
        across = verified(with_sets(chosen), "links-of-blocks").select(F.col("a").alias("label"), F.col("b").alias("to"))
        several = written(several.join(across, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "merged")
        labels = within.filter("blocks = 1").select("id", "label").unionAll(several.select("id", "label"))
        # all that is outside the bundle's largest group with all of the bundle
        groups = several.groupBy("bundle", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
        main = groups.groupBy("bundle").agg(F.max_by(F.struct("label", "n"), F.struct("m", "label")).alias("x"), F.sum("n").alias("all")).filter("all > x.n")
        main = written(main.select("bundle", F.col("x.label").alias("main"), F.ceil((F.col("all") - F.col("x.n")) / BLOCK_TOKENS).cast("int").alias("rest"), F.ceil(F.col("x.n") / BLOCK_TOKENS).cast("int").alias("own")), "main")
        spread = several.drop("block", "blocks").join(main.hint("merge"), "bundle").withColumn("inside", F.col("label") == F.col("main"))
        # blocks 0 to rest - 1 hold what is outside, the others the largest group, whose own pairs are connected
        spread = spread.withColumn("block", F.expr("cast(if(inside, rest + pmod(xxhash64(id, 1), own), pmod(xxhash64(id, 1), rest)) AS int)")).withColumn("others", F.expr("if(inside, rest, rest + own)"))
        if not main.isEmpty():
            links = verified(_in_pairs(with_sets(spread.select("bundle", "block", "others", "id", "f1", "f2", "label")), ["bundle"], "others"), "links-of-rest")
    labels = labels.dropDuplicates(["id"])
    # rows of one id with several sets tie these sets together
    again = written(known.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id"), "again")
    if not again.isEmpty():
        ties = known.join(reps, ["f1", "f2", "n"]).filter("id <> rep").join(again, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        for end in ("a", "b"):
            ties = ties.join(labels.select(F.col("id").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        ties = ties.select("a", "b")
        links = ties if links is None else links.unionAll(ties)
    linked = labels.select(F.col("id").alias("node"), F.col("label").alias("component"))
    if links is not None:
        moved = written(components(links, "links"), "moved")
        moved = moved.select(F.col("node").alias("label"), F.col("component").alias("to"))
        # what only ties reach has no label of a block
        lone = moved.join(labels.select(F.col("id").alias("label")), "label", "left_anti").select(F.col("label").alias("id"), "label")
        linked = labels.unionAll(lone).join(moved, "label", "left").select(F.col("id").alias("node"), F.coalesce("to", "label").alias("component"))
    out = members.join(reps, ["f1", "f2", "n"], "left").withColumn("node", F.coalesce("rep", "id"))
    out = out.join(linked, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "node")).otherwise(F.col("id")).alias("component_id"))


def without_near_copies(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group that links connect, with all its columns: that with the smallest id; null ids come last.

    Rows are numbered for it, so that repeated ids and rows without one are rows like others. Empty texts link with nothing and stay.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")
    groups = jaccard_components(rows.select(F.col("at").alias("doc_id"), F.col("row")[text].alias("text")), width, num, den)
    order = F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"), "at")
    first = groups.join(rows.select(F.col("at").alias("doc_id"), order.alias("order")), "doc_id").groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(first.select(F.col("order.at").alias("at")).hint("merge"), "at", "left_semi").select("row.*")


def _in_pairs(rows: DataFrame, key: list[str], others: str = "blocks") -> DataFrame:
    """Rows once for each pair of blocks (i <= j) that they are in: with every block below ``others``; ``block`` by hash where not given."""
    if "block" not in rows.columns:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col(others)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0, {others} - 1)")))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
    return rows.select(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), side.alias("side"), *[c for c in rows.columns if c not in (*key, "block", "other", others)])


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with the same first ``n`` columns; rows without these columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n] != key:
                if held:
                    yield key, held
                key, held = row[:n], []
            held.append(row[n:])
    if held:
        yield key, held


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _prints(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two hashes of each set."""
    with np.errstate(over="ignore"):
        fp = np.array([[mix64(s).sum(dtype=_U64), mix64(s ^ _ODD[2]).sum(dtype=_U64)] for s in sets], _U64).reshape(-1, 2)
    return _signed(np.ascontiguousarray(fp[:, 0])), _signed(np.ascontiguousarray(fp[:, 1]))


#: The query's rows (three words, 90 of 100) in DuckDB's SQL: pairs that share a shingle, then the nodes reachable from each.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(least(a, b)) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.component_id, n.doc_id) AS component_id FROM n LEFT JOIN c ON n.doc_id = c.a
"""

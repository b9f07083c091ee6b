"""Hard negatives by k-means inverted lists with stored radii.

Vectors become integers; a row's score is its integer inner product with an anchor. Centroids are fitted on a bounded sample (the
``SAMPLE`` rows with the smallest hashes); every row goes to the list of its nearest centroid, and each list stores its radius, the
largest distance of a row from the centroid. By Cauchy and Schwarz the scores of a list lie within a.c - |a|r and a.c + |a|r. An anchor
visits the lists in falling order of that upper bound, a few at first and four times as many in each further round; it passes over
lists whose bounds lie outside its window and stops where the bound falls strictly below its k-th score (a tie may still win by its
id). So nothing is lost: the lists decide how much is compared, never what is found. A first search finds the positives (same label, no
window), a second one the negatives of all windows of an anchor at once.

A round joins visits with the lists' blocks of rows: long lists are dealt over salts, and a list that many anchors visit is copied
for each ``ANCHORS`` of them, so no task has more than a block's share of a hot list or of a crowd of anchors. What a block finds above
the k-th scores comes back to the anchor's state, a row of a table in the shared folder.

Rows without id, label or vector, or with a null component or one that isn't finite (256 times it neither) take no part. Rows of another
length than an anchor's have no product with it. "Other rows" are those with another id; each row counts on its own, and an anchor that
is there several times has its results several times. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, written

#: Rows that the centroids are fitted on, rows a list should hold, most lists, bytes of centroids sent to tasks, rows of a block, of a
#: salt, anchors that a copy of a list serves, lists of a first visit, growth of visits.
SAMPLE, LIST_ROWS, MOST_LISTS, CENTROID_BYTES, BLOCK, SALT_ROWS, ANCHORS, FIRST, GROWTH, STEPS = 16_384, 512, 4_096, 4 << 20, 2_048, 16_384, 2_048, 4, 4, 6
NONE, EXACT = -(1 << 63), float(1 << 53)


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that take part, their vectors as doubles that are integers."""
        for batch in batches:
            ids, labels, col = batch.columns
            with np.errstate(all="ignore"):
                x = np.floor(scale * col.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64))
            at = col.offsets.to_numpy().astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = ~(ids.is_null().to_numpy(False) | labels.is_null().to_numpy(False) | col.is_null().to_numpy(False))
            good = np.flatnonzero(some & (bad[at[1:]] == bad[at[:-1]]))
            vec = [x[at[i] : at[i + 1]] for i in good.tolist()]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(good)), labels.take(pa.array(good)), pa.array([len(v) for v in vec], pa.int32()), pa.array([float(np.abs(v).max(initial=0)) for v in vec], pa.float64()), pa.array([v.tobytes() for v in vec], pa.binary())],
                ["id", "label", "d", "most", "vec"],
            )

    return run


def _matrix(raw: list[bytes], kind: str, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), d).astype(np.float64)


def fitted(x: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of the rows by Lloyd's steps from a seeded start."""
    out = x[np.random.default_rng(len(x)).permutation(len(x))[:lists]].copy()
    for _ in range(STEPS):
        own = nearest(x, out)[0]
        sums, n = np.zeros_like(out), np.bincount(own, minlength=len(out))
        np.add.at(sums, own, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its nearest centroid and the distance from it, which is exact but for rounding."""
    own = np.zeros(len(x), np.int64)
    half = (centroids * centroids).sum(1) / 2
    for at in range(0, len(x), 1024):
        own[at : at + 1024] = (half[None, :] - x[at : at + 1024] @ centroids.T).argmin(1)
    off = x - centroids[own]
    return own, np.sqrt((off * off).sum(1))


class Lists:
    """Centroids by vectors' length and, once known, radii. Lengths that the sample lacks have one list without a bound."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids, self.radii = centroids, {d: np.full(len(c), np.inf) for d, c in centroids.items()}

    def bounds(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest score that a row of each list can have."""
        c = self.centroids.get(len(vec))
        if c is None:
            return np.array([-np.inf]), np.array([np.inf])
        mid, reach = c @ vec, np.sqrt(vec @ vec) * self.radii[len(vec)]
        slack = 1e-6 + 1e-9 * (np.abs(mid) + reach + np.sqrt((c * c).sum(1) * (vec @ vec)))  # what rounding may take
        return mid - reach - slack, mid + reach + slack


STATE = "id long, h long, label long, d int, vec binary, copies long, at int, next array<int>, pos binary, top binary"


def _windows(pos: np.ndarray, low: tuple[int, int], high: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Least and highest score of the negatives of each positive (id, score)."""
    return [-(-low[0] * s // low[1]) for s in pos[:, 1].tolist()], [high[0] * s // high[1] for s in pos[:, 1].tolist()]


def _advance(lists: Lists, vec: np.ndarray, at: int, least: list[float], highest: list[float], most: int) -> tuple[list[int], int]:
    """The next lists to visit, at most so many, and the place in the order of lists behind them. ``least``: what a score must reach."""
    low, high = lists.bounds(vec)
    order = np.argsort(-high, kind="stable")[at:]
    wanted = np.zeros(len(order), bool)
    for a, b in zip(least, highest, strict=True):
        if a <= b:
            wanted |= (high[order] >= a) & (low[order] <= b)
    found = np.flatnonzero(wanted)[:most]
    return order[found].tolist(), at + (int(found[-1]) + 1 if len(found) == most else len(order))


class Search:
    """One search of all anchors: of the same label without a window, or of other labels within each positive's window."""

    def __init__(self, lists: Lists, kind: str, same: bool, k: int, low: tuple[int, int], high: tuple[int, int]):
        self.lists, self.kind, self.same, self.k, self.low, self.high = lists, kind, same, k, low, high

    def slots(self, pos: bytes) -> tuple[list[float], list[float]]:
        return ([-np.inf], [np.inf]) if self.same else _windows(np.frombuffer(pos, np.int64).reshape(-1, 2), self.low, self.high)

    def least(self, low: list[float], top: np.ndarray) -> list[float]:
        """What a score of each slot must reach: its window's foot or its k-th score so far."""
        return [max(a, int(t[-1, 0])) if t[-1, 0] != NONE else a for a, t in zip(low, top, strict=True)]

    def row(self, row: tuple, top: np.ndarray, at: int, most: int) -> tuple:
        """A state row after its slots have changed."""
        id_, h, label, d, vec, copies, _, _, pos, _ = row
        low, high = self.slots(pos)
        nxt, at = _advance(self.lists, np.frombuffer(vec, self.kind).astype(np.float64), at, self.least(low, top), high, most)
        return id_, h, label, d, vec, copies, at, nxt, pos, top.tobytes()

    def start(self, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """States of anchors, which may hold a finished search's results: these become the positives."""
            for batch in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not self.same:
                        top = np.frombuffer(row[9], np.int64).reshape(-1, 2)
                        row = (*row[:8], np.ascontiguousarray(top[top[:, 0] != NONE][:, ::-1]).tobytes(), b"")
                    top = np.zeros((len(self.slots(row[8])[0]), self.k, 2), np.int64)
                    top[:, :, 0] = NONE
                    out.append(self.row(row, top, 0, most))
                yield _states(out)

        return run

    def compare(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by list, salts and kind: anchors first, which are held, then the list's blocks."""
        key, held, ready = None, [], None
        for batch in batches:
            names = ["d", "cluster", "salt", "crowd", "kind", "id", "h", "label", "vec", "pos", "top", "ids", "labels"]
            for d, cluster, salt, crowd, kind, id_, h, label, vec, pos, top, ids, labels in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if key != (d, cluster, salt, crowd):
                    key, held, ready = (d, cluster, salt, crowd), [], None
                if kind == 0:
                    low, high = self.slots(pos)
                    held.append((id_, h, label, vec, self.least(low, np.frombuffer(top, np.int64).reshape(-1, self.k, 2)), high))
                elif held:
                    if ready is None:
                        ready = self.crowd(held, d)
                    yield from self.block(ready, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(vec, self.kind).reshape(len(ids) // 8, d).astype(np.float64))

    def crowd(self, held: list[tuple], d: int):
        slots = max(len(r[4]) for r in held)
        low, high = np.full((slots, len(held)), np.inf), np.full((slots, len(held)), -np.inf)
        for i, r in enumerate(held):
            low[: len(r[4]), i], high[: len(r[5]), i] = r[4], r[5]
        return np.array([r[0] for r in held]), np.array([r[1] for r in held]), np.array([r[2] for r in held]), _matrix([r[3] for r in held], self.kind, d), low, high

    def block(self, crowd, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The best ``k`` of a block for each slot of each anchor, among those that its k-th score lets pass; ties by smaller ids."""
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        for at in range(0, len(crowd[0]), 256):
            name, h, label, vec, low, high = (c[at : at + 256] if i < 4 else c[:, at : at + 256] for i, c in enumerate(crowd))
            score = products(x, vec)
            fit = ((labels[:, None] == label[None, :]) == self.same) & (ids[:, None] != name[None, :])
            for slot in range(len(low)):
                i, j = np.nonzero(fit & (score >= low[slot]) & (score <= high[slot]))
                if not len(i):
                    continue
                own = score[i, j]
                by = np.lexsort((i, -own, j))
                i, j, own = i[by], j[by], own[by]
                place = np.arange(len(j)) - np.searchsorted(j, j, "left")
                best = place < self.k
                i, j, own = i[best], j[best], own[best]
                yield pa.RecordBatch.from_arrays([pa.array(name[j]), pa.array(h[j]), pa.array(np.full(len(j), slot, np.int32)), pa.array(ids[i]), pa.array(own)], ["id", "h", "slot", "other", "score"])

    def merge(self, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of rows sorted by anchor and kind: its state, then what was found for it."""
            state, found, done = None, {}, []

            def closed() -> tuple:
                top = np.frombuffer(state[9], np.int64).reshape(-1, self.k, 2).copy()
                for slot, new in found.items():
                    all_ = sorted([*((-s, o) for s, o in top[slot].tolist() if s != NONE), *new])[: self.k]
                    top[slot, : len(all_)] = [(-s, o) for s, o in all_]
                return self.row(state, top, state[6], most)

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[2] == 0:
                        if state is not None:
                            done.append(closed())
                        state, found = (*row[:2], *row[3:11]), {}
                        if len(done) >= 256:
                            yield _states(done)
                            done = []
                    else:
                        own = found.setdefault(row[11], [])
                        own.append((-row[13], row[12]))
                        if len(own) > 16 * self.k:
                            own.sort()
                            del own[self.k :]
            if state is not None:
                done.append(closed())
            if done:
                yield _states(done)

        return run


def _states(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], [part.split()[0] for part in STATE.split(", ")])


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, exact; those beyond a long are the nearest long."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, x.shape[1]) < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in y.tolist()]
    out = [[min(max(sum(int(v) * w for v, w in zip(row, other, strict=True)), NONE + 1), -NONE - 1) for other in whole] for row in x.tolist()]
    return np.array(out, np.int64).reshape(len(x), len(y))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by list and salt: blocks of ``BLOCK`` rows at most."""
    key, ids, labels, vecs = None, [], [], []

    def block() -> pa.RecordBatch:
        columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[2]], pa.int32()), *(pa.array([b], pa.binary()) for b in (np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), b"".join(vecs)))]
        return pa.RecordBatch.from_arrays(columns, ["d", "cluster", "salt", "ids", "labels", "vec"])

    for batch in batches:
        for d, cluster, salt, id_, label, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (key != (d, cluster, salt) or len(ids) == BLOCK):
                yield block()
                ids, labels, vecs = [], [], []
            key = d, cluster, salt
            ids.append(id_)
            labels.append(label)
            vecs.append(vec)
    if ids:
        yield block()


def _searched(search: Search, state: DataFrame, blocks: DataFrame, sizes: DataFrame, what: str) -> DataFrame:
    """Final states: rounds of visits until no anchor wants another list."""
    n_parts, most = partitions(state.sparkSession), FIRST
    now = written(state.mapInArrow(search.start(most), STATE), f"{what}-state")
    while not now.filter("size(next) > 0").isEmpty():
        most *= GROWTH
        visits = now.filter("size(next) > 0").withColumn("cluster", F.explode("next"))
        # a row a list: its salts and the copies that its visitors need
        crowds = visits.groupBy("d", "cluster").agg(F.count("*").alias("n")).join(F.broadcast(sizes), ["d", "cluster"]).select("d", "cluster", "salts", F.ceil(F.col("n") / ANCHORS).cast("int").alias("crowds"))
        crowds = F.broadcast(crowds)
        left = visits.join(crowds, ["d", "cluster"]).withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).withColumn("crowd", F.expr("cast(pmod(xxhash64(id, h), crowds) AS int)"))
        right = blocks.join(crowds, ["d", "cluster"]).withColumn("crowd", F.explode(F.expr("sequence(0, crowds - 1)")))
        columns = "d", "cluster", "salt", "crowd"
        left = left.select(*columns, F.lit(0).alias("kind"), "id", "h", "label", "vec", "pos", "top", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("labels"))
        right = right.select(*columns, F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in (("id", "long"), ("h", "long"), ("label", "long"))), "vec", *(F.lit(None).cast("binary").alias(n) for n in ("pos", "top")), "ids", "labels")
        both = left.unionAll(right).repartition(n_parts, *columns).sortWithinPartitions(*columns, "kind")
        found = both.mapInArrow(search.compare, "id long, h long, slot int, other long, score long")
        own = [c for c in now.columns if c not in ("id", "h")]
        rows = now.select("id", "h", F.lit(0).alias("kind"), *own, F.lit(None).cast("int").alias("slot"), F.lit(None).cast("long").alias("other"), F.lit(None).cast("long").alias("score"))
        rows = rows.unionAll(found.select("id", "h", F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(n) for n, t in now.dtypes if n in own), "slot", "other", "score"))
        after = written(rows.repartition(n_parts, "id", "h").sortWithinPartitions("id", "h", "kind").mapInArrow(search.merge(most), STATE), f"{what}-state")
        discard(now)
        now = after
    return now


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, per: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
    scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor's first ``positives`` rows of its label,
    for each of them the first ``per`` rows of other labels whose score is at least ``low`` and at most ``high`` times the positive's.
    ``anchors`` is a condition on the column ``id``; higher scores come first, then smaller ids."""
    spark = rows.sparkSession
    n_parts = partitions(spark)
    shown = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vec"))
    whole = written(shown.mapInArrow(_integers(scale), "id long, label long, d int, most double, vec binary"), "vectors")
    n, most = whole.agg(F.count("*"), F.max("most")).first()
    sample = whole.orderBy(F.xxhash64("id", "vec"), "id").limit(SAMPLE).select("d", "vec").collect()
    kind = "<i2" if (most or 0) < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    by: dict[int, list[bytes]] = {}
    for r in sample:
        by.setdefault(r.d, []).append(bytes(r.vec))
    wanted = {d: max(min(8, len(v)), min(MOST_LISTS, len(v), CENTROID_BYTES // (8 * max(d, 1) * len(by)), -(-n * len(v) // (len(sample) * LIST_ROWS)))) for d, v in by.items()}
    lists = Lists({d: fitted(_matrix(v, "<f8", d), wanted[d]) for d, v in by.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, raw = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            cluster, far, vecs = np.zeros(len(d), np.int32), np.zeros(len(d)), [b""] * len(d)
            for size in np.unique(d).tolist():
                at = np.flatnonzero(d == size)
                x = _matrix([raw[i] for i in at], "<f8", size)
                if size in lists.centroids:
                    cluster[at], far[at] = nearest(x, lists.centroids[size])
                for i, v in zip(at.tolist(), x.astype(kind), strict=True):
                    vecs[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vecs, pa.binary()), pa.array(cluster), pa.array(far)], ["id", "label", "d", "vec", "cluster", "far"])

    dealt = written(whole.select("id", "label", "d", "vec").mapInArrow(assign, "id long, label long, d int, vec binary, cluster int, far double"), "assigned")
    # a row a list
    sizes = written(dealt.groupBy("d", "cluster").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"), F.max("far").alias("radius")), "sizes")
    for r in sizes.filter(F.col("d").isin(list(lists.radii))).collect():  # at most the lists
        lists.radii[r.d][r.cluster] = r.radius * (1 + 1e-9) + 1e-6
    salted = dealt.join(F.broadcast(sizes), ["d", "cluster"]).withColumn("salt", F.expr("cast(pmod(xxhash64(id, vec), salts) AS int)"))
    salted = salted.select("d", "cluster", "salt", "id", "label", "vec").repartition(n_parts, "d", "cluster", "salt").sortWithinPartitions("d", "cluster", "salt")
    blocks = written(salted.mapInArrow(_packed, "d int, cluster int, salt int, ids binary, labels binary, vec binary"), "lists")
    first = dealt.filter(anchors).groupBy("id", "label", "d", "vec").agg(F.count("*").alias("copies"))
    first = first.select("id", F.xxhash64("label", "vec").alias("h"), "label", "d", "vec", "copies", F.lit(0).alias("at"), F.lit(None).cast("array<int>").alias("next"), F.lit(None).cast("binary").alias("pos"), F.lit(None).cast("binary").alias("top"))
    near = _searched(Search(lists, kind, True, positives, low, high), first, blocks, sizes, "positives")
    far = _searched(Search(lists, kind, False, per, low, high), near, blocks, sizes, "negatives")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, copies, pos, top in zip(*(batch.column(c).to_pylist() for c in ("id", "copies", "pos", "top")), strict=True):
                for (p, s), found in zip(np.frombuffer(pos, np.int64).reshape(-1, 2).tolist(), np.frombuffer(top, np.int64).reshape(-1, per, 2).tolist(), strict=True):
                    out.extend((id_, p, k + 1, o, s, t) for _ in range(copies) for k, (t, o) in enumerate(found) if t != NONE)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return far.mapInArrow(results, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


#: The same rows by all products, for ids that are not repeated.
ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

"""Embedding near-duplicates by NN-descent.

Equal vectors of a label collapse first. A neighbour graph of ``K`` neighbours a vector starts from windows of two orders by
random hyperplanes' signs (the rows are numbered over all partitions, so a window never ends at a partition's cut, and any
``WINDOW / 2`` rows in a row, such as a small label, stand whole in one) and is refined by joins of neighbours with their neighbours: of all vectors around a centre (its neighbours and
those that have it as one; large gatherings are split), pairs with a new one among them are compared, and each vector keeps
its best ``K``. Vectors whose whole list is at the threshold or above are saturated: their lists double, up to ``K_MOST``. An audit compares
vectors of the components found, and of those that no component holds, with all others of their label and asks for further
rounds until ``RECALL`` of their links, averaged over vectors, lie in the components found. Where the last audit saw any link
lost, all vectors of a label are compared exactly, in blocks; a loss that no probe meets stays.

The edges at the threshold give components. Lists of ``K_MOST`` can't hold all links of dense families, so lists may join two
families nowhere although they link. But a vector that met a link at all has one in its list (it gives one up for better ones
only), hence the linked vectors of a label are compared, in blocks and exactly, across components, and components that link
are joined. A vector's links to linked vectors then lie in its component and are counted there, exactly, by blocks of the
component's vectors against each other; no pair is written. Nothing below the threshold links.

Vectors that are null, zero, or hold null or non-finite components, and rows without a label, link with nothing. Vectors of
other lengths than their label's have no cosine and do not link with them. Repeated ids are rows of their own; a null id is
linked like others and is never the smallest: vectors are numbered for the search, and a component takes the smallest id that
any of its rows has, null only where none has one. An empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, partitions, written

K, K_MOST, ROUNDS, GATHER, WINDOW, AUDIT, RECALL, SETTLED = 10, 40, 8, 64, 256, 200, 0.98, 0.002
#: Rows of a block of vectors compared at once with another block; probes of the audit among vectors without links, times AUDIT.
TILE, LONE = 256, 10
LOG = logging.getLogger(__name__)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles, null where there is none."""
    for batch in batches:
        out = []
        for v in batch.column(2).to_pylist():
            x = None
            if v is not None and len(v) and None not in v:
                x = np.asarray(v, np.float64)
                with np.errstate(all="ignore"):
                    scale = np.abs(x).max()
                    x = x / scale if scale > 0 and np.isfinite(x).all() else None
                    x = None if x is None else (x / np.sqrt(x @ x)).tobytes()
            out.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "label", "vec"])


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if sims.shape[1] > k else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


def _edges(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["u", "v", "sim"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition with their place in it."""
    at = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "place"])
        at += batch.num_rows


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best neighbours within windows: of rows sorted by (w, label, size), those of one label and length."""

    def compare(rows):
        u, vec = np.array([r[0] for r in rows]), _unit([r[1] for r in rows])
        sims = vec @ vec.T
        np.fill_diagonal(sims, -2)
        near = _top(sims, K)
        rest = sims[np.arange(len(u))[:, None], near]
        good = rest > -2
        return _edges(np.repeat(u, good.sum(1)), u[near][good], rest[good])

    key, held = None, []
    for batch in batches:
        for w, label, size, u, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (w, label, size):
                if len(held) > 1:
                    yield compare(held)
                key, held = (w, label, size), []
            held.append((u, vec))
    if len(held) > 1:
        yield compare(held)


def _in_windows(coded: DataFrame, n_parts: int) -> DataFrame:
    """(w, label, size, u, vec): the rows in order, each in the two windows of ``WINDOW`` rows that hold it."""
    order = ["label", "size", "code", "u"]
    rows = coded.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = written(rows.mapInArrow(_numbered, "u long, label string, vec binary, size int, code long, part int, place long"), "order")
    before = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # a row for each partition
    rows = rows.join(F.broadcast(before), "part").withColumn("w", F.expr(f"(base + place) DIV {WINDOW // 2}"))
    return rows.withColumn("w", F.explode(F.array(F.col("w") - 1, F.col("w")))).select("w", "label", "size", "u", "vec").repartition(n_parts, "w").sortWithinPartitions("w", "label", "size")


def _coded(dim_seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, codes = batch.column(2).to_pylist(), []
            for size in {len(v) for v in vecs}:
                planes = np.random.default_rng([dim_seed, size]).standard_normal((size // 8, 24))
                own = [i for i, v in enumerate(vecs) if len(v) == size]
                signs = (_unit([vecs[i] for i in own]) @ planes > 0).astype(np.int64)
                codes.extend(zip(own, (signs << np.arange(24)).sum(1).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(v) for v in vecs], pa.int32()), pa.array([c for _, c in sorted(codes)], pa.int64())], ["u", "label", "vec", "size", "code"])

    return run


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (u, sim falling, v): the first ``k`` distinct neighbours of each u, flagged where new."""
    u_now, seen, room = None, set(), 0
    for batch in batches:
        out = []
        for u, v, sim, old, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if u != u_now:
                u_now, seen, room = u, set(), k
            if v not in seen and len(seen) < room:
                seen.add(v)
                out.append((u, v, sim, old))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["u", "v", "sim", "old"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by centre: for each vector of a gathering, the others that beat its worst neighbour."""

    def compare(rows):
        rows = list({r[0]: r for r in sorted(rows, key=lambda r: r[1])}.values())  # a fresh entry of a vector wins
        w, fresh, worst, room = (np.array([r[c] for r in rows]) for c in (0, 1, 2, 3))
        vec = _unit([r[4] for r in rows])
        sims = vec @ vec.T
        sims[~(fresh[:, None] | fresh[None, :])] = -2
        np.fill_diagonal(sims, -2)
        near = _top(sims, min(len(rows), int(room.max())))
        rest = sims[np.arange(len(w))[:, None], near]
        good = rest > worst[:, None]
        return _edges(np.repeat(w, good.sum(1)), w[near][good], rest[good])

    key, held = None, []
    for batch in batches:
        for c, s, w, fresh, worst, room, vec in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != (c, s):
                if len(held) > 1:
                    yield compare(held)
                key, held = (c, s), []
            held.append((w, fresh, worst, room, vec))
    if len(held) > 1:
        yield compare(held)


def _counted(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (component, i, j): each vector's linked rows on the other side, copies counted."""

        def compare(rows):
            u, side, copies = (np.array([r[c] for r in rows]) for c in (0, 1, 2))
            vec = _unit([r[3] for r in rows])
            if side.any():
                a, b = np.flatnonzero(side == 0), np.flatnonzero(side)
                good = (vec[a] @ vec[b].T) >= threshold
                n = np.r_[good @ copies[b], copies[a] @ good]
                u = np.r_[u[a], u[b]]
            else:
                good = (vec @ vec.T) >= threshold
                np.fill_diagonal(good, False)
                n = good @ copies
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64())], ["u", "n"])

        key, held = None, []
        for batch in batches:
            for c, i, j, side, u, copies, vec in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != (c, i, j):
                    if held and (key[1] == key[2] or (held[0][1] != held[-1][1])):
                        yield compare(held)
                    key, held = (c, i, j), []
                held.append((u, side, copies, vec))
        if held and (key[1] == key[2] or (held[0][1] != held[-1][1])):
            yield compare(held)

    return run


def _across(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (label, size, i, j, side): pairs that connect the components as all links across them would."""

        def compare(rows):
            side, of = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            names, of = np.unique(of, return_inverse=True)
            vec, now, found = _unit([r[2] for r in rows]), np.arange(len(names)), []
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == side.max())
            for at in range(0, len(a) if len(names) > 1 else 0, TILE):
                own = a[at : at + TILE]
                p, q = now[of[own]], now[of[b]]
                x, y = np.nonzero((vec[own] @ vec[b].T >= threshold) & (p[:, None] != q[None, :]))
                for pair in np.unique(p[x] * len(names) + q[y]):
                    one, two = divmod(int(pair), len(names))
                    if now[one] != now[two]:
                        now[now == now[two]] = now[one]
                        found.append((names[one], names[two]))
            return pa.RecordBatch.from_arrays([pa.array([int(r[c]) for r in found], pa.int64()) for c in range(2)], ["a", "b"])

        key, held = None, []
        for batch in batches:
            for label, size, i, j, side, component, vec in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != (label, size, i, j):
                    if held and (key[2] == key[3] or held[0][0] != held[-1][0]):
                        yield compare(held)
                    key, held = (label, size, i, j), []
                held.append((side, component, vec))
        if held and (key[2] == key[3] or held[0][0] != held[-1][0]):
            yield compare(held)

    return run


def bridged(vectors: DataFrame, threshold: float) -> DataFrame:
    """(u, component) of vectors (u, label, vec, component) after components of a label that link are joined: every pair of a
    label's vectors here is compared, in blocks against each other."""
    n_parts, kind = partitions(vectors.sparkSession), ["label", "size"]
    vectors = vectors.withColumn("size", F.octet_length("vec"))
    several = vectors.groupBy(*kind).agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    several = several.select(*kind, F.expr("cast(least(ceil(m / 8192), 16 + ceil(m / 65536)) AS int)").alias("blocks"))
    dealt = vectors.join(several, kind).withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select(*kind, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "component", "vec")
    dealt = dealt.repartition(n_parts, *kind, "i", "j").sortWithinPartitions(*kind, "i", "j", "side")
    met = written(dealt.mapInArrow(_across(threshold), "a long, b long"), "across")
    if met.isEmpty():
        return vectors.select("u", "component")
    moved = components(met, "across").select(F.col("node").alias("component"), F.col("component").alias("to"))
    return vectors.join(moved, "component", "left").select("u", F.coalesce("to", "component").alias("component"))


def descend(vectors: DataFrame, threshold: float, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """(u, v, sim): the refined graph over vectors (u, label, vec)."""
    n_parts, n = partitions(vectors.sparkSession), vectors.count()
    first = None
    for seed in (1, 2):
        coded = vectors.select("u", "label", "vec").mapInArrow(_coded(seed), "u long, label string, vec binary, size int, code long")
        near = _in_windows(coded, n_parts).mapInArrow(_windows, "u long, v long, sim double")
        first = near if first is None else first.unionAll(near)
    lists = vectors.select("u", F.lit(k).alias("room"))
    graph, before = _kept(first.withColumn("old", F.lit(False)), lists, n_parts), []
    for turn in range(rounds):
        stats = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("held"))
        lists = written(vectors.join(stats, "u", "left").join(lists, "u").select("u", "vec", F.when((F.col("held") >= F.col("room")) & (F.col("worst") >= threshold), F.least(F.col("room") * 2, F.lit(K_MOST))).otherwise(F.col("room")).alias("room"), F.when(F.col("held") >= F.col("room"), F.col("worst")).otherwise(-2.0).alias("worst")), "lists")
        both = graph.select(F.col("u").alias("c"), F.col("v").alias("w"), (~F.col("old")).alias("fresh"), F.lit(True).alias("own")).unionAll(graph.select(F.col("v").alias("c"), F.col("u").alias("w"), ~F.col("old"), F.lit(False)))
        degree = both.groupBy("c").agg(F.ceil(F.count("*") / GATHER).cast("int").alias("parts"))
        spread = both.join(degree, "c").withColumn("s", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("w"), "parts").cast("int")))))
        met = spread.join(lists, spread["w"] == lists["u"]).select("c", "s", "w", "fresh", "worst", "room", "vec")
        met = met.repartition(n_parts, "c", "s").sortWithinPartitions("c", "s")
        better = met.mapInArrow(_joined, "u long, v long, sim double")
        after = _kept(graph.select("u", "v", "sim", F.lit(True).alias("old")).unionAll(better.withColumn("old", F.lit(False))), lists.select("u", "room"), n_parts)
        discard(graph, *before)
        graph, before, lists = after, [lists], lists.select("u", "room")
        if graph.filter(~F.col("old")).count() <= SETTLED * k * n:
            break
    return graph.select("u", "v", "sim")


def _kept(edges: DataFrame, lists: DataFrame, n_parts: int) -> DataFrame:
    rows = edges.join(lists, "u").select("u", "v", "sim", "old", "room").repartition(n_parts, "u").sortWithinPartitions("u", F.desc("sim"), "v", F.desc("old"))
    return written(rows.mapInArrow(_best, "u long, v long, sim double, old boolean"), "graph")


def near_duplicates(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_valid, "id long, label string, vec binary")
    rows = written(rows, "unit")
    able = rows.filter("vec IS NOT NULL AND label IS NOT NULL")
    classes = able.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("u", F.monotonically_increasing_id()), "vectors")
    found = links(classes, threshold)
    # the smallest id of each component; a vector without links is one of its own
    found = written(classes.select("u", "label", "vec", "least", "copies").join(found, "u", "left").withColumn("component", F.coalesce("component", "u")), "linked")
    names = written(found.groupBy("component").agg(F.min("least").alias("name")), "names")
    found = found.join(names, "component").select("label", "vec", "copies", "n", "name")
    out = able.join(found, ["label", "vec"]).select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("name").alias("component_id"))
    rest = rows.filter("vec IS NULL OR label IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """(u, n, component) of vectors (u, label, vec, copies) that link with others; rounds go on until the audit passes.

    Whatever the round, a loss that the last audit saw sends all vectors through the exact comparison within their labels.
    """
    n_parts = partitions(classes.sparkSession)
    k = K
    while True:
        graph = descend(classes, threshold, k)
        joined = components(graph.filter(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b")), "near")
        joined = written(joined.select(F.col("node").alias("u"), "component"), "near")
        joined = written(bridged(classes.join(joined, "u").select("u", "label", "vec", "component"), threshold), "bridged")
        share = _audit(classes, joined, threshold)
        LOG.info("audit with %d neighbours: %.4f of the linked vectors' links found", k, share)
        if k >= 4 * K or share >= RECALL:
            break
        k *= 2
    if share < 1:
        every = classes.join(joined, "u", "left").select("u", "label", "vec", F.coalesce("component", "u").alias("component"))
        joined = bridged(every, threshold)
        several = joined.groupBy("component").agg(F.count("*").alias("m")).filter("m > 1").select("component")
        joined = written(joined.join(several, "component").select("u", "component"), "exact")
    size = joined.groupBy("component").agg(F.count("*").alias("m")).withColumn("blocks", F.expr("cast(least(ceil(m / 64), 32 + ceil(m / 4096)) AS int)"))
    dealt = joined.join(size, "component").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.join(classes.select("u", "copies", "vec"), "u").select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "u", "copies", "vec")
    dealt = dealt.repartition(n_parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "side")
    counts = dealt.mapInArrow(_counted(threshold), "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    return joined.join(counts, "u", "left").select("u", F.coalesce("n", F.lit(0)).alias("n"), "component")


def _audit(classes: DataFrame, joined: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """Estimated mean, over vectors that have links, of the share of their links that lie within a component.

    Probes are compared with every vector of their labels. They come in two strata, so that neither large components nor the
    many vectors without links hide a loss: one vector of each of at most ``sample`` components, and at most ``sample * LONE``
    of the vectors that no component holds. A lone vector with a link has lost all of it, and counts for its share of the stratum.
    """
    rows = classes.select("u", "label", "vec").join(joined, "u", "left")
    grouped, lone = rows.filter("component IS NOT NULL"), rows.filter("component IS NULL")
    one = grouped.groupBy("component").agg(F.min(F.struct(F.xxhash64("u"), "u")).alias("p")).select(F.col("p.u").alias("u")).orderBy(F.xxhash64("u"), "u").limit(sample)
    probes = rows.join(F.broadcast(one), "u", "left_semi").unionAll(lone.orderBy(F.xxhash64("u"), "u").limit(sample * LONE)).collect()
    own: dict[tuple, list] = {}
    for p in probes:
        own.setdefault((p.label, len(p.vec)), []).append((p.u, p.component, p.vec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, labels, vecs, comps = (batch.column(c).to_pylist() for c in range(4))
            at: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(labels, map(len, vecs), strict=True)):
                if key in own:
                    at.setdefault(key, []).append(i)
            out = []
            for key, rows in at.items():
                near = (_unit([x[2] for x in own[key]]) @ _unit([vecs[i] for i in rows]).T) >= threshold
                near &= np.array([x[0] for x in own[key]])[:, None] != np.array([names[i] for i in rows])[None, :]
                there = np.array([comps[i] is not None for i in rows])
                of = np.array([comps[i] or 0 for i in rows])
                for (u, comp, _), links in zip(own[key], near, strict=True):
                    if links.any():
                        out.append((u, comp is not None, int((links & there & (of == comp)).sum()) if comp is not None else 0, int(links.sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], ["u", "held", "hit", "whole"])

    met = rows.select("u", "label", "vec", "component").mapInArrow(run, "u long, held boolean, hit long, whole long").groupBy("u", "held").agg((F.sum("hit") / F.sum("whole")).alias("hit"))
    got = {r.held: (r.n, r.hit) for r in met.groupBy("held").agg(F.count("*").alias("n"), F.avg("hit").alias("hit")).collect()}
    n_grouped, n_lone = rows.agg(F.count("component"), F.count_if(F.col("component").isNull())).first()
    tried = sum(p.component is None for p in probes)
    lost = n_lone * got[False][0] / tried if False in got else 0
    return n_grouped * got.get(True, (0, 1.0))[1] / (n_grouped + lost) if n_grouped + lost else 1.0


#: The same rows in DuckDB's SQL: every pair of a label, then the nodes reachable from each.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
          WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(least(a, b)) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, coalesce(c.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""

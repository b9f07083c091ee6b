"""Segmented scans and pointer doubling against plain loops."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from blockloom.operators import linkage as li
from blockloom.operators import scan

BLOCKS = "chain_id int, number long, hash string, parent_number long, parent_hash string"


def test_one_chain_is_dealt_evenly(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("chain_id"), F.when(F.col("id") < 3, F.col("id")).otherwise(F.col("id") * 3 + 10**9).alias("number"), F.col("id").cast("string").alias("hash"))
    ranged, w = scan.carried(rows, ["chain_id"], ["number", "hash"], last=["hash"])
    out = scan.uncarried(ranged.withColumn("before", F.lag("hash").over(w)).withColumn("task", F.spark_partition_id()))
    assert out.filter("before IS NULL OR cast(before AS bigint) + 1 <> cast(hash AS bigint)").count() == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as over data for which tasks aren't put together
    sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 2 * median(sizes) and sum(sizes) == 200_000
    plan = ranged.withColumn("before", F.lag("hash").over(w))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "Broadcast" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_scans_equal_a_loop(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(scan, "CUTS", rng.choice([1, 4, 16]))
    rows, pos, answers = [], 0, []
    for chain in range(3):
        number, held = rng.randint(0, 5), "root"
        for _ in range(rng.choice([1, 40, 300])):
            for fork in range(rng.choice([1, 1, 1, 2])):
                rows.append((chain, number, f"H{chain}.{number}.{fork}", number - 1 if rng.random() < 0.9 else number - 2, held if rng.random() < 0.9 else "other"))
            held, number = rows[-1][2], number + rng.choice([1, 1, 1, 5, 1000])
        for _ in range(200):
            answers.append((chain, pos := pos + rng.choice([1, 1, 900]), rng.randint(0, 3) + pos // 3000, rng.randint(0, 50)))
    df = spark.createDataFrame(rows, BLOCKS)
    want, last = {}, {}
    for chain, number, hash_, pn, ph in sorted(rows):
        before = last.get(chain)
        want[chain, hash_] = before is None or before == (pn, ph)
        last[chain] = number, hash_
    assert {(r.chain_id, r.hash): r.linked for r in li.with_breaks(df).collect()} == want
    one = [r for i, r in enumerate(sorted(rows)) if i == 0 or r[:2] != sorted(rows)[i - 1][:2]]
    for fold, whole in ((False, False), (True, True)):
        cut, last = [], {}
        broken: set = set()
        for chain, number, hash_, _, ph in one:
            was = last.get(chain)
            same = was is None or ((was[1].lower() == ph.lower() if fold else was[1] == ph) and (not whole or was[0] + 1 == number))
            broken |= set() if same else {chain}
            cut += [] if chain in broken else [(chain, hash_)]
            last[chain] = number, hash_
        assert sorted((r.chain_id, r.hash) for r in li.linked_prefix(spark.createDataFrame(one, BLOCKS), fold, whole).collect()) == sorted(cut)
    seen = spark.createDataFrame(answers, "chain_id int, pos long, epoch long, number long")
    top, live, newest, best = {}, {}, {}, {}
    for chain, at, epoch, number in answers:
        top[chain, at] = best[chain] = max(best.get(chain, -1), number)
        if epoch >= newest.get(chain, (-1, 0))[0]:
            newest[chain] = (epoch, max(number, newest[chain][1]) if newest.get(chain, (-1, 0))[0] == epoch else number)
            live[chain, at] = newest[chain][1]
    assert {(r.chain_id, r.pos): r.highest for r in li.running_finality(seen).collect()} == top
    assert {(r.chain_id, r.pos): r.finalized for r in li.epoch_finality(seen).collect()} == live
    assert li.with_breaks(df.filter("false")).count() == 0 and li.running_finality(seen.filter("false")).count() == 0


def test_common_ancestor_of_a_long_chain(spark, monkeypatch):
    made = []
    kept = li.Kept
    monkeypatch.setattr(li, "Kept", lambda df, what: made.append(df) or kept(df, what))
    n = 100_000
    main = spark.range(n).select(F.lit(1).alias("chain_id"), F.col("id").alias("number"), F.concat(F.lit("a"), "id").alias("hash"), F.greatest(F.col("id") - 1, F.lit(0)).alias("parent_number"), F.concat(F.lit("a"), F.col("id") - 1).alias("parent_hash"))
    side = spark.range(30, n).select(F.lit(1).alias("chain_id"), F.col("id").alias("number"), F.concat(F.lit("f"), "id").alias("hash"), (F.col("id") - 1).alias("parent_number"), F.concat(F.when(F.col("id") == 30, "a").otherwise("f"), F.col("id") - 1).alias("parent_hash"))
    pairs = [(1, 1, n - 1, f"a{n - 1}", n - 1, f"f{n - 1}"), (1, 2, 500, "a500", 90, "a90"), (1, 3, 7, "a7", 8, "zz")]
    got = li.common_ancestors(main.unionByName(side), spark.createDataFrame(pairs, "chain_id int, pair int, a_number long, a_hash string, b_number long, b_hash string"), n)
    assert {tuple(r)[1:] for r in got.collect()} == {(1, 29, "a29", n - 30, n - 30), (2, 90, "a90", 410, 0)}
    assert len(made) - 1 <= 17  # a join a round
    assert all(str(df._jdf.queryExecution().logical()).count("Join") == 1 for df in made[1:])


def test_ancestors_stop_at_depth_and_at_unknown_parents(spark):
    rows = [(1, i, f"h{i}", i - 1, f"h{i - 1}") for i in range(5, 40)] + [(1, 50, "s1", 49, "gone"), (1, 51, "s2", 49, "gone")]
    df = spark.createDataFrame(rows, BLOCKS)
    head = spark.createDataFrame([(1, 39, "h39")], "chain_id int, number long, hash string")
    for depth in (0, 1, 6, 100):
        got = {(r.number, r.depth) for r in li.canonical_from(df, head, depth).collect()}
        assert got == {(39 - k, k) for k in range(min(depth, 34) + 1)}
    pairs = spark.createDataFrame([(1, 1, 50, "s1", 51, "s2")], "chain_id int, pair int, a_number long, a_hash string, b_number long, b_hash string")
    assert li.common_ancestors(df, pairs, 10).count() == 0


def test_prefix_of_one_chain_is_joined_in_parts(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("chain_id"), F.col("id").alias("number"), F.col("id").cast("string").alias("hash"), F.when(F.col("id") == 15_000, "x").otherwise((F.col("id") - 1).cast("string")).alias("parent_hash"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}  # as over chains too many to broadcast
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        sizes = [r["count"] for r in li.linked_prefix(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k in off:
            spark.conf.unset(k)
    assert sum(sizes) == 15_000 and len(sizes) > 1 and max(sizes) < 2 * median(sizes)


def test_walks_equal_brute_force_over_small_segments(spark, monkeypatch):
    monkeypatch.setattr(li, "SEGMENT", 2, raising=False)
    monkeypatch.setattr(li, "WIDEST", 5, raising=False)
    rng = random.Random(9)
    rows = []
    for chain in (1, 2):
        for n in range(-6, 90, 2):
            for k in range(rng.choice([1, 1, 2, 3])):
                up = n - rng.choice([2, 2, 2, 4, 30])
                rows += [(chain, n, f"h{n}/{k}", up, f"h{up}/{rng.choice([0, 0, 1])}")] * rng.choice([1, 1, 2])
                if rng.random() < 0.1:
                    rows.append((chain, n, f"h{n}/{k}", n + rng.choice([0, -4]), f"h{n - 4}/0"))
    up = {}
    for chain, n, h, pn, ph in rows:
        known = up.get((chain, n, h))
        up[chain, n, h] = min([x for x in (known, (pn, ph) if pn < n else None) if x], default=None)

    def walk(chain, n, h, depth):
        at, out = (n, h), []
        while at and (chain, *at) in up and len(out) <= depth:
            out.append(at)
            at = up[chain, *at]
        return out

    blocks = spark.createDataFrame(rows, BLOCKS)
    refs = sorted(up)
    heads = [rng.choice([r for r in refs if r[0] == c and r[1] > 60]) for c in (1, 2)] + [(2, 500, "none")]
    pairs = [(a[0], i, a[1], a[2], b[1], b[2]) for i in range(80) for a, b in [rng.choices([r for r in refs if r[0] == 1 + i % 2], k=2)]]
    for depth in (0, 3, 20, 500):
        got = sorted(tuple(r)[:3] + tuple(r)[5:] + tuple(r)[3:5] for r in li.canonical_from(blocks, spark.createDataFrame(heads, "chain_id int, number long, hash string"), depth).collect())
        want = sorted({(c, *at, k, *r[3:]) for c, n, h in heads for k, at in enumerate(walk(c, n, h, depth)) for r in rows if r[:3] == (c, *at)})
        assert got == want
        met = {}
        for c, i, an, ah, bn, bh in pairs:
            a, b = walk(c, an, ah, depth), walk(c, bn, bh, depth)
            both = [(c, i, *x, a.index(x), b.index(x)) for x in a if x in b]
            met |= {i: both[0]} if both else {}
        got = li.common_ancestors(blocks, spark.createDataFrame(pairs, "chain_id int, pair int, a_number long, a_hash string, b_number long, b_hash string"), depth)
        assert sorted(tuple(r) for r in got.collect()) == sorted(met.values()) and (met or not depth)


def test_pairs_of_one_chain_share_their_walks(spark, monkeypatch):
    sizes, kept = [], li.Kept
    monkeypatch.setattr(li, "Kept", lambda df, what: sizes.append((k := kept(df, what)).df.count()) or k)
    n = 2000
    blocks = spark.range(n).select(F.lit(1).alias("chain_id"), F.col("id").alias("number"), F.col("id").cast("string").alias("hash"), (F.col("id") - 1).alias("parent_number"), (F.col("id") - 1).cast("string").alias("parent_hash"))
    pairs = spark.createDataFrame([(1, i, n - 1, str(n - 1), 10 * i, str(10 * i)) for i in range(50)], "chain_id int, pair int, a_number long, a_hash string, b_number long, b_hash string")
    assert {(r.pair, r.number, r.steps_a) for r in li.common_ancestors(blocks, pairs, n).collect()} == {(i, 10 * i, n - 1 - 10 * i) for i in range(50)}
    assert sum(sizes) <= n  # not each pair's ancestors

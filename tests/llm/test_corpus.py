"""Joins, mixing, classifier, neighbours and the pipeline: against brute force."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from blockloom.llm import block_mix, common, nn_descent, shingle_join, toxicity
from blockloom.llm.common import components
from blockloom.llm.nn_descent import near_duplicates
from blockloom.llm.pieces import model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, num, den):
    """{id: smallest id reachable} over all pairs that share a shingle."""
    sets, at = {i: shingles(t, width) for i, t in rows}, {}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        near = Counter(j for g in s for j in at.get(g, ()))
        for j, n in near.items():
            if n * (num + den) >= num * (len(s) + len(sets[j])):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            at.setdefault(g, []).append(i)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard_components(spark, width, num, den):
    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 400, n)] for n in (30, 120, 500)]
    rows, k = [], 0
    for words in base:
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3):
            own = [w if rng.random() > share else f"v{rng.integers(0, 999)}" for w in words]
            rows.append((k := k + 1, " ".join(own)))
    rows += [(k + 1, None), (k + 2, ""), (k + 3, "one"), (k + 4, "ONE"), (k + 5, " \t"), (k + 6, "one two"), (k + 7, rows[0][1].upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cell", "'x' AS component")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in shingle_join.jaccard_components(df, width, num, den).collect()}
    comp, sizes = brute(rows, width, num, den)
    assert got == {i: (comp[i], sizes[i]) for i in comp}


def test_jaccard_odd_rows(odd, none):
    got = shingle_join.jaccard_components(odd, 3, 90, 100).collect()
    assert len(got) == odd.count() and shingle_join.jaccard_components(none, 3, 90, 100).count() == 0
    by = {r.doc_id: r.component_id for r in got}
    assert by[2] == 1 and by[12] == 1 and by[3] == 3 and by[None] is None and by[10] == 10


def test_jaccard_equals_its_sql(spark, sf, duck, same_rows):
    assert same_rows(shingle_join.jaccard_components(spark.read.parquet(f"{sf}/documents.parquet"), 3, 90, 100), duck, shingle_join.ORACLE) == 200


def test_bundles_of_many_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_TOKENS", 400)
    monkeypatch.setattr(shingle_join, "CELL", 8)
    rng, rows = np.random.default_rng(8), []
    for family in range(3):
        words = [f"f{family if family < 2 else 0}.{x}" for x in range(60)]  # the third starts near the first
        for step in range(40):
            for at in rng.integers(0, 60, 1 if family < 2 else step % 3):
                words[at] = f"n{family}.{step}.{at}"  # a walk: neighbours link, far ones do not
            rows.append((1000 - len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    comp, sizes = brute(rows, 3, 80, 100)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in shingle_join.jaccard_components(df, 3, 80, 100).collect()}
    assert got == {i: (comp[i], sizes[i]) for i in comp} and 1 < len(set(comp.values())) < len(rows) - 20


def test_strangers_do_not_share_cells():
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (8, 10)):
        plan = shingle_join.Plan(num, den)
        for n in (12, 20, 40, 100):
            seen = Counter(c for _ in range(2000) for c in plan.cells(np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))).tolist())
            assert max(seen.values()) <= 3


def test_rtree_finds_all_within_the_bound():
    rng, plan = np.random.default_rng(2), shingle_join.Plan(90, 100)
    sets = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.r_[s[3:], rng.integers(0, 2**63, 3).astype(np.uint64)]) for s in sets]
    vectors, sizes = np.array([shingle_join.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree = shingle_join.RTree(vectors, sizes)
    for i in range(0, 300, 11):
        want = {j for j in range(300) if np.minimum(vectors[i], vectors[j]).sum() >= plan.overlap(sizes[i] + sizes[j])}
        assert set(tree.query(vectors[i], int(sizes[i]), plan).tolist()) == want
    assert all(set(plan.cells(a).tolist()) & set(plan.cells(b).tolist()) for a, b in zip(sets[:150], sets[150:], strict=True) if len(np.intersect1d(a, b)) >= plan.overlap(len(a) + len(b)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100), (7, 7), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[100] == got[60] == got[50] == 50 and got[201] == 200 and len(got) == 45


def test_components_of_stars_need_no_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(common, "written", lambda df, what, f=common.written: tables.append(what) or f(df, what))
    for edges in ([(9, 1), (1, 5), (8, 2), (2, 2)], [(1, 2)], []):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").coalesce(1), "t").collect()}
        assert got == {i: 2 if i in (8, 2) and len(edges) > 1 else 1 for e in edges for i in e}
    assert tables == ["t-edges"] * 3
    rng = np.random.default_rng(3)
    names = rng.permutation(300)
    edges = [(int(names[i]), int(names[i + 1])) for i in range(299) if i % 100 != 99]
    rows = components(spark.createDataFrame([edges[i] for i in rng.permutation(len(edges))], "a long, b long").repartition(7), "t").collect()
    assert len(rows) == 300 and {r.node: r.component for r in rows} == {int(n): int(min(names[i // 100 * 100 : i // 100 * 100 + 100])) for i, n in enumerate(names)}


def test_stars_of_parts_of_a_task():
    edges = [(int(a), int(b)) for a, b in np.random.default_rng(6).integers(0, 40, (60, 2))]
    for most in (1, 7, 1000):
        batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in edges[i : i + 3]], "b": [b for _, b in edges[i : i + 3]]}) for i in range(0, 60, 3)]
        found = [(u, v) for x in common._in_stars(most)(iter(batches)) for u, v in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        assert all(u > v for u, v in found)
        for some in (edges, found):
            u, v = common.stars(*np.array(some).T)
            assert dict(zip(u.tolist(), v.tolist(), strict=True)) == _smallest(edges)


def _smallest(edges):
    at = {i: i for e in edges for i in e}
    while any(at[a] != at[b] for a, b in edges):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return {i: least for i, least in at.items() if i != least}


def test_blocks_name_their_own_components(spark, monkeypatch):
    """Only links between blocks need rounds once more: with one block for each bundle there are none."""
    rounds, words = [], [f"w{i}" for i in range(60)]
    monkeypatch.setattr(shingle_join, "components", lambda edges, what, f=components: rounds.append(what) or f(edges, what))
    rows = [(100 - 4 * k - i, " ".join([f"k{k}", *words[k:], *(f"end{k}.{j}" for j in range(i))])) for k in range(0, 20, 7) for i in range(4)]
    comp, sizes = brute(rows, 3, 90, 100)
    for tokens, passes in ((1 << 16, ["bundles"]), (100, ["bundles", "links"])):
        rounds.clear()
        monkeypatch.setattr(shingle_join, "BLOCK_TOKENS", tokens)
        got = shingle_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
        assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (comp[i], sizes[i]) for i in comp} and set(rounds) <= set(passes)


@pytest.mark.parametrize("tokens", [1 << 16, 50])
def test_ids_of_several_texts_tie_their_sets(spark, monkeypatch, tokens):
    monkeypatch.setattr(shingle_join, "BLOCK_TOKENS", tokens)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(11, a), (2, a + " more"), (13, b), (4, b + " more"), (7, a + " else"), (7, b + " else"), (18, c), (19, c), (19, d), (20, d), (21, "alone"), (None, a)]
    got = {(r.doc_id, r.component_id) for r in shingle_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {(i, 2) for i in (2, 4, 7, 11, 13)} | {(i, 18) for i in (18, 19, 20)} | {(21, 21), (None, None)}


def test_mix(spark, odd, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (block_mix.mix(d).toPandas().sort_values("doc_id").reset_index(drop=True) for d in (docs, docs.repartition(5)))
    assert a.equals(b) and (a.taken <= 3 * a["size"]).all()
    assert a["size"].tolist() == [len(WORD.findall(r.text)) for r in docs.orderBy("doc_id").collect()]
    per = a.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(t=("taken", "sum"), aim=("target", "first"), n=("source_size", "first"))
    names, weights = sorted(per.index), (5, 2, 1)
    aims = block_mix.targets([int(per.n[s]) for s in names], [weights[i % 3] for i in range(len(names))])
    assert np.allclose([per.aim[s] for s in names], aims) and abs(sum(aims) - a["size"].sum()) < 1e-6 * a["size"].sum() + 1
    assert (abs(per.t - per.aim) <= 0.1 * per.aim + block_mix.BLOCK * 3).all()
    got = block_mix.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken == 0 for r in got if r["size"] == 0) and block_mix.mix(none).count() == 0
    mixed = block_mix.mixed_documents(odd)
    assert mixed.columns == odd.columns and all(r.text and r._key == 7 for r in mixed.collect()) and block_mix.mixed_documents(none).count() == 0


@pytest.mark.parametrize("wide", [1, 1 << 50])
def test_mix_takes_what_brute_force_takes(spark, wide):
    rng = np.random.default_rng(6)
    sizes = {"a": [3000, 1, 700, 0, 255], "b": [100], "c": [40, 260], None: [30, 2000]}
    rows = [(int(rng.integers(0, 1 << 10)) * wide + k if s else None, " ".join(["w"] * n), s) for s, many in sizes.items() for k, n in enumerate(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, slots, sources = block_mix.plan(docs, "doc_id", "text", "source", block_mix.WEIGHTS, 3)
    taken, named = Counter(), {x["s"]: x for x in sources}
    for r in slots.collect():
        taken.update((r.s, w) for w in range(r.block * block_mix.BLOCK, min(r.block * block_mix.BLOCK + r.words, named[r.s]["size"])))
    assert all(sum(n for (s, _), n in taken.items() if s == x["s"]) == x["words"] == round(x["target"]) for x in sources)
    want = []
    for x in sources:
        at = 0
        for r in sorted((r for r in block_mix.mix(docs).join(docs, "doc_id", "left").select("doc_id", "source", "size").distinct().collect() if r.doc_id is not None and r.source == x["source"]), key=lambda r: r.doc_id):
            want.append((r.doc_id, sum(taken[x["s"], w] for w in range(at, at + r["size"]))))
            at += r["size"]
    got = {r.doc_id: r.taken for r in block_mix.mix(docs).collect()}
    assert want and all(got[i] == n for i, n in want)


def test_running_totals_of_any_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 3)), None if k % 5 == 0 else int(rng.integers(-(2**62), 2**62)), int(rng.integers(0, 9)), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, id long, v long, tie long")
    got = block_mix.running_total(df, "g", ["id", "tie"], "v").collect()
    now = Counter()
    for r in sorted(got, key=lambda r: (r.g, r.id is not None, r.id or 0, r.tie)):
        assert r.since == now[r.g]
        now[r.g] += r.v
    assert len(got) == 500


def test_permutations_and_draws():
    for n in (1, 2, 3, 100, 4097):
        to = block_mix.permuted(np.arange(n), n, 12345).tolist()
        assert sorted(to) == list(range(n)) and all(to[block_mix.inverse_place(x, n, 12345)] == x for x in range(0, n, 1 + n // 9))
    huge = np.array([10**12, 3, 5 * 10**11, 10**4])
    parts = [block_mix.shard_draw(huge, 10**6, k, 2) for k in (0, 1, 2, 10**6 - 1)]
    assert (parts[0][0] + parts[0][1] == parts[1][0]).all() and (parts[1][0] + parts[1][1] == parts[2][0]).all() and (parts[3][0] + parts[3][1] == huge).all()
    assert len({int(c[0]) for _, c in parts}) > 1 and all(abs(c[0] - 10**6) < 10**4 for _, c in parts)
    slots, at = np.array([1000, 3, 0, 777]), np.zeros(4, int)
    for k in range(7):
        first, counts = block_mix.shard_draw(slots, 7, k, 1)
        assert (first == at).all()
        at = first + counts
    assert (at == slots).all()
    assert block_mix.targets([100, 10, 10, 1000], [5, 2, 1, 5]) == [300.0, 30.0, 30.0, 760.0]


def test_toxicity(spark, odd, none, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(docs, model).join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.7 and n.get((0, 1), 0) / n[0, 0] < 0.02
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows) and toxicity.toxicity(none, model).count() == 0
    assert toxicity.without_toxic(odd, model).columns == odd.columns
    flat = toxicity.fit(odd, labels.filter("false"))
    assert {r.score for r in toxicity.toxicity(odd, flat).collect()} == {0.0}


def test_embeddings(spark):
    rng, rows = np.random.default_rng(0), []

    def add(v, label):
        rows.append((len(rows), None if v is None else [float(x) for x in v], label))

    for label in range(2):
        for size in (1,) * 30 + (2, 3, 70):
            b = rng.standard_normal(16)
            for _ in range(size):
                add(b + rng.standard_normal(16) * 0.2, label)
    for _ in range(12):
        add(b, 0)
    for v, label in ((None, 0), ([0.0] * 16, 1), ([float("nan")] * 16, 1), (b, None), ([1.0, 2.0], 0)):
        add(v, label)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS u", "2 AS component")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    unit = {}
    for i, v, label in rows:
        x = None if v is None else np.array(v, np.float32).astype(float)
        if x is not None and label is not None and len(x) == 16 and np.isfinite(x).all() and x.any():
            unit[i] = (x / np.linalg.norm(x), label)
    parent, n = {r[0]: r[0] for r in rows}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in unit:
        for q in unit:
            if p < q and unit[p][1] == unit[q][1] and unit[p][0] @ unit[q][0] >= 0.93:
                n[p] += 1
                n[q] += 1
                a, b = root(p), root(q)
                parent[max(a, b)] = min(a, b)
    assert got == {i: (n[i], root(i), root(i) == i) for i in parent}
    assert near_duplicates(df.filter("false")).count() == 0


def test_families_beyond_the_lists_are_joined(spark):
    rng, m, within, across = np.random.default_rng(7), 60, 0.988, 0.955
    axes = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    c = across / within
    rows = []
    for centre in (axes[0], c * axes[0] + np.sqrt(1 - c * c) * axes[1]):
        noise = rng.standard_normal((m, 64))
        noise -= noise @ axes.T @ axes
        rows += list(centre + noise / np.linalg.norm(noise, axis=1)[:, None] * np.sqrt(1 / within - 1))
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    sims = unit @ unit.T
    assert (sims >= 0.93).all() and sims[:m, m:].max() < min(np.sort(s)[-41] for s in (*sims[:m, :m], *sims[m:, m:]))  # 40 best: no one of the other family
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(unit)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {i: (2 * m - 1, 0, i == 0) for i in range(2 * m)}


def test_links_lost_by_the_search_are_found_by_the_exact_way(spark, monkeypatch):
    rng, rows = np.random.default_rng(9), []
    for k in range(30):
        b = rng.standard_normal(16)
        rows += [(len(rows) + x, [float(v) for v in b + rng.standard_normal(16) * 0.01], k % 2) for x in range(2 if k < 10 else 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links = {i: [j for j, _, m in rows if j != i and m == n and unit[i] @ unit[j] >= 0.93] for i, _, n in rows}
    assert sum(map(len, links.values())) == 20
    lone = spark.createDataFrame([], "u long, v long, sim double")
    monkeypatch.setattr(nn_descent, "descend", lambda *_: lone)
    classes = df.selectExpr("vec_id AS u", "cast(label AS string) AS label", "embedding").drop("embedding").join(near_vectors(df), "u")
    part = spark.createDataFrame([(2 * k + x, 2 * k) for k in range(5) for x in range(2)], "u long, component long")
    assert nn_descent._audit(classes, part.filter("false"), 0.93) == 0 and nn_descent._audit(classes, part, 0.93) == 0.5
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {i: (len(to), min([i, *to])) for i, to in links.items()}


@pytest.mark.parametrize("parts", [1, 8, 200])
def test_few_vectors_over_any_partitions(spark, parts):
    rng, before = np.random.default_rng(3), spark.conf.get("spark.sql.shuffle.partitions")
    base = rng.standard_normal(16)
    near = [[float(x) for x in base + rng.standard_normal(16) * 0.02] for _ in range(6)]
    rows = [(10 + k, v, 1) for k, v in enumerate(near)] + [(None, near[0], 1), (7, near[1], 1), (7, near[1], 1), (None, [float(x) for x in rng.standard_normal(16)], 1), (3, [1.0] * 16, 2), (None, near[0], 3), (None, near[0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [(str(10 + k), 8, 7, False) for k in range(6)] + [("None", 8, 7, False), ("7", 8, 7, True), ("7", 8, 7, True), ("None", 0, None, True), ("3", 0, 3, True)] + [("None", 1, None, True)] * 2
    assert got == sorted(want, key=str)


def test_embeddings_equal_their_sql(spark, same_rows):
    import duckdb

    rng, rows = np.random.default_rng(5), []
    for label in range(3):
        for size in (1,) * 40 + (2, 3, 9, 30):
            b = rng.standard_normal(12)
            rows += [(len(rows) + k, [float(np.float32(x)) for x in b + rng.standard_normal(12) * 0.15], label) for k in range(size)]
    rows += [(len(rows), None, 0), (len(rows) + 1, [0.0] * 12, 0), (len(rows) + 2, rows[0][1], None), (len(rows) + 3, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    con, table = duckdb.connect(), df.toArrow()
    con.register("embeddings", table)
    assert same_rows(near_duplicates(df), con, nn_descent.ORACLE) == len(rows)


def near_vectors(df):
    """(u, vec) of a table's unit vectors, as the operator packs them."""
    return df.selectExpr("vec_id AS id", "'x' AS label", "embedding AS v").mapInArrow(nn_descent._valid, "id long, label string, vec binary").selectExpr("id AS u", "vec")


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "sentencepiece"]
    seen, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, now, sf), f"test-{name}")
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "ngram_jaccard_join":
            comp, _ = brute([(r.doc_id, r.text) for r in now.collect()], 5, 8, 10)
            assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in comp.items() if i == c)
        if name == "sentencepiece":
            sp, texts = model(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")), sorted((r.doc_id, sp_ids) for r in now.collect() for sp_ids in [r.text])
            assert sorted((r.doc_id, bytes(r.ids)) for r in out.collect()) == sorted((i, np.array(sp.encode(x, add_bos=True, add_eos=True), "<u4").tobytes()) for i, x in texts)
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
            assert {r.doc_id for r in out.collect()} == {i for i, p in scores.items() if not p}
        if name == "source_mixing":
            words = {r.doc_id: WORD.findall(r.text) for r in now.collect()}
            taken = Counter()
            for r in out.collect():
                own = WORD.findall(r.text)
                assert set(own) <= set(words[r.doc_id]) and r.n_chars == len(r.text)
                taken[r.doc_id] += len(own)
            assert taken == Counter({r.doc_id: r.taken for r in block_mix.mix(now).collect() if r.taken})
        seen.append(out.count())
        now = out
    assert seen[0] > 0.8 * docs.count() and corpus_pipeline.run(spark, sf).count() == seen[-1]


def test_stages_on_odd_rows(spark, odd, none, sf):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.written(stage(spark, docs, sf), f"odd-{name}")
            assert out.columns == odd.columns and {r._key for r in out.select("_key").collect()} <= {7} and (out.count() > 0) == (docs is odd)
    assert corpus_pipeline.encoding(spark, odd, sf).count() == odd.count() and corpus_pipeline.encoding(spark, none, sf).count() == 0
    stay = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, odd, sf).collect()]
    assert sorted(i for i, _ in stay if i) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11] and (None, "no id at all") in stay


def test_draws_follow_one_law_at_all_sizes():
    from math import comb

    from blockloom.llm.block_mix import hypergeometric

    rng = np.random.default_rng(7)
    for own, rest, want in [(5, 7, 4), (3, 2000, 900), (2000, 3, 900), (40, 60, 99), (1, 1, 1), (300, 500, 400), (6, 10**12, 4 * 10**11)]:
        n = 20_000
        got = np.bincount([hypergeometric(rng, own, rest, want) for _ in range(n)], minlength=min(own, want) + 1)
        if rest < 10**6:
            exact = np.array([comb(own, x) * comb(rest, want - x) / comb(own + rest, want) if 0 <= want - x <= rest else 0.0 for x in range(len(got))])
        else:  # so many others that each is drawn by itself
            exact = np.array([comb(own, x) * 0.4**x * 0.6 ** (own - x) for x in range(len(got))])
        wide = exact * n >= 5
        assert got[exact == 0].sum() == 0
        chi = ((got[wide] - exact[wide] * n) ** 2 / (exact[wide] * n)).sum()
        assert chi < wide.sum() + 5 * np.sqrt(2 * wide.sum()) + 1, (own, rest, want, chi)
    for own, rest, want in [(10**12, 3 * 10**12, 2 * 10**12), (10**15, 10**9, 10**14), (10**9, 10**9, 10**9)]:
        whole = own + rest
        mean, sd = want * own / whole, (want * own / whole * (rest / whole) * ((whole - want) / (whole - 1))) ** 0.5
        z = np.array([(hypergeometric(rng, own, rest, want) - mean) / sd for _ in range(5000)])
        assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and abs((z**4).mean() - 3) < 0.5
    assert [hypergeometric(rng, *x) for x in [(0, 5, 3), (5, 0, 3), (4, 4, 8), (4, 4, 0)]] == [0, 3, 4, 0]

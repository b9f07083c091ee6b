"""Hard negatives against brute force and SQL."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import hard_negatives as hn
from blockloom.llm.queries import op12_hard_negatives

KIND = "vec_id long, embedding array<double>, label int"


def brute(rows, every, positives=5, per=10):
    good = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and None not in v:
            with np.errstate(all="ignore"):
                q = np.floor(256 * np.asarray(v, np.float64))
            if np.isfinite(q).all():
                good.append((i, label, [int(x) for x in q]))
    out = Counter()
    for a, label, q in good:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), i, own == label) for i, own, w in good if i != a and len(w) == len(q))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:per]
            out.update((a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(fit))
    return out


def found(df, every, **more):
    return Counter(tuple(r) for r in hn.hard_negatives(df, F.col("id") % every == 0, **more).collect())


@pytest.fixture(scope="module")
def cloud():
    """Families of near vectors, with labels across them, and copies."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    x = np.vstack([c + 0.3 * rng.standard_normal((50, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:130] = x[100]
    return [(int(i), v.tolist(), int(rng.integers(0, 4))) for i, v in zip(rng.permutation(len(x)), x, strict=True)]


def test_equals_brute_force_and_visits_part_of_the_lists(spark, cloud, monkeypatch):
    monkeypatch.setattr(hn, "LIST_ROWS", 20)
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "SALT_ROWS", 15)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    df = spark.createDataFrame(cloud, KIND).repartition(3)
    want = brute(cloud, 7)
    assert found(df, 7) == want and len(want) > 1000
    # the bounds leave lists out: an anchor's order of lists ends before the last
    x = np.array([v for _, v, _ in cloud])
    c = hn.fitted(np.floor(256 * x), 30)
    own, far = hn.nearest(np.floor(256 * x), c)
    lists = hn.Lists({16: c})
    for k in range(30):
        lists.radii[16][k] = far[own == k].max(initial=0)
    low, high = lists.bounds(np.floor(256 * x[0]))
    score = np.floor(256 * x) @ np.floor(256 * x[0])
    assert all(low[own[i]] <= score[i] <= high[own[i]] for i in range(len(x)))
    fifth = np.sort(score)[-6]
    nxt, _ = hn._advance(lists, np.floor(256 * x[0]), 0, [fifth], [np.inf], 30)
    assert 0 < len(nxt) < 25 and len(hn._advance(lists, np.floor(256 * x[0]), 0, [np.inf], [0], 30)[0]) == 0


def test_ties_copies_and_odd_rows(spark):
    rows = [(i, [0.5, 0.25, -0.125], i % 3) for i in range(40)]
    rows += [(100 + i, [0.1 * i, 0.5, 0.2], i % 2) for i in range(20)] + [(100, [0.1, 0.2, 0.3], 1)] * 3 + [(None, [1.0, 1.0, 1.0], 1), (200, None, 1), (201, [1.0, None, 1.0], 1), (202, [1.0, float("nan"), 0.0], 0), (203, [1.0, float("inf"), 0.0], 0)]
    rows += [(204, [1e308, 1.0, 0.0], 0), (210, [0.5, 0.5], 0), (220, [0.25, 0.5], 0), (225, [0.1, 0.5], 1), (230, [], 0), (240, [], 1), (250, [-0.5, -0.25, 0.125], None), (260, [3e6, 2e6, 1.0], 2), (270, [-1.0, -1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS id", "'x' AS d", "2 AS cluster", "3 AS vec", "4 AS h")
    assert found(df, 10) == brute(rows, 10)
    assert found(df.filter("false"), 10) == Counter()
    big = [(i, [1e6 * (1 + i / 7), 1e6 - i], i % 2) for i in range(30)]
    assert found(spark.createDataFrame(big, KIND), 5) == brute(big, 5)


def test_lengths_that_the_sample_lacks(spark, monkeypatch):
    monkeypatch.setattr(hn, "SAMPLE", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.random(2 + i % 5).tolist(), i % 3) for i in range(150)]
    assert found(spark.createDataFrame(rows, KIND), 10) == brute(rows, 10)


def test_equals_its_sql(spark, duck, sf, same_rows):
    assert same_rows(op12_hard_negatives(spark, sf), duck, hn.ORACLE) > 50

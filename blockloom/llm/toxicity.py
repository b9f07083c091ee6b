"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the n-grams (``GRAMS`` characters) of a text's lower-cased words, each word between spaces, present or not,
hashed to ``BUCKETS``. From labelled texts, per bucket: r = log((p + 1)/(P + 2)) - log((q + 1)/(N + 2)), p of P toxic and q of N
other texts having it. Buckets whose p differs from what chance gives by fewer than ``DEVIATIONS`` standard deviations have r = 0 and
leave. A logistic regression is fitted on the features times r, with an L2
penalty and balanced classes. Score: its probability, of the whole text, so that text added to a document can't hide a feature.

Labels come from at most ``MOST_LABELS`` labelled rows (those with the smallest hashed ids; the bound is this parameter). Their
features alone, as bucket numbers, come to the driver. The model is the r and weights of the kept buckets (``BUCKETS`` at most).

Null and empty texts have no feature and get the intercept's score. Rows with a null or repeated id are scored row by row;
labels of null ids, null labels and labels without a document are left out, a document with several labels is toxic if one
says so. Without labels of both classes every score is 0. Other columns of the input pass by.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, slices, written

GRAMS, BUCKETS, MOST_LABELS, DEVIATIONS, PENALTY, CACHE_ROWS, THRESHOLD = (5, 6), 1 << 20, 8_000, 2.5, 1e-3, 200_000, 0.7
_CACHE: dict[str, dict[str, tuple[int, ...]]] = {}


def word_grams(word: str) -> tuple[int, ...]:
    """Buckets of a word's n-grams, its ends marked."""
    w = f"<{word}>"
    return tuple({zlib.crc32(w[i : i + n].encode()) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1)})


def features(text: str | None, cache: dict[str, tuple[int, ...]]) -> set[int]:
    """Buckets of the n-grams of a whole text."""
    found: set[int] = set()
    if text:
        for w in set(text.lower().split()):
            g = cache.get(w)
            if g is None:
                g = cache[w] = word_grams(w)
            if g:
                found.update(g)
    return found


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELS) -> dict:
    """The model {bucket: weight} and intercept, from labelled rows that aren't held out."""
    arrow_rows(docs.sparkSession)
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label).alias("_y"))
    marked = marked.orderBy(F.xxhash64(id_col), id_col).limit(most)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, "text"):
            if len(cache) > CACHE_ROWS:
                cache.clear()
            sets = [sorted(features(t, cache)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.list_(pa.int32()))], ["y", "g"])

    found = docs.select(F.col(id_col), F.col(text).alias("text")).join(F.broadcast(marked), id_col).select("text", F.col("_y").cast("int").alias("y"))
    found = written(found.mapInArrow(grams, "y int, g array<int>"), "grams")
    counts = found.groupBy().agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("pos")).first()
    n, pos = counts.n, counts.pos or 0
    if not pos or pos == n:
        return {"bias": None, "weights": {}}
    per = found.select("y", F.explode("g").alias("b")).groupBy("b").agg(F.count("*").alias("c"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("p"))
    share = pos / n
    spread = F.sqrt(F.col("c") * share * (1 - share) * (1 - F.col("c") / (n + 1)) + 0.25)
    kept = per.filter(F.abs(F.col("p") - F.col("c") * share) >= DEVIATIONS * spread).toArrow().to_pandas().sort_values("b")
    if not len(kept):
        return {"bias": float(np.log(share / (1 - share))), "weights": {}}
    p, q = kept["p"].to_numpy(float), (kept["c"] - kept["p"]).to_numpy(float)
    r = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (n - pos + 2))
    at = {int(b): i for i, b in enumerate(kept["b"])}
    return _regression(found, at, r)


def _regression(found: DataFrame, at: dict[int, int], r: np.ndarray) -> dict:
    """The regression's rows, narrowed to the kept buckets, and its solution as a model."""
    sc = found.sparkSession.sparkContext
    keep = sc.broadcast((uuid.uuid4().hex, at))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = keep.value[1]
        for batch in batches:
            sets = [sorted(own[b] for b in g if b in own) for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["y", "g"])

    data = found.mapInArrow(narrow, "y int, g array<int>").toArrow().combine_chunks()
    y = (data.column("y").to_numpy() > 0).astype(float)
    lists = data.column("g").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lens, cols = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y), dtype=np.int32), lens)
    b, w = solve(y, row, cols, r)
    names = sorted(at, key=at.get)
    return {"bias": float(b), "weights": {n: float(v) for n, v in zip(names, w * r, strict=True)}}


def solve(y: np.ndarray, row: np.ndarray, cols: np.ndarray, r: np.ndarray, penalty: float = PENALTY) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L2 logistic regression on the sparse features r[cols], by Newton steps with conjugate gradients."""
    x, n, m = r[cols], len(y), len(r)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def apply(b, w):
        return b + np.bincount(row, x * w[cols], n)

    def back(v):
        return np.bincount(cols, v[row] * x, m)

    def loss(b, w):
        z = apply(b, w)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * penalty * (w @ w))

    b, w = 0.0, np.zeros(m)
    now = loss(b, w)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(apply(b, w), -40, 40)))
        g, h = weight * (s - y), weight * s * (1 - s) + 1e-9
        rb, rw = -g.sum(), -(back(g) + penalty * w)
        db, dw, pb, pw, old = 0.0, np.zeros(m), rb, rw.copy(), rb * rb + rw @ rw
        first = old
        for _ in range(60):
            t = h * apply(pb, pw)
            hb, hw = t.sum() + 1e-9 * pb, back(t) + penalty * pw
            a = old / max(pb * hb + pw @ hw, 1e-30)
            db, dw, rb, rw = db + a * pb, dw + a * pw, rb - a * hb, rw - a * hw
            new = rb * rb + rw @ rw
            if new < 1e-6 * first:
                break
            pb, pw, old = rb + new / old * pb, rw + new / old * pw, new
        step = 1.0
        while step > 1e-4 and (then := loss(b + step * db, w + step * dw)) > now:
            step /= 2
        if step <= 1e-4 or now - then < 1e-7:
            break
        b, w, now = b + step * db, w + step * dw, then
    return b, w


def score_texts(texts: list[str | None], model: dict, cache: dict[str, tuple[int, ...]]) -> list[float]:
    """Scores of whole texts; ``cache`` holds, of a word, those of its buckets that the model has."""
    weights, bias = model["weights"], model["bias"]
    if bias is None:
        return [0.0] * len(texts)
    if len(cache) > CACHE_ROWS:
        cache.clear()
    scores = []
    for t in texts:
        found: set[int] = set()
        if t and weights:
            words = set(t.lower().split())
            for w in words.difference(cache):
                cache[w] = tuple(b for b in word_grams(w) if b in weights)
            for g in map(cache.__getitem__, words):
                if g:
                    found.update(g)
        z = bias + sum(weights[b] for b in sorted(found))
        scores.append(float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0)))))
    return scores


def _cache(name: str) -> dict[str, tuple[int, ...]]:
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = {}
    return _CACHE[name]


def toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))  # BUCKETS weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = sent.value
        for batch in slices(batches, "text"):
            scores = score_texts(batch.column(1).to_pylist(), own, _cache(name))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), batch.column(2)], ["id", "score", "held_out"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), held_out(id_col).alias("held_out")).mapInArrow(run, f"id {kind}, score double, held_out boolean")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns, in one pass and without a shuffle."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = sent.value
        for batch in slices(batches, text):
            scores = score_texts(batch.column(text).to_pylist(), own, _cache(name))
            yield batch.filter(pa.array([x < threshold for x in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Best-fit packing against the library and a plain packer; importance resampling against brute force and SQL."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm import best_fit, common, resample

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text, end=0):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_units_encode_as_whole_texts(library):
    rng, (tok, known) = random.Random(3), best_fit.tokenizer(PATH)
    parts = [" ", "\n", "  ", "\n\n", "a", "word", "Ünï", "b1", "12", "'s", "'ll", ".", ",", "...", ").", "\xa0", "\t", "\x1c", "\r\n", "\x85", "　", "\0", "<|endoftext|>", "<|", "日é", "\U0001f600", "it's"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["x" * 5000, "ab " * 3000, None, ""]
    ids, ends = best_fit.encode_texts(tok, known, pa.array(texts), 0)
    for text, part in zip(texts, np.split(ids, ends[:-1]), strict=True):
        assert part.tolist() == ids_of(library, text), repr(text)


def test_forgetting_changes_no_id(library, monkeypatch):
    monkeypatch.setattr(best_fit, "CACHE_ROWS", 20)
    tok, known, texts = Tokenizer.from_file(PATH), best_fit.Known(), [f"some words {i}, and w{i % 7} more.\nEnd {i * i}" for i in range(200)]
    for at in range(0, 200, 20):
        ids, ends = best_fit.encode_texts(tok, known, pa.array(texts[at : at + 20]), 0)
        assert [p.tolist() for p in np.split(ids, ends[:-1])] == [ids_of(library, t) for t in texts[at : at + 20]]
        assert len(known.units) <= 200


def hold(rows, texts, library, size):
    """Checks whole documents, cuts, gapless sequences; returns how many sequences there are."""
    by, at = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        at[r.sequence_id].append(r)
    for doc, text in texts.items():
        whole, pieces = ids_of(library, text), sorted(by[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(whole) // size)
        assert all(r.length == size for r in pieces[1:]) and pieces[0].start == 0
        for r in pieces:
            assert np.frombuffer(r.ids, "<u4").tolist() == whole[r.start : r.start + r.length]
        assert sum(r.length for r in pieces) == len(whole)
    for held in at.values():
        end = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= size
    return len(at)


@pytest.mark.parametrize("parts", [1, 40])
def test_packing_is_whole_and_tight(spark, sf, library, parts, monkeypatch):
    monkeypatch.setattr(best_fit, "RUN", 50)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(parts)
    rows = best_fit.pack_documents(docs, PATH).collect()
    n = hold(rows, {r.doc_id: r.text for r in docs.collect()}, library, 2048)
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_few_open_bins(spark, sf, library, monkeypatch):
    monkeypatch.setattr(best_fit, "OPEN", 4)
    monkeypatch.setattr(best_fit.Bins.__init__, "__defaults__", (4,))
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    hold(best_fit.pack_documents(docs, PATH, 300).collect(), {r.doc_id: r.text for r in docs.collect()}, library, 300)


def test_the_fullest_bin_closes_first_and_the_best_fit_is_taken():
    bins = best_fit.Bins(10, 3)
    assert not any(bins.put(n, n) for n in (6, 7, 8))
    assert bins.put(9, 9) == [[8]] and bins.put(3, 3) == [[7, 3]] and bins.put(1, 1) == [[9, 1]]
    assert sorted(bins.rest()) == [(4, [6])]


def test_packing_odd_rows(odd, none, library):
    rows = best_fit.pack_documents(odd, PATH, 64).collect()
    want = Counter()
    for r in odd.collect():
        want[r.doc_id] += len(ids_of(library, r.text))
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want and best_fit.pack_documents(none, PATH).count() == 0
    assert best_fit.digest(best_fit.pack_documents(odd, PATH)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    held = best_fit.sequences(best_fit.pack_documents(odd, PATH, 64)).collect()
    assert sum(len(r.ids) for r in held) == 4 * sum(want.values()) and all(4 * sum(p.length for p in r.pieces) == len(r.ids) for r in held)


def test_texts_over_a_slice(spark, library, monkeypatch):
    monkeypatch.setattr(best_fit, "GATHER", 1 << 12)
    monkeypatch.setattr(resample, "SLICE", 1 << 12)
    docs = [(i, f"w{i} beta, gamma. " * (400 if i % 9 == 0 else 20)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    hold(best_fit.pack_documents(df, PATH).collect(), dict(docs), library, 2048)
    check_resample(df, df.limit(5))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def check_resample(docs, target):
    import hashlib

    own, wanted = [(r.doc_id, *grams(r.text)) for r in docs.select("doc_id", "text").collect()], Counter()
    for r in target.select("text").collect():
        wanted.update(grams(r.text)[1])
    corpus = Counter(b for _, _, g in own for b in g)
    s, t = corpus.total(), wanted.total()
    gain = {b: math.floor(1000 * math.log(float(wanted[b] + 1) * float(s + 10_000) / (float(n + 1) * float(t + 10_000)))) for b, n in corpus.items()}
    want = []
    for doc, n, g in own:
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        want.append((doc, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = Counter((*x[:1], *x[2:], i + 1) for i, x in enumerate(able[: 5 * len(able) // 100]))
    rest = Counter((*x[:1], *x[2:], None) for x in [*able[5 * len(able) // 100 :], *(x for x in want if x[1] < 20)])
    assert Counter(tuple(r) for r in resample.resample(docs, target).collect()) == drawn + rest


def test_resample_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_resample(docs.repartition(5), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert dict(resample.resample(docs, docs).dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}


def test_resample_equals_its_sql(spark, sf, duck, same_rows):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert same_rows(resample.resample(docs, bench), duck, resample.ORACLE) == docs.count()


def test_resample_odd_rows(spark, odd, none):
    many = odd.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).drop("k")
    check_resample(many, odd)
    check_resample(odd, none)
    check_resample(none, odd)


def test_runs_of_the_suffix_array():
    """Long words, non-ASCII words, more ids than a packed key holds."""
    texts = ["é" * 500 + " x " + "y" * 100 + " Z z", "a b a b a b", "", None, "A\0B ab", "日本 語 日本 語 x"]
    found = [[] for _ in texts]
    for bucket, begin, size, of in resample.buckets_of(pa.array(texts)):
        for b, at, n in zip(bucket.tolist(), begin.tolist(), size.tolist(), strict=True):
            for p in range(at, at + n):
                found[of[p]].append(b)
    assert [sorted(f) for f in found] == [sorted(grams(t)[1]) for t in texts]
    ids, of = np.array([5, 1 << 40, 5, 1 << 40, 5]), np.array([0, 0, 0, 1, 1])
    order, starts = resample.runs(ids, of)
    assert order.tolist()[:1] == [2] and [len(s) for s in starts] == [2, 3, 3]
    assert common.SLICE_BYTES == 4 << 20

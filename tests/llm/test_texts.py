"""Token counts, codecs, shards, media, chunks: against the libraries or brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from blockloom.llm import line_chunks, media, queries, webp, word_ids
from blockloom.llm import ring_shards as ring_module
from blockloom.llm.piece_codec import PieceCodec, digests, encode_decode
from blockloom.llm.pieces import encode_keys, keys, model
from blockloom.llm.ring_shards import ring_shards
from blockloom.llm.token_counts import token_counts

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "▁", "é", "日", "<s>", "\x00", "\t", "the", "ing", "😀", "x" * 250, "　", "ab" * 120, ".", "İ", "Σ", "é", "<|endoftext|>", "'s", ".,", "ﬁ"]


def noise(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_piece_units_and_merges_equal_the_library():
    sp, own = model(PIECES), PieceCodec(PIECES)
    rng = random.Random(2)
    runs = ["".join(rng.choice(letters) for _ in range(n)) for n in (5, 60, 1500) for letters in ("ab", "aein", "est ing", "=-", "日本語中文的是", "etaoinshrdlu", "xX01") for _ in range(6)]
    for text in [*noise(400), *runs, "", " ", "\n", " \n ", "a" * 3000, "ab" * 20_000, "-" * 5001]:
        units = keys(text)
        want = sp.encode(text)
        assert [i for ids in encode_keys(sp, units) for i in ids] == want
        assert np.frombuffer(b"".join(own.encode_keys(units)), "<u4").tolist() == want
        full = [1, *want, 2]
        assert own.decode(np.array(full)) == sp.decode(full)


def test_odd_ids_decode_as_the_library_does():
    sp, own, rng = model(PIECES), PieceCodec(PIECES), random.Random(1)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2, 28705]) for _ in range(rng.randint(0, 6))]
        if not any(i < 259 for i in ids):
            assert own.decode(np.array(ids, int)) == sp.decode(ids)


def test_token_counts(odd, none):
    sp = model(PIECES)
    got = token_counts(odd, PIECES, 100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and token_counts(none, PIECES, 100).count() == 0
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(sp.encode(r.text or "")), n > 100) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want


def test_piece_codec(odd, none):
    sp = model(PIECES)
    want = []
    for r in odd.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((str(r.doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in digests(encode_decode(odd, PIECES)).collect()) == sorted(want)
    assert encode_decode(none, PIECES).count() == 0


@pytest.mark.parametrize("top", [2, 300, 1 << 17, 1 << 45, 1 << 62])
def test_words_pack_and_unpack(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 7, 240, 1000):
        ids = (rng.integers(0, top, n) * (rng.random(n) < 0.7)).astype(np.uint64)
        words, _ = word_ids.pack(ids)
        assert (word_ids.unpack(words, n) == ids).all()
    big = rng.integers(0, top, 15_000).astype(np.uint64)
    first, docs, none, counts, ids = word_ids.read_segment(word_ids.write_segment(5, [None, 9], [big[:7], big[7:]]))
    assert first == 5 and docs.tolist() == [0, 9] and none == 1 and counts.tolist() == [7, 14_993] and (ids == big).all()


def test_word_ids(odd, none):
    tok, at, want = Tokenizer.from_file(WORDS), 0, []
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((str(r.doc_id), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = word_ids.read_ids(word_ids.write_ids(odd, WORDS, 1))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert word_ids.read_ids(word_ids.write_ids(none, WORDS, 1)).count() == 0


def test_words_between_gaps_equal_the_library():
    tok, texts = word_ids.tokenizer(WORDS), [*noise(1500, 9), None, "Heath. \u00c9tre, Ab\ncd 12.5% x<|endoftext|>y a<|b don't''s \u0301x e\u0301 \u01c5"]
    ids, counts = word_ids.encode_texts(tok, pa.array(texts), {}, [1])
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_one_id_with_most_rows_is_dealt_over_buckets(spark):
    tok, at, want = word_ids.tokenizer(WORDS), 0, []
    docs = spark.createDataFrame([(5 if k < 300 else None if k < 400 else -(2**63) if k == 400 else k, f"text {k % 150}") for k in range(500)], "doc_id long, text string")
    files = word_ids.write_ids(docs, WORDS, 1)
    got = word_ids.read_ids(files).orderBy("start").collect()
    assert files.filter("bucket > 0").count() > 12 and [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(500)]
    ids = [r.doc_id for r in got]
    assert ids[:100] == [None] * 100 and ids[100] == -(2**63) and ids[100:] == sorted(ids[100:]) and ids.count(5) == 300
    want = sorted(zlib.crc32(np.array([*tok.encode(f"text {k % 150}").ids, 1], "<u4").tobytes()) for k in range(500))
    assert sorted(r.ids_crc32 for r in got) == want


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (17, 33), (24, 50)])
def test_webp_features_round_trip(size):
    rng = np.random.default_rng(size[0])
    h, w = size
    wide = rng.integers(0, 2**32, size, dtype=np.uint32)
    flat = np.full(size, 0xFF00AA00, np.uint32)
    few = rng.choice(np.array([1, 2, 300, 0xFF000000, 7], np.uint32), size)
    modes = rng.integers(0, 14, (-(-h // 4), -(-w // 4)))
    for x in (wide, flat, few):
        for k in ({}, {"green": True}, {"cross": (13, -77, 200)}, {"cache_bits": 6}, {"predictor": modes}, {"predictor": modes, "cross": (3, 4, 5), "green": True, "cache_bits": 3}, {"palette": True}):
            if k.get("palette") and len(np.unique(x)) > 256:
                continue
            data = webp.encode(x, **k)
            assert (webp.decode(data) == x).all() and (webp.decode_many([data, data])[1] == x).all()


def test_webp_rejects_what_it_cannot_read():
    data = webp.encode(np.arange(600, dtype=np.uint32).reshape(20, 30))
    for bad in (b"", b"RIFF" + data[4:8] + b"WAVE" + data[12:], data[:20] + b"\x00" + data[21:], data[:60]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_media(odd, none):
    got = media.digest(media.write_media(odd)).collect()
    want = []
    for r in odd.collect():
        raw = (r.text or "").encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want.append((str(r.doc_id), len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    by = {r.doc_id: r for r in got}
    assert by[1].media_sha256 == by[2].media_sha256 and by[1].feature == by[2].feature
    assert media.digest(media.write_media(none)).count() == 0


def test_line_chunks_equal_their_sql(spark, sf, duck, same_rows):
    assert same_rows(queries.QUERIES["op5_line_chunks"](spark, sf), duck, line_chunks.ORACLE)


def test_line_chunks_keep_first_and_all_that_is_single(spark, odd, none):
    passage = "\n".join(f"line {i} of a passage that comes back word by word" for i in range(12))
    long = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, f"head one\n{passage}\ntail one", 5), (2, f"other head\n{passage}\nother tail", 5), (3, f"{long}\nmine", 5), (4, f"yours\n{long}", 5), (5, None, 5), (6, "", 5)], "doc_id long, text string, kept int").drop("kept")
    by = {r.row.doc_id: r for r in line_chunks.line_dedup(docs).collect()}
    assert by[1].kept == by[1].text and by[3].kept == by[3].text and by[4].kept == "yours" and by[5].kept is None and by[6].kept == ""
    assert len(by[2].kept) < len(by[2].text) / 2 and by[2].kept.startswith("other head") and by[2].kept.endswith("other tail")
    got = line_chunks.line_dedup(odd)
    assert got.count() == odd.count() and line_chunks.line_dedup(none).count() == 0 and got.select("row.*").columns == [c for c in odd.columns if c != "text"]
    back = line_chunks.without_repeats(odd)
    assert back.columns == odd.columns and {r._key for r in back.collect()} == {7} and line_chunks.without_repeats(none).columns == odd.columns


def test_pipeline_takes_whole_runs_out(spark, odd, none):
    line = lambda name, n: " ".join(f"{name}.{i}" for i in range(n))
    rows, want = [], {}
    for k in range(24):
        passage = "\n".join([line(f"p{k}a", 28), *(["", " "] if k % 3 == 0 else []), line(f"p{k}b", 30), *(line(f"p{k}c{j}", 9) for j in range(k % 4))])
        short = f"{line(f's{k}', 20)}\n{line(f't{k}', 30)}"
        ends = [[line(f"{w}{k}{e}", 5) for w in "xyz"] for e in "gh"]
        for i, (head, mid, tail) in enumerate(ends):
            rows.append((2 * k + i, f"{head}\n{passage}\n{mid}\n{short}\n{tail}", "en", "a", 0))
        want[2 * k], want[2 * k + 1] = rows[-2][1], "\n".join([ends[1][0], ends[1][1], short, ends[1][2]])
    rows += [(None, rows[0][1], "en", "a", 0), (100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, rows[0][1], "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    cut = {r.row.doc_id: r for r in line_chunks.without_repeated_runs(docs).withColumnRenamed("kept", "text").collect()}
    # the null id sorts first: all of document 0 has come before
    assert cut[None].cut == 0 and cut[None].text == rows[0][1] and cut[0].text == cut[102].text == "" and cut[100].text is None and cut[101].text == ""
    assert {i: cut[i].text for i in want if i > 1} == {i: t for i, t in want.items() if i > 1}
    out = {r.doc_id: r.text for r in line_chunks.without_repeats(docs.filter("doc_id IS NOT NULL")).collect()}
    assert 102 not in out and all(f"p{k}a.0" not in out[2 * k + 1] and f"p{k}b.29" not in out[2 * k + 1] for k in range(24)) and all(out[2 * k] == want[2 * k] for k in range(24))
    assert line_chunks.without_repeated_runs(odd).count() == odd.count() and line_chunks.without_repeated_runs(none).count() == 0


def test_ring_shards(spark, odd, none, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ring_shards(docs).toPandas()
    per = got.groupby("shard")
    assert len(got) == docs.count() and sorted(per.groups) == list(range(24)) and per.size().max() - per.size().min() <= 1
    assert all(sorted(x) == list(range(len(x))) for _, x in per["slot"])
    crc = {r.doc_id: (len(r.text.encode()) + 8, zlib.crc32(r.text.encode())) for r in docs.collect()}
    assert all((size, crc_) == crc[i] for i, size, crc_ in got[["doc_id", "size", "text_crc32"]].values.tolist())
    again = ring_shards(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    more = ring_shards(docs, 25).toPandas().set_index("doc_id").shard
    assert (more != got.set_index("doc_id").shard).mean() < 0.15  # 0.04 at least, more as bounds round on 200 rows
    assert got[["doc_id", "shard", "slot"]].values.tolist() == ring_by_hand(got, 24)
    small = ring_shards(odd).toPandas()
    assert len(small) == odd.count() and small.groupby("shard").size().max() == 1 and ring_shards(none).count() == 0


def ring_by_hand(rows, shards):
    """(doc_id, shard, slot) by walking the ring, cell by cell and row by row."""
    place = lambda key: int(hashlib.md5(key.encode()).hexdigest()[:12], 16)
    wide, nodes = 2**48 // ring_module.CELLS, {}
    for s in range(shards):
        for v in range(ring_module.VIRTUAL):
            at = place(f"node/{s}/{v}") // wide
            nodes[at] = min(s, nodes.get(at, s))
    stops = sorted(nodes)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    cells = {}
    for i, size, crc in rows[["doc_id", "size", "text_crc32"]].values.tolist():
        p = place(f"key/{i}/{crc}")
        cells.setdefault(p // wide, []).append((p, i, size, crc))
    home = lambda cell: next((n for n in stops if n >= cell), stops[0])
    out, full, over = {}, [0] * shards, {n: [] for n in stops}
    for cell in sorted(cells, key=lambda c: (hashlib.md5(str(c).encode()).hexdigest(), c)):  # a shard's own order
        s = nodes[home(cell)]
        for row in sorted(cells[cell]):
            if full[s] < room[s]:
                out[row[1]] = (s, full[s])
                full[s] += 1
            else:
                over[home(cell)].append((cell if cell <= home(cell) else cell - ring_module.CELLS, row))
    queue = []
    for lap in range(2):
        for n in stops:
            if not lap:
                queue += sorted(over[n], key=lambda r: r[0])  # cells in ring order, rows in their own
            s = nodes[n]
            while queue and full[s] < room[s]:
                out[queue.pop(0)[1][1]] = (s, full[s])
                full[s] += 1
    return [[i, *out[i]] for i in rows["doc_id"].tolist()]


def test_ids_of_small_batches_are_made_together():
    tok = word_ids.tokenizer(WORDS)
    texts = ["Word word WORD", "Étre étre x9,y", None, "word don't"] * 50
    one = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    small = [one.slice(k, 10) for k in range(0, len(texts), 10)]
    got = list(word_ids.gathered(iter(small), 1 << 20))
    assert len(got) == 1 and got[0].column(0).to_pylist() == texts and list(word_ids.gathered(iter([]))) == []
    assert sum(b.num_rows for b in word_ids.gathered(iter(small), 300)) == len(texts)
    cache, asked = {}, []

    class Seen(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    cache = Seen()
    ids, counts = word_ids.encode_texts(tok, got[0].column(0), cache, [1])
    want = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]
    assert len(asked) == len(set(asked))  # a word is looked up once

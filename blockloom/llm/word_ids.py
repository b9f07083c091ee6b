"""Token-id shards in a Simple-8b file format: words of 64 bits that pack varying counts of ids.

A segment file is::

    b"BLS8" | version u16 | 0 u16 | first u64 | ids u64 | documents u32 | without id u32 | words u64 | blocks u32
    documents x (doc_id i64, ids u32)     in ascending doc_id order; those without an id first
    blocks x (first word u64, first id u64)
    words x u64

The four high bits of a word are its selector (``SELECTORS``: how many ids of how many bits). Selector 15 marks an escape:
its low bits count the raw 64-bit words that follow, one for an id of 2**60 or more each. Every ``BLOCK_WORDS`` words a
block begins, never inside an escape, so blocks decode on their own; within a block all words of one selector unpack at once.

Files are stored as rows (bucket, segment, data) of a Parquet table, as Spark's writers alone reach any store and commit
whole files when executors are lost. A bucket is a range of doc_ids, or one of an id's ranges of text hashes where an id has
more rows than a bucket should; segments follow each other in it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import arrow_rows, partitions, slices, written

#: (ids, bits) of each selector; fixed by the published format.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
_U64 = np.uint64
ESCAPE, BLOCK_WORDS, SEGMENT_IDS, CACHE_ROWS, GATHERED, NONE = 15, 4096, 1 << 19, 800_000, 8 << 20, -(1 << 63)
_WIDTHS = np.array(sorted({b for _, b in SELECTORS}), np.uint64)
_NEED = np.searchsorted(_U64(1) << _WIDTHS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.int8)
_HEAD = struct.Struct("<4sHHQQIIQI")
_TOKENIZERS: dict[str, Tokenizer] = {}


def _reach(need: np.ndarray) -> dict[int, np.ndarray]:
    """For each count of the selectors: the widest need among that many ids from each place on, ids past the end being narrow."""
    n, longest = len(need), SELECTORS[0][0]
    window = {1: np.concatenate([need, np.ones(longest, np.int8)])}
    for count in sorted({c for c, _ in SELECTORS}):  # a window is the union of two shorter ones that overlap
        below = max(k for k in window if 2 * k >= count or k == max(window))
        while 2 * below < count:
            window[2 * below] = np.maximum(window[below][:-below], window[below][below:])
            below *= 2
        window[count] = np.maximum(window[below][: len(window[below]) - (count - below)], window[below][count - below :])
    return {c: window[c][:n] for c, _ in SELECTORS}


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of an array of unsigned ids, and per word the number of ids packed before it (one entry more at the end).

    Each word takes the selector with the most ids that fit, as many as are left at the end.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, _U64), np.zeros(1, np.int64)
    if int(ids.max()) < len(_NEED):
        need = _NEED[ids.astype(np.int64)]
    else:
        need = np.searchsorted(_U64(1) << _WIDTHS, ids, "right").astype(np.int8)  # how many widths are too small
    best, reach = np.full(n, ESCAPE, np.int8), _reach(need)
    for s in range(len(SELECTORS) - 1, -1, -1):  # from few wide ids to many narrow ones
        count, bits = SELECTORS[s]
        np.putmask(best, reach[count] <= np.searchsorted(_WIDTHS, bits), np.int8(s))
    took = np.minimum(np.array([c for c, _ in SELECTORS] + [1], np.int32)[best], n - np.arange(n, dtype=np.int32) if n < 1 << 31 else n - np.arange(n))
    step, at, starts = took.tolist(), 0, []
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    sel, cnt = best[starts].astype(np.int64), took[starts]
    words = sel.astype(_U64) << _U64(60)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == ESCAPE or SELECTORS[s][1] == 0:
            continue
        count, bits = SELECTORS[s]
        for k in range(count):
            live = rows[cnt[rows] > k]
            if not len(live):
                break
            words[live] |= ids[starts[live] + k] << _U64(k * bits)
    before = np.r_[starts, n]
    raw = np.flatnonzero(sel == ESCAPE)
    if len(raw):  # runs of escapes share a word with their count
        words[raw] |= _U64(1)
        words = np.insert(words, raw + 1, ids[starts[raw]])
        before = np.insert(before, raw + 1, starts[raw])
    return words, before


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of an array of words."""
    words = words.astype(_U64)
    sel = (words >> _U64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():
        at = 0
        while at < len(words):  # an escaped value's own high bits may look like a selector
            nxt = np.flatnonzero(sel[at:] == ESCAPE)
            if not len(nxt):
                break
            at += int(nxt[0]) + 1
            raw[at] = True
            at += 1
    counts = np.array([c for c, _ in SELECTORS] + [0])[sel]
    counts[raw] = 1
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, _U64)
    for s in np.unique(sel[~raw]):
        if s == ESCAPE or SELECTORS[s][1] == 0:
            continue
        count, bits = SELECTORS[s]
        rows = np.flatnonzero((sel == s) & ~raw)
        fields = (words[rows, None] >> (np.arange(count, dtype=_U64) * _U64(bits))) & _U64((1 << bits) - 1)
        out[(ends[rows] - count)[:, None] + np.arange(count)] = fields
    out[ends[raw] - 1] = words[raw]
    return out[:n]


def write_segment(first: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One file of whole documents; ``first`` is the index of its first id within the bucket."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    words, before = pack(flat)
    starts = np.arange(0, len(words), BLOCK_WORDS)
    if len(words):
        inside = np.flatnonzero(np.diff(before[:-1], append=before[-1]) == 0)  # the words that introduce an escape
        starts = np.where(np.isin(starts - 1, inside), starts - 1, starts)
    docs = np.zeros(len(doc_ids), [("id", "<i8"), ("n", "<u4")])
    docs["id"], docs["n"] = [0 if i is None else i for i in doc_ids], [len(x) for x in ids]
    blocks = np.zeros(len(starts), [("word", "<u8"), ("id", "<u8")])
    blocks["word"], blocks["id"] = starts, before[starts] if len(starts) else []
    return b"".join([_HEAD.pack(b"BLS8", 2, 0, first, len(flat), len(doc_ids), doc_ids.count(None), len(words), len(starts)), docs.tobytes(), blocks.tobytes(), words.astype("<u8").tobytes()])


def read_segment(data: bytes) -> tuple[int, np.ndarray, int, np.ndarray, np.ndarray]:
    """(first, doc_ids, how many of these stand for no id, counts, ids) of a file, block by block through its offsets."""
    magic, version, _, first, n, n_docs, n_null, n_words, n_blocks = _HEAD.unpack_from(data)
    if magic != b"BLS8" or version != 2:
        raise ValueError("not a segment file")
    at = _HEAD.size
    docs = np.frombuffer(data, [("id", "<i8"), ("n", "<u4")], n_docs, at)
    blocks = np.frombuffer(data, [("word", "<u8"), ("id", "<u8")], n_blocks, at := at + docs.nbytes)
    words = np.frombuffer(data, "<u8", n_words, at + blocks.nbytes)
    ids = np.zeros(n, np.uint64)
    edges = np.r_[blocks["word"].astype(np.int64), n_words]
    at_id = np.r_[blocks["id"].astype(np.int64), n]
    for b in range(n_blocks):
        ids[at_id[b] : at_id[b + 1]] = unpack(words[edges[b] : edges[b + 1]], at_id[b + 1] - at_id[b])
    return first, docs["id"], n_null, docs["n"].astype(np.int64), ids


#: The settings under which no token reaches over a space or line feed. Normalisers that neither join nor look past
#: them (NFC composes with no space, lower-casing goes by character), and a splitter whose every alternative excludes white space.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLITTER = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, one for each worker process; refuses one under which texts don't fall apart into words."""
    if path not in _TOKENIZERS:
        tok = Tokenizer.from_file(path)
        kind = json.loads(tok.to_str())
        added = [t for t in kind["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") or re.search(r"\s", t["content"])]
        if kind["normalizer"] != {"type": "Sequence", "normalizers": _NORMALIZERS} or kind["pre_tokenizer"] != {"type": "Sequence", "pretokenizers": _SPLITTER} or added or kind["model"].get("dropout"):
            raise ValueError("the tokenizer's words aren't known to be those between spaces")
        _TOKENIZERS[path] = tok
    return _TOKENIZERS[path]


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if it prints in Latin-1, else the next from U+0100 on."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or (161 <= b and b != 173):
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


_LETTERS = _byte_letters()
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Words of Latin letters, digits and ASCII signs but apostrophes: normalisation leaves their characters apart, and the splitter
#: makes a pre-token of each run of letters, each digit and each run of signs. ``<|`` opens the added tokens.
_PLAIN = re.compile(f"(?!.*<\\|)[{_LATIN}0-9!-&(-/:-@\\[-`{{-~]+")
_PARTS = re.compile(f"[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
_CACHES: dict[str, dict[str, bytes]] = {}


def _learn(tok: Tokenizer, words: Iterable[str], cache: dict[str, bytes]) -> None:
    """Puts the ids of words that the cache lacks into it: plain ones by their parts, through the model itself, others through the library."""
    model, odd = tok.model.tokenize, []
    for w in words:
        if w.isascii() and w.isalpha():
            parts = (w,)
        elif _PLAIN.fullmatch(w):
            parts = _PARTS.findall(w)
        else:
            odd.append(w)
            continue
        for p in parts:
            if p not in cache:
                low = p.lower()
                if low not in cache:  # printing ASCII is written as it is
                    ids = [t.id for t in model(low if low.isascii() else low.encode().decode("latin-1").translate(_LETTERS))]
                    cache[low] = struct.pack(f"<{len(ids)}I", *ids)
                cache[p] = cache[low]
        if len(parts) > 1:
            cache[w] = b"".join([cache[p] for p in parts])
    if odd:
        cache.update((w, np.array(c.ids, "<u4").tobytes()) for w, c in zip(odd, tok.encode_batch(odd, add_special_tokens=False), strict=True))


def encode_texts(tok: Tokenizer, texts: pa.Array, cache: dict[str, bytes], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with ``end`` behind it, in one array, and their counts: by distinct words between spaces and line feeds."""
    split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
    coded = split.values.dictionary_encode()
    words = coded.dictionary.to_pylist()
    if len(cache) > CACHE_ROWS:  # what came first is what comes often
        for w in list(cache)[CACHE_ROWS // 2 :]:
            del cache[w]
    cache.setdefault("", b"")
    raw = list(map(cache.get, words))
    if new := [i for i, ids in enumerate(raw) if ids is None]:
        _learn(tok, [words[i] for i in new], cache)
        for i in new:
            raw[i] = cache[words[i]]
    flat, lens = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    at = coded.indices.to_numpy()
    counts, first = lens[at], (np.cumsum(lens) - lens)[at]
    whole = np.concatenate([[0], np.cumsum(counts)])
    ids = flat[np.repeat(first - whole[:-1], counts) + np.arange(whole[-1])]
    ends = whole[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
    sizes = np.diff(ends, prepend=0)
    return np.insert(ids, np.repeat(ends, len(end)), np.tile(np.array(end, "<u4"), len(ends))), sizes + len(end)


def gathered(batches: Iterator[pa.RecordBatch], least: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``least`` bytes or a batch more: the more texts, the fewer distinct words a text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, sorts by id and writes; returns the table (bucket, segment, data) of segment files.

    Rows without an id come first. Repeated ids stay, ordered by their texts' hashes. Null and empty texts hold the end id
    alone. Only bucket bounds (quantiles of the ids, one for each of the buckets) reach the driver.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    buckets = 4 * partitions(spark)
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(NONE))
    cuts = docs.agg(F.percentile_approx(rank, [i / buckets for i in range(1, buckets)], 100 * buckets)).first()[0] or []
    bounds = np.array(cuts, np.int64)  # an id that holds more than a bucket's rows is several bounds

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, cache = tokenizer(tokenizer_path), _CACHES.setdefault(tokenizer_path, {})
        for batch in gathered(slices(batches, text)):
            ids, counts = encode_texts(tok, batch.column(1), cache, [end_id])
            names, spread = batch.column(0).fill_null(NONE).to_numpy(), batch.column(2).to_numpy().view(np.uint64) >> _U64(32)
            low, high = np.searchsorted(bounds, names, "left"), np.searchsorted(bounds, names, "right")
            bucket = np.where(high > low, low + 1 + (spread.astype(np.int64) * (high - low) >> 32), high).astype(np.int32)
            narrow = ids.astype("<u2") if len(ids) and ids.max() < 1 << 16 else ids
            offsets = np.concatenate([[0], np.cumsum(counts)]) * narrow.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(np.ascontiguousarray(narrow))])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(0), batch.column(2), pa.array(counts.astype(np.int32)), packed.cast(pa.binary())], ["bucket", "id", "h", "n", "ids"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, first, held, names, ids = None, 0, 0, 0, [], []

        def flush():
            nonlocal number, first, held, names, ids
            data = write_segment(first, names, ids)
            out = pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["bucket", "segment", "n_ids", "data"])
            number, first, held, names, ids = number + 1, first + held, 0, [], []
            return out

        for batch in batches:
            for b, i, n, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if names and (b != bucket or held >= SEGMENT_IDS):
                    yield flush()
                if b != bucket:
                    bucket, number, first = b, 0, 0
                names.append(i)
                ids.append(np.frombuffer(raw, f"<u{len(raw) // n}"))
                held += n
        if names:
            yield flush()

    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias(text), F.xxhash64(text).alias("h")).mapInArrow(encode, "bucket int, id long, h long, n int, ids binary")
    # by unsigned hash, as the buckets of an id that has several are ranges of it
    packed = packed.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "id", F.expr("h < 0"), "h", "ids")
    return written(packed.select("bucket", "id", "h", "n", "ids").mapInArrow(segments, "bucket int, segment int, n_ids long, data binary"), "ids")


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the segment files, ``start`` over all documents before it."""
    totals = files.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, names, n_null, counts, ids = read_segment(data)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                none = np.arange(len(names)) < n_null
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), bucket, np.int32)), pa.array(names, mask=none), pa.array(first + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["bucket", "id", "local", "n_tokens", "ids_crc32"])

    rows = files.select("bucket", "data").mapInArrow(read, "bucket int, id long, local long, n_tokens long, ids_crc32 long")
    # one row for each bucket: four times the shuffle partitions at most
    return rows.join(F.broadcast(totals), "bucket").select(F.col("id").alias(id_col), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

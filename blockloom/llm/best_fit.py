"""Packing of token sequences by bounded-space online best-fit.

A document's ids, with an end id behind them, are one piece, or several where they are longer than a sequence: whole sequences from
the end on, so that only the first piece may be shorter. A task packs the pieces of its own rows as they come, without a shuffle:
``OPEN`` bins are open at most, their free space is the key of a bitset, a piece goes where the least space is left that holds it,
and where a bin is needed and none may open, the fullest closes. Pieces come in runs of ``RUN``, the longest of a run first.

What lies in bins still open at a task's end goes on to the next level, where the rest of ``FAN`` tasks are packed in the same way,
until one group is left; so at most ``OPEN`` sequences in all stay loosely filled, however many tasks there are, and each level
shuffles the rest of the one before it only. A group of a level holds the contents of ``FAN * OPEN`` sequences at most.

Each row is a document of its own, repeated rows and ids too. A null or empty text is the end id alone; a null id stays null; other
columns are ignored; an empty table gives an empty result. Texts of any length are encoded whole: one longer than a slice is a slice.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import partitions, slices, written
from .word_ids import _LETTERS

OPEN, RUN, FAN, CACHE_ROWS, GATHER = 1024, 1000, 16, 1_000_000, 4 << 20
#: A bin with less free space than this part of a sequence is left as it is at a task's end.
TIGHT = 128
_SPACE = "[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \u0085   -     　]"
#: Three white spaces in a row, or two before an added token or a text's end: there a pre-token may hold several. Of two before a word, each is apart.
_AMID = f"{_SPACE}{_SPACE}(?:{_SPACE}|<\\||$)|\\x00"
_BEFORE_SPACES = re.compile(r"(?<=\S)(?=\s)")
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Units of Latin letters, digits and ASCII signs but apostrophes: the splitter makes a pre-token of each run of letters, of digits and
#: of signs, a space before it included. ``<|`` opens the added token.
_PLAIN = re.compile(f"(?s:(?!.*<\\|))[ \n]?[{_LATIN}0-9!-&(-/:-@\\[-`{{-~]*")
_PARTS = re.compile(f" ?[{_LATIN}]+| ?[0-9]+| ?[^{_LATIN}0-9 \n]+|[ \n]")
_TOKENIZERS: dict[str, tuple[Tokenizer, Known]] = {}


class Known:
    """Ids of units seen before, as Arrow and numpy arrays: looked up for a whole slice at once."""

    def __init__(self):
        self.units, self.ids, self.ends = pa.array([""], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def find(self, units: pa.Array) -> np.ndarray:
        """Places of the units, -1 where unknown."""
        return pc.index_in(units, value_set=self.units).fill_null(-1).to_numpy().astype(np.int64)

    def learn(self, units: pa.Array, raw: list[bytes]) -> None:
        lens = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        self.units = pa.concat_arrays([self.units, units])
        self.ends = np.concatenate([self.ends, (self.ends[-1] if len(self.ends) else 0) + np.cumsum(lens)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), "<u4")])

    def shrink(self, rows: int) -> None:
        """Forgets all but the first: what came first is what comes often."""
        self.units, self.ends = self.units[:rows], self.ends[:rows]
        self.ids = self.ids[: self.ends[-1]]


def tokenizer(path: str) -> tuple[Tokenizer, Known]:
    """The tokenizer of a file and what is known of it, one for each worker process; refuses one whose texts don't fall apart before white space."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        kind = json.loads(tok.to_str())
        split = kind["pre_tokenizer"] or {}
        odd = [t for t in kind["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") or re.search(r"[\s\0.,]", t["content"])]
        if kind["normalizer"] or split.get("type") != "ByteLevel" or kind["model"]["type"] != "BPE" or split["add_prefix_space"] or not split["use_regex"] or odd or kind["model"].get("dropout"):
            raise ValueError("the tokenizer's pre-tokens aren't known to end before white space")
        _TOKENIZERS[path] = tok, Known()
    return _TOKENIZERS[path]


def _units(texts: pa.Array) -> pa.ListArray:
    """Texts cut where no pre-token reaches: before each space, around each line feed and before stops and commas that follow a letter or
    digit; before runs of white space alone where these stand amid such."""
    texts = texts.cast(pa.large_string()).fill_null("")
    marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
    stops = pc.replace_substring(pc.replace_substring(marked, ".", "\0."), ",", "\0,")
    marked = pc.if_else(pc.match_substring_regex(texts, f"[^{_LATIN}0-9][.,]"), marked, stops)
    amid = pc.match_substring_regex(texts, _AMID)
    if not pc.any(amid).as_py():
        return pc.split_pattern(marked, "\0")
    return pa.array([_BEFORE_SPACES.split(t) if odd else m.split("\0") for t, m, odd in zip(texts.to_pylist(), marked.to_pylist(), amid.to_pylist(), strict=True)], pa.large_list(pa.large_string()))


def _ids(tok: Tokenizer, units: list[str]) -> list[bytes]:
    """Ids of units: plain ones by their parts, through the model itself, others through the library."""
    out, odd, model, parts = [b""] * len(units), [], tok.model.tokenize, {}
    for i, w in enumerate(units):
        if not _PLAIN.fullmatch(w):
            odd.append(i)
            continue
        for p in _PARTS.findall(w):
            if p not in parts:
                ids = [t.id for t in model(p.encode().decode("latin-1").translate(_LETTERS))]
                parts[p] = struct.pack(f"<{len(ids)}I", *ids)
            out[i] += parts[p]
    for i, e in zip(odd, tok.encode_batch([units[i] for i in odd], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


def encode_texts(tok: Tokenizer, known: Known, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id behind it, in one array, and where each text's end."""
    units = _units(texts)
    coded = units.values.dictionary_encode()
    words, rows = coded.dictionary, len(known.units)
    place = known.find(words)
    missing = np.flatnonzero(place < 0)
    if len(missing):
        place[missing] = rows + np.arange(len(missing))
        known.learn(words.take(pa.array(missing)), _ids(tok, words.take(pa.array(missing)).to_pylist()))
    place = place[coded.indices.to_numpy()]
    first, counts = known.ends[np.maximum(place - 1, 0)], np.diff(known.ends, prepend=0)[place]
    whole = np.concatenate([[0], np.cumsum(counts)])
    ids = known.ids[np.repeat(first - whole[:-1], counts) + np.arange(whole[-1])]
    if len(known.units) > CACHE_ROWS or len(known.ids) > 8 * CACHE_ROWS:
        known.shrink(min(rows, CACHE_ROWS // 2) if len(known.ids) <= 8 * CACHE_ROWS else 1)
    ends = whole[units.offsets.to_numpy()[1:] - units.offsets[0].as_py()]
    return np.insert(ids, ends, np.full(len(ends), end_id, "<u4")), ends + np.arange(1, len(ends) + 1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to ``GATHER`` bytes, longer ones cut."""
    held, size = [], 0
    for batch in slices(batches, "text", GATHER):
        if held and size + batch.nbytes > GATHER:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


class Bins:
    """Open bins of one size by free space. ``put`` places an item and gives back the contents of what it closes."""

    def __init__(self, size: int, most: int = OPEN):
        self.size, self.most, self.bits, self.count = size, most, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(size + 1)]

    def _take(self, least: int) -> tuple[int, list]:
        """The open bin with the smallest free space of at least ``least``."""
        fit = self.bits >> least
        free = least + (fit & -fit).bit_length() - 1
        held = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.count -= 1
        return free, held

    def put(self, length: int, item) -> list[list]:
        closed = []
        if self.bits >> length:
            free, held = self._take(length)
        else:
            if self.count == self.most:
                closed.append(self._take(1)[1])
            free, held = self.size, []
        held.append(item)
        free -= length
        if free:
            self.by_free[free].append(held)
            self.bits |= 1 << free
            self.count += 1
        else:
            closed.append(held)
        return closed

    def rest(self) -> Iterator[tuple[int, list]]:
        """(free space, contents) of the bins that are open, which close."""
        while self.count:
            yield self._take(1)


#: A piece: (doc, piece, start, length, ids as little-endian unsigned 32-bit integers).
Piece = tuple


def packed(pieces: Iterable[Piece], size: int, first: int, last: bool) -> Iterator[tuple[int | None, int | None, Piece]]:
    """(sequence, offset, piece) of all pieces, sequences numbered from ``first``; without numbers what the next level is to pack."""
    bins, number, run = Bins(size), first, []

    def placed(held: list[Piece]) -> Iterator[tuple[int, int, Piece]]:
        nonlocal number
        at = 0
        for piece in held:
            yield number, at, piece
            at += piece[3]
        number += 1

    def put(run: list[Piece]):
        for piece in sorted(run, key=lambda p: -p[3]):
            for held in bins.put(piece[3], piece):
                yield from placed(held)

    for piece in pieces:
        run.append(piece)
        if len(run) == RUN:
            yield from put(run)
            run = []
    yield from put(run)
    for free, held in bins.rest():
        if last or free * TIGHT < size:
            yield from placed(held)
        else:
            yield from ((None, None, piece) for piece in held)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids (little-endian unsigned 32-bit integers), sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"task long, id {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"

    def rows(level: int, group: int, pieces: Iterable[Piece], last: bool, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        names, out = [part.split()[0] for part in schema.split(", ")], []
        for sequence, offset, piece in packed(pieces, size, level << 58 | group << 32, last):
            out.append((group, *piece, sequence, offset))
            if len(out) == RUN:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = tokenizer(tokenizer_path)
        batches = _gathered(batches)
        head = next(batches, None)
        if head is None:
            return

        def pieces() -> Iterator[Piece]:
            batch = head
            while batch is not None:
                ids, ends = encode_texts(tok, known, batch.column(1), end_id)
                for doc, start, end in zip(batch.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    short = (end - start - 1) % size + 1
                    for piece, at in enumerate([start, *range(start + short, end, size)]):
                        to = min(end, at + (size if piece else short))
                        yield doc, piece, at - start, to - at, ids[at:to].tobytes()
                batch = next(batches, None)

        yield from rows(0, TaskContext.get().partitionId(), pieces(), False, head.column(0).type)

    def further(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of rows sorted by group: each group on its own."""
            stream = ((row[0], row[1:6], batch.column(1).type) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True))
            row = next(stream, None)

            def own(group: int) -> Iterator[Piece]:
                nonlocal row
                while row is not None and row[0] == group:
                    yield row[1]
                    row = next(stream, None)

            while row is not None:
                yield from rows(level, row[0], own(row[0]), last, row[2])

        return run

    level, now = 0, written(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(first, schema), "packed")
    done = now.filter("sequence_id IS NOT NULL")
    tasks = now.agg(F.max("task").alias("m")).first().m
    while tasks is not None:
        level, tasks = level + 1, tasks // FAN
        rest = now.filter("sequence_id IS NULL").withColumn("task", F.expr(f"task DIV {FAN}"))
        rest = rest.repartition(min(partitions(docs.sparkSession), tasks + 1), "task").sortWithinPartitions("task", F.xxhash64("id", "piece", "length"), "ids")
        now = written(rest.mapInArrow(further(level, tasks == 0), schema), f"packed-{level}")
        done = done.unionAll(now.filter("sequence_id IS NOT NULL"))
        if tasks == 0:
            break
    return done.drop("task").withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, pieces): the ids of each sequence and what they are of, in order."""
    part = F.struct("offset", id_col, "piece", "start", "length", "ids")
    own = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))  # a sequence holds a piece a token at most
    return own.select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.expr(f"transform(p, x -> struct(x.offset, x.`{id_col}`, x.piece, x.start, x.length))").alias("pieces"))


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with their ids' unsigned CRC-32 in place of the ids."""
    return pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The distinct units of a batch (see ``pieces``) become one flat numpy array of symbols, cut into words wherever no piece of the
vocabulary holds the two neighbouring characters, so that nothing could merge across. In each round every adjacent pair's
rank is looked up, a segmented minimum gives each word its best rank, and all its pairs of that rank that don't overlap, from the
left, merge at once, in all words; the array is compacted, until no word has a pair left. Where a merge makes a better
pair than those that it is done with, the word's merges to the right of it wait for the next round: the library, which merges one
by one, would turn to that pair first. Characters outside the vocabulary become their bytes' pieces.

Null and empty texts encode to begin and end ids alone and decode to an empty text. Repeated rows are encoded row by row,
other columns of the input are kept aside, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, slices
from .pieces import MARK, keys, model

#: Units that a worker's cache holds.
CACHE_ROWS = 150_000
_NONE = np.int64(1) << np.int64(40)
_CODECS: dict[str, PieceCodec] = {}


class PieceCodec:
    """Tables of one model: symbols of characters, pairs with their rank and result, bytes of pieces."""

    def __init__(self, path: str):
        sp = model(path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.n, self.bos, self.eos, self.unknown = n, sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.symbols = dict(self.ids)  # of pieces and of characters that are no piece
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, len(self.symbols) + n)
        self.text = {v: k for k, v in self.symbols.items()}
        pairs: dict[tuple[int, int], tuple[float, int]] = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                left, right = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (-sp.get_score(i), i)
        order = {s: r for r, s in enumerate(sorted({s for s, _ in pairs.values()}))}
        self.base = n + len(self.symbols) + 2
        flat = sorted((a * self.base + b, order[s], i) for (a, b), (s, i) in pairs.items())
        self.pair_key, self.pair_rank, self.pair_to = (np.array([x[j] for x in flat], np.int64) for j in range(3))
        bits = 1
        while 1 << bits < 4 * len(flat):
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.slot = np.full((1 << bits) + 64, -1, np.int64)  # open addressing, so that a lookup is a few gathers
        self.probes = 0
        for j, h in enumerate(self._hash(self.pair_key)):
            step = 0
            while self.slot[h + step] >= 0:
                step += 1
            self.slot[h + step] = j
            self.probes = max(self.probes, step + 1)
        chars = sorted({self.symbols[c] for p in self.ids for c in p})
        self.dense = np.zeros(self.base, np.int64)  # of a character: 1 on, 0 where no piece holds it
        self.dense[chars] = np.arange(1, len(chars) + 1)
        near = np.array([[self.symbols[p[k]], self.symbols[p[k + 1]]] for p in self.ids for k in range(len(p) - 1)], np.int64)
        self.wide = len(chars) + 1
        at = np.unique(self.dense[near[:, 0]] * self.wide + self.dense[near[:, 1]])  # neighbouring characters of some piece, as bits
        self.near = np.zeros(self.wide * self.wide // 8 + 1, np.uint8)
        np.bitwise_or.at(self.near, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        self.piece_bytes = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.control = {i for i in range(n) if sp.is_control(i)}

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the tables, -1 where it merges to nothing."""
        key = left * self.base + right
        at, found = self._hash(key), np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        for step in range(self.probes):
            j = self.slot[at[todo] + step]
            hit = (j >= 0) & (self.pair_key[j] == key[todo])
            found[todo[hit]] = j[hit]
            todo = todo[~hit & (j >= 0)]
            if not len(todo):
                break
        return found

    def _chars(self, unit: str) -> list[int]:
        get, base = self.symbols.get, self.base - 1  # characters that no piece holds share a symbol without pairs
        return [get(c, base) for c in unit]

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit, given as its text with space marks."""
        if not units:
            return []
        symbols = np.fromiter((s for u in units for s in self._chars(u)), np.int64)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), lens)
        dense = self.dense[symbols]
        pair = dense[:-1] * self.wide + dense[1:]
        cut = np.ones(len(symbols), bool)
        cut[1:] = ((self.near[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 0) | (unit[1:] != unit[:-1])
        starts = np.flatnonzero(cut)  # of words
        symbols, word, width = self._rounds(symbols, np.cumsum(cut) - 1, np.ones(len(symbols), np.int64))
        unit = unit[starts][word]
        plain = symbols < self.n
        ends = np.searchsorted(unit, np.arange(len(units) + 1))
        odd = set(unit[~plain].tolist())
        return [self._finish(symbols[a:b], width[a:b], units[i]) if i in odd else symbols[a:b] for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; ``_NONE`` where it merges to nothing."""
        at = self._pairs(left, right)
        return np.where(at >= 0, self.pair_rank[at], _NONE), self.pair_to[at]

    def _rounds(self, symbols, word, width):
        done_s, done_w, done_l = [], [], []
        rank, to = np.full(len(symbols), _NONE, np.int64), np.zeros(len(symbols), np.int64)  # of each symbol with the next one
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same], to[same] = self._ranks(symbols[same], symbols[same + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(word)])
            live = np.repeat(best < _NONE, counts)
            if not live.all():  # compaction: words without a pair leave
                done_s.append(symbols[~live]), done_w.append(word[~live]), done_l.append(width[~live])
                symbols, word, width, rank, to = symbols[live], word[live], width[live], rank[live], to[live]
                if not len(symbols):
                    break
                keep = best < _NONE
                best, counts = best[keep], counts[keep]
            hits = np.flatnonzero(rank == np.repeat(best, counts))
            hits = self._allowed(hits, symbols, word, rank, to)
            symbols[hits] = to[hits]
            width[hits] += width[hits + 1]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            moved = hits - np.arange(len(hits))
            symbols, word, width, rank, to = symbols[keep], word[keep], width[keep], rank[keep], to[keep]
            touched = np.zeros(len(symbols), bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            again = np.flatnonzero(touched)
            rank[again] = _NONE
            again = again[again + 1 < len(symbols)]
            again = again[word[again] == word[again + 1]]
            rank[again], to[again] = self._ranks(symbols[again], symbols[again + 1])
        if not done_s:
            return symbols, word, width
        symbols, word, width = np.concatenate(done_s), np.concatenate(done_w), np.concatenate(done_l)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order], width[order]

    def _allowed(self, hits, symbols, word, rank, to):
        """Of a round's pairs (each word's of its best rank), those that the library would merge before it turns to any other rank."""
        own = word[hits]
        first = np.r_[True, own[1:] != own[:-1]]
        if first.all():
            return hits
        alone = first & np.r_[first[1:], True]
        return np.sort(np.concatenate([hits[alone], self._several(hits[~alone], symbols, word, rank, to)]))

    def _several(self, hits, symbols, word, rank, to):
        """``_allowed`` of words with more than one pair of their best rank."""
        first = np.r_[True, word[hits[1:]] != word[hits[:-1]]]
        # of a run of overlapping pairs every other one, from the left
        begins = np.r_[True, (hits[1:] != hits[:-1] + 1)] | first
        place = np.arange(len(hits)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        hits = hits[place % 2 == 0]
        first = np.r_[True, word[hits[1:]] != word[hits[:-1]]]
        # a merge's new pairs: with the symbol before (itself a result if merged just before it), and with the one after, not merged yet
        before, after = np.maximum(hits - 1, 0), np.minimum(hits + 2, len(symbols) - 1)
        left = symbols[before]
        joined = np.r_[False, hits[1:] == hits[:-1] + 2] & ~first
        left[joined] = to[hits[np.flatnonzero(joined) - 1]]
        lower = np.where((hits > 0) & (word[before] == word[hits]), self._ranks(left, to[hits])[0], _NONE)
        upper = np.where((hits + 2 < len(symbols)) & (word[after] == word[hits]), self._ranks(to[hits], symbols[after])[0], _NONE)
        better = np.minimum(lower, upper) < rank[hits]
        passed = np.cumsum(better) - better  # better pairs made before each merge
        return hits[passed == passed[np.flatnonzero(first)[np.cumsum(first) - 1]]]

    def _finish(self, symbols: np.ndarray, width: np.ndarray, unit: str) -> np.ndarray:
        """Symbols that are no piece become the pieces of their bytes."""
        ids, at = [], 0
        for s, w in zip(symbols.tolist(), width.tolist(), strict=True):
            if s < self.n:
                ids.append(s)
            else:
                ids.extend(self.byte[b] for b in unit[at : at + w].encode())
            at += w
        return np.array(ids, np.int64)

    def encode_keys(self, todo: list[str]) -> list[bytes]:
        """Ids of each unit's key as little-endian unsigned 32-bit integers."""
        return [x.astype("<u4").tobytes() for x in self.encode_units([k.replace(" ", MARK) if k[:1] == "\n" else MARK + k.replace(" ", MARK) for k in todo])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish, byte pieces join to characters, the dummy prefix goes."""
        raw = b"".join(map(self.piece_bytes.__getitem__, ids.tolist()))
        if raw[:1] == b" " and next(i for i in ids.tolist() if i not in self.control) != self.unknown:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # ids that no encoder gives
            return self._decode_odd(ids)

    def _decode_odd(self, ids: np.ndarray) -> str:
        parts, run = [], b""
        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.piece_bytes[i]
                continue
            parts, run = [*parts, _one_by_one(run)], b""
            parts.append(self.piece_bytes[i].decode())
        out = "".join([*parts, _one_by_one(run)])
        first = next((i for i in ids.tolist() if i not in self.control), self.unknown)
        return out if first == self.unknown else out.removeprefix(" ")


def _one_by_one(raw: bytes) -> str:
    """Whole characters of a run of bytes, each byte outside one as U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


def codec(path: str) -> PieceCodec:
    """The tables of a model file, made once a worker process."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """(id, ids binary, decoded string) of every whole text; ids are little-endian unsigned 32-bit integers."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        cache: dict[str, bytes] = {}
        first = np.array([own.bos] * begin, "<u4").tobytes()
        last = np.array([own.eos] * end, "<u4").tobytes()
        for batch in slices(batches, text):
            parts = [keys(x) if x else [] for x in batch.column(text).to_pylist()]
            if len(cache) > CACHE_ROWS:
                cache.clear()
            missing = list(set().union(*parts).difference(cache))
            cache.update(zip(missing, own.encode_keys(missing), strict=True))
            coded = [first + b"".join(map(cache.__getitem__, p)) + last for p in parts]
            decoded = [own.decode(np.frombuffer(x, "<u4")) for x in coded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coded, pa.binary()), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias(text)).mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of ``encode_decode``'s rows."""
    return coded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))

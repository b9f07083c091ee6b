"""Lossless WebP: an encoder for 8-bit samples and a full decoder to pixel arrays.

The decoder reads every feature of the published bitstream: prefix codes (simple and normal, with code-length codes), several
groups of codes chosen by an entropy image, back-references with the plane's distance codes, colour cache, and the inverse of
the predictor, cross-colour, subtract-green and palette (with packed indexes) transforms.

Images are decoded side by side: each step of ``_entropy_lanes`` decodes one symbol (or copies one pixel) of every image of
a batch in a few numpy calls, so that the number of calls follows the longest image and not the number of pixels. The encoder keeps
images small (``ROWS`` rows) for that reason.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Samples of a row, rows of an image at most (a row holds one sample in each pixel's green), images decoded side by side.
WIDTH, ROWS, LANES, MAX_SIDE = 192, 64, 2048, 1 << 14
_U32, _U64 = np.uint32, np.uint64
#: Order in which the lengths of the code-length code are stored; fixed by the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTHS, SIZES = 24, (256 + 24, 256, 256, 256, 40)


def _plane_codes() -> list[tuple[int, int]]:
    """(xi, yi) of distance codes 1 to 120: neighbours by distance from the pixel, as the format orders them.

    By squared distance; of equals the row further up first, then the column further right of the pixel.
    """
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


PLANE = _plane_codes()


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes):
        self.value, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)

    def take(self, n: int) -> int:
        x = (self.value >> self.at) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the stream ends early")
        return x


def _reversed(bits: int) -> np.ndarray:
    """For each number of so many bits, the number with its bits in reverse."""
    if bits not in _REVERSED:
        x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for _ in range(bits):
            out, x = (out << 1) | (x & 1), x >> 1
        _REVERSED[bits] = out
    return _REVERSED[bits]


_REVERSED: dict[int, np.ndarray] = {}


def lookup(lens: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, bits) of a canonical code's lengths: the next ``bits`` bits index ``symbol << 4 | length``."""
    held = np.flatnonzero(lens)
    if len(held) <= 1:
        return np.array([int(held[0]) << 4 if len(held) else 0], np.uint16), 0
    order = held[np.argsort(lens[held], kind="stable")]
    own = lens[order].astype(np.int64)
    bits = int(own[-1])
    if int((1 << (bits - own)).sum()) != 1 << bits:
        raise ValueError("a prefix code is not complete")
    return np.repeat((order << 4 | own).astype(np.uint16), 1 << (bits - own))[_reversed(bits)], bits


def _read_code(bits: Bits, size: int) -> tuple[np.ndarray, int]:
    lens = np.zeros(size, np.int64)
    if bits.take(1):  # one or two symbols
        two = bits.take(1)
        first = bits.take(8 if bits.take(1) else 1)
        lens[first] = 1
        if two:
            lens[bits.take(8)] = 1
        return lookup(lens)
    some = np.zeros(19, np.int64)
    for i in range(4 + bits.take(4)):
        some[CODE_ORDER[i]] = bits.take(3)
    most = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    table, width = lookup(some)
    table = table.tolist()
    at, before, mask = 0, 8, (1 << width) - 1
    while at < size and most:
        most -= 1
        x = table[(bits.value >> bits.at) & mask]
        bits.at += x & 15
        x >>= 4
        if x < 16:
            lens[at] = x
            before = x or before
            at += 1
            continue
        n, v = (3 + bits.take(2), before) if x == 16 else (3 + bits.take(3), 0) if x == 17 else (11 + bits.take(7), 0)
        if at + n > size:
            raise ValueError("code lengths run over")
        lens[at : at + n] = v
        at += n
    return lookup(lens)


def _extra(bits: Bits, symbol: int) -> int:
    """Value of a length or distance prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.take(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = PLANE[code - 1]
    return max(1, x + y * width)


class Header:
    """What stands before an image's pixels: transforms, colour cache, entropy image, groups of five codes."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.width, self.height, self.transforms = width, height, []
        while main and bits.take(1):
            kind = bits.take(2)
            if any(t[0] == kind for t in self.transforms):
                raise ValueError("a transform comes twice")
            if kind in (0, 1):
                size = 2 + bits.take(3)
                image = decode_scalar(bits, -(-self.width // (1 << size)), -(-self.height // (1 << size)), False)
                self.transforms.append((kind, size, image, self.width))
            elif kind == 2:
                self.transforms.append((2, 0, None, self.width))
            else:
                n = 1 + bits.take(8)
                colours = decode_scalar(bits, n, 1, False)[0]
                for shift in (0, 8, 16, 24):  # each colour is stored as the difference to the one before
                    part = np.cumsum((colours >> _U32(shift)) & _U32(255)) & 255
                    colours = (colours & ~_U32(255 << shift)) | (part.astype(_U32) << _U32(shift))
                pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.transforms.append((3, pack, colours, self.width))
                self.width = -(-self.width // (1 << pack))
        self.cache_bits = bits.take(4) if bits.take(1) else 0
        if self.cache_bits > 11:
            raise ValueError("the colour cache is too large")
        self.meta, self.meta_bits, n = None, 0, 1
        if main and bits.take(1):
            self.meta_bits = 2 + bits.take(3)
            meta = decode_scalar(bits, -(-self.width // (1 << self.meta_bits)), -(-self.height // (1 << self.meta_bits)), False)
            self.meta = (meta >> _U32(8)) & _U32(0xFFFF)
            n = int(self.meta.max()) + 1
        sizes = (SIZES[0] + ((1 << self.cache_bits) if self.cache_bits else 0), *SIZES[1:])
        self.groups = [[_read_code(bits, s) for s in sizes] for _ in range(n)]


def decode_scalar(bits: Bits, width: int, height: int, main: bool = True) -> np.ndarray:
    """Pixels of an entropy-coded image, one at a time, whatever it uses; transforms are undone in the main image."""
    head = Header(bits, width, height, main)
    return undo(head, _pixels(bits, head).reshape(head.height, head.width))


def _pixels(bits: Bits, head: Header) -> np.ndarray:
    width, n = head.width, head.width * head.height
    out, cache = [0] * n, [0] * (1 << head.cache_bits if head.cache_bits else 1)
    shift = 32 - head.cache_bits
    groups = [[(t.tolist(), (1 << w) - 1) for t, w in g] for g in head.groups]
    meta = head.meta.tolist() if head.meta is not None else None

    def symbol(code):
        x = code[0][(bits.value >> bits.at) & code[1]]
        bits.at += x & 15
        return x >> 4

    at = 0
    while at < n:
        group = groups[meta[(at // width) >> head.meta_bits][(at % width) >> head.meta_bits]] if meta else groups[0]
        s = symbol(group[0])
        if s < 256:
            red, blue, alpha = symbol(group[1]), symbol(group[2]), symbol(group[3])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _extra(bits, s - 256)
            back = _distance(_extra(bits, symbol(group[4])), width)
            if back > at:
                raise ValueError("a back-reference starts before the image")
            length = min(length, n - at)
            new = (out[at - back : at] * (-(-length // back)))[:length] if back < length else out[at - back : at - back + length]
        else:
            new = [cache[s - 280]]
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        out[at : at + len(new)] = new
        at += len(new)
        if head.cache_bits:
            for x in new:
                cache[((0x1E35A7BD * x) & 0xFFFFFFFF) >> shift] = x
    return np.array(out, _U32)


def _channels(x: np.ndarray) -> list[np.ndarray]:
    return [((x >> _U32(s)) & _U32(255)).astype(np.int64) for s in (24, 16, 8, 0)]


def _joined(a, r, g, b) -> np.ndarray:
    a, r, g, b = ((x & 255).astype(_U32) for x in (a, r, g, b))
    return (a << _U32(24)) | (r << _U32(16)) | (g << _U32(8)) | b


def _signed8(x):
    return (x ^ 128) - 128


def cross_delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (_signed8(t) * _signed8(c)) >> 5


def undo(head: Header, pixels: np.ndarray) -> np.ndarray:
    """Inverts the transforms, the last first."""
    for kind, size, data, width in reversed(head.transforms):
        if kind == 2:
            a, r, g, b = _channels(pixels)
            pixels = _joined(a, r + g, g, b + g)
        elif kind == 1:
            rows, cols = np.indices(pixels.shape) >> size
            _, r2b, g2b, g2r = _channels(data[rows, cols])
            a, r, g, b = _channels(pixels)
            r = (r + cross_delta(g2r, g)) & 255
            pixels = _joined(a, r, g, b + cross_delta(g2b, g) + cross_delta(r2b, r))
        elif kind == 3:
            index = ((pixels >> _U32(8)) & _U32(255)).astype(np.int64)
            if size:
                per = 8 >> size
                index = ((index[:, :, None] >> (np.arange(1 << size) * per)) & ((1 << per) - 1)).reshape(len(index), -1)[:, :width]
            colours = np.zeros(256, _U32)  # an index behind the palette is transparent black
            colours[: len(data)] = data
            pixels = colours[index]
        else:
            pixels = _unpredicted(pixels, (data >> _U32(8)) & _U32(15), size)
    return pixels


def _predict(mode: int, left, top, corner, right):
    """Prediction of (a, r, g, b) from the neighbours to the left, above, above left and above right."""
    def half(x, y):
        return tuple((p + q) >> 1 for p, q in zip(x, y, strict=True))

    if mode in (0, 14, 15):
        return (255, 0, 0, 0)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode < 10:
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        near = sum(abs(t - c) for t, c in zip(top, corner, strict=True)) < sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if near else top
    if mode == 12:
        return tuple(min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True))
    mean = half(left, top)
    return tuple(min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean, corner, strict=True))


def predictions(done: list[list[tuple]], x: int, y: int, mode: int):
    """The prediction at (x, y): the border has modes of its own."""
    if not y:
        return (255, 0, 0, 0) if not x else done[0][x - 1]
    if not x:
        return done[y - 1][0]
    above = done[y - 1]
    return _predict(mode, done[y][x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < len(above) else done[y][0])


def _unpredicted(pixels: np.ndarray, modes: np.ndarray, size: int) -> np.ndarray:
    parts = np.stack(_channels(pixels), -1).tolist()
    modes, done = modes.tolist(), []
    for y, row in enumerate(parts):
        done.append([])
        for x, rest in enumerate(row):
            p = predictions(done, x, y, modes[y >> size][x >> size])
            done[y].append(tuple((v + q) & 255 for v, q in zip(rest, p, strict=True)))
    return _joined(*np.moveaxis(np.array(done, np.int64).reshape(*pixels.shape, 4), -1, 0))


def parse(data: bytes) -> tuple[Bits, int, int]:
    """(bits behind the size, width, height) of a file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack_from("<I", data, 16)[0]])
    if bits.take(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height = 1 + bits.take(14), 1 + bits.take(14)
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    return bits, width, height


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height x width, uint32) of one file."""
    return decode_scalar(*parse(data))


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """``decode`` of many files, side by side where an image has one group of codes."""
    out: list[np.ndarray | None] = [None] * len(files)
    lanes = []
    for i, data in enumerate(files):
        bits, width, height = parse(data)
        head = Header(bits, width, height, True)
        if head.meta is None:
            lanes.append((i, bits, head))
        else:
            out[i] = undo(head, _pixels(bits, head).reshape(head.height, head.width))
    lanes.sort(key=lambda x: x[2].width * x[2].height)
    for at in range(0, len(lanes), LANES):
        own = lanes[at : at + LANES]
        for (i, _, head), pixels in zip(own, _entropy_lanes(own, files), strict=True):
            pixels = pixels.reshape(head.height, head.width)
            out[i] = undo(head, pixels) if head.transforms else pixels
    return out


def _entropy_lanes(lanes: list[tuple[int, Bits, Header]], files: list[bytes], spell: int = 32) -> list[np.ndarray]:
    """Pixels of images with one group of codes each: a symbol of every image in each step.

    Images that have ended run on for less than ``spell`` steps, into room behind their pixels, before they leave.
    """
    raw = [files[i][20:] for i, _, _ in lanes]
    base = np.cumsum([0, *(len(x) + 8 + spell * 16 for x in raw)])
    data = np.zeros(int(base[-1]) + 8, np.uint8)
    for x, at in zip(raw, base, strict=False):
        data[at : at + len(x)] = np.frombuffer(x, np.uint8)
    words = data[:-3].astype(_U32)
    for k in (1, 2, 3):
        words |= data[k : len(data) - 3 + k].astype(_U32) << _U32(8 * k)
    pos = base[:-1] * 8 + np.array([b.at for _, b, _ in lanes])
    tables, offs, masks, at = [], np.zeros((5, len(lanes)), np.int64), np.zeros((5, len(lanes)), _U32), 0
    for j, (_, _, head) in enumerate(lanes):
        for k, (t, w) in enumerate(head.groups[0]):
            tables.append(t)
            offs[k, j], masks[k, j] = at, (1 << w) - 1
            at += len(t)
    table = np.concatenate(tables)
    total = np.array([h.width * h.height for _, _, h in lanes])
    starts = np.cumsum(np.r_[0, total + spell])
    out = np.zeros(int(starts[-1]) + spell, _U32)
    flat = not masks[1:4].any()  # red, blue and alpha take no bits
    rest = [(table[offs[k]] >> 4).astype(_U32) for k in (1, 2, 3)]
    fixed = (rest[2] << _U32(24)) | (rest[0] << _U32(16)) | rest[1]
    cache_bits = np.array([h.cache_bits for _, _, h in lanes])
    caches = np.zeros((len(lanes), 1 << int(cache_bits.max())), _U32) if cache_bits.any() else None
    width = np.array([h.width for _, _, h in lanes])
    live = np.arange(len(lanes))
    here, end = starts[:-1].copy(), starts[:-1] + total
    off, mask = offs[0].copy(), masks[0].copy()
    step = 0

    def put(lane: int, pixels: np.ndarray) -> None:
        if caches is not None and cache_bits[lane]:
            for x in pixels.tolist():
                caches[lane, ((0x1E35A7BD * x) & 0xFFFFFFFF) >> (32 - int(cache_bits[lane]))] = x

    while len(live):
        code = table[off + ((words[pos >> 3] >> (pos & 7).astype(_U32)) & mask)]
        pos += code & 15
        symbol = code >> 4
        odd = np.flatnonzero(symbol > 255) if symbol.max() > 255 else ()
        if flat:
            pixel = fixed[live] | (symbol.astype(_U32) << _U32(8))
        else:
            pixel, more = symbol.astype(_U32) << _U32(8), symbol < 256
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                code = table[offs[k, live] + ((words[pos >> 3] >> (pos & 7).astype(_U32)) & masks[k, live])]
                pos += np.where(more, code & 15, 0)
                pixel |= (code >> 4).astype(_U32) << _U32(shift)
        out[here] = pixel
        if caches is not None:
            plain = np.flatnonzero((symbol < 256) & (cache_bits[live] > 0))
            key = (pixel[plain].astype(_U64) * _U64(0x1E35A7BD) & _U64(0xFFFFFFFF)) >> (32 - cache_bits[live[plain]]).astype(_U64)
            caches[live[plain], key.astype(np.int64)] = pixel[plain]
        here += 1
        for j in odd:
            lane, at = int(live[j]), int(here[j]) - 1
            if at >= end[j]:
                continue
            here[j] = at
            if symbol[j] >= 280:
                new = caches[lane, int(symbol[j]) - 280 : int(symbol[j]) - 279].copy()
            else:
                bits = Bits(data[int(pos[j]) >> 3 : (int(pos[j]) >> 3) + 24].tobytes())
                bits.at = int(pos[j]) & 7
                length = _extra(bits, int(symbol[j]) - 256)
                x = int(table[offs[4, lane] + ((bits.value >> bits.at) & int(masks[4, lane]))])
                bits.at += x & 15
                back = _distance(_extra(bits, x >> 4), int(width[lane]))
                pos[j] += bits.at - (int(pos[j]) & 7)
                if back > at - starts[lane]:
                    raise ValueError("a back-reference starts before the image")
                length = min(length, int(end[j]) - at)
                new = np.resize(out[at - back : at], length) if back < length else out[at - back : at - back + length].copy()
            out[at : at + len(new)] = new
            put(lane, new)
            here[j] = at + len(new)
        step += 1
        if step % spell == 0 or len(odd):
            over = here >= end
            if over.any() and (step % spell == 0):
                if (pos[over] > (base[1:][live[over]] * 8)).any():
                    raise ValueError("the stream ends early")
                keep = ~over
                live, pos, here, end, off, mask = live[keep], pos[keep], here[keep], end[keep], off[keep], mask[keep]
    return [out[s : s + n] for s, n in zip(starts[:-1], total, strict=True)]


# -- encoder ----------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code of at most ``most`` bits; a single symbol has length 1, which ``_code`` stores as none."""
    held = np.flatnonzero(counts)
    lens = np.zeros(len(counts), np.int64)
    if len(held) <= 1:
        lens[held] = 1
        return lens
    floor = 1
    while True:
        heap = [(max(int(counts[i]), floor), k) for k, i in enumerate(held)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(held) - 1), len(held)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = n
            heapq.heappush(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(held)]) <= most:
            lens[held] = depth[: len(held)]
            return lens
        floor = max(2 * floor, int(counts[held].sum()) >> most)


def codes_of(lens: np.ndarray) -> np.ndarray:
    """Canonical codes, their bits in the order of the stream."""
    held = np.flatnonzero(lens)
    out = np.zeros(len(lens), np.int64)
    order = held[np.argsort(lens[held], kind="stable")]
    own = lens[order]
    top = int(own[-1]) if len(own) else 0
    starts = np.cumsum(1 << (top - own)) - (1 << (top - own))
    out[order] = _reversed(top)[starts]
    return out


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, x: int, n: int) -> None:
        self.value |= int(x) << self.at
        self.at += n


def _code(out: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a code for the counts; returns (codes, lengths) with length 0 where a symbol takes no bits."""
    held = np.flatnonzero(counts)
    if len(held) <= 2 and (not len(held) or held[-1] < 256):
        first = int(held[0]) if len(held) else 0
        out.put(1, 1), out.put(max(0, len(held) - 1), 1)
        wide = first > 1
        out.put(wide, 1), out.put(first, 8 if wide else 1)
        lens = np.zeros(len(counts), np.int64)
        if len(held) == 2:
            out.put(int(held[1]), 8)
            lens[held] = 1
        return codes_of(lens), lens
    lens = code_lengths(counts, 13)
    if len(held) == 1:  # one large symbol: a second one completes the code
        lens[0] = 1
    out.put(0, 1)
    tokens, at, own = [], 0, lens[: int(np.flatnonzero(lens)[-1]) + 1].tolist()
    while at < len(own):
        run = 1
        if not own[at]:
            while at + run < len(own) and not own[at + run] and run < 138:
                run += 1
        if run >= 11:
            tokens.append((18, run - 11, 7))
        elif run >= 3:
            tokens.append((17, run - 3, 3))
        else:
            tokens.extend((own[at], 0, 0) for _ in range(run))
        at += run
    some = code_lengths(np.bincount([t for t, _, _ in tokens], minlength=19), 7)
    if np.count_nonzero(some) == 1:
        some[0 if not some[0] else 1] = 1
    n = max(i for i, k in enumerate(CODE_ORDER) if some[k]) + 1
    out.put(max(n, 4) - 4, 4)
    for k in CODE_ORDER[: max(n, 4)]:
        out.put(int(some[k]), 3)
    size = 2 * max(1, (max(len(tokens) - 2, 1).bit_length() + 1) // 2)
    out.put(1, 1), out.put((size - 2) // 2, 3), out.put(len(tokens) - 2, size)
    names = codes_of(some)
    for t, x, w in tokens:
        out.put(int(names[t]), int(some[t])), out.put(x, w)
    return codes_of(lens), lens


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 2
    return 2 * n + 2 + ((value - 1) >> n & 1), (value - 1) & ((1 << n) - 1), n


def _runs(pixels: np.ndarray, least: int = 16, most: int = 4096) -> list[tuple[int, int]]:
    """(start, length) of runs of equal pixels behind the first one of each."""
    edge = np.flatnonzero(np.r_[True, pixels[1:] != pixels[:-1]])
    lens = np.diff(np.r_[edge, len(pixels)]) - 1
    out = []
    for i in np.flatnonzero(lens >= least):
        at, n = int(edge[i]) + 1, int(lens[i])
        while n:
            part = min(n, most)
            out.append((at, part))
            at, n = at + part, n - part
    return out


def _entropy(out: Writer, pixels: np.ndarray, cache_bits: int, main: bool) -> bytes:
    """An entropy-coded image with runs as back-references of distance 1; returns the whole stream's bytes if main."""
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    pixels = np.ascontiguousarray(pixels.ravel())
    runs = _runs(pixels)
    keep = np.ones(len(pixels), bool)
    for at, n in runs:
        keep[at + 1 : at + n] = False
    green = ((pixels >> _U32(8)) & _U32(255)).astype(np.int64)
    extra, wide = np.zeros(len(pixels), np.int64), np.zeros(len(pixels), np.int64)
    for at, n in runs:
        symbol, extra[at], wide[at] = _prefix(n)
        green[at] = 256 + symbol
    if cache_bits:
        cache: dict[int, int] = {}
        for at, x in enumerate(pixels.tolist()):
            key = ((0x1E35A7BD * x) & 0xFFFFFFFF) >> (32 - cache_bits)
            if cache.get(key) == x and green[at] < 256:
                green[at] = 280 + key
            cache[key] = x
    green, extra, wide, plain = green[keep], extra[keep], wide[keep], pixels[keep]
    literal, copy = green < 256, (green >= 256) & (green < 280)
    parts = [green, *(((plain >> _U32(s)) & _U32(255)).astype(np.int64) for s in (16, 0, 24))]
    sizes = (SIZES[0] + ((1 << cache_bits) if cache_bits else 0), *SIZES[1:])
    tables = [_code(out, np.bincount(p if k == 0 else p[literal], minlength=s)) for k, (p, s) in enumerate(zip(parts, sizes, strict=False))]
    back = 1 + next(i for i, p in enumerate(PLANE) if p == (1, 0))  # the pixel to the left
    symbol, far, n_far = _prefix(back)
    last = _code(out, np.bincount([symbol] if len(runs) else [], minlength=40).astype(np.int64))
    fields = [(tables[0][0][green], tables[0][1][green])]
    for k in (1, 2, 3):
        if tables[k][1].any():
            fields.append((np.where(literal, tables[k][0][parts[k]], 0), np.where(literal, tables[k][1][parts[k]], 0)))
    if len(runs):
        fields.append((extra, wide))
        fields.append((np.where(copy, last[0][symbol] | far << int(last[1][symbol]), 0), np.where(copy, int(last[1][symbol]) + n_far, 0)))
    values, widths = (np.stack(x, 1).ravel() for x in zip(*fields, strict=True))
    if not main:
        for v, w in zip(values.tolist(), widths.tolist(), strict=True):
            out.put(v, w)
        return b""
    ends = np.cumsum(widths) + out.at
    bits = ends - widths
    packed = np.zeros((int(ends[-1]) >> 6) + 2, _U64)
    shift = (bits & 63).astype(_U64)
    values = values.astype(_U64)
    word = bits >> 6
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    packed[word[first]] = np.add.reduceat(values << shift, first)
    over = np.flatnonzero((bits & 63) + widths > 64)
    packed[word[over] + 1] += values[over] >> (_U64(64) - shift[over])
    whole = bytearray(packed.tobytes()[: -(-int(ends[-1]) // 8)])
    head = out.value.to_bytes(-(-out.at // 8), "little")
    for i, x in enumerate(head):
        whole[i] |= x
    return bytes(whole)


def encode(pixels: np.ndarray, palette: bool = False, green: bool = False, cross: tuple[int, int, int] | None = None, predictor: np.ndarray | None = None, cache_bits: int = 0, size: int = 2) -> bytes:
    """A file of ARGB pixels. ``predictor``: modes of its blocks; ``cross``: (green to red, green to blue, red to blue)."""
    height, width = pixels.shape
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("the image's sides must lie between 1 and 16384")
    out = Writer()
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14)
    out.put(1, 1), out.put(0, 3)
    if palette:
        colours, index = np.unique(pixels, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("too many colours for a palette")
        out.put(1, 1), out.put(3, 2), out.put(len(colours) - 1, 8)
        parts = [np.diff(c, prepend=0) for c in _channels(colours)]
        _entropy(out, _joined(*parts), 0, False)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index = index.reshape(height, width)
        per = 1 << pack
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        index = (index << (np.arange(per) * (8 >> pack))).sum(axis=2)
        pixels = _U32(0xFF000000) | (index.astype(_U32) << _U32(8))
    if predictor is not None:
        out.put(1, 1), out.put(0, 2), out.put(size - 2, 3)
        _entropy(out, predictor.astype(_U32) << _U32(8), 0, False)
        rows = [[tuple(p) for p in row] for row in np.stack(_channels(pixels), -1).tolist()]
        modes = predictor.tolist()
        diff = [[tuple(v - q for v, q in zip(p, predictions(rows[: y] + [row[:x]], x, y, modes[y >> size][x >> size]), strict=True)) for x, p in enumerate(row)] for y, row in enumerate(rows)]
        pixels = _joined(*np.moveaxis(np.array(diff, np.int64).reshape(*pixels.shape, 4), -1, 0))
    if cross is not None:
        out.put(1, 1), out.put(1, 2), out.put(size - 2, 3)
        g2r, g2b, r2b = (np.int64(x & 255) for x in cross)
        shape = (-(-pixels.shape[0] // (1 << size)), -(-pixels.shape[1] // (1 << size)))
        _entropy(out, np.full(shape, 0xFF000000 | int(r2b) << 16 | int(g2b) << 8 | int(g2r), _U32), 0, False)
        a, r, g, b = _channels(pixels)
        pixels = _joined(a, r - cross_delta(g2r, g), g, b - cross_delta(g2b, g) - cross_delta(r2b, r))
    if green:
        out.put(1, 1), out.put(2, 2)
        a, r, g, b = _channels(pixels)
        pixels = _joined(a, r - g, g, b - g)
    out.put(0, 1)
    stream = _entropy(out, pixels, cache_bits, True)
    stream += b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream


# -- texts as media ---------------------------------------------------------------------------------------------------


def pad(raw: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of a row."""
    return raw + b" " * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def encode_samples(payload: bytes) -> bytes:
    """8-bit samples in rows of ``WIDTH``, as one file for each ``ROWS`` rows, one behind the other.

    A sample is the green of an opaque pixel; images of at most 16 sample values use a palette with packed indexes.
    """
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = []
    for at in range(0, len(samples), ROWS):
        part = samples[at : at + ROWS]
        few = np.count_nonzero(np.bincount(part.ravel(), minlength=256)) <= 16
        out.append(encode(_U32(0xFF000000) | (part.astype(_U32) << _U32(8)), palette=few))
    return b"".join(out)


def split_files(media: bytes) -> list[bytes]:
    """The files that stand one behind the other."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out


def decode_samples(medias: list[bytes]) -> list[bytes]:
    """The payloads of ``encode_samples``, all files decoded side by side."""
    files = [split_files(m) for m in medias]
    pixels = iter(decode_many([f for fs in files for f in fs]))
    return [b"".join(((next(pixels) >> _U32(8)) & _U32(255)).astype(np.uint8).tobytes() for _ in fs) for fs in files]

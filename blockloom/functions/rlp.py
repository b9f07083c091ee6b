"""Recursive length prefix encoding and Merkle Patricia roots over ordered lists."""

from __future__ import annotations

from .keccak import keccak256

EMPTY_ROOT = keccak256(b"\x80")


def length_prefix(n: int, base: int) -> bytes:
    if n < 56:
        return bytes([base + n])
    size = n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([base + 55 + len(size)]) + size


def encode(item) -> bytes:
    """Bytes, non-negative integers, and lists of these."""
    if isinstance(item, int):
        item = item.to_bytes((item.bit_length() + 7) // 8)
    if isinstance(item, (bytes, bytearray)):
        return bytes(item) if len(item) == 1 and item[0] < 0x80 else length_prefix(len(item), 0x80) + bytes(item)
    body = b"".join(map(encode, item))
    return length_prefix(len(body), 0xC0) + body


class Raw(bytes):
    """Already encoded: stands in a list as it is."""


def _encode_node(parts: list) -> bytes:
    body = b"".join(p if isinstance(p, Raw) else encode(p) for p in parts)
    return length_prefix(len(body), 0xC0) + body


def _packed(nibbles: tuple[int, ...], leaf: bool) -> bytes:
    flag = 2 * leaf
    path = (flag + 1, *nibbles) if len(nibbles) % 2 else (flag, 0, *nibbles)
    return bytes(16 * a + b for a, b in zip(path[::2], path[1::2], strict=True))


def _reference(node: bytes) -> Raw:
    return Raw(node) if len(node) < 32 else Raw(encode(keccak256(node)))


def _node(items: list[tuple[tuple[int, ...], bytes]], depth: int) -> bytes:
    """The encoded node over sorted (path, value) pairs, which share what comes before ``depth``."""
    if len(items) == 1:
        return _encode_node([_packed(items[0][0][depth:], True), items[0][1]])
    first, last = items[0][0], items[-1][0]
    same = depth
    while same < min(len(first), len(last)) and first[same] == last[same]:
        same += 1
    if same > depth:
        return _encode_node([_packed(first[depth:same], False), _reference(_node(items, same))])
    slots: list = []
    for nibble in range(16):
        below = [x for x in items if len(x[0]) > depth and x[0][depth] == nibble]
        slots.append(_reference(_node(below, depth + 1)) if below else b"")
    return _encode_node([*slots, next((v for p, v in items if len(p) == depth), b"")])


def ordered_root(values: list[bytes]) -> bytes:
    """Root of the trie from each value's RLP-coded position to the value."""
    if not values:
        return EMPTY_ROOT
    paths = (tuple(n for b in encode(i) for n in (b >> 4, b & 15)) for i in range(len(values)))
    return keccak256(_node(sorted(zip(paths, values, strict=True)), 0))

"""Keccak-256, vectorised over messages: one permutation serves all messages of a batch that have a block left."""

from __future__ import annotations

import numpy as np

_U = np.uint64
RATE, _MASK = 136, 2**64 - 1


def _constants() -> tuple[list[int], list[list[int]]]:
    """Round constants from the published shift register, rotation offsets from the published walk."""
    rounds, state = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if state & 1:
                c |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        rounds.append(c)
    turns = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        turns[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turns


_ROUNDS, _TURNS = _constants()


def _rotated(a: np.ndarray, n: int) -> np.ndarray:
    return a if not n else (a << _U(n)) | (a >> _U(64 - n))


def _permute(s: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    for c in _ROUNDS:
        p = [s[x][0] ^ s[x][1] ^ s[x][2] ^ s[x][3] ^ s[x][4] for x in range(5)]
        d = [p[x - 1] ^ _rotated(p[(x + 1) % 5], 1) for x in range(5)]
        b = [[None] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _rotated(s[x][y] ^ d[x], _TURNS[x][y])
        s = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        s[0][0] = s[0][0] ^ _U(c)
    return s


def keccak256_many(messages: list[bytes]) -> list[bytes]:
    """The hash of each message."""
    if not messages:
        return []
    blocks = np.array([len(m) // RATE + 1 for m in messages])
    order = np.argsort(-blocks, kind="stable")
    n, most = len(messages), int(blocks.max())
    data = np.zeros((n, most * RATE), np.uint8)
    for row, i in enumerate(order):
        m = messages[i]
        data[row, : len(m)] = np.frombuffer(m, np.uint8)
        data[row, len(m)] ^= 0x01
        data[row, blocks[i] * RATE - 1] ^= 0x80
    words = data.view("<u8").reshape(n, most, RATE // 8).astype(_U)
    lanes = [[np.zeros(n, _U) for _ in range(5)] for _ in range(5)]
    left = blocks[order]
    for k in range(most):
        live = int((left > k).sum())  # sorted: those with a block left come first
        part = [[lanes[x][y][:live].copy() for y in range(5)] for x in range(5)]
        for j in range(RATE // 8):
            part[j % 5][j // 5] ^= words[:live, k, j]
        part = _permute(part)
        for x in range(5):
            for y in range(5):
                lanes[x][y][:live] = part[x][y]
    digest = np.stack([lanes[x][0] for x in range(4)], 1).astype("<u8")
    out = [b""] * n
    for row, i in enumerate(order):
        out[i] = digest[row].tobytes()
    return out


def keccak256(message: bytes) -> bytes:
    """The hash of one message, in plain integers: for one, array calls cost more than they save."""
    size = len(message) // RATE + 1
    data = bytearray(size * RATE)
    data[: len(message)] = message
    data[len(message)] ^= 0x01
    data[-1] ^= 0x80
    s = [[0] * 5 for _ in range(5)]
    for at in range(0, len(data), RATE):
        for j in range(RATE // 8):
            s[j % 5][j // 5] ^= int.from_bytes(data[at + 8 * j : at + 8 * j + 8], "little")
        for c in _ROUNDS:
            p = [x[0] ^ x[1] ^ x[2] ^ x[3] ^ x[4] for x in s]
            d = [p[x - 1] ^ _turned(p[(x + 1) % 5], 1) for x in range(5)]
            b = [[0] * 5 for _ in range(5)]
            for x in range(5):
                for y in range(5):
                    b[y][(2 * x + 3 * y) % 5] = _turned(s[x][y] ^ d[x], _TURNS[x][y])
            s = [[b[x][y] ^ (~b[(x + 1) % 5][y] & _MASK & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            s[0][0] ^= c
    return b"".join(s[x][0].to_bytes(8, "little") for x in range(4))


def _turned(a: int, n: int) -> int:
    return (a << n | a >> (64 - n)) & _MASK

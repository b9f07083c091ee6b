"""Public key recovery on secp256k1 in plain integers (slow; opt in)."""

from __future__ import annotations

from .keccak import keccak256

#: The curve's published parameters.
P = 2**256 - 2**32 - 977
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
G = (0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8)


def _double(p):
    x, y, z = p
    if not y:
        return (0, 1, 0)
    s, m = 4 * x * y * y % P, 3 * x * x % P
    nx = (m * m - 2 * s) % P
    return nx, (m * (s - nx) - 8 * pow(y, 4, P)) % P, 2 * y * z % P


def _add(p, q):
    if not p[2]:
        return q
    if not q[2]:
        return p
    z1, z2 = p[2] * p[2] % P, q[2] * q[2] % P
    u1, u2 = p[0] * z2 % P, q[0] * z1 % P
    s1, s2 = p[1] * z2 * q[2] % P, q[1] * z1 * p[2] % P
    if u1 == u2:
        return _double(p) if s1 == s2 else (0, 1, 0)
    h, r = (u2 - u1) % P, (s2 - s1) % P
    h2 = h * h % P
    h3, v = h * h2 % P, u1 * h2 % P
    x = (r * r - h3 - 2 * v) % P
    return x, (r * (v - x) - s1 * h3) % P, h * p[2] * q[2] % P


def multiply_sum(a: int, p: tuple[int, int], b: int, q: tuple[int, int]) -> tuple[int, int] | None:
    """a*p + b*q in affine coordinates, None for the point at infinity; both scalars are walked at once."""
    pp, qq = (*p, 1), (*q, 1)
    both, out = _add(pp, qq), (0, 1, 0)
    for i in range(255, -1, -1):
        out = _double(out)
        bits = (a >> i & 1) + 2 * (b >> i & 1)
        if bits:
            out = _add(out, (None, pp, qq, both)[bits])
    if not out[2]:
        return None
    inv = pow(out[2], -1, P)
    return out[0] * inv * inv % P, out[1] * pow(inv, 3, P) % P


def recover(digest: bytes, r: int, s: int, odd: int) -> bytes | None:
    """The 64-byte public key that signed a digest, None for a signature that none can have made."""
    if not (0 < r < N and 0 < s < N):
        return None
    y2 = (pow(r, 3, P) + 7) % P
    y = pow(y2, (P + 1) // 4, P)
    if y * y % P != y2:
        return None
    if y & 1 != odd & 1:
        y = P - y
    inv = pow(r, -1, N)
    z = int.from_bytes(digest) % N
    key = multiply_sum(-z * inv % N, G, s * inv % N, (r, y))
    return key[0].to_bytes(32) + key[1].to_bytes(32) if key else None


def address(public_key: bytes) -> str:
    return "0x" + keccak256(public_key)[12:].hex()


def sign(digest: bytes, secret: int, nonce: int) -> tuple[int, int, int]:
    """(r, s, odd) for tests: a signature with a given nonce."""
    x, y = multiply_sum(nonce, G, 0, G)
    r, odd = x % N, y & 1
    s = pow(nonce, -1, N) * (int.from_bytes(digest) + r * secret) % N
    return (r, N - s, odd ^ 1) if s > N // 2 else (r, s, odd)

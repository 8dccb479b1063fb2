"""Signed statements of publications: their text, key names, and Ed25519 signatures (RFC 8032).

The arithmetic is plain Python, as the standard describes it: a statement is signed once a publication,
so speed doesn't matter. `verify` never raises for bad input.
"""

from __future__ import annotations

import base64
import hashlib

KEY_PREFIX = "ed25519:"
#: Fixed values of RFC 8032: the field's prime, the group's order, the curve's constant, the base point's y.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]  # x = X / Z, y = Y / Z, x * y = T / Z


def statement(header: str, set_name: str, publication: int, revision: int, content: bytes) -> str:
    """The five lines that are signed."""
    return f"{header}\nset: {set_name}\npublication: {publication}\nrevision: {revision}\nsha256: {hashlib.sha256(content).hexdigest()}\n"


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    out: Point = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def _same(p: Point, q: Point) -> bool:
    return (p[0] * q[2] - q[0] * p[2]) % P == 0 and (p[1] * q[2] - q[1] * p[2]) % P == 0


def _decoded(raw: bytes) -> Point | None:
    y, odd = int.from_bytes(raw, "little") & ((1 << 255) - 1), raw[31] >> 7
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    x = P - x if x & 1 != odd else x
    return x, y, 1, x * y % P


def _encoded(p: Point) -> bytes:
    z = pow(p[2], -1, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


BASE = _decoded((4 * pow(5, -1, P) % P).to_bytes(32, "little"))


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return (int.from_bytes(h[:32], "little") & ((1 << 254) - 8)) | 1 << 254, h[32:]


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def public_key(seed: bytes) -> bytes:
    return _encoded(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, text: bytes) -> bytes:
    a, prefix = _secret(seed)
    r = _number(prefix, text)
    point = _encoded(_times(r, BASE))
    return point + ((r + _number(point, public_key(seed), text) * a) % ORDER).to_bytes(32, "little")


def verify(key: bytes, text: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _decoded(key), _decoded(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    return _same(_times(s, BASE), _add(r, _times(_number(signature[:32], key, text), a)))


def parse_key(text: str) -> bytes:
    """The 32 bytes of "ed25519:<base64>"; ValueError for anything else."""
    text = text.strip()
    if not text.startswith(KEY_PREFIX):
        raise ValueError(f"a public key starts with {KEY_PREFIX}")
    raw = base64.b64decode(text.removeprefix(KEY_PREFIX), validate=True)
    if len(raw) != 32:
        raise ValueError(f"a public key has 32 bytes, not {len(raw)}")
    return raw


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:16]

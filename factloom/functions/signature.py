"""ECDSA signatures over P-256 with SHA-256, as the log's writers make them (hex of DER over the transaction id)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The curve of FIPS 186-4.
P = 0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF
N = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
A = -3
B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B
G = (0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5)
_SPKI = bytes.fromhex("3059301306072a8648ce3d020106082a8648ce3d030107034200")


# Points are (x, y, z) for x / z^2, y / z^3, so that a multiplication inverts once, at its end; z is 0 at infinity.


def _double(p):
    x, y, z = p
    if not z or not y:
        return 1, 1, 0
    yy, zz = y * y % P, z * z % P
    s = 4 * x * yy % P
    m = 3 * (x - zz) * (x + zz) % P  # as A is -3
    nx = (m * m - 2 * s) % P
    return nx, (m * (s - nx) - 8 * yy * yy) % P, 2 * y * z % P


def _add(p, q):
    if not p[2] or not q[2]:
        return q if not p[2] else p
    (x1, y1, z1), (x2, y2, z2) = p, q
    a, b = z1 * z1 % P, z2 * z2 % P
    u, v = x1 * b % P, x2 * a % P
    s, t = y1 * b * z2 % P, y2 * a * z1 % P
    if u == v:
        return _double(p) if s == t else (1, 1, 0)
    h, r = v - u, t - s
    hh = h * h % P
    hhh, w = h * hh % P, u * hh % P
    x = (r * r - hhh - 2 * w) % P
    return x, (r * (w - x) - s * hhh) % P, h * z1 * z2 % P


def _sum(k, p, n=0, q=None):
    """k * p + n * q as (x, y), or None at infinity: both multiples in one run of doublings."""
    p = (*p, 1)
    steps = {1: p}
    if q is not None:
        steps |= {2: (*q, 1), 3: _add(p, (*q, 1))}
    out = (1, 1, 0)
    for i in range(max(k.bit_length(), n.bit_length()) - 1, -1, -1):
        out = _double(out)
        if step := (k >> i & 1) | (n >> i & 1) << 1:
            out = _add(out, steps[step])
    if not out[2]:
        return None
    inv = pow(out[2], -1, P)
    return out[0] * inv * inv % P, out[1] * inv * inv * inv % P


def _point(pub: str):
    raw = bytes.fromhex(pub)
    raw = raw[len(_SPKI):] if raw.startswith(_SPKI) else raw
    if len(raw) != 65 or raw[0] != 4:
        raise ValueError("not an uncompressed point")
    x, y = int.from_bytes(raw[1:33], "big"), int.from_bytes(raw[33:], "big")
    if (y * y - x * x * x - A * x - B) % P:
        raise ValueError("not on the curve")
    return x, y


def _der(sig: str) -> tuple[int, int]:
    raw, out, at = bytes.fromhex(sig), [], 2
    if raw[0] != 0x30 or raw[1] != len(raw) - 2:
        raise ValueError("not DER")
    for _ in range(2):
        if raw[at] != 2:
            raise ValueError("not DER")
        n = raw[at + 1]
        out.append(int.from_bytes(raw[at + 2 : at + 2 + n], "big"))
        at += 2 + n
    return out[0], out[1]


def verify(pub: str, sig: str, message: str) -> bool:
    """Whether ``sig`` is a signature over the message by the key; False on anything malformed."""
    try:
        q, (r, s) = _point(pub), _der(sig)
        if not (0 < r < N and 0 < s < N):
            return False
        z, w = int.from_bytes(hashlib.sha256(message.encode()).digest(), "big"), pow(s, -1, N)
        x = _sum(z * w % N, G, r * w % N, q)
        return x is not None and x[0] % N == r
    except (ValueError, IndexError, TypeError, AttributeError):
        return False


def sign(secret: int, message: str) -> tuple[str, str]:
    """(public key, signature) with a nonce derived from secret and message; for writing test logs."""
    z = int.from_bytes(hashlib.sha256(message.encode()).digest(), "big")
    k = int.from_bytes(hashlib.sha256(f"{secret}:{message}".encode()).digest(), "big") % (N - 1) + 1
    r = _sum(k, G)[0] % N
    s = pow(k, -1, N) * (z + r * secret) % N
    parts = b"".join(b"\x02" + bytes([len(b)]) + b for b in ((b"\0" + i if i[0] & 0x80 else i) for i in (x.to_bytes((x.bit_length() + 7) // 8, "big") for x in (r, s))))
    x, y = _sum(secret, G)
    return "04" + x.to_bytes(32, "big").hex() + y.to_bytes(32, "big").hex(), (b"\x30" + bytes([len(parts)]) + parts).hex()


def _verified(pub: pd.Series, sig: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([verify(*x) for x in zip(pub, sig, message)], dtype=bool)


def verified(pub: Column | str, sig: Column | str, message: Column | str) -> Column:
    """``verify`` over Arrow batches; there is no built-in expression for it."""
    return F.pandas_udf(_verified, "boolean")(pub, sig, message)

"""BIP-340 Schnorr signatures over secp256k1, in plain Python, batched by Arrow. Verification is opt-in."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Fixed values of the curve.
P = 2**256 - 2**32 - 977
N = 0xFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFEBAAEDCE6AF48A03BBFD25E8CD0364141
G = (
    0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798,
    0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8,
)
# Points are Jacobian (X, Y, Z); None is infinity.


def _double(a):
    if a is None or a[1] == 0:
        return None
    x, y, z = a
    s = 4 * x * y * y % P
    m = 3 * x * x % P
    x3 = (m * m - 2 * s) % P
    return x3, (m * (s - x3) - 8 * y**4) % P, 2 * y * z % P


def _add(a, b):
    if a is None or b is None:
        return a or b
    z1, z2 = a[2] * a[2] % P, b[2] * b[2] % P
    u1, u2 = a[0] * z2 % P, b[0] * z1 % P
    s1, s2 = a[1] * z2 * b[2] % P, b[1] * z1 * a[2] % P
    if u1 == u2:
        return _double(a) if s1 == s2 else None
    h, r = u2 - u1, s2 - s1
    h2 = h * h % P
    h3, v = h * h2 % P, u1 * h2 % P
    x = (r * r - h3 - 2 * v) % P
    return x, (r * (v - x) - s1 * h3) % P, h * a[2] * b[2] % P


def _two_products(k1: int, p1, k2: int, p2):
    """k1 * p1 + k2 * p2, both scalars bit by bit together."""
    both, out = _add(p1, p2), None
    for i in range(max(k1.bit_length(), k2.bit_length()) - 1, -1, -1):
        out = _double(out)
        pick = (k1 >> i & 1) + 2 * (k2 >> i & 1)
        if pick:
            out = _add(out, (None, p1, p2, both)[pick])
    return out


def lift(x: int):
    """The point of that x whose y is even."""
    if x >= P:
        return None
    c = (pow(x, 3, P) + 7) % P
    y = pow(c, (P + 1) // 4, P)
    if y * y % P != c:
        return None
    return x, y if y % 2 == 0 else P - y, 1


def _challenge(*parts: bytes) -> int:
    tag = hashlib.sha256(b"BIP0340/challenge").digest()
    return int.from_bytes(hashlib.sha256(tag + tag + b"".join(parts)).digest(), "big") % N


def verify(pubkey: bytes, message: bytes, signature: bytes) -> bool:
    r, s = int.from_bytes(signature[:32], "big"), int.from_bytes(signature[32:], "big")
    point = lift(int.from_bytes(pubkey, "big"))
    if point is None or r >= P or s >= N or len(signature) != 64:
        return False
    e = _challenge(signature[:32], pubkey, message)
    found = _two_products(s, (*G, 1), N - e, point)
    if found is None:
        return False
    inverse = pow(found[2], -1, P)
    y = found[1] * inverse**3 % P
    return y % 2 == 0 and found[0] * inverse * inverse % P == r


def sign(secret: int, message: bytes, nonce: int = 12345) -> tuple[bytes, bytes]:
    """(public key, signature) for tests; the nonce is not random, so never use it for real keys."""

    def affine(k):
        x, y, z = _two_products(k, (*G, 1), 0, (*G, 1))
        inverse = pow(z, -1, P)
        return x * inverse * inverse % P, y * inverse**3 % P

    x, y = affine(secret)
    d = secret if y % 2 == 0 else N - secret
    rx, ry = affine(nonce)
    k = nonce if ry % 2 == 0 else N - nonce
    public, r = x.to_bytes(32, "big"), rx.to_bytes(32, "big")
    return public, r + ((k + _challenge(r, public, message) * d) % N).to_bytes(32, "big")


@F.pandas_udf(BooleanType())
def verify_signature(pubkey: pd.Series, id_: pd.Series, sig: pd.Series) -> pd.Series:
    """Whether sig (128 hex digits) signs id (64) for pubkey (64); false for anything malformed or null."""

    def one(p, m, s):
        try:
            return verify(bytes.fromhex(p), bytes.fromhex(m), bytes.fromhex(s))
        except (TypeError, ValueError):
            return False

    return pd.Series([one(*row) for row in zip(pubkey, id_, sig, strict=True)], dtype="boolean")

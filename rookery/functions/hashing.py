"""Event ids: SHA-256 of a compact JSON array."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Control characters whose escapes to_json writes with capital digits.
_CAPITAL = "0B 0E 0F 1A 1B 1C 1D 1E 1F".split()


def canonical(pubkey: str, created_at: int, kind: int, tags, content: str) -> str:
    """[0,pubkey,created_at,kind,tags,content] without spaces; only quotes, backslashes and control characters are escaped."""
    return json.dumps([0, pubkey, created_at, kind, tags, content], ensure_ascii=False, separators=(",", ":"))


def canonical_json(pubkey, created_at, kind, wire_tags, content) -> Column:
    """`canonical` in columns, without Python; null where a field is null."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    text = lambda c: F.substring(one := F.to_json(F.array(col(c))), F.lit(2), F.char_length(one) - 2)
    known = col(pubkey).isNotNull() & col(content).isNotNull()
    number = lambda c: col(c).cast("bigint").cast("string")
    whole = F.concat(F.lit("[0,"), text(pubkey), F.lit(","), number(created_at), F.lit(","), number(kind), F.lit(","), F.to_json(col(wire_tags)), F.lit(","), text(content), F.lit("]"))
    small = whole
    for digits in _CAPITAL:  # an escape, not a backslash's own escape before a u
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*)\\u00{digits}", rf"$1\\u00{digits.lower()}")
    return F.when(known, F.when(whole.rlike(r"\\u00[01][A-F]"), small).otherwise(whole))


def event_id(pubkey, created_at, kind, wire_tags, content) -> Column:
    """The id that an event of these fields must have. wire_tags: arrays of strings, empty ones included."""
    return F.sha2(canonical_json(pubkey, created_at, kind, wire_tags, content), 256)


def fold128(hex64: str) -> str:
    """The two halves of 32 bytes XORed. Not used in plans: exact equality needs no folding."""
    raw = bytes.fromhex(hex64)
    return bytes(a ^ b for a, b in zip(raw[:16], raw[16:], strict=True)).hex()

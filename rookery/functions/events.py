"""Column functions over events: tags, kind classes, replacement keys, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ADDRESSABLE, EPHEMERAL, REPLACEABLE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_hex(c, chars: int = 64) -> Column:
    """Exactly `chars` hex digits of either case."""
    return _col(c).rlike(f"^[0-9a-fA-F]{{{chars}}}$")


def is_single_letter(c) -> Column:
    return F.char_length(_col(c)) == 1


def tag_value(tag: Column) -> Column:
    """A tag's first value; null if it has none."""
    return F.get(tag["values"], 0)


def event_tags(wire) -> Column:
    """Tags from their wire form, arrays of strings; empty arrays are dropped."""
    kept = F.filter(_col(wire), lambda t: F.size(t) > 0)
    return F.transform(kept, lambda t: F.struct(F.get(t, 0).alias("name"), F.slice(t, 2, F.size(t)).alias("values")))


def hex_tag_values(tags, name: str) -> Column:
    """First values of the tags of that name that are 64 hex digits, lower-cased."""
    known = F.filter(_col(tags), lambda t: (t["name"] == name) & F.coalesce(is_hex(tag_value(t)), F.lit(False)))
    return F.transform(known, lambda t: F.lower(tag_value(t)))


def _between(kind, bounds: tuple[int, int]) -> Column:
    return (_col(kind) >= bounds[0]) & (_col(kind) < bounds[1])


def is_ephemeral(kind) -> Column:
    return _between(kind, EPHEMERAL)


def is_addressable(kind) -> Column:
    return _between(kind, ADDRESSABLE)


def is_replaceable(kind) -> Column:
    return _between(kind, REPLACEABLE) | is_addressable(kind)


def kind_class(kind) -> Column:
    return (
        F.when(is_ephemeral(kind), "ephemeral")
        .when(is_addressable(kind), "addressable")
        .when(is_replaceable(kind), "replaceable")
        .otherwise("regular")
    )


def d_tag(kind, tags) -> Column:
    """An addressable event's first `d` value (it may be empty); null for other kinds and without one."""
    first = F.get(F.filter(_col(tags), lambda t: (t["name"] == "d") & (F.size(t["values"]) > 0)), 0)
    return F.when(is_addressable(kind), tag_value(first))


def replacement_key(pubkey, kind, tags) -> Column:
    """(pubkey, kind, d) for replaceable kinds, d null where the event has no slot of its own; null for other kinds."""
    key = F.struct(_col(pubkey).alias("pubkey"), _col(kind).alias("kind"), d_tag(kind, tags).alias("d"))
    return F.when(is_replaceable(kind), key)


def route_key(id_, pubkey, kind, tags) -> Column:
    """One string per cell of state: the replacement key, else the id. Lengths keep keys apart."""
    d = d_tag(kind, tags)
    slot = F.when(d.isNull(), F.lit("r")).otherwise(F.concat(F.lit("a"), d))
    return F.when(is_replaceable(kind), F.concat_ws(":", F.lit("k"), _col(pubkey), _col(kind).cast("string"), slot)).otherwise(
        F.concat(F.lit("i:"), _col(id_))
    )


def approximate_size(raw, content, tags, struct_bytes: int = 256) -> Column:
    """Bytes that an event object takes: its struct (a parameter, as it depends on the platform), raw text, content and tags."""
    of_tag = lambda t: F.octet_length(t["name"]) + F.aggregate(t["values"], F.lit(0), lambda s, v: s + F.octet_length(v))
    in_tags = F.aggregate(_col(tags), F.lit(0), lambda s, t: s + of_tag(t))
    return (F.lit(struct_bytes) + F.octet_length(_col(raw)) + F.octet_length(_col(content)) + in_tags).cast("bigint")


def shard_of(id_, shards: int = 64) -> Column:
    """Which of `shards` ordered lists an id belongs to; only a layout matter, results do not depend on it."""
    return F.pmod(F.xxhash64(_col(id_)), F.lit(shards)).cast("int")

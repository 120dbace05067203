"""Point and range access: newest first, ties by id, stopped by a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_hex, is_single_letter, tag_value


def newest(events: DataFrame, limit: int | None = None) -> DataFrame:
    """created_at descending, id ascending; with a limit the plan is a top-k, not a sort."""
    out = events.orderBy(F.desc("created_at"), F.asc("id"))
    return out.limit(limit) if limit is not None else out


def oldest(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(F.asc("created_at"), F.desc("id")).limit(n)


def by_id(events: DataFrame, id_: str) -> DataFrame:
    return events.where(F.col("id") == id_)


def contains(events: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id) with found: whether each is there; one row for each given row."""
    known = events.select("id").distinct().withColumn("found", F.lit(True))
    return ids.join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def by_pubkey(events: DataFrame, pubkey: str, limit: int | None = None) -> DataFrame:
    return newest(events.where(F.col("pubkey") == pubkey), limit)


def by_pubkey_since(events: DataFrame, pubkey: str, since: int, limit: int | None = None) -> DataFrame:
    return newest(events.where((F.col("pubkey") == pubkey) & (F.col("created_at") >= since)), limit)


def by_kind(events: DataFrame, kind: int, limit: int | None = None) -> DataFrame:
    return newest(events.where(F.col("kind") == kind), limit)


def tag_index(events: DataFrame) -> DataFrame:
    """(letter, value, id, created_at, kind, pubkey, seq): first values of one-character tags; e and p only as 64 hex digits,
    lower-cased. Written sorted by (letter, value), its scans are pruned by Parquet statistics."""
    one = events.select("id", "created_at", "kind", "pubkey", "seq", F.explode("tags").alias("t"))
    name, value = F.col("t.name"), tag_value(F.col("t"))
    hexed = name.isin("e", "p")
    kept = one.where(is_single_letter(name) & value.isNotNull() & (~hexed | is_hex(value)))
    return kept.select(name.alias("letter"), F.when(hexed, F.lower(value)).otherwise(value).alias("value"), "id", "created_at", "kind", "pubkey", "seq")


def by_tag(events: DataFrame, index: DataFrame, letter: str, value: str, limit: int | None = None) -> DataFrame:
    """Events of an index entry: a top-k of the narrow index first, then a semi-join with what is left."""
    wanted = value.lower() if letter in ("e", "p") else value
    hits = index.where((F.col("letter") == letter) & (F.col("value") == wanted)).select("id", "created_at").distinct()
    if limit is not None:
        hits = newest(hits, limit)
    return newest(events.join(hits.select("id"), "id", "left_semi"))


def all_ids(events: DataFrame) -> DataFrame:
    return events.select("id").distinct()


def totals(events: DataFrame) -> DataFrame:
    """(events, bytes)"""
    return events.agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("bytes"))

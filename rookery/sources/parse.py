"""Strict parsing of event JSON, in columns: VARIANT keeps the JSON types that lenient readers would cast away."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import event_id, event_tags, is_hex, verify_signature
from ..model import EVENT_COLUMNS, MAX_KIND

#: Why a line is no event: fixed texts.
REASONS = {
    "json": "Invalid JSON",
    "range": "created_at is beyond 63 bits",
    "id": "Invalid event id (expected 32-byte hex)",
    "pubkey": "Invalid pubkey (expected 32-byte hex)",
    "sig": "Invalid signature (expected 64-byte hex)",
    "mismatch": "Event id does not match content hash",
    "signature": "Signature verification failed",
}
_WHOLE = r"^(BIGINT|DECIMAL\(\d+,0\))$"


def _type(variant: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def parsed(lines: DataFrame, raw: str = "raw", check_id: bool = False, check_signature: bool = False) -> DataFrame:
    """lines with the event's columns and reason: null for an event, else why not.

    Unchecked parsing asks for well-formed fields alone; check_id compares the id with the hash of the fields as received,
    check_signature verifies the signature too (slow: it runs Python).
    """
    v = F.try_parse_json(F.col(raw))
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    whole = lambda name: F.try_variant_get(v, f"$.{name}", "decimal(20,0)")
    texts = ("id", "pubkey", "content", "sig")
    shape = F.lit(True)
    for name in texts:
        shape = shape & (F.coalesce(_type(v, f"$.{name}"), F.lit("")) == "STRING")
    for name in ("created_at", "kind"):
        shape = shape & F.coalesce(_type(v, f"$.{name}"), F.lit("")).rlike(_WHOLE) & F.coalesce(whole(name) >= 0, F.lit(False))
    shape = shape & F.coalesce(_type(v, "$.tags"), F.lit("")).rlike(r"^ARRAY<(VOID|ARRAY<(VOID|STRING)>)>$")
    wire = F.try_variant_get(v, "$.tags", "array<array<string>>")
    no_nulls = F.coalesce(F.forall(wire, lambda t: t.isNotNull() & F.forall(t, lambda x: x.isNotNull())), F.lit(False))
    rows = lines.select(
        "*",
        *(text(n).alias(f"_{n}") for n in texts),
        whole("created_at").alias("_at"),
        whole("kind").alias("_kind"),
        wire.alias("_wire"),
        (shape & no_nulls & (whole("created_at") < F.lit("18446744073709551616").cast("decimal(20,0)")) & (whole("kind") <= MAX_KIND)).alias("_ok"),
    )
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    reason = (
        F.when(~ok, "json")
        .when(~is_hex("_id"), "id")
        .when(~is_hex("_pubkey"), "pubkey")
        .when(~is_hex("_sig", 128), "sig")
        .when(F.col("_at") > F.lit(2**63 - 1).cast("decimal(20,0)"), "range")
    )
    rows = rows.withColumn("reason", reason)
    if check_id or check_signature:
        good = F.col("reason").isNull()
        wanted = event_id(F.when(good, F.col("_pubkey")), F.when(good, F.col("_at").cast("bigint")).cast("string"), F.when(good, F.col("_kind").cast("string")), F.when(good, F.col("_wire")), F.when(good, F.col("_content")))
        rows = rows.withColumn("reason", F.when(good & (wanted != F.lower("_id")), "mismatch").otherwise(F.col("reason")))
    if check_signature:
        good = F.col("reason").isNull()
        right = verify_signature(F.when(good, F.col("_pubkey")), F.col("_id"), F.col("_sig"))
        rows = rows.withColumn("reason", F.when(good & ~right, "signature").otherwise(F.col("reason")))
    good = F.col("reason").isNull()
    held = lambda c: F.when(good, c)
    return rows.select(
        *(F.col(f"`{c}`") for c in lines.columns if c not in ("id", "pubkey", "created_at", "kind", "tags", "content", "sig", "raw_bytes", "reason")),
        held(F.lower("_id")).alias("id"),
        held(F.lower("_pubkey")).alias("pubkey"),
        held(F.col("_at").cast("bigint")).alias("created_at"),
        held(F.col("_kind").cast("bigint")).alias("kind"),
        held(event_tags("_wire")).alias("tags"),
        held(F.col("_content")).alias("content"),
        held(F.lower("_sig")).alias("sig"),
        F.octet_length(F.col(raw)).cast("bigint").alias("raw_bytes"),
        "reason",
    )


def events_of(lines: DataFrame, **checks) -> DataFrame:
    """Good events of lines (seq, raw)."""
    return parsed(lines, **checks).where(F.col("reason").isNull()).select(*EVENT_COLUMNS)


def rejects_of(lines: DataFrame, **checks) -> DataFrame:
    """(raw, reason) of what is no event."""
    return parsed(lines, **checks).where(F.col("reason").isNotNull()).select("raw", "reason")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(seq, raw) of a snapshot's lines; blank lines are skipped. seq orders files by name, and the lines of a file.

    A file's number fills the bits from 44 on. Below are its split's offset and the line's number in its task: a split has fewer lines
    than bytes, and a task reads several splits only if they are ends of files, which no split of the same file follows.
    """
    text = spark.read.text(path)
    names = [(re.sub("^file:/+", "/", f), i) for i, f in enumerate(sorted(text.inputFiles()))]
    names = spark.createDataFrame(names, "file string, number long")
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = text.select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("file"), (F.col("_metadata.file_block_start") + line).alias("n"))
    lines = lines.where(F.trim("value") != "").join(F.broadcast(names), "file")  # a row for each file, which the driver lists anyway
    return lines.select((F.col("number") * F.lit(1 << 44) + F.col("n")).alias("seq"), F.col("value").alias("raw"))


def read_archive(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Events of a folder of JSONL files, one for each id, the earliest line first; at most `limit` if given."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    events = events_of(read_jsonl(spark, path)).withColumn("_n", first).where("_n = 1").drop("_n")
    return events.orderBy("seq").limit(limit) if limit is not None else events

"""Makes an event log of the test tables' `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EVENT_COLUMNS

#: Kinds that the event types stand for.
KINDS = {"view": 1, "click": 7, "signup": 10002, "error": 20001, "purchase": 30023}
NO_SIGNATURE = "0" * 128


def event_identifier(n) -> F.Column:
    return F.sha2(F.concat(F.lit("evt:"), n.cast("string")), 256)


def user_key(n) -> F.Column:
    return F.sha2(F.concat(F.lit("usr:"), n.cast("string")), 256)


def adapted(events: DataFrame, users) -> DataFrame:
    """seq is event_id; created_at whole seconds; tags e (the event before), p (another user), t (the type), d (the property)."""
    kind = F.lit(0)
    for name, number in KINDS.items():
        kind = F.when(F.col("event_type") == name, number).otherwise(kind)
    rows = events.select(
        F.col("event_id").cast("bigint").alias("seq"),
        event_identifier(F.col("event_id")).alias("id"),
        user_key(F.col("user_id")).alias("pubkey"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"),
        kind.cast("bigint").alias("kind"),
        F.array(
            F.array(F.lit("e"), event_identifier(F.greatest(F.col("event_id") - 1, F.lit(0)))),
            F.array(F.lit("p"), user_key(F.col("user_id") * 7 % users)),
            F.array(F.lit("t"), F.col("event_type")),
            F.array(F.lit("d"), F.get_json_object("props", "$.k")),
        ).alias("wire"),
        F.lit("").alias("content"),
        F.lit(NO_SIGNATURE).alias("sig"),
    )
    raw = F.concat(
        F.lit('{"id":"'), "id", F.lit('","pubkey":"'), "pubkey", F.lit('","created_at":'), F.col("created_at").cast("string"),
        F.lit(',"kind":'), F.col("kind").cast("string"), F.lit(',"tags":'), F.to_json("wire"), F.lit(',"content":"","sig":"'), "sig", F.lit('"}'),
    )
    tags = F.transform("wire", lambda t: F.struct(F.get(t, 0).alias("name"), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))).alias("values")))
    rows = rows.withColumn("raw", raw).withColumn("raw_bytes", F.octet_length("raw").cast("bigint")).withColumn("tags", tags)
    return rows.select(*EVENT_COLUMNS)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    users = events.agg(F.greatest(F.countDistinct("user_id"), F.lit(1)).alias("users")).scalar()
    return adapted(events, users)

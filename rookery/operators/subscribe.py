"""Events against standing subscriptions.

A nested loop over events and filters costs their product. So filters are split by their most telling condition (ids, a tag,
authors, kinds), whose values join the events' on equality; only filters with none of these, on time alone or on nothing,
need the loop, and they match most events anyway. All other conditions are checked on the joined rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tag_value
from ..model import SUBSCRIPTION_SCHEMA
from ..sources.filters import Filter
from .match import row_matches
from .query import query

#: Loop filters, and values of the other filters, up to this many are sent to all events.
BROADCAST_FILTERS = 10_000


def subscriptions(spark, rows: list[tuple[str, str, list[Filter]]]) -> DataFrame:
    """A table of subscriptions from (connection, subscription id, filters)."""
    listed = lambda v: None if v is None else list(v)
    cap = lambda v: None if v is None else min(v, 2**63 - 1)
    data = [
        (conn, sub, i, listed(f.ids), listed(f.authors), listed(f.kinds), {k: list(v) for k, v in f.tags.items()}, cap(f.since), cap(f.until))
        for conn, sub, filters in rows
        for i, f in enumerate(filters)
    ]
    return spark.createDataFrame(data, SUBSCRIPTION_SCHEMA)


def replaced_subscriptions(current: DataFrame, added: DataFrame) -> DataFrame:
    """A subscription of the same connection and id takes the place of the old one."""
    return current.join(added.select("conn", "sub_id").distinct(), ["conn", "sub_id"], "left_anti").unionByName(added)


def closed(current: DataFrame, conn: str, sub_id: str | None = None) -> DataFrame:
    """Without one subscription, or without all of a connection."""
    gone = F.col("conn") == conn
    return current.where(~(gone & (F.col("sub_id") == sub_id) if sub_id is not None else gone))


def matched(events: DataFrame, subs: DataFrame, each_filter: bool = False, loop_filters: int | None = None, more: list[str] | None = None) -> DataFrame:
    """(conn, sub_id, id) once for each event and subscription that match; with each_filter also filter_no, once for each filter, and more columns of
    the event."""
    names = ("ids", "authors", "kinds", "tags", "since", "until")
    filters = subs.select("conn", "sub_id", "filter_no", *(F.col(n).alias(f"f_{n}") for n in names))
    filters = filters.withColumn("f_tags", F.coalesce("f_tags", F.create_map().cast("map<string,array<string>>")))
    told = F.array_sort(F.map_keys("f_tags"))
    letter = F.get(told, 0)
    path = (
        F.when(F.col("f_ids").isNotNull(), "id")
        .when(letter.isNotNull(), "tag")
        .when(F.col("f_authors").isNotNull(), "author")
        .when(F.col("f_kinds").isNotNull(), "kind")
        .otherwise("loop")
    )
    filters = filters.withColumn("path", path)
    key = F.array_distinct(
        F.when(F.col("path") == "id", F.col("f_ids"))
        .when(F.col("path") == "tag", F.transform(F.element_at("f_tags", letter), lambda v: F.concat(letter, F.lit("\u0000"), v)))
        .when(F.col("path") == "author", F.col("f_authors"))
        .otherwise(F.transform("f_kinds", lambda k: k.cast("string")))
    )
    keyed = filters.where("path <> 'loop'").withColumn("key", F.explode(key))
    if keyed.limit(BROADCAST_FILTERS + 1).count() <= BROADCAST_FILTERS:  # then the events, several rows each here, need no shuffle
        keyed = F.broadcast(keyed)
    tags = F.transform(
        F.filter("tags", lambda t: tag_value(t).isNotNull()), lambda t: F.struct(F.lit("tag").alias("path"), F.concat(t["name"], F.lit("\u0000"), tag_value(t)).alias("key"))
    )
    own = [F.struct(F.lit(p).alias("path"), F.col(c).cast("string").alias("key")) for p, c in (("id", "id"), ("author", "pubkey"), ("kind", "kind"))]
    narrow = events.select("id", "pubkey", "kind", "created_at", "tags")
    probes = narrow.withColumn("probe", F.explode(F.array_distinct(F.concat(F.array(*own), tags)))).select("*", "probe.path", "probe.key").drop("probe")
    out = ["conn", "sub_id", "id"] + ["filter_no"] * each_filter + (more or [])
    parts = [probes.join(keyed, ["path", "key"]).where(row_matches()).select(*out)]
    loop = filters.where("path = 'loop'")
    n = loop.count() if loop_filters is None else loop_filters
    if n:
        in_time = F.coalesce(F.col("created_at") >= F.col("f_since"), F.lit(True)) & F.coalesce(F.col("created_at") <= F.col("f_until"), F.lit(True))
        loops = -(-n // BROADCAST_FILTERS)
        of = F.pmod(F.xxhash64("conn", "sub_id", "filter_no"), F.lit(loops))
        for i in range(loops):  # each part of a size that may be sent to all events; nearly all pairs are answers
            parts.append(narrow.join(F.broadcast(loop.where(of == i) if loops > 1 else loop), in_time).select(*out))
    return reduce(DataFrame.unionByName, parts).distinct()


def stored_answers(events: DataFrame, requests: list[tuple[str, str, list[Filter]]], mode: str = "strict") -> DataFrame:
    """Stored results of every filter of every subscription: (conn, sub_id, filter_no, id). In strict mode one scan serves them all: the
    filters join the events, then each filter's limit cuts its rows, of which no task keeps more than the largest limit."""
    if mode == "strict":
        spark = events.sparkSession
        cap = [(conn, sub, i, f.limit) for conn, sub, filters in requests for i, f in enumerate(filters)]
        limits = F.broadcast(spark.createDataFrame(cap, "conn string, sub_id string, filter_no int, f_limit long"))
        key = ["conn", "sub_id", "filter_no"]
        hits = matched(events, subscriptions(spark, requests), True, more=["created_at"]).join(limits, key)
        answers = hits.where("f_limit is null").select(*key, "id")
        most = max((c[3] for c in cap if c[3] is not None), default=None)
        if most is None:
            return answers
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("created_at"), F.asc("id")))
        cut = hits.where("f_limit is not null").withColumn("_n", place).where((F.col("_n") <= most) & (F.col("_n") <= F.col("f_limit")))
        return answers.unionByName(cut.select(*key, "id"))
    parts = [
        query(events, f, mode).select(F.lit(conn).alias("conn"), F.lit(sub).alias("sub_id"), F.lit(i).alias("filter_no"), "id")
        for conn, sub, filters in requests
        for i, f in enumerate(filters)
    ]
    return reduce(DataFrame.unionByName, parts)

"""Figures about the store and its use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import capacity, format_bytes
from ..workdir import shared_folder

#: Upper edges of the histograms in seconds, fixed values.
HISTOGRAMS = {
    "write_delay_seconds": [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0],
    "time_to_eose_seconds": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0],
    "disk_persistence_seconds": [0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0],
}


def kind_counts(events: DataFrame, top: int | None = None) -> DataFrame:
    """(kind, n), most frequent first."""
    out = events.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("kind"))
    return out.limit(top) if top is not None else out


def author_rank_sample(events: DataFrame) -> DataFrame:
    """(rank, pubkey, n) of the authors at a tenth, a quarter, half, three quarters and the end of the order by number of events.

    The order is a distributed sort; places come from partition sizes, so no task sees all authors.
    """
    counts = events.groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"))
    total = counts.count()
    places = sorted({total // 10, total // 4, total // 2, total * 3 // 4, total - 1}) if total else []
    return at_ranks(counts, ["n", "pubkey"], places).select(F.col("rank"), "pubkey", "n")


def at_ranks(rows: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    """The rows at the given places (from 0) of an order, with their rank.

    The ranges are written once: range bounds come from a sample, so a second evaluation might draw them elsewhere.
    """
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "ranges")
    rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    sizes = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}
    start, wanted = 0, []
    for part in sorted(sizes):
        wanted += [(part, p - start, p) for p in places if start <= p < start + sizes[part]]
        start += sizes[part]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    hit, rank = F.lit(False), F.lit(None).cast("bigint")
    for part, at, place in wanted:
        here = (F.col("_part") == part) & (F.col("_at") == at)
        hit, rank = hit | here, F.when(here, F.lit(place).cast("bigint")).otherwise(rank)
    parts = [w[0] for w in wanted]
    chosen = held.where(F.col("_part").isin(parts)).withColumn("_at", inside).where(hit)
    return chosen.withColumn("rank", rank).drop("_part", "_at")


def median_created_at(events: DataFrame) -> DataFrame:
    """The upper median of created_at: element n / 2 of the sorted list. Only counts of whole seconds are ordered."""
    counts = events.groupBy("created_at").agg(F.count(F.lit(1)).alias("n"))
    total = events.count()
    return _value_at(counts, total // 2).select(F.col("created_at").alias("median_created_at"))


#: Bits that a step of _value_at tells apart; so many counts at most come to the driver.
STEP = 12


def _value_at(counts: DataFrame, place: int) -> DataFrame:
    """The row of the created_at that holds the given place (from 0) among counted values (created_at, n), from its high bits down."""
    low, high = counts.agg(F.min("created_at"), F.max("created_at")).first()
    if low is None:
        return counts.limit(0)
    shift = -(-(high - low).bit_length() // STEP) * STEP
    while shift:
        shift -= STEP
        part = F.shiftright(F.col("created_at") - low, shift)
        found = counts.where((F.col("created_at") >= low) & (F.col("created_at") <= high)).groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
        for part_no, n in sorted(tuple(r) for r in found.collect()):
            if place < n:
                low, high = low + (part_no << shift), min(high, low + (part_no + 1 << shift) - 1)
                break
            place -= n
    return counts.where(F.col("created_at") == low)


def counters(outcomes: DataFrame, subs: DataFrame | None = None, replies: DataFrame | None = None) -> DataFrame:
    """(name, value): what was saved, found twice, passed on or replaced; with subs (conn, sub_id) the gauges of connections and
    subscriptions; with replies (conn, frame) the events and bytes that went out. Counts of one batch: totals are their sums."""

    def rows(df: DataFrame, **cells) -> DataFrame:
        one = df.agg(*(c.cast("bigint").alias(k) for k, c in cells.items()))
        return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.coalesce(k, F.lit(0)).alias("value")) for k in cells))).alias("c")).select("c.*")

    of = lambda name: F.count_if(F.col("outcome") == name)
    out = rows(
        outcomes, events_saved_total=of("stored"), events_duplicate_total=of("duplicate"), events_ephemeral_total=of("ephemeral"),
        events_replaced_total=F.count("replaced_id"),
    )
    if subs is not None:
        out = out.unionByName(rows(subs, active_connections=F.countDistinct("conn"), active_subscriptions=F.countDistinct("conn", "sub_id")))
    if replies is not None:
        out = out.unionByName(rows(replies, events_output_total=F.count_if(F.col("frame").startswith('["EVENT"')), bytes_output_total=F.sum(F.octet_length("frame"))))
    return out


def counter_lines(values: DataFrame) -> DataFrame:
    """(line): counters and gauges (name, value) in Prometheus text form."""
    kind = F.when(F.col("name").endswith("_total"), "counter").otherwise("gauge")
    lines = F.array(F.concat(F.lit("# TYPE "), "name", F.lit(" "), kind), F.concat("name", F.lit(" "), F.col("value").cast("string")))
    return values.select("name", F.posexplode(lines).alias("n", "line")).orderBy("name", "n").select("line")


def histogram(values: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(le, n): how many values are at most each edge, cumulative, with one row for all; as text, `+Inf` last."""
    one = values.agg(*(F.count_if(F.col(column) <= e).alias(f"b{i}") for i, e in enumerate(edges)), F.count(column).alias("all"))
    cells = [F.struct(F.lit(_edge(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.le", "c.n")


def _edge(e: float) -> str:
    return repr(e).removesuffix(".0")


def exposition(values: DataFrame, column: str, name: str, help_text: str) -> DataFrame:
    """(line) of a histogram in Prometheus text form."""
    edges = HISTOGRAMS[name]
    one = values.agg(*(F.count_if(F.col(column) <= e).alias(f"b{i}") for i, e in enumerate(edges)), F.count(column).alias("all"), F.coalesce(F.sum(column), F.lit(0.0)).alias("total"))
    bucket = lambda le, c: F.concat(F.lit(f'{name}_bucket{{le="{le}"}} '), c.cast("string"))
    lines = [F.lit(f"# HELP {name} {help_text}"), F.lit(f"# TYPE {name} histogram")]
    lines += [bucket(_edge(e), F.col(f"b{i}")) for i, e in enumerate(edges)]
    lines += [bucket("+Inf", F.col("all")), F.concat(F.lit(f"{name}_sum "), F.col("total").cast("string")), F.concat(F.lit(f"{name}_count "), F.col("all").cast("string"))]
    return one.select(F.posexplode(F.array(*lines)).alias("n", "line")).orderBy("n").select("line")


def latency_summary(runs: DataFrame) -> DataFrame:
    """From (name, seconds, events, bytes) a row for each name: rounds, mean seconds and events, MB a second."""
    return runs.groupBy("name").agg(
        F.count(F.lit(1)).alias("rounds"),
        F.avg("seconds").alias("avg_seconds"),
        F.avg("events").alias("avg_events"),
        (F.sum("bytes") / F.sum("seconds") / 1e6).alias("mb_per_second"),
    )


def store_stats(events: DataFrame, max_bytes: int = 0, process_bytes: int = 0) -> DataFrame:
    """One row for a status page."""
    limit = F.lit(max_bytes).cast("bigint")
    used = F.coalesce(F.sum("raw_bytes"), F.lit(0)).cast("bigint")
    row = events.agg(F.count(F.lit(1)).alias("events"), used.alias("store_bytes"))
    return row.select(
        "events",
        "store_bytes",
        limit.alias("max_bytes"),
        F.lit(process_bytes).cast("bigint").alias("process_memory"),
        limit.alias("memory_limit"),
        F.col("store_bytes").alias("memory_used"),
        format_bytes("store_bytes").alias("shown_bytes"),
        capacity("store_bytes", limit).alias("shown_capacity"),
    )

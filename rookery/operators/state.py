"""What the log means: outcomes of inserts, the live set, replay of operations.

Arrival order (seq) alone decides: within a replacement key the last arrival wins, whatever its created_at. Only the live
event of a key is remembered, so one that was replaced may come again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_ephemeral, is_replaceable, route_key

_ROUTE = "_route"


def _routed(log: DataFrame) -> DataFrame:
    return log.withColumn(_ROUTE, route_key("id", "pubkey", "kind", "tags"))


def outcomes(log: DataFrame) -> DataFrame:
    """log with outcome (stored, duplicate, ephemeral) and replaced_id, for a log without deletes and eviction."""
    stored = _told(log).drop(_ROUTE)
    passing = log.where(is_ephemeral("kind")).select("*", F.lit("ephemeral").alias("outcome"), F.lit(None).cast("string").alias("replaced_id"))
    return stored.unionByName(passing)


def _told(log: DataFrame) -> DataFrame:
    """log without ephemeral events, with outcome (stored, duplicate), replaced_id and the route key.

    One shuffle on the route key (replacement key, else id): an event is a duplicate if the arrival before it in its
    cell has its id; otherwise it replaces that one.
    """
    before = F.lag("id").over(Window.partitionBy(_ROUTE).orderBy("seq"))
    rows = _routed(log.where(~is_ephemeral("kind"))).withColumn("_before", before)
    same = F.coalesce(F.col("_before") == F.col("id"), F.lit(False))
    return rows.select(
        *log.columns,
        _ROUTE,
        F.when(same, "duplicate").otherwise("stored").alias("outcome"),
        F.when(~same & is_replaceable("kind"), F.col("_before")).alias("replaced_id"),
    )


def slim(log: DataFrame, *more: str) -> DataFrame:
    """What outcomes need of a log: seq, id, the text, the route key, two marks of the kind, and the columns more."""
    marks = (is_ephemeral("kind").alias("_passing"), is_replaceable("kind").alias("_replaceable"))
    return log.select("seq", "id", "raw", route_key("id", "pubkey", "kind", "tags").alias(_ROUTE), *marks, *more)


def slim_outcomes(rows: DataFrame) -> DataFrame:
    """`outcomes` of a slim log, with its seq, id, text and further columns; one shuffle, of these alone."""
    before = F.lag("id").over(Window.partitionBy(_ROUTE).orderBy("seq"))
    kept = [c for c in rows.columns if c not in (_ROUTE, "_passing", "_replaceable")]
    same = F.coalesce(F.col("_before") == F.col("id"), F.lit(False))
    outcome, gone = F.when(same, "duplicate").otherwise("stored"), F.when(~same & F.col("_replaceable"), F.col("_before"))
    stored = rows.where("not _passing").withColumn("_before", before).select(*kept, outcome.alias("outcome"), gone.alias("replaced_id"))
    passing = rows.where("_passing").select(*kept, F.lit("ephemeral").alias("outcome"), F.lit(None).cast("string").alias("replaced_id"))
    return stored.unionByName(passing)


def live(log: DataFrame) -> DataFrame:
    """The events that are stored after the whole log. A replaceable cell keeps its last arrival (an arrival with the live id
    changes nothing, so the first of the last stretch of equal ids is the stored row); others their first. One shuffle: both windows
    stand on the same route key."""
    last = F.row_number().over(Window.partitionBy(_ROUTE).orderBy(F.desc("seq")))
    return _told(log).where("outcome = 'stored'").withColumn("_n", last).where("_n = 1").select(*log.columns)


def replaced(log: DataFrame) -> DataFrame:
    """(seq, id, replaced_id) of each event that took another's place."""
    return outcomes(log).where(F.col("replaced_id").isNotNull()).select("seq", "id", "replaced_id")


def insert_counts(log: DataFrame) -> DataFrame:
    """One row: how many of each outcome, and how many were replaced."""
    return outcomes(log).agg(
        F.count_if(F.col("outcome") == "stored").alias("inserted"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"),
        F.count_if(F.col("outcome") == "ephemeral").alias("ephemerals"),
        F.count_if(F.col("replaced_id").isNotNull()).alias("replaced"),
    )


def new_events(live_events: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming events whose id is not live."""
    return incoming.join(live_events.select("id"), "id", "left_anti")


def removed(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events without those of the given ids."""
    return events.join(ids.select("id"), "id", "left_anti")


def replay(ops: DataFrame) -> DataFrame:
    """Live events after operations: op insert or delete, segment and pos for their order, and the event's columns (for
    deletes the id alone).

    Replay has no check for ephemeral kinds. Each cell's last insert is live unless a delete of its id comes later; an insert that the
    live event's own id repeats is that same event. Events come as their first insert of the last stretch would.
    """
    order = [F.col("segment"), F.col("pos")]
    inserts = _routed(ops.where("op = 'insert'"))
    last = F.row_number().over(Window.partitionBy(_ROUTE).orderBy(*(c.desc() for c in order)))
    winners = inserts.withColumn("_n", last).where("_n = 1").drop("_n", "op", _ROUTE)
    deletes = ops.where("op = 'delete'").groupBy("id").agg(F.max(F.struct("segment", "pos")).alias("_gone"))
    kept = winners.join(deletes, "id", "left").where(F.col("_gone").isNull() | (F.col("_gone") < F.struct("segment", "pos")))
    return kept.drop("_gone")


def replay_counts(ops: DataFrame, max_bytes: int = 0) -> DataFrame:
    """One row of load counters: operations applied (op is not null), records that were none (op is null), and, with a limit, the events
    that loading the inserts one after the other evicts."""
    from .evict import load_eviction

    one = ops.agg(F.count("op").alias("applied"), F.count_if(F.col("op").isNull()).alias("errors"))
    if not max_bytes:
        return one.withColumn("evicted", F.lit(0).cast("bigint"))
    order = F.struct("segment", "pos")
    inserts = ops.where("op = 'insert'").withColumn("seq", order)
    gone = load_eviction(inserts, max_bytes).agg(F.count_if("evicted").alias("evicted")).scalar()
    return one.withColumn("evicted", gone)


def compacted(ops: DataFrame, live_ids: DataFrame) -> DataFrame:
    """The log rewritten: each live id's first insert, no deletes."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("segment", "pos"))
    kept = ops.where("op = 'insert'").join(live_ids.select("id").distinct(), "id", "left_semi")
    return kept.withColumn("_n", first).where("_n = 1").drop("_n").select(*ops.columns)

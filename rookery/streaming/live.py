"""Continuous operation on Structured Streaming.

Arrivals are a stream of log rows. `outcome_stream` keeps the live id of each route key and says what each arrival does;
`match_stream` sends what was accepted to matching subscriptions; `run` does both for every micro-batch and commits the
operation log. There is no watermark: late events are as good as any, arrival alone decides, so the state is as large as the set of
live keys. A bounded alternative with other semantics is `bounded_dedup`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import is_ephemeral, is_replaceable, route_key
from ..model import EVENT_SCHEMA
from ..operators.frames import eose_frame, event_frame
from ..operators.query import request
from ..operators.subscribe import matched
from ..plans.persistence import append_ops, recover
from ..sources.filters import Filter
from ..sources.parse import events_of

#: Frames dropped in a row from which a connection counts as slow, a fixed value.
SLOW_AFTER = 100
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of the route keys, whose state is read together: at 30 million live keys about 1,000 keys each.
STATE_PARTS = 1 << 15
_OUT = "seq long, id string, outcome string, replaced_id string, raw string"


def read_log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Log rows from Parquet files as they come; files_per_batch bounds a micro-batch (backpressure). A row whose op is `delete` tells that
    its event left the store."""
    reader = spark.readStream.schema(T.StructType([*EVENT_SCHEMA.fields, T.StructField("op", T.StringType())]))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_frame_stream(spark: SparkSession, path: str) -> DataFrame:
    """Frames of connections, one JSON object (n, conn, frame) a line; n orders them."""
    return spark.readStream.schema("n long, conn string, frame string").json(path)


def answer_frames(session, path: str, sink, checkpoint: str, trigger: dict | None = None):
    """Starts a query that gives the session's replies to each micro-batch of frames to sink(replies, batch). A batch that is tried
    again finds its events stored and acknowledges them as duplicates."""

    def each(batch: DataFrame, number: int) -> None:
        sink(session.answer(batch), number)
        session.release()

    frames_in = read_frame_stream(session.store.spark, path)
    return frames_in.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Cells(StatefulProcessor):
    """The live ids of the route keys of one part of all keys. State is a list of (route, id), of which a route's last entry counts and a
    null id tells that there is none; a batch appends what it changed, and a list is written anew when most of it is outdated.
    So calls to the state store are a few for each part, not for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "route string, id string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        known, entries = {}, 0
        for route, id_ in self.held.get():
            known[route] = id_
            entries += 1
        before: dict[str, str | None] = {}
        for r in sorted(rows, key=lambda r: r.seq):
            if r.passing and not r.gone:
                yield Row(seq=r.seq, id=r.id, outcome="ephemeral", replaced_id=None, raw=r.raw)
                continue
            held = known.get(r.route)
            if r.gone:
                if r.id == held:
                    before.setdefault(r.route, held)
                    known[r.route] = None
                continue
            outcome, gone = "duplicate", None
            if r.id != held:
                outcome, gone = "stored", held if r.replaceable else None
                before.setdefault(r.route, held)
                known[r.route] = r.id
            yield Row(seq=r.seq, id=r.id, outcome=outcome, replaced_id=gone, raw=r.raw)
        changed = [(route, known[route]) for route, old in before.items() if known[route] != old]
        left = [(route, id_) for route, id_ in known.items() if id_ is not None]
        if not changed:
            return
        if not left:
            self.held.clear()
        elif entries + len(changed) > 2 * len(left) + 16:
            self.held.put(left)
        else:
            self.held.appendList(changed)

    def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
        self.held.put([(c["route"], c["id"]) for c in initialState.cells])

    def close(self) -> None:
        pass


def outcome_stream(log: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(seq, id, outcome, replaced_id, raw) of every arrival, as the batch operator `outcomes` gives them.

    State: the live id of each route key, in RocksDB, so it may exceed memory; keys are dealt into STATE_PARTS parts, and a batch reads the
    parts that it touches. Within a micro-batch rows are applied by seq. An ephemeral event leaves no state. held, the
    events that a store holds when the query first starts, is the state to begin with; rows whose op is `delete` take their event out of it.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    gone = F.coalesce(F.col("op") == "delete", F.lit(False)) if "op" in log.columns else F.lit(False)
    route = route_key("id", "pubkey", "kind", "tags").alias("route")
    part = F.pmod(F.xxhash64("route"), F.lit(STATE_PARTS)).alias("part")
    rows = log.select("seq", "id", "raw", gone.alias("gone"), is_ephemeral("kind").alias("passing"), is_replaceable("kind").alias("replaceable"), route).withColumn("part", part)
    first = None
    if held is not None:
        cells = held.where(~is_ephemeral("kind")).select(F.struct(route, "id").alias("cell")).select(F.xxhash64("cell.route").alias("h"), "cell")
        cells = cells.groupBy(F.pmod("h", F.lit(STATE_PARTS)).alias("part")).agg(F.collect_list("cell").alias("cells"))
        first = cells.groupBy("part")
    return rows.groupBy("part").transformWithState(_Cells(), _OUT, "Append", "None", first)


def bounded_dedup(log: DataFrame, time_column: str, delay: str) -> DataFrame:
    """Drops repeated ids that come within the delay; its state is bounded, its answer is not that of `outcome_stream`."""
    return log.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["id"])


def match_stream(accepted: DataFrame, subs: DataFrame, sink, checkpoint: str, loop_filters: int | None = None, trigger: dict | None = None):
    """Starts a query that gives sink(frame, batch) each micro-batch's matches, (conn, sub_id, id), once for each subscription."""

    def each(batch: DataFrame, number: int) -> None:
        sink(matched(batch, subs, loop_filters=loop_filters), number)

    return accepted.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def delivered(matches: DataFrame, events: DataFrame, per_connection: int | None = None) -> DataFrame:
    """(conn, sub_id, id, frame) for matches; with per_connection only so many for each connection, newest ids last (a slow reader's cap)."""
    rows = matches.join(events.select("id", "raw", "seq"), "id").withColumn("frame", event_frame(F.col("sub_id"), F.col("raw")))
    if per_connection is not None:
        place = F.row_number().over(Window.partitionBy("conn").orderBy("seq", "sub_id"))
        rows = rows.withColumn("_n", place).where(F.col("_n") <= per_connection)
    return rows.select("conn", "sub_id", "id", "frame")


def dropped_frames(matches: DataFrame, per_connection: int) -> DataFrame:
    """(conn, dropped, slow) of one batch's matches: what the cap of `delivered` leaves out for each connection. All of it is dropped in a
    row, so a connection is slow, and to be closed, from SLOW_AFTER on."""
    n = matches.groupBy("conn").agg(F.count(F.lit(1)).alias("n"))
    dropped = n.select("conn", F.greatest(F.col("n") - per_connection, F.lit(0)).alias("dropped"))
    return dropped.withColumn("slow", F.col("dropped") >= SLOW_AFTER)


def stored_then_live(events: DataFrame, sub_id: str, filters: list[Filter], cut_seq: int | None = None, mode: str = "strict") -> DataFrame:
    """(part, n, frame): stored answers in order, then the end mark. With cut_seq only events up to it count as stored, so a live
    tail from the next seq gives every event exactly once; without it an event at the border may come twice."""
    held = events if cut_seq is None else events.where(F.col("seq") <= cut_seq)
    sub = F.lit(sub_id)
    answers = request(held, filters, mode).select(F.lit(0).alias("part"), F.monotonically_increasing_id().alias("n"), event_frame(sub, F.col("raw")).alias("frame"))
    end = events.sparkSession.range(1).select(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("n"), eose_frame(sub).alias("frame"))
    return answers.unionByName(end)


def run(spark: SparkSession, log_path: str, folder, subs: DataFrame, sink, checkpoint: str, trigger: dict | None = None, keeper=None):
    """Ingest, commit and deliver: what the store holds is the state to begin with; for each micro-batch the outcomes are committed to the
    operation log under a number of their own (a retry finds it again), then stored and ephemeral events go to sink with their
    subscriptions, then the keeper, if there is one, does what is due."""
    log = read_log_stream(spark, log_path)
    done = outcome_stream(log, recover(folder))
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        stored = held.where("outcome = 'stored'")
        gone = stored.where("replaced_id is not null").select("seq", F.lit("delete").alias("op"), F.col("replaced_id").alias("id"), F.lit(None).cast("string").alias("raw"))
        append_ops(folder, stored.select("seq", F.lit("insert").alias("op"), "id", "raw").unionByName(gone), key=f"{writer}-{number}")
        accepted = events_of(held.where("outcome <> 'duplicate'").select("seq", "raw"))
        sink(matched(accepted, subs), held, number)
        held.unpersist()
        if keeper:
            keeper.tick()

    return done.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Bounding the store: the oldest events go first."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent_of, route_key
from ..workdir import shared_folder
from .access import oldest

#: Fixed values of the policy.
TARGET, WATCH, LOAD_FROM, LOAD_TO = 50, 70, 90, 70
BATCH, PRESSED_BATCH, CHUNK = 1000, 5000, 100


def interval_seconds(used: int, max_bytes: int, process_bytes: int = 0) -> int:
    """Until the next check: sooner the fuller the store is. 10 is the first interval, before any check."""
    if max_bytes == 0:
        return 10
    if used >= percent_of(max_bytes, WATCH) or process_bytes >= max_bytes:
        return 1
    return 2 if used >= percent_of(max_bytes, TARGET) else 5


def chunks(events: DataFrame, batch: int) -> DataFrame:
    """The oldest `batch` events (a top-k) with their chunk (from 0) and the bytes of all before the chunk.

    The running sum is over the batch alone, 5,000 rows at most, never over the store.
    """
    order = Window.orderBy(F.asc("created_at"), F.desc("id"))
    rows = oldest(events.select("id", "created_at", "raw_bytes"), batch)
    rows = rows.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / CHUNK).cast("bigint"))
    sums = rows.groupBy("chunk").agg(F.sum("raw_bytes").alias("_bytes"))
    before = F.coalesce(F.sum("_bytes").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("bytes_before", before).drop("_bytes")
    return rows.join(F.broadcast(sums), "chunk")


def evicted(events: DataFrame, max_bytes: int, process_bytes: int = 0) -> DataFrame:
    """(id, created_at, raw_bytes, chunk) of what a periodic check removes: chunks of the oldest until half the limit is met.

    With the process itself over the limit no chunk ends the round, as removing events does not lower that figure at once.
    """
    empty = events.limit(0).select("id", "created_at", "raw_bytes", F.lit(0).cast("bigint").alias("chunk"))
    if max_bytes == 0:
        return empty
    target, pressed = percent_of(max_bytes, TARGET), process_bytes > max_bytes
    total = events.agg(F.coalesce(F.sum("raw_bytes"), F.lit(0))).first()[0]
    if total <= target and not pressed:
        return empty
    rows = chunks(events, PRESSED_BATCH if pressed else BATCH)
    if not pressed:
        rows = rows.where(F.lit(total) - F.col("bytes_before") > target)
    return rows.select("id", "created_at", "raw_bytes", "chunk")


def after_eviction(events: DataFrame, max_bytes: int, process_bytes: int = 0) -> DataFrame:
    return events.join(evicted(events, max_bytes, process_bytes).select("id"), "id", "left_anti")


def load_eviction(log: DataFrame, max_bytes: int) -> DataFrame:
    """(id, evicted) of every distinct insert that ends live or evicted when events are loaded one after the other.

    Whenever the store passes 90 % of the limit, the oldest go until 70 %. That is a fold over the order of arrival, so one task does it.
    Before it every event gets a number by age, which also stands for its id and its cell, and the numbers are packed, so the task reads
    a few bytes for each event; what it holds is bounded by max_bytes, not by the log: entries of events that are gone leave the heap
    when they are more than the live ones. Without a limit nothing goes, and each cell's last insert stays.
    """
    if max_bytes == 0:
        last = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("seq")))
        rows = log.select("seq", "id", route_key("id", "pubkey", "kind", "tags").alias("route")).withColumn("_n", last)
        return rows.where("_n = 1").select("id", F.lit(False).alias("evicted"))
    rows = _numbered(log.select("seq", "id", route_key("id", "pubkey", "kind", "tags").alias("route"), "created_at", "raw_bytes"))
    start, stop = percent_of(max_bytes, LOAD_FROM), percent_of(max_bytes, LOAD_TO)

    def fold(batches):
        held: dict[int, tuple[int, int]] = {}  # cell -> (id, bytes)
        routes: dict[int, int] = {}
        ages: list[tuple[int, int]] = []
        used = 0
        for batch in batches:
            for packed in batch.column(1):
                gone = []
                for age, id_, route, size in zip(*_unpacked(packed.as_py()), strict=True):
                    if id_ in routes:
                        continue
                    if route in held:
                        old, bytes_ = held.pop(route)
                        del routes[old]
                        used -= bytes_
                    held[route], routes[id_] = (id_, size), route
                    used += size
                    heapq.heappush(ages, (age, id_))
                    if len(ages) > 2 * len(routes) + 1000:
                        ages = list({x[1]: x for x in ages if x[1] in routes}.values())
                        heapq.heapify(ages)
                    if used > start:
                        while used > stop and ages:
                            _, oldest_id = heapq.heappop(ages)
                            if oldest_id in routes:
                                used -= held.pop(routes.pop(oldest_id))[1]
                                gone.append(oldest_id)
                yield _told(gone, True)
        yield _told(list(routes), False)

    ordered = _packed(rows).repartition(1).sortWithinPartitions("seq")
    ends = ordered.mapInArrow(fold, "number bigint, evicted boolean")
    return ends.join(rows.where("age = number").select("number", "id"), "number").select("id", "evicted")


def _numbered(rows: DataFrame) -> DataFrame:
    """(seq, id, age, number, cell, raw_bytes): age orders the rows as the oldest first, number is the least age of the row's id and cell
    that of its route."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "ages")
    order = [F.asc("created_at"), F.desc("id")]
    aged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("age", F.monotonically_increasing_id())
    aged.drop("created_at").write.parquet(path)  # once: the numbers of a second run might differ
    aged = spark.read.schema(aged.drop("created_at").schema).parquet(path)
    least = lambda c: F.min("age").over(Window.partitionBy(c))
    return aged.withColumn("number", least("id")).withColumn("cell", least("route")).drop("route")


def _packed(rows: DataFrame) -> DataFrame:
    """(seq, packed): runs of rows in the order of seq, each with its first seq."""
    kind = dict(rows.dtypes)["seq"]

    def work(batches):
        for b in batches:
            if b.num_rows:
                age, number, cell, size = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
                data = np.stack([np.diff(age, prepend=0), age - number, age - cell, size]).astype("<i8")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([zlib.compress(data.tobytes(), 1)], pa.binary())], ["seq", "packed"])

    in_order = rows.select("seq", "age", "number", "cell", "raw_bytes").repartitionByRange("seq").sortWithinPartitions("seq")
    return in_order.mapInArrow(work, f"seq {kind}, packed binary")


def _unpacked(packed: bytes) -> list[list[int]]:
    step, number, cell, size = np.frombuffer(zlib.decompress(packed), "<i8").reshape(4, -1)
    age = np.cumsum(step)
    return [age.tolist(), (age - number).tolist(), (age - cell).tolist(), size.tolist()]


def _told(numbers: list[int], gone: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([gone] * len(numbers), pa.bool_())], ["number", "evicted"])

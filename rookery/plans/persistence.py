"""A store's life on disk: snapshots, the operation log in Parquet, checkpoints, recovery.

A store folder holds snapshots `snapshot-N` (live events in Parquet, by bucket of their route key, ordered by kind and time) and
batches: `log/batch-N`, operations (seq, op, id, raw), or `outcomes/batch-N`, what an insert did (seq, id, raw, outcome, replaced_id),
whose stored events are inserts and whose replaced ids are deletes. The snapshot of the highest number whose write is complete is the one that counts, so writing
a new one never harms the old. What is live is the snapshot without the cells and ids that later batches touch, and what those
batches leave: filters reach the snapshot's scan.

A batch's number belongs to the writer that could create its marker in `claims`; a stream's retry finds the number of its first try
in `keys`. A checkpoint covers the batches before the first number that is claimed and not yet written, so that no late
commit is lost; `release` gives up the number of a writer that died.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import route_key
from ..model import EVENT_COLUMNS, EVENT_SCHEMA
from ..operators.state import compacted, replay, slim, slim_outcomes
from ..sources.parse import parsed

#: Fixed numbers of the policy.
MIN_CHECKPOINT_BYTES, LIVE_FACTOR = 64 * 1024 * 1024, 2
OPS_SCHEMA = "seq bigint, op string, id string, raw string"
OUTCOME_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("id", "raw", "outcome", "replaced_id"))])
OUTCOME_COLUMNS = OUTCOME_SCHEMA.fieldNames()
#: Hexadecimal digits halve with this codec.
CODEC = "zstd"
#: Parts of a snapshot by route key, of which an insert reads those it touches.
BUCKETS = 16
SNAPSHOT_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_route", T.StringType()), T.StructField("bucket", T.IntegerType())])


class Folder:
    """The numbered entries of a store folder, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm.org.apache.hadoop.fs.Path

    def _fs(self, path: str):
        p = self._jvm(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self, below: str, pattern: str) -> list[int]:
        p, fs = self._fs(f"{self.path}{below}")
        if not fs.exists(p):
            return []
        names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
        done = [int(m[1]) for n, full in names if (m := re.fullmatch(pattern, n)) and fs.exists(self._jvm(f"{full}/_SUCCESS"))]
        return sorted(done)

    def names(self, below: str) -> list[str]:
        p, fs = self._fs(f"{self.path}{below}")
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def claims(self) -> list[int]:
        return sorted(int(n) for n in self.names("/claims") if n.isdigit())

    def claim(self, key: str | None = None) -> int:
        """A batch's number that no other writer gets, and with a key (writer-batch) the one that the key got before."""
        known = [int(m[1]) for n in self.names("/keys") if key and (m := re.fullmatch(re.escape(key) + r"=(\d+)", n))]
        if known:
            return max(known)
        number = max([*self.batches(), *self.snapshots(), *self.claims()], default=0) + 1
        while not self._created(f"/claims/{number}"):
            number += 1
        if key:
            self._created(f"/keys/{key}={number}")
            writer, _, at = key.rpartition("-")
            for n in self.names("/keys"):  # only a writer's last batch can be tried again
                if (m := re.fullmatch(re.escape(writer) + r"-(\d+)=\d+", n)) and int(m[1]) < int(at):
                    self.delete(f"/keys/{n}")
        return number

    def _created(self, below: str) -> bool:
        p, fs = self._fs(f"{self.path}{below}")
        return fs.createNewFile(p)

    def release(self, number: int) -> None:
        self.delete(f"/claims/{number}")

    def delete(self, below: str) -> None:
        p, fs = self._fs(f"{self.path}{below}")
        fs.delete(p, True)

    def snapshots(self) -> list[int]:
        return self.numbers("", r"snapshot-(\d+)")

    def logged(self) -> list[int]:
        return self.numbers("/log", r"batch-(\d+)")

    def batches(self) -> list[int]:
        return sorted({*self.logged(), *self.numbers("/outcomes", r"batch-(\d+)")})

    def empty(self) -> bool:
        return not self.batches() and not self.snapshots()


def append_ops(folder: Folder, ops: DataFrame, batch: int | None = None, key: str | None = None) -> int:
    """One commit of operations (seq, op, id, raw) under a number of its own, which it returns; a given number, or the same key again,
    takes its own place, so retries are safe."""
    if batch is None:
        batch = folder.claim(key)
    ops.select("seq", "op", "id", "raw").write.mode("overwrite").option("compression", CODEC).parquet(f"{folder.path}/log/batch-{batch}")
    return batch


def append_outcomes(folder: Folder, done: DataFrame) -> str:
    """One commit of an insert's outcomes under a number of its own; returns the path."""
    path = f"{folder.path}/outcomes/batch-{folder.claim()}"
    done.write.option("compression", CODEC).parquet(path)
    return path


def ops_of(log: DataFrame) -> DataFrame:
    """What the inserts of an arriving log write: an insert for each stored event and a delete of each event that it replaced. Both come
    from one pass over the outcomes."""
    none = F.lit(None).cast("string")
    op = lambda name, id_, raw: F.struct("seq", F.lit(name).alias("op"), id_.alias("id"), raw.alias("raw"))
    insert, gone = op("insert", F.col("id"), F.col("raw")), op("delete", F.col("replaced_id"), none)
    both = F.when(F.col("replaced_id").isNull(), F.array(insert)).otherwise(F.array(insert, gone))
    return slim_outcomes(slim(log)).where("outcome = 'stored'").select(F.inline(both))


def batch_ops(folder: Folder, number: int, logged: list[int]) -> DataFrame:
    """The operations of one batch; logged tells which numbers are in the log."""
    if number in logged:
        return folder.spark.read.schema(OPS_SCHEMA).parquet(f"{folder.path}/log/batch-{number}")
    done = folder.spark.read.schema(OUTCOME_SCHEMA).parquet(f"{folder.path}/outcomes/batch-{number}").where("outcome = 'stored'")
    inserts = done.select("seq", F.lit("insert").alias("op"), "id", "raw")
    return inserts.unionByName(done.where("replaced_id is not null").select("seq", F.lit("delete").alias("op"), F.col("replaced_id").alias("id"), F.lit(None).cast("string").alias("raw")))


def read_ops(folder: Folder) -> DataFrame:
    """(segment, pos, op, events' columns): the batches after the newest snapshot."""
    spark, parts = folder.spark, []
    after, logged = max(folder.snapshots(), default=-1), folder.logged()
    for n in folder.batches():
        if n > after:
            ops = batch_ops(folder, n, logged)
            # an insert and the delete of what it replaced share a seq; the delete comes second
            pos = F.col("seq") * 2 + (F.col("op") == "delete").cast("bigint")
            parts.append(ops.select(F.lit(n + 1).cast("bigint").alias("segment"), pos.alias("pos"), "op", F.col("id").alias("wanted"), "raw"))
    if not parts:
        return _operations(spark.createDataFrame([], "segment bigint, pos bigint, op string, wanted string, raw string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _operations(out)


def _operations(records: DataFrame) -> DataFrame:
    inserts = parsed(records.where("op = 'insert'").drop("wanted")).where("reason is null").drop("reason")
    deletes = records.where("op = 'delete'").select("segment", "pos", "op", F.col("wanted").alias("id"))
    return inserts.unionByName(deletes, allowMissingColumns=True)


def routed(events: DataFrame) -> DataFrame:
    """events with their route key and its bucket."""
    rows = events.withColumn("_route", route_key("id", "pubkey", "kind", "tags"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("_route"), F.lit(BUCKETS)).cast("int"))


def recover(folder: Folder, buckets: list[int] | None = None, upto: int | None = None) -> DataFrame:
    """Live events; seq is the order of recovery (segment, then place). With buckets only those of these buckets, with their
    route key; upto leaves out later batches."""
    spark, last = folder.spark, folder.snapshots()
    columns = EVENT_COLUMNS + ["_route"] * (buckets is not None)
    ops = read_ops(folder) if upto is None else read_ops(folder).where(F.col("segment") <= upto + 1)
    fresh = replay(ops).withColumn("seq", F.col("segment") * F.lit(1 << 44) + F.col("pos"))
    fresh = routed(fresh.select(*EVENT_COLUMNS))
    if buckets is not None:
        fresh = fresh.where(F.col("bucket").isin(buckets))
    if not last:
        return fresh.select(*columns)
    held = spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{folder.path}/snapshot-{last[-1]}")
    if buckets is not None:
        held = held.where(F.col("bucket").isin(buckets))
    if not any(n > last[-1] and (upto is None or n <= upto) for n in folder.batches()):
        return held.select(*columns)
    cells = ops.where("op = 'insert'").select(route_key("id", "pubkey", "kind", "tags").alias("_route")).distinct()
    held = held.join(cells, "_route", "left_anti").join(ops.where("op = 'delete'").select("id").distinct(), "id", "left_anti")
    return held.select(*columns).unionByName(fresh.select(*columns))


def write_snapshot(folder: Folder, live_events: DataFrame, number: int) -> str:
    """One raw event a line, for other programs; returns the path."""
    path = f"{folder.path}/lines-{number}"
    live_events.select("raw").write.mode("overwrite").text(path)
    return path


def checkpoint(folder: Folder) -> int:
    """Writes what is live as the snapshot of the newest batch that no open number precedes, then deletes what it covers; returns the
    snapshot's number."""
    done, old = folder.batches(), folder.snapshots()
    last = max(old, default=0)
    opened = min((n for n in folder.claims() if n > last and n not in done), default=None)
    covered = [n for n in done if opened is None or n < opened]
    number = max([last, *covered])
    if number not in old:
        rows = routed(recover(folder, upto=number)).repartitionByRange("bucket", "kind", "created_at").sortWithinPartitions("bucket", "kind", "created_at")
        rows.select(*EVENT_COLUMNS, "_route", "bucket").write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(f"{folder.path}/snapshot-{number}")
    for n in covered:
        folder.delete(f"/log/batch-{n}")
        folder.delete(f"/outcomes/batch-{n}")
        folder.delete(f"/claims/{n}")
    for n in old:
        if n < number:
            folder.delete(f"/snapshot-{n}")
    return number


def log_bytes(folder: Folder) -> int:
    last = max(folder.snapshots(), default=-1)
    logged = folder.logged()
    parts = [batch_ops(folder, n, logged) for n in folder.batches() if n > last]
    if not parts:
        return 0
    size = F.coalesce(F.octet_length("raw") + 5, F.lit(33))
    return reduce(DataFrame.unionByName, parts).agg(F.sum(size)).first()[0] or 0


def needs_checkpoint(pending: int, live_bytes: int) -> bool:
    return pending >= max(MIN_CHECKPOINT_BYTES, LIVE_FACTOR * live_bytes)


def maybe_checkpoint(folder: Folder) -> int | None:
    live_bytes = recover(folder).agg(F.sum("raw_bytes")).first()[0] or 0
    return checkpoint(folder) if needs_checkpoint(log_bytes(folder), live_bytes) else None


def truncate_log(folder: Folder) -> None:
    folder.delete("/log")
    folder.delete("/outcomes")


def compact_log(folder: Folder, live_ids: DataFrame) -> int:
    """Rewrites all batches as one that holds each live id's first insert; returns how many records that removed."""
    spark, batches = folder.spark, folder.batches()
    if not batches:
        return 0
    logged = folder.logged()
    parts = [batch_ops(folder, n, logged).select(F.lit(n).alias("segment"), F.col("seq").alias("pos"), "op", "id", "raw") for n in batches]
    ops = parts[0]
    for p in parts[1:]:
        ops = ops.unionByName(p)
    before = ops.count()
    number = append_ops(folder, compacted(ops, live_ids).withColumnRenamed("pos", "seq"))
    for n in batches:
        folder.delete(f"/log/batch-{n}")
        folder.delete(f"/outcomes/batch-{n}")
        folder.delete(f"/claims/{n}")
    return before - spark.read.parquet(f"{folder.path}/log/batch-{number}").count()

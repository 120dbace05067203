"""The store as one object: a folder on disk, its live events, and what can be asked of them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EVENT_COLUMNS
from ..operators import access, evict, query, state, stats
from ..sources.config import Config
from ..sources.filters import Filter
from ..sources.parse import parsed
from . import persistence


class EventStore:
    """Inserts are batches; each is one commit of the operation log. Reads see what the last commit left live."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.config = spark, config or Config()
        self.folder = persistence.Folder(spark, path)

    @property
    def live(self) -> DataFrame:
        return persistence.recover(self.folder)

    def insert(self, log: DataFrame) -> DataFrame:
        """Outcomes of a batch of events (seq orders them), after committing it; other columns of log are kept. Events go after the live
        ones. Only the buckets of the store that the batch touches are read, and of these only its cells.

        What is shuffled and written is slim: an event's text alone, which the other columns are read from again where they are asked for.
        The outcomes are the commit, so the text is written once."""
        more = [c for c in log.columns if c not in EVENT_COLUMNS]
        shift = F.lit(1 << 62)
        both = state.slim(log, *more).withColumn("seq", F.col("seq") + shift).withColumn("_new", F.lit(True))
        if not self.folder.empty():
            new = persistence.routed(log)
            buckets = [r.bucket for r in new.select("bucket").distinct().collect()]
            held = persistence.recover(self.folder, buckets).join(new.select("_route").distinct(), "_route", "left_semi")
            both = state.slim(held).withColumn("_new", F.lit(False)).unionByName(both, allowMissingColumns=True)
        done = state.slim_outcomes(both).where("_new").withColumn("seq", F.col("seq") - shift)
        path = persistence.append_outcomes(self.folder, done.select(*persistence.OUTCOME_COLUMNS, *more))
        done = self.spark.read.schema(T.StructType([*persistence.OUTCOME_SCHEMA.fields, *(log.schema[c] for c in more)])).parquet(path)
        rows = parsed(done.withColumnRenamed("id", "_known")).drop("id").withColumnRenamed("_known", "id")
        return rows.select(*EVENT_COLUMNS, *more, "outcome", "replaced_id")

    def delete(self, ids: DataFrame) -> None:
        ops = ids.select(F.lit(0).cast("bigint").alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("raw"))
        persistence.append_ops(self.folder, ops)

    def evict(self, log_path: str | None = None) -> int:
        """One round of the periodic check; returns how many events went. With the folder of a streamed log it is told there too, so that
        the stream forgets them."""
        gone = evict.evicted(self.live, self.config.max_bytes).select("id").collect()  # a round's batch, 1,000 or 5,000 ids at most
        if gone:
            ids = self.spark.createDataFrame(gone, "id string")
            if log_path:
                told = self.live.join(F.broadcast(ids), "id", "left_semi").select(*EVENT_COLUMNS, F.lit("delete").alias("op"))
                told.withColumn("seq", F.lit(0).cast("bigint")).write.mode("append").parquet(log_path)
            self.delete(ids)
        return len(gone)

    def get(self, id_: str) -> DataFrame:
        return access.by_id(self.live, id_)

    def query(self, f: Filter, mode: str = "strict") -> DataFrame:
        return query.query(self.live, f, mode)

    def request(self, filters: list[Filter], mode: str = "strict") -> DataFrame:
        return query.request(self.live, filters, mode)

    def stats(self) -> DataFrame:
        return stats.store_stats(self.live, self.config.max_bytes)

    def information(self) -> dict:
        """What a client may ask about the service."""
        limits = {"max_subscriptions": self.config.max_subscriptions, "max_limit": self.config.max_limit}
        return {"name": "rookery", "description": "Event store on Spark", "supported_nips": [1, 11], "limitation": limits}

    def save(self) -> int:
        return persistence.checkpoint(self.folder)

    def view(self, name: str = "events_live") -> None:
        """Makes the live events a view for Spark SQL."""
        self.live.createOrReplaceTempView(name)


class Keeper:
    """The store's periodic work. A stream calls `tick` after each commit: eviction comes sooner the fuller the store is, a checkpoint
    is considered every persistence interval."""

    def __init__(self, store: EventStore, log_path: str | None = None, clock=time.monotonic):
        self.store, self.log_path, self.clock = store, log_path, clock
        self.check_at = clock() + evict.interval_seconds(0, 0)
        self.save_at = clock() + store.config.persistence_interval

    def tick(self) -> dict:
        """What was due: how many events were evicted, and the checkpoint's number or None."""
        now, done = self.clock(), {}
        if now >= self.check_at:
            done["evicted"] = self.store.evict(self.log_path)
            used = self.store.live.agg(F.sum("raw_bytes")).first()[0] or 0
            self.check_at = now + evict.interval_seconds(used, self.store.config.max_bytes)
        if now >= self.save_at:
            done["checkpoint"] = persistence.maybe_checkpoint(self.store.folder)
            self.save_at = now + self.store.config.persistence_interval
        return done

"""Frames in, frames out: what a service answers to a batch of client frames.

Frames are rows (n, conn, frame): n orders them, conn is the connection. EVENT frames are verified, stored as one commit and
acknowledged; REQ and CLOSE frames change the table of subscriptions and get stored answers and the end mark; what cannot be
read gets a notice. Events that were stored or are ephemeral go to all subscriptions that match, the sender's own included.
A subscription is registered before its stored query runs, so an event at the border may come twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EVENT_COLUMNS, SUBSCRIPTION_SCHEMA
from ..operators import frames, query, subscribe
from ..sources import parse
from ..sources.filters import FilterError, parse_filter
from ..workdir import shared_folder
from .store import EventStore

_REPLY = "conn string, n bigint, part int, frame string"


class Session:
    """A store with its subscriptions."""

    def __init__(self, store: EventStore, verify: bool = True, mode: str = "strict"):
        self.store, self.verify, self.mode = store, verify, mode
        self._held: list[DataFrame] = []
        self.subscriptions = store.spark.createDataFrame([], SUBSCRIPTION_SCHEMA)

    def answer(self, incoming: DataFrame) -> DataFrame:
        """(conn, n, part, frame): replies to each frame; part 0 acknowledges or answers, 1 ends stored answers, 2 is live."""
        spark = self.store.spark
        read = incoming.select("n", "conn", frames.parse_message("frame").alias("m")).persist()
        replies = [read.where("m.error is not null").select("conn", "n", F.lit(0).alias("part"), frames.notice_frame(F.col("m.error")).alias("frame"))]
        replies += self._subscribe(read)
        events = read.where("m.type = 'EVENT'").select(F.col("n").alias("seq"), "conn", F.col("m.event").alias("raw"))
        checked = parse.parsed(events, check_id=self.verify, check_signature=self.verify).persist()
        self._held += [read, checked]
        said = F.coalesce(*(F.when(F.col("reason") == k, F.lit(v)) for k, v in parse.REASONS.items()))
        replies.append(checked.where("reason is not null").select("conn", F.col("seq").alias("n"), F.lit(0).alias("part"), frames.notice_frame(said).alias("frame")))
        good = checked.where("reason is null")
        if good.head(1):
            done = self.store.insert(good.select(*EVENT_COLUMNS, "conn"))
            replies.append(frames.ok_frames(done, "conn").select("conn", F.col("seq").alias("n"), F.lit(0).alias("part"), "frame"))
            if self.subscriptions.head(1):  # else there is nobody to send them to
                accepted = done.drop("conn").where("outcome <> 'duplicate'")
                hits = subscribe.matched(accepted, self.subscriptions).join(accepted.select("id", "seq", "raw"), "id")
                replies.append(hits.select("conn", F.col("seq").alias("n"), F.lit(2).alias("part"), frames.event_frame(F.col("sub_id"), F.col("raw")).alias("frame")))
        return reduce(DataFrame.unionByName, replies, spark.createDataFrame([], _REPLY))

    def release(self) -> None:
        """Forgets what the answers so far were made from; call it when they have been sent."""
        for df in self._held:
            df.unpersist()
        self._held = []

    def _subscribe(self, read: DataFrame) -> list[DataFrame]:
        """Applies REQ and CLOSE frames in order; they are few, so they are planned on the driver. Returns the replies."""
        spark, out = self.store.spark, []
        asked = read.where("m.type in ('REQ', 'CLOSE')").orderBy("n").collect()
        if not asked:
            return out
        for row in asked:
            if row.m.type == "CLOSE":
                self.subscriptions = subscribe.closed(self.subscriptions, row.conn, row.m.id)
                continue
            place = (F.lit(row.conn).alias("conn"), F.lit(row.n).cast("bigint").alias("n"))
            try:
                filters = [parse_filter(f) for f in row.m.filters]
            except FilterError as e:
                out.append(spark.range(1).select(*place, F.lit(0).alias("part"), frames.notice_frame(F.lit(f"Invalid filter: {e}")).alias("frame")))
                continue
            added = subscribe.subscriptions(spark, [(row.conn, row.m.id, filters)])
            self.subscriptions = subscribe.replaced_subscriptions(self.subscriptions, added)
            stored = query.request(self.store.live, filters, self.mode)
            out.append(stored.select(*place, F.lit(0).alias("part"), frames.event_frame(F.lit(row.m.id), F.col("raw")).alias("frame")))
            out.append(spark.range(1).select(*place, F.lit(1).alias("part"), frames.eose_frame(F.lit(row.m.id)).alias("frame")))
        self._settle()
        return out

    def _settle(self) -> None:
        """Writes the table of subscriptions, so that its plan does not grow with the frames that made it."""
        path = shared_folder(self.store.spark, "subscriptions")
        self.subscriptions.write.parquet(path)
        self.subscriptions = self.store.spark.read.schema(self.subscriptions.schema).parquet(path)

    def disconnect(self, conn: str) -> None:
        self.subscriptions = subscribe.closed(self.subscriptions, conn)

    def status_page(self) -> str:
        """A small HTML page of the store's figures."""
        row = self.store.stats().first()
        cells = {"Events": f"{row.events:,}", "Store": row.shown_bytes, "Capacity": row.shown_capacity}
        return "<!DOCTYPE html><title>rookery</title><dl>" + "".join(f"<dt>{k}</dt><dd>{v}</dd>" for k, v in cells.items()) + "</dl>"


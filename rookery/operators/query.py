"""Stored queries of filters.

strict: all conditions hold, newest first over the whole result, the limit last.
compat: the index-driven order of evaluation that clients of the original may rely on: an access path by fixed priority, each of its
values cut to the limit before the other conditions, some tag conditions not looked at, values in list order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.filters import Filter, hex_values
from .access import newest, tag_index
from .frames import eose_frame, event_frame
from .match import matches


def query(events: DataFrame, f: Filter, mode: str = "strict") -> DataFrame:
    """Events of one filter, in answer order. In compat mode a column pos holds the value's place on the access path."""
    if mode == "compat":
        return compat(events, f)
    if mode != "strict":
        raise ValueError(f"no such mode: {mode}")
    return newest(events.where(matches(f)), f.limit)


def access_path(f: Filter) -> tuple[str, list] | None:
    """(path, values in list order) that the compat evaluation starts from; None if nothing leads to events."""
    generic = sorted(k for k, v in f.tags.items() if k not in ("e", "p") and v)
    if f.ids:
        return "ids", list(f.ids)
    for letter in ("e", "p"):
        if f.tags.get(letter):
            return letter, list(hex_values(f.tags[letter]))
    if generic:  # the original takes any of them; here the smallest
        return generic[0], list(f.tags[generic[0]])
    if f.authors:
        return "authors", list(f.authors)
    if f.kinds:
        return "kinds", list(f.kinds)
    return None


def compat(events: DataFrame, f: Filter) -> DataFrame:
    path = access_path(f)
    if path is None or not path[1] or f.limit == 0:
        return events.limit(0).withColumn("pos", F.lit(0))
    name, values = path
    kind = "bigint" if name == "kinds" else "string"
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(v).cast(kind).alias("value")) for i, v in enumerate(values)])).alias("w")
    wanted = F.broadcast(events.sparkSession.range(1).select(wanted).select("w.*"))  # as many rows as the filter lists
    if name in ("ids", "authors", "kinds"):
        column = {"ids": "id", "authors": "pubkey", "kinds": "kind"}[name]
        found = events.where(F.col(column).isin(values)).join(wanted, F.col(column) == F.col("value")).drop("value")
    else:
        index = tag_index(events).where((F.col("letter") == name) & F.col("value").isin(values))
        hits = index.join(wanted, "value").select("id", "pos").distinct()
        found = events.join(hits, "id")
    if f.limit is not None and name != "ids":
        order = Window.partitionBy("pos").orderBy(F.desc("created_at"), F.asc("id"))
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= f.limit).drop("_n")
    generic = [k for k in f.tags if k not in ("e", "p")]
    if name == "ids":
        skip = set(f.tags)
    else:
        skip = {k for k in ("e", "p") if f.tags.get(k)} | set(generic if any(f.tags[k] for k in generic) else ())
    rest = Filter(None, f.authors, f.kinds, f.tags, f.since, f.until)
    kept = found.where(matches(rest, skip))
    first = Window.partitionBy("id").orderBy("pos")
    kept = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    kept = kept.orderBy("pos", F.desc("created_at"), F.asc("id"))
    return kept.limit(f.limit) if f.limit is not None else kept


def request(events: DataFrame, filters: list[Filter], mode: str = "strict") -> DataFrame:
    """The filters of one request, one after the other; an event that two filters match comes twice. filter_no counts from 0."""
    parts = [query(events, f, mode).withColumn("filter_no", F.lit(i)) for i, f in enumerate(filters)]
    if not parts:
        return events.limit(0).withColumn("filter_no", F.lit(0))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_eose(frames: DataFrame, sub_id: str) -> DataFrame:
    """Answer frames (raw) and the end-of-stored-events frame, ordered last by `last`."""
    end = frames.sparkSession.range(1).select(F.lit(True).alias("last"), eose_frame(F.lit(sub_id)).alias("frame"))
    return frames.select(F.lit(False).alias("last"), event_frame(F.lit(sub_id), F.col("raw")).alias("frame")).unionByName(end)

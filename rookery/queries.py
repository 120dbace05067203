"""Registered queries of the engine: each operator over the whole event log made of the table `events`."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .operators import access, evict, frames, match, query, state, stats, subscribe
from .plans import persistence
from .plans.session import Session
from .plans.store import EventStore
from .sources import adapter, parse, wal
from .sources.filters import Filter
from .streaming import live as streaming
from .workdir import shared_folder

EV = lambda n: hashlib.sha256(f"evt:{n}".encode()).hexdigest()
USR = lambda n: hashlib.sha256(f"usr:{n}".encode()).hexdigest()
#: Parameters of the queries; their SQL uses the same.
SINCE, UNTIL, LIMIT = 1704585600, 1705190400, 50
FILTERS = [
    Filter(kinds=(1, 7), since=SINCE),
    Filter(tags={"t": ("click", "view"), "p": (USR(3), USR(5))}, limit=LIMIT),
    Filter(authors=(USR(2), USR(3)), until=UNTIL, limit=LIMIT),
]
SUBSCRIPTIONS = [
    ("c1", "a", [Filter(kinds=(1,)), Filter(kinds=(1, 7), authors=(USR(3),))]),
    ("c1", "b", [Filter(ids=(EV(5), EV(6)))]),
    ("c2", "a", [Filter(tags={"t": ("error",), "d": ("7", "8")})]),
    ("c2", "c", [Filter(since=UNTIL)]),
    ("c3", "d", [Filter(kinds=())]),
]
MAX_BYTES = 2_000_000


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.event_log(spark, sf_dir)


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, and then all of it arriving again."""
    once = log(spark, sf_dir)
    n = once.count()
    return once.unionByName(once.withColumn("seq", F.col("seq") + n))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment 1: all events are inserted; segment 2: clicks and sign-ups are deleted."""
    events = log(spark, sf_dir)
    inserts = events.select(F.lit(1).alias("segment"), F.col("seq").alias("pos"), F.lit("insert").alias("op"), "*")
    gone = events.where(F.col("kind").isin(7, 10002))
    deletes = gone.select(F.lit(2).alias("segment"), F.col("seq").alias("pos"), F.lit("delete").alias("op"), "id")
    return inserts.unionByName(deletes, allowMissingColumns=True)


QUERIES: dict = {}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def listed(name: str, make):
    """A query that asks `make` of the log and returns plain columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(log(spark, sf_dir))

    run.__name__ = name
    return registered(run)


PLAIN = ("seq", "id", "pubkey", "created_at", "kind")
plain = lambda df, *more: df.select(*PLAIN, *more)

# Access.
listed("get_by_id", lambda e: access.by_id(e, EV(42)).select(*PLAIN, "raw"))
listed("by_kind", lambda e: plain(access.by_kind(e, 1, 20)))
listed("by_pubkey", lambda e: plain(access.by_pubkey(e, USR(3), LIMIT)))
listed("by_pubkey_since", lambda e: plain(access.by_pubkey_since(e, USR(3), SINCE, LIMIT)))
listed("by_e_tag", lambda e: plain(access.by_tag(e, access.tag_index(e), "e", EV(10).upper(), LIMIT)))
listed("by_p_tag", lambda e: plain(access.by_tag(e, access.tag_index(e), "p", USR(5), LIMIT)))
listed("by_tag_t", lambda e: plain(access.by_tag(e, access.tag_index(e), "t", "click", LIMIT)))
listed("by_tag_d", lambda e: plain(access.by_tag(e, access.tag_index(e), "d", "7")))
listed("oldest_n", lambda e: plain(access.oldest(e, LIMIT)))
listed("event_count", lambda e: access.totals(e).select("events"))
listed("memory_bytes", lambda e: access.totals(e).select("bytes"))
listed("all_ids", access.all_ids)
listed("full_scan", lambda e: plain(e, "raw"))
listed("tag_counts", lambda e: access.tag_index(e).groupBy("letter", "value").agg(F.count(F.lit(1)).alias("n")))


@registered
def contains_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(EV(3),), (EV(-1),), (EV(7),)], "id string")
    return access.contains(log(spark, sf_dir), ids)


# Predicates.
listed("kind_in", lambda e: plain(e.where(match.matches(Filter(kinds=(1, 10002))))))
listed("author_in", lambda e: plain(e.where(match.matches(Filter(authors=(USR(1), USR(4)))))))
listed("id_in", lambda e: plain(e.where(match.matches(Filter(ids=(EV(1), EV(2), EV(-5)))))))
listed("since_until", lambda e: plain(e.where(match.matches(Filter(since=SINCE, until=UNTIL)))))
listed("tag_exists", lambda e: plain(e.where(match.matches(Filter(tags={"t": ("view",), "d": ("1", "2", "3")})))))
listed("live_match", lambda e: plain(e.where(match.matches(FILTERS[1]))))
listed("live_match_empty", lambda e: plain(e.where(match.matches(Filter()))))
listed("hex_prefix", lambda e: plain(e.where(match.id_starts_with("00"))))
listed("kind_class", lambda e: e.select("seq", fn.kind_class("kind").alias("class")))

# Stored queries.
listed("filter_and_strict", lambda e: plain(query.query(e, FILTERS[1])))
listed("filter_multi_kind_strict", lambda e: plain(query.query(e, Filter(kinds=(7, 1), limit=LIMIT))))
listed("filter_multi_kind_compat", lambda e: plain(query.query(e, Filter(kinds=(7, 1), limit=LIMIT), "compat"), "pos"))
listed("filter_author_kind_limit_compat", lambda e: plain(query.query(e, Filter(authors=(USR(3), USR(2)), kinds=(1,), limit=LIMIT), "compat"), "pos"))
listed("filter_e_p_compat", lambda e: plain(query.query(e, Filter(tags={"e": (EV(10), EV(11), "nothex"), "p": (USR(3),)}), "compat"), "pos"))
listed("filter_generic_tags_compat", lambda e: plain(query.query(e, Filter(tags={"t": ("click",), "d": ("5",)}, kinds=(7, 1), limit=LIMIT), "compat"), "pos"))
listed("filter_ids_ignores_tags_compat", lambda e: plain(query.query(e, Filter(ids=(EV(9), EV(8)), tags={"t": ("none",)}), "compat"), "pos"))
listed("filter_empty", lambda e: plain(query.query(e, Filter(limit=LIMIT), "compat")))
listed("filter_time_only", lambda e: plain(query.query(e, Filter(since=SINCE), "compat")))
listed("filter_limit_zero", lambda e: plain(query.query(e, Filter(kinds=(1,), limit=0))))
listed("req_union_all", lambda e: plain(query.request(e, FILTERS), "filter_no"))
listed("req_with_eose", lambda e: query.with_eose(query.query(e, FILTERS[2]), 'su"b').select("last", "frame"))


@registered
def subs_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribe.matched(log(spark, sf_dir), subscribe.subscriptions(spark, SUBSCRIPTIONS))


@registered
def subs_stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subscribe.stored_answers(log(spark, sf_dir), SUBSCRIPTIONS)


# State.
KEY = ("seq", "id", "outcome", "replaced_id")
listed("insert_outcomes", lambda e: state.outcomes(e).select(*KEY))
listed("live_state", lambda e: plain(state.live(e)))
listed("replaced_events", state.replaced)
listed("insert_counts", state.insert_counts)
listed("ok_messages", lambda e: frames.ok_frames(state.outcomes(e)))
listed("replacement_key", lambda e: e.select("seq", fn.replacement_key("pubkey", "kind", "tags").alias("k")).select("seq", F.col("k").isNotNull().alias("replaceable"), F.col("k.d").alias("d")))
listed("d_tag", lambda e: e.select("seq", fn.d_tag("kind", "tags").alias("d")))
listed("e_tags", lambda e: e.select("seq", F.array_join(fn.hex_tag_values("tags", "e"), ",").alias("values")))
listed("p_tags", lambda e: e.select("seq", F.array_join(fn.hex_tag_values("tags", "p"), ",").alias("values")))
listed("anti_join_new", lambda e: plain(state.new_events(state.live(e), e)))
listed("remove_events", lambda e: plain(state.removed(e, e.where(fn.is_ephemeral("kind")).select("id"))))


@registered
def lookback_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.outcomes(twice(spark, sf_dir)).select(*KEY)


@registered
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.replay(operations(spark, sf_dir)).select(*PLAIN)


@registered
def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.replay_counts(operations(spark, sf_dir))


@registered
def compact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    return state.compacted(ops, state.replay(ops).select("id")).select("segment", "pos", "op", "id")


listed("evict_target", lambda e: evict.evicted(e, MAX_BYTES).select("id", "raw_bytes", "chunk"))
listed("evict_chunks", lambda e: evict.chunks(e, evict.BATCH).select("id", "chunk", "bytes_before"))
listed("load_eviction", lambda e: evict.load_eviction(e, MAX_BYTES))

# Frames, parsing, hashes.
listed("event_frames", lambda e: e.select("seq", frames.event_frame(F.lit('a"b'), F.col("raw")).alias("frame")))
listed("event_id_hash", lambda e: e.select("seq", fn.event_id("pubkey", "created_at", "kind", F.transform("tags", lambda t: F.concat(F.array(t["name"]), t["values"])), "content").alias("hash")))
listed("object_size", lambda e: e.select("seq", fn.approximate_size("raw", "content", "tags").alias("size")))

#: How parse_errors spoils the events of each kind: (kind, SQL over raw, the reason).
SPOILT = [
    (7, "substring(raw, 1, 50)", "json"),
    (10002, "replace(raw, '{\"id\":\"', '{\"id\":\"zz')", "id"),
    (20001, "replace(raw, '\"kind\":', '\"kind\":1.5,\"x\":')", "json"),
    (30023, "replace(raw, '\"sig\":\"', '\"sig\":\"0')", "sig"),
]


@registered
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    for kind, spoilt, _ in SPOILT:
        raw = F.when(F.col("kind") == kind, F.expr(spoilt)).otherwise(raw)
    return parse.parsed(log(spark, sf_dir).select("seq", raw.alias("raw"))).select("seq", "reason", "id")


@registered
def parse_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's ids are no hashes of their events, so checking them rejects each."""
    return parse.parsed(log(spark, sf_dir).select("seq", "raw"), check_id=True).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@registered
def parse_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the log, events of even seq get the id that their fields have; the others keep the adapter's, which is none."""
    events = log(spark, sf_dir)
    wire = F.transform("tags", lambda t: F.concat(F.array(t["name"]), t["values"]))
    named = F.concat(F.lit('{"id":"'), fn.event_id("pubkey", "created_at", "kind", wire, "content"), F.substring("raw", 72, 1 << 30))
    lines = events.select("seq", F.when(F.col("seq") % 2 == 0, named).otherwise(F.col("raw")).alias("raw"))
    return parse.parsed(lines, check_id=True).select("seq", "reason", "id")


MESSAGES = [
    ('["EVENT",{"id":"x"}]', "EVENT", None), ('["REQ","s",{"kinds":[1]},{}]', "REQ", None), ('["CLOSE","s"]', "CLOSE", None), ('["EOSE","s"]', "EOSE", None),
    ('["NOTICE","hi"]', "NOTICE", None), ('["OK","id",true,"fine"]', "OK", None), ("nonsense", None, "JSON parse error"), ("{}", None, "Expected JSON array"), ("[]", None, "Empty array"),
    ("[1]", None, "Invalid message type"), ('["EVENT"]', None, "Missing event data"), ('["REQ","s"]', None, "Missing filters"), ('["REQ",1,{}]', None, "Missing subscription ID"),
    ('["CLOSE"]', None, "Missing subscription ID"), ('["CLOSE",1]', None, "Invalid subscription ID"), ('["EOSE"]', None, "Missing EOSE id"), ('["NOTICE",1]', None, "Invalid notice message"),
    ('["OK","i",1,"x"]', None, "Invalid OK accepted field"), ('["OK","i",true,1]', None, "Invalid OK message"), ('["COUNT"]', None, "Unknown message type: COUNT"),
]


@registered
def parse_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(m[0],) for m in MESSAGES], "frame string").select("frame", frames.parse_message("frame").alias("m"))
    return rows.select("frame", "m.type", "m.error")


@registered
def verify_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opt-in verification, over the published test vector and a changed message (the log's own signatures are empty)."""
    public = "f9308a019258c31049344f85f89d5229b531c845836f99b08601f113bce036f9"
    sig = "e907831f80848d1069a5371b402410364bdf1c5f8307b0084c55f1ce2dca821525f66a4a85ea8b71e482a74f382d2ce5ebeee8fdb2172f477df4900d310536c0"
    rows = [("vector", public, "00" * 32, sig), ("changed", public, "01" * 32, sig), ("malformed", "zz", "", None)]
    made = spark.createDataFrame(rows, "name string, pubkey string, id string, sig string")
    return made.select("name", fn.verify_signature("pubkey", "id", "sig").alias("valid"))


# Storage.
@registered
def wal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = log(spark, sf_dir).select("seq", F.lit("insert").alias("op"), "id", "raw")
    records = wal.decoded(wal.encoded(events))
    return wal.operations(records).select("op", *PLAIN[1:])


@registered
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = persistence.Folder(spark, shared_folder(spark, "snapshot"))
    path = persistence.write_snapshot(folder, log(spark, sf_dir), 1)
    return parse.events_of(parse.read_jsonl(spark, path)).select(*PLAIN[1:], "raw")


@registered
def checkpoint_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is logged, half of it checkpointed, and recovered."""
    folder = persistence.Folder(spark, shared_folder(spark, "store"))
    events = log(spark, sf_dir)
    middle = events.agg(F.max("seq")).first()[0] // 2
    persistence.append_ops(folder, persistence.ops_of(events.where(F.col("seq") <= middle)), 1)  # what comes later changes no earlier outcome
    persistence.checkpoint(folder)
    persistence.append_ops(folder, persistence.ops_of(events).where(F.col("seq") > middle), 2)
    return persistence.recover(folder).select(*PLAIN[1:])


def _half_stored(spark: SparkSession, sf_dir: str) -> tuple[EventStore, int]:
    """A store that holds the first half of the log, as a snapshot, and the last seq of that half."""
    events, store = log(spark, sf_dir), EventStore(spark, shared_folder(spark, "store"))
    middle = events.agg(F.max("seq")).first()[0] // 2
    store.insert(events.where(F.col("seq") <= middle))
    store.save()
    return store, middle


@registered
def store_stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the log is in the store; a stream commits the other half; what is live is recovered."""
    store, middle = _half_stored(spark, sf_dir)
    path = _arrived(spark, log(spark, sf_dir).where(F.col("seq") > middle))
    subs = subscribe.subscriptions(spark, SUBSCRIPTIONS)
    streaming.run(spark, path, store.folder, subs, lambda hits, held, n: None, shared_folder(spark, "state")).awaitTermination()
    return store.live.select(*PLAIN[1:])


# Figures.
listed("kind_topk", lambda e: stats.kind_counts(e, 5))
listed("author_rank_sample", stats.author_rank_sample)
listed("median_created_at", stats.median_created_at)
listed("counters", lambda e: stats.counters(state.outcomes(e)))
listed("stats_row", lambda e: stats.store_stats(e, MAX_BYTES))


@registered
def histogram_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return stats.histogram(events, "value", stats.HISTOGRAMS["time_to_eose_seconds"])


@registered
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runs = events.select(F.col("event_type").alias("name"), F.col("value").alias("seconds"), F.lit(1).alias("events"), F.octet_length("props").alias("bytes"))
    done = stats.latency_summary(runs)
    return done.select("name", "rounds", F.round("avg_seconds", 6).alias("avg_seconds"), "avg_events", F.round("mb_per_second", 9).alias("mb_per_second"))


# Streams, each run until its input is used up.
def _arrived(spark: SparkSession, events: DataFrame) -> str:
    """A folder with these events, as files of the order of arrival; their number follows the log's size."""
    path = shared_folder(spark, "log")
    events.repartitionByRange("seq").write.parquet(path)
    return path


def _streamed(spark: SparkSession, sf_dir: str):
    path = _arrived(spark, log(spark, sf_dir))
    return path, streaming.read_log_stream(spark, path)


@registered
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, arriving = _streamed(spark, sf_dir)
    out = shared_folder(spark, "outcomes")
    done = streaming.outcome_stream(arriving).writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, "state"))
    done.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq long, id string, outcome string, replaced_id string").parquet(out).select(*KEY)


@registered
def stream_after_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the log's second half as a stream whose state begins with what the first half left in a store."""
    store, middle = _half_stored(spark, sf_dir)
    path, out = _arrived(spark, log(spark, sf_dir).where(F.col("seq") > middle)), shared_folder(spark, "outcomes")
    done = streaming.outcome_stream(streaming.read_log_stream(spark, path), store.live).writeStream.format("parquet").option("path", out)
    done.option("checkpointLocation", shared_folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq long, id string, outcome string, replaced_id string").parquet(out).select(*KEY)


@registered
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives as a frame; the acknowledgements."""
    path, out = shared_folder(spark, "frames"), shared_folder(spark, "replies")
    event = F.concat(F.lit('["EVENT",'), "raw", F.lit("]")).alias("frame")
    log(spark, sf_dir).select(F.col("seq").alias("n"), F.lit("c").alias("conn"), event).write.option("compression", "gzip").option("maxRecordsPerFile", 50_000).json(path)  # files do not split
    session = Session(EventStore(spark, shared_folder(spark, "store")), verify=False)
    sink = lambda replies, number: replies.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")
    streaming.answer_frames(session, path, sink, shared_folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out).where("part = 0").select(F.col("n").alias("seq"), "frame")


@registered
def stream_live_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, arriving = _streamed(spark, sf_dir)
    out = shared_folder(spark, "matches")
    sink = lambda frame, number: frame.write.mode("overwrite").parquet(f"{out}/batch={number}")
    streaming.match_stream(arriving, subscribe.subscriptions(spark, SUBSCRIPTIONS), sink, shared_folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("conn", "sub_id", "id")

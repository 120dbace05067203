"""DuckDB SQL of the registered queries, written from the semantics, over the table `events` alone."""

from __future__ import annotations

from .operators.stats import HISTOGRAMS
from .queries import EV, FILTERS, LIMIT, MAX_BYTES, MESSAGES, SINCE, SPOILT, SUBSCRIPTIONS, UNTIL, USR

_RAW = (
    "'{\"id\":\"' || id || '\",\"pubkey\":\"' || pubkey || '\",\"created_at\":' || created_at || ',\"kind\":' || kind || ',\"tags\":' || wire || "
    "',\"content\":\"\",\"sig\":\"' || repeat('0', 128) || '\"}'"
)
_WIRE = "'[[\"e\",\"' || e || '\"],[\"p\",\"' || p || '\"],[\"t\",\"' || t || '\"],[\"d\",\"' || d || '\"]]'"
BASE = f"""
base AS (SELECT CAST(event_id AS BIGINT) AS seq, sha256('evt:' || event_id) AS id, sha256('usr:' || user_id) AS pubkey,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS created_at,
    CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'signup' THEN 10002 WHEN 'error' THEN 20001 WHEN 'purchase' THEN 30023 ELSE 0 END AS BIGINT) AS kind,
    sha256('evt:' || greatest(event_id - 1, 0)) AS e, sha256('usr:' || (user_id * 7 % (SELECT count(DISTINCT user_id) FROM events))) AS p,
    event_type AS t, regexp_extract(props, '"k": *([0-9]+)', 1) AS d FROM events),
wired AS (SELECT *, {_WIRE} AS wire FROM base),
ev AS (SELECT *, {_RAW} AS raw, CAST(strlen({_RAW}) AS BIGINT) AS raw_bytes,
    CASE WHEN kind BETWEEN 10000 AND 19999 THEN 'r' || pubkey || kind WHEN kind BETWEEN 30000 AND 39999 THEN 'a' || pubkey || kind || ':' || d ELSE 'i' || id END AS cell,
    kind BETWEEN 20000 AND 29999 AS ephemeral, kind BETWEEN 10000 AND 19999 OR kind BETWEEN 30000 AND 39999 AS replaceable FROM wired)"""
PLAIN = "seq, id, pubkey, created_at, kind"
NEWEST = "ORDER BY created_at DESC, id"


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([BASE.strip(), *(c.strip() for c in ctes)]) + " " + body


def _plain(where: str, tail: str = "", more: str = "") -> str:
    return _sql(f"SELECT {PLAIN}{more} FROM ev WHERE {where} {tail}")


def _in(column: str, values) -> str:
    shown = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"{column} IN ({shown})" if shown else "false"


def _where(f) -> str:
    parts = ["true"]
    for column, values in (("id", f.ids), ("kind", f.kinds), ("pubkey", f.authors)):
        if values is not None:
            parts.append(_in(column, values))
    parts += [_in({"e": "e", "p": "p", "t": "t", "d": "d"}[k], v) for k, v in f.tags.items()]
    if f.since is not None:
        parts.append(f"created_at >= {f.since}")
    if f.until is not None:
        parts.append(f"created_at <= {f.until}")
    return " AND ".join(parts)


def _compat(column: str, values, limit: int | None, rest: str = "true") -> str:
    """The first `limit` of each value in list order, then the other conditions, the first place of each id, the limit."""
    wanted = ", ".join(f"({i}, {v!r})" for i, v in enumerate(values))
    cut = f"QUALIFY row_number() OVER (PARTITION BY pos ORDER BY created_at DESC, id) <= {limit}" if limit is not None else ""
    last = f"LIMIT {limit}" if limit is not None else ""
    return _sql(
        f"SELECT {PLAIN}, pos FROM once ORDER BY pos, created_at DESC, id {last}",
        f"wanted(pos, value) AS (VALUES {wanted})",
        f"cand AS (SELECT ev.*, pos FROM ev JOIN wanted ON {column} = value {cut})",
        f"once AS (SELECT * FROM cand WHERE {rest} QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1)",
    )


_DONE = """
done AS (SELECT *, CASE WHEN ephemeral THEN 'ephemeral' WHEN id = before THEN 'duplicate' ELSE 'stored' END AS outcome,
    CASE WHEN replaceable AND id <> before THEN before END AS replaced_id
    FROM (SELECT *, CASE WHEN NOT ephemeral THEN lag(id) OVER (PARTITION BY cell, ephemeral ORDER BY seq) END AS before FROM arrivals))"""
_ONCE = "arrivals AS (SELECT * FROM ev)"
_TWICE = "arrivals AS (SELECT * FROM ev UNION ALL SELECT * REPLACE (seq + (SELECT count(*) FROM ev) AS seq) FROM ev)"
_LIVE = "live AS (SELECT * FROM done WHERE outcome = 'stored' QUALIFY row_number() OVER (PARTITION BY cell ORDER BY seq DESC) = 1)"
_REPLAYED = """live AS (SELECT * FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY cell ORDER BY seq DESC) = 1) WHERE kind NOT IN (7, 10002))"""
KEY = "seq, id, outcome, replaced_id"
_INDEX = "tags AS (SELECT seq, id, unnest(['e', 'p', 't', 'd']) AS letter, unnest([e, p, t, d]) AS value FROM ev)"
_OLD = "ORDER BY created_at, id DESC"
_CHUNKS = f"""
batch AS (SELECT id, created_at, raw_bytes, CAST((row_number() OVER ({_OLD}) - 1) // 100 AS BIGINT) AS chunk FROM ev {_OLD} LIMIT 1000),
sums AS (SELECT chunk, coalesce(sum(sum(raw_bytes)) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before FROM batch GROUP BY chunk)"""


def _subscribed() -> str:
    parts = [f"SELECT '{c}' AS conn, '{s}' AS sub_id, id FROM ev WHERE {_where(f)}" for c, s, filters in SUBSCRIPTIONS for f in filters]
    return _sql(" UNION ".join(parts))


def _answers() -> str:
    parts = [f"SELECT '{c}' AS conn, '{s}' AS sub_id, CAST({i} AS INTEGER) AS filter_no, id FROM ev WHERE {_where(f)}" for c, s, filters in SUBSCRIPTIONS for i, f in enumerate(filters)]
    return _sql(" UNION ALL ".join(parts))


def _request() -> str:
    parts = []
    for i, f in enumerate(FILTERS):
        limit = f"LIMIT {f.limit}" if f.limit is not None else ""
        parts.append(f"(SELECT {PLAIN}, CAST({i} AS INTEGER) AS filter_no FROM ev WHERE {_where(f)} {NEWEST} {limit})")
    return _sql(" UNION ALL ".join(parts))


def _histogram() -> str:
    rows = [f"SELECT '{repr(e).removesuffix('.0')}' AS le, count(*) FILTER (value <= {e!r}) AS n FROM events" for e in HISTOGRAMS["time_to_eose_seconds"]]
    return " UNION ALL ".join([*rows, "SELECT '+Inf' AS le, count(value) AS n FROM events"])


def _spoilt() -> str:
    reason = "CASE kind " + " ".join(f"WHEN {k} THEN '{r}'" for k, _, r in SPOILT) + " END"
    return _sql(f"SELECT seq, {reason} AS reason, CASE WHEN {reason} IS NULL THEN id END AS id FROM ev")


def _messages() -> str:
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({text(m)}, CAST({text(t)} AS VARCHAR), CAST({text(e)} AS VARCHAR))" for m, t, e in MESSAGES) + ") AS m(frame, type, error)"


_F2 = FILTERS[2]
ORACLE_SQL = {
    "get_by_id": _plain(f"id = '{EV(42)}'", more=", raw"),
    "contains_id": _sql(f"SELECT w AS id, w IN (SELECT id FROM ev) AS found FROM (SELECT unnest(['{EV(3)}', '{EV(-1)}', '{EV(7)}']) AS w)"),
    "by_kind": _plain("kind = 1", f"{NEWEST} LIMIT 20"),
    "by_pubkey": _plain(f"pubkey = '{USR(3)}'", f"{NEWEST} LIMIT {LIMIT}"),
    "by_pubkey_since": _plain(f"pubkey = '{USR(3)}' AND created_at >= {SINCE}", f"{NEWEST} LIMIT {LIMIT}"),
    "by_e_tag": _plain(f"e = '{EV(10)}'", f"{NEWEST} LIMIT {LIMIT}"),
    "by_p_tag": _plain(f"p = '{USR(5)}'", f"{NEWEST} LIMIT {LIMIT}"),
    "by_tag_t": _plain("t = 'click'", f"{NEWEST} LIMIT {LIMIT}"),
    "by_tag_d": _plain("d = '7'"),
    "oldest_n": _plain("true", f"{_OLD} LIMIT {LIMIT}"),
    "event_count": "SELECT count(*) AS events FROM events",
    "memory_bytes": _sql("SELECT CAST(coalesce(sum(raw_bytes), 0) AS BIGINT) AS bytes FROM ev"),
    "all_ids": _sql("SELECT DISTINCT id FROM ev"),
    "full_scan": _plain("true", more=", raw"),
    "tag_counts": _sql("SELECT letter, value, count(*) AS n FROM tags GROUP BY ALL", _INDEX),
    "kind_in": _plain("kind IN (1, 10002)"),
    "author_in": _plain(_in("pubkey", [USR(1), USR(4)])),
    "id_in": _plain(_in("id", [EV(1), EV(2), EV(-5)])),
    "since_until": _plain(f"created_at BETWEEN {SINCE} AND {UNTIL}"),
    "tag_exists": _plain("t = 'view' AND d IN ('1', '2', '3')"),
    "live_match": _plain(_where(FILTERS[1])),
    "live_match_empty": _plain("true"),
    "hex_prefix": _plain("starts_with(id, '00')"),
    "kind_class": _sql(
        "SELECT seq, CASE WHEN kind BETWEEN 20000 AND 29999 THEN 'ephemeral' WHEN kind BETWEEN 30000 AND 39999 THEN 'addressable'"
        " WHEN kind BETWEEN 10000 AND 19999 THEN 'replaceable' ELSE 'regular' END AS class FROM ev"
    ),
    "filter_and_strict": _plain(_where(FILTERS[1]), f"{NEWEST} LIMIT {LIMIT}"),
    "filter_multi_kind_strict": _plain("kind IN (7, 1)", f"{NEWEST} LIMIT {LIMIT}"),
    "filter_multi_kind_compat": _compat("kind", [7, 1], LIMIT),
    "filter_author_kind_limit_compat": _compat("pubkey", [USR(3), USR(2)], LIMIT, "kind IN (1)"),
    "filter_e_p_compat": _compat("e", [EV(10), EV(11)], None),
    "filter_generic_tags_compat": _compat("d", ["5"], LIMIT, "kind IN (7, 1)"),
    "filter_ids_ignores_tags_compat": _compat("id", [EV(9), EV(8)], None),
    "filter_empty": _plain("false"),
    "filter_time_only": _plain("false"),
    "filter_limit_zero": _plain("false"),
    "req_union_all": _request(),
    "req_with_eose": _sql(
        f"SELECT false AS last, '[\"EVENT\",\"su\\\"b\",' || raw || ']' AS frame FROM (SELECT raw FROM ev WHERE {_where(_F2)} {NEWEST} LIMIT {_F2.limit})"
        " UNION ALL SELECT true, '[\"EOSE\",\"su\\\"b\"]'"
    ),
    "subs_match_all": _subscribed(),
    "subs_stored_answers": _answers(),
    "insert_outcomes": _sql(f"SELECT {KEY} FROM done", _ONCE, _DONE),
    "live_state": _sql(f"SELECT {PLAIN} FROM live", _ONCE, _DONE, _LIVE),
    "replaced_events": _sql("SELECT seq, id, replaced_id FROM done WHERE replaced_id IS NOT NULL", _ONCE, _DONE),
    "insert_counts": _sql(
        "SELECT count(*) FILTER (outcome = 'stored') AS inserted, count(*) FILTER (outcome = 'duplicate') AS duplicates,"
        " count(*) FILTER (outcome = 'ephemeral') AS ephemerals, count(replaced_id) AS replaced FROM done",
        _ONCE, _DONE,
    ),
    "ok_messages": _sql(
        "SELECT seq, '[\"OK\",\"' || id || '\",true,\"' || CASE outcome WHEN 'ephemeral' THEN 'ephemeral: will not be stored'"
        " WHEN 'duplicate' THEN 'duplicate: already have this event' ELSE '' END || '\"]' AS frame FROM done",
        _ONCE, _DONE,
    ),
    "replacement_key": _sql("SELECT seq, replaceable, CASE WHEN kind BETWEEN 30000 AND 39999 THEN d END AS d FROM ev"),
    "d_tag": _sql("SELECT seq, CASE WHEN kind BETWEEN 30000 AND 39999 THEN d END AS d FROM ev"),
    "e_tags": _sql('SELECT seq, e AS "values" FROM ev'),
    "p_tags": _sql('SELECT seq, p AS "values" FROM ev'),
    "anti_join_new": _sql(f"SELECT {PLAIN} FROM ev WHERE id NOT IN (SELECT id FROM live)", _ONCE, _DONE, _LIVE),
    "remove_events": _plain("NOT ephemeral"),
    "lookback_duplicates": _sql(f"SELECT {KEY} FROM done", _TWICE, _DONE),
    "replay_log": _sql(f"SELECT {PLAIN} FROM live", _REPLAYED),
    "replay_counts": _sql("SELECT count(*) + count(*) FILTER (kind IN (7, 10002)) AS applied, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS evicted FROM ev"),
    "compact_log": _sql("SELECT CAST(1 AS INTEGER) AS segment, seq AS pos, 'insert' AS op, id FROM live", _REPLAYED),
    "evict_target": _sql(
        f"SELECT id, raw_bytes, batch.chunk FROM batch JOIN sums USING (chunk) WHERE (SELECT sum(raw_bytes) FROM ev) - bytes_before > {MAX_BYTES * 50 // 100}", _CHUNKS
    ),
    "evict_chunks": _sql("SELECT id, batch.chunk, CAST(bytes_before AS BIGINT) AS bytes_before FROM batch JOIN sums USING (chunk)", _CHUNKS),
    "event_frames": _sql("SELECT seq, '[\"EVENT\",\"a\\\"b\",' || raw || ']' AS frame FROM ev"),
    "event_id_hash": _sql("SELECT seq, sha256('[0,\"' || pubkey || '\",' || created_at || ',' || kind || ',' || wire || ',\"\"]') AS hash FROM ev"),
    "object_size": _sql("SELECT seq, CAST(256 + raw_bytes + 4 + strlen(e) + strlen(p) + strlen(t) + strlen(d) AS BIGINT) AS size FROM ev"),
    "parse_errors": _spoilt(),
    "parse_checked": "SELECT 'mismatch' AS reason, count(*) AS n FROM events",
    "parse_messages": _messages(),
    "parse_verified": _sql(
        "SELECT seq, CASE WHEN seq % 2 = 0 THEN NULL ELSE 'mismatch' END AS reason, CASE WHEN seq % 2 = 0 THEN "
        "sha256('[0,\"' || pubkey || '\",' || created_at || ',' || kind || ',' || wire || ',\"\"]') END AS id FROM ev"
    ),
    "verify_sig": "SELECT * FROM (VALUES ('vector', true), ('changed', false), ('malformed', false)) t(name, valid)",
    "counters": _sql(
        "SELECT u.name, u.value FROM (SELECT count(*) FILTER (outcome = 'stored') AS s, count(*) FILTER (outcome = 'duplicate') AS d, "
        "count(*) FILTER (outcome = 'ephemeral') AS e, count(replaced_id) AS r FROM done), "
        "LATERAL (VALUES ('events_saved_total', s), ('events_duplicate_total', d), ('events_ephemeral_total', e), ('events_replaced_total', r)) u(name, value)",
        _ONCE,
        _DONE,
    ),
    "store_stream_recovery": _sql("SELECT id, pubkey, created_at, kind FROM live", _ONCE, _DONE, _LIVE),
    "stream_after_store": _sql(f"SELECT {KEY} FROM done WHERE seq > (SELECT max(seq) // 2 FROM ev)", _ONCE, _DONE),
    "wal_decode": _sql("SELECT 'insert' AS op, id, pubkey, created_at, kind FROM ev"),
    "snapshot_roundtrip": _sql("SELECT id, pubkey, created_at, kind, raw FROM ev"),
    "checkpoint_recovery": _sql("SELECT id, pubkey, created_at, kind FROM live", _ONCE, _DONE, _LIVE),
    "kind_topk": _sql("SELECT kind, count(*) AS n FROM ev GROUP BY kind ORDER BY n DESC, kind LIMIT 5"),
    "author_rank_sample": _sql(
        "SELECT CAST(rank AS BIGINT) AS rank, pubkey, n FROM ranked, (SELECT count(*) AS m FROM ranked) WHERE rank IN (m // 10, m // 4, m // 2, m * 3 // 4, m - 1)",
        "ranked AS (SELECT pubkey, count(*) AS n, row_number() OVER (ORDER BY count(*), pubkey) - 1 AS rank FROM ev GROUP BY pubkey)",
    ),
    "median_created_at": _sql("SELECT created_at AS median_created_at FROM ev ORDER BY created_at LIMIT 1 OFFSET (SELECT count(*) // 2 FROM ev)"),
    "stats_row": _sql(
        f"SELECT *, store_bytes AS memory_used, printf('%.1f', store_bytes / power(1024, u)) || ' ' || ['B', 'KB', 'MB', 'GB'][CAST(u AS INTEGER) + 1] AS shown_bytes,"
        f" CAST(floor(store_bytes * 100 / {MAX_BYTES} + 0.5) AS BIGINT) || '%' AS shown_capacity FROM row",
        f"row AS (SELECT count(*) AS events, CAST(sum(raw_bytes) AS BIGINT) AS store_bytes, CAST({MAX_BYTES} AS BIGINT) AS max_bytes, CAST(0 AS BIGINT) AS process_memory,"
        f" CAST({MAX_BYTES} AS BIGINT) AS memory_limit, least(3, floor(log2(sum(raw_bytes)) / 10)) AS u FROM ev)",
    ).replace("SELECT *, store_bytes", "SELECT * EXCLUDE (u), store_bytes"),
    "histogram_value": _histogram(),
    "latency_summary": (
        "SELECT event_type AS name, count(*) AS rounds, round(avg(value), 6) AS avg_seconds, CAST(1 AS DOUBLE) AS avg_events,"
        " round(sum(strlen(props)) / sum(value) / 1e6, 9) AS mb_per_second FROM events GROUP BY event_type"
    ),
    "stream_outcomes": _sql(f"SELECT {KEY} FROM done", _ONCE, _DONE),
    "stream_live_match": _subscribed(),
}
ORACLE_SQL["stream_frames"] = ORACLE_SQL["ok_messages"]

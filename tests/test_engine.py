"""The engine against a small model in plain Python, one test for each odd behaviour."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from rookery import functions as fn
from rookery.functions.hashing import canonical, fold128
from rookery.functions.signatures import sign, verify
from rookery.model import EVENT_COLUMNS, EVENT_SCHEMA
from rookery.operators import access, evict, frames, match, query, state, stats, subscribe
from rookery.plans.persistence import Folder, append_ops, checkpoint, compact_log, log_bytes, needs_checkpoint, ops_of, recover
from rookery.plans.store import EventStore
from rookery.sources import config, parse, wal
from rookery.sources.filters import Filter, FilterError, hex_values, parse_filter
from rookery.streaming import live as streaming

pad = lambda n: f"{n:064x}"


def event(n, author=1, kind=1, at=1000, tags=(), content="test", seq=None):
    wire = [list(t) for t in tags]
    raw = json.dumps({"id": pad(n), "pubkey": pad(author), "created_at": at, "kind": kind, "tags": wire, "content": content, "sig": "0" * 128}, ensure_ascii=False, separators=(",", ":"))
    return (seq if seq is not None else n, pad(n), pad(author), at, kind, [(t[0], t[1:]) for t in wire if t], content, "0" * 128, raw, len(raw.encode()))


def table(spark, rows):
    return spark.createDataFrame([r if r[0] is not None else r for r in rows], EVENT_SCHEMA)


def ids(df):
    return [int(r.id, 16) for r in df.collect()]


# --- a model of the rules ---------------------------------------------------------------------------------------------


def cell(e):
    _, id_, author, _, kind, tags, *_ = e
    if 30000 <= kind < 40000:
        d = next((t[1][0] for t in tags if t[0] == "d" and t[1]), None)
        return ("r", author, kind) if d is None else ("a", author, kind, d)
    return ("r", author, kind) if 10000 <= kind < 20000 else ("i", id_)


def fold(rows):
    live, out = {}, []
    for e in sorted(rows, key=lambda e: e[0]):
        if 20000 <= e[4] < 30000:
            out.append((e[0], "ephemeral", None))
        elif any(x[1] == e[1] for x in live.values()):
            out.append((e[0], "duplicate", None))
        else:
            old = live.get(cell(e))
            out.append((e[0], "stored", old[1] if old else None))
            live[cell(e)] = e
    return sorted(out), sorted(x[1] for x in live.values())


def tag_ok(e, letter, values, exact=True):
    return any(t[0] == letter and t[1] and t[1][0] in values for t in e[5])


def matches_live(f, e):
    return (
        (f.ids is None or e[1] in f.ids)
        and (f.authors is None or e[2] in f.authors)
        and (f.kinds is None or e[4] in f.kinds)
        and (f.since is None or e[3] >= f.since)
        and (f.until is None or e[3] <= f.until)
        and all(tag_ok(e, k, v) for k, v in f.tags.items())
    )


def compat_model(rows, f):
    newest = sorted(rows, key=lambda e: (-e[3], e[1]))
    generic = sorted(k for k, v in f.tags.items() if k not in "ep" and v)
    cut = lambda found: found if f.limit is None else found[: f.limit]
    if f.ids:
        found, skip = [e for i in f.ids for e in rows if e[1] == i], set(f.tags)
    else:
        if f.tags.get("e") or f.tags.get("p") or generic:
            letter = "e" if f.tags.get("e") else "p" if f.tags.get("p") else generic[0]
            values = hex_values(f.tags[letter]) if letter in "ep" else f.tags[letter]
            held = lambda e, v: any(t[0] == letter and t[1] and (t[1][0].lower() if letter in "ep" else t[1][0]) == v for t in e[5])
            found = [e for v in values for e in cut([e for e in newest if held(e, v)])]
        elif f.authors:
            found = [e for v in f.authors for e in cut([e for e in newest if e[2] == v])]
        elif f.kinds:
            found = [e for v in f.kinds for e in cut([e for e in newest if e[4] == v])]
        else:
            found = []
        skip = {k for k in "ep" if f.tags.get(k)} | ({k for k in f.tags if k not in "ep"} if generic else set())
    rest = Filter(None, f.authors, f.kinds, {k: v for k, v in f.tags.items() if k not in skip}, f.since, f.until)
    out = []
    for e in found:
        if matches_live(rest, e) and e[1] not in [o[1] for o in out]:
            out.append(e)
    return [int(e[1], 16) for e in cut(out)]


def random_events(rng, n):
    out = []
    for i in range(n):
        tags = [["e", pad(rng.randrange(6))]] * rng.randrange(2) + [["p", pad(rng.randrange(3)).upper()]] * rng.randrange(2)
        tags += [[rng.choice("tad"), rng.choice("xyz")] for _ in range(rng.randrange(3))] + [["t"]] * rng.randrange(2) + [["long", "x"]]
        out.append(event(i, rng.randrange(1, 4), rng.choice([1, 7, 0, 10002, 20001, 30023]), 1000 + rng.randrange(8), tags, seq=i))
    return out


def random_filter(rng):
    some = lambda pool: tuple(rng.sample(pool, rng.randrange(0, 3)))
    maybe = lambda make, p=0.35: make() if rng.random() < p else None
    tags = {k: some([pad(i) for i in range(4)] + ["bad"]) for k in "ep" if rng.random() < 0.3} | {k: some(list("xyz")) for k in "ta" if rng.random() < 0.25}
    return Filter(
        maybe(lambda: some([pad(i) for i in range(12)]), 0.15), maybe(lambda: some([pad(i) for i in range(1, 4)])), maybe(lambda: some([1, 7, 10002])),
        tags, maybe(lambda: 1000 + rng.randrange(5), 0.2), maybe(lambda: 1003 + rng.randrange(5), 0.2), maybe(lambda: rng.randrange(4), 0.4),
    )


# --- filters ----------------------------------------------------------------------------------------------------------


def test_filters_against_the_model(spark):
    rng = random.Random(1)
    rows = random_events(rng, 40)
    events = table(spark, rows).cache()
    for _ in range(45):
        f = random_filter(rng)
        assert ids(query.query(events, f, "compat")) == compat_model(rows, f), f
        want = sorted((e for e in rows if matches_live(f, e)), key=lambda e: (-e[3], e[1]))[: f.limit]
        assert ids(query.query(events, f)) == [int(e[1], 16) for e in want], f


def test_empty_and_time_only_filters(spark):
    events = table(spark, [event(1), event(2, at=2000)])
    assert ids(query.query(events, Filter(limit=5), "compat")) == []
    assert ids(query.query(events, Filter(since=1), "compat")) == []
    assert ids(events.where(match.matches(Filter()))) == [1, 2]
    assert ids(query.query(events, Filter(kinds=(1,), limit=0))) == []
    assert ids(query.query(events, Filter(kinds=()))) == [] == ids(query.query(events, Filter(kinds=()), "compat"))
    assert ids(query.query(events, Filter(ids=(), kinds=(1,)), "compat")) == [2, 1]
    assert ids(query.query(events, Filter(ids=(), kinds=(1,)))) == []


def test_limit_before_other_conditions(spark):
    events = table(spark, [event(i, author=1, kind=1 if i < 3 else 7, at=1000 + i) for i in range(6)])
    f = Filter(authors=(pad(1),), kinds=(1,), limit=2)
    assert ids(query.query(events, f, "compat")) == [] and ids(query.query(events, f)) == [2, 1]
    assert ids(query.query(events, Filter(kinds=(1, 7), limit=2), "compat")) == [2, 1]
    assert ids(query.query(events, Filter(kinds=(1, 7), limit=2))) == [5, 4]


def test_union_of_filters_repeats(spark):
    events = table(spark, [event(1), event(2, kind=7)])
    got = query.request(events, [Filter(kinds=(1,)), Filter(ids=(pad(1),))])
    assert sorted((r.filter_no, int(r.id, 16)) for r in got.collect()) == [(0, 1), (1, 1)]
    assert query.request(events, []).count() == 0


def test_filter_parsing():
    f = parse_filter(json.dumps({"ids": [pad(1).upper()], "kinds": [1], "#t": ["x"], "#xy": [1], "other": {}, "since": 5, "limit": 0, "authors": None}))
    assert f == Filter(ids=(pad(1),), kinds=(1,), tags={"t": ("x",)}, since=5, limit=0)
    assert parse_filter(f.to_json()) == f and f.e_tags is None
    for bad in ("[]", "{", '{"#":["x"]}', '{"ids":["ab"]}', '{"kinds":[-1]}', '{"kinds":[1.5]}', '{"since":"1"}', '{"#t":[1]}'):
        with pytest.raises(FilterError):
            parse_filter(bad)


def test_subscriptions_against_the_model(spark):
    rng = random.Random(2)
    rows = random_events(rng, 30)
    filters = [random_filter(rng) for _ in range(25)] + [Filter(), Filter(since=1004)]
    subs = [(f"c{i % 3}", f"s{i}", [f, filters[i - 1]]) for i, f in enumerate(filters)]
    got = subscribe.matched(table(spark, rows), subscribe.subscriptions(spark, subs))
    want = {(c, s, e[1]) for c, s, fs in subs for f in fs for e in rows if matches_live(f, e)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    held = subscribe.subscriptions(spark, subs[:4])
    changed = subscribe.replaced_subscriptions(held, subscribe.subscriptions(spark, [("c0", "s0", [Filter()])]))
    assert changed.where("conn = 'c0' and sub_id = 's0'").count() == 1
    assert subscribe.closed(changed, "c0", "s0").count() == changed.count() - 1
    assert subscribe.closed(changed, "c0").where("conn = 'c0'").count() == 0


# --- state ------------------------------------------------------------------------------------------------------------


def test_state_against_the_model(spark):
    rng = random.Random(3)
    for _ in range(6):
        pool = random_events(rng, 12)
        rows = [(i, *rng.choice(pool)[1:]) for i in range(50)]
        log = table(spark, rows)
        out, live = fold(rows)
        assert sorted(tuple(r) for r in state.outcomes(log).select("seq", "outcome", "replaced_id").collect()) == out
        assert sorted(r.id for r in state.live(log).collect()) == live
        c = state.insert_counts(log).first()
        assert (c.inserted, c.duplicates, c.ephemerals) == tuple(sum(o[1] == k for o in out) for k in ("stored", "duplicate", "ephemeral"))


def test_replacement_rules(spark):
    rows = [
        event(1, kind=10000, at=2000, seq=1), event(2, kind=10000, at=1000, seq=2),  # the last arrival wins, older or not
        event(3, kind=30000, tags=[["d", "a"]], seq=3), event(4, kind=30000, tags=[["d", "b"]], seq=4), event(5, kind=30000, tags=[["d", "a"]], seq=5),
        event(6, kind=30000, tags=[["d"]], seq=6), event(7, kind=30000, seq=7), event(8, kind=30000, tags=[["d", ""]], seq=8),
        event(9, kind=0, seq=9), event(10, kind=0, seq=10), event(11, kind=20000, seq=11), event(1, kind=10000, at=2000, seq=12),
    ]
    log = table(spark, rows)
    assert sorted(ids(state.live(log))) == [1, 4, 5, 7, 8, 9, 10]
    assert {r.seq: r.replaced_id for r in state.replaced(log).collect()} == {2: pad(1), 5: pad(3), 7: pad(6), 12: pad(2)}
    keys = {r.seq: r.k for r in log.select("seq", fn.replacement_key("pubkey", "kind", "tags").alias("k")).collect()}
    assert keys[9] is None and keys[7].d is None and keys[8].d == "" and keys[3].d == "a"


def test_replay_against_a_fold(spark):
    rng = random.Random(4)
    for _ in range(5):
        pool = random_events(rng, 10)
        live, rows = {}, []
        for i in range(40):
            e = rng.choice(pool)
            if rng.random() < 0.7:
                rows.append((0, i, "insert", *e))
                if not any(x == e[1] for x in live.values()):
                    live[cell(e)] = e[1]
            else:
                rows.append((0, i, "delete", *(v if n == "id" else None for n, v in zip(EVENT_COLUMNS, e, strict=True))))
                live = {k: v for k, v in live.items() if v != e[1]}
        ops = spark.createDataFrame(rows, "segment int, pos int, op string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT_SCHEMA))
        assert sorted(r.id for r in state.replay(ops).collect()) == sorted(live.values())


def test_eviction(spark):
    rows = [event(i, at=1000 + i // 2) for i in range(450)]
    events = table(spark, rows)
    total = sum(r[9] for r in rows)
    assert evict.evicted(events, 0).count() == 0 and evict.evicted(events, 2 * total).count() == 0
    for limit in (total, total // 2, 100):
        used, gone = total, []
        oldest = sorted(rows, key=lambda e: (e[3], -int(e[1], 16)))
        for k in range(0, len(oldest), 100):
            chunk = oldest[k : k + 100]
            gone += [e[1] for e in chunk]
            used -= sum(e[9] for e in chunk)
            if used <= limit * 50 // 100:
                break
        assert sorted(r.id for r in evict.evicted(events, limit).collect()) == sorted(gone)
    assert evict.evicted(events, total * 3, process_bytes=total * 4).count() == 450
    assert evict.after_eviction(events, total).count() == 450 - evict.evicted(events, total).count()
    assert [evict.interval_seconds(u, 100, p) for u, p in ((10, 0), (50, 0), (70, 0), (10, 100))] == [5, 2, 1, 1]


def test_load_eviction(spark):
    rng = random.Random(5)
    rows = random_events(rng, 200)
    limit = sum(r[9] for r in rows) // 3
    live, held, gone = {}, 0, set()
    for e in rows:
        if any(x[1] == e[1] for x in live.values()):
            continue
        if cell(e) in live:
            held -= live.pop(cell(e))[9]
        live[cell(e)] = e
        held += e[9]
        if held > limit * 90 // 100:
            while held > limit * 70 // 100 and live:
                k = min(live, key=lambda k: (live[k][3], -int(live[k][1], 16)))
                gone.add(live[k][1])
                held -= live.pop(k)[9]
    got = evict.load_eviction(table(spark, rows), limit).collect()
    assert {r.id for r in got if not r.evicted} == {e[1] for e in live.values()}
    assert {r.id for r in got if r.evicted} == gone


# --- access, figures --------------------------------------------------------------------------------------------------


def test_access(spark):
    rows = [event(i, author=1 + i % 2, kind=1 + i % 3, at=1000 + i // 3, tags=[["e", pad(5)], ["t", "x"], ["t", "x"], ["xy", "z"], ["e", "short"]]) for i in range(12)]
    events = table(spark, rows)
    index = access.tag_index(events)
    assert index.where("letter = 'e'").count() == 12 and index.where("letter = 'xy'").count() == 0
    order = sorted(rows, key=lambda e: (-e[3], e[1]))
    assert ids(access.by_tag(events, index, "e", pad(5).upper(), 4)) == [int(e[1], 16) for e in order][:4]
    assert ids(access.by_tag(events, index, "t", "x")) == [int(e[1], 16) for e in order]
    assert ids(access.by_pubkey_since(events, pad(1), 1002, 3)) == [int(e[1], 16) for e in order if e[2] == pad(1) and e[3] >= 1002][:3]
    assert ids(access.oldest(events, 4)) == [2, 1, 0, 5]
    assert {r.id: r.found for r in access.contains(events, spark.createDataFrame([(pad(1),), (pad(99),)], "id string")).collect()} == {pad(1): True, pad(99): False}
    assert access.totals(events).first().bytes == sum(r[9] for r in rows) and access.totals(events.limit(0)).first().bytes == 0


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "log")
    table(spark, [event(i) for i in range(20)]).write.parquet(path)
    plan = spark.read.parquet(path).where(match.matches(Filter(kinds=(1, 7), since=5))).select("id")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PushedFilters" in plan and "In(kind" in plan and "GreaterThanOrEqual(created_at,5)" in plan and "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    top = access.by_kind(spark.read.parquet(path), 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_figures(spark):
    rows = [event(i, author=1 + (i * i) % 7, kind=i % 4, at=1000 + (i * 37) % 90000) for i in range(60)]
    events = table(spark, rows)
    counts = {}
    for e in rows:
        counts[e[2]] = counts.get(e[2], 0) + 1
    ranked = sorted((n, a) for a, n in counts.items())
    n = len(ranked)
    want = {(p, ranked[p][1], ranked[p][0]) for p in {n // 10, n // 4, n // 2, n * 3 // 4, n - 1}}
    assert {tuple(r) for r in stats.author_rank_sample(events).collect()} == want
    assert stats.median_created_at(events).first()[0] == sorted(e[3] for e in rows)[30]
    assert stats.median_created_at(events.limit(0)).count() == 0 == stats.author_rank_sample(events.limit(0)).count()
    values = spark.createDataFrame([(0.0001,), (0.002,), (3.0,), (99.0,)], "v double")
    got = {r.le: r.n for r in stats.histogram(values, "v", stats.HISTOGRAMS["write_delay_seconds"]).collect()}
    assert got["0.0001"] == 1 and got["0.005"] == 2 and got["1"] == 2 and got["+Inf"] == 4
    lines = [r.line for r in stats.exposition(values, "v", "write_delay_seconds", "Write delay").collect()]
    assert lines[1] == "# TYPE write_delay_seconds histogram" and lines[-1] == "write_delay_seconds_count 4"
    shown = spark.range(1).select(*(fn.format_bytes(F.lit(n)).alias(f"b{i}") for i, n in enumerate([0, 1, 1023, 1024, 5 * 2**20, 2**41])), fn.capacity(F.lit(1), F.lit(8)).alias("c"), fn.capacity(F.lit(1), F.lit(0)).alias("d"))
    assert list(shown.first()) == ["0 B", "1.0 B", "1023.0 B", "1.0 KB", "5.0 MB", "2048.0 GB", "13%", "—"]
    sizes = table(spark, [event(1, tags=[["t", "ab", "c"]], content="é")]).select(fn.approximate_size("raw", "content", "tags", 10).alias("s"), "raw_bytes").first()
    assert sizes.s == 10 + sizes.raw_bytes + 2 + 4


# --- parsing, hashes, frames ------------------------------------------------------------------------------------------


def test_parsing(spark):
    good = json.loads(event(1, tags=[["e", pad(2)], [], ["t"]])[8])
    variants = {
        "ok": good, "extra": good | {"x": [1]}, "upper": good | {"id": pad(0xAB).upper()}, "short": good | {"id": "ab"}, "key": good | {"pubkey": "zz" * 32}, "sig": good | {"sig": "0" * 127},
        "float": good | {"created_at": 1.5}, "text": good | {"created_at": "1"}, "negative": good | {"kind": -1}, "large": good | {"kind": 2**32}, "far": good | {"created_at": 2**63}, "over": good | {"created_at": 2**64},
        "tags": good | {"tags": [["e", 1]]}, "null": good | {"tags": [["e", None]]}, "flat": good | {"tags": ["e"]}, "content": good | {"content": 5}, "none": good | {"tags": []}, "edge": good | {"created_at": 2**63 - 1},
    }
    lines = [(k, json.dumps(v)) for k, v in variants.items()] + [("missing", json.dumps({k: v for k, v in good.items() if k != "sig"})), ("no", "{"), ("array", "[]"), ("null line", "null"), ("twice", '{"id":"a","id":"b"}')]
    got = {r.seq: r for r in parse.parsed(spark.createDataFrame(lines, "seq string, raw string")).collect()}
    want = {"short": "id", "key": "pubkey", "sig": "sig", "far": "range"} | {k: None for k in ("ok", "extra", "upper", "none", "edge")}
    assert {k: r.reason for k, r in got.items()} == {k: want.get(k, "json") for k in got}
    assert got["ok"].tags == [("e", [pad(2)]), ("t", [])] and got["upper"].id == pad(0xAB) and got["ok"].raw_bytes == len(lines[0][1])
    assert set(want.get(k, "json") for k in got) - {None} <= set(parse.REASONS)


def test_ids_and_signatures(spark):
    public, _ = sign(7, b"\0" * 32)
    fields = (public.hex(), 1234, 1, [["t", 'q"\\'], [], ["x"]], "tab\t nul\u0001 del\x7f é 🙂  ")
    text = canonical(*fields)
    assert "\\t" in text and "\\u0001" in text and "é" in text and " " not in text.split('"tab')[0]
    id_ = hashlib.sha256(text.encode()).digest()
    _, signature = sign(7, id_)
    assert verify(public, id_, signature) and not verify(public, b"\1" * 32, signature) and not verify(b"\xff" * 32, id_, signature)
    raw = {"id": id_.hex(), "pubkey": fields[0], "created_at": fields[1], "kind": fields[2], "tags": fields[3], "content": fields[4], "sig": signature.hex()}
    lines = [(0, json.dumps(raw)), (1, json.dumps(raw | {"content": "x"})), (2, json.dumps(raw | {"sig": "0" * 128})), (3, "no")]
    df = spark.createDataFrame(lines, "seq long, raw string")
    assert [r.reason for r in parse.parsed(df, check_signature=True, check_id=True).orderBy("seq").collect()] == [None, "mismatch", "signature", "json"]
    assert fold128("00" * 15 + "01" + "ff" * 16) == "ff" * 15 + "fe"


def test_frames(spark):
    made = spark.range(1).select(
        frames.eose_frame(F.lit('a"b')).alias("a"), frames.notice_frame(F.lit("x\ny")).alias("b"), frames.ok_frame(F.lit("i"), F.lit(True), F.lit("m")).alias("c"),
        frames.request_frame(F.lit("s"), F.array(F.lit("{}"), F.lit('{"kinds":[1]}'))).alias("d"), frames.close_frame(F.lit("s")).alias("e"),
    ).first()
    assert [json.loads(x) for x in made] == [["EOSE", 'a"b'], ["NOTICE", "x\ny"], ["OK", "i", True, "m"], ["REQ", "s", {}, {"kinds": [1]}], ["CLOSE", "s"]]
    df = spark.createDataFrame([('["REQ","s",{"kinds":[1]},{"#t":["x"]}]',), ('["EVENT",{"id":"x"}]',), ('["OK","i",false,"why"]',), ('["NOTICE","n"]',)], "f string")
    req, ev, ok, notice = (r.m for r in df.select(frames.parse_message("f").alias("m")).collect())
    assert [parse_filter(f) for f in req.filters] == [Filter(kinds=(1,)), Filter(tags={"t": ("x",)})] and req.id == "s"
    assert json.loads(ev.event) == {"id": "x"} and ok.accepted is False and ok.message == "why" and notice.message == "n"
    end = query.with_eose(table(spark, [event(1)]), "s").orderBy("last").collect()
    assert json.loads(end[0].frame)[2]["id"] == pad(1) and end[1].frame == '["EOSE","s"]'


# --- storage ----------------------------------------------------------------------------------------------------------


def test_wal_records(spark, tmp_path):
    good = wal.encode_insert("{}") + wal.encode_delete(pad(3))
    assert [(r[1], r[4]) for r in wal.decode(good)] == [("insert", None), ("delete", None)]
    assert [r[4] for r in wal.decode(good + b"\x00\x05")] == [None, None, "truncated record"]
    assert [r[4] for r in wal.decode(good + wal.encode_insert("abc")[:-1])] == [None, None, "truncated record"]
    assert [r[1] for r in wal.decode(b"\x07" + good)] == []
    assert "exceeds maximum" in list(wal.decode(b"\x00\x00\x00\x00\x40"))[0][4]
    assert [r[4] for r in wal.decode(good + b"\x01ab")][-1] == "truncated record"
    (tmp_path / "wal.log").write_bytes(wal.encode_insert(event(1)[8]) + wal.encode_insert(event(2)[8]) + wal.encode_insert("junk") + wal.encode_delete(pad(1)))
    records = wal.read_wal(spark, str(tmp_path / "wal.log"))
    assert ids(state.replay(wal.operations(records))) == [2]
    assert wal.pending_bytes(records).first()[0] == (tmp_path / "wal.log").stat().st_size


def test_snapshot_and_recovery(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "store"))
    assert recover(folder).count() == 0
    rows = [event(1, kind=10000, seq=1), event(2, seq=2), event(3, kind=10000, seq=3), event(4, kind=20000, seq=4)]
    append_ops(folder, ops_of(table(spark, rows)), 1)
    assert sorted(ids(recover(folder))) == [2, 3]
    assert log_bytes(folder) > 0 and not needs_checkpoint(10, 10) and needs_checkpoint(200 << 20, 90 << 20)
    assert checkpoint(folder) == 1 and folder.batches() == [] and folder.snapshots() == [1]
    append_ops(folder, spark.createDataFrame([(1, "delete", pad(2), None)], "seq long, op string, id string, raw string"), 2)
    append_ops(folder, ops_of(table(spark, [event(5, seq=1), event(6, seq=2)])), 3)
    assert sorted(ids(recover(folder))) == [3, 5, 6]
    assert compact_log(folder, spark.createDataFrame([(pad(6),)], "id string")) == 2
    assert sorted(ids(recover(folder))) == [2, 3, 6]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "events.jsonl").write_text(f"{event(1)[8]}\n\nbad\n{event(2)[8]}\n{event(1)[8]}\n")
    lines = parse.read_jsonl(spark, str(tmp_path / "lines"))
    assert lines.count() == 4 and parse.rejects_of(lines).count() == 1
    assert ids(parse.read_archive(spark, str(tmp_path / "lines"), limit=5)) == [1, 2]
    changed = [event(1, content="x" * k)[8] for k in (0, 5000)]
    for name, line in (("a.jsonl", changed[0]), ("b.jsonl", changed[1] + "\n" + changed[1])):
        (tmp_path / "order").mkdir(exist_ok=True)
        (tmp_path / "order" / name).write_text(line + "\n")
    assert [r.content for r in parse.read_archive(spark, str(tmp_path / "order")).collect()] == [""]


def test_commits_are_not_lost(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "store"))
    ops = lambda *n: ops_of(table(spark, [event(i, seq=i) for i in n]))
    assert [append_ops(folder, ops(i)) for i in (1, 2)] == [1, 2]
    assert checkpoint(folder) == 2
    slow, fast = folder.claim(), append_ops(folder, ops(4))  # two writers, the earlier number still open
    assert (slow, fast) == (3, 4) and checkpoint(folder) == 2
    append_ops(folder, ops(3), slow)
    assert sorted(ids(recover(folder))) == [1, 2, 3, 4] and checkpoint(folder) == 4
    assert append_ops(folder, ops(5), key="w-0") == append_ops(folder, ops(5), key="w-0") == 5 and append_ops(folder, ops(6), key="w-1") == 6
    died = folder.claim()
    append_ops(folder, ops(8))
    assert checkpoint(folder) == 6
    folder.release(died)
    assert checkpoint(folder) == 8 and sorted(ids(recover(folder))) == [1, 2, 3, 4, 5, 6, 8]


def test_filters_and_buckets_reach_the_snapshot(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.insert(table(spark, [event(i, kind=10000 + i, at=1000 + i, seq=i) for i in range(40)]))
    store.save()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at,1030)" in plan(store.query(Filter(kinds=(10035,), since=1030)))
    store.insert(table(spark, [event(50, kind=10035, at=2000, seq=1)]))
    shown = plan(store.query(Filter(kinds=(10035,), since=1030)))
    assert "GreaterThanOrEqual(created_at,1030)" in shown and ids(store.query(Filter(kinds=(10035,)))) == [50]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan(recover(store.folder, [3]))) and store.live.count() == 40
    shuffles = state.live(table(spark, [event(1)]))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 1


def test_stream_starts_from_the_store_and_forgets(spark, tmp_path):
    from rookery.plans.store import Keeper

    path, sent, now = str(tmp_path / "in"), [], [0.0]
    store = EventStore(spark, str(tmp_path / "s"), config.Config(max_bytes=1000, persistence_interval=60))
    store.insert(table(spark, [event(1, seq=1), event(2, kind=10000, seq=2)]))
    store.save()
    keeper = Keeper(store, path, lambda: now[0])
    subs = subscribe.subscriptions(spark, [("c", "all", [Filter()])])

    def go(*rows):
        table(spark, rows).coalesce(1).write.mode("append").parquet(path)
        told = []
        sink = lambda m, held, n: told.extend((r.seq, r.outcome, r.replaced_id) for r in held.collect())
        streaming.run(spark, path, store.folder, subs, sink, str(tmp_path / "state"), keeper=keeper).awaitTermination()
        return sorted(told)

    assert go(event(1, seq=3), event(3, kind=10000, seq=4)) == [(3, "duplicate", None), (4, "stored", pad(2))]
    assert sorted(ids(store.live)) == [1, 3]
    now[0] = 100.0  # both jobs are due: the store is over its limit, so all that is old goes
    assert go(event(4, at=5000, seq=5)) == [(5, "stored", None)]
    left = sorted(ids(store.live))
    assert 1 not in left and store.folder.snapshots()
    assert go(event(1, seq=6)) == [(6, "stored", None)]


def test_frames_as_a_stream(spark, tmp_path):
    from rookery.plans.session import Session

    session, path, told = Session(EventStore(spark, str(tmp_path / "s")), verify=False), tmp_path / "frames", []
    path.mkdir()
    rows = [(1, "a", '["REQ","s",{"kinds":[1]}]'), (2, "b", f'["EVENT",{event(1)[8]}]'), (3, "a", '["CLOSE","s"]')]
    for n, conn, frame in rows:
        (path / f"{n}.json").write_text(json.dumps({"n": n, "conn": conn, "frame": frame}) + "\n")
    streaming.answer_frames(session, str(path), lambda df, n: told.extend((r.conn, json.loads(r.frame)[0]) for r in df.collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(told) == [("a", "EOSE"), ("b", "OK")] and session.subscriptions.count() == 0
    matches = spark.createDataFrame([("a",)] * 150 + [("b",)] * 3, "conn string")
    assert sorted(tuple(r) for r in streaming.dropped_frames(matches, 20).collect()) == [("a", 130, True), ("b", 0, False)]


def test_counters_and_load_counts(spark):
    rows = [event(1, seq=1), event(1, seq=2), event(2, kind=20000, seq=3), event(3, kind=10000, seq=4), event(4, kind=10000, seq=5)]
    subs = subscribe.subscriptions(spark, [("c", "a", [Filter()]), ("c", "b", [Filter()]), ("d", "a", [Filter()])])
    replies = spark.createDataFrame([("c", '["EVENT",1]'), ("c", '["EOSE","a"]')], "conn string, frame string")
    got = {r.name: r.value for r in stats.counters(state.outcomes(table(spark, rows)), subs, replies).collect()}
    assert got == {"events_saved_total": 3, "events_duplicate_total": 1, "events_ephemeral_total": 1, "events_replaced_total": 1, "active_connections": 2,
                   "active_subscriptions": 3, "events_output_total": 1, "bytes_output_total": 23}
    lines = [r.line for r in stats.counter_lines(stats.counters(state.outcomes(table(spark, rows)))).collect()]
    assert lines[:2] == ["# TYPE events_duplicate_total counter", "events_duplicate_total 1"]
    ops = table(spark, [event(i, at=i, seq=i) for i in range(10)]).selectExpr("1L as segment", "seq as pos", "'insert' as op", "* except(seq)")
    torn = ops.limit(1).selectExpr("* except(op)").withColumn("op", F.lit(None).cast("string"))
    size = event(1, at=1)[9]
    row = state.replay_counts(ops.unionByName(torn), 5 * size).first()
    assert (row.applied, row.errors) == (10, 1) and 0 < row.evicted < 10
    assert sum(r.evicted for r in evict.load_eviction(ops.withColumnRenamed("pos", "seq"), 5 * size).collect()) == row.evicted
    assert {r.evicted for r in evict.load_eviction(ops.withColumnRenamed("pos", "seq"), 0).collect()} == {False}


def test_one_scan_serves_all_stored_filters(spark):
    rng = random.Random(31)
    events = table(spark, [(i, *e[1:]) for i, e in enumerate(random_events(rng, 40))])
    asked = [("c", "a", [Filter(kinds=(1,), limit=3), Filter(limit=2)]), ("d", "x", [Filter(limit=0), Filter(since=1)]), ("e", "y", [Filter(kinds=())])]
    got = sorted(tuple(r) for r in subscribe.stored_answers(events, asked).collect())
    want = sorted((c, s, i, r.id) for c, s, fs in asked for i, f in enumerate(fs) for r in query.query(events, f).collect())
    assert got == want


def test_store(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"), config.Config(max_bytes=2000))
    first = store.insert(table(spark, [event(i, kind=10000 if i < 2 else 1, at=1000 + i, seq=i) for i in range(8)]))
    assert first.where("outcome = 'stored'").count() == 8
    again = {r.seq: r.outcome for r in store.insert(table(spark, [event(1, kind=10000, at=1001, seq=1), event(0, kind=10000, at=1000, seq=2), event(9, at=2000, seq=3)])).collect()}
    assert again == {1: "duplicate", 2: "stored", 3: "stored"}
    assert sorted(ids(store.live)) == [0, 2, 3, 4, 5, 6, 7, 9]
    assert ids(store.query(Filter(kinds=(1,), limit=2))) == [9, 7] and store.get(pad(9)).count() == 1
    assert store.stats().first().events == 8 and store.information()["limitation"]["max_limit"] == 5000
    store.save()
    assert sorted(ids(store.live)) == [0, 2, 3, 4, 5, 6, 7, 9]
    assert store.evict() == 8 and store.live.count() == 0


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("max_bytes: 5\nmax_limit: 7  # note\npersistence_path: './x'\nunknown: 1\n")
    got = config.load(str(tmp_path / "c.yaml"), {"MAX_LIMIT": "9"})
    assert (got.max_bytes, got.max_limit, got.persistence_path, got.max_subscriptions) == (5, 9, "./x", 300)
    assert got.budget(100) == 5 and config.Config().budget(100) == 80 and config.Config(target_ram_percent=0).budget(100) == 0


# --- streams ----------------------------------------------------------------------------------------------------------


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rng = random.Random(6)
    pool = random_events(rng, 15)
    rows = [(i, *rng.choice(pool)[1:]) for i in range(60)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:25], rows[25:]):
        table(spark, part).coalesce(1).write.mode("append").parquet(path)
        arriving = streaming.outcome_stream(streaming.read_log_stream(spark, path, 1))
        arriving.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("seq", "outcome", "replaced_id").collect())
    assert got == fold(rows)[0]


def test_stream_state_by_parts(spark, tmp_path, monkeypatch):
    """Many keys in one part of the state, over restarts, from a store's events and with deletes."""
    monkeypatch.setattr(streaming, "STATE_PARTS", 2)
    rng = random.Random(16)
    pool = random_events(rng, 25)
    rows = [(i, *rng.choice(pool)[1:]) for i in range(150)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    held = state.live(table(spark, rows[:50]))
    for at in range(50, 150, 20):
        table(spark, rows[at : at + 20]).coalesce(1).write.mode("append").parquet(path)
        arriving = streaming.outcome_stream(streaming.read_log_stream(spark, path, 1), held)
        arriving.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    told = lambda df: sorted(tuple(r) for r in df.select("seq", "outcome", "replaced_id").collect())
    assert told(spark.read.parquet(out)) == [r for r in fold(rows)[0] if r[0] >= 50]
    live = state.live(table(spark, rows)).where("kind < 20000 or kind >= 30000").orderBy("seq").limit(1)
    gone = live.withColumn("op", F.lit("delete")).withColumn("seq", F.lit(200).cast("long"))
    gone.unionByName(live.withColumn("op", F.lit(None).cast("string")).withColumn("seq", F.lit(201).cast("long"))).coalesce(1).write.mode("append").parquet(path)
    arriving = streaming.outcome_stream(streaming.read_log_stream(spark, path, 1), held)
    arriving.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert told(spark.read.parquet(out).where("seq > 150")) == [(201, "stored", None)]


def test_files_of_a_streamed_log_follow_its_size(spark):
    from rookery import queries

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        path = queries._arrived(spark, table(spark, [event(i, seq=i) for i in range(400)]))
    finally:
        spark.conf.set(key, before)
    assert len(spark.read.parquet(path).inputFiles()) > 3 and spark.read.parquet(path).count() == 400


def test_few_filters_move_no_events(spark):
    """Events that come several times each are not shuffled for a small table of filters."""
    subs = subscribe.subscriptions(spark, [("c", "x", [Filter(kinds=(1,)), Filter(tags={"t": ("a",)})])])
    plan = subscribe.matched(table(spark, [event(1)]), subs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_wal_decodes_in_runs(spark, monkeypatch):
    """Large segments go through Python one by one, and their records in runs."""
    monkeypatch.setattr(wal, "RUN", 7)
    data = b"".join(wal.encode_insert(f"x{i}") for i in range(20)) + wal.encode_delete("ab" * 32) + b"\x00"
    got = wal.decoded(spark.createDataFrame([("a", data), ("b", b""), ("c", data)], "path string, content binary"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is not None
    rows = sorted(tuple(r) for r in got.collect() if r.segment == "a")
    assert [r[3] for r in rows[:20]] == [f"x{i}" for i in range(20)] and rows[20][4] == "ab" * 32 and rows[21][5] == "truncated record"
    assert got.count() == 44


def test_load_eviction_reads_packed_numbers(spark):
    """The one task reads far less than the ids take."""
    rows = [event(i, seq=i) for i in range(500)]
    packed = evict._packed(evict._numbered(table(spark, rows).selectExpr("seq", "id", "'i:' || id as route", "created_at", "raw_bytes"))).collect()
    assert sum(len(r.packed) for r in packed) < 500 * 32
    numbers = [evict._unpacked(r.packed) for r in sorted(packed, key=lambda r: r.seq)]
    assert [x for n in numbers for x in n[3]] == [len(r[8].encode()) for r in rows]


def test_stream_commits_and_delivers(spark, tmp_path):
    path = str(tmp_path / "in")
    table(spark, [event(1, seq=1), event(2, kind=20001, seq=2), event(1, seq=3), event(3, kind=10000, seq=4)]).coalesce(1).write.parquet(path)
    folder, sent = Folder(spark, str(tmp_path / "store")), []
    subs = subscribe.subscriptions(spark, [("c", "all", [Filter(), Filter(kinds=(1,))]), ("c", "eph", [Filter(kinds=(20001,))])])
    streaming.run(spark, path, folder, subs, lambda m, held, n: sent.extend(tuple(r) for r in m.collect()), str(tmp_path / "state")).awaitTermination()
    assert sorted(sent) == [("c", "all", pad(1)), ("c", "all", pad(2)), ("c", "all", pad(3)), ("c", "eph", pad(2))]
    assert sorted(ids(recover(folder))) == [1, 3]
    events = table(spark, [event(i, seq=i) for i in range(4)])
    answer = streaming.stored_then_live(events, "s", [Filter(kinds=(1,))], cut_seq=2).orderBy("part", "n").collect()
    assert len(answer) == 4 and answer[-1].frame == '["EOSE","s"]'
    matches = subscribe.matched(events, subscribe.subscriptions(spark, [("c", "x", [Filter(kinds=(1,))])]))
    assert streaming.delivered(matches, events, per_connection=2).count() == 2


def test_session(spark, tmp_path):
    from rookery.plans.session import Session

    session = Session(EventStore(spark, str(tmp_path / "s")), verify=False)
    frames_in = lambda rows: spark.createDataFrame(rows, "n long, conn string, frame string")
    told = lambda df: sorted((r.conn, r.n, r.part, json.loads(r.frame)) for r in df.collect())
    one = f'["EVENT",{event(1)[8]}]'
    got = told(session.answer(frames_in([(1, "a", '["REQ","s",{"kinds":[1]}]'), (2, "b", one), (3, "b", "junk"), (4, "b", '["REQ","x",{"ids":["ab"]}]'), (5, "b", '["EVENT",{"id":1}]')])))
    assert [(c, n, p, f[0]) for c, n, p, f in got] == [("a", 1, 1, "EOSE"), ("a", 2, 2, "EVENT"), ("b", 2, 0, "OK"), ("b", 3, 0, "NOTICE"), ("b", 4, 0, "NOTICE"), ("b", 5, 0, "NOTICE")]
    got = told(session.answer(frames_in([(6, "b", one), (7, "b", '["REQ","t",{"kinds":[1]}]'), (8, "a", '["CLOSE","s"]')])))
    assert [(c, n, p, f[0]) for c, n, p, f in got] == [("b", 6, 0, "OK"), ("b", 7, 0, "EVENT"), ("b", 7, 1, "EOSE")]
    assert "duplicate" in got[0][3][3]
    session.disconnect("b")
    assert session.subscriptions.count() == 0 and "Events" in session.status_page()


def test_an_insert_is_written_once(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    rows = [event(i, kind=(1, 10000, 20001)[i % 3], at=1000 + i, tags=[["t", "x"]], seq=i) for i in range(9)]
    done = store.insert(table(spark, rows).withColumn("conn", F.lit("c")))
    assert sorted((r.seq, r.outcome, r.replaced_id) for r in done.collect()) == fold(rows)[0]
    assert {r.conn for r in done.collect()} == {"c"} and done.drop("conn", "outcome", "replaced_id").exceptAll(table(spark, rows)).count() == 0
    assert store.folder.logged() == [] and store.folder.batches() == [1]  # the text is in the outcomes alone
    held = spark.read.parquet(str(tmp_path / "s" / "outcomes" / "batch-1"))
    assert "tags" not in held.columns and held.count() == 9
    again = [event(7, kind=10000, at=1007, seq=1), event(12, kind=10000, at=1, seq=2)]
    assert sorted((r.seq, r.outcome, r.replaced_id) for r in store.insert(table(spark, again)).collect()) == [(1, "duplicate", None), (2, "stored", pad(7))]
    assert sorted(ids(store.live)) == [0, 3, 6, 12] and log_bytes(store.folder) == sum(r[9] + 5 for r in rows if r[4] in (1, 10000)) + 33 * 3 + again[1][9] + 5
    assert compact_log(store.folder, store.live.select("id")) == 6 and sorted(ids(store.live)) == [0, 3, 6, 12]
    assert store.save() and sorted(ids(store.live)) == [0, 3, 6, 12]


def test_operations_of_a_log_take_one_pass(spark):
    ops = ops_of(table(spark, [event(1, kind=10000, seq=1), event(2, kind=10000, seq=2), event(3, kind=20000, seq=3)]))
    assert ops._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert sorted((r.seq, r.op, int(r.id, 16), r.raw is None) for r in ops.collect()) == [(1, "insert", 1, False), (2, "delete", 1, True), (2, "insert", 2, False)]


def test_event_ids_take_no_python(spark):
    odd = ["".join(map(chr, range(0x300))), "\u2028\u2029\U0001f600\ufffd", "\\u000B\x0b\\\x0b\\\\u001F\x1f\x0b\x1f", '"\\/', "", "\x7f\x80"]
    rows = [(a, 2**53 + 1, 7, [[a, b], [], ["t"]], b) for a in odd for b in odd] + [("p", 0, 0, [], "x"), ("p", 1, 1, None, "x")]
    df = spark.createDataFrame(rows, "p string, at long, kind long, wire array<array<string>>, content string")
    got = df.select("*", fn.canonical_json("p", "at", "kind", "wire", "content").alias("text"), fn.event_id("p", "at", "kind", "wire", "content").alias("id"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        want = None if r.wire is None else canonical(r.p, r["at"], r.kind, r.wire, r.content)
        assert r.text == want and r.id == (want and hashlib.sha256(want.encode()).hexdigest())

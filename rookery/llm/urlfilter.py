"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a regular expression over a whole url together with the literal tokens ([a-z0-9]+ runs bounded
on both sides by other characters) that any url it matches must hold. Each rule is filed under the one of its
tokens that is rarest among the urls of the whole table; a url's tokens fetch candidate rules from a hashed
index, and only those run their expressions. Rules without a token are candidates for every url.

The index is a literal array of buckets (XXH64 of the token, so a lookup is one array access) up to
`inline_rules` rules; larger sets are joined on the token, distinct urls against rules, so neither a hot url
nor a common token brings more than its distinct urls together.

Defined results: a null url, or one without `://`, has empty host and path and no fitting host rule (pattern rules
match nothing in a null url); repeated rows each get a row; an empty table gives an empty result; other columns are
ignored. Among fitting host rules the longest rule string wins, on a tie the longer host, then `allow`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host rules (verdict, host and path), fixed values of the query.
HOST_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Pattern rules for urls that no host rule fits: `*` stands for any characters, `^` for a separator or the end.
PATTERN_RULES = [
    ("block", "^casino^"),
    ("block", "^cheap^pills^"),
    ("block", "^spam^farm^"),
    ("block", "^porn^"),
    ("block", "^xxx^"),
    ("block", "^viagra^"),
    ("block", "^adserver^"),
    ("block", "^doubleclick^"),
    ("allow", "^wiki^casino^"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 256
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    kind: str  # host or pattern
    regex: str  # over lowerhost + "#" + path for host rules (neither holds a #), over the lower-cased url for pattern rules
    tokens: tuple[str, ...]
    rank: int = 0  # larger wins


def host_rule(verdict: str, text: str) -> Rule:
    host, slash, rest = text.partition("/")
    path = slash + rest
    closed = [t for t in re.finditer(r"[A-Za-z0-9]+", path) if t.end() < len(path)]
    tokens = [t for t in re.findall(r"[a-z0-9]+", host)] + [t[0].lower() for t in closed]
    regex = rf"(?s)^(?:[^#]*\.)?{_quoted(host)}#{_quoted(path)}"
    return Rule(text, verdict, "host", regex, tuple(tokens))


def pattern_rule(verdict: str, text: str) -> Rule:
    parts = re.split(r"([*^])", text)
    regex = "(?s)" + "".join({"*": ".*", "^": "(?:^|[^a-z0-9]+|$)"}.get(p, _quoted(p)) for p in parts)
    tokens = re.findall(r"(?<=\^)[a-z0-9]+(?=\^)", text)
    return Rule(text, verdict, "pattern", regex, tuple(tokens))


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/])", r"\\\1", s)


def ranked(rules: list[Rule]) -> list[Rule]:
    """Host rules outrank pattern rules; longer names outrank shorter ones; allow wins between equals."""
    order = sorted(rules, key=lambda r: (r.kind == "host", len(r.name), len(r.name.partition("/")[0]), r.verdict == "allow", r.name))
    return [Rule(r.name, r.verdict, r.kind, r.regex, r.tokens, i + 1) for i, r in enumerate(order)]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    lower = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(lower, F.lit("([a-z0-9]+)"), F.lit(1)))


def token_counts(pages: DataFrame, rules: list[Rule], url: str) -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs; as many numbers as the rules have tokens."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = pages.select(F.explode(tokens_of(F.col(url))).alias("t")).where(F.col("t").isin(wanted)).groupBy("t").count()
    return {t: 0 for t in wanted} | {r["t"]: r["count"] for r in found.collect()}


def indexed(rules: list[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Each rule under its rarest token; under None those that have none."""
    by: dict[str | None, list[Rule]] = {}
    for r in rules:
        by.setdefault(min(r.tokens, key=lambda t: (counts[t], -len(t), t), default=None), []).append(r)
    return by


def _fits(rule, subject: str, lower_url: str) -> Column:
    return F.regexp_like(F.when(rule["on_host"], F.col(subject)).otherwise(F.col(lower_url)), rule["regex"])


def filter_urls(
    pages: DataFrame,
    rules: list[Rule] | None = None,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    inline_rules: int = 2000,
) -> DataFrame:
    """(key, host, path, rule, verdict, pattern): the winning host rule, else the winning pattern rule's verdict, else the default."""
    rules = ranked([host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERN_RULES] if rules is None else rules)
    by = indexed(rules, token_counts(pages, rules, url))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    judge = _by_array if len(rules) <= inline_rules else _by_join
    won = judge(rows, by)
    out = won.select(F.col("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "won")
    is_host = F.col("won.on_host")
    return out.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.when(is_host, F.col("won.name")).alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
        F.when(~is_host, F.col("won.name")).alias("pattern"),
    )


def _struct(r: Rule, token: str | None) -> Column:
    return F.struct(
        F.lit(r.rank).alias("rank"), F.lit(token or "").alias("token"), F.lit(r.kind == "host").alias("on_host"),
        F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"),
    )


_KIND = "array<struct<rank:int,token:string,on_host:boolean,name:string,verdict:string,regex:string>>"


def _subjects(rows: DataFrame) -> DataFrame:
    url = F.col("url")
    return rows.withColumns(
        {"subject": F.concat(host_of(url), F.lit("#"), path_of(url)), "lower_url": F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER), "tokens": tokens_of(url)}
    )


def _by_array(rows: DataFrame, by: dict) -> DataFrame:
    """No shuffle: each url looks its tokens up in the literal index."""
    buckets: list[list[Column]] = [[] for _ in range(BUCKETS)]
    for token, rules in by.items():
        if token is not None:
            buckets[xxhash.xxh64_intdigest(token.encode(), 42) % BUCKETS] += [_struct(r, token) for r in rules]
    every = F.array(*[_struct(r, None) for r in by.get(None, [])]).cast(_KIND)
    index = F.array(*[F.array(*b).cast(_KIND) for b in buckets])
    fetched = F.flatten(
        F.transform(
            "tokens",
            lambda t: F.filter(F.get(index, F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")), lambda r: r["token"] == t),
        )
    )
    fitting = F.filter(F.concat(fetched, every), lambda r: _fits(r, "subject", "lower_url"))
    return _subjects(rows).select("key", "url", F.array_max(fitting).alias("won"))


def _by_join(rows: DataFrame, by: dict) -> DataFrame:
    """For rule sets too large for a literal: distinct urls' tokens join the rules on the token. Rules come from the driver; where
    their text is at most BROADCAST_BYTES the join is a broadcast, so that a common token does not gather its urls in one task."""
    spark = rows.sparkSession
    data = [(r.rank, t or "", r.kind == "host", r.name, r.verdict, r.regex) for t, rules in by.items() for r in rules]
    index = spark.createDataFrame(data, "rank int, token string, on_host boolean, name string, verdict string, regex string")
    if sum(len(x) for row in data for x in row if isinstance(x, str)) <= BROADCAST_BYTES:
        index = F.broadcast(index)
    every = F.array(*[F.lit("")] * (None in by)).cast("array<string>")
    urls = _subjects(rows.select("url").distinct()).withColumn("token", F.explode(F.concat("tokens", every)))
    rule = F.struct("rank", "token", "on_host", "name", "verdict", "regex")
    hits = urls.join(index, "token").where(F.regexp_like(F.when(F.col("on_host"), F.col("subject")).otherwise(F.col("lower_url")), F.col("regex")))
    won = hits.groupBy("url").agg(F.max(rule).alias("won"))
    return rows.join(won.withColumnRenamed("url", "won_url"), F.col("url").eqNullSafe(F.col("won_url")), "left").select("key", "url", "won")

"""Predicates of filters as columns, over literal filters and over filters that are columns themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tag_value
from ..sources.filters import Filter


def among(column: Column, values) -> Column:
    return column.isin(list(values)) if values else F.lit(False)


def has_tag(letter: str, values, tags: str = "tags") -> Column:
    """Some tag of that name whose first value is one of the values."""
    if not values:
        return F.lit(False)
    return F.exists(tags, lambda t: (t["name"] == letter) & F.coalesce(tag_value(t).isin(list(values)), F.lit(False)))


def in_time(f: Filter) -> Column:
    out = F.lit(True)
    if f.since is not None:
        out = out & (F.col("created_at") >= F.lit(f.since).cast("decimal(20,0)") if f.since >= 2**63 else F.col("created_at") >= f.since)
    if f.until is not None and f.until < 2**63:
        out = out & (F.col("created_at") <= f.until)
    return out


def matches(f: Filter, skip_letters=()) -> Column:
    """All conditions of a filter; limit is none. The scalar ones reach the Parquet scan."""
    out = in_time(f)
    if f.ids is not None:
        out = out & among(F.col("id"), f.ids)
    if f.kinds is not None:
        out = out & among(F.col("kind"), f.kinds)
    if f.authors is not None:
        out = out & among(F.col("pubkey"), f.authors)
    for letter, values in sorted(f.tags.items()):
        if letter not in skip_letters:
            out = out & has_tag(letter, values)
    return out


def id_starts_with(prefix: str, column: str = "id") -> Column:
    """Hex prefixes, longer than 64 never; filters do not use it."""
    return F.lit(False) if len(prefix) > 64 else F.col(column).startswith(prefix)


def row_matches() -> Column:
    """An event row (columns of the log) against a filter row (columns of a subscription), all conditions."""
    ok = lambda c: F.coalesce(c, F.lit(True))
    tag_ok = lambda entry: F.exists(
        "tags", lambda t: (t["name"] == entry["key"]) & F.coalesce(F.array_contains(entry["value"], tag_value(t)), F.lit(False))
    )
    return (
        ok(F.array_contains("f_ids", F.col("id")))
        & ok(F.array_contains("f_kinds", F.col("kind")))
        & ok(F.array_contains("f_authors", F.col("pubkey")))
        & ok(F.col("created_at") >= F.col("f_since"))
        & ok(F.col("created_at") <= F.col("f_until"))
        & ok(F.forall(F.map_entries("f_tags"), tag_ok))
    )

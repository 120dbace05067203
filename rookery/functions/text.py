"""Text for people and JSON fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_bytes(c) -> Column:
    """`0 B`, else one decimal and the largest of B, KB, MB, GB that keeps it at 1 or more."""
    n = _col(c).cast("double")
    out = F.when(n == 0, F.lit("0 B"))
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.concat(F.format_string("%.1f", n / float(1024**i)), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (i + 1), text) if unit != "GB" else out.otherwise(text)
    return out


def capacity(used, limit) -> Column:
    """Rounded percent of the limit; a dash where there is none."""
    u, m = _col(used), _col(limit)
    return F.when(F.coalesce(m, F.lit(0)) == 0, F.lit("—")).otherwise(
        F.concat(F.floor(u.cast("double") / m * 100 + 0.5).cast("string"), F.lit("%"))
    )


def percent_of(limit: int, percent: int) -> int:
    """Thresholds multiply first and divide as integers."""
    return limit * percent // 100


def json_string(c) -> Column:
    """A text as a JSON string, escaped."""
    one = F.to_json(F.array(_col(c)))
    return F.substring(one, F.lit(2), F.char_length(one) - 2)

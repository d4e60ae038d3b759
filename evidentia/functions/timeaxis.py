"""Valid-time rules as Column expressions over (temporal_kind, valid_start, valid_end); NULL is an open bound.

Each rule gives a pair (eligible, uncertain). Unknown times and windows (one instant somewhere inside) are
never eligible, only uncertain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARLIEST, LATEST = -(1 << 62), 1 << 62


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _extent(prefix: str):
    return tuple(F.col(f"{prefix}{c}") for c in ("temporal_kind", "valid_start", "valid_end"))


def _overlaps(start: Column, end: Column, lo, hi) -> Column:
    return (start.isNull() | (start < hi)) & (end.isNull() | (end > lo))


def in_window(lo, hi, prefix: str = "") -> tuple[Column, Column]:
    """Against the half-open window [lo, hi)."""
    kind, start, end = _extent(prefix)
    lo, hi = _c(lo), _c(hi)
    eligible = F.when(kind == "instant", (start >= lo) & (start < hi)).when(kind == "interval", _overlaps(start, end, lo, hi)).otherwise(False)
    uncertain = F.when(kind == "unknown", True).when(kind == "window", _overlaps(start, end, lo, hi)).otherwise(False)
    return eligible, uncertain


def at_point(t, prefix: str = "") -> tuple[Column, Column]:
    """Against one instant."""
    kind, start, end = _extent(prefix)
    t = _c(t)
    holds = (start.isNull() | (start <= t)) & (end.isNull() | (end > t))
    eligible = F.when(kind == "instant", start == t).when(kind == "interval", holds).otherwise(False)
    return eligible, F.when(kind == "unknown", True).when(kind == "window", holds).otherwise(False)


def just_before(b, prefix: str = "") -> tuple[Column, Column]:
    """Against the moment before a boundary: what reaches up to it counts, instants never do."""
    kind, start, end = _extent(prefix)
    b = _c(b)
    reaches = (start.isNull() | (start < b)) & (end.isNull() | (end >= b))
    eligible = F.when(kind == "interval", reaches).otherwise(False)
    return eligible, F.when(kind == "unknown", True).when(kind == "window", reaches).otherwise(False)


def outside_window(lo, hi) -> Column:
    eligible, uncertain = in_window(lo, hi)
    return ~eligible & ~uncertain


def outside_point(t) -> Column:
    eligible, uncertain = at_point(t)
    return ~eligible & ~uncertain


def micros(column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _c(column))


def reach(prefix: str = "") -> tuple[Column, Column]:
    """[low, high) in microseconds of an instant or interval: an instant lasts one microsecond, the unit of time."""
    kind, start, end = _extent(prefix)
    low = F.when(start.isNull(), F.lit(EARLIEST)).otherwise(micros(start))
    high = F.when(kind == "instant", micros(start) + 1).when(end.isNull(), F.lit(LATEST)).otherwise(micros(end))
    return low, high


def overlap(left: str, right: str) -> Column:
    """Whether two instants or intervals share an instant (columns with these prefixes)."""
    (a, b), (c, d) = reach(left), reach(right)
    return (a < d) & (c < b)


def bound(prefix: str = "") -> Column:
    """The earliest bound that is known: the start, else the end."""
    _, start, end = _extent(prefix)
    return F.coalesce(start, end)


def rfc3339(column) -> Column:
    """UTC text with as many fractional digits as needed."""
    text = F.date_format(_c(column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", ""), F.lit("Z"))

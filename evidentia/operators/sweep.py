"""Running sums over the times of a group, split by time, so that a group of any size is shared among tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of one part of a group's times.
DAY = 86_400_000_000
#: Rows of one key up to which a key is summed by one task.
WHOLE = 100_000


def running(events: DataFrame, by: list[str], sums: list[str], span: int | None = DAY) -> DataFrame:
    """events (by, t, sums; one row for each group and time) with `<sum>_now`: each sum's total up to that time, itself included.

    Each part of `span` microseconds is summed by itself, after what the group's earlier parts add up to (one
    row a part). Without a span a group is summed by one task.
    """
    own = [F.sum(c).alias(c) for c in sums]
    if span is None:
        w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        return events.select("*", *(F.sum(c).over(w).alias(f"{c}_now") for c in sums))
    rows = events.withColumn("_part", F.floor(F.col("t") / span))
    parts = rows.groupBy(*by, "_part").agg(*own)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before") for c in sums))
    inside = Window.partitionBy(*by, "_part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(c).over(inside).alias(f"_{c}_inside") for c in sums)).join(parts, [*by, "_part"])
    return rows.select(*events.columns, *((F.col(f"_{c}_before") + F.col(f"_{c}_inside")).alias(f"{c}_now") for c in sums))


def turns(rows: DataFrame, by: list[str], low: str, high: str, sums: dict) -> DataFrame:
    """(by, t, sums): what changes at each time when a row adds its sums from `low` until `high`; changes of a time are added up."""
    both = rows.select(*by, *(v.alias(k) for k, v in sums.items()), F.explode(F.array(F.struct(F.col(low).alias("t"), F.lit(1).alias("d")), F.struct(F.col(high).alias("t"), F.lit(-1).alias("d")))).alias("_e"))
    return both.groupBy(*by, F.col("_e.t").alias("t")).agg(*(F.sum(F.col(k) * F.col("_e.d")).alias(k) for k in sums))

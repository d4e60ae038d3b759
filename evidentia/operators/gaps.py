"""What a result does not tell: evidence outside the selection, excluded by authority, or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.authority import asked_ends


def requested_ends(rows: DataFrame) -> DataFrame:
    """(entity_id, obs_id, predicate) of requested entities that a row's ends resolve to; rows as qualify() gives them."""
    return rows.select("obs_id", "predicate", F.explode(asked_ends(resolved_only=True)).alias("entity_id"))


def valid_time_gaps(cands: DataFrame, outside: Column, label: str) -> DataFrame:
    """Per requested entity and predicate: evidence that lies outside the selection for certain; entity blank if no end was requested."""
    ends = asked_ends(resolved_only=True)
    rows = cands.where((F.col("status") != "rejected") & outside).select(F.explode(F.when(F.size(ends) > 0, ends).otherwise(F.array(F.lit("")))).alias("entity_id"), "predicate")
    return rows.distinct().select(F.lit("valid-time-excluded").alias("kind"), "entity_id", F.lit(label).alias("label"), "predicate")


def coverage_gaps(coverage: DataFrame, outside: Column | None = None) -> DataFrame:
    """Authority and mention gaps; coverage for certain outside a point or trajectory selection is left out, for a trend it stays."""
    rows = coverage.where(F.col("reason").isin("unresolved-mention", "authority-excluded"))
    rows = rows if outside is None else rows.where(~outside)
    return rows.select(F.col("reason").alias("kind"), "entity_id", F.lit(None).cast("string").alias("label"), "predicate").distinct()


def no_evidence(requested: DataFrame, *material: DataFrame) -> DataFrame:
    """Requested entities without any fact, unresolved key or gap."""
    told = None
    for m in material:
        own = m.select("entity_id").where("entity_id is not null")
        told = own if told is None else told.unionByName(own)
    out = requested.distinct()
    out = out if told is None else out.join(told.distinct(), "entity_id", "left_anti")
    null = F.lit(None).cast("string")
    return out.select(F.lit("no-evidence").alias("kind"), "entity_id", null.alias("label"), null.alias("predicate"))


def in_order(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy("entity_id", "kind", F.col("label").asc_nulls_first(), F.col("predicate").asc_nulls_first())


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").otherwise("6-plus")

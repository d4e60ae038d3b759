"""Explicit causal claims; chronology alone never makes one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.timeaxis import bound, in_window
from evidentia.schema import CAUSES


def causal_links(cands: DataFrame, links: DataFrame, lo, hi, predicate: str = CAUSES) -> DataFrame:
    """One row per (cause, effect) claimed in the window.

    Unlike state, uncertain rows go and rejected and counter-only rows stay. Ordered output has the earliest
    valid bound (none last), the earliest record, the smallest observation id, cause and effect.
    """
    eligible, _ = in_window(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))
    rows = cands.where(F.col("predicate") == predicate).where(eligible).withColumn("bound", bound())
    evidence = links.groupBy("obs_id").agg(
        F.count_if(F.col("role") == "supporting").alias("n_sup"), F.count_if(F.col("role") == "contradicting").alias("n_con")
    )
    rows = rows.join(evidence, "obs_id", "left")
    names = {"subject_kind": "cause_kind", "subject_ref": "cause_ref", "object_kind": "effect_kind", "object_ref": "effect_ref"}
    return rows.groupBy(*(F.col(a).alias(b) for a, b in names.items())).agg(
        F.count("*").alias("n_observations"), F.min("bound").alias("first_bound"), F.min("recorded_at").alias("first_recorded"),
        F.min("obs_id").alias("first_obs"), F.coalesce(F.sum("n_sup"), F.lit(0)).alias("n_supporting"),
        F.coalesce(F.sum("n_con"), F.lit(0)).alias("n_contradicting"),
    )


def in_order(of_links: DataFrame) -> DataFrame:
    return of_links.orderBy(F.col("first_bound").asc_nulls_last(), "first_recorded", "first_obs", "cause_kind", "cause_ref", "effect_kind", "effect_ref")

"""Answers as nested rows and JSON: facts with their contributions and exact citations, in canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import timeaxis as ta
from evidentia.functions.order import CITATION, _place
from evidentia.operators.state import KEY, VALUE
from evidentia.schema import EXTENT_KINDS, TERM_KINDS

#: Columns of an observation that a contribution shows, after its id.
CONTRIBUTION = ("status", "temporal_kind", "valid_start", "valid_end", "recorded_at", "subject_grounding", "object_grounding")


def _term(kind: str, ref: str) -> Column:
    return F.struct(F.col(kind).alias("kind"), F.col(ref).alias("ref"))


def key_struct() -> Column:
    return F.struct(_term("subject_kind", "subject_ref").alias("subject"), F.col("predicate"))


def _contribution() -> Column:
    """Ordered first by id, status and extent as extents are ordered; the ranks are dropped again by _shown."""
    start, end = F.col("valid_start"), F.col("valid_end")
    return F.struct(
        "obs_id", "status", _place("temporal_kind", EXTENT_KINDS).alias("_kind"), start.isNull().alias("_no_start"), ta.rfc3339("valid_start").alias("valid_start"), end.isNull().alias("_no_end"),
        ta.rfc3339("valid_end").alias("valid_end"), ta.rfc3339("recorded_at").alias("recorded_at"), "subject_grounding", "object_grounding", "temporal_kind",
    )


def _shown(rows: Column) -> Column:
    return F.transform(rows, lambda x: F.struct(x["obs_id"].alias("obs_id"), *(x[c].alias(c) for c in CONTRIBUTION)))


def cited_values(told: DataFrame, by: list[str]) -> DataFrame:
    """Per group, key and value: its contributions and its citations by role, each in order.

    told: rows of (by, key, value, obs_id, CONTRIBUTION, and the columns of a citation). A row holds all that tells
    one value, so told must be bounded (the engine counts it first).
    """
    held = lambda role: F.sort_array(F.collect_set(F.when(F.col("role") == role, F.struct(*CITATION))))
    out = told.groupBy(*by, *KEY, *VALUE).agg(
        _shown(F.sort_array(F.collect_set(_contribution()))).alias("contributions"), held("supporting").alias("supporting"), held("contradicting").alias("contradicting"),
    )
    return out.withColumn("fact", F.struct(key_struct().alias("key"), _term("object_kind", "object_ref").alias("value"), "contributions", "supporting", "contradicting"))


def _ranked(kind: str, ref: str) -> list[Column]:
    return [_place(kind, TERM_KINDS), F.col(ref)]


def candidates_of(values: DataFrame, by: list[str]) -> DataFrame:
    """Per group and key the cited values as a list in order of their terms."""
    item = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(_ranked("object_kind", "object_ref"))), F.col("fact").alias("fact"))
    return values.groupBy(*by, *KEY).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["fact"]).alias("candidates"))


def place_of_key() -> list[Column]:
    """Columns by which members are put in order of their keys."""
    return [*_ranked("subject_kind", "subject_ref"), F.col("predicate")]


def member(df: DataFrame, order: list[Column], content: Column) -> DataFrame:
    """(order, content): the rows of one member of an answer, and what puts them in order."""
    return df.select(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("order"), content.alias("content"))


def lines(members: dict[str, DataFrame]) -> DataFrame:
    """(member, json): one row for each row of an answer, in no order; for answers of any size."""
    out = None
    for name, df in members.items():
        one = df.select(F.lit(name).alias("member"), F.to_json("content", {"ignoreNullFields": "false"}).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out


def gathered(members: dict[str, DataFrame]) -> DataFrame:
    """One row with an ordered array for each member, never null; for answers whose size has been checked."""
    out = None
    for name, df in members.items():
        one = df.select(F.transform(F.array_sort(F.collect_list(F.struct("order", "content"))), lambda x: x["content"]).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out

"""From candidate rows to resolved facts and unresolved keys, for any number of selections at once.

Candidates have one row per admitted observation: `sel` columns (what separates selections, such as a
selection label), the key (subject_kind, subject_ref, predicate), the value (object_kind, object_ref), the
extent, recorded_at, status and `supported` (has a supporting evidence link). Ids and evidence stay in their
own tables and are joined by provenance(), so that no key's rows are gathered in one task: all aggregates
here hold numbers and are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.timeaxis import reach
from evidentia.operators.sweep import DAY, WHOLE, running, turns
from evidentia.plans.lineage import cut

KEY = ["subject_kind", "subject_ref", "predicate"]
VALUE = ["object_kind", "object_ref"]


def dedupe_observations(df: DataFrame, id_col: str = "obs_id") -> DataFrame:
    """One row per id; a repeat must equal its first row in every column, else the query fails."""
    rest = [c for c in df.columns if c != id_col]
    row = F.struct(*rest)
    one = df.groupBy(id_col).agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    clash = F.raise_error(F.concat(F.lit("divergent rows for observation "), F.col(id_col)))
    return one.select(id_col, F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(clash).alias("r")).select(id_col, *(F.col(f"r.{c}").alias(c) for c in rest))


def candidates(observations: DataFrame, links: DataFrame, cutoff=None) -> DataFrame:
    """Observations known by the (inclusive) recorded cutoff, flagged whether any link supports them."""
    if cutoff is not None:
        observations = observations.where(F.col("recorded_at") <= F.lit(cutoff).cast("timestamp_ntz"))
    support = links.where("role = 'supporting'").select("obs_id").distinct().withColumn("supported", F.lit(True))
    return observations.join(support, "obs_id", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def labelled(cands: DataFrame, rules: dict) -> tuple[DataFrame, Column, Column]:
    """Rows once for each selection that they meet, with its `label`, and the two columns that aggregate() asks for.

    rules: label -> (eligible, uncertain). So several selections are aggregated in one pass, by sel=["label"].
    """
    hit = [F.when(eligible | uncertain, F.struct(F.lit(label).alias("label"), uncertain.alias("unsure"))) for label, (eligible, uncertain) in rules.items()]
    met = F.explode(F.filter(F.array(*hit), lambda x: x.isNotNull()))
    rows = cands.withColumn("_met", met).select(*cands.columns, F.col("_met.label").alias("label"), F.col("_met.unsure").alias("unsure"))
    return rows, ~F.col("unsure"), F.col("unsure")


def classify(cands: DataFrame, eligible: Column, uncertain: Column) -> DataFrame:
    """Rows in the selection with their class: counter-only (c), tentative (t) or supported (s).

    The order decides: no supporting link, then uncertain or hypothesized, then supported. Rejected rows go.
    """
    rows = cands.where(F.col("status") != "rejected").withColumn("uncertain", uncertain).where(eligible | F.col("uncertain"))
    cls = F.when(~F.col("supported"), "c").when(F.col("uncertain") | (F.col("status") == "hypothesized"), "t").otherwise("s")
    return rows.withColumn("cls", cls)


def values(classified: DataFrame, sel: list[str]) -> DataFrame:
    """Per selection, key and value: which classes occur, whether tentative ones are uncertain or hypothesized, and a value's rows."""
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    cls = F.col("cls")
    return classified.groupBy(*sel, *KEY, *VALUE).agg(
        has(cls == "s").alias("s"), has(cls == "t").alias("t"), has(cls == "c").alias("c"),
        has((cls == "t") & F.col("uncertain")).alias("t_time"), has((cls == "t") & ~F.col("uncertain")).alias("t_hypo"),
        F.count("*").alias("n_rows"), F.sum(F.when(cls == "s", 1).otherwise(0)).alias("n_supported_rows"),
        F.min("recorded_at").alias("first_recorded"), F.min("obs_id").alias("first_obs"),
        F.min(F.when(cls == "s", F.col("recorded_at"))).alias("first_s_recorded"), F.min(F.when(cls == "s", F.col("obs_id"))).alias("first_s_obs"),
    )


def overlapping_keys(classified: DataFrame, of_values: DataFrame, sel: list[str], at_point: bool = False) -> DataFrame:
    """Keys of which two different supported values hold at one instant.

    A sweep instead of pairs: a value holds while any of its extents is open, and a key overlaps where two
    values hold. Only keys with several supported values come here. A key's rows are brought together once, if
    there are few (WHOLE); the times of larger keys are split by days, so that they are shared among tasks, and
    without any such key there is no second branch. At one instant (at_point) several supported values overlap.
    """
    key = [*sel, *KEY]
    several = of_values.groupBy(*key).agg(F.sum("s").alias("ns"), F.sum("n_supported_rows").alias("rows")).where("ns > 1").select(*key, "rows")
    if at_point:
        return several.select(*key)
    several = cut(several)
    largest = several.agg(F.max("rows")).first()[0] or 0
    low, high = reach()
    rows = classified.where("cls = 's'").join(several, key).select(*key, *VALUE, "rows", low.alias("low"), high.alias("high"))

    def overlapping(part, span):
        open_ = running(turns(part, [*key, *VALUE], "low", "high", {"n": F.lit(1)}), [*key, *VALUE], ["n"], span)
        held = (F.col("n_now") > 0).cast("int") - (F.col("n_now") - F.col("n") > 0).cast("int")
        steps = open_.withColumn("step", held).where("step <> 0").groupBy(*key, "t").agg(F.sum("step").alias("step"))
        return running(steps, key, ["step"], span).where("step_now > 1").select(*key).distinct()

    small = rows.where(F.col("rows") <= WHOLE).repartition(*key)
    if largest <= WHOLE:
        return overlapping(small, None)
    return overlapping(small, None).unionByName(overlapping(rows.where(F.col("rows") > WHOLE), DAY))


def keys(of_values: DataFrame, overlapping: DataFrame, sel: list[str]) -> DataFrame:
    """Per selection and key: `outcome` (resolved, or the first reason that holds), the value if resolved, and the earliest
    record and smallest id of the observations that tell it (a fact's are its supported rows)."""
    key = [*sel, *KEY]
    one = of_values.groupBy(*key).agg(
        F.sum("s").alias("n_supported"), F.sum("c").alias("n_counter"), F.count("*").alias("n_values"),
        F.max(F.when((F.col("t_time") == 1) & (F.col("s") == 0), 1).otherwise(0)).alias("other_time"),
        F.max(F.when((F.col("t_hypo") == 1) & (F.col("s") == 0), 1).otherwise(0)).alias("other_hypo"),
        F.max(F.when(F.col("s") == 1, F.struct(*VALUE))).alias("value"),
        F.min("first_recorded").alias("any_recorded"), F.min("first_obs").alias("any_obs"), F.min("first_s_recorded").alias("s_recorded"), F.min("first_s_obs").alias("s_obs"),
    )
    one = one.join(overlapping.withColumn("overlaps", F.lit(True)), key, "left")
    resolved = (F.col("n_counter") == 0) & (F.col("n_supported") == 1) & (F.col("other_time") == 0) & (F.col("other_hypo") == 0)
    outcome = (
        F.when(resolved, "resolved").when(F.col("other_time") == 1, "temporal-uncertainty").when(F.col("other_hypo") == 1, "hypothesized")
        .when((F.col("n_supported") > 1) & F.col("overlaps"), "conflicting-values").when(F.col("n_supported") > 1, "multiple-states-in-window")
        .when(F.col("n_counter") > 0, "counterevidence-only")
    )
    held = [F.when(resolved, F.col(f"value.{v}")).alias(v) for v in VALUE]
    first = [F.when(resolved, F.col(f"s_{c}")).otherwise(F.col(f"any_{c}")).alias(f"first_{c}") for c in ("recorded", "obs")]
    return one.select(*key, outcome.alias("outcome"), *held, "n_values", "n_supported", "n_counter", *first)


def aggregate(cands: DataFrame, eligible: Column, uncertain: Column, sel: list[str] | None = None, at_point: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classified rows, value table, key table) of the selection that the two columns state.

    The value table is cut: overlaps and keys both start from it, so rows are aggregated once. at_point: the selection
    is one instant.
    """
    sel = sel or []
    rows = classify(cands, eligible, uncertain)
    of_values = cut(values(rows, sel))
    return rows, of_values, keys(of_values, overlapping_keys(rows, of_values, sel, at_point), sel)


def provenance(classified: DataFrame, of_keys: DataFrame, links: DataFrame, sel: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Long form: each contributing observation with its links, and the columns of it that `carry` names.

    A resolved key is told by its supported rows alone; an unresolved key by all its rows.
    """
    key = [*(sel or []), *KEY]
    rows = classified.join(of_keys.select(*key, "outcome"), key).where("outcome <> 'resolved' or cls = 's'")
    return rows.join(links, "obs_id", "left").select(*key, *VALUE, "outcome", "cls", "obs_id", *(carry or []), *(c for c in links.columns if c != "obs_id"))


def compare(of_keys: DataFrame, before: str, after: str, label: str = "label") -> DataFrame:
    """Added, removed and changed keys between two labels; keys unresolved on either side have kind `unresolved`."""
    side = lambda name, tag: of_keys.where(F.col(label) == name).select(*KEY, F.col("outcome").alias(f"{tag}_outcome"), *(F.col(v).alias(f"{tag}_{v}") for v in VALUE))
    both = side(before, "before").join(side(after, "after"), KEY, "full_outer")
    open_ = (F.coalesce("before_outcome", F.lit("resolved")) != "resolved") | (F.coalesce("after_outcome", F.lit("resolved")) != "resolved")
    same = F.lit(True)
    for v in VALUE:
        same &= F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    kind = F.when(open_, "unresolved").when(F.col("before_outcome").isNull(), "added").when(F.col("after_outcome").isNull(), "removed").when(~same, "changed")
    return both.withColumn("change", kind).where("change is not null")

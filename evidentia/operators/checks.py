"""What must hold of snapshots and results whatever the data: each check gives the rows that break it, so none is right.

Every check returns (member, detail, fault); faults() unites several, and require() raises on the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.state import KEY, VALUE, compare
from evidentia.schema import CAUSES, COVERAGE_CLASSES, UNRESOLVED_REASONS


class Inconsistent(ValueError):
    """Rows contradict each other; no answer is given from them."""


def _fault(rows: DataFrame, member: str, detail, fault) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(F.lit(member).alias("member"), lit(detail).cast("string").alias("detail"), lit(fault).alias("fault"))


def _key(prefix: str = "") -> Column:
    return F.to_json(F.struct(*(F.col(f"{prefix}{k}") for k in KEY)))


def faults(*found: DataFrame) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def require(*found: DataFrame) -> None:
    first = faults(*found).first()
    if first is not None:
        raise Inconsistent(f"{first['member']} {first['detail']}: {first['fault']}")


def term_maps(state_kind: Column, state_ref: Column, kind: Column, ref: Column, grounding: Column) -> Column:
    """Whether a resolved term may stand for a source term: an entity for itself without a grounding, an entity for a
    mention that grounds it, text and absence for themselves."""
    same = (state_kind == kind) & state_ref.eqNullSafe(ref)
    return F.coalesce(
        F.when(kind == "mention", (state_kind == "entity") & state_ref.isNotNull() & (grounding == ref))
        .when(kind == "entity", same & grounding.isNull()).when(kind.isin("text", "absent"), same & grounding.isNull()), F.lit(False),
    )


def candidate_faults(cands: DataFrame, observations: DataFrame) -> DataFrame:
    """Candidates whose predicate or terms don't come from their observation; grounding columns are told by the candidate."""
    o = observations.select("obs_id", *(F.col(c).alias(f"o_{c}") for c in (*KEY, *VALUE)))
    rows = cands.join(o, "obs_id", "left")
    ok = F.col("predicate").eqNullSafe(F.col("o_predicate"))
    for end in ("subject", "object"):
        ok &= term_maps(F.col(f"{end}_kind"), F.col(f"{end}_ref"), F.col(f"o_{end}_kind"), F.col(f"o_{end}_ref"), F.col(f"{end}_grounding"))
    return _fault(rows.where(~ok), "candidate", F.col("obs_id"), "not of its observation")


def qualification_faults(qualified: DataFrame, coverage: DataFrame, requested: DataFrame) -> DataFrame:
    """An observation has one class of the closed set, a coverage row occurs once and names a requested entity."""
    one = qualified.groupBy("obs_id").agg(F.count("*").alias("n"), F.count_distinct("class").alias("classes"), F.min("class").alias("class"))
    bad = F.when(F.col("classes") != 1, "contradicting classes").when(F.col("n") > 1, "twice").when(~F.col("class").isin(*COVERAGE_CLASSES), "unknown class")
    out = one.withColumn("_f", bad).where("_f is not null")
    rows = coverage.groupBy("entity_id", "predicate", "obs_id", "reason").agg(F.count("*").alias("n"))
    unasked = coverage.join(requested.select("entity_id").distinct(), "entity_id", "left_anti")
    return faults(_fault(out, "qualified", F.col("obs_id"), F.col("_f")), _fault(rows.where("n > 1"), "coverage", F.col("obs_id"), "twice"), _fault(unasked, "coverage", F.col("obs_id"), "not requested"))


def summary_faults(of_keys: DataFrame, of_values: DataFrame, sel: list[str] | None = None) -> DataFrame:
    """A key occurs once in a selection, resolved with a value or unresolved for a known reason, with distinct candidates,
    at least one, and two where values conflict."""
    key = [*(sel or []), *KEY]
    resolved, conflict = F.col("outcome") == "resolved", F.col("outcome") == "conflicting-values"
    known = F.coalesce(F.col("outcome").isin("resolved", *UNRESOLVED_REASONS), F.lit(False))
    odd = ~known | (resolved & F.col("object_kind").isNull())
    # both frames are gone through once and counted together: numbers only, added up before they are shuffled
    told = of_keys.select(*key, F.lit(1).alias("n"), odd.cast("int").alias("odd"), F.coalesce(conflict, F.lit(False)).cast("int").alias("open"), *(F.lit(0).alias(c) for c in ("held", "same")))
    values = of_values.groupBy(*key, *VALUE).agg(F.count("*").alias("same")).select(*key, *(F.lit(0).alias(c) for c in ("n", "odd", "open")), F.lit(1).alias("held"), "same")
    of = told.unionByName(values).groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("n", "odd", "open", "held")), F.max("same").alias("same")).where("n > 0")
    held, n = F.col("held"), F.col("n")
    single = F.when(held < 2, F.col("open")).otherwise(0)
    times = {
        "key twice": (n > 1).cast("int"), "no known outcome": F.col("odd"), "no candidates": F.when(held == 0, n).otherwise(0), "conflict of one value": F.when(held > 0, single).otherwise(0),
        "a value twice": F.when((held > 0) & (F.col("same") > 1), n - single).otherwise(0),
    }
    found = of.withColumn("_f", F.explode(F.flatten(F.array(*(F.array_repeat(F.lit(fault), k.cast("int")) for fault, k in times.items())))))
    return _fault(found, "summary", _key(), F.col("_f"))


def fact_faults(told: DataFrame, sel: list[str] | None = None) -> DataFrame:
    """Each value that is told has at least one observation and one piece of evidence; told: state.provenance()."""
    one = told.groupBy(*(sel or []), *KEY, *VALUE).agg(F.count("obs_id").alias("o"), F.count("evidence_id").alias("e")).where("o = 0 OR e = 0")
    return _fault(one, "fact", _key(), F.when(F.col("o") == 0, "no observation").otherwise("no evidence"))


def trend_faults(of_keys: DataFrame, changes: DataFrame, before: str, after: str) -> DataFrame:
    """The changes are exactly those that follow from the two windows' keys; each kind has the sides that it needs."""
    again = compare(of_keys, before, after)
    cols = [*KEY, "change", *(f"{s}_{v}" for s in ("before", "after") for v in VALUE), "before_outcome", "after_outcome"]
    lost, extra = (a.select(*cols).exceptAll(b.select(*cols)) for a, b in ((again, changes), (changes, again)))
    return faults(_fault(lost, "change", _key(), "missing"), _fault(extra, "change", _key(), "does not follow"), change_faults(changes, "change"))


def change_faults(changes: DataFrame, member: str) -> DataFrame:
    """added has only a value after, removed only one before, changed two different ones."""
    had, has = (F.col(f"{s}_object_kind").isNotNull() for s in ("before", "after"))
    same = F.lit(True)
    for v in VALUE:
        same &= F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    ok = F.when(F.col("change") == "added", ~had & has).when(F.col("change") == "removed", had & ~has).when(F.col("change") == "changed", had & has & ~same).otherwise(F.col("change") == "unresolved")
    return _fault(changes.where(~ok), member, _key(), "shape")


def transition_faults(moves: DataFrame, lo, hi) -> DataFrame:
    """Transitions lie inside the window, one for a key and instant, with the sides of their kind."""
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    out = moves.where((F.col("instant") < ntz(lo)) | (F.col("instant") >= ntz(hi)))
    twice = moves.groupBy(*KEY, "instant").agg(F.count("*").alias("n")).where("n > 1")
    return faults(_fault(out, "transition", _key(), "outside"), _fault(twice, "transition", _key(), "twice"), change_faults(moves, "transition"))


def gap_faults(gaps: DataFrame, entity_ids, labels, predicates=(), causal: bool = False) -> DataFrame:
    """A gap names only requested entities, labels and predicates; only a causal question can lack causal evidence."""
    entity, label, predicate = F.coalesce("entity_id", F.lit("")), F.coalesce("label", F.lit("")), F.coalesce("predicate", F.lit(""))
    wrong = (
        F.when(~entity.isin("", *entity_ids), "entity not requested").when(~label.isin("", *labels), "label not requested")
        .when((predicate != "") & F.lit(bool(predicates)) & ~predicate.isin("", *predicates), "predicate not requested")
        .when((F.col("kind") == "no-causal-evidence") & (F.lit(not causal) | ~predicate.isin("", CAUSES)), "not a causal question")
    )
    return _fault(gaps.withColumn("_f", wrong).where("_f is not null"), "gap", F.concat_ws(" ", "kind", "entity_id", "label", "predicate"), F.col("_f"))


def chain_faults(violations: DataFrame, member: str) -> DataFrame:
    """The rows of authority.chain_violations() or digest_violations(), as faults."""
    fault = F.col("fault") if "fault" in violations.columns else F.lit("digest")
    return _fault(violations, member, F.col("id"), fault)

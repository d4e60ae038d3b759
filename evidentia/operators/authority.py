"""Append-only decision chains, admission gates, and what an observation may be used for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.evidence import TIME, digest, frame
from evidentia.functions.timeaxis import micros
from evidentia.plans.lineage import cut
from evidentia.schema import ADMISSION_OUTCOMES, ADMISSION_TARGETS

#: Who may decide (fixed values), and the longest reason code in characters.
RESOLVERS, ADMITTERS, LONGEST_REASON = ("automatic", "reviewer"), ("automatic", "reviewer", "policy"), 128


def known_by(df: DataFrame, cutoff=None) -> DataFrame:
    """Rows recorded by the cutoff, itself included; all without one."""
    return df if cutoff is None else df.where(F.col("recorded_at") <= F.lit(cutoff).cast("timestamp_ntz"))


def chains(decisions: DataFrame) -> DataFrame:
    """Every decision with the root of its chain and its depth; one that reaches no root (its predecessor is missing, or
    they form a ring) is left out.

    Each row points to the one it supersedes; every round doubles how far a row points, so a chain of n takes
    log2(n) joins and none has a limit of rows or of depth.
    """
    up = F.coalesce("supersedes_id", "id")
    ways = cut(decisions.select("id", up.alias("at"), F.when(F.col("supersedes_id").isNull(), 0).otherwise(1).alias("depth"), F.col("supersedes_id").isNull().alias("done")))
    left = ways.where("not done").count()
    rounds = max(1, left).bit_length() + 1  # a longer way than all open rows runs in a ring
    while left and rounds:
        on = ways.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        moved = ways.where("not done").join(on, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        ways = cut(ways.where("done").unionByName(moved))
        left, rounds = ways.where("not done").count(), rounds - 1
    return decisions.join(ways.where("done").select("id", F.col("at").alias("root"), F.col("depth").cast("int").alias("depth")), "id")


def effective(decisions: DataFrame, cutoff=None) -> DataFrame:
    """The tail of each chain among the decisions known by the cutoff: one that no known decision supersedes.

    Known decisions are a prefix of their chain, so this equals the deepest one, without recursion.
    """
    known = known_by(decisions, cutoff)
    later = known.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id"))
    return known.join(later, "id", "left_anti")


def chain_violations(decisions: DataFrame, same: str, cutoff=None) -> DataFrame:
    """Known decisions whose predecessor is missing, not known, later, or about something else; and forks."""
    known = known_by(decisions, cutoff)
    prior = decisions.select(F.col("id").alias("p_id"), F.col("recorded_at").alias("p_recorded"), F.col(same).alias("p_same"))
    heirs = known.where("supersedes_id is not null").join(prior, F.col("supersedes_id") == F.col("p_id"), "left")
    late = F.lit(False) if cutoff is None else F.col("p_recorded") > F.lit(cutoff).cast("timestamp_ntz")
    fault = (
        F.when(F.col("p_id").isNull(), "missing-predecessor").when(late, "unknown-predecessor")
        .when(F.col("p_recorded") > F.col("recorded_at"), "time-runs-back").when(F.col(same) != F.col("p_same"), "other-target")
    )
    out = heirs.withColumn("fault", fault).where("fault is not null").select("id", "fault")
    forks = known.where("supersedes_id is not null").groupBy("supersedes_id").agg(F.count("*").alias("n")).where("n > 1")
    roots = known.where("supersedes_id is null").groupBy(same).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    return out.unionByName(forks.select(F.col("supersedes_id").alias("id"), F.lit("fork").alias("fault"))).unionByName(
        roots.select("id", F.lit("several-roots").alias("fault"))
    )


#: Rows of one target up to which it is judged by one task.
WHOLE = 50_000


def appendable(decisions: DataFrame, new: DataFrame, same: str | list[str], whole: int = WHOLE) -> DataFrame:
    """New decisions with a verdict, judged against the stored ones and against each other.

    `append`: it is the first decision of its target, or it supersedes the last one that stands, stored or of this
    batch. `replay`: an equal row is stored or comes before it. `conflict`: its id has other content, stored or before
    it. `decided`: a root where the target has one. `stale`: it supersedes what is not the last decision of its target,
    or one that was recorded after it. `unauthorised`: a correction that no reviewer makes (where new has `authority`).
    `no-id`: without an id. same: the column or columns that name the target.

    Of rivals for one place the first by (recorded_at, id) wins, so what is appended never forks: each place has one
    first heir, and heirs are followed from the stored last decision. Of rows with one id the first by
    (recorded_at, content) is judged for all: equal ones are its replays (or share its refusal), others conflicts.

    Rows go to their targets once and are judged there. What a target alone can't tell is judged by joins
    (_appendable_by_joins): targets with more than `whole` rows, and those with an id that another target has too.
    """
    same = [same] if isinstance(same, str) else list(same)
    cols = [c for c in new.columns if c != "id"]
    both = new.withColumn("_stored", F.lit(False)).unionByName(decisions.select(*new.columns).withColumn("_stored", F.lit(True)))
    apart = _apart(both, same, whole)
    if apart.isEmpty():
        return _appendable_by_target(both, new.columns, same)
    on = lambda rows: [rows[c].eqNullSafe(apart[f"_a_{c}"]) for c in same]
    within = _appendable_by_target(both.join(apart, on(both), "left_anti"), new.columns, same)
    own, old = new.join(apart, on(new), "left_semi"), decisions.select("id", *cols)
    return within.unionByName(_appendable_by_joins(old.join(apart, on(old), "left_semi"), own, same))


def _apart(both: DataFrame, same: list[str], whole: int) -> DataFrame:
    """The targets (_a_<column>) that have too many rows for one task, or an id that another target has or supersedes.

    Targets are compared by 64-bit hashes, ids met by theirs: a collision of ids only sends a target here in vain.
    """
    target, names = F.xxhash64(*same), [F.col(c).alias(f"_a_{c}") for c in same]
    bucket = F.pmod(target, F.lit(1 << 16))
    full = [r[0] for r in both.groupBy(bucket.alias("_b")).count().where(F.col("count") > whole).select("_b").collect()]
    large = both.where(bucket.isin(full)).groupBy(*same).count().where(F.col("count") > whole).select(*names)
    # of stored rows, what they supersede is looked up whatever its target
    ids = F.when(F.col("_stored") & F.col("supersedes_id").isNotNull(), F.array("id", "supersedes_id")).otherwise(F.array("id"))
    each = both.select(*same, F.explode(ids).alias("_id")).where("_id is not null").withColumns({"_h": F.xxhash64("_id"), "_t": target})
    shared = cut(each.groupBy("_h").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high")).where("_low <> _high").select("_h"))
    found = large if full else None
    if not shared.isEmpty():
        crossed = each.join(shared, "_h", "left_semi").select(*names)
        found = crossed if found is None else found.unionByName(crossed)
    return cut(found.distinct()) if found is not None else both.where("false").select(*names)


def _appendable_by_target(both: DataFrame, columns: list[str], same: list[str]) -> DataFrame:
    """appendable() where each id belongs to one target: one shuffle of stored and new rows, by target."""
    cols = [c for c in columns if c != "id"]
    row = F.struct(*cols)
    rows = both.repartition(*same).withColumn("_body", F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))
    of_id = Window.partitionBy(*same, "id")
    rows = rows.withColumn("_n", F.row_number().over(of_id.orderBy("_stored", "recorded_at", "_body")))
    rows = rows.withColumns({"_first": F.first(F.when(~F.col("_stored"), F.col("_body")), ignorenulls=True).over(of_id.orderBy("_stored", "recorded_at", "_body").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = rows.withColumn("_old", F.max(F.when(F.col("_stored"), row)).over(of_id))
    rows = rows.withColumn("_starts", F.row_number().over(Window.partitionBy(*same).orderBy("id")) == 1)
    barred = F.lit(False) if "authority" not in columns else F.col("supersedes_id").isNotNull() & ~F.coalesce(F.col("authority") == "reviewer", F.lit(False))
    told = (
        F.when(F.col("id").isNull(), "no-id").when(F.col("_old").isNotNull(), F.when(row.eqNullSafe(F.col("_old")), "replay").otherwise("conflict"))
        .when(F.col("_body") != F.col("_first"), "conflict")
    )
    named = F.lit(True)
    for c in same:
        named &= F.col(c).isNotNull()
    head = ~F.col("_stored") & (F.col("_n") == 1)
    rows = rows.select(*columns, "_stored", "_starts", head.alias("_head"), told.alias("_told"), barred.alias("_barred"), named.alias("_named"), micros("recorded_at").alias("_at"))
    rows = rows.withColumn("_open", F.col("_head") & F.col("_told").isNull() & ~F.col("_barred"))
    won = rows.mapInArrow(_winners, T.StructType([*rows.schema.fields, T.StructField("_won", T.BooleanType())])).where("not _stored")
    refused = F.when(F.col("_barred"), "unauthorised").when(F.col("supersedes_id").isNull(), "decided").otherwise("stale")
    verdict = F.coalesce("_told", F.when(F.col("_won"), F.when(F.col("_head"), "append").otherwise("replay")).otherwise(refused))
    return won.select(*columns, verdict.alias("verdict"))


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with `_won`: whether a row's id takes its place. Rows of a target follow each other, the first has `_starts`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = batch.column("_starts").to_numpy(zero_copy_only=False).nonzero()[0]
        if not len(starts):
            held.append(batch)
            continue
        yield from _judged([*held, batch.slice(0, starts[-1])])
        held = [batch.slice(starts[-1])]
    yield from _judged(held)


def _judged(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole targets with `_won`."""
    rows = pa.Table.from_batches(batches) if batches else None
    if rows is None or not rows.num_rows:
        return
    ids, ups, ats, opens, stored, named, starts = (rows.column(c).to_pylist() for c in ("id", "supersedes_id", "_at", "_open", "_stored", "_named", "_starts"))
    begins = [i for i, s in enumerate(starts) if s or not i] + [len(ids)]
    won: list[bool] = []
    for low, high in zip(begins, begins[1:], strict=False):
        of = range(low, high)
        gone = {ups[i] for i in of if stored[i]}
        tails = {ids[i]: ats[i] for i in of if stored[i] and named[i] and ids[i] not in gone}
        heads = {ids[i]: ats[i] for i in of if opens[i]}
        first: dict = {}  # a place (what is superseded; None: the root's) and its first heir
        for i in of:
            if opens[i]:
                up, at = ups[i], ats[i]
                before = heads.get(up, tails.get(up))
                if (up is None and not tails) or (up is not None and before is not None and at is not None and before <= at):
                    first[up] = min(first.get(up, (at is not None, at or 0, ids[i])), (at is not None, at or 0, ids[i]))
        way, taken = [None, *tails], set()
        while way:
            heir = first.pop(way.pop(), None)
            if heir:
                taken.add(heir[2])
                way.append(heir[2])
        won += [not stored[i] and ids[i] is not None and ids[i] in taken for i in of]
    yield from rows.append_column("_won", pa.array(won, pa.bool_())).to_batches()


def _appendable_by_joins(decisions: DataFrame, new: DataFrame, same: list[str]) -> DataFrame:
    """appendable() of any targets, however large, and ids, whatever their targets.

    Heirs are followed by pointer doubling (chains()), whatever the batch's order or the length of its chains. Rivals of
    a place are found by a minimum that is combined before its shuffle.
    """
    cols = [c for c in new.columns if c != "id"]
    row = lambda p: F.struct(*(F.col(f"{p}{c}") for c in cols))
    rows = new.withColumn("_body", F.sha2(F.to_json(row(""), {"ignoreNullFields": "false"}), 256))
    first = rows.groupBy("id").agg(F.min(F.struct("recorded_at", "_body")).alias("_first"))
    rows = rows.join(first, "id", "left").withColumn("_n", F.row_number().over(Window.partitionBy("id", "_body").orderBy(F.lit(0))))
    rows = rows.withColumn("_head", F.col("id").isNotNull() & (F.col("_n") == 1) & F.coalesce(F.col("_body") == F.col("_first._body"), F.lit(False)))
    old = decisions.select(F.col("id").alias("o_id"), *(F.col(c).alias(f"o_{c}") for c in cols))
    tails = effective(decisions).select(F.col("id").alias("t_id"), F.col("recorded_at").alias("t_at"), *(F.col(c).alias(f"t_{c}") for c in same))
    rows = rows.join(old, F.col("id") == F.col("o_id"), "left").join(tails, [F.col(c) == F.col(f"t_{c}") for c in same], "left")
    barred = F.lit(False) if "authority" not in new.columns else F.col("supersedes_id").isNotNull() & ~F.coalesce(F.col("authority") == "reviewer", F.lit(False))
    rows = cut(rows.withColumn("_barred", barred))

    heads = rows.where(F.col("_head") & F.col("o_id").isNull() & ~F.col("_barred"))
    before = heads.select(F.col("id").alias("supersedes_id"), F.col("recorded_at").alias("_at"), *(F.col(c).alias(f"_{c}") for c in same))
    of_batch = heads.where(F.col("supersedes_id").isNotNull()).join(before, "supersedes_id")
    for c in same:
        of_batch = of_batch.where(F.col(c).eqNullSafe(F.col(f"_{c}")))
    place = [*same, "up", "supersedes_id"]
    of_batch = of_batch.where(F.col("_at") <= F.col("recorded_at")).select("id", "recorded_at", *same, F.col("supersedes_id").alias("up"), "supersedes_id")
    root = F.col("supersedes_id").isNull() & F.col("t_id").isNull()
    next_ = (F.col("supersedes_id") == F.col("t_id")) & (F.col("t_at") <= F.col("recorded_at"))
    of_stored = heads.where(F.coalesce(root | next_, F.lit(False))).select("id", "recorded_at", *same, F.lit(None).cast("string").alias("up"), "supersedes_id")
    heirs = of_batch.unionByName(of_stored)
    firsts = heirs.groupBy(*place).agg(F.min(F.struct("recorded_at", "id")).alias("_f")).select(F.col("_f.id").alias("id"), F.col("up").alias("supersedes_id"))
    won = chains(cut(firsts)).select("id", F.lit(True).alias("_won"))

    judged = rows.join(won, "id", "left")
    refused = F.when(F.col("_barred"), "unauthorised").when(F.col("supersedes_id").isNull(), "decided").otherwise("stale")
    verdict = (
        F.when(F.col("id").isNull(), "no-id")
        .when(F.col("o_id").isNotNull(), F.when(row("").eqNullSafe(row("o_")), "replay").otherwise("conflict"))
        .when(F.col("_body") != F.col("_first._body"), "conflict").when(F.col("_won"), F.when(F.col("_head"), "append").otherwise("replay")).otherwise(refused)
    )
    return judged.select(*new.columns, verdict.alias("verdict"))


def admitted(admissions: DataFrame, kind: str, cutoff=None) -> DataFrame:
    """Ids of a target kind whose effective admission is `admitted`."""
    own = admissions.where(F.col("target_kind") == kind)
    return effective(own, cutoff).where("outcome = 'admitted'").select(F.col("target_id").alias("id")).distinct()


def accepted(decisions: DataFrame, entities: DataFrame, cutoff=None) -> DataFrame:
    """Effective decisions that accept an entity known by the cutoff; a rejected tail hides the accept before it."""
    tails = effective(decisions, cutoff).where("outcome = 'accepted'")
    return tails.join(known_by(entities, cutoff).select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


def resolved_mentions(decisions: DataFrame, admissions: DataFrame, entities: DataFrame, cutoff=None) -> DataFrame:
    """mention_id -> entity_id where the admitted decisions of an admitted mention agree on one entity."""
    edges = accepted(decisions, entities, cutoff)
    edges = edges.join(admitted(admissions, "identity_decision", cutoff), "id", "left_semi")
    edges = edges.join(admitted(admissions, "mention", cutoff).select(F.col("id").alias("mention_id")), "mention_id", "left_semi")
    one = edges.groupBy("mention_id").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("last"))
    return one.where("entity_id = last").select("mention_id", "entity_id")


def resolve_terms(observations: DataFrame, mentions: DataFrame, entities: DataFrame, cutoff=None, requested: DataFrame | None = None) -> DataFrame:
    """Adds for each end <end>_entity, and flags <end>_missing (a direct entity is unknown), <end>_unresolved (a mention
    resolves to none) and <end>_asked (the entity that it names or resolves to is requested).

    Mentions and entities are looked up in one table by kind and reference, one join for each end; ends of other
    kinds are spread by the observation's id, so a frequent text is no hot key. requested: (entity_id).
    """
    known = known_by(entities, cutoff).select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    if requested is None:
        asked = known.select("_id", F.lit(False).alias("_asked"))
    else:
        asked = requested.select(F.col("entity_id").alias("_id")).distinct().withColumn("_asked", F.lit(True))
    people = known.join(asked, "_id", "full_outer").select("_id", "_known", F.coalesce("_asked", F.lit(False)).alias("_asked"))
    direct = people.select(F.lit("entity").alias("_kind"), F.col("_id").alias("_ref"), F.when(F.col("_known"), F.col("_id")).alias("_entity"), "_asked")
    told = mentions.select(F.lit("mention").alias("_kind"), F.col("mention_id").alias("_ref"), F.col("entity_id").alias("_id"))
    told = told.join(people, "_id", "left").select("_kind", "_ref", F.col("_id").alias("_entity"), F.coalesce("_asked", F.lit(False)).alias("_asked"))
    names = direct.unionByName(told).withColumn("_spread", F.lit(0))
    for end in ("subject", "object"):
        kind = F.col(f"{end}_kind")
        named = kind.isin("entity", "mention")
        own = names.select("_spread", F.col("_kind").alias(f"{end}_kind"), F.col("_ref").alias(f"{end}_ref"), F.col("_entity").alias(f"{end}_entity"), F.col("_asked").alias(f"{end}_asked"))
        observations = observations.withColumn("_spread", F.when(named, 0).otherwise(1 + F.pmod(F.xxhash64("obs_id"), F.lit(4096)).cast("int")))
        observations = observations.join(own, ["_spread", f"{end}_kind", f"{end}_ref"], "left").drop("_spread")
        none = F.col(f"{end}_entity").isNull()
        observations = observations.withColumns({f"{end}_missing": (kind == "entity") & none, f"{end}_unresolved": (kind == "mention") & none, f"{end}_asked": F.coalesce(f"{end}_asked", F.lit(False))})
    return observations


def evidence_visible(links: DataFrame, spans: DataFrame | None = None, versions: DataFrame | None = None, sources: DataFrame | None = None, cutoff=None) -> DataFrame:
    """Observations (obs_id) with at least one link and no link whose span, version or source is absent or recorded after
    the cutoff: one late source rejects the whole set of citations.

    spans: (evidence_id, version_id, recorded_at); versions: (version_id, source_id, recorded_at); sources:
    (source_id, recorded_at). Tables that are not given are not asked; without any, a link is enough.
    """
    if spans is None:
        return links.select("obs_id").distinct()
    seen = known_by(spans, cutoff).select("evidence_id", "version_id")
    if versions is not None:
        held = known_by(versions, cutoff).select("version_id", "source_id")
        if sources is not None:
            held = held.join(known_by(sources, cutoff).select("source_id"), "source_id", "left_semi")
        seen = seen.join(held.select("version_id"), "version_id", "left_semi")
    seen = seen.select("evidence_id").distinct().withColumn("_seen", F.lit(1))
    of = links.join(seen, "evidence_id", "left").groupBy("obs_id").agg(F.min(F.coalesce("_seen", F.lit(0))).alias("_all"))
    return of.where("_all = 1").select("obs_id")


def qualify(resolved: DataFrame, ok_observations: DataFrame, ok_evidence: DataFrame, n_requested, predicates: list[str] | None = None, match: str = "all") -> DataFrame:
    """Related observations with `class`; resolved: resolve_terms() with the requested ids, whose number is n_requested.

    Related: an end resolves to a requested entity or names one directly. The class is the first that holds:
    predicate-filtered, authority-excluded (an entity is missing), unresolved-mention, entity-filtered
    (`all`: each requested id must be among the two ends), authority-excluded (not admitted, or evidence),
    retained. Rows are judged by their own columns; the one join brings whether admission and evidence allow them.
    """
    rows = resolved.where(F.col("subject_asked") | F.col("object_asked"))
    allowed = ok_observations.select(F.col("id").alias("obs_id")).join(ok_evidence.select("obs_id"), "obs_id", "left_semi").distinct()
    rows = rows.join(allowed.withColumn("_allowed", F.lit(True)), "obs_id", "left")
    hit = [F.col(f"{e}_asked") & F.col(f"{e}_entity").isNotNull() for e in ("subject", "object")]
    twice = hit[0] & hit[1] & (F.col("subject_entity") == F.col("object_entity"))
    matched = hit[0].cast("int") + hit[1].cast("int") - twice.cast("int")
    wanted = matched >= (F.lit(n_requested) if match == "all" else F.lit(1))
    named = F.lit(True) if not predicates else F.col("predicate").isin(list(predicates))
    cls = (
        F.when(~named, "predicate-filtered").when(F.col("subject_missing") | F.col("object_missing"), "authority-excluded")
        .when(F.col("subject_unresolved") | F.col("object_unresolved"), "unresolved-mention").when(~wanted, "entity-filtered")
        .when(F.col("_allowed").isNull(), "authority-excluded").otherwise("retained")
    )
    return rows.withColumn("class", cls).drop("_allowed")


def asked_ends(resolved_only: bool = False) -> Column:
    """The requested entities that an observation's ends resolve to or, unless resolved_only, name directly."""
    ends = []
    for e in ("subject", "object"):
        name = F.col(f"{e}_entity") if resolved_only else F.coalesce(f"{e}_entity", f"{e}_ref")
        ends.append(F.when(F.col(f"{e}_asked"), name))
    return F.array_distinct(F.filter(F.array(*ends), lambda x: x.isNotNull()))


def coverage(qualified: DataFrame) -> DataFrame:
    """One row per observation not retained and requested id that it touches."""
    rows = qualified.where("class <> 'retained'").withColumn("entity_id", F.explode(asked_ends()))
    return rows.select("entity_id", "predicate", "obs_id", F.col("class").alias("reason"), "temporal_kind", "valid_start", "valid_end")


def entity_authority(requested: DataFrame, entities: DataFrame, cutoff=None) -> DataFrame:
    """(entity_id, known) for every requested id."""
    seen = known_by(entities, cutoff).select(F.col("id").alias("entity_id"), F.lit(True).alias("known")).distinct()
    return requested.distinct().join(seen, "entity_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def relationship_observations(observations: DataFrame, decisions: DataFrame, admissions: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """Current admitted observations whose two ends are entities with an effective accepted decision (ordered pairs).

    Ends resolve by effective accepted decisions alone; the decisions' own admission is not asked for here.
    """
    tails = accepted(decisions, entities)
    one = tails.groupBy("mention_id").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("last")).where("entity_id = last")
    rows = resolve_terms(observations, one.select("mention_id", "entity_id"), entities)
    rows = rows.join(admitted(admissions, "observation").select(F.col("id").alias("obs_id")), "obs_id", "left_semi").join(links.select("obs_id"), "obs_id", "left_semi")
    backed = tails.select("entity_id").distinct()
    for end in ("subject_entity", "object_entity"):
        rows = rows.join(backed.select(F.col("entity_id").alias(end)), end, "left_semi")
    return rows


def reason_fault(reason: Column) -> Column:
    """A reason code is not blank and has at most LONGEST_REASON characters."""
    return F.when(reason.isNull() | (F.trim(reason) == ""), "no-reason").when(F.char_length(reason) > LONGEST_REASON, "long-reason")


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def resolution_fault() -> Column:
    """What is wrong with a resolution decision (id, proposal_id, outcome, entity_id, authority, reason, recorded_at,
    supersedes_id), else NULL: an accepted one names an entity, a rejected one none, and none supersedes itself."""
    return (
        F.when(_blank("id"), "no-id").when(_blank("proposal_id"), "no-proposal").when(~F.coalesce(F.col("outcome").isin("accepted", "rejected"), F.lit(False)), "outcome")
        .when((F.col("outcome") == "accepted") & _blank("entity_id"), "accepted-without-entity").when((F.col("outcome") == "rejected") & ~_blank("entity_id"), "rejected-with-entity")
        .when(~F.coalesce(F.col("authority").isin(*RESOLVERS), F.lit(False)), "authority").otherwise(F.coalesce(
            reason_fault(F.col("reason")), F.when(F.col("recorded_at").isNull(), "no-time").when(F.trim("supersedes_id") == F.trim("id"), "supersedes-itself")
        ))
    )


def admission_fault() -> Column:
    """The same for an admission decision (id, target_kind, target_id, outcome, authority, reason, recorded_at, supersedes_id)."""
    among = lambda name, values: ~F.coalesce(F.col(name).isin(*values), F.lit(False))
    return (
        F.when(_blank("id"), "no-id").when(among("target_kind", ADMISSION_TARGETS), "target-kind").when(_blank("target_id"), "no-target")
        .when(among("outcome", ADMISSION_OUTCOMES), "outcome").when(among("authority", ADMITTERS), "authority").otherwise(F.coalesce(
            reason_fault(F.col("reason")), F.when(F.col("recorded_at").isNull(), "no-time").when(F.trim("supersedes_id") == F.trim("id"), "supersedes-itself")
        ))
    )


def decision_digest(*columns: str) -> Column:
    """A decision's digest: its time, then the named columns in order, an absent one as empty; its own id is not part."""
    return digest(frame(micros("recorded_at"), TIME), *(frame(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))


RESOLUTION_DIGEST = ("proposal_id", "outcome", "entity_id", "authority", "reason", "supersedes_id")
ADMISSION_DIGEST = ("target_kind", "target_id", "outcome", "authority", "reason", "supersedes_id")


def digest_violations(decisions: DataFrame, columns: tuple[str, ...], cutoff=None) -> DataFrame:
    """(id) of known decisions whose stored `digest` is not that of their columns."""
    return known_by(decisions, cutoff).where(~F.col("digest").eqNullSafe(decision_digest(*columns))).select("id")


def pair_authority(pairs: DataFrame, decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """(first, second) pairs with whether each of the two has an effective accepted decision; relationships are told of pairs with both."""
    backed = accepted(decisions, entities).select("entity_id").distinct().withColumn("_backed", F.lit(True))
    for end in ("first", "second"):
        pairs = pairs.join(backed.withColumnRenamed("entity_id", end), end, "left").withColumn(f"{end}_accepted", F.coalesce("_backed", F.lit(False))).drop("_backed")
    return pairs.select("first", "second", "first_accepted", "second_accepted")


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The last row of each group in an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")

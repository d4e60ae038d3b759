"""Reviewer commands, automatic acceptance, owner reconciliation, and what an accepted extraction writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.evidence import opaque_id
from evidentia.operators.authority import effective

#: Commands: (command_id, proposal_id, action, entity_id, name, email, recorded_at); action is one of these.
ACTIONS = ("accept", "reject", "create", "correct-accept", "correct-reject")


def owner_choice(n_email: Column, email_owner: Column, n_provider: Column, provider_owner: Column, evaluated: Column, may_create: Column) -> tuple[Column, Column]:
    """(choice, entity): conflict, reuse or create, from the owners of an address and of a directory subject."""
    choice = (
        F.when((n_email > 1) | (n_provider > 1), "conflict")
        .when(n_provider == 1, F.when((n_email == 1) & (email_owner == provider_owner), "reuse").otherwise("conflict"))
        .when(n_email == 1, F.when(evaluated.isNull() | (evaluated == email_owner), "reuse").otherwise("conflict"))
        .when(may_create, "create").otherwise("conflict")
    )
    return choice, F.when(choice == "reuse", F.coalesce(provider_owner, email_owner))


def automatic_accepts(proposals: DataFrame, candidates: DataFrame, grounded: DataFrame) -> DataFrame:
    """Proposals that may be accepted without a reviewer: exactly one candidate by exact address, and its address
    is the proposal's grounded, normalised one.

    candidates: (proposal_id, entity_id, reason, email); grounded: (proposal_id, email).
    """
    exact = candidates.where("reason = 'exact-email'").groupBy("proposal_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"), F.min("email").alias("email"))
    return proposals.select("proposal_id").join(exact.where("n = 1"), "proposal_id").join(grounded, ["proposal_id", "email"]).select("proposal_id", "entity_id", "email")


def decide(commands: DataFrame, decisions: DataFrame, proposals: DataFrame, entities: DataFrame) -> DataFrame:
    """Each command with `verdict`: ok, unknown-proposal, unknown-entity, decided (accept or reject of a proposal that has
    a decision), undecided (correction of one that has none), or several (more than one command for a proposal).

    Rows that are ok have the decision they write: id, outcome, entity, supersedes_id.
    """
    tails = effective(decisions).select(F.col("proposal_id").alias("t_proposal"), F.col("id").alias("t_id"))
    known = proposals.select(F.col("proposal_id").alias("p_id"), "mention_id").distinct()
    ent = entities.select(F.col("id").alias("e_id")).distinct()
    n = commands.groupBy("proposal_id").agg(F.count("*").alias("n"))
    rows = commands.join(n, "proposal_id").join(known, F.col("proposal_id") == F.col("p_id"), "left")
    rows = rows.join(tails, F.col("proposal_id") == F.col("t_proposal"), "left").join(ent, F.col("entity_id") == F.col("e_id"), "left")
    fix, accepts = F.col("action").startswith("correct"), F.col("action").isin("accept", "correct-accept", "create")
    made = opaque_id(F.lit("person"), F.col("proposal_id"))
    entity = F.when(F.col("action") == "create", made).when(accepts, F.col("entity_id"))
    verdict = (
        F.when(F.col("n") > 1, "several").when(F.col("p_id").isNull(), "unknown-proposal")
        .when(accepts & (F.col("action") != "create") & F.col("e_id").isNull(), "unknown-entity")
        .when(~fix & F.col("t_id").isNotNull(), "decided").when(fix & F.col("t_id").isNull(), "undecided").otherwise("ok")
    )
    ok = verdict == "ok"
    return rows.select(
        *commands.columns, "mention_id", verdict.alias("verdict"), F.when(ok, opaque_id(F.lit("decision"), F.col("command_id"))).alias("id"),
        F.when(ok, F.when(accepts, "accepted").otherwise("rejected")).alias("outcome"), F.when(ok, entity).alias("decided_entity"), F.when(ok & fix, F.col("t_id")).alias("supersedes_id"),
    )


def written_decisions(decided: DataFrame) -> DataFrame:
    return decided.where("verdict = 'ok'").select("id", "proposal_id", "mention_id", "outcome", F.col("decided_entity").alias("entity_id"), "recorded_at", "supersedes_id")


def written_people(decided: DataFrame) -> DataFrame:
    """The entities that `create` commands make."""
    return decided.where("verdict = 'ok' AND action = 'create'").select(F.col("decided_entity").alias("id"), F.lit("person").alias("kind"), F.col("name").alias("display_name"), "recorded_at")


def written_aliases(decided: DataFrame, normal_name, normal_email) -> DataFrame:
    """(decision_id, kind, value) once each: the name as given, its normal form, and the address, of accepting commands."""
    rows = decided.where("outcome = 'accepted'").select(F.col("id").alias("decision_id"), F.explode(F.array(
        F.struct(F.lit("name").alias("kind"), F.trim("name").alias("value")), F.struct(F.lit("name").alias("kind"), normal_name(F.col("name")).alias("value")),
        F.struct(F.lit("email").alias("kind"), normal_email(F.col("email")).alias("value")),
    )).alias("a"))
    return rows.select("decision_id", "a.kind", "a.value").where("value IS NOT NULL AND value <> ''").distinct()


PROPOSAL = (
    "meeting_date string, citations array<struct<id:string,section_id:string,start:long,end:long,quote:string>>, people array<struct<id:string,name:string,email:string,citation_ids:array<string>>>,"
    " statements array<struct<id:string,speaker_id:string,text:string,citation_ids:array<string>>>,"
    " signals array<struct<id:string,subject_id:string,object_id:string,category:string,direction:string,citation_ids:array<string>>>"
)


def looked_up(lists: DataFrame, by: str, ids: str, records: DataFrame, key: str) -> DataFrame:
    """(by, records): the records that each row's list of ids names, in the list's order; ids without a record are left out.

    lists: (by, ids array). A row's list is a proposal's or an entity's own evidence, so it is short.
    """
    one = lists.select(by, F.posexplode(ids).alias("_pos", key))
    held = records.select(key, F.struct(*records.columns).alias("_record"))
    out = one.join(held, key).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_pos", "_record"))).alias("_l"))
    empty = F.from_json(F.lit("[]"), f"array<{held.schema['_record'].dataType.simpleString()}>")
    return lists.select(by).distinct().join(out, by, "left").select(by, F.coalesce(F.transform("_l", lambda x: x["_record"]), empty).alias("records"))


def projected_proposals(proposals: DataFrame, mentions: DataFrame, proposal_evidence: DataFrame, spans: DataFrame, candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Proposals as a reviewer sees them, by (recorded_at, proposal_id): with the mention, the evidence in order and the
    candidates by rank with their names."""
    lists = proposal_evidence.groupBy("proposal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "evidence_id"))), lambda x: x["evidence_id"]).alias("ids"))
    shown = looked_up(lists, "proposal_id", "ids", spans.select("evidence_id", "version_id", "section_id", "start_byte", "end_byte", "quote"), "evidence_id")
    named = candidates.join(entities.select(F.col("id").alias("entity_id"), "display_name"), "entity_id")
    ranked = named.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "display_name", "confidence", "reason"))).alias("candidates"))
    m = mentions.select(F.col("id").alias("mention_id"), "surface", "normalized_name", "proposed_email")
    rows = proposals.join(m, "mention_id").join(shown.withColumnRenamed("records", "evidence"), "proposal_id", "left").join(ranked, "proposal_id", "left")
    return rows.select("proposal_id", "mention_id", "run_id", "version_id", "recorded_at", "surface", "normalized_name", "proposed_email", "evidence", "candidates").orderBy("recorded_at", "proposal_id")


def decision_aliases(decided: DataFrame, aliases: DataFrame) -> DataFrame:
    """(decision_id, kind, value): what a decision asserts, each kind and value once, in that order."""
    rows = aliases.join(decided.where("verdict = 'ok' and outcome = 'accepted'").select(F.col("id").alias("decision_id")), "decision_id", "left_semi")
    return rows.where(F.trim("value") != "").select("decision_id", "kind", F.trim("value").alias("value")).distinct().orderBy("decision_id", "kind", "value")

"""Commands that are judged and committed in one: what is judged against the store is written before it can change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.operators import authority, directory, review
from evidentia.plans.lineage import cut
from evidentia.sources.store import Store


def _commit(store: Store, judge: Callable[[dict[str, DataFrame]], tuple[DataFrame, dict[str, DataFrame]]], batch: str | None) -> DataFrame:
    """The verdicts that judge(tables) gives, after the frames beside them are committed; none for a batch that is committed."""
    told: list[DataFrame] = []

    def run(held):
        verdicts, rows = judge(held)
        told.append(cut(verdicts))
        return {name: (df, schema.TABLES[name][1]) for name, df in rows.items()}

    store.commit(run, batch)
    return told[0] if told else store.spark.createDataFrame([], "id string, verdict string")  # the batch is committed already


def append_decisions(store: Store, new: DataFrame, aliases: DataFrame | None = None, batch: str | None = None) -> DataFrame:
    """Resolution decisions with their verdicts (authority.appendable), those to append committed with their aliases.

    new as in schema.STORED_DECISION; aliases: (decision_id, kind, value). A decision whose columns break the rules
    (authority.resolution_fault) has that as its verdict and is judged no further.
    """

    def judge(held):
        judged = _well_formed(new, authority.resolution_fault(), lambda rows: authority.appendable(held["decisions"].select(*new.columns), rows, "proposal_id"))
        good = judged.where("verdict = 'append'").drop("verdict")
        rows = {"decisions": good}
        if aliases is not None:
            rows["aliases"] = aliases.join(good.where("outcome = 'accepted'").select(F.col("id").alias("decision_id")), "decision_id", "left_semi")
        return judged, rows

    return _commit(store, judge, batch)


def append_admissions(store: Store, new: DataFrame, batch: str | None = None) -> DataFrame:
    """Admission decisions with their verdicts, those to append committed; new as in schema.STORED_ADMISSION."""

    def judge(held):
        judged = _well_formed(new, authority.admission_fault(), lambda rows: authority.appendable(held["admissions"].select(*new.columns), rows, ["target_kind", "target_id"]))
        return judged, {"admissions": judged.where("verdict = 'append'").drop("verdict")}

    return _commit(store, judge, batch)


def _well_formed(new: DataFrame, fault: Column, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = cut(new.withColumn("_fault", fault))
    wrong = rows.where("_fault is not null").select(*new.columns, F.concat(F.lit("invalid: "), "_fault").alias("verdict"))
    return cut(judge(rows.where("_fault is null").drop("_fault")).unionByName(wrong))


def review_proposals(store: Store, commands: DataFrame, normal_name, normal_email, batch: str | None = None) -> DataFrame:
    """Reviewers' commands with their verdicts (review.decide); decisions, made people, aliases and links carried over are
    committed together.

    commands: (command_id, proposal_id, action, entity_id, name, email, reason, recorded_at).
    """

    def judge(held):
        judged = cut(review.decide(commands, held["decisions"], held["proposals"], held["entities"]))
        decisions = review.written_decisions(judged).join(judged.select("id", "reason"), "id").withColumn("authority", F.lit("reviewer"))
        return judged, {
            "entities": review.written_people(judged), "decisions": decisions, "aliases": review.written_aliases(judged, normal_name, normal_email),
            "directory_links": directory.carry_over(decisions, held["directory_links"]),
        }

    return _commit(store, judge, batch)


def accept_directory_candidates(store: Store, commands: DataFrame, batch: str | None = None) -> DataFrame:
    """Reviewers' acceptances of staged directory candidates with their verdicts; decisions and links committed together."""

    def judge(held):
        judged = directory.accept_candidates(commands, held["directory_links"], held["decisions"], held["entities"])
        return judged, directory.accepted_writes(judged, held["proposals"])

    return _commit(store, judge, batch)


def enrich_directory(store: Store, answer: Callable[[DataFrame], DataFrame], domains: list[str], at: Column, fresh: str = "7 DAYS", retry: str = "1 HOUR", batch: str | None = None) -> DataFrame:
    """One run of the directory over what is pending: (mention_id, state, kind, value, verdict, authority, entity_id).

    Mentions with a fresh answer or a retry that is not due are told and not asked (see directory.pending). The rest
    are asked once each, before the store is held; what the answers decide is judged against the tables as they stand
    then, and written in one commit: profiles, lookups, entities, candidates, decisions with aliases, and links.
    answer: directory.searched() or found() with their directory bound.
    """
    work = cut(directory.pending(store.snapshot(), at, fresh, retry))
    asked = directory.questions(work.where("state = 'ask'").drop("state"), domains)
    answers, candidates = directory.answered(asked, answer)

    def judge(held):
        open_ = asked.join(authority.effective(held["decisions"]).where("authority = 'reviewer'").select("proposal_id").distinct(), "proposal_id", "left_anti")
        owners, links = directory.email_owners(held["aliases"], held["decisions"]), directory.provider_owners(held["directory_links"], held["decisions"])
        rows = cut(directory.judged(directory.evaluated(open_, answers, owners, links, domains), held["decisions"], owners, links, held["directory_links"]))
        told = work.join(rows.select("mention_id", "kind", "value", "verdict", "authority", "entity_id"), "mention_id", "left")
        return told.select("mention_id", "state", "kind", "value", "verdict", "authority", "entity_id"), directory.fresh_writes(directory.writes(rows, candidates, at, retry), held)

    return _commit(store, judge, batch)

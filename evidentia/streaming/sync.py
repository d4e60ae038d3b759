"""Ingest as one flow: listed documents to versions, claims, extraction, validation and one committed write set each.

A batch of documents goes through in one pass, each with an outcome of its own; a document that fails stops no other.
Ids and digests follow from content, so a batch that is run again finds its versions complete and writes nothing. A run
is claimed with a lease before its model is asked, so two syncs at once share the work; one that is too slow writes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import schema
from evidentia.functions.evidence import digest, frame, interaction_predicate, opaque_id
from evidentia.functions.text import grounded_email, grounded_name, normalize_name
from evidentia.operators import documents, extraction, identity, records
from evidentia.plans.lineage import cut
from evidentia.sources.store import Store
from evidentia.streaming import leases

#: A listed document: what a source tells of it before its content is read.
LISTED = schema._struct("doc_id:s provider:s title:s locator:s provider_version:s modified_at:t")
#: A document's content: its tabs, in any order; the tree gives their order.
TAB = schema._struct("doc_id:s id:s parent_id:s position:l title:s role:s content:s")
#: What can become of a document in a run, and why it fails (fixed values).
OUTCOMES = ("completed", "unchanged", "incomplete", "failed")
FAULTS = ("invalid-source", "busy", "model", "invalid-extraction", "storage")


@dataclass(frozen=True)
class Config:
    """What an extraction depends on besides the document: a run's identity is the version's and these."""

    provider: str
    model: str
    prompt_version: str
    schema_digest: str = ""
    policy: str = "initial-admission/1"


def one_source(listing: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Documents of a listing (distinct ids, else it is refused), or the one asked for."""
    if not listing.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a listing names a document twice")
    return listing if doc_id is None else listing.where(F.col("doc_id") == doc_id)


def representative(listing: DataFrame) -> DataFrame:
    """At most one document of a listing, that with the smallest id; enough to see whether a source can be read."""
    return listing.orderBy("doc_id").limit(1)


def versions_of(listing: DataFrame, tabs: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, sections, faults): the version that each document is now, its sections in order, and what is wrong with others.

    A document needs its provenance, at least one section with distinct ids, and exactly one transcript. A
    version's id follows from the source and the digest of what it says.
    """
    placed = records.flatten_tree(tabs.select("doc_id", "id", "parent_id", "position", "title"))
    body = placed.join(tabs.select("doc_id", "id", "parent_id", "title", "role", documents.content_hash().alias("content_hash")), ["doc_id", "id"])
    # contents are met last, by what is stored of them; digests need only their hashes
    sections = body.select(F.col("doc_id").alias("version_id"), F.col("id").alias("section_id"), "title", "parent_id", "path", F.col("section_order").cast("long").alias("section_order"), "role", "content_hash")
    shaped = listing.select(
        F.col("doc_id").alias("version_id"), "provider", F.col("provider_id" if "provider_id" in listing.columns else "doc_id").alias("provider_id"), "title", "locator", "provider_version", "modified_at",
        documents_date(F.col("title")).alias("source_time"),
    )
    digests = documents.version_records(shaped, sections).withColumnRenamed("version_id", "doc_id")
    takes = documents.transcripts(sections.withColumnRenamed("version_id", "doc_id"))
    rows = shaped.withColumnRenamed("version_id", "doc_id").join(digests, "doc_id").join(takes.select("doc_id", "accepted"), "doc_id", "left")
    fault = F.coalesce(F.col("fault"), F.when(~F.coalesce("accepted", F.lit(False)), "transcripts"))
    rows = cut(rows.withColumn("fault", fault).withColumn("source_id", opaque_id(F.lit("source"), F.col("provider"), F.col("provider_id"))))
    good = rows.where("fault is null").withColumn("version_id", opaque_id(F.lit("version"), F.col("source_id"), F.col("digest")))
    versions = good.select("doc_id", "source_id", "provider", "provider_id", "version_id", "digest", "title", "locator", "provider_version", "modified_at", "source_time", at.alias("recorded_at"))
    own = sections.drop("content_hash").withColumnRenamed("version_id", "doc_id").join(good.select("doc_id", "version_id"), "doc_id")
    own = own.join(tabs.select("doc_id", F.col("id").alias("section_id"), "content"), ["doc_id", "section_id"]).select(*schema.SECTION.names)
    return versions, own, rows.where("fault is not null").select("doc_id", "fault")


def documents_date(title: Column) -> Column:
    from evidentia.functions.evidence import meeting_date

    return meeting_date(title).cast("timestamp_ntz")


def runs_of(versions: DataFrame, config: Config) -> DataFrame:
    """versions with the run that extracts each under this configuration."""
    made = documents.derivation_digest(F.col("version_id"), {k: F.lit(getattr(config, k)) for k in ("provider", "model", "prompt_version", "schema_digest")})
    return versions.withColumn("derivation", made).withColumn("run_id", opaque_id(F.lit("run"), F.col("derivation")))


def extracted(runs: DataFrame, sections: DataFrame, model: Callable[[str], str], attempts: int = 1) -> DataFrame:
    """runs with (accepted, fault, proposal), one row for each: the model is asked once for each run, its answer read strictly.

    model: the transcript as JSON {section id: text} -> JSON text. An answer that fails is `model`, one that breaks a
    rule `invalid-extraction: why`; either way the other runs go on.
    """
    rows = runs.dropDuplicates(["run_id"]).join(sections.select("version_id", "section_id", F.coalesce("content", F.lit("")).alias("text")), "version_id")
    texts = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section_id", "text")))))
    rows = rows.groupBy("version_id", *(c for c in runs.columns if c != "version_id")).agg(texts.alias("_texts"))

    def ask(texts: pd.Series, days: pd.Series) -> pd.DataFrame:
        import json

        out = []
        for text, day in zip(texts, days, strict=True):
            fault, proposal = "model", None
            for _ in range(max(1, attempts)):
                try:
                    answer = model(text)
                except Exception:  # noqa: BLE001  (a remote model may fail in any way)
                    continue
                try:
                    proposal = json.dumps(extraction.validate(answer, json.loads(text), day), sort_keys=True)
                    fault = None
                    break
                except extraction.Invalid as e:
                    fault = f"invalid-extraction: {e}"
            out.append((fault is None, fault, proposal))
        return pd.DataFrame(out, columns=["accepted", "fault", "proposal"])

    asked = F.pandas_udf(ask, "accepted boolean, fault string, proposal string").asNondeterministic()
    return cut(rows.withColumn("_a", asked("_texts", F.date_format("source_time", "yyyy-MM-dd"))).select(*runs.columns, "_a.*"))


@F.pandas_udf(T.StructType([T.StructField("name_cite", T.StringType()), T.StructField("email_cite", T.StringType())]))
def _grounds(proposal: pd.Series, person: pd.Series) -> pd.DataFrame:
    """The first of a person's citations that names them, and the first that holds the address."""
    import json

    out = []
    for p, i in zip(proposal, person, strict=True):
        x = json.loads(p)
        quotes = {c["id"]: c["quote"] for c in x["citations"]}
        who = next(y for y in x["people"] if y["id"] == i)
        name = next((c for c in who["citation_ids"] if grounded_name(quotes[c], who["name"])), None)
        mail = next((c for c in who["citation_ids"] if who["email"] and grounded_email(quotes[c], who["email"])), None)
        out.append((name, mail))
    return pd.DataFrame(out, columns=["name_cite", "email_cite"])


def completion(accepted: DataFrame, names: DataFrame, config: Config) -> dict[str, DataFrame]:
    """The whole write set of accepted extractions, by table: spans, mentions, proposals with their evidence, candidates,
    observations, links, admissions, runs.

    accepted: (run_id, derivation, version_id, proposal, recorded_at, completed_at); names: (entity_id, name,
    is_alias), normalised, against which mentions are ranked. Everything is admitted by policy at first; signals
    become inferred observations between mentions, at the document's date if it has one. Every frame also has the run
    that owns the row.
    """
    from evidentia.operators.review import PROPOSAL

    rows = accepted.select("run_id", "derivation", "version_id", "recorded_at", "completed_at", "proposal", F.from_json("proposal", PROPOSAL, {"mode": "FAILFAST"}).alias("p"))
    null = F.lit(None).cast("string")
    own = lambda kind, x: opaque_id(F.lit(kind), F.col("run_id"), x)
    c = rows.select("run_id", "version_id", "recorded_at", F.explode("p.citations").alias("c"))
    spans = c.select(own("evidence", F.col("c.id")).alias("evidence_id"), "version_id", F.col("c.section_id").alias("section_id"), F.col("c.start").alias("start_byte"), F.col("c.end").alias("end_byte"), F.col("c.quote").alias("quote"), "recorded_at", "run_id")
    people = rows.select("run_id", "version_id", "completed_at", "proposal", F.explode("p.people").alias("m"))
    people = cut(people.withColumn("g", _grounds("proposal", "m.id")).withColumns({"mention_id": own("mention", F.col("m.id")), "proposal_id": own("proposal", F.col("m.id")), "normal": normalize_name(F.col("m.name"))}).drop("proposal"))
    name_ev, mail_ev = own("evidence", F.col("g.name_cite")), F.when(F.col("g.email_cite").isNotNull(), own("evidence", F.col("g.email_cite")))
    mentions = people.select(F.col("mention_id").alias("id"), name_ev.alias("evidence_id"), "run_id", F.col("m.name").alias("surface"), F.col("normal").alias("normalized_name"), F.col("m.email").alias("proposed_email"), mail_ev.alias("email_evidence_id"), F.col("completed_at").alias("recorded_at"))
    proposals = people.select("proposal_id", "mention_id", "run_id", "version_id", F.col("completed_at").alias("recorded_at"))
    cites = F.array_distinct(F.filter(F.array(name_ev, mail_ev), lambda x: x.isNotNull()))
    evidence = people.select("proposal_id", "run_id", F.posexplode(cites).alias("position", "evidence_id"))
    ranked = identity.rank_names(people.select("mention_id", F.col("normal").alias("name")), names).join(people.select("mention_id", "proposal_id", "run_id"), "mention_id")
    candidates = ranked.select("run_id", "proposal_id", "entity_id", "rank", "confidence", F.concat(F.lit("name-"), "via").alias("reason"), F.concat(F.lit("mention:"), "mention_id").alias("source"))
    signals = rows.select("run_id", "derivation", "completed_at", F.col("p.meeting_date").alias("day"), F.explode("p.signals").alias("s"))
    day = F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    obs_id = opaque_id(F.lit("observation"), F.col("derivation"), F.col("s.id"))
    observations = signals.select(
        obs_id.alias("obs_id"), F.lit("mention").alias("subject_kind"), own("mention", F.col("s.subject_id")).alias("subject_ref"), interaction_predicate(F.col("s.category"), F.col("s.direction")).alias("predicate"),
        F.lit("mention").alias("object_kind"), own("mention", F.col("s.object_id")).alias("object_ref"), F.when(day.isNull(), "unknown").otherwise("instant").alias("temporal_kind"), day.alias("valid_start"),
        F.lit(None).cast("timestamp_ntz").alias("valid_end"), F.col("completed_at").alias("recorded_at"), F.lit("inferred").alias("status"), "run_id",
    )
    links = signals.select(obs_id.alias("obs_id"), "run_id", F.explode(F.array_distinct("s.citation_ids")).alias("x")).select("obs_id", own("evidence", F.col("x")).alias("evidence_id"), F.lit("supporting").alias("role"), "run_id")
    admissions = None
    for kind, ids, of in (("extraction_run", rows.select(F.col("run_id").alias("id"), "completed_at", "run_id"), "id"), ("mention", people.select(F.col("mention_id").alias("id"), "completed_at", "run_id"), "id"), ("observation", signals.select(obs_id.alias("id"), "completed_at", "run_id"), "id")):
        one = records.initial_admissions(ids, kind, config.policy, F.col("completed_at")).withColumns({"supersedes_id": null, "reason": F.lit(config.policy)}).join(ids.select(F.col("id").alias("target_id"), "run_id"), "target_id")
        admissions = one if admissions is None else admissions.unionByName(one)
    runs = rows.select("run_id", "version_id", "derivation", F.lit("completed").alias("outcome"), digest(frame("proposal")).alias("write_digest"), F.col("completed_at").alias("recorded_at"))
    return {
        "spans": spans, "mentions": mentions, "proposals": proposals, "proposal_evidence": evidence, "candidates": candidates, "observations": observations, "links": links,
        "admissions": admissions.select(*schema.STORED_ADMISSION.names, "run_id"), "runs": runs,
    }


def prepare(store: Store, listing: DataFrame, tabs: DataFrame, config: Config, at: Column, owner: str, lease: str = "1 HOUR") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claimed runs, sections, outcomes so far): new versions, their sections, sources and revisions, and the claims on
    their runs are committed at once; versions whose run is complete are unchanged, those of another's claim are busy."""
    versions, sections, wrong = versions_of(one_source(listing), tabs, at)
    runs = cut(runs_of(versions, config))
    revision_id, revision_digest = documents.revision(F.col("provider"), F.col("provider_id"), F.col("provider_version"), F.col("modified_at"))
    told: list[DataFrame] = []

    def judge(held):
        fresh = runs.join(held["versions"].select("version_id"), "version_id", "left_anti").dropDuplicates(["version_id"])
        sources = runs.join(held["sources"].select("source_id"), "source_id", "left_anti").select("source_id", "provider", "provider_id", "recorded_at").distinct()
        revisions = runs.select(revision_id.alias("revision_id"), "version_id", revision_digest.alias("digest"), F.col("modified_at").alias("observed_at")).join(held["revisions"].select("revision_id"), "revision_id", "left_anti")
        done = held["runs"].where("outcome = 'completed'").select("run_id", F.lit(True).alias("_done"))
        rows = leases.claim(runs, held["attempts"], at, owner, lease).join(done, "run_id", "left")
        rows = cut(rows.withColumn("claim", F.when(F.col("_done"), "completed").otherwise(F.col("claim"))).drop("_done"))
        told.append(rows)
        new = {
            "sources": sources, "versions": fresh.select(*schema.VERSION.names), "sections": sections.join(fresh.select("version_id"), "version_id", "left_semi"),
            "revisions": revisions.dropDuplicates(["revision_id"]), "attempts": leases.claims(rows).dropDuplicates(["run_id"]),
        }
        return _keyed(new)

    store.commit(judge)
    outcomes = wrong.select("doc_id", F.lit("failed").alias("outcome"), F.concat(F.lit("invalid-source: "), "fault").alias("fault"))
    none = F.lit(None).cast("string")
    for claim, outcome, fault in (("completed", "unchanged", none), ("busy", "incomplete", F.lit("busy"))):
        outcomes = outcomes.unionByName(told[0].where(F.col("claim") == claim).select("doc_id", F.lit(outcome).alias("outcome"), fault.alias("fault")))
    return told[0].where("claim IN ('claimed', 'held')"), sections, outcomes


def _keyed(frames: dict[str, DataFrame]) -> dict:
    return {name: (df, schema.TABLES[name][1]) for name, df in frames.items()}


def unsound(written: dict[str, DataFrame]) -> DataFrame:
    """(run_id, fault): runs whose write set does not hold together, each with the first of its faults.

    A fault of a row is told of the run that owns the row, so it stops that run alone.
    """
    links = written["links"].join(written["observations"].select("obs_id"), "obs_id")
    rows = {
        "evidence": written["spans"].select(F.col("evidence_id").alias("id"), "run_id"), "mentions": written["mentions"].select("id", "evidence_id", "run_id"),
        "observations": links.select(F.concat_ws(":", "obs_id", "evidence_id").alias("id"), "evidence_id", "run_id"), "proposals": written["proposals"].select(F.col("proposal_id").alias("id"), "mention_id", "run_id"),
    }
    owners = None
    for name, df in rows.items():
        one = df.select(F.lit(name).alias("table"), "id", "run_id").distinct()
        owners = one if owners is None else owners.unionByName(one)
    found = records.write_set_faults({name: df.drop("run_id") for name, df in rows.items()}).join(owners, ["table", "id"])
    return found.groupBy("run_id").agg(F.min(F.concat_ws(" ", "table", "fault")).alias("fault"))


def finish(store: Store, claimed: DataFrame, sections: DataFrame, model: Callable[[str], str], names: DataFrame, config: Config, at: Column, attempts: int = 1) -> DataFrame:
    """(doc_id, outcome, fault) of claimed runs, after their write sets have been committed.

    The model is asked for each run. A run is completed only if its claim still holds when it is written; else it is
    `incomplete: storage` and nothing of it is written. A run whose answer breaks a rule, or whose write set does not
    hold together, fails alone; one whose model gives no answer is incomplete and may be claimed again.
    """
    # answers hold whole quotes: they are stored once, and what is judged of their runs goes without them
    answers = extracted(claimed, sections, model, attempts)
    done_at = F.lit(store.spark.range(1).select(at.cast("string").alias("at")).first()["at"]).cast("timestamp_ntz")
    rows = cut(claimed.join(answers.select("run_id", "accepted", "fault"), "run_id"))
    good = answers.where("accepted").select("doc_id", "source_id", "run_id", "derivation", "version_id", "modified_at", "provider_version", "proposal", "recorded_at", done_at.alias("completed_at"))
    written = completion(good, names, config)
    wrong = unsound(written).select("run_id", F.concat(F.lit("invalid-extraction: "), "fault").alias("_wrong"))
    rows = cut(rows.join(wrong, "run_id", "left").withColumn("fault", F.coalesce("_wrong", "fault")).withColumn("accepted", F.col("accepted") & F.col("_wrong").isNull()).drop("_wrong"))
    told: list[DataFrame] = []

    def judge(held):
        mine = cut(leases.held_still(rows, held["attempts"], at))
        told.append(mine)
        done = mine.where("accepted").select("run_id").distinct()
        fit = good.join(done, "run_id", "left_semi")
        new = {name: df.join(done, "run_id", "left_semi") for name, df in written.items()}
        ended = mine.withColumn("event", F.when(F.col("accepted"), "completed").otherwise("failed")).dropDuplicates(["run_id"])
        return _keyed(new | {"pointers": moved(fit, held), "attempts": leases.ends(ended, at)})

    store.commit(judge)
    lost = rows.join(told[0].select("doc_id"), "doc_id", "left_anti")
    outcome = F.when(F.col("accepted"), "completed").when(F.col("fault") == "model", "incomplete").otherwise("failed")
    return told[0].select("doc_id", outcome.alias("outcome"), "fault").unionByName(lost.select("doc_id", F.lit("incomplete").alias("outcome"), F.lit("storage").alias("fault")))


def moved(fit: DataFrame, held: dict[str, DataFrame]) -> DataFrame:
    """The pointers that completed versions move: each source's newest version by its time of change, a stored one included.

    An older revision that comes late is stored but moves nothing; of one time the new version is taken.
    """
    last = held["pointers"].groupBy("source_id").agg(F.max("seq").alias("last"))
    now = records.current_versions(held["pointers"]).join(fit.select("source_id").distinct(), "source_id", "left_semi").join(held["versions"].select("version_id", "modified_at", "provider_version"), "version_id")
    zero = F.lit(None).cast("timestamp_ntz")
    both = fit.select("source_id", "version_id", "modified_at", "provider_version", F.col("completed_at").alias("at"), F.lit(1).alias("fresh"))
    both = both.unionByName(now.select("source_id", "version_id", "modified_at", "provider_version", zero.alias("at"), F.lit(0).alias("fresh")))
    best = both.groupBy("source_id").agg(F.max_by(F.struct("version_id", "at", "fresh"), F.struct("modified_at", "fresh", "provider_version", "version_id")).alias("b")).select("source_id", "b.*").where("fresh = 1")
    best = best.join(now.select("source_id", F.col("version_id").alias("_now")), "source_id", "left").where(~F.col("version_id").eqNullSafe(F.col("_now")))
    return best.join(last, "source_id", "left").select("source_id", "version_id", F.col("at").alias("recorded_at"), (F.coalesce("last", F.lit(-1)) + 1).alias("seq"))


def sync(
    store: Store, listing: DataFrame, tabs: DataFrame, model: Callable[[str], str], names: DataFrame, config: Config, at: Column, attempts: int = 1, owner: str | None = None, lease: str = "1 HOUR",
    done_at: Column | None = None, after: Callable[[Store, DataFrame], None] | None = None,
) -> DataFrame:
    """One run over a listing: (doc_id, outcome, fault) of every document, after its write set has been committed.

    Versions and claims are committed first; then the model is asked for the claimed runs; then the write sets of the
    accepted answers, with references checked, the pointers and the ended attempts in one last commit, judged at
    `done_at` (by default `at`). A batch that dies between the two commits is taken up again when its lease is over.
    Another sync of the same documents at the same time finds them busy. after(store, documents) is called with those
    completed or unchanged, for what follows a complete document, such as the directory (see enriching()).
    """
    claimed, sections, outcomes = prepare(store, listing, tabs, config, at, owner or uuid.uuid4().hex, lease)
    out = cut(outcomes.unionByName(finish(store, claimed, sections, model, names, config, at if done_at is None else done_at, attempts)))
    if after is not None:
        after(store, out.where("outcome IN ('completed', 'unchanged')").select("doc_id"))
    return out


def revisions(listing: DataFrame, tabs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A listing that may name a document several times, and its tabs, by document and revision: `doc_id@provider_version`.

    Of rows that repeat a document and revision the last by its time of change holds. tabs with `provider_version`
    are met by it, others are the text of every revision.
    """
    rows = listing.groupBy("doc_id", "provider_version").agg(F.max(F.struct("modified_at", *(c for c in listing.columns if c not in ("doc_id", "provider_version", "modified_at")))).alias("r"))
    rows = rows.select(F.concat_ws("@", "doc_id", "provider_version").alias("_key"), F.col("doc_id").alias("provider_id"), "provider_version", "r.*")
    own = ["provider_id", "provider_version"] if "provider_version" in tabs.columns else ["provider_id"]
    keyed = tabs.withColumnRenamed("doc_id", "provider_id").join(rows.select("_key", *own), own).withColumnRenamed("_key", "doc_id")
    return rows.withColumnRenamed("_key", "doc_id"), keyed.select(*TAB.names)


def stream(store: Store, tabs: DataFrame, model: Callable[[str], str], names: Callable[[], DataFrame], config: Config, at: Callable[[], Column] | None = None, **how):
    """A foreachBatch function: each micro-batch of listed documents is synced once; run again, it finds its work done.

    A batch may hold several revisions of a document, in any order, and late ones: each becomes a version, and the
    newest by its time of change is the current one. at: the time of a batch, by default the clock's.
    """

    def run(listing: DataFrame, epoch: int) -> None:
        rows, texts = revisions(listing, tabs)
        sync(store, cut(rows), texts, model, names(), config, at() if at else F.current_timestamp().cast("timestamp_ntz"), **how)

    return run

"""Enrichment from a directory of people: what may be asked, what an answer decides, and the rows that it writes.

All of it works on tables: any number of mentions is asked, judged and written in one pass. Decisions follow from ids,
so writing a batch again changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.evidence import opaque_id
from evidentia.functions.text import normalize_email, source_mailbox, valid_email
from evidentia.operators import records
from evidentia.operators.authority import admitted, effective
from evidentia.operators.review import owner_choice
from evidentia.plans.lineage import cut

#: What a lookup can come to (fixed values); the last two may be tried again.
OUTCOMES = (
    "matched", "no_match", "ambiguous", "review", "disabled", "not_configured", "unauthorized", "forbidden", "invalid_response", "result_limit_exceeded", "rate_limited", "unavailable",
)
RETRYABLE = ("rate_limited", "unavailable")
#: Where a profile comes from; only the first binds a person to an address of the domain.
SOURCES = ("domain_profile", "domain_contact")
#: Reasons of candidates and decisions.
EXACT, BY_EMAIL, BY_NAME, BY_REVIEW = "unique-exact-work-email", "directory-email-review", "directory-name-review", "directory-candidate-accepted"

PROFILES = "array<struct<provider:string,subject_id:string,source:string,display_name:string,emails:array<string>>>"


def approved(domains: list[str]) -> list[str]:
    """The approved domains, trimmed and in lower case; none, a repeat or no domain at all is refused."""
    out = [d.strip().lower() for d in domains]
    if not out or len(set(out)) != len(out) or not all("." in d and "@" not in d and " " not in d and d.strip(".") == d for d in out):
        raise ValueError("directory domains must be given, valid and distinct")
    return out


def questions(mentions: DataFrame, domains: list[str]) -> DataFrame:
    """(mention_id, proposal_id, kind, value, binding) of the mentions that may be asked about, one question each.

    mentions: (mention_id, proposal_id, name, email, email_ok, binding), name and address normalised; binding tells
    how the address is grounded: `source` (the quote is exactly one named mailbox), `reviewer`, or `cited`. An
    address of an approved domain is asked for, else the name; a mention without either is not asked about.
    """
    domain = F.substring_index("email", "@", -1)
    by_email = F.coalesce(F.col("email_ok") & domain.isin(approved(domains)) & F.col("binding").isin("source", "reviewer", "cited"), F.lit(False))
    by_name = F.coalesce(F.trim("name") != "", F.lit(False))
    rows = mentions.withColumn("kind", F.when(by_email, "email").when(by_name, "name")).where("kind is not null")
    return rows.select("mention_id", "proposal_id", "kind", F.when(F.col("kind") == "email", F.col("email")).otherwise(F.col("name")).alias("value"), F.when(F.col("kind") == "email", F.col("binding")).otherwise("none").alias("binding"))


@F.pandas_udf(T.StringType())
def _binding(name_quote: pd.Series, email_quote: pd.Series, name: pd.Series, email: pd.Series) -> pd.Series:
    """How an address is grounded: `source` if its quote is exactly this name and mailbox, else `cited`."""
    quotes = [e or n or "" for n, e in zip(name_quote, email_quote, strict=True)]
    return pd.Series([None if not m else "source" if source_mailbox(q, n or "", m) else "cited" for q, n, m in zip(quotes, name, email, strict=True)], dtype=object)


def pending(held: dict[str, DataFrame], at: Column, fresh: str, retry: str = "1 HOUR") -> DataFrame:
    """Mentions that still have to be resolved, as questions() takes them, with `state`: `ask`, `reused` or `waiting`.

    A mention counts if its run is complete, admitted and of its source's current version, if it is admitted itself,
    and if its proposal has no effective decision. reused: its last lookup that came to something (matched, no_match,
    ambiguous, review) is not older than `fresh`. waiting: one that may be tried again is not due yet; its
    retry_after says when, else it is `retry` after the attempt. held: the tables of a store.
    """
    known = records.current_versions(held["pointers"]).select("version_id").distinct()
    runs = held["runs"].where("outcome = 'completed'").join(known, "version_id", "left_semi").join(admitted(held["admissions"], "extraction_run").select(F.col("id").alias("run_id")), "run_id", "left_semi")
    rows = held["mentions"].join(runs.select("run_id"), "run_id", "left_semi").join(admitted(held["admissions"], "mention"), "id", "left_semi").withColumnRenamed("id", "mention_id")
    rows = rows.join(held["proposals"].select("mention_id", "proposal_id"), "mention_id").join(effective(held["decisions"]).select("proposal_id").distinct(), "proposal_id", "left_anti")
    quotes = held["spans"].select("evidence_id", "quote")
    rows = rows.join(quotes.withColumnRenamed("quote", "_name_quote"), "evidence_id", "left")
    rows = rows.join(quotes.select(F.col("evidence_id").alias("email_evidence_id"), F.col("quote").alias("_email_quote")), "email_evidence_id", "left")
    done = F.col("outcome").isin("matched", "no_match", "ambiguous", "review")
    due = F.coalesce("retry_after", F.col("attempted_at") + F.expr(f"INTERVAL {retry}"))
    tried = held["lookups"].withColumns({"_fresh": done & (F.col("attempted_at") >= at - F.expr(f"INTERVAL {fresh}")), "_wait": F.col("outcome").isin(*RETRYABLE) & (due > at)})
    tried = tried.groupBy("mention_id").agg(F.max("_fresh").alias("_fresh"), F.max("_wait").alias("_wait"))
    email = normalize_email(F.col("proposed_email"))
    rows = rows.withColumn("email", email).withColumn("binding", F.coalesce(_binding("_name_quote", "_email_quote", "surface", "email"), F.lit("none")))
    state = F.when(F.coalesce("_fresh", F.lit(False)), "reused").when(F.coalesce("_wait", F.lit(False)), "waiting").otherwise("ask")
    return rows.join(tried, "mention_id", "left").select("mention_id", "proposal_id", F.col("normalized_name").alias("name"), "email", valid_email(F.coalesce("email", F.lit(""))).alias("email_ok"), "binding", state.alias("state"))


class Bucket:
    """Tokens that fill at a rate up to a burst; take() waits only where none is left."""

    def __init__(self, per_second: float, burst: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = per_second, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1


def searched(asked: DataFrame, ask: Callable, attempts: int = 2, wait: float = 0.0, per_second: float | None = None, tasks: int | None = None) -> DataFrame:
    """The questions with `outcome`, `profiles` and `tries`: each distinct question is put to the directory once.

    ask(kind, value) gives {"outcome": one of OUTCOMES or None, "profiles": [...]}; what fails is `unavailable`, what
    is no such answer `invalid_response`. A retryable outcome is tried again, at most `attempts` times in all, after
    `wait` seconds. Profiles count only where no outcome is given. per_second bounds the calls of each task, tasks the
    tasks that ask, so the directory hears at most their product.
    """

    def one(kind, value, bucket):
        for tries in range(1, max(1, attempts) + 1):
            if bucket:
                bucket.take()
            try:
                got = ask(kind, value)
                outcome, profiles = got.get("outcome"), got.get("profiles") or []
                if outcome is not None and outcome not in OUTCOMES:
                    outcome = "invalid_response"
            except Exception:  # noqa: BLE001  (a directory that fails is unavailable; the batch goes on)
                outcome, profiles = "unavailable", []
            if outcome not in RETRYABLE:
                break
            if tries < attempts:
                time.sleep(wait)
        names = ("provider", "subject_id", "source", "display_name")
        held = [{n: p.get(n) for n in names} | {"emails": [e for e in p.get("emails") or [] if isinstance(e, str)]} for p in profiles] if outcome is None else []
        return outcome, held, tries

    def run(batches):
        bucket = Bucket(per_second) if per_second else None
        for pdf in batches:
            got = [one(k, v, bucket) for k, v in zip(pdf["kind"], pdf["value"], strict=True)]
            yield pd.DataFrame({"kind": pdf["kind"], "value": pdf["value"], "outcome": [g[0] for g in got], "profiles": [g[1] for g in got], "tries": [g[2] for g in got]})

    distinct = asked.select("kind", "value").distinct()
    answers = (distinct.coalesce(tasks) if tasks else distinct).mapInPandas(run, f"kind string, value string, outcome string, profiles {PROFILES}, tries int")
    return asked.join(answers, ["kind", "value"])


def found(asked: DataFrame, profiles: DataFrame, normal_email=F.lower, normal_name=F.lower) -> DataFrame:
    """The same from a table of profiles (provider, subject_id, source, display_name, emails): those with the address or the name."""
    one = F.struct("provider", "subject_id", "source", "display_name", "emails").alias("profile")
    keys = profiles.select(F.lit("name").alias("kind"), normal_name(F.col("display_name")).alias("value"), one)
    keys = keys.unionByName(profiles.select(F.explode("emails").alias("_e"), one).select(F.lit("email").alias("kind"), normal_email(F.col("_e")).alias("value"), "profile"))
    held = keys.join(asked.select("kind", "value").distinct(), ["kind", "value"], "left_semi").groupBy("kind", "value").agg(F.collect_set("profile").alias("profiles"))
    out = asked.join(held, ["kind", "value"], "left")
    return out.select(*asked.columns, F.lit(None).cast("string").alias("outcome"), F.coalesce("profiles", F.array().cast(PROFILES)).alias("profiles"), F.lit(1).alias("tries"))


def email_owners(aliases: DataFrame, decisions: DataFrame) -> DataFrame:
    """(email, entity_id) once each, of addresses that an effective accepted decision gives to an entity."""
    tails = effective(decisions).where("outcome = 'accepted'").select(F.col("id").alias("decision_id"), "entity_id")
    return aliases.where("kind = 'email'").join(tails, "decision_id").select(F.col("value").alias("email"), "entity_id").distinct()


def provider_owners(links: DataFrame, decisions: DataFrame) -> DataFrame:
    """(provider, subject_id, entity_id) once each, of directory links whose decision is effective and accepted."""
    tails = effective(decisions).where("outcome = 'accepted'").select(F.col("id").alias("decision_id"), "entity_id")
    return links.join(tails, ["decision_id", "entity_id"], "left_semi").select("provider", "subject_id", "entity_id").distinct()


def _counted(owners: DataFrame, by: list[str], n: str, one: str) -> DataFrame:
    return owners.groupBy(*by).agg(F.count_distinct("entity_id").alias(n), F.min("entity_id").alias(one))


def answered(asked: DataFrame, answer: Callable[[DataFrame], DataFrame], normal_email=F.lower) -> tuple[DataFrame, DataFrame]:
    """(answers, candidates) of the distinct questions among those asked, answered once.

    answer: searched() or found() with their directory bound. answers: (kind, value, outcome, tries, n_candidates,
    profile), candidates: (kind, value, profile), once each: the profiles that an answer gave and, for an address,
    that have it. `profile` is an address's only candidate. Mentions meet the answers alone, so however many profiles
    an answer has, they are not repeated for each mention.
    """
    raw = cut(answer(asked.select("kind", "value").distinct()))
    candidates = raw.select("kind", "value", F.explode("profiles").alias("profile"))
    candidates = candidates.where((F.col("kind") != "email") | F.exists("profile.emails", lambda e: normal_email(e) == F.col("value"))).distinct()
    of = candidates.groupBy("kind", "value").agg(F.count("*").alias("n_candidates"), F.first("profile").alias("profile"))
    answers = raw.select("kind", "value", "outcome", "tries").join(of, ["kind", "value"], "left")
    only = F.when((F.col("kind") == "email") & (F.col("n_candidates") == 1), F.col("profile"))
    return answers.select("kind", "value", "outcome", "tries", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), only.alias("profile")), candidates


def evaluated(asked: DataFrame, answers: DataFrame, owners: DataFrame, links: DataFrame, domains: list[str]) -> DataFrame:
    """Each question asked with `verdict`, the profile that it rests on, the entity that it names, and how many candidates it has.

    asked: questions(), answers: answered(), owners: email_owners(), links: provider_owners(). An outcome that was
    given stands. A name gives candidates to review at best. An address: of no profile no_match, of several ambiguous;
    of one, review unless it is bound to the address by its source, its domain is approved, it comes from the domain
    itself, at most one entity owns the address, and entities linked to the profile are exactly that one; else
    matched, with the owner or, without one, a person to be made.
    """
    rows = asked.join(answers, ["kind", "value"])
    rows = rows.join(_counted(owners, ["email"], "n_owners", "owner"), (F.col("kind") == "email") & (F.col("value") == F.col("email")), "left").drop("email")
    linked = _counted(links, ["provider", "subject_id"], "n_links", "link").select(F.struct("provider", "subject_id").alias("_who"), "n_links", "link")
    rows = rows.withColumn("_of", F.when(F.col("profile").isNotNull(), F.struct(F.col("profile.provider").alias("provider"), F.col("profile.subject_id").alias("subject_id"))))
    rows = rows.join(linked, F.col("_of") == F.col("_who"), "left").drop("_of", "_who")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bound = ~blank("profile.provider") & ~blank("profile.subject_id") & F.col("binding").isin("source", "reviewer") & F.substring_index("value", "@", -1).isin(approved(domains)) & (F.col("profile.source") == SOURCES[0])
    n, k = F.coalesce("n_owners", F.lit(0)), F.coalesce("n_links", F.lit(0))
    clash = (k > 0) & ((n == 0) | (k > 1) | (F.col("link") != F.col("owner")))
    verdict = (
        F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("n_candidates") == 0, "no_match").when(F.col("kind") == "name", "review")
        .when(F.col("n_candidates") > 1, "ambiguous").when(~F.coalesce(bound, F.lit(False)) | (n > 1) | F.coalesce(clash, F.lit(False)), "review").otherwise("matched")
    )
    matched = F.col("verdict") == "matched"
    return rows.withColumn("verdict", verdict).select(
        "mention_id", "proposal_id", "kind", "value", "tries", "verdict", F.when(matched, F.col("profile")).alias("profile"), F.when(matched, F.col("owner")).alias("entity_id"),
        F.when(F.col("verdict").isin("matched", "ambiguous", "review"), F.col("n_candidates")).otherwise(0).alias("n_candidates"),
    )


def judged(verdicts: DataFrame, decisions: DataFrame, owners: DataFrame, links: DataFrame, stored_links: DataFrame) -> DataFrame:
    """evaluated() with `authority`: accepted (with the entity), kept (the exact link stands already), staged, or none.

    A match is staged for review where a reviewer has decided the proposal, where an automatic decision stands
    without this very link, or where the owners of the address and of the profile disagree.
    decisions with `authority`; owners and links as in evaluated(); stored_links: (proposal_id, provider,
    subject_id, entity_id, decision_id).
    """
    tails = effective(decisions).select("proposal_id", F.col("id").alias("t_id"), F.col("authority").alias("t_authority"), F.col("entity_id").alias("t_entity"))
    who = verdicts.withColumns({"provider": F.col("profile.provider"), "subject_id": F.col("profile.subject_id")})
    rows = who.join(tails, "proposal_id", "left")
    exact = stored_links.where("decision_id is not null").select("proposal_id", "provider", "subject_id", F.col("decision_id").alias("t_id"), F.col("entity_id").alias("t_entity")).distinct()
    rows = rows.join(exact.withColumn("_exact", F.lit(True)), ["proposal_id", "provider", "subject_id", "t_id", "t_entity"], "left")
    rows = rows.join(_counted(owners, ["email"], "n_email", "email_owner").withColumnRenamed("email", "value"), "value", "left")
    rows = rows.join(_counted(links, ["provider", "subject_id"], "n_provider", "provider_owner"), ["provider", "subject_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    choice, entity = owner_choice(zero("n_email"), F.col("email_owner"), zero("n_provider"), F.col("provider_owner"), F.col("entity_id"), F.col("entity_id").isNull())
    made = opaque_id(F.lit("directory-person"), F.col("provider"), F.col("subject_id"))
    authority = (
        F.when(F.col("verdict") != "matched", F.when(F.col("n_candidates") > 0, "staged").otherwise("none"))
        .when(F.col("t_authority") == "reviewer", "staged").when(F.col("t_id").isNotNull(), F.when(F.col("_exact"), "kept").otherwise("staged"))
        .when(choice == "conflict", "staged").otherwise("accepted")
    )
    chosen = F.when(authority == "kept", F.col("t_entity")).when(authority == "accepted", F.when(choice == "create", made).otherwise(entity))
    return rows.select(*verdicts.columns[: verdicts.columns.index("entity_id")], chosen.alias("entity_id"), "n_candidates", authority.alias("authority"))


def writes(rows: DataFrame, candidates: DataFrame, at: Column, retry: str = "1 HOUR") -> dict[str, DataFrame]:
    """What judged() rows with the candidates of answered() write, by table: profiles, lookups, entities, candidates, decisions, aliases, directory_links.

    An accepted match has its entity, a candidate, an automatic decision, the address as its alias and a link;
    a staged one an entity, a candidate and a link without a decision for each distinct profile. A retryable
    outcome may be asked again after `retry`.
    """
    rows = rows.withColumn("at", at)
    null = lambda kind: F.lit(None).cast(kind)
    own = ["mention_id", "proposal_id", "kind", "authority", "at", F.col("entity_id").alias("accepted_id")]
    some = rows.where("n_candidates > 0")
    each = rows.where("authority = 'accepted'").select(*own, F.col("profile").alias("p"))
    each = each.unionByName(some.where("authority NOT IN ('accepted', 'kept')").drop("profile").join(candidates.withColumnRenamed("profile", "p"), ["kind", "value"]).select(*own, "p"))
    each = each.select("*", "p.provider", "p.subject_id", "p.display_name")
    each = each.withColumn("entity_id", F.when(F.col("authority") == "accepted", F.col("accepted_id")).otherwise(opaque_id(F.lit("directory-person"), F.col("provider"), F.col("subject_id"))))
    each = each.dropDuplicates(["proposal_id", "provider", "subject_id"])
    accepted = F.col("authority") == "accepted"
    decision = opaque_id(F.lit("directory-decision"), F.col("proposal_id"), F.col("entity_id"))
    each = each.withColumn("decision_id", F.when(accepted, decision))
    profiles = candidates.withColumnRenamed("profile", "p").join(some.select("kind", "value", "at").distinct(), ["kind", "value"]).select("p.provider", "p.subject_id", "p.display_name", F.array_sort("p.emails").alias("emails"), F.col("at").alias("observed_at")).distinct()
    lookups = rows.select(
        opaque_id(F.lit("lookup"), F.col("mention_id"), F.col("kind"), F.col("value"), F.col("at").cast("string")).alias("lookup_id"), "mention_id", F.when(F.col("kind") == "email", F.col("value")).alias("email"),
        F.col("verdict").alias("outcome"), F.col("at").alias("attempted_at"), F.when(F.col("verdict").isin(*RETRYABLE), F.col("at") + F.expr(f"INTERVAL {retry}")).alias("retry_after"),
    )
    reason = F.when(accepted, EXACT).when(F.col("kind") == "email", BY_EMAIL).otherwise(BY_NAME)
    decided = each.where(accepted)
    emails = rows.where("authority = 'accepted'").select("proposal_id", F.col("value").alias("email"))
    return {
        "profiles": profiles, "lookups": lookups,
        "entities": each.select(F.col("entity_id").alias("id"), F.lit("person").alias("kind"), "display_name", F.col("at").alias("recorded_at")).dropDuplicates(["id"]),
        "candidates": each.select("proposal_id", "entity_id", F.row_number().over(Window.partitionBy("proposal_id").orderBy("provider", "subject_id")).alias("rank"), null("double").alias("confidence"), reason.alias("reason"), F.concat_ws(":", F.lit("directory"), "provider", "subject_id").alias("source")),
        "decisions": decided.select(F.col("decision_id").alias("id"), "proposal_id", "mention_id", F.lit("accepted").alias("outcome"), "entity_id", F.col("at").alias("recorded_at"), null("string").alias("supersedes_id"), F.lit("automatic").alias("authority"), F.lit(EXACT).alias("reason")),
        "aliases": decided.join(emails, "proposal_id").select("decision_id", F.lit("email").alias("kind"), F.col("email").alias("value")).distinct(),
        "directory_links": each.select("provider", "subject_id", "entity_id", "decision_id", "proposal_id", F.col("at").alias("recorded_at")),
    }


def enrich(work: DataFrame, answer: Callable[[DataFrame], DataFrame], state: dict[str, DataFrame], domains: list[str], at: Column) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(verdicts, writes) of all mentions that may be asked about.

    work: mentions as in questions(); answer: searched() or found() with their directory bound; state: aliases,
    decisions (with authority) and directory_links as stored. The answers are cut before anything is made of them, so
    a question is put to the directory once, however many of the frames are written, and all tell of one answer.
    """
    owners, links = email_owners(state["aliases"], state["decisions"]), provider_owners(state["directory_links"], state["decisions"])
    asked = questions(work, domains)
    answers, candidates = answered(asked, answer)
    rows = cut(judged(evaluated(asked, answers, owners, links, domains), state["decisions"], owners, links, state["directory_links"]))
    return rows, writes(rows, candidates, at)


def fresh_writes(written: dict[str, DataFrame], held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """writes() without what the store has already: entities, candidates, aliases, and links that were staged before."""
    out = dict(written)
    for name, key in (("entities", ["id"]), ("candidates", ["proposal_id", "entity_id"]), ("decisions", ["id"]), ("aliases", ["decision_id", "kind", "value"]), ("profiles", ["provider", "subject_id", "observed_at"])):
        out[name] = out[name].join(held[name].select(*key), key, "left_anti")
    key = ["provider", "subject_id", "entity_id", "proposal_id"]
    stands = held["directory_links"].select(*key, F.coalesce("decision_id", F.lit("")).alias("_d")).distinct()
    out["directory_links"] = out["directory_links"].withColumn("_d", F.coalesce("decision_id", F.lit(""))).join(stands, [*key, "_d"], "left_anti").drop("_d")
    return out


def accept_candidates(commands: DataFrame, stored_links: DataFrame, decisions: DataFrame, entities: DataFrame) -> DataFrame:
    """A reviewer's acceptance of staged candidates, with `verdict`: ok, not-staged, unknown-entity, owned (another entity
    has the provider's subject), or decided.

    commands: (command_id, proposal_id, provider, subject_id, entity_id, recorded_at), judged as if they came one by
    one in order of (recorded_at, command_id): the first for a proposal decides it, the first that is ok for a subject
    gives it to its entity, and what is refused takes nothing from those after it. ok rows write the decision and the
    link that carry_over() and the store's append take; equal commands are one.

    Rounds: a command is ok once no open one comes before it for its proposal, and its subject is its entity's or no
    open one comes before it there; then its rivals are refused. Each round settles at least the first open command of
    every group that is free of others, so rounds follow the longest chain of commands that hang on each other, not
    their number.
    """
    key, who = ["proposal_id", "provider", "subject_id", "entity_id"], ["provider", "subject_id"]
    staged = stored_links.where("decision_id is null").select(*key).distinct().withColumn("_staged", F.lit(True))
    owners = provider_owners(stored_links, decisions).groupBy(*who).agg(F.min("entity_id").alias("_low"), F.max("entity_id").alias("_high"))
    tails = effective(decisions).select("proposal_id", F.col("id").alias("_tail"))
    rows = commands.distinct().join(staged, key, "left").join(owners, who, "left").join(tails, "proposal_id", "left")
    rows = rows.join(entities.select(F.col("id").alias("entity_id"), F.lit(True).alias("_known")).distinct(), "entity_id", "left")
    other = F.coalesce((F.col("_low") != F.col("entity_id")) | (F.col("_high") != F.col("entity_id")), F.lit(False))
    verdict = F.when(F.col("_staged").isNull(), "not-staged").when(F.col("_known").isNull(), "unknown-entity").when(other, "owned").when(F.col("_tail").isNotNull(), "decided")
    order = F.struct("recorded_at", "command_id").alias("_order")
    judged = cut(rows.select(*commands.columns, verdict.alias("verdict"), order, F.coalesce(F.col("_low") == F.col("entity_id"), F.lit(False)).alias("_own")))
    settled, open_ = judged.where("verdict is not null").drop("_own"), judged.where("verdict is null")
    while not open_.isEmpty():
        first_p = open_.groupBy("proposal_id").agg(F.min("_order").alias("_p"))
        first_s = open_.groupBy(*who).agg(F.min("_order").alias("_s"))
        now = open_.join(first_p, "proposal_id").join(first_s, who)
        now = cut(now.where((F.col("_order") == F.col("_p")) & (F.col("_own") | (F.col("_order") == F.col("_s")))).drop("_p", "_s", "_own").withColumn("verdict", F.lit("ok")))
        taken = now.groupBy(*who).agg(F.min("entity_id").alias("_taken"))
        gone = now.select("command_id", F.lit(True).alias("_ok"))
        left = open_.join(gone, "command_id", "left").where("_ok is null").drop("_ok").join(now.select("proposal_id", F.lit(True).alias("_done")).distinct(), "proposal_id", "left").join(taken, who, "left")
        why = F.when(F.col("_done"), "decided").when(F.col("_taken") != F.col("entity_id"), "owned")
        left = cut(left.withColumns({"verdict": why, "_own": F.col("_own") | F.coalesce(F.col("_taken") == F.col("entity_id"), F.lit(False))}))
        kept = ["verdict", "_order"]
        settled = cut(settled.unionByName(now.select(*commands.columns, *kept)).unionByName(left.where("verdict is not null").select(*commands.columns, *kept)))
        open_ = left.where("verdict is null").select(*commands.columns, *kept, "_own")
    return settled.select(*commands.columns, "verdict", F.when(F.col("verdict") == "ok", opaque_id(F.lit("decision"), F.col("command_id"))).alias("decision_id"))


def accepted_writes(judged: DataFrame, proposals: DataFrame) -> dict[str, DataFrame]:
    """What accept_candidates() writes: a reviewer's decision and its link for each command that is ok."""
    ok = judged.where("verdict = 'ok'").join(proposals.select("proposal_id", "mention_id"), "proposal_id", "left")
    decisions = ok.select(
        F.col("decision_id").alias("id"), "proposal_id", "mention_id", F.lit("accepted").alias("outcome"), "entity_id", "recorded_at", F.lit(None).cast("string").alias("supersedes_id"),
        F.lit("reviewer").alias("authority"), F.lit(BY_REVIEW).alias("reason"),
    )
    return {"decisions": decisions, "directory_links": ok.select("provider", "subject_id", "entity_id", "decision_id", "proposal_id", "recorded_at")}


def carry_over(decided: DataFrame, stored_links: DataFrame) -> DataFrame:
    """Directory links that reviewers' corrections take over: the proof of the decision that an accepted successor
    supersedes, now for the successor and its entity.

    decided: decisions (id, proposal_id, outcome, entity_id, supersedes_id, recorded_at).
    """
    new = decided.where("outcome = 'accepted' and supersedes_id is not null").select(F.col("supersedes_id").alias("decision_id"), F.col("id").alias("_id"), F.col("entity_id").alias("_entity"), "proposal_id", F.col("recorded_at").alias("_at"))
    held = stored_links.where("decision_id is not null").select("provider", "subject_id", "decision_id", "proposal_id")
    rows = new.join(held, ["decision_id", "proposal_id"])
    return rows.select("provider", "subject_id", F.col("_entity").alias("entity_id"), F.col("_id").alias("decision_id"), "proposal_id", F.col("_at").alias("recorded_at")).distinct()

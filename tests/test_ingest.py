"""Ingest as one flow, the directory, reviewers' projections, and the store's ledger."""

import json
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.cli import TABLES
from evidentia.operators import authority, directory, documents, records, review
from evidentia.plans.commands import append_admissions, review_proposals
from evidentia.plans.engine import Engine
from evidentia.plans.request import POINT, At, Request
from evidentia.sources import ledger
from evidentia.sources.store import Store
from evidentia.streaming import sync

NOW = datetime(2041, 5, 5, 12)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


CONFIG = sync.Config("desk", "reader-1", "p3")


def listing(spark, ids="abcde"):
    title = lambda i: f"[2041-05-0{ord(i) - 96}] Talk {i}"
    return spark.createDataFrame([(i, "desk", title(i), f"talks/{i}", "1", NOW) for i in ids], sync.LISTED)


def tabs(spark, words="Ana Diaz <ana@x.org> thanks Bo Li. Bo Li agrees."):
    rows = [(i, f"{i}0", None, 0, "Talk", "other", "") for i in "abcde"] + [(i, f"{i}1", f"{i}0", 0, "Transcript", "transcript", f"{words} This is {i}.") for i in "abcd"]
    return spark.createDataFrame(rows, sync.TAB)


def answers(patience=()):
    """A model that quotes the transcript; talks b and c are answered wrongly (c by an exception) unless it has patience with them."""

    def model(text):
        import json

        body = next(v for v in json.loads(text).values() if v)
        section = next(k for k, v in json.loads(text).items() if v)
        if "This is c" in body and "c" not in patience:
            raise TimeoutError("no answer")
        quote = "Ana Diaz <ana@x.org> thanks Bo Li." if "This is b" not in body or "b" in patience else "Nobody said this."
        people = [{"id": "p1", "name": "Ana Diaz", "email": "ana@x.org", "citation_ids": ["c1"]}, {"id": "p2", "name": "Bo Li", "email": None, "citation_ids": ["c1"]}]
        signal = {"id": "s1", "subject_id": "p1", "object_id": "p2", "category": "endorsement_trust", "direction": "strengthening", "citation_ids": ["c1"]}
        return json.dumps({"meeting_date": "1999-01-01", "citations": [{"id": "c1", "section_id": section, "start": 0, "end": 1, "quote": quote}], "people": people, "statements": [], "signals": [signal]})

    return model


def outcomes(df):
    return {r["doc_id"]: (r["outcome"], (r["fault"] or "").split(":")[0]) for r in df.collect()}


@pytest.fixture(scope="module")
def synced(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("synced")), TABLES)
    names = spark.createDataFrame([("person:bo", "bo li", False), ("person:an", "an li", True)], "entity_id string, name string, is_alias boolean")
    first = outcomes(sync.sync(store, listing(spark), tabs(spark), answers(), names, CONFIG, now()))
    return store, names, first


def test_sync(spark, synced):
    store, names, first = synced
    want = {"a": ("completed", ""), "b": ("failed", "invalid-extraction"), "c": ("incomplete", "model"), "d": ("completed", ""), "e": ("failed", "invalid-source")}
    assert first == want
    held = store.snapshot()
    assert {n: held[n].count() for n in ("sources", "versions", "sections", "spans", "mentions", "proposals", "observations", "links", "runs", "pointers")} == {
        "sources": 4, "versions": 4, "sections": 8, "spans": 2, "mentions": 4, "proposals": 4, "observations": 2, "links": 2, "runs": 2, "pointers": 2,
    }
    assert held["admissions"].groupBy("target_kind").count().collect() and Counter(r["target_kind"] for r in held["admissions"].collect()) == {"extraction_run": 2, "mention": 4, "observation": 2}
    o = held["observations"].first()
    assert (o["temporal_kind"], o["status"], o["predicate"]) == ("instant", "inferred", "evidentia.interaction/endorsement_trust/strengthening") and {r["valid_start"].day for r in held["observations"].collect()} == {1, 4}
    cands = {(r["entity_id"], r["rank"], round(r["confidence"], 2)) for r in held["candidates"].collect()}
    assert cands == {("person:bo", 1, 1.0), ("person:an", 2, 0.5)}
    m = {r["surface"]: r for r in held["mentions"].where("proposed_email is not null").collect()}
    assert set(m) == {"Ana Diaz"} and m["Ana Diaz"]["evidence_id"] == m["Ana Diaz"]["email_evidence_id"]
    # again: what is complete is unchanged, what failed is tried again, and a better model finishes it
    again = outcomes(sync.sync(store, listing(spark), tabs(spark), answers("bc"), names, CONFIG, now()))
    assert again == {"a": ("unchanged", ""), "b": ("completed", ""), "c": ("completed", ""), "d": ("unchanged", ""), "e": ("failed", "invalid-source")}
    assert store.snapshot()["versions"].count() == 4 and store.snapshot()["runs"].count() == 4
    # a changed text is a new version, and the pointer moves to it
    moved = outcomes(sync.sync(store, listing(spark, "a"), tabs(spark, "Ana Diaz <ana@x.org> thanks Bo Li. So it is.").where("doc_id = 'a'"), answers(), names, CONFIG, F.lit(datetime(2041, 6, 1)).cast("timestamp_ntz")))
    held = store.snapshot()
    assert moved == {"a": ("completed", "")} and held["versions"].count() == 5
    current = {r["source_id"]: r["version_id"] for r in records.current_versions(held["pointers"]).collect()}
    before = {r["source_id"]: r["version_id"] for r in records.current_versions(held["pointers"], NOW).collect()}
    assert len(current) == 4 and sum(current[s] != before[s] for s in before) == 1
    again = documents.digest_conflicts(
        held["versions"].select("version_id", "digest"),
        documents.version_records(held["versions"].join(held["sources"].select("source_id", "provider", "provider_id"), "source_id").drop("digest"), held["sections"]), "version_id",
    )
    assert again.count() == 0


def test_what_sync_wrote_can_be_reviewed_and_asked(spark, synced):
    store, _, _ = synced
    held = store.snapshot()
    people = spark.createDataFrame([("person:bo", "person", "Bo Li", NOW), ("person:ana", "person", "Ana Diaz", NOW)], schema.ENTITY)
    shown = review.projected_proposals(held["proposals"], held["mentions"], held["proposal_evidence"], held["spans"], held["candidates"], people).collect()
    assert all(r["evidence"][0]["quote"] == "Ana Diaz <ana@x.org> thanks Bo Li." for r in shown) and shown == sorted(shown, key=lambda r: (r["recorded_at"], r["proposal_id"]))
    assert {r["surface"]: [c["display_name"] for c in r["candidates"] or []] for r in shown} == {"Ana Diaz": [], "Bo Li": ["Bo Li"]}
    commands = held["mentions"].join(held["proposals"].select("proposal_id", F.col("mention_id").alias("id")), "id").select(
        F.concat(F.lit("cmd:"), "proposal_id").alias("command_id"), "proposal_id", F.lit("accept").alias("action"), F.when(F.col("surface") == "Bo Li", "person:bo").otherwise("person:ana").alias("entity_id"),
        F.col("surface").alias("name"), F.col("proposed_email").alias("email"), now().alias("recorded_at"),
    )
    store.append({"entities": (people, "id")})
    decided = review_proposals(store, commands.withColumn("reason", F.lit("seen")), F.lower, F.lower)
    assert {r["verdict"] for r in decided.collect()} == {"ok"}
    admitted = records.initial_admissions(store.snapshot()["decisions"].select("id"), "identity_decision", "p", now()).withColumns({"supersedes_id": F.lit(None).cast("string"), "reason": F.lit("p")})
    assert {r["verdict"] for r in append_admissions(store, admitted).collect()} == {"append"}
    engine = Engine(spark, store.snapshot())
    r = engine.query(Request(POINT, ("person:ana", "person:bo"), (At("p", datetime(2041, 5, 4)),)))
    assert [(x["subject_ref"], x["object_ref"]) for x in r.facts.collect()] == [("person:ana", "person:bo")]
    assert {x["quote"] for x in r.citations.collect()} == {"Ana Diaz <ana@x.org> thanks Bo Li."}


def test_sync_refuses_a_listing_with_repeats(spark):
    twice = listing(spark, "ab").unionByName(listing(spark, "a"))
    with pytest.raises(ValueError):
        sync.one_source(twice)
    assert [r["doc_id"] for r in sync.representative(listing(spark)).collect()] == ["a"] and sync.one_source(listing(spark), "b").count() == 1


MENTION = "mention_id string, proposal_id string, name string, email string, email_ok boolean, binding string"
PEOPLE = "provider string, subject_id string, source string, display_name string, emails array<string>"


def asked(spark):
    rows = [(f"m{i}", f"p{i}", name, email, ok, bind) for i, (name, email, ok, bind) in enumerate([
        ("ana", "ana@x.org", True, "source"), ("bo", "bo@x.org", True, "source"), ("cy", "cy@x.org", True, "cited"), ("dee", "dee@other.org", True, "source"), ("", "bad", False, "source"),
        ("eva", "two@x.org", True, "source"), ("fay", "fay@x.org", True, "source"), ("gus", "gus@x.org", True, "source"), ("hal", "hal@x.org", True, "source"), ("zoe", None, None, "none"),
    ])]
    return spark.createDataFrame(rows, MENTION)


def people(spark):
    rows = [("d", n, "domain_profile", n, [f"{n}@x.org"]) for n in ("ana", "bo", "cy", "fay", "hal")]
    rows += [("d", "t1", "domain_profile", "eva", ["two@x.org"]), ("d", "t2", "domain_profile", "eve", ["Two@x.org"]), ("d", "g", "domain_contact", "gus", ["gus@x.org"]), ("d", "dee", "domain_profile", "dee", ["dee@x.org"])]
    return spark.createDataFrame(rows, PEOPLE)


def state(spark):
    decisions = [
        ("d1", "q1", "m", "accepted", "e:bo", NOW, None, "reviewer", "r"), ("d2", "q2", "m", "accepted", "e:f1", NOW, None, "automatic", "r"), ("d3", "q3", "m", "accepted", "e:f2", NOW, None, "automatic", "r"),
        ("d8", "p8", "m8", "rejected", None, NOW, None, "reviewer", "r"),
    ]
    aliases = [("d1", "email", "bo@x.org"), ("d2", "email", "fay@x.org"), ("d3", "email", "fay@x.org"), ("d8", "email", "hal@x.org")]
    links = [("d", "bo", "e:bo", "d1", "q1", NOW)]
    make = spark.createDataFrame
    return {"decisions": make(decisions, schema.STORED_DECISION), "aliases": make(aliases, schema.ALIAS), "directory_links": make(links, schema.DIRECTORY_LINK)}


def test_directory_enrichment(spark, tmp_path):
    held = state(spark)
    table = people(spark)
    rows, written = directory.enrich(asked(spark), lambda q: directory.found(q, table), held, ["x.org"], now())
    got = {r["mention_id"]: (r["kind"], r["verdict"], r["authority"]) for r in rows.collect()}
    assert got == {
        "m0": ("email", "matched", "accepted"), "m1": ("email", "matched", "accepted"), "m2": ("email", "review", "staged"), "m3": ("name", "review", "staged"), "m5": ("email", "ambiguous", "staged"),
        "m6": ("email", "review", "staged"), "m7": ("email", "review", "staged"), "m8": ("email", "matched", "staged"), "m9": ("name", "no_match", "none"),
    }
    assert {r["mention_id"]: r["entity_id"] for r in written["decisions"].collect()}["m1"] == "e:bo"
    counts = {n: df.count() for n, df in written.items()}
    assert (counts["decisions"], counts["aliases"], counts["lookups"]) == (2, 2, 9) and counts["candidates"] == counts["directory_links"] == 9
    store = Store(spark, str(tmp_path), TABLES)
    batch = {n: (df, schema.TABLES[n][1]) for n, df in (held | written).items() if n in schema.TABLES and n not in held}
    merged = batch | {n: (held[n].unionByName(written[n].select(*held[n].columns)), schema.TABLES[n][1]) for n in held}
    store.append(merged, "b1")
    # written once more: the automatic match stands by its exact link, and nothing new is decided
    held_now = store.snapshot()
    again, more = directory.enrich(asked(spark).where("mention_id = 'm0'"), lambda q: directory.found(q, table), held_now, ["x.org"], now())
    assert [r["authority"] for r in again.collect()] == ["kept"] and more["decisions"].count() == more["directory_links"].count() == 0
    owners = {(r["provider"], r["subject_id"]) for r in directory.provider_owners(held_now["directory_links"], held_now["decisions"]).collect()}
    assert owners == {("d", "ana"), ("d", "bo")}
    # a reviewer takes a staged candidate; one whose subject belongs to another entity is refused
    staged = {r["proposal_id"]: r for r in held_now["directory_links"].where("decision_id is null").collect()}
    c = lambda i, p, e=None: (i, p, staged[p]["provider"], staged[p]["subject_id"], e or staged[p]["entity_id"], NOW)
    commands = spark.createDataFrame([c("c1", "p2"), c("c2", "p7", "e:none"), c("c3", "p8")], "command_id string, proposal_id string, provider string, subject_id string, entity_id string, recorded_at timestamp_ntz")
    entities = written["entities"]
    out = {r["command_id"]: r["verdict"] for r in directory.accept_candidates(commands, held_now["directory_links"], held_now["decisions"], entities).collect()}
    assert out == {"c1": "ok", "c2": "not-staged", "c3": "decided"}
    # a correction that accepts another entity takes the proof over, one that rejects does not
    auto = {r["proposal_id"]: r["id"] for r in written["decisions"].collect()}
    fixes = spark.createDataFrame([("n0", "p0", "accepted", "e:other", auto["p0"], NOW), ("n1", "p1", "rejected", None, auto["p1"], NOW)], "id string, proposal_id string, outcome string, entity_id string, supersedes_id string, recorded_at timestamp_ntz")
    assert [(r["subject_id"], r["entity_id"], r["decision_id"]) for r in directory.carry_over(fixes, held_now["directory_links"]).collect()] == [("ana", "e:other", "n0")]


def test_directory_search_is_bounded(spark):
    def ask(kind, value):
        if value == "ana@x.org":
            return {"outcome": "rate_limited"}
        if value == "bo@x.org":
            raise OSError
        if value == "cy@x.org":
            return {"outcome": "odd"}
        return {"profiles": [{"provider": "d", "subject_id": value, "source": "domain_profile", "display_name": "x", "emails": [value, 3]}]}

    q = directory.questions(asked(spark), ["x.org"])
    got = {r["mention_id"]: (r["outcome"], r["tries"], len(r["profiles"])) for r in directory.searched(q, ask, attempts=3).collect()}
    assert got["m0"] == ("rate_limited", 3, 0) and got["m1"] == ("unavailable", 3, 0) and got["m2"] == ("invalid_response", 1, 0) and got["m6"] == (None, 1, 1) and "m4" not in got
    rows, written = directory.enrich(asked(spark).where("mention_id = 'm0'"), lambda x: directory.searched(x, ask), state(spark), ["x.org"], now())
    assert [r["verdict"] for r in rows.collect()] == ["rate_limited"] and [r["retry_after"] for r in written["lookups"].collect()] == [datetime(2041, 5, 5, 13)]
    for bad in ([], ["x"], ["x.org", "X.org"], ["a@x.org"]):
        with pytest.raises(ValueError):
            directory.approved(bad)


def test_decision_rules(spark):
    kind = "id string, proposal_id string, outcome string, entity_id string, authority string, reason string, recorded_at timestamp_ntz, supersedes_id string"
    good = ("d", "p", "accepted", "e", "reviewer", "seen", NOW, None)
    change = lambda **k: tuple(k.get(n, v) for n, v in zip("id proposal outcome entity authority reason at prior".split(), good, strict=True))
    rows = [good, change(id=" "), change(proposal=None), change(outcome="maybe"), change(entity=None), change(outcome="rejected"), change(authority="policy"), change(reason=" "), change(reason="x" * 129), change(at=None), change(prior="d"), change(outcome="rejected", entity=None)]
    found = [r[0] for r in spark.createDataFrame(rows, kind).coalesce(1).select(authority.resolution_fault()).collect()]
    assert found == [None, "no-id", "no-proposal", "outcome", "accepted-without-entity", "rejected-with-entity", "authority", "no-reason", "long-reason", "no-time", "supersedes-itself", None]
    kind = "id string, target_kind string, target_id string, outcome string, authority string, reason string, recorded_at timestamp_ntz, supersedes_id string"
    rows = [("a", "mention", "m", "admitted", "policy", "r", NOW, None), ("a", "thing", "m", "admitted", "policy", "r", NOW, None), ("a", "mention", "", "admitted", "policy", "r", NOW, None), ("a", "mention", "m", "accepted", "policy", "r", NOW, None), ("a", "mention", "m", "retired", "nobody", "r", NOW, None), ("a", "mention", "m", "retired", "reviewer", "r", NOW, "a")]
    found = [r[0] for r in spark.createDataFrame(rows, kind).coalesce(1).select(authority.admission_fault()).collect()]
    assert found == [None, "target-kind", "no-target", "outcome", "authority", "supersedes-itself"]


def test_chains_and_trees_without_limits(spark):
    n = 3000
    line = [(f"d{i}", f"d{i - 1}" if i else None) for i in range(n)] + [("x", "gone"), ("r1", "r2"), ("r2", "r1"), ("one", None)]
    rows = {r["id"]: (r["root"], r["depth"]) for r in authority.chains(spark.createDataFrame(line, "id string, supersedes_id string")).collect()}
    assert rows == {f"d{i}": ("d0", i) for i in range(n)} | {"one": ("one", 0)}
    deep = [("t", i, i - 1 if i else None, 0, str(i)) for i in range(500)] + [("u", 0, None, 1, "b"), ("u", 1, None, 0, "a"), ("u", 2, 1, 0, "c"), ("v", 0, 1, 0, "x"), ("v", 1, 0, 0, "y")]
    out = records.flatten_tree(spark.createDataFrame(deep, "doc_id string, id long, parent_id long, position long, title string")).collect()
    assert {(r["doc_id"], r["id"]): (r["depth"], r["section_order"]) for r in out} == {("t", i): (i, i) for i in range(500)} | {("u", 1): (0, 0), ("u", 2): (1, 1), ("u", 0): (0, 2)}
    assert records.flatten_tree(spark.createDataFrame([], "doc_id string, id long, parent_id long, position long, title string")).count() == 0


def test_ledger(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"entities": schema.ENTITY})
    made = []
    steps = [ledger.Step(n, f"text of {n}", lambda s, n=n: made.append(n)) for n in ("one", "two", "three")]
    assert ledger.Migrator(store, steps).status() == "absent"
    assert ledger.Migrator(store, steps[:2]).apply() == ["one", "two"] and ledger.Migrator(store, steps).status() == "pending"
    assert ledger.Migrator(store, steps).apply() == ["three"] and made == ["one", "two", "three"] and ledger.Migrator(store, steps).apply() == []
    m = ledger.Migrator(store, steps)
    assert m.status() == m.status(m.fingerprint()) == "current" and m.status("other") == "schema_drift"
    changed = [steps[0], ledger.Step("two", "other text"), steps[2]]
    assert ledger.Migrator(store, changed).status() == "checksum_mismatch"
    with pytest.raises(ledger.Refused):
        ledger.Migrator(store, changed).apply()
    assert ledger.health(store) == {"status": "ok"}

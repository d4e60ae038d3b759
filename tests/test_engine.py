"""Requests, the engine over a small story, the store, leases and the command line."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.cli import TABLES, main
from evidentia.functions import text as tx
from evidentia.operators import authority, checks, citations, documents, extraction
from evidentia.plans.engine import Engine, OverLimit, UnknownEntity, same_request
from evidentia.plans.request import CAUSAL, POINT, TRAJECTORY, TREND, At, BadRequest, Between, Request, ask, instant, normalize, parse
from evidentia.sources.store import Busy, Conflict, Store
from evidentia.streaming import leases


def at(text):
    return datetime.fromisoformat(text) if text else None


SPRING = Between("spring", at("2041-04-02"), at("2041-05-20"))
AUTUMN = Between("autumn", at("2041-09-01"), at("2041-11-11"))
WEIR = "place:weir-3"

#: A weir on a river: id, predicate, value, extent kind, start, end, recorded, status.
NOTES = [
    ("keeper-1", "keeper", "Ivo", "interval", "2041-02-10", "2041-06-30", "2041-02-11", "observed"),
    ("keeper-2", "keeper", "Runa", "interval", "2041-08-15", None, "2041-08-16T08:30", "observed"),
    ("keeper-0", "keeper", "Olaf", "interval", "2041-01-01", None, "2041-01-02", "rejected"),
    ("gate-a", "gate", "open", "instant", "2041-04-09T06:00", None, "2041-04-09T07:00", "observed"),
    ("gate-b", "gate", "shut", "instant", "2041-04-09T06:00", None, "2041-04-10T07:00", "validated_empirically"),
    ("depth", "depth", "low", "window", "2041-09-20", "2041-10-05", "2041-10-06", "observed"),
    ("silt", "silt", "heavy", "unknown", None, None, "2041-03-30", "inferred"),
    ("lease", "lease", "granted", "interval", "2041-03-01", "2041-12-01", "2041-03-02", "hypothesized"),
    ("fish", "fish", "none", "interval", "2041-01-01", None, "2041-01-20", "observed"),
    ("licence-a", "licence", "A", "interval", "2041-04-02", "2041-04-20", "2041-04-03", "observed"),
    ("licence-b", "licence", "B", "interval", "2041-04-25", "2041-05-10", "2041-04-26", "observed"),
    ("debt", "debt", "large", "interval", "2041-04-01", None, "2041-04-02", "observed"),
    ("tax", "tax", "paid", "interval", "2041-04-01", None, "2041-04-03", "observed"),
]
#: Whose only evidence speaks against it, which was never admitted, and whose document came to light late.
AGAINST, HIDDEN, LATE = "fish", "debt", "tax"


def story(spark):
    """Notes on a weir, each citing a line of its own document."""
    observations = [(i, "entity", WEIR, f"weir.{p}", "text", v, kind, at(a), at(b), at(r), s) for i, p, v, kind, a, b, r, s in NOTES]
    observations.append(("owner", "mention", "men:w", "weir.owner", "text", "Guild", "interval", at("2041-03-05"), None, at("2041-03-06"), "observed"))
    observations.append(("partner", "entity", WEIR, "weir.partner", "mention", "men:x", "interval", at("2041-03-05"), None, at("2041-03-06"), "observed"))
    observations.append(("flood", "entity", WEIR, schema.CAUSES, "text", "a flooded meadow", "instant", at("2041-04-15T03:00"), None, at("2041-04-15T09:00"), "observed"))
    ids = [o[0] for o in observations]
    links = [(i, f"ev:{i}", "contradicting" if i == AGAINST else "supporting") for i in ids] + [("keeper-2", "ev:keeper-1", "contradicting"), ("gate-b", "ev:gate-a", "contradicting")]
    admissions = [(f"adm:{i}", "observation", i, "quarantined" if i == HIDDEN else "admitted", at("2041-01-01"), None) for i in ids]
    admissions += [("adm:men:w", "mention", "men:w", "admitted", at("2041-01-01"), None), ("adm:dec:1", "identity_decision", "dec:1", "admitted", at("2041-01-01"), None)]
    decisions = [("dec:0", "prop:w", "men:w", "accepted", "place:mill-9", at("2041-03-06T10:00"), None), ("dec:1", "prop:w", "men:w", "accepted", WEIR, at("2041-03-07"), "dec:0")]
    entities = [(WEIR, "place", "The weir", at("2040-01-01")), ("place:mill-9", "place", "The mill", at("2040-01-01"))]
    lines = {i: f"Line on {i}: ürsprünglich so." for i in ids}
    quote = lambda i: lines[i].split(": ")[1]
    versions = [(f"ver:{i}", f"src:{i}", "d", f"Log {i}", f"log/{i}", "1", at("2041-01-01"), None, at("2041-10-01" if i == LATE else "2041-01-01")) for i in ids]
    sections = [(f"ver:{i}", "s1", "Log", None, ["Log"], 0, "notes", lines[i]) for i in ids]
    start = lambda i: len(lines[i].split(": ")[0].encode()) + 2
    spans = [(f"ev:{i}", f"ver:{i}", "s1", start(i), start(i) + len(quote(i).encode()), quote(i), at("2041-01-01")) for i in ids]
    sources = [(f"src:{i}", "desk", i, at("2041-01-01")) for i in ids]
    rows = {"observations": observations, "links": links, "decisions": decisions, "admissions": admissions, "entities": entities, "versions": versions, "sections": sections, "spans": spans, "sources": sources}
    kinds = {name: schema.TABLES[name][0] for name in rows} | {"decisions": schema.RESOLUTION_DECISION, "observations": schema.OBSERVATION, "admissions": schema.ADMISSION_DECISION, "sections": schema.SECTION}
    out = {name: spark.createDataFrame(x, kinds[name]) for name, x in rows.items()}
    digests = documents.version_records(out["versions"].drop("digest").join(out["sources"].select("source_id", "provider", "provider_id"), "source_id"), out["sections"])
    out["versions"] = out["versions"].drop("digest").join(digests.select("version_id", "digest"), "version_id").select(*schema.VERSION.names)
    return out


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, story(spark))


P = (WEIR,)


def told(df, *columns):
    return {tuple(x[c].removeprefix("weir.") if isinstance(x[c], str) else x[c] for c in columns) for x in df.collect()}


def test_trend_story(engine):
    r = engine.query(Request(TREND, P, (SPRING, AUTUMN)))
    assert told(r.facts, "label", "predicate", "object_ref") == {(x, *y) for x, k in (("spring", "Ivo"), ("autumn", "Runa")) for y in (("keeper", k), ("owner", "Guild"), ("tax", "paid"))} | {("spring", schema.CAUSES, "a flooded meadow")}
    assert told(r.changes.where("change <> 'unresolved'"), "predicate", "change", "before_object_ref", "after_object_ref") == {("keeper", "changed", "Ivo", "Runa"), (schema.CAUSES, "removed", "a flooded meadow", None)}
    both = {("silt", "temporal-uncertainty"), ("lease", "hypothesized"), ("fish", "counterevidence-only")}
    assert told(r.unresolved, "label", "predicate", "reason") == {(x, *y) for x in ("spring", "autumn") for y in both} | {
        ("spring", "gate", "conflicting-values"), ("spring", "licence", "multiple-states-in-window"), ("autumn", "depth", "temporal-uncertainty"),
    }
    gaps = told(r.gaps, "kind", "label", "predicate")
    assert {("unresolved-mention", None, "partner"), ("authority-excluded", None, "debt"), ("valid-time-excluded", "spring", "depth"), ("valid-time-excluded", "autumn", "gate")} <= gaps
    assert ("valid-time-excluded", "spring", "tax") not in gaps
    own = r.citations.where("predicate = 'weir.keeper' and outcome = 'resolved'")
    assert told(own, "label", "obs_id", "evidence_id", "role") == {("spring", "keeper-1", "ev:keeper-1", "supporting"), ("autumn", "keeper-2", "ev:keeper-2", "supporting"), ("autumn", "keeper-2", "ev:keeper-1", "contradicting")}
    assert told(own, "source_id", "version_id", "section_id", "section_title", "quote") == {(f"src:{i}", f"ver:{i}", "s1", "Log", "ürsprünglich so.") for i in ("keeper-1", "keeper-2")}


def test_trend_as_known(engine):
    early = engine.query(Request(TREND, P, (SPRING, AUTUMN), known_as_of=at("2041-03-06T12:00")))
    assert told(early.facts, "label", "predicate") == {("spring", "keeper")}  # the mention was the mill's then
    late = engine.query(Request(TREND, P, (SPRING, AUTUMN), known_as_of=at("2041-09-30T12:00")))
    assert ("spring", "tax") not in told(late.facts, "label", "predicate") and ("authority-excluded", "tax") in told(late.gaps, "kind", "predicate")
    assert ("spring", "tax") in told(engine.query(Request(TREND, P, (SPRING, AUTUMN), known_as_of=at("2041-10-01"))).facts, "label", "predicate")


def test_point_json(engine):
    q = Request(POINT, ("place:mill-9", *P), (At("p", at("2041-08-20")),), match="any")
    r = engine.query(q)
    x = json.loads(engine.envelope(r).first()["json"])
    assert x["request"]["intent"] == POINT and x["request"]["entity_ids"] == ["place:mill-9", WEIR] and x["request"]["selections"] == [{"label": "p", "start": "2041-08-20T00:00:00Z", "end": None}]
    facts = {f["key"]["predicate"]: f for f in x["point"]["facts"]}
    assert [f["key"]["predicate"] for f in x["point"]["facts"]] == sorted(facts) == ["weir.keeper", "weir.owner", "weir.tax"]
    keeper = facts["weir.keeper"]
    assert keeper["value"] == {"kind": "text", "ref": "Runa"} and [c["obs_id"] for c in keeper["contributions"]] == ["keeper-2"]
    assert keeper["contributions"][0]["recorded_at"] == "2041-08-16T08:30:00Z" and keeper["contributions"][0]["valid_end"] is None
    assert [c["evidence_id"] for c in keeper["supporting"]] == ["ev:keeper-2"] and [c["evidence_id"] for c in keeper["contradicting"]] == ["ev:keeper-1"]
    assert facts["weir.owner"]["contributions"][0]["subject_grounding"] == "men:w"
    assert {"kind": "no-evidence", "entity_id": "place:mill-9", "label": None, "predicate": None} in x["gaps"]
    assert {u["key"]["predicate"]: [c["value"]["ref"] for c in u["candidates"]] for u in x["point"]["unresolved"]} == {"weir.fish": ["none"], "weir.lease": ["granted"], "weir.silt": ["heavy"]}
    assert "facts: 3" in engine.text(r) and {r_["member"] for r_ in engine.lines(r).collect()} == {"facts", "unresolved", "gaps"}
    assert same_request(r, q) and not same_request(r, Request(POINT, P, (At("p", at("2041-08-20")),)))


def test_trend_json(engine):
    x = json.loads(engine.envelope(engine.query(Request(TREND, P, (SPRING, AUTUMN)))).first()["json"])["trend"]
    change = next(c for c in x["changes"] if c["key"]["predicate"] == "weir.keeper")
    assert (change["kind"], change["before"]["value"]["ref"], change["after"]["value"]["ref"]) == ("changed", "Ivo", "Runa") and change["after"]["supporting"][0]["quote"]
    assert [k["predicate"] for k in x["unresolved_keys"]] == ["weir.depth", "weir.fish", "weir.gate", "weir.lease", "weir.licence", "weir.silt"]
    gate = next(u for u in x["unresolved"] if u["key"]["predicate"] == "weir.gate")
    assert [c["value"]["ref"] for c in gate["candidates"]] == ["open", "shut"]


def test_trajectory_and_limits(engine):
    q = lambda n: Request(TRAJECTORY, P, (Between("b", at("2041-01-15"), at("2041-09-30")),), limit=n)
    r = engine.query(q(20))
    got = [(x["instant"], x["predicate"].removeprefix("weir."), x["change"]) for x in r.transitions.collect() if x["predicate"] != schema.CAUSES]
    want = [("02-10", "keeper", "added"), ("03-05", "owner", "added"), ("04-01", "tax", "added"), ("04-02", "licence", "added"), ("04-20", "licence", "removed"), ("04-25", "licence", "added"), ("05-10", "licence", "removed"), ("06-30", "keeper", "removed"), ("08-15", "keeper", "added")]
    assert got == [(at(f"2041-{d}"), p, c) for d, p, c in want]
    with pytest.raises(OverLimit):
        engine.query(q(9))
    x = json.loads(engine.envelope(r).first()["json"])["trajectory"]
    last = x["transitions"][-1]
    assert (last["instant"], last["before"], last["after"]["value"]["ref"], last["unresolved"]) == ("2041-08-15T00:00:00Z", None, "Runa", [])


def test_transitions_carry_what_they_turn_into(spark):
    """A fact that turns unresolved is removed and shows the candidates; ties are broken by what tells the transition."""
    e = lambda *x: ("entity", "e", *x)
    rows = [
        ("o1", *e("a.p", "text", "x", "interval", at("2041-01-01"), at("2041-01-05"), at("2041-01-01"), "observed")), ("o2", *e("a.p", "text", "y", "interval", at("2041-01-10"), None, at("2041-01-09"), "observed")),
        ("o3", *e("b.p", "text", "z", "interval", at("2041-01-10"), None, at("2041-01-03"), "observed")), ("o4", *e("a.p", "text", "w", "window", at("2041-01-20"), at("2041-01-25"), at("2041-01-21"), "observed")),
    ]
    make = spark.createDataFrame
    tables = {
        "observations": make(rows, schema.OBSERVATION), "links": make([(o[0], f"ev:{o[0]}", "supporting") for o in rows], schema.EVIDENCE_LINK), "decisions": make([], schema.RESOLUTION_DECISION),
        "admissions": make([(f"a{o[0]}", "observation", o[0], "admitted", at("2041-01-01"), None) for o in rows], schema.ADMISSION_DECISION), "entities": make([("e", "thing", "E", at("2040-01-01"))], schema.ENTITY),
    }
    engine = Engine(spark, tables)
    r = engine.query(Request(TRAJECTORY, ("e",), (Between("b", at("2041-01-01"), at("2041-02-01")),), limit=9))
    got = [(x["instant"].day, x["predicate"], x["change"], x["first_obs"]) for x in r.transitions.collect()]
    # b.p was recorded before the observation that adds a.p, though a.p has an older one that takes no part
    assert got == [(1, "a.p", "added", "o1"), (5, "a.p", "removed", "o1"), (10, "b.p", "added", "o3"), (10, "a.p", "added", "o2"), (20, "a.p", "removed", "o2"), (25, "a.p", "added", "o2")]
    x = json.loads(engine.envelope(r).first()["json"])["trajectory"]["transitions"]
    assert [(u["side"], u["reason"], [c["value"]["ref"] for c in u["candidates"]]) for u in x[4]["unresolved"]] == [("after", "temporal-uncertainty", ["w", "y"])]
    assert [(u["side"], [c["contributions"][0]["obs_id"] for c in u["candidates"]]) for u in x[5]["unresolved"]] == [("before", ["o4", "o2"])]


def test_causal(engine):
    ask_ = lambda w: engine.query(Request(CAUSAL, P, (w,), predicates=(schema.CAUSES,), limit=5))
    r = ask_(SPRING)
    x = json.loads(engine.envelope(r).first()["json"])["causal"]["links"]
    assert [(y["cause"]["ref"], y["effect"]["ref"], y["supporting"][0]["evidence_id"]) for y in x] == [(WEIR, "a flooded meadow", "ev:flood")]
    assert "no-causal-evidence" not in {g["kind"] for g in r.gaps.collect()}
    none = ask_(AUTUMN)
    assert none.links.count() == 0 and "no-causal-evidence" in {g["kind"] for g in none.gaps.collect()}
    with pytest.raises(UnknownEntity):
        engine.query(Request(POINT, ("place:none",), (At("p", at("2041-08-20")),)))


def test_contradicting_tables_are_refused(spark):
    """A fork, a lost predecessor, a changed decision, a citation that leads nowhere: no answer."""
    good = story(spark)
    q = Request(POINT, P, (At("p", at("2041-08-20")),))

    def refused(**tables):
        with pytest.raises(checks.Inconsistent):
            Engine(spark, good | tables).query(q)

    fork = spark.createDataFrame([("dec:2", "prop:w", "men:w", "rejected", None, at("2041-03-08"), "dec:0")], schema.RESOLUTION_DECISION)
    refused(decisions=good["decisions"].unionByName(fork))
    refused(decisions=good["decisions"].where("id <> 'dec:0'"))
    signed = good["decisions"].withColumns({"authority": F.lit("reviewer"), "reason": F.lit("seen")})
    signed = signed.withColumn("digest", authority.decision_digest(*authority.RESOLUTION_DIGEST))
    assert Engine(spark, good | {"decisions": signed}).query(q).facts.count() == 3
    refused(decisions=signed.withColumn("reason", F.when(F.col("id") == "dec:1", "other").otherwise(F.col("reason"))))
    # without its version an observation is excluded, as any late source excludes it
    lost = Engine(spark, good | {"versions": good["versions"].where("version_id <> 'ver:keeper-2'")}).query(q)
    assert ("keeper",) not in told(lost.facts, "predicate")
    refused(spans=good["spans"].unionByName(good["spans"].where("evidence_id = 'ev:keeper-2'").withColumn("quote", F.lit("other"))))
    assert citations.span_faults(good["spans"], good["sections"]).count() == 0
    moved = good["spans"].withColumn("start_byte", F.when(F.col("evidence_id") == "ev:tax", F.col("start_byte") + 1).otherwise(F.col("start_byte")))
    assert [tuple(x) for x in citations.span_faults(moved, good["sections"]).collect()] == [("ev:tax", "inside-character")]


@pytest.mark.parametrize(
    "bad",
    [
        Request("other", P, (SPRING,)), Request(POINT, (), (At("p", SPRING.start),)), Request(POINT, ("a", "a"), (At("p", SPRING.start),)), Request(TREND, P, (AUTUMN, SPRING)), Request(TREND, P, (SPRING,)),
        Request(POINT, P, (At("p", SPRING.start),), limit=1), Request(TRAJECTORY, P, (SPRING,)), Request(CAUSAL, P, (SPRING,), predicates=("x",), limit=1), Request(CAUSAL, P, (SPRING,), limit=1), Request(POINT, P, (At(" ", SPRING.start),)),
    ],
)
def test_bad_requests(bad):
    with pytest.raises(BadRequest):
        normalize(bad)


def test_parse_and_ask():
    r, out = parse(["trend", "--entity", "b", "--entity", "a", "--before", "2041-01-01T00:00:00Z/2041-02-01T00:00:00Z", "--after", "2041-03-01T01:00:00+01:00/2041-04-01T00:00:00Z", "--output", "json"])
    assert r.entity_ids == ("a", "b") and r.selections[1].start == at("2041-03-01") and out == "json"
    assert parse(["causal", "--entity", "a", "--between", "2041-01-01T00:00:00Z/2041-02-01T00:00:00Z", "--limit", "3"])[0].predicates == (schema.CAUSES,)
    assert instant("2041-01-01T00:00:00.1234567Z").microsecond == 123456
    plan = json.dumps({"status": "planned", "reason": "", "intent": POINT, "entity_match": "all", "predicates": [], "selections": [{"label": "p", "at": "2041-01-01T00:00:00Z"}], "knowledge_scope": "current", "chronology_limit": None})
    assert ask("what now?", lambda q: plan, ("e1",)).intent == POINT
    with pytest.raises(BadRequest):
        ask("what of e1?", lambda q: plan, ("e1",))
    with pytest.raises(extraction.Invalid):
        ask("what?", lambda q: '{"status": 1, "status": 2}', ("e1",))


def keyed(tables):
    return {n: (df, schema.TABLES[n][1]) for n, df in tables.items()}


def test_store_and_cli(spark, tmp_path, capsys):
    t = story(spark)
    store = Store(spark, str(tmp_path), TABLES)
    first = keyed(t)
    counts = store.append(first, "b1")
    assert counts["observations"] == len(NOTES) + 3 and counts["links"] == len(NOTES) + 5  # two spans are cited twice
    assert store.append(first, "b1")["observations"] == 0 and store.append(first, "b2")["links"] == 0
    assert {n: df.count() for n, df in store.snapshot().items() if n in t} == {n: df.count() for n, df in t.items()}
    with pytest.raises(Conflict):
        store.append({"entities": (t["entities"].withColumn("display_name", F.lit("?")), "id")})
    with pytest.raises(Conflict):
        store.append({"links": (t["links"].limit(1).withColumn("role", F.lit(None).cast("string")), schema.TABLES["links"][1])})
    assert main([str(tmp_path), "query", "point", "--entity", WEIR, "--at", "2041-08-20T00:00:00Z", "--output", "json"], spark) == 0
    assert '"Runa"' in capsys.readouterr().out
    assert main([str(tmp_path), "query", "point", "--entity", "none", "--at", "2041-08-20T00:00:00Z"], spark) == 2
    assert main([str(tmp_path), "check"], spark) == 0 and "marks: ok" in capsys.readouterr().out
    assert main([str(tmp_path / "none"), "check"], spark) == 1 and "root: failed" in capsys.readouterr().out


def test_answers_are_proved_down_to_the_bytes(spark, tmp_path):
    """A changed byte in any row that an answer rests on is refused; rows that it does not rest on are not read for it."""
    store = Store(spark, str(tmp_path), TABLES)
    store.append(keyed(story(spark)))
    held = {n: df.cache() for n, df in store.snapshot().items()}
    ask = lambda tables: Engine(spark, tables).query(Request(POINT, P, (At("p", at("2041-08-20")),)))
    keeper = ask(held).citations.where("predicate = 'weir.keeper'").collect()
    assert {(r["obs_id"], r["evidence_id"], r["quote"], r["section_id"], r["version_id"]) for r in keeper} == {("keeper-2", f"ev:{i}", "ürsprünglich so.", "s1", f"ver:{i}") for i in ("keeper-1", "keeper-2")}
    on = lambda name, where, **change: held | {name: held[name].withColumns({c: F.when(F.expr(where), v).otherwise(F.col(c)) for c, v in change.items()})}
    mine = "version_id = 'ver:keeper-2'"
    wrong = {
        "section": on("sections", mine, content=F.concat("content", F.lit("."))), "leaf": on("sections", mine, leaf=F.lit("0")), "title": on("sections", mine, title=F.lit("Other")), "version": on("versions", mine, title=F.lit("Other")),
        "locator": on("versions", mine, locator=F.lit("elsewhere")), "quote": on("spans", mine, quote=F.lit("ursprünglich so.")), "place": on("spans", mine, start_byte=F.col("start_byte") - 1), "value": on("observations", "obs_id = 'keeper-2'", object_ref=F.lit("Rune")),
        "time": on("observations", "obs_id = 'keeper-2'", valid_start=F.lit(at("2041-08-14")).cast("timestamp_ntz")), "role": on("links", "obs_id = 'keeper-2'", role=F.lit("supporting")), "decision": on("decisions", "id = 'dec:1'", reason=F.lit("other")),
        "admission": on("admissions", "target_id = 'keeper-2'", reason=F.lit("other")), "none": on("admissions", "target_id = 'keeper-2'", digest=F.lit(None).cast("string")), "added": held | {"sections": held["sections"].unionByName(held["sections"].where(mine).withColumn("section_id", F.lit("s2")))},
    }
    for name, tables in wrong.items():
        with pytest.raises(checks.Inconsistent):
            ask(tables)
            pytest.fail(name)
    ask(on("sections", "version_id = 'none'", content=F.lit("x")))


def test_store_after_a_writer_that_died(spark, tmp_path, monkeypatch):
    """Rows written without a marker are never read; the same batch can be written again, once."""
    t = {n: df for n, df in story(spark).items() if n in ("entities", "links")}
    store = Store(spark, str(tmp_path), TABLES)
    with monkeypatch.context() as m:
        m.setattr(Store, "_mark", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            store.append(keyed(t), "b1")
    assert store.snapshot()["entities"].count() == 0
    assert store.append(keyed(t), "b1") == {n: df.count() for n, df in t.items()} and store.append(keyed(t), "b1") == {n: 0 for n in t}
    assert {n: store.snapshot()[n].count() for n in t} == {n: df.count() for n, df in t.items()}
    more = t["entities"].withColumn("id", F.concat("id", F.lit("+")))
    store.append({"entities": (more, "id")}, "b2")
    store.compact()
    assert store.vacuum() >= 3 and store.snapshot()["entities"].count() == 4 and store.snapshot()["links"].count() == t["links"].count()
    assert store.append({"entities": (more, "id")}, "b3") == {"entities": 0} and store.append(keyed(t), "b1")["links"] == 0
    store.append({"entities": (more.withColumn("id", F.concat("id", F.lit("+"))), "id")}, "b4")
    assert store.snapshot()["entities"].count() == 6


def test_store_has_one_writer(spark, tmp_path):
    store = Store(spark, str(tmp_path), TABLES)
    rows = story(spark)["entities"]
    with store.writing(), pytest.raises(Busy):
        Store(spark, str(tmp_path), TABLES).append({"entities": (rows, "id")})
    assert store.append({"entities": (rows, "id")})["entities"] == 2
    with store.writing():  # a hold that is too old no longer counts
        assert Store(spark, str(tmp_path), TABLES, hold=-1).append({"entities": (rows, "id")})["entities"] == 0


def test_store_takes_a_stream_once(spark, tmp_path):
    rows = story(spark)["links"]
    rows.write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/store", TABLES)
    for checkpoint in ("a", "b"):  # the second stream starts anew and sends the same batch
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(store.sink("links", schema.TABLES["links"][1])).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination(120)
    assert store.snapshot()["links"].count() == rows.count()


def test_leases_batch_and_stream(spark, tmp_path):
    rows = [
        ("r", 0, 1, "claim", "a"), ("r", 5, 2, "claim", "b"), ("r", 12, 3, "claim", "b"), ("r", 13, 4, "complete", "a"), ("r", 14, 5, "complete", "b"), ("r", 15, 6, "complete", "b"), ("r", 16, 7, "claim", "a"),
        ("s", 0, 8, "claim", "a"), ("s", 1, 9, "fail", "a"), ("s", 2, 10, "claim", "b"),
    ]
    kind = "run_id string, at long, command_id long, action string, owner string"
    commands = spark.createDataFrame(rows, kind)
    want = {1: "claimed", 2: "busy", 3: "reclaimed", 4: "refused", 5: "completed", 6: "replay", 7: "completed", 8: "claimed", 9: "failed", 10: "claimed"}
    assert {r["command_id"]: r["outcome"] for r in leases.fold(commands, 10).collect()} == want
    for i, part in enumerate((commands.where("at < 13"), commands.where("at >= 13"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = leases.stream(stream, 10).writeStream.format("memory").queryName("leases").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["command_id"]: r["outcome"] for r in spark.sql("select * from leases").collect()} == want


def test_extraction_rules():
    section = {"body": "Ana Diaz <ana@x.org> said yes. Bo said no."}
    good = {
        "meeting_date": "1999-01-01", "citations": [{"id": "c1", "section_id": "body", "start": 0, "end": 3, "quote": "Ana Diaz <ana@x.org> said yes."}, {"id": "c2", "section_id": "body", "start": 31, "end": 42, "quote": "Bo said no."}],
        "people": [{"id": "p1", "name": "Ana Diaz", "email": "ana@x.org", "citation_ids": ["c1"]}, {"id": "p2", "name": "Bo", "email": None, "citation_ids": ["c2"]}],
        "statements": [{"id": "s1", "speaker_id": "p1", "text": "yes", "citation_ids": ["c1"]}], "signals": [{"id": "g1", "subject_id": "p1", "object_id": "p2", "category": "support_advocacy", "direction": "mixed", "citation_ids": ["c1"]}],
    }
    out = extraction.validate(json.dumps(good), section, "2024-05-05")
    assert out["meeting_date"] == "2024-05-05" and (out["citations"][0]["start"], out["citations"][0]["end"]) == (0, 30)

    def fault(**change):
        with pytest.raises(extraction.Invalid) as e:
            extraction.validate(json.dumps(good | change), section)
        return str(e.value)

    assert fault(extra=1) == "top members"
    assert fault(people=[good["people"][0] | {"name": "Ana"}, good["people"][1] | {"name": "B"}]) == "name not grounded"
    assert fault(statements=[good["statements"][0] | {"speaker_id": "p9"}]) == "unknown speaker"
    assert fault(signals=[good["signals"][0] | {"direction": "up"}]) == "signal vocabulary"
    assert fault(citations=[good["citations"][0] | {"quote": "said"}, good["citations"][1]]) == "quote not found once"
    assert not tx.grounded_name("mail ana.diaz@x.org", "diaz") and tx.grounded_name("by Ana  Diaz.", "ana diaz")
    assert tx.source_mailbox("Ana Diaz <ANA@x.org>", "ana diaz", "ana@x.org") and not tx.source_mailbox("Ana", "ana", "ana@x.org")


def test_extraction_of_damaged_answers_gives_verdicts(spark):
    """Thousands of damaged answers of a model: each is accepted or has a fault, none fails."""
    section = "Ana Diaz <ana@x.org> said yes. Bo said no."
    good = {
        "meeting_date": None, "citations": [{"id": "c1", "section_id": "body", "start": 0, "end": 30, "quote": "Ana Diaz <ana@x.org> said yes."}],
        "people": [{"id": "p1", "name": "Ana Diaz", "email": "ana@x.org", "citation_ids": ["c1"]}], "statements": [{"id": "s1", "speaker_id": "p1", "text": "yes", "citation_ids": ["c1"]}], "signals": [],
    }
    text = json.dumps(good)
    rnd = random.Random(5)
    values = [None, 0, -1, 1.5, True, "", "x", [], {}, [[]], {"a": 1}, 10**30, "\ud800", [None], ["c1", 3]]

    def damaged():
        x = json.loads(text)
        spot = rnd.choice([x, *(y for k in ("citations", "people", "statements") for y in x[k])])
        spot[rnd.choice(list(spot))] = rnd.choice(values)
        return json.dumps(x)

    cut = lambda: "".join(rnd.choice((c, c, c, c, c, c, c, c, c, rnd.choice('[]{}",:0'))) for c in text[: rnd.randrange(len(text))])
    payloads = [damaged() for _ in range(2500)] + [cut() for _ in range(1000)] + ["[" * 100_000, '{"a":' * 50_000, '"' + "[" * 1000, "9" * 6000, "", "NaN", text, None]
    faults = set()
    for x in payloads[:-1]:
        try:
            extraction.validate(x, {"body": section})
        except extraction.Invalid as e:
            faults.add(str(e))
    assert len(faults) > 15 and "nested too deeply" in faults
    rows = extraction.verdicts(spark.createDataFrame([(i, x, section) for i, x in enumerate(payloads)], "id long, p string, s string"), "id", "p", "s").collect()
    assert len(rows) == len(payloads) and all(r["accepted"] == (r["fault"] is None) == (r["proposal"] is not None) for r in rows) and rows[-2]["accepted"]


def test_names_have_no_cap(spark):
    from evidentia.operators import identity

    names = spark.createDataFrame([(f"e{i:02}", "ana diaz", False) for i in range(9)] + [("f", "ana", False), ("g", "bo ana cy", True), ("h", "bo", False)], "entity_id string, name string, is_alias boolean")
    mentions = spark.createDataFrame([("m", "ana diaz", "a@x"), ("n", "zed", "b@x"), ("o", "bo bo", "c@x")], "mention_id string, name string, email string")
    got = identity.rank_names(mentions.drop("email"), names).orderBy("mention_id", "rank").collect()
    assert [(r["entity_id"], round(r["confidence"], 3)) for r in got if r["mention_id"] == "m"] == [(f"e{i:02}", 1.0) for i in range(9)] + [("f", 0.5), ("g", 0.333)]
    assert [(r["entity_id"], round(r["confidence"], 3), r["via"]) for r in got if r["mention_id"] == "o"] == [("h", 1.0, "display"), ("g", 0.667, "alias")]
    emails = spark.createDataFrame([("e01", "a@x"), ("e02", "c@x"), ("e03", "c@x")], "entity_id string, email string")
    out = {(r["mention_id"], r["outcome"], r["entity_id"]) for r in identity.resolve(mentions, names, emails).collect()}
    assert out == {("m", "automatic", "e01"), ("n", "none", None), ("o", "ranked", "h"), ("o", "ranked", "g")}

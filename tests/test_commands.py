"""Batches of commands: judged against the store and each other, committed in one, and the store's one writer."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.cli import TABLES
from evidentia.operators import authority, directory
from evidentia.plans import commands
from evidentia.sources.store import Busy, Lost, Store

DECISION = "id string, proposal_id string, mention_id string, outcome string, entity_id string, recorded_at timestamp_ntz, supersedes_id string, authority string, reason string"
ADMISSION = "id string, target_kind string, target_id string, outcome string, recorded_at timestamp_ntz, supersedes_id string, authority string, reason string"


def day(n):
    return datetime(2041, 1, n)


def decision(i, proposal, up=None, n=1, entity="e", who="reviewer"):
    return (i, proposal, "m", "accepted", entity, day(n), up, who, "seen")


def verdicts(df, key="id"):
    return sorted((r[key] or "", r["verdict"]) for r in df.collect())


def test_a_batch_is_judged_against_itself_and_committed(spark, tmp_path):
    store = Store(spark, str(tmp_path), TABLES)
    put = lambda rows, **k: verdicts(commands.append_decisions(store, spark.createDataFrame(rows, DECISION), **k))
    first = [
        decision("a0", "p"), decision("a0", "p"), decision("a9", "p"), decision("b1", "p", "a0", 2), decision("b2", "p", "a0", 3), decision("c", "p", "b1", 4), decision("d", "p", "b2", 5), decision("e", "p", "c", 3),
        decision("f", "q", "c", 5), decision("g", "q"), decision("g", "q", n=2), decision("h", "r", who="automatic"), decision("i", "r", "h", 2, who="automatic"), decision("j", "s", "nowhere"), decision(" ", "s"), decision(None, "s"),
    ]
    want = [
        ("", "invalid: no-id"), (" ", "invalid: no-id"), ("a0", "append"), ("a0", "replay"), ("a9", "decided"), ("b1", "append"), ("b2", "stale"), ("c", "append"), ("d", "stale"), ("e", "stale"), ("f", "stale"), ("g", "append"), ("g", "conflict"),
        ("h", "append"), ("i", "unauthorised"), ("j", "stale"),
    ]
    assert put(first) == want
    held = store.snapshot()["decisions"]
    assert {r["id"] for r in held.collect()} == {"a0", "b1", "c", "g", "h"}
    assert authority.chain_violations(held, "proposal_id").count() == 0 and authority.digest_violations(held, authority.RESOLUTION_DIGEST).count() == 0
    assert {r["id"]: r["depth"] for r in authority.chains(held).collect()} == {"a0": 0, "b1": 1, "c": 2, "g": 0, "h": 0}
    # once more nothing is new; a successor of what stands is taken, of what was superseded not
    again = dict(put(first))
    assert again["a0"] == again["c"] == again["h"] == "replay" and again["b2"] == "stale" and again["a9"] == "decided"
    assert put([decision("k", "p", "c", 6), decision("l", "p", "b1", 6)]) == [("k", "append"), ("l", "stale")]
    assert put([decision("k2", "p", "k", 7)], batch="x") == [("k2", "append")] and put([decision("k2", "p", "k", 7)], batch="x") == []


def test_a_long_chain_in_one_batch(spark, tmp_path):
    n = 300
    rows = [("d0", "p", "m", "accepted", "e", day(1), None, "reviewer", "r")] + [(f"d{i}", "p", "m", "accepted", "e", day(1), f"d{i - 1}", "reviewer", "r") for i in range(1, n)]
    rows += [(f"x{i}", "p", "m", "rejected", None, day(1), f"d{i}", "reviewer", "r") for i in range(0, n, 7)]
    stored = spark.createDataFrame([], DECISION)
    got = dict(verdicts(authority.appendable(stored, spark.createDataFrame(rows, DECISION), "proposal_id")))
    assert all(got[f"d{i}"] == "append" for i in range(n)) and all(got[f"x{i}"] == "stale" for i in range(0, n - 1, 7))
    # many rivals for one place: one of them wins
    crowd = spark.range(5000).select(F.concat(F.lit("r"), F.col("id")).alias("id"), F.lit("t").alias("target_kind"), F.lit("t").alias("target_id"), F.lit("admitted").alias("outcome"), F.lit(day(1)).cast("timestamp_ntz").alias("recorded_at"), F.lit(None).cast("string").alias("supersedes_id"))
    out = authority.appendable(crowd.limit(0), crowd, ["target_kind", "target_id"]).groupBy("verdict").count().collect()
    assert {r["verdict"]: r["count"] for r in out} == {"append": 1, "decided": 4999}
    assert authority.appendable(crowd.limit(0), crowd.limit(0), ["target_kind", "target_id"]).count() == 0


def test_admissions(spark, tmp_path):
    store = Store(spark, str(tmp_path), TABLES)
    put = lambda rows: verdicts(commands.append_admissions(store, spark.createDataFrame(rows, ADMISSION)))
    a = lambda i, target, up=None, n=1, outcome="admitted", who="policy", kind="mention": (i, kind, target, outcome, day(n), up, who, "r")
    assert put([a("1", "m"), a("2", "m"), a("3", "m", kind="observation"), a("4", "m", "1", 2, "retired", "reviewer"), a("5", "n", who="nobody")]) == [("1", "append"), ("2", "decided"), ("3", "append"), ("4", "append"), ("5", "invalid: authority")]
    held = store.snapshot()["admissions"]
    assert authority.digest_violations(held, authority.ADMISSION_DIGEST).count() == 0 and {r["id"] for r in authority.effective(held).collect()} == {"3", "4"}


def candidates(spark, rows):
    return spark.createDataFrame(rows, "command_id string, proposal_id string, provider string, subject_id string, entity_id string, recorded_at timestamp_ntz")


def test_candidates_of_a_batch(spark, tmp_path):
    """One subject for two entities, one proposal twice, a refused command that frees what it asked for, equal commands."""
    store = Store(spark, str(tmp_path), TABLES)
    links = [("d", s, e, None, p, day(1)) for s in ("s1", "s2", "s3") for e in ("A", "B", "C") for p in ("p1", "p2", "p3", "p4", "p5", "p6")]
    people = [(e, "person", e, day(1)) for e in ("A", "B", "C")]
    proposals = [(f"p{i}", f"m{i}", "r", "v", day(1)) for i in range(1, 7)]
    store.append({n: (spark.createDataFrame(x, schema.TABLES[n][0]), schema.TABLES[n][1]) for n, x in (("directory_links", links), ("entities", people), ("proposals", proposals))})
    c = lambda i, p, s, e, n: (i, p, "d", s, e, day(n))
    rows = [c("1", "p1", "s1", "A", 2), c("2", "p1", "s2", "B", 3), c("3", "p3", "s2", "C", 4), c("4", "p4", "s1", "B", 5), c("5", "p5", "s1", "A", 6), c("6", "p6", "s2", "B", 7), c("6", "p6", "s2", "B", 7), c("7", "p6", "s3", "B", 8), c("8", "none", "s3", "B", 8)]
    out = commands.accept_directory_candidates(store, candidates(spark, rows))
    assert verdicts(out, "command_id") == [("1", "ok"), ("2", "decided"), ("3", "ok"), ("4", "owned"), ("5", "ok"), ("6", "owned"), ("7", "ok"), ("8", "not-staged")]
    held = store.snapshot()
    owners = {(r["subject_id"], r["entity_id"]) for r in directory.provider_owners(held["directory_links"], held["decisions"]).collect()}
    assert owners == {("s1", "A"), ("s2", "C"), ("s3", "B")}
    assert authority.chain_violations(held["decisions"], "proposal_id").count() == 0 and {r["mention_id"] for r in held["decisions"].collect()} == {"m1", "m3", "m5", "m6"}
    later = commands.accept_directory_candidates(store, candidates(spark, [c("9", "p2", "s2", "A", 9), c("10", "p2", "s2", "C", 9), c("11", "p1", "s1", "A", 9)]))
    assert verdicts(later, "command_id") == [("10", "ok"), ("11", "decided"), ("9", "owned")]


def test_reviews_are_committed(spark, tmp_path):
    store = Store(spark, str(tmp_path), TABLES)
    proposals = [(f"p{i}", f"m{i}", "r", "v", day(1)) for i in range(3)]
    store.append({"proposals": (spark.createDataFrame(proposals, schema.PROPOSAL), "proposal_id")})
    kind = "command_id string, proposal_id string, action string, entity_id string, name string, email string, reason string, recorded_at timestamp_ntz"
    ask = lambda rows: verdicts(commands.review_proposals(store, spark.createDataFrame(rows, kind), F.lower, F.lower), "command_id")
    assert ask([("c0", "p0", "create", None, "Ana", "A@x.org", "seen", day(2)), ("c1", "p1", "reject", None, None, None, "no", day(2)), ("c2", "p2", "accept", "nobody", "Bo", None, "r", day(2))]) == [("c0", "ok"), ("c1", "ok"), ("c2", "unknown-entity")]
    held = store.snapshot()
    ana = held["entities"].first()["id"]
    assert {(r["kind"], r["value"]) for r in held["aliases"].collect()} == {("name", "Ana"), ("name", "ana"), ("email", "a@x.org")}
    assert ask([("c3", "p1", "correct-accept", ana, "Ana", None, "r", day(3)), ("c4", "p0", "accept", ana, "Ana", None, "r", day(3))]) == [("c3", "ok"), ("c4", "decided")]
    tails = {r["proposal_id"]: r["outcome"] for r in authority.effective(store.snapshot()["decisions"]).collect()}
    assert tails == {"p0": "accepted", "p1": "accepted"}


def test_a_writer_that_comes_back_late(spark, tmp_path):
    """It neither marks its rows nor takes away the hold of the one that took over; a third is refused."""
    rows = spark.createDataFrame([("e", "person", "E", day(1))], schema.ENTITY)
    slow, quick = Store(spark, str(tmp_path), TABLES), Store(spark, str(tmp_path), TABLES, hold=-1)
    third = Store(spark, str(tmp_path), TABLES)

    def late(held):
        with quick.writing():
            late.inner = third
        return {"entities": (rows, "id")}

    with pytest.raises(Lost):
        slow.commit(late)
    assert store_is_empty(slow)
    token = slow.writing()
    token.__enter__()
    other = quick.writing()
    other.__enter__()
    token.__exit__(None, None, None)  # the first leaves; the second still holds
    with pytest.raises(Busy):
        third.append({"entities": (rows, "id")})
    other.__exit__(None, None, None)
    assert third.append({"entities": (rows, "id")}) == {"entities": 1}


def store_is_empty(store):
    return store.snapshot()["entities"].count() == 0


def test_enrichment_asks_once(spark, tmp_path):
    """However many frames of an enrichment are written, each question is put to the directory once."""
    log = tmp_path / "asked"
    log.mkdir()

    def ask(kind, value):
        (log / f"{kind}-{value}-{time.time_ns()}").touch()
        return {"profiles": [{"provider": "d", "subject_id": value, "source": "domain_profile", "display_name": value, "emails": [value]}]}

    work = spark.createDataFrame([("m0", "p0", "ana", "ana@x.org", True, "source"), ("m1", "p1", "ana", "ana@x.org", True, "source"), ("m2", "p2", "bo", None, None, "none")], "mention_id string, proposal_id string, name string, email string, email_ok boolean, binding string")
    none = {n: spark.createDataFrame([], schema.TABLES[n][0]) for n in ("aliases", "decisions", "directory_links")}
    rows, written = directory.enrich(work, lambda q: directory.searched(q, ask), none, ["x.org"], F.lit(day(1)).cast("timestamp_ntz"))
    assert rows.count() == 3
    store = Store(spark, str(tmp_path / "store"), TABLES)
    store.append({n: (df, schema.TABLES[n][1]) for n, df in written.items()})
    assert sorted(p.name.rsplit("-", 1)[0] for p in log.iterdir()) == ["email-ana@x.org", "name-bo"]


def test_a_directory_run(spark, tmp_path):
    """New mentions are asked, fresh answers are reused, a retry waits until it is due; everything is one commit, and a run again adds nothing."""
    from test_ingest import CONFIG, answers, listing, now, tabs

    from evidentia.streaming import sync

    store, log = Store(spark, str(tmp_path / "store"), TABLES), tmp_path / "asked"
    log.mkdir()
    names = spark.createDataFrame([], "entity_id string, name string, is_alias boolean")
    sync.sync(store, listing(spark, "ad"), tabs(spark), answers(), names, CONFIG, now()).count()

    def ask(kind, value):
        (log / f"{value}-{time.time_ns()}").touch()
        if value == "bo li":
            return {"outcome": "rate_limited"}
        return {"profiles": [{"provider": "d", "subject_id": value, "source": "domain_profile", "display_name": "Ana Diaz", "emails": [value]}]}

    def run(days, hours=0):
        for f in log.iterdir():
            f.unlink()
        at = F.lit(datetime(2041, 5, 6 + days, 12 + hours)).cast("timestamp_ntz")
        out = commands.enrich_directory(store, lambda q: directory.searched(q, ask, attempts=1, per_second=100.0, tasks=1), ["x.org"], at, fresh="7 DAYS", retry="2 HOURS")
        return sorted((r["state"], r["kind"] or "", r["verdict"] or "", r["authority"] or "") for r in out.collect()), sorted(f.name.rsplit("-", 1)[0] for f in log.iterdir())

    first = [("ask", "email", "review", "staged")] * 2 + [("ask", "name", "rate_limited", "none")] * 2
    assert run(0) == (first, ["ana@x.org", "bo li"])
    held = store.snapshot()
    assert (held["lookups"].count(), held["profiles"].count(), held["entities"].count(), held["decisions"].count(), held["directory_links"].count(), held["candidates"].count()) == (4, 1, 1, 0, 2, 2)
    assert run(0, 1) == ([("reused", "", "", "")] * 2 + [("waiting", "", "", "")] * 2, [])
    assert run(0, 3) == ([("ask", "name", "rate_limited", "none")] * 2 + [("reused", "", "", "")] * 2, ["bo li"])
    assert run(9)[1] == ["ana@x.org", "bo li"]
    held = store.snapshot()
    assert (held["entities"].count(), held["directory_links"].count(), held["candidates"].count(), held["lookups"].count()) == (1, 2, 2, 10)


def test_a_bucket_bounds_the_calls():
    clock = [0.0]
    bucket = directory.Bucket(2.0, 3, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    at = []
    for _ in range(7):
        bucket.take()
        at.append(round(clock[0], 6))
    assert at == [0, 0, 0, 0.5, 1.0, 1.5, 2.0]
    clock[0] += 100
    bucket.take()
    assert clock[0] == 102.0 and bucket.tokens == 2.0

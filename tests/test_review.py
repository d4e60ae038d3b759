"""Reviewer commands and the write set of an accepted extraction."""

from datetime import datetime

from pyspark.sql import functions as F

from evidentia import schema
from evidentia.operators import authority, review

NOW = datetime(2032, 1, 1)


def test_commands_write_chains(spark):
    decisions = spark.createDataFrame([("d0", "p1", "m1", "accepted", "e1", NOW, None)], schema.RESOLUTION_DECISION)
    proposals = spark.createDataFrame([("p1", "m1"), ("p2", "m2"), ("p3", "m3"), ("p4", "m4")], "proposal_id string, mention_id string")
    entities = spark.createDataFrame([("e1", "person", "Ana", NOW)], schema.ENTITY)
    rows = [
        ("c1", "p1", "correct-reject", None, None, None, NOW), ("c2", "p2", "create", None, " Bo  Li ", "BO@x.org", NOW), ("c3", "p3", "accept", "e9", None, None, NOW),
        ("c4", "p4", "correct-accept", "e1", None, None, NOW), ("c5", "p9", "reject", None, None, None, NOW),
    ]
    commands = spark.createDataFrame(rows, "command_id string, proposal_id string, action string, entity_id string, name string, email string, recorded_at timestamp_ntz")
    decided = review.decide(commands, decisions, proposals, entities)
    assert {r["command_id"]: r["verdict"] for r in decided.collect()} == {"c1": "ok", "c2": "ok", "c3": "unknown-entity", "c4": "undecided", "c5": "unknown-proposal"}
    tails = {r["proposal_id"]: r["outcome"] for r in authority.effective(decisions.unionByName(review.written_decisions(decided))).collect()}
    assert tails == {"p1": "rejected", "p2": "accepted"}
    assert [r["display_name"] for r in review.written_people(decided).collect()] == [" Bo  Li "]
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    assert {(r["kind"], r["value"]) for r in review.written_aliases(decided, plain, plain).collect()} == {("name", "Bo  Li"), ("name", "bo li"), ("email", "bo@x.org")}


def test_automatic_accepts(spark):
    proposals = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "proposal_id string")
    candidates = spark.createDataFrame([("p1", "e1", "exact-email", "a@x"), ("p1", "e2", "name", None), ("p2", "e1", "exact-email", "a@x"), ("p2", "e2", "exact-email", "a@x"), ("p3", "e3", "exact-email", "b@x")], "proposal_id string, entity_id string, reason string, email string")
    grounded = spark.createDataFrame([("p1", "a@x"), ("p2", "a@x"), ("p3", "c@x")], "proposal_id string, email string")
    assert [tuple(r) for r in review.automatic_accepts(proposals, candidates, grounded).collect()] == [("p1", "e1", "a@x")]

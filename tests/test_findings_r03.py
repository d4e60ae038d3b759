"""What the findings of round 3 asked for: results as before, and work that grows no faster than the input."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidentia.functions.order import CITATION
from evidentia.operators import authority, checks, citations, directory, documents, identity, seals, state
from evidentia.plans import lineage
from evidentia.plans.engine import Engine
from evidentia.plans.request import POINT, At, Request
from evidentia.schema import UNRESOLVED_REASONS
from evidentia.sources.store import Conflict, Store
from evidentia.streaming import leases

DECISION = "id string, kind string, target string, outcome string, recorded_at timestamp_ntz, supersedes_id string, authority string"


def held_by(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def decided(seed: int, n: int, old: bool, crossed: bool) -> list[tuple]:
    """Rows of few targets with rivals, chains, repeats, changed repeats and, if crossed, ids that several targets have."""
    of, out = random.Random(seed), []
    for i in range(n):
        target = of.choice([None, *(f"t{k}" for k in range(9))])
        name = lambda: f"{of.choice(['', target or 'none']) if crossed else target or 'none'}/{of.randrange(5)}"  # noqa: E731,B023
        ident = f"old/{target}/{of.randrange(4)}" if old or of.random() < 0.2 else name()
        up = of.choice([None, name(), f"old/{target}/{of.randrange(4)}"])
        out.append((None if not old and of.random() < 0.05 else ident, "k", target, of.choice("ab"), datetime(2024, 1, 1) + timedelta(days=of.randrange(3)), up, of.choice(["reviewer", "reviewer", "automatic"])))
    if old:  # one row an id, and one last decision a target
        out = list({r[2]: r for r in {r[0]: r for r in out}.values()}.values())
    return out if old else out + out


@pytest.mark.parametrize(("crossed", "whole"), [(False, 50_000), (True, 24)])
def test_f1_f8_targets_are_judged_as_by_joins(spark, crossed, whole):
    told = set()
    for seed in (1,):
        stored, new = spark.createDataFrame(decided(seed, 12, True, crossed), DECISION), spark.createDataFrame(decided(seed + 50, 80, False, crossed), DECISION)
        got, want = authority.appendable(stored, new, ["kind", "target"], whole), authority._appendable_by_joins(stored, new, ["kind", "target"])
        got, want = (sorted(map(tuple, df.collect()), key=repr) for df in (got, want))
        assert got == want
        told |= {r[-1] for r in got}
    assert told >= {"append", "replay", "conflict", "decided", "stale", "unauthorised", "no-id"}


def test_f1_f8_the_batch_is_not_written_while_it_is_judged(spark):
    """Before, every row was stored with its digests in the checkpoint folder."""
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    new = spark.range(20_000).selectExpr("concat('d', id) AS id", "'k' AS kind", "concat('t', id div 4) AS target", "'a' AS outcome", "timestamp_ntz '2024-01-01' AS recorded_at", "if(id % 4 = 0, NULL, concat('d', id - 1)) AS supersedes_id")
    before = held_by(folder)
    out = authority.appendable(new.limit(0), new, ["kind", "target"])
    assert [tuple(r) for r in out.groupBy("verdict").count().collect()] == [("append", 20_000)]
    assert held_by(folder) - before < 20 * 20_000


def test_f3_a_task_goes_through_many_runs(spark):
    """Before, each run was a group of its own (FlatMapGroupsInPandas), a frame for every few commands."""
    of = random.Random(3)
    rows = [(of.choice([None, *(f"r{k}" for k in range(40))]), of.randrange(60), i, of.choice(["claim", "claim", "complete", "fail"]), of.choice("ab")) for i in range(900)]
    out = leases.fold(spark.createDataFrame(rows, "run_id string, at long, command_id long, action string, owner string").repartition(7), 10)
    want, state = {}, {}
    for run, at, i, action, owner in sorted(rows, key=lambda r: (r[1], r[2])):
        state[run], outcome = leases.advance(state.get(run, leases.FRESH), at, action, owner, 10)
        want[i] = (run, outcome, state[run][1])
    assert {r["command_id"]: (r["run_id"], r["outcome"], r["attempt"]) for r in out.collect()} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_f2_profiles_of_an_address_are_not_repeated_for_its_mentions(spark):
    """Before, each of 300 mentions carried the 1,000 profiles of its address, and told them apart two by two."""
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    work = spark.range(300).selectExpr("concat('m', id) AS mention_id", "concat('p', id) AS proposal_id", "'' AS name", "if(id % 2 = 0, 'a@x.org', 'b@x.org') AS email", "true AS email_ok", "'source' AS binding")
    profiles = spark.range(1000).selectExpr("'d' AS provider", "concat('s', id) AS subject_id", "'domain_profile' AS source", "'x' AS display_name", "array(if(id = 0, 'B@x.org', 'a@x.org')) AS emails")
    none = {
        "decisions": spark.createDataFrame([], "id string, proposal_id string, mention_id string, outcome string, entity_id string, recorded_at timestamp_ntz, supersedes_id string, authority string, reason string"),
        "aliases": spark.createDataFrame([], "decision_id string, kind string, value string"), "directory_links": spark.createDataFrame([], "provider string, subject_id string, entity_id string, decision_id string, proposal_id string, recorded_at timestamp_ntz"),
    }
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = held_by(folder)
    rows, written = directory.enrich(work, lambda q: directory.found(q, profiles), none, ["x.org"], at)
    assert held_by(folder) - before < 300 * 1000  # less than a byte for each mention's profile
    assert {tuple(r) for r in rows.groupBy("value", "verdict", "authority").count().collect()} == {("a@x.org", "ambiguous", "staged", 150), ("b@x.org", "matched", "accepted", 150)}
    assert written["profiles"].count() == 1000 and written["candidates"].count() == 150 * 999 + 150 and written["decisions"].count() == 150


def test_f7_links_and_citations_are_compared_without_sorting_them(spark):
    """Before, whole citations were sorted by the task that compares them (SortAggregate, SortMergeJoin)."""
    links = spark.createDataFrame([("o1", "e1", "s"), ("o1", "e2", "s"), ("o2", "e2", "s"), ("o2", "e2", "s"), (None, "e3", "s")], "obs_id string, evidence_id string, role string")
    rows = [("o1", "e1", "s", "x", None), ("o1", "e1", "s", None, "x"), ("o9", "e1", "s", "x", None), (None, "e3", "s", "x", None), ("o1", "e4", "s", "x", None), ("o1", "e4", "s", "x", None)]
    cited = spark.createDataFrame(rows, "obs_id string, evidence_id string, role string, source_id string, version_id string")
    cited = cited.select("obs_id", *(c if c in cited.columns else F.lit(None).cast("string").alias(c) for c in CITATION))
    out = citations.link_faults(links, cited)
    want = [("o1", "e2", "s", "uncited"), ("o2", "e2", "s", "uncited"), ("o2", "e2", "s", "uncited"), (None, "e3", "s", "uncited"), ("o9", "e1", "s", "unlinked"), (None, "e3", "s", "unlinked")]
    want += [("o1", "e4", "s", "unlinked"), ("o1", "e4", "s", "unlinked"), (None, "e1", None, "told-twice")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize(("ids", "rows"), [(50_000, 500_000), (4, 6)])
def test_f4_f5_ranks_are_counted_by_ranges_of_ids(spark, ids, rows):
    """Before, one task sorted all entities of a name; a name's ranks now come from several."""
    of = random.Random(4)
    word = lambda: " ".join(of.choice(["red", "old", "ring", "bolt", "cap"]) for _ in range(of.randrange(1, 4)))
    names = [(of.choice([None, " ", *(f"e{k}" for k in range(30))]), of.choice([word(), word(), "", "a@b", None]), of.random() < 0.5) for _ in range(160)]
    said = [(f"m{i}", of.choice([word(), word(), "none", "", "a@b", None])) for i in range(60)]
    want = []
    for mention, name in said:
        best = {}
        for entity, known, alias in names:
            if name and known and "@" not in name + known and (entity or "").strip():
                m, k = name.split(" "), known.split(" ")
                c = 1.0 if name == known else sum(t in k for t in m) / max(len(m), len(k))
                if c > 0:
                    best[entity] = max(best.get(entity, (0.0, False)), (c, not alias))
        order = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))
        want += [(mention, i, e, c, "display" if d else "alias") for i, (e, (c, d)) in enumerate(order, 1)]
    mentions, held = spark.createDataFrame(said, "mention_id string, name string"), spark.createDataFrame(names, "entity_id string, name string, is_alias boolean")
    out = identity.rank_names(mentions, held, ids=ids, rows=rows)
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 100
    assert sorted(map(tuple, identity.rank_names(mentions, held, 2, ids, rows).collect())) == sorted(w for w in want if w[1] <= 2)
    if ids == 4:
        held = spark.range(400).selectExpr("concat('e', id) AS entity_id", "'red ring' AS name", "false AS is_alias")
        one = identity.rank_names(spark.createDataFrame([("m", "red cap")], mentions.schema), held, ids=40, rows=100)
        got = one.select("rank", "entity_id", F.spark_partition_id().alias("task")).collect()
        assert [e for _, e, _ in sorted(got)] == sorted(f"e{i}" for i in range(400)) and [g[0] for g in sorted(got)] == list(range(1, 401))
        assert len({g["task"] for g in got}) > 1


def test_f6_contents_are_written_once_and_judged_by_their_digests(spark, tmp_path):
    """Before, every row was shuffled and stored whole in the checkpoint folder to be judged."""
    kind = StructType([StructField("id", LongType()), StructField("text", StringType())])
    store = Store(spark, str(tmp_path / "store"), {"t": kind})
    rows = lambda lo, hi, x="x": spark.range(lo, hi).selectExpr("id", f"repeat('{x}', 10000) AS text")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = held_by(folder)
    assert store.append({"t": (rows(0, 200), "id")}) == {"t": 200}
    assert held_by(folder) - before < 200 * 1000
    again = rows(150, 250).unionByName(rows(240, 250))  # some are there already, some come twice
    assert store.append({"t": (again, "id")}) == {"t": 50} and store.append({"t": (again, "id")}) == {"t": 0}
    with pytest.raises(Conflict):
        store.append({"t": (rows(249, 300, "y"), "id")})
    with pytest.raises(Conflict):
        store.append({"t": (rows(300, 301).unionByName(rows(300, 301, "y")), "id")})
    held = store.snapshot()["t"]
    assert held.where("text = repeat('x', 10000)").select("id").distinct().count() == held.count() == 250
    assert len([f for f in os.listdir(tmp_path / "store" / "t") if f.startswith("attempt=")]) == 2


class Asked(dict):
    """Tables that count how often each is asked for its rows."""

    def __init__(self, tables):
        super().__init__(tables)
        self.n = {}

    def __getitem__(self, name):
        self.n[name] = self.n.get(name, 0) + 1
        return super().__getitem__(name)

    def get(self, name, default=None):
        return self[name] if name in self else default


def cited_notes(spark) -> dict:
    """Notes on three people, told by name or by mention; each piece of evidence has a document of two sections."""
    people = ["CASE WHEN id % 3 = 0 THEN 'mention' ELSE 'entity' END AS subject_kind", "CASE WHEN id % 3 = 0 THEN concat('m', id) ELSE concat('p', id % 4) END AS subject_ref"]
    day = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    told = spark.range(40).selectExpr("concat('o', id) AS obs_id", *people, "concat('a', id % 5) AS predicate", "'text' AS object_kind", "'v' AS object_ref", "'interval' AS temporal_kind", f"{day} AS valid_start", "CAST(NULL AS TIMESTAMP_NTZ) AS valid_end", f"{day} AS recorded_at", "'observed' AS status")
    links = spark.range(40).selectExpr("concat('o', id) AS obs_id", "concat('e', id) AS evidence_id", "'supporting' AS role")
    chain = [f"{day} AS recorded_at", "CAST(NULL AS STRING) AS supersedes_id", "'reviewer' AS authority", "'seen' AS reason"]
    decisions = spark.range(40).selectExpr("concat('d', id) AS id", "concat('r', id) AS proposal_id", "concat('m', id) AS mention_id", "'accepted' AS outcome", "concat('p', id % 4) AS entity_id", *chain)
    targets = told.selectExpr("'observation' AS k", "obs_id AS t").unionByName(spark.range(40).selectExpr("inline(array(struct('mention' AS k, concat('m', id) AS t), struct('identity_decision' AS k, concat('d', id) AS t)))"))
    admissions = targets.selectExpr("concat(k, t) AS id", "k AS target_kind", "t AS target_id", "'admitted' AS outcome", *chain)
    sections = links.selectExpr("concat('v', evidence_id) AS version_id", "explode(array(0L, 1L)) AS section_order", "evidence_id")
    sections = sections.selectExpr("version_id", "concat('s', section_order) AS section_id", "IF(section_order = 0, 'Cover', 'Note') AS title", "CAST(NULL AS STRING) AS parent_id", "array('x') AS path", "section_order", "'notes' AS role", "IF(section_order = 0, 'never cited', concat('On ', evidence_id)) AS content")
    versions = links.selectExpr("concat('v', evidence_id) AS version_id", "concat('s', evidence_id) AS source_id", "'desk' AS provider", "evidence_id AS provider_id", "evidence_id AS title", "evidence_id AS locator", "'1' AS provider_version", f"{day} AS modified_at", "CAST(NULL AS TIMESTAMP_NTZ) AS source_time", f"{day} AS recorded_at")
    return seals.sealed({
        "observations": told, "links": links, "decisions": decisions, "admissions": admissions, "entities": spark.range(4).selectExpr("concat('p', id) AS id", f"{day} AS recorded_at"), "sections": sections,
        "versions": versions.join(documents.version_records(versions, sections).select("version_id", "digest"), "version_id"), "sources": versions.selectExpr("source_id", "recorded_at"),
        "spans": links.selectExpr("evidence_id", "concat('v', evidence_id) AS version_id", "'s1' AS section_id", "3L AS start_byte", "CAST(3 + length(evidence_id) AS BIGINT) AS end_byte", "evidence_id AS quote", f"{day} AS recorded_at"),
    }, {})


@pytest.mark.parametrize("at_most", [50_000, 0])
def test_f9_an_answer_goes_through_each_table_of_documents_once(spark, monkeypatch, at_most):
    """Before, spans, versions and sources were gone through for each of three questions, and all rows shuffled for it."""
    monkeypatch.setattr(lineage, "FEW", at_most)
    tables = Asked(cited_notes(spark))
    got = Engine(spark, tables).query(Request(POINT, ("p1", "p2"), (At("point", datetime(2024, 1, 2)),), (), "any")).citations
    want = {f"o{i}" for i in range(40) if i % 4 in (1, 2)}
    assert {(r["obs_id"], r["evidence_id"], r["section_title"], r["quote"]) for r in got.collect()} == {(o, f"e{o[1:]}", "Note", f"e{o[1:]}") for o in want}
    assert {n: tables.n[n] for n in ("spans", "versions", "sources", "links")} == {"spans": 1, "versions": 1, "sources": 1, "links": 1}
    keys = spark.range(3).selectExpr("concat('vee', id) AS version_id").localCheckpoint()
    plan = lineage.met(tables["sections"], keys, ["version_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == bool(at_most)


def test_f9_sections_that_nobody_cites_lend_no_content(spark):
    tables = cited_notes(spark)
    kept = Engine(spark, tables)._sections(tables["spans"].where("evidence_id = 'e7'").localCheckpoint())
    assert sorted((r["section_id"], r["content"], len(r["leaf"])) for r in kept.collect()) == [("s0", None, 64), ("s1", "On e7", 64)]


def test_f10_keys_and_values_are_counted_in_one_pass(spark):
    """Before, keys were gone through three times in one stage and met by joins, so that its tasks held all of it at once."""
    of = random.Random(10)
    outcomes = ["resolved", *UNRESOLVED_REASONS, "odd", None]
    keys = [("entity", of.choice(["a", "b", "c", "d", "e", "f"]), of.choice("pqr"), of.choice(outcomes), of.choice(["text", None])) for _ in range(30)]
    values = [("entity", of.choice(["a", "b", "c", "d", "z"]), of.choice("pqr"), "text", of.choice("xyz")) for _ in range(30)]
    keys.append(("absent", None, "p", "resolved", "text"))
    values.append(("absent", None, "p", "text", "x"))
    want = []
    for k in {x[:3] for x in keys}:
        rows, own = [x for x in keys if x[:3] == k], [x[3:] for x in values if x[:3] == k]
        want += [(k, "key twice")] * (len(rows) > 1)
        for *_, outcome, kind in rows:
            want += [(k, "no known outcome")] * (outcome not in outcomes[:-2] or (outcome == "resolved" and kind is None))
            if not own:
                want.append((k, "no candidates"))
            elif outcome == "conflicting-values" and len(set(own)) < 2:
                want.append((k, "conflict of one value"))
            elif len(own) > len(set(own)):
                want.append((k, "a value twice"))
    of_keys = lineage.cut(spark.createDataFrame(keys, "subject_kind string, subject_ref string, predicate string, outcome string, object_kind string"))
    of_values = lineage.cut(spark.createDataFrame(values, "subject_kind string, subject_ref string, predicate string, object_kind string, object_ref string"))
    found = checks.summary_faults(of_keys, of_values)
    name = spark.createDataFrame([k[0] for k in want], "subject_kind string, subject_ref string, predicate string").select(F.to_json(F.struct(*state.KEY)).alias("k")).collect()
    assert sorted((r["detail"], r["fault"]) for r in found.collect()) == sorted((n["k"], f) for n, (_, f) in zip(name, want, strict=True))
    assert len({f for _, f in want}) == 5
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2 and "Join" not in plan

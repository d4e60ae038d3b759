"""Queries of the four questions through the engine, of the directory, reviewers' projections and pointers, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import authority, directory, documents, identity, records, review, seals
from evidentia.plans.engine import Engine
from evidentia.plans.request import CAUSAL, POINT, TRAJECTORY, TREND, At, Between, Request
from evidentia.queries import _BEL, _BOUNDS, _BUN, _KEYS, _PEL, _PUN, _TRAJECTORY, A, B, B2, C, D, K, P, _point, _resolved_sql, _state_sql, _ts, _W1, _window, _EL, _UN, ntz, query
from evidentia.record_queries import _MAIL, _mails, _NAMES
from evidentia.schema import CAUSES

#: Whom the questions are about; the engine is asked as its users ask it, about few entities.
ASKED = ("user:1", "user:2", "user:3", "user:5", "user:8")
_IDS = ", ".join(f"'{x}'" for x in ASKED)
_VIEWS = ("fx_admissions", "fx_entities", "fx_evidence")


def _kept_sql(cutoff: str | None) -> str:
    """`cand`: what the engine keeps of the observations, with resolved subjects, as the state rules ask for it."""
    known = f"recorded_at <= {_ts(cutoff)}" if cutoff else "true"
    return f"""{_resolved_sql(cutoff)}, t AS (SELECT o.*, CASE WHEN subject_kind='mention' THEN rm.entity_id WHEN e.id IS NOT NULL THEN e.id END AS ent_id
 FROM (SELECT * FROM fx_obs WHERE {known}) o LEFT JOIN rm ON o.subject_kind='mention' AND o.subject_ref=rm.mention_id LEFT JOIN ent e ON o.subject_kind='entity' AND o.subject_ref=e.id),
cand AS (SELECT * REPLACE ('entity' AS subject_kind, ent_id AS subject_ref), EXISTS(SELECT 1 FROM fx_evidence e WHERE e.obs_id=t.obs_id AND e.role='supporting') AS sup
 FROM t WHERE status<>'rejected' AND ent_id IN ({_IDS}) AND obs_id IN (SELECT target_id FROM adm WHERE target_kind='observation') AND obs_id IN (SELECT obs_id FROM fx_evidence))"""


def _engine(p) -> Engine:
    own = {"observations": p["fx_obs"].drop("event_id", "user_id", "ts"), "links": p["fx_evidence"], "decisions": p["fx_decisions"], "admissions": p["fx_admissions"], "entities": p["fx_entities"]}
    return Engine(p.spark, own)


def _win(label: str, lo: str, hi: str) -> Between:
    return Between(label, datetime.fromisoformat(lo), datetime.fromisoformat(hi))


def _ask(p, intent, *selections, limit=0, known=None, predicates=()):
    return _engine(p).query(Request(intent, ASKED, selections, predicates, "any", datetime.fromisoformat(known) if known else None, limit))


def _trend_sql(cutoff):
    return f""", {_kept_sql(cutoff)}, {_state_sql('a', 'cand', *_W1)}, {_state_sql('b', 'cand', _window(_EL, _ts(B2), _ts(C)), _window(_UN, _ts(B2), _ts(C)))},
j AS (SELECT subject_kind,subject_ref,predicate,a.o AS ao,b.o AS bo,CASE WHEN a.o='resolved' THEN a.vk END AS ak,CASE WHEN a.o='resolved' THEN a.vr END AS ar,CASE WHEN b.o='resolved' THEN b.vk END AS bk,CASE WHEN b.o='resolved' THEN b.vr END AS br FROM ak a FULL JOIN bk b USING (subject_kind,subject_ref,predicate))
SELECT subject_kind,subject_ref,predicate,CASE WHEN coalesce(ao,'resolved')<>'resolved' OR coalesce(bo,'resolved')<>'resolved' THEN 'unresolved' WHEN ao IS NULL THEN 'added' WHEN bo IS NULL THEN 'removed' ELSE 'changed' END AS change,ar AS before_object_ref,br AS after_object_ref,ao AS before_outcome,bo AS after_outcome FROM j
WHERE coalesce(ao,'resolved')<>'resolved' OR coalesce(bo,'resolved')<>'resolved' OR ao IS NULL OR bo IS NULL OR ak<>bk OR ar<>br"""


def _trend(p, known=None) -> DataFrame:
    return _ask(p, TREND, _win("before", A, B), _win("after", B2, C), known=known).changes.drop("before_object_kind", "after_object_kind")


@query(_trend_sql(None), *_VIEWS)
def engine_trend(p):
    return _trend(p)


@query(_trend_sql(K), *_VIEWS)
def engine_trend_asof(p):
    return _trend(p, K)


_POINT = f", {_kept_sql(K)}, {_state_sql('p', 'cand', _point(_PEL, _ts(P)), _point(_PUN, _ts(P)))}"


@query(
    _POINT + " SELECT c.subject_ref, c.predicate, c.object_ref, k.o AS outcome, c.cls, c.obs_id, c.status, c.recorded_at, e.evidence_id, e.role FROM pc c JOIN pk k USING (subject_kind,subject_ref,predicate) LEFT JOIN fx_evidence e ON e.obs_id=c.obs_id WHERE k.o<>'resolved' OR c.cls='s'",
    *_VIEWS,
)
def engine_point(p):
    """Every contribution and citation of a state at one instant, as known earlier."""
    told = _ask(p, POINT, At("point", datetime.fromisoformat(P)), known=K).citations
    return told.select("subject_ref", "predicate", "object_ref", "outcome", "cls", "obs_id", "status", "recorded_at", "evidence_id", "role")


_QUOTE = "ünited."


def _documents(links: DataFrame) -> dict[str, DataFrame]:
    """A document of two sections for each piece of evidence, which quotes the second; sealed as a store has them."""
    i, at, null = F.col("evidence_id"), ntz("1990-01-01 00:00:00"), F.lit(None).cast("string")
    # ids are columns of what is grouped, digests are made with the other columns: who asks for few ids has only these grouped and made
    one = links.select("evidence_id", F.concat(F.lit("v:"), i).alias("version_id"), F.concat(F.lit("s:"), i).alias("source_id")).distinct()
    named = lambda columns: [c.alias(n) for n, c in columns.items()]
    section = lambda n, title, text: {"section_id": F.lit(f"s{n}"), "title": F.lit(title), "parent_id": null, "path": F.array(F.lit(title)), "section_order": F.lit(n).cast("long"), "role": F.lit("notes"), "content": text}
    held = [section(0, "Cover", F.concat(F.lit("Cover of "), i)), section(1, "Note", F.concat(F.lit("On "), i, F.lit(f": {_QUOTE}")))]
    leaves = [documents.section_leaf(documents.content_hash(x["content"]), x.get) for x in held]
    sections = [one.select("version_id", *named(x), leaf.alias("leaf")) for x, leaf in zip(held, leaves, strict=True)]
    start = (F.octet_length(i) + 5).cast("long")
    spans = one.select("evidence_id", "version_id", F.lit("s1").alias("section_id"), start.alias("start_byte"), (start + len(_QUOTE.encode())).alias("end_byte"), F.lit(_QUOTE).alias("quote"), at.alias("recorded_at"))
    sources = one.select("source_id", F.lit("desk").alias("provider"), i.alias("provider_id"), at.alias("recorded_at"))
    own = {"provider": F.lit("desk"), "provider_id": i, "title": F.concat(F.lit("Log "), i), "locator": F.concat(F.lit("log/"), i), "provider_version": F.lit("1"), "modified_at": at, "source_time": F.lit(None).cast("timestamp_ntz"), "recorded_at": at}
    root = documents.version_root((own | {"n": F.lit(len(held)).cast("long"), "entries": F.concat(*leaves)}).get)
    versions = one.select("version_id", "source_id", *named(own), root.alias("digest"))
    return {"sections": sections[0].unionByName(sections[1]), "spans": spans, "sources": sources, "versions": versions}


@query(
    _POINT + f" SELECT c.subject_ref, c.predicate, c.obs_id, e.evidence_id, e.role, 'v:' || e.evidence_id AS version_id, 's:' || e.evidence_id AS source_id, 's1' AS section_id, 'Note' AS section_title, CAST(1 AS BIGINT) AS section_order, CAST(strlen(e.evidence_id) + 5 AS BIGINT) AS start_byte, CAST(strlen(e.evidence_id) + {5 + len(_QUOTE.encode())} AS BIGINT) AS end_byte, '{_QUOTE}' AS quote FROM pc c JOIN pk k USING (subject_kind,subject_ref,predicate) JOIN fx_evidence e ON e.obs_id=c.obs_id WHERE k.o<>'resolved' OR c.cls='s'",
    *_VIEWS,
)
def engine_cited(p):
    """The same with documents: every citation with its bytes, section, version and source, all proved by their digests."""
    own = _engine(p).t
    told = {"authority": F.lit("reviewer"), "reason": F.lit("seen")}
    own = own | {n: own[n].withColumns(told) for n in ("decisions", "admissions")} | _documents(own["links"])
    engine = Engine(p.spark, seals.sealed(own, {}))
    out = engine.query(Request(POINT, ASKED, (At("point", datetime.fromisoformat(P)),), (), "any", datetime.fromisoformat(K))).citations
    return out.where("evidence_id is not null").select("subject_ref", "predicate", "obs_id", "evidence_id", "role", "version_id", "source_id", "section_id", "section_title", "section_order", "start_byte", "end_byte", "quote")


@query(
    _POINT + """, g AS (SELECT subject_ref, predicate, object_ref, string_agg(DISTINCT obs_id, ' ' ORDER BY obs_id) AS ids, string_agg(DISTINCT CASE WHEN role='supporting' THEN evidence_id END, ' ' ORDER BY CASE WHEN role='supporting' THEN evidence_id END) AS sup,
 string_agg(DISTINCT CASE WHEN role='contradicting' THEN evidence_id END, ' ' ORDER BY CASE WHEN role='contradicting' THEN evidence_id END) AS con
 FROM (SELECT c.subject_ref, c.predicate, c.object_ref, c.obs_id, e.evidence_id, e.role FROM pc c JOIN pk k USING (subject_kind,subject_ref,predicate) LEFT JOIN fx_evidence e ON e.obs_id=c.obs_id WHERE k.o='resolved' AND c.cls='s') GROUP BY 1, 2, 3)
SELECT subject_ref, predicate, object_ref, ids AS obs_ids, coalesce(sup, '') AS supporting_ids, coalesce(con, '') AS contradicting_ids FROM g""",
    *_VIEWS,
)
def engine_point_json(p):
    """The facts of the JSON envelope, taken apart again."""
    e = _engine(p)
    text = e.envelope(_ask(p, POINT, At("point", datetime.fromisoformat(P)), known=K))
    cited = "array<struct<evidence_id:string>>"
    fact = f"struct<label:string,key:struct<subject:struct<kind:string,ref:string>,predicate:string>,value:struct<kind:string,ref:string>,contributions:array<struct<obs_id:string>>,supporting:{cited},contradicting:{cited}>"
    rows = text.select(F.explode(F.from_json("json", f"struct<point:struct<facts:array<{fact}>>>")["point"]["facts"]).alias("f"))
    joined = lambda c, k: F.array_join(F.array_sort(F.transform(c, lambda x: x[k])), " ")
    return rows.select(
        F.col("f.key.subject.ref").alias("subject_ref"), F.col("f.key.predicate").alias("predicate"), F.col("f.value.ref").alias("object_ref"), joined(F.col("f.contributions"), "obs_id").alias("obs_ids"),
        joined(F.col("f.supporting"), "evidence_id").alias("supporting_ids"), joined(F.col("f.contradicting"), "evidence_id").alias("contradicting_ids"),
    )


# the plain trajectory over what the engine keeps, then what tells each transition's two sides
_MOVES = _TRAJECTORY.split("cut AS", 1)[1].split("\nl AS (", 1)[0]
_MOVES = f""", {_kept_sql(None)}, {_BOUNDS}, cut AS{_MOVES}
l AS (SELECT *, lag(o) OVER w AS po, lag(vk) OVER w AS pk, lag(vr) OVER w AS pr, lag(lo) OVER w AS plo FROM f WINDOW w AS (PARTITION BY subject_kind,subject_ref,predicate ORDER BY lo NULLS FIRST)),
mv AS (SELECT * FROM l WHERE lo IS NOT NULL AND ((o='resolved' AND coalesce(po,'')<>'resolved') OR (po='resolved' AND coalesce(o,'')<>'resolved') OR (o='resolved' AND po='resolved' AND (vk<>pk OR vr<>pr)))),
al AS (SELECT subject_kind,subject_ref,predicate,lo,cls,object_ref,obs_id,recorded_at FROM uc UNION ALL SELECT subject_kind,subject_ref,predicate,NULL,cls,object_ref,obs_id,recorded_at FROM zc),
mt AS (SELECT mv.subject_ref, mv.predicate, mv.lo AS instant, 'after' AS side, mv.o AS outcome, al.object_ref, al.obs_id, al.recorded_at FROM mv JOIN al USING (subject_kind,subject_ref,predicate) WHERE al.lo IS NOT DISTINCT FROM mv.lo AND (mv.o<>'resolved' OR cls='s')
 UNION ALL SELECT mv.subject_ref, mv.predicate, mv.lo, 'before', mv.po, al.object_ref, al.obs_id, al.recorded_at FROM mv JOIN al USING (subject_kind,subject_ref,predicate) WHERE al.lo IS NOT DISTINCT FROM mv.plo AND (mv.po<>'resolved' OR cls='s'))"""


def _trajectory(p):
    return _ask(p, TRAJECTORY, _win("between", A, D), limit=10_000)


@query(
    _MOVES + """, tie AS (SELECT subject_ref, predicate, instant, min(recorded_at) AS first_recorded, min(obs_id) AS first_obs FROM mt GROUP BY 1, 2, 3)
SELECT subject_ref, predicate, lo AS instant, CASE WHEN o='resolved' AND coalesce(po,'')<>'resolved' THEN 'added' WHEN coalesce(o,'')<>'resolved' THEN 'removed' ELSE 'changed' END AS change, CASE WHEN po='resolved' THEN pr END AS before_object_ref, CASE WHEN o='resolved' THEN vr END AS after_object_ref,
 first_recorded, first_obs, CAST(row_number() OVER (ORDER BY lo, first_recorded, first_obs, mv.subject_ref, mv.predicate) AS BIGINT) AS place FROM mv JOIN tie USING (subject_ref, predicate) WHERE tie.instant = mv.lo""",
    *_VIEWS,
)
def engine_trajectory(p):
    """Transitions in their order: by instant, then by what tells them."""
    rows = _trajectory(p).transitions
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy().orderBy("instant", "first_recorded", "first_obs", "subject_ref", "predicate")).cast("long")  # at most 10,000 rows
    return rows.select("subject_ref", "predicate", "instant", "change", "before_object_ref", "after_object_ref", "first_recorded", "first_obs", place.alias("place"))


@query(_MOVES + " SELECT DISTINCT subject_ref, predicate, instant, side, outcome, object_ref, obs_id FROM mt", *_VIEWS)
def transition_material(p):
    """The observations of both sides of every transition, unresolved candidates included."""
    return _trajectory(p).moves.select("subject_ref", "predicate", "instant", "side", "outcome", "object_ref", "obs_id").distinct()


_CLAIMS = f""", {_resolved_sql(None)}, t AS (SELECT o.*, CASE WHEN subject_kind='mention' THEN rm.entity_id WHEN e.id IS NOT NULL THEN e.id END AS se, f.id AS oe
 FROM fx_pairs o LEFT JOIN rm ON o.subject_kind='mention' AND o.subject_ref=rm.mention_id LEFT JOIN ent e ON o.subject_kind='entity' AND o.subject_ref=e.id LEFT JOIN ent f ON o.object_ref=f.id),
k AS (SELECT * FROM t WHERE se IS NOT NULL AND oe IS NOT NULL AND (se IN ({_IDS}) OR oe IN ({_IDS})) AND replace(obs_id,'rel:','obs:') IN (SELECT target_id FROM adm WHERE target_kind='observation') AND replace(obs_id,'rel:','obs:') IN (SELECT obs_id FROM fx_evidence) AND {_W1[0]}),
ev AS (SELECT replace(obs_id,'obs:','rel:') AS obs_id, count(*) FILTER (role='supporting') AS ns, count(*) FILTER (role='contradicting') AS nc FROM fx_evidence GROUP BY 1)"""


@query(
    _CLAIMS + " SELECT se AS cause_ref, oe AS effect_ref, CAST(count(*) AS BIGINT) AS n_observations, min(coalesce(valid_start,valid_end)) AS first_bound, min(recorded_at) AS first_recorded, min(k.obs_id) AS first_obs, CAST(sum(ns) AS BIGINT) AS n_supporting, CAST(sum(nc) AS BIGINT) AS n_contradicting FROM k JOIN ev USING (obs_id) GROUP BY 1, 2",
    *_VIEWS, "fx_pairs",
)
def engine_causal(p):
    """The pairs of people read as explicit causal claims."""
    own = lambda df, c: df.withColumn(c, F.regexp_replace(c, "^obs:", "rel:"))
    tables = {
        "observations": p["fx_pairs"].withColumn("predicate", F.lit(CAUSES)).drop("event_id", "user_id", "ts"), "links": own(p["fx_evidence"], "obs_id"), "decisions": p["fx_decisions"],
        "admissions": own(p["fx_admissions"], "target_id"), "entities": p["fx_entities"],
    }
    r = Engine(p.spark, tables).query(Request(CAUSAL, ASKED, (_win("w", A, B),), (CAUSES,), "any", None, 10_000))
    return r.links.drop("cause_kind", "effect_kind")


# ---- identity, directory, review, pointers ----------------------------------------------------------


@query(
    f"""WITH {_NAMES.replace('m AS (SELECT DISTINCT', 'm AS (SELECT DISTINCT', 1)}, w AS (SELECT mention_id, name, CASE WHEN length(name) % 3 = 0 THEN 'a' || length(name) || '@x.org' ELSE '' END AS email FROM m),
o AS (SELECT 'a' || length(p_name) || '@x.org' AS email, 'part:' || min(p_partkey) AS eid, count(DISTINCT p_partkey) AS n FROM part WHERE p_partkey % 97 = 0 GROUP BY 1),
x AS (SELECT w.mention_id, o.eid FROM w JOIN o ON w.email = o.email WHERE o.n = 1)
SELECT mention_id, 'automatic' AS outcome, eid AS entity_id, 1 AS rank FROM x
UNION ALL SELECT mention_id, 'ranked', entity_id, CAST(rank AS INTEGER) FROM r WHERE mention_id NOT IN (SELECT mention_id FROM x)
UNION ALL SELECT mention_id, 'none', NULL, NULL FROM w WHERE mention_id NOT IN (SELECT mention_id FROM x) AND mention_id NOT IN (SELECT mention_id FROM r)"""
)
def resolver_outcomes(p):
    """One outcome for each mention: the owner of its address, else all names that share a word with it."""
    part = p["part"]
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    said = F.concat_ws(" ", "p_name", second)
    mail = lambda n: F.concat(F.lit("a"), F.length(n).cast("string"), F.lit("@x.org"))
    mentions = part.select(F.concat(F.lit("m:"), said).alias("mention_id"), said.alias("name")).distinct()
    mentions = mentions.withColumn("email", F.when(F.length("name") % 3 == 0, mail("name")).otherwise(""))
    eid = F.concat(F.lit("part:"), "p_partkey").alias("entity_id")
    names = part.select(eid, F.col("p_name").alias("name"), F.lit(False).alias("is_alias")).unionByName(part.select(eid, F.concat_ws(" ", F.lower("p_type"), second).alias("name"), F.lit(True).alias("is_alias")))
    emails = part.where("p_partkey % 97 = 0").select(eid, mail("p_name").alias("email"))
    return identity.resolve(mentions, names, emails).select("mention_id", "outcome", "entity_id", "rank")


@query(
    f"""WITH {_MAIL}, q AS (SELECT mention_id, email, CAST(substr(mention_id,2) AS BIGINT) AS s FROM m),
pf AS (SELECT email, 'c' || min(CAST(substr(entity_id,2) AS BIGINT)) AS subject, count(DISTINCT entity_id) AS k FROM o GROUP BY email),
ow AS (SELECT email, min(entity_id) AS owner, count(DISTINCT entity_id) AS n FROM o WHERE CAST(substr(entity_id,2) AS BIGINT) % 3 = 0 GROUP BY email),
j AS (SELECT q.*, coalesce(pf.k, 0) AS k, pf.subject, coalesce(ow.n, 0) AS n, ow.owner FROM q LEFT JOIN pf USING (email) LEFT JOIN ow USING (email)),
v AS (SELECT *, CASE WHEN k = 0 THEN 'no_match' WHEN k > 1 THEN 'ambiguous' WHEN s % 4 = 1 OR n > 1 THEN 'review' ELSE 'matched' END AS verdict FROM j)
SELECT mention_id, verdict, CASE WHEN verdict = 'matched' THEN CASE WHEN s % 5 = 0 THEN 'staged' ELSE 'accepted' END WHEN k > 0 THEN 'staged' ELSE 'none' END AS authority, CASE WHEN verdict = 'matched' AND s % 5 <> 0 AND n = 1 THEN owner END AS owner FROM v"""
)
def directory_enrichment(p):
    """Mentions asked for by address, judged against owners, and what may be decided without a reviewer."""
    m, o = _mails(p)
    s, c = F.substring("mention_id", 2, 20).cast("long"), F.substring("entity_id", 2, 20).cast("long")
    work = m.select("mention_id", F.concat(F.lit("p"), "mention_id").alias("proposal_id"), F.lit("").alias("name"), "email", F.lit(True).alias("email_ok"), F.when(s % 4 == 1, "cited").otherwise("source").alias("binding"))
    profiles = o.select(F.lit("d").alias("provider"), F.col("entity_id").alias("subject_id"), F.lit("domain_profile").alias("source"), F.lit("x").alias("display_name"), F.array("email").alias("emails"))
    at = ntz(A)
    null = F.lit(None).cast("string")
    owned = o.where(c % 3 == 0).select(F.concat(F.lit("d"), "entity_id").alias("id"), F.concat(F.lit("q"), "entity_id").alias("proposal_id"), F.lit("m").alias("mention_id"), F.lit("accepted").alias("outcome"), "entity_id", at.alias("recorded_at"), null.alias("supersedes_id"), F.lit("reviewer").alias("authority"), F.lit("r").alias("reason"), "email")
    seen = m.where(s % 5 == 0).select(F.concat(F.lit("s"), "mention_id").alias("id"), F.concat(F.lit("p"), "mention_id").alias("proposal_id"), "mention_id", F.lit("rejected").alias("outcome"), null.alias("entity_id"), at.alias("recorded_at"), null.alias("supersedes_id"), F.lit("reviewer").alias("authority"), F.lit("r").alias("reason"))
    state = {
        "decisions": owned.drop("email").unionByName(seen), "aliases": owned.select(F.col("id").alias("decision_id"), F.lit("email").alias("kind"), F.col("email").alias("value")),
        "directory_links": owned.select(null.alias("provider"), null.alias("subject_id"), "entity_id", null.alias("decision_id"), "proposal_id", "recorded_at").where("false"),
    }
    rows, _ = directory.enrich(work, lambda q: directory.found(q, profiles), state, ["example.org"], at)
    return rows.select("mention_id", "verdict", "authority", F.when(F.length("entity_id") < 64, F.col("entity_id")).alias("owner"))


@query(
    "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS now, max_by(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate <= TIMESTAMP '1995-06-30 00:00:00') AS earlier FROM orders GROUP BY 1"
)
def current_pointer(p):
    """Where each source's pointer stands now, and stood at an earlier time."""
    rows = p["orders"].select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("recorded_at"), F.col("o_orderkey").alias("seq"))
    now, earlier = records.current_versions(rows), records.current_versions(rows, "1995-06-30 00:00:00")
    out = now.join(earlier.withColumnRenamed("version_id", "earlier"), "source_id", "left")
    return out.select(F.col("source_id").alias("o_custkey"), F.col("version_id").alias("now"), "earlier")


@query(
    "SELECT l_orderkey AS o_orderkey, string_agg(CAST(c_custkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS found FROM lineitem LEFT JOIN customer ON l_partkey = c_custkey GROUP BY 1"
)
def ordered_lookup(p):
    """Lists of ids looked up with their order kept; ids without a record are left out."""
    lists = p["lineitem"].groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    out = review.looked_up(lists, "l_orderkey", "ids", p["customer"].select(F.col("c_custkey").alias("k"), "c_name"), "k")
    found = F.array_join(F.transform("records", lambda r: r["k"].cast("string")), " ")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.size("records") > 0, found).alias("found"))


@query(
    """SELECT id, CASE WHEN n % 6 = 0 THEN 'accepted-without-entity' WHEN n % 6 = 1 THEN 'rejected-with-entity' WHEN n % 6 = 2 THEN 'authority' WHEN n % 6 = 3 THEN 'long-reason' WHEN n % 6 = 4 THEN 'supersedes-itself' END AS fault FROM (SELECT id, CAST(split_part(id, ':', 2) AS BIGINT) AS n FROM fx_decisions) WHERE n % 6 < 5""",
    "fx_decisions",
)
def decision_faults(p):
    """Decisions of which five in six break one rule each."""
    n = F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 6
    rows = p["fx_decisions"].withColumns({
        "outcome": F.when(n == 1, "rejected").otherwise("accepted"), "entity_id": F.when(n == 0, F.lit(None).cast("string")).otherwise(F.lit("e")), "authority": F.when(n == 2, "nobody").otherwise("reviewer"),
        "reason": F.when(n == 3, F.repeat(F.lit("x"), 129)).otherwise("seen"), "supersedes_id": F.when(n == 4, F.col("id")).otherwise(F.col("supersedes_id")),
    })
    return rows.select("id", authority.resolution_fault().alias("fault")).where("fault is not null")


@query("SELECT id FROM fx_decisions WHERE id LIKE '%9:0'", "fx_decisions")
def digest_violations(p):
    """Decisions that were changed after their digest was made."""
    rows = p["fx_decisions"].withColumns({"authority": F.lit("automatic"), "reason": F.lit("r")})
    rows = rows.withColumn("digest", authority.decision_digest(*authority.RESOLUTION_DIGEST))
    return authority.digest_violations(rows.withColumn("reason", F.when(F.col("id").like("%9:0"), "changed").otherwise(F.col("reason"))), authority.RESOLUTION_DIGEST)


# ---- sources and ingest -----------------------------------------------------------------------------


def _reader():
    """A model that quotes a document whole; it fails for some documents and answers wrongly for others."""

    def model(text: str) -> str:
        import json

        section, body = next(iter(json.loads(text).items()))
        if "#fails#" in body:
            raise TimeoutError("no answer")
        people = [{"id": i, "name": n, "email": None, "citation_ids": ["c1"]} for i, n in (("p1", "Ana Diaz"), ("p2", "Bo Li"))]
        signal = {"id": "s1", "subject_id": "p1", "object_id": "p1" if "#wrong#" in body else "p2", "category": "support_advocacy", "direction": "mixed", "citation_ids": ["c1"]}
        return json.dumps({"meeting_date": None, "citations": [{"id": "c1", "section_id": section, "start": 0, "end": 0, "quote": body}], "people": people, "statements": [], "signals": [signal]})

    return model


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE doc_id % 6 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' WHEN 3 THEN 'unchanged' WHEN 4 THEN CASE WHEN doc_id % 12 = 4 THEN 'incomplete' ELSE 'completed' END ELSE 'completed' END AS outcome, CASE doc_id % 6 WHEN 0 THEN 'model' WHEN 1 THEN 'invalid-extraction: signal ends' WHEN 2 THEN 'invalid-source: transcripts' WHEN 4 THEN CASE WHEN doc_id % 12 = 4 THEN 'busy' END END AS fault, CASE WHEN doc_id % 6 >= 3 AND doc_id % 12 <> 4 THEN 1 ELSE 0 END AS observations FROM documents"
)
def sync_documents(p):
    """Every document as a source of one talk, synced into a store of its own: some were synced before, some fail, some are
    claimed by another sync that still runs."""
    import uuid

    from evidentia import schema
    from evidentia.plans.lineage import shared_folder
    from evidentia.sources.store import Store
    from evidentia.streaming import sync

    k = F.col("doc_id") % 6
    docs = p["documents"].select("doc_id", F.concat(F.lit("Ana Diaz wrote to Bo Li: "), F.coalesce("text", F.lit("")), F.when(k == 0, " #fails#").when(k == 1, " #wrong#").otherwise("")).alias("body"))
    name = F.col("doc_id").cast("string")
    listing = docs.select(name.alias("doc_id"), F.lit("desk").alias("provider"), F.concat(F.lit("Talk "), name).alias("title"), F.concat(F.lit("talk/"), name).alias("locator"), F.lit("1").alias("provider_version"), ntz(A).alias("modified_at"))
    tabs = docs.select(name.alias("doc_id"), F.lit("t").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("position"), F.lit("Transcript").alias("title"), F.when(k == 2, "notes").otherwise("transcript").alias("role"), F.col("body").alias("content"))
    names = p.spark.createDataFrame([("person:bo", "bo li", False)], "entity_id string, name string, is_alias boolean")
    store = Store(p.spark, f"{shared_folder(p.spark)}/sync-{uuid.uuid4().hex}", {n: t for n, (t, _) in schema.TABLES.items()})
    config = sync.Config("desk", "reader", "1")
    ran = lambda rows, at: sync.sync(store, rows, tabs, _reader(), names, config, ntz(at))
    ran(listing.where(F.col("doc_id").cast("long") % 6 == 3), A).count()
    sync.prepare(store, listing.where(F.col("doc_id").cast("long") % 12 == 4), tabs, config, ntz(B), "another")
    out = ran(listing, B)
    held = store.snapshot()
    n = held["observations"].select(F.col("obs_id")).join(held["links"], "obs_id").join(held["spans"], "evidence_id").join(held["versions"].select("version_id", "source_id"), "version_id").join(held["sources"], "source_id")
    n = n.groupBy(F.col("provider_id").alias("doc_id")).agg(F.count_distinct("obs_id").cast("int").alias("observations"))
    return out.join(n, "doc_id", "left").select("doc_id", "outcome", "fault", F.coalesce("observations", F.lit(0)).alias("observations"))

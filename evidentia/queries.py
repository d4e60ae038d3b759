"""One query per operator over the driver's tables, each with the SQL that its result is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import timeaxis as ta
from evidentia.operators import authority, causal, state, trajectory
from evidentia.schema import CAUSES
from evidentia.sources.projection import Projection, with_views

A, B, B2, C = "2024-01-10 00:00:00", "2024-01-17 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"
K, P, D = "2024-01-15 00:00:00", "2024-01-12 12:00:00", "2024-01-17 00:00:00"
PREDICATES = [f"attr.{i}" for i in range(12)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of a Projection under its name; sql follows the views it names."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Projection(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql is not None:
            head = with_views(*views) if views else ""
            body = sql.strip()
            if head and body.startswith(","):
                body = head + body
            elif head:
                body = f"{head}\n{body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return add


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def cands(p: Projection, cutoff: str | None = None) -> DataFrame:
    return state.candidates(p["fx_obs"], p["fx_evidence"], cutoff)


# ---- SQL pieces -------------------------------------------------------------------------------------

_EL = "CASE temporal_kind WHEN 'instant' THEN valid_start >= {A} AND valid_start < {B} WHEN 'interval' THEN (valid_start IS NULL OR valid_start < {B}) AND (valid_end IS NULL OR valid_end > {A}) ELSE false END"
_UN = "CASE temporal_kind WHEN 'unknown' THEN true WHEN 'window' THEN valid_start < {B} AND valid_end > {A} ELSE false END"
_PEL = "CASE temporal_kind WHEN 'instant' THEN valid_start = {T} WHEN 'interval' THEN (valid_start IS NULL OR valid_start <= {T}) AND (valid_end IS NULL OR valid_end > {T}) ELSE false END"
_PUN = "CASE temporal_kind WHEN 'unknown' THEN true WHEN 'window' THEN valid_start <= {T} AND valid_end > {T} ELSE false END"
_BEL = "CASE WHEN temporal_kind = 'interval' THEN (valid_start IS NULL OR valid_start < {T}) AND (valid_end IS NULL OR valid_end >= {T}) ELSE false END"
_BUN = "CASE WHEN temporal_kind = 'unknown' THEN true WHEN temporal_kind = 'window' THEN valid_start < {T} AND valid_end >= {T} ELSE false END"
_OVER = """CASE WHEN l.temporal_kind='instant' AND r.temporal_kind='instant' THEN l.valid_start=r.valid_start
 WHEN l.temporal_kind='instant' THEN (r.valid_start IS NULL OR l.valid_start>=r.valid_start) AND (r.valid_end IS NULL OR l.valid_start<r.valid_end)
 WHEN r.temporal_kind='instant' THEN (l.valid_start IS NULL OR r.valid_start>=l.valid_start) AND (l.valid_end IS NULL OR r.valid_start<l.valid_end)
 ELSE (l.valid_start IS NULL OR r.valid_end IS NULL OR l.valid_start<r.valid_end) AND (r.valid_start IS NULL OR l.valid_end IS NULL OR r.valid_start<l.valid_end) END"""


def _ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"


def _window(template: str, lo: str, hi: str) -> str:
    return template.replace("{A}", lo).replace("{B}", hi)


def _point(template: str, t: str) -> str:
    return template.replace("{T}", t)


def _cands_sql(cutoff: str | None = None) -> str:
    known = f" AND recorded_at <= {_ts(cutoff)}" if cutoff else ""
    return f"cand AS (SELECT s.*, EXISTS(SELECT 1 FROM fx_evidence e WHERE e.obs_id=s.obs_id AND e.role='supporting') AS sup FROM fx_obs s WHERE status<>'rejected'{known})"


def _state_sql(tag: str, source: str, el: str, un: str, extra: str = "") -> str:
    """Tables {tag}c (classified rows), {tag}v (values), {tag}k (keys with outcome o); extra: leading key columns."""
    x = f"{extra}, " if extra else ""
    same = "l.subject_kind=r.subject_kind AND l.subject_ref=r.subject_ref AND l.predicate=r.predicate" + (f" AND l.{extra}=r.{extra}" if extra else "")
    return f"""{tag}e AS (SELECT *, {el} AS el, {un} AS un FROM {source}),
{tag}c AS (SELECT *, CASE WHEN NOT sup THEN 'c' WHEN un OR status='hypothesized' THEN 't' ELSE 's' END AS cls FROM {tag}e WHERE el OR un),
{tag}v AS (SELECT {x}subject_kind,subject_ref,predicate,object_kind,object_ref,max(CASE WHEN cls='s' THEN 1 ELSE 0 END) AS s,max(CASE WHEN cls='t' THEN 1 ELSE 0 END) AS t,max(CASE WHEN cls='c' THEN 1 ELSE 0 END) AS cc,
 max(CASE WHEN cls='t' AND un THEN 1 ELSE 0 END) AS tv,max(CASE WHEN cls='t' AND NOT un THEN 1 ELSE 0 END) AS hv,count(*) AS n FROM {tag}c GROUP BY ALL),
{tag}g AS (SELECT {x}subject_kind,subject_ref,predicate,sum(s) AS ns,sum(cc) AS nc,count(*) AS nv,max(CASE WHEN tv=1 AND s=0 THEN 1 ELSE 0 END) AS q1,max(CASE WHEN hv=1 AND s=0 THEN 1 ELSE 0 END) AS q2,
 max(CASE WHEN s=1 THEN object_kind END) AS vk,max(CASE WHEN s=1 THEN object_ref END) AS vr FROM {tag}v GROUP BY ALL),
{tag}o AS (SELECT DISTINCT {'l.' + extra + ',' if extra else ''}l.subject_kind,l.subject_ref,l.predicate FROM {tag}c l JOIN {tag}c r ON {same} AND l.object_ref<r.object_ref AND l.cls='s' AND r.cls='s' AND {_OVER}),
{tag}k AS (SELECT g.*, CASE WHEN nc=0 AND ns=1 AND q1=0 AND q2=0 THEN 'resolved' WHEN q1=1 THEN 'temporal-uncertainty' WHEN q2=1 THEN 'hypothesized' WHEN ns>1 AND o.predicate IS NOT NULL THEN 'conflicting-values'
 WHEN ns>1 THEN 'multiple-states-in-window' WHEN nc>0 THEN 'counterevidence-only' END AS o FROM {tag}g g LEFT JOIN {tag}o o USING ({x}subject_kind,subject_ref,predicate))"""


_KEYS = "SELECT subject_kind, subject_ref, predicate, o AS outcome, CASE WHEN o='resolved' THEN vk END AS object_kind, CASE WHEN o='resolved' THEN vr END AS object_ref, CAST(nv AS BIGINT) AS n_values, CAST(ns AS BIGINT) AS n_supported, CAST(nc AS BIGINT) AS n_counter FROM {t}k"
_W1 = (_window(_EL, _ts(A), _ts(B)), _window(_UN, _ts(A), _ts(B)))


def _keys_out(keys: DataFrame) -> DataFrame:
    return keys.select(*state.KEY, "outcome", *state.VALUE, *(F.col(c).cast("long").alias(c) for c in ("n_values", "n_supported", "n_counter")))


# ---- time axis --------------------------------------------------------------------------------------


@query("SELECT obs_id, subject_kind, subject_ref, predicate, object_ref, temporal_kind, valid_start, valid_end, recorded_at, status FROM fx_obs", "fx_obs")
def scan_observations(p):
    return p["fx_obs"].select("obs_id", "subject_kind", "subject_ref", "predicate", "object_ref", "temporal_kind", "valid_start", "valid_end", "recorded_at", "status")


@query(f"SELECT obs_id, recorded_at FROM fx_obs WHERE recorded_at <= {_ts(K)}", "fx_obs")
def cutoff_filter(p):
    return authority.known_by(p["fx_obs"], K).select("obs_id", "recorded_at")


@query(f"SELECT obs_id, {_W1[0]} AS eligible, {_W1[1]} AS uncertain FROM fx_obs", "fx_obs")
def valid_eligibility_window(p):
    eligible, uncertain = ta.in_window(ntz(A), ntz(B))
    return p["fx_obs"].select("obs_id", eligible.alias("eligible"), uncertain.alias("uncertain"))


@query(f"SELECT obs_id, {_point(_PEL, _ts(P))} AS eligible, {_point(_PUN, _ts(P))} AS uncertain FROM fx_obs", "fx_obs")
def valid_eligibility_point(p):
    eligible, uncertain = ta.at_point(ntz(P))
    return p["fx_obs"].select("obs_id", eligible.alias("eligible"), uncertain.alias("uncertain"))


@query(f"SELECT obs_id, {_point(_BEL, _ts(P))} AS eligible, {_point(_BUN, _ts(P))} AS uncertain FROM fx_obs", "fx_obs")
def before_boundary(p):
    eligible, uncertain = ta.just_before(ntz(P))
    return p["fx_obs"].select("obs_id", eligible.alias("eligible"), uncertain.alias("uncertain"))


@query(
    f"SELECT l.obs_id AS left_id, r.obs_id AS right_id FROM fx_obs l JOIN fx_obs r ON l.subject_ref=r.subject_ref AND l.predicate=r.predicate AND l.obs_id<r.obs_id AND l.temporal_kind IN ('instant','interval') AND r.temporal_kind IN ('instant','interval') AND {_OVER}",
    "fx_obs",
)
def extent_overlap_pairs(p):
    rows = p["fx_obs"].where("temporal_kind IN ('instant','interval')")
    cols = ["obs_id", "subject_ref", "predicate", "temporal_kind", "valid_start", "valid_end"]
    left, right = (rows.select(*(F.col(c).alias(f"{s}_{c}") for c in cols)) for s in "lr")
    on = (F.col("l_subject_ref") == F.col("r_subject_ref")) & (F.col("l_predicate") == F.col("r_predicate")) & (F.col("l_obs_id") < F.col("r_obs_id"))
    return left.join(right, on & ta.overlap("l_", "r_")).select(F.col("l_obs_id").alias("left_id"), F.col("r_obs_id").alias("right_id"))


@query("SELECT obs_id, subject_ref, predicate, object_ref, status FROM fx_obs", "fx_obs")
def observation_dedupe(p):
    rows = p["fx_obs"].select("obs_id", "subject_ref", "predicate", "object_ref", "status")
    again = p["fx_obs"].where("event_id % 3 = 0").select(*rows.columns)
    return state.dedupe_observations(rows.unionByName(again))


# ---- state ------------------------------------------------------------------------------------------


@query(f", {_cands_sql()}, {_state_sql('w', 'cand', *_W1)} SELECT obs_id, cls FROM wc", "fx_evidence")
def classify_candidates(p):
    return state.classify(cands(p), *ta.in_window(ntz(A), ntz(B))).select("obs_id", "cls")


@query(
    f", {_cands_sql()}, {_state_sql('w', 'cand', *_W1)} SELECT subject_kind,subject_ref,predicate,object_kind,object_ref,s,t,cc AS c,tv AS t_time,hv AS t_hypo,CAST(n AS BIGINT) AS n_rows FROM wv",
    "fx_evidence",
)
def value_accumulate(p):
    rows = state.classify(cands(p), *ta.in_window(ntz(A), ntz(B)))
    return state.values(rows, []).select(*state.KEY, *state.VALUE, "s", "t", "c", "t_time", "t_hypo", "n_rows")


@query(f", {_cands_sql()}, {_state_sql('w', 'cand', *_W1)} {_KEYS.replace('{t}', 'w')}", "fx_evidence")
def window_state(p):
    return _keys_out(state.aggregate(cands(p), *ta.in_window(ntz(A), ntz(B)))[2])


@query(
    f", {_cands_sql()}, {_state_sql('w', 'cand', *_W1)} SELECT v.subject_kind,v.subject_ref,v.predicate,k.o AS reason,v.object_kind,v.object_ref,CAST(v.n AS BIGINT) AS n_rows FROM wv v JOIN wk k USING (subject_kind,subject_ref,predicate) WHERE k.o<>'resolved'",
    "fx_evidence",
)
def window_unresolved(p):
    _, of_values, of_keys = state.aggregate(cands(p), *ta.in_window(ntz(A), ntz(B)))
    open_ = of_keys.where("outcome <> 'resolved'").select(*state.KEY, F.col("outcome").alias("reason"))
    return of_values.join(open_, state.KEY).select(*state.KEY, "reason", *state.VALUE, "n_rows")


@query(
    f", {_cands_sql()}, {_state_sql('w', 'cand', *_W1)} SELECT o AS outcome, CAST(count(*) AS BIGINT) AS n FROM wk GROUP BY o", "fx_evidence"
)
def window_outcomes(p):
    return state.aggregate(cands(p), *ta.in_window(ntz(A), ntz(B)))[2].groupBy("outcome").agg(F.count("*").alias("n"))


@query(f", {_cands_sql()}, {_state_sql('p', 'cand', _point(_PEL, _ts(P)), _point(_PUN, _ts(P)))} {_KEYS.replace('{t}', 'p')}", "fx_evidence")
def point_state(p):
    return _keys_out(state.aggregate(cands(p), *ta.at_point(ntz(P)), at_point=True)[2])


@query(f", {_cands_sql(K)}, {_state_sql('p', 'cand', _point(_PEL, _ts(P)), _point(_PUN, _ts(P)))} {_KEYS.replace('{t}', 'p')}", "fx_evidence")
def point_state_asof(p):
    return _keys_out(state.aggregate(cands(p, K), *ta.at_point(ntz(P)), at_point=True)[2])


_TREND = f""", {_cands_sql()}, {_state_sql('a', 'cand', *_W1)}, {_state_sql('b', 'cand', _window(_EL, _ts(B2), _ts(C)), _window(_UN, _ts(B2), _ts(C)))},
j AS (SELECT subject_kind,subject_ref,predicate,a.o AS ao,b.o AS bo,CASE WHEN a.o='resolved' THEN a.vk END AS ak,CASE WHEN a.o='resolved' THEN a.vr END AS ar,CASE WHEN b.o='resolved' THEN b.vk END AS bk,CASE WHEN b.o='resolved' THEN b.vr END AS br FROM ak a FULL JOIN bk b USING (subject_kind,subject_ref,predicate))"""


def _trend(p):
    rows, eligible, uncertain = state.labelled(cands(p), {"before": ta.in_window(ntz(A), ntz(B)), "after": ta.in_window(ntz(B2), ntz(C))})
    return state.compare(state.aggregate(rows, eligible, uncertain, sel=["label"])[2], "before", "after")


@query(
    _TREND + """ SELECT subject_kind,subject_ref,predicate,CASE WHEN ao IS NULL THEN 'added' WHEN bo IS NULL THEN 'removed' ELSE 'changed' END AS change,ar AS before_object_ref,br AS after_object_ref FROM j
WHERE coalesce(ao,'resolved')='resolved' AND coalesce(bo,'resolved')='resolved' AND (ao IS NULL OR bo IS NULL OR ak<>bk OR ar<>br)""",
    "fx_evidence",
)
def trend_changes(p):
    return _trend(p).where("change <> 'unresolved'").select(*state.KEY, "change", "before_object_ref", "after_object_ref")


@query(
    _TREND + " SELECT subject_kind,subject_ref,predicate,ao AS before_outcome,bo AS after_outcome FROM j WHERE coalesce(ao,'resolved')<>'resolved' OR coalesce(bo,'resolved')<>'resolved'",
    "fx_evidence",
)
def trend_unresolved_keys(p):
    return _trend(p).where("change = 'unresolved'").select(*state.KEY, "before_outcome", "after_outcome")


_BOUNDS = f"""bnd AS (SELECT valid_start AS t FROM cand WHERE temporal_kind<>'unknown' AND valid_start>={_ts(A)} AND valid_start<{_ts(D)}
 UNION SELECT valid_end FROM cand WHERE temporal_kind NOT IN ('unknown','instant') AND valid_end>{_ts(A)} AND valid_end<{_ts(D)})"""


@query(f", {_cands_sql()}, {_BOUNDS} SELECT t FROM bnd", "fx_evidence")
def trajectory_boundaries(p):
    return trajectory.boundaries(cands(p), ntz(A), ntz(D))


@query(f", {_cands_sql()}, {_BOUNDS} SELECT t, lead(t) OVER (ORDER BY t) AS next FROM bnd", "fx_evidence")
def trajectory_next_boundary(p):
    return trajectory.following(trajectory.boundaries(cands(p), ntz(A), ntz(D)))


# Every piece of the window between boundaries of all keys, for every key: the plain rule, not the engine's rewrite.
_TRAJECTORY = f""", {_cands_sql()}, {_BOUNDS}, cut AS (SELECT t FROM bnd UNION SELECT {_ts(A)}), pc AS (SELECT t AS lo, lead(t,1,{_ts(D)}) OVER (ORDER BY t) AS hi FROM cut),
cp AS (SELECT c.*, lo, hi FROM cand c JOIN pc ON (c.temporal_kind='unknown') OR (c.temporal_kind='instant' AND c.valid_start>=lo AND c.valid_start<hi) OR (c.temporal_kind IN ('interval','window') AND (c.valid_start IS NULL OR c.valid_start<hi) AND (c.valid_end IS NULL OR c.valid_end>lo))),
{_state_sql('u', 'cp', _window(_EL, 'lo', 'hi'), _window(_UN, 'lo', 'hi'), 'lo')}, {_state_sql('z', 'cand', _point(_BEL, _ts(A)), _point(_BUN, _ts(A)))},
st AS (SELECT subject_kind,subject_ref,predicate,lo,o,vk,vr FROM uk UNION ALL SELECT subject_kind,subject_ref,predicate,NULL,o,vk,vr FROM zk),
ky AS (SELECT DISTINCT subject_kind,subject_ref,predicate FROM cand), cell AS (SELECT ky.*, lo FROM ky, (SELECT lo FROM pc UNION ALL SELECT NULL)),
f AS (SELECT c.subject_kind,c.subject_ref,c.predicate,c.lo,s.o,s.vk,s.vr FROM cell c LEFT JOIN st s ON c.subject_kind=s.subject_kind AND c.subject_ref=s.subject_ref AND c.predicate=s.predicate AND c.lo IS NOT DISTINCT FROM s.lo),
l AS (SELECT *, lag(o) OVER w AS po, lag(vk) OVER w AS pk, lag(vr) OVER w AS pr FROM f WINDOW w AS (PARTITION BY subject_kind,subject_ref,predicate ORDER BY lo NULLS FIRST))
SELECT subject_kind,subject_ref,predicate,lo AS instant,CASE WHEN o='resolved' AND coalesce(po,'')<>'resolved' THEN 'added' WHEN po='resolved' AND coalesce(o,'')<>'resolved' THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN po='resolved' THEN pr END AS before_object_ref, CASE WHEN o='resolved' THEN vr END AS after_object_ref
FROM l WHERE lo IS NOT NULL AND ((o='resolved' AND coalesce(po,'')<>'resolved') OR (po='resolved' AND coalesce(o,'')<>'resolved') OR (o='resolved' AND po='resolved' AND (vk<>pk OR vr<>pr)))"""


@query(_TRAJECTORY, "fx_evidence")
def trajectory_transitions(p):
    out = trajectory.transitions(cands(p), A, D)
    return out.select(*state.KEY, "instant", "change", "before_object_ref", "after_object_ref")


@query(
    f", {_cands_sql()}, {_state_sql('w', 'cand', _window(_EL, _ts(A), _ts(D)), _window(_UN, _ts(A), _ts(D)))} {_KEYS.replace('{t}', 'w')} WHERE o<>'resolved'",
    "fx_evidence",
)
def trajectory_unresolved(p):
    return _keys_out(state.aggregate(cands(p), *ta.in_window(ntz(A), ntz(D)))[2]).where("outcome <> 'resolved'")


def _causal_sql(cutoff: str | None) -> str:
    known = f" AND c.recorded_at <= {_ts(cutoff)}" if cutoff else ""
    return f"""SELECT c.subject_ref AS cause_ref, c.object_ref AS effect_ref, CAST(count(*) AS BIGINT) AS n_observations, min(coalesce(valid_start,valid_end)) AS first_bound, min(recorded_at) AS first_recorded, min(c.obs_id) AS first_obs,
CAST(coalesce(sum(e.ns),0) AS BIGINT) AS n_supporting, CAST(coalesce(sum(e.nc),0) AS BIGINT) AS n_contradicting
FROM fx_causal c LEFT JOIN (SELECT obs_id, count(*) FILTER (WHERE role='supporting') AS ns, count(*) FILTER (WHERE role='contradicting') AS nc FROM fx_evidence GROUP BY obs_id) e ON c.obs_id=e.obs_id
WHERE {_W1[0]}{known} GROUP BY 1, 2"""


def _causal(p, cutoff=None):
    rows = authority.known_by(p["fx_causal"], cutoff)
    return causal.causal_links(rows, p["fx_evidence"], A, B, CAUSES).drop("cause_kind", "effect_kind")


@query(_causal_sql(None), "fx_causal", "fx_evidence")
def causal_links(p):
    return _causal(p)


@query(_causal_sql(K), "fx_causal", "fx_evidence")
def causal_links_asof(p):
    return _causal(p, K)


# ---- authority --------------------------------------------------------------------------------------

_CHAIN = "r(id,root,depth) AS (SELECT id,id,0 FROM fx_decisions WHERE supersedes_id IS NULL UNION ALL SELECT d.id,r.root,r.depth+1 FROM fx_decisions d JOIN r ON d.supersedes_id=r.id)"


def _tail_sql(view: str, cutoff: str | None, where: str = "true") -> str:
    known = f" AND recorded_at <= {_ts(cutoff)}" if cutoff else ""
    return f"(SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY w.root ORDER BY w.depth DESC) AS rn FROM {view} d JOIN {view}_walk w ON d.id=w.id WHERE {where}{known}) WHERE rn=1)"


def _walk(view: str) -> str:
    return f"{view}_walk(id,root,depth) AS (SELECT id,id,0 FROM {view} WHERE supersedes_id IS NULL UNION ALL SELECT d.id,w.root,w.depth+1 FROM {view} d JOIN {view}_walk w ON d.supersedes_id=w.id)"


@query(f", {_CHAIN} SELECT id, root, CAST(depth AS INTEGER) AS depth FROM r", "fx_decisions")
def resolution_chains_recursive(p):
    return authority.chains(p["fx_decisions"]).select("id", "root", "depth")


@query(f", {_walk('fx_decisions')} SELECT id, mention_id, outcome, entity_id FROM {_tail_sql('fx_decisions', None)}", "fx_decisions")
def effective_resolution_current(p):
    return authority.effective(p["fx_decisions"]).select("id", "mention_id", "outcome", "entity_id")


@query(f", {_walk('fx_decisions')} SELECT id, mention_id, outcome, entity_id FROM {_tail_sql('fx_decisions', K)}", "fx_decisions")
def effective_resolution_asof(p):
    return authority.effective(p["fx_decisions"], K).select("id", "mention_id", "outcome", "entity_id")


@query(f", {_walk('fx_admissions')} SELECT target_kind, target_id, outcome FROM {_tail_sql('fx_admissions', K)}", "fx_admissions")
def effective_admission_asof(p):
    return authority.effective(p["fx_admissions"], K).select("target_kind", "target_id", "outcome")


@query(
    """SELECT d.id, CASE WHEN q.id IS NULL THEN 'missing-predecessor' WHEN q.recorded_at > d.recorded_at THEN 'time-runs-back' ELSE 'other-target' END AS fault
FROM (SELECT * REPLACE (CASE WHEN id LIKE '%7:1' THEN recorded_at - INTERVAL '9' DAY ELSE recorded_at END AS recorded_at, CASE WHEN id LIKE '%3:2' THEN concat('none:', id) ELSE supersedes_id END AS supersedes_id) FROM fx_decisions) d
LEFT JOIN (SELECT * REPLACE (CASE WHEN id LIKE '%7:1' THEN recorded_at - INTERVAL '9' DAY ELSE recorded_at END AS recorded_at) FROM fx_decisions) q ON d.supersedes_id=q.id WHERE d.supersedes_id IS NOT NULL AND (q.id IS NULL OR q.recorded_at>d.recorded_at OR q.proposal_id<>d.proposal_id)""",
    "fx_decisions",
)
def chain_integrity_violations(p):
    """Faults planted in copies of the chains, found again."""
    bad = p["fx_decisions"].withColumn("recorded_at", F.when(F.col("id").like("%7:1"), F.expr("recorded_at - INTERVAL '9' DAY")).otherwise(F.col("recorded_at")))
    bad = bad.withColumn("supersedes_id", F.when(F.col("id").like("%3:2"), F.concat(F.lit("none:"), "id")).otherwise(F.col("supersedes_id")))
    return authority.chain_violations(bad, "proposal_id")


def _resolved_sql(cutoff: str | None) -> str:
    known = f" WHERE recorded_at <= {_ts(cutoff)}" if cutoff else ""
    return f"""{_walk('fx_decisions')}, {_walk('fx_admissions')}, adm AS (SELECT target_kind, target_id FROM {_tail_sql('fx_admissions', cutoff)} WHERE outcome='admitted'),
ent AS (SELECT id FROM fx_entities{known}),
rm AS (SELECT mention_id, min(entity_id) AS entity_id FROM {_tail_sql('fx_decisions', cutoff)} d WHERE outcome='accepted' AND entity_id IN (SELECT id FROM ent)
 AND EXISTS (SELECT 1 FROM adm a WHERE a.target_kind='mention' AND a.target_id=d.mention_id) AND EXISTS (SELECT 1 FROM adm a WHERE a.target_kind='identity_decision' AND a.target_id=d.id) GROUP BY mention_id HAVING count(DISTINCT entity_id)=1)"""


@query(f", {_resolved_sql(K)} SELECT mention_id, entity_id FROM rm", "fx_admissions", "fx_entities")
def resolved_mentions(p):
    return authority.resolved_mentions(p["fx_decisions"], p["fx_admissions"], p["fx_entities"], K)


def _qualified(p, view="fx_obs", cutoff=K, match="any", requested=None):
    mentions = authority.resolved_mentions(p["fx_decisions"], p["fx_admissions"], p["fx_entities"], cutoff)
    asked = p["fx_entities"].select(F.col("id").alias("entity_id")) if requested is None else p.spark.createDataFrame([(i,) for i in requested], "entity_id string")
    rows = authority.resolve_terms(authority.known_by(p[view], cutoff), mentions, p["fx_entities"], cutoff, asked)
    oks = authority.admitted(p["fx_admissions"], "observation", cutoff)
    if view == "fx_pairs":
        oks = oks.select(F.regexp_replace("id", "^obs:", "rel:").alias("id"))
    links = p["fx_evidence"] if view != "fx_pairs" else p["fx_evidence"].withColumn("obs_id", F.regexp_replace("obs_id", "^obs:", "rel:"))
    return authority.qualify(rows, oks, authority.evidence_visible(links), len(requested or ()), PREDICATES if view == "fx_obs" else None, match)


_LIST = ", ".join(f"'{x}'" for x in PREDICATES)
_QUALIFIED = f""", {_resolved_sql(K)}, known AS (SELECT * FROM fx_obs WHERE recorded_at <= {_ts(K)}),
t AS (SELECT o.*, CASE WHEN subject_kind='mention' THEN rm.entity_id WHEN e.id IS NOT NULL THEN e.id END AS ent_id, subject_kind='entity' AND e.id IS NULL AS missing, subject_kind='mention' AND rm.mention_id IS NULL AS unres
 FROM known o LEFT JOIN rm ON o.subject_kind='mention' AND o.subject_ref=rm.mention_id LEFT JOIN ent e ON o.subject_kind='entity' AND o.subject_ref=e.id),
q AS (SELECT t.*, CASE WHEN predicate NOT IN ({_LIST}) THEN 'predicate-filtered' WHEN missing THEN 'authority-excluded' WHEN unres THEN 'unresolved-mention' WHEN ent_id NOT IN (SELECT id FROM fx_entities) THEN 'entity-filtered'
 WHEN obs_id NOT IN (SELECT target_id FROM adm WHERE target_kind='observation') OR obs_id NOT IN (SELECT obs_id FROM fx_evidence) THEN 'authority-excluded' ELSE 'retained' END AS class
 FROM t WHERE ent_id IN (SELECT id FROM fx_entities) OR (subject_kind='entity' AND subject_ref IN (SELECT id FROM fx_entities)))"""


@query(_QUALIFIED + " SELECT obs_id, class, ent_id AS subject_entity FROM q", "fx_admissions", "fx_entities", "fx_evidence")
def qualified_observations(p):
    return _qualified(p).select("obs_id", "class", "subject_entity")


@query(
    _QUALIFIED + " SELECT coalesce(ent_id, subject_ref) AS entity_id, predicate, obs_id, class AS reason FROM q WHERE class<>'retained'",
    "fx_admissions", "fx_entities", "fx_evidence",
)
def coverage_classification(p):
    return authority.coverage(_qualified(p)).select("entity_id", "predicate", "obs_id", "reason")


@query(
    f"SELECT r.id AS entity_id, e.id IS NOT NULL AS known FROM (SELECT id FROM fx_entities UNION ALL SELECT 'user:none') r LEFT JOIN (SELECT id FROM fx_entities WHERE recorded_at <= {_ts(A)}) e USING (id)",
    "fx_entities",
)
def entity_authority(p):
    ids = p["fx_entities"].select(F.col("id").alias("entity_id"))
    return authority.entity_authority(ids.unionByName(p.spark.createDataFrame([("user:none",)], "entity_id string")), p["fx_entities"], A)


def _pairs_sql(cond: str) -> str:
    return f""", {_resolved_sql(K)}, known AS (SELECT * FROM fx_pairs WHERE recorded_at <= {_ts(K)}),
t AS (SELECT o.*, CASE WHEN subject_kind='mention' THEN rm.entity_id ELSE e.id END AS se, f.id AS oe, subject_kind='entity' AND e.id IS NULL OR f.id IS NULL AS missing, subject_kind='mention' AND rm.mention_id IS NULL AS unres
 FROM known o LEFT JOIN rm ON o.subject_kind='mention' AND o.subject_ref=rm.mention_id LEFT JOIN ent e ON o.subject_kind='entity' AND o.subject_ref=e.id LEFT JOIN ent f ON o.object_ref=f.id),
rq AS (SELECT unnest(['user:1','user:2']) AS id)
SELECT obs_id, CASE WHEN missing THEN 'authority-excluded' WHEN unres THEN 'unresolved-mention' WHEN NOT ({cond}) THEN 'entity-filtered'
 WHEN replace(obs_id,'rel:','obs:') NOT IN (SELECT target_id FROM adm WHERE target_kind='observation') OR replace(obs_id,'rel:','obs:') NOT IN (SELECT obs_id FROM fx_evidence) THEN 'authority-excluded' ELSE 'retained' END AS class
FROM t WHERE se IN (SELECT id FROM rq) OR oe IN (SELECT id FROM rq) OR object_ref IN (SELECT id FROM rq) OR (subject_kind='entity' AND subject_ref IN (SELECT id FROM rq))"""


def _pair_request(p, match):
    return _qualified(p, "fx_pairs", match=match, requested=["user:1", "user:2"]).select("obs_id", "class")


@query(_pairs_sql("(se='user:1' OR oe='user:1') AND (se='user:2' OR oe='user:2')"), "fx_admissions", "fx_entities", "fx_evidence", "fx_pairs")
def entity_match_all(p):
    return _pair_request(p, "all")


@query(_pairs_sql("coalesce(se IN ('user:1','user:2'),false) OR oe IN ('user:1','user:2')"), "fx_admissions", "fx_entities", "fx_evidence", "fx_pairs")
def entity_match_any(p):
    return _pair_request(p, "any")


@query(
    f""", {_walk('fx_decisions')}, {_walk('fx_admissions')}, acc AS (SELECT * FROM {_tail_sql('fx_decisions', None)} WHERE outcome='accepted' AND entity_id IN (SELECT id FROM fx_entities)),
one AS (SELECT mention_id, min(entity_id) AS entity_id FROM acc GROUP BY mention_id HAVING count(DISTINCT entity_id)=1),
t AS (SELECT o.obs_id, o.predicate, CASE WHEN subject_kind='mention' THEN one.entity_id ELSE e.id END AS subject_entity, f.id AS object_entity FROM fx_pairs o LEFT JOIN one ON o.subject_kind='mention' AND o.subject_ref=one.mention_id LEFT JOIN fx_entities e ON o.subject_kind='entity' AND o.subject_ref=e.id LEFT JOIN fx_entities f ON o.object_ref=f.id)
SELECT obs_id, predicate, subject_entity, object_entity FROM t WHERE subject_entity IN (SELECT entity_id FROM acc) AND object_entity IN (SELECT entity_id FROM acc)
AND replace(obs_id,'rel:','obs:') IN (SELECT target_id FROM {_tail_sql('fx_admissions', None)} WHERE target_kind='observation' AND outcome='admitted') AND replace(obs_id,'rel:','obs:') IN (SELECT obs_id FROM fx_evidence)""",
    "fx_admissions", "fx_entities", "fx_evidence", "fx_pairs",
)
def relationship_pair_observations(p):
    as_rel = lambda df, c: df.withColumn(c, F.regexp_replace(c, "^obs:", "rel:"))
    out = authority.relationship_observations(p["fx_pairs"], p["fx_decisions"], as_rel(p["fx_admissions"], "target_id"), p["fx_entities"], as_rel(p["fx_evidence"], "obs_id"))
    return out.select("obs_id", "predicate", "subject_entity", "object_entity").distinct()

"""Queries of the operators on records: gaps, citations, identity, evidence, extraction, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import evidence as ev
from evidentia.functions import text as tx
from evidentia.functions import timeaxis as ta
from evidentia.operators import authority, citations, extraction, gaps, identity, records, state
from evidentia.queries import _QUALIFIED, _W1, A, B, K, _cands_sql, _qualified, _state_sql, cands, ntz, query
from evidentia.plans.lineage import cut
from evidentia.streaming import leases

_RETAINED = "FROM q WHERE class='retained' AND status<>'rejected'"
_VT = f"vg AS (SELECT DISTINCT ent_id AS entity_id, predicate {_RETAINED} AND NOT ({_W1[0]}) AND NOT ({_W1[1]}))"
_GAP_VIEWS = ("fx_admissions", "fx_entities", "fx_evidence")


def _retained(p):
    q = cut(_qualified(p))
    return q, q.where("class = 'retained'")


@query(_QUALIFIED + f", {_VT} SELECT 'valid-time-excluded' AS kind, entity_id, 'w' AS label, predicate FROM vg", *_GAP_VIEWS)
def gaps_valid_time(p):
    return gaps.valid_time_gaps(_qualified(p).where("class = 'retained'"), ta.outside_window(ntz(A), ntz(B)), "w")


@query(_QUALIFIED + " SELECT DISTINCT class AS kind, coalesce(ent_id, subject_ref) AS entity_id, predicate FROM q WHERE class IN ('authority-excluded','unresolved-mention')", *_GAP_VIEWS)
def gaps_coverage(p):
    return gaps.coverage_gaps(authority.coverage(_qualified(p))).select("kind", "entity_id", "predicate")


@query(
    _QUALIFIED + f", {_VT} SELECT 'no-evidence' AS kind, id AS entity_id FROM (SELECT id FROM fx_entities UNION ALL SELECT 'user:none') WHERE id NOT IN (SELECT entity_id FROM vg) AND id NOT IN (SELECT coalesce(ent_id, subject_ref) FROM q WHERE class IN ('authority-excluded','unresolved-mention')) AND id NOT IN (SELECT ent_id {_RETAINED} AND (({_W1[0]}) OR ({_W1[1]})))",
    *_GAP_VIEWS,
)
def gaps_no_evidence(p):
    q, rows = _retained(p)
    eligible, uncertain = ta.in_window(ntz(A), ntz(B))
    told = gaps.requested_ends(rows.where((F.col("status") != "rejected") & (eligible | uncertain)))
    other = gaps.valid_time_gaps(rows, ta.outside_window(ntz(A), ntz(B)), "w")
    asked = p["fx_entities"].select(F.col("id").alias("entity_id")).unionByName(p.spark.createDataFrame([("user:none",)], "entity_id string"))
    return gaps.no_evidence(asked, told, other, gaps.coverage_gaps(authority.coverage(q))).select("kind", "entity_id")


# every document is a version of its source with one section; each piece of evidence of that number quotes it whole
_CITED = """sp AS (SELECT concat('ev:', CAST(doc_id AS VARCHAR)) AS evidence_id, concat('ver:', CAST(doc_id AS VARCHAR)) AS version_id, octet_length(encode(text)) AS n, text, source, TIMESTAMP '2024-01-05 00:00:00' + to_hours(CAST(doc_id % 400 AS INTEGER)) AS at FROM documents),
src AS (SELECT source, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(min(doc_id) % 20 AS INTEGER)) AS at FROM documents GROUP BY source)"""


def _cited_tables(p):
    docs = p["documents"]
    at = lambda base, unit, n: F.timestamp_add(unit, n.cast("int"), F.lit(base).cast("timestamp_ntz"))
    ver, hour = F.concat(F.lit("ver:"), "doc_id").alias("version_id"), at("2024-01-05", "HOUR", F.col("doc_id") % 400)
    size = F.octet_length(F.col("text").cast("binary")).cast("long")
    spans = docs.select(F.concat(F.lit("ev:"), "doc_id").alias("evidence_id"), ver, F.lit("body").alias("section_id"), F.lit(0).cast("long").alias("start_byte"), size.alias("end_byte"), F.col("text").alias("quote"), hour.alias("recorded_at"))
    versions = docs.select(ver, F.col("source").alias("source_id"), F.concat(F.lit("at/"), "doc_id").alias("locator"), hour.alias("recorded_at"))
    sections = docs.select(ver, F.lit("body").alias("section_id"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("parent_id"), F.array("lang").alias("path"), F.lit(0).cast("long").alias("section_order"), F.lit("notes").alias("role"), F.col("text").alias("content"))
    sources = docs.groupBy(F.col("source").alias("source_id")).agg(at("2024-01-01", "DAY", F.min("doc_id") % 20).alias("recorded_at"))
    return spans, versions, sections, sources


def _cited_sql(cutoff):
    known = f"AND sp.at <= TIMESTAMP '{cutoff}' AND src.at <= TIMESTAMP '{cutoff}'" if cutoff else ""
    return f", {_CITED} SELECT e.obs_id, e.evidence_id, e.role, sp.version_id, sp.source AS source_id, CAST(0 AS BIGINT) AS start_byte, CAST(n AS BIGINT) AS end_byte, 'at/' || substr(sp.version_id, 5) AS locator, md5(text) AS quote_md5 FROM fx_evidence e JOIN sp USING (evidence_id) JOIN src ON src.source=sp.source WHERE true {known}"


def _citations(p, cutoff=None):
    spans, versions, sections, sources = _cited_tables(p)
    rows = citations.citations(p["fx_evidence"], spans, versions, sections, sources, cutoff)
    return rows.select("obs_id", "evidence_id", "role", "version_id", "source_id", "start_byte", "end_byte", "locator", F.md5("quote").alias("quote_md5"))


@query(_cited_sql(None), "fx_evidence")
def citations_join(p):
    return _citations(p)


@query(_cited_sql(K), "fx_evidence")
def citations_asof(p):
    return _citations(p, K)


@query(
    f", {_CITED}, ok AS (SELECT evidence_id FROM sp JOIN src ON src.source=sp.source WHERE sp.at <= TIMESTAMP '{K}' AND src.at <= TIMESTAMP '{K}') SELECT obs_id FROM fx_evidence GROUP BY obs_id HAVING bool_and(evidence_id IN (SELECT evidence_id FROM ok))",
    "fx_evidence",
)
def evidence_cutoff(p):
    """Observations none of whose evidence, versions or sources came later than the cutoff."""
    spans, versions, _, sources = _cited_tables(p)
    return authority.evidence_visible(p["fx_evidence"], spans, versions, sources, K)


@query("SELECT 'ev:' || doc_id AS evidence_id, CASE WHEN doc_id % 5 = 1 THEN 'no-section' WHEN doc_id % 5 = 2 THEN 'out-of-range' ELSE 'quote-differs' END AS fault FROM documents WHERE doc_id % 5 IN (1, 2, 3) AND text IS NOT NULL AND octet_length(encode(text)) > 0")
def span_faults(p):
    """Spans that quote a whole document, three in five of them planted wrong."""
    spans, _, sections, _ = _cited_tables(p)
    n = F.substring("evidence_id", 4, 20).cast("long") % 5
    bad = spans.where("end_byte > 0").withColumns({
        "section_id": F.when(n == 1, "none").otherwise(F.col("section_id")), "end_byte": F.when(n == 2, F.col("end_byte") + 1).otherwise(F.col("end_byte")), "quote": F.when(n == 3, F.concat("quote", F.lit("?"))).otherwise(F.col("quote")),
    })
    return citations.span_faults(bad, sections)


@query(
    f", {_cands_sql()}, {_state_sql('w', 'cand', *_W1)} SELECT c.subject_ref, c.predicate, c.object_ref, k.o AS outcome, c.cls, c.obs_id, e.evidence_id, e.role FROM wc c JOIN wk k USING (subject_kind,subject_ref,predicate) LEFT JOIN fx_evidence e ON e.obs_id=c.obs_id WHERE k.o<>'resolved' OR c.cls='s'",
    "fx_evidence",
)
def fact_provenance(p):
    rows, _, keys = state.aggregate(cands(p), *ta.in_window(ntz(A), ntz(B)))
    return state.provenance(rows, keys, p["fx_evidence"]).select("subject_ref", "predicate", "object_ref", "outcome", "cls", "obs_id", "evidence_id", "role")


# ---- identity and review ----------------------------------------------------------------------------


def _proposals(p):
    return p["events"].select(
        F.concat(F.lit("prop:"), "event_id").alias("proposal_id"), F.concat(F.lit("men:"), "event_id").alias("mention_id"), F.col("user_id"),
        F.concat(F.lit("run:"), "user_id").alias("run_id"), F.concat(F.lit("ver:"), "user_id").alias("version_id"),
    )


_PROPOSALS = "pr AS (SELECT concat('prop:', event_id) AS proposal_id, concat('men:', event_id) AS mention_id, user_id, ts FROM events)"


@query(f", {_PROPOSALS} SELECT proposal_id, mention_id FROM pr WHERE proposal_id NOT IN (SELECT proposal_id FROM fx_decisions)", "fx_decisions")
def pending_proposals(p):
    return records.pending_proposals(_proposals(p), p["fx_decisions"]).select("proposal_id", "mention_id")


@query(
    f", {_PROPOSALS} SELECT proposal_id FROM pr WHERE user_id % 3 <> 0 AND user_id % 5 <> 0 AND user_id % 7 <> 0 AND mention_id IN (SELECT target_id FROM fx_admissions WHERE target_kind='mention')",
    "fx_admissions",
)
def eligible_proposals(p):
    rows = _proposals(p)
    users = p["events"].select("user_id").distinct()
    runs = users.where("user_id % 3 <> 0").select(F.concat(F.lit("run:"), "user_id").alias("run_id"))
    versions = users.where("user_id % 5 <> 0").select(F.concat(F.lit("ver:"), "user_id").alias("version_id"))
    own = records.initial_admissions(users.where("user_id % 7 <> 0").select(F.concat(F.lit("run:"), "user_id").alias("id")), "extraction_run", "policy", ntz(A)).drop("authority")
    adm = p["fx_admissions"].unionByName(own.withColumn("supersedes_id", F.lit(None).cast("string")))
    return records.eligible_proposals(rows, rows.select("mention_id"), adm, runs, versions).select("proposal_id")


@query(
    "SELECT DISTINCT entity_id, 'name' AS kind, lower(replace(entity_id, ':', ' ')) AS value FROM fx_decisions d WHERE outcome='accepted' AND NOT EXISTS (SELECT 1 FROM fx_decisions s WHERE s.supersedes_id=d.id)",
    "fx_decisions",
)
def entity_aliases_effective(p):
    d = p["fx_decisions"].where("outcome = 'accepted'")
    aliases = d.select(F.col("id").alias("decision_id"), F.lit("name").alias("kind"), tx.plain_name(F.translate("entity_id", ":", " ")).alias("value"))
    return records.effective_aliases(aliases, p["fx_decisions"])


_NAMES = """m AS (SELECT DISTINCT concat('m:', p_name, ' ', split_part(p_name, ' ', 2)) AS mention_id, concat(p_name, ' ', split_part(p_name, ' ', 2)) AS name FROM part),
n AS (SELECT concat('part:', p_partkey) AS entity_id, p_name AS name, false AS is_alias FROM part UNION ALL SELECT concat('part:', p_partkey), concat(lower(p_type), ' ', split_part(p_name, ' ', 2)), true FROM part),
dn AS (SELECT name, string_split(name, ' ') AS k FROM (SELECT DISTINCT name FROM n)),
sc AS (SELECT m.mention_id, d.name, CASE WHEN m.name=d.name THEN 1.0 ELSE CAST(len(list_filter(string_split(m.name,' '), lambda x: list_contains(d.k, x))) AS DOUBLE) / greatest(len(string_split(m.name,' ')), len(d.k)) END AS c FROM m, dn d),
b AS (SELECT mention_id, entity_id, max(c) AS confidence, max(CASE WHEN NOT is_alias THEN c END) AS dc FROM sc JOIN n USING (name) WHERE c > 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY confidence DESC, entity_id) AS rank FROM b)"""


@query(f"WITH {_NAMES} SELECT mention_id, CAST(rank AS INTEGER) AS rank, entity_id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN dc = confidence THEN 'display' ELSE 'alias' END AS via FROM r")
def name_candidate_ranking(p):
    part = p["part"]
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    said = F.concat_ws(" ", "p_name", second)
    mentions = part.select(F.concat(F.lit("m:"), said).alias("mention_id"), said.alias("name")).distinct()
    eid = F.concat(F.lit("part:"), "p_partkey").alias("entity_id")
    names = part.select(eid, F.col("p_name").alias("name"), F.lit(False).alias("is_alias")).unionByName(part.select(eid, F.concat_ws(" ", F.lower("p_type"), second).alias("name"), F.lit(True).alias("is_alias")))
    return identity.rank_names(mentions, names)


_MAIL = "m AS (SELECT concat('s', s_suppkey) AS mention_id, concat('a', CAST(round(s_acctbal) AS BIGINT) % 400, '@example.org') AS email FROM supplier), o AS (SELECT concat('c', c_custkey) AS entity_id, concat('a', CAST(round(c_acctbal) AS BIGINT) % 400, '@example.org') AS email FROM customer)"


def _mails(p):
    mail = lambda c: F.concat(F.lit("a"), (F.round(c).cast("long") % 400).cast("string"), F.lit("@example.org")).alias("email")
    return p["supplier"].select(F.concat(F.lit("s"), "s_suppkey").alias("mention_id"), mail("s_acctbal")), p["customer"].select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), mail("c_acctbal"))


@query(f"WITH {_MAIL} SELECT mention_id, CAST(n AS BIGINT) AS n_owners, CASE WHEN n=1 THEN e END AS entity_id FROM m JOIN (SELECT email, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM o GROUP BY email) USING (email)")
def email_exact_match(p):
    return identity.email_matches(*_mails(p))


@query(
    f"""WITH {_MAIL}, pf AS (SELECT email, concat('sub', min(substr(entity_id,2)::BIGINT) % 50) AS subject_id, count(DISTINCT entity_id) % 3 AS k FROM o GROUP BY email),
p2 AS (SELECT email, subject_id FROM pf WHERE k>=1 UNION ALL SELECT email, concat(subject_id,'x') FROM pf WHERE k=2), np AS (SELECT email, count(DISTINCT subject_id) n, min(subject_id) s FROM p2 GROUP BY email),
ow AS (SELECT email, count(DISTINCT entity_id) n, min(entity_id) e FROM o WHERE substr(entity_id,2)::BIGINT % 2 = 0 GROUP BY email),
l AS (SELECT subject_id, count(DISTINCT entity_id) n, min(entity_id) e FROM (SELECT concat('sub', substr(entity_id,2)::BIGINT % 50) AS subject_id, entity_id FROM o WHERE substr(entity_id,2)::BIGINT < 20) GROUP BY 1),
j AS (SELECT mention_id, email, coalesce(np.n,0) AS n, coalesce(ow.n,0) AS wn, ow.e AS we, coalesce(l.n,0) AS ln, l.e AS le, substr(mention_id,2)::BIGINT % 4 <> 0 AS automatic FROM m LEFT JOIN np USING (email) LEFT JOIN ow USING (email) LEFT JOIN l ON l.subject_id=np.s),
v AS (SELECT mention_id AS lookup_id, we, CASE WHEN n=0 THEN 'no_match' WHEN n>1 THEN 'ambiguous' WHEN NOT automatic THEN 'review' WHEN wn>1 OR ln>1 OR (ln=1 AND wn=1 AND le<>we) THEN 'review' WHEN ln=1 AND wn=0 THEN 'review' WHEN wn=1 THEN 'matched' ELSE 'matched-new' END AS verdict FROM j)
SELECT lookup_id, verdict, CASE WHEN verdict='matched' THEN we END AS entity_id FROM v"""
)
def directory_email_policy(p):
    m, o = _mails(p)
    number = F.substring("entity_id", 2, 20).cast("long")
    pf = o.groupBy("email").agg(F.concat(F.lit("sub"), (F.min(number) % 50).cast("string")).alias("subject_id"), (F.count_distinct("entity_id") % 3).alias("k"))
    profiles = pf.where("k >= 1").select("email", "subject_id").unionByName(pf.where("k = 2").select("email", F.concat("subject_id", F.lit("x")).alias("subject_id")))
    links = o.where(number < 20).select(F.concat(F.lit("sub"), (number % 50).cast("string")).alias("subject_id"), "entity_id")
    lookups = m.select(F.col("mention_id").alias("lookup_id"), "email", (F.substring("mention_id", 2, 20).cast("long") % 4 != 0).alias("automatic"))
    return identity.directory_verdict(lookups, profiles, o.where(number % 2 == 0), links, ["example.org"])


@query(
    """WITH m AS (SELECT c_custkey AS mention_id FROM customer WHERE c_custkey % 6 <> 0), f AS (SELECT o_custkey AS mention_id, max(CASE WHEN o_orderstatus='F' THEN o_orderdate END) AS last, max(CASE WHEN o_orderdate + INTERVAL '30' DAY > TIMESTAMP '1998-06-01 00:00:00' THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1)
SELECT mention_id, coalesce(last + INTERVAL '90' DAY > TIMESTAMP '1998-06-01 00:00:00', false) AS reusable, coalesce(b, 0) = 1 AS blocked FROM m LEFT JOIN f USING (mention_id)"""
)
def lookup_reuse_flags(p):
    mentions = p["customer"].select(F.col("c_custkey").alias("mention_id"))
    tries = p["orders"].select(F.col("o_custkey").alias("mention_id"), F.col("o_orderdate").alias("attempted_at"), (F.col("o_orderstatus") == "F").alias("conclusive"), F.expr("o_orderdate + INTERVAL '30' DAY").alias("retry_after"))
    return identity.lookup_work(mentions, mentions.where("mention_id % 6 = 0"), tries, ntz("1998-06-01 00:00:00"), "'90' DAY")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(substr(c_mktsegment,1,1), '***@', lower(c_mktsegment), '.example') END AS masked FROM customer")
def masked_email(p):
    mail = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("@"), "c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")))
    return p["customer"].select("c_custkey", ev.masked_email(mail).alias("masked"))


@query(
    "WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY k, o_orderpriority) - 1 AS INTEGER) AS place FROM f"
)
def first_seen_order(p):
    return records.first_seen(p["orders"], "o_custkey", "o_orderpriority", "o_orderkey")


# ---- evidence ---------------------------------------------------------------------------------------

_HEX = "hex(encode(text))"


@query(
    f"""SELECT doc_id, CAST(s AS BIGINT) AS start_byte, substr({_HEX}, 2*s+1, 40) AS slice_hex, s >= octet_length(encode(text)) OR substr({_HEX}, 2*s+1, 1) NOT IN ('8','9','A','B') AS start_ok,
CASE WHEN text IS NULL THEN NULL WHEN s+20 > octet_length(encode(text)) THEN 'out-of-range' WHEN substr({_HEX}, 2*s+1, 1) IN ('8','9','A','B') OR (s+20 < octet_length(encode(text)) AND substr({_HEX}, 2*(s+20)+1, 1) IN ('8','9','A','B')) THEN 'inside-character' ELSE 'quote-differs' END AS fault
FROM (SELECT doc_id, text, 5 + doc_id % 7 AS s FROM documents)"""
)
def evidence_span_bytes(p):
    s = (5 + F.col("doc_id") % 7).cast("long")
    text = F.col("text")
    return p["documents"].select(
        "doc_id", s.alias("start_byte"), F.hex(ev.byte_slice(text, s, s + 20)).alias("slice_hex"), ev.on_boundary(text, s).alias("start_ok"),
        ev.span_fault(text, s, s + 20, F.lit("not the quote")).alias("fault"),
    )


def _framed(expr: str) -> str:
    return f"('01' || lpad(upper(to_hex(octet_length(encode({expr})))), 16, '0') || hex(encode({expr})))"


@query(f"SELECT doc_id, sha256(unhex({_framed('text')} || {_framed('lang')})) AS digest FROM documents")
def framed_sha256(p):
    return p["documents"].select("doc_id", ev.digest(ev.frame("text"), ev.frame("lang")).alias("digest"))


@query(f"SELECT doc_id, sha256(unhex({_framed('source')} || {_framed('CAST(doc_id AS VARCHAR)')} || {_framed(chr(39) + '0:8' + chr(39))})) AS span_id FROM documents")
def span_id_digest(p):
    return p["documents"].select("doc_id", ev.opaque_id(F.col("source"), F.col("doc_id").cast("string"), F.lit("0:8")).alias("span_id"))


_WRITE = f"e AS (SELECT source AS g, sha256(unhex({_framed(chr(39) + 'documents' + chr(39))} || {_framed('CAST(doc_id AS VARCHAR)')} || {_framed('lang')})) AS h FROM documents)"


@query(
    f"WITH {_WRITE}, b AS (SELECT g, substr(h,1,2) AS k, sha256(string_agg(h, '' ORDER BY h)) AS p FROM e GROUP BY 1, 2) SELECT g AS \"group\", sha256(string_agg(p, '' ORDER BY k)) AS digest FROM b GROUP BY 1"
)
def write_set_digest(p):
    return ev.set_digest(records.write_set(("documents", p["documents"], ["source", "doc_id", "lang"])), ["group"], F.col("entry"))


@query(
    """WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, role FROM conversations),
w AS (SELECT conv_id, turn, role AS path, [turn] AS o, 0 AS d FROM n WHERE parent IS NULL UNION ALL SELECT n.conv_id, n.turn, w.path || '/' || n.role, list_append(w.o, n.turn), w.d + 1 FROM n JOIN w ON n.conv_id=w.conv_id AND n.parent=w.turn)
SELECT conv_id AS doc_id, turn AS id, path, CAST(d AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS INTEGER) AS section_order FROM w"""
)
def section_flatten(p):
    parent = F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2"))
    nodes = p["conversations"].select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), parent.alias("parent_id"), F.col("turn").alias("position"), F.col("role").alias("title"))
    return records.flatten_tree(nodes).select("doc_id", "id", F.array_join("path", "/").alias("path"), "depth", "section_order")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 3) THEN CAST(o_orderdate AS DATE) END AS day FROM orders"
)
def meeting_date_from_title(p):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    title = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("["), day, F.lit("] Review"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Review ["), day, F.lit("]")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("["), day, F.lit("] and [2024-01-01] Review"))).otherwise(F.concat(F.lit("["), day, F.lit("] Review [2024-13-01]")))
    )
    return p["orders"].select("o_orderkey", ev.meeting_date(title).alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'future_responsibility' END AS category, CASE WHEN c_custkey % 3 = 0 THEN 'mixed' END AS direction FROM customer")
def predicate_codec(p):
    made = F.when(F.col("c_custkey") % 3 == 0, ev.interaction_predicate(F.lit("future_responsibility"), F.lit("mixed"))).when(F.col("c_custkey") % 3 == 1, F.lit("evidentia.interaction/other/mixed")).otherwise(F.lit("evidentia.interaction/future_responsibility/mixed/"))
    category, direction = ev.parse_interaction(F.col("predicate"))
    return p["customer"].select("c_custkey", made.alias("predicate")).select("c_custkey", category.alias("category"), direction.alias("direction"))


@query("SELECT event_id, rtrim(rtrim(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z' AS written FROM events")
def rfc3339_times(p):
    return p["events"].select("event_id", ta.rfc3339("ts").alias("written"))


# ---- ingest -----------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def attempt_latest(p):
    return authority.latest(p["orders"], ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderstatus AS outcome, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) = 0 THEN '0' WHEN count(*) = 1 THEN '1' WHEN count(*) <= 5 THEN '2-5' ELSE '6-plus' END AS bucket FROM orders GROUP BY 1")
def run_outcome_summary(p):
    out = p["orders"].groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    return out.withColumn("bucket", gaps.count_bucket(F.col("n")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'append' WHEN o_orderkey % 10 = 0 THEN 'conflict' ELSE 'replay' END AS verdict FROM orders")
def idempotent_append(p):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
    new = p["orders"].select(*cols)
    changed = new.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "?").otherwise(F.col("o_orderstatus")))
    return records.append_once(new.where("o_orderkey % 2 = 0"), changed, "o_orderkey").select("o_orderkey", "verdict")


#: A batch for each stored root: the suffix of the new id, what it supersedes, and its verdict if the root stands and if it
#: was superseded; ids of `new:` make a chain of their own.
_BATCH = [
    (":0", None, "replay", "replay"), (":r", None, "decided", "decided"), (":8", ":0", "append", "stale"), (":8", ":0", "replay", "stale"), (":9", ":0", "stale", "stale"), (":a", ":8", "append", "stale"),
    (":b", ":9", "stale", "stale"), (":c", ":a", "append", "stale"), ("new:0", None, "append", "append"), ("new:1", None, "decided", "decided"), ("new:2", "new:0", "append", "append"), ("new:3", "new:1", "stale", "stale"),
]


def batch_of(roots, same: str):
    """_BATCH for each root."""
    bare = F.regexp_replace("id", ":0$", "")
    name = lambda x: F.lit(None).cast("string") if x is None else F.concat(bare, F.lit(x))
    out = None
    for suffix, up, *_ in _BATCH:
        target = F.concat(F.lit("new:"), same) if suffix.startswith("new") else F.col(same)
        one = roots.withColumns({"_id": name(suffix), "_up": name(up), "_same": target}).withColumns({"id": F.col("_id"), "supersedes_id": F.col("_up"), same: F.col("_same")}).drop("_id", "_up", "_same")
        out = one if out is None else out.unionByName(one)
    return out


def batch_sql(table: str, same: str, where: str) -> str:
    rows = ", ".join(f"('{s}', '{a}', '{b}')" for s, _, a, b in _BATCH)
    later = f"EXISTS (SELECT 1 FROM {table} s WHERE s.{same} = x.{same} AND s.supersedes_id IS NOT NULL)"
    return f"SELECT regexp_replace(x.id, ':0$', '') || b.suffix AS id, CASE WHEN {later} THEN b.later ELSE b.stands END AS verdict FROM {table} x CROSS JOIN (VALUES {rows}) b(suffix, stands, later) WHERE x.id LIKE '%:0'{where}"


@query(batch_sql("fx_decisions", "proposal_id", ""), "fx_decisions")
def decision_append_rules(p):
    """Decisions judged against the stored ones and each other: rivals, chains of a batch, repeats, new targets."""
    return authority.appendable(p["fx_decisions"], batch_of(p["fx_decisions"].where("id LIKE '%:0'"), "proposal_id"), "proposal_id").select("id", "verdict")


@query(
    """SELECT 'mentions' AS "table", CAST(o_orderkey AS VARCHAR) AS id, 'no evidence' AS fault FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)
UNION ALL SELECT 'proposals', CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR), 'no mentions' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"""
)
def write_set_references(p):
    evidence = p["customer"].where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("id"))
    mentions = p["orders"].select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("evidence_id"))
    proposals = p["lineitem"].select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("mention_id"))
    none = mentions.where("false")
    found = records.write_set_faults({"evidence": evidence, "mentions": mentions, "observations": none, "proposals": proposals})
    return found.where("fault <> 'twice'")


@query("SELECT 'checksum_mismatch' AS status UNION ALL SELECT 'pending' UNION ALL SELECT 'schema_drift' UNION ALL SELECT 'current' UNION ALL SELECT 'absent'")
def ledger_status(p):
    want = p["region"].select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("name"), F.sha2("r_name", 256).alias("checksum"))
    bad = want.withColumn("checksum", F.when(F.col("position") == 1, "x").otherwise(F.col("checksum")))
    cases = [(bad, True), (want.where("position < 3"), True), (want, False), (want, True), (want.where("false"), True)]
    out = [records.ledger_status(want, have, ok) for have, ok in cases]
    for other in out[1:]:
        out[0] = out[0].unionByName(other)
    return out[0]


_LEASE = 120 * 86_400 * 1_000_000


@query(
    f"""WITH RECURSIVE c AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, epoch_us(o_orderdate) AS moment, o_orderkey AS command_id, CASE WHEN o_orderkey % 3 = 0 THEN 'complete' WHEN o_orderkey % 7 = 1 THEN 'fail' ELSE 'claim' END AS action,
 CAST(o_orderkey % 2 AS VARCHAR) AS who, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
j AS (SELECT *, 0 AS k FROM (SELECT DISTINCT run_id FROM c) CROSS JOIN (SELECT 'new' AS state, 0 AS attempt, '' AS holder, CAST(0 AS BIGINT) AS claimed, CAST(0 AS BIGINT) AS until, CAST(0 AS BIGINT) AS command_id, '' AS outcome)
 UNION ALL SELECT run_id, CASE WHEN outcome IN ('claimed','reclaimed') THEN 'active' WHEN outcome = 'completed' AND action = 'complete' THEN 'completed' WHEN outcome = 'failed' THEN 'failed' ELSE state END,
  CASE WHEN outcome IN ('claimed','reclaimed') THEN attempt + 1 ELSE attempt END, CASE WHEN outcome IN ('claimed','reclaimed') THEN who ELSE holder END, CASE WHEN outcome IN ('claimed','reclaimed') THEN moment ELSE claimed END,
  CASE WHEN outcome IN ('claimed','reclaimed') THEN moment + {_LEASE} ELSE until END, command_id, outcome, n
 FROM (SELECT c.run_id, c.moment, c.command_id, c.action, c.who, c.n, j.state, j.attempt, j.holder, j.claimed, j.until,
  CASE WHEN action = 'claim' THEN CASE WHEN state = 'completed' THEN 'completed' WHEN state = 'active' AND moment < until THEN 'busy' WHEN state = 'active' THEN 'reclaimed' ELSE 'claimed' END
   WHEN state = 'completed' AND action = 'complete' AND who = holder THEN 'replay' WHEN state <> 'active' OR holder <> who OR NOT (claimed <= moment AND moment < until) THEN 'refused' WHEN action = 'complete' THEN 'completed' ELSE 'failed' END AS outcome
  FROM c JOIN j ON c.run_id = j.run_id AND c.n = j.k + 1))
SELECT run_id, command_id, outcome, CAST(attempt AS INTEGER) AS attempt FROM j WHERE k > 0"""
)
def lease_states(p):
    o = p["orders"]
    action = F.when(F.col("o_orderkey") % 3 == 0, "complete").when(F.col("o_orderkey") % 7 == 1, "fail").otherwise("claim")
    commands = o.select(F.col("o_custkey").cast("string").alias("run_id"), ta.micros("o_orderdate").alias("at"), F.col("o_orderkey").alias("command_id"), action.alias("action"), (F.col("o_orderkey") % 2).cast("string").alias("owner"))
    return leases.fold(commands, _LEASE)


@query("SELECT c_custkey, 'fi 1 ' || lower(c_name) AS name, true AS mail_ok FROM customer")
def nfkc_name_normalize(p):
    return p["customer"].select("c_custkey", tx.normalize_name(F.concat(F.lit("ﬁ ①  "), "c_name")).alias("name"), tx.valid_email(F.concat("c_mktsegment", F.lit("@x.org"))).alias("mail_ok"))


_SHA = "sha1(unhex('6BA7B8129DAD11D180B400C04FD430C8') || encode(c_name))"


@query(
    f"""SELECT c_custkey, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', 1 + CAST(('0x' || substr(h,17,1)) AS INTEGER) % 4, 1) || substr(h,18,3) || '-' || substr(h,21,12) AS id
FROM (SELECT c_custkey, {_SHA} AS h FROM customer)"""
)
def uuid5_ids(p):
    return p["customer"].select("c_custkey", ev.stable_uuid(F.col("c_name")).alias("id"))


_BITS = "lpad(upper(to_hex(CAST(CAST(value AS BIT) AS UBIGINT))), 16, '0')"


@query(
    f"SELECT event_id, sha256(unhex({_framed('event_type')} || '050000000000000008' || lpad(upper(to_hex(epoch_us(ts))), 16, '0') || '020000000000000008' || {_BITS})) AS digest FROM events"
)
def observation_digest_float(p):
    return p["events"].select("event_id", ev.digest(ev.frame("event_type"), ev.frame(ta.micros("ts"), ev.TIME), ev.frame(ev.float_bits(F.col("value")), ev.BYTES)).alias("digest"))


_CASES = ("accepted", "not JSON", "unknown speaker", "signal vocabulary", "quote not found once", "name not grounded", "signal ends", "citation quote")


@query(
    f"SELECT doc_id, doc_id % 8 = 0 AS accepted, [{', '.join(repr(c) if c != 'accepted' else 'NULL' for c in _CASES)}][1 + doc_id % 8] AS fault FROM documents"
)
def extraction_validate(p):
    """Answers that quote the whole section, with people, statements and signals; seven in eight break one rule each."""
    k = F.col("doc_id") % 8
    section = F.concat(F.lit("Ana Diaz wrote to Bo Li: "), F.coalesce("text", F.lit("")))
    when = lambda n, a, b: F.when(k == n, F.lit(a)).otherwise(F.lit(b))
    cite = F.struct(F.lit("c1").alias("id"), F.lit("body").alias("section_id"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.when(k == 4, F.concat(section, F.lit("?"))).when(k == 7, F.lit(None)).otherwise(section).alias("quote"))
    ids = F.array(F.lit("c1")).alias("citation_ids")
    person = lambda i, name: F.struct(F.lit(i).alias("id"), name.alias("name"), F.lit(None).cast("string").alias("email"), ids)
    people = F.array(person("p1", when(5, "Ana Dia", "Ana Diaz")), person("p2", F.lit("Bo Li")))
    statements = F.array(F.struct(F.lit("s1").alias("id"), when(2, "p9", "p1").alias("speaker_id"), F.col("text"), ids))
    statements = F.transform(statements, lambda s: F.struct(s["id"].alias("id"), s["speaker_id"].alias("speaker_id"), F.coalesce(s["text"], F.lit("")).alias("text"), s["citation_ids"].alias("citation_ids")))
    signals = F.array(F.struct(F.lit("g1").alias("id"), F.lit("p1").alias("subject_id"), when(6, "p1", "p2").alias("object_id"), F.lit("support_advocacy").alias("category"), when(3, "up", "mixed").alias("direction"), ids))
    payload = F.to_json(F.struct(F.lit("2024-01-01").alias("meeting_date"), F.array(cite).alias("citations"), people.alias("people"), statements.alias("statements"), signals.alias("signals")), {"ignoreNullFields": "false"})
    rows = p["documents"].select("doc_id", section.alias("section"), F.when(k == 1, F.concat(payload, F.lit("x"))).otherwise(payload).alias("payload"))
    return extraction.verdicts(rows, "doc_id", "payload", "section").select(F.col("id").alias("doc_id"), "accepted", "fault")


# ---- review -----------------------------------------------------------------------------------------


@query(
    f"""WITH {_MAIL}, ow AS (SELECT email, count(DISTINCT entity_id) AS ne, min(entity_id) AS eo FROM o GROUP BY email),
j AS (SELECT mention_id, coalesce(ne,0) AS ne, eo, s % 3 AS np, CASE WHEN s % 3 = 1 THEN CASE WHEN s % 2 = 0 THEN eo ELSE 'c0' END WHEN s % 3 = 2 THEN 'c0' END AS po, CASE WHEN s % 5 = 0 THEN 'c1' END AS ev, s % 2 = 0 AS mk FROM (SELECT *, CAST(substr(mention_id,2) AS BIGINT) AS s FROM m) m LEFT JOIN ow USING (email)),
k AS (SELECT *, CASE WHEN ne>1 OR np>1 THEN 'conflict' WHEN np=1 THEN CASE WHEN ne=1 AND eo=po THEN 'reuse' ELSE 'conflict' END WHEN ne=1 THEN CASE WHEN ev IS NULL OR ev=eo THEN 'reuse' ELSE 'conflict' END WHEN mk THEN 'create' ELSE 'conflict' END AS choice FROM j)
SELECT mention_id, choice, CASE WHEN choice='reuse' THEN coalesce(po, eo) END AS entity_id FROM k"""
)
def owner_reconciliation(p):
    from evidentia.operators.review import owner_choice

    m, o = _mails(p)
    owners = o.groupBy("email").agg(F.count_distinct("entity_id").alias("ne"), F.min("entity_id").alias("eo"))
    s = F.substring("mention_id", 2, 20).cast("long")
    rows = m.join(owners, "email", "left").withColumn("ne", F.coalesce("ne", F.lit(0))).withColumn("np", s % 3)
    po = F.when(s % 3 == 1, F.when(s % 2 == 0, F.col("eo")).otherwise("c0")).when(s % 3 == 2, "c0")
    choice, entity = owner_choice(F.col("ne"), F.col("eo"), F.col("np"), po, F.when(s % 5 == 0, "c1"), s % 2 == 0)
    return rows.select("mention_id", choice.alias("choice"), entity.alias("entity_id"))


@query(
    """SELECT 'cmd:' || event_id AS command_id, CASE WHEN event_id % 2 = 0 THEN 'unknown-proposal' WHEN event_id % 9 = 5 AND event_id % 10 <> 1 THEN 'unknown-entity'
WHEN event_id % 10 <> 1 AND EXISTS (SELECT 1 FROM fx_decisions d WHERE d.proposal_id = 'prop:' || e.event_id) THEN CASE WHEN event_id % 10 = 7 THEN 'ok' ELSE 'decided' END
WHEN event_id % 10 = 1 AND EXISTS (SELECT 1 FROM fx_decisions d WHERE d.proposal_id = 'prop:' || e.event_id) THEN 'decided' WHEN event_id % 10 = 7 THEN 'undecided' ELSE 'ok' END AS verdict FROM events e""",
    "fx_decisions",
)
def review_commands(p):
    from evidentia.operators.review import decide

    e = F.col("event_id")
    action = F.when(e % 10 == 7, "correct-accept").when(e % 10 == 1, "create").otherwise("accept")
    commands = p["events"].select(
        F.concat(F.lit("cmd:"), "event_id").alias("command_id"), F.concat(F.lit("prop:"), "event_id").alias("proposal_id"), action.alias("action"),
        F.when(e % 9 == 5, "none").otherwise(F.concat(F.lit("user:"), "user_id")).alias("entity_id"), F.lit("Ana").alias("name"), F.lit("").alias("email"), F.col("ts").alias("recorded_at"),
    )
    known = _proposals(p).where("substr(proposal_id, -1) IN ('1', '3', '5', '7', '9')")  # commands on the others name no proposal
    return decide(commands, p["fx_decisions"], known, p["fx_entities"]).select("command_id", "verdict")

"""Queries of the operators on stored documents and statements, with the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import evidence as ev
from evidentia.operators import documents
from evidentia.queries import query


def _t(expr: str) -> str:
    return f"('01' || lpad(upper(to_hex(octet_length(encode({expr})))), 16, '0') || hex(encode({expr})))"


def _n(expr: str, tag: str = "03") -> str:
    return f"('{tag}0000000000000008' || lpad(upper(to_hex({expr})), 16, '0'))"


def _f(value: bool) -> str:
    return f"'0400000000000000010{int(value)}'"


def _time(expr: str) -> str:
    return _n(f"epoch_us({expr})", "05")


@query(
    """WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, CASE WHEN role = 'user' THEN text ELSE '' END AS run FROM conversations),
w AS (SELECT conv_id, turn, run, [turn] AS o FROM n WHERE parent IS NULL UNION ALL SELECT n.conv_id, n.turn, n.run, list_append(w.o, n.turn) FROM n JOIN w ON n.conv_id=w.conv_id AND n.parent=w.turn)
SELECT conv_id AS doc_id, string_agg(coalesce(run, ''), '' ORDER BY o) AS text FROM w GROUP BY 1"""
)
def structural_text(p):
    parent = F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2"))
    run = F.when(F.col("role") == "user", F.col("text"))
    rows = p["conversations"].select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), parent.alias("parent_id"), F.col("turn").alias("position"), run.alias("text"))
    return documents.structural_text(rows)


@query("SELECT conv_id AS doc_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS n_transcripts, count(*) FILTER (role = 'user') = 1 AS accepted FROM conversations GROUP BY 1")
def transcript_check(p):
    role = F.when(F.col("role") == "user", "transcript").otherwise("notes")
    return documents.transcripts(p["conversations"].select(F.col("conv_id").alias("doc_id"), role.alias("role")))


_SECTION = f"sha256(unhex({_t('CAST(sid AS VARCHAR)')} || {_t('role')} || {_t(chr(39) * 2)} || {_n('1')} || {_t('role')} || {_n('turn')} || {_t('role')} || {_t('sha256(coalesce(text, ' + chr(39) * 2 + '))')}))"
_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(version_id AS INTEGER))"


@query(
    f"""WITH s AS (SELECT *, CASE WHEN conv_id % 5 = 1 THEN 0 ELSE turn END AS sid FROM conversations WHERE conv_id % 11 <> 3),
h AS (SELECT conv_id AS version_id, string_agg(e, '' ORDER BY turn, e) AS entries, count(*) AS n, count(DISTINCT sid) AS d FROM (SELECT *, {_SECTION} AS e FROM s) GROUP BY 1),
v AS (SELECT version_id, CASE WHEN version_id % 7 = 0 THEN 'provenance' WHEN n IS NULL THEN 'no-sections' WHEN d <> n THEN 'section-ids' END AS fault, n, entries FROM (SELECT DISTINCT conv_id AS version_id FROM conversations) LEFT JOIN h USING (version_id))
SELECT version_id, fault, CASE WHEN fault IS NULL THEN sha256(unhex({_t("'Talk ' || version_id")} || {_t("'talk/' || version_id")} || {_t("'1'")} || {_time(_AT)} || CASE WHEN version_id % 2 = 0 THEN {_f(False)} ELSE {_f(True)} || {_time(_AT)} END || {_n('n')} || {_t('entries')})) END AS digest FROM v"""
)
def document_version_digest(p):
    talk = p["conversations"]
    v = F.col("version_id")
    at = F.timestamp_add("HOUR", v, F.lit("2024-01-01").cast("timestamp_ntz"))
    versions = talk.select(F.col("conv_id").alias("version_id")).distinct().select(
        "version_id", F.lit("store").alias("provider"), v.cast("string").alias("provider_id"), F.when(v % 7 == 0, " ").otherwise(F.concat(F.lit("Talk "), v)).alias("title"),
        F.concat(F.lit("talk/"), v).alias("locator"), F.lit("1").alias("provider_version"), at.alias("modified_at"), F.when(v % 2 != 0, at).alias("source_time"),
    )
    sections = talk.where("conv_id % 11 <> 3").select(
        F.col("conv_id").alias("version_id"), F.when(F.col("conv_id") % 5 == 1, 0).otherwise(F.col("turn")).cast("string").alias("section_id"), F.col("role").alias("title"),
        F.lit(None).cast("string").alias("parent_id"), F.array("role").alias("path"), F.col("turn").alias("section_order"), "role", F.col("text").alias("content"),
    )
    return documents.version_records(versions, sections)


_REVISION = f"sha256(unhex({_t(chr(39) + 'revision' + chr(39))} || {_t(chr(39) + 'store' + chr(39))} || {_t('CAST(o_orderkey AS VARCHAR)')} || {_t('o_orderstatus')}))"


@query(f"SELECT o_orderkey, {_REVISION} AS revision_id, sha256(unhex({_t(_REVISION)} || {_time('o_orderdate')})) AS digest FROM orders")
def revision_ids(p):
    own, made = documents.revision(F.lit("store"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderdate"))
    return p["orders"].select("o_orderkey", own.alias("revision_id"), made.alias("digest"))


@query(
    f"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'no-method' WHEN 1 THEN 'no-version' WHEN 2 THEN 'model-without-prompt' END AS fault,
sha256(unhex({_t('c_name')} || {_t(chr(39) + 'limit' + chr(39))} || {_t('CAST(c_nationkey AS VARCHAR)')} || {_t(chr(39) + 'model' + chr(39))} || {_t('c_mktsegment')})) AS digest FROM customer"""
)
def derivation_rules(p):
    k = F.col("c_custkey") % 5
    fault = documents.derivation_fault(F.when(k == 0, " ").otherwise("extract"), F.when(k != 1, "1"), F.when(k >= 2, "m"), F.when(k > 2, "p1"))
    return p["customer"].select("c_custkey", fault.alias("fault"), documents.derivation_digest("c_name", {"model": F.col("c_mktsegment"), "limit": F.col("c_nationkey")}).alias("digest"))


@query(
    """SELECT event_id, CASE WHEN k = 5 OR (k = 0 AND event_id % 7 = 0) THEN NULL ELSE CASE k WHEN 0 THEN 'absent' WHEN 1 THEN 'text' WHEN 2 THEN 'mention' WHEN 3 THEN 'entity' ELSE 'grounded_entity' END END AS stored,
CASE WHEN k IN (1, 2, 3, 4) THEN event_type END AS ref, CASE WHEN k = 4 THEN 'men:' || event_id END AS grounding, NOT (k = 5 OR (k = 0 AND event_id % 7 = 0)) AS same FROM (SELECT *, event_id % 6 AS k FROM events)"""
)
def term_codec(p):
    """Terms stored and read again; a mention with a grounding and an absent term with a text have no stored form."""
    k = F.col("event_id") % 6
    kind = F.when(k == 0, "absent").when(k == 1, "text").when(k.isin(2, 5), "mention").otherwise("entity")
    ref = F.when(k != 0, F.col("event_type")).when(F.col("event_id") % 7 == 0, "x")
    rows = p["events"].select("event_id", kind.alias("kind"), ref.alias("ref"), F.when(k >= 4, F.concat(F.lit("men:"), "event_id")).alias("grounding"))
    rows = rows.withColumn("stored", documents.encode_term(F.col("kind"), F.col("ref"), F.col("grounding")))
    rows = rows.withColumn("term", documents.decode_term(F.col("stored")))
    same = F.coalesce((F.col("term.kind") == F.col("kind")) & F.col("term.ref").eqNullSafe(F.col("ref")) & F.col("term.grounding").eqNullSafe(F.col("grounding")), F.lit(False))
    return rows.select("event_id", F.col("stored.kind").alias("stored"), "term.ref", "term.grounding", same.alias("same"))


@query(
    """SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'not-after' WHEN event_id % 8 = 1 AND temporal_kind = 'instant' THEN 'instant' END AS fault,
CASE WHEN event_id % 8 = 0 OR (event_id % 8 = 1 AND temporal_kind = 'instant') THEN NULL ELSE temporal_kind END AS kind,
CASE WHEN event_id % 8 <> 0 AND NOT (event_id % 8 = 1 AND temporal_kind = 'instant') THEN valid_start END AS valid_start,
CASE WHEN event_id % 8 <> 0 AND NOT (event_id % 8 = 1 AND temporal_kind = 'instant') THEN valid_end END AS valid_end FROM fx_obs""",
    "fx_obs",
)
def extent_codec(p):
    """Extents stored and read again; an end that is not after its start and an instant with an end are refused."""
    k = F.col("event_id") % 8
    kind = F.when(k == 0, "interval").otherwise(F.col("temporal_kind"))
    start = F.when(k == 0, F.col("ts")).otherwise(F.col("valid_start"))
    end = F.when((k == 0) | (k == 1) & (F.col("temporal_kind") == "instant"), F.col("ts")).otherwise(F.col("valid_end"))
    rows = p["fx_obs"].select("event_id", kind.alias("k"), start.alias("s"), end.alias("e"))
    args = [F.col(c) for c in "kse"]
    rows = rows.select("event_id", documents.extent_fault(*args).alias("fault"), documents.encode_extent(*args).alias("stored"))
    rows = rows.withColumn("x", documents.decode_extent(F.col("stored")))
    return rows.select("event_id", "fault", "x.kind", F.col("x.start").alias("valid_start"), F.col("x.end").alias("valid_end"))


_CONFIDENCE = f"CASE event_id % 3 WHEN 0 THEN {_f(False)} WHEN 1 THEN {_f(True)} || '0200000000000000083FE0000000000000' ELSE {_f(True)} || '0200000000000000083FD0000000000000' END"


@query(
    f""", l AS (SELECT * FROM fx_evidence WHERE evidence_id NOT LIKE 'ev:%7' UNION ALL SELECT * FROM fx_evidence WHERE evidence_id LIKE 'cx:%1'),
g AS (SELECT obs_id, count(*) AS n, count(DISTINCT evidence_id || '/' || role) AS d, string_agg({_t('evidence_id')} || {_t('role')}, '' ORDER BY evidence_id, role) AS pairs FROM l GROUP BY 1),
f AS (SELECT o.*, n, pairs, CASE WHEN n IS NULL THEN 'no-evidence' WHEN n <> d THEN 'evidence-twice' WHEN event_id % 37 = 0 THEN 'no-version' END AS fault FROM fx_obs o LEFT JOIN g USING (obs_id))
SELECT obs_id, fault, CASE WHEN fault IS NULL THEN sha256(unhex({_t('subject_kind')} || {_t('subject_ref')} || {_t('predicate')} || {_t('object_kind')} || {_t('object_ref')} || {_t('temporal_kind')}
|| CASE WHEN valid_start IS NULL THEN {_f(False)} ELSE {_f(True)} || {_time('valid_start')} END || CASE WHEN valid_end IS NULL THEN {_f(False)} ELSE {_f(True)} || {_time('valid_end')} END || {_time('recorded_at')}
|| {_n('n')} || pairs || {_t("'extract'")} || {_t("'1'")} || {_t("'run'")} || {_t("''")} || {_t("''")} || {_t('status')} || {_CONFIDENCE})) END AS digest FROM f""",
    "fx_evidence",
)
def observation_records(p):
    links = p["fx_evidence"]
    links = links.where("evidence_id NOT LIKE 'ev:%7'").unionByName(links.where("evidence_id LIKE 'cx:%1'"))
    e, none = F.col("event_id"), F.lit(None).cast("string")
    rows = p["fx_obs"].select(
        "*", F.lit("extract").alias("method"), F.when(e % 37 != 0, "1").alias("version"), F.lit("run").alias("run_id"), none.alias("model"), none.alias("prompt_version"),
        F.when(e % 3 == 1, 0.5).when(e % 3 == 2, 0.25).alias("confidence"),
    )
    return documents.observation_records(rows, links)


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def digest_conflicts(p):
    rows = p["documents"].select("doc_id", ev.digest(ev.frame("text"), ev.frame("lang")).alias("digest"))
    stored = rows.withColumn("digest", F.when(F.col("doc_id") % 10 == 3, F.reverse("digest")).otherwise(F.col("digest")))
    return documents.digest_conflicts(stored, rows, "doc_id")


@query(
    """SELECT 'c' || c_custkey AS id, c_name AS display_name, array_to_string(coalesce(a, []), ' ') AS aliases, CAST(coalesce(n, 0) AS BIGINT) AS n_mentions FROM customer
LEFT JOIN (SELECT o_custkey, list_sort(list(DISTINCT 'name:' || o_orderstatus)) AS a, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
)
def entity_listing(p):
    own = F.concat(F.lit("c"), "o_custkey").alias("entity_id")
    aliases = p["orders"].select(own, F.lit("name").alias("kind"), F.col("o_orderstatus").alias("value"))
    people = p["customer"].select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("display_name"))
    out = documents.entity_listing(people, aliases, p["orders"].select(own, F.col("o_orderdate").alias("mention_id")))
    return out.withColumn("aliases", F.array_join("aliases", " "))


@query(
    """SELECT subject_id, email FROM (SELECT o_custkey AS subject_id, 'm' || o_orderkey AS email, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END, o_orderkey) AS rn FROM orders) WHERE rn = 1"""
)
def profile_email(p):
    k = F.col("o_orderkey")
    return documents.profile_email(p["orders"].select(F.col("o_custkey").alias("subject_id"), F.concat(F.lit("m"), k).alias("email"), (k % 5 == 0).alias("is_primary"), k.alias("position")))

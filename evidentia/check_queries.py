"""Queries of orders, checks and rules over rows in which faults are planted, with the SQL that finds them again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import evidence as ev
from evidentia.functions import order
from evidentia.functions import text as tx
from evidentia.functions import timeaxis as ta
from evidentia.operators import authority, checks, citations, directory, identity, records, review, state
from evidentia.plans.lineage import cut
from evidentia.queries import _TREND, _W1, A, B, B2, C, K, _cands_sql, _state_sql, _ts, cands, ntz, query
from evidentia.record_queries import batch_of, batch_sql
from evidentia.schema import TAB_ROLES


# ---- orders -----------------------------------------------------------------------------------------

_KIND = "CASE temporal_kind WHEN 'unknown' THEN 0 WHEN 'instant' THEN 1 WHEN 'interval' THEN 2 WHEN 'window' THEN 3 END"


@query(f"SELECT obs_id, CAST(row_number() OVER (PARTITION BY predicate ORDER BY {_KIND}, valid_start NULLS LAST, valid_end NULLS LAST, obs_id) AS BIGINT) AS place FROM fx_obs", "fx_obs")
def extent_order(p):
    w = Window.partitionBy("predicate").orderBy(*order.extent_order(), "obs_id")
    return p["fx_obs"].select("obs_id", F.row_number().over(w).cast("long").alias("place"))


@query(
    "SELECT obs_id, CAST(row_number() OVER (PARTITION BY event_id % 50 ORDER BY CASE subject_kind WHEN 'absent' THEN 0 WHEN 'text' THEN 1 WHEN 'mention' THEN 2 WHEN 'entity' THEN 3 END, subject_ref, predicate, object_ref, obs_id) AS BIGINT) AS place FROM fx_obs",
    "fx_obs",
)
def key_order(p):
    """Mentions come before entities, whatever their names; keys by subject, then predicate, then the value."""
    w = Window.partitionBy(F.col("event_id") % 50).orderBy(*order.key_order(), *order.value_order(), "obs_id")
    return p["fx_obs"].select("obs_id", F.row_number().over(w).cast("long").alias("place"))


@query(
    f"SELECT obs_id, CAST(row_number() OVER (PARTITION BY predicate ORDER BY status, {_KIND}, valid_start NULLS LAST, valid_end NULLS LAST, recorded_at, obs_id) AS BIGINT) AS place FROM fx_obs", "fx_obs"
)
def contribution_order(p):
    rows = p["fx_obs"].withColumns({"own": F.col("obs_id"), "obs_id": F.lit("same"), "subject_grounding": F.lit(None).cast("string"), "object_grounding": F.lit(None).cast("string")})
    w = Window.partitionBy("predicate").orderBy(*order.contribution_order(), "own")
    return rows.select(F.col("own").alias("obs_id"), F.row_number().over(w).cast("long").alias("place"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_partkey AS VARCHAR), l_linenumber, CAST(l_orderkey AS VARCHAR), l_returnflag, l_linestatus) AS BIGINT) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem)"
)
def citation_order(p):
    """Citations by source, section, evidence and role: lines of a supplier as if they cited parts."""
    text = lambda c: F.col(c).cast("string")
    own = {"source_id": text("l_partkey"), "section_order": F.col("l_linenumber"), "evidence_id": text("l_orderkey"), "role": F.col("l_returnflag"), "section_title": F.col("l_linestatus")}
    rows = p["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").distinct()
    rows = rows.withColumns({c: own.get(c, F.lit(None).cast("string")) for c in order.CITATION})
    w = Window.partitionBy("l_suppkey").orderBy(*order.citation_order())
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("place"))


# ---- checks that find planted faults ----------------------------------------------------------------


@query(
    "SELECT obs_id AS detail FROM fx_obs WHERE event_id % 17 = 3 OR (event_id % 17 = 5 AND subject_kind = 'mention') OR (event_id % 17 = 7 AND subject_kind = 'entity')", "fx_obs"
)
def candidate_faults(p):
    """Candidates that don't come from their observation: another predicate, a wrong grounding, a grounding too many."""
    rows = p["fx_obs"]
    mention = F.col("subject_kind") == "mention"
    told = rows.withColumns({
        "predicate": F.when(F.col("event_id") % 17 == 3, "other").otherwise(F.col("predicate")), "subject_grounding": F.when(mention, F.when(F.col("event_id") % 17 == 5, "men:none").otherwise(F.col("subject_ref"))).when(F.col("event_id") % 17 == 7, "men:x"),
        "object_grounding": F.lit(None).cast("string"), "subject_ref": F.when(mention, F.lit("user:1")).otherwise(F.col("subject_ref")), "subject_kind": F.lit("entity"),
    })
    return checks.candidate_faults(told, rows).select("detail")


@query(
    "SELECT obs_id AS detail, 'contradicting classes' AS fault FROM fx_obs WHERE event_id % 13 = 2 UNION ALL SELECT obs_id, 'twice' FROM fx_obs WHERE event_id % 13 = 4 UNION ALL SELECT obs_id, 'unknown class' FROM fx_obs WHERE event_id % 13 = 6 UNION ALL SELECT obs_id, 'not requested' FROM fx_obs WHERE event_id % 13 = 8",
    "fx_obs",
)
def qualification_faults(p):
    rows = p["fx_obs"].select("event_id", "obs_id", "predicate", F.when(F.col("event_id") % 13 == 6, "odd").otherwise("retained").alias("class"))
    again = rows.where("event_id % 13 IN (2, 4)").withColumn("class", F.when(F.col("event_id") % 13 == 2, "entity-filtered").otherwise(F.col("class")))
    cover = rows.where("event_id % 13 IN (8, 10)").select(F.when(F.col("event_id") % 13 == 8, "user:none").otherwise("user:1").alias("entity_id"), "predicate", "obs_id", F.lit("entity-filtered").alias("reason"))
    asked = p.spark.createDataFrame([("user:1",)], "entity_id string")
    return checks.qualification_faults(rows.unionByName(again), cover, asked).select("detail", "fault")


_SUMMARY = f", {_cands_sql()}, {_state_sql('w', 'cand', *_W1)}"


def _broken_keys(p):
    """The window's keys; those of one predicate occur twice, one has no known outcome, one lost its values."""
    _, of_values, of_keys = state.aggregate(cands(p), *ta.in_window(ntz(A), ntz(B)))
    of_keys = cut(of_keys)  # read twice
    twice = of_keys.where("predicate = 'attr.1'")
    odd = of_keys.withColumn("outcome", F.when(F.col("predicate") == "attr.2", "odd").otherwise(F.col("outcome")))
    return odd.unionByName(twice), of_values.where("predicate <> 'attr.3'")


@query(
    _SUMMARY + " SELECT predicate, 'key twice' AS fault, CAST(count(*) AS BIGINT) AS n FROM wk WHERE predicate='attr.1' GROUP BY 1 UNION ALL SELECT predicate, 'no known outcome', count(*) FROM wk WHERE predicate='attr.2' GROUP BY 1 UNION ALL SELECT predicate, 'no candidates', count(*) FROM wk WHERE predicate='attr.3' GROUP BY 1",
    "fx_evidence",
)
def summary_faults(p):
    found = checks.summary_faults(*_broken_keys(p))
    return found.groupBy(F.get_json_object("detail", "$.predicate").alias("predicate"), "fault").agg(F.count("*").alias("n"))


@query(
    _SUMMARY + " SELECT c.predicate, CAST(count(DISTINCT (c.subject_kind, c.subject_ref, c.object_ref)) AS BIGINT) AS n FROM wc c JOIN wk k USING (subject_kind,subject_ref,predicate) WHERE (k.o<>'resolved' OR c.cls='s') AND c.predicate IN ('attr.4', 'attr.5') GROUP BY 1",
    "fx_evidence",
)
def fact_faults(p):
    """Values of two predicates whose links were lost have no evidence."""
    rows, _, keys = state.aggregate(cands(p), *ta.in_window(ntz(A), ntz(B)))
    lost = p["fx_obs"].where("predicate IN ('attr.4', 'attr.5')").select("obs_id")
    told = state.provenance(rows, keys, p["fx_evidence"].join(lost, "obs_id", "left_anti"))
    return checks.fact_faults(told).groupBy(F.get_json_object("detail", "$.predicate").alias("predicate")).agg(F.count("*").alias("n"))


@query(
    _TREND + """, ch AS (SELECT *, CASE WHEN coalesce(ao,'resolved')<>'resolved' OR coalesce(bo,'resolved')<>'resolved' THEN 'unresolved' WHEN ao IS NULL THEN 'added' WHEN bo IS NULL THEN 'removed' ELSE 'changed' END AS change FROM j WHERE coalesce(ao,'resolved')<>'resolved' OR coalesce(bo,'resolved')<>'resolved' OR ao IS NULL OR bo IS NULL OR ak<>bk OR ar<>br)
SELECT 'missing' AS fault, CAST(count(*) AS BIGINT) AS n FROM ch WHERE predicate='attr.1' OR (predicate='attr.2' AND change='added') HAVING count(*) > 0 UNION ALL SELECT 'does not follow', count(*) FROM ch WHERE predicate='attr.2' AND change='added' HAVING count(*) > 0 UNION ALL SELECT 'shape', count(*) FROM ch WHERE predicate='attr.2' AND change='added' HAVING count(*) > 0""",
    "fx_evidence",
)
def trend_faults(p):
    """Changes of one predicate left out, additions of another told as removals."""
    rows, eligible, uncertain = state.labelled(cands(p), {"before": ta.in_window(ntz(A), ntz(B)), "after": ta.in_window(ntz(B2), ntz(C))})
    keys = state.aggregate(rows, eligible, uncertain, sel=["label"])[2]
    changes = state.compare(keys, "before", "after").where("predicate <> 'attr.1'")
    changes = changes.withColumn("change", F.when((F.col("predicate") == "attr.2") & (F.col("change") == "added"), "removed").otherwise(F.col("change")))
    return checks.trend_faults(keys, changes, "before", "after").groupBy("fault").agg(F.count("*").alias("n"))


@query(
    f"SELECT fault, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN valid_start >= {_ts(B)} OR valid_start < {_ts(A)} THEN 'outside' END AS fault FROM fx_obs WHERE temporal_kind='instant' UNION ALL SELECT CASE WHEN event_id % 10 = 1 THEN 'twice' END FROM fx_obs WHERE temporal_kind='instant' UNION ALL SELECT CASE WHEN event_id % 10 = 5 THEN 'shape' END FROM fx_obs WHERE temporal_kind='instant') WHERE fault IS NOT NULL GROUP BY 1 UNION ALL SELECT 'outside2', count(*) FROM fx_obs WHERE false HAVING count(*) > 0",
    "fx_obs",
)
def transition_faults(p):
    """Instants as transitions: some outside the window, some twice, some without a value."""
    null = F.lit(None).cast("string")
    rows = p["fx_obs"].where("temporal_kind = 'instant'").select(
        "event_id", "subject_kind", F.col("obs_id").alias("subject_ref"), "predicate", F.col("valid_start").alias("instant"), F.lit("added").alias("change"), null.alias("before_object_kind"), null.alias("before_object_ref"),
        F.when(F.col("event_id") % 10 == 5, null).otherwise(F.lit("text")).alias("after_object_kind"), F.col("object_ref").alias("after_object_ref"),
    )
    again = rows.where("event_id % 10 = 1").withColumn("instant", F.col("instant"))
    found = checks.transition_faults(rows.unionByName(again), A, B)
    # a row told twice that lies outside is outside twice
    return found.distinct().groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "SELECT CASE event_id % 5 WHEN 0 THEN 'entity not requested' WHEN 1 THEN 'label not requested' WHEN 2 THEN 'predicate not requested' WHEN 3 THEN 'not a causal question' END AS fault, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 5 < 4 GROUP BY 1"
)
def gap_faults(p):
    k = F.col("event_id") % 5
    gaps = p["events"].select(
        F.when(k == 3, "no-causal-evidence").otherwise("no-evidence").alias("kind"), F.when(k == 0, "e9").otherwise("e1").alias("entity_id"), F.when(k == 1, "other").otherwise("w").alias("label"),
        F.when(k == 2, "x").when(k == 3, F.lit(None)).otherwise("p").alias("predicate"),
    )
    return checks.gap_faults(gaps, ["e1"], ["w"], ["p"]).groupBy("fault").agg(F.count("*").alias("n"))


@query(
    "SELECT obs_id, evidence_id, role, 'uncited' AS fault FROM fx_evidence WHERE CAST(substr(evidence_id, 4) AS BIGINT) % 9 = 1 UNION ALL SELECT obs_id, evidence_id, role, 'unlinked' FROM fx_evidence WHERE CAST(substr(evidence_id, 4) AS BIGINT) % 9 = 2 UNION ALL SELECT NULL, evidence_id, NULL, 'told-twice' FROM fx_evidence WHERE CAST(substr(evidence_id, 4) AS BIGINT) % 9 = 3",
    "fx_evidence",
)
def link_faults(p):
    """Links without a citation, citations without a link, evidence told in two ways."""
    links = p["fx_evidence"]
    n = F.substring("evidence_id", 4, 20).cast("long") % 9
    cited = links.withColumns({c: F.lit(None).cast("string") for c in order.CITATION if c not in ("evidence_id", "role")}).where(n != 1)
    twice = cited.where(n == 3).withColumn("locator", F.lit("elsewhere"))
    return citations.link_faults(links.where(n != 2), cited.unionByName(twice))


# ---- rules of sources and reviewers -----------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'transcript' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'notes' ELSE 'other' END AS role FROM orders")
def tab_roles(p):
    title = F.when(F.col("o_orderstatus") == "F", "  Full\tTRANSCRIPT ").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0), "Notes").otherwise("Notes of the day")
    return p["orders"].select("o_orderkey", ev.tab_role(title, ["full transcript"], ["notes"]).alias("role"))


@query(
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'listed ' || c_name ELSE 'read ' || c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-02-02 00:00:00' END AS source_time, CASE WHEN c_custkey % 5 = 0 THEN 'l' ELSE 'f' END AS locator, CASE WHEN c_custkey % 3 = 0 THEN 'f1' ELSE 'l1' END AS provider_version,
CASE WHEN c_custkey % 7 = 0 THEN 'provider' END AS fault FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey, 'listed ' || c_name, TIMESTAMP '2024-01-01 00:00:00', 'l', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'l1' END, 'missing' FROM customer WHERE c_custkey % 11 = 0"""
)
def merged_documents(p):
    c = p["customer"]
    k = F.col("c_custkey")
    null = F.lit(None).cast("string")
    base = lambda tag, day: [k.alias("doc_id"), F.when((k % 7 == 0) & F.lit(tag == "read"), "q").otherwise("p").alias("provider"), F.concat(F.lit(f"{tag} "), "c_name").alias("title"), ntz(day).alias("source_time")]
    listed = c.select(*base("listed", "2024-01-01"), F.lit("l").alias("locator"), F.when(k % 3 == 0, null).otherwise(F.lit("l1")).alias("provider_version"), ntz(A).alias("modified_at"))
    read = c.where(k % 11 != 0).select(*base("read", "2024-02-02"), F.when(k % 5 == 0, " ").otherwise("f").alias("locator"), F.lit("f1").alias("provider_version"), ntz(B).alias("modified_at"), F.lit("x").alias("content"))
    read = read.withColumn("title", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("title")))
    return records.merged_documents(listed, read).select("doc_id", "title", "source_time", "locator", "provider_version", "fault")


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'no-id' WHEN 1 THEN 'no-title' WHEN 2 THEN 'role' WHEN 3 THEN 'order' WHEN 4 THEN 'path' END AS fault FROM documents")
def section_faults(p):
    k = F.col("doc_id") % 7
    rows = p["documents"].select(
        "doc_id", F.when(k == 0, " ").otherwise("s").alias("section_id"), F.when(k == 1, "").otherwise("t").alias("title"), F.when(k == 2, "speech").otherwise("notes").alias("role"), F.when(k == 3, -1).otherwise(0).alias("section_order"),
        F.when(k == 4, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a"))).alias("path"), F.col("text").alias("content"),
    )
    return rows.select("doc_id", records.section_fault(TAB_ROLES).alias("fault"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS bound, c_custkey % 4 <> 1 AS named, c_custkey % 5 < 3 AS addressed, lower(c_mktsegment) || '@x.org' AS email FROM customer")
def grounded_identities(p):
    """Names and addresses found in quotes, bounded, and mailboxes that are exactly one's."""
    from pyspark.sql.types import BooleanType

    @F.pandas_udf(BooleanType())
    def bound(quote, name, mail):
        return quote.combine(name, lambda q, n: (q, n)).combine(mail, lambda qn, m: tx.source_mailbox(*qn, m)).astype(bool)

    @F.pandas_udf(BooleanType())
    def named(quote, name):
        return quote.combine(name, tx.grounded_name).astype(bool)

    @F.pandas_udf(BooleanType())
    def addressed(quote, mail):
        return quote.combine(mail, tx.grounded_email).astype(bool)

    k, name = F.col("c_custkey"), F.concat(F.lit("Ana "), F.lower("c_mktsegment"))
    mail = F.concat(F.lower("c_mktsegment"), F.lit("@x.org"))
    box = F.when(k % 3 == 0, F.concat(name, F.lit(" <"), mail, F.lit(">"))).when(k % 3 == 1, F.concat(name, F.lit(" "), mail)).otherwise(F.concat(F.lit("Bo <"), mail, F.lit(">")))
    says = F.when(k % 4 == 0, F.concat(F.lit("So said "), F.upper(name), F.lit("."))).when(k % 4 == 1, F.concat(name, F.lit("s"))).otherwise(F.concat(F.lit("("), name, F.lit(")")))
    holds = F.when(k % 5 < 3, F.concat(F.lit("write to "), F.upper(mail), F.lit("."))).otherwise(F.concat(F.lit("x"), mail))
    return p["customer"].select("c_custkey", bound(box, name, mail).alias("bound"), named(says, name).alias("named"), addressed(holds, mail).alias("addressed"), tx.normalize_email(F.concat(F.lit(" "), F.upper(mail))).alias("email"))


@query(
    "SELECT 'prop' || c_custkey AS proposal_id, 'e' || c_custkey AS entity_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0"
)
def automatic_accepts(p):
    """One candidate by exact address that is the grounded one; others have two, or another address."""
    c = p["customer"]
    k, pid = F.col("c_custkey"), F.concat(F.lit("prop"), "c_custkey").alias("proposal_id")
    one = c.select(pid, F.concat(F.lit("e"), "c_custkey").alias("entity_id"), F.lit("exact-email").alias("reason"), F.concat(k.cast("string"), F.lit("@x")).alias("email"))
    more = c.where("c_custkey % 3 = 1").select(pid, F.lit("other").alias("entity_id"), F.lit("exact-email").alias("reason"), F.concat(k.cast("string"), F.lit("@x")).alias("email"))
    grounded = c.where("c_custkey % 3 <> 2").select(pid, F.concat(k.cast("string"), F.when(k % 2 == 0, "@x").otherwise("@y")).alias("email"))
    return review.automatic_accepts(c.select(pid), one.unionByName(more), grounded).select("proposal_id", "entity_id")


@query(batch_sql("fx_admissions", "target_id", " AND x.target_kind = 'observation'").replace("s.target_id = x.target_id", "s.target_id = x.target_id AND s.target_kind = 'observation'"), "fx_admissions")
def admission_append_rules(p):
    """Admission decisions judged against the stored ones and each other."""
    rows = p["fx_admissions"]
    return authority.appendable(rows, batch_of(rows.where("target_kind = 'observation' AND id LIKE '%:0'"), "target_id"), ["target_kind", "target_id"]).select("id", "verdict")


_CMD = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'create' ELSE 'correct-accept' END AS action FROM customer"


def _decided(p):
    c = p["customer"]
    k = F.col("c_custkey")
    pid, null = F.concat(F.lit("p"), "c_custkey").alias("proposal_id"), F.lit(None).cast("string")
    proposals = c.select(pid, F.concat(F.lit("m"), "c_custkey").alias("mention_id"))
    entities = c.select(F.concat(F.lit("e"), "c_custkey").alias("id"))
    decisions = c.where("c_custkey % 4 = 3 AND c_custkey % 8 = 3").select(F.concat(F.lit("d"), "c_custkey").alias("id"), pid, F.concat(F.lit("m"), "c_custkey").alias("mention_id"), F.lit("rejected").alias("outcome"), null.alias("entity_id"), ntz(A).alias("recorded_at"), null.alias("supersedes_id"))
    action = F.element_at(F.array(*map(F.lit, ("accept", "reject", "create", "correct-accept"))), (k % 4 + 1).cast("int"))
    commands = c.select(F.concat(F.lit("c"), "c_custkey").alias("command_id"), pid, action.alias("action"), F.concat(F.lit("e"), "c_custkey").alias("entity_id"), F.concat(F.lit("  Ana  "), "c_name").alias("name"), F.concat(k.cast("string"), F.lit("@X.org")).alias("email"), ntz(B).alias("recorded_at"))
    return review.decide(commands, decisions, proposals, entities)


@query(
    f"SELECT 'p' || k AS proposal_id, CASE WHEN action = 'reject' THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN action IN ('accept', 'correct-accept') THEN 'e' || k WHEN action = 'create' THEN 'made' END AS entity, CASE WHEN action = 'correct-accept' THEN 'd' || k END AS supersedes_id FROM ({_CMD}) WHERE action <> 'correct-accept' OR k % 8 = 3"
)
def review_decisions(p):
    """The decisions that reviewers' commands write; a created person's id is made."""
    rows = review.written_decisions(_decided(p))
    return rows.select("proposal_id", "outcome", F.when(F.length("entity_id") > 60, "made").otherwise(F.col("entity_id")).alias("entity"), "supersedes_id")


@query(
    f"SELECT 'p' || k AS proposal_id, kind, value FROM ({_CMD.replace('FROM customer', ', c_name FROM customer')}), LATERAL (SELECT unnest(['name', 'name', 'email']) AS kind, unnest(['Ana  ' || c_name, 'ana ' || lower(c_name), k || '@x.org']) AS value) WHERE action <> 'reject' AND (action <> 'correct-accept' OR k % 8 = 3)"
)
def review_aliases(p):
    """Names as given and normalised, and addresses, of everyone that an accepted decision names."""
    decided = _decided(p)
    rows = review.written_aliases(decided, tx.plain_name, lambda c: F.lower(F.trim(c)))
    return rows.join(decided.select(F.col("id").alias("decision_id"), "proposal_id"), "decision_id").select("proposal_id", "kind", "value")


@query(f"SELECT 'p' || k AS proposal_id, '  Ana  ' || c_name AS display_name FROM ({_CMD.replace('FROM customer', ', c_name FROM customer')}) WHERE action = 'create'")
def review_people(p):
    decided = _decided(p)
    rows = review.written_people(decided)
    return rows.join(decided.select(F.col("decided_entity").alias("id"), "proposal_id"), "id").select("proposal_id", "display_name")


@query(
    "SELECT 'admitted' AS outcome, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS targets, 64 AS id_length FROM orders"
)
def initial_admissions(p):
    rows = records.initial_admissions(p["orders"].select(F.col("o_orderkey").alias("id")), "observation", "policy/1", ntz(A))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("id").alias("targets"), F.max(F.length("id")).alias("id_length"))


@query(
    """, acc AS (SELECT DISTINCT d.entity_id FROM fx_decisions d WHERE outcome='accepted' AND NOT EXISTS (SELECT 1 FROM fx_decisions s WHERE s.supersedes_id=d.id) AND entity_id IN (SELECT id FROM fx_entities)),
pr AS (SELECT DISTINCT 'user:' || user_id AS first, 'user:' || (user_id + event_id % 3) AS second FROM events)
SELECT first, second, first IN (SELECT entity_id FROM acc) AS first_accepted, second IN (SELECT entity_id FROM acc) AS second_accepted FROM pr""",
    "fx_decisions", "fx_entities",
)
def pair_authority(p):
    pairs = p["events"].select(F.concat(F.lit("user:"), "user_id").alias("first"), F.concat(F.lit("user:"), (F.col("user_id") + F.col("event_id") % 3).cast("string")).alias("second")).distinct()
    return authority.pair_authority(pairs, p["fx_decisions"], p["fx_entities"])


@query(
    f"SELECT l.obs_id AS obs_id FROM fx_obs l WHERE recorded_at <= {_ts(K)} AND subject_kind = 'mention' AND predicate IN ('attr.3', 'attr.7')", "fx_obs"
)
def observation_values(p):
    """Observations of a few predicates known by the cutoff: the read behind an answer."""
    return authority.known_by(p["fx_obs"], datetime.fromisoformat(K)).where("subject_kind = 'mention' AND predicate IN ('attr.3', 'attr.7')").select("obs_id")


@query(
    "SELECT DISTINCT 'ver:' || doc_id AS version_id, lang AS title FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL"
)
def cited_sections(p):
    """The sections of the versions that a third of the spans cite."""
    from evidentia.record_queries import _cited_tables

    spans, _, sections, _ = _cited_tables(p)
    return citations.cited_sections(spans.where("cast(substr(evidence_id, 4) as long) % 3 = 0 and quote is not null"), sections).select("version_id", "title").distinct()


@query(
    "SELECT id, CASE n % 6 WHEN 0 THEN 'target-kind' WHEN 1 THEN 'no-target' WHEN 2 THEN 'outcome' WHEN 3 THEN 'authority' WHEN 4 THEN 'no-reason' END AS fault FROM (SELECT id, CAST(split_part(id, ':', 3) AS BIGINT) AS n FROM fx_admissions WHERE target_kind = 'observation') WHERE n % 6 < 5",
    "fx_admissions",
)
def admission_faults(p):
    """Admission decisions of which five in six break one rule each."""
    n = F.split_part("id", F.lit(":"), F.lit(3)).cast("long") % 6
    rows = p["fx_admissions"].where("target_kind = 'observation'").withColumns({
        "target_kind": F.when(n == 0, "thing").otherwise(F.col("target_kind")), "target_id": F.when(n == 1, " ").otherwise(F.col("target_id")), "outcome": F.when(n == 2, "maybe").otherwise(F.col("outcome")),
        "authority": F.when(n == 3, "nobody").otherwise("policy"), "reason": F.when(n == 4, "").otherwise("r"),
    })
    return rows.select("id", authority.admission_fault().alias("fault")).where("fault is not null")


@query(
    "SELECT c_custkey AS mention_id, CASE WHEN c_custkey % 3 = 0 THEN 'email' ELSE 'name' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || '@x.org' ELSE lower(c_name) END AS value, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'source' ELSE 'cited' END ELSE 'none' END AS binding FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 <> 0"
)
def directory_questions(p):
    """What may be asked: an address of an approved domain, else the name, else nothing."""
    k = F.col("c_custkey")
    rows = p["customer"].select(
        k.alias("mention_id"), F.concat(F.lit("p"), "c_custkey").alias("proposal_id"), F.when(k % 5 == 0, " ").otherwise(F.lower("c_name")).alias("name"), F.concat(k.cast("string"), F.when(k % 3 == 0, "@x.org").otherwise("@y.org")).alias("email"),
        F.lit(True).alias("email_ok"), F.when(k % 2 == 0, "source").otherwise("cited").alias("binding"),
    )
    return directory.questions(rows, ["X.org "]).select("mention_id", "kind", "value", "binding")


@query(
    "SELECT 'c' || c_custkey AS command_id, CASE WHEN c_custkey % 5 = 0 THEN 'not-staged' WHEN c_custkey % 5 = 1 THEN 'unknown-entity' WHEN c_custkey % 5 = 2 THEN 'owned' WHEN c_custkey % 5 = 3 THEN 'decided' ELSE 'ok' END AS verdict FROM customer"
    " UNION ALL SELECT x || c_custkey, v FROM customer, (VALUES ('x', 'owned'), ('y', 'decided'), ('z', 'ok')) r(x, v) WHERE c_custkey % 5 = 4"
)
def staged_candidates(p):
    """Reviewers' acceptances of staged directory candidates; four in five meet an obstacle, the fifth has rivals: another
    entity for its subject, its own proposal once more, and another proposal for the same entity."""
    c = p["customer"]
    k, null = F.col("c_custkey"), F.lit(None).cast("string")
    key = F.col("c_custkey").cast("string")
    own = [F.lit("d").alias("provider"), F.concat(F.lit("s"), key).alias("subject_id"), F.concat(F.lit("e"), key).alias("entity_id")]
    staged = c.where("c_custkey % 5 <> 0").select(*own, null.alias("decision_id"), F.concat(F.lit("p"), key).alias("proposal_id"))
    owned = c.where("c_custkey % 5 = 2").select(F.lit("d").alias("provider"), F.concat(F.lit("s"), key).alias("subject_id"), F.lit("e-other").alias("entity_id"), F.concat(F.lit("o"), key).alias("decision_id"), F.concat(F.lit("q"), key).alias("proposal_id"))
    decisions = owned.select(F.col("decision_id").alias("id"), "proposal_id", F.lit("accepted").alias("outcome"), "entity_id", ntz(A).alias("recorded_at"), null.alias("supersedes_id"))
    decisions = decisions.unionByName(c.where("c_custkey % 5 = 3").select(F.concat(F.lit("r"), key).alias("id"), F.concat(F.lit("p"), key).alias("proposal_id"), F.lit("rejected").alias("outcome"), null.alias("entity_id"), ntz(A).alias("recorded_at"), null.alias("supersedes_id")))
    entities = c.where(k % 5 != 1).select(F.concat(F.lit("e"), key).alias("id"))
    commands = c.select(F.concat(F.lit("c"), key).alias("command_id"), F.concat(F.lit("p"), key).alias("proposal_id"), *own, ntz(B).alias("recorded_at"))
    free = c.where("c_custkey % 5 = 4")
    for name, proposal, entity in (("x", "px", "else"), ("y", "p", None), ("z", "pz", None)):
        who = [*own[:2], F.lit(entity).alias("entity_id") if entity else own[2]]
        pid = F.concat(F.lit(proposal), key).alias("proposal_id")
        commands = commands.unionByName(free.select(F.concat(F.lit(name), key).alias("command_id"), pid, *who, ntz(B).alias("recorded_at")))
        staged = staged.unionByName(free.select(*who, null.alias("decision_id"), pid))
    entities = entities.unionByName(p.spark.range(1).select(F.lit("else").alias("id")))
    return directory.accept_candidates(commands, staged.unionByName(owned), decisions, entities).select("command_id", "verdict")


@query(
    """SELECT o_orderkey AS proposal_id, 'M' || o_custkey AS surface, (SELECT string_agg('q' || l_linenumber, ' ' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS quotes, 'Person ' || (o_custkey % 7) AS first_name FROM orders"""
)
def projected_proposals(p):
    """Proposals with their mention, evidence in order and candidates by rank."""
    o = p["orders"]
    null = F.lit(None).cast("string")
    proposals = o.select(F.col("o_orderkey").alias("proposal_id"), F.col("o_orderkey").alias("mention_id"), F.lit("r").alias("run_id"), F.lit("v").alias("version_id"), F.col("o_orderdate").alias("recorded_at"))
    mentions = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("M"), "o_custkey").alias("surface"), F.lit("m").alias("normalized_name"), null.alias("proposed_email"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    lines = p["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey").withColumn("position", place).withColumn("evidence_id", F.concat_ws(":", "l_orderkey", "position"))
    spans = lines.select("evidence_id", F.lit("v").alias("version_id"), F.lit("s").alias("section_id"), F.lit(0).alias("start_byte"), F.lit(1).alias("end_byte"), F.concat(F.lit("q"), "l_linenumber").alias("quote"))
    candidates = o.select(F.col("o_orderkey").alias("proposal_id"), F.concat(F.lit("e"), (F.col("o_custkey") % 7).cast("string")).alias("entity_id"), F.lit(1).alias("rank"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reason"))
    candidates = candidates.unionByName(candidates.withColumns({"rank": F.lit(2), "entity_id": F.lit("e8")}))
    entities = p.spark.range(9).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("Person "), F.col("id").cast("string")).alias("display_name"))
    rows = review.projected_proposals(proposals, mentions, lines.select(F.col("l_orderkey").alias("proposal_id"), "position", "evidence_id"), spans, candidates, entities)
    quotes = F.array_join(F.transform("evidence", lambda e: e["quote"]), " ")
    return rows.select("proposal_id", "surface", F.when(F.size("evidence") > 0, quotes).alias("quotes"), F.get("candidates", F.lit(0))["display_name"].alias("first_name"))


@query(
    "SELECT c_custkey AS mention_id, CASE WHEN c_custkey % 3 = 0 THEN 'none' WHEN c_custkey % 5 = 0 THEN 'automatic' ELSE 'ranked' END AS outcome, CASE WHEN c_custkey % 3 <> 0 THEN 'e' || c_custkey END AS entity_id FROM customer"
)
def person_outcomes(p):
    """Only persons are ever who a mention is: a third of the entities that have the name and the address are places."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "place").otherwise("person").alias("kind")
    entity, mail = F.concat(F.lit("e"), k).alias("entity_id"), F.concat(k.cast("string"), F.lit("@x.org")).alias("email")
    mentions = p["customer"].select(k.alias("mention_id"), F.lower("c_name").alias("name"), F.when(k % 5 == 0, mail).otherwise("").alias("email"))
    out = identity.resolve(mentions, p["customer"].select(entity, F.lower("c_name").alias("name"), F.lit(False).alias("is_alias"), kind), p["customer"].select(entity, mail, kind))
    return out.select("mention_id", "outcome", "entity_id")


@query(
    "SELECT 'm' || c_custkey AS mention_id, CASE c_custkey % 4 WHEN 0 THEN 'reused' WHEN 2 THEN 'waiting' ELSE 'ask' END AS state, CASE WHEN c_custkey % 2 = 0 THEN 'source' ELSE 'cited' END AS binding FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0"
)
def directory_pending(p):
    """Mentions that wait for the directory: with a fresh answer, with a retry that is not due, with an old answer or none;
    those decided, of runs not admitted, and of versions no longer current are none of them."""
    k, c = F.col("c_custkey"), p["customer"]
    name = lambda x: F.concat(F.lit(x), k)
    null, t = F.lit(None).cast("string"), ntz(A)
    ago = lambda days: t - F.expr(f"INTERVAL {days} DAYS")
    mail = F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@x.org"))
    admission = lambda kind, of: c.where("c_custkey % 11 <> 0" if kind == "extraction_run" else "true").select(F.concat(F.lit(kind), k).alias("id"), F.lit(kind).alias("target_kind"), name(of).alias("target_id"), F.lit("admitted").alias("outcome"), t.alias("recorded_at"), null.alias("supersedes_id"))
    lookups = c.where("c_custkey % 4 <> 3").select(name("m").alias("mention_id"), F.when(k % 4 == 2, "rate_limited").otherwise("matched").alias("outcome"), F.when(k % 4 == 0, ago(3)).otherwise(ago(90)).alias("attempted_at"), F.when(k % 4 == 2, t + F.expr("INTERVAL 1 HOUR")).alias("retry_after"))
    held = {
        "pointers": c.select(name("s").alias("source_id"), F.when(k % 13 == 0, name("w")).otherwise(name("v")).alias("version_id"), t.alias("recorded_at"), F.lit(0).cast("long").alias("seq")),
        "runs": c.select(name("r").alias("run_id"), name("v").alias("version_id"), F.lit("completed").alias("outcome")), "admissions": admission("extraction_run", "r").unionByName(admission("mention", "m")), "lookups": lookups,
        "mentions": c.select(name("m").alias("id"), name("q").alias("evidence_id"), name("r").alias("run_id"), F.col("c_name").alias("surface"), F.lower("c_name").alias("normalized_name"), mail.alias("proposed_email"), name("q").alias("email_evidence_id")),
        "proposals": c.select(name("m").alias("mention_id"), name("p").alias("proposal_id")), "spans": c.select(name("q").alias("evidence_id"), F.concat("c_name", F.lit(" <"), mail, F.when(k % 2 == 0, ">").otherwise("> wrote")).alias("quote")),
        "decisions": c.where("c_custkey % 7 = 0").select(name("d").alias("id"), name("p").alias("proposal_id"), t.alias("recorded_at"), null.alias("supersedes_id")),
    }
    return directory.pending(held, t, "30 DAYS").select("mention_id", "state", "binding")

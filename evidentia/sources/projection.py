"""Views that read the driver's tables as observations, evidence, decisions, admissions and entities.

The same text serves Spark and the SQL that results are held against; {S} is the engine's string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_obs": """
SELECT concat('obs:', CAST(event_id AS {S})) AS obs_id,
CASE WHEN event_id % 4 = 3 THEN 'mention' ELSE 'entity' END AS subject_kind,
CASE WHEN event_id % 4 = 3 THEN concat('men:', CAST(event_id AS {S})) ELSE concat('user:', CAST(user_id AS {S})) END AS subject_ref,
concat('attr.', CAST(event_id % 24 AS {S})) AS predicate,
'text' AS object_kind, event_type AS object_ref,
CASE WHEN event_id % 41 = 0 THEN 'unknown' WHEN event_id % 13 = 1 THEN 'window' WHEN event_id % 5 IN (0,1) THEN 'instant' ELSE 'interval' END AS temporal_kind,
CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 13 <> 1 AND event_id % 5 = 4 AND event_id % 3 = 0 THEN NULL ELSE ts END AS valid_start,
CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 13 = 1 THEN ts + INTERVAL '2' DAY WHEN event_id % 5 IN (0,1) THEN NULL WHEN event_id % 5 = 2 THEN ts + INTERVAL '3' DAY WHEN event_id % 5 = 3 THEN NULL WHEN event_id % 3 = 0 THEN ts + INTERVAL '1' DAY ELSE ts + INTERVAL '10' DAY END AS valid_end,
ts + INTERVAL '1' HOUR AS recorded_at,
CASE event_id % 29 WHEN 0 THEN 'hypothesized' WHEN 1 THEN 'rejected' WHEN 2 THEN 'inferred' WHEN 3 THEN 'validated_structurally' WHEN 4 THEN 'validated_empirically' ELSE 'observed' END AS status,
event_id, user_id, ts FROM events""",
    "fx_evidence": """
SELECT obs_id, concat('ev:', CAST(event_id AS {S})) AS evidence_id, 'supporting' AS role FROM fx_obs WHERE event_id % 31 <> 0
UNION ALL SELECT obs_id, concat('cx:', CAST(event_id AS {S})), 'contradicting' FROM fx_obs WHERE event_id % 31 = 0 OR event_id % 7 = 0""",
    "fx_decisions": """
SELECT concat('dec:', CAST(event_id AS {S}), ':0') AS id, concat('prop:', CAST(event_id AS {S})) AS proposal_id, concat('men:', CAST(event_id AS {S})) AS mention_id, 'accepted' AS outcome, concat('user:', CAST(user_id AS {S})) AS entity_id, ts + INTERVAL '2' HOUR AS recorded_at, CAST(NULL AS {S}) AS supersedes_id FROM fx_obs WHERE event_id % 4 = 3
UNION ALL SELECT concat('dec:', CAST(event_id AS {S}), ':1'), concat('prop:', CAST(event_id AS {S})), concat('men:', CAST(event_id AS {S})), 'accepted', concat('user:', CAST(user_id + 1 AS {S})), ts + INTERVAL '2' DAY, concat('dec:', CAST(event_id AS {S}), ':0') FROM fx_obs WHERE event_id % 8 = 3
UNION ALL SELECT concat('dec:', CAST(event_id AS {S}), ':2'), concat('prop:', CAST(event_id AS {S})), concat('men:', CAST(event_id AS {S})), 'rejected', CAST(NULL AS {S}), ts + INTERVAL '4' DAY, concat('dec:', CAST(event_id AS {S}), ':1') FROM fx_obs WHERE event_id % 16 = 3""",
    "fx_admissions": """
SELECT concat('adm:', obs_id, ':0') AS id, 'observation' AS target_kind, obs_id AS target_id, CASE WHEN event_id % 19 = 0 THEN 'quarantined' ELSE 'admitted' END AS outcome, recorded_at, CAST(NULL AS {S}) AS supersedes_id FROM fx_obs
UNION ALL SELECT concat('adm:', obs_id, ':1'), 'observation', obs_id, CASE WHEN event_id % 2 = 0 THEN 'retired' ELSE 'admitted' END, ts + INTERVAL '3' DAY, concat('adm:', obs_id, ':0') FROM fx_obs WHERE event_id % 19 = 0 OR event_id % 23 = 0
UNION ALL SELECT concat('adm:', subject_ref, ':0'), 'mention', subject_ref, 'admitted', recorded_at, CAST(NULL AS {S}) FROM fx_obs WHERE subject_kind = 'mention'
UNION ALL SELECT concat('adm:', id, ':0'), 'identity_decision', id, 'admitted', recorded_at, CAST(NULL AS {S}) FROM fx_decisions""",
    "fx_entities": """
SELECT concat('user:', CAST(user_id AS {S})) AS id, 'person' AS kind, concat('User ', CAST(user_id AS {S})) AS display_name, min(ts) - INTERVAL '1' DAY AS recorded_at FROM events GROUP BY user_id""",
    "fx_causal": """
SELECT o.obs_id, 'text' AS subject_kind, e.cause AS subject_ref, '{CAUSES}' AS predicate, o.object_kind, o.object_ref, o.temporal_kind, o.valid_start, o.valid_end, o.recorded_at, o.status, o.event_id, o.user_id, o.ts
FROM fx_obs o JOIN (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cause FROM events) e ON o.event_id = e.event_id
WHERE e.cause IS NOT NULL""",
    "fx_pairs": """
SELECT concat('rel:', CAST(event_id AS {S})) AS obs_id,
CASE WHEN event_id % 4 = 3 THEN 'mention' ELSE 'entity' END AS subject_kind,
CASE WHEN event_id % 4 = 3 THEN concat('men:', CAST(event_id AS {S})) ELSE concat('user:', CAST(user_id AS {S})) END AS subject_ref,
concat('rel.', event_type) AS predicate, 'entity' AS object_kind, concat('user:', CAST((user_id + event_id % 3) AS {S})) AS object_ref,
temporal_kind, valid_start, valid_end, recorded_at, status, event_id, user_id, ts
FROM (SELECT o.*, o.object_ref AS event_type FROM fx_obs o) o""",
}

#: Tables each view reads: driver tables, or views before it.
READS = {
    "fx_obs": ("events",),
    "fx_evidence": ("fx_obs",),
    "fx_decisions": ("fx_obs",),
    "fx_admissions": ("fx_obs", "fx_decisions"),
    "fx_entities": ("events",),
    "fx_causal": ("fx_obs", "events"),
    "fx_pairs": ("fx_obs",),
}


def view_sql(name: str, string: str) -> str:
    from evidentia.schema import CAUSES

    return VIEWS[name].replace("{S}", string).replace("{CAUSES}", CAUSES).strip()


class Projection:
    """The views over one folder of driver tables; each is made once and lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name not in VIEWS:
                self._made[name] = self.table(name)
            else:
                sql, reads = view_sql(name, "STRING"), READS[name]
                for r in reads:
                    sql = sql.replace(f"FROM {r}", f"FROM {{{r}}} AS {r}").replace(f"AS {r} o", "AS o").replace(f"AS {r} ON", f"AS {r}x ON")
                self._made[name] = self.spark.sql(sql, **{r: self[r] for r in reads})
        return self._made[name]


def with_views(*names: str) -> str:
    """`WITH RECURSIVE` and the views (with those that they read) as common table expressions for DuckDB."""
    order: list[str] = []

    def add(name):
        for r in READS.get(name, ()):
            add(r)
        if name in VIEWS and name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({view_sql(n, 'VARCHAR')})" for n in order)

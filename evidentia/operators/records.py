"""Sources, sections, reviewer read models, write sets, and the ingest lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.evidence import frame
from evidentia.operators.authority import admitted, effective
from evidentia.plans.lineage import cut


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """Depth-first rows of forests (doc_id, id, parent_id, position, title): path of titles, depth, order in the document.

    Each round doubles how much of its path a row holds, so a tree of depth n takes log2(n) joins, whatever its
    size; then a document's rows are put in order by their places from the root down. Nodes that reach no root
    (their parent is missing, or they form a ring) are left out.
    """
    start = nodes.select("doc_id", "id", F.col("parent_id").alias("at"), F.array("title").alias("path"), F.array("position").alias("places"))
    ways = cut(start)
    largest = nodes.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = int(largest).bit_length() + 1  # a longer way than a document has nodes runs in a ring
    while rounds and not ways.where("at is not null").isEmpty():
        up = ways.select("doc_id", F.col("id").alias("at"), F.col("at").alias("next"), F.col("path").alias("head"), F.col("places").alias("first"))
        moved = ways.where("at is not null").join(up, ["doc_id", "at"])
        moved = moved.select("doc_id", "id", F.col("next").alias("at"), F.concat("head", "path").alias("path"), F.concat("first", "places").alias("places"))
        ways = cut(ways.where("at is null").unionByName(moved))
        rounds -= 1
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("places")) - 1
    return ways.where("at is null").select("doc_id", "id", "path", (F.size("path") - 1).alias("depth"), order.alias("section_order"))


def merged_documents(listed: DataFrame, fetched: DataFrame) -> DataFrame:
    """What is known of each listed document after it was read, with `fault`: missing (it was not read), provider (the two
    disagree), or NULL.

    Both: (doc_id, provider, title, source_time, locator, provider_version, modified_at), fetched with content. Title
    and its date come from one of the two, the read one if it has a title; locator and provider are the read ones
    where there are any; version and time of change are the listed ones where there are any.
    """
    new = fetched.select("doc_id", F.struct(*(c for c in fetched.columns if c != "doc_id")).alias("f"))
    rows = listed.select("doc_id", F.struct(*(c for c in listed.columns if c != "doc_id")).alias("l")).join(new, "doc_id", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own = lambda name, first, then: F.when(blank(f"{first}.{name}"), F.col(f"{then}.{name}")).otherwise(F.col(f"{first}.{name}")).alias(name)
    titled = F.when(blank("f.title"), F.struct("l.title", "l.source_time")).otherwise(F.struct("f.title", "f.source_time"))
    fault = F.when(F.col("f").isNull(), "missing").when(~blank("l.provider") & ~blank("f.provider") & (F.col("l.provider") != F.col("f.provider")), "provider")
    return rows.withColumn("t", titled).select(
        "doc_id", own("provider", "f", "l"), "t.title", "t.source_time", own("locator", "f", "l"), own("provider_version", "l", "f"), F.coalesce("l.modified_at", "f.modified_at").alias("modified_at"), "f.content", fault.alias("fault"),
    )


def section_fault(roles: tuple[str, ...] | None = None) -> Column:
    """What is wrong with a section (section_id, title, role, section_order, path, content), else NULL: its id, title, role
    and titles of its path are not blank, its order is not negative, its text is valid UTF-8, its role one of `roles`."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    among = F.lit(True) if roles is None else F.col("role").isin(*roles)
    return (
        F.when(blank("section_id"), "no-id").when(blank("title"), "no-title").when(blank("role") | ~F.coalesce(among, F.lit(False)), "role").when(F.coalesce(F.col("section_order") < 0, F.lit(True)), "order")
        .when(F.exists(F.coalesce("path", F.array().cast("array<string>")), lambda x: x.isNull() | (F.trim(x) == "")), "path").when(~F.is_valid_utf8(F.coalesce("content", F.lit(""))), "not-utf8")
    )


def row_digest(columns: list[str]) -> Column:
    """A digest of the named columns, whatever their order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def append_once(existing: DataFrame, new: DataFrame, key: str | list[str], stored: str = "row_digest") -> DataFrame:
    """New rows with `verdict`: append, replay (an equal row exists), conflict (the key exists with other content), or
    no-key (a column of the key is null).

    key: one column or several. Rows that repeat a key among the new ones: the first in order of content is
    judged, equal ones are replays, different ones conflicts. Only the existing rows of the new keys are looked
    at; where existing or new have a column `stored` it is taken for their digest, else it is made.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in new.columns if c not in (*keys, stored)] or keys
    old = existing.join(new.select(*keys).distinct(), keys, "left_semi")
    old = old.select(*keys, (F.col(stored) if stored in existing.columns else row_digest(rest)).alias("_old"))
    by = Window.partitionBy(*keys)
    rows = new.withColumn("_body", F.col(stored) if stored in new.columns else row_digest(rest))
    rows = rows.withColumn("_rank", F.row_number().over(by.orderBy("_body"))).withColumn("_first", F.min("_body").over(by))
    rows = rows.join(old, keys, "left")
    held = F.coalesce("_old", "_first")
    none = F.lit(False)
    for k in keys:
        none |= F.col(k).isNull()
    verdict = F.when(none, "no-key").when(F.col("_body") != held, "conflict").when(F.col("_old").isNotNull() | (F.col("_rank") > 1), "replay").otherwise("append")
    return rows.select(*new.columns, verdict.alias("verdict"))


def current_versions(pointers: DataFrame, cutoff=None) -> DataFrame:
    """(source_id, version_id): where each source's pointer stands; pointers are only appended, the last one holds.

    pointers: (source_id, version_id, recorded_at, seq); of one time the highest seq is the last.
    """
    rows = pointers if cutoff is None else pointers.where(F.col("recorded_at") <= F.lit(cutoff).cast("timestamp_ntz"))
    return rows.groupBy("source_id").agg(F.max_by("version_id", F.struct("recorded_at", "seq")).alias("version_id"))


def pending_proposals(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    return proposals.join(decisions.select("proposal_id").distinct(), "proposal_id", "left_anti")


def eligible_proposals(proposals: DataFrame, mentions: DataFrame, admissions: DataFrame, completed_runs: DataFrame, current_versions: DataFrame) -> DataFrame:
    """Proposals whose run is completed, version current, and run and mention effectively admitted."""
    rows = proposals.join(mentions, "mention_id")
    rows = rows.join(completed_runs.select("run_id").distinct(), "run_id", "left_semi").join(current_versions.select("version_id").distinct(), "version_id", "left_semi")
    rows = rows.join(admitted(admissions, "extraction_run").select(F.col("id").alias("run_id")), "run_id", "left_semi")
    return rows.join(admitted(admissions, "mention").select(F.col("id").alias("mention_id")), "mention_id", "left_semi")


def effective_aliases(aliases: DataFrame, decisions: DataFrame) -> DataFrame:
    """(entity_id, kind, value) once each, of alias assertions that an effective accepted decision owns."""
    tails = effective(decisions).where("outcome = 'accepted'").select(F.col("id").alias("decision_id"), "entity_id")
    return aliases.join(tails, "decision_id").select("entity_id", "kind", "value").distinct()


def first_seen(df: DataFrame, by: str, item: str, position: str) -> DataFrame:
    """Distinct items of a group in the order in which they first appear."""
    one = df.groupBy(by, item).agg(F.min(position).alias(position))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(position, item)) - 1).drop(position)


def write_set(*tables: tuple[str, DataFrame, list[str]]) -> DataFrame:
    """One row per entry of a write set: its group and framed bytes (the table's name, then the columns as text)."""
    out = None
    for name, df, (group, *cols) in ((n, d, c) for n, d, c in tables):
        rows = df.select(F.col(group).cast("string").alias("group"), F.concat(frame(F.lit(name)), *(frame(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols)).alias("entry"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_set_faults(write: dict[str, DataFrame]) -> DataFrame:
    """References of a write set that lead nowhere, and ids given twice: (table, id, fault)."""

    def dangling(child, column, parent, key):
        rows = write[child].where(F.col(column).isNotNull())
        rows = rows.join(write[parent].select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")
        return rows.select(F.lit(child).alias("table"), F.col("id").cast("string").alias("id"), F.concat(F.lit("no "), F.lit(parent)).alias("fault"))

    out = dangling("mentions", "evidence_id", "evidence", "id").unionByName(dangling("observations", "evidence_id", "evidence", "id")).unionByName(dangling("proposals", "mention_id", "mentions", "id"))
    for name, df in write.items():
        twice = df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(twice.select(F.lit(name).alias("table"), F.col("id").cast("string").alias("id"), F.lit("twice").alias("fault")))
    return out


def initial_admissions(targets: DataFrame, kind: str, policy: str, at) -> DataFrame:
    """One deterministic policy admission per target."""
    target = F.col("id").cast("string")
    return targets.select(
        F.sha2(F.concat(frame(F.lit(policy)), frame(F.lit(kind)), frame(target)), 256).alias("id"), F.lit(kind).alias("target_kind"), target.alias("target_id"),
        F.lit("admitted").alias("outcome"), F.lit("policy").alias("authority"), at.alias("recorded_at"),
    )


def ledger_status(expected: DataFrame, applied: DataFrame, fingerprint_ok: bool) -> DataFrame:
    """absent, checksum_mismatch, pending, schema_drift or current, in this order; both: (position, name, checksum)."""
    a = applied.select("position", F.col("name").alias("a_name"), F.col("checksum").alias("a_sum"), F.lit(1).alias("a"))
    both = expected.join(a, "position", "full_outer")
    one = both.agg(
        F.sum("a").alias("n"), F.max(F.when(F.col("a").isNotNull() & (F.col("name").isNull() | (F.col("name") != F.col("a_name")) | (F.col("checksum") != F.col("a_sum"))), 1).otherwise(0)).alias("bad"),
        F.max(F.when(F.col("a").isNull(), 1).otherwise(0)).alias("open"),
    )
    return one.select(
        F.when(F.col("n").isNull(), "absent").when(F.col("bad") == 1, "checksum_mismatch").when(F.col("open") == 1, "pending")
        .when(~F.lit(fingerprint_ok), "schema_drift").otherwise("current").alias("status")
    )


def schema_fingerprint(*frames: DataFrame) -> str:
    """A digest of the tables' schemas whatever their order."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(f.schema.json() for f in frames)).encode()).hexdigest()

"""Documents and statements as stored: structural text, digests over whole records, shape rules, term and extent codecs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.evidence import BYTES, FLAG, NUMBER, TIME, digest, float_bits, frame, opaque_id
from evidentia.functions.timeaxis import micros
from evidentia.operators.records import flatten_tree

#: Forms of a stored term (fixed values), and which of its four columns each holds.
STORED_TERMS = {"absent": (), "text": ("text",), "mention": ("mention_id",), "entity": ("entity_id",), "grounded_entity": ("entity_id", "grounding_mention_id")}
TERM_COLUMNS = ("text", "mention_id", "entity_id", "grounding_mention_id")


def _blank(column: Column) -> Column:
    return column.isNull() | (F.trim(column) == "")


def _text(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return frame(F.coalesce(c.cast("string"), F.lit("")))


def _maybe(column: Column, framed: Column) -> Column:
    """A flag whether there is a value, then the value if so."""
    return F.when(column.isNull(), frame(F.lit(False), FLAG)).otherwise(F.concat(frame(F.lit(True), FLAG), framed))


def structural_text(elements: DataFrame) -> DataFrame:
    """(doc_id, text): the runs of each element tree (doc_id, id, parent_id, position, text), depth first.

    Paragraphs, tables, rows, cells and contents are elements without a text; a document without runs has ''.
    """
    walked = flatten_tree(elements.withColumnRenamed("text", "title"))
    run = F.struct("section_order", F.coalesce(F.element_at("path", -1), F.lit("")).alias("run"))
    runs = F.transform(F.array_sort(F.collect_list(run)), lambda x: x["run"])
    return walked.groupBy("doc_id").agg(F.array_join(runs, "").alias("text"))


def transcripts(sections: DataFrame) -> DataFrame:
    """(doc_id, n_transcripts, accepted): a document is taken only with exactly one transcript."""
    n = sections.groupBy("doc_id").agg(F.count_if(F.col("role") == "transcript").alias("n_transcripts"))
    return n.withColumn("accepted", F.col("n_transcripts") == 1)


def version_records(versions: DataFrame, sections: DataFrame) -> DataFrame:
    """(version_id, digest, fault) of each document version.

    versions: (version_id, provider, provider_id, title, locator, provider_version, modified_at, source_time);
    sections: (version_id, section_id, title, parent_id, path, section_order, role, content). The digest covers
    what the source says (sections in order, contents by their hash), neither the provider's ids nor the time of
    recording. fault: provenance, no-sections, section-ids, or NULL; a faulty version has no digest. Sections may
    have `content_hash` instead of their content.
    """
    leaf = section_leaf(F.col("content_hash")) if "content_hash" in sections.columns else section_leaf()
    own = sections.select("version_id", "section_id", F.struct("section_order", leaf.alias("e")).alias("s"))
    held = own.groupBy("version_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["e"]), "").alias("entries"), F.count("*").alias("n"),
        (F.size(F.collect_set("section_id")) + F.max(F.when(_blank(F.col("section_id")), -1).otherwise(0))).alias("ids"),
    )
    rows = versions.join(held, "version_id", "left")
    lacks = F.col("modified_at").isNull()
    for c in ("provider", "provider_id", "title", "locator", "provider_version"):
        lacks |= _blank(F.col(c))
    fault = F.when(lacks, "provenance").when(F.col("n").isNull(), "no-sections").when(F.col("ids") != F.col("n"), "section-ids")
    return rows.select("version_id", F.when(fault.isNull(), version_root()).alias("digest"), fault.alias("fault"))


def content_hash(content: Column | str = "content") -> Column:
    return F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256)


def section_leaf(content: Column | None = None, of: Callable[[str], Column] = F.col) -> Column:
    """The digest of a section: its place and titles, and its content by its hash. A version's digest is over its leaves.

    of: a section's column by its name, where it is not one of the frame's.
    """
    content = content_hash() if content is None else content
    path = F.concat(frame(F.size(of("path")).cast("long"), NUMBER), F.aggregate(of("path"), F.lit(b""), lambda a, x: F.concat(a, frame(x))))
    return F.sha2(F.concat(_text(of("section_id")), _text(of("title")), _text(of("parent_id")), path, frame(of("section_order"), NUMBER), _text(of("role")), frame(content)), 256)


def version_root(of: Callable[[str], Column] = F.col) -> Column:
    """A version's digest from its own columns and (n, entries): its leaves in order, joined. of: as in section_leaf()."""
    return digest(
        *(_text(F.trim(of(c))) for c in ("title", "locator", "provider_version")), frame(micros(of("modified_at")), TIME),
        _maybe(of("source_time"), frame(micros(of("source_time")), TIME)), frame(of("n"), NUMBER), frame(of("entries")),
    )


def version_faults(versions: DataFrame, leaves: DataFrame) -> DataFrame:
    """(version_id, fault) of versions whose digest is not that of their columns and leaves: version-digest.

    leaves: (version_id, section_order, leaf), of all sections of these versions: 64 characters each, whatever the
    sections hold. So what cites one section of a version is proved by that section's content and the others' leaves.
    """
    held = leaves.groupBy("version_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_order", "leaf"))), lambda x: x["leaf"]), "").alias("entries"), F.count("*").alias("n"))
    rows = versions.join(held, "version_id", "left")
    return rows.where(~F.col("digest").eqNullSafe(version_root())).select("version_id", F.lit("version-digest").alias("fault"))


def revision(provider, provider_id, provider_version, observed_at) -> tuple[Column, Column]:
    """(id, digest) of the sight of a source revision: the id does not depend on the time, the digest does."""
    own = opaque_id(F.lit("revision"), provider, provider_id, provider_version)
    return own, digest(frame(own), frame(micros(observed_at), TIME))


def derivation_fault(method: Column, version: Column, model: Column, prompt_version: Column) -> Column:
    """A derivation names its method and version; it names a model exactly if it names a prompt's version."""
    return F.when(_blank(method), "no-method").when(_blank(version), "no-version").when(_blank(model) != _blank(prompt_version), "model-without-prompt")


def derivation_digest(version_id, config: dict[str, Column]) -> Column:
    """What was derived, and how: a version with the settings of its extraction, in order of their names."""
    return digest(frame(version_id), *(f for k in sorted(config) for f in (frame(F.lit(k)), _text(config[k]))))


def encode_term(kind: Column, ref: Column, grounding: Column) -> Column:
    """A term (kind, ref, grounding mention) as its five stored columns; NULL if its shape is wrong."""
    stored = F.when((kind == "entity") & grounding.isNotNull(), "grounded_entity").otherwise(kind)
    wrong = (kind == "absent") & ref.isNotNull() | (kind != "absent") & _blank(ref) | (kind != "entity") & grounding.isNotNull() | grounding.isNotNull() & _blank(grounding)
    term = F.struct(
        stored.alias("kind"), F.when(kind == "text", ref).alias("text"), F.when(kind == "mention", ref).alias("mention_id"),
        F.when(kind == "entity", ref).alias("entity_id"), F.when(kind == "entity", grounding).alias("grounding_mention_id"),
    )
    return F.when(kind.isin("absent", "text", "mention", "entity") & ~F.coalesce(wrong, F.lit(True)), term)


def decode_term(stored: Column) -> Column:
    """(kind, ref, grounding) of five stored columns; NULL unless exactly the columns of its kind hold something."""
    shape = F.lit(False)
    for kind, holds in STORED_TERMS.items():
        same = stored["kind"] == kind
        for c in TERM_COLUMNS:
            same &= ~_blank(stored[c]) if c in holds else stored[c].isNull()
        shape |= same
    ref = F.coalesce(stored["text"], stored["mention_id"], stored["entity_id"])
    kind = F.when(stored["kind"] == "grounded_entity", "entity").otherwise(stored["kind"])
    return F.when(F.coalesce(shape, F.lit(False)), F.struct(kind.alias("kind"), ref.alias("ref"), stored["grounding_mention_id"].alias("grounding")))


def extent_fault(kind: Column, start: Column, end: Column) -> Column:
    """What is wrong with a valid-time extent, else NULL."""
    none, both = start.isNull() & end.isNull(), start.isNotNull() & end.isNotNull()
    return (
        F.when(kind.isNull() | ~kind.isin("unknown", "instant", "interval", "window"), "kind")
        .when((kind == "unknown") & ~none, "bounds-of-unknown").when((kind == "instant") & (start.isNull() | end.isNotNull()), "instant")
        .when((kind == "interval") & none, "no-bound").when((kind == "window") & ~both, "open-window").when(both & (end <= start), "not-after")
    )


def encode_extent(kind: Column, start: Column, end: Column) -> Column:
    """An extent as (kind, instant, start, end); NULL if it has a fault."""
    at = kind == "instant"
    return F.when(extent_fault(kind, start, end).isNull(), F.struct(kind.alias("kind"), F.when(at, start).alias("instant"), F.when(~at, start).alias("start"), F.when(~at, end).alias("end")))


def decode_extent(stored: Column) -> Column:
    """(kind, start, end) of a stored extent; NULL if columns of another kind hold something or it has a fault."""
    at = stored["kind"] == "instant"
    start = F.coalesce(stored["instant"], stored["start"])
    ok = (stored["instant"].isNotNull() == at) & (~at | stored["start"].isNull()) & extent_fault(stored["kind"], start, stored["end"]).isNull()
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(stored["kind"].alias("kind"), start.alias("start"), stored["end"].alias("end")))


def observation_records(observations: DataFrame, links: DataFrame) -> DataFrame:
    """(obs_id, digest, fault): a statement's digest leaves out its id and takes its links in order.

    observations as in schema.OBSERVATION with method, version, run_id, model, prompt_version and confidence;
    fault: term, extent, no-evidence, evidence-twice, one of derivation_fault, confidence, or NULL.
    """
    pair = F.concat(frame("evidence_id"), frame("role"))
    own = links.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "role", F.hex(pair).alias("p")))).alias("links"))
    own = own.select("obs_id", F.size("links").cast("long").alias("n"), F.size(F.array_distinct("links")).alias("d"), F.unhex(F.array_join(F.transform("links", lambda x: x["p"]), "")).alias("pairs"))
    rows = observations.join(own, "obs_id", "left")
    none = F.lit(None).cast("string")
    terms = [encode_term(F.col(f"{side}_kind"), F.col(f"{side}_ref"), none) for side in ("subject", "object")]
    c = F.col("confidence")
    fault = (
        F.when(terms[0].isNull() | terms[1].isNull(), "term").when(extent_fault(F.col("temporal_kind"), F.col("valid_start"), F.col("valid_end")).isNotNull(), "extent")
        .when(F.col("n").isNull(), "no-evidence").when(F.col("n") != F.col("d"), "evidence-twice")
        .otherwise(F.coalesce(derivation_fault(F.col("method"), F.col("version"), F.col("model"), F.col("prompt_version")), F.when(F.isnan(c) | (c < 0) | (c > 1), "confidence")))
    )
    made = digest(
        *(_text(x) for x in ("subject_kind", "subject_ref", "predicate", "object_kind", "object_ref", "temporal_kind")),
        _maybe(F.col("valid_start"), frame(micros("valid_start"), TIME)), _maybe(F.col("valid_end"), frame(micros("valid_end"), TIME)), frame(micros("recorded_at"), TIME),
        frame("n", NUMBER), F.col("pairs"), *(_text(x) for x in ("method", "version", "run_id", "model", "prompt_version", "status")), _maybe(c, frame(float_bits(c), BYTES)),
    )
    return rows.select("obs_id", F.when(fault.isNull(), made).alias("digest"), fault.alias("fault"))


def digest_conflicts(stored: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Keys whose stored digest is not the one derived again from the row, or that no row can be derived for."""
    again = derived.select(F.col(key).alias("_k"), F.col("digest").alias("_again"))
    return stored.join(again, F.col(key) == F.col("_k"), "left").where(~F.col("digest").eqNullSafe(F.col("_again"))).select(key)


def entity_listing(entities: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities by (display name, id): id, display_name, aliases in order, n_mentions.

    aliases: (entity_id, kind, value); mentions: (entity_id, mention_id), repeats count once.
    """
    named = aliases.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "value"))).alias("aliases"))
    met = mentions.groupBy("entity_id").agg(F.count_distinct("mention_id").alias("n_mentions"))
    rows = entities.join(named, F.col("id") == named["entity_id"], "left").join(met, F.col("id") == met["entity_id"], "left")
    empty = F.array().cast("array<string>")
    return rows.select("id", "display_name", F.coalesce("aliases", empty).alias("aliases"), F.coalesce("n_mentions", F.lit(0)).alias("n_mentions")).orderBy("display_name", "id")


def profile_email(emails: DataFrame) -> DataFrame:
    """(subject_id, email): each profile's primary address, else its first; emails: (subject_id, email, is_primary, position)."""
    return emails.groupBy("subject_id").agg(F.min_by("email", F.struct(~F.col("is_primary"), "position", "email")).alias("email"))

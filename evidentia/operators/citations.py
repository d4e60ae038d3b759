"""Exact evidence: links with the bytes, section, version and source that they cite, and whether these hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.evidence import span_fault
from evidentia.functions.order import CITATION
from evidentia.operators.authority import known_by
from evidentia.operators.documents import version_faults
from evidentia.operators.seals import own_faults


def cited_sections(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """The sections of the versions that any of the spans cites."""
    return sections.join(spans.select("version_id").distinct(), "version_id", "left_semi")


def citations(links: DataFrame, spans: DataFrame, versions: DataFrame, sections: DataFrame, sources: DataFrame | None = None, cutoff=None) -> DataFrame:
    """obs_id and the columns of order.CITATION for each link whose span, version and source are known by the cutoff.

    links: (obs_id, evidence_id, role); spans, versions, sections, sources as in schema. Start from few links: the
    spans and versions are met by key, and only the sections that are cited lend their columns.
    """
    known = known_by(versions, cutoff).select("version_id", "source_id", "locator")
    if sources is not None:
        known = known.join(known_by(sources, cutoff).select("source_id"), "source_id", "left_semi")
    own = known_by(spans, cutoff).select("evidence_id", "version_id", "section_id", "start_byte", "end_byte", "quote")
    held = sections.select("version_id", "section_id", "section_order", F.col("title").alias("section_title"), F.col("path").alias("section_path"), F.col("role").alias("section_role"))
    rows = links.select("obs_id", "evidence_id", "role").join(own, "evidence_id").join(known, "version_id").join(held, ["version_id", "section_id"], "left")
    return rows.select("obs_id", *CITATION)


def span_faults(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """(evidence_id, fault) of spans that don't quote their section: no-section, out-of-range, inside-character or quote-differs."""
    rows = spans.join(sections.select("version_id", "section_id", "content"), ["version_id", "section_id"], "left")
    wrong = span_fault(F.col("content"), F.col("start_byte"), F.col("end_byte"), F.col("quote"))
    return rows.select("evidence_id", F.when(F.col("content").isNull(), "no-section").otherwise(wrong).alias("fault")).where("fault is not null")


def proof_faults(links: DataFrame, spans: DataFrame, versions: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, fault) of what the links cite and that does not hold down to its bytes.

    A span must quote its section, a section give the leaf that is stored for it, and a version's digest follow from
    its columns and all its leaves. Only the cited sections' contents are read; of a version's other sections their
    leaves, 64 characters each. sections: with `leaf`. Each frame is read several times: start from cut ones.
    """
    own = spans.join(links.select("evidence_id").distinct(), "evidence_id", "left_semi")
    cited = sections.join(own.select("version_id", "section_id").distinct(), ["version_id", "section_id"], "left_semi")
    ids = own.select("version_id").distinct()
    leaves = sections.select("version_id", "section_order", "leaf").join(ids, "version_id", "left_semi")
    out = span_faults(own, cited).select(F.col("evidence_id").alias("id"), "fault")
    out = out.unionByName(own_faults(cited, "sections", ["version_id", "section_id"]).select(F.concat_ws("/", "version_id", "section_id").alias("id"), "fault"))
    return out.unionByName(version_faults(versions.join(ids, "version_id", "left_semi"), leaves).select(F.col("version_id").alias("id"), "fault"))


def link_faults(links: DataFrame, cited: DataFrame) -> DataFrame:
    """(obs_id, evidence_id, role, fault): links without a citation, citations without a link, and evidence that is told
    in two ways. Both sides must match one to one."""
    pair = ["obs_id", "evidence_id", "role"]
    both = links.select(*pair, F.lit(1).alias("l"), F.lit(0).alias("c")).unionByName(cited.select(*pair, F.lit(0).alias("l"), F.lit(1).alias("c")))
    n = both.groupBy(*pair).agg(F.sum("l").alias("l"), F.sum("c").alias("c"))
    unknown = F.greatest(*(F.col(k).isNull() for k in pair))  # what has no name is nobody's match
    alone = lambda one, other, fault: F.array_repeat(F.lit(fault), F.when(unknown | (F.col(other) == 0), F.col(one)).otherwise(0).cast("int"))
    out = n.where(unknown | (F.col("l") == 0) | (F.col("c") == 0)).select(*pair, F.explode(F.concat(alone("l", "c", "uncited"), alone("c", "l", "unlinked"))).alias("fault"))
    # of what is told, 120 bits of its digest: numbers are aggregated in place, rows would be sorted whole
    told = F.sha2(F.to_json(F.struct(*(c for c in CITATION if c not in ("evidence_id", "role")))), 256)
    parts = [F.conv(F.substring(told, at, 15), 16, 10).cast("long").alias(name) for name, at in (("x", 1), ("y", 16))]
    ways = cited.select("evidence_id", *parts).groupBy("evidence_id").agg(F.min("x").alias("x"), F.max("x").alias("x2"), F.min("y").alias("y"), F.max("y").alias("y2")).where("x <> x2 OR y <> y2")
    null = F.lit(None).cast("string")
    return out.unionByName(ways.select(null.alias("obs_id"), "evidence_id", null.alias("role"), F.lit("told-twice").alias("fault")))

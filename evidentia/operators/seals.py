"""Digests of stored rows: made when rows are stored, held against their content when an answer rests on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.evidence import NUMBER, TIME, digest, frame
from evidentia.functions.timeaxis import micros
from evidentia.operators.authority import ADMISSION_DIGEST, RESOLUTION_DIGEST, decision_digest
from evidentia.operators.documents import _maybe, _text, section_leaf
from evidentia.schema import OBSERVATION

#: Tables whose rows have a digest of their own columns, and the column that holds it.
OWN = {"decisions": "digest", "admissions": "digest", "sections": "leaf"}
#: The same with observations, whose digest takes their links too.
SEALS = OWN | {"observations": "digest"}
_STATED = [f.name for f in OBSERVATION.fields if f.name not in ("obs_id", "valid_start", "valid_end", "recorded_at")]


def _own(name: str):
    return {"decisions": lambda: decision_digest(*RESOLUTION_DIGEST), "admissions": lambda: decision_digest(*ADMISSION_DIGEST), "sections": section_leaf}[name]()


def observation_digests(observations: DataFrame, links: DataFrame) -> DataFrame:
    """observations with `_made`: the digest of what each states, when, and of its links in order; its id is not part.

    A link that comes or goes later changes it, so an observation is stored with all its links.
    """
    pair = F.hex(F.concat(frame("evidence_id"), frame("role")))
    own = links.groupBy("obs_id").agg(F.sort_array(F.collect_set(pair)).alias("_pairs"))
    rows = observations.join(own, "obs_id", "left")
    pairs = F.coalesce("_pairs", F.array().cast("array<string>"))
    made = digest(
        *(_text(c) for c in _STATED), *(_maybe(F.col(c), frame(micros(c), TIME)) for c in ("valid_start", "valid_end")), frame(micros("recorded_at"), TIME),
        frame(F.size(pairs).cast("long"), NUMBER), F.unhex(F.array_join(pairs, "")),
    )
    return rows.withColumn("_made", made).drop("_pairs")


def sealed(tables: dict[str, DataFrame], held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The frames with the digests that they lack; held: the stored tables, for links that are stored already."""
    out = dict(tables)
    for name, column in OWN.items():
        if name in out and column not in out[name].columns:
            out[name] = out[name].withColumn(column, _own(name))
    if "observations" in out and "digest" not in out["observations"].columns:
        ids = out["observations"].select("obs_id").distinct()
        links = held["links"].join(ids, "obs_id", "left_semi").select("obs_id", "evidence_id", "role") if "links" in held else None
        if "links" in out:
            own = out["links"].select("obs_id", "evidence_id", "role")
            links = own if links is None else links.unionByName(own)
        out["observations"] = observation_digests(out["observations"], links).withColumnRenamed("_made", "digest") if links is not None else out["observations"]
    return out


def own_faults(rows: DataFrame, name: str, key: list[str]) -> DataFrame:
    """(key, fault) of rows whose digest is not that of their columns."""
    return rows.where(~F.col(OWN[name]).eqNullSafe(_own(name))).select(*key, F.lit(f"{name}-digest").alias("fault"))


def observation_faults(observations: DataFrame, links: DataFrame) -> DataFrame:
    """(obs_id, fault) of observations whose digest is not that of their columns and links."""
    rows = observation_digests(observations, links)
    return rows.where(~F.col("digest").eqNullSafe(F.col("_made"))).select("obs_id", F.lit("observation-digest").alias("fault"))

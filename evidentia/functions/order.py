"""Total orders of results, as lists of columns for orderBy and array_sort; ids and texts compare by their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.schema import EXTENT_KINDS, TERM_KINDS


def _place(kind, kinds: tuple[str, ...]) -> Column:
    """A kind's place in its closed set, which is its rank; a kind of no set comes first."""
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.array_position(F.array(*map(F.lit, kinds)), c)


def term_order(kind: str, ref: str) -> list[Column]:
    """Absent, text, mention, entity; then the content."""
    return [_place(kind, TERM_KINDS).asc_nulls_first(), F.col(ref).asc_nulls_first()]


def key_order(prefix: str = "") -> list[Column]:
    """State keys: the subject, then the predicate."""
    return [*term_order(f"{prefix}subject_kind", f"{prefix}subject_ref"), F.col(f"{prefix}predicate")]


def value_order(prefix: str = "") -> list[Column]:
    return term_order(f"{prefix}object_kind", f"{prefix}object_ref")


def extent_order(prefix: str = "") -> list[Column]:
    """Unknown, instant, interval, window; a bound that is there comes before one that is not."""
    return [_place(f"{prefix}temporal_kind", EXTENT_KINDS), F.col(f"{prefix}valid_start").asc_nulls_last(), F.col(f"{prefix}valid_end").asc_nulls_last()]


def contribution_order() -> list[Column]:
    """An observation's place among the contributions of a fact."""
    return [F.col("obs_id"), F.col("status"), *extent_order(), F.col("recorded_at"), F.col("subject_grounding").asc_nulls_first(), F.col("object_grounding").asc_nulls_first()]


#: Columns of a citation in their order of comparison.
CITATION = ("source_id", "version_id", "section_order", "section_id", "start_byte", "end_byte", "evidence_id", "role", "section_title", "section_path", "section_role", "locator", "quote")


def citation_order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in CITATION]


def citation_struct() -> Column:
    """A citation whose natural order is the order of citations."""
    return F.struct(*CITATION)

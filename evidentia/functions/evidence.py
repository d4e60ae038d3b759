"""Digests, byte spans and codecs as Column expressions."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from evidentia.schema import SIGNAL_CATEGORIES, SIGNAL_DIRECTIONS

#: Tags of framed fields (fixed values): text, bytes, number, flag, time.
TEXT, BYTES, NUMBER, FLAG, TIME = 1, 2, 3, 4, 5
INTERACTION = "evidentia.interaction"
NAMESPACE = uuid.NAMESPACE_OID


def _long(column: Column) -> Column:
    return F.unhex(F.lpad(F.hex(column.cast("long")), 16, "0"))


def frame(column, tag: int = TEXT) -> Column:
    """Tag, length as 8 big-endian bytes, payload: fields so framed cannot run into each other."""
    c = F.col(column) if isinstance(column, str) else column
    if tag == TEXT:
        raw = c.cast("binary")
    elif tag == BYTES:
        raw = c
    elif tag == FLAG:
        raw = F.when(c, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    else:
        raw = _long(c)
    return F.concat(F.unhex(F.lit(f"{tag:02X}")), _long(F.octet_length(raw)), raw)


def digest(*framed: Column) -> Column:
    """Lower-case hex SHA-256 over framed fields."""
    return F.sha2(F.concat(*framed), 256)


def opaque_id(*parts) -> Column:
    """A stable id from the framed parts."""
    return digest(*(frame(p) for p in parts))


def byte_slice(text, start, end) -> Column:
    """Bytes [start, end) of the text's UTF-8."""
    return F.substring(text.cast("binary"), start + 1, end - start)


def on_boundary(text, offset) -> Column:
    """Whether a byte offset is not inside a character (both ends of the text count)."""
    raw = text.cast("binary")
    lead = F.hex(F.substring(raw, offset + 1, F.lit(1))).substr(1, 1)
    return (offset == 0) | (offset == F.octet_length(raw)) | ~lead.isin("8", "9", "A", "B")


def span_fault(text, start, end, quote) -> Column:
    """NULL for a valid span, else what is wrong with it."""
    return (
        F.when((start < 0) | (end <= start) | (end > F.octet_length(text.cast("binary"))), "out-of-range")
        .when(~on_boundary(text, start) | ~on_boundary(text, end), "inside-character")
        .when(byte_slice(text, start, end) != quote.cast("binary"), "quote-differs")
    )


def locate_unique(text, quote) -> Column:
    """Byte offset of a quote that occurs exactly once, else NULL."""
    at = F.instr(text, quote)
    again = F.locate(quote, text, at + 1)
    return F.when((at > 0) & (again == 0) & (F.length(quote) > 0), F.octet_length(F.substring(text, F.lit(1), at - 1)).cast("long"))


def set_digest(df: DataFrame, by: list[str], entry: Column, name: str = "digest", buckets: int = 256) -> DataFrame:
    """A digest of each group's entries whatever their order: entries are hashed, each bucket's sorted hashes are
    hashed, then the buckets'; no task sorts more than a bucket of a group at once."""
    rows = df.select(*by, F.sha2(entry, 256).alias("_e"))
    rows = rows.withColumn("_b", F.conv(F.col("_e").substr(1, 2), 16, 10).cast("int") % buckets)
    part = rows.groupBy(*by, "_b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_e")), ""), 256).alias("_p"))
    return part.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_p"))), lambda x: x["_p"]), ""), 256).alias(name))


def interaction_predicate(category, direction) -> Column:
    ok = category.isin(*SIGNAL_CATEGORIES) & direction.isin(*SIGNAL_DIRECTIONS)
    return F.when(ok, F.concat_ws("/", F.lit(INTERACTION), category, direction))


def parse_interaction(predicate) -> tuple[Column, Column]:
    """(category, direction), both NULL unless the predicate is exactly of the vocabulary."""
    parts = F.split(predicate, "/", -1)
    c, d = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    ok = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == INTERACTION) & c.isin(*SIGNAL_CATEGORIES) & d.isin(*SIGNAL_DIRECTIONS)
    return F.when(ok, c), F.when(ok, d)


def meeting_date(title) -> Column:
    """The date of a title `[YYYY-MM-DD] text` that holds exactly one valid bracketed date, else NULL."""
    found = F.regexp_extract_all(title, F.lit(r"(\[\d{4}-\d{2}-\d{2}\])"), 1)
    dates = F.filter(F.transform(found, lambda x: F.try_to_date(F.substring(x, 2, 10), "yyyy-MM-dd")), lambda x: x.isNotNull())
    own = F.try_to_date(F.regexp_extract(title, r"^\[(\d{4}-\d{2}-\d{2})\] \s*\S", 1), "yyyy-MM-dd")
    return F.when((F.size(dates) == 1) & own.isNotNull(), own)


def tab_role(title, transcript: list[str], notes: list[str]) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))
    return F.when(plain.isin(*transcript), "transcript").when(plain.isin(*notes), "notes").otherwise("other")


def masked_email(email) -> Column:
    """First character of the local part, three stars, the domain; empty if the address has no two sides."""
    return F.when(F.regexp_like(email, F.lit(r"(?s)^.+@[^@]+$")), F.regexp_replace(email, r"(?s)^(.).*(@[^@]+)$", "$1***$2")).otherwise("")


@pandas_udf(T.StringType())
def stable_uuid(name: pd.Series) -> pd.Series:
    """Version-5 UUID of a name under the OID namespace."""
    return name.map(lambda s: str(uuid.uuid5(NAMESPACE, s)), na_action="ignore")


@pandas_udf(T.BinaryType())
def float_bits(value: pd.Series) -> pd.Series:
    """A double's IEEE bits, big-endian, for digests."""
    return value.map(lambda v: struct.pack(">d", v), na_action="ignore")

"""Names and mail addresses: the parts that need Unicode normalisation run as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\u0080-\U0010ffff-]+"
_MAILBOX = re.compile(rf"{_ATOM}(\.{_ATOM})*@{_ATOM}(\.{_ATOM})*\Z")


def normalized_name(name: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", name).split()).lower()


def normalized_email(email: str) -> str:
    return unicodedata.normalize("NFKC", email).strip().lower()


@pandas_udf(T.StringType())
def _nfkc_name(s: pd.Series) -> pd.Series:
    return s.map(normalized_name, na_action="ignore")


@pandas_udf(T.StringType())
def _nfkc_email(s: pd.Series) -> pd.Series:
    return s.map(normalized_email, na_action="ignore")


@pandas_udf(T.BooleanType())
def valid_email(s: pd.Series) -> pd.Series:
    """One plain mailbox without display name or white space."""
    return s.map(lambda x: x is not None and bool(_MAILBOX.match(x))).astype(bool)


def normalize_name(name: Column) -> Column:
    """NFKC, white space collapsed, lower case."""
    return _nfkc_name(name)


def normalize_email(email: Column) -> Column:
    return _nfkc_email(email)


def plain_name(name: Column) -> Column:
    """The same for ASCII names, inside generated code."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


_EDGE = r"[^\w.@+-]"


def grounded_name(quote: str, name: str) -> bool:
    """Whether the quote names this person: all words in a row, bounded, not inside a mail address."""
    words = r"\s+".join(re.escape(w) for w in unicodedata.normalize("NFKC", name).split())
    return bool(words) and bool(re.search(rf"(?i)(?<![\w.@+-]){words}(?![\w@+-]|\.\w)", unicodedata.normalize("NFKC", quote)))


def grounded_email(quote: str, email: str) -> bool:
    mail = re.escape(normalized_email(email))
    return bool(mail) and bool(re.search(rf"(?<![\w.@+-]){mail}(?![\w@+-]|\.\w)", normalized_email(quote)))


def source_mailbox(quote: str, name: str, email: str) -> bool:
    """Whether the quote is exactly `Name <mail>` for this name and address."""
    m = re.fullmatch(r"\s*(.+?)\s*<([^<>]+)>\s*", quote)
    return bool(m) and normalized_name(m[1].strip('"')) == normalized_name(name) and normalized_email(m[2]) == normalized_email(email)

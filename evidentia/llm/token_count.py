"""Token counts of texts under a byte-level BPE vocabulary, by rank-synchronous array merging."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Seen, merger
from .common import carried, small_batches

#: Unicode white space, as the pre-tokeniser sees it (the control characters 1C-1F are none).
_W = "\t-\r \x85\xa0  -     　"
#: Runs that hold whole pre-tokens: optional space and non-space, or white space up to the last of a run.
_RUNS = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
#: The byte-level pre-tokeniser's pattern (fixed).
_PRE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+")
#: Distinct runs, and characters of them, that a worker remembers before it starts anew.
MEMORY, MEMORY_CHARACTERS = 400_000, 16 << 20


class Counter:
    """Counts tokens; remembers the counts of the runs it has seen."""

    def __init__(self, path: str, specials: tuple[str, ...]):
        self.merger = merger(path)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self._forget()

    def _forget(self) -> None:
        self.seen, self.known, self.held = Seen(), np.empty(0, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        pre = [_PRE.findall(run) for run in new]
        flat = [t for run in pre for t in run]
        tokens = Seen()
        which = np.fromiter(map(tokens.__getitem__, flat), np.int64, len(flat))
        _, counts = self.merger.merge([t.encode("utf-8") for t in tokens])
        each = np.fromiter(map(len, pre), np.int64, len(pre))
        total = np.concatenate(([0], np.cumsum(counts[which])))
        until = np.cumsum(each)
        self.known = np.concatenate((self.known, total[until] - total[until - each]))

    def count(self, texts: list[str]) -> np.ndarray:
        out, owner, runs = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            n = 0
            for part in parts:
                found = _RUNS.findall(part)
                runs += found
                n += len(found)
            owner.append(n)
        which = np.fromiter(map(self.seen.__getitem__, runs), np.int64, len(runs))
        if new := self.seen.fresh():
            self._learn(new)
            self.held += sum(map(len, new))
        total = np.concatenate(([0], np.cumsum(self.known[which])))
        until = np.cumsum(owner)
        out += total[until] - total[until - np.array(owner, np.int64)]
        if len(self.seen) > MEMORY or self.held > MEMORY_CHARACTERS:
            self._forget()
        return out


@lru_cache
def _counter(path: str, specials: tuple[str, ...] | None) -> Counter:
    return Counter(path, added_tokens(path) if specials is None else specials)


def added_tokens(path: str) -> tuple[str, ...]:
    """The special strings that the vocabulary file adds, longest first."""
    with open(path, encoding="utf-8") as f:
        return tuple(sorted((t["content"] for t in json.load(f).get("added_tokens") or ()), key=len, reverse=True))


def text_steps(texts, limit: int = 1 << 20):
    """Runs of texts of at most `limit` characters, or one longer text; null counts as empty."""
    run, size = [], 0
    for text in texts:
        text = text or ""
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def token_counts(
    df: DataFrame, tokenizer_path: str, specials: tuple[str, ...] | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer_path: a byte-level BPE vocabulary file, readable on every executor. Whole texts are counted;
    a special string inside a text counts as its one token (`specials`; by default those that the file adds).
    Null counts as empty: 0 bytes, 0 tokens. Ids are passed on as they are, null or repeated. There is no
    shuffle; a worker's memory is one step of texts and at most MEMORY remembered runs or MEMORY_CHARACTERS of
    them, or one text's. An empty table gives no rows; other columns don't matter.
    """

    def run(batches):
        counter = _counter(tokenizer_path, specials)
        for pdf in batches:
            counts = [counter.count(texts) for texts in text_steps(pdf["text"])]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_tokens": np.concatenate([*counts, np.empty(0, np.int64)])})

    text = F.coalesce(F.col(text_col), F.lit(""))
    small_batches(df)
    own, kind, back = carried(df, id_col)
    rows = df.select(own.alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(back(F.col("id")).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

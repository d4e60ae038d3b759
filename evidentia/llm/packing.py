"""Packing tokenised documents into sequences by vector best-fit."""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import Seen, merger, ragged
from .common import carried, cut_lineage, small_batches
from .token_count import text_steps

#: The word vocabulary's pre-token pattern (fixed), and the line feed that here parts words.
_PRE = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Separators that Python's split() knows and the vocabulary's normaliser does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Words with characters beyond the Latin blocks, or that may hold special tokens, go to the library.
_HARD = re.compile("[\x1c-\x1f\u0250-\U0010ffff]|<\\|")
#: Distinct words, and characters of them, that a worker remembers before it starts anew.
MEMORY, MEMORY_CHARACTERS = 200_000, 8 << 20


class WordIds:
    """Token ids of texts under a word-level-normalised BPE (NFC, lower case, white space dropped).

    Nothing of that vocabulary reaches over white space, so a text's ids are its words' ids in order, and
    words are looked up once while they are remembered.
    """

    def __init__(self, path: str):
        self.library, self.merger = Tokenizer.from_file(path), merger(path)
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        self.seen, self.held = Seen(), 0
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat: np.ndarray = np.empty(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        hard = [i for i, word in enumerate(new) if _HARD.search(word)] if _HARD.search("\n".join(new)) else []
        plain = np.setdiff1d(np.arange(len(new)), hard)
        joined = "\n".join([new[i] for i in plain] if hard else new)
        # no word holds a line feed, nothing composes with one, and in the Latin blocks lower case needs no context
        joined = (joined if joined.isascii() else unicodedata.normalize("NFC", joined)).lower()
        tokens = Seen()
        found = _PRE.findall(joined)
        which = np.fromiter(map(tokens.__getitem__, found), np.int64, len(found))
        ends = np.append(np.flatnonzero(which == tokens["\n"]), len(which))
        ids, counts = self.merger.merge([t.encode("utf-8") if t != "\n" else b"" for t in tokens])
        first = np.cumsum(counts) - counts
        picked = ids[ragged(first[which], counts[which])].astype(np.uint32)
        total = np.concatenate(([0], np.cumsum(counts[which])))
        lengths, starts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        until = total[ends][: len(plain)]
        starts[plain] = np.concatenate(([0], until))[: len(plain)]
        lengths[plain] = until - starts[plain]
        more, at = [picked], len(picked)
        if hard:
            for i, e in zip(hard, self.library.encode_batch([new[i] for i in hard], add_special_tokens=False), strict=True):
                starts[i], lengths[i] = at, len(e.ids)
                more.append(np.array(e.ids, np.uint32))
                at += len(e.ids)
        self.starts = np.concatenate((self.starts, starts + len(self.flat)))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, *more))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and how many each text has."""
        words, n = [], []
        for text in texts:
            found = [text] if _ODD.search(text) else text.split()
            words += found
            n.append(len(found))
        which = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        if new := self.seen.fresh():
            self._learn(new)
            self.held += sum(map(len, new))
        lengths = self.lengths[which]
        flat = self.flat[ragged(self.starts[which], lengths)]
        total = np.concatenate(([0], np.cumsum(lengths)))
        until = np.cumsum(np.array(n, np.int64)) if n else np.empty(0, np.int64)
        counts = total[until] - total[until - np.array(n, np.int64)]
        if len(self.seen) > MEMORY or self.held > MEMORY_CHARACTERS:
            self._forget()
        return flat, counts


@lru_cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@dataclass(frozen=True)
class Limits:
    """What one sequence holds: tokens, documents, and attention cost (the sum of squared lengths)."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    #: of the residual capacities in the norm or the dot product
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    def valid(self) -> None:
        if min(self.tokens, self.documents) < 1 or self.attention < self.tokens**2 or self.rule not in ("norm", "dot"):
            raise ValueError("limits must be positive, and a full piece must fit the attention budget")


@dataclass(frozen=True)
class Plan:
    """Where the r-th piece of each length goes: entries sorted by (length, first rank)."""

    key: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    uses: np.ndarray
    base: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length.astype(np.int64) << 44) + rank, "right") - 1
        over = rank - self.first[at]
        return self.bin[at] + over // self.uses[at], self.base[at] + over % self.uses[at] * length


def best_fit(lengths: dict[int, int], limits: Limits = Limits()) -> Plan:  # noqa: B008
    """Best-fit decreasing over lengths with counts; its work depends on the distinct lengths, not on the counts.

    A piece's demand is (length, 1, length^2), so equal lengths are interchangeable and equal bins form one
    class with a multiplicity. Longest first, each length goes to the feasible class whose residual after
    the piece has the least weighted norm (rule `norm`), or whose residual has the largest weighted dot
    product with the piece's demand among those (rule `dot`); every constraint holds. Without a feasible
    class new bins are opened and filled with the length itself.
    """
    limits.valid()
    cap = np.array([limits.tokens, limits.documents, limits.attention], float)
    w = np.array(limits.weights, float)
    room = np.empty((1024, 3), np.int64)
    many = np.empty(1024, np.int64)
    held: list[list[tuple[int, int]]] = []

    def add(r, m, pattern):
        nonlocal room, many
        k = len(held)
        if k == len(many):
            room, many = np.concatenate((room, np.empty_like(room))), np.concatenate((many, np.empty_like(many)))
        room[k], many[k] = r, m
        held.append(pattern)

    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        need = np.array([length, 1, length * length], np.int64)
        while n > 0:
            k = len(held)
            ok = np.flatnonzero((room[:k] >= need).all(axis=1) & (many[:k] > 0))
            if len(ok):
                if limits.rule == "norm":
                    best = ok[np.argmin((w * ((room[ok] - need) / cap) ** 2).sum(axis=1))]
                else:
                    best = ok[np.argmax((w * (room[ok] / cap) * (need / cap)).sum(axis=1))]
                m, before = int(many[best]), held[best]
                fill = int((room[best] // need).min())
                pattern = lambda uses: [*before[:-1], (length, before[-1][1] + uses)] if before and before[-1][0] == length else [*before, (length, uses)]  # noqa: B023, E731
                if n >= m * fill:  # every bin of the class takes all it can of this length
                    room[best], held[best] = room[best] - fill * need, pattern(fill)
                    n -= m * fill
                else:
                    full, rest = divmod(n, fill)
                    many[best] = m - full - (rest > 0)
                    if full:
                        add(room[best] - fill * need, full, pattern(fill))
                    if rest:
                        add(room[best] - rest * need, 1, pattern(rest))
                    n = 0
            else:
                fill = int((cap.astype(np.int64) // need).min())
                full, rest = divmod(n, fill)
                if full:
                    add(cap.astype(np.int64) - fill * need, full, [(length, fill)])
                if rest:
                    add(cap.astype(np.int64) - rest * need, 1, [(length, rest)])
                n = 0
    first: dict[int, int] = {}
    rows, start = [], 0
    for c in range(len(held)):
        m, base = int(many[c]), 0
        if m:
            for length, uses in held[c]:
                rank = first.get(length, 0)
                rows.append((length, rank, start, uses, base))
                first[length] = rank + m * uses
                base += length * uses
            start += m
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return Plan((a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3], a[:, 4], start)


def _pieces(path: str, end_id: int, size: int, kind: str):
    def run(batches):
        tokens = word_ids(path)
        for pdf in batches:
            row, piece, start, length, crc = [], [], [], [], []
            i = 0
            for texts in text_steps(pdf["text"]):
                flat, counts = tokens.ids(texts)
                at = 0
                for n in counts.tolist():
                    ids = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for p, s in enumerate(range(0, n + 1, size)):
                        part = ids[s : s + size]
                        row.append(i)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                    i += 1
            yield pd.DataFrame({"id": pdf["id"].iloc[row].reset_index(drop=True), "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    return run, f"id {kind}, piece int, start long, length long, ids_crc32 long"


def _placed(plan: Plan):
    def run(batches):
        for pdf in batches:
            pdf["sequence_id"], pdf["offset"] = plan.place(pdf["length"].to_numpy(), pdf.pop("rank").to_numpy())
            yield pdf

    return run


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's without added tokens, then `end_id`; only documents longer than
    limits.tokens are cut, into full pieces and a rest. Null or empty texts are the one id `end_id`. Each
    row is a document of its own, also where rows repeat an id (order among them is free); a null id is kept.
    An empty table gives no rows; other columns don't matter.

    The driver plans on the counts of lengths: at most limits.tokens numbers, whatever the input. The plan
    has a bounded number of entries too (classes of equal bins). A piece's rank among those of its length is
    its bucket's first rank plus its rank in the bucket; buckets are drawn by a piece's place among the read
    rows (held by a checkpoint), so a length that most rows share, also rows that are alike in everything, is
    spread over as many buckets as there are shuffle partitions.
    """
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small_batches(df)
    own, kind, back = carried(df, id_col)
    rows = df.select(own.alias("id"), F.col(text_col).alias("text"))
    run, schema = _pieces(tokenizer_path, end_id, limits.tokens, kind)
    pieces = cut_lineage(rows.mapInPandas(run, schema).withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    plan = best_fit({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limits)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece")) - 1)
    ranked = ranked.join(starts, ["length", "bucket"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("from") + F.col("rank")).alias("rank")
    )
    out = ranked.mapInPandas(_placed(plan), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(back(F.col("id")).alias(id_col), *out.columns[1:])

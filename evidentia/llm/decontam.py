"""Benchmark decontamination: windows of items found in documents by a prefix-filtered set join, confirmed word by word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, cut_lineage, mix, small_batches, span_hashes, steps, word_spans

#: Bytes that are no part of a word (A-Z are lower-cased first).
APART = np.zeros(256, bool)
APART[:0x80] = True
for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    APART[first : last + 1] = False
#: Words of a shingle.
SHINGLE = 3
#: Windows (of an item each) that are looked for at once; more are looked for in several passes over the documents.
BLOCK = 1 << 18
#: Places of the table that says at once that a shingle is in no item.
SIEVE = 1 << 20
_WEIGHTS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)


class Words:
    """The words of several texts: where each begins and ends in the lower-cased bytes, its hash and its text."""

    def __init__(self, raws: list[bytes]):
        self.low, self.start, self.size, self.counts = word_spans(raws, APART)
        self.hash = span_hashes(self.low, self.start, self.size)
        self.until = np.cumsum(self.counts)
        self.text = np.repeat(np.arange(len(raws)), self.counts)

    def shingles(self, width: int) -> np.ndarray:
        """The hash of `width` words from each word on; those that pass a text's end say nothing."""
        n = max(0, len(self.hash) - width + 1)
        total = np.full(n, width, np.uint64)
        for i in range(width):
            total += self.hash[i : i + n] * _WEIGHTS[i]
        return mix(total)

    def joined(self, first: int, words: int) -> bytes:
        return b" ".join(self.low[a : a + n].tobytes() for a, n in zip(self.start[first : first + words].tolist(), self.size[first : first + words].tolist(), strict=True))


def _windows(window: int):
    """A row for each shingle of each window: the window's words, its length, and the shingle's hash and place."""

    def run(batches):
        for pdf in batches:
            rows = []
            for first, raws in steps(pdf["text"]):
                words = Words(raws)
                widths = {w: words.shingles(w) for w in range(1, SHINGLE + 1)}
                for k, n in enumerate(words.counts.tolist()):
                    at, m = int(words.until[k]) - n, min(n, window)
                    width = min(m, SHINGLE)
                    for w in range(at, at + n - m + 1) if m else ():
                        text = words.joined(w, m)
                        rows += [(pdf["item"].iat[first + k], text, m, int(widths[width][w + i].view(np.int64)), i) for i in range(m - width + 1)]
            yield pd.DataFrame(rows, columns=["item", "window", "words", "shingle", "place"])

    return run


def _counted(wanted: np.ndarray, widths: list[int]):
    """How often each wanted shingle stands in a batch's texts."""

    def run(batches):
        sieve = np.zeros(SIEVE, bool)
        sieve[wanted % SIEVE] = True
        for pdf in batches:
            counts = np.zeros(len(wanted), np.int64)
            for _, raws in steps(pdf["text"]):
                words = Words(raws)
                for width in widths:
                    h = words.shingles(width)
                    h = h[(words.text[: len(h)] == words.text[width - 1 :]) & sieve[h % SIEVE]]
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    counts += np.bincount(at[wanted[at] == h], minlength=len(wanted))
            some = np.flatnonzero(counts)
            yield pd.DataFrame({"shingle": wanted[some].view(np.int64), "count": counts[some]})

    return run


@dataclass(frozen=True)
class Block:
    """Windows by their rarest shingle: sorted shingle hashes, each window's place of it, length, words and item."""

    shingle: np.ndarray
    place: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    window: list[bytes]
    items: list[list]
    widths: list[int]

    @classmethod
    def of(cls, rows: list, window: int) -> "Block":
        rows = sorted(rows, key=lambda r: (r["shingle"] & (1 << 64) - 1, r["window"]))
        texts = [bytes(r["window"]) for r in rows]
        hashes = np.zeros((len(rows), window), np.uint64)
        for i, text in enumerate(texts):
            own = Words([text]).hash
            hashes[i, : len(own)] = own
        count = np.array([r["words"] for r in rows], np.int64)
        widths = sorted({min(m, SHINGLE) for m in count.tolist()})
        return cls(np.array([r["shingle"] for r in rows], np.int64).view(np.uint64), np.array([r["place"] for r in rows], np.int64), count, hashes, texts, [sorted(r["items"]) for r in rows], widths)

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence: shingles are met, then bounds, hashes and words are compared."""
        sieve = np.zeros(SIEVE, bool)
        sieve[self.shingle % SIEVE] = True
        firsts, which = [], []
        for width in self.widths:
            h = words.shingles(width)
            some = np.flatnonzero(sieve[h % SIEVE])
            low, high = np.searchsorted(self.shingle, h[some], "left"), np.searchsorted(self.shingle, h[some], "right")
            each = high - low
            at = np.repeat(some, each)
            w = np.repeat(low - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(int(each.sum()))
            # a shingle at its place in the window fixes where the window would begin: both ends must lie in the text
            begin = at - self.place[w]
            ok = (np.minimum(self.words[w], SHINGLE) == width) & (begin >= 0) & (begin + self.words[w] <= len(words.hash))
            begin, w = begin[ok], w[ok]
            ok = words.text[begin] == words.text[begin + self.words[w] - 1]
            begin, w = begin[ok], w[ok]
            for i in range(self.hashes.shape[1]):
                short = self.words[w] <= i
                ok = short | (words.hash[np.minimum(begin + i, len(words.hash) - 1)] == self.hashes[w, i])
                begin, w = begin[ok], w[ok]
            firsts.append(begin)
            which.append(w)
        begin, w = np.concatenate([*firsts, np.empty(0, np.int64)]), np.concatenate([*which, np.empty(0, np.int64)])
        ok = [words.joined(a, int(self.words[i])) == self.window[i] for a, i in zip(begin.tolist(), w.tolist(), strict=True)]
        ok = np.array(ok, bool)
        return begin[ok], w[ok]


def _spans(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Merged runs of words."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begin.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "digest binary, n_words long, spans array<struct<begin: long, end: long>>, items array<string>"


def _scan(block: Block | None):
    def run(batches):
        for pdf in batches:
            counts, spans, items = [], [], []
            for _, raws in steps(pdf["text"]):
                words = Words(raws)
                counts += words.counts.tolist()
                own_spans, own_items = [[] for _ in raws], [[] for _ in raws]
                begin, w = block.found(words) if block else (np.empty(0, np.int64), np.empty(0, np.int64))
                text = words.text[begin]
                for t in np.unique(text).tolist():
                    at = text == t
                    zero = int(words.until[t] - words.counts[t])
                    own_spans[t] = [{"begin": a, "end": b} for a, b in _spans(begin[at] - zero, begin[at] + block.words[w[at]] - zero)]
                    own_items[t] = sorted({x for i in np.unique(w[at]).tolist() for x in block.items[i]})
                spans += own_spans
                items += own_items
            yield pdf.drop(columns="text").assign(n_words=counts, spans=spans, items=items)

    return run


def _merged(batches):
    for pdf in batches:
        spans = [[{"begin": a, "end": b} for a, b in _spans(np.array([s["begin"] for s in x]), np.array([s["end"] for s in x]))] for x in pdf["spans"]]
        yield pdf.assign(spans=spans)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, spans (runs of hit words, from 0), items (sorted ids, as text).

    Words are runs of letters, digits and code points beyond ASCII, A-Z lower-cased. A window is `window` words of an
    item that follow each other; an item of fewer words is one window, one without words none. A document's word is
    hit if it lies in an occurrence of a window. Null texts have no words. A null item id has windows that hit, but
    no name in items; rows that repeat an item id are one item. Documents' rows are judged one by one, whatever
    their ids. An empty benchmark hits nothing, an empty table gives no rows; other columns don't matter.

    1. A window is a set of shingles of up to three words, all of which an occurrence must have, so one of them is
       prefix enough: the rarest, by how often each stands in all documents, counted in one pass. Windows with a
       shingle that stands nowhere go.
    2. Documents meet the prefix shingles. A shingle's place in its window tells where the window would begin, so the
       bounds of the text are held against it, then the words' hashes, then the words themselves.

    Documents are never shuffled: the windows go to them, in blocks of about `block` (window, item) pairs, some
    200 bytes each, one pass over the documents for each block. Equal windows are one. With several blocks what is
    found is put together by the text's digest, so only digests of documents are dealt.
    """
    small_batches(docs)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    shingles = cut_lineage(items.mapInPandas(_windows(window), "item string, window binary, words int, shingle long, place int"))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    # blocks are ranges of the windows' digests, with about as many (window, item) pairs as wanted
    pairs = shingles.where("place = 0").select("window", "item").distinct()
    blocks = max(1, -(-pairs.count() // block))
    shingles = shingles.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int"))
    own, kind, back = carried(docs, id_col)
    rows = docs.select(own.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest") if blocks > 1 else F.lit(None).cast("binary").alias("digest"), "text")
    found = []
    for k in range(blocks):
        part = shingles.where(F.col("block") == k)
        wanted = part.select("shingle", F.least("words", F.lit(SHINGLE)).alias("width")).distinct().toPandas()
        if not len(wanted):
            continue
        hashes = np.unique(wanted["shingle"].to_numpy(np.int64).view(np.uint64))
        counted = texts.mapInPandas(_counted(hashes, sorted(set(wanted["width"].tolist()))), "shingle long, count long")
        counted = counted.groupBy("shingle").agg(F.sum("count").alias("count"))
        each = part.select("window", "words", "shingle", "place").distinct().join(counted, "shingle", "left")
        rarest = each.groupBy("window", "words").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "place", "shingle")).alias("rarest"))
        named = part.where("place = 0").groupBy("window").agg(F.array_compact(F.collect_set("item")).alias("items"))
        prefix = rarest.where("rarest.count > 0").join(named, "window").select("window", "words", "rarest.shingle", "rarest.place", "items").collect()
        if prefix:
            found.append(rows.mapInPandas(_scan(Block.of(prefix, window)), f"id {kind}, {_FOUND}"))
    if len(found) < 2:
        out = found[0] if found else rows.mapInPandas(_scan(None), f"id {kind}, {_FOUND}")
    else:
        hits = found[0].where("size(spans) > 0")
        for more in found[1:]:
            hits = hits.unionByName(more.where("size(spans) > 0"))
        hits = hits.select("digest", "spans", "items").distinct().groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hits = hits.mapInPandas(_merged, "digest binary, spans array<struct<begin: long, end: long>>, items array<string>")
        none = found[0].select("id", "digest", "n_words")
        out = none.join(hits, "digest", "left")
        out = out.select("id", "n_words", *[F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "items")])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select(back(F.col("id")).alias(id_col), "n_words", hit.alias("n_hit"), "spans", "items")

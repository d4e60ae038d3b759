"""Quality classifier: a generalised additive model with pairwise interactions over statistics of the text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, carried, cut_lineage, id_crc, small_batches, steps, word_hashes

#: Classes of bytes whose shares are features; bytes from 80 on are one class.
_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "mark", "sign", "control", "high")
_CLASS = np.full(256, _CLASSES.index("high"), np.uint8)
_CLASS[:128] = _CLASSES.index("sign")
_CLASS[:32] = _CLASS[127] = _CLASSES.index("control")
for _name, _bytes in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", (32, 9)), ("line", (10, 11, 12, 13)), ("stop", b".,;:'\"-()"), ("mark", b"!?")):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)

FEATURES = (
    "log_bytes", *(f"share_{c}" for c in _CLASSES), "mean_word", "spread_word", "distinct_words", "top_word", "repeated_lines", "mean_line", "entropy", "upper_of_letters", "signs_a_word", "marks_a_word",
)


def text_features(texts) -> np.ndarray:
    """(rows, FEATURES) statistics of whole texts; null or empty texts are all zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for first, raws in steps(texts):
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        doc = np.repeat(np.arange(len(raws)), n)
        flat = np.frombuffer(b"".join(raws), np.uint8)
        k = len(_CLASSES)
        classes = np.bincount(doc * k + _CLASS[flat], minlength=len(raws) * k).reshape(-1, k)
        hist = np.bincount(doc * 256 + LOWER[flat], minlength=len(raws) * 256).reshape(-1, 256)
        size = np.maximum(n, 1)
        p = hist / size[:, None]
        x = out[first : first + len(raws)]
        x[:, 0] = np.log1p(n)
        x[:, 1 : k + 1] = classes / size[:, None]
        h, counts = word_hashes(raws)
        words = np.maximum(counts, 1)
        solid = n - classes[:, 3] - classes[:, 4]
        x[:, k + 1] = solid / words
        x[:, k + 7] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
        x[:, k + 8] = classes[:, 1] / np.maximum(classes[:, 0] + classes[:, 1], 1)
        x[:, k + 9] = classes[:, 7] / words
        x[:, k + 10] = classes[:, 6] / words
        at = 0
        for i, c in enumerate(counts.tolist()):
            own = h[at : at + c]
            at += c
            if c:
                _, times = np.unique(own, return_counts=True)
                x[i, k + 3] = len(times) / c
                x[i, k + 4] = times.max() / c
                lengths = np.fromiter(map(len, raws[i].split()), np.int64)
                x[i, k + 2] = lengths.std()
            lines = [line for line in raws[i].split(b"\n") if line.strip()]
            if lines:
                x[i, k + 5] = 1 - len(set(lines)) / len(lines)
                x[i, k + 6] = np.log1p(n[i] / len(lines))
    return out


@dataclass(frozen=True)
class Additive:
    """Bin edges and lookup tables: score = sigmoid(intercept + one table per feature + one per pair)."""

    edges: list
    intercept: float
    tables: list
    pairs: list
    pair_tables: list

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def raw(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.intercept)
        for f, table in enumerate(self.tables):
            z += table[b[:, f]]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[b[:, f], b[:, g]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best gain of one cut of bins with gradients g and weights h, and its place (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    c, d = g.sum() - a, h.sum() - b
    gain = a * a / (b + ridge) + c * c / (d + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(b < 1e-3) | (d < 1e-3)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow tree over one feature's bins: the step of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_cut(g[lo:hi], h[lo:hi], ridge), lo, hi) for lo, hi in parts]
        gain, at, lo, hi = max(cuts)
        if not at:
            break
        parts.remove((lo, hi))
        parts += [(lo, lo + at), (lo + at, hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _square(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree over a pair's bins: a cut of the first feature, then one of the second on either side; its gain and steps."""
    best, out = 0.0, np.zeros_like(g)
    for at in range(1, len(g)):
        gain, step = -g.sum() ** 2 / (h.sum() + ridge), np.zeros_like(g)
        for rows in (slice(0, at), slice(at, None)):
            a, b = g[rows].sum(axis=0), h[rows].sum(axis=0)
            _, cut = _cut(a, b, ridge)
            for cols in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                s, w = a[cols].sum(), b[cols].sum() + ridge
                gain += s * s / w
                step[rows, cols] = -s / w
        if gain > best:
            best, out = gain, step
    return best, out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 24, pair_bins: int = 8, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, leaves: int = 3, ridge: float = 2.0) -> Additive:
    """Cyclic boosting: each round gives every feature in turn one shallow tree, then every chosen pair one.

    Pairs are chosen by the gain of a first two-way tree on the residuals of the additive part. Without rows
    of both classes the model is a constant.
    """
    if not len(y) or y.min() == y.max():
        return Additive([np.empty(0)] * len(FEATURES), 0.0 if not len(y) else float(6 * y[0] - 3), [np.zeros(1)] * len(FEATURES), [], [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    model = Additive(edges, float(np.log(y.mean() / (1 - y.mean()))), [np.zeros(len(e) + 1) for e in edges], [], [])
    b = model.bins(x)
    z = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)), leaves, ridge)
            table += step
            z += step[b[:, f]]
    g, h = slopes()
    coarse = [np.minimum(np.arange(len(t)) * pair_bins // len(t), pair_bins - 1) for t in model.tables]
    c = np.stack([coarse[f][b[:, f]] for f in range(b.shape[1])], axis=1)

    def grid(f, k, v):
        return np.bincount(c[:, f] * pair_bins + c[:, k], v, pair_bins**2).reshape(pair_bins, pair_bins)

    gains = [(_square(grid(f, k, g), grid(f, k, h), ridge)[0], f, k) for f in range(b.shape[1]) for k in range(f)]
    chosen = [(f, k) for _, f, k in sorted(gains, reverse=True)[:pairs]]
    tables = [np.zeros((pair_bins, pair_bins)) for _ in chosen]
    for _ in range(pair_rounds):
        for (f, k), table in zip(chosen, tables, strict=True):
            g, h = slopes()
            step = rate * _square(grid(f, k, g), grid(f, k, h), ridge)[1]
            table += step
            z += step[c[:, f], c[:, k]]
    model.pairs.extend(chosen)
    model.pair_tables.extend(t[np.ix_(coarse[f], coarse[k])] for (f, k), t in zip(chosen, tables, strict=True))
    return model


def _featured(batches):
    for pdf in batches:
        x = text_features(pdf["text"])
        yield pdf.drop(columns="text").assign(x=list(x))


def quality_scores(
    df: DataFrame, labels: DataFrame, held_out=None, threshold: float = 0.7, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", row_col: str | None = None
) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 from `threshold` on).

    The model learns from at most `sample` labelled rows (those with the smallest id hashes) whose id is not
    held out; labels join on the id. Only the text enters a score; null counts as empty, and empty texts get
    the score of all-zero statistics. Without labels of both classes the score is a constant (0.5 without
    any label). Null ids are scored and held in; null labels are left out. Rows that repeat an id are scored
    one by one. An empty table gives no rows; other columns don't matter.

    held_out: a column function of the id, by default crc32(id as text) mod 4 = 2.
    row_col: a column without nulls that is given back with each row, where ids don't tell rows apart.
    """
    apart = held_out or (lambda c: F.coalesce(F.pmod(id_crc(c), F.lit(4)) == 2, F.lit(False)))
    own = [F.col(row_col).alias("row")] if row_col else []
    small_batches(df)
    named, _, back = carried(df, id_col)
    rows = df.select(named.alias("id"), *own, F.col(text_col).alias("text"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    held = cut_lineage(rows.mapInPandas(_featured, f"{kind}, x array<double>"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    marked = marked.where(~apart(F.col("id")) & F.col("id").isNotNull())
    # only ids with hashes low enough to be among the least `sample` go on, so that no task sends more than its share
    spot, n = F.xxhash64("id"), marked.count()
    share = min(1.0, (1.2 * sample + 1000) / max(n, 1))
    known = marked.where(spot <= int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else F.lit(True)).join(held.withColumn("id", back(F.col("id"))), "id")
    known = known.orderBy(spot, "id", "y").limit(sample).select("x", "y").toPandas()
    model = fit(np.array(known["x"].tolist(), float).reshape(-1, len(FEATURES)), known["y"].to_numpy(float))

    def scored(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float).reshape(-1, len(FEATURES))
            yield pdf.drop(columns="x").assign(score=model.score(x))

    out = held.mapInPandas(scored, f"{kind}, score double")
    own = [F.col("row").alias(row_col)] if row_col else []
    named = back(F.col("id"))
    return out.select(named.alias(id_col), *own, apart(named).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Language-model scores by prediction by partial matching: byte contexts, escapes, symbol exclusion."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, carried, id_crc, mix, small_batches, spread, steps, word_hashes

#: Longest context in bytes. A path of the trie, context and symbol, is ORDER + 1 bytes of one integer.
ORDER = 5
#: Byte values that UTF-8 never has: what stands before a text, and the symbol that ends it.
BEFORE, END = 0xFF, 0xFE
END_WORD = np.uint64(0xE0D0E0D0E0D0E0D1)
_LOWER = LOWER.tobytes()


def paths(raws: list[bytes], order: int) -> np.ndarray:
    """For each byte of each lower-cased text and its end, the `order` bytes before it and itself, as one integer."""
    edge = bytes([BEFORE]) * ORDER
    u = np.frombuffer(b"".join(edge + r.translate(_LOWER) + bytes([END]) for r in raws), np.uint8)
    at = np.flatnonzero(u != BEFORE)
    wide = u.astype(np.int64)
    code = np.zeros(len(u), np.int64)
    for back in range(order, -1, -1):
        code[order:] = (code[order:] << 8) | wide[order - back : len(u) - back]
    return code[at]


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and how many tokens each text has."""
    h, n = word_hashes(raws)
    ends = np.cumsum(n)
    return np.insert(h, ends, END_WORD).view(np.int64), n + 1


@dataclass
class Low:
    """Counts of the contexts of two bytes and fewer, whose number is bounded, from the whole training text."""

    code: np.ndarray
    count: np.ndarray
    sum2: np.ndarray
    kinds2: np.ndarray
    c1: np.ndarray
    c0: np.ndarray
    under2: np.ndarray
    under1: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, count: np.ndarray) -> "Low":
        by = np.argsort(code)
        code, count = code[by], count[by].astype(float)
        ctx, last = code >> 8, code & 0xFFFF
        c1 = np.bincount(last, count, 1 << 16)
        c0 = np.bincount(np.arange(1 << 16) & 0xFF, c1, 1 << 8)
        seen1 = c1 > 0
        return cls(
            code, count, np.bincount(ctx, count, 1 << 16), np.bincount(ctx, minlength=1 << 16).astype(float), c1, c0,
            np.bincount(ctx, c1[last], 1 << 16), np.bincount(np.arange(1 << 16) >> 8, np.where(seen1, c0[np.arange(1 << 16) & 0xFF], 0), 1 << 8),
        )

    def c2(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(code))
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.count[at], 0.0)


def _step(lp, todo, count, total, kinds):
    """One order: where the symbol was seen its share, else the escape; lp and todo change in place."""
    hit = todo & (count > 0)
    lp[hit] += np.log10((2 * count[hit] - 1) / (2 * total[hit]))
    todo &= ~hit
    out = todo & (kinds > 0)
    lp[out] += np.log10(kinds[out] / (2 * total[out]))


def log_probabilities(path: np.ndarray, count: np.ndarray, low: Low) -> np.ndarray:
    """log10 of the probability of each path's last byte after its other bytes.

    path: distinct, sorted; count: in training. All paths that share their last three context bytes must be
    there together. A context gives a symbol seen c of t times, with d different symbols, (2c - 1) / 2t, and
    the escape d / 2t (method D); in the next shorter context the symbols of the longer one are left
    out of t and d. Contexts never seen are passed over. Below order 0, the symbols left of 256 are alike.
    """

    def groups(key, *values):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        return which, [np.add.reduceat(v, start) for v in values]

    if not len(path):
        return np.empty(0)
    lp, todo = np.zeros(len(path)), np.ones(len(path), bool)
    keys, c, back = path, count.astype(float), np.arange(len(path))  # the order's distinct paths, and each path's one
    under, above = np.zeros(len(path)), np.zeros(len(path))  # counts and kinds here of what the longer context has
    for order in range(ORDER, 2, -1):
        shorter, to = np.unique(keys & ((1 << 8 * order) - 1), return_inverse=True)
        c_shorter = np.bincount(to, c, len(shorter)) if order > 3 else low.c2(shorter)
        seen = (c > 0).astype(float)
        which, (total, kinds, beneath) = groups(keys >> 8, c, seen, seen * c_shorter[to])
        mine = which[back]
        _step(lp, todo, c[back], total[mine] - under, kinds[mine] - above)
        under, above = beneath[mine], kinds[mine]
        keys, c, back = shorter, c_shorter, to[back]
    two = (path >> 8) & 0xFFFF
    _step(lp, todo, c[back], low.sum2[two] - under, low.kinds2[two] - above)
    one, zero = two & 0xFF, path & 0xFF
    sum1 = low.c1.reshape(256, 256).sum(axis=1)
    kinds1 = (low.c1.reshape(256, 256) > 0).sum(axis=1).astype(float)
    _step(lp, todo, low.c1[path & 0xFFFF], sum1[one] - low.under2[two], kinds1[one] - low.kinds2[two])
    kinds0 = float((low.c0 > 0).sum())
    _step(lp, todo, low.c0[zero], low.c0.sum() - low.under1[one], kinds0 - kinds1[one])
    lp[todo] -= np.log10(256 - kinds0)
    return lp


def _tally(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label, key = pd.factorize(np.concatenate(keys))
    return key, np.bincount(label, np.concatenate(counts), len(key)).astype(np.int64)


def _training(batches):
    """Per batch: two-byte contexts with their symbol (kind 0) and tokens (kind 1), with counts."""
    for pdf in batches:
        kept: list[list] = [[], [], [], []]
        for _, raws in steps(pdf["text"]):
            for kind, found in enumerate((paths(raws, 2), tokens(raws)[0])):
                label, key = pd.factorize(found)
                kept[2 * kind].append(key)
                kept[2 * kind + 1].append(np.bincount(label, minlength=len(key)))
        for kind in range(2):
            key, n = _tally(kept[2 * kind], kept[2 * kind + 1])
            yield pd.DataFrame({"kind": np.full(len(key), kind, np.int32), "key": key, "n": n})


@dataclass(frozen=True)
class Parts:
    """How paths and tokens are dealt: contexts of three bytes to groups, each group's paths to `splits` parts.

    A part's paths belong to one group, so it sends one message there and has one back; a frequent context is
    shared by all parts of its group. Both numbers are about the root of the number of parts.
    """

    groups: int
    splits: int

    @classmethod
    def of(cls, parts: int) -> "Parts":
        splits = math.isqrt(max(1, parts) - 1) + 1
        return cls(-(-max(1, parts) // splits), splits)

    @staticmethod
    def _hash(key: np.ndarray, n: int) -> np.ndarray:
        return (mix(key.view(np.uint64)) % np.uint64(n)).astype(np.int64)

    def place(self, key: np.ndarray, kind: int) -> np.ndarray:
        if kind:
            return self._hash(key, self.groups * self.splits)
        return self._hash((key >> 8) & 0xFFFFFF, self.groups) * self.splits + self._hash(key, self.splits)


def _joined(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64)


class Block:
    """The distinct paths and tokens of some texts, in an order that both passes over the block find again."""

    def __init__(self, texts, held_out, parts: Parts):
        self.rows, self.sizes = [], []
        keys: list[list] = [[], []]
        train: list[list] = [[], []]
        held_out = np.asarray(held_out, bool)
        for first, raws in steps(texts):
            sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
            words, n = tokens(raws)
            use = ~held_out[first : first + len(raws)]
            labels = []
            for kind, (found, each) in enumerate(((paths(raws, ORDER), sizes), (words, n))):
                label, key = pd.factorize(found)
                keys[kind].append(key)
                train[kind].append(np.bincount(label, np.repeat(use, each), len(key)).astype(np.int64))
                labels.append(label.astype(np.int32))
            self.rows.append(labels)
            self.sizes.append((sizes, n))
        self.keys, self.counts, self.places, owners = [], [], [], []
        for kind in range(2):
            key, n = _tally(keys[kind], train[kind])
            part = parts.place(key, kind)
            by = np.lexsort((key, part))
            self.keys.append(key[by])
            self.counts.append(n[by])
            owners.append(part[by])
            at = np.empty(len(key), np.int64)
            at[by] = np.arange(len(key))
            self.places.append([at[pd.Index(key).get_indexer(k)] for k in keys[kind]])
        #: the parts that hold anything of this block, and where each one's paths and tokens start
        self.parts = np.union1d(*owners)
        self.cuts = [np.append(np.searchsorted(owner, self.parts), len(owner)) for owner in owners]

    def sums(self, kind: int, values: np.ndarray) -> np.ndarray:
        """For each text the sum of the values of its paths or tokens."""
        out = []
        for labels, places, sizes in zip(self.rows, self.places[kind], self.sizes, strict=True):
            v = values[places][labels[kind]]
            out.append(np.add.reduceat(v, np.cumsum(sizes[kind]) - sizes[kind]))
        return np.concatenate(out) if out else np.empty(0)


def ppm_scores(df: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all texts not held out; A-Z are lower-cased throughout, null counts as empty.
    `score` is the log10 probability of the text's bytes and its end, each after up to ORDER bytes.
    `base_score` is the smoothed unigram score of its words and end: log10((c + 1) / (N + V + 1)) each.
    Rows that repeat an id are scored, and learnt from, one by one; a null id counts as training. If all
    rows are held out every byte has probability 1/256. An empty table gives no rows; other columns don't
    matter.

    1. One pass without a shuffle of texts counts contexts of two bytes (at most 2^24 numbers reach the
       driver and the workers), the training tokens and their kinds.
    2. Texts are dealt into blocks by a hash of id and text. Each block tells its distinct paths and tokens
       (by 64-bit hash) with their training counts, one array for each part that they fall to by hash: a
       context of three bytes belongs to one group of parts, and its paths are shared among all of them.
    3. Parts add up the counts of all blocks. Then the distinct paths of a group's parts meet, where their
       probabilities are found, and go back: what meets is a piece of the trie, not the blocks' messages.
    4. Parts answer each block with the probability of each of its paths and the count of each of its tokens,
       and blocks add up their texts. Blocks and parts grow with the input, so that no task holds more than
       its share; the trie as a whole is nowhere.

    held_out: a column function of the id, by default crc32(id as text) mod 7 = 2.
    """
    apart = held_out or (lambda c: F.coalesce(F.pmod(id_crc(c), F.lit(7)) == 2, F.lit(False)))
    small_batches(df)
    _, kind, back = carried(df, id_col)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = spread(df)
    parts = Parts.of(blocks)
    rows = rows.withColumn("held_out", apart(F.col("id"))).withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("id", F.col("id").cast(kind))

    counted = rows.where("not held_out").select("text").mapInPandas(_training, "kind int, key long, n long")
    counted = counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    known = counted.groupBy(F.when(F.col("kind") == 0, F.col("key")).alias("code")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()
    words = known[known["code"].isna()]
    pairs = known[known["code"].notna()]
    n_train, n_kinds = int(words["n"].sum()), int(words["kinds"].sum())
    sent = df.sparkSession.sparkContext.broadcast(Low.of(pairs["code"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)))

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        block = Block(pdf["text"], pdf["held_out"], parts)
        number, out = int(pdf["block"].iat[0]), []
        for i, p in enumerate(block.parts.tolist()):
            (a, b), (c, d) = block.cuts[0][i : i + 2], block.cuts[1][i : i + 2]
            out.append((number, p, *(x.tobytes() for x in (block.keys[0][a:b], block.counts[0][a:b], block.keys[1][c:d], block.counts[1][c:d]))))
        return pd.DataFrame(out, columns=["block", "part", "paths", "path_n", "words", "word_n"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        label, path = pd.factorize(_joined(pdf["paths"]))
        n = np.bincount(label, _joined(pdf["path_n"]), len(path)).astype(np.int64)
        part = int(pdf["part"].iat[0])
        return pd.DataFrame([(part // parts.splits, part, path.tobytes(), n.tobytes())], columns=["context", "part", "paths", "path_n"])

    def judged(pdf: pd.DataFrame) -> pd.DataFrame:
        path, n = _joined(pdf["paths"]), _joined(pdf["path_n"])
        by = np.argsort(path)
        lp = np.empty(len(path))
        lp[by] = log_probabilities(path[by], n[by], sent.value)
        ends = np.cumsum([len(x) // 8 for x in pdf["paths"]])
        return pd.DataFrame({"part": pdf["part"], "paths": pdf["paths"], "lp": [v.tobytes() for v in np.split(lp, ends[:-1])]})

    def answered(tells: pd.DataFrame, trie: pd.DataFrame) -> pd.DataFrame:
        if not len(tells):
            return pd.DataFrame(columns=["block", "part", "path_lp", "word_c"])
        path, lp = _joined(trie["paths"]), np.frombuffer(b"".join(trie["lp"]), np.float64)
        by = np.argsort(path)
        path, lp = path[by], lp[by]
        out = [lp[np.searchsorted(path, np.frombuffer(x, np.int64))].tobytes() for x in tells["paths"]]
        label, words = pd.factorize(_joined(tells["words"]))
        total = np.bincount(label, _joined(tells["word_n"]), len(words)).astype(float)
        ends = np.cumsum([len(x) // 8 for x in tells["words"]])
        return pd.DataFrame({"block": tells["block"], "part": tells["part"], "path_lp": out, "word_c": [v.tobytes() for v in np.split(total[label], ends[:-1])]})

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["id", "held_out", "n_tokens", "n_known", "base", "score"])
        block = Block(left["text"], left["held_out"], parts)
        right = right.sort_values("part")
        lp, c = (np.frombuffer(b"".join(right[x]), np.float64) for x in ("path_lp", "word_c"))
        n = np.concatenate([s[1] for s in block.sizes])
        return pd.DataFrame({
            "id": left["id"], "held_out": left["held_out"], "n_tokens": n, "n_known": block.sums(1, (c > 0).astype(np.int64)),
            "base": block.sums(1, np.log10(c + 1)), "score": block.sums(0, lp),
        })

    tells = rows.groupBy("block").applyInPandas(told, "block int, part int, paths binary, path_n binary, words binary, word_n binary")
    trie = tells.groupBy("part").applyInPandas(summed, "context int, part int, paths binary, path_n binary")
    trie = trie.groupBy("context").applyInPandas(judged, "part int, paths binary, lp binary")
    answers = tells.groupBy("part").cogroup(trie.groupBy("part")).applyInPandas(answered, "block int, part int, path_lp binary, word_c binary")
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        scored, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    )
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n_train + n_kinds + 1)))
    return out.select(
        back(F.col("id")).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )

"""Language identification by string kernels: Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, carried, cut_lineage, id_crc, small_batches, steps

#: Columns of the 1-, 2- and 3-byte grams; the last are hashed.
SIZES = (1 << 8, 1 << 16, 1 << 17)
#: Rows of one kernel block.
ROWS = 64
#: Bounds of what the kernel is learnt from: languages (those with most texts), and bytes of a text (longer ones
#: are not learnt from). With `each` texts a language they bound the sample: 256 * 256 texts of 16 KB.
LANGUAGES, LEARNT_BYTES = 256, 1 << 14
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(raws: list[bytes]) -> list[np.ndarray]:
    """For each gram length a (texts, grams) matrix of which grams (A-Z lower-cased) a text holds at all."""
    n = np.fromiter(map(len, raws), np.int64, len(raws))
    flat = LOWER[np.frombuffer(b"".join(raws), np.uint8)].astype(np.uint32)
    doc = np.repeat(np.arange(len(raws)), n)
    out, code = [], flat
    for k, size in enumerate(SIZES):
        m = np.zeros((len(raws), size), bool)
        if k:
            code = (code[:-1] << np.uint32(8)) | flat[k:]
            inside = doc[k:] == doc[: len(doc) - k]
            at, own = code[inside], doc[k:][inside]
        else:
            at, own = code, doc
        if size < 1 << 8 * (k + 1):
            at = (at * np.uint32(0x9E3779B1)) >> np.uint32(32 - size.bit_length() + 1)
        m[own, at] = True
        out.append(m)
    return out


@dataclass(frozen=True)
class Kernel:
    """Landmark texts as columns of the grams they hold, and the regression weights on them."""

    grams: list
    landmarks: list
    weights: np.ndarray
    languages: list

    def block(self, raws: list[bytes]) -> np.ndarray:
        """Blended spectrum presence kernel of texts with the landmarks: the mean cosine over gram lengths."""
        return self.compare(raws)[0]

    def compare(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The kernel with the landmarks, and the share of a text's grams that stand in any landmark."""
        known, grams = np.zeros(len(raws)), np.zeros(len(raws))
        out = np.zeros((len(raws), len(self.weights) if len(self.weights) else self.landmarks[0].shape[1]), np.float32)
        for m, cols, held in zip(presence(raws), self.grams, self.landmarks, strict=True):
            n, own = m.sum(axis=1), m[:, cols].astype(np.float32)
            norm = np.sqrt(np.maximum(n, 1)).astype(np.float32)
            out += (own @ held) / norm[:, None]
            known += own.sum(axis=1)
            grams += n
        return out / len(SIZES), known / np.maximum(grams, 1)

    def predict(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each text, its score, and the share of the text's grams that are known."""
        k, known = self.compare(raws)
        f = k @ self.weights
        best = f.argmax(axis=1)
        return best, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1), known


def fit(raws: list[bytes], languages: list[str], landmarks_each: int = 32, ridge: float = 1e-4) -> Kernel | None:
    """Landmarks are the first texts of each language; all texts fit the ridge regression. None without texts."""
    names = sorted(set(languages))
    if not names:
        return None
    picked = [i for name in names for i in [j for j, x in enumerate(languages) if x == name][:landmarks_each]]
    grams, held = [], []
    for m in presence([raws[i] for i in picked]):
        cols = np.flatnonzero(m.any(axis=0))
        grams.append(cols)
        held.append((m[:, cols] / np.sqrt(np.maximum(m.sum(axis=1), 1))[:, None]).T.astype(np.float32))
    empty = Kernel(grams, held, np.empty(0), names)
    blocks = [raws[i : i + ROWS] for i in range(0, len(raws), ROWS)]
    k_nm = np.concatenate([empty.block(b) for b in blocks]).astype(float)
    k_mm = empty.block([raws[i] for i in picked]).astype(float)
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    left = k_nm.T @ k_nm + ridge * len(raws) * k_mm + 1e-8 * np.eye(len(picked)) * len(raws)
    weights = np.linalg.solve(left, k_nm.T @ y).astype(np.float32)
    return Kernel(grams, held, weights, names)


def learn(df: DataFrame, each: int, held_out, id_col: str, text_col: str, lang_col: str) -> Kernel | None:
    """A kernel from at most `each` texts of each language: of each of `each` hash classes of ids the least.

    Of more than LANGUAGES languages those with most texts are learnt, of equally many the first by name; texts
    above LEARNT_BYTES are not learnt from. Rows are picked by numbers alone, then only their texts are read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    rows = rows.where(F.octet_length("text") <= LEARNT_BYTES).withColumn("spot", F.xxhash64("id"))
    least = cut_lineage(rows.groupBy("lang", F.pmod("spot", F.lit(each)).alias("class")).agg(F.min("spot").alias("spot"), F.count("*").alias("n")))
    common = least.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).select("lang")
    least = least.join(F.broadcast(common), "lang").select("lang", "spot")
    # at most `each` * LANGUAGES rows
    texts = rows.join(F.broadcast(least), ["lang", "spot"]).dropDuplicates(["lang", "spot"])
    known = texts.select("lang", "spot", "text").orderBy("spot", "lang").toPandas()
    known = known[known["text"].map(lambda t: has_letter(t)).astype(bool)]
    return fit([t.encode("utf-8", "surrogatepass") for t in known["text"]], known["lang"].tolist())


def languages(
    df: DataFrame, held_out=None, each: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", row_col: str | None = None, least_known: float = 0.0
) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (0 to 1).

    The kernel learns from at most `each` texts of up to LEARNT_BYTES bytes of each non-null language among the
    rows not held out, and of the LANGUAGES languages with most such texts, so what is gathered and sent to the
    workers is bounded whatever the rows; a prediction sees the whole text only. Null texts and texts without a letter are `und` with score 0, and
    so are all texts when there is nothing to learn from. Ties go to the language first by name. Null ids
    are predicted and held in. An empty table gives no rows; other columns don't matter.

    held_out: a column function of the id, by default crc32(id as text) mod 3 = 1.
    row_col: a column without nulls that is given back with each row, where ids don't tell rows apart.
    least_known: texts of whose distinct grams a smaller share stands in any landmark text are `und` with
    score 0 too; by default each text with a letter is given the best of the learnt languages.
    """
    apart = held_out or (lambda c: F.coalesce(F.pmod(id_crc(c), F.lit(3)) == 1, F.lit(False)))
    kernel = learn(df, each, apart, id_col, text_col, lang_col)
    own = [F.col(row_col).alias("row")] if row_col else []
    small_batches(df)
    named, _, back = carried(df, id_col)
    rows = df.select(named.alias("id"), *own, F.col(text_col).alias("text"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    sent = df.sparkSession.sparkContext.broadcast(kernel)

    def run(batches):
        model = sent.value
        for pdf in batches:
            name = np.full(len(pdf), UNKNOWN, object)
            score = np.zeros(len(pdf))
            some = np.array([has_letter(t) for t in pdf["text"]], bool)
            at = np.flatnonzero(some)
            if model is not None and len(at):
                for first, raws in steps(pdf["text"].iloc[at].tolist()):
                    for i in range(0, len(raws), ROWS):
                        best, value, known = model.predict(raws[i : i + ROWS])
                        spot, meets = at[first + i : first + i + len(best)], known >= least_known
                        spot, best, value = spot[meets], best[meets], value[meets]
                        name[spot] = np.array(model.languages, object)[best]
                        score[spot] = value
            yield pdf.drop(columns="text").assign(lang_pred=name, score=score)

    out = rows.mapInPandas(run, f"{kind}, lang_pred string, score double")
    own = [F.col("row").alias(row_col)] if row_col else []
    named = back(F.col("id"))
    return out.select(named.alias(id_col), *own, apart(named).alias("held_out"), "lang_pred", "score")

"""Fill in the middle: texts cut at units that an Aho-Corasick scan of class changes counts, parts put in another order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import small_batches

#: The marks before prefix, suffix and middle (fixed).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)

#: Classes of code points: letters A-Z and a-z are one but for those in sentinels, all else is another but for < and >.
_LETTERS, _OTHERS = "aPSM", " <>"
_CLASS = np.full(129, ord(" "), np.uint8)
_CLASS[65:91] = _CLASS[97:123] = ord("a")
_CLASS[[ord(c) for c in "PSM<>"]] = [ord(c) for c in "PSM<>"]
#: What an event says: a letter follows what is none, the other way round, or a sentinel ends here.
_CHANGE, _SENTINEL = 1, 2
_EVENT = np.dtype([("at", np.int64), ("what", np.int64)])


@lru_cache
def _automaton() -> ahocorasick.Automaton:
    """One automaton of all pairs of classes at which a run of letters begins or ends, and the sentinels."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for a in _LETTERS:
        for b in _OTHERS:
            found.add_word(a + b, _CHANGE)
            found.add_word(b + a, _CHANGE)
    for s in SENTINELS:
        found.add_word(s, _SENTINEL)
    found.make_automaton()
    return found


class Units:
    """The units of a text ([A-Za-z]+ or one other code point), known by the places where its class changes.

    Between two events nothing is stored: a gap of letters is one unit, any other gap has as many units as code
    points, so a unit's place is found by a search among the sums of the gaps and an addition.
    """

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = _CLASS[np.minimum(points, 128)].tobytes().decode("ascii")
        # the text is led by a code point that is no letter, so that letters at its start are a change
        events = np.fromiter(_automaton().iter(" " + classes), _EVENT)
        self.sentinel = bool((events["what"] == _SENTINEL).any())
        self.edges = np.concatenate(([0], events["at"][events["what"] == _CHANGE] - 1, [len(points)]))
        units = np.diff(self.edges)
        units[1::2] = 1
        self.sums = np.concatenate(([0], np.cumsum(units)))

    @property
    def n(self) -> int:
        return int(self.sums[-1])

    def end_of(self, rank: int) -> int:
        """The code points that the first `rank` units hold."""
        if rank <= 0:
            return 0
        gap = int(np.searchsorted(self.sums, rank)) - 1
        if gap % 2:
            return int(self.edges[gap + 1])
        return int(self.edges[gap] + rank - self.sums[gap])


_CUT = StructType([StructField("n", LongType()), StructField("sentinel", BooleanType()), StructField("first", LongType()), StructField("second", LongType())])


@pandas_udf(_CUT)
def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, one, two in batches:
        rows = []
        for text, a, b in zip(texts, one.tolist(), two.tolist(), strict=True):
            units = Units(text)
            a, b = a % (units.n + 1), b % (units.n + 1)
            rows.append((units.n, units.sentinel, units.end_of(min(a, b)), units.end_of(max(a, b))))
        yield pd.DataFrame(rows, columns=_CUT.names)


def restored(output: Column, form: Column) -> Column:
    """The text that gave this output in this form: a text without sentinels has each mark once, so nothing is guessed."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20
) -> DataFrame:
    """One row per input row: id, n (units), form, prefix_chars, middle_chars, output; other columns don't matter.

    Units are runs of A-Z and a-z and single other code points. sha256(`seed:id`), whose first four groups of
    eight digits are numbers h1 to h4, draws all: prefix and middle end after h1 % (n + 1) and h2 % (n + 1) units,
    in their order. A text that is empty, holds a sentinel or has h3 % 100 >= plain_from stays as it is (plain);
    of the rest h4 % 100 < spm_below is <S>suffix<P>prefix<M>middle (spm), else <P>prefix<S>suffix<M>middle (psm).
    prefix_chars and middle_chars are code points, null for plain. Null text counts as empty. Rows that repeat an
    id draw the same numbers and are cut by their own texts; a null id is drawn as an empty one. An empty table
    gives no rows.

    Each row is for itself: no shuffle; the worker gets the text and gives back four numbers, the parts are put
    together inside the engine. A worker holds the events of one text at a time.
    """
    small_batches(df)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), named.alias("digest"))
    drawn = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = rows.select("id", "text", *drawn)
    rows = rows.select("id", "text", "h3", "h4", _cuts("text", "h1", "h2").alias("cut"))
    plain = (F.col("text") == "") | F.col("cut.sentinel") | (F.col("h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("id", "text", "cut", form.alias("form"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substring("text", F.lit(1), first)
    middle = F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.char_length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    whole = F.col("form") == "plain"
    return rows.select(
        F.col("id").alias(id_col), F.col("cut.n").alias("n"), "form", F.when(~whole, F.col("cut.first")).alias("prefix_chars"),
        F.when(~whole, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"), output.alias("output"),
    )

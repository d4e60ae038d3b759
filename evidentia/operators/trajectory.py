"""Dated transitions of every key inside a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.timeaxis import micros
from evidentia.operators.state import KEY, VALUE
from evidentia.operators.sweep import WHOLE, running, turns
from evidentia.plans.lineage import cut

#: Parts that a window's times are split into for larger keys.
PARTS = 4096
#: Levels of blocks of time, each twice as long as the one below; a window has 2^LEVELS of the shortest at most.
LEVELS = 16


def _inside(start: str, end: str, kind: str, lo, hi):
    """Where state may change inside [lo, hi): starts, and ends strictly inside."""
    s, e = F.col(start), F.col(end)
    return F.filter(F.array(F.when((s >= lo) & (s < hi), s), F.when((F.col(kind) != "instant") & (e > lo) & (e < hi), e)), lambda x: x.isNotNull())


def boundaries(cands: DataFrame, lo, hi) -> DataFrame:
    """Distinct boundaries (column t) of all keys; rejected rows have none, counter-only and hypothesized ones do."""
    rows = cands.where("status <> 'rejected'").where("temporal_kind <> 'unknown'")
    return rows.select(F.explode(_inside("valid_start", "valid_end", "temporal_kind", lo, hi)).alias("t")).distinct()


def following(times: DataFrame) -> DataFrame:
    """Each time with the next one (t, next). No sort runs over all times: each hour looks inside itself, and
    for its last time at the first time of the next hour that has any."""
    hour = F.date_trunc("hour", F.col("t")).cast("timestamp_ntz")
    by = times.withColumn("hour", hour)
    hours = by.groupBy("hour").agg(F.min("t").alias("first"))
    hours = hours.select("hour", F.lead("first").over(Window.orderBy("hour")).alias("later"))  # one row an hour of the window
    inner = by.withColumn("inner", F.lead("t").over(Window.partitionBy("hour").orderBy("t")))
    return inner.join(hours, "hour").select("t", F.coalesce("inner", "later").alias("next"))


def _ntz(t) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def spans(cands: DataFrame, lo, hi) -> DataFrame:
    """Rows with their class (s, t_time, t_hypo or c) and the span [low, high) of the window in which they count, in microseconds.

    One microsecond before the window stands for the state just before it: what reaches up to the window counts
    there. An instant lasts until the next boundary of *any* key, an unknown time all along.
    """
    lo, hi = _ntz(lo), _ntz(hi)
    rows = cands.where("status <> 'rejected'")
    instant = F.col("temporal_kind") == "instant"
    after = following(boundaries(cands, lo, hi)).withColumnRenamed("t", "valid_start")
    # only instants look for what follows them
    held = rows.where(instant & (F.col("valid_start") >= lo) & (F.col("valid_start") < hi)).join(after, "valid_start", "left").select(*rows.columns, "next")
    rows = rows.where(~instant).select("*", F.lit(None).cast("timestamp_ntz").alias("next")).unionByName(held)
    first, last, start, end = micros(lo), micros(hi), micros("valid_start"), micros("valid_end")
    unknown = F.col("temporal_kind") == "unknown"
    low = F.when(unknown | F.col("valid_start").isNull() | (start < first), first - 1).otherwise(start)
    high = F.when(instant, F.coalesce(micros("next"), last)).when(unknown | end.isNull() | (end > last), last).otherwise(end)
    cls = F.when(~F.col("supported"), "c").when(unknown | (F.col("temporal_kind") == "window"), "t_time").when(F.col("status") == "hypothesized", "t_hypo").otherwise("s")
    return rows.withColumns({"cls": cls, "low": low, "high": high}).drop("next").where(F.col("low") < F.col("high"))


def transitions(cands: DataFrame, lo, hi) -> DataFrame:
    """Per key and boundary at most one row: added, removed or changed between adjacent pieces of the window.

    Only facts make transitions; a key that turns unresolved is removed. Unresolved keys of either side are
    told by before_outcome and after_outcome.

    A sweep: rows add to their value's counts from where they begin until they end, values to their key's, so
    the state after each change and before it follow from running sums; no row meets another row. A key with
    more than WHOLE changes is split by time. Which single value holds is told by sums of a hash of 62 bits.
    """
    rows = spans(cands, lo, hi)
    kinds = ("s", "t_time", "t_hypo", "c")
    counts = turns(rows, [*KEY, *VALUE], "low", "high", {k: (F.col("cls") == k).cast("long") for k in kinds})
    counts = cut(counts)
    of_keys = counts.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))
    largest, width = of_keys.agg(F.max("n"), F.max("high") - F.min("low")).first()
    span = None if (largest or 0) <= WHOLE else max(1, width // PARTS)
    counts = counts.repartition(*KEY) if span is None else counts  # a key's rows are brought together once

    values = running(counts, [*KEY, *VALUE], list(kinds), span)
    hashed = F.xxhash64(*VALUE)
    mark = {"v1": F.shiftrightunsigned(hashed, 33), "v2": hashed.bitwiseAND((1 << 31) - 1)}

    def holds(when):  # of a value: what it adds to its key's state
        s = when("s") > 0
        return {"n_s": s, "n_c": when("c") > 0, "n_time": (when("t_time") > 0) & ~s, "n_hypo": (when("t_hypo") > 0) & ~s}

    now, before = holds(lambda k: F.col(f"{k}_now")), holds(lambda k: F.col(f"{k}_now") - F.col(k))
    steps = values.select(*KEY, *VALUE, "t", *((now[k].cast("long") - before[k].cast("long")).alias(k) for k in now))
    steps = steps.select(*KEY, "t", *now, *((F.col("n_s") * v).alias(k) for k, v in mark.items()))
    sums = [*now, *mark]
    steps = steps.groupBy(*KEY, "t").agg(*(F.sum(k).alias(k) for k in sums))
    states = running(steps, KEY, sums, span).where((F.col("t") >= micros(_ntz(lo))) & (F.col("t") < micros(_ntz(hi))))

    def state(of):
        fact = (of("n_s") == 1) & (of("n_c") == 0) & (of("n_time") == 0) & (of("n_hypo") == 0)
        return fact, F.when(fact, "resolved").when(of("n_time") > 0, "temporal-uncertainty").when(of("n_hypo") > 0, "hypothesized").when(of("n_s") > 1, "conflicting-values").when(of("n_c") > 0, "counterevidence-only")

    sides = {"before": lambda k: F.col(f"{k}_now") - F.col(k), "after": lambda k: F.col(f"{k}_now")}
    (had, before_outcome), (has, after_outcome) = (state(of) for of in sides.values())
    same = (F.col("v1") == 0) & (F.col("v2") == 0)
    change = F.when(has & ~had, "added").when(had & ~has, "removed").when(had & has & ~same, "changed")
    instant = F.expr("timestampadd(MICROSECOND, t, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    out = states.select(
        *KEY, instant.alias("instant"), change.alias("change"), before_outcome.alias("before_outcome"), after_outcome.alias("after_outcome"),
        *(F.when(ok, sides[side](k)).alias(f"{side}_{k}") for side, ok in (("before", had), ("after", has)) for k in mark),
    ).where("change is not null")
    known = rows.where("cls = 's'").select(*KEY, *VALUE).distinct()
    for side in sides:
        names = known.select(*KEY, *(v.alias(f"{side}_{k}") for k, v in mark.items()), *(F.col(v).alias(f"{side}_{v}") for v in VALUE))
        out = out.join(names, [*KEY, *(f"{side}_{k}" for k in mark)], "left")
    return out.select(*KEY, "instant", "change", *(f"before_{v}" for v in VALUE), *(f"after_{v}" for v in VALUE), "before_outcome", "after_outcome")


def _parts(t: Column, width: int) -> Column:
    """How many whole parts lie before t."""
    return F.call_function("div", t, F.lit(width).cast("long"))


def cover(low: Column, high: Column, width: int, levels: int = LEVELS) -> Column:
    """The blocks (level, block) that [low, high) is made of: at most two of each level, none twice.

    A block of level k is 2^k parts of `width` long. What is left at both ends, less than a part, is told as level -1:
    the part it lies in, of which only some times belong to the span. Times are not below 0.
    """
    first, last = _parts(low + width - 1, width), _parts(high, width)

    def of_level(k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        a, b = F.call_function("shiftright", first + step - 1, k), F.call_function("shiftright", last, k)
        left = F.when((a < b) & (a % 2 == 1), F.struct(k.alias("level"), a.alias("block")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(k.alias("level"), (b - 1).alias("block")))
        return F.array(left, right)

    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level))
    from_, until = _parts(low, width), _parts(high - 1, width)
    part = lambda when, at: F.when(when, F.struct(F.lit(-1).alias("level"), at.alias("block")))
    head = part((low % width != 0) | (from_ >= last), from_)
    tail = part((high % width != 0) & (until != from_) & (until >= last), until)
    return F.filter(F.concat(whole, F.array(head, tail)), lambda x: x.isNotNull())


def blocks_at(t: Column, width: int, levels: int = LEVELS) -> Column:
    """The blocks that a time lies in: one of each level of cover(), and the part of level -1."""
    part = _parts(t, width)
    return F.transform(F.sequence(F.lit(-1), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", part, F.greatest(k, F.lit(0))).alias("block")))


def material(cands: DataFrame, moves: DataFrame, lo, hi) -> DataFrame:
    """(key, instant, side, outcome, value, cls, obs_id, recorded_at): the observations that tell each transition's two sides.

    A side that is a fact has its supported rows, an unresolved side all rows of its candidates. moves: some
    transitions() of the same rows.

    Rows meet only the transitions that they tell: each row's span is cut into a few blocks of time, each
    transition looks into the blocks that hold it, and both are joined by key and block. A span and a time share one
    block at most, so nothing is found twice, and a key of many rows and transitions is dealt by its blocks.
    """
    first, last = cands.sparkSession.range(1).select(micros(_ntz(lo)), micros(_ntz(hi))).first()
    width = max(1, -(-(last - first + 1) // (1 << LEVELS)))
    at = moves.select(*KEY, "instant", F.explode(F.array(
        F.struct(F.lit("before").alias("side"), F.col("before_outcome").alias("outcome"), (micros("instant") - 1).alias("t")),
        F.struct(F.lit("after").alias("side"), F.col("after_outcome").alias("outcome"), micros("instant").alias("t")),
    )).alias("s")).select(*KEY, "instant", "s.*").where("outcome is not null")
    zero = F.lit(first - 1)
    at = at.withColumn("_b", F.explode(blocks_at(F.col("t") - zero, width))).select("*", "_b.level", "_b.block").drop("_b")
    rows = spans(cands, lo, hi).withColumn("_b", F.explode(cover(F.col("low") - zero, F.col("high") - zero, width))).select("*", "_b.level", "_b.block").drop("_b")
    found = rows.join(at, [*KEY, "level", "block"]).where((F.col("level") >= 0) | ((F.col("low") <= F.col("t")) & (F.col("t") < F.col("high"))))
    return found.where("outcome <> 'resolved' or cls = 's'").select(*KEY, "instant", "side", "outcome", *VALUE, "cls", "obs_id", "recorded_at")


def ties(told: DataFrame) -> DataFrame:
    """(key, instant, first_recorded, first_obs): what orders transitions of one instant, over both sides of material()."""
    return told.groupBy(*KEY, "instant").agg(F.min("recorded_at").alias("first_recorded"), F.min("obs_id").alias("first_obs"))

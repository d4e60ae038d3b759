"""Ordered funnels: strict as-of joins inside client-time ranges find each row's next step, Spark follows and ranks them."""

from __future__ import annotations

from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage


@dataclass(frozen=True)
class Funnel:
    """Kinds of rows in their order; a row of kind `excluded` between two steps ends an attempt."""

    name: str
    steps: tuple[str, ...]
    excluded: str


#: Rows that a worker joins at once (a range is never parted).
CHUNK = 1 << 16
#: A range with more rows is cut into PARTS; so is none with less than a 2^20th of all rows, so few are cut.
DENSE, FEW, PARTS = 1 << 18, 20, 64
#: Times are ranked by so many bits at once.
BITS = 10


def micros(ts: Column, kind: str) -> Column:
    """Microseconds since 1970; a timestamp without a zone is taken as it stands, whatever the session's zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts)
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000 + second


def _sql(links: list[tuple[int, int, int]], firsts: list[int], within: int) -> str:
    """One statement for a chunk: an as-of join for each link's next row, one for its exclusion, and the first steps' counts."""
    same = "a.client = {0}.client AND a.slot = {0}.slot AND a.part = {0}.part AND a.at < {0}.at"
    parts = [
        f"SELECT CAST({i} AS INTEGER) AS link, a.client, a.at, b.at AS next, CAST(1 AS BIGINT) AS n FROM (SELECT * FROM own WHERE kind = {start}) a"
        f" ASOF JOIN (SELECT * FROM chunk WHERE kind = {end}) b ON {same.format('b')}"
        f" ASOF LEFT JOIN (SELECT * FROM chunk WHERE kind = {excluded}) e ON {same.format('e')}"
        f" WHERE b.at - a.at <= {within} AND (e.at IS NULL OR e.at > b.at)"
        for i, (start, end, excluded) in enumerate(links)
    ]
    parts += [
        f"SELECT CAST({-1 - k} AS INTEGER), client, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), count(*) FROM own WHERE kind = {k} GROUP BY client" for k in firsts
    ]
    return "WITH own AS (SELECT * FROM chunk WHERE own) " + " UNION ALL ".join(parts)


def _chunks(batches):
    """Whole ranges, about CHUNK rows at once; rows come sorted by range."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        unit = table.column("unit").to_numpy()
        cut = int((unit != unit[-1]).argmin()) if unit[0] != unit[-1] else 0
        # the last range goes on in the next batch
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows if cut else 0
    if held:
        yield pa.Table.from_batches(held)


def _links(sql: str, schema: pa.Schema):
    def run(batches):
        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as db:
            for chunk in _chunks(batches):
                db.register("chunk", chunk)
                yield from db.sql(sql).to_arrow_table().cast(schema).to_batches()
                db.unregister("chunk")

    return run


def _ranges(rows: DataFrame, within: int, dense_rows: int) -> DataFrame:
    """(client, kind, at) as ranges (client, slot, part) of `within` at most, with the rows after each that matter to it.

    A range's halo is the first row of each kind after its end: any later one is no next row of the range, and one
    that is more than `within` away is no matter. A slot is `within` long, so its halo lies in the next slot. Slots
    of more than dense_rows rows (or a 2^20th of all rows, if that is more, so there are at most 2^20 such slots) are
    cut into PARTS; the first rows of each part are the halo of the parts before it, back to the last with that kind.
    """
    slot = F.expr(f"(at - pmod(at, {within})) div {within}")
    rows = rows.withColumn("slot", slot)
    counts = rows.groupBy("client", "slot").agg(F.count("*").alias("n"))
    most = max(dense_rows, (counts.agg(F.sum("n")).first()[0] or 0) >> FEW)
    dense = cut_lineage(counts.where(F.col("n") > most).select("client", "slot", F.lit(True).alias("dense")))

    part = F.when(F.col("dense"), F.expr(f"pmod(at, {within}) * {PARTS} div {within}")).otherwise(0).cast("int")
    own = rows.join(F.broadcast(dense), ["client", "slot"], "left").withColumn("part", part)
    firsts = rows.groupBy("client", "slot", "kind").agg(F.min("at").alias("at"))
    after = firsts.withColumn("slot", F.col("slot") - 1).join(F.broadcast(dense), ["client", "slot"], "left")
    columns = ["client", "slot", "part", "kind", "at"]
    halo = after.where("dense is null").withColumn("part", F.lit(0)).select(*columns)

    inner = own.where("dense").groupBy("client", "slot", "part", "kind").agg(F.min("at").alias("at")).select(*columns)
    inner = inner.unionByName(after.where("dense").withColumn("part", F.lit(PARTS)).select(*columns))
    before = F.coalesce(F.lag("part").over(Window.partitionBy("client", "slot", "kind").orderBy("part")), F.lit(0))
    inner = inner.withColumn("before", before).where(F.col("part") > F.col("before"))
    inner = inner.withColumn("part", F.explode(F.sequence("before", F.col("part") - 1))).select(*columns)

    own = own.select(*columns).distinct().withColumn("own", F.lit(True))
    return own.unionByName(halo.unionByName(inner).withColumn("own", F.lit(False)))


def _medians(times: DataFrame, key: list[str], top: int) -> DataFrame:
    """key, n (sum of w), t: the ceil(n / 2)-th smallest time, each counted w times; times are below 2^top.

    The rank is followed down the times' bits, BITS at a level: a level counts each key's values of these bits among
    the times with the bits found so far, at most 2^BITS of them, and keeps the value that holds the rank.
    """
    shift = max(0, -(-top // BITS) - 1) * BITS
    over = Window.partitionBy(*key).orderBy("bits")
    found = None
    while shift >= 0:
        rows = times.withColumn("above", F.shiftright("time", shift + BITS)).withColumn("bits", F.shiftright("time", shift))
        held = ["n", "rest"]
        if found is not None:
            rows = rows.join(found.withColumnRenamed("bits", "above"), [*key, "above"])
            level = rows.groupBy(*key, "bits", *held).agg(F.sum("w").alias("w"))
        else:
            level = rows.groupBy(*key, "bits").agg(F.sum("w").alias("w"))
            level = level.withColumn("n", F.sum("w").over(Window.partitionBy(*key))).withColumn("rest", F.expr("(n + 1) div 2"))
        level = level.withColumn("until", F.sum("w").over(over)).where(F.col("until").between(F.col("rest"), F.col("rest") + F.col("w") - 1))
        found = level.select(*key, "bits", "n", (F.col("rest") - F.col("until") + F.col("w")).alias("rest"))
        shift -= BITS
    return found.select(*key, "n", F.col("bits").alias("t"))


def funnel_counts(
    df: DataFrame, funnels: list[Funnel], within: int = 900_000_000, client_col: str = "client_id", kind_col: str = "kind", ts_col: str = "ts", dense_rows: int = DENSE
) -> DataFrame:
    """One row per funnel and client with attempts: funnel, client, n1.., deepest, t2.., same_depth.

    Rows with a null client, kind or time are left out, rows that repeat all three count once, other columns don't
    matter. Each row of a funnel's first kind starts an attempt. The next step is the client's earliest row of its
    kind later than the step before (rows at the same microsecond don't follow each other); it is reached unless more
    than `within` microseconds have gone by, or an excluded row lies after the step before and not after it. n: the
    attempts that reach each step; deepest: the last step that any reached; t: the ceil(n / 2)-th smallest of the
    microseconds from the step before, null where n is 0; same_depth: clients of the same funnel and deepest. Funnels
    may differ in length: a step that a funnel lacks has n 0. An empty table gives no rows.

    1. Rows are dealt to ranges of a client and a time, with the first rows after each (see _ranges): a client with
       any share of the rows is shared among tasks.
    2. In each range one strict as-of join finds the next row of each kind and one the next exclusion; only steps
       that are reached leave it. Attempts that meet in a row go on as one with their number.
    3. Steps are followed by joins on (client, time), which no client makes uneven, and times are ranked by their
       bits, so no client's times meet in one task.
    """
    kinds = sorted({k for f in funnels for k in (*f.steps, f.excluded)})
    code = {k: i for i, k in enumerate(kinds)}
    steps = [(f.name, s + 1, (code[f.steps[s]], code[f.steps[s + 1]], code[f.excluded])) for f in funnels for s in range(len(f.steps) - 1)]
    links = sorted({link for _, _, link in steps})
    firsts = sorted({code[f.steps[0]] for f in funnels})
    longest = max(len(f.steps) for f in funnels)

    kind = F.element_at(F.create_map(*[F.lit(x) for pair in code.items() for x in pair]), F.col(kind_col))
    rows = df.select(F.col(client_col).alias("client"), kind.cast("int").alias("kind"), micros(F.col(ts_col), dict(df.dtypes)[ts_col]).alias("at")).dropna()
    ranged = _ranges(rows, within, dense_rows).withColumn("unit", F.xxhash64("client", "slot", "part"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartition(parts, "unit").sortWithinPartitions("unit")
    whole = dict(df.dtypes)[client_col]
    out = f"link int, client {whole}, at long, next long, n long"
    typed = pa.schema([("link", pa.int32()), ("client", pa.string() if whole == "string" else pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("n", pa.int64())])
    client = F.col("client") if whole == "string" else F.col("client").cast("long")
    found = ranged.withColumn("client", client).mapInArrow(_links(_sql(links, firsts, within), typed), out.replace(whole, "string" if whole == "string" else "long", 1))
    found = cut_lineage(found.withColumn("client", F.col("client").cast(whole)))

    used = {i: [(name, step) for name, step, link in steps if link == links[i]] for i in range(len(links))}
    used |= {-1 - k: [(f.name, 0) for f in funnels if code[f.steps[0]] == k] for k in firsts}
    of = F.create_map(*[x for i, u in used.items() for x in (F.lit(i), F.array(*[F.struct(F.lit(a).alias("funnel"), F.lit(b).alias("step")) for a, b in u]))])
    found = found.withColumn("use", F.explode(F.element_at(of, F.col("link")))).select("use.*", "client", "at", "next", "n")

    starts = found.where("step = 0").groupBy("funnel", "client").agg(F.sum("n").alias("n1"))
    key = ["funnel", "client"]
    times, states = [], None
    for step in range(1, longest):
        rows = found.where(F.col("step") == step)
        if states is None:
            rows = rows.withColumn("w", F.lit(1).cast("long"))
        else:
            rows = rows.join(states.withColumnRenamed("next", "at"), [*key, "at"])
        rows = rows.select(*key, "at", "next", "w")
        times.append(rows.select(*key, F.lit(step + 1).alias("step"), (F.col("next") - F.col("at")).alias("time"), "w"))
        states = rows.groupBy(*key, "next").agg(F.sum("w").alias("w"))
    reached = times[0]
    for more in times[1:]:
        reached = reached.unionByName(more)
    reached = cut_lineage(reached.groupBy(*key, "step", "time").agg(F.sum("w").alias("w")))
    ranked = _medians(reached, [*key, "step"], within.bit_length())
    each = [x for s in range(2, longest + 1) for x in (F.max(F.when(F.col("step") == s, F.col("n"))).alias(f"n{s}"), F.max(F.when(F.col("step") == s, F.col("t"))).alias(f"t{s}"))]
    deepest = F.greatest(F.lit(1), *[F.when(F.col(f"n{s}") > 0, s) for s in range(2, longest + 1)])
    rows = starts.join(ranked.groupBy(*key).agg(*each), key, "left").withColumn("deepest", deepest)
    rows = cut_lineage(rows)
    depths = rows.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    rows = rows.join(F.broadcast(depths), ["funnel", "deepest"])
    return rows.select(
        "funnel", F.col("client").alias(client_col), "n1", *[F.coalesce(f"n{s}", F.lit(0)).cast("long").alias(f"n{s}") for s in range(2, longest + 1)],
        "deepest", *[f"t{s}" for s in range(2, longest + 1)], "same_depth",
    )

"""Sharding along a Hilbert curve over quantised metadata, with DataFrame functions only."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

BITS = 4  # of each of the three quantised dimensions: 4,096 cells


@lru_cache
def curve(bits: int = BITS, dims: int = 3) -> tuple[int, ...]:
    """The Hilbert index of every cell, by row-major cell number (Skilling's transpose form of the curve)."""
    side, out = 1 << bits, []
    for cell in range(side**dims):
        x = [cell >> (bits * (dims - 1 - d)) & (side - 1) for d in range(dims)]
        q = side >> 1
        while q > 1:
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[d]) & (q - 1)
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        t, q = 0, side >> 1
        while q > 1:
            if x[dims - 1] & q:
                t ^= q - 1
            q >>= 1
        index = 0
        for b in range(bits - 1, -1, -1):
            for d in range(dims):
                index = index << 1 | ((x[d] ^ t) >> b & 1)
        out.append(index)
    return tuple(out)


def hilbert_index(*coordinates, bits: int = BITS):
    """The curve index of quantised coordinates (columns of 0 to 2^bits - 1), from a table made by rule."""
    cell = F.lit(0)
    for c in coordinates:
        cell = cell * (1 << bits) + c
    return F.element_at(F.array(*map(F.lit, curve(bits, len(coordinates)))), (cell + 1).cast("int"))


def category_step(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with `out`: the step (0 to 15) of a string column, null a value of its own, before all others.

    The values in order are cut into 16 runs of nearly equal row counts, so a step is a range of values and the
    least and largest value of a file tell what it can't hold, however many values there are: the counted values are
    dealt by range and summed part by part, and only the first value of each step goes to the rows.
    """
    of = rows.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = cut_lineage(of.repartitionByRange(parts, F.col("_value").asc_nulls_first()).withColumn("_part", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = of.groupBy("_part").agg(F.sum("_n").alias("_n"))  # one row a part
    sums = sums.select("_part", earlier(Window.orderBy("_part")).alias("_from"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    before = earlier(Window.partitionBy("_part").orderBy(F.col("_value").asc_nulls_first()))
    steps = of.withColumn("_before", before).join(F.broadcast(sums), "_part")
    steps = steps.select("_value", F.expr(f"((_from + _before) * {1 << BITS}) div _total").cast("int").alias("_step"))
    firsts = steps.groupBy("_step").agg(F.min("_value").alias("_first")).where("_first is not null")
    one = firsts.agg(F.sort_array(F.collect_list(F.struct("_step", "_first"))).alias("_steps"))  # 16 at most
    last = F.aggregate("_steps", F.lit(0), lambda at, s: F.when(s["_first"] <= F.col(column), s["_step"]).otherwise(at))
    return rows.crossJoin(F.broadcast(one)).withColumn(out, F.when(F.col(column).isNull(), 0).otherwise(last)).drop("_steps")


def hilbert_shards(
    df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, str] = ("lang", "source")
) -> DataFrame:
    """Rows id, size, text_crc32, curve index, the three coordinates, shard and slot; law `rows`.

    Two category columns (in order of value, null first) and the size's logarithm are quantised to 16 steps
    each. Rows are ordered by curve index, inside a cell by a hash of the text, then the id; the order is cut
    into `shards` runs whose row counts differ by one at most. Every run therefore covers few cells, its
    ranges of values prune files, and equal texts of one cell (so of one language and source step) are
    neighbours. Repeated rows each get a slot of their own (which of two identical rows gets which is free).
    Null text has size 1; an empty table gives no rows; other columns don't matter, also when named like the
    results.

    No sort runs over all rows: a row's place is its cell's first place (a running count over at most 4,096
    cells), plus its bucket's place in the cell, plus its rank in cell and bucket. A cell that holds most rows
    is split over as many buckets of texts as there are shuffle partitions; a text with more copies in a cell
    than a quarter of a bucket's share is a bucket of its own, split by id in proportion to its copies.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = (1 << BITS) - 1
    utf8 = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(utf8).cast("long") + 1).alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.xxhash64(utf8).alias("same"),
        *(F.col(c).cast("string").alias(f"value_{i}") for i, c in enumerate(categories)),
    )
    for i in range(len(categories)):
        rows = category_step(rows, f"value_{i}", f"at_{i}")
    rows = rows.withColumn("at_2", F.least(F.floor(F.log2("size")), F.lit(top)).cast("int"))
    rows = rows.withColumn("cell", hilbert_index(F.col("at_0"), F.col("at_1"), F.col("at_2"))).drop("value_0", "value_1")

    copies = rows.groupBy("cell", "same").agg(F.count("*").alias("n"))
    share = F.col("n") * (4 * buckets)
    hot = copies.crossJoin(F.broadcast(copies.agg(F.sum("n").alias("total")))).where(share > F.col("total"))
    # a hot text has more than 1 / (4 * buckets) of all rows, so there are fewer than 4 * buckets of them
    hot = hot.select("cell", "same", F.ceil(share / F.col("total")).alias("split"))
    rows = rows.join(F.broadcast(hot), ["cell", "same"], "left")
    rows = rows.withColumn("bucket", F.pmod("same", F.lit(buckets)).cast("int")).withColumn("alone", F.when(F.col("split").isNull(), 0).otherwise(F.col("same")))
    rows = rows.withColumn("part", F.when(F.col("split").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.col("split")))).drop("split")
    place = ["cell", "bucket", "alone", "part"]
    counts = rows.groupBy(*place).agg(F.count("*").alias("n"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("cell_n"))
    # at most 4,096 rows, one for each cell of the curve
    cells = cells.select(
        "cell",
        F.coalesce(F.sum("cell_n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cell_from"),
        F.sum("cell_n").over(Window.partitionBy()).alias("total"),
    )
    before = Window.partitionBy("cell").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("bucket_from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.join(F.broadcast(cells), "cell").select(*place, (F.col("cell_from") + F.col("bucket_from")).alias("from"), "total")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy("same", "id")) - 1)
    out = ranked.join(starts, place).withColumn("place", F.col("from") + F.col("rank"))
    # shard s holds the places from ceil(s * total / shards) on
    out = out.withColumn("shard", F.expr(f"(place * {shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.col("cell").alias("hilbert"),
        *(F.col(f"at_{i}").alias(f"{c}_step") for i, c in enumerate(categories)), F.col("at_2").alias("size_step"),
        "shard", (F.col("place") - first).cast("long").alias("slot"),
    )

"""Spans and times meet in blocks of time: each pair that belongs together once, no other."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidentia.operators import trajectory
from evidentia.operators.trajectory import blocks_at, cover


def test_cover_meets_the_times_inside_once(spark):
    rnd = random.Random(2)
    for width, levels, end in ((1, 6, 60), (7, 4, 100), (1000, 3, 7000)):
        spans = [(i, *sorted(rnd.sample(range(end + 1), 2))) for i in range(300)] + [(900, 0, end), (901, 0, 1), (902, end - 1, end)]
        times = sorted({rnd.randrange(end) for _ in range(200)} | {0, end - 1})
        s = spark.createDataFrame(spans, "id long, low long, high long").withColumn("b", F.explode(cover(F.col("low"), F.col("high"), width, levels)))
        assert s.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * levels + 4
        t = spark.createDataFrame([(x,) for x in times], "t long").withColumn("b", F.explode(blocks_at(F.col("t"), width, levels)))
        met = s.join(t, "b").where((F.col("b.level") >= 0) | ((F.col("low") <= F.col("t")) & (F.col("t") < F.col("high"))))
        got = sorted((r["id"], r["t"]) for r in met.select("id", "t").collect())
        assert got == sorted((i, x) for i, a, b in spans for x in times if a <= x < b)


def test_material_of_a_hot_key(spark):
    """Of one key with many rows and transitions only what belongs together is made: the join's rows stay near its output."""
    n = 40_000
    day = datetime(2041, 1, 1)
    t = F.expr(f"timestampadd(SECOND, id * 10, TIMESTAMP_NTZ '{day}')")
    rows = spark.range(n).select(
        F.concat(F.lit("o"), "id").alias("obs_id"), F.lit("entity").alias("subject_kind"), F.lit("e").alias("subject_ref"), F.lit("p").alias("predicate"), F.lit("text").alias("object_kind"), F.concat(F.lit("v"), F.col("id") % 7).alias("object_ref"),
        F.lit("interval").alias("temporal_kind"), t.alias("valid_start"), F.expr(f"timestampadd(SECOND, id * 10 + 10, TIMESTAMP_NTZ '{day}')").alias("valid_end"), F.lit(day).cast("timestamp_ntz").alias("recorded_at"), F.lit("observed").alias("status"), F.lit(True).alias("supported"),
    )
    lo, hi = day, day + timedelta(seconds=n * 10)
    moves = trajectory.transitions(rows, lo, hi).cache()
    assert moves.count() == n
    told = trajectory.material(rows, moves, lo, hi)
    assert told.count() == 2 * n - 1  # before and after each transition but the first one's before
    assert told.where("side = 'after'").select("instant", F.substring("obs_id", 2, 9).cast("long").alias("i")).where(F.col("instant") != F.expr(f"timestampadd(SECOND, i * 10, TIMESTAMP_NTZ '{day}')")).count() == 0

"""Leases with timers: what runs out is told, what is complete is forgotten."""

from evidentia.streaming import leases

KIND = "run_id string, at long, command_id long, action string, owner string"
SECOND = 1_000_000


def test_leases_run_out_and_are_forgotten(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, told = tmp_path / "in", []
    source.mkdir()
    batches = [
        [("r", 0, 1, "claim", "a"), ("s", 0, 2, "claim", "a"), ("s", 1, 3, "complete", "a")], [("t", 30, 4, "claim", "b")], [("r", 31, 5, "complete", "a"), ("r", 31, 6, "claim", "b"), ("s", 32, 7, "claim", "b")], [("t", 300, 8, "claim", "c")],
        [("u", 301, 9, "claim", "c")], [("s", 302, 10, "claim", "b")],
    ]
    try:
        for rows in batches:
            spark.createDataFrame([(r, (1000 + at) * SECOND, i, what, who) for r, at, i, what, who in rows], KIND).write.mode("append").parquet(str(source))
            feed = leases.timed_stream(spark.readStream.schema(KIND).parquet(str(source)), 10 * SECOND, 100 * SECOND)
            feed.writeStream.foreachBatch(lambda df, epoch: told.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).outputMode("append").start().awaitTermination(120)
    finally:
        spark.conf.set(key, before)
    commands = {i: (run, outcome, attempt) for run, i, outcome, attempt in told if i is not None}
    assert commands[1] == ("r", "claimed", 1) and commands[3] == ("s", "completed", 1) and commands[4] == ("t", "claimed", 1)
    assert commands[5] == ("r", "refused", 1) and commands[6] == ("r", "claimed", 2) and commands[7] == ("s", "completed", 1)
    assert commands[10] == ("s", "claimed", 1)  # forgotten: it begins anew
    expired = {(run, attempt) for run, i, outcome, attempt in told if outcome == "expired"}
    assert {("r", 1), ("r", 2)} <= expired and commands[8] == ("t", "reclaimed", 2)

"""Extraction leases: who may work on a run, by its commands in order of time; batch and streaming."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Commands: (run_id, at, command_id, action claim|complete|fail, owner); `at` and leases are microseconds.
OUTPUT = "run_id string, command_id long, outcome string, attempt int"
STATE = "state string, attempt int, owner string, claimed long, lease long, last long"
FRESH = ("new", 0, "", 0, 0, -(1 << 62))


def advance(state: tuple, at: int, action: str, owner: str, lease: int) -> tuple[tuple, str]:
    """The next state of a run and the command's outcome.

    claim: completed, busy (another's lease runs), claimed, or reclaimed (the lease before it ran out).
    complete and fail need the attempt's owner inside its lease; a completed run answers an equal completion
    with `replay`. A failed run may be claimed again.
    """
    name, attempt, who, claimed, until, last = state
    if at < last:
        return state, "out-of-order"
    if action == "claim":
        if name == "completed":
            return (*state[:5], at), "completed"
        if name == "active" and at < until:
            return (*state[:5], at), "busy"
        return ("active", attempt + 1, owner, at, at + lease, at), "reclaimed" if name == "active" else "claimed"
    if name == "completed" and action == "complete" and owner == who:
        return (*state[:5], at), "replay"
    if name != "active" or owner != who or not claimed <= at < until:
        return (*state[:5], at), "refused"
    done = "completed" if action == "complete" else "failed"
    return (done, attempt, who, claimed, until, at), done


def fold(commands: DataFrame, lease: int) -> DataFrame:
    """Every command's outcome, run by run: a task goes through its runs in order of time and holds one state, however many
    runs it has and however long they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, fresh = None, FRESH, True
        for pdf in batches:
            out = []
            for name, at, command, action, owner in zip(*(pdf[c].tolist() for c in ("run_id", "at", "command_id", "action", "owner")), strict=True):
                if fresh or name != now:
                    now, state, fresh = name, FRESH, False
                state, outcome = advance(state, at, action, owner, lease)
                out.append((name, command, outcome, state[1]))
            yield pd.DataFrame(out, columns=["run_id", "command_id", "outcome", "attempt"])

    rows = commands.select("run_id", "at", "command_id", "action", "owner").repartition("run_id")
    return rows.sortWithinPartitions("run_id", F.asc_nulls_last("at"), F.asc_nulls_last("command_id")).mapInPandas(run, OUTPUT)


def stream(commands: DataFrame, lease: int) -> DataFrame:
    """The same over a stream: a run's state is kept between batches; commands late against it are out-of-order."""

    def run(key: tuple, frames: Iterable[pd.DataFrame], kept: GroupState):
        state = kept.get if kept.exists else FRESH
        pdf = pd.concat(list(frames))
        out = []
        for c in pdf.sort_values(["at", "command_id"]).itertuples():
            state, outcome = advance(tuple(state), c.at, c.action, c.owner, lease)
            out.append((key[0], c.command_id, outcome, state[1]))
        kept.update(tuple(state))
        yield pd.DataFrame(out, columns=["run_id", "command_id", "outcome", "attempt"])

    return commands.groupBy("run_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


class Runs(StatefulProcessor):
    """A run's state with timers: one ends its lease, one forgets it `keep` microseconds after it was completed."""

    def __init__(self, lease: int, keep: int):
        self.lease, self.keep = lease, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("run", STATE)

    def _wake(self, state: tuple) -> None:
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if state[0] == "active":
            self.handle.registerTimer(-(-state[4] // 1000))
        elif state[0] == "completed":
            self.handle.registerTimer(-(-(state[5] + self.keep) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else FRESH
        out = []
        for c in pd.concat(list(rows)).sort_values(["at", "command_id"]).itertuples():
            state, outcome = advance(state, c.at, c.action, c.owner, self.lease)
            out.append((key[0], c.command_id, outcome, state[1]))
        self.held.update(state)
        self._wake(state)
        yield pd.DataFrame(out, columns=["run_id", "command_id", "outcome", "attempt"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, now = tuple(self.held.get()) if self.held.exists() else FRESH, expiredTimerInfo.getExpiryTimeInMs() * 1000
        if state[0] == "active" and state[4] <= now:
            self.held.update(("failed", *state[1:]))
            yield pd.DataFrame([(key[0], None, "expired", state[1])], columns=["run_id", "command_id", "outcome", "attempt"]).astype({"command_id": "Int64"})
        elif state[0] == "completed":
            self.held.clear()

    def close(self) -> None:
        pass


def timed_stream(commands: DataFrame, lease: int, keep: int, delay: str = "0 seconds") -> DataFrame:
    """stream() with timers by event time: a lease that runs out gives a row `expired` (its command_id is null), and a
    completed run is forgotten `keep` microseconds after its last command, so state doesn't grow for ever.

    Commands later than `delay` behind the latest seen are left out, as Spark does with late rows. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = commands.withColumn("_time", F.timestamp_micros("at")).withWatermark("_time", delay)
    return timed.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=Runs(lease, keep), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def standing(attempts: DataFrame) -> DataFrame:
    """(run_id, number, owner, lease_until, ended): each run's last attempt, and how it ended if it has.

    attempts as in schema.ATTEMPT; aggregates only, combined before their shuffle.
    """
    claimed = F.col("event") == "claimed"
    each = attempts.groupBy("run_id", "number").agg(
        F.max(F.when(claimed, F.col("owner"))).alias("owner"), F.max(F.when(claimed, F.col("lease_until"))).alias("lease_until"), F.max(F.when(~claimed, F.col("event"))).alias("ended"),
    )
    last = each.groupBy("run_id").agg(F.max_by(F.struct("number", "owner", "lease_until", "ended"), "number").alias("last"))
    return last.select("run_id", "last.*")


def claim(runs: DataFrame, attempts: DataFrame, at: Column, owner: str, lease: str) -> DataFrame:
    """runs with `claim` and the attempt it is about: `claimed` (a new attempt, until at + lease), `held` (the owner's own
    attempt still runs), `busy` (another's does), or `completed`.

    An attempt that failed, or whose lease is over, is followed by the next one. What is claimed must be written as
    claims() has it before another writer can look (Store.commit).
    """
    rows = runs.join(standing(attempts), "run_id", "left").withColumn("_at", at)
    runs_on = F.col("ended").isNull() & (F.col("_at") < F.col("lease_until"))
    how = F.when(F.col("ended") == "completed", "completed").when(runs_on, F.when(F.col("owner") == owner, "held").otherwise("busy")).otherwise("claimed")
    rows = rows.withColumn("claim", how)
    number = F.when(F.col("claim") == "claimed", F.coalesce("number", F.lit(0)) + 1).otherwise(F.col("number")).cast("int")
    until = F.when(F.col("claim") == "claimed", F.col("_at") + F.expr(f"INTERVAL {lease}")).otherwise(F.col("lease_until"))
    return rows.select(*runs.columns, "claim", number.alias("number"), F.when(F.col("claim") == "busy", F.col("owner")).otherwise(F.lit(owner)).alias("owner"), until.alias("lease_until"), F.col("_at").alias("claimed_at"))


def claims(claimed: DataFrame) -> DataFrame:
    """The rows that newly claimed runs write."""
    rows = claimed.where("claim = 'claimed'")
    return rows.select("run_id", "number", F.lit("claimed").alias("event"), "owner", F.col("claimed_at").alias("at"), "lease_until", F.lit(None).cast("string").alias("fault"))


def held_still(claimed: DataFrame, attempts: DataFrame, at: Column) -> DataFrame:
    """The claimed runs whose attempt is still the last, has not ended, and is inside its lease: only these may end."""
    now = standing(attempts).select("run_id", F.col("number").alias("_number"), F.col("owner").alias("_owner"), F.col("lease_until").alias("_until"), F.col("ended").alias("_ended"))
    rows = claimed.join(now, "run_id").withColumn("_at", at)
    return rows.where((F.col("number") == F.col("_number")) & (F.col("owner") == F.col("_owner")) & F.col("_ended").isNull() & (F.col("_at") < F.col("_until"))).select(*claimed.columns)


def ends(rows: DataFrame, at: Column) -> DataFrame:
    """The rows that ended attempts write; rows: (run_id, number, owner, event completed or failed, fault)."""
    return rows.select("run_id", "number", "event", "owner", at.alias("at"), F.lit(None).cast("timestamp_ntz").alias("lease_until"), "fault")

"""The store's own schema: an ordered ledger of steps, applied forward only, and a probe of the running service."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.records import ledger_status, schema_fingerprint
from evidentia.sources.store import Store

_LEDGER = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("checksum", T.StringType())])
LEDGER = "_ledger"


class Refused(RuntimeError):
    """The ledger doesn't fit the steps; nothing was applied."""


@dataclass(frozen=True)
class Step:
    """One change of a store; its text is its identity, apply makes it."""

    name: str
    text: str
    apply: Callable[[Store], None] = lambda store: None

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()


class Migrator:
    """Applies steps to a store in order: those of the ledger must be the first ones, unchanged, before any is applied.

    A step is entered after it has been made, under the store's one writer; run again after it died, the migrator
    makes the step that was not entered again, so steps must bear being made twice.
    """

    def __init__(self, store: Store, steps: list[Step]):
        if len({s.name for s in steps}) != len(steps):
            raise Refused("two steps have one name")
        self.store, self.steps = store, steps

    def expected(self) -> DataFrame:
        return self.store.spark.createDataFrame([(i, s.name, s.checksum) for i, s in enumerate(self.steps)], _LEDGER)

    def applied(self) -> DataFrame:
        path = f"{self.store.root}/{LEDGER}"
        return self.store.spark.read.schema(_LEDGER).parquet(path) if self.store._exists(path) else self.store.spark.createDataFrame([], _LEDGER)

    def status(self, fingerprint: str | None = None) -> str:
        """absent, checksum_mismatch, pending, schema_drift or current; fingerprint: of the tables as they should be."""
        ok = fingerprint is None or fingerprint == self.fingerprint()
        return ledger_status(self.expected(), self.applied(), ok).first()["status"]

    def fingerprint(self) -> str:
        return schema_fingerprint(*self.store.snapshot().values())

    def apply(self) -> list[str]:
        """The names of the steps that were made."""
        with self.store.writing():
            done = {r["position"]: (r["name"], r["checksum"]) for r in self.applied().collect()}  # as many as there are steps
            want = {i: (s.name, s.checksum) for i, s in enumerate(self.steps)}
            if sorted(done) != list(range(len(done))) or any(want.get(i) != d for i, d in done.items()):
                raise Refused("the ledger differs from the steps")
            for i in range(len(done), len(self.steps)):
                self.steps[i].apply(self.store)
                self.store.spark.createDataFrame([(i, *want[i])], _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.store.root}/{LEDGER}")
        return [s.name for s in self.steps[len(done) :]]


def health(store: Store) -> dict[str, str]:
    """The probe of a running service: whether its session answers; it reads no table."""
    return {"status": "ok" if store.spark.range(1).select(F.lit(1)).count() == 1 else "failed"}

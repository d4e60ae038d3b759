"""Ordered readiness checks of a store."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from evidentia.sources.store import Store

#: The checks, in their order (fixed values).
CHECKS = ("root", "marks", "tables")


def readiness(store: Store) -> list[tuple[str, bool, str]]:
    """(check, passed, detail) in order, up to the first that fails: the root is there, its commit markers can be
    read, and every table that has files can be read by its schema. No rows are gathered."""
    out: list[tuple[str, bool, str]] = []

    def root():
        if not store._exists(store.root):
            raise FileNotFoundError(store.root)
        return store.root

    def tables():
        held = store.snapshot()
        for df in held.values():
            df.limit(1).count()
        return ", ".join(held)

    for check, run in zip(CHECKS, (root, lambda: f"{store.marks().count()} batches", tables), strict=True):
        try:
            out.append((check, True, run()))
        except (OSError, PySparkException, Py4JError) as e:  # what storage and engine can fail with; other errors are faults of the program
            out.append((check, False, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
            break
    return out


def ready(store: Store) -> bool:
    found = readiness(store)
    return len(found) == len(CHECKS) and all(ok for _, ok, _ in found)

"""Cutting a plan: rows computed once and read again by several branches of a query."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which keys are sent to every task, so that the rows that meet them are not shuffled.
FEW = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that checkpoint() writes to: spark.checkpoint.dir, or the one set for the session.

    A session without one gets a temporary folder only if it is local (a test); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(keys: DataFrame) -> DataFrame:
    """The same rows, sent to every task if there are at most FEW. They are counted: start from a cut frame."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def met(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns `on` occur in keys; a pass over the rows without a shuffle while the keys are few()."""
    return rows.join(few(keys.select(*on).distinct()), on, "left_semi")

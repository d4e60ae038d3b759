"""Append-only Parquet tables with a commit marker; a reader sees committed batches only."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.operators.records import append_once, row_digest
from evidentia.operators.seals import SEALS, sealed
from evidentia.plans.lineage import cut

#: Markers: a batch, the attempt whose rows are its rows, its place, and up to which place an attempt holds all rows.
_MARKS = T.StructType([T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("covers", T.LongType())])
DIGEST = "row_digest"


class Conflict(ValueError):
    """A row's key exists with other content or is null; nothing of the batch was written."""


class Busy(RuntimeError):
    """Another writer holds the store."""


class Lost(RuntimeError):
    """This writer's hold ran out and another took it over; nothing of the batch was committed."""


class Store:
    """Tables as folders of attempts under one root, on any file system that Spark writes to.

    A writer holds the store while it writes: a second one is refused until the first has gone, or its hold is
    older than `hold` seconds. A batch's rows are written under an attempt of their own, its marker last: a
    writer that dies leaves an attempt that no marker names, so no reader ever takes it, and the same batch can
    be written again. Rows are judged by their keys and digests as they were written, before the marker. A snapshot reads the markers once, so that all tables of a query are of one moment.
    Every row is kept with a digest of its content, and an append looks only at the rows of its own keys.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType], hold: float = 6 * 3600):
        self.spark, self.root, self.schemas, self.hold = spark, root.rstrip("/"), schemas, hold

    # ---- files ------------------------------------------------------------------------------------------

    def _file(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        files, p = self._file(path)
        return files.exists(p)

    def _token(self) -> str | None:
        files, p = self._file(f"{self.root}/_writer")
        if not files.exists(p):
            return None
        stream = files.open(p)
        try:
            return stream.readLine()
        finally:
            stream.close()

    def _owned(self, token: str) -> None:
        """Refuses to go on for a writer whose hold has run out and was taken over."""
        if self._token() != token:
            raise Lost(f"another writer has taken {self.root}")

    @contextmanager
    def writing(self):
        """The one writer's hold on the store; creating its file succeeds for one caller only.

        The file names its writer by a token: one that comes back late, after its hold was taken over, finds another's
        token, marks nothing and leaves the file alone. The token is read just before the marker is written; the
        hold must be far longer than that write takes.
        """
        files, p = self._file(f"{self.root}/_writer")
        token = uuid.uuid4().hex
        if files.exists(p) and time.time() - files.getFileStatus(p).getModificationTime() / 1000 > self.hold:
            files.delete(p, False)
        try:
            stream = files.create(p, False)
        except Py4JJavaError as e:
            if not files.exists(p):
                raise
            raise Busy(f"another writer holds {self.root}") from e
        stream.writeBytes(token + "\n")
        stream.close()
        try:
            yield token
        finally:
            if self._token() == token:
                files.delete(p, False)

    # ---- reading ----------------------------------------------------------------------------------------

    def marks(self) -> DataFrame:
        path = f"{self.root}/_marks"
        return self.spark.read.schema(_MARKS).parquet(path) if self._exists(path) else self.spark.createDataFrame([], _MARKS)

    def _attempts(self) -> DataFrame:
        """Attempts whose rows hold: the last that covers those before it, and all after it."""
        marks = self.marks()
        covered = marks.agg(F.coalesce(F.max("covers"), F.lit(-1)).alias("_covered"))
        return marks.crossJoin(F.broadcast(covered)).where((F.col("seq") > F.col("_covered")) & (F.col("covers").isNull() | (F.col("covers") == F.col("_covered")))).select("attempt")

    def snapshot(self, digests: bool = False) -> dict[str, DataFrame]:
        """All tables as of now; digests: with each row's digest."""
        attempts = cut(self._attempts())
        out = {}
        for name, schema in self.schemas.items():
            path = f"{self.root}/{name}"
            full = T.StructType([*schema.fields, T.StructField(DIGEST, T.StringType()), T.StructField("attempt", T.StringType())])
            rows = self.spark.read.schema(full).parquet(path) if self._exists(path) else self.spark.createDataFrame([], full)
            out[name] = rows.join(attempts, "attempt", "left_semi").select(*schema.names, *([DIGEST] if digests else []))
        return out

    # ---- writing ----------------------------------------------------------------------------------------

    def append(self, tables: dict[str, tuple[DataFrame, str | list[str]]], batch: str | None = None) -> dict[str, int]:
        """Appends new rows of several tables (frame, key) in one commit; equal rows are no-ops, a conflict writes nothing.

        A key is one column or several; columns that a frame lacks are null. A batch id that is committed already is a no-op, so a retry of a stream's
        batch is safe, whether its first writer finished or died. Gives the number of rows written of each table.
        """
        return {name: 0 for name in tables} | self.commit(lambda held: tables, batch)

    def commit(self, judge: Callable[[dict[str, DataFrame]], dict[str, tuple[DataFrame, str | list[str]]]], batch: str | None = None) -> dict[str, int]:
        """append() of what `judge` makes of the tables as they stand, while no other writer can change them.

        So a verdict that depends on stored rows (see authority.appendable) still holds when its rows are written.
        """
        batch = batch or uuid.uuid4().hex
        with self.writing() as token:
            if not self.marks().where(F.col("batch") == batch).isEmpty():
                return {}
            held = self.snapshot(digests=True)
            plain = {n: df.drop(DIGEST) for n, df in held.items()}
            asked = judge(plain)
            full = sealed({name: self._full(name, df) for name, (df, _) in asked.items()}, plain)
            attempt = uuid.uuid4().hex
            counts = {}
            try:
                for name, (_, key) in asked.items():
                    counts[name] = self._write(name, full[name], [key] if isinstance(key, str) else list(key), held[name], attempt)
            except Conflict:
                for name in asked:
                    self._delete(self._folder(name, attempt))
                raise
            self._owned(token)
            self._mark(batch, attempt)
            return counts

    def _folder(self, name: str, attempt: str) -> str:
        return f"{self.root}/{name}/attempt={attempt}"

    def _delete(self, path: str) -> None:
        files, p = self._file(path)
        files.delete(p, True)

    def _write(self, name: str, df: DataFrame, keys: list[str], held: DataFrame, attempt: str) -> int:
        """Writes the new rows of a table under an attempt; how many. What is written once is judged by keys and digests, so
        contents are neither shuffled nor stored to be judged; only where some rows are there already, the others are written again."""
        columns, path = self.schemas[name].names, self._folder(name, attempt)
        stored = T.StructType([*self.schemas[name].fields, T.StructField(DIGEST, T.StringType())])
        df.select(*columns, row_digest([c for c in columns if c not in keys] or keys).alias(DIGEST)).write.parquet(path)
        rows = self.spark.read.schema(stored).parquet(path)
        judged = append_once(held, rows.select(*keys, DIGEST), keys, DIGEST)
        n = {r["verdict"]: r["count"] for r in judged.groupBy("verdict").count().collect()}
        if n.keys() & {"conflict", "no-key"}:
            raise Conflict(name)
        if "replay" in n:
            if "append" in n:
                new = rows.join(judged.where("verdict = 'append'").select(*keys), keys, "left_semi").dropDuplicates(keys)
                new.select(*columns, DIGEST).write.parquet(self._folder(name, f"{attempt}-new"))
            self._delete(path)
            if "append" in n:
                files, p = self._file(self._folder(name, f"{attempt}-new"))
                files.rename(p, self._file(path)[1])
        elif not n:
            self._delete(path)
        return n.get("append", 0)

    def _full(self, name: str, df: DataFrame) -> DataFrame:
        """The frame with all columns of its table, those that it lacks null; but for digests, which are made of the others."""
        return df.select(*(
            F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schemas[name].fields if f.name in df.columns or f.name != SEALS.get(name)
        ))

    def _mark(self, batch: str, attempt: str, covers: bool = False) -> None:
        last = self.marks().agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
        row = last.select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), (F.col("last") + 1).alias("seq"), (F.col("last") if covers else F.lit(None).cast("long")).alias("covers"))
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_marks")

    def compact(self) -> None:
        """Writes all committed rows once more, in few files, as one attempt that covers all before it.

        Readers of an earlier snapshot keep their files; vacuum() removes what no marker needs any more.
        """
        with self.writing() as token:
            attempt = uuid.uuid4().hex
            for name, rows in self.snapshot(digests=True).items():
                if not rows.isEmpty():
                    rows.write.mode("append").parquet(f"{self.root}/{name}/attempt={attempt}")
            self._owned(token)
            self._mark(f"compact-{attempt}", attempt, covers=True)

    def vacuum(self) -> int:
        """Deletes attempts whose rows hold for nobody: of writers that died, and those that a later attempt covers."""
        with self.writing():
            keep = {r["attempt"] for r in self._attempts().toLocalIterator()}
            gone = 0
            for name in self.schemas:
                files, p = self._file(f"{self.root}/{name}")
                for s in files.listStatus(p) if files.exists(p) else ():
                    if s.getPath().getName().removeprefix("attempt=") not in keep:
                        gone += bool(files.delete(s.getPath(), True))
            return gone

    def sink(self, name: str, key: str | list[str]):
        """A foreachBatch function that appends each micro-batch once."""
        return lambda df, epoch: self.append({name: (df, key)}, f"{name}-{epoch}")


def landing(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """Documents of a landing folder; the schema is always given, never inferred."""
    return spark.read.schema(schema).format(kind).load(path)


def landing_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)

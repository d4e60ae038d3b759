"""Shared pieces of the corpus operators: table access, shared storage, byte-level word hashing."""

from __future__ import annotations

import hashlib
import math
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Text bytes handled by one vectorised step; a longer single text gets a step of its own.
STEP_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_storage(spark: SparkSession) -> str:
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


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared checkpoint folder: survives lost executors, is computed once."""
    shared_storage(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that go to a worker at once.
BATCH_ROWS = 1024


def small_batches(df: DataFrame) -> None:
    """Lets at most BATCH_ROWS rows go to a worker at once, in this session, unless it lets fewer.

    An executor holds what goes to a worker several times over (rows, Arrow buffers, a buffer for the pipe), and the
    worker does so too, so this bounds the memory of both; batches also end at 64 MB, Spark's own bound. Results
    don't depend on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)


def spread(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """How many hash blocks the rows should form: grows with the input, at least the shuffle partitions."""
    held = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = planned if planned < 1 << 60 else 0
    return max(int(held), math.ceil(known / bytes_each))


#: Types of whole numbers, which pandas would turn to floating point beside a null.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def carried(df: DataFrame, name: str):
    """(column, its type, back): how a column goes through a worker unchanged; whole numbers go as text, and `back` makes
    them numbers again, so that no digit is lost in a batch that also holds a null."""
    kind = df.schema[name].dataType.simpleString()
    if kind in WHOLE:
        return F.col(name).cast("string"), "string", lambda c: c.cast(kind)
    return F.col(name), kind, lambda c: c


def id_crc(column):
    """crc32 of an id written as text, the rule by which rows are held out."""
    return F.crc32(column.cast("string").cast("binary"))


def steps(texts, limit: int = STEP_BYTES):
    """(first row, encoded texts) runs of at most `limit` bytes, or one longer text; null counts as empty."""
    run, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(raw) > limit:
            yield first, run
            run, size, first = [], 0, i
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: The bytes of eight that a word's last block keeps, by how many are its own.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 4096


def word_spans(raws: list[bytes], apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with A-Z lower-cased (and eight more), each word's place and length there, each text's number of words.

    apart: which bytes are no part of a word; the space is one of them.
    """
    joined = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    n = len(joined)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], apart[joined])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    low = np.zeros(n + 8, np.uint8)
    low[:n] = LOWER[joined]
    lengths = np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))
    until = np.searchsorted(start, np.cumsum(lengths), "left")
    return low, start, end - start, np.diff(np.concatenate(([0], until)))


def span_hashes(low: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words given by their places.

    A word's hash runs over its blocks of eight bytes, mixing after each, and starts from its length: words of
    one block and one length differ for certain, others agree by chance only (2^-64), whatever pattern their
    bytes have. All words take a step at once, so no Python object is made per word; words longer than
    LONG_WORD have a BLAKE2 digest instead.
    """
    eights = np.ndarray((len(low) - 8,), "<u8", low, 0, (1,))  # the eight bytes from each place on
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > LONG_WORD)
    at, block = (np.flatnonzero(size <= LONG_WORD) if len(long) else np.arange(len(size))), 0
    while len(at):
        left = size[at] - block
        h[at] = mix(h[at] ^ (eights[start[at] + block] & _TAIL[np.minimum(left, 8)]))
        at = at[left > 8]
        block += 8
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (A-Z lower-cased), and each text's number of words."""
    low, start, size, counts = word_spans(raws)
    return span_hashes(low, start, size), counts

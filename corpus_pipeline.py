"""The corpus pipeline: quality, language, exact duplicates, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A runner writes each stage's rows as Parquet and gives them, read again, to the next.

Every stage judges each row by itself, whatever its id: a null id is a row like any other, rows that repeat an id
each have their own verdict, null text counts as empty, other columns are passed on as they are, and an empty table
gives an empty table. What that means for each stage is told at the stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import cut_lineage, shared_storage, table
from evidentia.llm.exact_dedup import exact_groups
from evidentia.llm.language import UNKNOWN, languages
from evidentia.llm.near_dedup import near_duplicates
from evidentia.llm.packing import Limits, pack
from evidentia.llm.quality import quality_scores

#: Documents whose chance of label 1 is lower go, as in op6.
QUALITY = 0.7
#: Documents of whose distinct grams a smaller share stands in the texts that the kernel learnt from go.
KNOWN = 0.5
#: Numbers of rows (8 bytes each) that are sent to all executors at most.
SENT = 1 << 20
#: Names of files that are sent to all executors at most.
FILES = 1 << 16


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that numbers its rows, the same however often they are read, and that column's name.

    Ids may be null or repeat, so a row's verdict is held by this number. In files a row is known by its file
    and its place there, where docs has FILES of them at most (their names are sent to all executors); the rows of
    any other table are numbered once and checkpointed.
    """
    row = _free(docs, "_row")
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and _free(docs, "_metadata") == "_metadata"
    if plain:
        meta = docs.select("*", F.col("_metadata.file_path").alias(_free(docs, "_in")), F.col("_metadata.row_index").alias(_free(docs, "_place")))
        of_file, place = meta.columns[-2:]
        names = sorted(r[0] for r in meta.select(of_file).distinct().limit(FILES + 1).collect())
        if len(names) <= FILES:
            number = _free(docs, "_number")
            files = docs.sparkSession.createDataFrame(list(enumerate(names)), f"`{number}` long, `{of_file}` string")
            placed = meta.join(F.broadcast(files), of_file)
            return placed.select(*(placed[c] for c in docs.columns), F.shiftleft(placed[number], 40).bitwiseOR(placed[place]).alias(row)), row
    return cut_lineage(docs.withColumn(row, F.monotonically_increasing_id())), row


def _without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows numbered by `row`, with their own columns, but for those in gone.

    The numbers that go are counted first: few are sent to all executors, so that texts stay in place; of more,
    both sides are dealt by number.
    """
    gone = cut_lineage(gone.select(row))
    few = gone.count() <= SENT
    return rows.join(F.broadcast(gone) if few else gone, row, "left_anti").drop(row)


def _copies(rows: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """All rows of each group (`row`, _group) but one: that with the smallest id, a null id only if there is no other.

    Of rows that repeat this id the first in number stays.
    """
    own = cut_lineage(groups.join(rows.select(row, F.col("doc_id").alias("_id")), row))
    first = own.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", row)).alias("_first"))
    return own.join(first.select(F.col(f"_first.{row}").alias(row)), row, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject; it learns from the labels not held out.

    Empty texts are judged as texts without any statistics; without labels of both classes all scores are alike
    (0.5 without any label, which is below the threshold: nothing stays that nothing speaks for).
    """
    rows, row = _numbered(docs)
    scores = quality_scores(rows, table(spark, sf_dir, "labels"), threshold=QUALITY, row_col=row)
    return _without(rows, row, scores.where("predicted = 0"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose grams the learnt languages hold at least half; those without text or letters go too.

    Without any text whose language is known there is nothing to judge by, and no document stays.
    """
    rows, row = _numbered(docs)
    return _without(rows, row, languages(rows, row_col=row, least_known=KNOWN).where(F.col("lang_pred") == UNKNOWN))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest id; null and empty texts are one group.

    A row without an id stays only where its whole group has none; of rows that repeat the smallest id one stays.
    """
    rows, row = _numbered(docs)
    groups = exact_groups(rows, id_col=row).where("group_size > 1")
    return _without(rows, row, _copies(rows, row, groups.select(row, F.col("keep_id").alias("_group"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8 or more), that with the smallest id.

    Rows without words are near to nothing, so each of them stays; rows without an id as in the stage before.
    """
    rows, row = _numbered(docs)
    groups = near_duplicates(rows, id_col=row, width=5, similar=(80, 100))
    return _without(rows, row, _copies(rows, row, groups.select(row, F.col("component_id").alias("_group"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 4096 tokens; an empty text is its end alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, limits=Limits(tokens=4096))


STAGES = [("quality", quality), ("language", language), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]

#: Classifiers, signatures and best-fit are not SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again.

    A stage's rows are removed when the next stage's are written; the packed pieces are held by a checkpoint.
    """
    folder = f"{shared_storage(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            _drop(spark, folder)
            return out
        out.write.parquet(f"{folder}/{name}")
        if before:
            _drop(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs


QUERIES = {"pipeline": run}

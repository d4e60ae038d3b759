"""A remote collection as a Spark source: listed page by page, in batch or as a stream, and read document by document."""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from evidentia.functions.evidence import meeting_date, tab_role
from evidentia.operators import records
from evidentia.plans.lineage import cut

NAME = "paged_listing"
LISTED = "doc_id string, provider string, title string, locator string, provider_version string, modified_at timestamp_ntz"
_FIELDS = ("doc_id", "provider", "title", "locator", "provider_version", "modified_at")


class InvalidPages(ValueError):
    """A page names a next page that was there before: the listing would never end."""


def client_of(options) -> object:
    """The client that `client` names as module:factory, made with the other options.

    A client has page(collection, token) -> {"documents": [...], "next": token or None}, the first page by token None,
    and document(doc_id) -> {"title", "locator", "provider", "tabs": [{"id", "parent_id", "position", "title", "content"}]}.
    """
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)({k: v for k, v in options.items() if k != "client"})


def _row(document: dict) -> tuple:
    at = document.get("modified_at")
    return (*(document.get(k) for k in _FIELDS[:-1]), datetime.fromisoformat(at) if isinstance(at, str) else at)


class _Page(InputPartition):
    def __init__(self, token):
        self.token = token


class _Batch(DataSourceReader):
    """A partition for each page. The chain of tokens is walked once before, as each page alone tells the next one's."""

    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        client, token, seen = client_of(self.options), None, {None}
        pages = [_Page(None)]
        tokens = getattr(client, "next_token", None) or (lambda c, t: client.page(c, t).get("next"))
        while token := tokens(self.options["collection"], token):
            if token in seen:
                raise InvalidPages("a page names a page before it as the next")
            seen.add(token)
            pages.append(_Page(token))
        return pages

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = client_of(self.options).page(self.options["collection"], partition.token)
        yield from map(_row, page["documents"])


class _Stream(SimpleDataSourceStreamReader):
    """Offsets are a page's token and how many of its documents were taken, so a restart goes on in the middle of a page,
    and a last page that grows or gets a successor is taken up where it was left."""

    def __init__(self, options):
        self.options, self.most = options, int(options.get("pages_per_batch", 10))

    def initialOffset(self) -> dict:
        return {"token": None, "taken": 0}

    def _walk(self, start: dict, end: dict | None):
        client, at, seen, rows = client_of(self.options), dict(start), {start["token"]}, []
        for _ in range(self.most if end is None else 1 << 30):
            page = client.page(self.options["collection"], at["token"])
            until = end["taken"] if end is not None and at["token"] == end["token"] else len(page["documents"])
            rows += [_row(d) for d in page["documents"][at["taken"] : until]]
            at["taken"] = max(at["taken"], until)
            if end is not None and at["token"] == end["token"] or not page.get("next"):
                break
            if page["next"] in seen:
                raise InvalidPages("a page names a page before it as the next")
            seen.add(page["next"])
            at = {"token": page["next"], "taken": 0}
        return rows, at

    def read(self, start: dict):
        rows, end = self._walk(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._walk(start, end)[0])

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    """Options: client (module:factory), collection, pages_per_batch (streams, 10), and whatever the client takes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def listing(spark: SparkSession, stream: bool = False, **options: str) -> DataFrame:
    """The documents of a collection (LISTED): a task a page, or a stream of pages."""
    spark.dataSource.register(PagedListing)
    reader = spark.readStream if stream else spark.read
    return reader.format(NAME).options(**options).load()


def contents(listed: DataFrame, options: dict[str, str], transcripts: list[str], notes: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(listing, tabs, faults) as sync takes them: each listed document is read once, and what was listed and read is merged.

    Tabs get their role by their title (transcripts, notes: plain titles in lower case). faults: (doc_id, fault):
    `missing` (it could not be read), `provider` (listed and read disagree), or a section's fault; such documents are
    in neither of the others. A document that fails stops no other.
    """

    def run(batches):
        client = client_of(options)
        for pdf in batches:
            out = []
            for doc_id in pdf["doc_id"]:
                try:
                    d = client.document(doc_id)
                except Exception:  # noqa: BLE001  (a remote store may fail in any way)
                    continue
                tabs = [{k: t.get(k) for k in ("id", "parent_id", "position", "title", "content")} for t in d.get("tabs") or []]
                out.append((doc_id, d.get("provider"), d.get("title"), d.get("locator"), tabs))
            yield pd.DataFrame(out, columns=["doc_id", "provider", "title", "locator", "content"])

    kind = "doc_id string, provider string, title string, locator string, content array<struct<id:string,parent_id:string,position:long,title:string,content:string>>"
    none = F.lit(None).cast("string")
    dated = lambda df: df.withColumn("source_time", meeting_date(F.col("title")).cast("timestamp_ntz"))
    read = dated(listed.select("doc_id").mapInPandas(run, kind)).withColumns({"provider_version": none, "modified_at": none.cast("timestamp_ntz")})
    columns = ["doc_id", "provider", "title", "source_time", "locator", "provider_version", "modified_at"]
    merged = cut(records.merged_documents(dated(listed).select(*columns), read.select(*columns, "content")))
    tabs = merged.where("fault is null").select("doc_id", F.explode("content").alias("t")).select("doc_id", "t.*")
    tabs = cut(tabs.withColumn("role", tab_role(F.col("title"), transcripts, notes)))
    shaped = tabs.select("doc_id", F.col("id").alias("section_id"), "title", "role", F.coalesce("position", F.lit(0)).alias("section_order"), F.array("title").alias("path"), "content")
    faults = shaped.withColumn("fault", records.section_fault(("transcript", "notes", "other"))).where("fault is not null").groupBy("doc_id").agg(F.min("fault").alias("fault"))
    faults = cut(faults.unionByName(merged.where("fault is not null").select("doc_id", "fault")))
    good = merged.join(faults.select("doc_id"), "doc_id", "left_anti")
    own = tabs.join(faults.select("doc_id"), "doc_id", "left_anti")
    return good.select(*_FIELDS), own.select("doc_id", "id", "parent_id", "position", "title", "role", "content"), faults

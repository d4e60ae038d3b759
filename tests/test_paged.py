"""The paged source: batch, streams that go on where they were left, tokens that repeat, and the reading of documents."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evidentia.sources import paged
from tests import paged_client


@pytest.fixture
def options(tmp_path):
    return {"client": "tests.paged_client:Folder", "root": str(tmp_path), "collection": "c"}


def test_pages(spark, options):
    root = options["root"]
    paged_client.put(root, "c", None, ["a", "b"], "t1")
    paged_client.put(root, "c", "t1", [], "t2")
    paged_client.put(root, "c", "t2", ["c"])
    df = paged.listing(spark, **options)
    assert df.rdd.getNumPartitions() == 3
    rows = {r["doc_id"]: r for r in df.collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"]["modified_at"] == datetime(2041, 5, 2, 10) and rows["c"]["locator"] == "talks/c"
    paged_client.put(root, "c", "t2", ["c"], "t1")
    with pytest.raises(Exception, match="a page before it"):
        paged.listing(spark, **options).collect()


def test_a_stream_goes_on_where_it_was_left(spark, options, tmp_path):
    root, out = options["root"], str(tmp_path / "out")
    paged_client.put(root, "c", None, ["a", "b"], "t1")
    paged_client.put(root, "c", "t1", ["c"])

    def run():
        feed = paged.listing(spark, stream=True, pages_per_batch="1", **options)
        feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "offsets")).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(r["doc_id"] for r in spark.read.parquet(out).collect())

    assert run() == ["a", "b", "c"]
    paged_client.put(root, "c", "t1", ["c", "d"], "t2")  # the last page grew and got a successor
    paged_client.put(root, "c", "t2", ["e"])
    assert run() == ["a", "b", "c", "d", "e"] and run() == ["a", "b", "c", "d", "e"]


def test_documents_are_read_and_merged(spark, options):
    root = options["root"]
    paged_client.put(root, "c", None, ["a", "b", "gone", "x"])
    tab = lambda i, title, content, up=None: {"id": i, "parent_id": up, "position": 0, "title": title, "content": content}
    paged_client.put_document(root, "a", tabs=[tab("1", "Talk", ""), tab("2", " TRANSCRIPT ", "Ana thanks Bo.", "1"), tab("3", "Gemini notes", "n", "1")])
    paged_client.put_document(root, "b", provider="other", tabs=[tab("1", "Transcript", "x")])
    paged_client.put_document(root, "x", tabs=[tab("1", " ", "x")])
    listing, tabs, faults = paged.contents(paged.listing(spark, **options), options, ["transcript"], ["gemini notes"])
    assert {tuple(r) for r in faults.collect()} == {("gone", "missing"), ("b", "provider"), ("x", "no-title")}
    assert [(r["doc_id"], r["title"], r["locator"], r["provider_version"]) for r in listing.collect()] == [("a", "[2041-05-01] Talk a", "read/a", "1")]
    assert {(r["id"], r["role"]) for r in tabs.collect()} == {("1", "other"), ("2", "transcript"), ("3", "notes")} and tabs.where(F.col("doc_id") != "a").count() == 0

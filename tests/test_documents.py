"""Shape rules of stored documents and statements on odd rows."""

from datetime import datetime

from pyspark.sql import functions as F

from evidentia.operators import documents

VERSION = "version_id string, provider string, provider_id string, title string, locator string, provider_version string, modified_at timestamp_ntz, source_time timestamp_ntz"
SECTION = "version_id string, section_id string, title string, parent_id string, path array<string>, section_order long, role string, content string"


def test_versions(spark):
    at = datetime(2024, 1, 1)
    versions = spark.createDataFrame([("a", "s", "1", "t", "l", "1", at, None), ("b", "s", "1", " t ", "l", "1", at, None), ("c", "s", "1", "t", "l", "1", at, at), ("d", "s", "1", "t", "l", "1", at, None), ("e", "s", "", "t", "l", "1", at, None), ("f", "s", "1", "t", "l", "1", at, None)], VERSION)
    body = [("x", "t", None, ["t"], 0, "notes", "one"), ("y", "t", None, ["t"], 1, "notes", None)]
    rows = [(v, *s) for v in "abce" for s in body] + [("f", "", "t", None, ["t"], 0, "notes", "one")]
    out = {r[0]: (r[1], r[2]) for r in documents.version_records(versions, spark.createDataFrame(rows, SECTION)).collect()}
    assert out["a"] == out["b"] and out["a"][0] and out["c"][0] not in (None, out["a"][0])
    assert [out[k][1] for k in "def"] == ["no-sections", "provenance", "section-ids"] and not any(out[k][0] for k in "def")
    assert documents.version_records(versions.limit(0), spark.createDataFrame([], SECTION)).count() == 0


def test_section_order_matters(spark):
    v = spark.createDataFrame([("a", "s", "1", "t", "l", "1", datetime(2024, 1, 1), None)], VERSION)
    two = lambda x, y: spark.createDataFrame([("a", "x", "t", None, [], x, "notes", "one"), ("a", "y", "t", None, [], y, "notes", "two")], SECTION)
    first, again, other = (documents.version_records(v, s).first()["digest"] for s in (two(0, 1), two(0, 1), two(1, 0)))
    assert first == again != other


def test_codecs_refuse_wrong_shapes(spark):
    kinds = "kind string, text string, mention_id string, entity_id string, grounding_mention_id string"
    rows = [("absent", None, None, None, None), ("absent", "x", None, None, None), ("text", " ", None, None, None), ("entity", None, None, "e", None), ("entity", None, None, "e", "m"), ("grounded_entity", None, None, "e", "m"), ("grounded_entity", None, None, "e", None), ("other", "x", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, kinds).select(F.struct("*").alias("s"))
    assert [r[0] is not None for r in df.select(documents.decode_term(F.col("s"))).collect()] == [True, False, False, True, False, True, False, False, False]
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [("unknown", None, None), ("unknown", a, None), ("instant", a, None), ("instant", a, b), ("interval", None, b), ("interval", None, None), ("window", a, None), ("window", a, b), ("interval", a, a), (None, a, b)]
    df = spark.createDataFrame(rows, "k string, s timestamp_ntz, e timestamp_ntz")
    found = [r[0] for r in df.select(documents.extent_fault(F.col("k"), F.col("s"), F.col("e"))).collect()]
    assert found == [None, "bounds-of-unknown", None, "instant", None, "no-bound", "open-window", None, "not-after", "kind"]


def test_text_of_tables_in_order(spark):
    rows = [(1, 0, None, 0, None), (1, 3, 0, 1, "c"), (1, 1, 0, 0, None), (1, 2, 1, 0, "b"), (1, 4, None, 1, "d"), (2, 0, None, 0, None)]
    out = documents.structural_text(spark.createDataFrame(rows, "doc_id long, id long, parent_id long, position long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "bcd", 2: ""}

"""Claims, failures that stay with their document, and revisions in sync."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_ingest import CONFIG, NOW, answers, listing, now, outcomes, tabs

from evidentia.cli import TABLES
from evidentia.operators import records
from evidentia.sources.store import Store
from evidentia.streaming import leases, sync


def when(hours):
    return F.lit(NOW + timedelta(hours=hours)).cast("timestamp_ntz")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([("person:bo", "bo li", False)], "entity_id string, name string, is_alias boolean")


def test_two_syncs_of_one_listing(spark, tmp_path, names):
    """The second finds the first's documents busy; when the lease is over it takes them, and the first can't complete."""
    store = Store(spark, str(tmp_path), TABLES)
    claimed, sections, before = sync.prepare(store, listing(spark, "ad"), tabs(spark), CONFIG, when(0), "slow")
    assert outcomes(before) == {} and {(r["claim"], r["number"], r["owner"]) for r in claimed.collect()} == {("claimed", 1, "slow")}
    run = lambda at, who, **k: outcomes(sync.sync(store, listing(spark, "ade"), tabs(spark), answers(), names, CONFIG, at, owner=who, **k))
    assert run(when(0.5), "quick") == {"a": ("incomplete", "busy"), "d": ("incomplete", "busy"), "e": ("failed", "invalid-source")}
    # the owner itself goes on with its claim
    again, _, _ = sync.prepare(store, listing(spark, "ad"), tabs(spark), CONFIG, when(0.6), "slow")
    assert {(r["claim"], r["number"]) for r in again.collect()} == {("held", 1)}
    # after the lease another attempt begins; the slow owner's completion is refused, whenever it says that it ended
    taken, more, _ = sync.prepare(store, listing(spark, "a"), tabs(spark), CONFIG, when(1.5), "quick")
    assert {(r["claim"], r["number"]) for r in taken.collect()} == {("claimed", 2)}
    for at in (when(0.7), when(1.6)):
        late = outcomes(sync.finish(store, claimed.where("doc_id = 'a'"), sections, answers(), names, CONFIG, at))
        assert late == {"a": ("incomplete", "storage")}
    # d was not taken over, but its lease is over too
    assert outcomes(sync.finish(store, claimed.where("doc_id = 'd'"), sections, answers(), names, CONFIG, when(1.2))) == {"d": ("incomplete", "storage")}
    held = store.snapshot()
    assert held["runs"].count() == held["observations"].count() == held["spans"].count() == 0
    assert outcomes(sync.finish(store, taken, more, answers(), names, CONFIG, when(1.6))) == {"a": ("completed", "")}
    assert run(when(3), "third") == {"a": ("unchanged", ""), "d": ("completed", ""), "e": ("failed", "invalid-source")}
    held = store.snapshot()
    ended = {(r["number"], r["owner"], r["ended"]) for r in leases.standing(held["attempts"]).collect()}
    assert ended == {(2, "quick", "completed"), (2, "third", "completed")} and held["runs"].count() == 2


def test_a_model_that_fails_may_be_asked_again_at_once(spark, tmp_path, names):
    store = Store(spark, str(tmp_path), TABLES)
    run = lambda patience, at: outcomes(sync.sync(store, listing(spark, "bc"), tabs(spark), answers(patience), names, CONFIG, at))
    assert run("", when(0)) == {"b": ("failed", "invalid-extraction"), "c": ("incomplete", "model")}
    assert run("bc", when(0.1)) == {"b": ("completed", ""), "c": ("completed", "")}
    rows = store.snapshot()["attempts"].collect()
    assert sorted((r["number"], r["event"], (r["fault"] or "").split(":")[0]) for r in rows) == sorted([(1, "claimed", "")] * 2 + [(1, "failed", "invalid-extraction"), (1, "failed", "model")] + [(2, "claimed", ""), (2, "completed", "")] * 2)


def test_one_bad_write_set_stops_one_document(spark, tmp_path, names, monkeypatch):
    """A span that is missing from one document's write set; the others are completed, and what follows hears of them."""
    whole = sync.completion

    def torn(good, names, config):
        out = whole(good, names, config)
        bad = good.where("doc_id = 'b'").select("run_id")
        return out | {"spans": out["spans"].join(bad, "run_id", "left_anti")}

    monkeypatch.setattr(sync, "completion", torn)
    store, heard = Store(spark, str(tmp_path), TABLES), []
    got = outcomes(sync.sync(store, listing(spark, "abcd"), tabs(spark), answers("bc"), names, CONFIG, now(), after=lambda s, docs: heard.extend(r["doc_id"] for r in docs.collect())))
    assert got == {"a": ("completed", ""), "b": ("failed", "invalid-extraction"), "c": ("completed", ""), "d": ("completed", "")} and sorted(heard) == ["a", "c", "d"]
    held = store.snapshot()
    assert held["runs"].count() == 3 and held["observations"].count() == 3 and held["mentions"].count() == 6
    monkeypatch.undo()
    assert outcomes(sync.sync(store, listing(spark, "b"), tabs(spark), answers("bc"), names, CONFIG, when(1))) == {"b": ("completed", "")}


def revision(doc, number, hours):
    return (doc, "desk", f"[2041-05-01] Talk {doc}", f"talks/{doc}", str(number), NOW + timedelta(hours=hours))


def test_revisions_of_a_stream(spark, tmp_path, names):
    """Two revisions of a document in one batch and one that comes late all become versions; the newest stays current."""
    kind = sync.LISTED
    texts = spark.createDataFrame(
        [("a", f"t{n}", None, 0, "Transcript", "transcript", f"Ana Diaz <ana@x.org> thanks Bo Li. Take {n}.", str(n)) for n in range(1, 5)],
        "doc_id string, id string, parent_id string, position long, title string, role string, content string, provider_version string",
    )
    store, source = Store(spark, f"{tmp_path}/store", TABLES), tmp_path / "in"
    source.mkdir()
    feed = spark.readStream.schema(kind).parquet(str(source))
    current = []
    for batch, rows in enumerate([[revision("a", 3, 3), revision("a", 2, 2), revision("a", 2, 2)], [revision("a", 1, 1)], [revision("a", 4, 4), revision("a", 3, 3)]]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(str(source))
        run = sync.stream(store, texts, answers(), lambda: names, CONFIG, at=lambda batch=batch: when(10 + batch))
        feed.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start().awaitTermination(300)
        held = store.snapshot()
        current.append([r["provider_version"] for r in records.current_versions(held["pointers"]).join(held["versions"], "version_id").collect()])
    assert current == [["3"], ["3"], ["4"]]
    assert (held["versions"].count(), held["revisions"].count(), held["sources"].count(), held["runs"].count(), held["pointers"].count()) == (4, 4, 1, 4, 2)
    assert {r["modified_at"] for r in held["versions"].collect()} == {NOW + timedelta(hours=h) for h in range(1, 5)} and isinstance(NOW, datetime)

"""The snapshot store and ingest: commits, replays, crashes, replacements, cascades and streams."""

import shutil

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import relation_text
from quarrymill.operators import ingest, snapshots

DOC = "source_id long, external_id string, title string, content string"
RULES = (relation_text.Rule("PROVES", ("proves",)), relation_text.Rule("CONTAINS", ("holds",)))


@pytest.fixture
def store(spark, tmp_path):
    return snapshots.Store(spark, f"file://{tmp_path}/store")


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOC)


def names(store, version=None):
    return sorted(r.name for r in store.read("entities", version).collect())


def counts(store):
    return {t: store.read(t).count() for t in ("documents", "chunks", "events", "bridge", "entities", "edges")}


def test_ingest_reads_back_and_a_replay_changes_nothing(spark, store):
    rows = docs(spark, (1, "a", "A", "# one\nAmber Press proves Delta Ledger.\n# two\nGrand Hall holds Amber Press."), (1, "b", "B", "Delta Ledger stays."))
    assert ingest.ingest(store, rows, "first", rules=RULES) == 1 and ingest.ingest(store, rows, "first", rules=RULES) == 1 and store.version() == 1
    assert counts(store) == {"documents": 2, "chunks": 3, "events": 3, "bridge": 5, "entities": 3, "edges": 4}
    ids = {r.entity_id: r.name for r in store.read("entities").collect()}
    assert sorted(ids.values()) == ["Amber Press", "Delta Ledger", "Grand Hall"]
    assert {(ids[e.subject], e.kind, ids[e.object]) for e in store.read("edges").collect()} == {
        ("Amber Press", "PROVES", "Delta Ledger"), ("Delta Ledger", "PROVES", "Amber Press"), ("Grand Hall", "CONTAINS", "Amber Press"), ("Amber Press", "CONTAINS", "Grand Hall")
    }
    held = {r.entity_id: r.n for r in store.read("holders").groupBy("entity_id").agg(F.sum("delta").alias("n")).collect()}
    assert held == {r.entity_id: r["count"] for r in store.read("bridge").groupBy("entity_id").count().collect()}


def test_replace_is_one_commit_and_old_readers_stay(spark, store):
    ingest.ingest(store, docs(spark, (1, "a", "A", "Amber Press proves Delta Ledger."), (1, "b", "B", "Delta Ledger stays. Grand Hall too."), (2, "a", "C", "Amber Press elsewhere.")), "one", rules=RULES)
    before = names(store, 1)
    old = store.read("documents")
    assert ingest.ingest(store, docs(spark, (1, "a", "A2", "Nothing But Harbor Lights here.")), "two", replace=True, rules=RULES) == 2
    now = {(r.source_id, r.external_id): r.title for r in store.read("documents").collect()}
    assert now == {(1, "a"): "A2", (1, "b"): "B", (2, "a"): "C"}
    assert {r.title for r in old.collect()} == {"A", "B", "C"} and names(store, 1) == before
    gone = set(store.read("documents", 1).select("document_id").toPandas().document_id) - set(store.read("documents").select("document_id").toPandas().document_id)
    for t in ("chunks", "events", "bridge", "edges"):
        assert not set(store.read(t).select("document_id").toPandas().document_id) & gone
    held = {r.entity_id for r in store.read("bridge").collect()}
    assert {r.entity_id for r in store.read("entities").collect()} == held
    assert all(e.subject in held and e.object in held for e in store.read("edges").collect())


def test_a_crash_before_the_commit_leaves_nothing_and_a_retry_commits(spark, store, monkeypatch):
    ingest.ingest(store, docs(spark, (1, "a", "A", "Amber Press.")), "one")
    whole = counts(store)
    real = snapshots.Commit.publish

    def crash(self):
        raise OSError("lost")

    monkeypatch.setattr(snapshots.Commit, "publish", crash)
    with pytest.raises(OSError):
        ingest.ingest(store, docs(spark, (1, "a", "A2", "Delta Ledger.")), "two", replace=True)
    assert store.version() == 1 and counts(store) == whole
    monkeypatch.setattr(snapshots.Commit, "publish", real)
    assert ingest.ingest(store, docs(spark, (1, "a", "A2", "Delta Ledger.")), "two", replace=True) == 2
    assert [r.title for r in store.read("documents").collect()] == ["A2"]


def test_two_commits_of_one_version_conflict(spark, store):
    one, two = store.begin("one"), store.begin("two")
    rows = spark.createDataFrame([(1,)], "k long")
    one.append("t", rows)
    two.append("t", rows)
    assert one.publish() == 1
    with pytest.raises(snapshots.Conflict):
        two.publish()
    assert store.read("t").count() == 1 and one.publish() == 1  # its id is done


def test_delete_rewrites_only_files_with_the_rows(spark, store):
    commit = store.begin("one")
    for part in range(3):
        commit.append("t", spark.createDataFrame([(10 * part + k, part) for k in range(5)], "k long, part int").coalesce(1))
    commit.publish()
    before = set(store.manifest()["tables"]["t"]["files"])
    commit = store.begin("two")
    assert commit.delete("t", spark.createDataFrame([(11,), (13,), (99,)], "k long"), ["k"]) == 1
    commit.publish()
    after = set(store.manifest()["tables"]["t"]["files"])
    assert len(before & after) == 2 and sorted(r.k for r in store.read("t").collect()) == [0, 1, 2, 3, 4, 10, 12, 14, 20, 21, 22, 23, 24]


def test_shared_entities_stay_and_unshared_go_with_their_edges(spark, store):
    ingest.ingest(store, docs(spark, (1, "a", "A", "Amber Press proves Delta Ledger."), (1, "b", "B", "Delta Ledger holds Grand Hall.")), "one", rules=RULES)
    a = store.read("documents").filter("external_id = 'a'")
    assert ingest.delete(store, a, "gone") == 2 and ingest.delete(store, a, "gone") == 2
    assert names(store) == ["Delta Ledger", "Grand Hall"] and store.read("documents").count() == 1
    assert ingest.delete(store, store.read("documents"), "all") == 3
    assert all(n == 0 for n in counts(store).values()) and store.read("holders").count() == 0


def test_rebuild_takes_stored_texts_in_again(spark, store):
    ingest.ingest(store, docs(spark, (1, "a", "A", "Amber Press proves Delta Ledger."), (2, "b", "B", "Grand Hall.")), "one")
    assert store.read("edges").count() == 0
    assert ingest.rebuild(store, 1, "again", rules=RULES) == 2
    assert store.read("edges").count() > 0 and store.read("documents").count() == 2
    assert {r.external_id: r.commit_id for r in store.read("documents").collect()} == {"a": "again", "b": "one"}


def test_bad_rows_are_quarantined_or_stop_the_ingest(spark, store):
    rows = docs(spark, (1, "a", "A", "Amber Press."), (1, "x", "X", "  "), (None, "y", "Y", "text"), (1, None, "Z", "text"), (1, "a", "A", "Amber Press."))
    with pytest.raises(ValueError):
        ingest.ingest(store, rows, "strict", stop_on_error=True)
    assert store.version() == 0
    ingest.ingest(store, rows, "lenient")
    assert sorted(r.error for r in store.read("quarantine").collect()) == ["content is empty", "external id is missing", "source is missing"]
    assert store.read("documents").count() == 1
    ingest.ingest(store, rows.limit(0), "nothing")
    assert store.read("documents").count() == 1 and store.read("documents").columns == store.read("documents", 1).columns


def test_a_stream_commits_batches_once(spark, store, tmp_path):
    folder = tmp_path / "in"
    docs(spark, (1, "a", "A", "Amber Press."), (1, "x", "X", "")).write.json(str(folder / "0"))
    source = lambda: spark.readStream.schema(DOC).option("maxFilesPerTrigger", 10).json(str(folder / "*"))

    def run(checkpoint):
        ingest.stream(source(), store, "feed").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    run(tmp_path / "c1")
    assert store.version() == 1 and store.read("quarantine").count() == 1
    docs(spark, (1, "a", "A2", "Delta Ledger.")).write.json(str(folder / "1"))
    run(tmp_path / "c1")
    assert store.version() == 2 and [r.title for r in store.read("documents").collect()] == ["A2"]
    shutil.rmtree(tmp_path / "c1")  # the stream forgets what it did and replays: its batches are done already
    run(tmp_path / "c1")
    assert store.version() == 2 and [r.title for r in store.read("documents").collect()] == ["A2"]

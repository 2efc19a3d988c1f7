from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.operators import incremental as I
from sheafwork.sources.versioned import ConcurrentCommit, Manifest, VersionedTable, diff

ITEM = "item_seq long, collection string, source_id string, document_id string, media_type string, path string, size_bytes long, modified_utc string, content_hash binary, seen_utc timestamp"
STATE = "collection string, source_id string, document_id string, content_hash binary, recipe_hash binary, size_bytes long, modified_utc string, status string, last_run_id string, updated_utc string"
RECIPE = "recipe_id int, collection string, media_type string, recipe_hash binary, active_from_utc timestamp, retired_utc timestamp"
T0 = datetime(2025, 1, 1)


def item(n, doc, content, kind="text/plain", seen=T0, col="kb"):
    return (n, col, "s", doc, kind, None, 1, None, content, seen)


def state(doc, content, recipe=b"R", status="Indexed", at="2025-01-01T00:00:00Z", col="kb"):
    return (col, "s", doc, content, recipe, 1, None, status, "r", at)


@pytest.fixture
def recipe(spark):
    return spark.createDataFrame([(1, "kb", "Text/Plain", b"R", T0, None), (2, "kb", "text/plain", b"Q", T0, T0)], RECIPE)


def test_what_is_pending(spark, recipe, rows):
    items = [
        item(1, "same", b"A"), item(2, "new", b"A"), item(3, "changed", b"B"), item(4, "pending", b"A"), item(5, "recipe", b"A"), item(6, "null", None), item(7, "zero", b"\0\0"),
        item(8, "kind", b"A", "TEXT/plain; charset=utf-8"), item(9, "unknown", b"A", "text/none"), item(10, "offset", b"B"), item(11, "twice", b"A", seen=datetime(2025, 1, 2)), item(12, "twice", b"B"),
        item(13, "nanos", b"B"), item(14, None, b"A"), item(2, "new", b"A"),
    ]
    st = [
        state("same", b"A", status=" INDEXED "), state("changed", b"A"), state("pending", b"A", status="Pending"), state("recipe", b"A", b"Q"), state("null", None), state("zero", b"\0\0"), state("kind", b"A"), state("unknown", b"A"),
        # the later instant holds the newer digest, though its text sorts first
        state("offset", b"B", at="2025-01-01T00:30:00-05:00"), state("offset", b"A", at="2025-01-01T03:00:00Z"), state("twice", b"A", status="NoTextLayer"), state("twice", b"A", status="NoTextLayer"),
        state("nanos", b"B", at="2025-01-01T00:00:00.1234562Z"), state("nanos", b"A", at="2025-01-01T00:00:00.1234561Z"), state("absent", b"A", status="Pending"),
    ]
    got = I.to_process(spark.createDataFrame(items, ITEM), spark.createDataFrame(st, STATE), recipe)
    assert {r["document_id"] for r in got.collect()} == {"new", "changed", "pending", "recipe", "null", "zero", "unknown", None}
    assert got.count() == 8


def test_extra_and_clashing_columns(spark, recipe):
    items = spark.createDataFrame([item(1, "a", b"A")], ITEM).withColumn("status", F.lit("x")).withColumn("_type", F.lit(1)).withColumn("_recipe", F.lit(1))
    st = spark.createDataFrame([state("a", b"A")], STATE).withColumn("media_type", F.lit("x")).withColumn("seen_utc", F.lit(1))
    assert I.to_process(items, st, recipe.withColumn("document_id", F.lit(1))).count() == 0
    assert I.to_process(items, st.limit(0), recipe.limit(0)).count() == 1
    assert I.to_process(items.limit(0), st, recipe).count() == 0


def test_manifest_diff():
    a, b = Manifest(1, {"x": None, "y": None, "z": "d1"}), Manifest(2, {"y": "d2", "z": "d1", "w": None})
    d = diff(a, b)
    assert (d.added, d.removed, d.redeleted) == (("w",), ("x",), ("y",))


def test_changes_read_deletion_vectors(spark, tmp_path, rows):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(add=spark.range(6).coalesce(1))
    t.commit(delete_keys=spark.range(2))
    t.commit(add=spark.range(10, 12), delete_keys=spark.range(3, 4))
    assert rows(t.read()) == [(2,), (4,), (5,), (10,), (11,)]
    assert rows(t.changes(0)) == [(i, "insert") for i in (2, 4, 5, 10, 11)]
    assert rows(t.changes(1)) == [(0, "delete"), (1, "delete"), (3, "delete"), (10, "insert"), (11, "insert")]
    assert rows(t.changes(2)) == [(3, "delete"), (10, "insert"), (11, "insert")]
    assert rows(t.changes(3)) == []
    # going back, hidden rows are shown again
    assert rows(I.changed_rows(spark, t.manifest(3), t.manifest(1), t.schema(1))) == [(0, "insert"), (1, "insert"), (3, "insert"), (10, "delete"), (11, "delete")]
    t.commit(add=spark.range(1), overwrite=True)
    assert rows(t.read()) == [(0,)]
    assert rows(t.read(1)) == [(i,) for i in range(6)]


def test_one_writer_wins(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.commit(add=spark.range(1))
    with pytest.raises(ConcurrentCommit):
        t.commit(add=spark.range(1), expected=0)
    with pytest.raises(ConcurrentCommit):
        t._create(1, "{}")
    assert t.version() == 1 and t.read().count() == 1


def test_runs_neither_skip_nor_repeat(spark, tmp_path, recipe):
    src, st = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/state")
    schema = spark.createDataFrame([], STATE).schema
    st.commit(add=spark.createDataFrame([], STATE))
    src.commit(add=spark.createDataFrame([item(i, f"d{i}", b"A") for i in range(5)], ITEM))
    seen: list[str] = []

    def work(fail=False, only=None):
        def process(todo):
            out = todo if only is None else todo.where(F.col("document_id").isin(only))
            seen[:] = sorted(r["document_id"] for r in out.collect())
            if fail:
                raise RuntimeError("died")
            return I.state_rows(out, schema, "r", "2025-02-01T00:00:00Z")

        return process

    with pytest.raises(RuntimeError):
        I.run(spark, src, st, recipe, work(fail=True))
    assert st.version() == 1 and st.properties() == {}
    # part of it is processed; the rest comes again though nothing was delivered anew
    assert I.run(spark, src, st, recipe, work(only=["d0", "d1"])) == 2
    assert I.run(spark, src, st, recipe, work()) == 3 and seen == ["d2", "d3", "d4"]
    assert I.run(spark, src, st, recipe, work()) == 0
    src.commit(add=spark.createDataFrame([item(9, "d1", b"B", seen=datetime(2025, 3, 1)), item(10, "d7", b"A")], ITEM))
    assert I.run(spark, src, st, recipe, work()) == 2 and seen == ["d1", "d7"]
    assert I.run(spark, src, st, recipe, work()) == 0
    # another recipe makes everything pending
    assert I.run(spark, src, st, recipe.withColumn("recipe_hash", F.lit(b"N")), work()) == 6
    assert st.properties()[I.PROCESSED] == "2" and st.read().count() == 6


@pytest.mark.parametrize("by", ["vector", "file"])
def test_withdrawn_rows_compete_no_longer(spark, tmp_path, recipe, by):
    src, st = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/state")
    schema = spark.createDataFrame([], STATE).schema
    st.commit(add=spark.createDataFrame([], STATE))
    kept = spark.createDataFrame([item(1, "older", b"A"), item(2, "same", b"A")], ITEM)
    src.commit(add=kept)
    gone = spark.createDataFrame([item(3, "older", b"B", seen=datetime(2025, 3, 1)), item(4, "unfinished", b"A")], ITEM)
    src.commit(add=gone)
    seen = []

    def work(todo):
        seen[:] = sorted((r["document_id"], bytes(r["content_hash"])) for r in todo.collect())
        return I.state_rows(todo.where("document_id <> 'unfinished'"), schema, "r", "2025-02-01T00:00:00Z")

    assert I.run(spark, src, st, recipe, work) == 2
    assert seen == [("older", b"B"), ("same", b"A"), ("unfinished", b"A")]
    if by == "vector":
        src.commit(delete_keys=gone.select("item_seq"))
    else:
        src.commit(add=kept, overwrite=True)
    assert I.run(spark, src, st, recipe, work) == 1 and seen == [("older", b"A")]
    assert I.run(spark, src, st, recipe, work) == 0 and seen == []
    assert st.properties()[I.PROCESSED] == "3"


def test_withdrawn_documents_are_retired_not_processed(spark, tmp_path, recipe):
    src, st = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/state")
    schema = spark.createDataFrame([], STATE).schema
    st.commit(add=spark.createDataFrame([], STATE))
    items = spark.createDataFrame([item(i, f"d{i}", b"A") for i in range(20)], ITEM)
    src.commit(add=items)
    work = lambda todo: I.state_rows(todo, schema, "r", "2025-02-01T00:00:00Z")
    assert I.run(spark, src, st, recipe, lambda todo: work(todo.where("document_id < 'd15'"))) == 7
    src.commit(delete_keys=items.select("document_id"))
    assert I.run(spark, src, st, recipe, work) == 0 and st.read().count() == 0
    src.commit(add=items)
    assert I.run(spark, src, st, recipe, work) == 20 and I.run(spark, src, st, recipe, work) == 0


def test_a_run_opens_only_what_changed(spark, tmp_path, recipe, monkeypatch):
    src, st = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/state")
    schema = spark.createDataFrame([], STATE).schema
    st.commit(add=spark.createDataFrame([], STATE))
    work = lambda todo: I.state_rows(todo, schema, "r", "2025-02-01T00:00:00Z")
    for k in range(3):
        src.commit(add=spark.createDataFrame([item(10 * k + i, f"d{k}{i}", b"A") for i in range(4)], ITEM).coalesce(1))
    assert I.run(spark, src, st, recipe, work) == 12
    src.commit(add=spark.createDataFrame([item(90, "d00", b"B", seen=datetime(2025, 3, 1))], ITEM).coalesce(1))
    opened = changed = I.changed_rows(spark, src.manifest(3), src.manifest(4), src.schema())
    assert len(opened.inputFiles()) == 1 and changed.count() == 1
    read = []
    monkeypatch.setattr(I, "_read", lambda *a: read.append(a))  # an append alone never searches the source
    assert I.run(spark, src, st, recipe, work) == 1 and not read
    monkeypatch.undo()
    # an older delivery that comes late is no change
    src.commit(add=spark.createDataFrame([item(91, "d00", b"C", seen=datetime(2024, 3, 1))], ITEM).coalesce(1))
    assert I.run(spark, src, st, recipe, work) == 0


def test_each_delete_writes_a_vector_for_the_files_it_hits(spark, tmp_path, rows):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    for k in range(3):
        t.commit(add=spark.range(10 * k, 10 * k + 5).coalesce(1))
    for k in range(3):
        t.commit(delete_keys=spark.range(10 * k, 10 * k + 2))
    assert [len(diff(t.manifest(v), t.manifest(v + 1)).redeleted) for v in (3, 4, 5)] == [1, 1, 1]
    assert len(t.changes(5).inputFiles()) == 2  # a data file and its vector
    t.commit(delete_keys=spark.range(0, 3))  # two of them are deleted already
    assert rows(t.changes(6)) == [(2, "delete")] and rows(t.changes(4, 6)) == [(10, "delete"), (11, "delete"), (20, "delete"), (21, "delete")]
    assert rows(t.read()) == [(i,) for i in (3, 4, 12, 13, 14, 22, 23, 24)]
    before = t.version()
    t.compact()
    assert t.compact() == before + 1 and not any(t.manifest().files.values()) and rows(t.read()) == rows(t.read(before))
    t.commit(delete_keys=spark.range(99, 100))
    assert not any(t.manifest().files.values())


def test_a_dead_run_leaves_deliveries_that_do_not_count(spark, tmp_path, recipe, monkeypatch):
    src, st = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/state")
    schema = spark.createDataFrame([], STATE).schema
    st.commit(add=spark.createDataFrame([], STATE))
    work = lambda todo: I.state_rows(todo, schema, "r", "2025-02-01T00:00:00Z")
    src.commit(add=spark.createDataFrame([item(1, "a", b"A")], ITEM))
    assert I.run(spark, src, st, recipe, work) == 1
    src.commit(add=spark.createDataFrame([item(2, "b", b"A")], ITEM))
    commit = st.commit
    monkeypatch.setattr(st, "commit", lambda **kw: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        I.run(spark, src, st, recipe, work)
    monkeypatch.setattr(st, "commit", commit)
    assert I.run(spark, src, st, recipe, work) == 1 and I.run(spark, src, st, recipe, work) == 0
    kept = VersionedTable(spark, f"{st.root}/deliveries")
    assert kept.read(int(st.properties()[I.DELIVERIES])).count() == 2


def test_a_lost_race_changes_nothing(spark, tmp_path, recipe):
    src, st = VersionedTable(spark, f"file://{tmp_path}/src"), VersionedTable(spark, f"file://{tmp_path}/state")
    schema = spark.createDataFrame([], STATE).schema
    st.commit(add=spark.createDataFrame([], STATE))
    src.commit(add=spark.createDataFrame([item(1, "a", b"A")], ITEM))

    def process(todo):
        st.commit(add=spark.createDataFrame([], STATE))  # another writer, meanwhile
        return I.state_rows(todo, schema, "r", "2025-02-01T00:00:00Z")

    with pytest.raises(ConcurrentCommit):
        I.run(spark, src, st, recipe, process)
    assert st.version() == 2 and st.read().count() == 0


def test_delivery_order(spark):
    items = spark.createDataFrame([item(1, "a", b"A"), item(2, "a", b"B"), item(3, "a", b"C", seen=None)], ITEM)
    got = {r["item_seq"]: r["delivery_no"] for r in I.delivery_order(items).collect()}
    assert got == {2: 1, 1: 2, 3: 3}
    assert isinstance(I.current_delivery(items).schema["content_hash"].dataType, T.BinaryType)

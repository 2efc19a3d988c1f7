import dataclasses
import datetime
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError
from sheafwork.functions.filters import Field
from sheafwork.operators import chat, chunking, embedding, rag, state
from sheafwork.operators.collection import Collection, Definition, list_collections, query
from sheafwork.operators.ingest import Budget, Pipeline
from sheafwork.sources import files
from sheafwork.sources.extract import Registry
from sheafwork.sources.versioned import VersionedTable
from sheafwork.streaming import ingest as streams


class Counting:
    """An embedder that writes down how many texts it was given."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, texts):
        import os

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write(str(len(texts)))
        return embedding.hashing_embedder(8)(texts)

    def total(self):
        import os

        return sum(int(open(os.path.join(self.folder, n)).read()) for n in os.listdir(self.folder))  # noqa: SIM115


@pytest.fixture
def pipeline(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    counting = Counting(tmp_path / "calls")
    return Pipeline(spark, f"file://{tmp_path}/kb", "kb", chunking.resolve(64, heading_budget=8), counting, 8), counting


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id string, text string, media_type string")


def test_rerun_does_nothing(spark, pipeline):
    p, calls = pipeline
    a = docs(spark, ("a", "One.\n\nTwo.", "text/plain"), ("b", "# H\n\nBody.", "text/markdown"), ("c", None, None), ("d", "One.\n\nTwo.", "text/plain"))
    r = p.run(a, "s")
    assert r.outcome == "Completed" and r.counts["seen"] == 4 and r.counts["indexed"] == 4 and r.counts["added"] == 3
    # one text in two documents is embedded once
    assert calls.total() == 2
    again = p.run(a, "s")
    assert again.counts["skipped"] == 4 and again.counts["indexed"] == 0 and calls.total() == 2
    st = {x["document_id"]: (x["status"], x["chunk_count"]) for x in p.state.read().collect()}
    assert st == {"a": ("Indexed", 1), "b": ("Indexed", 1), "c": ("NoTextLayer", 0), "d": ("Indexed", 1)}


def test_changes_are_diffed_and_missing_pruned(spark, pipeline):
    p, calls = pipeline
    long = "\n\n".join(f"Paragraph {i} " + "word " * 12 for i in range(4))
    p.run(docs(spark, ("a", long, "text/plain"), ("b", "gone", "text/plain")), "s")
    before = {r["chunk_key"] for r in p.chunks.read().where("document_id = 'a'").collect()}
    n = calls.total()
    r = p.run(docs(spark, ("a", "New first. " + "word " * 20 + "\n\n" + long, "text/plain")), "s")
    after = p.chunks.read().collect()
    assert r.counts["removed_documents"] == 1 and {x["document_id"] for x in after} == {"a"} and p.state.read().count() == 1
    assert calls.total() - n <= r.counts["added"] and all(len(x["embedding"]) == 8 for x in after)
    assert len({x["chunk_key"] for x in after}) == len(after) and before


def test_budgets_suspend_and_the_next_run_goes_on(spark, pipeline):
    p, calls = pipeline
    items = docs(spark, *[(f"d{i}", f"text {i}", "text/plain") for i in range(6)])
    r = p.run(items, "s", most_documents=2)
    assert (r.outcome, r.suspend_reason, r.counts["indexed"]) == ("Suspended", "budget:documents", 2)
    # skipped documents are seen, too
    r = p.run(items, "s", budget=Budget(documents=3))
    assert (r.counts["skipped"], r.counts["indexed"]) == (2, 1)
    r = p.run(items, "s", budget=Budget(chunks=1))
    assert (r.outcome, r.suspend_reason, r.counts["added"]) == ("Suspended", "budget:chunks", 1)
    r = p.run(items, "s", budget=Budget(tokens=1))
    assert (r.outcome, r.suspend_reason, r.counts["indexed"], r.counts["tokens"]) == ("Suspended", "budget:tokens", 1, 2)
    r = p.run(items, "s", budget=Budget(seconds=0.0))
    assert (r.outcome, r.suspend_reason, r.counts["indexed"]) == ("Suspended", "budget:duration", 0)
    last = p.run(items, "s", budget=Budget(seconds=600.0, chunks=99))
    assert last.outcome == "Completed" and last.counts["indexed"] == 1 and p.chunks.read().count() == 6 and calls.total() == 6


class Shifted:
    """Another model: other vectors for the same texts."""

    def __call__(self, texts):
        return -embedding.hashing_embedder(8)(texts)


def test_another_model_embeds_everything_again(spark, pipeline, tmp_path):
    p, calls = pipeline
    items = docs(spark, ("a", "One text.", "text/plain"), ("b", "Other text.", "text/plain"), ("c", "", "text/plain"))
    p.run(items, "s")
    old = {r["chunk_key"]: r["embedding"] for r in p.chunks.read().collect()}
    make = lambda **kw: Pipeline(spark, f"file://{tmp_path}/kb", "kb", chunking.resolve(64, heading_budget=8), Shifted(), 8, model="shifted", **kw)
    with pytest.raises(SheafError, match="6009"):
        make(strict_recipe=True).run(items, "s")
    assert {r["chunk_key"]: r["embedding"] for r in p.chunks.read().collect()} == old
    q = make()
    r = q.run(items, "s")
    assert (r.counts["indexed"], r.counts["added"], r.counts["reembedded"], r.counts["unchanged"]) == (3, 2, 2, 0)
    new = q.chunks.read().collect()
    assert {x["chunk_key"] for x in new} == set(old)
    for x in new:
        assert x["embedding"] == pytest.approx([-v for v in old[x["chunk_key"]]]) and x["recipe_hash"] == q.state.read().where("document_id = 'a'").first()["recipe_hash"]
    assert q.run(items, "s").counts["skipped"] == 3
    # back again: vectors of the first recipe are gone, so they are made anew and not taken from the second
    n = calls.total()
    r = p.run(items, "s")
    assert r.counts["reembedded"] == 2 and calls.total() == n + 2 and {x["chunk_key"]: x["embedding"] for x in p.chunks.read().collect()} == old


def test_vectors_are_reused_under_one_recipe_only(spark, pipeline, tmp_path):
    p, calls = pipeline
    p.run(docs(spark, ("a", "same words", "text/plain")), "s")
    assert p.run(docs(spark, ("z", "same words", "text/plain")), "t").counts["added"] == 1 and calls.total() == 1
    # another extractor is another recipe, and another collection has its own vectors
    p.run(docs(spark, ("m", "same words", "text/markdown")), "u")
    assert calls.total() == 2
    (tmp_path / "more").mkdir()
    more = Counting(tmp_path / "more")
    Pipeline(spark, f"file://{tmp_path}/kb", "other", chunking.resolve(64, heading_budget=8), more, 8).run(docs(spark, ("a", "same words", "text/plain")), "s")
    assert more.total() == 1


def broken(data):
    raise ValueError("cannot read this")


def test_a_failed_document_fails_alone(spark, tmp_path):
    reg = Registry()
    reg.add("broken", {"application/x-broken"}, set(), broken)
    o = chunking.resolve(64, heading_budget=8, overflow="throw")
    make = lambda **kw: Pipeline(spark, f"file://{tmp_path}/kb", "kb", o, embedding.hashing_embedder(8), 8, registry=reg, **kw)
    p = make()
    rows = [("a", "fine", "text/plain"), ("b", "x", "application/x-broken"), ("c", "y", "application/x-none"), ("d", "word " * 500, "text/plain"), ("e", None, "text/plain")]
    r = p.run(docs(spark, *rows), "s")
    assert (r.counts["indexed"], r.counts["failed"]) == (3, 2)
    st = {x["document_id"]: (x["status"], (x["error"] or "")[:4]) for x in p.state.read().collect()}
    assert st == {"a": ("Indexed", ""), "b": ("Failed", "cann"), "c": ("Unsupported", "6101"), "d": ("Failed", "6151"), "e": ("NoTextLayer", "")}
    # nothing has changed, so nothing is tried again
    assert p.run(docs(spark, *rows), "s").counts["skipped"] == 5
    assert p.run(docs(spark, *rows), "s", force=True).counts["failed"] == 2
    # a document too large is never read, and is no sign of trouble
    q = make(most_bytes=3, abort_after=1)
    r = q.run(spark.createDataFrame([("big", "large text", "text/plain"), ("ok", "abc", "text/plain")], "document_id string, text string, media_type string"), "t")
    assert r.counts["failed"] == 1 and {x["error"][:4] for x in q.state.read().where("document_id = 'big'").collect()} == {"6052"}
    assert q.run(docs(spark, ("big", "large text", "text/plain"), ("ok", "abc", "text/plain")), "t").counts["skipped"] == 2


def test_failures_in_a_row_end_the_run(spark, tmp_path):
    reg = Registry()
    reg.add("broken", {"application/x-broken"}, set(), broken)
    p = Pipeline(spark, f"file://{tmp_path}/kb", "kb", chunking.resolve(64, heading_budget=8), embedding.hashing_embedder(8), 8, registry=reg, abort_after=3)
    kinds = "bbgbbbbg"  # the third failure in a row is the sixth document
    rows = [(i, f"d{i}", f"text {i}", "application/x-broken" if k == "b" else "text/plain") for i, k in enumerate(kinds)]
    items = spark.createDataFrame(rows, "n int, document_id string, text string, media_type string")
    with pytest.raises(SheafError, match="6010"):
        p.run(items, "s", order=["n"])
    assert sorted(r["document_id"] for r in p.state.read().collect()) == [f"d{i}" for i in range(6)]
    assert p.chunks.read().count() == 1 and [r["outcome"] for r in p.runs.read().collect()] == ["Failed"]


def test_runs_are_recorded_in_order(spark, tmp_path):
    at = datetime.datetime(2025, 1, 1, tzinfo=datetime.UTC)
    p = Pipeline(spark, f"file://{tmp_path}/kb", "kb", chunking.resolve(64, heading_budget=8), embedding.hashing_embedder(8), 8, clock=lambda: at, keep_runs=2)
    for _ in range(3):
        p.run(docs(spark, ("a", "text", "text/plain")), "s")
    runs = sorted(p.runs.read().collect(), key=lambda r: r["started_utc"])
    assert [(r["started_utc"][20:26], r["outcome"], r["documents_indexed"]) for r in runs] == [("000001", "Completed", 0), ("000002", "Completed", 0)]


def test_filters_and_unreadable_folders_do_not_prune(spark, pipeline):
    p, _ = pipeline
    rows = [("x/a", "one", "text/plain"), ("x/b", "two", "text/plain"), ("y/c", "three", "text/plain")]
    p.run(docs(spark, *rows), "s", only=F.col("document_id") != "y/c")
    assert p.state.read().count() == 2
    p.run(docs(spark, *rows), "s")
    r = p.run(docs(spark, rows[1]), "s", unreadable=["y/"])
    assert r.counts["removed_documents"] == 1 and {x["document_id"] for x in p.state.read().collect()} == {"x/b", "y/c"} == {x["document_id"] for x in p.chunks.read().collect()}


def test_files_and_bytes(spark, pipeline, tmp_path):
    p, _ = pipeline
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Head\n\nBody text.")
    (tmp_path / "in/b.txt").write_bytes("caf\u00e9".encode("latin-1"))
    (tmp_path / "in/c.bin").write_bytes(b"\0\1")
    r = p.run(files.folder(spark, f"file://{tmp_path}/in"), "disk")
    assert (r.counts["seen"], r.counts["indexed"]) == (3, 3)
    st = {x["document_id"]: x["status"] for x in p.state.read().collect()}
    assert st == {"a.md": "Indexed", "b.txt": "Indexed", "c.bin": "Unsupported"}
    got = {x["document_id"]: (x["text"], x["heading_path"]) for x in p.chunks.read().collect()}
    assert got == {"a.md": ("Body text.", "Head"), "b.txt": ("caf\u00e9", "")}
    assert p.run(files.folder(spark, f"file://{tmp_path}/in"), "disk").counts["skipped"] == 3


def test_another_recipe_does_all_again(spark, pipeline, tmp_path):
    p, calls = pipeline
    items = docs(spark, ("a", "text", "text/plain"))
    p.run(items, "s")
    q = Pipeline(spark, f"file://{tmp_path}/kb", "kb", chunking.resolve(48, heading_budget=8), calls, 8)
    assert q.recipe != p.recipe and q.run(items, "s").counts["indexed"] == 1


def test_empty_source(spark, pipeline):
    assert pipeline[0].run(spark.createDataFrame([], "document_id string, text string, media_type string"), "s").counts["seen"] == 0


def test_stream_takes_each_in_once(spark, pipeline, tmp_path):
    p, _ = pipeline
    src = f"file://{tmp_path}/in"
    schema = T.StructType.fromDDL("document_id string, text string, media_type string")
    results = []
    for k in range(2):
        docs(spark, (f"d{k}", f"text {k}", "text/plain")).coalesce(1).write.mode("append").parquet(src)
        streams.ingest_stream(streams.read_stream(spark, src, schema), p, "s", f"file://{tmp_path}/ck", results.append).awaitTermination()
    assert sum(r.counts["indexed"] for r in results) == 2 and p.state.read().count() == 2


def test_the_first_delivery_counts_and_later_ones_fail(spark, pipeline):
    p, _ = pipeline
    rows = [(n, "a" if n else "b", f"text {n}", "text/plain") for n in (3, 1, 0, 2)]
    items = spark.createDataFrame(rows, "n int, document_id string, text string, media_type string").repartition(3)
    r = p.run(items, "s", order=["n"])
    assert {k: r.counts[k] for k in ("seen", "indexed", "failed", "skipped")} == {"seen": 4, "indexed": 2, "failed": 2, "skipped": 0}
    assert {(x["document_id"], x["text"]) for x in p.chunks.read().collect()} == {("a", "text 1"), ("b", "text 0")} and p.state.read().count() == 2
    assert [(x["document_id"], x["error"][:4]) for x in p.failures.read().collect()] == [("a", "6054")] * 2
    again = p.run(items, "s", order=["n"])
    assert again.counts["indexed"] == 0 and again.counts["skipped"] == 2 and again.counts["failed"] == 2


def test_append_and_windows(spark, tmp_path):
    src = f"file://{tmp_path}/ev"
    spark.createDataFrame([(datetime.datetime(2024, 1, 1, h), "a") for h in (0, 0, 1)], "ts timestamp, k string").write.parquet(src)
    schema = T.StructType.fromDDL("ts timestamp, k string")
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    for _ in range(2):
        streams.append_stream(streams.read_stream(spark, src, schema), t, f"file://{tmp_path}/ck2").awaitTermination()
    assert t.read().count() == 3 and t.properties() == {"stream_batch": "0"}
    q = streams.windowed_counts(streams.read_stream(spark, src, schema), "ts", ["k"]).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]


@dataclasses.dataclass
class Note:
    key: str
    tag: str | None
    body: str
    when: datetime.date | None
    embedding: list[float]


def definition(**kw):
    return Definition.of(Note, "key", "embedding", 2, full_text=("body",), **kw)


def test_collection(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/cs/notes", definition())
    with pytest.raises(SheafError, match="5201"):
        c.get(["a"])
    c.create()
    c.create()
    assert list_collections(spark, f"file://{tmp_path}/cs") == ["notes"]
    rows = lambda *r: spark.createDataFrame(list(r), "key string, tag string, body string, when date, embedding array<float>, n int")
    c.upsert(rows(("a", "x", "roof tiles", None, [1.0, 0.0], 1), ("a", "y", "roof slates", None, [1.0, 0.1], 2), ("b", None, "gutter", None, [0.0, 1.0], 1)), ["n"])
    c.upsert(rows(("b", "z", "gutter roof", None, [0.1, 1.0], 1)), ["n"])
    assert sorted((r["key"], r["tag"]) for r in c.get(["a", "b"]).collect()) == [("a", "y"), ("b", "z")]
    assert "embedding" not in c.get(["a"]).columns and "embedding" in c.get(["a"], True).columns
    assert [r["key"] for r in c.search([1, 0], 1).collect()] == ["a"]
    assert [r["key"] for r in c.search([1, 0], 1, predicate=Field("tag") == "z").collect()] == ["b"]
    assert [r["key"] for r in c.hybrid([1, 0], ["roof"], 2).collect()] == ["a", "b"]
    assert [r["key"] for r in c.scan(None, 1, 1, [("tag", False)]).collect()] == ["a"]
    with pytest.raises(Exception, match="5212"):
        c.upsert(rows(("c", None, "", None, [1.0], 1)), ["n"])
    c.delete(spark.createDataFrame([("a",)], "key string"))
    assert [r["key"] for r in c.scan(None, 9).collect()] == ["b"]
    c.drop()
    assert not c.exists()
    assert query(spark, "SELECT :x + 1 AS y", x=1).first()["y"] == 2


@pytest.mark.parametrize(("fields", "code"), [("k string", 5202), ("key double, embedding array<float>", 5203), ("key string, embedding array<float>, d decimal(5,2)", 5204), ("key string, _rowid int, embedding array<float>", 5205), ("key string", 5206), ("key string, embedding array<float>, e array<float>", 5207)])
def test_invalid_definitions(spark, fields, code):
    with pytest.raises(SheafError, match=str(code)):
        Definition("key", "embedding", 2, T.StructType.fromDDL(fields))


def test_invalid_metric_and_dimensions(spark):
    s = T.StructType.fromDDL("key string, embedding array<float>")
    with pytest.raises(SheafError, match="5208"):
        Definition("key", "embedding", 0, s)
    with pytest.raises(SheafError, match="5209"):
        Definition("key", "embedding", 2, s, metric="dot")


def test_generated_keys(spark):
    stored = spark.createDataFrame([(7, "x")], "id long, n string")
    rows = spark.createDataFrame([(None, "b"), (None, "a"), (9, "c")], "id long, n string")
    got = {r["n"]: r["id"] for r in state.next_keys(stored, rows, "id", ["n"]).collect()}
    assert got == {"c": 9, "a": 10, "b": 11}
    assert state.next_keys(stored.limit(0), rows.limit(0), "id", ["n"]).count() == 0


def test_upsert_and_delete_with_nulls(spark, rows):
    s = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    n = spark.createDataFrame([("a", 5, 1), ("a", 6, 2), (None, 7, 1)], "k string, v int, o int")
    assert sorted(state.upsert(s, n, ["k"], ["o"]).collect(), key=str) == sorted([("c", 3), ("a", 6), (None, 7)], key=str)
    assert rows(state.delete(s, spark.createDataFrame([(None,)], "k string"), ["k"])) == [("a", 1), ("c", 3)]


def test_diff_kinds(spark, rows):
    f = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, o int")
    s = spark.createDataFrame([("b", 2), ("c", 9), ("d", 4)], "k string, o int")
    assert rows(state.diff(f, s, ["k"], ["o"])) == [("a", "added"), ("b", "unchanged"), ("c", "repaired"), ("d", "removed")]


def test_donors(spark):
    doc = [("kb", "s", f"d{i}", b"A", b"R", "Indexed") for i in range(8)] + [("kb", "s", "other", b"B", b"R", "Indexed"), ("kb", "s", "zero", b"\0", b"R", "Indexed"), ("kb", "s", "zero2", b"\0", b"R", "Indexed")]
    got = state.donors(spark.createDataFrame(doc, "collection string, source_id string, document_id string, content_hash binary, recipe_hash binary, status string"))
    per = {r["d"]: r["count"] for r in got.groupBy(F.col("document.document_id").alias("d")).count().collect()}
    assert per == {f"d{i}": 4 for i in range(8)}


def test_prune_only_after_completion(spark):
    s = spark.createDataFrame([("kb", "s", "x/a"), ("kb", "s", "b"), ("kb", "s", "c")], "collection string, source_id string, document_id string")
    live = s.where("document_id = 'c'")
    assert state.prune_missing(s, live, False).count() == 0
    assert [r["document_id"] for r in state.prune_missing(s, live, True, ["x/"]).collect()] == ["b"]


def test_keywords(spark):
    df = spark.createDataFrame([("How does the Roof roof leak? ROOF-tiles été a b",), (None,), ("one two three four five six seven eight nine ten",)], "t string")
    got = [list(r[0]) for r in df.select(rag.keywords(F.col("t"))).collect()]
    assert got[0] == ["Roof", "leak", "tiles", "été"] and got[1] == [] and len(got[2]) == 8


def sources(spark, *rows):
    return spark.createDataFrame([("q", i, s, k, t, ti, u) for i, (s, k, t, ti, u) in enumerate(rows)], "q string, position int, score double, score_kind string, text string, title string, uri string")


def test_context(spark):
    s = rag.ranked(sources(spark, (0.2, "Distance", "second\nline", "T\n2", None), (0.1, "Distance", "first", None, "u")), "q")
    r = rag.context_blocks(s, "q").first()
    assert r["included"] == 2 and r["context"] == (
        f"{rag.HEADING}\n{rag.CONTEXT_PROMPT}\n\n[1]\n    Source: u\n    ---\n    first\n\n[2] Title: T 2\n    ---\n    second\n    line\n\n{rag.CITATION_PROMPT}"
    )
    assert rag.context_blocks(s, "q", 75).first()["included"] == 1
    none = rag.context_blocks(s, "q", 5)
    assert none.first()["context"] is None
    with pytest.raises(Exception, match="7204"):
        rag.require_context(none).collect()


def test_rank_and_clamp(spark):
    s = rag.ranked(sources(spark, (0.5, "Relevance", "a" * 20, None, None), (0.9, "Relevance", "b", None, None), (0.5, "Relevance", "c", None, None)), "q", 10)
    assert [(r["ordinal"], r["text"]) for r in s.orderBy("ordinal").collect()] == [(1, "b"), (2, "a" * 10 + rag.SUFFIX), (3, "c")]
    again = spark.createDataFrame([("a" * 10 + rag.SUFFIX,), ("x" * 50 + rag.SUFFIX,)], "t string").select(rag.clamp(F.col("t"), 10)).collect()
    assert [r[0] for r in again] == ["a" * 10 + rag.SUFFIX, "x" * 10 + rag.SUFFIX]


def test_citations(spark):
    a = spark.createDataFrame([("q", "é [2] and [1], [2]. [9] [x] [99999999999]"), ("r", "none")], "q string, answer string")
    s = spark.createDataFrame([("q", 1), ("q", 2)], "q string, ordinal int")
    cited, lost = rag.citations(a, s, "q")
    assert sorted((r["ordinal"], r["place"], list(r["starts"])) for r in cited.collect()) == [(1, 2, [10]), (2, 1, [2, 15])]
    assert [(r["q"], r["unresolved"]) for r in lost.collect()] == [("q", 2)]


def test_answers(spark):
    s = rag.ranked(sources(spark, (0.1, "Distance", "first", None, None), (0.2, "Distance", "second", None, None)), "q")
    a = rag.extractive_answer(s, "q")
    assert a.first()["answer"] == "first [1]\n\nsecond [2]"
    got = {r["q"]: (r["answer"], r["grounded"]) for r in rag.answered(spark.createDataFrame([("q",), ("z",)], "q string"), a, "q").collect()}
    assert got == {"q": ("first [1]\n\nsecond [2]", True), "z": (rag.NO_RESULTS, False)}


def reference_history(msgs, turns, tokens, protected):
    keep = [True] * len(msgs)
    tok = [(len(t) + 3) // 4 for _, t in msgs]
    groups, now = [], None
    for i, (r, _) in enumerate(msgs):
        if r == "system":
            continue
        if r == "user" or now is None:
            now = []
            groups.append(now)
        now.append(i)
    left, total = list(groups), sum(tok)
    while left and (len(left) > turns or total > tokens):
        if any(i >= len(msgs) - protected for i in left[0]):
            break
        for i in left.pop(0):
            keep[i] = False
            total -= tok[i]
    return keep


def test_history_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for conv in range(150):
        msgs = [(str(rng.choice(["user", "user", "assistant", "system"])), "x" * int(rng.integers(0, 60))) for _ in range(int(rng.integers(1, 20)))]
        rows += [(conv, i, r, t) for i, (r, t) in enumerate(msgs)]
        want |= {(conv, i): k for i, k in enumerate(reference_history(msgs, 3, 60, 2))}
    df = spark.createDataFrame(rows, "c int, n int, role string, text string")
    got = {(r["c"], r["n"]): r["kept"] for r in chat.reduce_history(df, "c", "n", 3, 60, 2).collect()}
    assert got == want


def test_prompt_and_stops(spark):
    m = spark.createDataFrame([(1, 1, "system", "S"), (1, 2, "user", "U"), (1, 3, "system", "late")], "c int, n int, role string, text string")
    assert chat.prompt(m, "c", "n", "cfg").first()["prompt"] == "system: S\nsystem: cfg\nuser: U\nsystem: late\nassistant: "
    t = spark.createDataFrame([("abc STOP def",), ("none",)], "t string")
    assert [r[0] for r in t.select(chat.stopped(F.col("t"), ["def", " STOP"])).collect()] == ["abc", "none"]


def test_memory(spark):
    s = spark.createDataFrame([("a", 100, 1, 1, 1, 1, 5000), ("b", 100, 1, 1, 1, 1, 50)], "name string, weights long, layers int, heads int, head_size int, element_bytes int, available long")
    got = {r["name"]: (r["context"], r["required"]) for r in chat.memory_ladder(s, [512, 1024, 2048], 10, 20, 1.0).collect()}
    assert got == {"a": (2048, 100 + 2 * 2048 + 30), "b": (0, 100 + 2 * 512 + 30)}


def test_wordpiece():
    wp = embedding.WordPiece(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "roof", "##s", "leak", "##ing", "!", "中"])
    ids = lambda t: [list(wp.ids)[i] for i in wp.encode(t)[0]]
    assert ids("Roofs leaking!") == ["[CLS]", "roof", "##s", "leak", "##ing", "!", "[SEP]"] and ids("xyz 中") == ["[CLS]", "[UNK]", "中", "[SEP]"] and ids("") == ["[CLS]", "[SEP]"]
    assert embedding.words("Ünïcode, 中文 a\u200bb\x01c") == ["unicode", ",", "中", "文", "abc"] and len(embedding.words("한국")) == 1
    assert wp.encode("roof roof roof", 4) == ([2, 4, 4, 3], True) and wp.count("roofs") == 2
    batch, mask, cut = wp.batch(["roof", "roof " * 70], 80)
    assert batch.shape == (2, 128) and mask.sum() == 3 + 72 and cut == [False, False]


def test_pooling():
    s = np.array([[[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]]])
    m = np.array([[1, 1, 0]])
    assert embedding.pool(s, m).tolist() == [[2.0, 4.0]] and embedding.pool(s, m, "cls").tolist() == [[1.0, 3.0]]
    assert np.allclose(embedding.l2(np.array([[3.0, 4.0], [0.0, 0.0]])), [[0.6, 0.8], [0, 0]])
    assert np.allclose(embedding.layer_norm(np.array([[1.0, 3.0]])), [[-1, 1]], atol=1e-4)


def test_failing_windows_are_halved(spark):
    def bad(texts):
        if "x" in texts:
            raise RuntimeError("no")
        return embedding.hashing_embedder(4)(texts)

    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    got = embedding.embed(df, "t", bad, 4).collect()
    assert [r["embedding"] is None for r in got] == [False, False, True]
    with pytest.raises(Exception, match="6206"):
        embedding.embed(spark.createDataFrame([("a",), ("x",)], "t string"), "t", bad, 4).collect()

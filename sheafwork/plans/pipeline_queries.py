"""Queries that run whole pipelines: collections, ingestion and streams, in the shared work folder."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError
from sheafwork.functions.filters import Field
from sheafwork.functions.text import media_type
from sheafwork.operators import chunking, embedding, incremental, state
from sheafwork.operators.collection import Collection, Definition
from sheafwork.operators.ingest import Budget, Pipeline
from sheafwork.plans.search_queries import _COS, _L2, _Q
from sheafwork.plans.tables import table
from sheafwork.runtime import place
from sheafwork.sources import adapters, files
from sheafwork.sources.extract import Registry
from sheafwork.sources.versioned import VersionedTable
from sheafwork.streaming import ingest as streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_place = place


def _vectors(spark: SparkSession, d: str) -> Collection:
    schema = T.StructType([T.StructField("vec_id", T.LongType(), False), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    c = Collection(spark, _place(spark, "vectors"), Definition("vec_id", "embedding", 64, schema, metric="l2"))
    c.create()
    e = table(spark, d, "embeddings").withColumn("label", F.col("label").cast("int"))
    c.upsert(e.withColumn("o", F.lit(1)).unionByName(e.where("vec_id % 5 = 0").withColumn("label", F.lit(99)).withColumn("o", F.lit(2))), ["o"])
    c.delete(e.where("vec_id % 7 = 3").select("vec_id"))
    return c


@query(f"WITH {_Q}, e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS INT) AS label, embedding FROM embeddings WHERE vec_id % 7 <> 3) SELECT vec_id, label, {_L2} AS distance FROM e, q WHERE label >= 5 ORDER BY distance, vec_id LIMIT 20")
def collection_search(spark, d):
    """A collection made by an upsert and a delete, searched with a filter."""
    q = table(spark, d, "embeddings").where("vec_id = 7").select("embedding")
    return _vectors(spark, d).search(q, 20, predicate=Field("label") >= 5, digits=6)


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS INT) AS label FROM embeddings WHERE vec_id % 7 <> 3 ORDER BY label DESC, vec_id LIMIT 40 OFFSET 10")
def collection_scan(spark, d):
    return _vectors(spark, d).scan(None, 40, 10, [("label", False)])


@query("SELECT 'table' AS by, vec_id, CAST(CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS INT) AS label FROM embeddings WHERE vec_id % 7 <> 3 AND vec_id IN (SELECT 3 * vec_id FROM embeddings) UNION ALL SELECT 'list', vec_id, CAST(CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS INT) FROM embeddings WHERE vec_id % 7 <> 3 AND vec_id IN (1, 2, 3, 5, 10)")
def collection_get(spark, d):
    """Records by key, asked for by a table of keys and by a list that names one deleted and one unknown key, too."""
    c = _vectors(spark, d)
    keys = table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("k"))
    return c.get(keys).withColumn("by", F.lit("table")).unionByName(c.get([1, 2, 3, 5, 10, -1]).withColumn("by", F.lit("list")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text", "media_type")


@query("SELECT run, CAST(seen AS BIGINT) AS seen, CAST(CASE run WHEN 1 THEN seen WHEN 2 THEN 0 ELSE changed END AS BIGINT) AS indexed FROM (SELECT count(*) AS seen, count(*) FILTER (WHERE doc_id % 10 = 0) AS changed FROM documents), (SELECT unnest([1, 2, 3]) AS run)")
def ingest_runs(spark, d):
    """The pipeline run three times: all documents, nothing changed, a tenth of the texts changed."""
    p = Pipeline(spark, _place(spark, "ingest"), "kb", chunking.resolve(256), embedding.hashing_embedder(16), 16)
    items = _items(spark, d)
    changed = items.withColumn("text", F.when(F.col("document_id").cast("long") % 10 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nA new end."))).otherwise(F.col("text")))
    results = [p.run(x, "docs") for x in (items, items, changed)]
    return spark.createDataFrame([(i + 1, r.counts["seen"], r.counts["indexed"]) for i, r in enumerate(results)], "run int, seen long, indexed long")


#: One chunk a text that isn't blank: whole texts fit.
_WHOLE = chunking.resolve(1 << 30, overlap_tokens=0, min_tokens=16)
_BLANK = "trim(coalesce(text, ''), chr(10) || chr(13) || chr(9) || ' ') = ''"


class _Negated:
    """Another model: the opposite of the first one's vectors."""

    def __call__(self, texts):
        return -embedding.hashing_embedder(8)(texts)


def _unreadable(data: bytes):
    raise ValueError("6104: document is malformed")


def _registry() -> Registry:
    r = Registry()
    r.add("unreadable", {"application/x-unreadable"}, set(), _unreadable)
    return r


@query(
    f"WITH d AS (SELECT count(*) AS docs, count(*) FILTER (WHERE NOT {_BLANK}) AS chunks FROM documents) SELECT run, docs AS indexed, chunks AS added, CASE run WHEN 2 THEN chunks ELSE 0 END AS reembedded,"
    " CASE run WHEN 2 THEN 0 ELSE chunks END AS first_model, CASE run WHEN 2 THEN chunks ELSE 0 END AS second_model, CAST(1 AS BIGINT) AS recipes FROM d, (SELECT unnest([1, 2]) AS run)"
)
def recipe_drift(spark, d):
    """Two runs, the second with another model: every chunk is embedded again, and no vector of the first model is left under the second's recipe."""
    root, items, out = _place(spark, "drift"), _items(spark, d).withColumn("media_type", F.lit("text/plain")), []
    for run, (model, embedder) in enumerate((("first", embedding.hashing_embedder(8)), ("second", _Negated())), 1):
        p = Pipeline(spark, root, "kb", _WHOLE, embedder, 8, model=model, chunker="plain")
        r = p.run(items, "docs")
        c = p.chunks.read().select("embed_text" if "embed_text" in p.chunks.schema().names else "text", "embedding", "recipe_hash")
        again = embedding.embed(c.withColumnRenamed("embedding", "stored"), c.columns[0], embedding.hashing_embedder(8), 8)
        sign = F.when(F.get("stored", F.lit(0)) == F.get("embedding", F.lit(0)), 1).when(F.get("stored", F.lit(0)) == -F.get("embedding", F.lit(0)), 2)
        x = again.select(sign.alias("m"), "recipe_hash").agg(F.count_if(F.col("m") == 1), F.count_if(F.col("m") == 2), F.count_distinct("recipe_hash")).first()
        out.append((run, r.counts["indexed"], r.counts["added"], r.counts["reembedded"], x[0], x[1], x[2]))
    return spark.createDataFrame(out, "run int, indexed long, added long, reembedded long, first_model long, second_model long, recipes long")


@query(
    f"SELECT CASE WHEN doc_id % 10 = 3 THEN 'Failed 6104' WHEN doc_id % 10 = 4 THEN 'Unsupported 6101' WHEN {_BLANK} THEN 'NoTextLayer' ELSE 'Indexed' END AS outcome, count(*) AS n FROM documents GROUP BY 1"
    " UNION ALL SELECT 'Failed 6054', count(*) FILTER (WHERE doc_id % 10 = 5) FROM documents"
)
def ingest_outcomes(spark, d):
    """A run over documents some of which cannot be read, have no extractor, or come twice: each has its outcome, and the run completes."""
    i = _items(spark, d).withColumn("no", F.lit(0))
    n = F.col("document_id").cast("long") % 10
    i = i.withColumn("media_type", F.when(n == 3, "application/x-unreadable").when(n == 4, "application/x-none").otherwise("text/plain"))
    i = i.unionByName(i.where(n == 5).withColumn("no", F.lit(1)).withColumn("text", F.concat(F.lit("later "), F.coalesce("text", F.lit("")))))
    p = Pipeline(spark, _place(spark, "outcomes"), "kb", _WHOLE, embedding.hashing_embedder(8), 8, chunker="plain", registry=_registry())
    p.run(i, "docs", order=["no"])
    code = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit(" "), F.substring(c, 1, 4)))
    st = p.state.read().select(F.concat("status", code("error")).alias("outcome"))
    twice = p.failures.read().where("error LIKE '6054%'").select(F.lit("Failed 6054").alias("outcome"))
    return st.unionByName(twice).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    f"WITH d AS (SELECT doc_id, NOT {_BLANK} AS one, row_number() OVER (ORDER BY doc_id) AS n FROM documents), c AS (SELECT *, coalesce(sum(one::INT) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)"
    " SELECT 'budget:documents' AS reason, least(count(*), 15) AS indexed FROM d UNION ALL SELECT 'budget:chunks', count(*) FILTER (WHERE n > 15 AND before - (SELECT count(*) FROM d WHERE one AND n <= 15) < 20) FROM c"
    f" UNION ALL SELECT 'budget:none', count(*) - 15 - (SELECT count(*) FILTER (WHERE n > 15 AND before - (SELECT count(*) FROM d WHERE one AND n <= 15) < 20) FROM c) FROM d"
)
def ingest_budgets(spark, d):
    """Three runs, suspended by a budget of documents and one of chunks, and then free: each goes on where the last one stopped."""
    p = Pipeline(spark, _place(spark, "budgets"), "kb", _WHOLE, embedding.hashing_embedder(8), 8, chunker="plain")
    i = _items(spark, d).withColumn("media_type", F.lit("text/plain")).withColumn("no", F.col("document_id").cast("long"))
    out = [p.run(i, "docs", order=["no"], budget=b) for b in (Budget(documents=15), Budget(chunks=20), None)]
    return spark.createDataFrame([(r.suspend_reason or "budget:none", r.counts["indexed"]) for r in out], "reason string, indexed long")


@query(
    "WITH d AS (SELECT doc_id, doc_id % 50 >= 25 AS bad, row_number() OVER (ORDER BY doc_id) AS n FROM documents), g AS (SELECT *, n - row_number() OVER (PARTITION BY bad ORDER BY n) AS grp FROM d),"
    " k AS (SELECT *, row_number() OVER (PARTITION BY bad, grp ORDER BY n) AS k FROM g), stop AS (SELECT min(n) AS n FROM k WHERE bad AND k = 20)"
    " SELECT CASE WHEN bad THEN 'Failed' ELSE 'read' END AS status, count(*) AS n FROM d WHERE n <= (SELECT n FROM stop) GROUP BY 1 UNION ALL SELECT 'run Failed', 1"
)
def ingest_abort(spark, d):
    """Twenty failures in a row end a run; what came before them is written."""
    p = Pipeline(spark, _place(spark, "abort"), "kb", _WHOLE, embedding.hashing_embedder(8), 8, chunker="plain", registry=_registry())
    i = _items(spark, d).withColumn("no", F.col("document_id").cast("long"))
    i = i.withColumn("media_type", F.when(F.col("no") % 50 >= 25, "application/x-unreadable").otherwise("text/plain"))
    try:
        p.run(i, "docs", order=["no"])
    except SheafError as e:
        if e.code != 6010:
            raise
    st = p.state.read().select(F.when(F.col("status") == "Failed", "Failed").otherwise("read").alias("status"))
    runs = p.runs.read().select(F.concat(F.lit("run "), "outcome").alias("status"))
    return st.unionByName(runs).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT run, outcome, CAST(n AS INT) AS indexed, CAST(1 AS BIGINT) AS later FROM (SELECT 1 AS run, 'Completed' AS outcome, count(*) AS n FROM nation UNION ALL SELECT 2, 'Completed', 0 FROM region GROUP BY 1)")
def run_history(spark, d):
    """Runs at one instant of the clock are recorded each strictly later than the one before."""
    at = datetime(2025, 1, 1, tzinfo=UTC)
    p = Pipeline(spark, _place(spark, "history"), "kb", _WHOLE, embedding.hashing_embedder(8), 8, chunker="plain", clock=lambda: at)
    i = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("document_id"), F.col("n_name").alias("text"), F.lit("text/plain").alias("media_type"))
    for _ in range(2):
        p.run(i, "nations")
    w = Window.partitionBy("collection", "source_id").orderBy("started_utc")
    r = p.runs.read().withColumn("run", F.row_number().over(w)).withColumn("before", F.lag("started_utc").over(w))
    return r.select("run", "outcome", F.col("documents_indexed").alias("indexed"), F.coalesce(F.col("started_utc") > F.col("before"), F.lit(True)).cast("long").alias("later"))


@query("SELECT lower(trim(split_part(coalesce(media_type, 'text/plain'), ';', 1))) AS kind, CASE WHEN trim(coalesce(text, ''), chr(10) || chr(13) || chr(9) || ' ') = '' THEN 'NoTextLayer' ELSE 'Indexed' END AS status, count(*) AS n FROM documents GROUP BY 1, 2")
def extract_all_documents(spark, d):
    """Every text of a table through the extractors, by media type without parameters."""
    docs = files.items(table(spark, d, "documents"), "doc_id", "text", "media_type")
    got = files.extract(docs).select("document_id", "status")
    return got.join(docs.select("document_id", media_type(F.col("media_type")).alias("kind")), "document_id").groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """Daily counts by a stream with a watermark, appended to a folder as windows close; one late event beyond all closes the last ones."""
    events = table(spark, d, "events").select("ts", "event_type")
    src, out = _place(spark, "events"), _place(spark, "windows")
    events.coalesce(1).write.parquet(src)
    run = lambda: streams.windowed_counts(streams.read_stream(spark, src, events.schema), "ts", ["event_type"], "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    end = events.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    for k in (1, 2):  # the second one's batch sees the watermark that the first has moved
        end.select(F.col("ts") + F.expr(f"INTERVAL {10 * k} DAYS"), F.lit("end").alias("event_type")).toDF("ts", "event_type").coalesce(1).write.mode("append").parquet(src)
        run()
    return spark.read.parquet(out).where("event_type <> 'end' OR event_type IS NULL").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_append(spark, d):
    """Events through a stream into a versioned table, twice from one checkpoint."""
    events = table(spark, d, "events").select("event_id", "event_type")
    src, check, t = _place(spark, "events"), _place(spark, "check"), VersionedTable(spark, _place(spark, "table"))
    events.write.parquet(src)
    for _ in range(2):
        streams.append_stream(streams.read_stream(spark, src, events.schema), t, check).awaitTermination()
    return t.read().groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, true AS same FROM documents")
def element_roundtrip(spark, d):
    """Extracted documents taken apart into elements and put together again are the same."""
    got = files.extract(files.items(table(spark, d, "documents"), "doc_id", "text", "media_type")).select("document_id", "text", "blocks")
    back = adapters.from_elements(adapters.elements(got.withColumnsRenamed({"text": "t", "blocks": "b"}).withColumns({"text": F.col("t"), "blocks": F.col("b")})))
    return back.select("document_id", (F.col("text").eqNullSafe(F.col("t")) & F.col("blocks").eqNullSafe(F.col("b"))).alias("same"))


@query("SELECT 1 AS since, o_orderstatus AS status, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS inserted, count(*) FILTER (WHERE o_orderkey % 4 = 0 AND o_custkey % 2 = 0) AS deleted FROM orders GROUP BY 2")
def table_changes(spark, d):
    """Record deltas between versions of a table, which together hold every order: an append and a delete by keys."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    t = VersionedTable(spark, _place(spark, "orders"))
    t.commit(add=o.where("coalesce(o_orderkey % 4 <> 1, true)"))
    t.commit(add=o.where("o_orderkey % 4 = 1"))
    t.commit(delete_keys=o.where("o_orderkey % 4 = 0 AND o_custkey % 2 = 0").select("o_orderkey"))
    c = t.changes(1).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(F.col("_change") == "insert").alias("inserted"), F.count_if(F.col("_change") == "delete").alias("deleted"))
    return c.select(F.lit(1).alias("since"), "status", "inserted", "deleted")


@query("SELECT run, CASE run WHEN 1 THEN n ELSE 0 END AS processed FROM (SELECT count(DISTINCT (collection, source_id, document_id)) AS n FROM source_item), (SELECT unnest([1, 2]) AS run)")
def p1_runs(spark, d):
    """Runs from an empty state: the first processes every document with a recipe once, later ones none of them again.

    Beside the table's documents there are others that are left unfinished and then withdrawn, once by a
    deletion vector and once by removing files. The second row counts what all runs after the first process.
    """
    items = table(spark, d, "source_item")
    src, st = VersionedTable(spark, _place(spark, "source")), VersionedTable(spark, _place(spark, "state"))
    # every delivery has a digest here; media types without a recipe would always be pending
    src.commit(add=items)
    others = items.withColumn("document_id", F.concat(F.lit("withdrawn/"), "document_id"))
    src.commit(add=others)
    schema = table(spark, d, "ingest_document").schema
    st.commit(add=spark.createDataFrame([], schema))
    recipe = table(spark, d, "recipe")

    def work(todo: DataFrame) -> DataFrame:
        return incremental.state_rows(todo, schema, "run", "2026-02-01T00:00:00Z")

    def some(todo: DataFrame) -> DataFrame:
        return work(todo.where("NOT coalesce(startswith(document_id, 'withdrawn/'), false)"))

    first = incremental.run(spark, src, st, recipe, some)
    src.commit(delete_keys=others.select("document_id").where("document_id IS NOT NULL"))
    again = incremental.run(spark, src, st, recipe, work)
    src.commit(add=others)
    again += incremental.run(spark, src, st, recipe, some)
    src.commit(add=items, overwrite=True)
    again += incremental.run(spark, src, st, recipe, work)
    return spark.createDataFrame([(1, first), (2, again)], "run int, processed long")


@query(
    "WITH t AS (SELECT md5(text) AS h, count(DISTINCT key) AS n FROM ingested_chunk WHERE text IS NOT NULL AND embedding IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS texts, CAST(sum(n) - count(*) AS BIGINT) AS reused FROM t"
)
def embeddings_saved(spark, d):
    """How many vectors embedding each text once saves over the stored chunks."""
    c = table(spark, d, "ingested_chunk").where("text IS NOT NULL AND embedding IS NOT NULL").select("key", F.md5("text").alias("h")).distinct()
    t = c.groupBy("h").agg(F.count("*").alias("n"))
    return t.agg(F.sum("n").alias("chunks"), F.count("*").alias("texts"), (F.sum("n") - F.count("*")).alias("reused"))


@query("SELECT collection, source_id, count(*) FILTER (WHERE keep) AS taken, count(*) AS seen FROM (SELECT *, size_bytes < 5000 AND NOT starts_with(document_id, 'scans/') AS keep FROM source_item QUALIFY row_number() OVER (PARTITION BY collection, source_id, document_id ORDER BY item_seq) = 1) GROUP BY 1, 2")
def source_filter(spark, d):
    """A filter on source items leaves liveness alone: what it leaves out is still seen."""
    i = state.first_delivery(table(spark, d, "source_item"), ["item_seq"]).where("NOT duplicate")
    keep = (F.col("size_bytes") < 5000) & ~F.col("document_id").startswith("scans/")
    return i.groupBy("collection", "source_id").agg(F.count_if(keep).alias("taken"), F.count("*").alias("seen"))


@query(f"WITH {_Q} SELECT label, count(*) AS n, min({_COS}) AS nearest, max({_COS}) AS farthest FROM embeddings, q GROUP BY label")
def distance_range(spark, d):
    from sheafwork.functions import vectors
    from sheafwork.operators.search import with_query

    e = table(spark, d, "embeddings")
    rows, q = with_query(e, e.where("vec_id = 7").select("embedding"))
    x = rows.withColumn("x", F.round(vectors.cosine_distance(F.col("embedding"), q), 6) + F.lit(0.0))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("nearest"), F.max("x").alias("farthest"))


@query("SELECT doc_id, version FROM (SELECT record_id AS doc_id, extractor_version AS version, row_number() OVER (PARTITION BY collection, source_id, document_id ORDER BY extractor_version DESC NULLS LAST, record_id DESC) AS n FROM extracted_document) WHERE n = 1")
def latest_extraction(spark, d):
    """Of several extractions of a document the one by the newest extractor."""
    w = Window.partitionBy("collection", "source_id", "document_id").orderBy(F.desc_nulls_last("extractor_version"), F.desc("record_id"))
    e = table(spark, d, "extracted_document").withColumn("n", F.row_number().over(w)).where("n = 1")
    return e.select(F.col("record_id").alias("doc_id"), F.col("extractor_version").alias("version"))

"""Queries on ingestion state, upserts, diffs and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions.text import instant, strip
from sheafwork.operators import incremental, state
from sheafwork.plans.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DOC = "collection, source_id, document_id"
_AT = "CAST(regexp_replace({0}, '[.,][0-9]+', '') AS TIMESTAMPTZ)"
_NS = "CAST(rpad(left(regexp_extract({0}, '[.,]([0-9]+)', 1), 9), 9, '0') AS INT)"
_FORCE = (
    "st AS (SELECT * FROM ingest_document QUALIFY row_number() OVER (PARTITION BY collection, source_id, document_id ORDER BY " + _AT.format("updated_utc") + " DESC NULLS LAST, " + _NS.format("updated_utc")
    + " DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST, hex(content_hash) DESC NULLS LAST, hex(recipe_hash) DESC NULLS LAST) = 1)"
)
_CUR = "cur AS (SELECT * FROM source_item QUALIFY row_number() OVER (PARTITION BY collection, source_id, document_id ORDER BY seen_utc DESC NULLS LAST, item_seq DESC NULLS LAST) = 1)"
_SAME = "s.collection IS NOT DISTINCT FROM c.collection AND s.source_id IS NOT DISTINCT FROM c.source_id AND s.document_id IS NOT DISTINCT FROM c.document_id"


@query(f"WITH {_CUR} SELECT {_DOC}, item_seq, size_bytes FROM cur")
def upsert_last_wins(spark, d):
    """The current delivery of every document: all deliveries, in their order, put in over what the first half has left."""
    i = table(spark, d, "source_item").select(*state.DOC, "item_seq", "size_bytes", "seen_utc")
    order = ["seen_utc", "item_seq"]
    stored = state.last_wins(i.where("item_seq % 2 = 0"), state.DOC, order)
    return state.upsert(stored, i, state.DOC, order).drop("seen_utc")


@query("SELECT collection, count(*) AS n FROM ingested_chunk WHERE source_id NOT IN ('garden-desk', 'hop-loft') AND NOT (collection = 'kb' AND source_id = 'store-faq') GROUP BY collection")
def delete_by_source(spark, d):
    c = table(spark, d, "ingested_chunk").select("collection", "source_id")
    gone = spark.createDataFrame([("garden-desk",), ("hop-loft",)], "source_id string")
    c = state.delete(state.delete(c, gone, ["source_id"]), spark.createDataFrame([("kb", "store-faq")], "collection string, source_id string"), ["collection", "source_id"])
    return c.groupBy("collection").agg(F.count("*").alias("n"))


@query(f"WITH {_CUR}, {_FORCE} SELECT {', '.join(f'coalesce(c.{k}, s.{k}) AS {k}' for k in ('collection', 'source_id', 'document_id'))}, CASE WHEN s.document_id IS NULL THEN 'added' WHEN c.document_id IS NULL THEN 'removed' WHEN c.content_hash IS NOT DISTINCT FROM s.content_hash THEN 'unchanged' ELSE 'repaired' END AS change FROM cur c FULL JOIN st s ON {_SAME}")
def document_diff(spark, d):
    """Documents delivered against those known, by content."""
    cur = incremental.current_delivery(table(spark, d, "source_item")).select(*state.DOC, "content_hash")
    st = incremental.state_in_force(table(spark, d, "ingest_document")).select(*state.DOC, "content_hash")
    return state.diff(cur, st, state.DOC, ["content_hash"])


@query(
    "WITH f AS (SELECT collection, source_id, document_id, ordinal, md5(text) AS h, row_number() OVER (PARTITION BY collection, source_id, document_id, md5(text) ORDER BY ordinal, draft_id) AS dup FROM chunk_draft),"
    " s AS (SELECT DISTINCT collection, source_id, document_id, ordinal, md5(text) AS h FROM ingested_chunk), s2 AS (SELECT *, row_number() OVER (PARTITION BY collection, source_id, document_id, h ORDER BY ordinal) AS dup FROM s)"
    " SELECT CASE WHEN s.document_id IS NULL THEN 'added' WHEN f.document_id IS NULL THEN 'removed' WHEN f.ordinal IS NOT DISTINCT FROM s.ordinal THEN 'unchanged' ELSE 'repaired' END AS change, count(*) AS n"
    " FROM f FULL JOIN s2 s ON s.collection IS NOT DISTINCT FROM f.collection AND s.source_id IS NOT DISTINCT FROM f.source_id AND s.document_id IS NOT DISTINCT FROM f.document_id AND s.h IS NOT DISTINCT FROM f.h AND s.dup = f.dup GROUP BY 1"
)
def chunk_diff(spark, d):
    """Drafted chunks against stored ones by text, as counts of the kinds of change."""
    from pyspark.sql import Window

    f = table(spark, d, "chunk_draft").select(*state.DOC, "ordinal", F.md5("text").alias("h"), F.row_number().over(Window.partitionBy(*state.DOC, F.md5("text")).orderBy("ordinal", "draft_id")).alias("dup"))
    s = table(spark, d, "ingested_chunk").select(*state.DOC, "ordinal", F.md5("text").alias("h")).distinct()
    s = s.withColumn("dup", F.row_number().over(Window.partitionBy(*state.DOC, "h").orderBy("ordinal")))
    return state.diff(f, s, ["document_id", "collection", "source_id", "h", "dup"], ["ordinal"]).groupBy("change").agg(F.count("*").alias("n"))


@query(f"WITH {_FORCE} SELECT collection, lower(trim(status)) AS status, count(*) AS n, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM st GROUP BY 1, 2")
def status_counts(spark, d):
    s = incremental.state_in_force(table(spark, d, "ingest_document"))
    return s.groupBy("collection", F.lower(strip(F.col("status"))).alias("status")).agg(F.count("*").alias("n"), F.sum("chunk_count").alias("chunks"))


@query(
    f"WITH {_FORCE}, r AS (SELECT DISTINCT recipe_hash FROM recipe WHERE retired_utc IS NULL) SELECT collection, source_id, count(*) AS documents,"
    + ", ".join(f" count(*) FILTER (WHERE lower(trim(status)) = '{x}') AS {x}" for x in ("indexed", "failed", "unsupported", "notextlayer"))
    + ", CAST(sum(chunk_count) AS BIGINT) AS chunks, count(*) FILTER (WHERE r.recipe_hash IS NULL) AS stale FROM st LEFT JOIN r USING (recipe_hash) GROUP BY 1, 2"
)
def status_report(spark, d):
    s = incremental.state_in_force(table(spark, d, "ingest_document"))
    return state.status_report(s, table(spark, d, "recipe").where("retired_utc IS NULL"))


_RUN = f"{_AT.format('started_utc')} DESC NULLS LAST, {_NS.format('started_utc')} DESC NULLS LAST, run_id DESC"


@query(f"SELECT run_id, collection, source_id FROM ingest_run QUALIFY row_number() OVER (PARTITION BY collection, source_id ORDER BY {_RUN}) <= 3")
def run_history_prune(spark, d):
    return state.newest_runs(table(spark, d, "ingest_run"), 3).select("run_id", "collection", "source_id")


@query(f"SELECT collection, source_id, run_id, outcome FROM ingest_run QUALIFY row_number() OVER (PARTITION BY collection, source_id ORDER BY {_RUN}) = 1")
def latest_run(spark, d):
    return state.latest_runs(table(spark, d, "ingest_run"))


@query(f"WITH {_FORCE} SELECT {_DOC} FROM st s WHERE NOT EXISTS (SELECT 1 FROM source_item c WHERE {_SAME}) AND NOT starts_with(document_id, 'export/')")
def prune_missing(spark, d):
    s = incremental.state_in_force(table(spark, d, "ingest_document"))
    return state.prune_missing(s, table(spark, d, "source_item"), completed=True, unreadable=["export/"]).select(*state.DOC)


@query("SELECT item_seq, row_number() OVER (PARTITION BY collection, source_id, document_id ORDER BY item_seq) > 1 AS duplicate FROM source_item")
def first_delivery(spark, d):
    return state.first_delivery(table(spark, d, "source_item"), ["item_seq"]).select("item_seq", "duplicate")


@query(
    f"WITH {_FORCE}, rc AS (SELECT collection, lower(trim(split_part(media_type, ';', 1))) AS mt, max(recipe_hash) AS rh FROM recipe WHERE retired_utc IS NULL GROUP BY ALL),"
    f" g AS (SELECT c.item_seq, CASE WHEN c.size_bytes > 8000 AND c.size_bytes IS NOT DISTINCT FROM s.size_bytes AND lower(trim(s.status)) = 'failed' THEN 'size'"
    " WHEN lower(trim(s.status)) = 'unsupported' AND c.size_bytes IS NOT DISTINCT FROM s.size_bytes AND c.content_hash = s.content_hash AND replace(hex(c.content_hash), '0', '') <> '' AND s.recipe_hash = rh AND replace(hex(rh), '0', '') <> '' THEN 'unsupported'"
    " WHEN c.content_hash = s.content_hash AND replace(hex(c.content_hash), '0', '') <> '' AND s.recipe_hash = rh AND replace(hex(rh), '0', '') <> '' AND lower(trim(s.status)) IN ('indexed', 'notextlayer', 'unsupported', 'failed') THEN 'content' END AS gate"
    f" FROM source_item c LEFT JOIN rc ON rc.collection = c.collection AND rc.mt = lower(trim(split_part(c.media_type, ';', 1))) LEFT JOIN st s ON {_SAME})"
    " SELECT gate, count(*) AS n FROM g GROUP BY gate"
)
def skip_gates(spark, d):
    from sheafwork.functions.text import media_type

    rc = incremental.current_recipes(table(spark, d, "recipe")).select("collection", "_type", "_recipe")
    i = table(spark, d, "source_item").withColumn("_type", media_type(F.col("media_type"))).join(F.broadcast(rc), ["collection", "_type"], "left")
    g = state.skip_gates(i, incremental.state_in_force(table(spark, d, "ingest_document")), F.col("i._recipe"), 8000)
    return g.groupBy("gate").agg(F.count("*").alias("n"))


@query("SELECT source_id, item_seq FROM (SELECT collection, source_id, item_seq, coalesce(sum(size_bytes) OVER (PARTITION BY collection, source_id ORDER BY item_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM source_item) WHERE before < 20000")
def budget_cutoff(spark, d):
    i = state.within_budget(table(spark, d, "source_item"), ["collection", "source_id"], ["item_seq"], F.col("size_bytes"), 20000)
    return i.where("taken").select("source_id", "item_seq")


@query(
    f"WITH r AS (SELECT collection, source_id, run_id, coalesce(outcome, '') <> 'Completed' AS failed, row_number() OVER (PARTITION BY collection, source_id ORDER BY {_AT.format('started_utc')}, {_NS.format('started_utc')}, run_id) AS n FROM ingest_run),"
    " g AS (SELECT *, n - row_number() OVER (PARTITION BY collection, source_id, failed ORDER BY n) AS grp FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY collection, source_id, failed, grp ORDER BY n) AS k FROM g)"
    " SELECT collection, source_id, min(n) AS n FROM k WHERE failed AND k = 2 GROUP BY 1, 2"
)
def abort_after_failures(spark, d):
    """The run at which a source's second failure in a row comes."""
    from pyspark.sql import Window

    w = Window.partitionBy("collection", "source_id").orderBy(instant(F.col("started_utc")), "run_id")
    r = table(spark, d, "ingest_run").select("collection", "source_id", (F.coalesce("outcome", F.lit("")) != "Completed").alias("failed"), F.row_number().over(w).cast("long").alias("n"))
    return state.abort_point(r, ["collection", "source_id"], ["n"], 2)


@query("SELECT collection, outcome, count(*) AS runs, CAST(sum(documents_indexed) AS BIGINT) AS indexed, CAST(sum(chunks_added) AS BIGINT) AS added, CAST(sum(chunks_removed) AS BIGINT) AS removed, max(chunks_added) AS most FROM ingest_run GROUP BY 1, 2")
def run_counters(spark, d):
    r = table(spark, d, "ingest_run").groupBy("collection", "outcome")
    return r.agg(F.count("*").alias("runs"), F.sum("documents_indexed").alias("indexed"), F.sum("chunks_added").alias("added"), F.sum("chunks_removed").alias("removed"), F.max("chunks_added").alias("most"))


@query("WITH k AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS id, o_orderkey AS seq FROM orders), t AS (SELECT max(id) AS m FROM k) SELECT seq, coalesce(id, m + row_number() OVER (PARTITION BY id IS NULL ORDER BY seq)) AS id FROM k, t")
def next_keys(spark, d):
    k = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("seq"))
    return state.next_keys(k.where("id < 0"), k, "id", ["seq"]).select("seq", "id")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentiles(spark, d):
    return state.nearest_rank(table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95])


@query(
    f"WITH {_FORCE}, i AS (SELECT DISTINCT collection, substr(hex(content_hash), 1, 2) AS content_hash, recipe_hash, source_id || '/' || document_id AS doc FROM st WHERE lower(trim(status)) = 'indexed' AND substr(hex(content_hash), 1, 2) <> '00'),"
    " j AS (SELECT a.collection, a.doc, b.doc AS donor FROM i a JOIN i b ON a.collection = b.collection AND a.content_hash = b.content_hash AND a.recipe_hash = b.recipe_hash AND a.doc <> b.doc)"
    " SELECT collection, doc, least(count(*), 4) AS donors FROM j GROUP BY 1, 2"
)
def vector_reuse(spark, d):
    """Donors by the digest's first byte: whole digests never meet here."""
    st = incremental.state_in_force(table(spark, d, "ingest_document"))
    s = state.donors(st.withColumn("content_hash", F.unhex(F.substring(F.hex("content_hash"), 1, 2))))
    return s.groupBy("document").agg(F.count("*").alias("donors")).select("document.collection", F.concat("document.source_id", F.lit("/"), "document.document_id").alias("doc"), "donors")


@query("SELECT 'ingested_chunk' AS name, count(*) AS n FROM ingested_chunk UNION ALL SELECT 'ingest_document', count(*) FROM ingest_document UNION ALL SELECT 'ingest_run', count(*) FROM ingest_run")
def table_counts(spark, d):
    out = None
    for name in ("ingested_chunk", "ingest_document", "ingest_run"):
        one = table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c.collection, count(*) AS chunks FROM ingested_chunk c WHERE NOT EXISTS (SELECT 1 FROM source_item s WHERE s.collection = c.collection AND s.source_id = c.source_id AND s.document_id = c.document_id) GROUP BY 1")
def orphan_chunks(spark, d):
    """Chunks of documents that the sources deliver no more."""
    c = table(spark, d, "ingested_chunk").select(*state.DOC)
    return c.join(table(spark, d, "source_item").select(*state.DOC).distinct(), state.DOC, "left_anti").groupBy("collection").agg(F.count("*").alias("chunks"))

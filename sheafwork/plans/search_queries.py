"""Queries on vector, keyword and hybrid search, filters and paging, with their SQL."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions import filters, vectors
from sheafwork.functions.filters import Field
from sheafwork.operators import fulltext, search
from sheafwork.plans.tables import table
from sheafwork.runtime import place

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _emb(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id = 7").select("embedding")


_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7)"
_COS = "round(greatest(0.0, 1 - list_inner_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(v, v)))), 6) + 0.0"
_L2 = "round(list_distance(CAST(embedding AS DOUBLE[]), v), 6) + 0.0"
_L1 = "round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), v), lambda z: abs(z[1] - z[2]))), 6) + 0.0"


def _knn_sql(dist: str, where: str = "true", top: int = 10, skip: int = 0, within: float | None = None) -> str:
    cond = f"WHERE distance <= {within}" if within is not None else ""
    return f"WITH {_Q} SELECT * FROM (SELECT vec_id, label, {dist} AS distance FROM embeddings, q WHERE {where}) {cond} ORDER BY distance, vec_id LIMIT {top} OFFSET {skip}"


@query(_knn_sql(_COS))
def knn_cosine(spark, d):
    e, q = _emb(spark, d)
    return search.knn(e, q, 10, key="vec_id", digits=6)


@query(_knn_sql(_COS, "label = 3 AND vec_id > 20"))
def knn_filtered(spark, d):
    e, q = _emb(spark, d)
    return search.knn(e, q, 10, key="vec_id", digits=6, predicate=(Field("label") == 3) & (Field("vec_id") > 20))


@query(_knn_sql(_L2))
def knn_l2(spark, d):
    e, q = _emb(spark, d)
    return search.knn(e, q, 10, metric="l2", key="vec_id", digits=6)


@query(_knn_sql(_L1))
def knn_l1(spark, d):
    e, q = _emb(spark, d)
    return search.knn(e, q, 10, metric="l1", key="vec_id", digits=6)


@query(_knn_sql(_COS, within=0.8, top=4096))
def knn_threshold(spark, d):
    e, q = _emb(spark, d)
    return search.knn(e, q, 4096, key="vec_id", digits=6, within=0.8)


@query(_knn_sql(_COS, top=10, skip=15))
def knn_paged(spark, d):
    e, q = _emb(spark, d)
    return search.knn(e, q, 10, skip=15, key="vec_id", digits=6)


@query(f"WITH {_Q} SELECT vec_id, {_COS} AS distance, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE), 3) AS DECIMAL(18,3)))) AS DOUBLE) AS component_sum FROM embeddings, q ORDER BY distance, vec_id LIMIT 5")
def knn_with_vectors(spark, d):
    e, q = _emb(spark, d)
    hits = search.knn(e, q, 5, key="vec_id", digits=6, include_vectors=True)
    total = F.aggregate(F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("decimal(18,3)")), F.lit(0).cast("decimal(28,3)"), lambda s, x: (s + x).cast("decimal(28,3)"))
    return hits.select("vec_id", "distance", total.cast("double").alias("component_sum"))


@query(
    "WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),"
    f" d AS (SELECT query, vec_id AS key, {_COS} AS distance FROM embeddings, q),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key) AS rank FROM d)"
    " SELECT query, key, distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"
)
def knn_batch(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    return search.knn_batch(e, q, 5, key="vec_id", digits=6)


@query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, CAST(len(embedding) AS INT) AS dims, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) + 0.0 AS unit_sum FROM embeddings")
def vec_normalize(spark, d):
    e = table(spark, d, "embeddings")
    unit = F.aggregate(vectors.normalize(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), vectors.length(F.col("embedding")).alias("dims"), (F.round(unit, 6) + F.lit(0.0)).alias("unit_sum"))


@query(
    "WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings), q AS (SELECT b AS v FROM b WHERE vec_id = 7),"
    " h AS (SELECT vec_id, CAST(len(list_filter(list_zip(b, v), lambda z: z[1] <> z[2])) AS INT) AS distance FROM b, q) SELECT * FROM h ORDER BY distance, vec_id LIMIT 20"
)
def knn_hamming(spark, d):
    e = table(spark, d, "embeddings").withColumn("bits", vectors.sign_bits(F.col("embedding")))
    return search.knn(e.select("vec_id", "bits"), e.where("vec_id = 7").select("bits"), 20, metric="hamming", key="vec_id", vector="bits")


@query("SELECT vec_id, CAST(4 * len(embedding) AS INT) AS bytes, true AS same, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS ones FROM embeddings")
def vec_codec(spark, d):
    e = table(spark, d, "embeddings").withColumn("blob", vectors.encode_float32(F.col("embedding")))
    bits = vectors.decode_bits(vectors.encode_bits(F.col("embedding")))
    return e.select("vec_id", F.octet_length("blob").alias("bytes"), (vectors.decode_float32(F.col("blob")) == F.col("embedding")).alias("same"), F.aggregate(bits, F.lit(0), lambda s, x: s + x).alias("ones"))


@query("SELECT collection, count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64) AS good, bool_or(len(embedding) <> 64) AS refused FROM ingested_chunk WHERE embedding IS NOT NULL GROUP BY collection")
def dimension_check(spark, d):
    """Vectors of 64 dimensions in each collection, and whether the check of a column refuses the collection as a whole."""
    c = table(spark, d, "ingested_chunk").where("embedding IS NOT NULL")
    n = c.groupBy("collection").agg(F.count("*").alias("n"), F.count_if(vectors.length(F.col("embedding")) == 64).alias("good"))
    refused = []
    for name in [r[0] for r in n.select("collection").collect()]:  # a row per collection
        try:
            c.where(F.col("collection") == name).select(vectors.checked(F.col("embedding"), 64).alias("v")).agg(F.count("v")).collect()
            refused.append((name, False))
        except PySparkException as e:
            if "5212" not in str(e):
                raise
            refused.append((name, True))
    return n.join(spark.createDataFrame(refused, "collection string, refused boolean"), "collection")


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE (c_acctbal > 5000 AND c_nationkey < 10) OR (c_mktsegment = 'FURNITURE' AND c_acctbal <= 0) OR c_custkey >= 1490")
def filter_logic(spark, d):
    p = ((Field("c_acctbal") > 5000) & (Field("c_nationkey") < 10)) | ((Field("c_mktsegment") == "FURNITURE") & (Field("c_acctbal") <= 0)) | (Field("c_custkey") >= 1490)
    return filters.where(table(spark, d, "customer"), p).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE NOT coalesce(lang = 'en' OR lang = 'de', false)")
def filter_not_null(spark, d):
    return filters.where(table(spark, d, "documents"), ~((Field("lang") == "en") | (Field("lang") == "de"))).select("doc_id", "lang")


@query("SELECT doc_id, source, lang FROM documents WHERE source IS NULL OR (lang IS NOT NULL AND media_type IS DISTINCT FROM 'text/plain')")
def filter_null_safe(spark, d):
    p = (Field("source") == None) | ((Field("lang") != None) & (Field("media_type") != "text/plain"))  # noqa: E711
    return filters.where(table(spark, d, "documents"), p).select("doc_id", "source", "lang")


@query("SELECT record_id, has_text_layer FROM extracted_document WHERE has_text_layer AND page_count >= 2")
def filter_bool(spark, d):
    return filters.where(table(spark, d, "extracted_document"), Field("has_text_layer").true() & (Field("page_count") >= 2)).select("record_id", "has_text_layer")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 5, 8, 13)")
def filter_in(spark, d):
    return filters.where(table(spark, d, "orders"), Field("o_orderpriority").isin("1-URGENT", "2-HIGH") & Field("o_custkey").isin(1, 2, 3, 5, 8, 13)).select("o_orderkey", "o_orderpriority")


@query("SELECT n_nationkey, n_name FROM nation WHERE NOT coalesce(n_name IN (NULL), false) AND n_regionkey <> 2")
def filter_in_empty(spark, d):
    return filters.where(table(spark, d, "nation"), ~Field("n_name").isin() & (Field("n_regionkey") != 2)).select("n_nationkey", "n_name")


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"SELECT doc_id, title FROM documents WHERE starts_with({_FOLD.format('title')}, 'service') OR ends_with({_FOLD.format('title')}, 'room') OR contains({_FOLD.format('title')}, 'É') OR contains({_FOLD.format('title')}, '%')")
def filter_like(spark, d):
    p = Field("title").starts("SERVICE") | Field("title").ends("Room") | Field("title").contains("É") | Field("title").contains("%")
    return filters.where(table(spark, d, "documents"), p).select("doc_id", "title")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey DESC, o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def filtered_get_page(spark, d):
    o = filters.where(table(spark, d, "orders"), Field("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy(F.desc("o_custkey"), "o_totalprice", "o_orderkey").offset(50).limit(25)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def get_by_keys(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(keys, "p_partkey", "left_semi").select("p_partkey", "p_name", "p_size")


@query("SELECT doc_id, CAST(greatest(length(lower(title)) - 2, 0) AS INT) AS grams FROM documents WHERE title IS NOT NULL")
def fts_trigrams(spark, d):
    t = table(spark, d, "documents").where("title IS NOT NULL")
    return t.select("doc_id", F.size(fulltext.tokens(F.col("title"), "trigram")).alias("grams"))


def _plain_words(col: str) -> str:
    """The default tokenizer in DuckDB's SQL: diacritics folded by the same table, lower case, runs of letters and digits."""
    was, to = fulltext.folding(1)
    return f"regexp_extract_all(lower(translate(coalesce({col}, ''), '{was}', '{to}')), '[\\p{{L}}\\p{{N}}]+')"


_indexes: dict[tuple, fulltext.TextIndex] = {}


def _index(spark: SparkSession, d: str, df: DataFrame | None = None, name: str = "documents", tokenizer: str = "unicode61") -> fulltext.TextIndex:
    """The index of the texts of a table, made once a session: searches read it and not the texts."""
    at = (spark.sparkContext.applicationId, d, name, tokenizer)
    if at not in _indexes:
        _indexes[at] = fulltext.TextIndex(spark, place(spark, "text-index"), "doc_id", tokenizer)
        _indexes[at].update(table(spark, d, "documents") if df is None else df, "text")
    return _indexes[at]


_T = f"t AS (SELECT doc_id, {_plain_words('text')} AS w FROM documents)"
_C = "len(list_filter(w, lambda x: x = '{}'))"


@query(f"WITH {_T} SELECT doc_id, CAST(len(w) AS INT) AS tokens, CAST(len(list_distinct(w)) AS INT) AS terms FROM t")
def fts_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", fulltext.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("terms"))


@query(f"WITH {_T} SELECT doc_id, CAST(len(w) AS INT) AS length, CAST({_C.format('pump')} AS INT) AS pump, CAST({_C.format('filter')} AS INT) AS filter FROM t WHERE {_C.format('pump')} > 0 OR {_C.format('filter')} > 0")
def fts_match_or(spark, d):
    m = _index(spark, d).match(["pump", "Filter"])
    return m.select("doc_id", "length", F.get("tf", F.lit(0)).alias("pump"), F.get("tf", F.lit(1)).alias("filter"))


@query(f"WITH {_T} SELECT doc_id, CAST(len(w) AS INT) AS length FROM t WHERE {_C.format('pump')} > 0 AND {_C.format('drain')} > 0")
def fts_match_and(spark, d):
    return _index(spark, d).match(["pump", "drain"], match_all=True).select("doc_id", "length")


_PH = "len(list_filter(range(1, len(w)), lambda i: w[i] = '{}' AND w[i + 1] = '{}'))"


@query(f"WITH {_T} SELECT doc_id, CAST({_PH.format('drain', 'pump')} AS INT) AS n FROM t WHERE {_PH.format('drain', 'pump')} > 0")
def fts_phrase(spark, d):
    m = _index(spark, d).match(["Drain-Pump"])
    return m.select("doc_id", F.get("tf", F.lit(0)).alias("n"))


def _bm25(words: list[str], source: str = "documents") -> str:
    f = ", ".join(f"{_C.format(w)} AS f{i}" for i, w in enumerate(words))
    s = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(words)))
    part = " + ".join(f"(CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * len / avglen))" for i in range(len(words)))
    anyf = " OR ".join(f"f{i} > 0" for i in range(len(words)))
    return f"{_T}, f AS (SELECT doc_id, len(w) AS len, {f} FROM t), s AS (SELECT count(*) AS n, avg(len) AS avglen, {s} FROM f), hits AS (SELECT doc_id, round(-({part}), 9) AS rank FROM f, s WHERE {anyf})"


@query(f"WITH {_bm25(['valve', 'sealed'])} SELECT doc_id, round(rank, 6) AS rank FROM hits ORDER BY hits.rank, doc_id LIMIT 10")
def fts_bm25_top10(spark, d):
    r = _index(spark, d).bm25(["valve", "sealed"]).withColumn("rank", F.round("rank", 9))
    return r.orderBy("rank", "doc_id").limit(10).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {_T} SELECT doc_id, CAST(len(w) AS INT) AS length FROM t WHERE len(list_filter(w, lambda x: regexp_full_match(x, 'seal(s|ed|ing|ings|er|ers|able)?|calibrat(e|es|ed|ing|ion|ions|or|ors|ive)'))) > 0")
def fts_porter(spark, d):
    """Documents that match stems; the SQL lists the forms that have them."""
    return _index(spark, d, tokenizer="porter").match(["sealing", "calibrates"]).select("doc_id", "length")


@query(f"WITH {_T} SELECT doc_id, CAST(len(list_filter(w, lambda x: starts_with(x, 'seal'))) AS INT) AS n FROM t WHERE len(list_filter(w, lambda x: starts_with(x, 'seal'))) > 0")
def fts_prefix(spark, d):
    return _index(spark, d).match(["seal*"]).select("doc_id", F.get("tf", F.lit(0)).alias("n"))


@query()
def fts_updated(spark, d):
    """An index that was updated and deleted from ranks as one made of what is left."""
    docs = table(spark, d, "documents")
    ix = fulltext.TextIndex(spark, place(spark, "text-index"), "doc_id")
    ix.update(docs.withColumn("text", F.concat(F.lit("valve "), F.coalesce("text", F.lit("")))), "text")
    ix.update(docs, "text")
    ix.delete(docs.where("doc_id % 10 = 3"))
    r = ix.bm25(["valve", "sealed"]).withColumn("rank", F.round("rank", 9))
    return r.orderBy("rank", "doc_id").limit(10).select("doc_id", F.round("rank", 6).alias("rank"))


SQL["fts_updated"] = "WITH " + _bm25(["valve", "sealed"]).replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3 OR doc_id IS NULL)", 1) + " SELECT doc_id, round(rank, 6) AS rank FROM hits ORDER BY hits.rank, doc_id LIMIT 10"


@query(f"WITH {_T}, p AS (SELECT doc_id, unnest(w) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS tf FROM p GROUP BY term")
def fts_postings(spark, d):
    p = fulltext.postings(table(spark, d, "documents"), "text", "doc_id").where("term <> ''")
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


def _corpus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the vector of the same number."""
    e, q = _emb(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return docs.join(e.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), "doc_id"), q


def _hybrid(words: list[str], where: str = "true", cand: int = 40, wk: float = 1.0, wv: float = 1.0, k: int = 60, top: int = 10, skip: int = 0, least: float | None = None) -> str:
    corpus = "corpus AS (SELECT d.doc_id, d.text, d.lang, e.embedding, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"
    bm = _bm25(words).replace("FROM documents)", "FROM corpus)", 1)
    v = f"vd AS (SELECT doc_id, {_COS} AS distance FROM corpus, q WHERE {where}), vl AS (SELECT doc_id, row_number() OVER (ORDER BY distance, doc_id) AS vr FROM vd QUALIFY vr <= {cand})"
    w = f"wl AS (SELECT doc_id, row_number() OVER (ORDER BY round(rank, 6), doc_id) AS wr FROM hits WHERE doc_id IN (SELECT doc_id FROM corpus WHERE {where}) QUALIFY wr <= {cand})"
    page = f"page AS (SELECT coalesce(vl.doc_id, wl.doc_id) AS doc_id, coalesce({wk} / ({k} + wr), 0) + coalesce({wv} / ({k} + vr), 0) AS score FROM vl FULL JOIN wl ON vl.doc_id = wl.doc_id ORDER BY score DESC, doc_id LIMIT {top} OFFSET {skip})"
    cond = f" WHERE score >= {least}" if least is not None else ""
    return f"WITH {corpus}, {_Q}, {bm}, {v}, {w}, {page} SELECT doc_id, round(score, 9) AS score FROM page{cond}"


def _fused(spark, d, words, **kw):
    c, q = _corpus(spark, d)
    return search.hybrid(c, q, words, "text", key="doc_id", digits=6, index=_index(spark, d, c, "corpus"), **kw).select("doc_id", F.round("score", 9).alias("score"))


@query(_hybrid(["valve", "sealed"]))
def hybrid_rrf(spark, d):
    return _fused(spark, d, ["valve", "sealed"])


@query(_hybrid(["valve", "sealed"], "label < 5"))
def hybrid_filtered(spark, d):
    return _fused(spark, d, ["valve", "sealed"], predicate=Field("label") < 5)


@query(_hybrid(["pump"], cand=100, wk=0.3, wv=2.0, k=10, skip=5))
def hybrid_weights(spark, d):
    return _fused(spark, d, ["pump"], skip=5, options=search.Hybrid(vector_weight=2.0, keyword_weight=0.3, k=10, candidates=100))


@query(_hybrid(["valve", "sealed"], least=0.0164))
def hybrid_threshold(spark, d):
    return _fused(spark, d, ["valve", "sealed"], least_score=0.0164)


@query(
    f"WITH corpus AS (SELECT d.doc_id, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id), {_Q}, h AS (SELECT doc_id, {_COS} AS distance FROM corpus, q ORDER BY distance, doc_id LIMIT 10 OFFSET 3)"
    " SELECT doc_id, round(1.0 / (63 + row_number() OVER (ORDER BY distance, doc_id)), 9) AS score FROM h"
)
def hybrid_no_keywords(spark, d):
    return _fused(spark, d, ["", "  "], skip=3)

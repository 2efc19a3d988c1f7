"""Queries on text, chunks, keys, embeddings, and on retrieval-augmented answers and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.functions import text as tx
from sheafwork.operators import chat, chunking, embedding, rag, state
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


_NORM = r"nfc_normalize(translate(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g'), chr(160) || chr(8199) || chr(8239), '   '))"


@query(f"SELECT doc_id, md5({_NORM}) AS digest FROM documents WHERE text IS NOT NULL")
def normalize_text(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(tx.normalized(F.col("text"))).alias("digest"))


_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"WITH p AS (SELECT doc_id, unnest(regexp_split_to_array({_NORM}, '\n[ \t\f\v\r]*(?:\n[ \t\f\v\r]*)+')) AS p FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, regexp_replace(p, '^{_WS}+|{_WS}+$', '', 'g') AS p FROM p) SELECT doc_id, count(*) AS blocks, CAST(sum(length(p)) AS BIGINT) AS chars FROM b WHERE p <> '' GROUP BY doc_id")
def paragraph_blocks(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(tx.paragraphs(tx.normalized(F.col("text")))).alias("p"))
    return t.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("p")).alias("chars"))


@query("SELECT doc_id, md5(coalesce(title, '') || chr(31) || coalesce(lang, '') || chr(31) || coalesce(text, '')) AS digest FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash(F.col("title"), F.col("lang"), F.col("text")).alias("digest"))


@query(
    "WITH c AS (SELECT *, row_number() OVER (PARTITION BY collection, source_id, document_id, md5(embed_text) ORDER BY ordinal, draft_id) - 1 AS dup FROM chunk_draft)"
    " SELECT draft_id, md5(md5(coalesce(source_id, '')) || chr(31) || md5(coalesce(document_id, '')) || chr(31) || md5(coalesce(embed_text, '')) || chr(31) || dup) AS chunk_key FROM c"
)
def chunk_keys(spark, d):
    c = table(spark, d, "chunk_draft").withColumn("ordinal", F.struct("ordinal", "draft_id"))
    return state.chunk_keys(c).select("draft_id", "chunk_key")


@query("SELECT document_id, CASE lower(regexp_extract(document_id, '\\.([^./\\\\]+)$', 1)) WHEN 'txt' THEN 'text/plain' WHEN 'log' THEN 'text/plain' WHEN 'csv' THEN 'text/plain' WHEN 'text' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'markdown' THEN 'text/markdown' WHEN 'pdf' THEN 'application/pdf' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/octet-stream' END AS kind FROM source_item")
def media_type_of_path(spark, d):
    return table(spark, d, "source_item").select("document_id", tx.media_type_of_path(F.col("document_id")).alias("kind"))


@query("SELECT draft_id, array_to_string(heading_path, ' › ') AS crumb, coalesce(array_to_string(heading_path, ' › ') || chr(10) || chr(10), '') || text AS embed FROM chunk_draft WHERE len(heading_path) > 0 AND len(list_filter(heading_path, lambda h: h IS NULL)) = 0")
def breadcrumbs(spark, d):
    c = table(spark, d, "chunk_draft").where("size(heading_path) > 0 AND NOT exists(heading_path, h -> h IS NULL)")
    crumb = tx.breadcrumb(F.col("heading_path"))
    return c.select("draft_id", crumb.alias("crumb"), F.concat(F.coalesce(F.concat(crumb, F.lit("\n\n")), F.lit("")), "text").alias("embed"))


@query("SELECT doc_id, coalesce(CAST(floor((length(text) + 3) / 4) AS BIGINT), 0) AS tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


#: White space in DuckDB's regular expressions.
_SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _chunks(spark: SparkSession, d: str, chunker: str, kind: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("media_type", F.lit(kind))
    return chunking.chunk_documents(t, "doc_id", "text", "media_type", chunking.resolve(256), chunker)


@query(
    rf"SELECT chunker, doc_id, CAST(length(regexp_replace(nfc_normalize(regexp_replace(text, '^\x{{FEFF}}', '')), '[{_SPACE}]', '', 'g')) AS BIGINT) AS chars, 0 AS over FROM documents, (SELECT unnest(['plain', 'token-window']) AS chunker) WHERE regexp_replace(text, '[{_SPACE}]', '', 'g') <> ''"
)
def chunk_cover(spark, d):
    """Without overlap the chunks of a text hold all its characters but white space once, within the budget."""
    o = chunking.resolve(256, overlap_tokens=0)
    t = table(spark, d, "documents").withColumn("media_type", F.lit("text/plain"))
    out = None
    for chunker in ("plain", "token-window"):
        c = chunking.chunk_documents(t, "doc_id", "text", "media_type", o, chunker)
        bare = F.length(F.regexp_replace("text", f"[{tx.WHITE_SPACE}]", ""))
        one = c.groupBy("doc_id").agg(F.sum(bare).alias("chars"), F.count_if(F.col("token_count") > o.max_tokens).alias("over")).withColumn("chunker", F.lit(chunker))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def chunk_plain(spark, d):
    return _chunks(spark, d, "plain", "text/plain")


@query()
def chunk_token_window(spark, d):
    return _chunks(spark, d, "token-window", "text/plain")


@query()
def chunk_markdown(spark, d):
    t = table(spark, d, "extracted_document").withColumn("media_type", F.lit("text/markdown"))
    return chunking.chunk_documents(t, "record_id", "text", "media_type", chunking.resolve(256))


@query()
def wordpiece_counts(spark, d):
    t = table(spark, d, "documents")
    return embedding.wordpiece_counts(t, "doc_id", "text", embedding.corpus_vocabulary(t, "text", 4000), 256)


@query(
    "WITH e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2),"
    " n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, i, round(x / n, 6) + 0.0 AS x FROM m JOIN n USING (label)"
)
def pool_mean_l2(spark, d):
    p = embedding.mean_pooled(table(spark, d, "embeddings"), ["label"], "embedding", 64)
    return p.select("label", F.posexplode("pooled").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN 32 END AS dims, min(doc_id) OVER (PARTITION BY text) AS first FROM documents")
def embed_distinct(spark, d):
    """The size of every text's vector, and the first document with the same one."""
    t = table(spark, d, "documents").select("doc_id", "text")
    e = embedding.embed_distinct(t, "text", embedding.hashing_embedder(32), 32)
    return e.select("doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"), F.min("doc_id").over(Window.partitionBy("embedding")).alias("first"))


# Retrieval-augmented answers. Queries are the titles of documents; their sources the document's chunks.

_STOP = ", ".join(f"'{w}'" for w in rag.STOP_WORDS if "'" not in w)


@query(
    rf"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(title, '\p{{L}}+')) AS w, generate_subscripts(regexp_extract_all(title, '\p{{L}}+'), 1) AS i FROM documents WHERE title IS NOT NULL),"
    f" g AS (SELECT doc_id, w, i FROM w WHERE length(w) >= 3 AND lower(w) NOT IN ({_STOP}) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) = 1),"
    " k AS (SELECT doc_id, w, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 8)"
    " SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS keywords FROM documents LEFT JOIN k USING (doc_id) WHERE title IS NOT NULL GROUP BY doc_id"
)
def rag_keywords(spark, d):
    t = table(spark, d, "documents").where("title IS NOT NULL")
    return t.select("doc_id", F.array_join(rag.keywords(F.col("title")), " ").alias("keywords"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Conversations from the events: a user's events in order, every tenth a system message."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    role = F.when(F.col("event_type") == "error", "system").when(F.col("event_type") == "view", "assistant").otherwise("user")
    return e.select(F.col("user_id").alias("conv_id"), F.row_number().over(w).alias("turn"), role.alias("role"), F.concat("event_type", F.lit(" "), "props").alias("text"))


_MSG = "m AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn, CASE event_type WHEN 'error' THEN 'system' WHEN 'view' THEN 'assistant' ELSE 'user' END AS role, event_type || ' ' || props AS text FROM events)"


@query(f"WITH {_MSG} SELECT conv_id, max_by(text, turn) AS query FROM m WHERE role = 'user' GROUP BY conv_id")
def rag_query_last(spark, d):
    return rag.query_text(_messages(spark, d), "conv_id", "turn")


@query(f"WITH {_MSG} SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS query FROM m WHERE role = 'user' GROUP BY conv_id")
def rag_query_all(spark, d):
    return rag.query_text(_messages(spark, d), "conv_id", "turn", every=True)


def _sources(spark: SparkSession, d: str, most: int = 1200) -> DataFrame:
    """Sources of a document as a query: its drafted chunks, scored by their length."""
    c = table(spark, d, "chunk_draft").where("text IS NOT NULL")
    kind = F.when(F.col("collection") == "kb", "Distance").otherwise("Relevance")
    s = c.select(F.concat_ws("/", "collection", "source_id", "document_id").alias("query_id"), F.col("draft_id").alias("position"), (F.length("text") % 7).cast("double").alias("score"), kind.alias("score_kind"), "text", F.col("breadcrumb").alias("title"), F.col("document_id").alias("uri"))
    return rag.ranked(s, "query_id", most)


_SRC = (
    "s AS (SELECT concat_ws('/', collection, source_id, document_id) AS query_id, draft_id AS position, CAST(length(text) % 7 AS DOUBLE) AS score, CASE WHEN collection = 'kb' THEN 'Distance' ELSE 'Relevance' END AS score_kind,"
    " CASE WHEN length(text) <= {0} OR (length(text) <= {0} + 13 AND ends_with(text, '…(truncated)')) THEN text ELSE substr(text, 1, {0}) || '…(truncated)' END AS text, breadcrumb AS title, document_id AS uri FROM chunk_draft WHERE text IS NOT NULL),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN score_kind = 'Distance' THEN score ELSE -score END, position) AS ordinal FROM s)"
)


@query(f"WITH {_SRC.format(1200)} SELECT query_id, position, CAST(ordinal AS INT) AS ordinal, CAST(length(text) AS INT) AS chars FROM r")
def rag_rank(spark, d):
    return _sources(spark, d).select("query_id", "position", "ordinal", F.length("text").alias("chars"))


_ONE = "regexp_replace(regexp_replace({0}, '^[\\x00-\\x1f\\x7f\\x{{2028}}\\x{{2029}}]+|[\\x00-\\x1f\\x7f\\x{{2028}}\\x{{2029}}]+$', '', 'g'), '[\\x00-\\x1f\\x7f\\x{{2028}}\\x{{2029}}]+', ' ', 'g')"
_TITLE = _ONE.format("title")


@query(
    f"WITH {_SRC.format(300)}, e AS (SELECT query_id, ordinal, chr(10) || '[' || ordinal || ']' || CASE WHEN length(coalesce(title, '')) > 0 THEN ' Title: ' || CASE WHEN length({_TITLE}) > 200 THEN substr({_TITLE}, 1, 200) || '…' ELSE {_TITLE} END ELSE '' END || chr(10)"
    f" || coalesce('    Source: ' || {_ONE.format('uri')} || chr(10), '') || '    ---' || chr(10) || '    ' || replace(regexp_replace(text, '\\r(\\n|$)', '\\1', 'g'), chr(10), chr(10) || '    ') || chr(10) AS e FROM r),"
    f" c AS (SELECT query_id, ordinal, '{rag.HEADING}' || chr(10) || '{rag.CONTEXT_PROMPT}' || chr(10) || string_agg(e, '') OVER (PARTITION BY query_id ORDER BY ordinal) || chr(10) || '{rag.CITATION_PROMPT}' AS context FROM e),"
    " f AS (SELECT query_id, max(ordinal) FILTER (WHERE (length(context) + 3) // 4 <= 160) AS n FROM c GROUP BY query_id)"
    " SELECT f.query_id, context, CAST(coalesce(n, 0) AS INT) AS included FROM f LEFT JOIN c ON c.query_id = f.query_id AND c.ordinal = f.n"
)
def rag_context(spark, d):
    return rag.context_blocks(_sources(spark, d, 300), "query_id", 160)


@query(f"WITH {_SRC.format(600)} SELECT query_id, string_agg(text || ' [' || ordinal || ']', chr(10) || chr(10) ORDER BY ordinal) AS answer FROM r WHERE ordinal <= 3 GROUP BY query_id")
def extractive_answer(spark, d):
    return rag.extractive_answer(_sources(spark, d, 600), "query_id", most_chars=600)


_MARK = r"'\[\d+\]'"


@query(
    f"WITH {_SRC.format(600)}, a AS (SELECT query_id, string_agg(text || ' [' || ordinal || ']', chr(10) || chr(10) ORDER BY ordinal) AS answer FROM r WHERE ordinal <= 3 GROUP BY query_id),"
    f" m AS (SELECT query_id, regexp_extract_all(answer, {_MARK}) AS ms, string_split_regex(answer, {_MARK}) AS gs FROM a), u AS (SELECT query_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m),"
    " z AS (SELECT query_id, TRY_CAST(regexp_extract(ms[i], '\\d+') AS INT) AS ordinal, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS start FROM u),"
    " c AS (SELECT query_id, ordinal, list(start ORDER BY start) AS st FROM z WHERE EXISTS (SELECT 1 FROM r WHERE r.query_id = z.query_id AND r.ordinal = z.ordinal) GROUP BY 1, 2)"
    " SELECT query_id, ordinal, row_number() OVER (PARTITION BY query_id ORDER BY st[1]) AS place, array_to_string(st, ',') AS starts FROM c"
)
def rag_citations(spark, d):
    """Cited sources of the extractive answers, with the offsets of their markers."""
    s = _sources(spark, d, 600)
    cited, _ = rag.citations(rag.extractive_answer(s, "query_id"), s, "query_id")
    return cited.select("query_id", "ordinal", "place", F.array_join("starts", ",").alias("starts"))


@query(f"WITH {_SRC.format(600)}, a AS (SELECT DISTINCT query_id FROM r), q AS (SELECT DISTINCT concat_ws('/', collection, source_id, document_id) AS query_id FROM ingest_document) SELECT query_id, a.query_id IS NOT NULL AS grounded FROM q LEFT JOIN a USING (query_id)")
def rag_grounded(spark, d):
    q = table(spark, d, "ingest_document").select(F.concat_ws("/", "collection", "source_id", "document_id").alias("query_id")).distinct()
    return rag.answered(q, rag.extractive_answer(_sources(spark, d, 600), "query_id"), "query_id").select("query_id", "grounded")


@query(
    f"WITH {_MSG}, t AS (SELECT *, (length(text) + 3) // 4 AS tok, sum((length(text) + 3) // 4) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) FILTER (WHERE role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn) AS free FROM m),"
    " g AS (SELECT *, CASE WHEN role <> 'system' THEN count(*) FILTER (WHERE role = 'user' OR (role <> 'system' AND free = 1)) OVER (PARTITION BY conv_id ORDER BY turn) END AS g FROM t),"
    " c AS (SELECT conv_id, g, sum(tok) AS c, max(total) AS total, min(back) AS back FROM g WHERE g IS NOT NULL GROUP BY 1, 2),"
    " d AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY g) AS gone, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(min(CASE WHEN back <= 2 THEN g END) OVER (PARTITION BY conv_id), 1000000) AS stop FROM c),"
    " k AS (SELECT conv_id, CASE WHEN max(n) <= 8 AND max(total) <= 300 THEN 0 ELSE coalesce(min(CASE WHEN n - g <= 8 AND total - gone <= 300 AND g < stop THEN g END), max(least(stop, n + 1)) - 1) END AS upto FROM d GROUP BY 1)"
    " SELECT conv_id, turn, role = 'system' OR g > coalesce(upto, 0) AS kept FROM g LEFT JOIN k USING (conv_id)"
)
def history_reduce(spark, d):
    m = chat.reduce_history(_messages(spark, d), "conv_id", "turn", most_tokens=300)
    return m.select("conv_id", F.col("turn").cast("long").alias("turn"), "kept")


@query(
    f"WITH {_MSG}, l AS (SELECT *, count(*) FILTER (WHERE role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn) = 0 AS lead FROM m)"
    " SELECT conv_id, md5(coalesce(string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) FILTER (WHERE lead), '') || 'system: Be brief.' || chr(10) || coalesce(string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) FILTER (WHERE NOT lead), '') || 'assistant: ') AS digest FROM l GROUP BY conv_id"
)
def prompt_compose(spark, d):
    return chat.prompt(_messages(spark, d), "conv_id", "turn", system="Be brief.").select("conv_id", F.md5("prompt").alias("digest"))


@query("SELECT doc_id, substr(text, 1, coalesce(list_min(list_filter([strpos(text, ' until'), strpos(text, '. '), strpos(text, '。')], lambda p: p > 0)) - 1, length(text))) AS head FROM documents WHERE text IS NOT NULL")
def stop_sequences(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", chat.stopped(F.col("text"), [" until", ". ", "。"]).alias("head"))


@query(
    "WITH r AS (SELECT unnest([8192, 4096, 2048, 1024, 512]) AS n), s AS (SELECT c_name AS name, 500000000 + c_custkey * 1000 AS w, CAST(28 AS BIGINT) * 2 * 8 * 128 * 2 AS per, CAST(floor((1000000000 + c_acctbal * 100000) * 0.8) AS BIGINT) AS usable FROM customer),"
    " f AS (SELECT name, w, per, max(CASE WHEN w + per * n + 100000000 + 50000000 <= usable THEN n END) AS n FROM s, r GROUP BY ALL)"
    " SELECT name, CAST(coalesce(n, 0) AS BIGINT) AS context, w + per * coalesce(n, 512) + 150000000 AS required FROM f"
)
def memory_ladder(spark, d):
    c = table(spark, d, "customer")
    s = c.select(F.col("c_name").alias("name"), (F.lit(500_000_000) + F.col("c_custkey") * 1000).alias("weights"), F.lit(28).alias("layers"), F.lit(8).alias("heads"), F.lit(128).alias("head_size"), F.lit(2).alias("element_bytes"), (F.lit(1_000_000_000) + F.col("c_acctbal") * 100_000).alias("available"))
    return chat.memory_ladder(s, [512, 1024, 2048, 4096, 8192], 100_000_000, 50_000_000, 0.8)


@query(f"WITH {_MSG}, x AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last FROM m GROUP BY 1) SELECT conv_id, CAST(turn AS DOUBLE) AS turn, role FROM m UNION ALL SELECT conv_id, last - 0.5, 'system' FROM x WHERE last IS NOT NULL AND conv_id % 2 = 0")
def context_injection(spark, d):
    m = _messages(spark, d)
    blocks = m.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 2 == 0, "context").alias("context"))
    return rag.injected(m, blocks, "conv_id", "turn").select("conv_id", "turn", "role")

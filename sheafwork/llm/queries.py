"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from sheafwork.llm import markup, mixing, neardup, neighbours, packing, sentences, splitting

QUERIES = {
    "p2_found": neardup.found,
    "p2_groups": neardup.groups,
    "p3_found": neighbours.found,
    "p3_nearest": neighbours.nearest,
    "p4_found": markup.found,
    "p4_clean": markup.clean,
    "p5_found": splitting.found,
    "p5_split": splitting.split,
    "p6_found": packing.found,
    "p6_fills": packing.fills,
    "p7_found": mixing.found,
    "p7_report": mixing.report,
    "p8_found": sentences.found,
    "p2_classes": neardup.classes,
    "p5_cover": splitting.cover,
    "p6_cover": packing.cover,
    "p7_limits": mixing.limits,
    "p8_cover": sentences.cover,
}

SQL: dict[str, str] = {}

#: Tokens as the splitting counts them, in DuckDB's regular expressions.
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}]{1,8}|[^\p{L}\p{N}\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'))"

SQL["p5_found"] = f"""
SELECT DISTINCT draft_id FROM chunk_draft JOIN collection_profile USING (collection) WHERE {_TOKENS} > max_tokens
"""

SQL["p6_found"] = """
SELECT DISTINCT capacity_tokens, doc_id FROM documents, pack_spec WHERE strlen(text) > capacity_tokens
"""

SQL["p7_found"] = """
WITH t AS (SELECT mix_id, lower(trim(source)) AS src, min(source) AS source, sum(greatest(coalesce(weight, 0), 0)) AS weight, max(coalesce(max_repeats, 1)) AS max_repeats FROM mix_target GROUP BY ALL),
d AS (SELECT lower(trim(source)) AS src, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS size, count(*) AS n FROM documents GROUP BY ALL),
p AS (SELECT mix_id, source, weight, max_repeats, coalesce(size, 0) AS size, coalesce(n, 0) AS n, sum(weight) OVER (PARTITION BY mix_id) AS all_weight, sum(coalesce(size, 0)) OVER (PARTITION BY mix_id) AS total FROM t LEFT JOIN d USING (src))
SELECT mix_id, source FROM p WHERE n = 0 OR max_repeats * size < weight / all_weight * total
"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

SQL["p2_found"] = f"""
WITH t AS (SELECT key, min({_WORDS}) AS w FROM ingested_chunk WHERE key IS NOT NULL AND text IS NOT NULL GROUP BY key),
s AS (SELECT DISTINCT key, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) >= 8),
n AS (SELECT key, count(*) AS n FROM s GROUP BY key),
b AS (SELECT x.key AS key_a, y.key AS key_b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.key < y.key GROUP BY ALL)
SELECT key_a, key_b FROM b JOIN n na ON na.key = key_a JOIN n nb ON nb.key = key_b WHERE shared >= 0.7 * (na.n + nb.n - shared) - 1e-9
"""

SQL["p2_classes"] = f"""
WITH t AS (SELECT DISTINCT key, array_to_string({_WORDS}, ' ') AS w, len({_WORDS}) AS n FROM ingested_chunk WHERE key IS NOT NULL AND text IS NOT NULL)
SELECT key, min(key) OVER (PARTITION BY w) AS class_id FROM t WHERE n >= 8
"""

SQL["p3_found"] = """
WITH v AS (SELECT DISTINCT collection, key, CAST(embedding AS DOUBLE[]) AS e, lower(distance_function) AS f, neighbour_count AS k, neighbour_max_distance AS most FROM ingested_chunk JOIN collection_profile USING (collection)
  WHERE key IS NOT NULL AND len(embedding) = dimensions AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = dimensions AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT a.key AS x, b.key AS y, a.k, a.most, CASE a.f WHEN 'cosinedistance' THEN 1 - list_cosine_similarity(a.e, b.e) WHEN 'euclideandistance' THEN list_distance(a.e, b.e)
  ELSE list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))) END AS d FROM v a JOIN v b ON a.collection = b.collection AND a.key <> b.key),
r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY d, y) AS n, k FROM d WHERE d <= most)
SELECT DISTINCT least(x, y) AS key_a, greatest(x, y) AS key_b FROM r WHERE n <= k
"""

SQL["p5_cover"] = f"""
SELECT draft_id, coalesce({_TOKENS}, 0) AS tokens, max_tokens IS NULL OR coalesce({_TOKENS}, 0) <= max_tokens AS whole, 0 AS over FROM chunk_draft LEFT JOIN collection_profile USING (collection)
"""

SQL["p6_cover"] = """
SELECT capacity_tokens, doc_id, CAST(strlen(text) AS BIGINT) AS size, strlen(text) <= capacity_tokens AS whole, 0 AS over FROM documents, (SELECT DISTINCT capacity_tokens FROM pack_spec) WHERE text IS NOT NULL
"""

SQL["p7_limits"] = """
WITH t AS (SELECT mix_id, lower(trim(source)) AS src, min(source) AS source, sum(greatest(coalesce(weight, 0), 0)) AS weight, max(coalesce(max_repeats, 1)) AS max_repeats FROM mix_target GROUP BY ALL),
d AS (SELECT lower(trim(source)) AS src, sum(coalesce(strlen(text), 0)) AS size, max(coalesce(strlen(text), 0)) AS longest FROM documents GROUP BY ALL),
p AS (SELECT mix_id, source, max_repeats, coalesce(size, 0) AS size, coalesce(longest, 0) AS longest, weight / sum(weight) OVER (PARTITION BY mix_id) * sum(coalesce(size, 0)) OVER (PARTITION BY mix_id) AS target FROM t LEFT JOIN d USING (src))
SELECT mix_id, source, true AS near, true AS within_repeats FROM p
"""

SQL["p8_cover"] = r"""
SELECT doc_id, CAST(length(regexp_replace(text, '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS BIGINT) AS chars, 0 AS gaps FROM documents WHERE text IS NOT NULL
"""

"""The core's registered queries and their SQL."""

from __future__ import annotations

from sheafwork.operators import incremental
from sheafwork.plans import pipeline_queries, search_queries, state_queries, text_queries

QUERIES = {"p1_found": incremental.found, **search_queries.QUERIES, **state_queries.QUERIES, **text_queries.QUERIES, **pipeline_queries.QUERIES}

SQL: dict[str, str] = {**search_queries.SQL, **state_queries.SQL, **text_queries.SQL, **pipeline_queries.SQL}

SQL["p1_found"] = """
WITH cur AS (
  SELECT * FROM source_item QUALIFY row_number() OVER (PARTITION BY collection, source_id, document_id ORDER BY seen_utc DESC NULLS LAST, item_seq DESC) = 1),
st AS (
  SELECT * FROM (SELECT *, CAST(regexp_replace(updated_utc, '[.,][0-9]+', '') AS TIMESTAMPTZ) AS at_s, CAST(rpad(left(regexp_extract(updated_utc, '[.,]([0-9]+)', 1), 9), 9, '0') AS INT) AS at_n FROM ingest_document)
  QUALIFY row_number() OVER (PARTITION BY collection, source_id, document_id ORDER BY at_s DESC NULLS LAST, at_n DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST, hex(content_hash) DESC NULLS LAST, hex(recipe_hash) DESC NULLS LAST) = 1),
rc AS (SELECT collection, lower(trim(split_part(media_type, ';', 1))) AS mt, max(recipe_hash) AS rh FROM recipe WHERE retired_utc IS NULL GROUP BY ALL)
SELECT c.collection, c.source_id, c.document_id
FROM cur c
LEFT JOIN rc r ON r.collection = c.collection AND r.mt = lower(trim(split_part(c.media_type, ';', 1)))
LEFT JOIN st s ON s.collection IS NOT DISTINCT FROM c.collection AND s.source_id IS NOT DISTINCT FROM c.source_id AND s.document_id IS NOT DISTINCT FROM c.document_id
WHERE NOT coalesce(c.content_hash = s.content_hash AND replace(hex(c.content_hash), '0', '') <> ''
  AND s.recipe_hash = r.rh AND replace(hex(r.rh), '0', '') <> ''
  AND lower(trim(s.status)) IN ('indexed', 'notextlayer', 'unsupported', 'failed'), false)
"""

"""Queries over pages and embeddings."""

from __future__ import annotations

from buslens.llm.ann import embedding_search
from buslens.llm.common import table
from buslens.llm.extraction import extract
from buslens.llm.registry import query
from buslens.llm.warc import archive_index

ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (ORDER BY page_id) AS r FROM pages),
d AS (SELECT page_id, r, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY h, payload_bytes ORDER BY page_id DESC NULLS LAST, r DESC) AS n,
    first(page_id) OVER (PARTITION BY h, payload_bytes ORDER BY page_id DESC NULLS LAST, r DESC) AS first_id FROM d)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST(('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5)) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
    CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first_id END AS refers_to
FROM ranked
"""


@query("op1_archive_index", ARCHIVE_SQL)
def op1_archive_index(spark, sf_dir):
    return archive_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_nearest")
def op3_nearest(spark, sf_dir):
    return embedding_search(table(spark, sf_dir, "embeddings"))


@query("op5_main_text")
def op5_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))

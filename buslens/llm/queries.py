"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from buslens.llm.common import table
from buslens.llm.language import identify
from buslens.llm.line_dedup import dedup_lines
from buslens.llm.mixing import fair_mix
from buslens.llm.ngram_join import ngram_components
from buslens.llm.packing import pack
from buslens.llm.registry import query
from buslens.llm.secrets import find_secrets
from buslens.llm.topk import integer_search

MIX_SQL = r"""
WITH docs AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ord FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighted AS (SELECT *, 2 * source_size AS stop,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight FROM sums),
placed AS (SELECT *, row_number() OVER (ORDER BY stop / weight, source ASC NULLS LAST) AS place,
    CAST((SELECT sum(source_size) FROM sums) AS DOUBLE) * 1.5e0 AS budget FROM weighted),
levels AS (SELECT *, (budget - CAST(coalesce(sum(stop) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM placed),
free AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE level * weight <= stop),
goals AS (SELECT source, source_size, CASE WHEN f.place IS NULL OR l.place < f.place THEN CAST(stop AS DOUBLE) ELSE f.level * weight END AS target
    FROM levels l, free f),
queued AS (SELECT *, row_number() OVER () AS r, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM docs),
copies AS (SELECT q.*, g.source_size, g.target, unnest(range(0, CASE WHEN size > 0 THEN 2 ELSE 1 END)) AS copy FROM queued q JOIN goals g ON q.source IS NOT DISTINCT FROM g.source),
parts AS (SELECT *, unnest(range(0, greatest(1, (size + 255) // 256))) AS part FROM copies),
timed AS (SELECT *, least(256, size - 256 * part) AS words,
    CASE WHEN target > 0 THEN CAST(copy * source_size + before + 256 * part + least(256, size - 256 * part) AS DOUBLE) / target ELSE 0e0 END AS finish FROM parts),
mixed AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, source NULLS FIRST, ord, size, r, copy, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM timed)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(sum(greatest(0, least(words, CAST(floor((SELECT sum(source_size) FROM sums) * 1.5e0) AS BIGINT) - ahead))) AS BIGINT) AS taken
FROM mixed GROUP BY r
"""


@query("op10_fair_mix", MIX_SQL)
def op10_fair_mix(spark, sf_dir):
    return fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op8_integer_top_k", TOP_SQL)
def op8_integer_top_k(spark, sf_dir):
    return integer_search(table(spark, sf_dir, "embeddings"))


NGRAM_SQL = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
grams AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * n_both >= 85 * (na + nb - n_both)),
reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, any_value(CAST(len(s.s) AS BIGINT)) AS n_shingles, min(t.doc_id) AS component_id
FROM reach JOIN sets s ON s.r = reach.a JOIN sets t ON t.r = reach.b GROUP BY s.r, s.doc_id
"""


@query("op4_ngram_jaccard", NGRAM_SQL)
def op4_ngram_jaccard(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))


@query("op9_pack")
def op9_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH RECURSIVE split AS (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS l FROM documents),
lines AS (SELECT *, list_distinct(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM split),
placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, line) AS t, list_sort(w) AS s FROM lines WHERE len(w) > 0),
sets AS MATERIALIZED (SELECT min(t) AS t, any_value(s) AS s, len(any_value(s)) AS n FROM placed GROUP BY s),
words AS MATERIALIZED (SELECT w, count(*) AS df FROM (SELECT unnest(s) AS w FROM sets) GROUP BY w),
ranked AS MATERIALIZED (SELECT u.t, u.n, u.w, row_number() OVER (PARTITION BY u.t ORDER BY d.df, u.w) AS place
    FROM (SELECT t, n, unnest(s) AS w FROM sets) u JOIN words d ON d.w = u.w),
prefix AS MATERIALIZED (SELECT t, n, w FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.t AS t, b.t AS e FROM prefix a JOIN prefix b ON a.w = b.w AND b.t < a.t AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
near AS MATERIALIZED (SELECT DISTINCT p.t FROM pairs p JOIN sets x ON x.t = p.t JOIN sets y ON y.t = p.e
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
gone AS MATERIALIZED (SELECT p.doc_id, p.line FROM placed p JOIN sets s ON s.s = p.s WHERE p.t > s.t OR s.t IN (SELECT t FROM near)),
kept AS (SELECT s.doc_id, s.line, s.l, g.doc_id IS NOT NULL AS gone FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.line = s.line)
SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed
FROM kept GROUP BY doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))

"""Queries over documents and conversations: token ids, the prefix trie, spelling variants."""

from __future__ import annotations

from buslens.llm.common import table
from buslens.llm.prefix_bpe import encode_decode
from buslens.llm.prefix_trie import prefix_trie
from buslens.llm.registry import query
from buslens.llm.spelling import spelling_variants

#: crc32 in SQL: a table of its 256 steps worked out by the rule, and a fold over the bytes of a text of ASCII and two-byte letters.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""


def crc_sql(text: str) -> str:
    code = f"list_transform(string_split({text}, ''), lambda ch: unicode(ch))"
    codes = f"flatten(list_transform({code}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform({codes}, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


@query("op11_prefix_bpe")
def op11_prefix_bpe(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""
WITH {CRC_TABLE},
own AS MATERIALIZED (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS MATERIALIZED (SELECT c, {crc_sql("CAST(c AS VARCHAR)")} % 9 AS h FROM own, crc),
rebuilt AS MATERIALIZED (SELECT o.c, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) AS turns FROM own o JOIN heads USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 5),
steps AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt),
paths AS MATERIALIZED (SELECT c, d, turns[1:d] AS path, d = len(turns) AS ends FROM steps),
nodes AS MATERIALIZED (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
    FROM paths GROUP BY path, d),
kids AS MATERIALIZED (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
weighed AS MATERIALIZED (SELECT n.path, n.d, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.path[n.d].t) END AS saved
    FROM nodes n LEFT JOIN kids k ON k.path = n.path AND k.d = n.d),
sums AS MATERIALIZED (SELECT path[1:a] AS path, a AS d, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM weighed) GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
    CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path AND s.d = n.d LEFT JOIN kids k ON k.path = n.path AND k.d = n.d LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
seen AS MATERIALIZED (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS MATERIALIZED (SELECT run, n, {crc_sql("id || ':' || run")} AS h FROM seen, crc),
results AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS size FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS MATERIALIZED (SELECT word, n, size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word),
shifted AS (SELECT DISTINCT g.word, g.n, w.word AS other, w.n AS other_n FROM gaps g JOIN words w ON w.word = g.rest),
near AS MATERIALIZED (SELECT * FROM pairs UNION ALL SELECT * FROM shifted UNION ALL SELECT other, other_n, word, n FROM shifted),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 2 * n),
ways AS (SELECT word, form AS goal FROM forms UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON f.word = w.goal),
ends AS (SELECT word, goal AS root FROM ways WHERE goal NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(l.root, w.word) AS root, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN ends l USING (word)
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))

"""SQL for the corpus queries that SQL can express (DuckDB)."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

WEB_ARCHIVE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(encode(coalesce(html, ''))) AS h FROM pages
), f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, octet_length(encode(p.body))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4)::INT)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (body)
"""

QUALITY = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(list_aggregate(words || [''], 'string_agg', ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
    len(regexp_extract_all(text, '[A-Z]')) AS upper, len(regexp_extract_all(text, '[A-Za-z]')) AS letters, len(regexp_extract_all(text, '[!?]')) AS marks,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS echoes
  FROM w
), windows AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 7], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), repeated AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), r AS (SELECT doc_id, sum(least(8, coalesce(following - i, 8)))::BIGINT AS n FROM repeated GROUP BY doc_id)
, q AS (
  SELECT doc_id, n_words, word_chars, n_symbols, upper, letters, marks, echoes, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM m LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > word_chars OR word_chars > 40 * n_words OR 5 * n_dup_lines > 4 * n_lines
    OR 5 * upper > 4 * letters OR marks > n_words OR 2 * echoes > n_words) AS kept
FROM b
"""

VORONOI = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

LEXICAL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term)
, d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id)
, a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d)
, q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf CROSS JOIN a GROUP BY term
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id) CROSS JOIN a GROUP BY item_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_web_archive": WEB_ARCHIVE, "op9_voronoi_knn": VORONOI, "op10_quality_cascade": QUALITY, "op11_lexical_search": LEXICAL}

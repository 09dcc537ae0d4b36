"""DuckDB SQL of the text queries that SQL can express: brute force over all windows, pairs and turns."""

from __future__ import annotations

import string

_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_HITS = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pattern AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS k
  FROM (SELECT *, least(10, len(w)) AS size FROM item WHERE len(w) > 0),
    LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
doc AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
place AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS k
  FROM doc, (SELECT DISTINCT size FROM pattern), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)),
match AS MATERIALIZED (SELECT doc_id, i, size, item_id FROM place JOIN pattern USING (size, k)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM match)
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM match) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

_JACCARD = f"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce({_TOKENS}, []) AS w FROM documents),
shingle AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS k
  FROM doc, LATERAL (SELECT unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i) WHERE len(w) > 0),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
whole AS MATERIALIZED (SELECT doc_id, string_agg(k, chr(10) ORDER BY k) AS s FROM shingle GROUP BY doc_id),
number AS (
  SELECT a AS doc_id, count(DISTINCT y.s) AS n_links
  FROM link JOIN whole x ON x.doc_id = a JOIN whole y ON y.doc_id = b WHERE x.s <> y.s GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles,
  least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id,
  coalesce(n_links, 0) AS n_links
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN number USING (doc_id)"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
placed AS (
  SELECT *, sum(length(role) + length(regexp_replace(text, '<(\|+)', '<|\1', 'g')) + 24)
      OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR last)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR last) AS n_examples
FROM placed GROUP BY conv_id"""

_NEGATIVES = """
WITH item AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS positive,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM item a JOIN item b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
chosen AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE positive
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM chosen JOIN scored USING (anchor_id)
WHERE NOT positive AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_hits": _HITS,
        "op3_chat_examples": _CHAT,
        "op4_ngram_jaccard": _JACCARD,
        "op12_hard_negatives": _NEGATIVES,
    }

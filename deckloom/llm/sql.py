"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

#: Water-filling as one sorted pass: sources reach their limit in the order of
#: size / weight, so the level follows from prefix sums over that order.
MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight
  FROM docs GROUP BY source),
sorted AS (
  SELECT *, sum(2 * source_size) OVER w - 2 * source_size AS fixed, sum(weight) OVER () - sum(weight) OVER w + weight AS rest,
    sum(source_size) OVER () AS total, row_number() OVER w AS place
  FROM sources WINDOW w AS (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST)),
level AS (
  SELECT coalesce(arg_min((1.5 * total - fixed)::DOUBLE / rest::DOUBLE, place) FILTER (WHERE (1.5 * total - fixed) / rest * weight <= 2 * source_size), 0) AS level
  FROM sorted),
targets AS (
  SELECT source, source_size, least(level * weight, (2 * source_size)::DOUBLE) AS target FROM sources, level),
placed AS (
  SELECT doc_id, docs.source, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, source, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""


CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(role, '(\\|<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1.', 'g'))
    + length(regexp_replace(text, '(\\|<\|im_start\|>|<\|im_sep\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\1.', 'g')) + 32 AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: All pairs that share a shingle, and what each document reaches.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 2 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
steps AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS node FROM words UNION SELECT doc_id, y FROM reached JOIN steps ON node = x)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(node) AS component_id, doc_id = min(node) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op2_chat": CHAT, "op7_mixing": MIXING, "op8_neardup": NEAR_DUPLICATES}

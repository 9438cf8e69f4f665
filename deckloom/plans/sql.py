"""DuckDB SQL for the queries, by name."""

from __future__ import annotations

from deckloom.functions.images import DIAGRAM_HINT_SUFFIX, HINTS
from deckloom.operators import validate as v
from deckloom.plans.views import STRUCTURE

NL = "chr(10)"
SEPARATOR = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
BLANK = "chr(10) || chr(10)"


def _quoted(text: str) -> str:
    """A literal; line feeds and vertical tabs by their codes."""
    out = "'" + text.replace("'", "''") + "'"
    return out.replace("\n", "' || chr(10) || '").replace("\x0b", "' || chr(11) || '")


def rough(x: str) -> str:
    return f"replace(replace({x}, ' the ', '  the' || chr(11)), ' de ', ' ' || chr(9) || ' de ')"


def norm(x: str) -> str:
    return f"regexp_replace(replace({x}, chr(11), chr(10)), '[ \\t]{{2,}}', ' ', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def masked(x: str) -> str:
    mail = f"regexp_replace({x}, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}', '[REDACTED]', 'g')"
    return f"regexp_replace({mail}, '0\\d{{1,2}}[-.\\s]\\d{{3,4}}[-.\\s]\\d{{4}}', '[REDACTED]', 'g')"


def paragraphs(lines: str, line: str, level: str) -> str:
    mark = f"CASE WHEN {level} > 0 THEN repeat('  ', {level}) || '- ' ELSE '' END"
    joined = f"coalesce(array_to_string(list_transform({lines}, lambda x, i: {mark} || {line}), {NL}), '')"
    return collapse(joined)


def joined(*parts: str) -> str:
    """Non-empty parts with blank lines between them."""
    listed = ", ".join(parts)
    return f"array_to_string(list_filter([{listed}], lambda x: x != ''), {BLANK})"


DOC_LEVEL = "(length(x) % 3)::BIGINT"
DOC_LINES = "SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents"
DOC_BODY = paragraphs("lines[2:]", norm(rough("x")), DOC_LEVEL)
DOC_MASKED = paragraphs("lines[2:]", masked(norm(rough("x"))), DOC_LEVEL)
DOC_HEADING = "'## ' || CASE WHEN lines[1] = '' THEN 'Slide ' || (doc_id + 1) ELSE lines[1] END"
TURN_BODY = collapse(norm("text"))


def deck(blocks: str, key: str, order: str) -> str:
    return f"SELECT {key} AS deck_id, coalesce(string_agg(block, {SEPARATOR} ORDER BY {order}) FILTER (WHERE block IS NOT NULL), '') AS markdown FROM ({blocks}) GROUP BY ALL"


def turns(*more: str, before: str = "''") -> str:
    return f"SELECT conv_id::VARCHAR AS conv, turn, role, {before} || {joined(chr(39) + '## ' + chr(39) + ' || role', TURN_BODY, *more)} AS block FROM conversations"


NOTES = (
    f"CASE WHEN {strip('text')} = '' THEN '' ELSE '> notes' || chr(10) || '> ' || replace(replace(text, ' ', chr(10)), chr(10), chr(10) || '> ') END"
)
COMMENT = "'<!-- slide_index: ' || (turn + 1) || ' | section: ' || role || ' | has_diagram: false -->' || chr(10)"

CELLS = (
    "SELECT l_orderkey, [['part', 'supplier', 'quantity', 'flags']] || list([l_partkey::VARCHAR, l_suppkey || chr(10) || '<' || l_linenumber || '>', "
    "l_quantity::INT::VARCHAR, l_returnflag || '|' || l_linestatus] "
    "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_returnflag, l_linestatus) AS rows FROM lineitem GROUP BY l_orderkey"
)


def lines(*parts: str) -> str:
    return f"array_to_string({' || '.join(parts)}, chr(10))"


SANE = "replace(replace(replace(c, chr(11), '<br>'), chr(10), '<br>'), '|', '\\|')"
PIPED = f"'| ' || array_to_string(list_transform(r, lambda c: {SANE}), ' | ') || ' |'"
FLAT = "array_to_string(list_transform(r, lambda c: replace(replace(c, chr(11), ' '), chr(10), ' ')), ' | ')"
ESCAPED = "replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
GFM = lines(
    f"list_transform(rows[1:1], lambda r: {PIPED})",
    "['| ' || array_to_string(list_transform(rows[1], lambda c: '---'), ' | ') || ' |']",
    f"list_transform(rows[2:], lambda r: {PIPED})",
)


def fenced(fence: str, mark: str) -> str:
    return lines(
        f"['```{fence}', '{mark}table: ' || len(rows) || 'x4']",
        f"list_transform(rows[1:1], lambda r: '{mark}headers: ' || {FLAT})",
        f"list_transform(rows[2:], lambda r, i: '{mark}row ' || i || ': ' || {FLAT})",
        "['```']",
    )


HTML = lines(
    "['<table>']",
    "flatten(list_transform(rows, lambda r, i: ['  <tr>'] || list_transform(r, lambda c: '    <' || CASE WHEN i = 1 THEN 'th' ELSE 'td' END || '>' || "
    f"{ESCAPED} || '</' || CASE WHEN i = 1 THEN 'th' ELSE 'td' END || '>') || ['  </tr>']))",
    "['</table>']",
)


def of_tables(markdown: str) -> str:
    return f"SELECT l_orderkey, {markdown} AS markdown FROM ({CELLS})"


PARTS = """
SELECT p_brand AS deck_id, p_size::INT AS slide_index, p_partkey AS k, p_name, p_type,
  ['text', 'image', 'other', 'text', 'image', 'table', 'text', 'group'][p_partkey % 8 + 1] AS kind,
  (p_partkey * 37 % 11 - 3) * 310000 AS top, p_partkey * 53 % 17 * 61000 AS lft,
  ['LINE', 'CHART', 'UNKNOWN', 'CONNECTOR', 'LINE'][p_partkey % 5 + 1] AS label,
  [NULL, 'diagram', 'photo'][p_partkey % 3 + 1] AS class,
  CASE WHEN p_partkey % 6 = 1 THEN p_name ELSE '' END AS alt, CASE WHEN p_partkey % 16 = 4 THEN p_type END AS description
FROM part
"""
MARKER = """CASE WHEN description IS NOT NULL THEN description || coalesce(chr(10) || chr(10) || '_[' || class || ' image]_', '')
  WHEN alt != '' THEN '![' || alt || '](...)'
  ELSE '![슬라이드 ' || {slide} || ' 이미지 ' || {number} || coalesce(' — ' || class, '') || ']' END"""
SLIDES_OF_PARTS = f"""
shapes AS ({PARTS}),
placed AS (
  SELECT *, min(k) FILTER (WHERE kind = 'text' AND k % 21 = 0 AND {strip("p_name")} != '') OVER (PARTITION BY deck_id, slide_index) AS title_k,
    row_number() OVER (PARTITION BY deck_id, slide_index, kind = 'image' ORDER BY floor(top / 914400), lft, k) AS number
  FROM shapes),
parts AS (
  SELECT *, CASE kind WHEN 'text' THEN {norm("p_name")} WHEN 'image' THEN {MARKER.format(slide="(slide_index + 1)", number="number")}
    WHEN 'other' THEN CASE WHEN k % 7 = 2 THEN '' ELSE p_type END
    WHEN 'table' THEN '| name | type |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_type || ' |' ELSE '' END AS part
  FROM placed),
slide_texts AS (
  SELECT deck_id, slide_index, '## ' || coalesce(max({strip("p_name")}) FILTER (WHERE k = title_k), 'Slide ' || (slide_index + 1)) ||
    coalesce({BLANK} || string_agg(part, {BLANK} ORDER BY floor(top / 914400), lft, k)
      FILTER (WHERE part != '' AND k IS DISTINCT FROM title_k AND NOT (kind = 'text' AND k % 9 = 0)), '') AS markdown
  FROM parts GROUP BY deck_id, slide_index)
"""

WIDE = """(len({x}) >= 3 AND list_reduce(list_transform(list_sort({x}), lambda q: {{'n': 1, 'last': q}}),
  lambda p, q: CASE WHEN q.last - p.last >= 100000 THEN {{'n': p.n + 1, 'last': q.last}} ELSE p END).n >= 3)"""
COLUMNS = f"""
bands AS (
  SELECT deck_id, slide_index, list_reduce(list({{'anchor': top, 'lefts': [lft], 'hit': false}} ORDER BY top, lft),
    lambda a, e: CASE WHEN e.anchor - a.anchor > 250000
      THEN {{'anchor': e.anchor, 'lefts': e.lefts, 'hit': a.hit OR {WIDE.format(x="a.lefts")}}}
      ELSE {{'anchor': a.anchor, 'lefts': a.lefts || e.lefts, 'hit': a.hit}} END) AS band
  FROM __ROWS__ GROUP BY ALL),
columns AS (SELECT deck_id, slide_index, band.hit OR {WIDE.format(x="band.lefts")} AS columns FROM bands)
"""
SCORES = f"""
{COLUMNS.replace("__ROWS__", "(SELECT * FROM shapes WHERE kind = 'text')")},
scores AS (
  SELECT deck_id, slide_index, ((count(*) > 8)::INT + 4 * coalesce(any_value(columns), false)::INT
    + 4 * (count(*) FILTER (WHERE kind = 'other' AND label IN ('LINE', 'CONNECTOR')) >= 2)::INT
    + 4 * bool_or(kind = 'other' AND label IN ('CHART', 'DIAGRAM'))::INT + 2 * bool_or(kind = 'table')::INT + 2 * bool_or(kind = 'group')::INT)::INT AS score
  FROM shapes LEFT JOIN columns USING (deck_id, slide_index) GROUP BY ALL)
"""

HINT = (
    "CASE {class} " + " ".join(f"WHEN '{k}' THEN {_quoted(t)}" for k, t in HINTS.items()) + " END"
)
IMAGES = """
SELECT sha256(text) AS hash, doc_id, strlen(text) AS size, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext,
  CASE WHEN doc_id % 3 = 0 THEN 'photo' WHEN doc_id % 3 = 1 THEN 'logo' END AS class
FROM documents WHERE strlen(text) > 0
"""

_structured = "text"
for _old, _new in STRUCTURE:
    _structured = f"replace({_structured}, {_quoted(_old)}, {_quoted(_new)})"

BARE = strip("line")
_ROW = f"string_split(replace({BARE}, '\\|', chr(1)), '|')"
ROW_CELLS = f"list_slice({_ROW}, 1 + ({_ROW}[1] = '')::INT, len({_ROW}) - (len({_ROW}) > 1 AND {_ROW}[-1] = '')::INT)"
IS_RULE = f"(len({ROW_CELLS}) > 0 AND len(list_filter({ROW_CELLS}, lambda c: NOT regexp_full_match({strip('c')}, ':?-+:?'))) = 0)"


def validation(docs: str) -> str:
    q = _quoted
    return f"""
WITH docs AS ({docs}),
split AS (SELECT doc_id, string_split(replace(coalesce(md, ''), chr(11), chr(10)), chr(10)) AS all_lines FROM docs),
cut_lines AS (SELECT doc_id, CASE WHEN all_lines[-1] = '' AND len(all_lines) > 1 THEN all_lines[:-2] ELSE all_lines END AS lines FROM split),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM cut_lines),
a AS (
  SELECT *, {BARE} AS bare, starts_with(line, '```') AS fence, nullif(length(regexp_extract(line, '^(#{{1,6}})( |$)', 1)), 0) AS level,
    coalesce(sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fences,
    min(pos) FILTER (WHERE {BARE} != '') OVER (PARTITION BY doc_id) AS opens
  FROM l),
b AS (
  SELECT *, bool_or(pos = opens AND bare = '---') OVER (PARTITION BY doc_id) AS front,
    min(pos) FILTER (WHERE bare = '---' AND pos > opens) OVER (PARTITION BY doc_id) AS closes FROM a),
c AS (SELECT *, CASE WHEN front THEN coalesce(closes, 0) ELSE 0 END AS last_front FROM b),
d AS (
  SELECT *, pos > last_front AS body, (fences - sum((fence AND pos <= last_front)::INT) OVER (PARTITION BY doc_id)) % 2 = 1 AS in_code,
    CASE WHEN NOT fence AND fences % 2 = 0 THEN level END AS here FROM c),
e AS (
  SELECT *, body AND NOT fence AND NOT in_code AS plain, body AND NOT in_code AND regexp_full_match(bare, '-{{3,}}') AS cut FROM d),
f AS (
  SELECT *, plain AND contains(replace(line, '\\|', ''), '|') AS pipe, CASE WHEN plain AND level IS NOT NULL THEN {strip("substr(line, level + 1)")} END AS heading,
    plain AND level IS NULL AND bare != '' AS content FROM e),
g AS (
  SELECT *, last_value(here IGNORE NULLS) OVER before AS above, last_value(heading IGNORE NULLS) OVER before AS title_before,
    max(pos) FILTER (WHERE heading IS NOT NULL) OVER before AS title_pos, max(pos) FILTER (WHERE content) OVER before AS content_pos,
    sum((NOT pipe)::INT) OVER upto AS island, sum(cut::INT) OVER upto AS block
  FROM f WINDOW before AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    upto AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
runs AS (
  SELECT doc_id, island, pos, line, {ROW_CELLS} AS cells, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS nth FROM g WHERE pipe),
tables AS (
  SELECT doc_id, min(pos) AS pos, bool_or(nth = 2 AND {IS_RULE}) AS is_table, count(*) FILTER (WHERE nth > 2) AS n_data, max(len(cells)) FILTER (WHERE nth = 1) AS width,
    list(len(cells)) FILTER (WHERE nth > 2) AS widths,
    NOT coalesce(bool_or(len(list_filter(cells, lambda c: {strip('c')} != '')) > 0) FILTER (WHERE nth > 2), false) AS blank
  FROM runs GROUP BY doc_id, island),
notes AS (
  SELECT doc_id, 3 AS rule, pos, 0 AS sub, {q(v.HEADING_START)} AS message FROM g WHERE here > 2 AND above IS NULL
  UNION ALL SELECT doc_id, 3, pos, 0, format('헤딩 레벨 점프: h{{}}에서 h{{}}로 2단계 이상 깊어졌습니다.', above, here) FROM g WHERE here > above + 1
  UNION ALL SELECT doc_id, 5, pos, 0, {q(v.TABLE_NO_DATA)} FROM tables WHERE is_table AND n_data = 0
  UNION ALL SELECT doc_id, 5, pos, 0, {q(v.TABLE_MISMATCH)} FROM tables WHERE is_table AND n_data > 0 AND len(list_filter(widths, lambda x: x != width)) > 0
  UNION ALL SELECT doc_id, 5, pos, 1, {q(v.TABLE_BLANK)} FROM tables WHERE is_table AND n_data > 0 AND blank
  UNION ALL SELECT doc_id, 6, pos, 0, {q(v.DUPLICATE_HEADING)} FROM g WHERE heading = title_before AND coalesce(content_pos, 0) < title_pos
  UNION ALL SELECT doc_id, 2, 0, 0, {q(v.UNCLOSED_FENCE)} FROM docs WHERE len(regexp_extract_all(md, '```')) % 2 = 1
  UNION ALL SELECT doc_id, 4, 0, 0, '제어문자 \\v 잔존: ' || (length(md) - length(replace(md, chr(11), ''))) || '개.' FROM docs WHERE contains(md, chr(11))
  UNION ALL SELECT doc_id, 7, 0, 0, {q(v.EMPTY_SLIDE)} FROM (
    SELECT doc_id, sum(cut::INT) + 1 - count(DISTINCT block) FILTER (WHERE body AND NOT fence AND NOT cut AND bare != ''
      AND (in_code OR (level IS NULL AND NOT (starts_with(bare, '<!--') AND ends_with(bare, '-->'))))) AS n FROM g GROUP BY doc_id), LATERAL (SELECT unnest(range(n::BIGINT)))),
told AS (SELECT doc_id, string_agg(message, chr(10) ORDER BY rule, pos, sub, message) AS warnings FROM notes GROUP BY doc_id)
SELECT doc_id, {strip("coalesce(md, '')")} != '' AND len(regexp_extract_all(coalesce(md, ''), '```')) % 2 = 0 AS valid,
  CASE WHEN {strip("coalesce(md, '')")} = '' THEN {q(v.EMPTY)} ELSE coalesce(warnings, '') END AS warnings
FROM docs LEFT JOIN told USING (doc_id)
"""


TWO_LINES = "['| h | v |', '| --- | --- |', '| ' || replace(lines[1], '|', '\\|') || ' | ' || len(lines) || ' |']"
DECK_TEXT = paragraphs("lines[2:]", norm("x"), "((i - 1) % 2)::BIGINT")

ORACLES: dict[str, str] = {
    "assemble_document_decks": deck(f"SELECT *, {joined(DOC_HEADING, DOC_BODY)} AS block FROM ({DOC_LINES})", "source", "doc_id"),
    "assemble_conversation_decks": deck(turns(), "conv", "turn, role"),
    "assemble_with_notes": deck(turns(NOTES), "conv", "turn, role"),
    "frontmatter_and_comments": (
        f"SELECT deck_id, '---' || chr(10) || 'generator: deckloom' || chr(10) || 'slide_count: ' || n || chr(10) || '---' || {BLANK} || markdown AS markdown "
        f"FROM ({deck(turns(before=COMMENT), 'conv', 'turn, role')}) JOIN (SELECT conv_id::VARCHAR AS deck_id, count(*) AS n FROM conversations GROUP BY ALL) USING (deck_id)"
    ),
    "single_slides": f"SELECT source AS deck_id, doc_id::INT AS slide_index, {joined(DOC_HEADING, DOC_BODY)} AS markdown FROM ({DOC_LINES})",
    "toc_filter": deck(
        f"SELECT source, place, CASE WHEN {strip('body')} = '' THEN CASE WHEN title != '' THEN '## ' || title END "
        f"ELSE {joined('CASE WHEN title = ' + chr(39) * 2 + ' THEN ' + chr(39) + '## Slide ' + chr(39) + ' || (place + 1) ELSE ' + chr(39) + '## ' + chr(39) + ' || title END', 'body')} END AS block "
        f"FROM (SELECT source, doc_id AS place, lines[1] AS title, {DOC_BODY} AS body FROM ({DOC_LINES}) "
        f"UNION ALL SELECT source, doc_id + 10000000, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lines[1] END, '' FROM ({DOC_LINES}))",
        "source",
        "place",
    ),
    "masked_documents": deck(f"SELECT *, {joined(DOC_HEADING, DOC_MASKED)} AS block FROM ({DOC_LINES})", "source", "doc_id"),
    "normalize_text": f"SELECT doc_id, {collapse(norm('replace(' + rough('text') + ', chr(10), chr(10) || chr(10) || chr(10))'))} AS clean FROM documents",
    "mask_default": f"SELECT doc_id, {masked('replace(text, ' + chr(39) + ' the ' + chr(39) + ', ' + chr(39) + ' 010-1234-5678 ' + chr(39) + ')')} AS masked FROM documents",
    "mask_custom": "SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[A-Z][a-z]+', '[REDACTED]', 'g'), '\\d+', '[REDACTED]', 'g') AS masked FROM conversations",
    "heading_hierarchy": (
        "SELECT c_custkey, '## ' || r_name || chr(10) || '### ' || n_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || '#### ' || c_name END AS headings, "
        "r_name AS section FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    ),
    "notes_blocks": f"SELECT conv_id, turn, {NOTES} AS notes FROM conversations UNION ALL SELECT conv_id, turn + 1000000, '' FROM conversations",
    "gfm_table": of_tables(GFM),
    "mermaid_table": of_tables(fenced("mermaid", "%% ")),
    "table_data": of_tables(fenced("table-data", "")),
    "html_table": of_tables(HTML),
    "table_markdown": of_tables(
        "CASE WHEN len(rows) * 12 > 50 OR len(list_filter(rows, lambda r: r[1] = r[2] OR r[2] = r[3] OR r[3] = r[4])) > 0 " f"THEN {HTML} ELSE {GFM} END"
    ),
    "ragged_table": (
        f"SELECT p_partkey, {lines('[' + chr(39) + '| a | b |' + chr(39) + ', ' + chr(39) + '| --- | --- |' + chr(39) + ']', 'list_transform(rows, lambda r: ' + chr(39) + '| ' + chr(39) + ' || coalesce(' + SANE.replace('c,', 'r[1],') + ', ' + chr(39) * 2 + ') || ' + chr(39) + ' | ' + chr(39) + ' || coalesce(' + SANE.replace('c,', 'r[2],') + ', ' + chr(39) * 2 + ') || ' + chr(39) + ' |' + chr(39) + ')')} AS markdown "
        "FROM (SELECT p_partkey, [string_split(p_name, ' ')[1:p_partkey % 4 + 1], [p_brand]] AS rows FROM part)"
    ),
    "complex_table_flag": (
        "SELECT p_partkey, (p_size + 1) * (p_partkey % 11) > 50 OR p_partkey % 11 > 8 OR p_partkey % 3 = 0 AS is_complex, p_partkey % 5 = 0 AS is_blank FROM part"
    ),
    "table_rows": (
        "SELECT p_partkey, ' ' || p_name || ' | ' || p_type || ' ' || chr(10) || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END AS cells, "
        "p_partkey % 3 = 0 AS is_separator FROM part"
    ),
    "heading_levels": "SELECT p_partkey, CASE WHEN p_partkey % 9 BETWEEN 1 AND 6 THEN (p_partkey % 9)::INT END AS level FROM part",
    "reading_ranks": (
        f"SELECT deck_id, slide_index, k::INT AS shape_id, row_number() OVER (PARTITION BY deck_id, slide_index ORDER BY floor(top / 914400), lft, k) AS rank FROM ({PARTS})"
    ),
    "image_numbering": f"WITH {SLIDES_OF_PARTS} SELECT * FROM slide_texts",
    "image_markers": f"SELECT k::INT AS shape_id, {MARKER.format(slide='slide_index', number='k')} AS marker FROM ({PARTS})",
    "image_classes": """
      WITH f AS (SELECT p_partkey, p_partkey * 7 % 256 + 1 AS w, p_partkey * 13 % 256 + 1 AS h, p_partkey * 31 % 300 AS colors,
        (p_partkey * 17 % 100) / 100 AS colorful, (p_partkey * 11 % 40) / 100 AS edge, (p_partkey * 19 % 100) / 100 AS bg FROM part)
      SELECT p_partkey, CASE WHEN edge >= 0.08::DOUBLE AND colors <= 32 AND bg >= 0.35::DOUBLE AND colorful < 0.05::DOUBLE THEN 'text'
        WHEN (w * h <= 16384 OR w / h >= 3) AND colors <= 48 AND (p_partkey % 5 = 0 OR bg >= 0.30::DOUBLE) THEN 'logo'
        WHEN colors <= 128 AND bg >= 0.25::DOUBLE AND edge >= 0.02::DOUBLE AND edge < 0.30::DOUBLE AND colorful < 0.80::DOUBLE THEN 'diagram'
        WHEN colors >= 200 AND colorful >= 0.30::DOUBLE THEN 'photo' END AS class FROM f""",
    "hints_and_prompts": (
        f"SELECT p_partkey, concat_ws(' ', {HINT.format(**{'class': 'class'})} || CASE WHEN class = 'diagram' THEN ' ' || {_quoted(DIAGRAM_HINT_SUFFIX)} ELSE '' END, "
        "CASE WHEN p_partkey % 2 = 0 THEN 'Alt text: ' || p_name END, 'Describe this image in detail.') AS prompt, "
        "['image/png', 'image/jpeg', 'image/jpeg', 'image/gif', 'image/webp', 'image/png'][p_partkey % 6 + 1] AS media_type, false AS is_vector "
        "FROM (SELECT *, ['text', 'diagram', 'photo', 'logo', NULL][p_partkey % 5 + 1] AS class FROM part)"
    ),
    "embedded_images": "SELECT p_partkey, '![slide render](data:image/png;base64,' || base64(repeat(p_name, 5)::BLOB) || ')' || chr(10) || chr(10) AS line FROM part",
    "complexity": f"WITH shapes AS ({PARTS}), {SCORES} SELECT deck_id, slide_index, score, score >= 4 AS is_complex FROM scores",
    "multi_column": f"WITH shapes AS ({PARTS}), {COLUMNS.replace('__ROWS__', 'shapes')} SELECT * FROM columns",
    "routing": (
        f"WITH shapes AS ({PARTS}), {SCORES} SELECT deck_id, slide_index, score FROM scores WHERE (score >= 4 OR slide_index IN (1, 2, 3)) AND slide_index NOT IN (3, 4) "
        "QUALIFY row_number() OVER (PARTITION BY deck_id ORDER BY score DESC, slide_index) <= 5"
    ),
    "describe_once": (
        f"WITH i AS ({IMAGES}), g AS (SELECT hash, arg_min(ext, doc_id) AS ext, arg_min(coalesce(class, ''), doc_id) AS class, any_value(size) AS size FROM i GROUP BY hash) "
        f"SELECT documents.doc_id, g.ext || ' of ' || g.size || ' bytes: ' || coalesce({HINT.format(**{'class': 'g.class'})}, 'no hint') AS description "
        "FROM documents LEFT JOIN i USING (doc_id) LEFT JOIN g ON i.hash = g.hash"
    ),
    "image_hash_groups": (
        f"SELECT hash, count(*) AS n_shapes, arg_min(ext, doc_id) AS extension, nullif(arg_min(coalesce(class, ''), doc_id), '') AS classification FROM ({IMAGES}) GROUP BY hash"
    ),
    "reconstruct_routed": f"""
      WITH {SLIDES_OF_PARTS}, {SCORES},
      chosen AS (SELECT deck_id, slide_index, deck_id || ' ' || (slide_index % 7) AS png FROM scores WHERE score >= 4 AND slide_index != 5
        QUALIFY row_number() OVER (PARTITION BY deck_id ORDER BY score DESC, slide_index) <= 9),
      rendered AS (SELECT *, min(slide_index) OVER (PARTITION BY deck_id, png) AS rep FROM chosen WHERE slide_index % 10 != 9)
      SELECT r.deck_id, r.slide_index, '![slide render](data:image/png;base64,' || base64(png::BLOB) || ')' || {BLANK} || '### rebuilt ' || rep || {BLANK} ||
        length(markdown) || ' characters, ' || strlen(png) || ' bytes' AS reconstructed_md
      FROM rendered r JOIN slide_texts s ON s.deck_id = r.deck_id AND s.slide_index = rep""",
    "suppress_labels": f"""
      WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN 'other' ELSE ' same label ' END AS label FROM conversations),
      p AS (SELECT *, lag(trim(label)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t)
      SELECT conv_id::VARCHAR AS deck_id, turn::BIGINT AS slide_index, '## ' || role || {BLANK} || CASE WHEN before = trim(label) THEN 'kept ' || turn
        ELSE label || {BLANK} || 'kept ' || turn || chr(10) || label END AS block FROM p""",
    "flowcharts": f"""
      SELECT doc_id, CASE WHEN doc_id % 5 != 0 AND doc_id % 3 != 2 THEN '```mermaid' || chr(10) || regexp_replace(
        CASE doc_id % 3 WHEN 0 THEN 'flowchart TD' ELSE 'Graph LR;' END || chr(10) || array_to_string(list_transform(
          string_split(replace(replace(text, '```', chr(39) || chr(39) || chr(39)), ' ', ' ' || chr(10)), chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), chr(10)), '\\s+$', '')
        || chr(10) || '```' END AS fence FROM documents""",
    "validate_structure": validation(f"SELECT doc_id, {_structured} AS md FROM documents"),
    "validate_plain": validation("SELECT doc_id, text AS md FROM documents UNION ALL SELECT -1 - doc_id, NULL FROM documents"),
    "deck_source": (
        "SELECT doc_id::VARCHAR AS deck_id, 0 AS slide_index, 0 AS place, true AS is_title, '0 ' || lines[1] AS paragraphs FROM (" + DOC_LINES + ") UNION ALL "
        "SELECT doc_id::VARCHAR, 0, 1, false, coalesce(array_to_string(list_transform(lines[2:], lambda x, i: ((i - 1) % 2) || ' ' || x), chr(10)), '') FROM (" + DOC_LINES + ")"
    ),
    "convert_decks": (
        f"SELECT doc_id::VARCHAR AS deck_id, {joined(DOC_HEADING.replace('doc_id + 1', '1'), DECK_TEXT)} || {SEPARATOR} || "
        f"'## Slide 2' || {BLANK} || array_to_string({TWO_LINES}, chr(10)) AS markdown FROM ({DOC_LINES})"
    ),
    "pixel_features": (
        "SELECT p_partkey AS shape_id, (p_partkey % 30 + 1)::INT AS width, (p_partkey % 20 + 1)::INT AS height, 1 AS n_unique_colors, "
        "CASE WHEN p_partkey % 256 >= 40 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS color_fraction, 0.0::DOUBLE AS edge_density, 1.0::DOUBLE AS bg_fraction, "
        "false AS has_alpha, 'logo' AS class FROM part"
    ),
}

ORACLES["convert_rich_decks"] = f"""
  SELECT p_partkey::VARCHAR AS deck_id, '## ' || p_name || {BLANK} || '![슬라이드 1 이미지 1]' || {BLANK} || p_type || ' series ' || p_name || ' ' || p_brand
    || {BLANK} || p_brand || ' ' || p_type || {BLANK} || '> notes' || chr(10) || '> ' || p_name || chr(10) || '> ' || p_brand || {SEPARATOR}
    || '## Slide 2' || {BLANK} || p_name || {BLANK} || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_brand || ' | ' || p_name || ' |'
    || {BLANK} || p_type || chr(10) || '  - ' || p_brand AS markdown, true AS valid, '' AS warnings FROM part
"""
ORACLES["rich_shapes"] = """
  WITH kinds(slide_index, place, kind) AS (VALUES (0, '0', 'text'), (0, '1', 'image'), (0, '2', 'other'), (0, '3', 'other'), (0, '4', 'other'),
    (1, '0', 'group'), (1, '0.0', 'text'), (1, '0.1', 'table'), (1, '0.2', 'group'), (1, '0.2.0', 'text'))
  SELECT p_partkey::VARCHAR AS deck_id, slide_index, place, kind, CASE WHEN slide_index = 0 AND place = '2' THEN p_type || ' series ' || p_name || ' ' || p_brand
    WHEN slide_index = 0 AND place = '3' THEN p_brand || ' ' || p_type ELSE '' END AS fallback_text FROM part, kinds
"""
_LINE = norm(rough("x"))
ORACLES["masking_counts"] = f"""
  SELECT source AS deck_id, sum(coalesce(list_sum(list_transform(lines[2:], lambda x: len(regexp_extract_all({_LINE}, '[A-Z][a-z]+'))
    + len(regexp_extract_all(regexp_replace({_LINE}, '[A-Z][a-z]+', '[REDACTED]', 'g'), '\\d+')))), 0))::BIGINT AS matches
  FROM ({DOC_LINES}) GROUP BY source
"""
ORACLES["convert_deck_tables"] = ORACLES["convert_decks"]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

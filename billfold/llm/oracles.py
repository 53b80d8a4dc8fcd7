"""The same queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLES: dict[str, str] = {}

ORACLES["op4_minmax_near_dedup"] = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4
    THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.other),
lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM lowest LEFT JOIN n USING (doc_id)
"""

ORACLES["op7_line_dedup"] = rf"""
WITH token AS (
  SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS ts FROM documents),
cut AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM token),
word AS (
  SELECT doc_id, i, regexp_extract(t, '[^\x20\x09-\x0D]+') AS w, position(chr(10) IN t) > 0 AS fresh,
    sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM cut),
closed AS (
  SELECT *, CASE WHEN fresh OR lag(right(w, 1) IN ('.', '!', '?') OR strlen(w) % 8 = 7) OVER (PARTITION BY doc_id ORDER BY i)
    THEN 1 ELSE 0 END AS begins FROM word),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM closed),
unit AS MATERIALIZED (
  SELECT doc_id, min(stop - length(w)) AS start, max(stop) AS "end", count(*) AS n_words,
    string_agg({LOWER.replace("text", "w")}, ' ' ORDER BY i) AS norm,
    row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS unit_no FROM numbered GROUP BY doc_id, n),
ranked AS (
  SELECT *, first_value(doc_id) OVER o AS kept_doc_id, first_value(start) OVER o AS kept_start, row_number() OVER o AS nth
  FROM unit WINDOW o AS (PARTITION BY norm ORDER BY doc_id, unit_no)),
run AS (
  SELECT *, unit_no - row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS run FROM ranked WHERE nth > 1),
summed AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS run_words FROM run)
SELECT doc_id, start, "end", n_words, run_words, kept_doc_id, kept_start FROM summed WHERE run_words >= 25
"""

ORACLES["op5_flow_mixing"] = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS})) AS size,
    md5('mix-1/' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
    2 * source_size AS cap FROM s),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level,
    row_number() OVER (ORDER BY cap / weight) AS place
  FROM weighed WINDOW before AS (ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE cap > weight * level),
aimed AS (
  SELECT source, source_size, CASE WHEN l.place < stop.place OR stop.place IS NULL THEN cap::DOUBLE
    ELSE weight * stop.level END AS target FROM levels l, stop),
flow AS (
  SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS whole, floor(target)::BIGINT % greatest(source_size, 1) AS rest
  FROM aimed),
placed AS (
  SELECT d.*, source_size, target, whole, rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) AS through
  FROM d JOIN flow f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE
  WHEN through <= rest OR (through - size < rest AND through - rest <= rest - (through - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

ORACLES["op3_threshold_top_k"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _escaped(column: str) -> str:
    """Code points of the column with backslashes doubled and one put into every control string."""
    longer = [f"length({column})", f"length({column}) - length(replace({column}, chr(92), ''))"]
    for s in ("<s>", "</s>", "[INST]", "[/INST]"):
        longer.append(f"(length({column}) - length(replace({column}, '{s}', ''))) // {len(s)}")
    return " + ".join(longer)


ORACLES["op9_chat_formatting"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(CASE WHEN role = 'assistant' THEN 7 ELSE 13 END + 1 + {_escaped("role")} + {_escaped("text")})::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

ORACLES["op11_patricia_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents),
g AS (
  SELECT doc_id, t, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER o AS nth
  FROM n WINDOW o AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""

ORACLES["op12_composed_spelling_variants"] = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
run AS (
  SELECT doc_id, unnest(regexp_extract_all(LOWER_TEXT, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
seen AS MATERIALIZED (
  SELECT w, count(*) AS c, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x FROM run GROUP BY doc_id, w),
summed AS (
  SELECT w, c, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
    lambda r, b: xor(t[((xor(r, b) & 255) + 1)::BIGINT], r >> 8)), 4294967295::UBIGINT) AS h FROM seen, crc),
word AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(c)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 5 AND sum(c) >= 3),
cut AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min({'n': -near_n, 'w': near}) AS best FROM pair GROUP BY word),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * n THEN best.w END AS form,
    CASE WHEN -best.n >= 2 * n THEN -best.n END AS form_n FROM word LEFT JOIN near USING (word)),
way AS (
  SELECT word, word AS reached FROM formed
  UNION ALL SELECT way.word, formed.form FROM way JOIN formed ON formed.word = way.reached WHERE formed.form IS NOT NULL),
root AS (SELECT way.word, reached AS root FROM way JOIN formed ON formed.word = way.reached WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN root USING (word)
""".replace("LOWER_TEXT", LOWER)

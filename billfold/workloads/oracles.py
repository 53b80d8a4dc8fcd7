"""The queries as SQL for DuckDB, written for checking, not for speed.

The SQL takes its own way wherever there is one: windows instead of array folds, plain
searching patterns instead of the split and reversed ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from billfold.functions import constants as K

S, W, D = f"[{K.SPACE_SET}]", f"[{K.WORD_SET}]", K.DIGIT
NOT_W = f"[^{K.WORD_SET}]"
ORACLES: dict[str, str] = {}


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{S}+', ''), '{S}+$', '')"


def fold(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '{S}+', ' ', 'g'), '^ ', ''), ' $', '')"


def has_word(x: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def numbers(x: str) -> str:
    return rf"regexp_extract_all({x}, '-?{D}+(?:\.{D}+)?')"


def without(x: str, signs: str) -> str:
    for s in signs:
        x = f"replace({x}, '{s}', '')"
    return x


# --- derived inputs ------------------------------------------------------------------

ITEMS = """
items AS (
  SELECT *, (rate_cents // 100)::VARCHAR || '.' || lpad((rate_cents % 100)::VARCHAR, 2, '0') AS rate_text,
         price::VARCHAR AS amount_text
  FROM (SELECT *, cents // qty AS rate_cents
        FROM (SELECT *, CAST(price * 100 AS BIGINT) AS cents
              FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS qty,
                           CAST(l_extendedprice AS DECIMAL(18,2)) AS price
                    FROM lineitem))))
"""

INVOICES = ITEMS + """, texts AS MATERIALIZED (
  SELECT o_orderkey, 'order_' || o_orderkey AS doc_id,
    'Invoice No: INV-' || o_orderkey || chr(10) || 'From: Supplier ' || coalesce(s, 0) || chr(10)
    || 'To: ' || c_name || chr(10) || 'Description | Qty | Rate | Amount' || chr(10)
    || coalesce(ls || chr(10), '') || 'Sales Tax ' || CAST(o_orderkey % 500 AS DECIMAL(18,2)) || chr(10)
    || 'Balance Due ' || CAST(o_totalprice AS DECIMAL(18,2)) || chr(10) || 'Page 1' AS text
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (
    SELECT l_orderkey, min(l_suppkey) AS s,
           string_agg('Part P' || l_partkey || ' | ' || qty || ' | ' || rate_text || ' | ' || amount_text, chr(10)
                      ORDER BY l_linenumber, l_partkey, qty, cents) AS ls
    FROM items GROUP BY l_orderkey) ON l_orderkey = o_orderkey)
"""

FILES = """
files AS (
  SELECT doc_id AS doc_no, 'doc_' || doc_id AS file_stem, 'doc_' || doc_id || '.txt' AS file_name,
         '/in/doc_' || doc_id || '.txt' AS file_path, sha256(text) AS file_hash, text
  FROM documents)
"""

LINES = rf"""
line_lists AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '{K.LINE_END}'), lambda x: {fold('x')}),
                             lambda x: x <> '') AS ls
  FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM line_lists)
"""

RAW_LINES = """
raw_lines AS (
  SELECT doc_id, unnest(ls) AS raw_text, generate_subscripts(ls, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
"""

WORDS = RAW_LINES + """, words AS (
  SELECT doc_id::VARCHAR AS doc_id, pos AS line_num, word_idx, (word_idx * 37) % 10007 AS "left",
         20 * pos + word_idx % 3 AS top, (doc_id * 31 + word_idx * 17) % 102 - 1 AS conf, text
  FROM (SELECT doc_id, pos, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS word_idx
        FROM (SELECT *, string_split(raw_text, ' ') AS ws FROM raw_lines)))
"""

KEPT_WORDS = WORDS + rf", kept AS (SELECT * FROM words WHERE regexp_matches(text, '[^{K.SPACE_SET}]'))"

CELLS = ITEMS + """, cells AS (
  SELECT l_orderkey::VARCHAR AS doc_id, l_linenumber, k * 100 AS x, l_linenumber * 40 + l_partkey % 5 AS y,
         18 + (cents + k) % 7 AS h,
         CASE k WHEN 0 THEN 'Part P' || l_partkey
                WHEN 1 THEN CASE WHEN qty % 7 = 0 THEN ' ' ELSE qty::VARCHAR END
                WHEN 2 THEN rate_text ELSE amount_text END AS text
  FROM items, (SELECT unnest([0, 1, 2, 3]) AS k))
"""

PAGES = """
pages_of AS (
  SELECT doc_id, (pos // 5) + 1 AS page_no, string_agg(raw_text, chr(10) ORDER BY pos) AS text
  FROM raw_lines GROUP BY doc_id, pos // 5)
"""

CLEANED = ITEMS + """, summary AS (
  SELECT o_orderkey AS o, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         CAST(o_totalprice AS DECIMAL(18,2)) - CASE WHEN o_orderkey % 5 = 3 THEN 1 ELSE 0 END AS sub,
         CAST(o_orderkey % 500 AS DECIMAL(18,2)) AS tax
  FROM orders),
summary_rows AS (
  SELECT o, 'Subtotal' AS d, sub AS v, 1 AS n FROM summary WHERE o % 6 IN (0, 2)
  UNION ALL SELECT o, 'VAT', tax, 2 FROM summary WHERE o % 6 = 0
  UNION ALL SELECT o, 'Total', price, 3 FROM summary WHERE o % 6 = 0
  UNION ALL SELECT o, 'Total', price, 1 FROM summary WHERE o % 6 IN (1, 4)
  UNION ALL SELECT o, 'Sales Tax', tax, 2 FROM summary WHERE o % 6 = 1
  UNION ALL SELECT o, 'GST', tax, 2 FROM summary WHERE o % 6 = 2
  UNION ALL SELECT o, 'Tax', tax, 1 FROM summary WHERE o % 6 = 3
  UNION ALL SELECT o, 'Tax 2', sub, 2 FROM summary WHERE o % 6 = 3
  UNION ALL SELECT o, 'Grand Total', sub, 2 FROM summary WHERE o % 6 = 4),
cleaned AS (
  SELECT 'N' || l_orderkey AS invoice_number, 'Part P' || l_partkey AS description, qty::DOUBLE AS qty,
         CAST(rate_text AS DOUBLE) AS rate, price::DOUBLE AS amount,
         'a_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || qty || '_' || cents AS file_name,
         1 AS row_number
  FROM items
  UNION ALL
  SELECT 'N' || o, CASE WHEN o % 7 < 3 THEN d || ' ' || CAST(v AS DECIMAL(18,2)) ELSE d END, NULL, NULL,
         CASE WHEN o % 7 < 3 THEN NULL ELSE CAST(v AS DECIMAL(18,2))::DOUBLE END, 'b', n
  FROM summary_rows)
"""

_LAST = f"TRY_CAST({numbers('replace(' + without('description', '€$£') + ', chr(44), chr(46))')}[-1] AS DOUBLE)"

SPLIT = CLEANED + f""", valued AS (
  SELECT invoice_number, description, trunc(qty) AS qty, rate, coalesce(amount, {_LAST}) AS amount, file_name, row_number,
         {has_word('lower(description)', K.SUMMARY_DESCRIPTION_WORDS)} AS is_summary,
         CASE WHEN contains(lower(description), 'subtotal') THEN 'subtotal'
              WHEN {has_word('lower(description)', K.TAX_WORDS)} THEN 'tax'
              WHEN {has_word('lower(description)', K.TOTAL_WORDS)} THEN 'total' ELSE 'other' END AS type
  FROM cleaned),
split_items AS (SELECT invoice_number, description, qty, rate, amount, file_name, row_number FROM valued WHERE NOT is_summary),
split_totals AS (
  SELECT invoice_number, type, description AS raw, amount AS parsed_amount, file_name, row_number
  FROM valued WHERE is_summary)
"""


def slots(totals: str) -> str:
    """The first-wins fold in its closed form."""
    return f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY invoice_number, type ORDER BY file_name, row_number) AS rn
  FROM {totals} WHERE parsed_amount IS NOT NULL),
slots AS (
  SELECT invoice_number,
    arg_min(parsed_amount, (file_name, row_number)) FILTER (type NOT IN ('tax', 'total') OR rn > 1) AS subtotal,
    arg_min(parsed_amount, (file_name, row_number)) FILTER (type = 'tax' AND rn = 1) AS tax,
    arg_min(parsed_amount, (file_name, row_number)) FILTER (type = 'total' AND rn = 1) AS total
  FROM ranked GROUP BY invoice_number)
"""


def verified(items: str, totals: str) -> str:
    return slots(totals) + f""", sums AS (
  SELECT invoice_number, CAST(sum(CAST(amount AS DECIMAL(28,8))) AS DOUBLE) AS s FROM {items} GROUP BY 1),
ids AS (SELECT invoice_number FROM {items} UNION SELECT invoice_number FROM {totals}),
step1 AS (
  SELECT invoice_number, coalesce(s, 0) AS s, coalesce(subtotal, total - tax) AS sub, tax, total
  FROM ids LEFT JOIN sums USING (invoice_number) LEFT JOIN slots USING (invoice_number)),
step2 AS (SELECT invoice_number, s, coalesce(sub, s) AS sub, tax, coalesce(total, sub + tax) AS total FROM step1),
verification AS (
  SELECT invoice_number, s AS items_sum, sub AS parsed_subtotal, tax AS parsed_tax,
         coalesce(total, sub + coalesce(tax, 0)) AS parsed_total, s - sub AS difference_items_vs_subtotal,
         abs(s - sub) > {K.MISMATCH_TOLERANCE} AS mismatch_flag
  FROM step2 WHERE invoice_number IS NOT NULL)
"""


VERIFICATION = """
SELECT invoice_number, round(items_sum, 4) AS items_sum, round(parsed_subtotal, 4) AS parsed_subtotal,
       round(parsed_tax, 4) AS parsed_tax, round(parsed_total, 4) AS parsed_total,
       round(difference_items_vs_subtotal, 4) AS difference_items_vs_subtotal, mismatch_flag
FROM verification
"""


def table_rows(source: str, key: str) -> str:
    """Table rows of ``source(key, text)`` by running windows over its lines."""
    footers = "|".join(K.FOOTER_STARTS)
    return rf"""
src_lists AS (
  SELECT {key} AS doc_id, list_filter(list_transform(string_split_regex(text, '{K.LINE_END}'),
         lambda x: {fold('x')}), lambda x: x <> '') AS ls FROM {source}),
src_lines AS (
  SELECT doc_id, line, line_no, {has_word('lower(line)', K.HEADER_WORDS)} AS is_head,
         regexp_matches(lower(line), '^(?:{footers})(?:{NOT_W}|$)') AS is_foot
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM src_lists)),
states AS (
  SELECT *, max(CASE WHEN is_head THEN line_no END) OVER w AS head_at,
         max(CASE WHEN is_foot AND NOT is_head THEN line_no END) OVER w AS foot_at
  FROM src_lines
  WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
table_rows AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_number, line AS raw_text
  FROM states
  WHERE head_at > coalesce(foot_at, 0) AND NOT is_head AND regexp_matches(line, '{D}'))
"""


def cells(source: str, columns: str) -> str:
    """SELECT of ``columns`` and the cells of ``raw_text``, joined by '~'."""
    return rf"""
SELECT {columns}, CASE WHEN len(tokens) >= 3
         THEN array_to_string(list_filter(list_transform(tokens, lambda t: {strip('t')}), lambda t: t <> ''), '~')
         ELSE array_to_string(list_concat([array_to_string(parts[1:last], ' ')],
                                          list_filter(parts[last + 1:], lambda t: t <> '')), '~') END AS cells
FROM (SELECT *, coalesce(list_max(list_transform(parts, lambda p, i:
             CASE WHEN regexp_full_match(p, '[{D}.,\-()]+') OR p = '' THEN 0 ELSE i END)), 0) AS last
      FROM (SELECT *, string_split_regex({strip('raw_text')}, '{S}{{2,}}|\t|{S}\|{S}') AS tokens,
                   string_split({fold('raw_text')}, ' ') AS parts
            FROM {source}))
"""


# --- labelled values --------------------------------------------------------------------

def _escaped(k: str) -> str:
    return k.replace("#", r"\#")


def value_after(text: str, keywords: Sequence[str], low: str | None = None) -> str:
    """``low`` may name a column that has the text in lower case."""
    low, raw = low or f"lower({text})", []
    for k in keywords:
        before = rf"(?:^|{NOT_W})" + _escaped(k)
        if k[-1].isalnum():
            p = rf"{before}(?:(?:{S}+[:\-]?{S}*|[:\-]{S}*)([^\n]+)|([^{K.WORD_SET}\n][^\n]*))"
            got = f"regexp_extract({low}, '{p}', 1) || regexp_extract({low}, '{p}', 2)"
        else:
            got = rf"regexp_extract({low}, '{before}({W}[^\n]*)', 1)"
        raw.append(f"CASE WHEN contains({low}, '{k}') THEN {got} ELSE '' END")
    signs = "' :' || chr(9) || '-'"
    after = ", ".join(
        f"CASE WHEN contains(lower(l), '{k}') THEN trim(substr(l, instr(lower(l), '{k}') + {len(k)}), {signs}) ELSE '' END"
        for k in keywords
    )
    lines = f"string_split_regex({text}, '{K.LINE_END}')"
    first = strip(f"list_filter([{', '.join(raw)}], lambda v: v <> '')[1]")
    second = f"list_filter(flatten(list_transform({lines}, lambda l: [{after}])), lambda v: v <> '')[1]"
    return f"CASE WHEN {has_word(low, keywords)} THEN coalesce({first}, {second}, '') ELSE '' END"


STREETS = "|".join(K.STREET_WORDS)
PLAIN = rf"[{K.WORD_SET}{K.SPACE_SET}.,\-]"


def street(text: str) -> str:
    return strip(rf"regexp_extract({text}, '(?i)({D}{{1,5}}{S}+{PLAIN}+(?:{STREETS}))(?:{NOT_W}|$)', 1)")


def box(text: str) -> str:
    return strip(rf"regexp_extract({text}, '(?i)P\.?O\.?{S}*Box{S}*{D}+')")


def place(text: str) -> str:
    return strip(
        rf"regexp_extract({text}, '(?i)[{K.WORD_SET}{K.SPACE_SET}]+,{S}*[A-Za-z]{{2,}}{S}*{D}{{5,6}}')"
    )


def address(text: str, labelled: str | None = None) -> str:
    """``labelled``, here and below: a column that has the labelled value already."""
    parts = (labelled or value_after(text, K.ADDRESS_KEYWORDS), street(text), box(text), place(text))
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ", '')"


def clean_number(raw: str) -> str:
    labels = "|".join(p.replace(".", r"\.").replace("#", r"\#") for p in K.INVOICE_NUMBER_PREFIXES)
    cut = rf"regexp_replace({strip(raw)}, '(?i)^(?:{labels})[:{K.SPACE_SET}\-]*', '')"
    kept = rf"substr(regexp_replace(regexp_replace({cut}, '{S}+', '_', 'g'), '[^A-Za-z0-9\-_#]', '', 'g'), 1, {K.INVOICE_NUMBER_LENGTH})"
    return f"coalesce(nullif({kept}, ''), {cut})"


def invoice_number(text: str, stem: str, labelled: str | None = None) -> str:
    labelled = labelled or value_after(text, K.INVOICE_NUMBER_KEYWORDS)
    bare = rf"regexp_extract({text}, '(?i)(?:^|{NOT_W})(INV[\-{K.SPACE_SET}_]*{D}+)(?:{NOT_W}|$)', 1)"
    return f"""coalesce(nullif({clean_number(labelled)}, ''),
      CASE WHEN {bare} <> '' THEN {clean_number(bare)} END, 'INV_' || {stem})"""


# --- numbers ------------------------------------------------------------------------------

def qty_rate_amount(source: str, raw: str, columns: str) -> str:
    """SELECT of ``columns`` with qty, rate and amount read from ``raw``."""
    number = rf"{D}+(?:\.{D}+)?"
    qty = rf"(?i)Qty\.?{S}*([{D}.]+){S}*\|{S}*([{D}.]+){S}*\|{S}*([{D}.]+)"
    pick = ", ".join(
        f"""CASE WHEN is_date THEN NULL
             WHEN regexp_matches(t, '{qty}') THEN TRY_CAST(regexp_extract(t, '{qty}', {i}) AS DOUBLE)
             WHEN len(plain) = 3 THEN TRY_CAST(plain[{i}] AS DOUBLE) {tail} END AS {name}"""
        for i, name, tail in (
            (1, "qty", ""), (2, "rate", ""),
            (3, "amount", f"ELSE TRY_CAST(nullif(regexp_extract(t, '({number})$', 1), '') AS DOUBLE)"),
        )
    )
    return rf"""
SELECT {columns}, {pick}
FROM (SELECT *, list_filter(ps, lambda p: regexp_full_match(p, '{number}')) AS plain,
             len(list_filter(ps, lambda p: regexp_full_match(p, '{D}{{1,2}}\.{D}{{1,2}}\.{D}{{2,4}}'))) > 0 AS is_date
      FROM (SELECT *, list_transform(string_split(t, '|'), lambda p: {strip('p')}) AS ps
            FROM (SELECT *, {strip(without(raw, '€,'))} AS t FROM {source})))
"""


def normalized(v: str) -> str:
    plain = without(v, "€$£")
    comma_last = rf"regexp_matches({plain}, '\..*,') AND NOT regexp_matches({plain}, ',.*\.')"
    late = rf"(contains({plain}, '.') AND regexp_matches({plain}, ',[^.]*$')) OR ({comma_last})"
    text = f"CASE WHEN {late} THEN replace({without(plain, '.')}, ',', '.') ELSE {without(plain, ',')} END"
    return f"TRY_CAST({numbers('(' + text + ')')}[-1] AS DOUBLE)"


# --- the queries ----------------------------------------------------------------------------

O = ORACLES
PAGE_TEXTS = RAW_LINES + "," + PAGES + """, layer AS (
  SELECT doc_id, page_no, CASE WHEN doc_id % 4 = 3 THEN ' ' || chr(10) || ' ' ELSE text END AS text FROM pages_of)"""
ASSEMBLED = r"""
  SELECT doc_id, coalesce(string_agg(chr(10) || text, '' ORDER BY page_no), '') AS text
  FROM layer WHERE regexp_matches(text, '""" + f"[^{K.SPACE_SET}]" + r"""') GROUP BY doc_id
"""

O["s2_content_hash"] = "SELECT doc_id, sha256(text) AS file_hash FROM documents"
O["s3_decode_text"] = "SELECT doc_id, text FROM documents"
_TROUBLED = FILES + """, troubled AS (
  SELECT doc_no::VARCHAR AS doc_id, CASE WHEN doc_no % 5 = 0 THEN '.docx' ELSE '.txt' END AS ext,
         CASE WHEN doc_no % 7 = 0 THEN ' ' ELSE text END AS text, file_path FROM files)
"""
_SOLID = f"regexp_matches(text, '[^{K.SPACE_SET}]')"
O["s4_failures"] = f"""WITH {_TROUBLED}
SELECT file_path AS file, CASE WHEN ext <> '.txt' THEN 'Unsupported extension ' || ext ELSE 'No text extracted' END AS error
FROM troubled WHERE ext <> '.txt' OR NOT {_SOLID}"""
O["s4_processable"] = f"WITH {_TROUBLED} SELECT doc_id, text FROM troubled WHERE ext = '.txt' AND {_SOLID}"
O["s5_assemble_pages"] = f"""WITH {PAGE_TEXTS}, assembled AS ({ASSEMBLED})
SELECT doc_id::VARCHAR AS doc_id, coalesce(a.text, '') AS text
FROM (SELECT DISTINCT doc_id FROM layer) LEFT JOIN assembled a USING (doc_id)"""
O["s6_flatten_page_tables"] = f"""WITH {ITEMS}
SELECT l_orderkey::VARCHAR AS doc_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, qty, cents) AS row_number,
       CASE WHEN l_partkey % 11 <> 0 THEN 'Part P' || l_partkey || ' | ' ELSE '' END
         || qty || ' | ' || rate_text || ' | ' || amount_text AS raw_text,
       CASE WHEN l_partkey % 11 <> 0 THEN 'Part P' || l_partkey ELSE '' END
         || '~' || qty || '~' || rate_text || '~' || amount_text AS cells
FROM items"""
O["s7_choose_row_source"] = f"""WITH {ITEMS}
SELECT l_orderkey AS doc_id,
       CASE l_orderkey % 4 WHEN 0 THEN 'T' || l_partkey WHEN 1 THEN 'O' || l_suppkey ELSE 'X' || qty END AS raw_text,
       least(l_orderkey % 4 + 1, 3) AS source
FROM items"""
O["s7_first_page_with_rows"] = f"""WITH {ITEMS}
SELECT l_orderkey AS doc_id, l_linenumber AS page_num, amount_text
FROM items QUALIFY l_linenumber = min(l_linenumber) OVER (PARTITION BY l_orderkey)"""
O["s8_append_fallback_text"] = f"""WITH {PAGE_TEXTS}, assembled AS ({ASSEMBLED}),
ocr AS (SELECT doc_id, string_agg(chr(10) || text, '' ORDER BY page_no) AS o FROM pages_of GROUP BY doc_id)
SELECT doc_id::VARCHAR AS doc_id,
       coalesce(a.text, '') || CASE WHEN doc_id % 2 = 1 OR NOT coalesce(regexp_matches(a.text, '[^{K.SPACE_SET}]'), FALSE)
                                    THEN o ELSE '' END AS text
FROM ocr LEFT JOIN assembled a USING (doc_id)"""
O["s9_append_row_sources"] = f"""WITH {LINES},
digits AS (SELECT * FROM lines WHERE regexp_matches(line, '{D}')),
last AS (SELECT doc_id, max(line_no) AS m FROM digits GROUP BY doc_id)
SELECT doc_id, line_no AS row_number, line AS raw_text FROM digits
UNION ALL
SELECT doc_id, line_no + coalesce(m, 0), line FROM lines LEFT JOIN last USING (doc_id)"""
_STORED = FILES + """, stored AS (
  SELECT min(doc_no) AS doc_no, file_hash FROM files WHERE doc_no % 3 = 0 GROUP BY file_hash)
"""
O["s10_insert_invoices"] = f"""WITH {_STORED}
SELECT 'doc_' || doc_no || '.txt' AS file_name, file_hash, 0 AS table_data_count FROM stored
UNION ALL
SELECT 'doc_' || min(doc_no) || '.txt', file_hash, 1 FROM files
WHERE file_hash NOT IN (SELECT file_hash FROM stored) GROUP BY file_hash"""
O["s11_insert_rows"] = f"""WITH {INVOICES}, {table_rows('texts', 'o_orderkey')}
SELECT 'A' AS invoice_number, 'order_' || doc_id || '.txt' AS file_name, row_number,
       CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE raw_text END AS raw_text
FROM table_rows"""
O["s11_raw_text_from_cells"] = f"""WITH {LINES}
SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN line ELSE (
    SELECT string_agg(v, ' | ' ORDER BY 'col_' || i)
    FROM (SELECT unnest(string_split(line, ' ')) AS v, generate_subscripts(string_split(line, ' '), 1) AS i)) END AS raw_text
FROM lines"""
O["s12_evolve_schema"] = """
SELECT s_name AS file_name, s_suppkey::VARCHAR AS file_hash, NULL::VARCHAR AS file_path, NULL::VARCHAR AS extraction_date,
       NULL::VARCHAR AS invoice_from, NULL::VARCHAR AS invoice_to, NULL::VARCHAR AS address, NULL::VARCHAR AS invoice_number,
       NULL::VARCHAR AS salesperson, NULL::BIGINT AS table_data_count, NULL::VARCHAR AS raw_text_preview,
       NULL::DOUBLE AS avg_confidence, NULL::BOOLEAN AS low_confidence_flag
FROM supplier"""
O["s12_store_evolves"] = """
SELECT s_name AS file_name, s_suppkey::VARCHAR AS file_hash, NULL::VARCHAR AS file_path, s_nationkey::BIGINT AS s_nationkey,
       NULL::BIGINT AS c_nationkey FROM supplier
UNION ALL SELECT c_name, c_custkey::VARCHAR, NULL, NULL, c_nationkey::BIGINT FROM customer"""
O["s13_skip_seen"] = f"""WITH {_STORED}
SELECT doc_no, file_name, file_hash FROM files WHERE file_hash NOT IN (SELECT file_hash FROM stored)"""
O["s14_stored_invoices"] = f"WITH {FILES} SELECT DISTINCT file_hash FROM files WHERE {_SOLID}"
O["st1_stream_invoices"] = O["s14_stored_invoices"]
O["st2_replayed_rows"] = f"""WITH {table_rows('documents', 'doc_id')}
SELECT 'doc_' || doc_id || '.txt' AS file_name, row_number, raw_text FROM table_rows"""
O["st2_broken_epoch"] = O["st2_replayed_rows"]

_NESTED = f"""WITH {SPLIT}{verified('split_items', 'split_totals')},
i AS (SELECT invoice_number, file_name, count(*) AS n_items, string_agg(description, '~' ORDER BY row_number, description) AS items
      FROM split_items GROUP BY 1, 2),
t AS (SELECT invoice_number, file_name, count(*) AS n_totals, string_agg(type || ':' || raw, '~' ORDER BY row_number) AS totals
      FROM split_totals GROUP BY 1, 2),
nested AS (SELECT * FROM i FULL JOIN t USING (invoice_number, file_name) JOIN verification USING (invoice_number))
"""
O["s18_nested_invoices"] = _NESTED + """
SELECT invoice_number, file_name, coalesce(items, '') AS items, coalesce(totals, '') AS totals, round(parsed_total, 4) AS parsed_total
FROM nested"""
O["s18_invoice_json"] = _NESTED + """
SELECT invoice_number, file_name, invoice_number AS json_number, coalesce(n_items, 0) AS n_items, coalesce(n_totals, 0) AS n_totals,
       CASE WHEN mismatch_flag THEN 'true' ELSE 'false' END AS mismatch
FROM nested"""
O["a7_totals_per_invoice"] = _NESTED + """
SELECT invoice_number, file_name, coalesce(n_items, 0) AS n_items, coalesce(n_totals, 0) AS n_totals, mismatch_flag
FROM nested"""

O["f1_keep_words"] = f"WITH {KEPT_WORDS} SELECT doc_id, line_num, word_idx, text FROM kept"
O["f2_keep_digit_lines"] = f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '{D}')"
O["f3_drop_summary_rows"] = f"""WITH {RAW_LINES}
SELECT doc_id, pos, raw_text FROM raw_lines WHERE NOT {has_word('lower(raw_text)', K.SUMMARY_ROW_WORDS)}"""
O["f4_drop_blank_rows"] = f"""WITH {RAW_LINES}
SELECT doc_id, pos, raw_text FROM raw_lines WHERE regexp_matches(raw_text, '[^{K.SPACE_SET}]')"""
O["f5_items"] = f"WITH {SPLIT} SELECT * FROM split_items"
O["f5_totals"] = f"WITH {SPLIT} SELECT * FROM split_totals"
O["f6_expected_columns"] = f"""WITH {CLEANED}
SELECT invoice_number, description, NULL::DOUBLE AS qty, NULL::DOUBLE AS rate, NULL::DOUBLE AS amount FROM cleaned"""
O["f7_stamp_rows"] = f"""WITH {ITEMS}
SELECT l_orderkey::VARCHAR AS invoice_number, 'order_' || l_orderkey || '.txt' AS file_name,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, qty, cents) AS row_number,
       CASE WHEN l_partkey % 11 <> 0 THEN 'Part P' || l_partkey || ' | ' ELSE '' END
         || qty || ' | ' || rate_text || ' | ' || amount_text AS raw_text
FROM items WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"""


def records(source: str, key: str, stem: str, file_name: str, file_path: str, where: str = "TRUE") -> str:
    """The invoice records of a table of texts: its values first, one each, then what is made of them."""
    values = {
        "invoice_from": K.SELLER_KEYWORDS, "invoice_to": K.BUYER_KEYWORDS, "salesperson": K.SALESPERSON_KEYWORDS,
        "addressed": K.ADDRESS_KEYWORDS, "numbered": K.INVOICE_NUMBER_KEYWORDS,
    }
    told = ",\n       ".join(f"{value_after('text', words, 'low')} AS {name}" for name, words in values.items())
    return f"""counts AS (SELECT doc_id AS key, count(*) AS n FROM table_rows GROUP BY 1),
lowered AS MATERIALIZED (SELECT *, {key} AS key, lower(text) AS low FROM {source} WHERE {where}),
told AS MATERIALIZED (SELECT *, {told} FROM lowered)
SELECT {file_name} AS file_name, {file_path} AS file_path, '2024-01-01 00:00:00' AS extraction_date, invoice_from, invoice_to,
       {address('text', 'addressed')} AS address, {invoice_number('text', stem, 'numbered')} AS invoice_number, salesperson,
       coalesce(n, 0) AS table_data_count, substr(text, 1, {K.PREVIEW_LENGTH}) AS raw_text_preview, sha256(text) AS file_hash,
       NULL::DOUBLE AS avg_confidence, FALSE AS low_confidence_flag
FROM told LEFT JOIN counts USING (key)"""


O["f8_invoice_records"] = f"""WITH {INVOICES}, {table_rows('texts', 'o_orderkey')},
{records('texts', 'o_orderkey', 'doc_id', "doc_id || '.txt'", "'/in/' || doc_id || '.txt'")}"""
O["f8_document_records"] = f"""WITH {FILES}, {table_rows('documents', 'doc_id')},
{records('files', 'doc_no', 'file_stem', 'file_name', 'file_path', _SOLID)}"""

O["a1_lines_from_words"] = f"""WITH {KEPT_WORDS}
SELECT doc_id, line_num, string_agg(text, ' ' ORDER BY "left", word_idx) AS raw_text FROM kept GROUP BY doc_id, line_num"""
O["a2_lines_from_centres"] = f"""WITH {KEPT_WORDS}
SELECT doc_id, min(top) + 6.0::DOUBLE AS line_start, string_agg(text, ' ' ORDER BY "left", word_idx) AS raw_text
FROM kept GROUP BY doc_id, line_num"""
O["a3_rows_from_cells"] = f"""WITH {CELLS}
SELECT doc_id, min(y) AS line_start,
       coalesce(string_agg(text, ' | ' ORDER BY x, y, h, text) FILTER (text <> ' '), '') AS raw_text,
       string_agg(text, '~' ORDER BY x, y, h, text) AS cells
FROM cells GROUP BY doc_id, l_linenumber"""
O["a4_keep_cells"] = f"""WITH {CELLS} SELECT doc_id, x, y, h, text FROM cells WHERE 50 * h > {K.MIN_CELL_AREA}"""


def confidence(kept: str) -> str:
    return f"""WITH {WORDS}, by_page AS (
  SELECT doc_id, line_num // 5 AS page, avg(conf::DOUBLE) FILTER ({kept}) AS c FROM words GROUP BY 1, 2)
SELECT doc_id, round(avg(c), 6) AS avg_confidence FROM by_page GROUP BY doc_id"""


O["a5_avg_confidence"] = confidence("conf <> -1")
O["a5_avg_cell_confidence"] = confidence("TRUE")
O["a6_row_counts"] = f"""WITH {table_rows('documents', 'doc_id')}, counts AS (SELECT doc_id, count(*) AS n FROM table_rows GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS table_data_count FROM documents LEFT JOIN counts USING (doc_id)"""
O["a8_item_sums"] = f"""WITH {SPLIT}
SELECT invoice_number, round(coalesce(CAST(sum(CAST(amount AS DECIMAL(28,8))) AS DOUBLE), 0), 4) AS items_sum
FROM split_items GROUP BY 1"""
O["w3_first_totals"] = f"""WITH {SPLIT}{slots('split_totals')}
SELECT invoice_number, round(subtotal, 4) AS subtotal, round(tax, 4) AS tax, round(total, 4) AS total
FROM (SELECT DISTINCT invoice_number FROM split_totals) LEFT JOIN slots USING (invoice_number)"""
O["a10_invoice_ids"] = f"""WITH {SPLIT}
SELECT invoice_number FROM split_items UNION SELECT invoice_number FROM split_totals"""

O["w1_document_rows"] = f"""WITH {table_rows('documents', 'doc_id')}
{cells('table_rows', 'doc_id, row_number, raw_text')}"""
O["w1_split_document"] = O["w1_document_rows"]
O["w1_invoice_rows"] = f"""WITH {INVOICES}, {table_rows('texts', 'o_orderkey')}
{cells('table_rows', "'order_' || doc_id AS doc_id, row_number, raw_text")}"""
O["w2_keep_first"] = f"WITH {FILES} SELECT file_hash, min(doc_no) AS doc_no FROM files GROUP BY file_hash"
O["w4_number_rows"] = f"""WITH {ITEMS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, cents,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, qty, cents) AS row_number
FROM items"""
O["w5_number_lines"] = f"""WITH {KEPT_WORDS}
SELECT doc_id, line_num, row_number() OVER (PARTITION BY doc_id ORDER BY line_num) AS row_number
FROM (SELECT DISTINCT doc_id, line_num FROM kept)"""
O["o1_sorted_paths"] = f"WITH {FILES} SELECT DISTINCT file_path FROM files ORDER BY file_path"
O["o4_first_characters"] = f"SELECT doc_id, substr(text, 1, {K.PREVIEW_LENGTH}) AS preview FROM documents"

O["t1_text_lines"] = f"WITH {LINES} SELECT doc_id, line_no, line FROM lines"
O["t2_value_after_keywords"] = f"""
SELECT doc_id, {value_after('text', ('invoice', 'the on', 'cha', 'email'))} AS value FROM documents"""
O["t3_parties"] = f"""SELECT doc_id, {value_after('text', K.SELLER_KEYWORDS)} AS invoice_from,
  {value_after('text', K.BUYER_KEYWORDS)} AS invoice_to, {value_after('text', K.SALESPERSON_KEYWORDS)} AS salesperson
FROM documents"""
O["t4_address"] = f"SELECT doc_id, {address('text')} AS address FROM documents"
O["t4_address_parts"] = f"""
SELECT doc_id, {street('text')} AS street, {box('text')} AS box, {place('text')} AS place FROM documents"""
O["t4_invoice_addresses"] = f"WITH {INVOICES} SELECT doc_id, {address('text')} AS address FROM texts"
_LETTERS = """
letters AS (
  SELECT c_custkey, c_name, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS pos
  FROM (SELECT c_custkey, c_name, [
          n || chr(10) || c_custkey || ' Old Mill Rd, 7th best ave; ref inv-' || c_custkey || ' ok',
          n || '; mail: p.o.  Box ' || c_custkey || '! xinv-1 INV 2x',
          'Hall: Upper ' || n || ',' || chr(10) || ' Ham ' || lpad(c_custkey::VARCHAR, 5, '1') || '. INV_' || c_custkey,
          'Late: ' || c_custkey || ' st, ' || n || ': ' || c_custkey || ' a  st. INV - '] AS ls
        FROM (SELECT *, replace(c_name, '#', ' ') AS n FROM customer)))
"""
O["t4_letter_addresses"] = f"WITH {_LETTERS} SELECT c_custkey, pos, {address('text')} AS address FROM letters"
O["t6_bare_invoice_numbers"] = f"""WITH {_LETTERS}
SELECT c_custkey, pos, {invoice_number('text', 'c_name')} AS invoice_number FROM letters"""
O["t3_conversation_parties"] = f"""SELECT conv_id, turn, {value_after('text', K.SELLER_KEYWORDS)} AS invoice_from,
  {value_after('text', K.BUYER_KEYWORDS)} AS invoice_to, {value_after('text', K.SALESPERSON_KEYWORDS)} AS salesperson
FROM conversations"""
O["f8_page_records"] = f"""WITH page_texts AS (SELECT page_id, 'page_' || page_id AS stem, html AS text FROM pages),
{table_rows('page_texts', 'page_id')},
counts AS (SELECT doc_id AS page_id, count(*) AS n FROM table_rows GROUP BY 1)
SELECT stem || '.txt' AS file_name, {value_after('text', K.SELLER_KEYWORDS)} AS invoice_from,
       {value_after('text', K.BUYER_KEYWORDS)} AS invoice_to, {address('text')} AS address,
       {invoice_number('text', 'stem')} AS invoice_number, {value_after('text', K.SALESPERSON_KEYWORDS)} AS salesperson,
       coalesce(n, 0) AS table_data_count, substr(text, 1, {K.PREVIEW_LENGTH}) AS raw_text_preview
FROM page_texts LEFT JOIN counts USING (page_id)"""
O["t5_clean_invoice_number"] = f"""WITH {LINES}
SELECT doc_id, line_no, {clean_number('labelled')} AS invoice_number
FROM (SELECT *, ['', 'Invoice No:', 'INV-', 'bill', 'inv.', 'invoice#', 'Bill No'][line_no % 7 + 1] || ' ' || line AS labelled
      FROM lines)"""
O["t6_invoice_number"] = f"""WITH {FILES}
SELECT doc_no, {invoice_number('text', 'file_stem')} AS invoice_number FROM files"""
O["t6_invoice_number_labelled"] = f"""WITH {INVOICES}
SELECT doc_id, {invoice_number('text', 'doc_id')} AS invoice_number FROM texts"""
O["t7_row_cells"] = f"WITH {RAW_LINES} {cells('raw_lines', 'doc_id, pos')}"
O["t8_header_lines"] = f"""WITH {LINES}
SELECT doc_id, line_no, line FROM lines WHERE {has_word('lower(line)', K.HEADER_WORDS)}"""
O["t9_dates"] = """
SELECT l_orderkey, l_linenumber, cell FROM (
  SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%d.%m.%Y') AS cell FROM lineitem
  UNION ALL
  SELECT l_orderkey, l_linenumber, day(l_shipdate) || '.' || month(l_shipdate) || '.' || strftime(l_shipdate, '%y')
  FROM lineitem)"""
_THREE = "qty || ' | ' || rate_text || ' | ' || amount_text"
O["t10_qty_rate_amount"] = f"""WITH {ITEMS}, forms AS (
  SELECT l_orderkey, l_linenumber, l_partkey, unnest([
    'Part P1 | ' || {_THREE}, 'Qty. ' || {_THREE}, 'Fee -' || replace(amount_text, '.', ',') || ' €',
    '27.08.2019 | ' || {_THREE}, 'due 27.08.2019 PO-' || qty || ' 27.09.2019', qty || ' | x | ' || amount_text,
    'none']) AS raw
  FROM items)
{qty_rate_amount('forms', 'raw', 'l_orderkey, l_linenumber, l_partkey, raw')}"""
O["t10_document_amounts"] = f"WITH {LINES} {qty_rate_amount('lines', 'line', 'doc_id, line_no')}"
O["t11_last_number"] = f"""WITH {LINES}
SELECT doc_id, line_no, TRY_CAST({numbers("replace(" + without('line', '€$£') + ", ',', '.')")}[-1] AS DOUBLE) AS amount
FROM lines"""
O["t12_normalize_qty"] = """
SELECT l_orderkey, l_linenumber, l_partkey, trunc(l_quantity / 2) AS qty,
       CAST(l_quantity AS INTEGER) + 0.5::DOUBLE AS qty_text, NULL::DOUBLE AS qty_bad
FROM lineitem"""
O["t13_normalize_amount"] = f"""WITH {ITEMS}, marked AS (
  SELECT *, CASE WHEN cents // 100 >= 1000 THEN (cents // 100000) || '#' || lpad((cents // 100 % 1000)::VARCHAR, 3, '0')
                 ELSE (cents // 100)::VARCHAR END AS th, lpad((cents % 100)::VARCHAR, 2, '0') AS c FROM items),
texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, unnest([
    amount_text, replace(th, '#', ',') || '.' || c, replace(th, '#', '.') || ',' || c,
    '€ ' || replace(amount_text, '.', ','), 'Part ' || amount_text || ' -' || qty, 'no number']) AS value
  FROM marked)
SELECT l_orderkey, l_linenumber, l_partkey, value, {normalized('value')} AS amount FROM texts"""
O["t14_summary_types"] = f"WITH {SPLIT} SELECT invoice_number, raw AS description, type FROM split_totals"
O["t15_amount_or_description"] = f"WITH {SPLIT} SELECT invoice_number, description, amount FROM valued"
O["t16_description"] = f"""
SELECT doc_id, split_part({strip('text')}, chr(10), 1) AS description FROM documents"""
O["t17_low_confidence"] = f"""WITH {WORDS}
SELECT doc_id, coalesce(avg(conf::DOUBLE) FILTER (conf <> -1) < 50, FALSE) AS low_confidence_flag FROM words GROUP BY doc_id"""
O["t18_reconcile"] = f"WITH {SPLIT}{verified('split_items', 'split_totals')}{VERIFICATION}"
O["p4_postprocess"] = O["t18_reconcile"]
O["p4_any_cleaned_table"] = (
    f"WITH {SPLIT}{verified('split_items', 'split_totals')}{VERIFICATION}"
    .replace("(file_name, row_number)", "parsed_amount")
    .replace("ORDER BY file_name, row_number", "ORDER BY parsed_amount")
)

# --- stages ------------------------------------------------------------------------------------

_CLEAN_COLUMNS = "doc_id, row_number, raw_text"
_CLEANED_ROWS = f"""WITH {INVOICES}, {table_rows('texts', 'o_orderkey')},
kept_rows AS (
  SELECT * FROM table_rows WHERE NOT {has_word('lower(raw_text)', K.SUMMARY_ROW_WORDS)}),
read_rows AS ({qty_rate_amount('kept_rows', 'raw_text', _CLEAN_COLUMNS)})
"""
O["p2_extract_rows"] = f"""WITH {INVOICES}, {table_rows('texts', 'o_orderkey')}
SELECT doc_id::VARCHAR AS invoice_number, 'order_' || doc_id || '.txt' AS file_name, row_number, raw_text FROM table_rows"""
O["p3_clean"] = _CLEANED_ROWS + """
SELECT 'order_' || doc_id AS invoice_number, raw_text AS description, qty, rate, amount,
       'order_' || doc_id || '.txt' AS file_name, row_number
FROM read_rows"""
_DESCRIPTION_LAST = f"TRY_CAST({numbers('replace(' + without('raw_text', '€$£') + ', chr(44), chr(46))')}[-1] AS DOUBLE)"
O["p1_run_stages"] = _CLEANED_ROWS + f""", full_rows AS (
  SELECT doc_id::VARCHAR AS invoice_number, raw_text, coalesce(amount, {_DESCRIPTION_LAST}) AS amount,
         'order_' || doc_id || '.txt' AS file_name, row_number,
         {has_word('lower(raw_text)', K.SUMMARY_DESCRIPTION_WORDS)} AS is_summary
  FROM read_rows),
run_items AS (SELECT * FROM full_rows WHERE NOT is_summary),
run_totals AS (
  SELECT invoice_number, 'tax' AS type, amount AS parsed_amount, file_name, row_number FROM full_rows WHERE is_summary)
{verified('run_items', 'run_totals')}{VERIFICATION}"""
O["invoice_verification"] = O["p1_run_stages"]
O["s15_exported_rows"] = O["p2_extract_rows"]
O["s16_rerun_batch"] = _CLEANED_ROWS + """
SELECT doc_id::VARCHAR AS invoice_number, raw_text AS description, qty, rate, amount,
       'order_' || doc_id || '.txt' AS file_name, row_number
FROM read_rows WHERE doc_id % 3 <> 0"""
O["s17_rerun_verification"] = f"SELECT * FROM ({O['p1_run_stages']}) WHERE invoice_number::BIGINT % 3 <> 0"
_FULL_ROWS = O["p1_run_stages"][: O["p1_run_stages"].index(",\nrun_items AS")]
O["s17_stored_items"] = _FULL_ROWS + """
SELECT invoice_number, raw_text AS description, amount, file_name, row_number FROM full_rows WHERE NOT is_summary"""
O["s17_stored_totals"] = _FULL_ROWS + """
SELECT invoice_number, 'tax' AS type, raw_text AS raw, amount AS parsed_amount, file_name, row_number
FROM full_rows WHERE is_summary"""
O["s19_text_files"] = "SELECT 'doc_' || doc_id AS file_stem, coalesce(text, '') AS text FROM documents"

# Scanned orders: of every eight 0-2 have page tables, 3-4 cells, 5-6 words only, 7 is an image.
_SCANNED = INVOICES + f""", scan_words AS MATERIALIZED (
  SELECT o_orderkey, line_num, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i
  FROM (SELECT o_orderkey, ls, generate_subscripts(ls, 1) - 1 AS line_num, string_split(unnest(ls), ' ') AS ws
        FROM (SELECT o_orderkey, string_split(text, chr(10)) AS ls FROM texts))),
big_cells AS MATERIALIZED (
  SELECT l_orderkey AS o, l_linenumber, k * 100 AS x, l_linenumber * 40 + l_partkey % 5 AS y,
         18 + (cents + k) % 7 AS h, k * 3 - 1 AS conf,
         CASE k WHEN 0 THEN 'Part P' || l_partkey
                WHEN 1 THEN CASE WHEN qty % 7 = 0 THEN ' ' ELSE qty::VARCHAR END
                WHEN 2 THEN rate_text ELSE amount_text END AS text
  FROM items, (SELECT unnest([0, 1, 2, 3]) AS k)
  WHERE l_orderkey % 8 IN (3, 4) AND 50 * (18 + (cents + k) % 7) > {K.MIN_CELL_AREA}),
cell_docs AS (SELECT DISTINCT o FROM big_cells),
by_table AS MATERIALIZED (
  SELECT l_orderkey AS o,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, qty, cents) AS row_number,
         CASE WHEN l_partkey % 11 <> 0 THEN 'Part P' || l_partkey || ' | ' ELSE '' END
           || qty || ' | ' || rate_text || ' | ' || amount_text AS raw_text
  FROM items WHERE l_orderkey % 8 <= 2 AND l_orderkey IN (SELECT o_orderkey FROM texts)),
by_cell AS (
  SELECT o, row_number() OVER (PARTITION BY o ORDER BY l_linenumber) AS row_number,
         coalesce(string_agg(text, ' | ' ORDER BY x, y, h, text) FILTER (text <> ' '), '') AS raw_text
  FROM big_cells WHERE o IN (SELECT o_orderkey FROM texts) GROUP BY o, l_linenumber),
by_line AS (
  SELECT o_orderkey AS o, line_num + 1 AS row_number, string_agg(word, ' ' ORDER BY i) AS raw_text
  FROM scan_words
  WHERE o_orderkey NOT IN (SELECT o FROM by_table) AND o_orderkey NOT IN (SELECT o FROM cell_docs)
  GROUP BY o_orderkey, line_num),
scanned_rows AS (SELECT * FROM by_table UNION ALL SELECT * FROM by_cell UNION ALL SELECT * FROM by_line)
"""
O["p2_extract_page_rows"] = f"""WITH {_SCANNED}
SELECT o::VARCHAR AS invoice_number, 'order_' || o || CASE WHEN o % 8 = 7 THEN '.png' ELSE '.pdf' END AS file_name,
       row_number, raw_text
FROM scanned_rows"""
O["p2_extract_page_invoices"] = f"""WITH {_SCANNED},
word_conf AS (
  SELECT o_orderkey AS o, avg(c) FILTER (c <> -1) AS conf
  FROM (SELECT o_orderkey, ((o_orderkey + i * 7) % 101 - 1)::DOUBLE AS c FROM scan_words) GROUP BY 1),
cell_conf AS (SELECT o, avg(conf::DOUBLE) AS conf FROM big_cells GROUP BY o),
counts AS (SELECT o, count(*) AS n FROM scanned_rows GROUP BY o),
measured AS MATERIALIZED (
  SELECT o_orderkey AS o, n, 'order_' || o_orderkey AS stem,
         repeat(chr(10) || text, CASE WHEN o_orderkey % 8 IN (0, 1, 3, 5) AND o_orderkey NOT IN (SELECT o FROM by_table)
                                      THEN 2 ELSE 1 END) AS text,
         CASE WHEN o_orderkey IN (SELECT o FROM by_table) THEN NULL ELSE coalesce(cc.conf, wc.conf) END AS conf
  FROM texts LEFT JOIN counts ON counts.o = o_orderkey
  LEFT JOIN cell_conf cc ON cc.o = o_orderkey LEFT JOIN word_conf wc ON wc.o = o_orderkey)
SELECT stem || CASE WHEN o % 8 = 7 THEN '.png' ELSE '.pdf' END AS file_name, '/in/' || stem AS file_path,
       '2024-01-01 00:00:00' AS extraction_date, {value_after('text', K.SELLER_KEYWORDS)} AS invoice_from,
       {value_after('text', K.BUYER_KEYWORDS)} AS invoice_to, {address('text')} AS address,
       {invoice_number('text', 'stem')} AS invoice_number, {value_after('text', K.SALESPERSON_KEYWORDS)} AS salesperson,
       n AS table_data_count, substr(text, 1, {K.PREVIEW_LENGTH}) AS raw_text_preview, sha256(o::VARCHAR) AS file_hash,
       round(conf, 6) AS avg_confidence, coalesce(conf < 20, FALSE) AS low_confidence_flag
FROM measured"""

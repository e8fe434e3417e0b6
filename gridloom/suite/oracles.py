"""The same results as plain SQL for the checking engine, written independently.

Only the SQL that renders the inputs is shared with the queries.
"""

from __future__ import annotations

from gridloom import fixed
from gridloom.suite import inputs
from gridloom.suite.queries import ANSWER_KINDS, ATTEMPT_REPLIES, DIMS, DOCUMENT_SCHEMA, FETCH, GROUPED, NOTHING, SQL_STATEMENTS, TOP_K

SPACE = "[\\s\\x0B\\x{85}\\p{Z}]"


def _given(sql: str) -> str:
    for name in ("customer", "orders", "events", "part", "lineitem"):
        sql = sql.replace("{" + name + "}", name)
    return sql


def _trim(v: str) -> str:
    return f"regexp_replace(regexp_replace({v}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- cells and types --------------------------------------------------------------------

def _clean(v: str) -> str:
    bare = f"trim(rtrim(ltrim({v}, ' $€£¥₹'), '% '))"
    return f"(CASE WHEN contains({bare}, '.') THEN replace({bare}, ',', '') ELSE {bare} END)"


def _long(v: str) -> str:
    return f"(CASE WHEN regexp_full_match({v}, '[+-]?[0-9]+') THEN try_cast({v} AS BIGINT) END)"


def _double(v: str) -> str:
    c = _clean(v)
    return (
        f"(CASE WHEN regexp_full_match({c}, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"AND NOT isinf(coalesce(try_cast({c} AS DOUBLE), 0)) THEN try_cast({c} AS DOUBLE) "
        f"WHEN regexp_full_match(lower({c}), '[+-]?inf(inity)?|nan') THEN try_cast({c} AS DOUBLE) END)"
    )


def _ymd(y: str, m: str, d: str) -> str:
    return f"{y} || '-' || {m} || '-' || {d}"


def _month(name: str) -> str:
    return f"lpad(CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower({name})) + 2) // 3 AS VARCHAR), 2, '0')"


def _part(v: str, start: int, n: int) -> str:
    return f"substr({v}, {start}, {n})"


def _date(v: str) -> str:
    cases = [
        ("[0-9]{4}-[0-9]{2}-[0-9]{2}", v),
        ("[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}", _ymd(_part(v, 7, 4), _part(v, 4, 2), _part(v, 1, 2))),
        ("[0-9]{2}/[0-9]{2}/[0-9]{4}", _ymd(_part(v, 7, 4), _part(v, 1, 2), _part(v, 4, 2))),
        ("[0-9]{4}/[0-9]{2}/[0-9]{2}", f"replace({v}, '/', '-')"),
        ("[0-9]{2}[ -][A-Za-z]{3}[ -][0-9]{4}", _ymd(_part(v, 8, 4), _month(_part(v, 4, 3)), _part(v, 1, 2))),
        ("[A-Za-z]{3} [0-9]{2}, [0-9]{4}", _ymd(_part(v, 9, 4), _month(_part(v, 1, 3)), _part(v, 5, 2))),
    ]
    whens = " ".join(f"WHEN regexp_full_match({v}, '{p}') THEN try_cast({e} AS DATE)" for p, e in cases)
    return f"(CASE {whens} END)"


def _stamp(v: str) -> str:
    clock = "[0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?"
    tail = f"substr({v}, 11)"
    cases = [
        (f"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T]{clock}Z?", f"substr({v}, 1, 10) || ' ' || rtrim(substr({v}, 12), 'Z')"),
        (f"[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}} {clock}", f"{_ymd(_part(v, 7, 4), _part(v, 4, 2), _part(v, 1, 2))} || {tail}"),
        (f"[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} {clock}", f"{_ymd(_part(v, 7, 4), _part(v, 1, 2), _part(v, 4, 2))} || {tail}"),
    ]
    whens = " ".join(f"WHEN regexp_full_match({v}, '{p}') THEN try_cast({e} AS TIMESTAMP)" for p, e in cases)
    return f"(CASE {whens} END)"


def _cells(*names: str, key: str = "table_key", row: str = "row_index") -> str:
    """CTEs ``text_rows`` (v0..v5) and ``cells`` (one per cell, trimmed) of the text tables."""
    union = " UNION ALL ".join(f"SELECT * FROM ({_given(inputs.TEXTS[n])})" for n in names or inputs.TEXTS)
    values = ", ".join(f"v{i}" for i in range(inputs.WIDTH))
    return (
        f"text_rows AS (SELECT {key} AS table_key, {row} AS row_index, {values} FROM ({union}) u), "
        f"raw_cells AS (SELECT table_key, row_index, unnest(range({inputs.WIDTH})) AS col_index, "
        f"unnest([{values}]) AS raw FROM text_rows), "
        f"cells AS (SELECT table_key, row_index, CAST(col_index AS INTEGER) AS col_index, raw, {_trim('raw')} AS v FROM raw_cells)"
    )


def _types() -> str:
    """CTEs ``flags``, ``counts`` and ``types`` from ``cells``."""
    return (
        "flags AS (SELECT table_key, col_index, "
        "lower(v) IN ('true', 'yes', 't', 'y', 'false', 'no', 'f', 'n') AS b, "
        f"{_long('v')} IS NOT NULL AS i, {_double('v')} IS NOT NULL AS d, "
        f"{_date('v')} IS NOT NULL AS dt, {_stamp('v')} IS NOT NULL AS ts FROM cells WHERE v <> ''), "
        "seen AS (SELECT table_key, col_index, count(*) AS n_values, count(*) FILTER (b) AS n_boolean, "
        "count(*) FILTER (i) AS n_integer, count(*) FILTER (d) AS n_double, count(*) FILTER (dt) AS n_date, "
        "count(*) FILTER (ts) AS n_timestamp FROM flags GROUP BY ALL), "
        "counts AS (SELECT c.table_key, c.col_index, coalesce(n_values, 0) AS n_values, "
        "coalesce(n_boolean, 0) AS n_boolean, coalesce(n_integer, 0) AS n_integer, coalesce(n_double, 0) AS n_double, "
        "coalesce(n_date, 0) AS n_date, coalesce(n_timestamp, 0) AS n_timestamp "
        "FROM (SELECT DISTINCT table_key, col_index FROM cells) c LEFT JOIN seen USING (table_key, col_index)), "
        "types AS (SELECT *, CASE WHEN n_values = 0 THEN 'VARCHAR' WHEN n_boolean / n_values >= 0.95 THEN 'BOOLEAN' "
        "WHEN n_integer / n_values >= 0.95 THEN 'INTEGER' WHEN n_double / n_values >= 0.95 THEN 'DOUBLE' "
        "WHEN n_date / n_values >= 0.95 THEN 'DATE' WHEN n_timestamp / n_values >= 0.95 THEN 'TIMESTAMP' "
        "ELSE 'VARCHAR' END AS type FROM counts)"
    )


def _headers(*names: str) -> str:
    """CTE ``headers`` (table_key, col_index, original_name, name) by literal values."""
    rows = ", ".join(
        f"({_quote(n)}, {i}, {_quote(h)})" for n in names or inputs.HEADERS for i, h in enumerate(inputs.HEADERS[n])
    )
    return f"given_headers(table_key, col_index, original_name) AS (VALUES {rows}), {_names('given_headers')}"


def _names(source: str) -> str:
    return (
        f"bases AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(lower({_trim('original_name')}), "
        f"'[^\\p{{L}}\\p{{Nd}}]+', '_', 'g'), '^_|_$', '', 'g'), ''), 'col_' || (col_index + 1)) AS base FROM {source}), "
        "nth AS (SELECT *, row_number() OVER (PARTITION BY table_key, base ORDER BY col_index) AS k FROM bases), "
        "headers AS (SELECT table_key, col_index, original_name, CASE WHEN k > 1 THEN base || '_' || k ELSE base END AS name FROM nth)"
    )


VALUES = (
    "SELECT table_key, row_index, col_index, type, v, "
    "CASE WHEN type = 'BOOLEAN' AND v <> '' THEN CAST(lower(v) IN ('true', 'yes', 't', 'y') AS INTEGER) END AS v_bool, "
    f"CASE WHEN type = 'INTEGER' THEN {_long('v')} END AS v_long, "
    f"CASE WHEN type = 'DOUBLE' THEN {_double('v')} END AS v_double, "
    f"CASE WHEN type = 'DATE' THEN {_date('v')} END AS v_date, "
    f"CASE WHEN type = 'TIMESTAMP' THEN {_stamp('v')} END AS v_ts, "
    "CASE WHEN type = 'VARCHAR' AND v <> '' THEN v END AS v_string "
    "FROM cells JOIN types USING (table_key, col_index)"
)


def _texts(*names: str) -> str:
    """CTE ``texts``: row texts of the text tables."""
    return (
        f"WITH {_cells(*names)}, {_headers(*names)}, "
        "texts AS (SELECT table_key, row_index, string_agg(CASE WHEN original_name = '' THEN name ELSE original_name END "
        "|| ': ' || v, ' | ' ORDER BY col_index) AS text FROM cells JOIN headers USING (table_key, col_index) "
        "WHERE v <> '' GROUP BY table_key, row_index)"
    )


def _uuid(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || "
        f"substr({h}, 21, 12))"
    )


def _wide(key: str) -> str:
    """The typed wide table ``data`` of one text table, from its known column types."""
    types = {
        "customer": ["long", "text", "long", "double", "text", "bool"],
        "orders": ["long", "text", "double", "date", "text", "long"],
        "events": ["long", "stamp", "long", "text", "double", "bool"],
        "part": ["long", "text", "text", "text", "text", "double"],
    }[key]
    names = {
        "customer": ["customer_id", "full_name", "nation", "acct_bal", "segment", "active"],
        "orders": ["order_key", "status", "total_price", "order_date", "priority", "col_6"],
        "events": ["event_id", "when_utc", "user", "type", "value", "flag"],
        "part": ["part", "part_2", "größe_name", "type", "size", "retail_price"],
    }[key]
    cast = {
        "long": _long,
        "double": _double,
        "date": _date,
        "stamp": _stamp,
        "bool": lambda v: f"CASE WHEN {v} <> '' THEN lower({v}) IN ('true', 'yes', 't', 'y') END",
        "text": lambda v: f"nullif({v}, '')",
    }
    trimmed = ", ".join(f"{_trim(f'v{i}')} AS v{i}" for i in range(inputs.WIDTH))
    columns = ", ".join(f'{cast[t](f"v{i}")} AS "{n}"' for i, (t, n) in enumerate(zip(types, names)))
    return f"SELECT {columns} FROM (SELECT {trimmed} FROM ({_given(inputs.TEXTS[key])}) t) t"


# --- grids ------------------------------------------------------------------------------

GRID = """
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
    o_orderkey // 1000 AS fno, o_orderkey % 2 AS sh, (o_orderkey % 1000) // 2 AS p FROM orders),
b AS (SELECT *, 'book' || fno AS file_id, 'S' || sh AS sheet, p // 7 AS b, p % 7 AS i, fno % 3 AS off FROM o),
laid AS (
  SELECT file_id, sheet, 11 * b AS r, off AS c, 'Report ' || b AS v FROM b WHERE i = 0 AND b % 2 = 0
  UNION ALL SELECT file_id, sheet, 11 * b + 1, off + j, h FROM b,
    (VALUES (0, 'Order Key'), (1, 'Status'), (2, 'Total ($)'), (3, 'Order Date'), (5, 'Priority'), (6, 'Cust Key')) t(j, h)
    WHERE i = 0
  UNION ALL SELECT file_id, sheet, 11 * b + 1, off + 8, 'Unused' FROM b WHERE i = 0 AND b % 3 = 0
  UNION ALL SELECT file_id, sheet, 11 * b + 2 + i, off, CAST(o_orderkey AS VARCHAR) FROM b
  UNION ALL SELECT file_id, sheet, 11 * b + 2 + i, off + 1, o_orderstatus FROM b
  UNION ALL SELECT file_id, sheet, 11 * b + 2 + i, off + 2, '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) FROM b
  UNION ALL SELECT file_id, sheet, 11 * b + 2 + i, off + 3, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM b
  UNION ALL SELECT file_id, sheet, 11 * b + 2 + i, off + 5, o_orderpriority FROM b WHERE i < 5
  UNION ALL SELECT file_id, sheet, 11 * b + 2 + i, off + 6, CAST(o_custkey AS VARCHAR) FROM b WHERE i < 5),
merges AS (SELECT file_id, sheet, 11 * b AS r, off AS c0, off + 3 AS c1 FROM b WHERE i = 0 AND b % 4 = 0),
occupied AS (SELECT DISTINCT file_id, sheet, r FROM laid),
bands AS (SELECT file_id, sheet, min(r) AS b0, max(r) AS b1 FROM (
    SELECT *, r - row_number() OVER (PARTITION BY file_id, sheet ORDER BY r) AS grp FROM occupied) x
  GROUP BY file_id, sheet, grp),
placed AS (SELECT l.*, b0, b1 FROM laid l JOIN bands USING (file_id, sheet) WHERE r BETWEEN b0 AND b1)
"""

ISLANDS = """
extent AS (SELECT file_id, sheet, b0, min(c) AS lo, max(c) AS hi FROM placed WHERE r > b0 OR b0 = b1 GROUP BY ALL),
used AS (SELECT DISTINCT p.file_id, p.sheet, p.b0, p.b1, p.c FROM placed p JOIN extent USING (file_id, sheet, b0)
  WHERE c BETWEEN lo AND hi),
islands AS (SELECT *, row_number() OVER (PARTITION BY file_id, sheet ORDER BY min_row, min_col) - 1 AS table_index FROM (
  SELECT file_id, sheet, b0 AS min_row, b1 AS max_row, min(c) AS min_col, max(c) AS max_col FROM (
    SELECT *, c - row_number() OVER (PARTITION BY file_id, sheet, b0 ORDER BY c) AS grp FROM used) x
  GROUP BY file_id, sheet, b0, b1, grp) y)
"""

TITLES = """
island_rows AS (SELECT i.*, unnest(range(min_row, max_row + 1)) AS r FROM islands i),
filled AS (SELECT i.file_id, i.sheet, i.table_index, i.min_row, i.max_row, i.min_col, i.max_col, i.r, count(l.c) AS n,
    (SELECT count(*) FROM merges m WHERE m.file_id = i.file_id AND m.sheet = i.sheet AND m.r = i.r
      AND least(m.c1, i.max_col) - greatest(m.c0, i.min_col) >= 1) AS merged
  FROM island_rows i LEFT JOIN laid l ON l.file_id = i.file_id AND l.sheet = i.sheet AND l.r = i.r
    AND l.c BETWEEN i.min_col AND i.max_col GROUP BY ALL),
judged AS (SELECT *, merged > 0 OR (max_col > min_col AND n = 1
    AND lead(n) OVER (PARTITION BY file_id, sheet, table_index ORDER BY r) > 1) AS title FROM filled),
headed AS (SELECT file_id, sheet, table_index, any_value(min_row) AS min_row, any_value(max_row) AS max_row,
    any_value(min_col) AS min_col, any_value(max_col) AS max_col,
    coalesce(min(r) FILTER (NOT coalesce(title, false)), any_value(max_row)) AS header_row FROM judged GROUP BY ALL)
"""

# --- vectors and retrieval --------------------------------------------------------------

FNV = (
    "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(('0x' || substr(hex(encode(term)), 2 * i + 1, 2)) AS BIGINT) "
    "FOR i IN range(CAST(strlen(term) AS BIGINT))]), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
)


def _terms(name: str, source: str, ident: str, text: str = "text") -> str:
    """CTEs ``<name>_tf`` and ``<name>`` (postings by bucket)."""
    return (
        f"{name}_words AS (SELECT {ident} AS id, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{Nd}}]+')) AS term FROM {source}), "
        f"{name}_tf AS (SELECT id, term, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY id) AS BIGINT) AS n_terms FROM {name}_words WHERE strlen(term) >= 2 GROUP BY id, term), "
        f"{name}_dict AS (SELECT term, {FNV} AS hash FROM (SELECT DISTINCT term FROM {name}_tf) d), "
        f"{name} AS (SELECT id, CAST(hash % 1048576 AS INTEGER) AS idx, CAST(sum(tf) AS BIGINT) AS tf, max(n_terms) AS n_terms FROM {name}_tf JOIN {name}_dict USING (term) GROUP BY 1, 2)"
    )


def _sparse(limit: int, questions: str = "benchmark", ident: str = "item_id", text: str = "text") -> str:
    return (
        f"{_terms('d', 'documents', 'doc_id')}, {_terms('q', questions, ident, text)}, "
        "sparse_all AS (SELECT q.id AS query_id, d.id AS doc_id, "
        "round(sum(d.tf * q.tf) / max(d.n_terms * q.n_terms), 6) AS score FROM d JOIN q USING (idx) GROUP BY 1, 2), "
        "sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank "
        f"FROM sparse_all QUALIFY rank <= {limit})"
    )


def _dense(limit: int) -> str:
    return (
        "n AS (SELECT count(*) AS n FROM embeddings), "
        "dd AS (SELECT doc_id, embedding::DOUBLE[] AS v FROM documents, n JOIN embeddings ON vec_id = doc_id % n.n), "
        "dq AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark, n JOIN embeddings ON vec_id = item_id % n.n), "
        "dense AS (SELECT query_id, doc_id, round(list_cosine_similarity(dd.v, dq.v), 6) AS score, "
        f"row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(dd.v, dq.v), 6) DESC, doc_id) AS rank FROM dd, dq QUALIFY rank <= {limit})"
    )


def _fused(limit: int) -> str:
    return (
        "fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ("
        "SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (2 + rank - 1)), 6) AS score FROM ("
        "SELECT query_id, doc_id, rank FROM dense UNION ALL SELECT query_id, doc_id, rank FROM sparse) l "
        f"GROUP BY ALL) s QUALIFY rank <= {limit})"
    )


HITS = (
    f"{_sparse(FETCH)}, "
    "hits AS (SELECT s.*, t.text, t.lang, CASE WHEN lang = 'fr' THEN '' ELSE source END AS table_key, "
    "source || '.csv' AS source_file, CASE WHEN lang = 'en' THEN '' ELSE lang END AS sheet, "
    "CASE WHEN lang = 'es' THEN '' ELSE 'Texts from ' || source END AS summary "
    "FROM sparse s JOIN documents t USING (doc_id)), "
    "capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_key ORDER BY rank) AS nth FROM hits QUALIFY nth <= 3), "
    f"diverse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM capped QUALIFY place <= {TOP_K}), "
    "best AS (SELECT * FROM hits WHERE table_key <> '' QUALIFY row_number() OVER (PARTITION BY query_id, table_key ORDER BY rank) = 1), "
    "candidates AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS table_rank FROM best), "
    "sampled AS (SELECT query_id, table_key, text, row_number() OVER (PARTITION BY query_id, table_key ORDER BY rank) AS nth "
    "FROM hits WHERE table_key <> '' AND text <> '' QUALIFY nth <= 5), "
    "asked AS (SELECT item_id AS query_id, CASE WHEN item_id % 10 = 0 THEN '? !' ELSE text END AS question FROM benchmark)"
)


def _column_line(name: str, original: str, kind: str) -> str:
    if original in ("", name):
        return f"  - {name} ({kind})"
    escaped = original.replace("\\", "\\\\").replace('"', '\\"')
    return f'  - {name}  [original: "{escaped}"]  ({kind})'


def _text(value: str) -> str:
    """A text with line breaks as an expression."""
    return " || chr(10) || ".join(_quote(line) for line in value.split("\n"))


# --- the queries ------------------------------------------------------------------------


def _grid_oracles() -> dict[str, str]:
    return {
        "row_bands": f"WITH {GRID} SELECT file_id, sheet, b0 AS band_start, b1 AS band_end, "
        "count(DISTINCT r) AS n_rows, count(*) AS n_cells FROM placed GROUP BY ALL",
        "table_islands": f"WITH {GRID}, {ISLANDS} SELECT file_id, sheet, table_index, min_row, max_row, min_col, max_col FROM islands",
        "title_rows_skipped": f"WITH {GRID}, {ISLANDS}, {TITLES} SELECT file_id, sheet, table_index, header_row, "
        "header_row - min_row AS titles FROM headed",
        "table_extract": f"WITH {GRID}, {ISLANDS}, {TITLES}, "
        "every AS (SELECT h.*, unnest(range(header_row, max_row + 1)) AS r FROM headed h), "
        "spread AS (SELECT e.*, unnest(range(min_col, max_col + 1)) AS c FROM every e), "
        "lines AS (SELECT s.file_id, s.sheet, s.table_index, s.header_row, s.r, "
        "string_agg(coalesce(l.v, ''), '|' ORDER BY s.c) AS t FROM spread s LEFT JOIN laid l "
        "ON l.file_id = s.file_id AND l.sheet = s.sheet AND l.r = s.r AND l.c = s.c GROUP BY ALL) "
        "SELECT x.file_id, x.sheet, x.table_index, x.r - x.header_row - 1 AS row_index, h.t AS header_text, x.t AS row_text "
        "FROM lines x JOIN lines h ON h.file_id = x.file_id AND h.sheet = x.sheet AND h.table_index = x.table_index "
        "AND h.r = x.header_row WHERE x.r > x.header_row",
    }


def _type_oracles() -> dict[str, str]:
    plain = f"WITH {_cells()}, {_types()}"
    return {
        "normalize_headers": f"WITH given AS ({_given(inputs.HEADER_TEXTS)}), {_names('given')}, "
        "again AS (SELECT *, row_number() OVER (PARTITION BY table_key, name ORDER BY col_index) AS k FROM headers) "
        "SELECT table_key, col_index, name, original_name, CASE WHEN k > 1 THEN name || '__' || k ELSE name END AS storage_name FROM again",
        "clean_numeric": f"SELECT l_orderkey, l_linenumber, raw, {_clean('raw')} AS cleaned, {_double('raw')} AS value "
        f"FROM ({_given(inputs.NUMBERS)}) x",
        "infer_types": f"{plain}, {_headers()} SELECT table_key, col_index, name, type, n_values, n_boolean, n_integer, "
        "n_double, n_date, n_timestamp FROM types JOIN headers USING (table_key, col_index)",
        "typed_cast": f"{plain} SELECT table_key, row_index, col_index, v_bool, v_long, v_double, "
        f"CAST(v_date AS VARCHAR) AS v_date, epoch_us(v_ts) AS v_ts, v_string FROM ({VALUES}) t",
        "materialize_table": f"SELECT * REPLACE (epoch_us(when_utc) AS when_utc) FROM ({_wide('events')}) t",
        "csv_ingest": f"{plain} SELECT table_key || '_v' || col_index AS name, type, count(*) AS n_rows, "
        "count(coalesce(CAST(v_bool AS VARCHAR), CAST(v_long AS VARCHAR), CAST(v_double AS VARCHAR), "
        "CAST(v_date AS VARCHAR), CAST(v_ts AS VARCHAR), v_string)) AS n_values, "
        f"CAST(coalesce(sum(v_long), 0) AS BIGINT) AS sum_long FROM ({VALUES}) t GROUP BY ALL",
    }


def _chunk_oracles() -> dict[str, str]:
    sheets = dict(
        key="'customer-' || (row_index // 100)", row="row_index % 100"
    )
    header = inputs.HEADERS["customer"]
    named = ", ".join(f"({i}, {_quote(h)})" for i, h in enumerate(header))
    listed = " | ".join(header)
    sheet_title = "'Table: customers.xlsx / ' || replace(table_key, 'customer-', 'Sheet ')"
    chunk = _uuid(chr(39).join(["table_key || ", ".csv||0|", " || row_index"]))
    return {
        "csv_rows": "WITH d AS (SELECT source || '-' || CAST(doc_id // 1000 AS VARCHAR) AS part, doc_id, replace(coalesce(text, ''), chr(13), '') AS t FROM documents), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS r FROM d), "
        "c AS (SELECT part, r, CASE doc_id % 4 WHEN 1 THEN [part, CAST(doc_id AS VARCHAR), t, 'extra', ''] "
        "WHEN 2 THEN [part, CAST(doc_id AS VARCHAR), 'x\" y \"z ', 'a \"b\" c'] ELSE [part, CAST(doc_id AS VARCHAR), t] END AS cells FROM r) "
        "SELECT part, r, CAST(col - 1 AS INTEGER) AS col, length(cells[col]) AS size, md5(cells[col]) AS digest FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS col FROM c) u",
        "listed_files": "SELECT '.csv' AS extension, 'csv' AS reader, '' AS reason, count(DISTINCT c_mktsegment) AS n_files FROM customer "
        "UNION ALL SELECT '.json', '', 'unsupported file type: .json', count(DISTINCT p_type) FROM part "
        "UNION ALL SELECT '.txt', '', 'unsupported file type: .txt', count(DISTINCT c_nationkey) FROM customer",
        "ingest_files": f"WITH {_cells('customer')}, texts AS (SELECT row_index, string_agg('customer v' || col_index || ': ' || v, ' | ' ORDER BY col_index) AS text FROM cells WHERE v <> '' GROUP BY ALL), "
        "total AS (SELECT count(*) AS n_chunks FROM texts) "
        f"SELECT text, 'Some customers' AS summary, {inputs.WIDTH} AS n_columns, {DIMS} AS dims, count(*) AS n, 5 AS n_files, 5 AS n_tables, n_chunks FROM texts, total GROUP BY ALL",
        "index_payload": f"{_texts()}, {_types()}, columns AS (SELECT table_key, string_agg(name || '/' || original_name || '/' || type, ';' ORDER BY col_index) AS columns FROM types JOIN headers USING (table_key, col_index) GROUP BY 1) "
        f"SELECT {chunk} AS chunk_id, table_key, 'file-' || table_key AS file_id, table_key || '.csv' AS source_file, '' AS sheet, 0 AS table_index, row_index, text, "
        "'asked of ' || table_key AS hyde, 'about ' || table_key AS summary, columns FROM texts JOIN columns USING (table_key)",
        "row_chunks": f"{_texts()} SELECT table_key, row_index, text, {inputs.WIDTH} AS n_columns FROM texts",
        "chunk_ids": f"{_texts()} SELECT table_key, row_index, {_uuid(chr(39).join(['table_key || ', '.csv||0|', ' || row_index']))} AS chunk_id FROM texts",
        "hyde_prompts": f"WITH {_cells('customer', **sheets)}, {_types()}, names(col_index, h) AS (VALUES {named}), "
        "columns AS (SELECT table_key, string_agg(h || ' (' || type || ')', ', ' ORDER BY col_index) AS cols "
        "FROM types JOIN names USING (col_index) GROUP BY ALL), "
        "texts AS (SELECT table_key, row_index, string_agg(h || ': ' || v, ' | ' ORDER BY col_index) AS t "
        "FROM cells JOIN names USING (col_index) WHERE v <> '' AND row_index < 20 GROUP BY ALL), "
        "samples AS (SELECT table_key, string_agg(t || chr(10), '' ORDER BY row_index) AS s FROM texts GROUP BY ALL) "
        f"SELECT table_key, {sheet_title} || chr(10) || 'Columns: ' || cols || chr(10) || chr(10) || 'Sample data:' || chr(10) "
        "|| coalesce(s, '') AS prompt FROM columns LEFT JOIN samples USING (table_key)",
        "summary_prompts": f"WITH {_cells('customer', **sheets)}, "
        "sizes AS (SELECT table_key, max(row_index) + 1 AS n FROM text_rows GROUP BY ALL), "
        "lines AS (SELECT table_key, row_index, string_agg(raw, ' | ' ORDER BY col_index) AS t FROM cells WHERE row_index < 30 GROUP BY ALL), "
        "samples AS (SELECT table_key, string_agg(t || chr(10), '' ORDER BY row_index) AS s FROM lines GROUP BY ALL) "
        f"SELECT table_key, {sheet_title} || chr(10) || 'Total rows: ' || n || chr(10) || 'Columns (original names): ' || "
        f"{_quote(', '.join(header))} || chr(10) || chr(10) || 'Sample data:' || chr(10) || {_quote(listed)} || chr(10) || s AS prompt "
        "FROM sizes JOIN samples USING (table_key)",
    }


def _retrieval_oracles() -> dict[str, str]:
    docs = _terms("d", "documents", "doc_id")
    twice = TOP_K * fixed.BRANCH_FACTOR
    return {
        "token_tf": f"WITH {docs} SELECT id AS doc_id, term, tf, n_terms FROM d_tf",
        "term_hash": f"WITH {docs} SELECT term, hash, CAST(hash % 1048576 AS INTEGER) AS idx FROM d_dict",
        "tf_sparse": f"WITH {docs} SELECT id AS doc_id, idx, round(CAST(CAST(tf / n_terms AS FLOAT) AS DOUBLE), 9) AS w FROM d",
        "embed_batches": "WITH words AS (SELECT doc_id, md5(unnest(regexp_extract_all("
        "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0b\\x0c\\r]+'))) AS h FROM documents), "
        f"sums AS (SELECT doc_id, (('0x' || substr(h, 1, 8))::BIGINT % {DIMS})::INTEGER AS pos, "
        "sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM words GROUP BY ALL) "
        "SELECT doc_id, pos, round((x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 6) AS x FROM sums WHERE x <> 0",
        "dense_topk": "WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings), "
        "avgs AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY ALL), "
        "means AS (SELECT label, list(x ORDER BY pos) AS v FROM avgs GROUP BY ALL) "
        "SELECT label AS query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score, "
        "row_number() OVER (PARTITION BY label_q ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v), 6) DESC, vec_id) AS rank "
        "FROM (SELECT vec_id, embedding FROM embeddings) e, (SELECT label, label AS label_q, v FROM means) m "
        f"QUALIFY rank <= {twice}",
        "sparse_topk": f"WITH {_sparse(twice)} SELECT query_id, doc_id, score, rank FROM sparse",
        "rrf_fusion": f"WITH {_dense(twice)}, {_sparse(twice)}, {_fused(TOP_K)} SELECT query_id, doc_id, score, rank FROM fused",
        "hybrid_search": f"WITH {_dense(2 * FETCH)}, {_sparse(2 * FETCH)}, {_fused(FETCH)} "
        "SELECT query_id, doc_id, score, rank, source, lang, n_chars FROM fused JOIN documents USING (doc_id)",
        "diversify_hits": f"WITH {HITS} SELECT query_id, place, rank, doc_id, table_key FROM diverse",
        "table_candidates": f"WITH {HITS} SELECT query_id, table_rank, table_key, doc_id FROM candidates",
        "table_samples": f"WITH {HITS} SELECT query_id, table_key, count(*) AS n, "
        "sha256(string_agg(text, chr(10) ORDER BY nth)) AS digest FROM sampled GROUP BY ALL",
        "hit_sources": f"WITH {HITS} SELECT query_id, place, source_file, sheet, 0 AS table_index, doc_id AS row_index, table_key, score FROM diverse",
        "key_filter": "SELECT doc_id, source AS table_key, n_chars FROM documents WHERE source IN ('src1', 'src7')",
        "raw_answers": f"WITH {HITS} SELECT query_id, {_trim('string_agg(text, chr(10) ORDER BY place)')} AS answer "
        "FROM diverse WHERE place <= 3 GROUP BY ALL",
    }


def _answers(instructions: str) -> str:
    """Answers of the scripted model, by a question's number modulo 6."""
    ran = f"CASE kind WHEN 3 THEN {_quote(NOTHING)} ELSE {_quote(GROUPED)} END"
    return (
        f"WITH {HITS}, marked AS (SELECT query_id, query_id % {ANSWER_KINDS} AS kind, question || ' #' || query_id % {ANSWER_KINDS} || '#' AS q FROM asked), "
        "found AS (SELECT * FROM diverse WHERE query_id % 10 <> 0), "
        "open AS (SELECT query_id FROM found WHERE place = 1 AND table_key <> ''), "
        "firsts AS (SELECT * FROM found WHERE summary <> '' QUALIFY row_number() OVER (PARTITION BY query_id, table_key ORDER BY place) = 1), "
        "about AS (SELECT query_id, string_agg('[' || source_file || CASE WHEN sheet = '' THEN '' ELSE '/' || sheet END || ']: ' || summary, chr(10) ORDER BY place) AS a FROM firsts GROUP BY ALL), "
        "context AS (SELECT query_id, string_agg('[' || place || '] ' || text, chr(10) ORDER BY place) AS t FROM found WHERE place <= 5 GROUP BY ALL), "
        "prompts AS (SELECT query_id, length(CASE WHEN a IS NULL THEN '' ELSE 'Table descriptions:' || chr(10) || a || chr(10) || chr(10) END || 'Question: ' || q "
        f"|| chr(10) || chr(10) || 'Context (table rows):' || chr(10) || t || {_text(chr(10) + chr(10) + instructions)}) AS size FROM context JOIN marked USING (query_id) LEFT JOIN about USING (query_id)), "
        "langs AS (SELECT source AS table_key, lang, count(*) AS n FROM documents GROUP BY ALL), "
        "shown AS (SELECT table_key, 'from rows: lang | n' || chr(10) || '--------' || chr(10) || string_agg(coalesce(lang, '<nil>') || ' | ' || n, chr(10) ORDER BY lang) AS t, count(*) AS n FROM langs GROUP BY 1), "
        "listed AS (SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY place) AS s FROM found GROUP BY 1), "
        "tried AS (SELECT query_id, table_rank, kind, table_key, CASE kind WHEN 3 THEN 0 ELSE n END AS n, shown.t, "
        f"table_rank || '/' || table_key || '/' || source_file || '/' || sheet || '/0/' || CASE kind WHEN 3 THEN 0 ELSE n END || '/' || {ran} AS line "
        "FROM candidates JOIN marked USING (query_id) JOIN open USING (query_id) JOIN shown USING (table_key) WHERE kind = 3 OR (kind IN (1, 4) AND table_rank = 1)), "
        "lines AS (SELECT query_id, string_agg(line, ';' ORDER BY table_rank) AS l FROM tried GROUP BY 1), "
        "won AS (SELECT query_id, t FROM tried WHERE kind = 1) "
        f"SELECT m.query_id, CASE WHEN size IS NULL THEN {_quote(fixed.NO_HITS_ANSWER)} WHEN won.t IS NOT NULL THEN won.t WHEN kind = 5 THEN '' ELSE 'from text: ' || size END AS answer, "
        "CASE WHEN size IS NULL THEN 'none' WHEN won.t IS NOT NULL THEN 'sql' ELSE 'text' END AS route, "
        "CASE WHEN size IS NOT NULL AND kind = 5 THEN 'RuntimeError: no text' ELSE '' END AS error, "
        "coalesce(s, '') AS sources, coalesce(l, '') AS attempts FROM marked m LEFT JOIN prompts USING (query_id) LEFT JOIN won USING (query_id) "
        "LEFT JOIN listed USING (query_id) LEFT JOIN lines USING (query_id)"
    )


def _statement_oracles() -> dict[str, str]:
    low = f"lower({_trim('sql')})"
    tokens = " ".join(
        f"WHEN contains({low}, {_quote(t)}) THEN {_quote('disallowed token: ' + t.strip())}" for t in fixed.DISALLOWED_SQL
    )
    replies = " UNION ALL ".join(
        f"SELECT q, {n} AS table_rank, {_quote(key)} AS table_key, replace({_quote(text)}, '{{q}}', q) AS sql FROM segments"
        for n, key, text in ATTEMPT_REPLIES
    )
    lines = "\n".join(_column_line(*c) for c in DOCUMENT_SCHEMA)
    from gridloom.operators.prompts import CONTEXT_INSTRUCTIONS, RESULT_INSTRUCTIONS, SQL_INSTRUCTIONS

    return {
        "validate_sql": f"SELECT p_partkey, sql, reason = '' AS accepted, reason FROM (SELECT *, CASE WHEN {low} = '' THEN 'empty query' "
        f"WHEN NOT starts_with({low}, 'select') THEN 'only SELECT queries are allowed' {tokens} ELSE '' END AS reason "
        f"FROM ({_given(inputs.STATEMENTS)}) s) t",
        "clean_sql": "WITH a AS (SELECT p_partkey, " + _trim("reply") + f" AS t FROM ({_given(inputs.REPLIES)}) r), "
        "b AS (SELECT p_partkey, CASE WHEN starts_with(t, '```') THEN regexp_replace("
        + _trim("CASE WHEN contains(t, chr(10)) THEN substr(t, strpos(t, chr(10)) + 1) ELSE t END")
        + ", '```$', '') ELSE t END AS t FROM a), "
        "c AS (SELECT p_partkey, " + _trim("t") + " AS t FROM b), "
        "d AS (SELECT p_partkey, CASE WHEN ends_with(t, ';') THEN substr(t, 1, length(t) - 1) ELSE t END AS sql FROM c) "
        "SELECT p_partkey, sql, lower(sql) = 'skip' AS irrelevant FROM d",
        "sql_attempts": f"WITH data AS ({_wide('customer')}), segments AS (SELECT DISTINCT c_mktsegment AS q FROM customer), "
        f"tries AS ({replies}), found AS (SELECT segment AS q, count(*) AS n, count(acct_bal) AS b FROM data GROUP BY ALL) "
        "SELECT q AS query_id, table_rank, table_key, sql, ['skipped', 'rejected', 'failed', 'empty', 'rows'][table_rank] AS status, "
        "CASE table_rank WHEN 4 THEN '[]' WHEN 5 THEN '[{\"n\":' || n || ',\"with_balance\":' || b || '}]' ELSE '' END AS rows_json "
        "FROM tries JOIN found USING (q) WHERE table_rank <= 5",
        "answer_routes": "WITH questions AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN '? !' ELSE text END AS question FROM benchmark), "
        f"{_sparse(FETCH, 'questions', 'item_id', 'question')}, "
        "hits AS (SELECT s.*, CASE WHEN lang = 'fr' THEN '' ELSE source END AS table_key FROM sparse s JOIN documents USING (doc_id)), "
        "top AS (SELECT query_id, table_key AS top_key FROM hits WHERE rank = 1), "
        "best AS (SELECT query_id, table_key FROM hits WHERE table_key <> '' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1), "
        "poor AS (SELECT DISTINCT source FROM labels JOIN documents USING (doc_id) WHERE quality = 0 AND lang = 'de') "
        "SELECT item_id AS query_id, CASE WHEN top_key IS NULL THEN 'none' WHEN top_key <> '' AND best.table_key IN (SELECT source FROM poor) "
        "THEN 'sql' ELSE 'text' END AS route FROM questions LEFT JOIN top ON top.query_id = item_id LEFT JOIN best ON best.query_id = item_id",
        "answers": _answers(CONTEXT_INSTRUCTIONS),
        "completions": "SELECT p_partkey, CASE WHEN contains(p_type, 'COPPER') THEN '' ELSE 'About: ' || lower('Part ' || p_type) || ', ' || length('Part ' || p_type) || ' letters' END AS reply, "
        "CASE WHEN contains(p_type, 'COPPER') THEN 'RuntimeError: no reply to Part ' || p_type ELSE '' END AS error FROM part",
        "result_prompts": f"WITH data AS ({_wide('customer')}), rows AS (SELECT segment AS query_id, nation, count(*) AS n, max(acct_bal) AS top FROM data GROUP BY ALL), "
        f"texts AS (SELECT query_id, string_agg(n || ' | ' || coalesce(CAST(nation AS VARCHAR), '<nil>') || ' | ' || coalesce({_small_number('top')}, '<nil>'), chr(10) ORDER BY nation NULLS LAST) AS t FROM rows GROUP BY 1) "
        "SELECT query_id, CASE WHEN query_id < 'F' THEN 'Table description:' || chr(10) || 'Customers' || chr(10) || chr(10) ELSE '' END || 'Question: How is ' || query_id || '?' || "
        "chr(10) || chr(10) || 'SQL query executed:' || chr(10) || replace('SELECT nation, count(*) AS n, max(acct_bal) AS top FROM data WHERE segment = ''{q}'' GROUP BY nation ORDER BY nation NULLS LAST', '{q}', query_id) || "
        f"chr(10) || chr(10) || 'Results:' || chr(10) || 'n | nation | top' || chr(10) || '{'-' * 16}' || chr(10) || t || {_text(chr(10) + chr(10) + RESULT_INSTRUCTIONS)} AS prompt FROM texts",
        "no_hits": f"SELECT item_id AS query_id, {_quote(fixed.NO_HITS_ANSWER)} AS answer, 0 AS n_sources, 0 AS n_attempts FROM benchmark WHERE item_id % 10 = 0 "
        f"UNION ALL (WITH {HITS} SELECT query_id, {_quote(fixed.NO_HITS_ANSWER)}, 0, 0 FROM asked WHERE query_id % 10 <> 0 AND query_id NOT IN (SELECT query_id FROM hits))",
        "sql_prompts": f"WITH {HITS}, shown AS (SELECT query_id, table_key, string_agg('  ' || text || chr(10), '' ORDER BY nth) AS s FROM sampled GROUP BY ALL), "
        f"made AS (SELECT c.query_id, table_rank, c.table_key, {_text('Table name: data' + chr(10) + 'Schema:' + chr(10) + lines + chr(10))} "
        "|| coalesce(chr(10) || 'Sample data rows:' || chr(10) || s, '') || chr(10) || 'Question: ' || question || "
        f"{_text(chr(10) + chr(10) + SQL_INSTRUCTIONS)} AS prompt FROM candidates c LEFT JOIN shown USING (query_id, table_key) JOIN asked USING (query_id)) "
        "SELECT query_id, table_rank, table_key, sha256(prompt) AS digest, length(prompt) AS length FROM made",
        "chunk_prompts": f"WITH {HITS}, firsts AS (SELECT * FROM diverse WHERE summary <> '' QUALIFY row_number() OVER (PARTITION BY query_id, table_key ORDER BY place) = 1), "
        "about AS (SELECT query_id, string_agg('[' || source_file || CASE WHEN sheet = '' THEN '' ELSE '/' || sheet END || ']: ' || summary, chr(10) ORDER BY place) AS a FROM firsts GROUP BY ALL), "
        "context AS (SELECT query_id, string_agg('[' || place || '] ' || text, chr(10) ORDER BY place) AS t FROM diverse WHERE place <= 5 GROUP BY ALL) "
        "SELECT query_id, CASE WHEN a IS NULL THEN '' ELSE 'Table descriptions:' || chr(10) || a || chr(10) || chr(10) END || 'Question: ' || question "
        f"|| chr(10) || chr(10) || 'Context (table rows):' || chr(10) || t || {_text(chr(10) + chr(10) + CONTEXT_INSTRUCTIONS)} AS prompt "
        "FROM context JOIN asked USING (query_id) LEFT JOIN about USING (query_id)",
    }


def _small_number(x: str) -> str:
    """Plain decimal text of a number that has at most two decimals."""
    return f"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(28,2)) AS VARCHAR), '0+$', ''), '\\.$', '')"


def _big_number(x: str) -> str:
    """Text with an exponent of a whole number from a million on."""
    whole = f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
    digits = f"rtrim({whole}, '0')"
    return (
        f"(substr({digits}, 1, 1) || CASE WHEN length({digits}) > 1 THEN '.' || substr({digits}, 2) ELSE '' END "
        f"|| 'e+' || lpad(CAST(length({whole}) - 1 AS VARCHAR), 2, '0'))"
    )


def _sql_oracles() -> dict[str, str]:
    out = {name: f"WITH data AS ({_wide(key)}) {statement}" for name, (key, statement) in SQL_STATEMENTS.items()}
    out["sql_having"] = out["sql_having"].replace("SELECT user,", 'SELECT "user",').replace("GROUP BY user", 'GROUP BY "user"')
    columns = ["flag", "high", "last_seen", "low", "n", "top_flagged", "type"]
    header = " | ".join(columns)
    out["format_rows"] = (
        f"WITH data AS ({_wide('events')}), r AS (SELECT type, flag, count(value) AS n, min(value) AS low, "
        "round(max(value)) * 1000000 AS high, max(when_utc) AS last_seen, max(CASE WHEN flag THEN value END) AS top_flagged FROM data GROUP BY type, flag) "
        f"SELECT 'header' AS kind, {_quote(header)} AS text UNION ALL SELECT 'rule', {_quote('-' * len(header))} UNION ALL "
        f"SELECT 'row', concat_ws(' | ', CAST(flag AS VARCHAR), {_big_number('high')}, "
        f"strftime(last_seen, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(last_seen) % 1000000 = 0 THEN '' ELSE '.25' END || ' +0000 UTC', "
        f"{_small_number('low')}, CAST(n AS VARCHAR), coalesce({_small_number('top_flagged')}, '<nil>'), type) FROM r"
    )
    return out


def _state_oracles() -> dict[str, str]:
    base = "SELECT 'doc-' || doc_id AS chunk_id, source AS file_id, lang, n_chars AS size FROM documents"
    columns = ", ".join(f"({i}, {_quote(n)}, {_quote(o)}, {_quote(t)})" for i, (n, o, t) in enumerate(DOCUMENT_SCHEMA))
    return {
        "index_upsert": f"WITH old AS ({base}), incoming AS ("
        "SELECT 'doc-' || doc_id AS chunk_id, 'again-' || source AS file_id, lang, n_chars + quality + 1 AS size FROM labels JOIN documents USING (doc_id) "
        "UNION ALL SELECT 'conv-' || conv_id, 'talk', 'en', length(text) FROM conversations), "
        "batch AS (SELECT chunk_id, any_value(file_id) AS file_id, any_value(lang) AS lang, max(size) AS size FROM incoming GROUP BY ALL) "
        "SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM batch) UNION ALL SELECT * FROM batch",
        "index_delete": f"SELECT * FROM ({base}) o WHERE NOT (file_id = 'src3' OR lang = 'fr')",
        "catalog_list": f"WITH cols(col_index, name, original_name, type) AS (VALUES {columns}), "
        "t AS (SELECT source, lang, count(*) AS row_count, count(*) FILTER (n_chars > 0) AS chunks FROM documents GROUP BY ALL), "
        "f AS (SELECT source, count(*) AS tables_found, CAST(sum(chunks) AS BIGINT) AS chunks_count FROM t GROUP BY ALL) "
        "SELECT source AS id, source || '.xlsx' AS filename, tables_found, chunks_count, lang AS sheet_name, source || '/' || lang AS table_key, "
        "row_count, col_index, name, original_name, type FROM t JOIN f USING (source), cols",
        "run_metrics": "SELECT user_id, count(*) AS requests_total, CAST(sum(floor(value)) AS BIGINT) AS total_duration_ms, "
        "count(*) FILTER (event_type IN ('view', 'click')) AS sql_path, count(*) FILTER (event_type NOT IN ('view', 'click', 'error')) AS text_path, "
        "CAST(round(sum(floor(value)) / count(*)) AS BIGINT) AS mean_ms FROM events GROUP BY user_id",
        "streaming_ingest": f"WITH {_terms('d', 'documents', 'doc_id')}, per AS (SELECT id, any_value(n_terms) AS n_terms, count(*) AS n_buckets FROM d GROUP BY id) "
        f"SELECT {_uuid(chr(39).join(['source || ', '.csv|', ' || lang || ', '|0|', ' || doc_id']))} AS chunk_id, source || '.csv' AS source_file, "
        f"lang AS sheet, doc_id AS row_index, coalesce(n_terms, 0) AS n_terms, coalesce(n_buckets, 0) AS n_buckets, {DIMS} AS dims "
        "FROM documents LEFT JOIN per ON id = doc_id WHERE text <> ''",
    }


def all_oracles() -> dict[str, str]:
    return {
        **_type_oracles(),
        **_sql_oracles(),
        **_grid_oracles(),
        **_chunk_oracles(),
        **_retrieval_oracles(),
        **_statement_oracles(),
        **_state_oracles(),
    }

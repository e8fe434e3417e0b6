"""Registered queries of the operators, with production parameters, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import alignment, chat, lines, mixing, near_copies, neighbours, ngram_model, packing, pii, quality, ranked_search, substrings, toxicity
from gridloom.llm.common import table
from gridloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.strip_repeats(table(spark, sf_dir, "documents")).drop("kept")


LINE_DEDUP = r"""
WITH all_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), inked AS (
  SELECT doc_id, i, regexp_replace(line, '^[ \t\x0b\x0c\r]+|[ \t\x0b\x0c\r]+$', '', 'g') AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM all_lines WHERE regexp_matches(line, '[^ \t\x0a\x0b\x0c\r]')
), sized AS (
  SELECT *, len(regexp_split_to_array(line, '[ \t\x0b\x0c\r]+')) AS w,
         lead(line) OVER o AS line2, lead(line, 2) OVER o AS line3
  FROM inked WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), counted AS (
  SELECT *, lead(w) OVER o AS w2 FROM sized WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, p, 1 AS n, line AS run FROM counted WHERE w >= 8
  UNION ALL SELECT doc_id, p, 2, line || chr(10) || line2 FROM counted WHERE line2 IS NOT NULL AND w + w2 >= 8
  UNION ALL SELECT doc_id, p, 3, line || chr(10) || line2 || chr(10) || line3 FROM counted WHERE line3 IS NOT NULL
), later AS (
  SELECT doc_id, p, n FROM (SELECT doc_id, p, n, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, p) AS r FROM runs) WHERE r > 1
), gone AS (
  SELECT DISTINCT i.doc_id, i.i FROM inked i JOIN later l ON l.doc_id = i.doc_id AND i.p BETWEEN l.p AND l.p + l.n - 1
), kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.i) AS text
  FROM all_lines a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(n.n, 0) AS n_lines, coalesce(g.n, 0) AS n_deleted
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM inked GROUP BY 1) n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON g.doc_id = d.doc_id
"""


@query(LINE_DEDUP)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "bucket", "boundary", "batch", "slot")


NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0
  )
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * m >= 4 * (p.n + q.n - m)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b
)
SELECT d.doc_id, c.class_id, coalesce(n.n, 0) AS n_links FROM documents d
JOIN (SELECT a, min(b) AS class_id FROM reach GROUP BY 1) c ON c.a = d.doc_id
LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY 1) n ON n.x = d.doc_id
"""


@query(NEAR)
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query()
def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score_texts(table(spark, sf_dir, "documents"))


@query()
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


MIXING = """
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY 1),
weighted AS (SELECT source, size, CASE WHEN size > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM sizes),
rates AS (
  SELECT source, CASE WHEN w > 0 THEN w / (SELECT sum(w) FROM weighted) * (SELECT sum(size) FROM weighted) * 1.0::DOUBLE / size ELSE 0.0::DOUBLE END AS mean
  FROM weighted
), parts AS (SELECT source, greatest(1, ceil(mean / 8.0))::INTEGER AS parts, mean FROM rates),
steps AS (
  SELECT source, mean / parts AS m, 0 AS k, exp(-(mean / parts)) AS p, exp(-(mean / parts)) AS cdf FROM parts
  UNION ALL SELECT source, m, k + 1, p * m / (k + 1)::DOUBLE, cdf + p * m / (k + 1)::DOUBLE FROM steps WHERE k < 64
), draws AS (
  SELECT d.doc_id, d.source, ((('0x' || substr(md5('mix:' || d.doc_id || ':' || g.i), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts q ON q.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(generate_series(1, q.parts)) AS i) g
), copies AS (
  SELECT w.doc_id, count(*) AS n FROM draws w JOIN steps s ON s.source IS NOT DISTINCT FROM w.source AND s.cdf < w.u GROUP BY 1
)
SELECT d.*, c.copy::INTEGER AS copy, md5('mix:order:' || d.doc_id || ':' || c.copy) AS order_key
FROM documents d JOIN (SELECT doc_id, unnest(generate_series(1, n)) AS copy FROM copies) c ON c.doc_id = d.doc_id
"""


@query(MIXING)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), tags=True)


LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SEARCH = rf"""
WITH items AS (
  SELECT item_id, i, unnest(list_distinct(regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t
  FROM (SELECT item_id, text, row_number() OVER () AS i FROM benchmark)
), words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, {LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)
), counts AS (SELECT r, doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY 1),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
weight AS (
  SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM counts GROUP BY 1), total
), pad AS (SELECT r, 50 + ((50 * n * big_n) // big_l) AS m FROM sizes, total),
scored AS (
  SELECT item_id, i, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM items JOIN counts USING (t) JOIN weight USING (t) JOIN pad USING (r) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query(SEARCH)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, length(role) + length(text) + length('<|turn|><|says|><|end|>')
    + len(regexp_extract_all(role || ' ' || text, '<\\*(?:\|(?:turn|says|end|image|audio|document|attachment)\|>|/?s>)|\[\\*/?INST\]')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY 1
"""


@query(CHAT)
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(spark, table(spark, sf_dir, "conversations"))


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))[0]


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

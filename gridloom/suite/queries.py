"""The registered queries: each reads whole given tables and returns a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.functions.parse import as_double, clean_number
from gridloom.functions.text import term_bucket, fnv1a
from gridloom.operators import chunks as ck
from gridloom.operators import grid as g
from gridloom.operators import hooks, prompts, retrieval, routing, runlog, schema, sqlguard, typed, vectors
from gridloom.operators.replies import CallStore
from gridloom.plans.answer import answer_hits
from gridloom.plans.ingest import Store, ingest
from gridloom.session import fresh_path, prepare, written
from gridloom.sources import catalog
from gridloom.sources.csv import scan_csv
from gridloom.sources.listing import list_files
from gridloom.sources.store import KeyedStore
from gridloom.sources.tables import table_path, write_tables
from gridloom.streaming.ingest import TEXT_ROWS, index_stream
from gridloom.suite import inputs
from gridloom.suite.inputs import table

Query = Callable[[SparkSession, str], DataFrame]
TOP_K = 10
FETCH = TOP_K * fixed.FETCH_FACTOR
DIMS = 64

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- names, types, values ---------------------------------------------------------------


@query
def normalize_headers(spark, sf_dir):
    headers = spark.sql(inputs.HEADER_TEXTS, part=table(spark, sf_dir, "part"))
    return schema.normalize_headers(headers)


@query
def clean_numeric(spark, sf_dir):
    raw = spark.sql(inputs.NUMBERS, lineitem=table(spark, sf_dir, "lineitem"))
    return raw.select(
        "l_orderkey", "l_linenumber", "raw", clean_number("raw").alias("cleaned"), as_double("raw").alias("value")
    )


@query
def infer_types(spark, sf_dir):
    rows = inputs.text_rows(spark, sf_dir)
    columns = schema.normalize_headers(schema.header_columns(inputs.text_tables(rows)))
    return schema.infer_types(rows, columns, keep_counts=True).select(
        "table_key", "col_index", "name", "type", *schema.COUNTS
    )


def _described(spark, sf_dir, *names):
    rows = inputs.text_rows(spark, sf_dir, *names)
    return schema.describe_tables(inputs.text_tables(rows, *names), rows), rows


@query
def typed_cast(spark, sf_dir):
    described, rows = _described(spark, sf_dir)
    return typed.typed_cells(rows, described).select(
        "table_key",
        "row_index",
        "col_index",
        F.col("v_bool").cast("int").alias("v_bool"),
        "v_long",
        "v_double",
        F.col("v_date").cast("string").alias("v_date"),
        F.unix_micros("v_ts").alias("v_ts"),
        "v_string",
    )


@query
def materialize_table(spark, sf_dir):
    described, rows = _described(spark, sf_dir, "events")
    wide = typed.materialize_table(rows, typed.table_columns(described, "events"))
    return wide.withColumn("when_utc", F.unix_micros("when_utc"))


# --- stored tables and SQL over them ----------------------------------------------------

_stored: dict[tuple[str, str], str] = {}


def stored_tables(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the typed text tables, written once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        root = fresh_path(spark, "typed")
        described, rows = _described(spark, sf_dir)
        write_tables(rows, written(described, "described"), root)
        _stored[key] = root
    return _stored[key]


def _sql(name: str, key: str, statement: str) -> None:
    def run(spark, sf_dir):
        session = sqlguard.open_table(spark, table_path(stored_tables(spark, sf_dir), key))
        return sqlguard.run_guarded(session, statement)

    run.__name__ = name
    query(run)


SQL_STATEMENTS = {
    "sql_avg_by_group": (
        "customer",
        "SELECT segment, round(avg(acct_bal), 4) AS avg_bal, count(acct_bal) AS n FROM data GROUP BY segment",
    ),
    "sql_filter": (
        "customer",
        "SELECT customer_id, full_name, acct_bal FROM data WHERE acct_bal > 5000 AND segment = 'BUILDING'",
    ),
    "sql_count": ("orders", "SELECT count(*) AS n_rows, count(order_date) AS n_dates FROM data"),
    "sql_topn": (
        "orders",
        "SELECT order_key, total_price FROM data ORDER BY total_price DESC NULLS LAST, order_key LIMIT 5",
    ),
    "sql_distinct": ("part", "SELECT DISTINCT part_2, type FROM data"),
    "sql_having": (
        "events",
        "SELECT user, count(*) AS n, round(sum(value), 2) AS total FROM data GROUP BY user HAVING count(*) > 5",
    ),
    "sql_subquery": (
        "orders",
        "SELECT priority, count(*) AS n FROM data "
        "WHERE total_price > (SELECT avg(total_price) FROM data) GROUP BY priority",
    ),
    "sql_self_join": (
        "customer",
        "SELECT a.nation, count(*) AS pairs FROM (SELECT DISTINCT nation, segment FROM data) a "
        "JOIN (SELECT DISTINCT nation, segment FROM data) b ON a.nation = b.nation AND a.segment < b.segment "
        "GROUP BY a.nation",
    ),
    "sql_union": (
        "customer",
        "SELECT segment AS label FROM data WHERE acct_bal < 0 UNION SELECT full_name FROM data WHERE acct_bal > 9900",
    ),
    "sql_window": (
        "customer",
        "SELECT segment, customer_id, place FROM (SELECT segment, customer_id, row_number() OVER "
        "(PARTITION BY segment ORDER BY acct_bal DESC NULLS LAST, customer_id) AS place FROM data) t WHERE place <= 3",
    ),
    "sql_cube": (
        "orders",
        "SELECT coalesce(status, 'all') AS status, coalesce(priority, 'all') AS priority, count(*) AS n "
        "FROM data GROUP BY CUBE (status, priority)",
    ),
}
for _name, (_key, _statement) in SQL_STATEMENTS.items():
    _sql(_name, _key, _statement)


@query
def format_rows(spark, sf_dir):
    session = sqlguard.open_table(spark, table_path(stored_tables(spark, sf_dir), "events"))
    result = sqlguard.run_guarded(
        session,
        "SELECT type, flag, count(value) AS n, min(value) AS low, round(max(value)) * 1000000 AS high, "
        "max(when_utc) AS last_seen, max(CASE WHEN flag THEN value END) AS top_flagged FROM data GROUP BY type, flag",
    )
    header, rule = sqlguard.header_texts(result)
    head = session.createDataFrame([("header", header), ("rule", rule)], "kind string, text string")
    return head.unionByName(sqlguard.row_texts(result).select(F.lit("row").alias("kind"), "text"))


# --- grids ------------------------------------------------------------------------------


def _banded(spark, sf_dir):
    grid, merges = inputs.order_grid(spark, sf_dir)
    return g.written_bands(grid), merges


@query
def row_bands(spark, sf_dir):
    banded, _ = _banded(spark, sf_dir)
    return g.row_bands(banded)


@query
def table_islands(spark, sf_dir):
    banded, _ = _banded(spark, sf_dir)
    return g.written_islands(banded).select(
        "file_id", "sheet", "table_index", "min_row", "max_row", "min_col", "max_col"
    )


@query
def title_rows_skipped(spark, sf_dir):
    banded, merges = _banded(spark, sf_dir)
    islands = written(g.written_islands(banded), "numbered-islands")
    return g.skip_title_rows(islands, banded, merges).select(
        "file_id", "sheet", "table_index", F.col("min_row").alias("header_row"), "titles"
    )


@query
def table_extract(spark, sf_dir):
    grid, merges = inputs.order_grid(spark, sf_dir)
    tables, rows = g.find_tables(grid, merges)
    return ck.attach_tables(rows, tables, ["file_id", "sheet", "table_index", "headers"]).select(
        "file_id",
        "sheet",
        "table_index",
        "row_index",
        F.array_join("headers", "|").alias("header_text"),
        F.array_join("values", "|").alias("row_text"),
    )


# --- chunks and prompts -----------------------------------------------------------------


@query
def row_chunks(spark, sf_dir):
    described, rows = _described(spark, sf_dir)
    return ck.row_chunks(rows, described).select("table_key", "row_index", "text", F.size("schema").alias("n_columns"))


@query
def chunk_ids(spark, sf_dir):
    described, rows = _described(spark, sf_dir)
    return ck.row_chunks(rows, described).select("table_key", "row_index", "chunk_id")


@query
def hyde_prompts(spark, sf_dir):
    tables, rows = inputs.customer_sheets(spark, sf_dir)
    return ck.question_prompts(rows, schema.describe_tables(tables, rows))


@query
def summary_prompts(spark, sf_dir):
    tables, rows = inputs.customer_sheets(spark, sf_dir)
    return ck.summary_prompts(rows, tables)


# --- vectors ----------------------------------------------------------------------------


@query
def token_tf(spark, sf_dir):
    return vectors.term_counts(table(spark, sf_dir, "documents"), "doc_id")


@query
def term_hash(spark, sf_dir):
    words = vectors.term_counts(table(spark, sf_dir, "documents"), "doc_id", spread=False).select("term").distinct()
    return words.select("term", fnv1a("term").alias("hash"), term_bucket("term").alias("idx"))


@query
def tf_sparse(spark, sf_dir):
    return vectors.postings(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "idx", F.round(F.col("w").cast("double"), 9).alias("w")
    )


@query
def embed_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", hooks.embeddings("text", hooks.hashed_embedding(DIMS)).alias("dense")
    )
    parts = docs.select("doc_id", F.posexplode("dense").alias("pos", "x")).where("x <> 0")
    return parts.select("doc_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


# --- retrieval --------------------------------------------------------------------------


@query
def dense_topk(spark, sf_dir):
    """Vectors nearest to the mean vector of each label."""
    vecs = table(spark, sf_dir, "embeddings")
    means = (
        vecs.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
        .select(F.col("label").alias("query_id"), F.transform("v", lambda p: p["x"]).alias("dense"))
    )
    corpus = vecs.select("vec_id", F.col("embedding").alias("dense"))
    return retrieval.dense_topk(corpus, means, TOP_K * fixed.BRANCH_FACTOR, "vec_id")


def _sparse_sides(spark, sf_dir):
    docs = vectors.postings(table(spark, sf_dir, "documents"), "doc_id")
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return docs, vectors.postings(items, "query_id", spread=False)


def _sparse_hits(spark, sf_dir, limit):
    return retrieval.sparse_topk(*_sparse_sides(spark, sf_dir), limit, "doc_id")


@query
def sparse_topk(spark, sf_dir):
    return _sparse_hits(spark, sf_dir, TOP_K * fixed.BRANCH_FACTOR)


def _dense_sides(spark, sf_dir):
    """Documents and benchmark items, given the vectors whose numbers they share modulo
    the number of vectors."""
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("dense"))
    n = vecs.count()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(n)).alias("vec_id"))
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.pmod("item_id", F.lit(n)).alias("vec_id")
    )
    return docs.join(vecs, "vec_id"), items.join(vecs, "vec_id")


def _branches(spark, sf_dir, limit):
    corpus, asked = _dense_sides(spark, sf_dir)
    fetch = limit * fixed.BRANCH_FACTOR
    return [retrieval.dense_topk(corpus, asked, fetch, "doc_id"), _sparse_hits(spark, sf_dir, fetch)]


@query
def rrf_fusion(spark, sf_dir):
    return retrieval.fuse_rrf(_branches(spark, sf_dir, TOP_K), TOP_K, id_col="doc_id")


@query
def hybrid_search(spark, sf_dir):
    """Fifty fused hits per question, with their payload."""
    corpus, asked = _dense_sides(spark, sf_dir)
    docs, items = _sparse_sides(spark, sf_dir)
    hits = retrieval.hybrid_search(corpus, docs, asked, items, FETCH, id_col="doc_id")
    payload = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return retrieval.attach_payload(hits, payload, "doc_id")


def _document_hits(spark, sf_dir):
    """Hits with the document's source as table key; documents in French have none."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "text",
        "lang",
        F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("source")).alias("table_key"),
        F.concat("source", F.lit(".csv")).alias("source_file"),
        F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")).alias("sheet"),
        F.when(F.col("lang") == "es", F.lit("")).otherwise(F.concat(F.lit("Texts from "), "source")).alias("summary"),
    )
    return retrieval.attach_payload(_sparse_hits(spark, sf_dir, FETCH), docs, "doc_id")


@query
def diversify_hits(spark, sf_dir):
    return retrieval.diversify(_document_hits(spark, sf_dir), TOP_K).select(
        "query_id", "place", "rank", "doc_id", "table_key"
    )


@query
def table_candidates(spark, sf_dir):
    return retrieval.table_candidates(_document_hits(spark, sf_dir)).select(
        "query_id", "table_rank", "table_key", "doc_id"
    )


@query
def table_samples(spark, sf_dir):
    return retrieval.table_samples(_document_hits(spark, sf_dir)).select(
        "query_id", "table_key", F.size("samples").alias("n"), F.sha2(F.array_join("samples", "\n"), 256).alias("digest")
    )


@query
def hit_sources(spark, sf_dir):
    diverse = retrieval.diversify(_document_hits(spark, sf_dir), TOP_K).withColumn("table_index", F.lit(0))
    return retrieval.sources(diverse.withColumn("row_index", F.col("doc_id"))).drop("text")


@query
def key_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "table_key")
    return retrieval.for_tables(docs, "src1", "src7").select("doc_id", "table_key", "n_chars")


@query
def raw_answers(spark, sf_dir):
    return retrieval.raw_answers(retrieval.diversify(_document_hits(spark, sf_dir), TOP_K))


# --- statements, routes, prompts --------------------------------------------------------


@query
def validate_sql(spark, sf_dir):
    statements = spark.sql(inputs.STATEMENTS, part=table(spark, sf_dir, "part"))
    return sqlguard.validate_sql(statements).select(
        "p_partkey", "sql", "accepted", F.coalesce("reason", F.lit("")).alias("reason")
    )


@query
def clean_sql(spark, sf_dir):
    replies = spark.sql(inputs.REPLIES, part=table(spark, sf_dir, "part"))
    return replies.select("p_partkey", sqlguard.clean_sql("reply").alias("sql")).withColumn(
        "irrelevant", sqlguard.is_irrelevant("sql")
    )


# One question per market segment; these are the replies for its candidate tables in order.
ATTEMPT_REPLIES = [
    (1, "part", "SKIP"),
    (2, "orders", "DROP TABLE data"),
    (3, "orders", "SELECT no_such_column FROM data"),
    (4, "customer", "SELECT full_name FROM data WHERE acct_bal > 1e9 AND segment = '{q}'"),
    (5, "customer", "SELECT count(*) AS n, count(acct_bal) AS with_balance FROM data WHERE segment = '{q}'"),
    (6, "events", "SELECT count(*) AS n FROM data"),
]


@query
def sql_attempts(spark, sf_dir):
    """Statements run table by table until one returns rows; one question per segment."""
    root = stored_tables(spark, sf_dir)
    tries = spark.createDataFrame([Row(table_rank=n, table_key=key, text=text) for n, key, text in ATTEMPT_REPLIES], "table_rank int, table_key string, text string")
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("query_id")).distinct()
    # Each segment with each of the six replies.
    candidates = segments.withColumn("table_rank", F.explode(F.sequence(F.lit(1), F.lit(len(ATTEMPT_REPLIES))))).join(tries, "table_rank")
    candidates = candidates.select("query_id", "table_rank", "table_key", F.replace("text", F.lit("{q}"), F.col("query_id")).alias("sql"))
    statements = routing.Statements(spark, lambda key: table_path(root, key))
    statements.rounds(written(candidates, "candidates"), len(ATTEMPT_REPLIES))
    return statements.log().select(
        "query_id", "table_rank", "table_key", "sql", "status", F.coalesce("rows_json", F.lit("")).alias("rows_json")
    )


def _questions(spark, sf_dir):
    """Benchmark items as questions; every tenth has no terms and so finds nothing."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(F.col("item_id") % 10 == 0, F.lit("? !")).otherwise(F.col("text")).alias("question"),
    )


@query
def answer_routes(spark, sf_dir):
    questions = _questions(spark, sf_dir)
    docs = vectors.postings(table(spark, sf_dir, "documents"), "doc_id")
    found = retrieval.sparse_topk(docs, vectors.postings(questions, "query_id", "question", spread=False), FETCH, "doc_id")
    keys = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("source")).alias("table_key")
    )
    diverse = retrieval.diversify(retrieval.attach_payload(found, keys, "doc_id"), TOP_K)
    # A statement "returns rows" for the best table if that table holds labelled documents
    # of low quality.
    best = retrieval.table_candidates(retrieval.attach_payload(found, keys, "doc_id")).filter(F.col("table_rank") == 1)
    poor = (
        table(spark, sf_dir, "labels")
        .filter(F.col("quality") == 0)
        .join(table(spark, sf_dir, "documents"), "doc_id")
        .groupBy(F.col("source").alias("table_key"), "lang")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("lang") == "de")
    )
    won = best.join(poor.select("table_key").distinct(), "table_key", "left_semi")
    return routing.answer_routes(questions, diverse, won)


DOCUMENT_SCHEMA = [("doc_id", "doc_id", "INTEGER"), ("text", "Text", "VARCHAR"), ("lang", 'the "lang"', "VARCHAR")]


@query
def sql_prompts(spark, sf_dir):
    hits = _document_hits(spark, sf_dir)
    described = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(o).alias("original_name"), F.lit(t).alias("type"))
            for n, o, t in DOCUMENT_SCHEMA
        ]
    )
    made = prompts.sql_prompts(
        retrieval.table_candidates(hits).withColumn("schema", described),
        retrieval.table_samples(hits),
        _questions(spark, sf_dir),
    )
    return made.select("query_id", "table_rank", "table_key", F.sha2("prompt", 256).alias("digest"), F.length("prompt").alias("length"))


# A question says, by its number modulo 6, how the model behaves.
ANSWER_KINDS = 6
GROUPED = "SELECT lang, count(*) AS n FROM data GROUP BY lang ORDER BY lang"
NOTHING = "SELECT doc_id FROM data WHERE n_chars < 0"


def scripted_reply(system: str, prompt: str) -> str:
    """A model whose replies and failures depend on the prompt alone."""
    kind = int(re.search(r"#(\d)#", prompt).group(1))
    if prompt.startswith("Table name: "):
        if kind == 2:
            raise RuntimeError("no statement")
        return {0: "SKIP", 3: NOTHING, 5: "DROP TABLE data"}.get(kind, f"```sql\n{GROUPED};\n```")
    if "SQL query executed:" in prompt:
        if kind == 4:
            raise RuntimeError("no reply")
        return "from rows: " + prompt.split("Results:\n")[1].split("\n\n")[0]
    if kind == 5:
        raise RuntimeError("no text")
    return f"from text: {len(prompt)}"


def described_part(system: str, prompt: str) -> str:
    """A model that cannot describe copper."""
    if "COPPER" in prompt:
        raise RuntimeError("no reply to " + prompt)
    return f" {system} {prompt.lower()}, {len(prompt)} letters "


@query
def completions(spark, sf_dir):
    """Kinds of parts described by a model, in two runs of which the second finds all replies kept."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Part "), "p_type").alias("prompt"))
    calls = CallStore(fresh_path(spark, "calls"), "describer")
    calls.completions(parts.where(~F.contains("prompt", F.lit("COPPER"))), "prompt", "reply", described_part, "About:")

    def silent(system: str, prompt: str) -> str:
        raise RuntimeError("asked again: " + prompt if "COPPER" not in prompt else "no reply to " + prompt)

    done = calls.completions(parts, "prompt", "reply", silent, "About:", error="error")
    return done.select("p_partkey", F.coalesce("reply", F.lit("")).alias("reply"), F.coalesce("error", F.lit("")).alias("error"))


def _marked_questions(spark, sf_dir):
    mark = F.concat(F.lit(" #"), (F.col("query_id") % ANSWER_KINDS).cast("string"), F.lit("#"))
    return _questions(spark, sf_dir).select("query_id", F.concat("question", mark).alias("question"), F.lit(TOP_K).alias("top_k"))


@query
def answers(spark, sf_dir):
    """Questions over the documents of each source as tables, with a model that fails for some."""
    root = fresh_path(spark, "sources")
    docs = table(spark, sf_dir, "documents")
    docs.select("doc_id", "text", "lang", "n_chars", "source").write.partitionBy("source").parquet(root)
    described = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).alias("original_name"), F.lit(t).alias("type")) for n, o, t in DOCUMENT_SCHEMA])
    hits = _document_hits(spark, sf_dir).where(F.col("query_id") % 10 != 0)
    name = F.col("query_id").cast("string")
    hits = hits.withColumns({"query_id": name, "schema": described, "table_index": F.lit(0), "row_index": F.col("doc_id")})
    asked = _marked_questions(spark, sf_dir).withColumn("query_id", name)
    done = answer_hits(spark, asked, hits, scripted_reply, lambda key: f"{root}/source={key}")
    attempts = F.transform("sql_attempts", lambda a: F.concat_ws("/", a["table_rank"], a["table_key"], a["source_file"], a["sheet"], a["table_index"], a["n_rows"], a["sql"]))
    return done.select(
        F.col("query_id").cast("long").alias("query_id"), F.coalesce("answer", F.lit("")).alias("answer"), "route", F.coalesce("error", F.lit("")).alias("error"),
        F.array_join(F.transform("sources", lambda s: s["row_index"].cast("string")), ",").alias("sources"), F.array_join(attempts, ";").alias("attempts"),
    )


@query
def result_prompts(spark, sf_dir):
    """One prompt per segment, showing the customers' numbers by nation."""
    root = stored_tables(spark, sf_dir)
    segments = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("query_id")).distinct()
    statement = "SELECT nation, count(*) AS n, max(acct_bal) AS top FROM data WHERE segment = '{q}' GROUP BY nation ORDER BY nation NULLS LAST"
    candidates = segments.select("query_id", F.lit(1).alias("table_rank"), F.lit("customer").alias("table_key"), F.replace(F.lit(statement), F.lit("{q}"), F.col("query_id")).alias("sql"))
    statements = routing.Statements(spark, lambda key: table_path(root, key))
    statements.rounds(candidates, 1)
    about = statements.attempts().select("query_id", "sql", F.when(F.col("query_id") < "F", F.lit("Customers")).otherwise(F.lit("")).alias("summary"))
    results = sqlguard.prompt_tables(statements.rows(), "query_id").join(about, "query_id")
    return prompts.result_prompts(results, segments.select("query_id", F.concat(F.lit("How is "), "query_id", F.lit("?")).alias("question")))


@query
def no_hits(spark, sf_dir):
    """Questions of which nothing is found, asked of an index of all documents, among others."""
    asked = _questions(spark, sf_dir).withColumn("top_k", F.lit(TOP_K))
    found = _document_hits(spark, sf_dir).where(F.col("query_id") % 10 != 0)
    hits = found.withColumns({"table_index": F.lit(0), "row_index": F.col("doc_id")})
    done = answer_hits(spark, asked, hits, None, str)
    return done.where("route = 'none'").select("query_id", "answer", F.size("sources").alias("n_sources"), F.size("sql_attempts").alias("n_attempts"))


@query
def chunk_prompts(spark, sf_dir):
    diverse = retrieval.diversify(_document_hits(spark, sf_dir), TOP_K)
    return prompts.chunk_prompts(diverse, _questions(spark, sf_dir))


# --- state ------------------------------------------------------------------------------

SMALL_INDEX = "chunk_id string, file_id string, lang string, size bigint"


def _document_index(spark, sf_dir) -> KeyedStore:
    store = KeyedStore(fresh_path(spark, "index"), "chunk_id", SMALL_INDEX, 8).create(spark)
    docs = table(spark, sf_dir, "documents")
    store.upsert(
        docs.select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"),
            F.col("source").alias("file_id"),
            "lang",
            F.col("n_chars").alias("size"),
        )
    )
    return store


@query
def index_upsert(spark, sf_dir):
    """Labelled documents arrive again, conversations anew (the longest turn wins)."""
    store = _document_index(spark, sf_dir)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    again = labels.join(docs, "doc_id").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("again-"), "source").alias("file_id"),
        "lang",
        (F.col("n_chars") + F.col("quality") + 1).alias("size"),
    )
    fresh = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("chunk_id"),
        F.lit("talk").alias("file_id"),
        F.lit("en").alias("lang"),
        F.length("text").cast("bigint").alias("size"),
    )
    store.upsert(again.unionByName(fresh), "size")
    return store.read(spark)


@query
def index_delete(spark, sf_dir):
    store = _document_index(spark, sf_dir)
    store.delete(spark, (F.col("file_id") == "src3") | (F.col("lang") == "fr"))
    return store.read(spark)


@query
def catalog_list(spark, sf_dir):
    """Sources as files, their languages as tables."""
    docs = table(spark, sf_dir, "documents")
    described = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("row_count")).select(
        F.concat_ws("/", "source", "lang").alias("table_key"),
        F.col("source").alias("file_id"),
        F.concat("source", F.lit(".xlsx")).alias("source_file"),
        F.col("lang").alias("sheet"),
        F.lit(0).alias("table_index"),
        "row_count",
        F.concat(F.lit("in "), "lang").alias("summary"),
        F.array(
            *[
                F.struct(F.lit(i).alias("col_index"), F.lit(n).alias("name"), F.lit(o).alias("original_name"),
                         F.lit(n).alias("storage_name"), F.lit(t).alias("type"))
                for i, (n, o, t) in enumerate(DOCUMENT_SCHEMA)
            ]
        ).alias("columns"),
    )
    kept = docs.filter(F.col("n_chars") > 0).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_chunks"))
    counts = kept.select(F.concat_ws("/", "source", "lang").alias("table_key"), "n_chunks")
    store = catalog.catalog_store(fresh_path(spark, "catalog"), 4).create(spark)
    store.upsert(catalog.file_records(described, counts))
    records = catalog.list_files(spark, store)
    return (
        catalog.file_schema(records)
        .join(records.select("id", "tables_found", "chunks_count"), "id")
        .select("id", "filename", "tables_found", "chunks_count", "sheet_name", "table_key", "row_count",
                "col_index", "name", "original_name", "type")
    )


@query
def run_metrics(spark, sf_dir):
    """Events as a query log: the kind of event is the route, its value the time."""
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("query_id"),
        F.when(F.col("event_type").isin("view", "click"), "sql")
        .when(F.col("event_type") == "error", "none")
        .otherwise("text")
        .alias("route"),
        F.floor("value").cast("bigint").alias("duration_ms"),
        "user_id",
    )
    return runlog.query_metrics(log, "user_id")


@query
def csv_ingest(spark, sf_dir):
    """Text tables written as delimited files, scanned back, typed, and counted by column."""
    folder = fresh_path(spark, "delimited")
    for name in inputs.TEXTS:
        rows = inputs.text_rows(spark, sf_dir, name)
        fields = [F.col("values")[i].alias(f"{name} v{i}") for i in range(inputs.WIDTH)]
        writer = rows.select(*fields).write.option("header", True).option("escape", '"')
        writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/{name}")
    grid = scan_csv(spark, [f"{folder}/{name}" for name in inputs.TEXTS])
    tables, rows = g.first_row_tables(grid)
    described = schema.describe_tables(tables, rows)
    cells = typed.typed_cells(rows, described)
    columns = described.select("table_key", F.explode("columns").alias("c")).select(
        "table_key", F.col("c.col_index").alias("col_index"), F.col("c.name").alias("name"), F.col("c.type").alias("type")
    )
    filled = F.coalesce(
        F.col("v_bool").cast("string"), F.col("v_long").cast("string"), F.col("v_double").cast("string"),
        F.col("v_date").cast("string"), F.col("v_ts").cast("string"), "v_string",
    )
    per_column = cells.groupBy("table_key", "col_index").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(filled).alias("n_values"),
        F.sum("v_long").alias("sum_long"),
    )
    return (
        per_column.join(columns, ["table_key", "col_index"])
        .groupBy("name", "type")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.coalesce(F.sum("sum_long"), F.lit(0)).alias("sum_long"),
        )
    )


@query
def csv_rows(spark, sf_dir):
    """Every cell and position of files whose texts hold line breaks, stray quotes and blank lines."""
    folder = fresh_path(spark, "delimited")
    records = spark.sql(inputs.CSV_RECORDS, documents=table(spark, sf_dir, "documents"))
    one_file = records.repartition("part").sortWithinPartitions("part", "doc_id")
    one_file.select("part", "value").write.partitionBy("part").text(folder)
    cells = scan_csv(spark, [folder]).select("r", "cells", F.posexplode("cells").alias("col", "value"))
    return cells.select(F.col("cells")[0].alias("part"), "r", "col", F.length("value").alias("size"), F.md5("value").alias("digest"))


@query
def listed_files(spark, sf_dir):
    """Customers by segment, parts by type and nations, in files of different kinds below one folder."""
    folder = fresh_path(spark, "files")
    customers, parts = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    customers.repartition("c_mktsegment").write.partitionBy("c_mktsegment").csv(f"{folder}/customers")
    parts.select("p_partkey", "p_type").repartition("p_type").write.partitionBy("p_type").json(f"{folder}/parts")
    customers.select(F.col("c_name").alias("value"), "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").text(f"{folder}/names")
    files = list_files(spark, folder).where("extension in ('.csv', '.json', '.txt')")
    return files.groupBy("extension", F.coalesce("reader", F.lit("")).alias("reader"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


def _described_sheet(system: str, prompt: str) -> str:
    return "Some customers" if system == hooks.SUMMARY_SYSTEM else f"{prompt.count(chr(10))} lines"


@query
def ingest_files(spark, sf_dir):
    """Customers as five delimited files, ingested; the index rows with what they carry."""
    folder = fresh_path(spark, "delimited")
    rows = inputs.text_rows(spark, sf_dir, "customer")
    fields = [F.col("values")[i].alias(f"customer v{i}") for i in range(inputs.WIDTH)]
    # Names of files differ, as chunk ids are made from them.
    writer = rows.select(*fields).repartition(5).write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    store = Store(fresh_path(spark, "store"), index_buckets=4, catalog_buckets=2)
    ingest(spark, folder, store, hooks.hashed_embedding(DIMS), _described_sheet)
    chunks = catalog.list_files(spark, store.catalog).agg(F.count(F.lit(1)).alias("n_files"), F.sum("tables_found").alias("n_tables"), F.sum("chunks_count").alias("n_chunks"))
    index = store.index.read(spark).groupBy("text", "summary", F.size("schema").alias("n_columns"), F.size("dense").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    return index.join(chunks, F.lit(True))


@query
def index_payload(spark, sf_dir):
    """All payload fields of the rows of the text tables, stored and read back by key."""
    described, rows = _described(spark, sf_dir)
    described = described.withColumns({"summary": F.concat(F.lit("about "), "table_key"), "hyde": F.concat(F.lit("asked of "), "table_key")})
    payload = "chunk_id string, table_key string, file_id string, source_file string, sheet string, table_index int, row_index bigint, text string, hyde string, summary string, columns string"
    store = KeyedStore(fresh_path(spark, "index"), "chunk_id", payload, 8).create(spark)
    chunks = ck.row_chunks(rows, described)
    store.upsert(chunks.withColumn("columns", F.array_join(F.transform("schema", lambda c: F.concat_ws("/", c["name"], c["original_name"], c["type"])), ";")).drop("schema"))
    hits = chunks.select("chunk_id").distinct()
    return retrieval.attach_payload(hits, store.read(spark))


@query
def streaming_ingest(spark, sf_dir):
    """Documents as a stream of texts, upserted into an index by id."""
    store = Store(fresh_path(spark, "streamed"), index_buckets=8)
    given = table(spark, sf_dir, "documents").schema
    rows = (
        spark.readStream.schema(given)
        .parquet(f"{sf_dir}/documents.parquet*")
        .select(
            F.concat("source", F.lit(".csv")).alias("source_file"),
            F.col("lang").alias("sheet"),
            F.lit(0).alias("table_index"),
            F.col("doc_id").alias("row_index"),
            "text",
        )
    )
    assert rows.columns == [c.split()[0] for c in TEXT_ROWS.split(", ")]
    index_stream(rows, store, fresh_path(spark, "progress"), hooks.hashed_embedding(DIMS)).awaitTermination()
    return store.index.read(spark).select(
        "chunk_id", "source_file", "sheet", "row_index", "n_terms",
        F.size("sparse").alias("n_buckets"), F.size("dense").alias("dims"),
    )

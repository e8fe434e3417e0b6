"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid as g
from gridloom.operators import chunks, retrieval, schema, typed, vectors
from gridloom.suite import inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def no_pairs(text):
    return "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_grid_steps_join_by_equality(spark, no_broadcast):
    grid, merges = inputs.order_grid(spark, SF)
    banded = g.band_rows(grid)
    islands = g.table_islands(banded)
    for df in (islands, g.skip_title_rows(islands, banded, merges), g.extract_tables(islands, banded)[1]):
        assert no_pairs(plan(df))


def test_extraction_needs_few_exchanges(spark, no_broadcast):
    from gridloom.suite.queries import all_queries

    text = plan(all_queries()["table_extract"](spark, SF))
    assert text.count("Exchange hashpartitioning") < 10 and text.count("Window") == 0


def test_sheet_rows_are_never_partitioned_by_sheet_alone(spark):
    grid, _ = inputs.order_grid(spark, SF)
    text = plan(g.band_rows(grid))
    heavy = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "_blk" in line]
    assert heavy  # sheet rows move by (file, sheet, block)
    assert "cells" not in "".join(x for x in text.splitlines() if "Exchange" in x and "_blk" not in x)


def test_type_counts_combine_before_the_exchange(spark):
    text = plan(schema.type_counts(inputs.text_rows(spark, SF, "orders")))
    assert text.count("Exchange") == 1 and "partial_count" in text and "ArrowEvalPython" not in text


def test_sparse_search_exchanges_whole_texts_once(spark):
    docs = vectors.postings(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    text = plan(docs)
    assert text.count("Exchange hashpartitioning(doc_id") == 1 and text.count("Exchange") == 1
    items = spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    found = plan(retrieval.sparse_topk(docs, vectors.postings(items, "query_id"), 5, "doc_id"))
    assert no_pairs(found) and "WindowGroupLimit" in found


def test_dense_search_keeps_the_corpus_in_place(spark):
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("dense"))
    asked = vecs.limit(3).withColumnRenamed("vec_id", "query_id")
    text = plan(retrieval.dense_topk(vecs, asked, 4, "vec_id"))
    below = text[text.index("MapInPandas"):]
    assert "Exchange" not in below and "WindowGroupLimit" in text and no_pairs(text)


def test_wide_tables_need_no_exchange(spark):
    rows = inputs.text_rows(spark, SF, "orders")
    columns = [{"col_index": i, "type": t, "storage_name": f"c{i}"} for i, t in enumerate(["INTEGER", "VARCHAR", "DOUBLE", "DATE"])]
    text = plan(typed.materialize_table(rows, columns))
    assert "Exchange" not in text and "ReadSchema" in text and "o_orderpriority" in text


def test_key_filter_reaches_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "table_key")
    text = plan(retrieval.for_tables(docs, "src1").select("doc_id"))
    pushed = text[text.index("PushedFilters"):].split("\n")[0]
    assert "EqualTo(source,src1)" in pushed and "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_parsing_stays_compilable(spark, tmp_path, capsys):
    path = str(tmp_path / "rows")
    inputs.text_rows(spark, SF, "orders", "events").write.parquet(path)
    rows = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        schema.type_counts(rows).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_terms_are_hashed_and_scored_in_tasks(spark):
    docs = vectors.postings(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert "aggregate(" not in plan(docs) and plan(docs).count("Generate") == 1
    items = vectors.postings(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "query_id"), "query_id")
    found = plan(retrieval.sparse_topk(docs, items, 5, "doc_id"))
    # Between the texts' one exchange and the ranked candidates' nothing moves.
    assert "MapInArrow" in found and found[found.index("MapInArrow"):].count("Exchange") == 1


def test_what_a_table_shares_is_not_made_per_row(spark):
    rows = inputs.text_rows(spark, SF)
    described = schema.describe_tables(inputs.text_tables(rows), rows)
    text = plan(chunks.row_chunks(rows, described))
    assert "original_name" not in text[: text.index("Join")].replace("original_name:string", "")

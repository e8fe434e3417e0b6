"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridloom.session import build_session  # noqa: E402
from gridloom.suite.queries import all_queries, stored_tables  # noqa: E402

HEADLINE = [
    "infer_types",
    "typed_cast",
    "materialize_table",
    "sql_avg_by_group",
    "sql_topn",
    "sql_window",
    "table_islands",
    "title_rows_skipped",
    "table_extract",
    "row_chunks",
    "summary_prompts",
    "tf_sparse",
    "dense_topk",
    "sparse_topk",
    "hybrid_search",
    "validate_sql",
    "index_upsert",
    "run_metrics",
    "chunk_ids",
    "diversify_hits",
    "csv_ingest",
    "streaming_ingest",
    "answer_routes",
    "sql_attempts",
    "embed_batches",
    "index_delete",
    "answers",
    "completions",
    "csv_rows",
    "index_payload",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    times = {}
    # What the queries over stored tables share, as a line of its own.
    start = time.perf_counter()
    stored_tables(spark, sf_dir)
    times["stored_tables"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

"""Run bookkeeping as log tables and aggregates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INGEST_LOG = "run_id string, files bigint, tables bigint, chunks bigint, duration_ms bigint"


def ingest_metrics(log: DataFrame) -> DataFrame:
    return log.agg(
        F.coalesce(F.sum("files"), F.lit(0)).alias("files_processed"),
        F.coalesce(F.sum("tables"), F.lit(0)).alias("tables_processed"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks_created"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_duration_ms"),
    )


def query_metrics(log: DataFrame, *by: str) -> DataFrame:
    """Requests, time, and path counts; the mean is rounded to whole milliseconds."""
    total = F.coalesce(F.sum("duration_ms"), F.lit(0))
    n = F.count(F.lit(1))
    return log.groupBy(*by).agg(
        n.alias("requests_total"),
        total.alias("total_duration_ms"),
        F.count_if(F.col("route") == "sql").alias("sql_path"),
        F.count_if(F.col("route").isin("text")).alias("text_path"),
        F.when(n > 0, F.round(total / n)).otherwise(F.lit(0.0)).cast("bigint").alias("mean_ms"),
    )

"""Typed tables on disk: one Parquet folder per table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.blocks import attach_tables, block
from gridloom.operators.typed import storage_schema, wide_rows
from gridloom.session import fresh_path

# Schemas written at once.
JOBS_AT_ONCE = 8


def table_path(root: str, table_key: str) -> str:
    return f"{root}/table_key={table_key}"


def write_tables(
    rows: DataFrame, described: DataFrame, root: str, lenient_prefix: bool = False
) -> DataFrame:
    """Write every table under ``root/table_key=<key>`` (Snappy Parquet, all nullable).

    Keys are derived from the file, so a repeated run replaces its own output. Tables
    with equal schemas are written by one job: the raw rows are first staged by schema,
    then each schema's rows are converted by one projection. A table is cut into files
    by row block, so neither a huge nor a tiny table decides the file size. Empty tables
    get an empty file. Returns ``(table_key, path)``.
    """
    spark = rows.sparkSession
    signature = F.sha2(F.to_json(F.transform("columns", lambda c: F.struct(c["storage_name"], c["type"]))), 256)
    signed = described.select("table_key", "row_count", "columns", signature.alias("signature"))
    stage = fresh_path(spark, "raw-rows")
    (
        attach_tables(rows, signed, ["signature"])
        .withColumn("_blk", block("row_index"))
        .repartition("signature", "table_key", "_blk")
        .drop("_blk")
        .write.partitionBy("signature")
        .parquet(stage)
    )
    staged = spark.read.schema(
        "table_key string, row_index bigint, values array<string>, signature string"
    ).parquet(stage)
    kinds = signed.groupBy("signature").agg(F.first("columns").alias("columns"))

    def write_kind(kind: Row) -> None:
        same = staged.filter(F.col("signature") == kind["signature"])
        (
            wide_rows(same, kind["columns"], "table_key", lenient_prefix=lenient_prefix)
            .write.mode("overwrite")
            .option("compression", "snappy")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("table_key")
            .parquet(root)
        )

    def write_empty(empty: Row) -> None:
        (
            spark.createDataFrame([], storage_schema(empty["columns"]))
            .coalesce(1)
            .write.mode("overwrite")
            .option("compression", "snappy")
            .parquet(table_path(root, empty["table_key"]))
        )

    # Jobs of different schemas share the executors; a few are under way at any time.
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        for write, chosen in ((write_kind, kinds), (write_empty, signed.filter(F.col("row_count") == 0))):
            left = chosen.toLocalIterator()
            while some := list(islice(left, 16 * JOBS_AT_ONCE)):
                list(pool.map(write, some))
    return described.select("table_key", F.concat(F.lit(f"{root}/table_key="), "table_key").alias("path"))


def read_table(spark: SparkSession, root: str, table_key: str) -> DataFrame:
    return spark.read.parquet(table_path(root, table_key))


def drop_folders(spark: SparkSession, paths: list[str]) -> list[str]:
    """Remove folders on any Hadoop file system; returns the ones that failed."""
    failed = []
    hadoop = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        try:
            target.getFileSystem(hadoop).delete(target, True)
        except Exception:
            failed.append(path)
    return failed

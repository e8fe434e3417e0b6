"""The file catalog: one record per ingested file, with its tables and their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.chunks import public_columns
from gridloom.sources.store import KeyedStore

TABLE_STRUCT = (
    "array<struct<table_index:int,sheet_name:string,table_key:string,row_count:bigint,summary:string,"
    "columns:array<struct<name:string,original_name:string,type:string>>>>"
)
CATALOG_SCHEMA = (
    "id string, filename string, uploaded_at timestamp, tables_found int, chunks_count bigint, "
    f"table_keys array<string>, tables {TABLE_STRUCT}"
)


def catalog_store(root: str, buckets: int = 16) -> KeyedStore:
    return KeyedStore(f"{root}/catalog", "id", CATALOG_SCHEMA, buckets)


def file_records(described: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Catalog records of files from their described tables and ``(table_key, n_chunks)``.

    The nested list is as long as one file has tables: one for delimited text, and for
    a workbook no more than its reader already held in one task.
    """
    summary = F.col("summary") if "summary" in described.columns else F.lit("")
    table = F.struct(
        F.col("sheet").alias("_sheet"),
        "table_index",
        F.col("sheet").alias("sheet_name"),
        "table_key",
        "row_count",
        summary.alias("summary"),
        public_columns().alias("columns"),
    )
    return (
        described.join(chunk_counts, "table_key", "left")
        .groupBy("file_id")
        .agg(
            F.first("source_file").alias("filename"),
            F.count(F.lit(1)).cast("int").alias("tables_found"),
            F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks_count"),
            F.array_sort(F.collect_list(table)).alias("_t"),
        )
        .select(
            F.col("file_id").alias("id"),
            "filename",
            F.current_timestamp().alias("uploaded_at"),
            "tables_found",
            "chunks_count",
            F.transform("_t", lambda t: t["table_key"]).alias("table_keys"),
            F.transform(
                "_t",
                lambda t: F.struct(
                    t["table_index"], t["sheet_name"], t["table_key"], t["row_count"], t["summary"], t["columns"]
                ),
            )
            .cast(TABLE_STRUCT)
            .alias("tables"),
        )
    )


def list_files(spark: SparkSession, store: KeyedStore) -> DataFrame:
    return store.read(spark)


def get_file(spark: SparkSession, store: KeyedStore, file_id: str):
    """One record; LookupError if there is none."""
    found = store.read(spark).filter(F.col("id") == file_id).head(1)
    if not found:
        raise LookupError(f"file {file_id} not found")
    return found[0]


def file_schema(records: DataFrame) -> DataFrame:
    """One row per column of every table; a record without tables gives none."""
    return (
        records.select("id", "filename", F.explode("tables").alias("t"))
        .select("id", "filename", "t.table_index", "t.sheet_name", "t.table_key", "t.row_count",
                F.posexplode("t.columns").alias("col_index", "c"))
        .select("id", "filename", "table_index", "sheet_name", "table_key", "row_count", "col_index",
                "c.name", "c.original_name", "c.type")
    )


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """Records kept as JSON lines elsewhere; unreadable ones are skipped."""
    return spark.read.schema(CATALOG_SCHEMA).option("mode", "DROPMALFORMED").json(path)

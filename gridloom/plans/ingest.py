"""Files to a searchable, queryable store: every stage handles all files at once."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import chunks as ck
from gridloom.operators import hooks, replies
from gridloom.operators.grid import find_tables, first_row_tables
from gridloom.operators.runlog import INGEST_LOG
from gridloom.operators.schema import COLUMN_STRUCT, describe_tables
from gridloom.operators.vectors import SPARSE_STRUCT, with_sparse
from gridloom.session import written
from gridloom.sources.catalog import catalog_store, file_records, get_file
from gridloom.sources.csv import file_id as id_of_path
from gridloom.sources.csv import scan_csv
from gridloom.sources.listing import list_files, paths_for
from gridloom.sources.store import KeyedStore
from gridloom.sources.tables import drop_folders, table_path, write_tables
from gridloom.sources.xlsx import scan_xlsx

INDEX_SCHEMA = (
    "chunk_id string, table_key string, file_id string, source_file string, sheet string, "
    "table_index int, row_index bigint, text string, hyde string, summary string, "
    f"schema {COLUMN_STRUCT}, dense array<float>, sparse {SPARSE_STRUCT}, n_terms bigint, "
    "ingested_at timestamp"
)


_INDEX_COLUMNS = (
    "chunk_id", "table_key", "file_id", "source_file", "sheet", "table_index", "row_index", "text", "hyde",
    "summary", "schema", "dense", "sparse", "n_terms", "ingested_at",
)


@dataclass(frozen=True)
class Store:
    """Where one collection lives: typed tables, index, catalog, run log."""

    root: str
    index_buckets: int = 64
    catalog_buckets: int = 16

    @property
    def tables(self) -> str:
        return f"{self.root}/tables"

    @property
    def index(self) -> KeyedStore:
        return KeyedStore(f"{self.root}/index", "chunk_id", INDEX_SCHEMA, self.index_buckets)

    @property
    def catalog(self) -> KeyedStore:
        return catalog_store(self.root, self.catalog_buckets)

    @property
    def ingest_log(self) -> str:
        return f"{self.root}/ingest_log"

    @property
    def query_log(self) -> str:
        return f"{self.root}/query_log"

    def table_path(self, table_key: str) -> str:
        return table_path(self.tables, table_key)

    def create(self, spark: SparkSession) -> "Store":
        self.index.create(spark)
        self.catalog.create(spark)
        return self


@dataclass(frozen=True)
class Ingested:
    """What a run did; ``rejected(path, reason)`` lists the files it could not use."""

    tables: DataFrame
    chunks: DataFrame
    rejected: DataFrame


def index_rows(chunks: DataFrame, embed: hooks.Embed, calls: replies.CallStore | None = None) -> DataFrame:
    """Chunks with dense and sparse vectors, ready for the index.

    Files of one name share chunk ids; one row per id goes on, so that the terms of one text
    are never counted together with those of another.
    """
    once = chunks.groupBy("chunk_id").agg(F.max(F.struct(*chunks.columns)).alias("_row")).select("_row.*")
    dense = replies.embeddings(calls, once, "text", "dense", embed)
    return with_sparse(dense, "chunk_id").withColumn("ingested_at", F.current_timestamp()).select(
        *_INDEX_COLUMNS
    )


def read_grids(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(tables, rows, rejected)`` of listed files, read by format."""
    rejected = files.filter(F.col("reason").isNotNull()).select("path", "reason")
    parts = []
    csv_paths = paths_for(files, "csv")
    if csv_paths:
        parts.append(first_row_tables(scan_csv(spark, csv_paths)))
    xlsx_paths = paths_for(files, "xlsx")
    if xlsx_paths:
        grid, merges, bad = scan_xlsx(spark, xlsx_paths)
        parts.append(find_tables(grid, merges))
        rejected = rejected.unionByName(bad)
    if not parts:
        raise ValueError("no readable files")
    tables, rows = parts[0]
    for more_tables, more_rows in parts[1:]:
        tables, rows = tables.unionByName(more_tables), rows.unionByName(more_rows)
    return tables, rows, rejected


def ingest(
    spark: SparkSession,
    path: str | list[str],
    store: Store,
    embed: hooks.Embed,
    complete: hooks.Complete | None = None,
    lenient_prefix: bool = False,
    calls: replies.CallStore | None = None,
) -> Ingested:
    """Find, name, type, store, chunk, embed and index the tables of all files of a folder.

    A failed summary stays empty; a failed question prompt fails the run. Everything is
    keyed by file, sheet and row, so running again replaces instead of adding.
    ``lenient_prefix`` reads leading numbers of texts in number columns. With ``calls`` a repeated
    run asks the models nothing again.
    """
    started = time.monotonic()
    store.create(spark)
    # Written, so that all uses see the same listing.
    files = written(list_files(spark, path), "files")
    tables, rows, rejected = read_grids(spark, files)
    tables, rows = written(tables, "tables"), written(rows, "rows")

    if complete is None:
        tables = tables.withColumn("summary", F.lit(""))
    else:
        asked = ck.summary_prompts(rows, tables)
        told = replies.completions(calls, asked, "prompt", "summary", complete, hooks.SUMMARY_SYSTEM, tolerate_errors=True)
        tables = tables.join(told.drop("prompt"), "table_key")
    described = written(describe_tables(tables, rows), "described")

    write_tables(rows, described, store.tables, lenient_prefix)

    if complete is None:
        described = described.withColumn("hyde", F.lit(""))
    else:
        asked = ck.question_prompts(rows, described)
        told = replies.completions(calls, asked, "prompt", "hyde", complete, hooks.QUESTION_SYSTEM)
        described = written(described.join(told.drop("prompt"), "table_key"), "described")

    chunks = ck.row_chunks(rows, described)
    indexed = written(index_rows(chunks, embed, calls), "index-rows")
    store.index.upsert(indexed)

    counts = indexed.groupBy("table_key").agg(F.count(F.lit(1)).alias("n_chunks"))
    records = written(file_records(described, counts), "records")
    store.catalog.upsert(records)

    found = records.select("id", "chunks_count")
    known = files.filter(F.col("reason").isNull()).select("path", id_of_path("path").alias("id"))
    silent = known.join(found, "id", "left").select(
        "path",
        F.when(F.col("chunks_count").isNull(), F.lit("no tables found in file"))
        .when(F.col("chunks_count") == 0, F.lit("all tables produced zero chunks"))
        .alias("reason"),
    )
    rejected = rejected.unionByName(
        silent.filter(F.col("reason").isNotNull()).join(rejected.select("path"), "path", "left_anti")
    )
    totals = records.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("tables_found"), F.lit(0)).cast("bigint").alias("tables"),
        F.coalesce(F.sum("chunks_count"), F.lit(0)).cast("bigint").alias("chunks"),
    ).first()
    took = int((time.monotonic() - started) * 1000)
    spark.createDataFrame([(uuid.uuid4().hex, *totals, took)], INGEST_LOG).write.mode("append").parquet(
        store.ingest_log
    )
    return Ingested(described, indexed, rejected)


def delete_file(spark: SparkSession, store: Store, file_id: str) -> list[str]:
    """Forget a file: index rows, stored tables, then the catalog record.

    The record goes last so that a run that failed half-way can be repeated. Returns the
    table folders that could not be removed; LookupError for an unknown file.
    """
    record = get_file(spark, store.catalog, file_id)
    store.index.delete(spark, F.col("file_id") == file_id)
    failed = drop_folders(spark, [store.table_path(k) for k in record["table_keys"]])
    store.catalog.delete(spark, F.col("id") == file_id)
    return failed

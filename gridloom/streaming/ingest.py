"""Incremental ingest: files or rows arriving over time, each batch upserted by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.chunks import chunk_id
from gridloom.operators.hooks import Complete, Embed
from gridloom.operators.replies import CallStore
from gridloom.operators.schema import COLUMN_STRUCT
from gridloom.plans.ingest import Store, index_rows, ingest
from gridloom.session import scratch

# One text per record; the record's place is its row.
TEXT_ROWS = "source_file string, sheet string, table_index int, row_index bigint, text string"


def watch_files(
    spark: SparkSession,
    folder: str,
    store: Store,
    checkpoint: str,
    embed: Embed,
    complete: Complete | None = None,
    available_now: bool = True,
    calls: CallStore | None = None,
) -> StreamingQuery:
    """Ingest every new CSV or workbook of a folder once.

    The stream carries file names only; a batch runs the set-based ingest over its new
    files. Ids are derived from file, sheet and row, so a replayed batch changes nothing.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    names = spark.readStream.format("binaryFile").schema(schema).load(folder).select("path")

    def handle(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.toLocalIterator()]
        if paths:
            with scratch(batch.sparkSession):
                ingest(batch.sparkSession, paths, store, embed, complete, calls=calls)

    writer = names.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def chunk_stream(rows: DataFrame) -> DataFrame:
    """Text rows of a stream as index chunks: row-local, no state, no watermark needed."""
    return rows.filter(F.col("text") != "").select(
        chunk_id().alias("chunk_id"),
        F.lit("").alias("table_key"),
        F.col("source_file").alias("file_id"),
        "source_file",
        "sheet",
        "table_index",
        "row_index",
        "text",
        F.lit("").alias("hyde"),
        F.lit("").alias("summary"),
        F.array().cast(COLUMN_STRUCT).alias("schema"),
    )


def index_stream(rows: DataFrame, store: Store, checkpoint: str, embed: Embed, calls: CallStore | None = None) -> StreamingQuery:
    """Upsert a stream of text rows into the index, all that is available now.

    With ``calls`` a replayed batch embeds nothing again.
    """
    store.create(rows.sparkSession)

    def handle(batch: DataFrame, _: int) -> None:
        with scratch(batch.sparkSession):
            store.index.upsert(index_rows(batch, embed, calls))

    return (
        chunk_stream(rows)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Choosing a reader by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files under folders or globs: ``(path, extension, reader, reason)``.

    The listing never reads contents. Files without a reader keep a reason instead.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    reader = F.when(extension == ".csv", F.lit("csv")).when(extension == ".xlsx", F.lit("xlsx"))
    return listed.withColumn("extension", extension).withColumn("reader", reader).withColumn(
        "reason",
        F.when(reader.isNull(), F.concat(F.lit("unsupported file type: "), extension)),
    )


def paths_for(files: DataFrame, reader: str) -> list[str]:
    """Paths of one kind (names only; the driver lists files for any scan anyway)."""
    return [r["path"] for r in files.filter(F.col("reader") == reader).select("path").toLocalIterator()]

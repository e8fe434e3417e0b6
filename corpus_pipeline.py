"""The corpus pipeline: five stages from raw documents to packed batches.

Each stage takes what the one before it kept, as Parquet, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import lines, mixing, near_copies, packing, toxicity
from gridloom.llm.common import table
from gridloom.session import ship_package, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def strip_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines seen earlier; a text of which no word is left goes."""
    ship_package(spark)
    names = docs.columns
    packed = docs.select(F.struct(*[c for c in names if c != "text"]).alias("_was"), "doc_id", "text")
    done = lines.dedup_lines(packed)
    left = done.where((F.col("n_deleted") == 0) | (F.col("n_lines") > F.col("n_deleted")))
    changed = F.col("n_deleted") > 0
    values = {
        "text": F.col("text"),
        # The count of characters follows a changed text.
        "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("_was")["n_chars"]) if "n_chars" in names else None,
    }
    return left.select(*[(values[c] if values.get(c) is not None else F.col("_was")[c]).alias(c) for c in names])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship_package(spark)
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, shuffled."""
    return mixing.mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their length bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", strip_repeated_lines),
    ("ngram_jaccard", one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

# The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

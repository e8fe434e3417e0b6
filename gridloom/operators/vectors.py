"""Sparse vectors: term frequencies folded into hash buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.functions.text import hash_bucket, terms

SPARSE_STRUCT = "array<struct<idx:int,tf:bigint,w:float>>"
# Terms folded at once.
PIECE_TERMS = 2_000_000


def term_counts(df: DataFrame, id_col: str, text_col: str = "text", spread: bool = True) -> DataFrame:
    """``(id, term, tf, n_terms)``: kept terms of each text and their counts.

    ``spread`` puts each text in the partition of its id first. That one exchange of
    whole rows serves every later grouping by id; exploded terms are never shuffled. The
    partition count is the session's: texts are small but splitting them is not, so
    adaptive execution must not merge partitions by bytes.
    """
    base = df.select(id_col, text_col)
    if spread:
        base = base.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    base = base.select(id_col, terms(text_col).alias("_terms"))
    return (
        base.select(id_col, F.size("_terms").cast("bigint").alias("n_terms"), F.explode("_terms").alias("term"))
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("tf"), F.max("n_terms").alias("n_terms"))
    )


def term_bucket(hashed: Column | str) -> Column:
    """Sparse vector index of a term, from its hash."""
    return hash_bucket(hashed)


def _hashes(words: pa.Array) -> np.ndarray:
    """``fnv1a`` of each word, of all words at once, byte by byte."""
    words = words.cast(pa.large_binary())
    starts = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    hashes = np.full(len(words), fixed.FNV_OFFSET, dtype=np.uint64)
    order = np.argsort(-np.diff(starts), kind="stable")
    sizes, at = np.diff(starts)[order], starts[:-1][order]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        # Words longer than k bytes come first.
        left = order[: np.searchsorted(-sizes, -k)]
        hashes[left] = ((hashes[left] ^ data[at[: len(left)] + k]) * np.uint64(fixed.FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    return hashes.astype(np.int64)


def _counted(texts: pa.Array, kinds: int) -> pa.Array:
    """Per text the hashes of its terms modulo ``kinds``, in order, and how often each comes."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(texts), 0), dtype=np.int64)
    coded = texts.flatten().dictionary_encode()
    pair = np.repeat(np.arange(len(texts)), sizes) * kinds + (_hashes(coded.dictionary) % kinds)[np.asarray(coded.indices)]
    pair, times = np.unique(pair, return_counts=True)
    bounds = np.searchsorted(pair, np.arange(len(texts) + 1) * kinds)
    items = pa.StructArray.from_arrays([pa.array(pair % kinds), pa.array(times.astype(np.int64))], ["idx", "tf"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items)


def _counts(texts: Column | str, kinds: int) -> Column:
    """``(idx, tf)`` arrays of arrays of terms; each distinct term of a batch is hashed once."""

    def run(batch: pa.Array) -> pa.Array:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch), 0), dtype=np.int64))
        full = np.arange(PIECE_TERMS, int(ends[-1]) if len(ends) else 0, PIECE_TERMS)
        cuts = np.unique([0, *(np.searchsorted(ends, full) + 1), len(batch)])
        return pa.concat_arrays([_counted(batch.slice(a, b - a), kinds) for a, b in zip(cuts[:-1], cuts[1:])] or [_counted(batch, kinds)])

    # Else the optimizer would ask for the counts once more to leave out texts without any.
    return F.arrow_udf(run, "array<struct<idx:bigint,tf:bigint>>").asNondeterministic()(texts)


def weight(tf: Column, n_terms: Column) -> Column:
    """Share of a text's kept terms, in single precision."""
    return (tf.cast("double") / n_terms).cast("float")


def postings(df: DataFrame, id_col: str, text_col: str = "text", spread: bool = True) -> DataFrame:
    """``(id, idx, tf, n_terms, w)``. Terms that share a bucket are summed, which leaves
    every dot product as it is.

    A text's terms are counted by hash where it is read. ``spread`` then puts the counts of each
    text, still one row, in the partition of its id, as that of ``term_counts`` does with texts.
    """
    counted = df.select(id_col, terms(text_col).alias("_terms")).select(
        id_col, F.size("_terms").cast("bigint").alias("n_terms"), _counts("_terms", 1 << 32).alias("_items")
    )
    if spread:
        counted = counted.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    return (
        counted.select(id_col, "n_terms", F.inline("_items").alias("_hash", "tf"))
        .groupBy(id_col, term_bucket("_hash").alias("idx"))
        .agg(F.sum("tf").alias("tf"), F.max("n_terms").alias("n_terms"))
        .withColumn("w", weight(F.col("tf"), F.col("n_terms")))
    )


def with_sparse(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Add ``sparse`` and ``n_terms`` to rows with unique ids; empty texts get ``[]``.

    A row has all its terms, so nothing is exchanged.
    """
    kept = F.when(F.col(id_col).isNotNull(), terms(text_col))
    counted = df.withColumn("_terms", F.coalesce(kept, F.array().cast("array<string>"))).withColumns(
        {"n_terms": F.size("_terms").cast("bigint"), "sparse": _counts("_terms", fixed.SPARSE_BUCKETS)}
    )
    weighted = F.transform("sparse", lambda i: F.struct(i["idx"], i["tf"], weight(i["tf"], F.col("n_terms")).alias("w")))
    return counted.withColumn("sparse", weighted.cast(SPARSE_STRUCT)).drop("_terms")


def explode_sparse(df: DataFrame, id_col: str) -> DataFrame:
    """Stored vectors back to postings; the vectors leave the table as they are stored."""
    return df.select(id_col, "n_terms", F.explode("sparse").alias("s")).select(
        id_col, F.col("s.idx").alias("idx"), F.col("s.tf").alias("tf"), "n_terms"
    )

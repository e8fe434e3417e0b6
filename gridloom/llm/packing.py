"""Packing: length buckets with the least padding, token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD
from gridloom.session import written

BUCKETS, BUDGET = 16, 16_384
SHARD = 4_096


def best_boundaries(edges: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` edges that minimise the padding of all lengths to the next one.

    ``padding(i, j) = edge[j] * documents(i..j) - tokens(i..j)``; dynamic programming over the
    edge before a bucket. As the best such edge never falls when ``j`` grows, the middle of a
    range of ``j`` bounds the search of both its halves, so a bucket costs ``n log n``; all
    ranges of a depth are searched together.
    """
    n = len(edges)
    docs, tokens = (np.concatenate([[0], np.cumsum(x)]).astype(np.float64) for x in (counts, sums))
    ends = np.concatenate([[0], edges]).astype(np.float64)
    best = ends * docs - tokens
    choices = [np.zeros(n + 1, dtype=np.int64)]
    for bucket in range(1, min(buckets, n)):
        nxt, choice = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
        low, high = np.array([bucket + 1]), np.array([n])
        first, last = np.array([bucket]), np.array([n - 1])
        while len(low):
            middle = (low + high) // 2
            size = np.minimum(last, middle - 1) - first + 1
            begin = np.cumsum(size) - size
            of = np.repeat(np.arange(len(size)), size)
            before = np.arange(size.sum()) - begin[of] + first[of]
            cost = best[before] + ends[middle][of] * (docs[middle][of] - docs[before]) - (tokens[middle][of] - tokens[before])
            nxt[middle] = np.minimum.reduceat(cost, begin)
            least = np.flatnonzero(cost == nxt[middle][of])
            choice[middle] = found = before[least[np.searchsorted(of[least], np.arange(len(size)))]]
            low, high = np.concatenate([low, middle + 1]), np.concatenate([middle - 1, high])
            first, last = np.concatenate([first, found]), np.concatenate([found, last])
            some = low <= high
            low, high, first, last = low[some], high[some], first[some], last[some]
        best = nxt
        choices.append(choice)
    bounds, j = [], n
    for choice in reversed(choices):
        if j:
            bounds.append(int(edges[j - 1]))
            j = int(choice[j])
    return bounds[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, seed: str = "pack") -> DataFrame:
    """Columns of ``docs`` with n_tokens, bucket, boundary, batch and slot (replacing any so named).

    ``length`` defaults to the words of ``text``. The histogram of exact lengths, one row for
    each that occurs and so at most as many as the longest text has words, goes to the driver
    for the boundaries. Inside a bucket documents are numbered
    in the order of a hash: by shards of about ``SHARD`` rows, whose offsets come from their
    counts, so that no bucket is sorted in one task. A batch holds ``budget // boundary``
    documents, at least one. A null or empty text has length 0; a text longer than the
    budget is a batch of its own; an empty table gives an empty result; repeated rows take
    slots of their own.
    """
    spark = docs.sparkSession
    own = ("n_tokens", "bucket", "boundary", "batch", "slot")
    if length is None:
        length = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    hashed = F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in ("doc_id",) if c in docs.columns], *([F.when(F.col("doc_id").isNull(), F.col("text"))] if {"doc_id", "text"} <= set(docs.columns) else []))
    rows = docs.select(F.struct("*").alias("_doc"), F.coalesce(length, F.lit(0)).cast("long").alias("_n"), hashed.alias("_h"))
    histogram = rows.groupBy("_n").agg(F.count(F.lit(1)).alias("c")).orderBy("_n").collect()
    edges, counts = (np.array([r[k] for r in histogram], dtype=np.int64) for k in range(2))
    bounds = best_boundaries(edges, counts, edges * counts, buckets)
    number, shards = F.lit(0), F.lit(1)
    for b, bound in enumerate(bounds):
        inside = int(counts[(edges <= bound) & (edges > (bounds[b - 1] if b else -1))].sum())
        number = F.when(F.col("_n") > (bounds[b - 1] if b else -1), b).otherwise(number)
        shards = F.when(F.col("_n") > (bounds[b - 1] if b else -1), max(1, -(-inside // SHARD))).otherwise(shards)
    boundary = F.get(F.array(*[F.lit(x).cast("long") for x in bounds or [0]]), F.col("_b"))
    # Never null, or the join below would test both for null on the unread text, bucket by bucket.
    rows = rows.withColumns({"_b": number, "_s": F.coalesce(F.pmod(F.col("_h"), shards.cast("long")).cast("int"), F.lit(0))})
    starts = rows.groupBy("_b", "_s").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("_b", "_s", (F.sum("n").over(Window.partitionBy("_b").orderBy("_s")) - F.col("n")).alias("_start"))
    starts = written(starts, "pack-shards")
    order = [F.col("_h"), F.col("_n")] + [F.col("_doc")[c] for c in ("doc_id",) if c in docs.columns]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b", "_s").orderBy(*order)))
    rows = rows.join(starts, ["_b", "_s"]).withColumn("_at", F.col("_start") + F.col("_r") - 1)
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(boundary, F.lit(1).cast("long"))))
    out = [F.col("_n").alias("n_tokens"), F.col("_b").alias("bucket"), boundary.alias("boundary"), F.floor(F.col("_at") / capacity).alias("batch"), (F.col("_at") % capacity).cast("int").alias("slot")]
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c not in own], *out)

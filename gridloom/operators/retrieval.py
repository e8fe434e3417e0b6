"""Top-k retrieval for batches of questions, fusion, and per-table diversification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom import fixed

SCORE_DIGITS = 6
# Questions held by one task at a time, and rows scored at once; more questions mean more passes.
QUERY_BLOCK, SLICE = 8192, 1024
# Pairs of a row and a question, or of their equal terms, that a task looks at together.
PAIRS = 4_000_000


def _best(df: DataFrame, limit: int | Column, id_col: str = "chunk_id") -> DataFrame:
    """Rank by score, ties by id, and keep ``limit`` per question.

    Spark limits each partition's rows per question before the exchange (window group
    limit), so only candidates move.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


class _Best:
    """A task's best rows of every question, in the order of ``_best``."""

    def __init__(self, questions: int, limit: int) -> None:
        self.limit = limit
        self.floor = np.full(questions, -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows, self.room = 0, max(500_000, 2 * questions * limit)

    def add(self, question: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        """Rows that reach what their question's last kept row has; the others are out."""
        near = score >= self.floor[question]
        self.held.append((question[near], score[near], key[near]))
        self.rows += int(near.sum())
        if self.rows > self.room:
            self.merge()

    def merge(self) -> tuple[np.ndarray, ...] | None:
        if not self.held:
            return None
        question, score, key = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((key, -score, question))
        question, score, key = question[order], score[order], key[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        kept = place < self.limit
        last = place == self.limit - 1
        self.floor[question[last]] = score[last]
        self.held, self.rows = [(question[kept], score[kept], key[kept])], int(kept.sum())
        return self.held[0]

    def frame(self, ids: np.ndarray, id_col: str) -> Iterator[pd.DataFrame]:
        found = self.merge()
        if found is not None and len(found[0]):
            yield pd.DataFrame({"query_id": ids[found[0]], id_col: found[2], "score": found[1]})


def _names(rows: list) -> np.ndarray:
    """Question ids as they are, whatever their type."""
    out = np.empty(len(rows), dtype=object)
    out[:] = [r["query_id"] for r in rows]
    return out


def _blocks(questions: DataFrame) -> Iterator[list]:
    """Questions in blocks of about ``QUERY_BLOCK`` by a hash of id and contents."""
    total = questions.count()
    blocks = math.ceil(total / QUERY_BLOCK)
    for b in range(blocks):
        yield questions.where(F.pmod(F.xxhash64(*questions.columns), F.lit(blocks)) == b).collect()


def _result(queries: DataFrame, corpus: DataFrame, id_col: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField(id_col, corpus.schema[id_col].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _passes(spark: SparkSession, parts: list[DataFrame], schema: T.StructType, limit: int, id_col: str) -> DataFrame:
    return _best(reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema), limit, id_col)


def _dense_in_task(ids: np.ndarray, matrix: np.ndarray, limit: int, id_col: str):
    """Batches of vectors to this task's best rows per question."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(len(ids), limit)
        for pdf in batches:
            for start in range(0, len(pdf), SLICE):
                part = pdf.iloc[start : start + SLICE]
                vectors = np.stack(part["dense"].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(vectors, axis=1)
                norms[norms == 0] = 1.0
                scores = np.round((vectors @ matrix.T) / norms[:, None], SCORE_DIGITS) + 0.0
                if len(part) > limit:
                    best.floor = np.maximum(best.floor, np.partition(scores, len(part) - limit, axis=0)[len(part) - limit])
                row, question = np.nonzero(scores >= best.floor)
                best.add(question, scores[row, question], part[id_col].to_numpy()[row])
        yield from best.frame(ids, id_col)

    return run


def dense_topk(corpus: DataFrame, queries: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """Exact cosine top ``limit``: ``corpus(id, dense)`` against ``queries(query_id, dense)``.

    The corpus never shuffles: each task scores its own batches as a matrix product and
    emits its best rows per question. Questions travel to the tasks in blocks of about
    ``QUERY_BLOCK``, one pass of the corpus for each block, so that neither driver nor task
    holds more than one block.
    """
    schema = _result(queries, corpus, id_col)
    lean = corpus.select(id_col, "dense").filter(F.col("dense").isNotNull())
    parts = []
    for block in _blocks(queries.select("query_id", "dense").distinct()):
        if not block:
            continue
        matrix = np.array([r["dense"] for r in block], dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1.0, norms)
        parts.append(lean.mapInPandas(_dense_in_task(_names(block), matrix, limit, id_col), schema))
    return _passes(queries.sparkSession, parts, schema, limit, id_col)


def _sparse_in_task(ids: np.ndarray, terms: np.ndarray, of: np.ndarray, tf: np.ndarray, sizes: np.ndarray, limit: int, id_col: str, layout: pa.Schema):
    """Batches of rows' vectors to this task's best rows per question; terms are sorted.

    ``sizes`` is the questions' number of terms at each of ``terms``. Scores are rounded as integers,
    halves up.
    """

    def scored(stored: pa.Array, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row times questions plus question) with equal terms, and their scores."""
        flat = stored.flatten()
        idx, times, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "tf", "n_terms"))
        row = np.repeat(np.arange(len(stored)), lengths) * len(ids)
        lo, n = np.searchsorted(terms, idx), np.searchsorted(terms, idx, "right")
        n -= lo
        met = np.flatnonzero(n)
        row, lo, n, times, size = row[met], lo[met], n[met], times[met], size[met]
        ends = np.cumsum(n)
        dot, most = np.zeros(len(stored) * len(ids), dtype=np.int64), np.zeros(len(stored) * len(ids), dtype=np.int64)
        cuts = np.unique([0, *(np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) if len(ends) else 0, PAIRS)) + 1), len(n)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            k = n[a:b]
            at = np.repeat(lo[a:b] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            pair = np.repeat(row[a:b], k) + of[at]
            np.add.at(dot, pair, np.repeat(times[a:b], k) * tf[at])
            np.maximum.at(most, pair, np.repeat(size[a:b], k) * sizes[at])
        pair = np.flatnonzero(dot)
        unit = 10**SCORE_DIGITS
        return pair, (2 * unit * dot[pair] + most[pair]) // (2 * most[pair]) / unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(ids), limit)
        step = max(1, min(SLICE, PAIRS // max(1, len(ids))))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                pair, score = scored(part["sparse"], np.asarray(pc.fill_null(pc.list_value_length(part["sparse"]), 0)))
                row, question = pair // len(ids), pair % len(ids)
                named = np.asarray(part[id_col].is_valid())[row]
                best.add(question[named], score[named], part[id_col].drop_null().to_numpy(zero_copy_only=False)[(np.cumsum(np.asarray(part[id_col].is_valid())) - 1)[row[named]]])
                if not named.all():
                    # Numpy's keys cannot be null.
                    lost = pd.DataFrame({"query_id": ids[question[~named]], id_col: None, "score": score[~named]})
                    yield pa.RecordBatch.from_pandas(lost, schema=layout, preserve_index=False)
        for pdf in best.frame(ids, id_col):
            yield pa.RecordBatch.from_pandas(pdf, schema=layout, preserve_index=False)

    return run


def _sparse_passes(rows: DataFrame, query_postings: DataFrame, limit: int, id_col: str) -> DataFrame:
    """Best of ``rows(id, sparse)``, each with all its ``(idx, tf, n_terms)``, a pass for each block of questions."""
    asked = query_postings.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tf", "n_terms"))).alias("items"))
    schema = _result(query_postings, rows, id_col)
    layout = to_arrow_schema(schema)
    parts = []
    for block in _blocks(asked):
        flat = sorted((i["idx"], q, i["tf"], i["n_terms"]) for q, r in enumerate(block) for i in r["items"])
        if not flat:
            continue
        terms, of, tf, sizes = (np.array(x, dtype=np.int64) for x in zip(*flat))
        parts.append(rows.mapInArrow(_sparse_in_task(_names(block), terms, of, tf, sizes, limit, id_col, layout), schema))
    return _passes(rows.sparkSession, parts, schema, limit, id_col)


def stored_sparse_topk(index: DataFrame, query_postings: DataFrame, limit: int, id_col: str = "chunk_id") -> DataFrame:
    """The top ``limit`` of ``sparse_topk`` over ``index(id, sparse, n_terms)`` as it is stored.

    A stored row has all its terms, so each task scores its own rows against a block of
    questions and emits its best; nothing of the index is exchanged.
    """
    items = F.transform("sparse", lambda i: F.struct(i["idx"].alias("idx"), i["tf"].alias("tf"), F.col("n_terms").alias("n_terms")))
    lean = index.select(id_col, "sparse", "n_terms").filter(F.size("sparse") > 0)
    return _sparse_passes(lean.select(id_col, items.alias("sparse")), query_postings, limit, id_col)


def sparse_topk(
    postings: DataFrame, query_postings: DataFrame, limit: int, id_col: str = "chunk_id"
) -> DataFrame:
    """Exact dot-product top ``limit`` on shared buckets.

    ``postings(id, idx, tf, n_terms)`` should come partitioned by id (see ``vectors.postings``):
    they are then brought together by id without an exchange, each task scores its own texts
    against a block of questions, and nothing but its best is exchanged.

    Counts are multiplied as integers and divided once by both text lengths, so a score
    does not depend on the order of its terms.
    """
    rows = postings.groupBy(id_col).agg(F.collect_list(F.struct("idx", "tf", "n_terms")).alias("sparse"))
    return _sparse_passes(rows, query_postings, limit, id_col)


def fuse_rrf(
    branches: list[DataFrame], limit: int | Column, k: int = fixed.RRF_K, id_col: str = "chunk_id"
) -> DataFrame:
    """Reciprocal rank fusion: sum of ``1 / (k + position)``, positions from 0."""
    listed = branches[0].select("query_id", id_col, "rank")
    for other in branches[1:]:
        listed = listed.unionByName(other.select("query_id", id_col, "rank"))
    scored = listed.groupBy("query_id", id_col).agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank") - 1)), SCORE_DIGITS).alias("score")
    )
    return _best(scored, limit, id_col)


def hybrid_search(
    dense_corpus: DataFrame,
    sparse_corpus: DataFrame,
    dense_queries: DataFrame,
    sparse_queries: DataFrame,
    limit: int,
    k: int = fixed.RRF_K,
    id_col: str = "chunk_id",
) -> DataFrame:
    """Both branches with twice the limit, fused and cut to ``limit`` per question."""
    fetch = limit * fixed.BRANCH_FACTOR
    return fuse_rrf(
        [
            dense_topk(dense_corpus, dense_queries, fetch, id_col),
            sparse_topk(sparse_corpus, sparse_queries, fetch, id_col),
        ],
        limit,
        k,
        id_col,
    )


def attach_payload(hits: DataFrame, index: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Payload of the hits. Hits are few; the index side is one scan."""
    return hits.join(index, id_col)


def for_tables(index: DataFrame, *table_keys: str) -> DataFrame:
    """Key filter, pushed into the Parquet scan."""
    return index.filter(F.col("table_key").isin(*table_keys))


# Everything below works on hits of a question, of which there are at most
# top_k * FETCH_FACTOR, so windows by question stay small however many questions run.


def diversify(
    hits: DataFrame,
    top_k: int | Column = fixed.DEFAULT_TOP_K,
    per_table: int = fixed.HITS_PER_TABLE,
    key: str = "table_key",
) -> DataFrame:
    """At most ``per_table`` hits of a table and ``top_k`` in all, in rank order."""
    group = F.coalesce(F.col(key), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return (
        hits.withColumn("_nth", nth)
        .filter(F.col("_nth") <= per_table)
        .withColumn("place", place)
        .filter(F.col("place") <= top_k)
        .drop("_nth")
    )


def table_candidates(hits: DataFrame, key: str = "table_key") -> DataFrame:
    """Each table once per question, as its best hit, in best-hit order."""
    keyed = hits.filter(F.coalesce(F.col(key), F.lit("")) != "")
    best = keyed.withColumn(
        "_nth", F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    ).filter(F.col("_nth") == 1)
    return best.withColumn(
        "table_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    ).drop("_nth")


def table_samples(hits: DataFrame, n: int = fixed.SQL_SAMPLE_ROWS, key: str = "table_key") -> DataFrame:
    """First ``n`` non-empty hit texts of each table, in rank order."""
    nth = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    return (
        hits.filter((F.coalesce(F.col(key), F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))
        .withColumn("_nth", nth)
        .filter(F.col("_nth") <= n)
        .groupBy("query_id", key)
        .agg(F.array_sort(F.collect_list(F.struct("_nth", "text"))).alias("_s"))
        .select("query_id", key, F.transform("_s", lambda s: s["text"]).alias("samples"))
    )


def sources(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "place", "source_file", "sheet", "table_index", "row_index", "table_key", "score", "text"
    )


def raw_answers(diverse: DataFrame) -> DataFrame:
    """First three hit texts, one per line, when there is no model."""
    return (
        diverse.filter(F.col("place") <= fixed.RAW_ANSWER_ROWS)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_t"))
        .select(
            "query_id",
            F.btrim(
                F.array_join(F.transform("_t", lambda t: t["text"]), "\n"), F.lit(fixed.WHITE_SPACE)
            ).alias("answer"),
        )
    )

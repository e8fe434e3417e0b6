"""Approximate nearest neighbours over learned partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import groups
from gridloom.session import written

# The partitioning is learned on at most SAMPLE vectors; a partition holds about SIZE different
# vectors, up to MAX_PARTS partitions (beyond, they grow). How many partitions a query looks
# into is measured: as few as find TARGET of the neighbours of vectors kept out of training.
SAMPLE, SIZE, MAX_PARTS, TARGET = 8_192, 600, 1_024, 0.96
# Different vectors of a partition, and queries sent to it, that meet in one group.
CHUNK, QUERIES = 2_048, 4_096


@dataclass
class Router:
    """A softmax layer over [vector direction, 1]: which partitions hold a vector's neighbours."""

    weights: np.ndarray

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        logits = x @ self.weights[:-1] + self.weights[-1]
        n = min(n, logits.shape[1])
        top = np.argpartition(-logits, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(logits, top, 1), axis=1, kind="stable"), 1)


def neighbour_graph(x: np.ndarray, k: int = 10) -> np.ndarray:
    """The k nearest of each sample vector by inner product of directions, in blocks."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for a in range(0, len(x), 1_024):
        score = x[a : a + 1_024] @ x.T
        score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
        out[a : a + 1_024] = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Parts of nearly equal size that cut few graph edges.

    Seeds grow from directions, then rounds move vectors to the part of most of their
    neighbours; a part takes only as many as its share allows, the surest first.
    """
    rng = np.random.default_rng(5)
    n = len(x)
    capacity = int(np.ceil(n / parts * 1.1))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros((parts, x.shape[1]))
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), x[rng.choice(n, parts)])
    part = np.argmax(x @ centres.T, axis=1)
    for _ in range(rounds):
        votes = x @ centres.T * 0.5
        linked = part[graph]
        for j in range(graph.shape[1]):
            np.add.at(votes, (np.arange(n), linked[:, j]), 1.0 / graph.shape[1])
        part, full = np.full(n, -1), np.zeros(parts, dtype=np.int64)
        left = np.arange(n)
        while len(left):
            choice = np.argmax(votes[left], axis=1)
            sure = votes[left, choice]
            order = np.lexsort((-sure, choice))
            rank = np.arange(len(left)) - np.searchsorted(choice[order], choice[order])
            fits = rank < (capacity - full)[choice[order]]
            taken = left[order[fits]]
            part[taken] = choice[order[fits]]
            full += np.bincount(part[taken], minlength=parts)
            left = left[order[~fits]]
            votes[:, full >= capacity] = -np.inf
        sums = np.zeros((parts, x.shape[1]))
        np.add.at(sums, part, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return part


def train_router(x: np.ndarray, parts: int, epochs: int = 30) -> Router:
    """Partition the sample's neighbour graph; fit the router to the parts of neighbours."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    if parts <= 1 or len(x) < 4 * parts:
        return Router(np.zeros((x.shape[1] + 1, 1)))
    graph = neighbour_graph(x)
    part = balanced_partition(x, graph, parts)
    rng = np.random.default_rng(3)
    centres = np.zeros((parts, x.shape[1]))
    np.add.at(centres, part, x)
    w = np.vstack([10 * (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).T, np.zeros(parts)])
    target = np.zeros((len(x), parts), dtype=np.float32)
    np.add.at(target, (np.arange(len(x)), part), 0.5)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[graph[:, j]]), 0.5 / graph.shape[1])
    full = np.hstack([x, np.ones((len(x), 1))])
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 512)):
            logits = full[rows] @ w
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = full[rows].T @ (p - target[rows]) / len(rows) + 1e-4 * w / len(rows)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Router(w)


def needed_probes(x: np.ndarray, parts: int, k: int, target: float) -> tuple[Router, int]:
    """A router trained on seven eighths of a sample, and the probes that the rest needs.

    The rest are queries; how high the router ranks the partitions of their true neighbours
    among the trained vectors tells which share of neighbours each number of probes finds.
    """
    held = np.arange(len(x)) % 8 == 7
    router = train_router(x[~held], parts)
    parts = router.weights.shape[1]
    if parts == 1 or not held.any():
        return router, parts
    score = x[held] @ x[~held].T
    k = min(k, score.shape[1])
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = router.order(x[held], parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None].repeat(len(order), 0), 1)
    found = np.take_along_axis(rank, router.order(x[~held], 1)[:, 0][true], 1)
    share = np.cumsum(np.bincount(found.reshape(-1), minlength=parts)) / found.size
    return router, int(np.searchsorted(share, target)) + 1 if share[-1] >= target else parts


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, target: float = TARGET, size: int = SIZE) -> DataFrame:
    """For each query (vec_id divisible by ``every``) its ``k`` nearest by inner product.

    Returns query_id, rank, vec_id, score (the double-precision inner product of the original
    vectors), ties to the smaller vec_id. Null and zero vectors, those with null or
    non-finite components, or without an id take no part; vectors of several lengths are each
    answered among those of their own length; an empty table gives an empty result, and columns
    other than vec_id and embedding are not looked at.

    Equal vectors are one candidate that carries its ``k + 1`` smallest ids, and equal queries
    are one query, so a vector that makes up a third of the table costs no more than another.
    The router is learned on a bounded hash sample and sent to all tasks; every vector is put
    into its likeliest partition, every query into as many of its likeliest as were measured to
    find ``target`` of the neighbours, and they meet by (partition, chunk of its vectors, block
    of its queries). The less structure the vectors have, the more partitions that takes. A
    repeated vec_id is one candidate per different vector.
    """
    spark = vectors.sparkSession
    value = F.transform("embedding", lambda v: v.cast("double"))
    good = vectors.select("vec_id", value.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = good.where(F.forall("v", finite)).where(F.exists("v", lambda x: x != 0)).withColumn("h", F.xxhash64("v"))
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.bool_or(F.col("vec_id") % every == 0).alias("asked")).where("asked").orderBy("d")
    found = [_among(good.where(F.size("v") == r[0]), r[0], k, every, target, size) for r in lengths.collect()]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _among(good: DataFrame, dims: int, k: int, every: int, target: float, size: int) -> DataFrame:
    """``nearest`` of usable ``(vec_id, v, h)`` whose vectors have ``dims`` components."""
    spark = good.sparkSession
    ranked = good.distinct().withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = written(ranked.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    number = distinct.count()
    parts = max(1, min(MAX_PARTS, number // size))
    sample = np.array([r[0] for r in distinct.orderBy("h").select("v").limit(SAMPLE).collect()], dtype=np.float64).reshape(-1, dims)
    # As deep in the sample as k is in the table.
    depth = max(1, round(k * len(sample) / max(1, number)))
    learned, probes = needed_probes(sample, min(parts, max(1, len(sample) // 16)), depth, target)
    router = spark.sparkContext.broadcast(learned)

    def rows_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)

    def place(take: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = router.value.order(rows_of(batch["v"]), take)
                of = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)), pa.array(order.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, of], [*batch.schema.names, "parts"])

        return run

    base = distinct.select("h", "v", "ids")
    kind = "h long, v array<double>, ids array<long>"
    placed = written(base.mapInArrow(place(1), f"{kind}, parts array<int>").select("h", "v", "ids", F.get("parts", F.lit(0)).alias("part")), "placed")
    sizes = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    chunks = {r[0]: r[1] for r in sizes.collect()}  # at most MAX_PARTS rows
    count = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in chunks.items() for x in kv]), F.col("part")), F.lit(0))
    candidates = placed.select("part", F.pmod(F.col("h"), count.cast("long")).cast("int").alias("chunk"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("q"), "v", "ids")
    asking = good.where(F.col("vec_id") % every == 0).select("vec_id", "h", "v").distinct()
    # How many queries a partition is asked by: at most MAX_PARTS rows.
    queries = asking.groupBy("h", "v").agg(F.count(F.lit(1)).alias("n")).select(F.col("h"), F.col("v"), F.array(F.col("n")).alias("ids"))
    routed = queries.mapInArrow(place(probes), f"{kind}, parts array<int>").select("h", "v", F.explode("parts").alias("part"))
    asked_by = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    blocks = {r[0]: r[1] for r in asked_by.collect()}
    among = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("part")), F.lit(0)) if blocks else F.lit(0)
    routed = routed.withColumn("block", F.pmod(F.col("h"), among.cast("long")).cast("int"))
    # A chunk meets every block of the queries; what nobody asks for stays where it is.
    candidates = candidates.withColumn("blocks", among).where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    candidates = candidates.select("part", "chunk", "block", "side", "q", "v", "ids")
    routed = routed.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1))) if chunks else routed.withColumn("chunk", F.lit(0))
    routed = routed.select("part", "chunk", "block", F.lit(1).alias("side"), F.col("h").alias("q"), "v", F.array().cast("array<long>").alias("ids"))
    meeting = candidates.union(routed).repartition("part", "chunk", "block").sortWithinPartitions("part", "chunk", "block", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(group: pa.Table) -> tuple[np.ndarray, ...] | None:
            side = group["side"].to_numpy()
            at = int(np.searchsorted(side, 1))
            if at in (0, len(side)):
                return None
            v = rows_of(group["v"].combine_chunks())
            ids = group["ids"].slice(0, at).to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
            flat = np.concatenate(ids)
            asked = group["q"].to_numpy()[at:]
            out = []
            for a in range(at, len(v), 512):
                score = v[a : a + 512] @ v[:at].T
                # k + 1 different vectors hold every answer but the query itself, ties aside.
                least = -np.partition(-score, min(k, at - 1), axis=1)[:, min(k, at - 1)]
                row, col = np.nonzero(score >= least[:, None] - 1e-9 * (1 + np.abs(least[:, None])))
                n = (bounds[1:] - bounds[:-1])[col]
                row, start, exact = np.repeat(row, n), np.repeat(bounds[col] - (np.cumsum(n) - n), n), np.repeat(score[row, col], n)
                out.append((asked[a - at + row], flat[start + np.arange(len(row))], exact))
            return best_of(*(np.concatenate(x) for x in zip(*out)))

        def best_of(q: np.ndarray, i: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) <= k
            return q[keep], i[keep], s[keep]

        # What a task has found for a query is merged before it is sent on.
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for group in groups(batches, ["part", "chunk", "block"]):
            found = one(group)
            if found is None:
                continue
            held.append(found)
            rows += len(found[0])
            if rows > 500_000:
                held = [best_of(*(np.concatenate(x) for x in zip(*held)))]
                rows = len(held[0][0])
                if rows > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["q", "vec_id", "score"])
                    held, rows = [], 0
        if held:
            merged = best_of(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged], ["q", "vec_id", "score"])

    found = meeting.mapInArrow(search, "q long, vec_id long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))).alias("best"))
    answered = asking.select(F.col("vec_id").alias("query_id"), F.col("h").alias("q")).join(lists, "q")
    own = F.slice(F.filter("best", lambda b: b["i"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(own).alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score"))

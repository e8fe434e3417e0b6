"""What the operators share: tables, row numbers, byte words, grouped batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import written

# A word is a run of anything but ASCII white space; bytes.split() cuts in the same places.
WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, *columns: str, name: str = "_row") -> DataFrame:
    """The named columns with a row number, so that null and repeated ids stay apart.

    The number is a row's place in its input split, and splits follow the executors that are
    there when the scan is planned. Who uses the number twice must therefore write it once.
    """
    return docs.select(F.monotonically_increasing_id().alias(name), *columns)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    value = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds at most ``limit`` bytes of a column, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start, base = 0, 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start, base = end, int(ends[end - 1])


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after the other, and the bounds of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that close inputs become unrelated numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Each run of equal keys of a sorted partition; a run may span batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        if held is not None:
            part = pa.concat_tables([held, part])
        change = np.zeros(part.num_rows, dtype=bool)
        for key in keys:
            values = part[key].combine_chunks().to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change)])
        part = part.combine_chunks()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield part.slice(a, b - a)
        held = part.slice(cuts[-1])
    if held is not None:
        yield held.combine_chunks()


def by_groups(batches: Iterator[pa.RecordBatch], keys: list[str], then: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """What ``then`` makes of each group; nothing for None and for empty batches."""
    for group in groups(batches, keys):
        out = then(group)
        if out is not None and out.num_rows:
            yield out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a, b)`` links as ``(node, root)``, root the smallest node.

    Every round joins each node's links to its smallest neighbour and halves the paths, the
    links of a round being written to the shared folder; nothing but a count reaches the
    driver. Links of one node are never gathered in one place: minima combine before the
    shuffle.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links"
    )
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    changed = True
    while changed:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("best"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "best").alias("to"))
        # A root that has found a smaller one takes all that point at it along.
        hook = step.groupBy(F.col("root").alias("r")).agg(F.min("to").alias("hook"))
        moved = step.join(hook, F.col("root") == F.col("r"), "left").select("node", F.col("root").alias("old"), F.least("to", "hook").alias("root"))
        jump = moved.select(F.col("node").alias("r"), F.col("root").alias("up"))
        nxt = written(
            moved.join(jump, F.col("root") == F.col("r"), "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "roots"
        )
        changed = not nxt.where("root <> old").isEmpty()
        roots = nxt.select("node", "root")
    return roots


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)

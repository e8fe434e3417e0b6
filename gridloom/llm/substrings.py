"""Removing byte strings that occur elsewhere, by refining buckets of q-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import flat_bytes, groups, mix64, numbered, pieces
from gridloom.session import written

# Strings of LENGTH bytes are compared. Each holds LENGTH - GRAM + 1 grams, of which its smallest
# is the anchor that puts it into a bucket.
LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
_M = 0x5851F42D4C957F2D
_INVERSE = pow(_M, -1, 1 << 64)
# Contexts of one bucket that are compared in one task; larger buckets are dealt out.
CHUNK = 16_384
_BYTES = np.random.default_rng(64).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 0 to n at least."""
    size = max(1 << 19, 1 << int(n).bit_length())
    if size not in _powers:
        if size > 1 << 19:
            _powers.pop(next((k for k in _powers if k > 1 << 19), 0), None)
        both = []
        for x in (_M, _INVERSE):
            p = np.full(size, x, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[size] = tuple(both)
    return _powers[size]


class Hashes:
    """Hashes of any stretch of a run of bytes, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        powers, self.back = _power_table(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share an anchor: (gram, context, text, first start, starts).

    The anchor of a window is the smallest gram in it, the leftmost of equals. The context is
    the bucket identifier of all bytes that the run's windows cover, with the anchor's place.
    """
    none = tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    hashes = Hashes(data)
    n = len(data) - GRAM + 1
    gram = hashes.of(slice(0, n), slice(GRAM, GRAM + n))
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (gram >> bits << bits) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - size)], low[WINDOW - size :])
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + LENGTH <= bounds[1:][text])
    if not len(starts):
        return none
    at, text = at[starts], text[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    number = np.diff(np.concatenate([new, [len(starts)]]))
    first, anchor, text = starts[new], at[new], text[new]
    span = mix64(hashes.of(first, first + number - 1 + LENGTH))
    context = mix64(span ^ ((anchor - first) * 256 + number).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return gram[anchor].view(np.int64), context.view(np.int64), text, first - bounds[text], number


def _squeezed(docs: DataFrame) -> DataFrame:
    """Row numbers, ids and compressed texts, for joins that carry the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_t"):
                texts = [(t or "").encode() for t in piece["_t"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece["_row"], piece["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())],
                    ["_row", "doc_id", "size", "z"],
                )

    return docs.select("_row", "doc_id", F.col("text").alias("_t")).mapInArrow(run, f"_row long, doc_id {kind}, size long, z binary")


def _text(z: bytes, size: int) -> bytes:
    return pa.decompress(z, size, "zstd", asbytes=True) if size else b""


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, or part of a large one, the runs of windows that it holds twice.

    ``run`` alone is settled. Of a part, a window found once comes with its identifier and its
    run, to be looked up in the other parts, and one found more often with weight 2 and no row.
    """
    kinds = {"_row": pa.int64(), "run": pa.int64(), "gram": pa.int64(), "window": pa.int64(), "weight": pa.int32()}

    def out(**columns: np.ndarray) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))

    def settle(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        part = pa.concat_tables(held).combine_chunks()
        data, bounds = flat_bytes(part["bytes"].combine_chunks())
        at, row, gram, alone = (part[c].to_numpy(zero_copy_only=False) for c in ("at", "_row", "gram", "alone"))
        group = np.repeat(np.arange(len(held)), [g.num_rows for g in held])
        number = at % 256
        record = np.repeat(np.arange(len(at)), number)
        offset = np.arange(len(record)) - np.repeat(np.cumsum(number) - number, number)
        first = bounds[:-1][record] + offset
        window = mix64(Hashes(data).of(first, first + LENGTH)).view(np.int64)
        weight = np.where(alone, 1, 2)[record]
        order = np.lexsort((window, group[record]))
        key = np.flatnonzero(np.concatenate([[True], (np.diff(window[order]) != 0) | (np.diff(group[record][order]) != 0)]))
        total = np.add.reduceat(weight[order], key)
        twice = np.empty(len(record), dtype=bool)
        twice[order] = np.repeat(total > 1, np.diff(np.concatenate([key, [len(record)]])))
        hit = np.flatnonzero(twice & alone[record])
        if len(hit):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(record[hit]) != 0)]))
            length = np.diff(np.concatenate([new, [len(hit)]]))
            begin = hit[new]
            yield out(_row=row[record[begin]], run=(at[record[begin]] // 256 + offset[begin]) * 65536 + length)
        dealt = (part["chunks"].to_numpy() > 1)[record]
        once = np.flatnonzero(dealt & ~twice)
        if len(once):
            yield out(_row=row[record[once]], run=(at[record[once]] // 256 + offset[once]) * 65536 + 1, gram=gram[record[once]], window=window[once], weight=np.ones(len(once), np.int32))
        more = order[key[total > 1]]
        more = more[dealt[more]]
        if len(more):
            yield out(gram=gram[record[more]], window=window[more], weight=np.full(len(more), 2, np.int32))

    held: list[pa.Table] = []
    rows = 0
    for group in groups(batches, ["gram", "chunk"]):
        held.append(group)
        rows += group.num_rows
        if rows > 1_024:
            yield from settle(held)
            held, rows = [], 0
    if held:
        yield from settle(held)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(_row, starts)``: per row the runs ``start * 65536 + number`` of repeated 200-byte windows.

    1. Every window is put into the bucket of its anchor gram, neighbouring windows with one
       anchor as one record, about one for seventy bytes. Buckets of one record drop out.
    2. A bucket is refined by the identifier of the bytes around the anchor. Where records agree
       on all of them, all their windows are repeated; one of them goes on for the others.
    3. Where a bucket still holds different surroundings, its records are refined once more, by
       the identifier of each single window; those met twice are repeated.

    Counts combine before each shuffle and joins are by key, so a string that is found in a
    third of all texts is no hot group.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_t", 1 << 18):
                gram, context, text, first, number = anchors(*flat_bytes(piece["_t"]))
                if len(gram):
                    rows = piece["_row"].to_numpy()[text]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, context, rows, first * 256 + number)], ["gram", "context", "_row", "at"])

    marked = docs.select("_row", F.col("text").alias("_t")).mapInArrow(mark, "gram long, context long, _row long, at long")
    marked = written(marked, "substring-anchors")
    # Written, so that the join reads it from files and can split the records of a hot gram.
    often = written(marked.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram"), "substring-grams")
    shared = written(marked.join(often, "gram"), "substring-shared")
    place = F.struct("_row", "at")
    contexts = written(shared.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "substring-contexts")
    mixed = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    mixed = written(mixed.select("gram", F.ceil(F.col("kinds") / CHUNK).cast("int").alias("chunks")), "substring-mixed")
    open_ = contexts.join(mixed, "gram").select(
        F.col("first._row").alias("_row"), F.struct("gram", "chunks", F.col("first.at").alias("at"), (F.col("n") == 1).alias("alone")).alias("a")
    )
    per_row = open_.groupBy("_row").agg(F.collect_list("a").alias("open"))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each record with the bytes that its windows cover."""
        names = ["gram", "chunks", "at", "alone"]
        for batch in batches:
            for row, size, z, records in zip(*(batch[c].to_pylist() for c in ("_row", "size", "z", "open"))):
                data = _text(z, size)
                cut = [data[r["at"] // 256 : r["at"] // 256 + r["at"] % 256 - 1 + LENGTH] for r in records]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array([r[n] for r in records], t) for n, t in zip(names, (pa.int64(), pa.int32(), pa.int64(), pa.bool_()))], pa.array(np.full(len(records), row)), pa.array(cut, pa.binary())],
                    [*names, "_row", "bytes"],
                )

    around = per_row.join(_squeezed(docs).drop("doc_id"), "_row").mapInArrow(surround, "gram long, chunks int, at long, alone boolean, _row long, bytes binary")
    around = around.withColumn("chunk", F.pmod(F.xxhash64("_row", "at"), F.col("chunks").cast("long")).cast("int"))
    refined = around.repartition("gram", "chunk").sortWithinPartitions("gram", "chunk").mapInArrow(_refine, "_row long, run long, gram long, window long, weight int")
    refined = written(refined, "substring-windows")
    single = refined.where("window IS NULL").select("_row", "run")
    # Windows of buckets that were dealt out: counted over all parts.
    rest = refined.where("window IS NOT NULL")
    again = rest.groupBy("gram", "window").agg(F.sum("weight").alias("m")).where("m > 1").select("gram", "window")
    dealt = rest.where("_row IS NOT NULL").join(again, ["gram", "window"]).select("_row", "run")
    whole = shared.join(contexts.where("n > 1").select("gram", "context"), ["gram", "context"])
    whole = whole.select("_row", (F.floor(F.col("at") / 256) * 65536 + F.col("at") % 256).alias("run"))
    return single.union(dealt).union(whole).groupBy("_row").agg(F.collect_list("run").alias("runs"))


def strip_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes.

    Removes each byte covered by a string of 200 bytes that also starts anywhere else, in the
    same text or another; overlaps count, and the input is what strings are judged on. A
    null text is empty; texts under 200 bytes stay whole; repeated rows of at least 200
    bytes vanish; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, size, z, runs in zip(*(batch[c].to_pylist() for c in ("doc_id", "size", "z", "runs"))):
                data = _text(z, size)
                spans, removed = 0, 0
                if runs:
                    run = np.array(runs, dtype=np.int64)
                    change = np.zeros(size + 1, dtype=np.int32)
                    np.add.at(change, run // 65536, 1)
                    np.add.at(change, run // 65536 + run % 65536 - 1 + LENGTH, -1)
                    gone = np.cumsum(change)[:size] > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    data = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                out.append((doc_id, size, removed, spans, hashlib.sha256(data).hexdigest(), data))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), layout.types)] if out else [pa.array([], t) for t in layout.types], layout.names)

    layout = pa.schema([("doc_id", docs.select("doc_id").limit(0).toArrow().schema.field(0).type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    docs = written(numbered(docs, "doc_id", "text"), "numbered-texts")
    rows = _squeezed(docs).join(repeated_spans(docs), "_row", "left")
    return rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

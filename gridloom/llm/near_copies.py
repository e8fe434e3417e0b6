"""Near copies: an n-gram Jaccard join with Bayesian pruning of candidates and exact checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import by_groups, components, flat_bytes, groups, mix64, numbered, pieces
from gridloom.session import written

SHINGLE, NUM, DEN = 5, 4, 5  # five words, similarity of at least 4/5
# MinHash values; BANDS bands of ROWS equal values make a candidate, so a pair of similarity
# 0.8 is missed with a probability of (1 - 0.8 ** ROWS) ** BANDS, or 5e-8.
HASHES, BANDS, ROWS, STEP = 128, 32, 4, 16
TOLERANCE = 1e-8
BLOCK = 512
_P = np.uint64(0x9E3779B97F4A7C55)
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(words: list[bytes], hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words; of all words if they are fewer."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    for w in set(words).difference(hashes):
        hashes[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(words))
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = out * _P + h[k : k + n]
    return np.unique(mix64(out + np.uint64(size)))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Sixteen bits of each MinHash value, one row per non-empty set."""
    flat = np.concatenate(sets)
    x = (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), dtype=np.uint16)
    for k in range(HASHES):
        least = np.minimum.reduceat(x * _A[k] + _B[k], starts)
        out[:, k] = (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
    return out


def least_matches(tolerance: float = TOLERANCE) -> np.ndarray:
    """For 16, 32, ... compared values: the fewest equal ones with which a pair is kept.

    With a uniform prior the similarity has a Beta(m + 1, n - m + 1) posterior; a pair goes
    when the part of it from 0.8 upwards is below the tolerance.
    """
    t = NUM / DEN
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = lambda m, n=n: sum(comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= tolerance))
    return np.array(out)


def _pairs(starts: np.ndarray, sizes: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside the groups, in slices of about ``most``."""
    first = np.repeat(starts, sizes)  # every member with those after it in its group
    at = np.arange(len(first)) + (starts[0] if len(starts) else 0)
    after = np.repeat(starts + sizes, sizes) - at - 1
    ends = np.cumsum(after)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        n = after[a:b]
        left = np.repeat(at[a:b], n)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        a = b


def surviving(sig: np.ndarray, band: np.ndarray, block: np.ndarray, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the groups that meet in their band for the first time and are not pruned.

    ``own`` tells the groups that hold one block; in the others only pairs across blocks count.
    """
    wide = sig.view(np.uint64)
    left, right = [], []
    for i, j in _pairs(starts, sizes):
        ok = own[i] | (block[i] != block[j])
        i, j = i[ok], j[ok]
        for b in np.unique(band[i]):
            of = band[i] == b
            x, y = i[of], j[of]
            if b:
                new = ~(wide[x, :b] == wide[y, :b]).any(axis=1)
                x, y = x[new], y[new]
            same = np.zeros(len(x), dtype=np.int64)
            for step, need in enumerate(least):
                if not len(x):
                    break
                cols = slice(step * STEP, (step + 1) * STEP)
                same += (sig[x, cols] == sig[y, cols]).sum(axis=1)
                keep = same >= need
                x, y, same = x[keep], y[keep], same[keep]
            left.append(x)
            right.append(y)
    empty = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def common_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the named pairs of sets, exactly."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)], dtype=np.int64)
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
    often = n > 1
    column = np.cumsum(often) - 1
    keep = often[inverse]
    of, column = of[keep], column[inverse[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for a in range(0, int(often.sum()), 8_192):
        lo, hi = np.searchsorted(column, [a, a + 8_192])
        part = np.zeros((len(sets), 8_192), dtype=np.float32)
        part[of[lo:hi], column[lo:hi] - a] = 1
        total += part @ part.T
    return total[x, y].astype(np.int64)


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members is linked to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, x, low)
        np.minimum.at(nxt, y, low)
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            return root
        root = nxt


def describe(docs: DataFrame) -> DataFrame:
    """``(_row, doc_id, digest, n, sig)``: the shingle set of each text, as digest, size and signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_t"):
                data, bounds = flat_bytes(piece["_t"])
                raw, hashes = data.tobytes(), {}
                sets = [shingles(raw[bounds[i] : bounds[i + 1]].split(), hashes) for i in range(piece.num_rows)]
                full = [s for s in sets if len(s)]
                sig = iter(signature(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece["_row"],
                        piece["doc_id"],
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["_row", "doc_id", "digest", "n", "sig"],
                )

    rows = docs.select("_row", "doc_id", F.col("text").alias("_t"))
    return rows.mapInArrow(run, f"_row long, doc_id {kind}, digest binary, n int, sig binary")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(row, to, docs, texts)``: per class and place of meeting its verified links.

    ``to`` is the smallest class that it is linked to there, ``docs`` and ``texts`` how many
    documents and different texts. Classes meet by band value, a band value of many classes
    in pairs of blocks, so a task holds at most two blocks, and no pair becomes a row. A pair
    is looked at only in the first band that it shares, so sums over places count it once.
    """
    bands = classes.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("sig", i * 8 + 1, F.lit(8)))).alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = bands.join(shared, ["band", "key"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks").cast("long")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = ["band", "key", "p", "q"]
    members = members.select("band", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "row")
    sized = classes.select("row", "sig", "n", "size")
    least = least_matches()

    def columns(part: pa.Table) -> tuple:
        sig = np.frombuffer(b"".join(part["sig"].to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
        p, q = part["p"].to_numpy(), part["q"].to_numpy()
        return sig, part["band"].to_numpy(), part["block"].to_numpy(), p == q

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            part = pa.concat_tables(held).combine_chunks()
            sizes = np.array([g.num_rows for g in held])
            x, y = surviving(*columns(part), np.cumsum(sizes) - sizes, sizes, least)
            kept = np.unique(np.concatenate([x, y]))
            if len(kept):
                yield from part.take(pa.array(kept)).to_batches()

        held: list[pa.Table] = []
        for group in groups(batches, meet):
            held.append(group)
            if sum(g.num_rows for g in held[-64:]) > 2_048 or len(held) > 2_000:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    layout = "band int, key binary, p int, q int, block int, row long, sig binary, n int, size long"
    met = members.join(sized, "row").select("band", "key", "p", "q", "block", "row", "sig", "n", "size")
    candidates = met.repartition(*meet).sortWithinPartitions(*meet, "block").mapInArrow(prune, layout)
    candidates = written(candidates, "candidates")
    codec = "zstd"

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_t"):
                texts = [t.encode() for t in piece["_t"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece["row"], pa.array([len(t) for t in texts], pa.int64()), pa.array([pa.compress(t, codec, asbytes=True) for t in texts], pa.binary())], ["row", "size_raw", "z"]
                )

    texts = docs.select(F.col("_row").alias("row"), F.col("text").alias("_t")).where("_t IS NOT NULL")
    texts = texts.mapInArrow(squeeze, "row long, size_raw long, z binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(group: pa.Table) -> pa.RecordBatch | None:
            m = np.array([group.num_rows])
            x, y = surviving(*columns(group), np.zeros(1, dtype=np.int64), m, least)
            if not len(x):
                return None
            hashes: dict[bytes, int] = {}
            raw = [pa.decompress(z, n, codec, asbytes=True) if n else b"" for z, n in zip(group["z"].to_pylist(), group["size_raw"].to_pylist())]
            sets = [shingles(t.split(), hashes) for t in raw]
            n, size, row = np.array([len(s) for s in sets]), group["size"].to_numpy(), group["row"].to_numpy()
            both = common_counts(sets, x, y)
            ok = both * DEN >= NUM * (n[x] + n[y] - both)
            x, y = x[ok], y[ok]
            if not len(x):
                return None
            docs_n = np.bincount(x, weights=size[y], minlength=len(n)) + np.bincount(y, weights=size[x], minlength=len(n))
            texts_n = np.bincount(x, minlength=len(n)) + np.bincount(y, minlength=len(n))
            order = np.argsort(row)
            rank = np.argsort(order)
            root = row[order[_roots(len(n), rank[x], rank[y])]][rank]
            linked = texts_n > 0
            return pa.RecordBatch.from_arrays([pa.array(c[linked]) for c in (row, root, docs_n.astype(np.int64), texts_n.astype(np.int64))], ["row", "to", "docs", "texts"])

        yield from by_groups(batches, meet, one)

    full = candidates.join(texts, "row").select("band", "key", "p", "q", "block", "row", "sig", "n", "size", "z", "size_raw")
    return full.repartition(*meet).sortWithinPartitions(*meet, "block").mapInArrow(verify, "row long, to long, docs long, texts long")


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per document: ``_row``, doc_id, class_row, class_id, n_links, n_text_links, n_copies.

    A link joins two documents whose sets of five-word shingles (words as they stand, cut at
    ASCII white space; a shorter text is one shingle) have a Jaccard similarity of 0.8 or
    more; a class is what links connect. ``class_id`` is the smallest doc_id in it and
    ``class_row`` the row that has it; ``n_links`` counts linked documents, ``n_text_links`` the
    different shingle sets among them, ``n_copies`` the documents with an equal set. Texts
    without words, null or empty, link to nothing. Repeated rows are copies; a null doc_id
    comes after all others, and a class without any has a null class_id.

    Equal sets are one class of copies from the start, so a text that makes up a third of
    the table is one row in the search for candidates.
    """
    return _classes(written(numbered(docs, "doc_id", "text"), "numbered-texts"))


def _classes(docs: DataFrame) -> DataFrame:
    """``near_classes`` of ``(_row, doc_id, text)``."""
    described = written(describe(docs), "shingle-sets")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_row").alias("row"), "n", "sig")
    classes = described.where("digest IS NOT NULL").groupBy("digest").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("size"))
    classes = written(classes.select("digest", "size", F.col("f.row").alias("row"), F.col("f.doc_id").alias("first_id"), F.col("f.n").alias("n"), F.col("f.sig").alias("sig")), "classes")
    found = written(links(docs, classes), "links")
    joined = components(found.select(F.col("row").alias("a"), F.col("to").alias("b")))
    sums = found.groupBy("row").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    placed = classes.select("digest", "size", "row", "first_id").join(sums, "row", "left").join(joined.withColumnRenamed("node", "row"), "row", "left")
    placed = placed.withColumn("root", F.coalesce("root", "row"))
    named = placed.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "row")).alias("best"))
    named = named.select("root", F.col("best.first_id").alias("class_id"), F.col("best.row").alias("class_row"))
    placed = placed.join(named, "root").select("digest", "size", "docs", "texts", "class_id", "class_row")
    out = described.select("_row", "doc_id", "digest").join(placed, "digest", "left")
    alone = F.col("size").isNull()
    return out.select(
        "_row",
        "doc_id",
        F.coalesce("class_row", "_row").alias("class_row"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("docs", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        F.coalesce("size", F.lit(1)).cast("long").alias("n_copies"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents without those that are not the first of their class; columns as they are."""
    packed = written(numbered(docs, F.struct("*").alias("_doc")), "numbered-documents")
    found = _classes(packed.select("_row", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text")))
    return packed.join(found.where("_row <> class_row").select("_row"), "_row", "left_anti").select("_doc.*")

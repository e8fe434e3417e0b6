"""Ranked lexical search by best positions: impact lists read from the top, unseen documents bounded."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import flat_bytes, numbered, pieces
from gridloom.session import written

# Items are answered in blocks of about so many bytes of text, which bounds what is sent to
# the tasks; an item longer than that is sent as it is.
BLOCK_BYTES = 8 << 20
# Postings of a task that are searched at once; the best so far are carried to the next ones.
SHARD = 2_000_000
FIRST_STEP = 16
# Everything that is ASCII and neither a digit nor a letter separates; A-Z become a-z.
_TERMS = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_TERMS).split()


class _Kinds(dict):
    """Query terms as numbers; every other term is -1 and is not kept."""

    def __missing__(self, term: bytes) -> int:
        return -1


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(_row, doc_id, n, terms, tfs)``: per document with a term its length and, of the query terms, number and count."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _Kinds(known.value)
        for batch in batches:
            for piece in pieces(batch, "_t"):
                data, bounds = flat_bytes(piece["_t"])
                raw = data.tobytes().translate(_TERMS)
                n, terms, tfs = [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    words = raw[a:b].split()
                    at = np.fromiter(map(kinds.__getitem__, words), dtype=np.int64, count=len(words))
                    term, tf = np.unique(at[at >= 0], return_counts=True)
                    n.append(len(words))
                    terms.append(term.astype(np.int32).tobytes())
                    tfs.append(tf.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [piece["_row"], piece["doc_id"], pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                    ["_row", "doc_id", "n", "terms", "tfs"],
                )

    texts = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_t"))
    return texts.mapInArrow(run, "_row long, doc_id long, n long, terms binary, tfs binary").where("n > 0")


def weights(found: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of each query term, number of documents and their terms; a task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            at = np.frombuffer(b"".join(batch["terms"].to_pylist()), np.int32)
            df += np.bincount(at, minlength=size)
            docs += batch.num_rows
            words += int(batch["n"].to_numpy().sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [docs, words]]))], ["term", "c"])

    counts = dict(found.select("n", "terms").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c")).collect())
    total = counts.get(-1, 0)
    w = [math.floor(1000 * math.log((2 * total + 2) / (2 * counts.get(t, 0) + 1))) for t in range(size)]
    return np.array(w, dtype=np.int64), total, counts.get(-2, 0)


class _Lists:
    """Impact lists of a shard: by term, highest impact first, and by document for direct accesses."""

    def __init__(self, n: np.ndarray, bounds: np.ndarray, term: np.ndarray, tf: np.ndarray, w: np.ndarray, docs: int, words: int):
        lengths, at = np.unique(n, return_inverse=True)
        # Exact for any length: Python's integers do not overflow.
        m = np.array([50 + 50 * int(x) * docs // words for x in lengths], dtype=np.int64)[at]
        doc = np.repeat(np.arange(len(n)), np.diff(bounds))
        impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        order = np.lexsort((-impact, term))
        self.start = np.searchsorted(term[order], np.arange(len(w) + 1))
        self.doc, self.impact = doc[order], impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order)) - self.start[term[order]]
        self.bounds, self.by_doc_term, self.by_doc_impact = bounds, term, impact
        self.seen = np.zeros(len(n), dtype=bool)

    def direct(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All postings of some documents, and which document each is of."""
        size = self.bounds[docs + 1] - self.bounds[docs]
        of = np.repeat(np.arange(len(docs)), size)
        return np.repeat(self.bounds[docs] - (np.cumsum(size) - size), size) + np.arange(len(of)), of


def best_positions(lists: _Lists, terms: np.ndarray, local: np.ndarray, keep, stats: list[int] | None = None) -> None:
    """Offer ``keep(docs, scores)`` all documents of a shard that can be among the best of an item.

    Sorted accesses go down all lists alike. A document met for the first time is looked up in
    all lists, which marks its positions there as seen. The best position of a list is the end
    of its unbroken run of seen positions: a document not yet met stands behind it in each
    list, so its score is at most the sum of the impacts there. The search ends when that is
    strictly below the lowest score that ``keep`` holds (it returns -1 while it is not full).
    ``local`` is scratch space of the size of the vocabulary, holding -1 throughout.
    """
    start, length = lists.start[terms], lists.start[terms + 1] - lists.start[terms]
    local[terms] = np.arange(len(terms))
    # Positions of all lists, one stop after each that is never seen.
    base = np.cumsum(length + 1) - (length + 1)
    marks = np.zeros(int((length + 1).sum()), dtype=bool)
    met: list[np.ndarray] = []
    depth, step, best = 0, FIRST_STEP, np.zeros(len(terms), np.int64)
    while np.any(best < length):
        # What is read by sorted access: the next positions of each list that are not seen yet.
        end = np.minimum(length, depth + step)
        size = np.maximum(end - depth, 0)
        at = np.repeat(start + depth - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        docs = lists.doc[at]
        docs = np.unique(docs[~lists.seen[docs]])
        lists.seen[docs] = True
        met.append(docs)
        places, of = lists.direct(docs)
        which = local[lists.by_doc_term[places]]
        inside = which >= 0
        places, of, which = places[inside], of[inside], which[inside]
        marks[base[which] + lists.place[places]] = True
        scores = np.zeros(len(docs), np.int64)
        np.add.at(scores, of, lists.by_doc_impact[places])
        floor = keep(docs, scores)
        unseen = np.flatnonzero(~marks)
        best = unseen[np.searchsorted(unseen, base)] - base
        open_lists = best < length
        bound = int(lists.impact[(start + np.maximum(best, 1) - 1)[open_lists]].sum())
        depth, step = depth + step, step * 2
        if floor > bound:
            break
    local[terms] = -1
    if met:
        all_met = np.concatenate(met)
        lists.seen[all_met] = False
        if stats is not None:
            stats.append(len(all_met))


class _Best:
    """The k best documents of an item so far: by score, then doc_id (nulls last), then row."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((4, 0), np.int64)

    def offer(self, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, row: np.ndarray) -> int:
        floor = self.rows[0, -1] if self.rows.shape[1] == self.k else 1
        good = score >= floor
        if good.any():
            rows = np.concatenate([self.rows, np.stack([score[good], no_id[good], ids[good], row[good]])], axis=1)
            self.rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], -rows[0]))[: self.k]]
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else -1


def _answer(found: DataFrame, items: list[np.ndarray], w: np.ndarray, docs: int, words: int, k: int, shard: int) -> DataFrame:
    sent = found.sparkSession.sparkContext.broadcast((items, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = sent.value
        best = [_Best(k) for _ in items]
        held: list[pa.RecordBatch] = []

        def search() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            term = np.frombuffer(b"".join(table["terms"].to_pylist()), np.int32).astype(np.int64)
            tf = np.frombuffer(b"".join(table["tfs"].to_pylist()), np.int32).astype(np.int64)
            size = table["terms"].combine_chunks()
            bounds = np.concatenate([[0], np.cumsum(np.array(pa.compute.binary_length(size)).astype(np.int64) // 4)])
            row, ids = table["_row"].to_numpy(), pa.compute.fill_null(table["doc_id"], 0).to_numpy()
            no_id = pa.compute.is_null(table["doc_id"]).to_numpy().astype(np.int64)
            lists, local = _Lists(table["n"].to_numpy(), bounds, term, tf, w, docs, words), np.full(len(w), -1)
            for one, terms in zip(best, items):
                best_positions(lists, terms, local, lambda at, score: one.offer(score, no_id[at], ids[at], row[at]))

        load = 0
        for batch in batches:
            held.append(batch)
            load += batch["terms"].nbytes // 4
            if load > shard:
                search()
                load = 0
        if held:
            search()
        item = np.repeat(np.arange(len(best)), [b.rows.shape[1] for b in best])
        rows = np.concatenate([b.rows for b in best], axis=1) if best else np.zeros((4, 0), np.int64)
        ids = pa.array(rows[2], mask=rows[1].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rows[3]), ids, pa.array(rows[0])], ["_item", "_row", "doc_id", "score"])

    return found.mapInArrow(run, "_item long, _row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_bytes: int = BLOCK_BYTES, shard: int = SHARD) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of each item.

    Each task holds the impact lists of its documents, finds the best of each item there by
    best positions, carrying them from shard to shard, and sends no more than ``k`` an item;
    these meet by item. Nothing is hot: lists are as long as a shard, whatever a word's
    frequency. Only the query terms of a block of items are broadcast.

    A null or empty text has no terms and is neither counted nor found; an item without terms,
    or whose terms occur nowhere, gets no rows. Repeated items are each answered, repeated
    documents each found. Equal scores go by doc_id (an integer; nulls last), then by row.
    A document of any length is one row of its task. Empty tables give no rows; other columns
    are not looked at.
    """
    spark = docs.sparkSession
    asked = written(numbered(items, "item_id", "text", name="_i"), "search-items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    out: DataFrame | None = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == b).orderBy("_i").collect()
        vocabulary: dict[bytes, int] = {}
        terms = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of((r["text"] or "").encode())}), dtype=np.int64) for r in rows]
        if not vocabulary:
            continue
        found = written(postings(docs, vocabulary), "search-postings")
        w, n, words = weights(found, len(vocabulary))
        if not n:
            break
        best = _answer(found, terms, w, n, words, k, shard)
        order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_row")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = asked.where(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == b).select("_i", "item_id")
        key = spark.createDataFrame([(i, r["_i"]) for i, r in enumerate(rows)], "_item long, _i long")
        best = best.join(key, "_item").join(names, "_i").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionAll(best)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out

"""Alignment of two tokenizers: inverted bitmaps of the documents that link a pair of ids."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import numbered, pieces
from gridloom.session import written

# Rows of a bitmap container; up to DENSE documents it is a list of 16-bit places, beyond it bits.
SPAN, DENSE = 1 << 16, 4096
# A pair of ids is written as ``a << SHIFT | b``.
SHIFT = 24
# Links that a task gathers before it writes their containers; chunks of text whose tokens it
# remembers; characters of a text that are looked at together; bytes of texts handled at once.
GATHER, REMEMBER, WINDOW, TOGETHER = 1_000_000, 150_000, 1 << 20, 1 << 19
# What a Python worker has loaded and learnt stays for its next tasks.
_LOADED: dict[tuple[bytes, bytes], "_Chunks"] = {}
# Where a single space stands between two characters that are no white space, both tokenizers
# begin a new token with the space, whatever lies around it: neither has a token with a space
# after another character. So a text is the sequence of its chunks, and equal chunks have equal
# tokens.
_SEAM = re.compile(r"(?<=\S) (?=\S)")


def _byte_values() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class _Pair:
    """Both tokenizers, from the contents of their files, and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        # A task has one core; threads of the tokenizer would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b)
        values, extra = _byte_values(), {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        names = self.a.get_vocab(with_added_tokens=False)
        size = max([*names.values(), *extra]) + 1
        self.a_bytes = [b""] * size
        for name, i in names.items():
            self.a_bytes[i] = bytes(values[c] for c in name)
        for i, content in extra.items():
            self.a_bytes[i] = content
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # Ids as text with what follows them inside a group and at its end.
        self.a_text, self.b_text = (np.array([f"{i}{c}" for c in ends for i in range(n)], dtype=object).reshape(2, n) for n, ends in ((size, ",|"), (len(self.b_bytes), ",;")))

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)
        return [x.ids for x in a], self.b.encode(chunks, num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(bounds[-1])), bounds


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Chunks(dict):
    """Numbers of chunks, and per number: counts, groups as text, and links as pair codes.

    Chunks with other bytes than their text are not ok and have none of these.
    """

    def __init__(self, pair: _Pair):
        super().__init__()
        self.pair, self.new = pair, []
        none = np.zeros(0, np.int64)
        self.ok, self.n_a, self.n_b, self.n_groups, self.codes, self.sizes = np.zeros(0, bool), none, none, none, none, none
        self.starts, self.used, self.text = none, none, []

    def use(self, numbers: np.ndarray) -> None:
        self.used[: len(self)] += np.bincount(numbers, minlength=len(self))

    def forget(self, keep: int) -> None:
        """Go on with the most used chunks only; numbers change."""
        best = np.sort(np.argsort(-self.used, kind="stable")[:keep])
        names = list(self)
        self.codes = self.codes[_spread(self.starts[best], self.sizes[best])]
        for name in ("ok", "n_a", "n_b", "n_groups", "sizes"):
            setattr(self, name, getattr(self, name)[best])
        self.used = self.used[best] // 2
        self.text = [self.text[i] for i in best.tolist()]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.clear()
        self.update((names[i], n) for n, i in enumerate(best.tolist()))

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n

    def learn(self) -> None:
        """Encode and align the chunks met since the last call, all at once."""
        if not self.new:
            return
        chunks, self.new = self.new, []
        a_lists, b_lists = self.pair.encode(chunks)
        (a, a_of), (b, b_of) = _flat(a_lists), _flat(b_lists)
        raw = [b" " + c.encode() for c in chunks]
        ok = self._returns(raw, a, a_of, self.pair.a_size, self.pair.a_bytes) & self._returns(raw, b, b_of, self.pair.b_size, self.pair.b_bytes)
        # Bad chunks take no part: their tokens go, so that ends of the others are places in one text.
        a, b = a[np.repeat(ok, np.diff(a_of))], b[np.repeat(ok, np.diff(b_of))]
        n_a, n_b = np.where(ok, np.diff(a_of), 0), np.where(ok, np.diff(b_of), 0)
        a_end, b_end = np.cumsum(self.pair.a_size[a]), np.cumsum(self.pair.b_size[b])
        if len(a):
            shared = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end]
        else:
            shared = a_end
        chunk_end = np.cumsum(np.where(ok, [len(r) for r in raw], 0))
        group_of = np.searchsorted(chunk_end, shared, side="left")
        n_groups = np.bincount(group_of, minlength=len(chunks))
        # The B tokens that overlap an A token: those that end after its start and start before its end.
        low = np.searchsorted(b_end, a_end - self.pair.a_size[a], side="right")
        high = np.searchsorted(b_end - self.pair.b_size[b], a_end, side="left")
        codes = np.repeat(a << SHIFT, high - low) | b[_spread(low, high - low)]
        of = np.repeat(np.repeat(np.arange(len(chunks)), n_a), high - low)
        more = {"ok": ok, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "codes": codes, "sizes": np.bincount(of, minlength=len(chunks))}
        for name, values in more.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int64)])
        # Ids in the order in which they are told: of each group those of A, then those of B.
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        a_before, b_before = np.searchsorted(a_group, np.arange(len(shared) + 1)), np.searchsorted(b_group, np.arange(len(shared) + 1))
        a_last, b_last = (shared[a_group] == a_end).astype(np.int64), (shared[b_group] == b_end).astype(np.int64)
        told = np.empty(len(a) + len(b), dtype=object)
        told[np.arange(len(a)) + b_before[a_group]] = self.pair.a_text[a_last, a]
        told[np.arange(len(b)) + a_before[b_group + 1]] = self.pair.b_text[b_last, b]
        # The last separator of a chunk falls away.
        stops = np.cumsum(n_a + n_b).tolist()
        told = told.tolist()
        self.text += ["".join(told[x:y])[:-1] for x, y in zip([0, *stops], stops)]

    @staticmethod
    def _returns(raw: list[bytes], ids: np.ndarray, bounds: np.ndarray, size: np.ndarray, names: list[bytes]) -> np.ndarray:
        """Which chunks the bytes of their tokens give back."""
        joined = b"".join(map(names.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(size[ids])])[bounds]
        if np.array_equal(np.diff(ends), [len(r) for r in raw]) and joined == b"".join(raw):
            return np.ones(len(raw), dtype=bool)
        return np.array([joined[x:y] == r for x, y, r in zip(ends[:-1].tolist(), ends[1:].tolist(), raw)], dtype=bool)


def _chunk_numbers(text: str, chunks: _Chunks) -> np.ndarray:
    """Numbers of a text's chunks; a long text is split in windows that end at seams."""
    found, start = [], 0
    while start <= len(text) and text:
        seam = _SEAM.search(text, start + WINDOW) if len(text) - start > WINDOW else None
        end = seam.start() if seam else len(text)
        parts = _SEAM.split(text[start:end])
        found.append(np.fromiter(map(chunks.__getitem__, parts), dtype=np.int64, count=len(parts)))
        start = end + 1
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _containers(codes: np.ndarray, places: np.ndarray, planes: np.ndarray) -> Iterator[dict]:
    """Containers, as columns, of distinct (code, plane, place in a span), sorted in this order."""
    if not len(codes):
        return
    cut = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (planes[1:] != planes[:-1])]))
    card = np.diff(np.concatenate([cut, [len(codes)]]))
    place = places.astype("<u2")
    for dense in (False, True):
        mine = (card > DENSE) == dense
        if not mine.any():
            continue
        at, n = cut[mine], card[mine]
        if dense:
            sets = [np.zeros(SPAN, dtype=bool) for _ in at]
            for bits, a, c in zip(sets, at, n):
                bits[place[a : a + c]] = True
            body = pa.array([np.packbits(bits, bitorder="little").tobytes() for bits in sets], pa.binary())
        else:
            data = place[_spread(at, n)].tobytes()
            body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], 2 * np.cumsum(n)]).astype(np.int32)), pa.py_buffer(data)])
        yield {"code": codes[at], "plane": planes[at].astype(np.int32), "card": n.astype(np.int32), "dense": np.full(len(at), dense), "bits": body}


def _members(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The places in all containers of a table, and which container each is of."""
    dense, card = batch["dense"].to_numpy(), batch["card"].to_numpy().astype(np.int64)
    bits = batch["bits"]
    places = np.zeros(int(card.sum()), dtype=np.int64)
    of = np.repeat(np.arange(len(card)), card)
    if not dense.all():
        sparse = np.frombuffer(b"".join(bits.filter(pa.array(~dense)).to_pylist()), "<u2")
        places[~dense[of]] = sparse
    ends = np.cumsum(card)
    for i in np.flatnonzero(dense):
        found = np.flatnonzero(np.unpackbits(np.frombuffer(bits[i].as_py(), np.uint8), bitorder="little"))
        places[ends[i] - card[i] : ends[i]] = found
    return places, of


def _slices(batch: pa.RecordBatch, members: int = 200_000) -> Iterator[pa.RecordBatch]:
    """A batch of containers in slices of about so many members."""
    ends = np.cumsum(batch["card"].to_numpy().astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + members, "right")))
        yield batch.slice(start, stop - start)
        start = stop


POSTING = "code long, span long, plane int, card int, dense boolean, bits binary"
DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def links(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """Documents and the containers of their linked pairs, as two kinds of rows of one table.

    Rows with a ``code`` are containers: the rows of a span of ``SPAN`` numbers whose count of
    links of that pair has the bit ``plane``. The others are documents: counts and the digest
    of their groups. A pair's links in a document are counted before anything is stored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((a, b))
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [f.split() for f in f"{DOCUMENT}, {POSTING}".split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}

    def rows(n: int, id_type: pa.DataType, columns: dict) -> pa.RecordBatch:
        types = {"_row": pa.int64(), "doc_id": id_type, **{name: kinds[kind] for name, kind in fields}}
        made = {name: pa.nulls(n, t) if columns.get(name) is None else columns[name] if isinstance(columns[name], pa.Array) else pa.array(columns[name], t) for name, t in types.items()}
        return pa.RecordBatch.from_arrays(list(made.values()), list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = sent.value
        if files not in _LOADED:
            _LOADED.clear()
            _LOADED[files] = _Chunks(_Pair(*files))
        chunks = _LOADED[files]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        load, span = 0, -1

        def flush(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal load
            code, place, times = (np.concatenate(x) for x in zip(*held))
            held.clear()
            load = 0
            order = np.argsort((code << 16) | place)
            code, place, times = code[order], place[order], times[order]
            for plane in range(int(times.max()).bit_length()):
                here = (times >> plane) & 1 == 1
                for c in _containers(code[here], place[here], np.full(int(here.sum()), plane)):
                    for at in range(0, len(c["card"]), 100_000):
                        part = {k: v[at : at + 100_000] for k, v in c.items()}
                        yield rows(len(part["card"]), id_type, {**part, "span": np.full(len(part["card"]), span)})

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            # At most 2 ** 14 documents at once, whose numbers stand above the pair codes below.
            for piece in (p for at in range(0, batch.num_rows, 1 << 14) for p in pieces(batch.slice(at, 1 << 14), "_t", TOGETHER)):
                row = piece["_row"].to_numpy()
                if len(chunks) > REMEMBER:
                    chunks.forget(REMEMBER // 2)
                numbers = [_chunk_numbers(text or "", chunks) for text in piece["_t"].to_pylist()]
                chunks.learn()
                # A text with a chunk that does not come back has no tokens at all.
                numbers = [x if chunks.ok[x].all() else x[:0] for x in numbers]
                n, flat = np.array([len(x) for x in numbers]), np.concatenate(numbers)
                chunks.use(flat)
                of = np.repeat(np.arange(len(n)), n)
                total = lambda name: np.bincount(of, getattr(chunks, name)[flat], len(n)).astype(np.int64)
                counts = {"n_a": total("n_a"), "n_b": total("n_b"), "n_groups": total("n_groups"), "n_links": total("sizes")}
                digests = [hashlib.sha256(";".join(map(chunks.text.__getitem__, x.tolist())).encode()).hexdigest() if len(x) else "" for x in numbers]
                size = chunks.sizes[flat]
                code = chunks.codes[_spread(chunks.starts[flat], size)]
                # How often a document links a pair; documents of a piece are few, so both fit into one number.
                key, times = np.unique((np.repeat(of, size) << (2 * SHIFT)) | code, return_counts=True)
                of, code = key >> (2 * SHIFT), key & ((1 << (2 * SHIFT)) - 1)
                for number in np.unique(row // SPAN).tolist():
                    if number != span or load > GATHER:
                        if held:
                            yield from flush(id_type)
                        span = number
                    here = row[of] // SPAN == number
                    held.append((code[here], (row[of[here]] % SPAN).astype(np.uint16), times[here].astype(np.int32)))
                    load += int(here.sum())
                yield rows(piece.num_rows, id_type, {"_row": row, "doc_id": piece["doc_id"], **counts, "groups_sha256": digests})
        if held:
            yield from flush(id_type)

    texts = numbered(docs, "doc_id", F.col("text").alias("_t"))
    return texts.mapInArrow(run, f"_row long, doc_id {id_kind}, {DOCUMENT}, {POSTING}")


def merged_bitmaps(postings: DataFrame) -> DataFrame:
    """Containers of the same pair, plane and span ORed, with their counts.

    ``card`` is the popcount of a plane. ``fresh`` counts the documents of a plane that no
    lower plane of the pair and span has, so that its sum is the popcount of the OR of planes:
    the documents that hold the pair. ``sum(card << plane)`` is its number of links. The work
    meets by pair and span, so a pair that all documents have is spread over their spans.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
            code, span, plane = (part[c].to_numpy() for c in ("code", "span", "plane"))
            start = np.concatenate([[True], (code[1:] != code[:-1]) | (span[1:] != span[:-1])])
            group = np.cumsum(start) - 1
            where, of = _members(part)
            # Distinct (group, plane, place): the OR of containers.
            key = (group[of] << 32) | (plane[of].astype(np.int64) << 16) | where
            key = np.unique(key)
            g, p, at = key >> 32, (key >> 16) & 0xFFFF, key & 0xFFFF
            _, first = np.unique((g << 16) | at, return_index=True)
            seen = np.zeros(len(key), dtype=np.int64)
            seen[first] = 1
            lead = np.flatnonzero(start)
            whole = (g << 16) | p
            cut = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
            total = np.add.reduceat(seen, cut)
            for c in _containers(g, at, p):
                fresh = total[np.searchsorted(whole[cut], (c["code"] << 16) | c["plane"])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[lead[c["code"]]]), pa.array(span[lead[c["code"]]]), pa.array(c["plane"]), pa.array(c["card"]), pa.array(c["dense"]), c["bits"], pa.array(fresh)],
                    ["code", "span", "plane", "card", "dense", "bits", "fresh"],
                )

        for batch in batches:
            for piece in _slices(batch):
                part = pa.Table.from_batches([piece])
                part = part if held is None else pa.concat_tables([held, part])
                code, span = part["code"].to_numpy(), part["span"].to_numpy()
                # The last pair and span may go on in the next piece.
                last = int(np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (span[1:] != span[:-1])]))[-1])
                if last:
                    yield from done(part.slice(0, last).combine_chunks())
                held = part.slice(last)
        if held is not None:
            yield from done(held.combine_chunks())

    return postings.repartition("code", "span").sortWithinPartitions("code", "span", "plane").mapInArrow(merge, f"{POSTING}, fresh long")


def pair_counts(merged: DataFrame) -> DataFrame:
    """``(code, a, b, n_docs, n_links, best)``: pairs with their counts; best marks those no other pair of their A id exceeds."""
    counts = merged.groupBy("code").agg(F.sum("fresh").alias("n_docs"), F.sum(F.expr("shiftleft(cast(card as bigint), plane)")).alias("n_links"))
    counts = counts.select("code", F.shiftright("code", SHIFT).cast("int").alias("a"), F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int").alias("b"), "n_docs", "n_links")
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def posting_scores(merged: DataFrame, counts: DataFrame) -> DataFrame:
    """``(_row, n_best, count_sum)``: what the postings of all pairs return to their documents.

    Containers meet by span of rows, and a task adds up one span at a time.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, best, total = None, None, None

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(span * SPAN + at), pa.array(best[at]), pa.array(total[at])], ["_row", "n_best", "count_sum"])

        for piece in (p for batch in batches for p in _slices(batch)):
            table = pa.Table.from_batches([piece])
            spans = table["span"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(spans[1:] != spans[:-1]) + 1, [len(spans)]])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if x == y:
                    continue
                if span != int(spans[x]):
                    if span is not None:
                        yield out()
                    span, best, total = int(spans[x]), np.zeros(SPAN, np.int64), np.zeros(SPAN, np.int64)
                part = table.slice(x, y - x).combine_chunks()
                where, of = _members(part)
                worth = np.int64(1) << part["plane"].to_numpy().astype(np.int64)
                np.add.at(total, where, (worth * part["n_docs"].to_numpy())[of])
                np.add.at(best, where, (worth * part["best"].to_numpy())[of])
        if span is not None:
            yield out()

    scored = merged.drop("fresh").join(counts.select("code", "n_docs", F.col("best").cast("long").alias("best")), "code").drop("code")
    return scored.repartition("span").sortWithinPartitions("span").mapInArrow(score, "_row long, n_best long, count_sum long")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files lie; any other path can be given to ``align`` instead."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with the scores of their links, and the pairs of ids with their counts.

    ``a_path`` is a byte-level BPE file of ``tokenizers``, ``b_path`` a ``sentencepiece`` model with
    byte fallback; the driver reads them and sends their contents (a few MB) to the tasks.
    Documents come as (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), pairs
    as in ``pair_counts``.

    A null or empty text, and one whose tokens do not give back its bytes, has no tokens: zeros
    and an empty digest. Repeated rows and ids, and null ids, stay apart and count as documents
    of their own. A text of any length is tokenized in windows. Empty tables give empty
    results; other columns are not looked at.
    """
    with open(a_path or tokenizer_path("byte_bpe_50k.json"), "rb") as f, open(b_path or tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        both = written(links(docs, f.read(), g.read()), "alignment")
    merged = written(merged_bitmaps(both.where("code is not null").select("code", "span", "plane", "card", "dense", "bits")), "pair-bitmaps")
    counts = written(pair_counts(merged), "pair-counts")
    scores = posting_scores(merged, counts)
    rows = both.where("code is null").join(scores, "_row", "left")
    zero = F.lit(0).cast("long")
    out = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return out, counts

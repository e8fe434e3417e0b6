"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import flat_bytes, mix64, pieces, remainder
from gridloom.session import written

# Frequent words whose exact counts are sent to every task: at most TOP, each up to TOP_BYTES
# long. Counts of all others are joined.
TOP, TOP_BYTES = 200_000, 48
# Filter: bits per training token, whatever their number, in slices for so many tokens each.
# PART slices that follow one another are filled and asked in one place.
BITS_PER_TOKEN, SLICE_TOKENS, PROBES, BLOCK, PART = 5, 500_000, 4, 512, 4
# Bytes of the texts that ask together.
CHUNK_BYTES = 4 << 20
# Weight of the pair estimate against the word estimate.
PAIRS = 0.2
_START, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_PAIR, _LEVEL = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x2545F4914F6CDD1D)


def _tokens(piece: pa.RecordBatch | pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words, the words of all texts as numbers, and words per text."""
    texts = piece["_t"].cast(pa.large_binary())
    data, bounds = flat_bytes(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    cut = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data.tobytes().lower())))
    bounds, coded = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
    flat, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary())
    # What stands before white space at the start of a text, or after that at its end, is no word.
    if (none := pc.index(words, b"").as_py()) >= 0:
        inked = flat != none
        bounds = np.concatenate([[0], np.cumsum(inked)])[bounds]
        flat = flat[inked]
        flat -= flat > none
        words = pa.concat_arrays([words[:none], words[none + 1 :]])
    return words, flat, np.diff(bounds).astype(np.int64)


def _grams(words: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words and, last, the end; which of them each token is, ends included;
    and hashes of the pairs that each token makes with the one before."""
    kinds = np.full(len(words) + 1, _END)
    data, bounds = flat_bytes(words)
    raw, bounds = data.tobytes(), bounds.tolist()
    kinds[:-1] = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(bounds, bounds[1:])), dtype=np.uint64, count=len(words))
    n = lengths + 1
    ends = np.cumsum(n) - 1
    which = np.full(int(n.sum()), len(words), dtype=np.int64)
    inner = np.ones(len(which), dtype=bool)
    inner[ends] = False
    which[inner] = flat
    token = kinds[which]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - lengths] = _START
    return kinds, which, mix64(before * _PAIR + token)


def token_counts(docs: DataFrame) -> DataFrame:
    """``(word, c)`` over the lower-case words of all texts; each task counts its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def counted() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out() -> Iterator[pa.RecordBatch]:
            return iter(held[0].to_batches(500_000))

        for batch in batches:
            for piece in pieces(batch, "_t"):
                words, flat, _ = _tokens(piece)
                held.append(pa.table({"word": words.cast(pa.binary()), "n": np.bincount(flat, minlength=len(words))}))
                if sum(x.num_rows for x in held) > 1_000_000:
                    held = [counted()]
                    if held[0].num_rows > 500_000:
                        yield from out()
                        held = []
        if held:
            held = [counted()]
            yield from out()

    return docs.select(F.col("text").alias("_t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Filter:
    """Layout of the filter: ``slices`` of ``per_slice`` blocks, the levels an n-gram is held at."""

    def __init__(self, tokens: int):
        self.slices = max(16, 2 ** math.ceil(math.log2(max(1, tokens) / SLICE_TOKENS + 1)))
        self.per_slice = max(1, tokens * BITS_PER_TOKEN // BLOCK // self.slices + 1)
        self.slice_bytes = self.per_slice * BLOCK // 8
        self.part = PART

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        """From the high bits: hashes in order are in the order of their slices."""
        return (h >> np.uint64(32)) * np.uint64(self.slices) >> np.uint64(32)

    def places(self, h: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """Bits of an n-gram in its slice: the block from its low bits, the places in it from a remix."""
        base = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(self.per_slice) >> np.uint64(32)) * np.uint64(BLOCK)
        g = mix64(h ^ (np.full(1, level, dtype=np.uint64) * _LEVEL))
        return (base + ((g >> np.uint64(9 * k)) & np.uint64(BLOCK - 1)) for k in range(PROBES))

    def levels(self, h: np.ndarray, bits: np.ndarray, start: np.ndarray | int, least: np.ndarray | None = None) -> np.ndarray:
        """The last level at which all probes hit; ``start`` is where each one's slice begins in ``bits``, in bytes.

        An n-gram is known to be held up to its level in ``least``, and not asked for there.
        """
        level = np.zeros(len(h), dtype=np.int64) if least is None else least.astype(np.int64)
        start = np.broadcast_to(np.asarray(start, dtype=np.int64), len(h))
        known, left = level.copy(), np.flatnonzero(level == 0)
        most = int(known.max(initial=0))
        for q in range(1, 64):
            hit = np.ones(len(left), dtype=bool)
            for at in self.places(h[left], q):
                hit &= (bits[start[left] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
            left = left[hit]
            level[left] = q
            if q <= most:
                left = np.concatenate([left, np.flatnonzero(known == q)])
            elif not len(left):
                break
        return level


def middle(level: np.ndarray) -> np.ndarray:
    """Counts as levels tell them: 0, 1, and the middle of a power of two on."""
    return np.concatenate([[0.0, 1.0], 2.0 ** (np.arange(2, 64) - 0.5)])[level]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order, where each distinct one begins there, and the order."""
    order = np.argsort(h)
    h = h[order]
    return h, np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64), order


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _packed(h: np.ndarray) -> bytes:
    """Hashes in order by their steps, the lowest bytes of all first: the highest are mostly 0 and compress."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


ASKED = "part int, _chunk long, hashes binary, counts binary, large binary"
LEVELS = "_chunk long, part int, levels binary"


def _ask(layout: Filter, texts: pa.Table) -> pa.Table:
    """The distinct n-grams of a chunk of texts with their counts in those that train, by part of the filter.

    A count is a byte; counts from 255 on are in ``large``.
    """
    words, flat, lengths = _tokens(texts)
    kinds, which, pair = _grams(words, flat, lengths)
    train = np.repeat(texts["_train"].to_numpy(), lengths + 1)
    h, first, order = _distinct(np.concatenate([mix64(kinds), pair]))
    counts = np.add.reduceat(np.concatenate([np.bincount(which[train], minlength=len(kinds)), train])[order], first)
    h = h[first]
    of = layout.slice_of(h).astype(np.int64) // layout.part
    small, asked = np.minimum(counts, 255).astype(np.uint8), []
    for a, b in _runs(of):
        large = counts[a:b][small[a:b] == 255].astype("<u4")
        asked.append((of[a], _packed(h[a:b]), small[a:b].tobytes(), large.tobytes()))
    part, hashes, few, many = zip(*asked)
    chunk = texts["_chunk"][0].as_py()
    return pa.table({"part": pa.array(part, pa.int32()), "_chunk": pa.array([chunk] * len(part), pa.int64()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(few, pa.binary()), "large": pa.array(many, pa.binary())})


def _answer(layout: Filter, asked: pa.Table) -> pa.Table:
    """Fill a part of the filter from the counts of all chunks; the levels it has for what each chunk asked."""
    rows = [_unpacked(x.as_buffer()) for x in asked["hashes"]]
    cuts = np.cumsum([0, *map(len, rows)])
    small = np.frombuffer(b"".join(asked["counts"].to_pylist()), np.uint8)
    count = small.astype(np.uint32)
    count[small == 255] = np.frombuffer(b"".join(asked["large"].to_pylist()), "<u4")
    rows = np.concatenate(rows)
    h, first, order = _distinct(rows)
    total = np.minimum(np.add.reduceat(count[order], first, dtype=np.int64), 2**32 - 1)
    found, times, h = np.empty(len(h), np.uint8), np.diff(first, append=len(h)), h[first]
    del rows, small, count, first
    level = np.where(total > 0, np.frexp(total.astype(np.float64))[1], 0).astype(np.uint8)
    of = layout.slice_of(h)
    for a, b in _runs(of):
        bits = np.zeros(layout.per_slice * BLOCK, dtype=bool)
        for q in range(1, int(level[a:b].max()) + 1):
            for at in layout.places(h[a:b][level[a:b] >= q], q):
                bits[at.astype(np.int64)] = True
        level[a:b] = layout.levels(h[a:b], np.packbits(bits, bitorder="little"), 0, level[a:b])
    found[order] = np.repeat(level, times)
    return pa.table({"_chunk": asked["_chunk"], "part": asked["part"], "levels": pa.array([found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())})


def filter_levels(texts: DataFrame, layout: Filter) -> DataFrame:
    """``(_chunk, part, levels)``: the filter's levels of the distinct n-grams of each chunk of texts, in order, a byte each.

    ``texts`` has ``_chunk``, ``_t`` and ``_train``. Words and pairs with count c in the texts that train
    are held at the levels 1 to 1 + floor(log2 c). Chunks send their distinct n-grams once, with
    their counts, to the parts of the filter; a part is filled from them, asked for the same
    n-grams, each once, and gone. The number of parts follows the number of training tokens, so what meets
    in one does not grow but by an entry for each chunk that has a frequent n-gram.
    """
    asked = texts.groupBy("_chunk").applyInArrow(lambda t: _ask(layout, t), ASKED)
    return asked.groupBy("part").applyInArrow(lambda t: _answer(layout, t), LEVELS)


def _written_alone(df: DataFrame, label: str) -> DataFrame:
    """As ``written``; what was exchanged for it is removed with it, not when the driver collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, label)
    finally:
        conf.set(key, before)


def score_texts(docs: DataFrame, fold: int = 7, held: int = 2, broadcast: int | None = None) -> DataFrame:
    """One row per document: counts of its tokens, the unigram base and the model's log10 probability.

    Learns from rows whose ``crc32(doc_id) mod fold`` is not ``held``. The base needs exact
    counts: those of the most frequent words are in every task, those of other words are
    joined by word after each text has counted its own. The model is a pair model with
    ``P(w|h) = PAIRS * c(h,w) / c(h) + (1 - PAIRS) * P(w)`` and ``P(w) = (c(w)+1)/(N+V+1)``, all
    counts read from the filter, whose bits grow with the training tokens, so that its error
    rate does not. The filter is in parts at any size, to which chunks of texts send their
    n-grams; ``broadcast`` once set a size up to which it went to every task, and has no effect.

    A null text is empty: one token, the end. A null doc_id counts as the empty id; repeated rows
    score alike; a text of any length is one row of its task; an empty table gives no rows;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    mark = remainder("doc_id", fold)
    training = docs.where(mark != held)
    counts = _written_alone(token_counts(training), "token-counts")
    texts, size = docs.agg(F.count_if(mark != held), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = words + texts, kinds + (1 if texts else 0)
    top_rows = counts.where(F.octet_length("word") <= TOP_BYTES).orderBy(F.desc("c"), "word").limit(TOP).toArrow().combine_chunks()
    top = spark.sparkContext.broadcast((top_rows["word"].combine_chunks().cast(pa.large_binary()), top_rows["c"].to_numpy()))
    del top_rows
    layout = Filter(n)
    total = float(n + v + 1)
    values = middle(np.arange(64))
    by_word = (1 - PAIRS) * (values + 1) / total
    before = np.append(values, float(max(1, texts)))
    by_pair = PAIRS * np.minimum(values[:, None], before) / np.maximum(before, 1.0)

    def score(piece: pa.Table, replies: pa.Table) -> pa.Table:
        words, flat, lengths = _tokens(piece)
        kinds, which, pair = _grams(words, flat, lengths)
        h, first, order = _distinct(np.concatenate([mix64(kinds), pair]))
        found = replies["levels"].to_pylist()
        level = np.empty(len(h), np.uint8)
        level[order] = np.repeat(np.frombuffer(b"".join([found[i] for i in np.argsort(replies["part"].to_numpy())]), np.uint8), np.diff(first, append=len(h)))
        rows, ends = len(lengths), np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        # Levels are few: what an n-gram of each level adds is looked up.
        one, two = level[: len(kinds)][which], level[len(kinds) :]
        before = np.empty_like(one)
        before[1:], before[starts] = one[:-1], 64
        p = by_pair[two, before]
        p += by_word[one]
        score = np.add.reduceat(np.log10(p, out=p), starts)
        del h, first, order, pair, which, p
        known, exact = top.value
        place = pc.index_in(words, value_set=known)
        c = np.append(exact, 0)[pc.fill_null(place, len(exact)).to_numpy()]
        doc = np.repeat(np.arange(rows), lengths)
        here = c[flat] > 0
        base = np.bincount(doc[here], weights=np.log10((c[flat[here]] + 1) / total), minlength=rows) + np.log10((texts + 1) / total)
        seen = np.bincount(doc[here], minlength=rows) + (1 if texts else 0)
        # Words that are not in every task: counted per text, to be joined.
        code, times = np.unique(doc[~here] * max(1, len(words)) + flat[~here], return_counts=True)
        of, word = code // max(1, len(words)), code % max(1, len(words))
        bounds = np.searchsorted(of, np.arange(rows + 1))
        tail = pa.StructArray.from_arrays([words.take(pa.array(word)).cast(pa.binary()), pa.array(times.astype(np.int32))], ["word", "m"])
        rest = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), tail)
        row = (piece["_chunk"][0].as_py() << 32) + np.arange(rows)
        return pa.table(
            [pa.array(row), piece["doc_id"], pa.array(lengths + 1), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(score), rest],
            ["_row", "doc_id", "n_tokens", "n_known", "base", "score", "rest"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"_row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,m:int>>"
    # A chunk is told by what its rows hold, so that it is the same whenever it is made; one exchange serves both who ask and who score.
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(math.ceil(size / CHUNK_BYTES) or 1))
    chunks = docs.select(chunk.alias("_chunk"), "doc_id", F.col("text").alias("_t"), (mark != held).alias("_train")).repartition("_chunk")
    scored = chunks.groupBy("_chunk").cogroup(filter_levels(chunks, layout).groupBy("_chunk")).applyInArrow(score, schema)
    scored = _written_alone(scored, "scored-texts")
    log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(total))
    tail = scored.select("_row", F.explode("rest").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.m").alias("m"))
    tail = tail.join(counts, "word", "left").groupBy("_row").agg(F.sum(F.col("m") * log).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("also"))
    return scored.drop("rest").join(tail, "_row", "left").select(
        "doc_id",
        (mark == held).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )

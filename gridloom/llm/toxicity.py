"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mix64, pieces, remainder

# Bounds of the labelled sample that the model is fitted on: toxic and clean texts, and code
# points of a text that is taken into it.
SAMPLE, SAMPLE_CHARS = (1_300, 3_300), 12_000
FEATURES, THRESHOLD = 1 << 17, 0.3
# Words of a document whose messages are passed in one block.
BLOCK = 64
TOKEN = re.compile(r"[^\W\d_]+")
# A word is taken for toxic if it stands RATIO times as often in toxic texts as in clean ones, and
# not by chance: the expected share of chance finds among such words is FALSE.
RATIO, FALSE = 5.0, 0.01
# Words on either side that tell copies of one passage.
SIDE = 2


def _features(word: str) -> list[int]:
    """Hashed features of a word in lower case: itself, its beginnings, its ending, its length."""
    names = ["w" + word, "s" + word[-3:], "n%d" % min(len(word), 12), *["p" + word[:k] for k in (3, 4, 5, 6)]]
    return [crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


N_FEATURES = 7


@dataclass
class Model:
    weights: np.ndarray  # of features, for toxic against clean
    moves: np.ndarray  # log potentials, from state to state
    begin: float
    calibration: np.ndarray  # bias, and weights of the document aggregates
    prior: float

    def emission(self, word: str) -> float:
        return float(self.weights[_features(word)].sum())


class _Emissions(dict):
    """Emission scores of words as they are written, each worked out once; forgotten when too many are held."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        self[word] = score = self.model.emission(word.lower())
        return score


def _limited(ratio: np.ndarray) -> np.ndarray:
    return np.clip(ratio, 1e-30, 1e30)


def messages(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of words as toxic-to-clean ratios; a document is one chain.

    ``e`` are the words' emission ratios, document after document. A document is laid out in
    blocks of ``block`` places, which are columns. The product of a block's transfer matrices
    says what a message becomes on its way through the block, so messages first step from block
    to block and then, in all blocks at once, from word to word.
    """
    (t00, t01), (t10, t11) = np.exp(moves)
    blocks = -(-lengths // block)
    n = int(blocks.sum())
    opening = np.cumsum(blocks) - blocks
    place = np.arange(len(e)) + np.repeat(opening * block - (np.cumsum(lengths) - lengths), lengths)
    grid, real = np.ones(n * block), np.zeros(n * block, dtype=bool)
    grid[place], real[place] = e, True
    grid, real = grid.reshape(n, block).T.copy(), real.reshape(n, block).T.copy()
    opens = np.zeros(n, dtype=bool)
    opens[opening[lengths > 0]] = True
    a_in, b_out = np.full(n, np.exp(begin)), np.ones(n)
    if (blocks > 1).any():
        p = np.where(opens, [[np.ones(n), np.zeros(n)], [np.zeros(n), grid[0]]], [[np.full(n, t00), t01 * grid[0]], [np.full(n, t10), t11 * grid[0]]])
        for k in range(1, block):
            step = np.stack([p[:, 0] * t00 + p[:, 1] * t10, (p[:, 0] * t01 + p[:, 1] * t11) * grid[k]], axis=1)
            p = np.where(real[k], step, p)
            p /= p.max(axis=(0, 1))
        order = np.argsort(-blocks, kind="stable")
        active = [opening[order[:count]] + j for j in range(int(blocks.max())) if (count := np.searchsorted(-blocks[order], -j))]
        a = np.full(len(blocks), np.exp(begin))
        for at in active:
            a = a[: len(at)]
            a_in[at] = a
            a = _limited((p[0, 1, at] + a * p[1, 1, at]) / (p[0, 0, at] + a * p[1, 0, at]))
        b = np.ones(0)
        for at in reversed(active):
            b = np.concatenate([b, np.ones(len(at) - len(b))])
            b_out[at] = b
            b = _limited((p[1, 0, at] + p[1, 1, at] * b) / (p[0, 0, at] + p[0, 1, at] * b))
    a, b = np.empty_like(grid), np.ones_like(grid)
    a[0] = np.where(opens, grid[0] * a_in, _limited(grid[0] * (t01 + a_in * t11) / (t00 + a_in * t10)))
    for k in range(1, block):
        a[k] = _limited(grid[k] * (t01 + a[k - 1] * t11) / (t00 + a[k - 1] * t10))
    b[block - 1] = b_out
    for k in range(block - 2, -1, -1):
        x = grid[k + 1] * b[k + 1]
        b[k] = np.where(real[k + 1], _limited((t10 + t11 * x) / (t00 + t01 * x)), 1.0)
    return a.T.reshape(-1)[place], b.T.reshape(-1)[place]


def marginals(model: Model, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of being toxic, per word, by forward-backward over each whole document."""
    if not len(emissions):
        return np.zeros(0)
    a, b = messages(np.exp(np.clip(emissions, -30, 30)), lengths, model.moves, model.begin)
    return a * b / (1 + a * b)


def aggregates(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: log odds of its likeliest word, and how many toxic words are expected."""
    out = np.zeros((len(lengths), 2))
    out[:, 0] = -8.0
    full = lengths > 0
    if full.any():
        at = (np.cumsum(lengths) - lengths)[full]
        top = np.clip(np.maximum.reduceat(p, at), 3.4e-4, 1 - 3.4e-4)
        out[full, 0] = np.log(top / (1 - top))
        out[full, 1] = np.log1p(np.add.reduceat(p, at))
    return out


def _tail(x: int, n: int, p: float) -> float:
    """Probability of at least ``x`` of ``n`` independent draws, each with probability ``p``."""
    k = np.arange(x, n + 1)
    ways = np.cumsum(np.log(np.concatenate([[1.0], (n - k[:-1]) / (k[:-1] + 1.0)])))
    first = lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1)
    return float(min(1.0, np.exp(first + ways + k * np.log(p) + (n - k) * np.log1p(-p)).sum()))


def _marked(x: np.ndarray, y: np.ndarray, p: float) -> np.ndarray:
    """Which keys, with ``x`` finds in toxic and ``y`` in clean documents, mark toxic text.

    Each is tested on its own counts by the exact binomial tail, against ``p``, the share of all
    tokens that stand in toxic documents, so long documents do not count as suspicious. The tests
    are taken together by the Benjamini-Hochberg step at FALSE, among the keys with finds
    enough to reach it at all (Tarone). The share of all toxic documents that has a key does
    not enter.
    """
    n = x + y
    totals = np.bincount(n)
    least, m = 1, int(totals[1:].sum())
    while m and p**least * m > FALSE:
        m -= int(totals[least])
        least += 1
    pairs, of, times = np.unique(np.stack([x, n]), axis=1, return_inverse=True, return_counts=True)
    tails = np.array([_tail(a, b, p) if b >= least and a > b * p else 1.0 for a, b in pairs.T.tolist()])
    order = np.argsort(tails)
    fine = np.flatnonzero(tails[order] * m <= FALSE * np.cumsum(times[order]))
    limit = tails[order[fine[-1]]] if m and len(fine) else -1.0
    return (tails <= limit)[of.reshape(-1)] & ((x + 0.5) * (1 - p) >= RATIO * (y + 0.5) * p)


def _token_labels(flat: np.ndarray, words: list[str], lengths: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of tokens, numbers into ``words``, from labels of documents.

    A word, or a beginning of four to six letters, marks a token of a toxic document by
    ``_marked``. A find counts once for each document, and once for all documents that have it
    between the same words, for copies of one passage are no new evidence; words so common
    that they meet by chance do not make a copy.
    """
    doc = np.repeat(np.arange(len(lengths)), lengths)
    around, chance = np.zeros(len(flat), dtype=np.uint64), np.zeros(len(flat))
    share = np.log(np.bincount(flat, minlength=len(words)) / max(1, len(flat)) + 1e-300)
    for k in range(-SIDE, SIDE + 1):
        at = np.arange(len(flat)) + k
        inside = (at >= 0) & (at < len(flat))
        inside[inside] = doc[at[inside]] == doc[inside]
        around = mix64(around + np.where(inside, flat[np.where(inside, at, 0)] + 1, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if k:
            chance[inside] += share[flat[at[inside]]]
    around = np.where(chance < np.log(0.01 / max(1, len(flat))), around >> np.uint64(1), doc.astype(np.uint64) | np.uint64(1 << 63))
    keys: dict[str, int] = {}
    of_word = np.array([[keys.setdefault(k, len(keys)) if k else -1 for k in (w, *(w[:j] + "*" if len(w) > j else "" for j in (4, 5, 6)))] for w in words])
    x, y = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    for kind in of_word.T:
        key = kind[flat]
        own = np.flatnonzero(key >= 0)
        order = own[np.lexsort((around[own], key[own], doc[own]))]
        key, place = key[order], around[order]
        # The smallest hash stands for the document, in all copies the same.
        first = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(doc[order]) != 0)])) if len(order) else order
        key, place, bad = key[first], place[first], toxic[doc[order[first]]]
        for counts, side in ((x, bad), (y, ~bad)):
            k, at = key[side], place[side]
            order2 = np.lexsort((at, k))
            k, at = k[order2], at[order2]
            fresh = np.ones(len(k), dtype=bool)
            fresh[1:] = (k[1:] != k[:-1]) | (at[1:] != at[:-1])
            counts += np.bincount(k[fresh], minlength=len(keys))
    # The last place stands for keys that a word does not have.
    hot = np.append(_marked(x, y, lengths[toxic].sum() / lengths.sum()), False)
    return (hot[of_word].any(axis=1)[flat] & toxic[doc]).astype(np.float64)


def fit(texts: list[str], toxic: np.ndarray, prior: float, epochs: int = 5, parts: int = 10, rate: float = 0.1) -> Model:
    """Fit the field by Adam on the conditional likelihood, then the document calibration."""
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)), -2.0, np.array([-20.0, 0.0, 0.0]), prior)
    words = [[w.lower() for w in TOKEN.findall(t or "")] for t in texts]
    lengths = np.array([len(w) for w in words])
    if not toxic.any() or toxic.all() or not lengths.sum():
        model.calibration[0] = 20.0 if len(toxic) and toxic.all() else -20.0
        return model
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for doc in words for w in doc])
    features = np.array([_features(w) for w in ids])
    labels = _token_labels(flat, list(ids), lengths, toxic)
    starts = np.cumsum(lengths) - lengths
    rng = np.random.default_rng(7)
    shape = (FEATURES,), (2, 2), ()
    m, v = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]
    step = 0
    for _ in range(epochs):
        for docs in np.array_split(rng.permutation(len(words)), parts):
            docs = docs[lengths[docs] > 0]
            if not len(docs):
                continue
            at = np.concatenate([np.arange(starts[d], starts[d] + lengths[d]) for d in docs])
            own, y = flat[at], labels[at]
            used, back = np.unique(own, return_inverse=True)
            ex = np.exp(np.clip(model.weights[features[used]].sum(axis=1)[back], -30, 30))
            a, b = messages(ex, lengths[docs], model.moves, model.begin)
            error = a * b / (1 + a * b) - y
            n = len(at)
            per_word = np.bincount(back, weights=error, minlength=len(used))
            grad = np.bincount(features[used].reshape(-1), weights=np.repeat(per_word, N_FEATURES), minlength=FEATURES)
            ends = np.cumsum(lengths[docs])
            pair = np.ones(n, dtype=bool)
            pair[ends - 1] = False
            pair = np.flatnonzero(pair)
            left, right = np.stack([np.ones(len(pair)), a[pair]]), np.stack([np.ones(len(pair)), ex[pair + 1] * b[pair + 1]])
            cell = left[:, None] * np.exp(model.moves)[:, :, None] * right[None]
            joint = (cell / cell.sum(axis=(0, 1))).sum(axis=2)
            y0, y1 = y[pair], y[pair + 1]
            found = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
            grads = [grad / n * 100 + 1e-5 * model.weights, (joint - found) / n, np.array(error[ends - lengths[docs]].sum() / len(docs))]
            step += 1
            params = [model.weights, model.moves, np.array(model.begin)]
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            model.weights, model.moves, model.begin = params[0], np.clip(params[1], -6, 6), float(np.clip(params[2], -8, 2))
    emission = (model.weights[features].sum(axis=1))[flat]
    x = np.column_stack([np.ones(len(words)), aggregates(marginals(model, emission, lengths), lengths)])
    weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - toxic)) + 0.1 * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(3)
        beta = beta - np.linalg.solve(curve, slope)
    model.calibration = beta
    return model


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on the texts of at most ``sample`` ids, toxic and clean, the first in the order of a hash.

    Rows whose ``crc32(doc_id) mod 4`` is 2 are never looked at. The share of toxic rows comes
    from all labelled rows outside them.
    """
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(remainder("doc_id", 4) != 2)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy(F.col("_toxic") > 0).count().collect()}
    picked = [
        usable.where(label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for label, most in zip((F.col("_toxic") > 0, F.col("_toxic") <= 0), sample)
    ]
    # At most the sum of ``sample`` ids, which bounds what is broadcast.
    picked = F.broadcast(picked[0].union(picked[1]))
    joined = docs.select("doc_id", "text").join(picked, "doc_id").where(F.length("text").between(1, sample_chars))
    rows = {(r[0], r[1]) for r in joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic")).select("text", "_toxic").toLocalIterator()}
    rows = sorted(rows)
    prior = counts.get(True, 0) / max(1, sum(counts.values()))
    return fit([r[0] for r in rows], np.array([r[1] > 0 for r in rows], dtype=bool), prior)


def tag(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key``, score, n_toxic_tokens and the offending spans as ``start:end`` in code points.

    Row by row, no shuffle: a text is cut into words, all of them are one chain, and the
    marginals of its words give its score. A null, empty or wordless text has the
    score of a text without suspicion; repeated rows score alike.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        emissions = _Emissions(model)
        for batch in batches:
            for piece in pieces(batch, "_t", 2 << 20):
                texts = [t or "" for t in piece["_t"].to_pylist()]
                words = [TOKEN.findall(t) for t in texts]
                lengths = np.array([len(w) for w in words], dtype=np.int64)
                flat = np.fromiter((emissions[w] for doc in words for w in doc), dtype=np.float64, count=int(lengths.sum()))
                p = marginals(model, flat, lengths)
                x = np.column_stack([np.ones(len(texts)), aggregates(p, lengths)]) @ model.calibration
                hot, start = p >= 0.5, np.concatenate([[0], np.cumsum(lengths)])
                number = np.concatenate([[0], np.cumsum(hot)])
                number = number[start[1:]] - number[start[:-1]]
                spans: list[str] = [""] * len(texts)
                for d in np.flatnonzero(number):
                    flags = hot[start[d] : start[d + 1]]
                    spans[d] = ",".join(f"{m.start()}:{m.end()}" for m, f in zip(TOKEN.finditer(texts[d]), flags) if f)
                yield pa.RecordBatch.from_arrays(
                    [piece["_k"], pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))), pa.array(number.astype(np.int64)), pa.array(spans, pa.string())],
                    ["_k", "score", "n_toxic_tokens", "toxic_spans"],
                )

    out = docs.select(F.col(key).alias("_k"), F.col("text").alias("_t")).mapInArrow(run, f"_k {kind}, score double, n_toxic_tokens long, toxic_spans string")
    return out.withColumnRenamed("_k", key)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: held_out, score and whether it reaches the threshold."""
    return tag(docs, train(docs, labels)).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_toxic_tokens", "toxic_spans"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scoring below the threshold, with their columns; clashing names stay theirs."""
    model = train(docs, labels)
    packed = docs.select(F.struct("*").alias("_k"), F.col("text"))
    return tag(packed, model, "_k").where(F.col("score") < threshold).select("_k.*")

"""Line dedup: winnowed line hashes find shared runs, of which only the first place stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mix64, numbered, pieces
from gridloom.session import written

# A run counts from so many lines or so many words on, whichever it has first.
RUN, WORDS = 3, 8
BLANK = " \t\n\x0b\f\r"
INK = f"[^{BLANK}]"


def _windows(h: np.ndarray, words: np.ndarray, ends: np.ndarray, run: int, least: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Start, length and fingerprint line of all runs of at most ``run`` lines that count.

    ``h`` and ``words`` are the hashes and words of the lines of many texts, one after the other,
    ``ends`` where each line's text ends. The fingerprint is the line with the smallest hash,
    the first of equals.
    """
    n = len(h)
    best, at, total = h.copy(), np.arange(n), words.astype(np.int64)
    for length in range(1, run + 1):
        if length > 1:
            start = np.arange(n - length + 1) if n >= length else np.zeros(0, np.int64)
            best, at, total = best[: len(start)], at[: len(start)], total[: len(start)]
            more = start + length - 1
            total = total + words[more]
            smaller = h[more] < best
            best, at = np.where(smaller, h[more], best), np.where(smaller, more, at)
        here = np.arange(len(best))
        counts = (here + length <= ends[: len(here)]) & ((total >= least) if length < run else True)
        yield here[counts], length, at[counts]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and words of all lines of a batch, end of each line's text, its row, and the first line of each row."""
    h = batch["h"]
    bounds = np.asarray(h.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    size = np.diff(bounds)
    return np.asarray(h.flatten()).astype(np.int64), np.asarray(batch["w"].flatten()).astype(np.int64), np.repeat(bounds[1:], size), np.repeat(np.arange(len(size)), size), bounds[:-1]


def repeated_windows(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """``(_row, runs)``: per row of ``(_row, doc_id, text)`` start and length of its short runs of lines seen before.

    Lines without a word do not count as lines; others are compared without surrounding white
    space. The runs looked at are those of ``run`` lines and shorter ones of at least ``words``
    words. A run's fingerprint is its smallest line hash; the places of a fingerprint that
    occurs once drop out. From the others each run that chose the place reaches out to both
    sides, up to ``run - 1`` lines, is compared as a whole, and every place of it but the first
    in the order of (doc_id, row, line) is a repeat.

    Together the short runs cover a longer shared one to both its ends: a line of it that is no
    longer in a shortest run that counts has fewer than ``run`` lines and ``words`` words behind the
    last such start, so one of the runs from there ends with it. Fingerprints, counts and minima
    are combined before the shuffle and joins are by key, so a line or run shared by a third
    of all documents is no hot group.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(INK))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t\x0b\f\r]+|[ \t\x0b\f\r]+$", ""))
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    sizes = F.transform(lines, lambda x: F.least(F.lit(words), F.size(F.split(x, r"[ \t\x0b\f\r]+"))).cast("int"))
    # Written, or the text would be split and hashed again for every use.
    base = written(docs.select("_row", F.col("doc_id").alias("_id"), hashes.alias("h"), sizes.alias("w")), "line-hashes").where(F.size("h") > 0)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, ends, of, first = _flat(batch)
            at = np.unique(np.concatenate([x[2] for x in _windows(h, w, ends, run, words)] or [np.zeros(0, np.int64)]))
            rows = batch["_row"].take(pa.array(of[at]))
            yield pa.RecordBatch.from_arrays([rows, pa.array((at - first[of[at]]).astype(np.int32)), pa.array(h[at])], ["_row", "at", "f"])

    places = written(base.select("_row", "h", "w").mapInArrow(choose, "_row long, at int, f long"), "line-fingerprints")
    marks = places.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    shared = places.join(marks, "f").groupBy("_row").agg(F.collect_list("at").alias("ats"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, ends, of, first = _flat(batch)
            ats = batch["ats"]
            bounds = np.asarray(ats.offsets).astype(np.int64)
            chosen = np.zeros(len(h), dtype=bool)
            chosen[np.repeat(first, np.diff(bounds)) + np.asarray(ats.flatten())] = True
            u = h.view(np.uint64)
            starts, lengths, keys, others = [], [], [], []
            for start, length, at in _windows(h, w, ends, run, words):
                start = start[chosen[at]]
                a, b = np.full(len(start), length, np.uint64), np.full(len(start), 7 * length, np.uint64)
                for k in range(length):
                    line = u[start + k]
                    a, b = mix64(a * np.uint64(0x9E3779B97F4A7C15) ^ line), mix64((b ^ line) * np.uint64(0xD6E8FEB86659FD93))
                starts.append(start)
                lengths.append(np.full(len(start), length, np.int32))
                keys.append(a.view(np.int64))
                others.append(b.view(np.int64))
            start = np.concatenate(starts)
            of_row = pa.array(of[start])
            columns = [batch["_row"].take(of_row), batch["_id"].take(of_row), pa.array((start - first[of[start]]).astype(np.int32))]
            columns += [pa.array(np.concatenate(x)) for x in (lengths, keys, others)]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_id", "s", "n", "k1", "k2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = base.join(shared, "_row").select("_row", "_id", "h", "w", "ats").mapInArrow(reach, f"_row long, _id {kind}, s int, n int, k1 long, k2 long")
    runs = written(runs, "line-runs")
    place = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("_row"), F.col("s"))
    first = runs.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("k1", "k2", "first")
    later = runs.join(first, ["k1", "k2"]).where(place > F.col("first"))
    return later.groupBy("_row").agg(F.collect_list(F.struct("s", "n")).alias("runs"))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """Columns of ``docs`` with text changed, n_lines and n_deleted (replacing any so named).

    Deletes every line inside a run of lines that occurs earlier in the corpus, in the order of
    doc_id (nulls last), then row, then line, and has at least ``run`` lines or ``words`` words; a
    single long line is such a run. Lines without a word stay and do not interrupt a run. A null
    text stays null; repeated rows are repeats of one another; a document of which nothing but
    blank lines is left keeps those. An empty table gives no rows, a text of any length is one
    row of its task.
    """
    own = ("n_lines", "n_deleted")
    rest = [c for c in docs.columns if c not in ("text", *own)]
    rows = written(numbered(docs, F.struct(*rest, F.lit(0).alias("_")).alias("_rest"), "text"), "numbered-lines")
    rows = rows.join(repeated_windows(rows.select("_row", F.col("_rest.doc_id").alias("doc_id"), "text"), run, words), "_row", "left").select("_rest", "text", "runs")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts, inked, deleted = [], [], []
                for text, runs in zip(piece["text"].to_pylist(), piece["runs"].to_pylist()):
                    lines = (text or "").split("\n")
                    places = [i for i, x in enumerate(lines) if x.strip(BLANK)]
                    gone = {places[r["s"] + k] for r in runs or () for k in range(r["n"])}
                    texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                    inked.append(len(places))
                    deleted.append(len(gone))
                yield pa.RecordBatch.from_arrays([piece["_rest"], pa.array(texts, pa.string()), pa.array(inked, pa.int64()), pa.array(deleted, pa.int64())], ["_rest", "text", *own])

    kind = rows.schema["_rest"].dataType.simpleString()
    out = rows.mapInArrow(delete, f"_rest {kind}, text string, n_lines long, n_deleted long")
    return out.select(*["text" if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns if c not in own], *own)

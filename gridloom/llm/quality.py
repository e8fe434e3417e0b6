"""Quality rules: a ledger of failure bits and measurements, policies and ablations over it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import flat_bytes, pieces

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_letters", "n_capitals", "max_word_bytes")

# Rule number -> name and the condition under which a text fails it. Ratios are compared as
# whole numbers, so that a rule gives the same bit wherever it is computed. The first two
# are the base; numbers are never given to another rule, so stored bits stay readable.
RULES: dict[int, tuple[str, str]] = {
    0: ("few_words", "n_words < 50"),
    1: ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbols", "10 * n_symbols > n_words"),
    3: ("repeated_lines", "2 * n_dup_lines > n_lines AND n_lines >= 4"),
    4: ("long_words", "word_chars > 12 * n_words"),
    5: ("short_words", "2 * word_chars < 5 * n_words"),
    6: ("capitals", "10 * n_capitals > 4 * n_letters AND n_letters >= 50"),
    7: ("few_distinct_words", "20 * n_distinct_words < n_words"),
    8: ("one_giant_word", "max_word_bytes > 1000"),
}
BASE_BITS = 0b11


@dataclass(frozen=True)
class Policy:
    """A version name and the rules that reject."""

    version: str
    rules: tuple[int, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r for r in self.rules)


POLICIES: Mapping[str, Policy] = {"v1": Policy("v1", (0, 1, 2, 3)), "v2": Policy("v2", tuple(RULES))}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more, and the number of distinct words."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(a) < 4 or len(ids) == len(a):
        return 0, len(ids)
    v = len(ids)
    pair = a[:-1] * v + a[1:]
    if v < 2_000_000:  # v ** 3 fits 63 bits
        code = pair[:-1] * v + a[2:]
    else:
        code = np.unique(pair, return_inverse=True)[1][:-1] * v + a[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(a), dtype=bool)
    for k in range(3):
        covered[k : k + len(code)] |= twice
    return int(covered.sum()), len(ids)


def _measure(texts: pa.Array) -> dict[str, np.ndarray]:
    data, bounds = flat_bytes(texts)
    space = _SPACE[data]

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    n = len(bounds) - 1
    out = {m: np.zeros(n, dtype=np.int64) for m in MEASURES}
    out["word_chars"] = count(~space & ((data & 0xC0) != 0x80))
    out["n_symbols"] = count(_SYMBOL[data])
    out["n_letters"], out["n_capitals"] = count(_LETTER[data]), count(_CAPITAL[data])
    raw = data.tobytes()
    for i in range(n):
        text = raw[bounds[i] : bounds[i + 1]]
        words = text.split()
        out["n_words"][i] = len(words)
        if not words:
            continue
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
        out["n_repeat_words"][i], out["n_distinct_words"][i] = _repeat_words(words)
        out["max_word_bytes"][i] = max(map(len, words))
    return out


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and every measurement, one pass over whole texts, row by row, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_t"):
                found = _measure(piece["_t"])
                yield pa.RecordBatch.from_arrays([piece["_k"], *[pa.array(found[m]) for m in MEASURES]], ["_k", *MEASURES])

    out = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(run, f"_k {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return out.withColumnRenamed("_k", key)


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Measurements and ``fail_bits``: bit r is set where rule r fails. Each rule is evaluated once.

    A null or empty text has no words and fails rule 0 only; repeated rows stay repeated;
    columns of ``docs`` other than the two named are not looked at.
    """
    bits = F.lit(0).cast("long")
    for number, (_, fails) in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << number)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text, key).withColumn("fail_bits", bits)


def passes(policy: Policy, bits: Column | str = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: texts failing it, failing it alone, and kept if it were left out.

    The ledger is first counted by its masked bits, of which there are few; a text comes back
    without rule r exactly where the masked bits are r's bit alone.
    """
    seen = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    kept = F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("n"))), F.lit(0))
    entry = lambda r: F.struct(
        F.lit(r).alias("rule"),
        F.lit(RULES[r][0]).alias("name"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(1 << r).cast("long")) != 0, F.col("n"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("bits") == (1 << r), F.col("n"))), F.lit(0)).alias("failing_alone"),
        (kept + F.coalesce(F.sum(F.when(F.col("bits") == (1 << r), F.col("n"))), F.lit(0))).alias("kept_without"),
    )
    return seen.agg(F.array(*[entry(r) for r in policy.rules]).alias("r")).select(F.inline("r"))


def quality_verdicts(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    """One row per document: the measurements, the failure bits and the policy's verdict."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE_BITS).cast("long")) != 0
    return ledger(docs).select("doc_id", *MEASURES, "fail_bits", F.lit(policy.version).alias("policy"), failed.alias("base_failed"), (~failed & passes(policy)).alias("kept"))

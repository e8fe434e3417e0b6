"""Model calls as user-supplied functions, run inside tasks on Arrow batches."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import fixed

Complete = Callable[[str, str], str]  # (system text, prompt) -> reply
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]

# Texts for the caller's model; results do not depend on them, and callers may pass their own.
QUESTION_SYSTEM = "List five questions about this table, one per line."
SUMMARY_SYSTEM = "Describe this table briefly."


def completions(
    df: DataFrame,
    prompt: str,
    out: str,
    complete: Complete | None,
    system: str = "",
    tolerate_errors: bool = False,
    error: str | None = None,
) -> DataFrame:
    """Add ``out``: the trimmed reply to each ``prompt``; no model means empty replies.

    Up to four calls of a task run at once. The function is marked non-deterministic so
    the optimizer never duplicates the calls. Rows keep their place; NULL prompts are
    not sent. A failed call fails the job, or with ``tolerate_errors`` has an empty reply, or
    with ``error`` a NULL reply and its reason in the column of that name.
    """
    if complete is None:
        done = df.withColumn(out, F.lit(""))
        return done if error is None else done.withColumn(error, F.lit(None).cast("string"))

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return complete(system, text).strip(), None
        except Exception as e:
            if error is not None:
                return None, f"{type(e).__name__}: {e}"
            if tolerate_errors:
                return "", None
            raise

    @F.pandas_udf("reply string, error string")
    def reply(texts: pd.Series) -> pd.DataFrame:
        with ThreadPoolExecutor(fixed.MODEL_CALLS_AT_ONCE) as pool:
            return pd.DataFrame(list(pool.map(one, texts)), columns=["reply", "error"], dtype=object)

    called = df.withColumn("_called", reply.asNondeterministic()(F.col(prompt))).withColumn(out, F.col("_called.reply"))
    return (called if error is None else called.withColumn(error, F.col("_called.error"))).drop("_called")


def embeddings(text: Column | str, embed: Embed) -> Column:
    """Dense vectors in input order, asked for in groups of at most 96 texts."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out: list = []
        values = texts.fillna("").tolist()
        for start in range(0, len(values), fixed.EMBED_BATCH):
            part = values[start : start + fixed.EMBED_BATCH]
            got = embed(part)
            if len(got) != len(part):
                raise ValueError(f"asked for {len(part)} vectors, got {len(got)}")
            out.extend(np.asarray(v, dtype=np.float32) for v in got)
        return pd.Series(out, dtype=object)

    return vectors.asNondeterministic()(F.col(text) if isinstance(text, str) else text)


def hashed_embedding(dims: int = 64) -> Embed:
    """A deterministic local stand-in for a model: signed hashing of lower-case words.

    A word adds 1 or -1, by the ninth hex digit of its md5, at the first eight digits modulo
    ``dims``; vectors are scaled to length 1. Case and white space are those of ASCII.
    """
    seen: dict[bytes, tuple[int, float]] = {}

    def place(word: bytes) -> tuple[int, float]:
        if word not in seen:
            if len(seen) > 100_000:
                seen.clear()
            digits = hashlib.md5(word).hexdigest()
            seen[word] = (int(digits[:8], 16) % dims, 1.0 if int(digits[8], 16) % 2 else -1.0)
        return seen[word]

    def embed(texts: Sequence[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(dims)
            for word, n in Counter(text.encode().lower().split()).items():
                at, sign = place(word)
                v[at] += n * sign
            norm = np.sqrt((v * v).sum())
            out.append(v / norm if norm else v)
        return out

    return embed

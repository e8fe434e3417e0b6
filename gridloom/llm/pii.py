"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks set around matches; texts that hold them get another control character instead,
# which no pattern accepts either, so that lengths and matches stay as they are.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
LOCAL = r"[A-Za-z0-9._%+-]"

# Where a run of one class is followed by something outside it, a possessive run finds the
# same as a greedy one, without recursion; a match can only begin where a run begins or
# where the match before has ended, so long runs are read once.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
KINDS = tuple(PATTERNS)
BASE = KINDS[:4]
# Score of a confirmed span without context, and words that raise it when they stand near.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.35}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "host|server|address|ip",
    "card": "card|visa|credit|pay|master",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
RAISE, NEAR, ENOUGH = 0.2, 40, 0.5
BLOCK = 128


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(match: Column) -> Column:
    code = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - F.lit(55))
    rest = F.aggregate(
        F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    )
    return F.length(code).between(15, 34) & (rest == 1)


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _candidates(parts: Column, kind: str) -> Column:
    """Per match: its text, its length, the length up to the next match, and its score."""
    rest = lambda p: F.substring_index(p, CLOSE, -1)

    def of(part: Column, i: Column) -> Column:
        match = F.substring_index(part, CLOSE, 1)
        around = F.concat(F.right(rest(F.get(parts, i)), F.lit(NEAR)), F.lit(" "), F.left(rest(part), F.lit(NEAR)))
        near = F.lower(around).rlike(rf"\b(?:{CONTEXT[kind]})")
        return F.struct(
            F.length(match).alias("n"),
            (F.length(part) - 1).alias("step"),
            _confirmed(kind, match).alias("ok"),
            F.round(F.lit(PRIOR[kind]) + F.when(near, RAISE).otherwise(0.0), 2).alias("score"),
        )

    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), of)


def _placed(first: Column, found: Column, kind: str) -> Column:
    """Spans at code points: running sums inside blocks of matches, then over the blocks."""
    span = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"
    no = KINDS.index(kind)

    def block(b: Column) -> Column:
        return F.aggregate(
            F.slice(found, b * BLOCK + 1, F.lit(BLOCK)),
            F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out")),
            lambda acc, m: F.struct(
                (acc["at"] + m["step"]).alias("at"),
                F.when(
                    m["ok"] & (F.lit(kind in BASE) | (m["score"] >= ENOUGH)),
                    F.concat(
                        acc["out"],
                        F.array(
                            F.struct(
                                acc["at"].alias("start"), F.lit(no).alias("kind_no"), (acc["at"] + m["n"]).alias("end"), F.lit(kind).alias("kind"), m["score"].alias("score")
                            )
                        ),
                    ),
                )
                .otherwise(acc["out"])
                .cast(span)
                .alias("out"),
            ),
        )

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), block)
    moved = F.aggregate(
        blocks,
        F.struct(first.alias("at"), F.array().cast(f"array<{span}>").alias("out")),
        lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.transform(
                        b["out"],
                        lambda s: F.struct(
                            (s["start"] + acc["at"]).alias("start"), s["kind_no"].alias("kind_no"), (s["end"] + acc["at"]).alias("end"), s["kind"].alias("kind"), s["score"].alias("score")
                        ),
                    )
                ),
            )
            .cast(f"array<{span}>")
            .alias("out"),
        ),
    )
    return F.when(F.size(found) > 0, F.flatten(moved["out"])).otherwise(F.array().cast(span))


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans``: every span (start, kind_no, end, kind, score) in order.

    Starts and ends count code points, the end is exclusive. The four base kinds are kept
    whenever their own check holds; an IBAN needs its mod-97 check, and a social security
    number needs a context word within 40 characters between it and the next candidate.
    Row by row and without a shuffle. A null or empty text has no spans; repeated rows give
    repeated results; other columns are not looked at.
    """
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), OPEN + CLOSE, OTHER + OTHER)
    out = docs.select(*keep, clean.alias("_t"))
    marked = {k: F.split(F.regexp_replace(F.col("_t"), p, f"{OPEN}$0{CLOSE}"), OPEN) for k, p in PATTERNS.items()}
    out = out.select(*keep, *[v.alias(f"_{k}") for k, v in marked.items()])
    # Lengths and candidates are columns of their own: a struct of both would be taken apart
    # by the optimiser and computed anew for every block that refers to it.
    first = [F.length(F.get(F.col(f"_{k}"), F.lit(0))).alias(f"_{k}_first") for k in KINDS]
    found = [_candidates(F.col(f"_{k}"), k).alias(f"_{k}_found") for k in KINDS]
    out = out.select(*keep, *first, *found)
    spans = F.concat(*[_placed(F.col(f"_{k}_first"), F.col(f"_{k}_found"), k) for k in KINDS])
    return out.select(*keep, F.array_sort(spans).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans as text."""
    found = find_pii(docs).withColumn("base", F.filter("spans", lambda s: s["kind_no"] < len(BASE)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.transform("spans", lambda s: s["score"]).alias("scores"),
    )

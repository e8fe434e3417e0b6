"""Chat formatting: typed content parts become text and ordered placeholders, with attachments and a loss mask."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<turn:bigint,part:int,kind:string,ref:string,at:bigint,tokens:bigint>"
# Characters of formatted text in one row; a longer conversation goes on in the next row.
ROW_CHARS = 1 << 20


@dataclass(frozen=True)
class Template:
    """Marks around roles and texts, placeholders of parts, and what a part's placeholder expands to.

    All control strings, the foreign ones included, must begin with a character that stands
    nowhere else in any of them. Then none can overlap another or arise across a seam, and one
    inserted escape after its first character takes a control string out of a text; a text
    that already has escapes there gets one more, so that reading takes exactly one away.
    """

    turn: str = "<|turn|>"
    says: str = "<|says|>"
    end: str = "<|end|>"
    placeholders: tuple[tuple[str, str], ...] = (("image", "<|image|>"), ("audio", "<|audio|>"), ("document", "<|document|>"))
    other: str = "<|attachment|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "\\"
    learnt: str = "assistant"
    image_patch: int = 14
    image_default: int = 576
    audio_rate: float = 25.0
    page_tokens: int = 1024
    _hide: re.Pattern = field(init=False, repr=False, compare=False)
    _show: re.Pattern = field(init=False, repr=False, compare=False)
    _cut: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        control = [self.turn, self.says, self.end, self.other, *(p for _, p in self.placeholders), *self.foreign]
        firsts = {c[:1] for c in control}
        if len(self.escape) != 1 or any(len(c) < 2 or self.escape in c or firsts & set(c[1:]) for c in control):
            raise ValueError("control strings must begin with a character that none of them has elsewhere, and be free of the escape")
        e = re.escape(self.escape)
        hide = "|".join(f"{re.escape(c[0])}(?={e}*{re.escape(c[1:])})" for c in sorted(set(control)))
        show = "|".join(f"{re.escape(c[0])}{e}(?={e}*{re.escape(c[1:])})" for c in sorted(set(control)))
        marks = "|".join(map(re.escape, (self.turn, self.says, self.end, self.other, *(p for _, p in self.placeholders))))
        for name, pattern in (("_hide", hide), ("_show", show), ("_cut", f"({marks})")):
            object.__setattr__(self, name, re.compile(pattern))

    def escaped(self, text: str) -> str:
        return self._hide.sub(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        return self._show.sub(lambda m: m[0][0], text)


class _Visitor:
    """Flattens the parts of one turn in their order; ``visit_<type>`` gives a placeholder's tokens."""

    def __init__(self, template: Template, turn: int | None, role: str):
        t = self.template = template
        self.turn, self.learnt, self.marks = turn, role == t.learnt, dict(t.placeholders)
        self.out, self.size, self.loss, self.attached = [], 0, [], []
        self._put(f"{t.turn}{t.escaped(role)}{t.says}")

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def visit(self, number: int, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind == "text":
            start = self.size
            self._put(self.template.escaped(part.get("text") or ""))
            if self.learnt and self.size > start:
                self.loss.append((start, self.size))
            return
        tokens = getattr(self, f"visit_{kind}", self.visit_other)(part) if kind in self.marks else self.visit_other(part)
        self.attached.append({"turn": self.turn, "part": number, "kind": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self._put(self.marks.get(kind, self.template.other))

    def visit_image(self, part: dict) -> int:
        w, h, p = part.get("width"), part.get("height"), self.template.image_patch
        return self.template.image_default if not w or not h or w < 0 or h < 0 else -(-w // p) * -(-h // p)

    def visit_audio(self, part: dict) -> int:
        seconds = part.get("seconds") or 0.0
        return math.ceil(seconds * self.template.audio_rate) if 0 < seconds < math.inf else 0

    def visit_document(self, part: dict) -> int:
        return max(0, part.get("pages") or 0) * self.template.page_tokens

    def visit_other(self, part: dict) -> int:
        return 0

    def done(self) -> str:
        self._put(self.template.end)
        return "".join(self.out)


def _formatted(turns: DataFrame, template: Template) -> DataFrame:
    """One formatted segment per turn: text, loss spans and attachments, counted from its start."""
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    attached = pa.list_(pa.struct([("turn", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, refs = [], [], []
            for turn, role, text, parts in zip(*(batch[c].to_pylist() for c in ("turn", "role", "text", "parts"))):
                visitor = _Visitor(template, turn, role or "")
                for i, part in enumerate(parts if parts is not None else [{"text": text}]):
                    visitor.visit(i, part or {})
                texts.append(visitor.done())
                spans.append([{"start": a, "end": b} for a, b in visitor.loss])
                refs.append(visitor.attached)
            columns = [batch[c] for c in ("conv_id", "turn", "role")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts), pa.array(spans, loss), pa.array(refs, attached)], ["conv_id", "turn", "role", "text", "loss", "attached"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    typed = "parts" in turns.columns
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        "role",
        (F.col("text") if "text" in turns.columns else F.lit(None)).cast("string").alias("text"),
        (F.col("parts") if typed else F.lit(None)).cast(f"array<{PART}>").alias("parts"),
    )
    return rows.mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, loss array<struct<start:bigint,end:bigint>>, attached array<{ATTACHMENT}>")


class _Row:
    """One row of output under construction."""

    def __init__(self, conv, number: int):
        self.conv, self.number = conv, number
        self.texts, self.size, self.turns, self.loss, self.attached = [], 0, 0, [], []

    def add(self, text: str, loss: list, attached: list) -> None:
        self.loss += [{"start": s["start"] + self.size, "end": s["end"] + self.size} for s in loss]
        self.attached += [{**a, "at": a["at"] + self.size} for a in attached]
        self.texts.append(text)
        self.size += len(text)
        self.turns += 1


def format_chats(turns: DataFrame, template: Template | None = None, row_chars: int = ROW_CHARS, then: tuple[Callable, str] | None = None) -> DataFrame:
    """Conversations as training text, one row each: ``(conv_id, number, n_turns, text, loss, attached, n_expanded)``.

    ``turns`` has conv_id, turn, role and either ``text`` or ``parts``, an array of typed parts
    (``PART``); where both are there, text stands in for null parts. Texts are escaped, images,
    audio and documents become placeholders in their place, whose references are listed in
    ``attached`` with the position of the placeholder and the tokens it expands to (their sum is
    ``n_expanded``). ``loss`` holds the spans, in code points, of the learnt role's texts.

    Turns are formatted where they are read. They meet by conversation, sorted, and are joined as
    they stream by, so that no conversation is held whole: one of more than ``row_chars``
    characters goes on in further rows (``number`` from 0), cut between turns, with positions
    counted in each row. ``then`` is a function over the sorted stream of such rows, with the
    schema of its result, that runs in the same task.

    A null text or role is empty, an unknown type of part an attachment without tokens, a
    negative or missing size the default or 0. A null conv_id is a conversation. Turns are
    ordered by turn (nulls first), ties by role and text; repeated rows are repeated turns. An
    empty table gives no rows, a text of any length is one turn. Other columns are not looked
    at.
    """
    template = template or Template()
    kind = turns.schema["conv_id"].dataType.simpleString()
    sorted_turns = _formatted(turns, template).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kind}, number long, n_turns long, text string, loss array<struct<start:bigint,end:bigint>>, attached array<{ATTACHMENT}>, n_expanded long"
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    attached = pa.list_(pa.struct([("turn", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Row | None = None
        ready: list[_Row] = []
        load = 0

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            rows = list(ready)
            ready.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r.conv for r in rows], id_type),
                    pa.array([r.number for r in rows], pa.int64()),
                    pa.array([r.turns for r in rows], pa.int64()),
                    pa.array(["".join(r.texts) for r in rows], pa.string()),
                    pa.array([r.loss for r in rows], loss),
                    pa.array([r.attached for r in rows], attached),
                    pa.array([sum(a["tokens"] for a in r.attached) for r in rows], pa.int64()),
                ],
                ["conv_id", "number", "n_turns", "text", "loss", "attached", "n_expanded"],
            )

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, text, spans, refs in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "loss", "attached"))):
                if held is not None and (held.conv != conv or held.size + len(text) > row_chars):
                    ready.append(held)
                    load += held.size
                    held = _Row(conv, held.number + 1 if held.conv == conv else 0)
                    if load > 2 * ROW_CHARS or len(ready) >= 10_000:
                        yield out(id_type)
                        load = 0
                held = held or _Row(conv, 0)
                held.add(text, spans, refs)
        if held is not None:
            ready.append(held)
            yield out(id_type)

    rows = sorted_turns.mapInArrow(run, schema)
    return rows if then is None else rows.mapInArrow(*then)


def read_turns(text: str, template: Template) -> Iterator[tuple[str, list[tuple[int, str]], int]]:
    """Role, text pieces with their position, and end of each turn in a formatted text.

    The inverse of formatting: cuts at the marks, which no escaped text has, and takes the
    escapes out. Placeholders are cuts between the pieces of a turn.
    """
    role, body, at = None, [], 0
    state = ""
    for i, token in enumerate(template._cut.split(text)):
        if i % 2:
            if token == template.end:
                yield role or "", body, at + len(token)
                role, body = None, []
            state = token
        elif state == template.turn:
            role = template.unescaped(token)
        elif role is not None and token:
            body.append((at, template.unescaped(token)))
        at += len(token)


# A conversation whose texts hold control strings; it is formatted along with the others.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_digest(spark: SparkSession, turns: DataFrame, template: Template | None = None) -> DataFrame:
    """What can be read back from the formatted conversations and from one full of control strings.

    One row per conversation: n_turns, digest of roles and texts, digest and length of what
    lies under the loss mask, and the length of the formatted text. Digests run on over the rows
    of a long conversation; nulls and ties are as in ``format_chats``.
    """
    template = template or Template()
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, chars, learnt = None, 0, 0, 0
        said, masked = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            rows = []
            for c, number, text, spans in zip(*(batch[x].to_pylist() for x in ("conv_id", "number", "text", "loss"))):
                if number == 0:
                    if n:
                        rows.append((conv, n, said.hexdigest(), learnt, masked.hexdigest(), chars))
                    conv, n, chars, learnt = c, 0, 0, 0
                    said, masked = hashlib.sha256(), hashlib.sha256()
                for role, body, _ in read_turns(text, template):
                    said.update(f"{role}\n{''.join(b for _, b in body)}\n".encode())
                    n += 1
                for span in spans:
                    part = template.unescaped(text[span["start"] : span["end"]])
                    masked.update(part.encode())
                    learnt += len(part)
                chars += len(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("conv_id").type if not i else None) for i, x in enumerate(zip(*rows))], names)
        if n:
            last = (conv, n, said.hexdigest(), learnt, masked.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([x], batch.schema.field("conv_id").type if not i else None) for i, x in enumerate(last)], names)

    control = spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string")
    both = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(control)
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return format_chats(both, template, then=(run, schema))

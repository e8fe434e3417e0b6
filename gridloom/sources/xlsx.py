"""Workbooks to grid rows and merge ranges.

The workbook format is a zip of XML parts, so a task can only read a workbook as a
whole; the files are spread over tasks and each is streamed row by row. Finding the
tables is not done here but relationally, on the grid.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import written
from gridloom.sources.csv import base_name, file_id

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PARSED = "path string, sheet string, r bigint, cells array<string>, merge array<int>, error string"
BATCH_ROWS = 4096

# Date and time formats that have a number instead of a text.
BUILTIN_DATES = {
    14: "mm-dd-yy",
    15: "d-mmm-yy",
    16: "d-mmm",
    17: "mmm-yy",
    18: "h:mm am/pm",
    19: "h:mm:ss am/pm",
    20: "hh:mm",
    21: "hh:mm:ss",
    22: "m/d/yy hh:mm",
    45: "mm:ss",
    46: "[h]:mm:ss",
    47: "mm:ss.0",
}

# Plain number formats that have a number instead of a text.
BUILTIN_NUMBERS = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%"}
NUMBER_FORMAT = re.compile(r"(#,##)?0(\.0+)?(%)?")


def column_number(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _area(ref: str) -> list[int]:
    first, _, last = ref.partition(":")
    last = last or first
    return [
        int(re.sub(r"\D", "", first)) - 1,
        column_number(first),
        int(re.sub(r"\D", "", last)) - 1,
        column_number(last),
    ]


def date_text(serial: float, pattern: str) -> str:
    """A day serial in a date/time pattern of y, m, d, h, s letters."""
    elapsed = round(serial * 86400)
    moment = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=elapsed)
    out, clock_seen = [], False
    half_day = "am/pm" in pattern.lower()
    tokens = re.findall(r"am/pm|y+|m+|d+|h+|s+|\\.|\"[^\"]*\"|\[[^\]]*\]|.", pattern.lower())
    for i, token in enumerate(tokens):
        head, n = token[0], len(token)
        if token == "am/pm":
            out.append("AM" if moment.hour < 12 else "PM")
        elif re.fullmatch(r"\[(h+|m+|s+)\]", token):
            out.append(f"{elapsed // {'h': 3600, 'm': 60, 's': 1}[token[1]]:0{n - 2}d}")
            clock_seen = True
        elif head == "y":
            out.append(f"{moment.year:04d}" if n > 2 else f"{moment.year % 100:02d}")
        elif head == "d":
            out.append({1: str(moment.day), 2: f"{moment.day:02d}", 3: moment.strftime("%a")}.get(n, moment.strftime("%A")))
        elif head == "h":
            hour = (moment.hour - 1) % 12 + 1 if half_day else moment.hour
            out.append(f"{hour:0{n}d}")
            clock_seen = True
        elif head == "s":
            out.append(f"{moment.second:0{n}d}")
        elif head == "m":
            # Minutes stand after hours or before seconds.
            following = next((t[0] for t in tokens[i + 1 :] if t[0] in "ymdhs" or t in ("[s]", "[ss]")), "")
            value = moment.minute if n <= 2 and (clock_seen or following in ("s", "[")) else moment.month
            names = {3: moment.strftime("%b"), 4: moment.strftime("%B")}
            out.append(names.get(n) or f"{value:0{n}d}")
        elif head == "\\":
            out.append(token[1:])
        elif head == '"':
            out.append(token[1:-1])
        elif head != "[":
            out.append(token)
    return "".join(out)


def number_text(raw: str) -> str:
    """A stored number as shown without a format: 15 significant digits at most."""
    try:
        value = float(raw)
    except ValueError:
        return raw
    if len(re.sub(r"\D", "", raw.lower().split("e")[0]).lstrip("0")) > 15:
        return f"{value:.15G}"
    text = format(Decimal(repr(value)), "f")
    return text[:-2] if text.endswith(".0") else text


def formatted_number(raw: str, pattern: str) -> str:
    """A stored number in a format of digits, thousands, decimals and percent."""
    group, decimals, percent = NUMBER_FORMAT.fullmatch(pattern).groups()
    value = Decimal(repr(float(raw))) * (100 if percent else 1)
    value = value.quantize(Decimal(1).scaleb(1 - len(decimals or ".")), ROUND_HALF_UP)
    return format(value if value else abs(value), ",f" if group else "f") + (percent or "")


def _cell_formats(book: zipfile.ZipFile) -> list[str | None]:
    """Per cell style: the date pattern or plain number format, or None for anything else."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{MAIN}numFmt")}
    out: list[str | None] = []
    styles = root.find(f"{MAIN}cellXfs")
    for xf in styles if styles is not None else []:
        fmt = int(xf.get("numFmtId", "0"))
        pattern = custom.get(fmt, "").split(";")[0]
        bare = re.sub(r"\"[^\"]*\"|\\.|\[[^\]]*\]", "", pattern).lower()
        shown = NUMBER_FORMAT.fullmatch(pattern) or (re.search(r"[ymdhs]", bare) and "0" not in bare.replace("s.0", "s"))
        out.append(BUILTIN_DATES.get(fmt) or BUILTIN_NUMBERS.get(fmt) or (pattern if shown else None))
    return out


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag == f"{MAIN}si":
                texts = [t.text or "" for t in node.iter(f"{MAIN}t")]
                phonetic = [t.text or "" for p in node.iter(f"{MAIN}rPh") for t in p.iter(f"{MAIN}t")]
                out.append("".join(texts[: len(texts) - len(phonetic)]))
                node.clear()
    return out


def _cell_text(cell, strings: list[str], formats: list[str | None]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    raw = cell.findtext(f"{MAIN}v") or ""
    if raw == "":
        return ""
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind != "n":
        return raw
    style = int(cell.get("s", "0"))
    pattern = formats[style] if style < len(formats) else None
    try:
        if pattern and NUMBER_FORMAT.fullmatch(pattern):
            return formatted_number(raw, pattern)
        return date_text(float(raw), pattern) if pattern else number_text(raw)
    except (OverflowError, ArithmeticError):  # no such day, or too many digits
        return number_text(raw)


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels}
    parts = []
    for sheet in root.iter(f"{MAIN}sheet"):
        target = targets[sheet.get(REL_ID)]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if part in book.namelist() and "worksheet" in part:
            parts.append((sheet.get("name"), part))
    return parts


def sheet_records(content: bytes) -> Iterator[tuple]:
    """``(sheet, r, cells, merge)`` of one workbook: its rows, and its merge ranges (r = -1)."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strings, formats = _shared_strings(book), _cell_formats(book)
    for name, part in _sheet_parts(book):
        next_row = 0
        with book.open(part) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag == f"{MAIN}row":
                    r = int(node.get("r", next_row + 1)) - 1
                    next_row = r + 1
                    cells: list[str] = []
                    for cell in node.iter(f"{MAIN}c"):
                        at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                        text = _cell_text(cell, strings, formats)
                        if text:
                            cells.extend([""] * (at - len(cells)))
                            cells.append(text)
                    node.clear()
                    if cells:
                        yield name, r, cells, None
                elif node.tag == f"{MAIN}mergeCell":
                    yield name, -1, None, _area(node.get("ref"))


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "sheet", "r", "cells", "merge", "error"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows: list = []
            try:
                for sheet, r, cells, merge in sheet_records(content):
                    rows.append((path, sheet, r, cells, merge, None))
                    if len(rows) == BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except (zipfile.BadZipFile, zlib.error, EOFError, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
                rows.append((path, None, -1, None, None, f"open xlsx: {e}"))
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def scan_xlsx(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(grid, merges, rejected)`` of workbooks; unreadable files are reported, not fatal.

    The parsed rows are written once, so the detection steps read columns, not zips.
    """
    parsed = written(
        spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(_parse, PARSED),
        "xlsx-rows",
    ).withColumn("file_id", file_id("path"))
    bad = parsed.filter(F.col("error").isNotNull()).select("path", F.col("error").alias("reason"))
    good = parsed.join(bad.select("path").distinct(), "path", "left_anti")
    grid = good.filter(F.col("r") >= 0).select(
        "file_id", base_name("path").alias("source_file"), "sheet", "r", "cells"
    )
    m = F.col("merge")
    merges = good.filter(F.col("merge").isNotNull()).select(
        "file_id", "sheet", m[0].alias("r0"), m[1].alias("c0"), m[2].alias("r1"), m[3].alias("c1")
    )
    return grid, merges, bad

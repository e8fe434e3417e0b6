"""Delimited text to grid rows, with the record's position in its file.

One parser for all files, whatever their size. A file is read in splits, line by line. A line
maps the two states *outside* and *inside a quoted field* to the state after it; each split is
passed once for both states it may begin in, and composing the splits' maps tells which one
holds. A quoted line break or a stray quote therefore changes no other record, and no file is
ever read by a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.text import name_uuid
from gridloom.session import written

# Inside a quoted field: anything but a quote, a doubled quote, or a quote that is not followed
# by a comma or the end (which is text). Possessive, so that matching neither goes back nor
# recurses, however long a field is.
_BODY = r'(?:[^"]++|""|"(?![",]|\z))*+'
_QUOTED = f'"{_BODY}"'
_OPEN = f'"{_BODY}'
_FIELD = rf'(?:{_QUOTED}(?=,|\z)|{_OPEN}\z|[^",][^,]*+|)'
# A line that begins outside or inside a quoted field and ends inside one.
_LEAVES_OPEN = rf'^(?:(?:{_QUOTED}|[^",][^,]*+|),)*+{_OPEN}\z'
_STAYS_OPEN = rf'^{_BODY}(?:\z|",(?:(?:{_QUOTED}|[^",][^,]*+|),)*+{_OPEN}\z)'


def file_id(path: Column | str) -> Column:
    """Stable id of a file, from its full path: a repeated run finds the same file."""
    return name_uuid(path)


def base_name(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.element_at(F.split(c, "/"), -1)


def plain_path(uri: Column | str) -> Column:
    """A file URI as the plain path that listings show (no escapes, one slash)."""
    c = F.col(uri) if isinstance(uri, str) else uri
    return F.regexp_replace(
        F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/"
    )


def split_fields(record: Column) -> Column:
    """Fields of one record, whose quoted fields may hold line breaks.

    A record without quotes is split on commas. Otherwise a field is either quoted (a
    doubled quote is a quote, a quote not followed by a comma is text, and one that is never
    closed runs to the end) or runs to the next comma.
    """
    plain = F.split(record, ",", -1)
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_FIELD})"), F.lit(1))

    def value(f: Column) -> Column:
        inner = F.when(f.rlike(rf"^{_QUOTED}\z"), F.substring(f, F.lit(2), F.length(f) - 2)).otherwise(F.substring(f, F.lit(2), F.length(f)))
        return F.when(f.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(f)

    return F.when(F.contains(record, F.lit('"')), F.transform(raw, value)).otherwise(plain)


# How a line maps (outside, inside): 0 keeps both, 1 always ends outside, 2 always inside, 3
# swaps them; 4 is added for a blank line, which is no record outside a quoted field.
def _line_map(line: Column) -> Column:
    leaves, stays = line.rlike(_LEAVES_OPEN), line.rlike(_STAYS_OPEN)
    quoted = F.when(leaves, F.when(stays, 2).otherwise(3)).otherwise(F.when(stays, 0).otherwise(1))
    return (F.when(F.contains(line, F.lit('"')), quoted).otherwise(0) + F.when(line == "", 4).otherwise(0)).cast("int")


def states_before(maps: np.ndarray, start: bool) -> np.ndarray:
    """The state before each line, and after the last, of lines with these maps (True: inside)."""
    n = len(maps)
    fixed = np.where((maps == 1) | (maps == 2), np.arange(n), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(fixed)]) if n else np.array([-1])
    swaps = np.concatenate([[0], np.cumsum(maps == 3)])
    base = np.where(last < 0, start, maps[np.maximum(last, 0)] == 2) if n else np.array([start])
    return base ^ ((swaps - swaps[last + 1]) % 2 == 1)


_STATES = "inside_o boolean, inside_i boolean, open_o boolean, open_i boolean, n_o bigint, n_i bigint"


def _line_states(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Per line, for a split that begins outside (``_o``) and inside (``_i``): the states before
    and after it, and how many records of the split have begun.

    Lines of a split come one after the other in one partition; only their maps travel.
    """
    split, state, begun = None, [False, True], [0, 0]
    for keys, maps in batches:
        keys, maps = keys.to_numpy(), maps.to_numpy()
        out = {c.split()[0]: np.zeros(len(maps), dtype=np.int64 if c.endswith("bigint") else bool) for c in _STATES.split(", ")}
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            if keys[a] != split:
                split, state, begun = keys[a], [False, True], [0, 0]
            for k, name in enumerate("oi"):
                states = states_before(maps[a:b] & 3, state[k])
                starts = begun[k] + np.cumsum(~states[:-1] & (maps[a:b] < 4))
                out[f"inside_{name}"][a:b], out[f"open_{name}"][a:b], out[f"n_{name}"][a:b] = states[:-1], states[1:], starts
                state[k], begun[k] = bool(states[-1]), int(starts[-1])
        yield pd.DataFrame(out)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with their file, split, order in the split, and what each does in either state."""
    lines = (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            plain_path("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.regexp_replace("value", "\r\\z", "").alias("line"),
        )
        .withColumn("_id", F.monotonically_increasing_id())
    )
    # Cells must not be cut from a line again for every use of a state, so states are one column.
    return lines.withColumn("s", F.pandas_udf(_line_states, _STATES)(F.xxhash64("path", "split"), _line_map(F.col("line"))))


def _split_starts(lines: DataFrame) -> DataFrame:
    """Per file split the state it begins in and the records begun in earlier splits.

    A split's map is again one of four. The state at a split is that after the last earlier
    split which ends in the same state from both, changed by each swap since.
    """
    in_file = Window.partitionBy("path").orderBy("split")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(F.struct("s.open_o", "s.open_i", "s.n_o", "s.n_i"), "_id")
    maps = lines.groupBy("path", "split").agg(last.alias("e")).select("path", "split", "e.*")
    fixed = F.col("open_o") == F.col("open_i")
    swap = (F.col("open_o") & ~F.col("open_i")).cast("int")
    states = (
        maps.withColumn("_swaps", F.sum(swap).over(in_file))
        .withColumn("_last", F.last(F.when(fixed, F.struct("open_o", "_swaps")), ignorenulls=True).over(earlier))
        .withColumn("_before", F.coalesce(F.sum(swap).over(earlier), F.lit(0)))
        .withColumn("_odd", (F.col("_before") - F.coalesce("_last._swaps", F.lit(0))) % 2 == 1)
        .withColumn("inside", F.coalesce("_last.open_o", F.lit(False)) != F.col("_odd"))
    )
    n = F.when(F.col("inside"), F.col("n_i")).otherwise(F.col("n_o"))
    return states.withColumn("_n", n).select("path", "split", "inside", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("begun"))


def scan_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Grid rows of delimited files. Blank lines outside quoted fields do not count as records.

    Lines are written once with their split and states, as both depend on how the files were
    split. A record of one line is parsed where it is read; only lines of records that hold line
    breaks are brought together, by record. A quoted field that is never closed runs to the
    end of its file, without the file's last line break; a record has to fit into one row.
    """
    lines = written(_lines(spark, paths), "csv-lines")
    pick = lambda name: F.when(F.col("inside"), F.col(f"s.{name}_i")).otherwise(F.col(f"s.{name}_o"))
    placed = lines.join(_split_starts(lines), ["path", "split"]).select(
        "path", "split", "_id", "line", (F.col("begun") + pick("n") - 1).alias("r"), pick("inside").alias("more"), pick("open").alias("goes_on")
    )
    one = placed.filter(~F.col("more") & ~F.col("goes_on") & (F.col("line") != "")).select("path", "r", "line")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("split", "_id", "line"))), lambda x: x["line"])
    many = placed.filter(F.col("more") | F.col("goes_on")).groupBy("path", "r").agg(F.array_join(parts, "\n").alias("line"))
    return one.unionByName(many).select(
        file_id("path").alias("file_id"),
        base_name("path").alias("source_file"),
        F.lit("").alias("sheet"),
        "r",
        split_fields(F.col("line")).alias("cells"),
    )

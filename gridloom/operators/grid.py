"""Finding the tables in cell grids.

A grid is one DataFrame row per sheet row: ``(file_id, source_file, sheet, r, cells)``
with ``cells`` a ragged ``array<string>``. Rows without content may be absent. Keeping
a sheet row in one record means its cells never need to be brought together again:
extraction and row texts are array expressions, and only column statistics explode
the cells (into a map-side combined aggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import has_content, name_uuid
from gridloom.operators.blocks import (
    BLOCK_BITS,
    block,
    join_heads,
    label_runs,
    mark_pieces,
    number_rows,
    run_heads,
)
from gridloom.session import written

GRID_SCHEMA = "file_id string, source_file string, sheet string, r bigint, cells array<string>"
MERGES_SCHEMA = "file_id string, sheet string, r0 int, c0 int, r1 int, c1 int"
SHEET = ["file_id", "sheet"]
BAND = [*SHEET, "band_start"]


def filled_rows(grid: DataFrame) -> DataFrame:
    """Rows with content, and ``filled``: the column numbers of their non-blank cells."""
    positions = F.transform("cells", lambda v, i: F.when(has_content(v), i))
    return grid.filter(F.exists("cells", has_content)).withColumn("filled", F.array_compact(positions))


def band_rows(grid: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Label every filled row with the first row of the row band (run of non-empty rows) it lies in."""
    pieces = mark_pieces(filled_rows(grid), SHEET, "r", bits)
    return join_heads(pieces, run_heads(pieces, SHEET, "r", bits), SHEET, "band_start", bits)


def written_bands(grid: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``band_rows`` for several uses: written when the rows have been sorted once, and again only
    if a band goes on from one block into the next, whose rows begin where the band does."""
    pieces = written(mark_pieces(filled_rows(grid), SHEET, "r", bits), "band-pieces")
    heads = written(run_heads(pieces, SHEET, "r", bits), "band-heads")
    if heads.isEmpty():
        return pieces.withColumnRenamed("_lo", "band_start").drop("_blk")
    return written(join_heads(pieces, heads, SHEET, "band_start", bits), "banded-rows")


def row_bands(banded: DataFrame) -> DataFrame:
    return banded.groupBy(*BAND).agg(
        F.max("r").alias("band_end"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("filled")).alias("n_cells")
    )


def band_islands(banded: DataFrame) -> DataFrame:
    """Bounds of every table, not yet numbered, and what its first three rows hold.

    Inside a band the extent runs from the first to the last column with content below
    the band's first row (a one-row band is its own extent); inside the extent, maximal
    runs of columns with any content are tables. Columns per band are first reduced by
    a map-side combined aggregate, so the windows below see at most one row per column,
    in one order. ``n_first``, ``n_second`` and ``n_third`` count the table's filled cells there;
    ``repeated`` says that one of these rows comes more than once, where counts of columns
    are not those of a row.
    """
    depth = F.col("r") - F.col("band_start")
    columns = (
        banded.select(*BAND, "r", depth.alias("depth"), "repeated", F.explode("filled").alias("c"))
        .groupBy(*BAND, "c")
        .agg(
            F.max("r").alias("last"),
            F.max(F.col("depth") == 0).alias("in_first"),
            F.max(F.col("depth") == 1).alias("in_second"),
            F.max(F.col("depth") == 2).alias("in_third"),
            F.max(F.col("repeated") & (F.col("depth") <= 2)).alias("repeated"),
        )
    )
    ordered = Window.partitionBy(*BAND).orderBy("c")
    band = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    data_column = F.when(F.col("last") > F.col("band_start"), F.col("c"))
    return (
        columns.withColumn("left", F.coalesce(F.min(data_column).over(band), F.min("c").over(band)))
        .withColumn("right", F.coalesce(F.max(data_column).over(band), F.max("c").over(band)))
        .withColumn("max_row", F.max("last").over(band))
        .withColumn("repeated", F.max("repeated").over(band))
        .filter(F.col("c").between(F.col("left"), F.col("right")))
        .withColumn("_grp", F.col("c") - F.row_number().over(ordered))
        .groupBy(*BAND, "max_row", "repeated", "_grp")
        .agg(
            F.min("c").alias("min_col"),
            F.max("c").alias("max_col"),
            F.sum(F.col("in_first").cast("int")).alias("n_first"),
            F.sum(F.col("in_second").cast("int")).alias("n_second"),
            F.sum(F.col("in_third").cast("int")).alias("n_third"),
        )
        .select(
            *BAND,
            F.col("band_start").alias("min_row"),
            "max_row",
            "min_col",
            "max_col",
            "n_first",
            "n_second",
            "n_third",
            "repeated",
        )
    )


def _numbered(groups: DataFrame, bits: int) -> DataFrame:
    return number_rows(groups, SHEET, "min_row", ["min_row", "min_col"], "table_index", bits)


def table_islands(banded: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Bounds of every table, numbered within its sheet by row and column."""
    return _numbered(band_islands(banded), bits)


def written_islands(banded: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``table_islands`` with the bounds written before numbering, which reads them twice."""
    return _numbered(written(band_islands(banded), "islands"), bits)


def _merged_spans(merges: DataFrame, row: str) -> DataFrame:
    """Column spans of the one-row merges of a row."""
    return (
        merges.filter(F.col("r0") == F.col("r1"))
        .groupBy(*SHEET, F.col("r0").cast("bigint").alias(row))
        .agg(F.collect_list(F.struct("c0", "c1")).alias("spans"))
    )


def _merged(spans: str) -> Column:
    """A merge overlaps two or more of the table's columns."""
    return F.coalesce(
        F.exists(
            spans,
            lambda s: F.least(s.c1, F.col("max_col")) - F.greatest(s.c0, F.col("min_col")) >= 1,
        ),
        F.lit(False),
    )


def _title_candidates(merges: DataFrame, bits: int) -> DataFrame:
    """Runs of rows that could be titles because of merges: rows with a one-row merge,
    and the rows right above them. Keyed by row for an equi-join."""
    one_row = merges.filter((F.col("r0") == F.col("r1")) & (F.col("c1") > F.col("c0")))
    near = one_row.select(
        *SHEET,
        F.explode(F.array((F.col("r0") - 1).cast("bigint"), F.col("r0").cast("bigint"))).alias("min_row"),
    ).filter(F.col("min_row") >= 0)
    return (
        label_runs(near.distinct(), SHEET, "min_row", bits)
        .select(*SHEET, "min_row", F.col("run_end").alias("reach"))
    )


def skip_title_rows(
    islands: DataFrame, banded: DataFrame, merges: DataFrame | None = None, bits: int = BLOCK_BITS
) -> DataFrame:
    """Move ``min_row`` below leading title rows.

    A row is a title if a one-row merge overlaps two or more of the table's columns, or
    if it has exactly one non-blank cell inside the table and the next row has several.
    Two neighbouring title rows cannot both be of the second kind, so a chain of titles
    ends at most two rows past the merged rows it starts in. Where none but a table's first row is merged there, the counts of
    its first three rows settle it; only the heads of the others are compared with sheet rows,
    by an equi-join on the row.
    """
    ident = [*SHEET, "table_index"]
    if merges is None:
        heads = islands.withColumn("reach", F.lit(None).cast("bigint")).withColumn("merged", F.lit(False))
    else:
        starts_at = _title_candidates(merges, bits).join(_merged_spans(merges, "min_row"), [*SHEET, "min_row"], "left")
        heads = (
            islands.join(starts_at, [*SHEET, "min_row"], "left").withColumn("merged", _merged("spans")).drop("spans")
        )
    settled = (F.coalesce("reach", "min_row") == F.col("min_row")) & ~F.col("repeated")
    several = F.col("max_col") > F.col("min_col")
    first_title = F.col("merged") | (several & (F.col("n_first") == 1) & (F.col("n_second") > 1))
    second_title = several & (F.col("n_second") == 1) & (F.col("n_third") > 1)
    titles = F.when(first_title, F.when(second_title, 2).otherwise(1)).otherwise(0)
    header = F.least(F.col("min_row") + titles, "max_row")
    plain = heads.filter(settled).withColumn("header_row", header).drop("merged")
    heads = heads.filter(~settled).drop("merged").withColumn("reach", F.coalesce("reach", F.col("min_row") - 1))
    head_rows = heads.filter(F.col("min_row") < F.col("max_row")).select(
        *ident,
        "min_row",
        "max_row",
        "min_col",
        "max_col",
        F.explode(
            F.sequence(F.col("min_row"), F.least(F.col("max_row"), F.col("reach") + 2))
        ).alias("r"),
    )
    counted = head_rows.join(banded.select(*SHEET, "r", "filled"), [*SHEET, "r"], "left").select(
        *ident,
        "r",
        "min_row",
        "max_row",
        "min_col",
        "max_col",
        F.size(
            F.filter(
                F.coalesce("filled", F.array().cast("array<int>")),
                lambda c: c.between(F.col("min_col"), F.col("max_col")),
            )
        ).alias("n"),
    )
    if merges is None:
        counted = counted.withColumn("merged", F.lit(False))
    else:
        counted = counted.join(_merged_spans(merges, "r"), [*SHEET, "r"], "left").withColumn(
            "merged", _merged("spans")
        )
    # Each row tells its own count to itself and to the row above: an aggregate, not a
    # window, because a chain of merged rows may be as long as the sheet.
    told = counted.select(
        *ident,
        "max_row",
        "merged",
        (F.col("max_col") > F.col("min_col")).alias("wide"),
        "n",
        F.explode(F.array(F.col("r"), F.col("r") - 1)).alias("at"),
        "r",
        "min_row",
    ).filter(F.col("at") >= F.col("min_row"))
    verdicts = told.groupBy(*ident, "max_row", "at").agg(
        F.max(F.when(F.col("r") == F.col("at"), F.col("merged"))).alias("merged"),
        F.max("wide").alias("wide"),
        F.max(F.when(F.col("r") == F.col("at"), F.col("n"))).alias("n"),
        F.max(F.when(F.col("r") > F.col("at"), F.col("n"))).alias("n_next"),
    )
    title = F.col("merged") | (
        F.col("wide") & (F.col("n") == 1) & (F.coalesce("n_next", F.lit(0)) > 1)
    )
    starts = verdicts.groupBy(*ident).agg(
        F.min(F.when(~title & (F.col("at") < F.col("max_row")), F.col("at"))).alias("header_row"),
        F.max("max_row").alias("_max_row"),
    )
    compared = heads.join(
        starts.select(*ident, F.coalesce("header_row", "_max_row").alias("header_row")), ident, "left"
    ).withColumn("header_row", F.coalesce("header_row", "min_row"))
    return (
        plain.unionByName(compared)
        .withColumn("titles", (F.col("header_row") - F.col("min_row")).cast("int"))
        .withColumn("min_row", F.col("header_row"))
        .drop("header_row", "reach", "n_first", "n_second", "n_third", "repeated")
    )


def named_tables(islands: DataFrame) -> DataFrame:
    return islands.withColumn(
        "table_key",
        name_uuid(F.concat_ws("|", "file_id", "sheet", F.col("table_index").cast("string"))),
    ).withColumn("row_count", F.col("max_row") - F.col("min_row"))


def extract_tables(
    islands: DataFrame, banded: DataFrame, bits: int = BLOCK_BITS
) -> tuple[DataFrame, DataFrame]:
    """Cut the rectangles out of the sheets.

    Returns ``tables`` (one row per table, with its header texts) and ``rows``
    (``table_key, row_index, values``). Every row inside a rectangle is a row of its
    band, so rows that are blank in one table because a neighbour is longer survive.
    The join key is (band, row block): a band holding a third of all rows is spread
    over its blocks, and the bounds side repeats once per block only. Headers are met by
    the same key, so that the rows move once for both. The bounds of a task's keys are looked
    up by hash, as they are fewer than the rows, which then need not be sorted.
    """
    named = islands if "table_key" in islands.columns else named_tables(islands)
    bounds = named.select(
        *BAND,
        "table_key",
        "min_row",
        "min_col",
        "max_col",
        F.explode(F.sequence(block("min_row", bits), block("max_row", bits))).alias("_blk"),
    )
    width = F.col("max_col") - F.col("min_col") + 1
    got = F.slice("cells", F.col("min_col") + 1, width)
    whole = F.when(F.size(got) == width, got).otherwise(
        F.concat(got, F.array_repeat(F.lit(""), width - F.size(got)))
    )
    values = F.when(
        F.exists(got, lambda v: v.isNull()), F.transform(whole, lambda v: F.coalesce(v, F.lit("")))
    ).otherwise(whole)
    blocked = banded.withColumn("_blk", block("r", bits))
    cut = (
        blocked.select(*BAND, "_blk", "r", "cells")
        .join(bounds.hint("shuffle_hash"), [*BAND, "_blk"])
        .filter(F.col("r") > F.col("min_row"))
        .select("table_key", (F.col("r") - F.col("min_row") - 1).alias("row_index"), values.alias("values"))
    )
    # The header is one sheet row of each table. Its position is not part of the key.
    top = blocked.select(*BAND, "_blk", "r", "source_file", "cells").join(
        named.withColumn("_blk", block("min_row", bits)).hint("shuffle_hash"), [*BAND, "_blk"]
    )
    tables = top.filter(F.col("r") - F.col("min_row") == 0).withColumn("headers", values).select(
        "table_key",
        "file_id",
        "source_file",
        "sheet",
        "table_index",
        "row_count",
        "headers",
        F.col("min_row").alias("start_row"),
        F.col("min_col").alias("start_col"),
        F.col("max_row").alias("end_row"),
        F.col("max_col").alias("end_col"),
    )
    return tables, cut


def find_tables(
    grid: DataFrame, merges: DataFrame | None = None, bits: int = BLOCK_BITS
) -> tuple[DataFrame, DataFrame]:
    """Grid to ``(tables, rows)``: bands, islands, title rows, extraction.

    The labelled rows feed three steps and the bounds two each, so they are written once: each
    step then reads the columns it needs instead of repeating all shuffles before it.
    """
    banded = written_bands(grid, bits)
    bounds = skip_title_rows(written(written_islands(banded, bits), "numbered-islands"), banded, merges, bits)
    return extract_tables(written(named_tables(bounds), "table-bounds"), banded, bits)


def first_row_tables(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One table per file: row 0 is the header, everything else is data (delimited text)."""
    key = name_uuid(F.concat_ws("|", "file_id", "sheet", F.lit("0")))
    keyed = grid.withColumn("table_key", key)
    counts = keyed.groupBy("table_key").agg(F.max("r").alias("row_count"))
    tables = (
        keyed.filter(F.col("r") == 0)
        .join(counts, "table_key")
        .select(
            "table_key",
            "file_id",
            "source_file",
            "sheet",
            F.lit(0).alias("table_index"),
            "row_count",
            F.col("cells").alias("headers"),
            F.lit(0).cast("bigint").alias("start_row"),
            F.lit(0).alias("start_col"),
            F.col("row_count").alias("end_row"),
            (F.size("cells") - 1).alias("end_col"),
        )
    )
    rows = keyed.filter(F.col("r") > 0).select(
        "table_key", (F.col("r") - 1).alias("row_index"), F.col("cells").alias("values")
    )
    return tables, rows

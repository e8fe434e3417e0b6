"""Position blocks: how long sheets and tables are cut so no key becomes one task.

A sheet or a table may hold a third of all rows, so nothing here windows over, joins
on, or groups by a sheet or table alone. Positions are cut into blocks of
``2**BLOCK_BITS`` consecutive rows; windows run inside a block, and only one summary
row per block travels to the sheet-level step (16,384 times fewer rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 14


def block(pos: Column | str, bits: int = BLOCK_BITS) -> Column:
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.shiftright(c.cast("bigint"), bits)


def label_runs(df: DataFrame, keys: list[str], pos: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``run_start``/``run_end``: the maximal run of consecutive positions of a row.

    Runs are found inside blocks; runs that touch a block edge are chained across
    blocks with one row per block. ``df`` may repeat positions.
    """
    part = [*keys, "_blk"]
    order = Window.partitionBy(*part).orderBy(pos)
    piece = Window.partitionBy(*part, "_grp")
    first, last = F.shiftleft(F.col("_blk"), bits), F.shiftleft(F.col("_blk") + 1, bits) - 1
    pieces = (
        df.withColumn("_blk", block(pos, bits))
        .withColumn("_grp", F.col(pos) - F.dense_rank().over(order))
        .withColumn("_lo", F.min(F.col(pos).cast("bigint")).over(piece))
        .withColumn("_hi", F.max(F.col(pos).cast("bigint")).over(piece))
    )
    edges = pieces.groupBy(*part).agg(
        F.max(F.when(F.col("_lo") == first, F.col("_hi"))).alias("_head_hi"),
        F.min(F.when(F.col("_hi") == last, F.col("_lo"))).alias("_tail_lo"),
    )
    up = Window.partitionBy(*keys).orderBy("_blk")
    down = Window.partitionBy(*keys).orderBy(F.col("_blk").desc())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    whole = F.coalesce(F.col("_head_hi") == last, F.lit(False))
    chained = (
        edges.withColumn(
            "_from_prev",
            F.col("_head_hi").isNotNull()
            & F.coalesce(
                (F.lag("_blk").over(up) == F.col("_blk") - 1)
                & F.lag("_tail_lo").over(up).isNotNull(),
                F.lit(False),
            ),
        )
        .withColumn(
            "_start",
            F.last(F.when(~(whole & F.col("_from_prev")), F.col("_tail_lo")), ignorenulls=True).over(
                up.rowsBetween(*so_far)
            ),
        )
        .withColumn("_head_start", F.when(F.col("_from_prev"), F.lag("_start").over(up)).otherwise(first))
        .withColumn(
            "_to_next",
            F.col("_tail_lo").isNotNull()
            & F.coalesce(
                (F.lag("_blk").over(down) == F.col("_blk") + 1)
                & F.lag("_head_hi").over(down).isNotNull(),
                F.lit(False),
            ),
        )
        .withColumn(
            "_end",
            F.last(F.when(~(whole & F.col("_to_next")), F.col("_head_hi")), ignorenulls=True).over(
                down.rowsBetween(*so_far)
            ),
        )
        .withColumn("_tail_end", F.when(F.col("_to_next"), F.lag("_end").over(down)).otherwise(last))
        .select(*part, "_head_start", "_tail_end")
    )
    return (
        pieces.join(chained, part)
        .withColumn("run_start", F.when(F.col("_lo") == first, F.col("_head_start")).otherwise(F.col("_lo")))
        .withColumn("run_end", F.when(F.col("_hi") == last, F.col("_tail_end")).otherwise(F.col("_hi")))
        .drop("_blk", "_grp", "_lo", "_hi", "_head_start", "_tail_end")
    )


def mark_pieces(df: DataFrame, keys: list[str], pos: str, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``_blk``, ``_lo`` (where the run of consecutive positions around a row begins, seen
    from inside its block) and ``repeated`` (the row before has the same position).

    One sort of a block: all that is asked of other rows is asked in its order.
    """
    order = Window.partitionBy(*keys, "_blk").orderBy(pos)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col(pos).cast("bigint")
    given = F.col(pos).isNotNull()
    for key in keys:
        given = given & F.col(key).isNotNull()
    return (
        df.filter(given)
        .withColumn("_blk", block(pos, bits))
        .withColumn("_step", at - F.lag(at).over(order))
        .withColumn("_lo", F.max(F.when(F.coalesce(F.col("_step"), F.lit(2)) > 1, at)).over(so_far))
        .withColumn("repeated", F.coalesce(F.col("_step") == 0, F.lit(False)))
        .drop("_step")
    )


def run_heads(pieces: DataFrame, keys: list[str], pos: str, bits: int = BLOCK_BITS) -> DataFrame:
    """``_head_start`` of the blocks whose first run goes on from the block before: where it began.

    Of ``mark_pieces`` one row per block is looked at, and only blocks that go on are returned.
    """
    part = [*keys, "_blk"]
    first, last = F.shiftleft(F.col("_blk"), bits), F.shiftleft(F.col("_blk") + 1, bits) - 1
    up = Window.partitionBy(*keys).orderBy("_blk")
    edges = pieces.groupBy(*part).agg(
        (F.min(pos) == first).alias("_at_first"),
        F.when(F.max(pos) == last, F.max("_lo")).alias("_tail_lo"),
    )
    goes_on = F.col("_at_first") & (F.lag("_blk").over(up) == F.col("_blk") - 1) & F.lag("_tail_lo").over(up).isNotNull()
    whole = F.col("_goes_on") & (F.col("_tail_lo") == first)
    return (
        edges.withColumn("_goes_on", F.coalesce(goes_on, F.lit(False)))
        .withColumn(
            "_start",
            F.last(F.when(~whole, F.col("_tail_lo")), ignorenulls=True).over(
                up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("_head_start", F.lag("_start").over(up))
        .filter("_goes_on")
        .select(*part, "_head_start")
    )


def join_heads(
    pieces: DataFrame, heads: DataFrame, keys: list[str], name: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Add ``name``: where the run of consecutive positions around a row begins."""
    goes_on = (F.col("_lo") == F.shiftleft(F.col("_blk"), bits)) & F.col("_head_start").isNotNull()
    return (
        pieces.join(heads, [*keys, "_blk"], "left")
        .withColumn(name, F.when(goes_on, F.col("_head_start")).otherwise(F.col("_lo")))
        .drop("_blk", "_lo", "_head_start")
    )


def number_rows(
    df: DataFrame, keys: list[str], pos: str, order: list[str], name: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Add a 0-based position within ``keys`` by ``order``, whose first column is ``pos``.

    Same as a row number over the keys, but counted per block and shifted by the sum of
    the earlier blocks' counts.
    """
    part = [*keys, "_blk"]
    blocked = df.withColumn("_blk", block(pos, bits))
    before = (
        Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocked.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        blocked.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
        .join(offsets, part)
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("int"))
        .drop("_blk", "_rn", "_before")
    )


def attach_tables(
    rows: DataFrame, tables: DataFrame, fields: list[str], bits: int = BLOCK_BITS
) -> DataFrame:
    """Join per-table ``fields`` to table rows on (table, row block).

    The table side is repeated once per block of its own rows, so a table holding a
    third of all rows spreads over as many join keys as it has blocks, and the repeated
    side stays 2**bits times smaller than the rows. When it is small enough adaptive
    execution broadcasts it from its measured size; nothing is hinted here.
    """
    per_block = tables.select(
        "table_key",
        *fields,
        F.explode(
            F.sequence(F.lit(0).cast("bigint"), block(F.greatest(F.col("row_count") - 1, F.lit(0)), bits))
        ).alias("_blk"),
    )
    return rows.withColumn("_blk", block("row_index", bits)).join(per_block, ["table_key", "_blk"]).drop("_blk")

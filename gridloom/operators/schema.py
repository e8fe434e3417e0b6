"""Column names and inferred column types, for all tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.functions.parse import cell_kind, with_parsed
from gridloom.functions.text import header_base

COLUMN_STRUCT = "array<struct<name:string,original_name:string,type:string>>"


def header_columns(tables: DataFrame) -> DataFrame:
    return tables.select("table_key", F.posexplode("headers").alias("col_index", "original_name"))


def normalize_headers(headers: DataFrame) -> DataFrame:
    """``(table_key, col_index, original_name)`` plus a clean, numbered ``name``.

    The k-th repeat of a base name gets ``_k``. Because only base names are counted the
    result can still collide (``A, A, A_2``); ``storage_name`` is unique. It adds ``__k``,
    which no clean name contains, since runs of other characters collapse to one ``_``.
    """
    base = header_base("original_name")
    position = F.concat(F.lit("col_"), (F.col("col_index") + 1).cast("string"))
    based = headers.withColumn("base", F.when(base == "", position).otherwise(base))
    nth = F.row_number().over(Window.partitionBy("table_key", "base").orderBy("col_index"))
    named = based.withColumn(
        "name", F.when(nth > 1, F.concat_ws("_", "base", nth.cast("string"))).otherwise(F.col("base"))
    )
    again = F.row_number().over(Window.partitionBy("table_key", "name").orderBy("col_index"))
    return named.withColumn(
        "storage_name",
        F.when(again > 1, F.concat_ws("__", "name", again.cast("string"))).otherwise(F.col("name")),
    ).select("table_key", "col_index", "name", "original_name", "storage_name")


def type_counts(rows: DataFrame) -> DataFrame:
    """Per column, how many non-empty cells are of each kind.

    Exploding is narrow and the counts combine on the map side, so a table of any
    length shuffles only a few numbers per column and task.
    """
    cells = rows.select("table_key", F.posexplode("values").alias("col_index", "value"))
    cells = with_parsed(cells, F.col("value")).select("table_key", "col_index", cell_kind().alias("kind"))

    def count_of(*kinds: str):
        return F.count_if(F.col("kind").isin(*kinds))

    return cells.groupBy("table_key", "col_index").agg(
        F.count("kind").alias("n_values"),
        count_of("BOOLEAN").alias("n_boolean"),
        count_of("INTEGER").alias("n_integer"),
        count_of("INTEGER", "DOUBLE").alias("n_double"),
        count_of("DATE").alias("n_date"),
        count_of("TIMESTAMP").alias("n_timestamp"),
    )


def choose_type():
    """First type whose share reaches the threshold; empty columns are VARCHAR."""
    chosen = None
    for name in fixed.COLUMN_TYPES[:-1]:
        enough = (F.col("n_values") > 0) & (
            F.col(f"n_{name.lower()}") / F.col("n_values") >= fixed.TYPE_MATCH_SHARE
        )
        chosen = F.when(enough, F.lit(name)) if chosen is None else chosen.when(enough, F.lit(name))
    return chosen.otherwise(F.lit(fixed.COLUMN_TYPES[-1]))


COUNTS = ("n_values", "n_boolean", "n_integer", "n_double", "n_date", "n_timestamp")


def infer_types(rows: DataFrame, columns: DataFrame, keep_counts: bool = False) -> DataFrame:
    """``columns`` plus ``type``; columns without any cell come out as VARCHAR."""
    typed = columns.join(type_counts(rows), ["table_key", "col_index"], "left").withColumn(
        "type", F.coalesce(choose_type(), F.lit("VARCHAR"))
    )
    return typed if keep_counts else typed.drop(*COUNTS)


def with_schema(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``tables`` plus ``columns``: the ordered array of column structs of each table."""
    packed = columns.groupBy("table_key").agg(
        F.array_sort(
            F.collect_list(F.struct("col_index", "name", "original_name", "storage_name", "type"))
        ).alias("columns")
    )
    return tables.join(packed, "table_key", "left").withColumn(
        "columns", F.coalesce("columns", F.expr("cast(array() as array<struct<col_index:int,name:string,original_name:string,storage_name:string,type:string>>)"))
    )


def describe_tables(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Header names and types for every table."""
    return with_schema(tables, infer_types(rows, normalize_headers(header_columns(tables))))

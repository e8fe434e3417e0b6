"""Typed values: long form for batch work, wide form for one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.parse import SPARK_TYPES, parsed_value, typed_value, with_parsed
from gridloom.functions.text import trim_ws
from gridloom.operators.blocks import attach_tables

VALUE_COLUMNS = {
    "BOOLEAN": "v_bool",
    "INTEGER": "v_long",
    "DOUBLE": "v_double",
    "DATE": "v_date",
    "TIMESTAMP": "v_ts",
    "VARCHAR": "v_string",
}


def storage_schema(columns: list) -> T.StructType:
    """Stored schema of one table from its column structs; everything is nullable."""
    schema = T.StructType()
    for c in columns:
        schema = schema.add(c["storage_name"], T.DataType.fromDDL(SPARK_TYPES[c["type"]]), True)
    return schema


def typed_cells(rows: DataFrame, described: DataFrame, lenient_prefix: bool = False) -> DataFrame:
    """All tables' cells in long form, one typed column filled per cell."""
    cells = attach_tables(rows, described, ["columns"]).select(
        "table_key",
        "row_index",
        F.explode("columns").alias("column"),
        "values",
    )
    parsed = with_parsed(cells, F.get("values", F.col("column.col_index")))
    return parsed.select(
        "table_key",
        "row_index",
        F.col("column.col_index").alias("col_index"),
        *[
            F.when(F.col("column.type") == kind, parsed_value(kind, lenient_prefix)).alias(name)
            for kind, name in VALUE_COLUMNS.items()
        ],
    )


def wide_rows(rows: DataFrame, columns: list, *keep: str, lenient_prefix: bool = False) -> DataFrame:
    """``values`` as the typed columns of one known schema, after the columns to ``keep``.

    A projection of two steps: trimmed cells, then values.
    """
    trimmed = rows.select(
        *keep, *[trim_ws(F.get("values", F.lit(c["col_index"]))).alias(f"_v{c['col_index']}") for c in columns]
    )
    return trimmed.select(
        *keep,
        *[
            typed_value(f"_v{c['col_index']}", c["type"], lenient_prefix).alias(c["storage_name"])
            for c in columns
        ],
    )


def materialize_table(
    rows: DataFrame, columns: list, table_key: str | None = None, lenient_prefix: bool = False
) -> DataFrame:
    """One table as a typed DataFrame: a projection, no pivot and no shuffle."""
    picked = rows if table_key is None else rows.filter(F.col("table_key") == table_key)
    return wide_rows(picked, columns, lenient_prefix=lenient_prefix)


def table_columns(described: DataFrame, table_key: str) -> list:
    """Column structs of one table (one row, bounded by the table's width)."""
    found = described.filter(F.col("table_key") == table_key).select("columns").head(1)
    if not found:
        raise KeyError(f"no table {table_key}")
    return found[0]["columns"]

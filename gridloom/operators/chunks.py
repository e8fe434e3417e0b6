"""Row chunks and the prompts made of sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.functions.text import has_content, name_uuid, table_label, trim_ws
from gridloom.operators.blocks import attach_tables
from gridloom.operators.schema import COLUMN_STRUCT


def _shown_name(column: Column) -> Column:
    return F.when(column["original_name"] == "", column["name"]).otherwise(column["original_name"])


def row_text() -> Column:
    """``Header: value`` pairs of the non-empty cells of a row carrying ``columns``."""

    def pair(column: Column) -> Column:
        value = trim_ws(F.get("values", column["col_index"]))
        return F.when(
            value != "",
            F.concat(_shown_name(column), F.lit(fixed.HEADER_SEPARATOR), value),
        )

    return F.array_join(F.array_compact(F.transform("columns", pair)), fixed.PAIR_SEPARATOR)


def chunk_id() -> Column:
    """Id of a row's coordinates. The file id is not part of it: same-named files share ids."""
    return name_uuid(
        F.concat_ws(
            "|",
            "source_file",
            "sheet",
            F.col("table_index").cast("string"),
            F.col("row_index").cast("string"),
        )
    )


def public_columns() -> Column:
    return F.transform(
        "columns", lambda c: F.struct(c["name"], c["original_name"], c["type"])
    ).cast(COLUMN_STRUCT)


def row_chunks(rows: DataFrame, described: DataFrame) -> DataFrame:
    """One chunk per row with any value; ``row_index`` stays the row's position.

    ``described`` needs the table columns and may carry ``summary`` and ``hyde``.
    """
    extra = {
        name: F.col(name) if name in described.columns else F.lit("") for name in ("summary", "hyde")
    }
    # What is the same for all rows of a table is made once per table, not per row.
    shared = {
        "_labels": F.transform("columns", lambda c: F.concat(_shown_name(c), F.lit(fixed.HEADER_SEPARATOR))),
        "_at": F.transform("columns", lambda c: c["col_index"]),
        "_schema": public_columns(),
    }
    tables = described.select(
        "table_key", "row_count", "file_id", "source_file", "sheet", "table_index",
        *[c.alias(n) for n, c in {**extra, **shared}.items()],
    ).withColumns(
        {
            "_in_place": F.forall(F.transform("_at", lambda at, i: at == i), lambda same: same),
            "_named": F.forall("_labels", lambda label: label.isNotNull()),
        }
    )
    joined = attach_tables(
        rows,
        tables,
        ["file_id", "source_file", "sheet", "table_index", "summary", "hyde", *shared, "_in_place", "_named"],
    )
    # The same as ``row_text``; a cell of a row is looked at once, and the text is not needed to
    # tell that there is any.
    n = F.size("_labels")
    first = F.when(F.size("values") <= n, F.col("values")).otherwise(F.slice("values", F.lit(1), n))
    cells = F.when(F.col("_in_place"), first).otherwise(F.transform("_at", lambda at: F.get("values", at)))
    text = F.array_join(
        F.zip_with(cells, "_labels", lambda v, label: F.when(has_content(v), F.concat(label, trim_ws(v)))), fixed.PAIR_SEPARATOR
    )
    some = F.when(F.col("_named"), F.exists(cells, has_content)).otherwise(text != "")
    return joined.filter(some).withColumn("text", text).select(
        chunk_id().alias("chunk_id"),
        "table_key",
        "file_id",
        "source_file",
        "sheet",
        "table_index",
        "row_index",
        "text",
        "hyde",
        "summary",
        F.col("_schema").alias("schema"),
    )


def _sample_lines(rows: DataFrame, tables: DataFrame, fields: list[str], n: int, line: Column) -> DataFrame:
    """Lines of the first ``n`` row positions of each table, in order, one array per table."""
    head = attach_tables(rows.filter(F.col("row_index") < n), tables, fields)
    return (
        head.select("table_key", F.struct("row_index", line.alias("line")).alias("item"))
        .filter(F.col("item.line").isNotNull())
        .groupBy("table_key")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select("table_key", F.transform("items", lambda i: i["line"]).alias("lines"))
    )


def _closed_lines(lines: Column) -> Column:
    """Lines joined, each followed by a line end."""
    return F.array_join(F.transform(lines, lambda t: F.concat(t, F.lit("\n"))), "")


def _no_lines() -> Column:
    return F.coalesce("lines", F.array().cast("array<string>"))


def question_prompts(rows: DataFrame, described: DataFrame) -> DataFrame:
    """Prompt asking which questions a table answers: typed columns and sample rows.

    The sample is the first 20 row positions; blank rows among them are left out, not
    replaced. The filter keeps at most 20 rows per table before anything is grouped.
    """
    text = row_text()
    sample = _sample_lines(
        rows, described, ["columns"], fixed.QUESTION_SAMPLE_ROWS, F.when(text != "", text)
    )
    column_list = F.array_join(
        F.transform("columns", lambda c: F.concat(_shown_name(c), F.lit(" ("), c["type"], F.lit(")"))), ", "
    )
    return described.join(sample, "table_key", "left").select(
        "table_key",
        F.concat(
            F.lit(fixed.TABLE_LABEL),
            table_label("source_file", "sheet", " / "),
            F.lit(fixed.COLUMNS_LABEL),
            column_list,
            F.lit(fixed.SAMPLE_LABEL),
            _closed_lines(_no_lines()),
        ).alias("prompt"),
    )


def summary_prompts(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Prompt asking for a table summary, from raw headers and the first 30 raw rows."""
    sample = _sample_lines(
        rows,
        tables,
        [],
        fixed.SUMMARY_SAMPLE_ROWS,
        F.array_join("values", fixed.PAIR_SEPARATOR),
    )
    return tables.join(sample, "table_key", "left").select(
        "table_key",
        F.concat(
            F.lit(fixed.TABLE_LABEL),
            table_label("source_file", "sheet", " / "),
            F.lit(fixed.TOTAL_ROWS_LABEL),
            F.col("row_count").cast("string"),
            F.lit(fixed.ORIGINAL_COLUMNS_LABEL),
            F.array_join("headers", ", "),
            F.lit(fixed.SAMPLE_LABEL),
            F.array_join("headers", fixed.PAIR_SEPARATOR),
            F.lit("\n"),
            _closed_lines(_no_lines()),
        ).alias("prompt"),
    )

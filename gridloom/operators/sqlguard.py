"""Checked read-only SQL over one inferred table."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.functions.render import value_text
from gridloom.functions.text import trim_ws


class RejectedSQL(ValueError):
    """A statement the checks do not let through."""


def clean_sql(reply: Column | str) -> Column:
    """A model reply without code fence and without one trailing semicolon."""
    text = trim_ws(reply)
    fenced = text.startswith("```")
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(text)
    body = trim_ws(body)
    body = F.regexp_replace(body, r"```$", "")
    return F.regexp_replace(trim_ws(F.when(fenced, body).otherwise(text)), r";$", "")


def is_irrelevant(statement: Column | str) -> Column:
    c = F.col(statement) if isinstance(statement, str) else statement
    return F.lower(c) == fixed.IRRELEVANT_REPLY


def rejection(statement: Column | str) -> Column:
    """Why a statement is not accepted, or NULL: empty, not a SELECT, or a listed token."""
    text = F.lower(trim_ws(statement))
    reason = F.when(text == "", F.lit("empty query")).when(
        ~text.startswith("select"), F.lit("only SELECT queries are allowed")
    )
    for token in fixed.DISALLOWED_SQL:
        reason = reason.when(F.contains(text, F.lit(token)), F.lit(f"disallowed token: {token.strip()}"))
    return reason


def validate_sql(statements: DataFrame, column: str = "sql") -> DataFrame:
    reason = rejection(column)
    return statements.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def text_rejection(statement: str) -> str | None:
    """The same check for one statement on the driver."""
    text = statement.lower().strip(fixed.WHITE_SPACE)
    if not text:
        return "empty query"
    if not text.startswith("select"):
        return "only SELECT queries are allowed"
    return next((f"disallowed token: {t.strip()}" for t in fixed.DISALLOWED_SQL if t in text), None)


# Spark offers these inside a SELECT; the token list above does not know them.
REACHES_OUT = re.compile(r"\b(java_method|reflect|try_reflect)\s*\(|\busing\s*['\"]", re.IGNORECASE)
# In an analysed plan: leaves that hold the statement's own rows, and expressions that run code or
# tell of the files.
OWN_ROWS = {"OneRowRelation", "LocalRelation", "CTERelationRef"}
OUTSIDE = {"InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CallMethodViaReflection", "TryReflect", "FileSourceMetadataAttribute"}


def open_table(spark: SparkSession, path: str) -> SparkSession:
    """A child session whose only view is ``data``, scanning one stored table.

    Temporary views of the parent are invisible there and paths cannot be queried as
    tables, so a statement reaches nothing but ``data``.
    """
    child = spark.newSession()
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.shuffle.partitions",
        "spark.sql.ansi.enabled",
        "spark.sql.adaptive.enabled",
        "spark.sql.codegen.hugeMethodLimit",
    ):
        child.conf.set(key, spark.conf.get(key))
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    child.read.parquet(path).createOrReplaceTempView(fixed.TABLE_NAME)
    return child


def _check_relations(session: SparkSession, statement: str) -> None:
    """Parsed, the statement must be a query over ``data`` (and its own CTEs) alone."""
    tree = session._jsparkSession.sessionState().sqlParser().parsePlan(statement).toString()
    if "ScriptTransformation" in tree or "Command" in tree.split("\n", 1)[0]:
        raise RejectedSQL("only SELECT queries are allowed")
    # Names of common table expressions only: an alias of a relation makes no table known.
    own = {n.strip().lower() for names in re.findall(r"CTE \[([^\]]*)\]", tree) for n in names.split(",")}
    for found in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", tree):
        name = found.strip().lower()
        if name != fixed.TABLE_NAME and name not in own:
            raise RejectedSQL(f"unknown table {found}")


def run_guarded(session: SparkSession, statement: str) -> DataFrame:
    """Run a checked statement in a session from ``open_table``.

    The text is looked at first, then the analysed plan, which shows what names, views and
    functions really stand for. Raises RejectedSQL, or Spark's own error for a statement that
    does not analyse.
    """
    reason = text_rejection(statement)
    if reason is None and REACHES_OUT.search(statement):
        reason = "the statement reaches outside the table"
    if reason:
        raise RejectedSQL(reason)
    _check_relations(session, statement)
    result = session.sql(statement)
    _check_plan(result._jdf.queryExecution().analyzed(), _files(session.table(fixed.TABLE_NAME)._jdf.queryExecution().analyzed()))
    return result


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _nodes(plan) -> Iterator:
    """A plan's nodes, with those of its subqueries and common table expressions."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += [*_each(node.children()), *_each(node.subqueries())]


def _files(plan) -> set[str]:
    """The folders that a plan's file scans read."""
    found = set()
    for node in _nodes(plan):
        if _kind(node) == "LogicalRelation":
            found |= {p.toString() for p in _each(node.relation().location().rootPaths())}
    return found


def _check_plan(plan, files: set[str]) -> None:
    """Pass an analysed plan that reads nothing but the given files and its own literals.

    Its only view may be ``data``; its leaves may be scans of these files that are no tables of
    the catalog, literal rows, and uses of common table expressions. Whatever else a name, an
    ``IDENTIFIER``, a view or a table function was resolved to is refused, as are expressions
    that run code or tell where the files lie.
    """
    for node in _nodes(plan):
        kind = _kind(node)
        if kind == "View":
            name = node.desc().identifier()
            if name.table() != fixed.TABLE_NAME or name.database().isDefined():
                raise RejectedSQL(f"unknown table {name.unquotedString()}")
        elif kind == "LogicalRelation":
            if node.catalogTable().isDefined() or not _files(node) <= files:
                raise RejectedSQL("unknown table")
        elif node.children().isEmpty() and kind not in OWN_ROWS:
            raise RejectedSQL(f"unknown source of rows {kind}")
        todo = list(_each(node.expressions()))
        while todo:
            expression = todo.pop()
            if _kind(expression) in OUTSIDE or _kind(expression).endswith("UDF"):
                raise RejectedSQL("the statement reaches outside the table")
            todo += _each(expression.children())


def _numbered(result: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """A result under numbers for names, and its columns by name; of equal names the last.

    Names that differ in case only are different names, which numbers keep apart.
    """
    numbered = result.toDF(*[f"_{i}" for i in range(len(result.columns))])
    return numbered, {c: F.col(f"_{i}") for i, c in enumerate(result.columns)}


def row_texts(result: DataFrame) -> DataFrame:
    """Every result row as one text line, columns by name; stays distributed."""
    numbered, columns = _numbered(result)
    return numbered.select(_row_text(numbered, columns).alias("text"))


def _row_text(numbered: DataFrame, columns: dict[str, Column]) -> Column:
    kinds = dict(zip(columns, (numbered.select(c).schema[0].dataType for c in columns.values())))
    return F.concat_ws(fixed.PAIR_SEPARATOR, *[value_text(columns[c], kinds[c]) for c in sorted(columns)])


def header_texts(result: DataFrame) -> tuple[str, str]:
    """Header line and the rule below it."""
    header = fixed.PAIR_SEPARATOR.join(sorted(set(result.columns)))
    return header, "-" * len(header.encode())


def shown_rows(result: DataFrame) -> DataFrame:
    """``(row_no, text, json)`` of every result row, numbers in the order of the result."""
    numbered, columns = _numbered(result)
    record = F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})
    return numbered.select(F.monotonically_increasing_id().alias("row_no"), _row_text(numbered, columns).alias("text"), record.alias("json"))


def _lines() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("row_no", "text"))), lambda r: r["text"])


def prompt_table(result: DataFrame) -> DataFrame:
    """One row, ``table_text``: a whole result as the text a prompt shows."""
    head = F.lit("\n".join(header_texts(result)) + "\n")
    return shown_rows(result).agg(_lines().alias("_lines")).select(
        F.when(F.size("_lines") == 0, F.lit(fixed.NO_ROWS_TEXT)).otherwise(F.concat(head, F.array_join("_lines", "\n"))).alias("table_text")
    )


def prompt_tables(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the result as the text a prompt shows: ``rows(*keys, head, row_no, text)``.

    One text needs all rows of its result in one task; nothing passes the driver.
    """
    return rows.groupBy(*keys, "head").agg(_lines().alias("_lines")).select(
        *keys, F.concat("head", F.lit("\n"), F.array_join("_lines", "\n")).alias("table_text")
    )

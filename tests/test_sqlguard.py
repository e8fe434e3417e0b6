import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridloom import fixed
from gridloom.functions.render import value_text
from gridloom.operators import routing, sqlguard

ACCEPTED = [
    "SELECT * FROM data",
    "  select id, v from data where v > 3  ",
    "SELECT count(*) FROM data -- note",
    "SELECT kind, avg(v) FROM data GROUP BY kind",
    "SELECT a.id FROM data a JOIN data b ON a.id = b.id",
    "SELECT id FROM data UNION SELECT v FROM data",
    "SELECT id FROM (SELECT * FROM data) WHERE v > (SELECT avg(v) FROM data)",
    "SELECT * FROM (WITH t AS (SELECT id FROM data) SELECT * FROM t)",
    "SELECT * FROM IDENTIFIER('data')",
    "SELECT 1 AS one",
    "SELECT * FROM (VALUES (1), (2)) AS v(x)",
    "SELECT explode(array(id, v)) FROM data",
    "SELECT d.id, x FROM data d, LATERAL (SELECT d.id + 1 AS x)",
    "SELECT * FROM data PIVOT (count(id) FOR kind IN ('a', 'b'))",
]
REJECTED = {
    "": "empty query",
    "  \n": "empty query",
    "DROP TABLE data": "only SELECT queries are allowed",
    "WITH t AS (SELECT 1) SELECT * FROM t": "only SELECT queries are allowed",
    "insert into data values (1)": "only SELECT queries are allowed",
    "SELECT last_update FROM data": "disallowed token: update",
    "SELECT workload FROM data": "disallowed token: load",
    "SELECT 1; drop table data": "disallowed token: drop",
    "SELECT * FROM read_csv('x')": "disallowed token: read_csv",
    "SELECT * FROM read_json('x')": "disallowed token: read_json",
    "SELECT 's3://b'": "disallowed token: s3://",
    "SELECT /* x */ 1": "disallowed token: /*",
}
REACHING = [
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM other_table",
    "SELECT * FROM data WHERE id IN (SELECT id FROM secrets)",
    "SELECT (SELECT max(id) FROM default.secrets) FROM data",
    "SELECT java_method('java.lang.System', 'getenv')",
    "SELECT reflect('java.lang.System', 'getenv')",
    "SELECT TRANSFORM(id) USING 'cat' FROM data",
    "SELECT id FROM data; SELECT 2",
    "SELECT * FROM IDENTIFIER('global_temp.payroll')",
    "SELECT id FROM data WHERE id IN (SELECT id FROM IDENTIFIER('global_temp.' || 'payroll'))",
    "SELECT (SELECT max(id) FROM IDENTIFIER('global_temp.literal')) FROM data",
    "SELECT * FROM (WITH t AS (SELECT * FROM IDENTIFIER('global_temp.payroll')) SELECT * FROM t)",
    "SELECT * FROM global_temp.payroll",
    "SELECT * FROM range(3)",
    "SELECT d.* FROM data d, LATERAL (SELECT * FROM range(2)) r",
    "SELECT input_file_name() FROM data",
    "SELECT id FROM data ORDER BY input_file_block_start()",
    "SELECT id, _metadata.file_path FROM data",
    "SELECT id FROM data WHERE exists(SELECT 1 FROM data b WHERE input_file_name() > 'a')",
]


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "d")
    spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(10)], "id bigint, v double, kind string").write.parquet(path)
    spark.range(3).createOrReplaceTempView("secrets")
    spark.range(3).createOrReplaceTempView("other_table")
    spark.createDataFrame([(1,)], "id int").createOrReplaceGlobalTempView("payroll")
    spark.sql("SELECT 1 AS id").createOrReplaceGlobalTempView("literal")
    return path


def test_statement_checks_agree_on_column_and_driver(spark):
    statements = [*ACCEPTED, *REJECTED]
    df = sqlguard.validate_sql(spark.createDataFrame([(s,) for s in statements], "sql string"))
    got = {r.sql: r.reason for r in df.collect()}
    assert got == {**{s: None for s in ACCEPTED}, **REJECTED}
    assert {s: sqlguard.text_rejection(s) for s in statements} == got
    for token in fixed.DISALLOWED_SQL:
        assert sqlguard.text_rejection(f"select x {token}y") is not None


def test_accepted_statements_run(spark, session):
    child = sqlguard.open_table(spark, session)
    for s in ACCEPTED:
        assert sqlguard.run_guarded(child, s).count() > 0, s


@pytest.mark.parametrize("statement", REACHING)
def test_nothing_but_the_table_is_reachable(spark, session, statement):
    child = sqlguard.open_table(spark, session)
    with pytest.raises((sqlguard.RejectedSQL, PySparkException)):
        sqlguard.run_guarded(child, statement)  # refused before anything is read


def test_catalog_tables_are_not_reachable(spark, session):
    spark.sql("CREATE TABLE IF NOT EXISTS hidden USING parquet AS SELECT 1 AS x")
    child = sqlguard.open_table(spark, session)
    for name in ("hidden", "default.hidden", "spark_catalog.default.hidden"):
        with pytest.raises(sqlguard.RejectedSQL):
            sqlguard.run_guarded(child, f"SELECT * FROM {name}")
        with pytest.raises(sqlguard.RejectedSQL):
            sqlguard.run_guarded(child, f"SELECT * FROM data WHERE id IN (SELECT x FROM {name})")
    spark.sql("DROP TABLE hidden")


def test_replies_are_cleaned(spark):
    cases = {
        "```sql\nSELECT 1\n```": "SELECT 1",
        "```\nSELECT 1;\n``` ": "SELECT 1",
        " SELECT 1; ": "SELECT 1",
        "SELECT 1;;": "SELECT 1;",
        "SKIP": "SKIP",
        "```SELECT 1```": "```SELECT 1",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "reply string")
    got = {r.reply: r.s for r in df.select("reply", sqlguard.clean_sql("reply").alias("s")).collect()}
    assert got == cases
    flags = [r[0] for r in df.sparkSession.createDataFrame([("SKIP",), ("skip",), ("skip it",)], "s string").select(sqlguard.is_irrelevant("s")).collect()]
    assert flags == [True, True, False]


def test_rendered_rows(spark):
    df = spark.sql(
        "SELECT 2.0D AS b, 'x' AS a, true AS c, CAST(NULL AS STRING) AS d, DATE'2024-01-05' AS e, "
        "TIMESTAMP'2024-01-05 10:00:00' AS f, 7L AS g"
    )
    assert sqlguard.prompt_table(df).first()[0].split("\n") == [
        "a | b | c | d | e | f | g",
        "-" * 25,
        "x | 2 | true | <nil> | 2024-01-05 00:00:00 +0000 UTC | 2024-01-05 10:00:00 +0000 UTC | 7",
    ]
    assert sqlguard.prompt_table(df.filter("b > 5")).first()[0] == "(no results)"


def test_of_equal_column_names_the_last_counts(spark, session):
    twice = sqlguard.run_guarded(sqlguard.open_table(spark, session), "SELECT id AS x, 1 AS y, id + 1 AS x FROM data WHERE id = 3")
    assert sqlguard.header_texts(twice)[0] == "x | y"
    assert [tuple(r)[1:] for r in sqlguard.shown_rows(twice).collect()] == [("4 | 1", '{"x":4,"y":1}')]


def test_names_may_differ_in_case_only(spark, session):
    both = sqlguard.run_guarded(sqlguard.open_table(spark, session), "SELECT id AS a, id + 1 AS A, kind FROM data WHERE id = 3")
    assert [tuple(r)[1:] for r in sqlguard.shown_rows(both).collect()] == [("4 | 3 | b", '{"a":3,"A":4,"kind":"b"}')]
    assert sqlguard.prompt_table(both).first()[0] == "A | a | kind\n------------\n4 | 3 | b"
    assert sqlguard.row_texts(both).first()[0] == "4 | 3 | b"


def test_another_table_of_files_is_refused(spark, session, tmp_path):
    """The scan of other files, even under the name of the table."""
    spark.range(3).write.parquet(str(tmp_path / "other"))
    child = sqlguard.open_table(spark, session)
    plan = spark.read.parquet(str(tmp_path / "other"))._jdf.queryExecution().analyzed()
    with pytest.raises(sqlguard.RejectedSQL):
        sqlguard._check_plan(plan, sqlguard._files(child.table("data")._jdf.queryExecution().analyzed()))


def test_rendered_doubles(spark):
    cases = {
        0.0: "0", 1.0: "1", -2.5: "-2.5", 123456.0: "123456", 999999.5: "999999.5", 1e6: "1e+06", 1234567.0: "1.234567e+06",
        -1234567.25: "-1.23456725e+06", 1.5e7: "1.5e+07", 123456789.25: "1.2345678925e+08", 1e21: "1e+21", 1e100: "1e+100",
        0.001: "0.001", 0.00012: "0.00012", 0.0001: "0.0001", 9.9e-5: "9.9e-05", -1.25e-7: "-1.25e-07", float("inf"): "+Inf",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    got = {r.x: r.t for r in df.select("x", value_text(F.col("x"), df.schema["x"].dataType).alias("t")).collect()}
    assert got == cases


def candidates(*statements, q="q"):
    return [Row(query_id=q, table_rank=i, table_key="t", sql=s) for i, s in enumerate(statements, 1)]


def test_attempts_stop_at_the_first_rows(spark, session):
    statements = routing.Statements(spark, lambda key: session)
    tried = candidates("skip", "DROP x", "SELECT nope FROM data", "SELECT id FROM data WHERE id > 99", "SELECT max(id) AS m FROM data", "SELECT 1 AS x")
    assert [t[4] for t in routing.first_rows(statements, tried)] == ["skipped", "rejected", "failed", "empty", "rows"]
    statements = routing.Statements(spark, lambda key: session)
    other = candidates("SELECT id FROM data WHERE id > 99", q="r")
    statements.rounds(spark.createDataFrame([*tried, *other]), 6)
    log = statements.log().orderBy("query_id", "table_rank").collect()
    assert [(r.query_id, r.status, r.n_rows) for r in log] == [
        ("q", "skipped", None), ("q", "rejected", None), ("q", "failed", None), ("q", "empty", 0), ("q", "rows", 1), ("r", "empty", 0),
    ]
    assert [r.rows_json for r in log] == [None, None, None, "[]", '[{"m":9}]', "[]"]
    assert [(r.query_id, r.text) for r in statements.rows().collect()] == [("q", "9")]
    none = routing.Statements(spark, lambda key: session)
    assert none.log().count() == 0 and none.rows().count() == 0


def test_statements_run_at_once_and_end_in_time(spark, session):
    slow = "SELECT count(*) AS n FROM data a, data b, data c, data d, data e, data f, data g, data h, data i WHERE a.id + b.id + c.id + d.id + e.id + f.id + g.id + h.id + i.id = -1"
    statements = routing.Statements(spark, lambda key: session, at_once=4, time_limit=8.0)
    mixed = [Row(query_id=f"q{i}", table_rank=1, table_key="t", sql=s) for i, s in enumerate([slow, "SELECT 1 AS x", slow, "SELECT id FROM data", "nonsense", "SELECT 2 AS y"])]
    started = time.monotonic()
    statements.run(mixed)
    took = time.monotonic() - started
    got = {r.query_id: (r.status, r.detail, r.n_rows) for r in statements.attempts().collect()}
    late = ("failed", "time limit", None)
    assert got == {"q0": late, "q1": ("rows", None, 1), "q2": late, "q3": ("rows", None, 10), "q4": ("rejected", "only SELECT queries are allowed", None), "q5": ("rows", None, 1)}
    assert took < 60
    assert {r.query_id for r in statements.rows().collect()} == {"q1", "q3", "q5"}


def test_a_statement_that_was_not_generated_is_told_apart(spark, session):
    statements = routing.Statements(spark, lambda key: session)
    rows = [Row(query_id="a", table_rank=1, table_key="t", sql=None, error="Boom: x"), Row(query_id="b", table_rank=1, table_key="t", sql="", error=None)]
    statements.run(rows)
    assert {(r.query_id, r.status, r.detail) for r in statements.attempts().collect()} == {("a", "not_generated", "Boom: x"), ("b", "rejected", "empty query")}


def test_alias_named_like_a_catalog_table_opens_nothing(spark, tmp_path):
    from gridloom.operators import sqlguard

    spark.sql("CREATE TABLE IF NOT EXISTS payroll_guard USING parquet AS SELECT 1 AS secret")
    try:
        spark.range(3).write.parquet(str(tmp_path / "t"))
        session = sqlguard.open_table(spark, str(tmp_path / "t"))
        for statement in (
            "SELECT b.* FROM data AS payroll_guard JOIN payroll_guard AS b",
            "SELECT 'CTE [payroll_guard]' AS x, secret FROM payroll_guard",
            "SELECT * FROM (SELECT id FROM data) payroll_guard, payroll_guard p",
        ):
            with pytest.raises(sqlguard.RejectedSQL):
                sqlguard.run_guarded(session, statement)
        fine = "SELECT * FROM (WITH few AS (SELECT id FROM data WHERE id < 2) SELECT id FROM few) x"
        assert sqlguard.run_guarded(session, fine).count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS payroll_guard")


def test_a_long_result_becomes_one_prompt_text_in_order(spark):
    rows = sqlguard.shown_rows(spark.range(0, 150_000, 1, 7).orderBy(F.desc("id"))).withColumns({"head": F.lit("id\n--"), "q": F.lit("a")})
    text = sqlguard.prompt_tables(rows, "q").first().table_text.split("\n")
    assert text[:2] == ["id", "--"] and text[2:] == [str(n) for n in range(149_999, -1, -1)]

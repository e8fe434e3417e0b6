import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import parse
from gridloom.operators import schema, typed

TYPED = [
    (["yes", "no", "Y"], "BOOLEAN"),
    (["TRUE", "False"], "BOOLEAN"),
    (["1", "0", "1"], "INTEGER"),
    (["7", "-12", "+4"], "INTEGER"),
    (["9223372036854775807"], "INTEGER"),
    (["9223372036854775808"], "DOUBLE"),
    (["1.5", "2", "-.5e3"], "DOUBLE"),
    (["$1,250.75", "€ 3.10"], "DOUBLE"),
    (["12%", "7.5 %"], "DOUBLE"),
    (["1,250", "3,400"], "VARCHAR"),
    (["-$5.00"], "VARCHAR"),
    (["NaN", "inf", "-Infinity"], "DOUBLE"),
    (["1e999"], "VARCHAR"),
    (["5d", "6f"], "VARCHAR"),
    (["1_000.5"], "DOUBLE"),
    (["0x1p-2"], "DOUBLE"),
    (["2023-11-05", "05.11.2023", "11/05/2023", "2023/11/05", "05 Nov 2023", "Nov 05, 2023", "05-nov-2023"], "DATE"),
    (["2023-02-30"], "VARCHAR"),
    (["5.11.2023"], "VARCHAR"),
    (["05 Abc 2023"], "VARCHAR"),
    (["2023-11-05 10:20:30", "2023-11-05T10:20:30", "2023-11-05T10:20:30Z", "2023-11-05T10:20:30.5+02:00"], "TIMESTAMP"),
    (["05.11.2023 1:02:03", "11/05/2023 23:59:59.999"], "TIMESTAMP"),
    (["2023-11-05 25:00:00"], "VARCHAR"),
    (["2023-11-05", "2023-11-05 10:20:30"], "VARCHAR"),
    (["", "  ", " "], "VARCHAR"),
    (["4", "", " 5 "], "INTEGER"),
    (["1"] * 19 + ["x"], "INTEGER"),
    (["1"] * 18 + ["x"], "VARCHAR"),
    (["1"] * 10 + ["2.5"] * 10, "DOUBLE"),
    (["apple", "pear"], "VARCHAR"),
]


def test_inferred_types(spark):
    rows = [(f"t{i}", n, [v]) for i, (values, _) in enumerate(TYPED) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "table_key string, row_index bigint, values array<string>")
    columns = spark.createDataFrame([(f"t{i}", 0) for i in range(len(TYPED))], "table_key string, col_index int")
    got = {r.table_key: r.type for r in schema.infer_types(df.repartition(5), columns).collect()}
    assert [(v, got[f"t{i}"]) for i, (v, _) in enumerate(TYPED)] == TYPED


def test_column_without_cells_is_text(spark):
    df = spark.createDataFrame([("t", 0, ["1"])], "table_key string, row_index bigint, values array<string>")
    columns = spark.createDataFrame([("t", 0), ("t", 1), ("u", 0)], "table_key string, col_index int")
    got = sorted(tuple(r) for r in schema.infer_types(df, columns).collect())
    assert got == [("t", 0, "INTEGER"), ("t", 1, "VARCHAR"), ("u", 0, "VARCHAR")]


HEADERS = [
    (["Unit Price", "qty"], ["unit_price", "qty"]),
    (["Total ($)", "a--b__c"], ["total", "a_b_c"]),
    (["", "  ", "x"], ["col_1", "col_2", "x"]),
    (["id", "ID", "Id "], ["id", "id_2", "id_3"]),
    (["__lead", "trail__"], ["lead", "trail"]),
    (["2024 q1"], ["2024_q1"]),
    (["Цена товара", "ÉTÉ"], ["цена_товара", "été"]),
    (["A", "A", "A_2"], ["a", "a_2", "a_2"]),
    (["###", "col 1"], ["col_1", "col_1_2"]),
]


def test_header_names(spark):
    rows = [(f"t{i}", n, h) for i, (given, _) in enumerate(HEADERS) for n, h in enumerate(given)]
    df = spark.createDataFrame(rows, "table_key string, col_index int, original_name string")
    got = schema.normalize_headers(df.repartition(4)).orderBy("table_key", "col_index").collect()
    for i, (_, names) in enumerate(HEADERS):
        mine = [r for r in got if r.table_key == f"t{i}"]
        assert [r.name for r in mine] == names
        assert len({r.storage_name for r in mine}) == len(mine)


CELLS = [
    ("BOOLEAN", " Yes ", True),
    ("BOOLEAN", "maybe", False),
    ("BOOLEAN", "", None),
    ("INTEGER", " 42 ", 42),
    ("INTEGER", "12 pcs", None),
    ("DOUBLE", "$1,234.50", 1234.5),
    ("DOUBLE", "45%", 45.0),
    ("DOUBLE", "1,234", None),
    ("DOUBLE", "n/a", None),
    ("DATE", "31 Jan 2024", dt.date(2024, 1, 31)),
    ("DATE", "31-31-2024", None),
    ("TIMESTAMP", "2024-01-31T10:00:00+02:00", dt.datetime(2024, 1, 31, 8)),
    ("TIMESTAMP", "31.01.2024 9:05:00,25", dt.datetime(2024, 1, 31, 9, 5, 0, 250000)),
    ("VARCHAR", " x y\t", "x y"),
    ("VARCHAR", "   ", None),
]


def test_typed_cells(spark):
    for kind in {k for k, _, _ in CELLS}:
        mine = [(n, [raw], want) for n, (k, raw, want) in enumerate(CELLS) if k == kind]
        rows = spark.createDataFrame([("t", n, raw) for n, raw, _ in mine], "table_key string, row_index bigint, values array<string>")
        column = {"col_index": 0, "storage_name": "x", "type": kind}
        wide = typed.wide_rows(rows, [column], "row_index").withColumn(
            "x", F.to_timestamp_ntz(F.col("x").cast("string")) if kind == "TIMESTAMP" else F.col("x")
        )
        got = {r.row_index: r.x for r in wide.collect()}
        assert got == {n: want for n, _, want in mine}, kind


def test_lenient_prefix_reads_leading_numbers(spark):
    df = spark.createDataFrame([("12 pcs",), ("1,234",), ("x",), ("-3.5e2kg",)], "v string")
    got = df.select(
        parse.as_long("v", lenient_prefix=True).alias("i"), parse.as_double("v", lenient_prefix=True).alias("d")
    ).collect()
    assert [(r.i, r.d) for r in got] == [(12, 12.0), (1, 1.0), (None, None), (-3, -350.0)]


def test_storage_schema_is_nullable_and_typed():
    columns = [{"storage_name": k.lower(), "type": k} for k in parse.SPARK_TYPES]
    made = typed.storage_schema(columns)
    assert all(f.nullable for f in made)
    assert [type(f.dataType) for f in made] == [
        T.BooleanType, T.LongType, T.DoubleType, T.DateType, T.TimestampType, T.StringType,
    ]


@pytest.mark.parametrize("zone", ["America/New_York", "UTC"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2024-01-31 10:00:00",)], "v string")
        assert df.select(F.unix_seconds(parse.as_timestamp("v"))).first()[0] == 1706695200
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_signs_around_numbers(spark):
    shown = {"$1,234.5 %": "1234.5", "7%": "7", "€ 8": "8", "1,2": "1,2", " 9.0 ": "9.0", "abc": "abc", "$": "", "": "", "-$3": "-$3", "4 %%": "4", "+infinity": "+infinity"}
    cells = parse.with_parsed(spark.createDataFrame([(v,) for v in shown], "v string"), F.col("v"))
    assert "_bare" in cells.columns
    assert {r.v: r._num for r in cells.collect()} == shown

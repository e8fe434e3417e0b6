import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import chunks as ck
from gridloom.operators import hooks, schema, vectors


@pytest.fixture(scope="module")
def staff(spark):
    tables = spark.createDataFrame(
        [
            ("k", "f", "staff.xlsx", "North", 0, 5, ["Name", " Dept ", "", "Pay"]),
            ("e", "f", "empty.csv", "", 0, 0, ["A", "B"]),
        ],
        "table_key string, file_id string, source_file string, sheet string, table_index int, row_count bigint, headers array<string>",
    )
    rows = spark.createDataFrame(
        [
            ("k", 0, [" Ada ", "R&D", "x", "10.5"]),
            ("k", 1, ["", " ", "", ""]),
            ("k", 2, ["Bob"]),
            ("k", 3, ["Cy", "", "y", "7"]),
            ("k", 4, ["", "Ops", "", "1"]),
        ],
        "table_key string, row_index bigint, values array<string>",
    )
    return schema.describe_tables(tables, rows), rows, tables


def test_row_texts_and_positions(spark, staff):
    described, rows, _ = staff
    got = {r.row_index: r for r in ck.row_chunks(rows, described).collect()}
    assert {i: r.text for i, r in got.items()} == {
        0: "Name: Ada |  Dept : R&D | col_3: x | Pay: 10.5",
        2: "Name: Bob",
        3: "Name: Cy | col_3: y | Pay: 7",
        4: " Dept : Ops | Pay: 1",
    }
    for i, r in got.items():
        assert r.chunk_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"staff.xlsx|North|0|{i}"))
    assert [(c.name, c.original_name, c.type) for c in got[0].schema] == [
        ("name", "Name", "VARCHAR"), ("dept", " Dept ", "VARCHAR"), ("col_3", "", "VARCHAR"), ("pay", "Pay", "DOUBLE"),
    ]


def test_prompts(staff):
    described, rows, tables = staff
    asked = {r.table_key: r.prompt for r in ck.question_prompts(rows, described).collect()}
    assert asked["k"] == (
        "Table: staff.xlsx / North\nColumns: Name (VARCHAR),  Dept  (VARCHAR), col_3 (VARCHAR), Pay (DOUBLE)\n\n"
        "Sample data:\nName: Ada |  Dept : R&D | col_3: x | Pay: 10.5\nName: Bob\nName: Cy | col_3: y | Pay: 7\n"
        " Dept : Ops | Pay: 1\n"
    )
    assert asked["e"] == "Table: empty.csv\nColumns: A (VARCHAR), B (VARCHAR)\n\nSample data:\n"
    told = {r.table_key: r.prompt for r in ck.summary_prompts(rows, tables).collect()}
    assert told["k"] == (
        "Table: staff.xlsx / North\nTotal rows: 5\nColumns (original names): Name,  Dept , , Pay\n\nSample data:\n"
        "Name |  Dept  |  | Pay\n Ada  | R&D | x | 10.5\n |   |  | \nBob\nCy |  | y | 7\n | Ops |  | 1\n"
    )


def test_question_sample_counts_positions_not_rows(spark):
    tables = spark.createDataFrame(
        [("k", "f", "a.csv", "", 0, 40, ["n"])],
        "table_key string, file_id string, source_file string, sheet string, table_index int, row_count bigint, headers array<string>",
    )
    rows = spark.createDataFrame(
        [("k", i, ["" if i % 2 else str(i)]) for i in range(40)], "table_key string, row_index bigint, values array<string>"
    ).repartition(6)
    prompt = ck.question_prompts(rows, schema.describe_tables(tables, rows)).first().prompt
    assert prompt.split("Sample data:\n")[1].splitlines() == [f"n: {i}" for i in range(0, 20, 2)]


def test_long_table_spreads_over_blocks(spark):
    n = 300
    tables = spark.createDataFrame(
        [("k", "f", "a.csv", "", 0, n, ["n"])],
        "table_key string, file_id string, source_file string, sheet string, table_index int, row_count bigint, headers array<string>",
    )
    rows = spark.range(n).select(F.lit("k").alias("table_key"), F.col("id").alias("row_index"))
    for bits in (2, 5, 14):
        joined = ck.attach_tables(rows, tables, ["source_file"], bits)
        assert joined.count() == n and joined.select("row_index").distinct().count() == n


def test_model_replies(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)] + [(20, None)], "i int, prompt string").repartition(3)
    replied = hooks.completions(df, "prompt", "reply", lambda system, p: f"  {system}:{p}\n", "s")
    assert {r.i: r.reply for r in replied.collect()} == {**{i: f"s:p{i}" for i in range(20)}, 20: None}
    assert {r.reply for r in hooks.completions(df, "prompt", "reply", None).collect()} == {""}

    def fails(system, prompt):
        raise RuntimeError("no model")

    assert hooks.completions(df, "prompt", "reply", fails, tolerate_errors=True).filter("reply = ''").count() == 20
    with pytest.raises(Exception, match="no model"):
        hooks.completions(df, "prompt", "reply", fails).collect()


def test_embedding_batches(spark):
    df = spark.createDataFrame([(i, f"w{i}") for i in range(250)], "i int, text string").coalesce(1)

    def sizes(texts):
        assert len(texts) <= 96
        return [[float(t[1:]), float(len(texts))] for t in texts]

    got = df.select("i", hooks.embeddings("text", sizes).alias("v")).collect()
    assert all(r.v[0] == r.i for r in got)
    assert sorted({r.v[1] for r in got}) == [58.0, 96.0]
    with pytest.raises(Exception, match="asked for"):
        df.select(hooks.embeddings("text", lambda t: [[1.0]])).collect()


TEXTS = ["Name: Ada | Pay: 10.5", "", "a b c", "ё я", "cat Cat CAT dog", "x-ray 42 été ÉTÉ", "!!"]


def loop_terms(text):
    out, word = [], ""
    for ch in text.lower() + " ":
        if ch.isalpha() or ch.isdecimal():
            word += ch
        else:
            if len(word.encode()) >= 2:
                out.append(word)
            word = ""
    return out


def loop_fnv(word):
    h = 2166136261
    for b in word.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def test_terms_hashes_and_weights(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r.t for r in df.select("i", tx.terms("text").alias("t")).collect()}
    assert got == {i: loop_terms(t) for i, t in enumerate(TEXTS)}
    words = sorted({w for t in TEXTS for w in loop_terms(t)} | {"", "name"})
    hashes = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.fnv1a("w").alias("h"), tx.term_bucket("w").alias("b"))
    for r in hashes.collect():
        assert r.h == loop_fnv(r.w) and r.b == loop_fnv(r.w) % 2**20
    sparse = {r.i: r for r in vectors.with_sparse(df, "i").collect()}
    for i, t in enumerate(TEXTS):
        kept = pd.Series(loop_terms(t), dtype=object).value_counts()
        assert {s.idx: s.tf for s in sparse[i].sparse} == {loop_fnv(w) % 2**20: n for w, n in kept.items()}
        assert abs(sum(s.w for s in sparse[i].sparse) - (1 if len(kept) else 0)) < 1e-6


def test_colliding_terms_are_summed(spark, monkeypatch):
    monkeypatch.setattr(vectors, "term_bucket", lambda c: F.lit(7))
    df = spark.createDataFrame([(1, "one two three two")], "i int, text string")
    assert [tuple(r)[:4] for r in vectors.postings(df, "i").collect()] == [(1, 7, 4, 4)]

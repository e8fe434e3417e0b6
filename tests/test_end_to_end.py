"""Files to answers with a scripted model, deletion, and streaming."""

import re

import pytest

import workbook as wb
from pyspark.sql import functions as F

from gridloom.operators.hooks import hashed_embedding
from gridloom.operators.runlog import ingest_metrics, query_metrics
from gridloom.plans.answer import answer, search
from gridloom.plans.ingest import Store, delete_file, ingest
from gridloom.sources import catalog
from gridloom.streaming.ingest import watch_files

EMBED = hashed_embedding(32)


def scripted_model():
    def model(system, prompt):
        if "Total rows:" in prompt:
            if "broken" in prompt:
                raise RuntimeError("no summary")
            return " about " + re.search(r"Table: (\S+)", prompt).group(1) + " "
        if "\nColumns: " in prompt:
            return "What?\nWhich?"
        if "Table name: data" in prompt:
            if "region" not in prompt.split("Question:")[0]:
                return "SKIP"
            if "average" in prompt:
                return "```sql\nSELECT region, avg(amount) AS mean FROM data GROUP BY region;\n```"
            if "explode" in prompt:
                return "DELETE FROM data"
            return "SELECT region FROM data WHERE amount > 1e9"
        if "SQL query executed:" in prompt:
            return "from rows: " + prompt.split("Results:\n")[1].split("\n\n")[0].replace("\n", "/")
        return "from text"

    return model


MODEL = scripted_model()


def files(folder):
    folder.mkdir(exist_ok=True)
    (folder / "sales.csv").write_text("Region,Amount,Sold on\nNorth,10.5,2024-01-01\nSouth,20,2024-01-02\nNorth,1.5,2024-01-03\n")
    (folder / "people.csv").write_text("Name,Team\nAda,Blue\nBob,Red\nCy,Blue\n")
    (folder / "broken.csv").write_text("only,header\n")
    (folder / "notes.txt").write_text("x")
    wb.write(
        folder / "book.xlsx",
        {"Plan": {**wb.grid([["Plan 2024"], ["City", "Budget"], ["Rome", 5], ["Oslo", 7]]), **wb.grid([["Code"], ["z1"]], (6, 4))}},
        {"Plan": ["A1:B1"]},
    )
    return str(folder)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("e2e")
    store = Store(str(base / "store"), index_buckets=4, catalog_buckets=2)
    path = files(base / "in")
    return store, path, ingest(spark, path, store, EMBED, MODEL)


def ids(spark, store):
    return {r.filename: r.id for r in catalog.list_files(spark, store.catalog).collect()}


def index_texts(spark, store):
    return sorted((r.source_file, r.sheet, r.table_index, r.row_index, r.text) for r in store.index.read(spark).collect())


def test_ingest_fills_everything(spark, loaded):
    store, _, done = loaded
    assert index_texts(spark, store) == [
        ("book.xlsx", "Plan", 0, 0, "City: Rome | Budget: 5"),
        ("book.xlsx", "Plan", 0, 1, "City: Oslo | Budget: 7"),
        ("book.xlsx", "Plan", 1, 0, "Code: z1"),
        ("people.csv", "", 0, 0, "Name: Ada | Team: Blue"),
        ("people.csv", "", 0, 1, "Name: Bob | Team: Red"),
        ("people.csv", "", 0, 2, "Name: Cy | Team: Blue"),
        ("sales.csv", "", 0, 0, "Region: North | Amount: 10.5 | Sold on: 2024-01-01"),
        ("sales.csv", "", 0, 1, "Region: South | Amount: 20 | Sold on: 2024-01-02"),
        ("sales.csv", "", 0, 2, "Region: North | Amount: 1.5 | Sold on: 2024-01-03"),
    ]
    rejected = {r.path.rsplit("/", 1)[1]: r.reason for r in done.rejected.collect()}
    assert rejected == {"notes.txt": "unsupported file type: .txt", "broken.csv": "all tables produced zero chunks"}
    records = {r.filename: r for r in catalog.list_files(spark, store.catalog).collect()}
    assert {n: (r.tables_found, r.chunks_count) for n, r in records.items()} == {
        "sales.csv": (1, 3), "people.csv": (1, 3), "book.xlsx": (2, 3), "broken.csv": (1, 0),
    }
    assert records["sales.csv"].tables[0].summary == "about sales.csv" and records["broken.csv"].tables[0].summary == ""
    row = store.index.read(spark).filter("source_file = 'sales.csv'").first()
    assert row.hyde == "What?\nWhich?" and len(row.dense) == 32 and len(row.sparse) > 0
    schema = catalog.file_schema(catalog.list_files(spark, store.catalog).filter("filename = 'sales.csv'"))
    assert [(r.name, r.original_name, r.type) for r in schema.orderBy("col_index").collect()] == [
        ("region", "Region", "VARCHAR"), ("amount", "Amount", "DOUBLE"), ("sold_on", "Sold on", "DATE"),
    ]
    table = spark.read.parquet(store.table_path(row.table_key))
    assert dict(table.dtypes) == {"region": "string", "amount": "double", "sold_on": "date"}
    total = ingest_metrics(spark.read.parquet(store.ingest_log)).first()
    assert (total.files_processed, total.tables_processed, total.chunks_created) == (4, 5, 9)


def test_answers(spark, loaded):
    store, _, _ = loaded
    questions = spark.createDataFrame(
        [("q1", "average amount by region", 5), ("q2", "region explode", 0), ("q3", "region of nothing", None)],
        "query_id string, question string, top_k int",
    )
    got = {r.query_id: r for r in answer(spark, store, questions, EMBED, MODEL).collect()}
    assert got["q1"].route == "sql"
    head, rule, *rows = got["q1"].answer.removeprefix("from rows: ").split("/")
    assert (head, rule, sorted(rows)) == ("mean | region", "-" * 13, ["20 | South", "6 | North"])
    assert [a.n_rows for a in got["q1"].sql_attempts] == [2] and len(got["q1"].sources) == 5
    assert got["q2"].route == "text" and got["q2"].answer == "from text" and got["q2"].sql_attempts == []
    assert got["q3"].route == "text" and [a.n_rows for a in got["q3"].sql_attempts] == [0]
    assert len({(s.table_key) for s in got["q2"].sources}) >= 3
    seen = query_metrics(spark.read.parquet(store.query_log)).first()
    assert (seen.requests_total, seen.sql_path, seen.text_path) == (3, 1, 2) and seen.mean_ms > 0
    plain = {r.query_id: r for r in answer(spark, store, questions, EMBED).collect()}
    assert {r.route for r in plain.values()} == {"text"} and plain["q1"].answer.count("\n") == 2


def test_a_failed_call_concerns_its_question_only(spark, loaded):
    store, _, _ = loaded

    def failing(system, prompt):
        if "Table name: data" in prompt and "statement fails" in prompt:
            raise RuntimeError("no statement")
        if "SQL query executed:" in prompt and "reply fails" in prompt:
            raise RuntimeError("no reply")
        if "Context (table rows):" in prompt and "text fails" in prompt:
            raise RuntimeError("no text")
        return MODEL(system, prompt)

    questions = spark.createDataFrame(
        [("fine", "average amount by region", 5), ("a", "average region statement fails", 5), ("b", "average amount by region reply fails", 5), ("c", "region explode text fails", 5)],
        "query_id string, question string, top_k int",
    )
    got = {r.query_id: r for r in answer(spark, store, questions, EMBED, failing).collect()}
    assert got["fine"].route == "sql" and got["fine"].error is None
    assert (got["a"].route, got["a"].answer, got["a"].sql_attempts) == ("text", "from text", [])
    assert (got["b"].route, got["b"].answer) == ("text", "from text")
    (tried,) = got["b"].sql_attempts
    assert (tried.source_file, tried.sheet, tried.table_index, tried.n_rows) == ("sales.csv", "", 0, 2)
    assert (got["c"].route, got["c"].answer, got["c"].error) == ("text", None, "RuntimeError: no text")
    assert len(got["c"].sources) == 5


def test_search_ranks_matching_rows_first(spark, loaded):
    store, _, _ = loaded
    asked = spark.createDataFrame([("q", "City Oslo Budget", 2)], "query_id string, question string, top_k int")
    hits = search(spark, store, asked, EMBED).orderBy("rank").collect()
    assert hits[0].text == "City: Oslo | Budget: 7" and [h["rank"] for h in hits] == list(range(1, len(hits) + 1))


def test_no_hits(spark, tmp_path):
    store = Store(str(tmp_path / "none"), 2, 2).create(spark)
    asked = spark.createDataFrame([("q", "anything")], "query_id string, question string")
    got = answer(spark, store, asked, EMBED, MODEL).first()
    assert got.answer == "No relevant data found." and got.route == "none" and got.sources == []


def test_a_scope_removes_what_was_written_in_it(spark, tmp_path):
    import os

    from gridloom.session import scratch, work_root

    folder = work_root(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        store = Store(str(tmp_path / "store"), 2, 2)
        path = files(tmp_path / "in")
        ingest(spark, path, store, EMBED)
        asked = spark.createDataFrame([("q", "City Oslo")], "query_id string, question string")
        assert answer(spark, store, asked, EMBED).first().route == "text"
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before and store.index.read(spark).count() == 9


def test_repeat_then_delete(spark, tmp_path):
    store = Store(str(tmp_path / "store"), 4, 2)
    path = files(tmp_path / "in")
    ingest(spark, path, store, EMBED)
    before = index_texts(spark, store)
    ingest(spark, path, store, EMBED)
    assert index_texts(spark, store) == before and len(ids(spark, store)) == 4
    book = ids(spark, store)["book.xlsx"]
    keys = catalog.get_file(spark, store.catalog, book).table_keys
    assert delete_file(spark, store, book) == []
    assert index_texts(spark, store) == [r for r in before if r[0] != "book.xlsx"]
    assert "book.xlsx" not in ids(spark, store)
    for key in keys:
        with pytest.raises(Exception):
            spark.read.parquet(store.table_path(key))
    with pytest.raises(LookupError):
        delete_file(spark, store, book)


def test_stream_of_files_equals_one_batch(spark, tmp_path):
    path = files(tmp_path / "in")
    batch, streamed = Store(str(tmp_path / "b"), 4, 2), Store(str(tmp_path / "s"), 4, 2)
    ingest(spark, path, batch, EMBED)
    for _ in range(2):  # the second run finds nothing new
        watch_files(spark, path, streamed, str(tmp_path / "cp"), EMBED).awaitTermination()
    assert index_texts(spark, streamed) == index_texts(spark, batch)
    (tmp_path / "in" / "late.csv").write_text("K\nv\n")
    watch_files(spark, path, streamed, str(tmp_path / "cp"), EMBED).awaitTermination()
    assert ("late.csv", "", 0, 0, "K: v") in index_texts(spark, streamed)
    assert spark.read.parquet(streamed.ingest_log).agg(F.sum("files")).first()[0] == 5

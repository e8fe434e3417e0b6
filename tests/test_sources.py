import random

import numpy as np
import pytest

import workbook as wb
from pyspark.sql import functions as F

from gridloom.operators import grid as g
from gridloom.operators import schema
from gridloom.operators.sqlguard import open_table, run_guarded
from gridloom.sources import catalog, tables
from gridloom.sources.csv import scan_csv, split_fields, states_before
from gridloom.sources.listing import list_files, paths_for
from gridloom.sources import store as store_module
from gridloom.sources.store import KeyedStore
from gridloom.sources.xlsx import scan_xlsx


def cells_by_file(grid):
    out = {}
    for r in grid.orderBy("source_file", "r").collect():
        out.setdefault(r.source_file, []).append((r.r, r.cells))
    return out


def test_fields_of_a_line(spark):
    cases = {
        "a,b,c": ["a", "b", "c"],
        "a,,": ["a", "", ""],
        ",": ["", ""],
        '"x, y",2': ["x, y", "2"],
        '"say ""hi""",2': ['say "hi"', "2"],
        'plain "quoted" word,2': ['plain "quoted" word', "2"],
        '"a "b" c",d': ['a "b" c', "d"],
        '"",""': ["", ""],
        " padded , x": [" padded ", " x"],
        '1,"two"': ["1", "two"],
        ',"x"': ["", "x"],
        '"a"",b","c"': ['a",b', "c"],
        '"open, to the ""end""': ['open, to the "end"'],
        '1,"': ["1", ""],
        'x"y,"a"b",""""': ['x"y', 'a"b', '"'],
        '"line\nbreak","' + "q" * 20000 + '""' * 5000 + '"': ["line\nbreak", "q" * 20000 + '"' * 5000],
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string")
    got = {r.line: r.f for r in df.select("line", split_fields(F.col("line")).alias("f")).collect()}
    assert got == cases


def test_csv_rows_and_positions(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("id,name\r\n1,x\r\n\r\n2,y,extra\n3\n", newline="")
    (tmp_path / "q.csv").write_text('k,"long\nname",z\n1,"two\nlines",""\n2,"it ""is""",5\n')
    (tmp_path / "plus+100%.csv").write_text("h\n")
    (tmp_path / "empty.csv").write_text("")
    got = cells_by_file(scan_csv(spark, [str(tmp_path)]))
    assert got == {
        "a b.csv": [(0, ["id", "name"]), (1, ["1", "x"]), (2, ["2", "y", "extra"]), (3, ["3"])],
        "q.csv": [(0, ["k", "long\nname", "z"]), (1, ["1", "two\nlines", ""]), (2, ["2", 'it "is"', "5"])],
        "plus+100%.csv": [(0, ["h"])],
    }


def test_large_csv_is_split_and_still_in_order(spark, tmp_path):
    n = 20000
    (tmp_path / "big.csv").write_text("n,twice\n" + "".join(f"{i},{2 * i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        grid = scan_csv(spark, [str(tmp_path / "big.csv")])
        wrong = grid.filter((F.col("r") > 0) & (F.col("cells")[0].cast("bigint") != F.col("r") - 1))
        assert grid.count() == n + 1 and wrong.count() == 0
        assert grid.filter("r = 0").first().cells == ["n", "twice"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def records_of(text):
    """The rules, one character after the other, over a whole file."""
    lines = text.split("\n")
    lines = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]
    records, cells, quoted = [], [], None
    for line in lines:
        if quoted is None and not line:
            continue
        if quoted is None:
            cells, at, fresh = [], 0, True
        else:
            quoted += "\n"
            at, fresh = 0, False
        while True:
            if fresh and not line.startswith('"', at):
                end = line.find(",", at)
                cells.append(line[at:] if end < 0 else line[at:end])
                if end < 0:
                    break
                at = end + 1
                continue
            if fresh:
                quoted, at, fresh = "", at + 1, False
            if at >= len(line):
                break
            if line[at] != '"':
                quoted += line[at]
                at += 1
            elif line[at + 1 : at + 2] == '"':
                quoted += '"'
                at += 2
            elif at + 1 == len(line) or line[at + 1] == ",":
                cells.append(quoted)
                quoted, at, fresh = None, at + 2, True
                if at == len(line) + 1:
                    break
            else:
                quoted += '"'
                at += 1
        if quoted is None:
            records.append(cells)
    if quoted is not None:
        records.append([*cells, quoted])
    return records


def csv_texts(n, seed):
    random.seed(seed)
    bits = ['"', '"', ",", "\n", "\n", "\r\n", "a", "b c", '""', "", '",', ',"', "\r", "é\u2028"]
    return ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(n)]


def expected_cells(texts):
    return {f"f{i}.csv": list(enumerate(records_of(t))) for i, t in enumerate(texts) if records_of(t)}


def test_any_text_has_the_records_of_the_rules(spark, tmp_path):
    texts = [*csv_texts(300, 1), "", '"', '""', '"\n"', 'a,"b\n\nc"\n\nd', "3,x,extra\n4\n1,5\" pipe\n", '"x\r\ny"\r\n']
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_text(t, newline="", encoding="utf-8")
    assert cells_by_file(scan_csv(spark, [str(tmp_path)])) == expected_cells(texts)


@pytest.mark.parametrize("size", [150, 500])
def test_splits_may_begin_inside_quoted_fields(spark, tmp_path, size):
    random.seed(size)
    long = '"' + 'x\n,"" y\n' * 60 + '",z\n'
    texts = [*csv_texts(6, size), "\n".join(csv_texts(12, size + 1)), "h,k\n" + long * 3 + 'stray 5" pipe,1\n2,"a "b" c"\n' + long]
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_text(t, newline="", encoding="utf-8")
    changed = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        got = cells_by_file(scan_csv(spark, [str(tmp_path)]))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == expected_cells(texts)


def test_states_of_lines():
    maps = np.array([0, 3, 0, 2, 3, 3, 1, 3])
    for start in (False, True):
        state, expected = start, []
        for m in maps:
            expected.append(state)
            state = {0: state, 1: False, 2: True, 3: not state}[int(m)]
        assert states_before(maps, start).tolist() == [*expected, state]


def test_listing_and_dispatch(spark, tmp_path):
    for name in ("a.csv", "B.CSV", "c.xlsx", "d.txt", "noext"):
        (tmp_path / name).write_bytes(b"x")
    files = list_files(spark, str(tmp_path))
    assert sorted(p.rsplit("/", 1)[1] for p in paths_for(files, "csv")) == ["B.CSV", "a.csv"]
    assert len(paths_for(files, "xlsx")) == 1
    bad = {r.path.rsplit("/", 1)[1]: r.reason for r in files.filter("reason is not null").collect()}
    assert bad == {"d.txt": "unsupported file type: .txt", "noext": "unsupported file type: "}


BOOKS = {
    "side.xlsx": ({"S": {**wb.grid([["A", "B"], [1, 2]]), **wb.grid([["X", "Y"], [3, 4]], (0, 3))}}, None),
    "sheets.xlsx": ({"Jan": wb.grid([["Month", "N"], ["Jan", 1]]), "Feb": wb.grid([["Month", "M"], ["Feb", 2]])}, None),
    "title.xlsx": ({"S": wb.grid([["Report"], ["Month", "Kind", "Sum", "Gain"], ["Jan", "x", 1, 0.5]])}, {"S": ["A1:D1"]}),
    "offset.xlsx": ({"S": wb.grid([["ID", "Val"], [1, 2], [3, 4]], (3, 2))}, None),
    "phantom.xlsx": ({"S": wb.grid([["N", "S", "P1", "P2"], ["a", 1], ["b", 2]])}, None),
}


@pytest.mark.parametrize("shared", [False, True])
def test_workbooks(spark, tmp_path, shared):
    for name, (sheets, merges) in BOOKS.items():
        wb.write(tmp_path / name, sheets, merges, shared)
    (tmp_path / "broken.xlsx").write_bytes(b"not a zip")
    grid, merges, bad = scan_xlsx(spark, [str(tmp_path)])
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["broken.xlsx"]
    tables_, rows = g.find_tables(grid, merges)
    found = sorted((t.source_file, t.sheet, t.table_index, t.headers, t.row_count) for t in tables_.collect())
    assert found == [
        ("offset.xlsx", "S", 0, ["ID", "Val"], 2),
        ("phantom.xlsx", "S", 0, ["N", "S"], 2),
        ("sheets.xlsx", "Feb", 0, ["Month", "M"], 1),
        ("sheets.xlsx", "Jan", 0, ["Month", "N"], 1),
        ("side.xlsx", "S", 0, ["A", "B"], 1),
        ("side.xlsx", "S", 1, ["X", "Y"], 1),
        ("title.xlsx", "S", 0, ["Month", "Kind", "Sum", "Gain"], 1),
    ]
    assert ["Jan", "x", "1", "0.5"] in [r["values"] for r in rows.collect()]


def test_displayed_values(spark, tmp_path):
    cells = wb.grid([["a", True, False, 1.0, 2.5, 1e21, 0.1 + 0.2, (45322, 1), (45322, 2), 12345678901234567, 1e-7]])
    wb.write(tmp_path / "v.xlsx", {"S": cells})
    grid, _, _ = scan_xlsx(spark, [str(tmp_path / "v.xlsx")])
    assert grid.first().cells == [
        "a", "TRUE", "FALSE", "1", "2.5", "1000000000000000000000", "0.3", "01-31-24", "2024-01-31",
        "1.23456789012346E+16", "0.0000001",
    ]


def stored(spark, root):
    t = spark.createDataFrame(
        [("k1", "f", "a.csv", "", 0, 3, ["ID", "Name", "When", "OK", "V"]), ("k2", "f", "b.csv", "", 0, 0, ["A", "A"]),
         ("k3", "f", "c.csv", "", 0, 1, ["ID", "Name", "When", "OK", "V"])],
        "table_key string, file_id string, source_file string, sheet string, table_index int, row_count bigint, headers array<string>",
    )
    r = spark.createDataFrame(
        [("k1", 0, ["1", "x", "2024-01-05", "yes", "1.5"]), ("k1", 1, ["2", "", "2024-01-06", "no", ""]),
         ("k1", 2, ["3", "z", "", "", "2"]), ("k3", 0, ["9", "w", "2024-02-01", "t", "0.5"])],
        "table_key string, row_index bigint, values array<string>",
    )
    described = schema.describe_tables(t, r)
    tables.write_tables(r, described, root)
    return described


def test_typed_tables_on_disk(spark, tmp_path):
    root = str(tmp_path / "t")
    for _ in range(2):  # a repeated run replaces its own output
        stored(spark, root)
    one = tables.read_table(spark, root, "k1")
    assert dict(one.dtypes) == {"id": "bigint", "name": "string", "when": "date", "ok": "boolean", "v": "double"}
    assert one.count() == 3 and one.filter("name is null").count() == 1 and one.filter("v is null").count() == 1
    empty = tables.read_table(spark, root, "k2")
    assert empty.count() == 0 and empty.columns == ["a", "a_2"]
    assert tables.read_table(spark, root, "k3").first().id == 9
    got = run_guarded(open_table(spark, tables.table_path(root, "k1")), "SELECT sum(id) AS s FROM data").first()
    assert got.s == 6
    assert tables.drop_folders(spark, [tables.table_path(root, "k1")]) == []
    with pytest.raises(Exception):
        tables.read_table(spark, root, "k1")


ITEMS = "chunk_id string, file_id string, n bigint"


def test_store_upsert_delete(spark, tmp_path, rows_of):
    store = KeyedStore(str(tmp_path / "s"), "chunk_id", ITEMS, 4).create(spark)
    assert store.create(spark).read(spark).count() == 0
    first = spark.createDataFrame([(f"c{i}", "f1" if i % 2 else "f2", i) for i in range(40)], ITEMS)
    store.upsert(first)
    once = rows_of(store.read(spark))
    store.upsert(first)
    assert rows_of(store.read(spark)) == once == rows_of(first)
    # A shorter second version of a file replaces what it names and leaves the rest.
    store.upsert(spark.createDataFrame([("c1", "f1", 100), ("c1", "f1", 101), ("new", "f3", 1)], ITEMS), "n")
    expected = {("c1", "f1", 101), ("new", "f3", 1)} | {r for r in once if r[0] != "c1"}
    assert set(rows_of(store.read(spark))) == expected
    store.delete(spark, F.col("file_id") == "f1")
    assert set(rows_of(store.read(spark))) == {r for r in expected if r[1] != "f1"}
    store.delete(spark, F.col("n") >= 0)  # every bucket left empty
    assert store.read(spark).count() == 0
    store.delete(spark, F.col("n") >= 0)
    store.upsert(first)
    assert rows_of(store.read(spark)) == once


def folders(path):
    return sorted(p.name for p in path.iterdir() if p.name.startswith("seg-"))


def test_a_batch_is_one_small_segment(spark, tmp_path, rows_of):
    root = tmp_path / "s"
    store = KeyedStore(str(root), "chunk_id", ITEMS, 4).create(spark)
    store.upsert(spark.range(5000).selectExpr("concat('c', id) chunk_id", "'f' file_id", "id n"))
    before = {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}
    store.upsert(spark.createDataFrame([("c7", "f", -7)], ITEMS))
    (new,) = set(folders(root)) - {p.parent.name for p in before}
    assert len(list((root / new).glob("*.parquet"))) == 1 and {p: p.stat().st_mtime_ns for p in before} == before
    got = dict(store.read(spark).select("chunk_id", "n").collect())
    assert len(got) == 5000 and got["c7"] == -7 and got["c8"] == 8
    # The base moves through no exchange and a condition reaches its scan.
    text = store.read(spark).filter("n = 8")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "EqualTo(n,8)" in text


def test_a_change_that_ended_half_way_never_began(spark, tmp_path, rows_of):
    root = tmp_path / "s"
    store = KeyedStore(str(root), "chunk_id", ITEMS, 2).create(spark)
    rows = [(f"c{i}", "f", i) for i in range(20)]
    store.upsert(spark.createDataFrame(rows, ITEMS))
    store.upsert(spark.createDataFrame([("c1", "g", 100)], ITEMS))
    (root / folders(root)[-1] / "_SUCCESS").unlink()
    assert rows_of(store.read(spark)) == sorted(rows)
    store.upsert(spark.createDataFrame([("c1", "g", 100)], ITEMS))
    expected = {r for r in rows if r[0] != "c1"} | {("c1", "g", 100)}
    assert set(rows_of(store.read(spark))) == expected
    # So it is with a compaction, whose segment is left aside and made anew.
    store.compact(spark)
    assert set(rows_of(store.read(spark))) == expected and store.segments(spark)[1] == []
    (root / [f for f in folders(root) if f.startswith("seg-000000000000-000000000003")][0] / "_SUCCESS").unlink()
    assert set(rows_of(store.read(spark))) == expected
    store.compact(spark)
    assert set(rows_of(store.read(spark))) == expected


def test_many_changes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "SEGMENTS", 3)
    root = tmp_path / "s"
    store, now = KeyedStore(str(root), "chunk_id", ITEMS, 2).create(spark), {}
    random.seed(4)
    for step in range(14):
        if step % 4 == 3:
            least = random.randint(0, 60)
            store.delete(spark, F.col("n") >= least)
            now = {k: v for k, v in now.items() if v < least}
        else:
            batch = {f"c{random.randint(0, 30)}": random.randint(0, 100) for _ in range(random.choice([1, 4, 200]))}
            store.upsert(spark.createDataFrame([(k, "f", v) for k, v in batch.items()], ITEMS))
            now |= batch
        assert dict(store.read(spark).select("chunk_id", "n").collect()) == now
    # Covered segments go with the next compaction; a reader's files outlive one.
    reader = store.read(spark)
    store.compact(spark)
    assert dict(reader.select("chunk_id", "n").collect()) == now == dict(store.read(spark).select("chunk_id", "n").collect())
    assert len(folders(root)) < 10


def test_catalog_json_skips_unreadable(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "1.json").write_text('{"id": "a", "filename": "a.csv", "tables_found": 0}\n')
    (folder / "2.json").write_text("{broken\n")
    records = catalog.read_json_records(spark, str(folder))
    assert [(r.id, r.filename) for r in records.select("id", "filename").collect()] == [("a", "a.csv")]
    assert catalog.file_schema(records).count() == 0


def test_shown_numbers_and_times():
    from gridloom.sources.xlsx import date_text, formatted_number

    at = 45000 + (12 * 3600 + 30 * 60 + 23) / 86400
    assert [date_text(at, p) for p in ("mm:ss", "hh:mm:ss", "m/d/yy hh:mm", "mm-dd-yy")] == ["30:23", "12:30:23", "3/15/23 12:30", "03-15-23"]
    assert [date_text(1.5, p) for p in ("[h]:mm:ss", "[mm]:ss")] == ["36:00:00", "2160:00"]
    shown = [formatted_number(*x) for x in (("0.15", "0%"), ("1234.5", "#,##0"), ("0.1234", "0.00%"), ("-0.001", "0.0"), ("2.5", "0"))]
    assert shown == ["15%", "1,235", "12.34%", "0.0", "3"]

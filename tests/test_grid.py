"""Table detection on hand-made grids, on random grids against a plain loop, and on
sheets long enough to span many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid as g
from gridloom.operators.blocks import label_runs, number_rows


def sheet(spark, lines, file_id="f", name="s"):
    return sheets(spark, {file_id: lines}, name)


def sheets(spark, by_file, name="s"):
    rows = [(f, f"{f}.xlsx", name, r, list(cells)) for f, lines in by_file.items() for r, cells in enumerate(lines)]
    return spark.createDataFrame(rows, g.GRID_SCHEMA)


def bounds(spark, grids, merges=None, bits=14, skip=False):
    """Islands of several grids at once, by grid number."""
    banded = g.band_rows(sheets(spark, {str(i): lines for i, lines in enumerate(grids)}), bits)
    islands = g.table_islands(banded, bits)
    if skip:
        m = spark.createDataFrame(merges, g.MERGES_SCHEMA) if merges is not None else None
        islands = g.skip_title_rows(islands, banded, m, bits)
    out = {str(i): [] for i in range(len(grids))}
    for r in islands.orderBy("file_id", "table_index").collect():
        out[r.file_id].append((r.min_row, r.max_row, r.min_col, r.max_col))
    return [out[str(i)] for i in range(len(grids))]


def filled(row):
    return [c for c, v in enumerate(row) if v.strip()]


def loop_islands(lines):
    """Plain-Python brute force."""
    found = []
    starts = [r for r in range(len(lines)) if filled(lines[r]) and (r == 0 or not filled(lines[r - 1]))]
    for b0 in starts:
        b1 = b0
        while b1 + 1 < len(lines) and filled(lines[b1 + 1]):
            b1 += 1
        below = set().union(*[filled(lines[r]) for r in range(b0 + (b1 > b0), b1 + 1)])
        used = set().union(*[filled(lines[r]) for r in range(b0, b1 + 1)])
        used = sorted(c for c in used if min(below) <= c <= max(below))
        for c in used:
            if c - 1 not in used:
                end = c
                while end + 1 in used:
                    end += 1
                found.append((b0, b1, c, end))
    return found


def loop_skip(bound, lines, merges):
    r0, r1, c0, c1 = bound

    def n(r):
        return sum(c0 <= c <= c1 for c in filled(lines[r]))

    while r0 < r1:
        merged = any(a == r0 == b and min(y, c1) - max(x, c0) >= 1 for a, x, b, y in merges)
        if not (merged or (c1 > c0 and n(r0) == 1 and n(r0 + 1) > 1)):
            break
        r0 += 1
    return (r0, r1, c0, c1)


CASES = [
    ("nothing", [], []),
    ("blank cells only", [["", " "], ["\t"]], []),
    ("one cell", [["x"]], [(0, 0, 0, 0)]),
    ("header only", [["p", "q", "r"]], [(0, 0, 0, 2)]),
    ("header only, split", [["p", "", "q", "r"]], [(0, 0, 0, 0), (0, 0, 2, 3)]),
    ("one table", [["p", "q"], ["1", "2"], ["3", "4"]], [(0, 2, 0, 1)]),
    ("stacked", [["p"], ["1"], [], ["q"], ["2"]], [(0, 1, 0, 0), (3, 4, 0, 0)]),
    ("side by side", [["p", "q", "", "x"], ["1", "2", "", "7"]], [(0, 1, 0, 1), (0, 1, 3, 3)]),
    ("offset", [[], [], ["", "", "p", "q"], ["", "", "1", "2"]], [(2, 3, 2, 3)]),
    ("phantom headers", [["p", "q", "r", "s"], ["1", "2"], ["3", "4"]], [(0, 2, 0, 1)]),
    ("phantom on the left", [["p", "q"], ["", "2"]], [(0, 1, 1, 1)]),
    ("sparse inside", [["p", "q", "r"], ["1", "", "3"]], [(0, 1, 0, 2)]),
    ("empty inside", [["p", "", "r"], ["1", "", "3"]], [(0, 1, 0, 0), (0, 1, 2, 2)]),
    ("ragged", [["p", "q", "r"], ["1"], ["2", "3", "4"]], [(0, 2, 0, 2)]),
    ("title keeps phantoms", [["T"], ["p", "q", "r"], ["1", "2"]], [(0, 2, 0, 2)]),
    ("no-break space is blank", [["p", " ", "q"], ["1", " ", "2"]], [(0, 1, 0, 0), (0, 1, 2, 2)]),
]


def test_hand_made_grids(spark):
    got = bounds(spark, [c[1] or [[""]] for c in CASES])
    for (name, _, expected), found in zip(CASES, got):
        assert found == expected, name


@pytest.mark.parametrize("bits", [1, 2, 14])
def test_random_grids_equal_a_plain_loop(spark, bits):
    rng = random.Random(bits)
    grids, merges = [], []
    for i in range(60):
        rows, cols, density = rng.randint(1, 14), rng.randint(1, 8), rng.choice([0.2, 0.5, 0.8])
        grids.append([["v" if rng.random() < density else rng.choice(["", " "]) for _ in range(cols)] for _ in range(rows)])
        for _ in range(rng.randint(0, 6)):
            r, c = rng.randrange(rows), rng.randrange(cols)
            tall = rng.random() < 0.15
            merges.append((str(i), "s", r, c, r + tall, c + rng.randint(0, 3)))
    assert bounds(spark, grids, bits=bits) == [loop_islands(x) for x in grids]
    own = [[(a, x, b, y) for f, _, a, x, b, y in merges if f == str(i)] for i in range(len(grids))]
    expected = [[loop_skip(b, x, own[i]) for b in loop_islands(x)] for i, x in enumerate(grids)]
    assert bounds(spark, grids, merges, bits, skip=True) == expected
    plain = [[loop_skip(b, x, []) for b in loop_islands(x)] for x in grids]
    assert bounds(spark, grids, None, bits, skip=True) == plain


def test_result_does_not_depend_on_partitioning(spark, rows_of):
    lines = CASES[7][1]
    one = sheet(spark, lines)
    many = one.repartition(7).orderBy(F.rand(3))
    names = ["min_row", "max_row", "min_col", "max_col", "table_index"]
    assert rows_of(g.table_islands(g.band_rows(one)), *names) == rows_of(g.table_islands(g.band_rows(many)), *names)


def test_runs_chain_over_blocks(spark):
    rng = random.Random(5)
    present = sorted({r for r in range(400) if r < 150 or rng.random() < 0.7})
    df = spark.createDataFrame([("k", r) for r in present], "k string, pos bigint")
    expected = {}
    for r in present:
        lo = hi = r
        while lo - 1 in expected or lo - 1 in set(present):
            lo -= 1
        while hi + 1 in set(present):
            hi += 1
        expected[r] = (lo, hi)
    for bits in (1, 2, 3, 5):
        got = {r.pos: (r.run_start, r.run_end) for r in label_runs(df, ["k"], "pos", bits).collect()}
        assert got == expected
    numbered = number_rows(df, ["k"], "pos", ["pos"], "n", 3)
    assert [r.n for r in numbered.orderBy("pos").collect()] == list(range(len(present)))


def test_titles_with_merges(spark):
    wide_title = [["T", "", "", ""], ["p", "q", "r", "s"], ["1", "2", "3", "4"]]
    beside = [["T", "", "", "", ""], ["p", "q", "", "x", "y"], ["1", "2", "", "8", "9"]]
    all_titles = [["a", "b"], ["c", "d"], ["e", "f"]]
    merges = [("0", "s", 0, 0, 0, 3), ("1", "s", 0, 0, 0, 1)] + [("2", "s", r, 0, r, 1) for r in range(3)]
    assert bounds(spark, [wide_title, beside, all_titles], merges, skip=True) == [
        [(1, 2, 0, 3)],
        [(1, 2, 0, 1), (0, 2, 3, 4)],
        [(2, 2, 0, 1)],
    ]


def test_extraction_pads_and_keeps_blank_rows(spark):
    lines = [["p", "q", "", "x"], ["1", "", "", "7"], ["2", "3"], ["4"]]
    tables, rows = g.find_tables(sheet(spark, lines))
    by_index = {t.table_index: t for t in tables.collect()}
    assert by_index[0].headers == ["p", "q"] and by_index[0].row_count == 3
    assert by_index[1].headers == ["x"] and by_index[1].row_count == 3
    values = {(r.table_key, r.row_index): r["values"] for r in rows.collect()}
    assert [values[(by_index[0].table_key, i)] for i in range(3)] == [["1", ""], ["2", "3"], ["4", ""]]
    assert [values[(by_index[1].table_key, i)] for i in range(3)] == [["7"], [""], [""]]


def test_header_only_table_has_no_rows(spark):
    tables, rows = g.find_tables(sheet(spark, [["p", "q"]]))
    assert tables.first().row_count == 0 and rows.count() == 0


def test_a_grid_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    lines = [["p", "q"], ["1", "2"], [], ["x"], ["3"], ["4"]]
    tables, rows = g.find_tables(sheet(spark, lines).mapInPandas(counted, g.GRID_SCHEMA))
    assert tables.count() == 2 and rows.count() == 3 and seen.value == len(lines)


def test_bands_written_over_blocks_equal_those_of_one_plan(spark, rows_of):
    grids = {"a": [["v"]] * 21 + [[]] + [["v"]] * 3, "b": [["v"]] * 8, "c": [["v"], [], ["v"]]}
    grid = sheets(spark, grids)
    for bits in (1, 2, 14):
        once, stored = g.band_rows(grid, bits), g.written_bands(grid, bits)
        expected = [(f, r, max(k for k in range(r + 1) if lines[k] and (k == 0 or not lines[k - 1])))
                    for f, lines in grids.items() for r in range(len(lines)) if lines[r]]
        assert rows_of(once, "file_id", "r", "band_start") == expected
        assert rows_of(stored, "file_id", "r", "band_start") == expected


def test_titles_settled_by_counts_and_by_rows(spark):
    under = [["T", "", ""], ["u", "", ""], ["p", "q", "r"], ["1", "2", "3"]]
    merged_twice = [["T", "", ""], ["U", "", ""], ["p", "q", "r"], ["1", "2", "3"]]
    all_but_one = [["T", ""], ["u", ""], ["p", "q"]]
    merges = [("0", "s", 0, 0, 0, 2), ("1", "s", 0, 0, 0, 2), ("1", "s", 1, 0, 1, 2), ("2", "s", 0, 0, 0, 1)]
    assert bounds(spark, [under, merged_twice, all_but_one], merges, skip=True) == [
        [(2, 3, 0, 2)], [(2, 3, 0, 2)], [(2, 2, 0, 1)],
    ]
    # A first row that comes twice holds one cell each time, two columns in all.
    cells = [(0, ["a", ""]), (0, ["", "b"]), (1, ["p", "q"]), (2, ["1", "2"])]
    twice = spark.createDataFrame([("f", "f.xlsx", "s", r, c) for r, c in cells], g.GRID_SCHEMA)
    banded = g.band_rows(twice)
    (got,) = g.skip_title_rows(g.table_islands(banded), banded).collect()
    assert (got.min_row, got.titles) == (1, 1)

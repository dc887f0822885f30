"""Type inference on hand-made grids: every row of the SURVEY 2.12 table."""

import pytest

from conftest import make_rows
from gridflow.functions.cells import unique_names
from gridflow.operators.grid import column_samples, infer_columns, sheet_shape

H = ("s", "col")

CASES = [
    # name, cells below the header, expected compat type, nullable, typed-mode type
    ("ints", [("n", "1"), ("n", "2"), ("n", "3")], "BIGINT", False, "BIGINT"),
    ("ints_null", [("n", "1"), None, ("n", "3")], "DOUBLE", True, "BIGINT"),
    ("fraction", [("n", "1"), ("n", "2.5")], "DOUBLE", False, "DOUBLE"),
    ("integral_float", [("n", "5.0"), ("n", "6.0")], "BIGINT", False, "BIGINT"),
    ("all_null", [None, None], "DOUBLE", True, "STRING"),
    ("bools", [("b", "true"), ("b", "false")], "BOOLEAN", False, "BOOLEAN"),
    ("bools_null", [("b", "true"), None], "DOUBLE", True, "BOOLEAN"),
    ("bool_int", [("b", "true"), ("n", "2")], "BIGINT", False, "STRING"),
    ("bool_frac", [("b", "true"), ("n", "2.5")], "DOUBLE", False, "STRING"),
    ("text_bool", [("s", "True"), ("s", "FALSE")], "BOOLEAN", False, "STRING"),
    ("text_bool_null", [("s", "True"), None], "STRING", True, "STRING"),
    ("text_num", [("s", "001"), ("s", "002")], "BIGINT", False, "STRING"),
    ("text_num_null", [("s", "1"), None], "DOUBLE", True, "STRING"),
    ("text_comma", [("s", "1,000"), ("s", "2")], "STRING", False, "STRING"),
    ("missing_token", [("s", "NULL"), ("n", "3")], "DOUBLE", True, "STRING"),
    ("date_text", [("d", "2024-01-01 00:00:00"), ("s", "x")], "STRING", False, "STRING"),
    ("dates", [("d", "2024-01-01 00:00:00"), None, ("d", "2024-01-02 00:00:00")], "TIMESTAMP", True, "TIMESTAMP"),
    ("mixed", [("n", "1"), ("s", "x")], "STRING", False, "STRING"),
    ("huge_int_text", [("s", "99999999999999999999")], "STRING", False, "STRING"),
    ("text_float", [("s", " 2.5 "), ("s", "1e3")], "DOUBLE", False, "STRING"),
]


@pytest.mark.parametrize("name,cells,compat,nullable,typed", CASES, ids=[c[0] for c in CASES])
def test_type_rules(spark, name, cells, compat, nullable, typed):
    rows = make_rows(spark, [[H]] + [[c] for c in cells])
    got = infer_columns(rows, header_row=0).collect()
    assert len(got) == 1
    assert got[0]["type"] == compat
    assert got[0]["nullable"] == nullable
    got_t = infer_columns(rows, header_row=0, infer="typed").collect()[0]
    assert got_t["type"] == typed


def test_no_rows_is_string(spark):
    rows = make_rows(spark, [[H]])
    got = infer_columns(rows, header_row=0).collect()
    assert [(r["name"], r["type"]) for r in got] == [("col", "STRING")]


def test_header_names_blank_and_duplicates(spark):
    rows = make_rows(spark, [[("s", "X"), None, ("s", "X")], [("n", "1"), ("n", "2"), ("n", "3"), ("n", "4")]])
    got = sorted((r["col_ix"], r["name"]) for r in infer_columns(rows, 0).collect())
    assert got == [(0, "X"), (1, "Unnamed: 1"), (2, "X.1"), (3, "Unnamed: 3")]


def test_names_like_pandas():
    import random

    from pandas.io.parsers import TextParser
    assert unique_names(["X", "X", "X.1"]) == ["X", "X.2", "X.1"]
    assert unique_names(["a", "", None, "a", "a"]) == ["a", "Unnamed: 1", "Unnamed: 2", "a.1", "a.2"]
    rng = random.Random(0)
    pool = ["X", "X", "X.1", "X.2", "X.1.1", "", "", "Unnamed: 0", "Unnamed: 1", "Unnamed: 0.1", "y", "y.1"]
    for _ in range(3000):
        head = [rng.choice(pool) for _ in range(rng.randint(1, 7))]
        if not any(head):
            continue     # pandas passes over a line of blanks
        want = TextParser([head, ["1"] * len(head)], header=0).read().columns.tolist()
        assert unique_names(head) == want, head


def test_samples_first_three_non_null_in_order(spark):
    grid = [[("s", "v")], [None], [("n", "5")], [("s", "NA")], [("n", "6")], [("n", "7")], [("n", "8")]]
    rows = make_rows(spark, grid)
    got = column_samples(rows, 0).collect()[0]["sample_values"]
    assert got == ["5", "6", "7"]


def test_blank_rows_between_data_are_kept(spark):
    grid = [[("s", "a"), ("s", "b")], [("n", "1"), ("n", "2")], [], [("n", "3"), ("n", "4")]]
    rows = make_rows(spark, grid)
    shape = sheet_shape(rows, 0).collect()[0]
    assert (shape["row_count"], shape["column_count"]) == (3, 2)
    types = {r["name"]: (r["type"], r["nullable"]) for r in infer_columns(rows, 0).collect()}
    assert types == {"a": ("DOUBLE", True), "b": ("DOUBLE", True)}


def test_samples_are_cut_before_they_are_sorted(spark):
    """Of 4,000 rows only a few cells a column and batch are sorted; missing cells, short rows and rows out of order count as ever."""
    import pyarrow as pa

    from gridflow.operators.grid import _first_values, column_samples
    cells = lambda i: [("n", str(i)), ("s", "NA" if i % 4 else f"t{i}"), ("null", None)][: 3 if i % 7 else 2] + [("s", f"late{i}")] * (i > 3990)
    data = [(f"f{i % 3}", 0, "S", i, [{"kind": a, "raw": b} for a, b in cells(i)]) for i in reversed(range(4000))]
    df = spark.createDataFrame(data, "file_id string, sheet_ix int, sheet string, row_ix int, cells array<struct<kind:string,raw:string>>")
    want = {}
    for i in range(1, 4000):
        for c, (a, b) in enumerate(cells(i)):
            if a != "null" and b != "NA" and len(want.setdefault((f"f{i % 3}", c), [])) < 3:
                want[f"f{i % 3}", c].append(b)
    got = {(r["file_id"], r["col_ix"]): list(r["sample_values"]) for r in column_samples(df).collect()}
    assert got == want
    batch = pa.RecordBatch.from_pylist([{"file_id": f, "sheet": s, "row_ix": r, "cells": c} for f, _, s, r, c in data])
    assert sum(b.num_rows for b in _first_values(3)([batch])) == sum(len(v) for v in want.values()) <= 40


def test_columns_are_counted_in_one_pass(spark, tmp_path):
    """The rows are scanned for counts once and for header rows once; a sheet without data rows and one without a header row stay."""
    from conftest import make_rows
    from gridflow.operators.grid import column_counts, infer_columns
    head = [("s", "a"), ("s", "b"), None]
    rows = make_rows(spark, [head, [("n", "1")], [("n", "2"), None, None, ("s", "x")]], "wide").unionByName(
        make_rows(spark, [head], "empty")).unionByName(make_rows(spark, [[]], "blank")).unionByName(
        make_rows(spark, [[], [("b", "true")]], "short").filter("row_ix > 0"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    got = {(r["file_id"], r["col_ix"]): (r["name"], r["n_rows"], r["c_int"], r["c_bool"], r["c_text"]) for r in column_counts(rows).collect()}
    assert got == {("wide", 0): ("a", 2, 2, 0, 0), ("wide", 1): ("b", 2, 0, 0, 0), ("wide", 2): ("Unnamed: 2", 2, 0, 0, 0),
                   ("wide", 3): ("Unnamed: 3", 2, 0, 0, 1), ("empty", 0): ("a", 0, 0, 0, 0), ("empty", 1): ("b", 0, 0, 0, 0),
                   ("empty", 2): ("Unnamed: 2", 0, 0, 0, 0), ("short", 0): ("Unnamed: 0", 1, 0, 1, 0)}
    for by_file in (True, False):
        plan = infer_columns(rows, by_file=by_file)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 2 and plan.count("posexplode(concat") == 1

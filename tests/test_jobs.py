"""Preview, analyze and parse jobs on the reference's fixture workbooks."""

import datetime as dt

import pytest

from conftest import workbook_doc
from gridflow.plans.jobs import analyze_files, parse_to_table, preview_files
from gridflow.sources.xlsx import write_workbook

WORKED = [  # FIXTURES 3: the documented example
    (0, [("s", "Supplier ID:"), ("s", "supplier A")]),
    (2, [("s", "Date"), ("s", "SKU"), ("s", "Qty")]),
    (3, [("d", "2026-01-02 00:00:00"), ("s", "A"), ("n", "50")]),
    (4, [("d", "2026-01-03 00:00:00"), ("s", "A"), ("n", "20")]),
]


@pytest.fixture(scope="module")
def docs(spark):
    return workbook_doc(spark, {"/sites/docs/Supplier A.xlsx": write_workbook([("Sheet1", WORKED)])})


def test_preview(docs):
    p = preview_files(docs, None, max_rows=50)
    f = p["files"].collect()[0]
    assert list(f["sheets"]) == ["Sheet1"] and f["selected_sheet"] == "Sheet1"
    assert (f["total_rows"], f["column_count"]) == (5, 3)
    assert f["recommended_table_name"] == "supplier_a"
    rows = sorted(p["rows"].collect(), key=lambda r: r["row_ix"])
    assert list(rows[3]["values"]) == ["2026-01-02 00:00:00", "A", "50"]
    assert list(rows[1]["values"]) == []


def test_analyze(docs):
    a = analyze_files(docs, None, header_row=2)
    cols = {r["name"]: (r["type"], r["nullable"], list(r["sample_values"])) for r in a["columns"].collect()}
    assert cols["Date"] == ("TIMESTAMP", False, ["2026-01-02 00:00:00", "2026-01-03 00:00:00"])
    assert cols["Qty"] == ("BIGINT", False, ["50", "20"])
    assert cols["SKU"][0] == "STRING"
    assert a["shape"].collect()[0]["row_count"] == 2


def test_parse_selected_columns(spark, docs):
    r = parse_to_table(spark, docs, None, "main.parsed_a", header_row=2, selected_columns=["Date", "Qty"])
    assert (r.rows_inserted, r.total_rows, r.rejects) == (2, 2, 0)
    assert r.columns == [{"name": "Date", "type": "TIMESTAMP"}, {"name": "Qty", "type": "BIGINT"}]
    t = spark.table("main.parsed_a")
    assert [f.simpleString() for f in t.schema.fields] == ["Date:timestamp", "Qty:bigint"]
    got = sorted((x["Date"], x["Qty"]) for x in t.collect())
    assert got == [(dt.datetime(2026, 1, 2), 50), (dt.datetime(2026, 1, 3), 20)]
    # parse appends again (reference behaviour, explicit append mode)
    parse_to_table(spark, docs, None, "main.parsed_a", header_row=2, selected_columns=["Date", "Qty"])
    assert spark.table("main.parsed_a").count() == 4


def test_parse_strict_selection_error(spark, docs):
    with pytest.raises(ValueError, match="no selected column"):
        parse_to_table(spark, docs, None, "main.parsed_b", header_row=2, selected_columns=["Nope"])


def test_parse_caller_schema_and_rejects(spark):
    sheet = [(0, [("s", "id"), ("s", "amount")]), (1, [("s", "a"), ("s", "12")]),
             (2, [("s", "b"), ("s", "n/a!")]), (3, [("s", "c"), ("n", "7")])]
    docs = workbook_doc(spark, {"/f/amounts.xlsx": write_workbook([("S", sheet)])})
    r = parse_to_table(spark, docs, None, "main.amounts", header_row=0,
                       schema=[("id", "STRING"), ("amount", "INT")])
    assert (r.rows_inserted, r.total_rows, r.rejects) == (2, 3, 1)
    assert sorted(x["amount"] for x in spark.table("main.amounts").collect()) == [7, 12]


def test_empty_sheet_is_success(spark):
    docs = workbook_doc(spark, {"/f/empty.xlsx": write_workbook([("S", [])])})
    r = parse_to_table(spark, docs, None, "main.empty_t", header_row=0)
    assert r.total_rows == 0 and "sheet is empty" in r.message


def test_typed_round_trip_property(spark):
    """SURVEY 5 (3): typed rows -> workbook bytes -> decode -> promote -> cast
    gives the same rows back, for random tables with NULLs."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from gridflow.plans.jobs import build_typed
    from gridflow.sources.workbook import decode_workbooks, grid_rows

    schema = [("i", "BIGINT"), ("f", "DOUBLE"), ("s", "STRING"), ("b", "BOOLEAN"), ("t", "TIMESTAMP")]
    row = st.tuples(
        st.one_of(st.none(), st.integers(-10**12, 10**12)),
        st.one_of(st.none(), st.floats(-1e9, 1e9, allow_nan=False).map(lambda x: round(x, 3))),
        st.one_of(st.none(), st.text(alphabet="abcXYZ &<>é", min_size=1, max_size=6)),
        st.one_of(st.none(), st.booleans()),
        st.one_of(st.none(), st.datetimes(min_value=dt.datetime(1901, 1, 1), max_value=dt.datetime(2090, 1, 1))
                  .map(lambda x: x.replace(microsecond=0))))

    def cells_of(r):
        i, f, s, b, t = r
        return [None if i is None else ("n", str(i)), None if f is None else ("n", repr(f)),
                None if s is None else ("s", s), None if b is None else ("b", "true" if b else "false"),
                None if t is None else ("d", t.strftime("%Y-%m-%d %H:%M:%S"))]

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(row, min_size=1, max_size=12))
    def check(rows):
        sheet = [(0, [("s", n) for n, _ in schema])] + [(k + 1, cells_of(r)) for k, r in enumerate(rows)]
        docs = workbook_doc(spark, {"/p/rt.xlsx": write_workbook([("S", sheet)])})
        typed, _ = build_typed(grid_rows(decode_workbooks(docs)), 0, None, None, schema, keys=("row_ix",))
        got = sorted((r["row_ix"], r["i"], r["f"], r["s"], r["b"], r["t"]) for r in typed.collect())
        exp = [(k + 1, *r) for k, r in enumerate(rows)]
        # trailing all-NULL rows are not rows of the sheet (as in pandas)
        while exp and all(v is None for v in exp[-1][1:]):
            exp.pop()
        assert got == exp

    check()


def test_files_of_different_layouts_parse_into_one_table(spark):
    import datetime as dt

    import pytest

    from gridflow.plans.jobs import parse_to_table
    from gridflow.sources.xlsx import write_workbook
    ts = dt.datetime(2024, 1, 1)
    grids = {"a": [(0, [("s", "k"), ("s", "n")]), (1, [("s", "x"), ("n", "1")])],
             "b": [(0, [("s", "n"), ("s", "extra"), ("s", "k")]), (1, [("n", "2.5"), ("b", "true"), ("s", "y")])],
             "c": [(0, [("s", "k"), ("s", "k")]), (1, [("s", "z"), ("s", "second")]), (2, [("s", "w")])],
             "d": [(0, [("s", "extra")])]}
    rows = [(f, (f, 1, ts, ts), bytearray(write_workbook([("S", g)])), False) for f, g in grids.items()]
    docs = spark.createDataFrame(rows, "file_id string, file_metadata struct<name:string, size_in_bytes:bigint, "
                                       "last_modified_timestamp:timestamp, created_timestamp:timestamp>, content binary, is_deleted boolean")
    r = parse_to_table(spark, docs, None, "main.mixed_t")
    t = spark.table("main.mixed_t")
    assert {c["name"]: c["type"] for c in r.columns} == {"k": "STRING", "n": "DOUBLE", "extra": "BOOLEAN", "k.1": "STRING"}
    assert sorted(tuple(x) for x in t.select("k", "n", "extra", "`k.1`").na.fill("-").na.fill(-1.0).collect()) == [
        ("w", -1.0, None, "-"), ("x", 1.0, None, "-"), ("y", 2.5, True, "-"), ("z", -1.0, None, "second")]
    assert (r.rows_inserted, r.total_rows, r.rejects) == (4, 4, 0)
    r = parse_to_table(spark, docs, ["a", "b"], "main.mixed_sel", selected_columns=["extra", "n", "nothere"], write_mode="replace")
    assert spark.table("main.mixed_sel").columns == ["extra", "n"]
    with pytest.raises(ValueError):
        parse_to_table(spark, docs, ["a", "b"], "main.mixed_none", selected_columns=["nothere"])
    r = parse_to_table(spark, docs, ["a", "b"], "main.mixed_schema", schema=[("n", "BIGINT"), ("k", "STRING")])
    assert (r.rows_inserted, r.rejects) == (1, 1)                 # 2.5 is no whole number


def test_mixed_layouts_look_names_up_once_a_file(spark):
    """Columns of files of different layouts are found by position, not by a search of the names in every row."""
    from gridflow.plans.jobs import build_typed
    from conftest import make_rows
    a = make_rows(spark, [[("s", "A"), ("s", "B")], [("n", "1"), ("s", "x")], [("n", "2")]], "a")
    b = make_rows(spark, [[("s", "B"), ("s", "C"), ("s", "A")], [("s", "y"), ("b", "true"), ("n", "3")]], "b")
    typed, schema = build_typed(a.unionByName(b))
    assert schema == [("A", "BIGINT"), ("B", "STRING"), ("C", "BOOLEAN")] or dict(schema)["A"] == "BIGINT"
    got = sorted(((r["A"], r["B"], r["C"]) for r in typed.collect()), key=str)
    assert [(x, y) for x, y, _ in got] == [(1, "x"), (2, None), (3, "y")]
    assert [z is None for _, _, z in got] == [True, True, False]
    plan = typed._jdf.queryExecution().analyzed().toString()
    assert "array_position" not in plan and "array_contains" not in plan


def test_casting_rows_is_compiled(spark):
    """The code generated for casting a table's rows must stay within what the JVM compiles (8,000 bytes a method): with cell,
    cast and reject flag in one projection it did not, and casting took ten times as long."""
    from conftest import make_rows
    from gridflow.plans.jobs import build_typed
    schema = [("Date", "TIMESTAMP"), ("SKU", "STRING"), ("Qty", "BIGINT"), ("Price", "DOUBLE"), ("Open", "BOOLEAN")]
    grid = [[("s", n) for n, _ in schema], [("d", "2024-01-02 00:00:00"), ("s", "SKU1"), ("n", "17.0"), ("n", "2.5"), ("b", "true")],
            [("s", "soon"), None, ("s", "x"), ("s", "n/a"), ("s", "TRUE")], [("d", "2024-01-03 00:00:00")]]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")      # its plans are made while they run
    try:
        out, _ = build_typed(make_rows(spark, grid), 0, None, None, schema, keys=("file_id",))
        plan = out._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert out.columns == ["file_id", "Date", "SKU", "Qty", "Price", "Open", "_rejected"]
    assert [(str(r["Date"]), *r[2:]) for r in out.collect()] == [
        ("2024-01-02 00:00:00", "SKU1", 17, 2.5, True, False), ("None", None, None, None, True, True), ("2024-01-03 00:00:00", None, None, None, None, False)]
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and max(sizes) <= 8000, sizes


def test_mixed_layouts_are_counted_once(spark, monkeypatch):
    """Types, the layout check and the places of columns come from one count of the cells."""
    from gridflow.operators import grid as G
    from gridflow.plans import jobs
    book = lambda *names: write_workbook([("S", [(0, [("s", n) for n in names]), (1, [("n", str(i)) for i in range(len(names))])])])
    calls, count = [], G.column_counts
    monkeypatch.setattr(G, "column_counts", lambda *a, **k: calls.append(a) or count(*a, **k))
    for i, (files, want) in enumerate((({"a": book("x", "y"), "b": book("y", "z", "x")}, [(0, 1, None), (2, 0, 1)]),
                                       ({"a": book("x", "y"), "b": book("x", "y")}, [(0, 1), (0, 1)]))):
        calls.clear()
        r = jobs.parse_to_table(spark, workbook_doc(spark, files), None, f"main.counted_{i}")
        assert len(calls) == 1 and r.rows_inserted == 2 and r.rejects == 0
        assert sorted(map(tuple, spark.table(f"main.counted_{i}").collect()), key=str) == sorted(want, key=str)
        spark.sql(f"DROP TABLE main.counted_{i}")

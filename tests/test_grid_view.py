"""grid_v and the operators that read it: one scan, one shuffle, the rows of its SQL on odd keys."""

import duckdb

from gridflow.operators.grid import attach_fixed_cell
from gridflow.plans import views as V

LINEITEM = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
            "l_linestatus string, l_shipdate timestamp_ntz")


def _odd(spark, tmp_path):
    import datetime as dt
    day = dt.datetime(1995, 3, 1)
    rows = [(k, k % 7, k % 3, ln, float(ln), None if k == 9 else k + 0.5, "O" if k % 2 else "F", day)
            for k in (0, 1, 9, 32767, 32768, 40000, 200000) for ln in (1, 2, 3)]
    rows += [(5, 1, None, 1, 1.0, 2.0, None, day), (32769, 2, None, 1, 1.0, 2.0, "O", None), (-1, None, 0, 1, None, 2.0, "F", day)]
    spark.createDataFrame(rows, LINEITEM).repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_those_of_the_sql(spark, tmp_path):
    sf = _odd(spark, tmp_path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
    key = "SELECT file_id, sheet_ix, sheet, row_ix, len(cells) AS n, list_transform(cells, lambda x: x.kind) AS kinds FROM grid_v"
    want = c.execute(V.with_views(key, "grid_v")).fetchall()
    for parts in (None, 3):
        got = V.grid_v(spark, sf, parts).selectExpr("file_id", "sheet_ix", "sheet", "row_ix", "size(cells)", "transform(cells, x -> x.kind)").collect()
        as_text = lambda rows: sorted(str((r[0], r[1], r[2], r[3], r[4], list(r[5]))) for r in rows)
        assert as_text(got) == as_text(want)


def test_one_scan_and_one_shuffle(spark, tmp_path):
    sf = _odd(spark, tmp_path)
    plan = _plan(V.grid_v(spark, sf))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    shuffled = plan[plan.index("Exchange"):]
    assert "Sort" not in shuffled and "AS file_id" not in shuffled      # bare columns travel, not names or cells
    # a file's rows are together: writing workbooks asks for no further shuffle
    assert _plan(V.grid_v(spark, sf, 3).groupBy("file_id").count()).count("Exchange") == 1


def test_fixed_cell_join_sorts_no_data_rows(spark, tmp_path):
    rows = V.grid_v(spark, _odd(spark, tmp_path))
    rows.write.parquet(str(tmp_path / "grid"))
    rows = spark.read.parquet(str(tmp_path / "grid"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as with more files than can be sent out
    try:
        out = attach_fixed_cell(rows, rows.filter("row_ix > 2").select("file_id", "row_ix"))
        assert "Sort" not in _plan(out)
        assert {(r[0], r[2]) for r in out.collect() if r[0]} == {(f"supplier_{s}_{b}.xlsx", str(s)) for s, b in
                                                                  {(k % 3, k // 32768) for k in (0, 1, 9, 32767, 32768, 40000, 200000)} | {(0, -1)}}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_sheets_are_made_in_one_pass(spark, tmp_path):
    from gridflow.plans.stored_queries import _two_sheets
    g = V.grid_v(spark, _odd(spark, tmp_path), 3)
    two = _two_sheets(g)
    assert _plan(two).count("Window") == 1 and _plan(two).count("FileScan") == 1
    own = sorted(str(r) for r in g.collect())
    assert sorted(str(r) for r in two.where("sheet_ix = 0").select(*g.columns).collect()) == own
    data = g.where("row_ix > 2").selectExpr("file_id", "1 AS sheet_ix", "'Data only' AS sheet", "row_ix", "cells")
    assert sorted(str(r) for r in two.where("sheet_ix = 1").collect()) == sorted(str(r) for r in data.collect())


def test_staging_sorts_no_rows_by_file(spark, tmp_path):
    from gridflow.plans.jobs import _staged
    rows = V.grid_v(spark, _odd(spark, tmp_path))
    rows.write.parquet(str(tmp_path / "grid"))
    rows = spark.read.parquet(str(tmp_path / "grid"))
    spec = rows.where("row_ix = 0 AND file_id IS NOT NULL").selectExpr("'t' AS target_table", "file_id", "2 AS header_row", "array(1, -1, 0) AS ix")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = _staged(rows, spec)
        assert "Sort" not in _plan(out)
        want = rows.where("row_ix > 2 AND file_id IS NOT NULL").selectExpr("array(cells[1], null, cells[0]) AS cells")
        assert sorted(str(r["cells"]) for r in out.collect()) == sorted(str(r["cells"]) for r in want.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

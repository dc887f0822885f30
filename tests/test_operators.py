"""Keyed writes, listings, quality, contracts, scalars and filters."""

import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridflow.functions.filters import glob_to_regex, require_nonblank
from gridflow.functions.scalars import extract_uuid, format_iso, parse_iso, table_name
from gridflow.operators.contracts import actual_columns, profile_tables, validate_schema
from gridflow.operators.keyed import best_by_priority, delete_where, insert_if_absent, list_registry, update_where
from gridflow.operators.quality import null_profile, quality_report, quality_summary
from gridflow.sinks import tables as S


def test_keyed_round_trip(spark):
    """FIXTURES 10: insert, update 100 -> 200, delete -> 0 rows, on a real table."""
    name = "main.kv_round_trip"
    S.drop_table(spark, name)
    S.ensure_table(spark, name, [("id", "STRING"), ("name", "STRING"), ("value", "INT")])
    rows = spark.createDataFrame([("id1", "test_name", 100)], "id string, name string, value int")
    result, inserted, rejects = insert_if_absent(spark.table(name), rows, "id")
    S.replace_table(result, name)
    assert [tuple(r) for r in spark.table(name).collect()] == [("id1", "test_name", 100)]
    _, ins2, rej2 = insert_if_absent(spark.table(name), rows, "id")
    assert ins2.count() == 0 and [r["reason"] for r in rej2.collect()] == ["duplicate key"]
    S.replace_table(update_where(spark.table(name), F.col("id") == "id1", {"value": 200}), name)
    assert spark.table(name).collect()[0]["value"] == 200
    kept, gone = delete_where(spark.table(name), F.col("id") == "id1")
    assert [r["id"] for r in gone.collect()] == ["id1"]
    S.replace_table(kept, name)
    assert spark.table(name).count() == 0
    kept2, gone2 = delete_where(spark.table(name), F.col("id") == "id1")
    assert gone2.count() == 0


def test_repeated_keys_in_batch_are_rejected(spark):
    t = spark.createDataFrame([("a", 1)], "id string, v int")
    rows = spark.createDataFrame([("b", 2), ("b", 3), ("c", 4), (None, 5), (None, 6)], "id string, v int")
    _, ins, rej = insert_if_absent(t, rows, "id")
    assert sorted(r["id"] for r in ins.collect()) == ["c"]
    assert sorted((r["id"] or "", r["reason"]) for r in rej.collect()) == \
        [("", "null key"), ("", "null key"), ("b", "repeated in batch"), ("b", "repeated in batch")]


def test_best_by_priority_unknown_ranks_last(spark):
    wh = spark.createDataFrame([("w", "a", "STOPPED", "SMALL"), ("w", "b", "RUNNING", "LARGE"),
                                ("w", "c", "RUNNING", "X_SMALL"), ("w", "d", "WEIRD", "X_SMALL")],
                               "k string, id string, state string, size string")
    got = best_by_priority(wh, "k", [("state", ["RUNNING", "STARTING", "STOPPED"]),
                                     ("size", ["X_SMALL", "SMALL", "MEDIUM", "LARGE"])], [F.col("id")]).collect()
    assert [r["id"] for r in got] == ["c"]


def test_registry_orders(spark):
    import datetime as dt
    reg = spark.createDataFrame([("c1", "zeta", dt.datetime(2024, 1, 1)), ("c2", "alpha", dt.datetime(2024, 2, 1))],
                                "connection_id string, connection_name string, created_at timestamp")
    assert [r["connection_id"] for r in list_registry(reg).collect()] == ["c2", "c1"]
    assert [r["connection_id"] for r in list_registry(reg, by="connection_name").collect()] == ["c2", "c1"]


def test_quality_report_fixture(spark):
    df = spark.createDataFrame([("2024-01-01", "SKU1", 10, "S1"), ("2024-01-02", None, 20, "S1")],
                               "Date string, SKU string, Qty bigint, supplier_id string")
    rep = {r["check"]: (r["value"], r["passed"]) for r in quality_report(df).collect()}
    assert rep["row_count"] == ("2", True)
    assert rep["required_columns"] == ("", True)
    assert rep["null_values"] == ("Date=0,Qty=0,SKU=1,supplier_id=0", False)
    assert rep["supplier_consistency"] == ("1", True)
    s = quality_summary(quality_report(df)).collect()[0]
    assert (s["checks_passed"], s["total_checks"]) == (False, 4)
    missing = {r["check"]: r for r in quality_report(df.drop("Qty")).collect()}["required_columns"]
    assert (missing["value"], missing["passed"]) == ("Qty", False)
    nulls = {r["column_name"]: r["null_count"] for r in null_profile(df).collect()}
    assert nulls == {"Date": 0, "SKU": 1, "Qty": 0, "supplier_id": 0}


def test_schema_contract_fixture(spark):
    """FIXTURES 9: expected id STRING, value INT against a table."""
    t = spark.createDataFrame([("a", 1, 2.0)], "id string, value bigint, extra double")
    exp = spark.createDataFrame([("t", "id", "STRING"), ("t", "value", "INT"), ("t", "gone", "STRING")],
                                "table_name string, column_name string, type string")
    r = validate_schema(exp, actual_columns(spark, {"t": t})).collect()[0]
    assert r["valid"] is False
    assert list(r["missing_columns"]) == ["gone"] and list(r["extra_columns"]) == ["extra"]
    assert [(m["column"], m["expected"], m["actual"]) for m in r["type_mismatches"]] == [("value", "int", "bigint")]
    exp2 = spark.createDataFrame([("t", "id", "string"), ("t", "value", "LONG")],
                                 "table_name string, column_name string, type string")
    assert validate_schema(exp2, actual_columns(spark, {"t": t})).collect()[0]["valid"] is True
    strict = validate_schema(exp2, actual_columns(spark, {"t": t}), strict=True).collect()[0]
    assert strict["valid"] is False
    from gridflow.operators.contracts import compare_columns
    per_col = {r["column_name"]: r["status"] for r in compare_columns(exp, actual_columns(spark, {"t": t})).collect()}
    assert per_col == {"id": "ok", "value": "type_mismatch", "gone": "missing", "extra": "extra"}


def test_profiles(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.range(10).withColumn("s", F.lit("x")).write.parquet(p)
    df = spark.read.parquet(p)
    simple = profile_tables(spark, {"t": df}).collect()[0]
    assert simple["n_rows"] == 10 and simple["size_in_bytes"] > 0 and simple["last_modified"] is not None
    det = {r["column_name"]: r for r in profile_tables(spark, {"t": df}, "DETAILED", "approx").collect()}
    assert (det["id"]["min_num"], det["id"]["max_num"], det["id"]["n_distinct"]) == (0.0, 9.0, 10)
    mem = spark.createDataFrame([(1,)], "a int")
    assert profile_tables(spark, {"m": mem}).collect()[0]["size_in_bytes"] is None


@pytest.mark.parametrize("path,expected", [
    ("/sites/x/Supplier A.xlsx", "supplier_a"), ("report.XLS", "report"), ("__weird--name__.xlsx", "weird__name"),
    ("a.b.xlsx", "a_b"), ("données 2024.xlsx", "donn_es_2024"), ("x.xlsx.bak", "x_xlsx_bak")])
def test_table_name(spark, path, expected):
    assert spark.range(1).select(table_name(F.lit(path))).first()[0] == expected


def test_extract_uuid(spark):
    u = "123e4567-E89B-12d3-a456-426614174000"
    cases = [(f"Site ID: {u}", u), ("site without uuid", "site without uuid"), ("nothing here", ""),
             (None, ""), (f"no mention {u}", "")]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    assert [r[0] for r in df.select(extract_uuid("c")).collect()] == [e for _, e in cases]


def test_iso_round_trip(spark):
    df = spark.createDataFrame([("2024-03-01T10:20:30",), ("2024-03-01T10:20:30.250000",), ("junk",)], "s string")
    got = [r[0] for r in df.select(format_iso(parse_iso("s"))).collect()]
    assert got == ["2024-03-01T10:20:30", "2024-03-01T10:20:30.250000", None]


def test_nonblank(spark):
    df = spark.createDataFrame([("a",), ("  ",), (None,), ("\t\n",), (" b ",)], "v string")
    ok, bad = require_nonblank(df, "v")
    assert sorted(r[0] for r in ok.collect()) == [" b ", "a"] and bad.count() == 3


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab*?[]!-.^&\\z", max_size=8), st.text(alphabet="ab-.!^&\\z", max_size=8))
def test_glob_matches_fnmatch(pattern, name):
    assert (re.match(glob_to_regex(pattern), name) is not None) == fnmatch.fnmatchcase(name, pattern)


def test_glob_in_spark_matches_fnmatch(spark):
    from gridflow.functions.filters import glob_match
    names = ["a.xlsx", "b.XLSX", "[x].csv", "a&&b", "a^b", "a\\b", "-", "!", "ab]", "a-b", ".hidden", "x\ny"]
    pats = ["*.xlsx", "[!a]*", "[?-.]", "[a-]*", "[]]*", "a[&]&b", "a[^]b", "a\\b", "[!]-]", "a[b-a-]b",
            "*", "?", "[", "x?y"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for p in pats:
        got = sorted(r[0] for r in df.filter(glob_match(F.col("n"), p)).collect())
        assert got == sorted(n for n in names if fnmatch.fnmatchcase(n, p)), p


def test_discover_and_validate_tables(spark):
    from gridflow.operators.contracts import discover_tables, validate_tables
    spark.sql("CREATE SCHEMA IF NOT EXISTS disc")
    spark.range(5).withColumn("name", F.lit("x")).write.mode("overwrite").saveAsTable("disc.supplier_a_data")
    spark.range(3).write.mode("overwrite").saveAsTable("disc.supplier_b_data")
    spark.range(2).write.mode("overwrite").saveAsTable("disc.other")
    got = discover_tables(spark, "disc", ["supplier_*_data"], "SIMPLE")
    stats = {r["table_name"]: r["n_rows"] for r in got["tables"].collect()}
    assert stats == {"disc.supplier_a_data": 5, "disc.supplier_b_data": 3}
    cols = {(r["table_name"], r["column_name"], r["type"]) for r in got["columns"].collect()}
    assert ("disc.supplier_a_data", "name", "string") in cols
    det = discover_tables(spark, "disc", "other", "DETAILED")["tables"].collect()
    assert [(r["column_name"], r["max_num"]) for r in det] == [("id", 1.0)]
    exp = spark.createDataFrame([("disc.supplier_a_data", "id", "BIGINT"), ("disc.supplier_a_data", "name", "STRING"),
                                 ("disc.supplier_b_data", "id", "INT"), ("disc.missing_t", "id", "BIGINT")],
                                "table_name string, column_name string, type string")
    res = {r["table_name"]: r["valid"] for r in validate_tables(spark, exp).collect()}
    assert res == {"disc.supplier_a_data": True, "disc.supplier_b_data": False, "disc.missing_t": False}


def test_discovery_levels(spark):
    import pytest

    from gridflow.operators.contracts import discover_tables
    spark.sql("CREATE SCHEMA IF NOT EXISTS lv")
    spark.sql("CREATE TABLE IF NOT EXISTS lv.t1 (a INT COMMENT 'first', b STRING) USING parquet")
    none = discover_tables(spark, "lv", level="NONE")
    assert none["tables"].columns == ["table_name", "table_type"] and none["tables"].count() == 1
    assert [(r["nullable"], r["comment"]) for r in none["columns"].orderBy("ordinal").collect()] == [(True, "first"), (True, None)]
    assert discover_tables(spark, "lv", level="SIMPLE")["tables"].first()["n_rows"] == 0
    assert discover_tables(spark, "lv", level="DETAILED")["tables"].count() == 2
    with pytest.raises(ValueError, match="level"):
        discover_tables(spark, "lv", level="MOST")


def test_small_predicates_display_and_table_property(spark):
    from gridflow.functions.filters import by_key, not_null
    from gridflow.functions.cells import display
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert [r["k"] for r in by_key(df, "k", "b").collect()] == ["b"]
    assert [r["k"] for r in not_null(df, "v").collect()] == ["a"]
    cells = spark.createDataFrame([(("null", None),), (("d", "2026-01-02 00:00:00"),), (("n", "5"),)],
                                  "cell struct<kind:string,raw:string>")
    assert [r[0] for r in cells.select(display(F.col("cell"))).collect()] == \
        [None, "2026-01-02 00:00:00", "5"]
    # single-target watermark as a table property (SHOW TBLPROPERTIES, not DESCRIBE)
    S.drop_table(spark, "main.props_t")
    S.ensure_table(spark, "main.props_t", [("x", "INT")])
    assert S.table_property(spark, "main.props_t", "gridflow_sync_watermark") is None
    S.set_table_property(spark, "main.props_t", "gridflow_sync_watermark", "2024-01-01T12:00:00")
    assert S.table_property(spark, "main.props_t", "gridflow_sync_watermark") == "2024-01-01T12:00:00"

"""Driver contract, file landing, SQL and table reads."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from gridflow.sources.documents import diff_snapshot, land_documents, list_documents, read_content
from gridflow.sources.sql import read_table, run_sql
from gridflow.sources.xlsx import write_workbook


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"Date", "Qty", "Price", "SKU"}


def test_every_query_has_an_oracle():
    from gridflow.plans.queries import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())
    assert len(QUERIES) >= 40


def test_shared_folder_goes_through_hadoop(spark, tmp_path):
    from gridflow import session as S
    # a scheme that only Hadoop resolves: a view of the local file system
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.gf.link./shared", f"file://{tmp_path}")
    S.write_bytes(spark, "viewfs://gf/shared/a.zip", b"abc")
    assert (tmp_path / "a.zip").read_bytes() == b"abc"
    S.write_bytes(spark, "viewfs://gf/shared/a.zip", b"other")   # never overwritten
    assert (tmp_path / "a.zip").read_bytes() == b"abc"


def test_no_private_folder_on_a_cluster():
    import pytest

    from gridflow import session as S

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        S.checkpoint_dir(Session())
    assert S.single_machine("local[8]") and not S.single_machine("local-cluster[2,1,1024]")


def test_land_documents_and_listing(spark, tmp_path):
    root = tmp_path / "site"
    (root / "sub").mkdir(parents=True)
    (root / "a.xlsx").write_bytes(write_workbook([("S", [(0, [("n", "1")])])]))
    (root / "sub" / "b.xlsx").write_bytes(b"bytes")
    (root / "c.txt").write_bytes(b"text")
    from gridflow.session import land
    docs = land(land_documents(spark, str(root), pattern="*.xlsx"), "docs")  # the documents table
    names = sorted(r["name"] for r in list_documents(docs).collect())
    assert names == ["a.xlsx", "b.xlsx"]
    got = read_content(docs, [r["file_id"] for r in docs.collect() if r["file_id"].endswith("b.xlsx")]).collect()
    assert bytes(got[0]["content"]) == b"bytes"
    # snapshot diff: b vanishes, a unchanged
    os.remove(root / "sub" / "b.xlsx")
    diff = {r["file_id"].split("/")[-1]: (r["change"], r["is_deleted"])
            for r in diff_snapshot(docs, land_documents(spark, str(root), pattern="*.xlsx")).collect()}
    assert diff == {"a.xlsx": ("unchanged", False), "b.xlsx": ("deleted", True)}


def test_run_sql_and_read_table(spark):
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    out = run_sql(spark, "SELECT g, count(*) AS n FROM {t} WHERE id >= :lo GROUP BY g", inputs={"t": df},
                  args={"lo": 4})
    assert sorted(tuple(r) for r in out.collect()) == [(0, 3), (1, 3)]
    before = spark.catalog.currentDatabase()
    spark.sql("CREATE SCHEMA IF NOT EXISTS other_place")
    spark.sql("CREATE TABLE IF NOT EXISTS other_place.only_there USING parquet AS SELECT 7 AS x")
    assert run_sql(spark, "SELECT x FROM only_there", schema="other_place").collect()[0]["x"] == 7
    assert spark.catalog.currentDatabase() == before
    t, msg = read_table(spark, "main.does_not_exist")
    assert t is None and "not found" in msg.lower()


def test_refresh_documents_reads_only_changed_files(spark, tmp_path):
    import time as _t

    from gridflow.session import land
    from gridflow.sources.documents import refresh_documents
    root = tmp_path / "site2"
    root.mkdir()
    for n in ("a", "b", "c"):
        (root / f"{n}.xlsx").write_bytes(n.encode())
    old_ts = _t.time() - 3600
    for n in ("a", "b", "c"):
        os.utime(root / f"{n}.xlsx", (old_ts, old_ts))
    docs = land(land_documents(spark, str(root)), "docs-v1")
    (root / "b.xlsx").write_bytes(b"b2")      # changed (now)
    os.remove(root / "c.xlsx")                 # vanished
    (root / "d.xlsx").write_bytes(b"d")       # new
    (root / "old.xlsx").write_bytes(b"o")     # new, with an older time than any landed file
    os.utime(root / "old.xlsx", (old_ts - 9999, old_ts - 9999))
    (root / "e.xlsx").write_bytes(b"e")
    os.utime(root / "a.xlsx", (old_ts - 5000, old_ts - 5000))   # put back to an older version
    snap = {r["file_id"].split("/")[-1]: (r["change"], r["is_deleted"], bytes(r["content"] or b""))
            for r in refresh_documents(spark, docs, str(root)).collect()}
    assert snap.pop("old.xlsx") == ("new", False, b"o") and snap.pop("e.xlsx") == ("new", False, b"e")
    assert snap == {"a.xlsx": ("changed", False, b"a"), "b.xlsx": ("changed", False, b"b2"),
                    "c.xlsx": ("deleted", True, b"c"), "d.xlsx": ("new", False, b"d")}


def test_land_and_release(spark):
    from gridflow.session import land, local_path, release
    df = land(spark.range(5), "release-test")
    path = local_path(df._gridflow_scratch)
    assert os.path.isdir(path) and df.count() == 5
    release(df)
    assert not os.path.exists(path)
    release(df)   # second release is a no-op


def test_refresh_opens_files_by_exact_name(spark, tmp_path, monkeypatch):
    """Names that would be patterns land, and only they; names come to the driver a part at a time."""
    from gridflow.sources import documents as D
    monkeypatch.setattr(D, "NAMES_AT_ONCE", 3)
    root = tmp_path / "odd"
    root.mkdir()
    names = ["a[1].xlsx", "a1.xlsx", "b{x,y}.xlsx", "bx.xlsx", "c*.xlsx", "cc.xlsx", "d e.xlsx", "f#%20.xlsx", "h^.xlsx"]
    for n in names:
        (root / n).write_bytes(n.encode())
    empty = D.land_documents(spark, str(root)).limit(0)
    got = {r["file_metadata"]["name"]: (bytes(r["content"]), r["change"]) for r in D.refresh_documents(spark, empty, str(root)).collect()}
    assert got == {n: (n.encode(), "new") for n in names}


def test_diff_of_null_and_repeated_ids(spark):
    import datetime as dt

    from gridflow.sources import documents as D
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ddl = ("file_id string, file_metadata struct<name:string, size_in_bytes:bigint, last_modified_timestamp:timestamp, "
           "created_timestamp:timestamp>, content binary, is_deleted boolean")
    row = lambda i, h, c, gone=False: (i, (i, len(c), t(h), None), bytearray(c), gone)
    old = spark.createDataFrame([row("a", 1, b"a1"), row("a", 2, b"a2x"), row("b", 1, b"b"), row("d", 1, b"d"), row(None, 1, b"?")], ddl)
    new = spark.createDataFrame([row("a", 2, b"a2y"), row("b", 3, b"b3"), row("b", 2, b"b2"), row("c", 1, b"c"), row(None, 1, b"!")], ddl)
    got = {r["file_id"]: (r["change"], bytes(r["content"]), r["is_deleted"]) for r in D.diff_snapshot(old, new).collect()}
    assert got == {"a": ("unchanged", b"a2x", False), "b": ("changed", b"b3", False), "c": ("new", b"c", False), "d": ("deleted", b"d", True)}
    plan = D.diff_snapshot(old, new).select("file_id", "change")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and plan.count("Join ") == 1 and "content" not in plan.split("LogicalRDD")[0]

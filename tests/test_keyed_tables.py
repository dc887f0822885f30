"""Stored keyed tables: versions, files that stay, readers during changes, rejects, vacuum."""

import threading

import pytest
from pyspark.sql import functions as F

from gridflow.sinks import keyed_tables as K

DDL = "id string, v long, `a b` string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def base(spark, n=400):
    return spark.range(n).select(F.format_string("k%04d", "id").alias("id"), F.col("id").alias("v"), F.lit("x").alias("a b"))


def files(spark, name):
    """range -> names of the files that the current version reads."""
    s = K.snapshot(spark, name)
    d = spark.table(s.data).where(s.where()).select(K.RANGE, F.col("_metadata.file_path").alias("f")).distinct().collect()
    out = {}
    for r in d:
        out.setdefault(r[K.RANGE], set()).add(r["f"])
    return out


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_rewrite_touched_ranges_only(spark):
    name = "main.kt_files"
    K.create_keyed(base(spark), name, "id", 8)
    assert sorted(files(spark, name)) == list(range(8))
    expect = {r[0]: r for r in rows(base(spark))}
    first = files(spark, name)
    n, rejects = K.insert_keyed(frame(spark, [("k0003", 1, "dup"), ("k0003x", 2, "new"), ("zz", 3, "two"), ("zz", 4, "two"), (None, 5, "n")]), name)
    assert n == 1 and sorted((r["reason"], r["v"]) for r in rejects.collect()) == [
        ("duplicate key", 1), ("null key", 5), ("repeated in batch", 3), ("repeated in batch", 4)]
    expect["k0003x"] = ("k0003x", 2, "new")
    second = files(spark, name)
    assert {r for r in second if second[r] != first[r]} == {0} and first[0] < second[0]     # a file more, none rewritten
    assert K.update_keyed(spark, name, F.col("v").isin(120, 121), {"a b": F.concat("a b", F.lit("!")), "v": 0}) == 2
    for k in ("k0120", "k0121"):
        expect[k] = (k, 0, "x!")
    third = files(spark, name)
    assert [r for r in third if third[r] != second[r]] == [2] and not third[2] & second[2]
    gone = K.delete_keyed(spark, name, F.col("id") >= "k0399")
    assert rows(gone) == [("k0399", 399, "x")] and gone.columns == ["id", "v", "a b"]
    del expect["k0399"]
    fourth = files(spark, name)
    assert [r for r in fourth if fourth[r] != third[r]] == [7]
    assert rows(spark.table(name)) == sorted(expect.values())
    assert K.delete_keyed(spark, name, F.col("id") >= "k0399").count() == 0                 # again: nothing, no version
    assert K.update_keyed(spark, name, F.col("v") == -1, {"v": 1}) == 0
    assert K.snapshot(spark, name).version == 3
    assert K.upsert_keyed(frame(spark, [("k0000", -1, "u"), ("k0399", -2, "u")]), name) == (1, 1)
    expect |= {"k0000": ("k0000", -1, "u"), "k0399": ("k0399", -2, "u")}
    fifth = files(spark, name)
    assert [r for r in fifth if fifth[r] != fourth[r]] == [0, 7]
    assert not fifth[0] & fourth[0] and fourth[7] < fifth[7]       # rewritten; a file more
    assert rows(spark.table(name)) == sorted(expect.values())
    K.drop_keyed(spark, name)
    assert not [t.name for t in spark.catalog.listTables("main") if t.name.startswith("kt_files")]


def test_versions_stay_readable_until_vacuum(spark):
    name = "main.kt_versions"
    K.create_keyed(base(spark, 40), name, "id", 4)
    for i in range(7):
        K.update_keyed(spark, name, F.col("id") == "k0000", {"v": 100 + i})
    value = lambda v=None: K.read_keyed(spark, name, v).where("id = 'k0000'").first()["v"]
    assert value() == 106 and [value(v) for v in range(3, 8)] == [102, 103, 104, 105, 106]
    with pytest.raises(K.KeyedTableError):
        K.read_keyed(spark, name, 2)
    assert K.vacuum_keyed(spark, name, kept=2) == 6            # the first range's folders of versions 0 to 5
    assert value() == 106 and value(6) == 105
    with pytest.raises(K.KeyedTableError):
        K.read_keyed(spark, name, 5)
    assert K.vacuum_keyed(spark, name, kept=2) == 0
    assert spark.table(name).count() == 40
    K.drop_keyed(spark, name)


def test_readers_see_whole_versions_during_changes(spark):
    """Each version has the same value in every row; a reader never sees two, and never no table."""
    name = "main.kt_readers"
    fresh = lambda v: base(spark, 60).withColumn("v", F.lit(v).cast("long"))
    K.create_keyed(fresh(0), name, "id", 3)
    seen, wrong, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                got = spark.table(name).groupBy("v").count().collect()
                if len(got) != 1 or got[0]["count"] != 60:
                    wrong.append(got)
                seen.add(got[0]["v"])
            except Exception as e:  # noqa: BLE001
                wrong.append(e)
    t = threading.Thread(target=read)
    t.start()
    try:
        for v in range(1, 4):
            K.update_keyed(spark, name, F.lit(True), {"v": v})
        K.create_keyed(fresh(9), name, "id", 2)                       # replaced as a whole
        K.create_keyed(fresh(10).withColumn("more", F.lit(1)), name, "id", 2)     # and with other columns
    finally:
        stop.set()
        t.join()
    assert not wrong and len(seen) >= 2
    assert spark.table(name).columns == ["id", "v", "a b", "more"]
    K.vacuum_keyed(spark, name)
    assert len([x for x in spark.catalog.listTables("main") if x.name.startswith("kt_readers__data")]) == 1
    assert spark.table(name).count() == 60
    K.drop_keyed(spark, name)


def test_a_change_that_breaks_off_leaves_the_version(spark, monkeypatch):
    name = "main.kt_broken"
    K.create_keyed(base(spark, 30), name, "id", 3)
    before = rows(spark.table(name))

    def fail(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(K, "_commit", fail)
        with pytest.raises(RuntimeError):
            K.update_keyed(spark, name, F.lit(True), {"v": -1})
    assert rows(spark.table(name)) == before and K.snapshot(spark, name).version == 0
    K.update_keyed(spark, name, F.col("id") == "k0001", {"v": -5})     # the folders of the lost try do not come back
    assert sorted(r["v"] for r in spark.table(name).collect()) == sorted([-5] + [v for _, v, _ in before if v != 1])
    K.drop_keyed(spark, name)


def test_writers_take_turns(spark):
    name = "main.kt_turns"
    K.create_keyed(base(spark, 10), name, "id", 2)
    stale = K.snapshot(spark, name)
    K.update_keyed(spark, name, F.col("id") == "k0001", {"v": 5})
    with pytest.raises(K.KeyedTableError, match="has changed"):
        K._commit(spark, name, stale, K._next(stale))
    K.drop_keyed(spark, name)


def test_odd_tables(spark):
    name = "main.kt_odd"
    K.create_keyed(base(spark, 0), name, "id", 4)                     # empty
    assert spark.table(name).count() == 0
    assert K.insert_keyed(frame(spark, []), name)[0] == 0
    assert K.insert_keyed(frame(spark, [("b", 1, None), ("a", None, "q")]), name)[0] == 2
    assert rows(K.delete_keyed(spark, name, F.col("v") > 0)) == [("b", 1, None)]      # a null condition keeps the row
    assert K.delete_keyed(spark, name, F.lit(True)).count() == 1 and spark.table(name).count() == 0
    K.drop_keyed(spark, name)
    for bad in ([("a", 1, ""), ("a", 2, "")], [(None, 1, "")]):
        with pytest.raises(K.KeyedTableError):
            K.create_keyed(frame(spark, bad), "main.kt_bad", "id")
    with pytest.raises(K.KeyedTableError):
        K.read_keyed(spark, "main.kt_none")
    K.create_keyed(spark.createDataFrame([(-5, 1.5), (3, 2.5), (40, 3.5)], "k int, x double"), "main.kt_int", "k", 3)
    assert K.insert_keyed(spark.createDataFrame([(-7, 0.0), (3, 9.9), (1000, 1.0)], "k int, x double"), "main.kt_int")[0] == 2
    assert [r["k"] for r in spark.table("main.kt_int").orderBy("k").collect()] == [-7, -5, 3, 40, 1000]
    with pytest.raises(K.KeyedTableError):
        K.update_keyed(spark, "main.kt_int", F.lit(True), {"k": 1})
    K.drop_keyed(spark, "main.kt_int")

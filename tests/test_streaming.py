"""Debounce (batch and streaming) and the workbook sync stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridflow.session import scratch_path
from gridflow.sources.xlsx import write_workbook
from gridflow.streaming.debounce import debounce_stream, debounce_triggers
from gridflow.streaming.sync_stream import StreamConfig, stream_status, stream_sync

T0 = dt.datetime(2024, 1, 1)


def fires(spark, events, gap="60 seconds", **kw):
    df = spark.createDataFrame([(t, T0 + dt.timedelta(seconds=s)) for t, s in events], "table_name string, ts timestamp")
    return sorted((r["table_name"], (r["fire_at"] - T0).total_seconds(), r["n_changes"])
                  for r in debounce_triggers(df, gap, **kw).collect())


@pytest.mark.parametrize("secs,expected", [
    ([0, 30], [("t", 90.0, 2)]),                        # FIXTURES 11: one fire at 00:01:30
    ([0, 60], [("t", 120.0, 2)]),                       # exactly 60 s apart: one burst
    ([0, 61], [("t", 60.0, 1), ("t", 121.0, 1)]),       # two fires
])
def test_debounce_fixture(spark, secs, expected):
    assert fires(spark, [("t", s) for s in secs]) == expected


def brute(events, gap):
    out = []
    for t in sorted({k for k, _ in events}):
        ts = sorted(s for k, s in events if k == t)
        start = prev = ts[0]
        n = 0
        for s in ts:
            if s - prev > gap:
                out.append((t, prev + gap, n))
                start, n = s, 0
            n += 1
            prev = s
        out.append((t, prev + gap, n))
        del start
    return sorted((t, float(f), n) for t, f, n in out)


def test_debounce_hot_key_across_partitions(spark):
    rnd = random.Random(7)
    events = [("hot", rnd.randint(0, 20000)) for _ in range(3000)] + \
             [(f"t{i % 7}", rnd.randint(0, 20000)) for i in range(600)]
    assert fires(spark, events, partitions=16) == brute(events, 60)
    groups = spark.createDataFrame([(f"t{i}", "g") for i in range(7)] + [("hot", "g")],
                                   "table_name string, group_name string")
    df = spark.createDataFrame([(t, T0 + dt.timedelta(seconds=s)) for t, s in events], "table_name string, ts timestamp")
    got = sorted(((r["fire_at"] - T0).total_seconds(), r["n_changes"])
                 for r in debounce_triggers(df, 300, group_map=groups, partitions=16).collect())
    assert got == [(f, n) for _, f, n in brute([("g", s) for _, s in events], 300)]


def test_debounce_stream_matches_batch(spark, tmp_path):
    events = [("a", 0), ("a", 30), ("b", 10), ("a", 200), ("b", 500), ("z", 5000)]  # z closes the others
    src = str(tmp_path / "ev")
    spark.createDataFrame([(t, T0 + dt.timedelta(seconds=s)) for t, s in events],
                          "table_name string, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("table_name string, ts timestamp").parquet(src)
    q = (debounce_stream(stream, "60 seconds").writeStream.format("memory").queryName("deb")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["table_name"], (r["fire_at"] - T0).total_seconds(), r["n_changes"])
                 for r in spark.table("deb").collect())
    batch = [x for x in fires(spark, events) if x[0] != "z"]
    assert got == batch


SHEET = [(0, [("s", "Date"), ("s", "Qty")]), (1, [("d", "2024-01-01 00:00:00"), ("n", "1")]),
         (2, [("d", "2024-01-02 00:00:00"), ("n", "2")])]


def _land(spark, path, files, ts, deleted=()):
    rows = []
    for fid, b in files.items():
        rows.append((fid, (fid.split("/")[-1], len(b), ts, ts), bytearray(b), fid in deleted))
    (spark.createDataFrame(rows, "file_id string, file_metadata struct<name:string, size_in_bytes:bigint, "
                                 "last_modified_timestamp:timestamp_ntz, created_timestamp:timestamp_ntz>, "
                                 "content binary, is_deleted boolean")
     .write.mode("append").parquet(path))


def test_stream_sync_update_delete_and_restart(spark):
    base = scratch_path(spark, "stream-test")
    landing = f"{base}/landing"
    cfg = StreamConfig(target_table="main.stream_t", state_table="main.stream_state",
                       checkpoint=f"{base}/ckpt", pattern="*.xlsx", header_row=0, trigger="availableNow")
    wb = write_workbook([("S", SHEET)])
    _land(spark, landing, {"/d/a.xlsx": wb, "/d/b.xlsx": wb, "/d/skip.csv": b"x"}, T0)
    stream_sync(spark, landing, cfg).awaitTermination()
    t = spark.table("main.stream_t")
    assert sorted((r["source_file"], r["Qty"]) for r in t.collect()) == \
        [("/d/a.xlsx", 1), ("/d/a.xlsx", 2), ("/d/b.xlsx", 1), ("/d/b.xlsx", 2)]
    # restart with nothing new: the checkpoint means no batch, nothing added
    stream_sync(spark, landing, cfg).awaitTermination()
    spark.catalog.refreshTable("main.stream_t")
    assert spark.table("main.stream_t").count() == 4
    # a = newer version with 3 rows, b deleted
    wb3 = write_workbook([("S", SHEET + [(3, [("d", "2024-01-03 00:00:00"), ("n", "3")])])])
    _land(spark, landing, {"/d/a.xlsx": wb3, "/d/b.xlsx": wb}, T0 + dt.timedelta(hours=1), deleted={"/d/b.xlsx"})
    q = stream_sync(spark, landing, cfg)
    q.awaitTermination()
    spark.catalog.refreshTable("main.stream_t")
    got = sorted((r["source_file"], r["Qty"]) for r in spark.table("main.stream_t").collect())
    assert got == [("/d/a.xlsx", 1), ("/d/a.xlsx", 2), ("/d/a.xlsx", 3)]
    st = stream_status(spark, q, cfg).collect()
    assert len(st) >= 1 and st[-1]["state"] == "TERMINATED"
    assert st[-1]["files_synced"] == 1 and st[-1]["written"] is True
    # b restored with its old modification time: its mark was cleared, so it syncs again
    _land(spark, landing, {"/d/b.xlsx": wb}, T0)
    stream_sync(spark, landing, cfg).awaitTermination()
    spark.catalog.refreshTable("main.stream_t")
    got = sorted((r["source_file"], r["Qty"]) for r in spark.table("main.stream_t").collect())
    assert got == [("/d/a.xlsx", 1), ("/d/a.xlsx", 2), ("/d/a.xlsx", 3), ("/d/b.xlsx", 1), ("/d/b.xlsx", 2)]
    # replaying an old batch is a no-op thanks to the marks
    from gridflow.streaming.sync_stream import sync_batch
    old = spark.read.parquet(landing).filter(F.col("file_metadata.last_modified_timestamp") == F.lit(T0))
    sync_batch(old.filter(F.col("file_id") == "/d/a.xlsx"), 99, cfg)
    spark.catalog.refreshTable("main.stream_t")
    assert spark.table("main.stream_t").count() == 5


def test_debounce_null_key_is_one_group(spark):
    df = spark.createDataFrame([(None, T0), (None, T0 + dt.timedelta(seconds=30)), ("t", T0)],
                               "table_name string, ts timestamp")
    got = sorted(((r["table_name"] or ""), r["n_changes"]) for r in debounce_triggers(df, 60).collect())
    assert got == [("", 2), ("t", 1)]


def test_debounce_many_changes_at_one_moment(spark):
    """200,000 changes of one table within one second, and no Python worker in the plan."""
    hot = spark.range(200_000).select(F.lit("hot").alias("table_name"), F.timestamp_micros(
        F.lit(1_700_000_000_000_000) + (F.col("id") % 5) * 250_000).alias("ts"))
    late = spark.range(3).select(F.lit("hot").alias("table_name"), F.timestamp_micros(
        F.lit(1_700_000_100_000_000) + F.col("id")).alias("ts"))
    out = debounce_triggers(hot.unionByName(late), "60 seconds", partitions=8)
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("MapInPandas", "MapInArrow", "ArrowEvalPython", "FlatMapGroupsInPandas"))
    assert sorted(r["n_changes"] for r in out.collect()) == [3, 200_000]


def test_debounce_random_keys_and_gaps(spark):
    rnd = random.Random(11)
    events = [(rnd.choice(["a", "b", "hot", "hot", "hot"]), rnd.randint(0, 3000)) for _ in range(2500)]
    for gap, parts in ((0, 5), (1, 16), (2, 3), (10_000, 7)):
        assert fires(spark, events, gap, partitions=parts) == brute(events, gap)


def test_marks_are_dealt_by_core_and_batches_by_session(spark, tmp_path, monkeypatch):
    """A partition of the marks costs a Python worker in every batch: as many as cores, whatever shuffles of data use."""
    import os

    from gridflow.streaming import sync_stream as M
    docs = spark.createDataFrame([(f"f{i}.xlsx", (f"f{i}.xlsx", 1, T0, T0), None, False) for i in range(20)], M.DOCUMENTS_DDL)
    docs.write.parquet(str(tmp_path / "landing"))
    seen = []
    monkeypatch.setattr(M, "_load_changes", lambda s, changes, epoch, cfg: seen.append((s.conf.get(M.SHUFFLES), changes.count())))
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get(M.SHUFFLES)
    spark.conf.set(M.SHUFFLES, str(cores + 5))
    try:
        for name, asked, want in (("a", None, cores), ("b", 2, 2)):
            cfg = StreamConfig("marks_dealt.t", "marks_dealt.s", str(tmp_path / name), trigger="availableNow", state_partitions=asked)
            stream_sync(spark, str(tmp_path / "landing"), cfg).awaitTermination()
            assert len([d for d in os.listdir(tmp_path / name / "state" / "0") if d.isdigit()]) == want
            assert spark.conf.get(M.SHUFFLES) == str(cores + 5)
    finally:
        spark.conf.set(M.SHUFFLES, before)
    assert seen == [(str(cores + 5), 20)] * 2


def _marks_one_by_one(known, versions, expires):
    """``pass_on`` file by file, on dictionaries: {file: (time, deleted, expires)} -> (what passed, the marks after)."""
    marks, passed = dict(known), set()
    for f in {v[0] for v in versions}:
        best = max((v for v in versions if v[0] == f), key=lambda v: (v[2], v[1], max(v[3], 0), v[4]))
        _, deleted, us, size, landed = best
        mark = known.get(f)
        gone = mark is not None and mark[1]
        newer = mark is None or mark[0] == M_NONE or us > mark[0]
        if deleted and (mark is None or gone or not (newer or us == mark[0])) or not deleted and not (gone or newer):
            continue
        marks[f] = (us, deleted, expires if deleted else M_NONE)
        passed.add((f, deleted, us, size, landed, gone and not deleted))
    return passed, marks


M_NONE = -(1 << 63)


def test_marks_of_a_group_are_those_of_each_file():
    import pandas as pd

    from gridflow.streaming.sync_stream import _MARKS, newest_versions, pass_on
    rnd = random.Random(5)
    stored, known = _MARKS.empty_table(), {}
    for batch in range(40):
        rows = [(f"f{rnd.randrange(12)}", rnd.random() < 0.3, rnd.choice([M_NONE, *range(6)]), rnd.choice([M_NONE, 0, 5, 9]), rnd.choice("xy"))
                for _ in range(rnd.randrange(1, 15))]
        rows = list({(r[0], r[1], r[2], max(r[3], 0), r[4]): r for r in rows}.values())      # no two that are as new as each other
        frame = pd.DataFrame(rows, columns=["file_id", "deleted", "file_us", "file_size", "landed"])
        changes, stored = pass_on(stored, newest_versions(frame), batch)
        passed, known = _marks_one_by_one(known, rows, batch)
        assert set(changes.itertuples(index=False, name=None)) == passed
        assert {r["file_id"]: (r["file_us"], r["deleted"], r["expires"]) for r in stored.to_pylist()} == known


def test_marks_of_many_files_are_kept_by_group(spark, tmp_path, monkeypatch):
    """State is read and written by group of files: its rows do not grow with the files. A second stream run finds every mark."""
    from gridflow.streaming import sync_stream as M
    n = 4 * M.MARK_GROUPS
    name = F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".xlsx"))
    stamp = F.lit(T0).cast("timestamp_ntz")
    docs = spark.range(n).select(name.alias("file_id"), F.struct(name.alias("name"), F.lit(1).cast("long").alias("size_in_bytes"), stamp.alias(
        "last_modified_timestamp"), stamp.alias("created_timestamp")).alias("file_metadata"), F.lit(None).cast("binary").alias("content"),
        F.lit(False).alias("is_deleted"))
    seen = []
    monkeypatch.setattr(M, "_load_changes", lambda s, changes, epoch, cfg: seen.append(changes.groupBy("deleted", "restored").count().collect()))
    cfg = StreamConfig("marks_grouped.t", "marks_grouped.s", str(tmp_path / "ckpt"), trigger="availableNow", tombstone_hours=24)

    def run(d):
        d.write.mode("append").parquet(str(tmp_path / "landing"))
        q = stream_sync(spark, str(tmp_path / "landing"), cfg)
        q.awaitTermination()
        return sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    rows = run(docs)
    assert 0 < rows <= 2 * M.MARK_GROUPS < n
    later = F.col("file_metadata").withField("last_modified_timestamp", F.lit(T0 + dt.timedelta(hours=1)).cast("timestamp_ntz"))
    half = docs.where("file_id < 'f5'")
    run(docs.where("file_id >= 'f5'").unionByName(half.withColumn("is_deleted", F.lit(True)).withColumn("file_metadata", later)))
    run(docs)       # the deleted ones come back with their old time
    k = half.count()
    assert [[(r["deleted"], r["restored"], r["count"]) for r in b] for b in seen] == [[(False, False, n)], [(True, False, k)], [(False, True, k)]]

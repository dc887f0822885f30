"""Append-only loads, recorded marks, per-file state of the stream, run table."""

import datetime as dt
import time

from pyspark.sql import functions as F

from gridflow.session import scratch_path
from gridflow.sinks import loads as L
from gridflow.sinks import tables as S
from gridflow.streaming import runs
from gridflow.streaming.sync_stream import StreamConfig, file_changes, runs_folder, stream_status, stream_sync
from gridflow.sources.xlsx import write_workbook

T0 = dt.datetime(2024, 1, 1)
KIND = [("a", "bigint"), ("b", "string")]


def load(spark, target, files, gone=(), kind=KIND, batch=None, source="s"):
    """files: {file: [(a, b)]}; gone: files without a new version."""
    ddl = ", ".join(f"{c} {t}" for c, t in kind) + ", source_file string"
    rows = spark.createDataFrame([(*r, f) for f, rs in files.items() for r in rs], ddl) if files else None
    sup = spark.createDataFrame([(f,) for f in (*files, *gone)], "source_file string")
    return L.append_load(spark, target, rows, sup, kind if files else (), source, batch)


def rows(spark, target):
    return sorted(tuple(r) for r in spark.table(target).collect())


def stored_files(spark, target):
    out = {}
    for t in L._tables(spark, target, "rows"):
        for r in spark.table(t).select(L.LOAD, F.col("_metadata.file_path").alias("f")).distinct().collect():
            out.setdefault(r[L.LOAD], set()).add(r["f"])
    return out


def test_loads_append_and_supersede(spark):
    t = "main.ld_basic"
    load(spark, t, {"x": [(1, "x1"), (2, "x2")], "y": [(3, "y1")]})
    first = stored_files(spark, t)
    load(spark, t, {"x": [(9, "x9")]})
    load(spark, t, {}, gone=["y"])
    assert rows(spark, t) == [(9, "x9", "x")]
    now = stored_files(spark, t)
    assert now[1] == first[1] and set(now) == {1, 2}            # what was there is not touched
    load(spark, t, {"y": [(4, "back")]})
    assert rows(spark, t) == [(4, "back", "y"), (9, "x9", "x")]
    assert {r[L.LOAD]: (r["rows"], r["live"]) for r in L.live_loads(spark, t).collect()} == {1: (3, 0), 2: (1, 1), 4: (1, 1)}
    L.drop_loads(spark, t)
    assert not [x.name for x in spark.catalog.listTables("main") if x.name.startswith("ld_basic")]


def test_compaction_keeps_rows_and_large_loads(spark):
    t = "main.ld_compact"
    load(spark, t, {f"big{i}": [(j, "b") for j in range(50)] for i in range(4)})
    for i in range(6):
        load(spark, t, {"s": [(i, "small")], f"s{i}": [(i, "other")]})
    load(spark, t, {}, gone=["s3"])
    before = rows(spark, t)
    big = stored_files(spark, t)[1]
    assert L.compact_loads(spark, t, max_superseded=0.2, small=20) == 6
    assert rows(spark, t) == before
    after = stored_files(spark, t)
    assert after[1] == big and len(after) == 2
    assert L.compact_loads(spark, t, max_superseded=0.2, small=20) == 0
    load(spark, t, {"s": [(99, "new")], "big0": [(1, "short")]})
    want = sorted([r for r in before if r[2] not in ("s", "big0")] + [(99, "new", "s"), (1, "short", "big0")])
    assert rows(spark, t) == want
    assert L.compact_loads(spark, t, max_superseded=0.1, small=1) >= 1 and rows(spark, t) == want
    L.compact_loads(spark, t, max_superseded=-1, small=10**9)
    assert rows(spark, t) == want and len(stored_files(spark, t)) == 1
    assert spark.table(f"{t}__superseded").count() == 0
    L.drop_loads(spark, t)


def test_wider_types_open_a_table(spark):
    t = "main.ld_wide"
    load(spark, t, {"x": [(1, "x1")], "y": [(2, "y1")]})
    load(spark, t, {"x": [(1.5, "x2")]}, kind=[("a", "double"), ("b", "string")])
    assert rows(spark, t) == [(1.5, "x2", "x"), (2.0, "y1", "y")] and dict(spark.table(t).dtypes)["a"] == "double"
    assert len(L._tables(spark, t, "rows")) == 2
    L.compact_loads(spark, t)
    assert rows(spark, t) == [(1.5, "x2", "x"), (2.0, "y1", "y")]
    L.drop_loads(spark, t)


def test_a_load_that_broke_off_is_not_there(spark, monkeypatch):
    t = "main.ld_broken"
    load(spark, t, {"x": [(1, "x1")]}, batch=0)
    with monkeypatch.context() as m:
        m.setattr(L, "_commit", lambda *a: 1 / 0)
        try:
            load(spark, t, {"x": [(2, "lost")], "z": [(3, "lost")]}, batch=1)
        except ZeroDivisionError:
            pass
    assert rows(spark, t) == [(1, "x1", "x")]
    assert L.committed(spark, t, "s", 0) and not L.committed(spark, t, "s", 1) and not L.committed(spark, t, "other", 0)
    load(spark, t, {"x": [(4, "again")]}, batch=1)
    assert rows(spark, t) == [(4, "again", "x")]
    L.compact_loads(spark, t)
    assert rows(spark, t) == [(4, "again", "x")] and all(2 != k for k in stored_files(spark, t))
    L.drop_loads(spark, t)


def marks(spark, name):
    return {r["file_id"]: r["watermark"] for r in S.current_marks(S.read_marks(spark, name)).collect() if r["watermark"]}


def test_marks_after_clear_restore_and_compaction(spark):
    name = "main.mk_t"
    put = lambda rs: S.advance_watermark(spark, name, spark.createDataFrame(
        [("t", f, w) for f, w in rs], "target_table string, file_id string, watermark timestamp"))
    hour = lambda h: T0 + dt.timedelta(hours=h)
    put([(f"f{i}", hour(0)) for i in range(60)])
    assert S.compact_state(spark, name) > 20 and len(marks(spark, name)) == 60
    files = lambda: {r["f"] for r in spark.table(name).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = files()
    put([("f1", hour(2)), ("f1", hour(1))])                       # twice in one call: the higher
    S.clear_watermark(spark, name, spark.createDataFrame([("t", "f2")], "target_table string, file_id string"))
    got = marks(spark, name)
    assert got["f1"] == hour(2) and "f2" not in got and len(got) == 59
    assert S.compact_state(spark, name) <= 2
    assert len(before & files()) >= len(before) - 2               # untouched buckets keep their files
    assert marks(spark, name) == got
    put([("f2", hour(0))])                                        # restored with its old time
    assert marks(spark, name)["f2"] == hour(0)
    assert S.compact_state(spark, name) == 1 and S.compact_state(spark, name) == 0
    assert marks(spark, name) == {**got, "f2": hour(0)}
    put([("f3", hour(3))])
    keys = spark.createDataFrame([("t", "f3")], "target_table string, file_id string")
    pruned = S.read_marks(spark, name, keys)
    assert {r["bucket"] for r in pruned.select("bucket").distinct().collect()} <= {
        S.DELTA, keys.select(S.mark_bucket(F.col("target_table"), F.col("file_id"))).first()[0]}
    assert "PartitionFilters: [" in pruned._jdf.queryExecution().toString() and S.current_marks(pruned).where("file_id = 'f3'").first()["watermark"] == hour(3)
    S.drop_table(spark, name)
    assert S.read_marks(spark, name) is None


DOCS = ("file_id string, file_metadata struct<name:string, size_in_bytes:bigint, last_modified_timestamp:timestamp_ntz, "
        "created_timestamp:timestamp_ntz>, content binary, is_deleted boolean")


def put_docs(spark, path, versions):
    """versions: (file, hour, value or None for deleted)"""
    out = []
    for f, h, v in versions:
        b = b"" if v is None else write_workbook([("S", [(0, [("s", "k")]), (1, [("n", str(v))])])])
        ts = T0 + dt.timedelta(hours=h)
        out.append((f, (f, len(b), ts, ts), bytearray(b), v is None))
    spark.createDataFrame(out, DOCS).coalesce(1).write.mode("append").parquet(path)


def test_state_decides_which_versions_pass(spark):
    """Older, equal and newer versions, deletions and restored files over several batches and a restart. No marks
    are recorded by hand and the target is not asked: only the state can tell."""
    base = scratch_path(spark, "state-test")
    cfg = StreamConfig("main.st_t", "main.st_state", f"{base}/ckpt", trigger="availableNow", max_files_per_trigger=1)
    landing = f"{base}/landing"

    def run():
        stream_sync(spark, landing, cfg).awaitTermination()
        return sorted((r["source_file"], r["k"]) for r in spark.table("main.st_t").collect())
    put_docs(spark, landing, [("a.xlsx", 5, 1), ("b.xlsx", 5, 2), ("c.xlsx", 5, 3), ("a.xlsx", 4, 0), ("n.csv", 5, 7)])
    assert run() == [("a.xlsx", 1), ("b.xlsx", 2), ("c.xlsx", 3)]
    S.drop_table(spark, "main.st_state")                       # the recorded marks are not what decides
    put_docs(spark, landing, [("a.xlsx", 4, 10), ("b.xlsx", 5, 20), ("c.xlsx", 6, 30)])     # older, equal, newer
    put_docs(spark, landing, [("a.xlsx", 3, None), ("b.xlsx", 7, None), ("d.xlsx", 1, None)])  # old deletion, deletion, unknown
    assert run() == [("a.xlsx", 1), ("c.xlsx", 30)]
    put_docs(spark, landing, [("b.xlsx", 5, 21), ("c.xlsx", 6, 31), ("d.xlsx", 1, 4)])      # restored with an old time, equal, new
    assert run() == [("a.xlsx", 1), ("b.xlsx", 21), ("c.xlsx", 30), ("d.xlsx", 4)]
    loads = spark.table("main.st_t__loads").select("n_rows").collect()
    assert sorted(r[0] for r in loads) == [0, 1, 2, 3]                                      # each batch wrote its own rows
    L.drop_loads(spark, "main.st_t")
    S.drop_table(spark, "main.st_state")


def test_run_table_has_every_batch_and_outlives_the_query(spark):
    """150 batches give 150 rows, though Spark remembers 100."""
    base = scratch_path(spark, "runs-test")
    name, folder = "runs test", f"{base}/runs"
    runs.run_listener(spark).watch(name, folder, lambda b: {"files_synced": b % 3})
    spark.range(150).repartition(150).write.parquet(f"{base}/in")
    q = (spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in").writeStream.queryName(name)
         .foreachBatch(lambda d, e: None).option("checkpointLocation", f"{base}/c").trigger(availableNow=True).start())
    q.awaitTermination()
    n = len([f for f in spark.read.format("binaryFile").load(f"{base}/in/*.parquet").select("path").collect()])
    for _ in range(60):
        got = runs.read_runs(spark, folder).collect()
        if len(got) >= n:
            break
        time.sleep(0.5)
    assert n > 100 and sorted(r["batch_id"] for r in got) == list(range(n))
    assert all(r["files_synced"] == r["batch_id"] % 3 and r["duration_ms"] is not None for r in got)
    assert runs.read_runs(spark, f"{base}/none").collect() == []

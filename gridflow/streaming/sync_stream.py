"""Continuous workbook -> table sync.

The documents table is read as a parquet file stream: every landing appends
files, so each micro-batch holds new document versions.

1. The stream itself carries metadata only. A stateful operator keyed by group of files (``FileMarks``) holds
   the version of each file last passed on and lets through what is newer: older and equal versions, and
   batches replayed, change nothing (I4). Deleted files leave a tombstone, which a timer clears.
2. Per micro-batch, contents of the versions let through are read from the landed files they lie in, decoded
   once (A4), and cast to the target's columns, widened where a batch needs it.
3. They are appended as a load (``gridflow.sinks.loads``): the batch writes its own rows and which files'
   older rows they supersede, nothing else. The load's commit is the batch's; a batch that ran before is skipped.
4. Marks are recorded for other jobs, and a row for the run table.

``sync_batch`` does the same for a batch DataFrame, gated by the recorded marks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gridflow.functions.cells import widen
from gridflow.functions.filters import glob_match
from gridflow.operators import grid as G
from gridflow.operators.gate import sync_gate
from gridflow.operators.keyed import latest_per_key
from gridflow.plans.jobs import build_typed
from gridflow.session import land, release
from gridflow.sinks import loads as L
from gridflow.sinks import tables as S
from gridflow.sources.workbook import decode_workbooks, grid_rows
from gridflow.streaming.runs import RUN_DDL, read_runs, run_listener

DOCUMENTS_DDL = ("file_id string, file_metadata struct<name:string, size_in_bytes:bigint, "
                 "last_modified_timestamp:timestamp_ntz, created_timestamp:timestamp_ntz>, "
                 "content binary, is_deleted boolean")
# Trigger intervals offered for a sync stream
TRIGGER_CHOICES = ("10 seconds", "30 seconds", "1 minute", "5 minutes")


@dataclass
class StreamConfig:
    target_table: str
    state_table: str
    checkpoint: str
    pattern: str | list[str] = "*.xlsx"
    header_row: int = 0
    selected_columns: list[str] | None = None
    trigger: str = "10 seconds"           # or "availableNow"
    active: bool = True
    max_files_per_trigger: int | None = None
    tombstone_hours: float = 24 * 30      # how long a deleted file is remembered
    state_partitions: int | None = None   # partitions of the marks (None: a core each); fixed when the checkpoint begins
    documents_ddl: str = DOCUMENTS_DDL
    log: list = field(default_factory=list)


# ---- per-file marks as operator state (I4) -------------------------------------
# times are microseconds in here: whole numbers compare the same in every time zone
CHANGES_DDL = "file_id string, deleted boolean, file_us long, file_size long, landed string, restored boolean"
STATE_DDL = "marks binary"
# Marks are kept by group of files: each read or write of state is a message between the Python worker and Spark, so
# a batch of very many files sends a few messages a group, not a few a file. Fixed when a checkpoint begins.
MARK_GROUPS = 256
_NONE = -(1 << 63)        # a time or size that is NULL: older than any other
_MARKS = pa.schema([("file_id", pa.string()), ("file_us", pa.int64()), ("file_size", pa.int64()), ("deleted", pa.bool_()),
                    ("expires", pa.int64())])


class FileMarks(StatefulProcessor):
    """Per file, the version last passed on. Of the versions that a batch brings the newest counts (of equal times a deletion,
    then the larger); it passes if it is newer than the state. Any live version of a deleted file is a
    restored one and passes, whatever its time. A deletion passes once, and not if older than the state."""

    def __init__(self, tombstone_ms: int):
        self.tombstone_ms = tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", STATE_DDL)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = None
        for part in rows:
            new = newest_versions(part if new is None else pd.concat([new, part], ignore_index=True))
        known = self._known()
        expires = timerValues.getCurrentWatermarkInMs() + self.tombstone_ms
        changes, marks = pass_on(known, new, expires)
        if not len(changes):
            return
        self._keep(marks)
        if changes["deleted"].any():
            self.handle.registerTimer(expires)
        yield changes

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known = self._known()
        over = pc.and_(known["deleted"], pc.less_equal(known["expires"], expiredTimerInfo.getExpiryTimeInMs()))
        self._keep(known.filter(pc.invert(over)))
        return iter(())

    def close(self) -> None:
        pass

    def _known(self) -> pa.Table:
        stored = self.marks.get()
        return pa.ipc.open_stream(bytes(stored[0])).read_all() if stored else _MARKS.empty_table()

    def _keep(self, marks: pa.Table) -> None:
        if not marks.num_rows:
            return self.marks.clear()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _MARKS) as writer:
            writer.write_table(marks.combine_chunks())
        self.marks.update((sink.getvalue().to_pybytes(),))


def newest_versions(rows: pd.DataFrame) -> pd.DataFrame:
    """The newest of the versions of every file."""
    coded = [pa.array(rows[c], pa.string()).dictionary_encode() for c in ("file_id", "landed")]
    file = coded[0].indices.to_numpy()
    if len(coded[0].dictionary) == len(file):
        return rows
    place = np.argsort(np.argsort(np.array(coded[1].dictionary.to_pylist(), dtype=object)))[coded[1].indices.to_numpy()]
    size = rows["file_size"].to_numpy()
    order = np.lexsort((place, np.where(size == _NONE, 0, size), rows["deleted"].to_numpy(), rows["file_us"].to_numpy(), file))
    last = np.append(np.diff(file[order]) != 0, True)
    return rows.iloc[order[last]]


def pass_on(known: pa.Table, new: pd.DataFrame, expires: int) -> tuple[pd.DataFrame, pa.Table]:
    """The versions of ``new`` (one a file) that pass, and the marks after them."""
    ids = pa.array(new["file_id"], pa.string())
    us, deleted = new["file_us"].to_numpy(np.int64), new["deleted"].to_numpy(bool)
    at = pc.fill_null(pc.index_in(ids, known["file_id"].combine_chunks()), -1).to_numpy()
    there = at >= 0
    # (-1 is the row behind the known ones)
    mark = np.append(known["file_us"].to_numpy(), _NONE)[at]
    gone = np.append(known["deleted"].to_numpy(), False)[at]
    newer = (mark == _NONE) | (us > mark)
    passed = np.where(deleted, there & ~gone & (newer | (us == mark)), gone | newer)
    changes = new[["file_id", "deleted", "file_us", "file_size", "landed"]].assign(restored=gone & ~deleted)[passed]
    rest = np.ones(known.num_rows, bool)
    rest[at[passed & there]] = False
    fresh = pa.table([ids.filter(pa.array(passed)), us[passed], np.where(deleted, _NONE, new["file_size"].to_numpy(np.int64))[passed],
                      deleted[passed], np.where(deleted, expires, _NONE)[passed]], schema=_MARKS)
    return changes, pa.concat_tables([known.filter(pa.array(rest)), fresh])


def file_changes(docs: DataFrame, cfg: StreamConfig) -> DataFrame:
    """The stream of versions to sync of a documents stream: ``file_id, deleted, file_ts, file_size, landed, restored``. Event time is the time of
    arrival, so no version is ever late; it only moves the tombstones' timers."""
    known = lambda c: F.coalesce(c, F.lit(_NONE))  # noqa: E731 - no NULL, which pandas would make a float of
    meta = docs.select(
        "file_id", F.coalesce("is_deleted", F.lit(False)).alias("deleted"),
        known(F.unix_micros(F.col("file_metadata.last_modified_timestamp").cast("timestamp"))).alias("file_us"),
        known(F.col("file_metadata.size_in_bytes")).alias("file_size"), F.col("_metadata.file_path").alias("landed"),
        F.col("file_metadata.name").alias("name"), F.current_timestamp().alias("seen_at"))
    meta = meta.where(F.col("file_id").isNotNull() & glob_match(F.col("name"), cfg.pattern)).drop("name")
    group = F.pmod(F.xxhash64("file_id"), F.lit(MARK_GROUPS)).cast("int")
    out = meta.withColumn("mark_group", group).withWatermark("seen_at", "0 seconds").groupBy("mark_group").transformWithStateInPandas(
        statefulProcessor=FileMarks(int(cfg.tombstone_hours * 3_600_000)), outputStructType=CHANGES_DDL, outputMode="Update",
        timeMode="EventTime")
    us, size = (F.nullif(F.col(c), F.lit(_NONE)) for c in ("file_us", "file_size"))
    return out.select("file_id", "deleted", size.alias("file_size"), "landed", "restored", F.timestamp_micros(us).alias("file_ts"))


def sync_batch(batch: DataFrame, epoch_id: int, cfg: StreamConfig) -> None:
    """Sync a batch DataFrame of documents, gated by the recorded marks."""
    spark = batch.sparkSession
    # of versions with one time stamp a deletion is the later, then the larger file
    latest = latest_per_key(batch.select("file_id", "file_metadata", "is_deleted"), "file_id", [
        F.col("file_metadata.last_modified_timestamp").desc(), F.col("is_deleted").desc_nulls_last(),
        F.col("file_metadata.size_in_bytes").desc(), F.col("file_metadata.name")])
    latest = land(latest.where(F.col("file_id").isNotNull() & glob_match(F.col("file_metadata.name"), cfg.pattern)), "batch-latest")
    tracked = latest.where("is_deleted = false").select("file_id", F.lit(cfg.target_table).alias("target_table"),
                                                        F.lit(S.table_exists(spark, cfg.target_table)).alias("target_exists"))
    gate = sync_gate(tracked, latest, S.read_marks(spark, cfg.state_table, tracked)).where("should_process")
    size = latest.select("file_id", F.col("file_metadata.size_in_bytes").alias("file_size"))
    todo = gate.select("file_id", F.lit(False).alias("deleted"), F.col("file_last_updated").cast("timestamp").alias("file_ts")).join(size, "file_id")
    gone = latest.where("is_deleted = true").select("file_id", F.lit(True).alias("deleted"), F.lit(None).cast("timestamp").alias("file_ts"),
                                                    F.lit(None).cast("long").alias("file_size"))
    changes = land(todo.unionByName(gone), "batch-changes")
    _sync(spark, changes, batch, epoch_id, cfg, source="")
    release(latest, changes)


def _stream_batch(changes: DataFrame, epoch_id: int, cfg: StreamConfig, shuffles: str) -> None:
    """One micro-batch of ``file_changes``; its own jobs shuffle as the caller's session does, not as the marks are dealt."""
    spark = changes.sparkSession
    dealt = spark.conf.get(SHUFFLES)
    spark.conf.set(SHUFFLES, shuffles)
    try:
        _load_changes(spark, changes, epoch_id, cfg)
    finally:
        spark.conf.set(SHUFFLES, dealt)


def _load_changes(spark: SparkSession, changes: DataFrame, epoch_id: int, cfg: StreamConfig) -> None:
    if L.committed(spark, cfg.target_table, cfg.checkpoint, epoch_id):
        return                       # ran before a restart
    changes = land(changes, "stream-changes")
    # the landed files of this batch: the stream's own listing, as many as a trigger takes
    paths = [r[0] for r in changes.where("not deleted").select("landed").distinct().collect()]
    docs = spark.read.schema(cfg.documents_ddl).parquet(*paths) if paths else None
    if docs is not None or not changes.isEmpty():
        _sync(spark, changes, docs, epoch_id, cfg, source=cfg.checkpoint)
    release(changes)


def _contents(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are the version chosen per file: contents of all
    other versions and files stay out of the join."""
    want = todo.select(F.col("file_id").alias("_id"), F.col("file_ts").alias("_ts"), F.col("file_size").alias("_size"))
    stamp = F.col("file_metadata.last_modified_timestamp").cast("timestamp")
    return (docs.where("is_deleted = false")
            .join(want, (F.col("file_id") == F.col("_id")) & stamp.eqNullSafe(F.col("_ts"))
                  & F.col("file_metadata.size_in_bytes").eqNullSafe(F.col("_size")), "left_semi")
            .dropDuplicates(["file_id"]))


def _widened(columns: list[Row], current: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The table's columns with the types that also hold the values of a batch with these ``columns`` (``infer_columns``).
    Columns without any value in the batch ask for nothing."""
    need = {r["name"]: r["type"] for r in columns if r["filled"]}
    return [(n, widen([t.upper(), need[n]]) if n in need else t) for n, t in current]


def _sync(spark: SparkSession, changes: DataFrame, docs: DataFrame | None, epoch_id: int, cfg: StreamConfig, source: str) -> None:
    """Load the versions of ``changes`` (landed) from ``docs``, then record marks and the run."""
    t_start = time.time()
    todo, deleted = changes.where("not deleted"), changes.where("deleted")
    counts = changes.groupBy("deleted").count().collect()
    n_todo = sum(r["count"] for r in counts if not r["deleted"])
    n_gone = sum(r["count"] for r in counts if r["deleted"])
    current = L.data_schema(spark, cfg.target_table)
    decoded = layouts = out = None
    ok, seen = todo.limit(0), None
    unreadable = 0
    schema: list[tuple[str, str]] = []
    if n_todo:
        decoded = land(decode_workbooks(_contents(docs, todo)), "stream-decoded")
        # a file that can be read has a marker a sheet, one that cannot has its error: no other rows are looked at
        ok_ids = decoded.where("row_ix is null").groupBy("file_id").agg(F.max("error").alias("error")).where("error is null").select("file_id")
        ok = land(todo.join(ok_ids, "file_id", "left_semi"), "stream-read")
        unreadable = n_todo - ok.count()
        rows = grid_rows(decoded)   # of files that could be read to their end
        layouts = land(G.column_counts(rows, cfg.header_row), "stream-layouts")      # for both the types and the layout
        schema = _widened(G.over_files(layouts).collect(), current) if current else None
        typed, schema = build_typed(rows, cfg.header_row, None, cfg.selected_columns if schema is None else [c for c, _ in schema],
                                    schema, "lenient", keys=("file_id",), layouts=layouts)
        if typed is not None:
            seen = Observation(f"stream_{uuid.uuid4().hex[:8]}")
            out = typed.observe(seen, F.count_if("_rejected").alias("rejects")).drop("_rejected").withColumnRenamed("file_id", L.FILE)
    if current is not None or out is not None:
        superseded = ok.select(F.col("file_id").alias(L.FILE)).unionByName(deleted.select(F.col("file_id").alias(L.FILE)))
        L.append_load(spark, cfg.target_table, out, superseded, schema, source, epoch_id, n_todo - unreadable)
    rejects = int(seen.get["rejects"]) if seen is not None else 0
    if n_todo - unreadable:
        S.advance_watermark(spark, cfg.state_table, ok.select(F.lit(cfg.target_table).alias("target_table"), "file_id",
                                                              F.col("file_ts").alias("watermark")))
    if n_gone:   # deleted files lose their marks: restored later, they sync again
        S.clear_watermark(spark, cfg.state_table, deleted.select(F.lit(cfg.target_table).alias("target_table"), "file_id"))
    release(*[d for d in (decoded, layouts, ok) if d is not None])   # table and marks are written
    cfg.log.append({"batch_id": epoch_id, "files_synced": n_todo - unreadable, "files_unreadable": unreadable,
                    "rejects": rejects, "written": bool(out is not None or n_gone), "seconds": round(time.time() - t_start, 3)})


SHUFFLES = "spark.sql.shuffle.partitions"
# Settings of the query: the state store that keyed state with timers needs, and no
# empty batches just to move the clock (tombstones are cleared with the next files)
QUERY_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def stream_sync(spark: SparkSession, docs_path: str, cfg: StreamConfig) -> StreamingQuery | None:
    """Start the stream (``None`` when ``cfg.active`` is false).

    The target is a view of the rows that count; ``compact_loads`` may run between batches."""
    if not cfg.active:
        return None
    reader = spark.readStream.schema(cfg.documents_ddl)
    if cfg.max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", cfg.max_files_per_trigger)
    src = reader.parquet(docs_path)
    name = f"sync {cfg.target_table} {uuid.uuid4().hex[:8]}"
    # a partition of the marks is a Python worker and a state store in every batch, whatever it holds (a small row a
    # file): there are as many as cores, not as many as a shuffle of data wants
    shuffles = spark.conf.get(SHUFFLES)
    marks = cfg.state_partitions or min(int(shuffles), spark.sparkContext.defaultParallelism)
    run_listener(spark).watch(name, runs_folder(cfg), lambda batch: _details(cfg, batch))
    w = (file_changes(src, cfg).writeStream.queryName(name).foreachBatch(lambda df, eid: _stream_batch(df, eid, cfg, shuffles)).outputMode("update")
         .option("checkpointLocation", cfg.checkpoint))
    w = w.trigger(availableNow=True) if cfg.trigger == "availableNow" else w.trigger(processingTime=cfg.trigger)
    settings = {**QUERY_SETTINGS, SHUFFLES: str(marks)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _details(cfg: StreamConfig, batch: int) -> dict:
    for e in reversed(cfg.log):
        if e["batch_id"] == batch:
            return {k: e[k] for k in ("files_synced", "written", "rejects", "files_unreadable")}
    return {}


def stream_status(spark: SparkSession, query: StreamingQuery | None, cfg: StreamConfig) -> DataFrame:
    """One row per micro-batch with new files, of all runs of the stream since its checkpoint began: id, rows in,
    rates, duration, files synced and written, and the query's state (TERMINATED without a query).

    Rows come from the run table; the newest batches of a running query may still be on their way to it and are
    taken from the query itself."""
    state = "ACTIVE" if query is not None and query.isActive else "TERMINATED"
    kept = read_runs(spark, runs_folder(cfg))
    rows = []
    for p in query.recentProgress if query is not None else ():
        d = _details(cfg, p.get("batchId"))
        if p.get("numInputRows") or d:
            rows.append((p.get("batchId"), p.get("timestamp"), p.get("numInputRows"), p.get("inputRowsPerSecond"),
                         p.get("processedRowsPerSecond"), (p.get("durationMs") or {}).get("triggerExecution"), d.get("files_synced"),
                         d.get("written"), d.get("rejects"), d.get("files_unreadable"), str(query.id), str(query.runId)))
    fresh = spark.createDataFrame(rows, RUN_DDL)
    fresh = fresh.join(kept.select("batch_id"), "batch_id", "left_anti").select(kept.columns)
    return kept.unionByName(fresh).withColumn("state", F.lit(state)).orderBy("batch_id")


def runs_folder(cfg: StreamConfig) -> str:
    """Where the stream's run table lies: beside its checkpoint, which outlives the driver."""
    return f"{cfg.checkpoint.rstrip('/')}-runs"

"""Composite jobs a user calls (K1-K6).

Every job works on many files at once: the gate, content read and decode run
once for all files as Spark jobs; the driver only sees header layouts, column
descriptors and per-target outcomes (one small row per target).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridflow.functions.scalars import content_type_error, table_name
from gridflow.operators import grid as G
from gridflow.operators.gate import sync_gate
from gridflow.operators.quality import quality_report
from gridflow.session import land, release, scratch_path
from gridflow.sinks import tables as S
from gridflow.sources.documents import live, read_content
from gridflow.sources.workbook import CELL_TYPE, decode_log, decode_workbooks, grid_rows

# Outcome codes of a file sync
FILE_NOT_FOUND = "FILE_NOT_FOUND"
NO_CHANGES = "NO_CHANGES"
READ_ERROR = "READ_ERROR"
CONTENT_TYPE_ERROR = "CONTENT_TYPE_ERROR"
SUCCESS = "SUCCESS"

ERROR_NO_FILE = "no live file of this id"


# ----------------------------------------------------------------- K1-K3
def preview_files(docs: DataFrame, file_ids: DataFrame | list[str] | None = None,
                  max_rows: int = 100) -> dict[str, DataFrame]:
    """K1: per file the sheet list, the first ``max_rows`` raw rows of the
    first sheet, their count and width, and a suggested table name. The
    decoder stops reading each sheet after ``max_rows`` rows."""
    decoded = decode_workbooks(read_content(docs, file_ids), max_rows=max_rows, sheets=None)
    rows = G.preview(grid_rows(decoded), max_rows)
    # one aggregate over the decoded rows (at most max_rows per sheet) gives
    # sheets, row count and width, so the summary decodes each file once
    first = (F.col("sheet_ix") == 0) & F.col("row_ix").isNotNull()
    per_file = (decoded.filter(F.col("error").isNull()).groupBy("file_id")
                .agg(F.sort_array(F.collect_set(F.struct("sheet_ix", "sheet"))).alias("_s"),
                     F.count_if(first).alias("total_rows"),
                     F.max(F.when(first, F.size("cells"))).alias("_w")))
    files = per_file.select(
        "file_id", F.transform("_s", lambda x: x["sheet"]).alias("sheets"),
        F.element_at("_s", 1)["sheet"].alias("selected_sheet"),
        "total_rows",
        F.when(F.col("total_rows") > 0, F.col("_w")).otherwise(F.lit(0)).alias("column_count"),
        table_name(F.col("file_id")).alias("recommended_table_name"))
    errors = decode_errors(decoded)
    return {"files": files, "rows": rows, "errors": errors.unionByName(missing_files(docs, file_ids))}


def decode_errors(decoded: DataFrame) -> DataFrame:
    """``file_id, error`` of the files that could not be read: their one row each is all that is looked at."""
    return decode_log(decoded.filter(F.col("error").isNotNull())).select("file_id", "error")


def missing_files(docs: DataFrame, file_ids) -> DataFrame:
    """``file_id, error`` of the asked-for files without a live row."""
    spark = docs.sparkSession
    if file_ids is None:
        return spark.createDataFrame([], "file_id string, error string")
    asked = (spark.createDataFrame([(i,) for i in file_ids], "file_id string") if isinstance(file_ids, list)
             else file_ids.select("file_id").distinct())
    return asked.join(live(docs).select("file_id"), "file_id", "left_anti").withColumn("error", F.lit(ERROR_NO_FILE))


def sheet_errors(docs: DataFrame, file_ids, decoded: DataFrame, header_row: int, sheet: str | None) -> DataFrame:
    """``file_id, error`` of readable files without the named sheet, or whose
    sheet ends above the header row (an empty sheet is no error)."""
    mine = (F.col("sheet_ix") == 0) if sheet is None else (F.col("sheet") == sheet)
    per = (decoded.groupBy("file_id")
           .agg(F.max(mine.cast("int")).alias("has"), F.max("error").alias("unread"),
                F.max(F.when(mine, F.col("row_ix"))).alias("last")))
    problem = (F.when(F.col("unread").isNotNull(), F.lit(None))
               .when(F.coalesce("has", F.lit(0)) == 0, F.lit(f"no sheet named {sheet}" if sheet else "no sheet"))
               .when(F.col("last") < header_row, F.concat(F.lit(f"header row {header_row} is below the last row "),
                                                          F.col("last").cast("string"))))
    asked = read_content(docs, file_ids).select("file_id").distinct()   # ids only, no content
    return asked.join(per, "file_id", "left").select("file_id", problem.alias("error")).filter(F.col("error").isNotNull())


class DecodeError(ValueError):
    """Files that a job needs cannot be read; ``errors`` (file_id, error) has them all."""

    def __init__(self, message: str, errors: DataFrame):
        super().__init__(message)
        self.errors = errors


def _raise_errors(errors: DataFrame) -> None:
    first = errors.orderBy("file_id").first()
    if first is not None:
        n = errors.count()
        raise DecodeError(f"cannot read {first['file_id']}: {first['error']}"
                          + (f" (and {n - 1} files more)" if n > 1 else ""), errors)


def analyze_files(docs: DataFrame, file_ids=None, header_row: int = 0,
                  sheet: str | None = None, infer: str = "compat") -> dict[str, DataFrame]:
    """K2: column name, type, nullability and samples with a chosen header row.
    Decoded rows are landed once: names, counts and samples all read them."""
    decoded = land(decode_workbooks(read_content(docs, file_ids), sheets=[sheet] if sheet else None),
                   "analyze-decoded")
    rows = grid_rows(decoded)
    errors = decode_errors(decoded)
    errors = errors.unionByName(sheet_errors(docs, file_ids, decoded, header_row, sheet)).unionByName(missing_files(docs, file_ids))
    return {"columns": G.analyze_columns(rows, header_row, sheet, infer),
            "shape": G.sheet_shape(rows, header_row, sheet), "errors": errors}


@dataclass
class ParseResult:
    message: str
    table_name: str
    rows_inserted: int
    total_rows: int
    rejects: int
    columns: list[dict] = field(default_factory=list)


def build_typed(rows: DataFrame, header_row: int = 0, sheet: str | None = None,
                selected_columns: Sequence[str] | None = None,
                schema: Sequence[tuple[str, str]] | None = None, mode: str = "strict",
                infer: str = "compat", keys: Sequence[str] = (), layouts: DataFrame | None = None,
                ) -> tuple[DataFrame, list[tuple[str, str]]]:
    """C12 -> C9/C10 -> E2 -> C13 over files of one header layout or of many.

    Files of different layouts are aligned by column name: a column stands where it first stands in any
    file, its type is decided over all files that have it, and files without it have NULL there.
    Returns the typed DataFrame (plus a ``_rejected`` flag) and the schema.
    One small driver read: names, layout check and types per column. Cells are counted once, whatever the layouts: the counts
    (a row a file and column) are landed, or come from a caller that has them (``layouts``).
    """
    own = layouts is None
    if own:
        layouts = land(G.column_counts(rows, header_row, sheet, infer), "layouts")
    # one job: names, layout check and types of every column over all files
    cols = sorted(G.over_files(layouts, infer).collect(), key=lambda r: r["col_ix"])
    if not all(r["consistent"] for r in cols):
        return _build_aligned(rows, layouts, header_row, sheet, selected_columns, schema, mode, infer, keys)
    if own:
        release(layouts)
    if not cols:
        return None, []
    names = [r["name"] for r in cols]
    promoted = G.promote_header(rows, names, header_row, sheet)
    picked = G.select_columns(promoted, selected_columns, mode)
    picked_cols = [c for c in picked.columns if c not in ("file_id", "sheet", "row_ix")]
    if schema is None:
        inferred = {r["name"]: r["type"] for r in cols}
        schema = [(c, inferred.get(c, "STRING")) for c in picked_cols]
    # typed values plus a reject flag (a present source value that did not survive its cast); no join, no second pass
    return G.typed_cells(picked, [F.col(f"`{c}`") for c, _ in schema], schema, keys), list(schema)


def aligned_columns(layouts: DataFrame, infer: str = "compat") -> DataFrame:
    """``name, type, pos`` over the files of ``layouts`` (``column_counts``): columns of one name are one
    column, placed by their first position and typed by the cells of all files that have them."""
    return (layouts.groupBy("name").agg(F.min("col_ix").alias("pos"), F.sum("n_rows").alias("n_rows"),
                                        *[F.sum(c).alias(c) for c in G.COUNT_COLUMNS])
            .select("name", G.summed_type(infer)["type"].alias("type"), "pos"))


def _build_aligned(rows: DataFrame, layouts: DataFrame, header_row: int, sheet: str | None, selected: Sequence[str] | None,
                   schema: Sequence[tuple[str, str]] | None, mode: str, infer: str, keys: Sequence[str]):
    """``build_typed`` over files of different ``layouts`` (``column_counts``). A file's names travel to its rows by a join on the file;
    a column is then found in a row by its name's place there, so files need no grouping."""
    found = sorted(aligned_columns(layouts, infer).collect(), key=lambda r: (r["pos"], r["name"]))     # a row a column
    types = {r["name"]: r["type"] for r in found}
    wanted = [n for n in selected or types if n in types]
    if not wanted:
        if mode == "strict":
            raise ValueError(f"no selected column is in the sheets: {list(selected)}")
        wanted = list(types)
    if schema is None:
        schema = [(n, types[n]) for n in wanted]
    # where each column stands in a file (-1: nowhere), found once a file; a name stands once in a header
    ix = [F.coalesce(F.max(F.when(F.col("name") == n, F.col("col_ix"))), F.lit(-1)).cast("int").alias(f"_ix{i}") for i, (n, _) in enumerate(schema)]
    places = layouts.groupBy("file_id").agg(*ix)
    data = G.sheet_rows(rows, sheet).filter(F.col("row_ix") > header_row).join(places, "file_id")
    cells = [F.when(F.col(f"_ix{i}") >= 0, F.get(F.col("cells"), F.col(f"_ix{i}"))) for i in range(len(schema))]
    return G.typed_cells(data, cells, schema, keys), list(schema)


def parse_to_table(spark: SparkSession, docs: DataFrame, file_ids, table: str,
                   header_row: int = 0, sheet: str | None = None,
                   selected_columns: Sequence[str] | None = None,
                   schema: Sequence[tuple[str, str]] | None = None,
                   write_mode: str = "append", infer: str = "compat") -> ParseResult:
    """K3: decode once (landed as parquet in the shared folder, so inference
    and the write do not decode twice and an executor loss re-reads files),
    promote the header, select, infer or accept the schema, create the table
    if absent and write all rows in one distributed job."""
    decoded = land(decode_workbooks(read_content(docs, file_ids),
                                    sheets=[sheet] if sheet else None), "decoded")
    try:
        errors = decode_errors(decoded)
        errors = errors.unionByName(sheet_errors(docs, file_ids, decoded, header_row, sheet)).unionByName(missing_files(docs, file_ids))
        errors = land(errors, "parse-errors")   # outlives the decoded rows
        _raise_errors(errors)
        rows = grid_rows(decoded)
        typed, sch = build_typed(rows, header_row, sheet, selected_columns, schema, "strict", infer)
        if typed is None:
            return ParseResult("no rows: the sheet is empty", table, 0, 0, 0, [])
        if write_mode == "replace":
            obs = Observation(f"replace_{uuid.uuid4().hex[:8]}")
            seen = typed.observe(obs, F.count(F.lit(1)).alias("total_rows"), F.count_if("_rejected").alias("rejects"))
            S.replace_table(seen.filter(~F.col("_rejected")).drop("_rejected"), table)
            total, bad = int(obs.get["total_rows"]), int(obs.get["rejects"])
            stats = {"rows_inserted": total - bad, "total_rows": total, "rejects": bad}
        else:
            S.ensure_table(spark, table, sch)
            stats = S.append_rows(typed, table, reject_col="_rejected")
    finally:
        release(decoded)
    msg = f"{stats['rows_inserted']} rows written" if stats["total_rows"] else "no rows: the sheet is empty"
    return ParseResult(msg, table, stats["rows_inserted"], stats["total_rows"], stats["rejects"],
                       [{"name": n, "type": t} for n, t in sch])


# ----------------------------------------------------------------- K4-K6
def existing_targets(spark: SparkSession, tracked: DataFrame) -> DataFrame:
    """``target_table, target_exists`` for the registry's targets: one catalog
    listing per distinct schema (a handful), joined to the targets in Spark."""
    schemas = [r[0] for r in tracked.select(
        F.substring_index("target_table", ".", -2).alias("q")).select(
        F.substring_index("q", ".", 1)).distinct().collect()]
    listed = []
    for db in schemas:
        if db and spark.catalog.databaseExists(db):
            listed += [(f"{db}.{t.name}",) for t in spark.catalog.listTables(db)]
    have = spark.createDataFrame(listed, "qualified string")
    key = F.substring_index(F.col("target_table"), ".", -2)
    return (tracked.select("target_table").distinct()
            .join(have, key == F.col("qualified"), "left")
            .select("target_table", F.col("qualified").isNotNull().alias("target_exists")))


LOG_COLUMNS = ["connection_id", "file_id", "target_table", "status", "message", "rows_written", "rejects"]


def sync_all(spark: SparkSession, tracked: DataFrame, docs: DataFrame,
             state_table: str, mode: str = "lenient") -> DataFrame:
    """K5 (K4 for one row): sync every enabled registry row in one pass.

    ``tracked``: ``connection_id, file_id, target_table, header_row,
    selected_columns (array<string>, may be NULL), sync_enabled``.

    All files are gated with one join (content never read). If any file of a
    target passes, or one that was written before is gone, the target is
    rebuilt from all its enabled live files, each with its own header row and
    selection; columns are united by name and typed over the files together.
    All files are decoded once and staged by target, so a target's write reads
    its own rows only. A target one of whose files cannot be read is left as
    it is. Watermarks come last.

    Returns the run log, a row per enabled registry row: ``status``, message,
    ``rows_written`` (of the whole target) and ``rejects`` (rows with a value
    its column's type cannot hold: written with NULL there). The driver handles one
    small row per rebuilt target.
    """
    enabled = tracked.filter(F.coalesce(F.col("sync_enabled"), F.lit(False)))
    if "target_exists" not in enabled.columns:
        enabled = enabled.join(existing_targets(spark, enabled), "target_table", "left")
    state = S.read_marks(spark, state_table, enabled)
    gate = land(sync_gate(enabled, docs, state), "sync-gate")
    present = F.col("file_last_updated").isNotNull()
    lost = ~present & F.col("table_last_updated").isNotNull()
    due = (gate.groupBy("target_table").agg(F.max(F.col("should_process") | lost).alias("due"),
                                            F.max(present).alias("any")).filter("due and any").select("target_table"))
    work = land(gate.filter(present).join(due, "target_table", "left_semi").select(
        "connection_id", "file_id", "target_table", F.coalesce("header_row", F.lit(0)).alias("header_row"),
        "selected_columns", "file_last_updated"), "sync-work")
    idle = gate.join(work.select("connection_id", "file_id", "target_table"),
                     ["connection_id", "file_id", "target_table"], "left_anti")
    log = [idle.select("connection_id", "file_id", "target_table",
                       F.when(present, NO_CHANGES).otherwise(FILE_NOT_FOUND).alias("status"),
                       F.col("reason").alias("message"), F.lit(None).cast("bigint").alias("rows_written"),
                       F.lit(None).cast("bigint").alias("rejects"))]
    done = None
    if content_type_error(docs.schema["content"].dataType):
        log.append(_outcome(work, CONTENT_TYPE_ERROR, F.lit("content is not binary, base64 text or a struct of either")))
    elif not work.isEmpty():
        rebuilt = _rebuild(spark, work, docs, mode)
        log.append(rebuilt)
        done = rebuilt.filter(F.col("status") == SUCCESS)
    out = land(log[0].select(*LOG_COLUMNS) if len(log) == 1 else log[0].select(*LOG_COLUMNS).unionByName(
        log[1].select(*LOG_COLUMNS)), "sync-log")
    if done is not None:
        ok = out.filter(F.col("status") == SUCCESS).select("target_table", "file_id").distinct()
        if not ok.isEmpty():
            S.advance_watermark(spark, state_table, work.join(ok, ["target_table", "file_id"]).select(
                "target_table", "file_id", F.col("file_last_updated").alias("watermark")).distinct())
            gone = gate.filter(lost).join(ok.select("target_table").distinct(), "target_table", "left_semi")
            if not gone.isEmpty():
                S.clear_watermark(spark, state_table, gone.select("target_table", "file_id"))
    release(gate, work)
    return out


def _outcome(work: DataFrame, status: str, message) -> DataFrame:
    return work.select("connection_id", "file_id", "target_table", F.lit(status).alias("status"), message.alias("message"),
                       F.lit(None).cast("bigint").alias("rows_written"), F.lit(None).cast("bigint").alias("rejects"))


def _layouts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, header_row, col_ix, name, n_rows, c_*`` of ``files(file_id,
    header_row)``: one inference job per distinct header row."""
    out = None
    for h in [r[0] for r in files.select("header_row").distinct().collect()] or [0]:
        mine = rows.join(files.filter(F.col("header_row") == h).select("file_id"), "file_id", "left_semi")
        one = G.column_counts(mine, int(h)).withColumn("header_row", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


def _rebuild(spark: SparkSession, work: DataFrame, docs: DataFrame, mode: str) -> DataFrame:
    """Write every target of ``work`` from its files; a log row per file."""
    decoded = land(decode_workbooks(read_content(docs, work.select("file_id"))), "sync-decoded")
    key = ["file_id", "header_row"]
    try:
        errors = land(decode_errors(decoded), "sync-errors")
        broken = work.join(errors, "file_id").select("target_table").distinct()
        fine = work.join(broken, "target_table", "left_anti")
        rows = grid_rows(decoded)
        layouts = land(_layouts(rows, fine.select(*key).distinct()), "sync-layouts")
        names = layouts.groupBy(*key).agg(F.transform(
            F.sort_array(F.collect_list(F.struct("col_ix", "name"))), lambda x: x["name"]).alias("names"))
        # C10 per file: the asked-for columns that are there, in request order; none: all
        found = F.filter(F.coalesce("selected_columns", F.array().cast("array<string>")),
                         lambda x: F.array_contains(F.col("names"), x))
        if mode == "strict":
            picked = F.when(F.coalesce(F.size("selected_columns"), F.lit(0)) > 0, found).otherwise(F.col("names"))
        else:
            picked = F.when(F.size(found) > 0, found).otherwise(F.col("names"))
        files = land(fine.join(names, key, "left").withColumn("picked", F.array_distinct(picked)), "sync-files")
        # a target's columns: united by name, placed by first position, typed over all its files
        kind = G.summed_type()
        columns = (files.select("target_table", *key, F.posexplode("picked").alias("pos", "name")).distinct()
                   .join(layouts, [*key, "name"])
                   .groupBy("target_table", "name").agg(F.min("pos").alias("pos"), F.sum("n_rows").alias("n_rows"),
                                                        *[F.sum(c).alias(c) for c in G.COUNT_COLUMNS])
                   .select("target_table", "pos", "name", kind["type"].alias("type"))
                   .groupBy("target_table").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "type"))).alias("cols")))
        columns = land(columns, "sync-columns")
        ix = F.transform("cols", lambda c: F.when(F.array_contains(F.col("picked"), c["name"]),
                                                  F.array_position(F.col("names"), c["name"]) - 1).otherwise(-1).cast("int"))
        spec = files.join(columns, "target_table").select("target_table", *key, ix.alias("ix"))
        staged = _staged(rows, spec)
        path = scratch_path(spark, "sync-staged")
        staged.write.partitionBy("target_table").parquet(path)
        todo = [(r["target_table"], [(c["name"], c["type"]) for c in r["cols"]]) for r in columns.toLocalIterator()]
        rows_of = spark.read.schema(f"cells {CELL_TYPE}, target_table string").parquet(path)
        # one write per table; a table's rows are a directory of the staged data
        with ThreadPoolExecutor(max_workers=max(1, min(8, len(todo)))) as pool:
            results = list(pool.map(lambda x: _write_target(spark, rows_of, *x), todo))
        written = spark.createDataFrame(results, "target_table string, n bigint, bad bigint, error string")
        # what stops a target is told on the file it comes from, and on the others of the target
        log = (work.join(errors, "file_id", "left").join(broken.withColumn("_broken", F.lit(True)), "target_table", "left")
               .join(written.withColumnRenamed("error", "_werror"), "target_table", "left"))
        status = F.when(F.col("_broken") | F.col("_werror").isNotNull(), READ_ERROR).otherwise(SUCCESS)
        message = F.coalesce("error", F.when(F.col("_broken"), "another file of this target cannot be read; it is left as it is"),
                             "_werror", F.concat(F.lit("wrote "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" rows")))
        log = land(log.select("connection_id", "file_id", "target_table", status.alias("status"), message.alias("message"),
                              F.when(status == SUCCESS, F.coalesce("n", F.lit(0))).alias("rows_written"),
                              F.when(status == SUCCESS, F.coalesce("bad", F.lit(0))).alias("rejects")), "sync-outcomes")
        release(errors, layouts, files, columns)
        return log
    finally:
        release(decoded)


def _staged(rows: DataFrame, spec: DataFrame) -> DataFrame:
    """``target_table, cells`` of the data rows of ``spec(target_table, file_id, header_row, ix)``: cells in the order of the
    target's columns. A partition's share of the files is hashed, so rows are dealt by file but not sorted by its name."""
    return (rows.filter(F.col("sheet_ix") == 0).join(spec.hint("shuffle_hash"), "file_id").filter(F.col("row_ix") > F.col("header_row"))
            .select("target_table", F.transform("ix", lambda i: F.when(i >= 0, F.get(F.col("cells"), i))).alias("cells")))


def _write_target(spark: SparkSession, staged: DataFrame, target: str, schema: list[tuple[str, str]]):
    """Replace one target with its staged rows: (target, rows, rejects, error)."""
    try:
        mine = staged.filter(F.col("target_table") == target)
        obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
        out = G.typed_cells(mine, [F.get(F.col("cells"), i) for i in range(len(schema))], schema).observe(
            obs, F.count(F.lit(1)).alias("n"), F.count_if("_rejected").alias("bad"))
        S.replace_table(out.drop("_rejected"), target)
        return target, int(obs.get["n"]), int(obs.get["bad"]), None
    except Exception as e:  # noqa: BLE001 - one bad target does not stop the rest
        return target, None, None, str(e)


def sync_file(spark: SparkSession, tracked_row: dict, docs: DataFrame, state_table: str) -> str:
    """K4: one registry row -> outcome code."""
    row = [tracked_row.get("connection_id", "c"), tracked_row["file_id"], tracked_row["target_table"],
           int(tracked_row.get("header_row", 0)), tracked_row.get("selected_columns")]
    t = spark.createDataFrame([row + [True]], "connection_id string, file_id string, target_table string, "
                                              "header_row int, selected_columns array<string>, "
                                              "sync_enabled boolean")
    return sync_all(spark, t, docs, state_table).collect()[0]["status"]


def table_last_updated(spark: SparkSession, name: str):
    """Newest data-file modification time of a table (``_metadata``), or None."""
    if not S.table_exists(spark, name):
        return None
    r = spark.table(name).select(F.max("_metadata.file_modification_time").alias("t")).collect()
    return r[0]["t"] if r else None


def run_sync(spark: SparkSession, cfg: dict, docs: DataFrame, header_row: int = 2,
             owner_cell: tuple[int, int] = (0, 1), required=("Date", "SKU", "Qty", "supplier_id")
             ) -> dict:
    """K6: gate -> parse (owner id attached) -> quality; status is
    ``skipped``, ``success``, ``dq_failed`` or ``error``.

    ``cfg``: ``file_name`` (the file id), ``target_table``. The gate compares
    the file's time with the table's last update (legacy rule).
    """
    target = cfg["target_table"]
    fid = cfg["file_name"]
    exists = S.table_exists(spark, target)
    mark = table_last_updated(spark, target) if exists else None
    t = spark.createDataFrame([(fid, target, exists)], "file_id string, target_table string, "
                                                     "target_exists boolean")
    st = spark.createDataFrame([(target, fid, mark)], "target_table string, file_id string, "
                                                      "watermark timestamp")
    g = sync_gate(t, docs, st).collect()[0]
    gate = {"catalog": cfg.get("catalog"), "schema": cfg.get("schema_name"), "file_name": fid,
            "documents_table": cfg.get("documents_table", "documents"), "target_table": target,
            "should_process": g["should_process"], "reason": g["reason"],
            "file_last_updated": g["file_last_updated"], "table_last_updated": g["table_last_updated"]}
    if not g["should_process"]:
        return {"status": "skipped", "gate": gate, "parse": None, "dq": None}
    decoded = land(decode_workbooks(read_content(docs, [fid])), "run-decoded")
    try:
        _raise_errors(decode_errors(decoded))
        rows = grid_rows(decoded)
        typed, _ = build_typed(rows, header_row, None, None, None, "lenient", keys=("file_id",))
        if typed is None:   # empty sheet: success, nothing written
            parse = {"status": "success", "rows_processed": 0, "message": "empty table"}
        else:
            obs = Observation(f"run_{uuid.uuid4().hex[:8]}")
            typed = typed.observe(obs, F.count(F.lit(1)).alias("n"), F.count_if("_rejected").alias("bad"))
            typed = G.attach_fixed_cell(rows, typed.drop("_rejected"), owner_cell[0], owner_cell[1],
                                        "supplier_id").drop("file_id")
            S.replace_table(typed, target)
            n, bad = int(obs.get["n"]), int(obs.get["bad"])
            told = f"wrote {n} rows" + (f", {bad} of them with a value its column cannot hold (NULL)" if bad else "")
            parse = {"status": "success", "rows_processed": n, "rejects": bad, "message": told}
    except Exception as e:  # noqa: BLE001
        return {"status": "error", "gate": gate,
                "parse": {"status": "error", "message": str(e)}, "dq": None}
    finally:
        release(decoded)
    # an empty sheet wrote nothing: its checks run on an empty, column-less frame
    checked = spark.table(target) if parse["rows_processed"] else spark.range(0).drop("id")
    rep = quality_report(checked, required=required).collect()
    checks = [{"check": r["check"], "value": r["value"], "passed": r["passed"]} for r in rep]
    ok = all(c["passed"] for c in checks)
    dq = {"status": "success", "checks_passed": ok, "total_checks": len(checks), "quality_checks": checks}
    return {"status": "success" if ok else "dq_failed", "gate": gate, "parse": parse, "dq": dq}


__all__ = ["preview_files", "analyze_files", "parse_to_table", "build_typed", "sync_all",
           "sync_file", "run_sync"]

"""Registered queries over stored tables, landed files and whole runs: operators whose work is a write, a
catalog entry or a decision, and so shows only when a job runs to its end.

Tables they make are dropped before the result is returned; the result is kept in the shared scratch folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridflow.plans import views as V
from gridflow.plans.queries import _NA_SQL, GIVEN_TABLES, _profile_sql, grid_parts, register, workbook_docs
from gridflow.session import land, scratch_path

SCHEMA = "gridflow_queries"


def _fresh(kind: str) -> str:
    return f"{SCHEMA}.{kind}_{uuid.uuid4().hex[:8]}"


# ------------------------------------------------------------- documents
@register("land_files", """
SELECT lang, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, true AS live, true AS named
FROM documents GROUP BY lang""")
def q_land_files(spark, sf_dir):
    """A1: the documents' texts are written as files, a folder a language, and landed again as documents rows."""
    from gridflow.sources.documents import land_documents
    root = scratch_path(spark, "land-files")
    V.table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(root)
    d = land_documents(spark, root, "part-*")
    return d.groupBy(F.regexp_extract("file_id", "/lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum(F.length("content")).alias("n_bytes"), F.bool_and(~F.col("is_deleted")).alias("live"),
        F.bool_and((F.col("file_metadata.size_in_bytes") == F.length("content")) & F.endswith("file_id", F.col("file_metadata.name"))).alias("named"))


@register("key_filters", V.with_views("""
SELECT 'by_key' AS filter, connection_id FROM tracked_v WHERE target_table = (SELECT min(target_table) FROM tracked_v)
UNION ALL
SELECT 'not_null', connection_id FROM tracked_v WHERE nullif(sync_enabled, false) IS NOT NULL""", "tracked_v"))
def q_key_filters(spark, sf_dir):
    """C3, C4."""
    from gridflow.functions.filters import by_key, not_null
    t = V.tracked_v(spark, sf_dir)
    first = t.agg(F.min("target_table")).first()[0]
    some = t.withColumn("flag", F.when(F.col("sync_enabled"), F.lit(True)))
    return (by_key(t, "target_table", first).select(F.lit("by_key").alias("filter"), "connection_id")
            .unionByName(not_null(some, "flag").select(F.lit("not_null").alias("filter"), "connection_id")))


@register("iso_times", """
WITH e AS (SELECT event_id, ts + to_microseconds(event_id % 3 * 250) AS ts FROM events)
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract(microsecond FROM ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS parsed FROM e""")
def q_iso_times(spark, sf_dir):
    """H4 there and back; unreadable text gives NULL."""
    from gridflow.functions.scalars import format_iso, parse_iso
    ts = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 3 * 250)
    e = V.table(spark, sf_dir, "events").select("event_id", format_iso(ts).alias("iso"))
    text = F.when(F.col("event_id") % 7 == 0, F.lit("last week")).otherwise(F.col("iso"))
    return e.select("event_id", "iso", parse_iso(text).cast("timestamp_ntz").alias("parsed"))


@register("registry_by_name", V.with_views("""
SELECT connection_id, connection_name, target_table, row_number() OVER (ORDER BY connection_name, connection_id) AS place FROM tracked_v""", "tracked_v"))
def q_registry_by_name(spark, sf_dir):
    """the listing by name; its order comes back as a place."""
    from pyspark.sql import Window

    from gridflow.operators.keyed import list_registry
    listed = list_registry(V.tracked_v(spark, sf_dir).select("connection_id", "connection_name", "target_table"), by="connection_name")
    stored = land(listed.withColumn("seen", F.monotonically_increasing_id()), "registry")     # numbers follow the listing's order
    # a registry is a row a connection
    return stored.withColumn("place", F.row_number().over(Window.orderBy("seen")).cast("long")).drop("seen")


@register("missing_keys_since", """
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1998-01-01')""")
def q_missing_keys_since(spark, sf_dir):
    """D3 where keys are missing: customers without an order of the last year."""
    from gridflow.operators.keyed import missing_keys
    late = V.table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return missing_keys(V.table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
                        late.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# ---------------------------------------------------------------- tables
@register("append_table", f"""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'n/a' WHEN o_orderkey % 10 = 5 THEN 'x' || CAST(o_orderkey AS VARCHAR)
                                   WHEN o_orderkey % 10 = 7 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS raw FROM orders),
w AS (SELECT *, raw IS NULL OR raw IN ({_NA_SQL}) AS missing FROM v),
x AS (SELECT o_orderkey, CASE WHEN missing THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS amount,
             NOT missing AND TRY_CAST(raw AS DOUBLE) IS NULL AS rejected FROM w),
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE rejected) AS bad FROM x)
SELECT o_orderkey, amount, 2::BIGINT AS times, total - bad AS rows_inserted, total AS total_rows, bad AS rejects,
       'Table not found' AS after_drop FROM x, n WHERE NOT rejected""")
def q_append_table(spark, sf_dir):
    """A table is created, rows are appended twice (an append repeats), rejected rows are skipped and
    counted, the table is read by name, dropped, and no longer found."""
    from gridflow.functions.cells import cast_cell, cell_present
    from gridflow.sinks import tables as S
    from gridflow.sources.sql import read_table
    m = F.col("o_orderkey") % 10
    raw = (F.when(m == 3, F.lit("n/a")).when(m == 5, F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
           .when(m == 7, F.lit(None).cast("string")).otherwise(F.col("o_totalprice").cast("string")))
    cell = F.struct(F.when(raw.isNull(), F.lit("null")).otherwise(F.lit("s")).alias("kind"), raw.alias("raw"))
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", cell.alias("cell"))
    amount = cast_cell(F.col("cell"), "DOUBLE")
    rows = o.select("o_orderkey", amount.alias("amount"), (cell_present(F.col("cell")) & amount.isNull()).alias("_rejected"))
    name = _fresh("append")
    try:
        S.ensure_table(spark, name, [("o_orderkey", "BIGINT"), ("amount", "DOUBLE")])
        S.ensure_table(spark, name, [("o_orderkey", "BIGINT"), ("amount", "DOUBLE")])      # there already: fine
        for _ in range(2):
            counts = S.append_rows(rows, name, reject_col="_rejected")
        stored, problem = read_table(spark, name)
        assert problem is None
        out = land(stored.groupBy("o_orderkey", "amount").agg(F.count("*").alias("times")), "append")
    finally:
        S.drop_table(spark, name)
    missing = read_table(spark, name)[1]
    return out.select("*", *[F.lit(v).cast("long").alias(k) for k, v in counts.items()], F.substring(F.lit(missing), 1, 15).alias("after_drop"))


# -------------------------------------------------------------- workbooks
def _two_sheets(rows):
    """``rows`` with the data rows once more on a second sheet; one pass, so files are made and sorted once."""
    first, second = (F.struct(F.lit(i).alias("sheet_ix"), F.lit(n).alias("sheet")) for i, n in enumerate(("Sheet1", "Data only")))
    sheets = F.when(F.col("row_ix") > V.GRID_HEADER_ROW, F.array(first, second)).otherwise(F.array(first))
    return rows.select("file_id", F.inline(sheets), "row_ix", "cells")


@register("decode_faults", V.with_views("""
WITH f AS (SELECT file_id, count(*) AS n, substr(md5(file_id), 1, 1) IN ('0', '1', '2') AS broken FROM grid_v GROUP BY file_id)
SELECT file_id, CASE WHEN broken THEN 0 ELSE 2 * n END AS n_rows, CASE WHEN broken THEN 0 ELSE 2 END AS n_sheets, broken AS failed,
       CASE WHEN broken THEN NULL ELSE 'Sheet1|Data only' END AS sheets_text, CASE WHEN broken THEN NULL ELSE 'Sheet1' END AS default_sheet FROM f""", "grid_v"))
def q_decode_faults(spark, sf_dir):
    """A4-A6 on workbooks of two sheets, some of them cut off in the middle: these give an error each and no rows. (The second
    sheet has no rows before its data; they read as blank.)"""
    from gridflow.sources.workbook import as_documents, decode_log, decode_workbooks, encode_workbooks, list_sheets
    docs = as_documents(encode_workbooks(_two_sheets(grid_parts(spark, sf_dir))))
    broken = F.substring(F.md5("file_id"), 1, 1).isin("0", "1", "2")
    half = F.expr("substring(content, 1, octet_length(content) div 2)")
    decoded = land(decode_workbooks(docs.withColumn("content", F.when(broken, half).otherwise(F.col("content")))), "decoded")
    log = decode_log(decoded).select("file_id", "n_rows", F.col("n_sheets").cast("int").alias("n_sheets"), F.col("error").isNotNull().alias("failed"))
    sheets = list_sheets(decoded).select("file_id", F.array_join("sheets", "|").alias("sheets_text"), "default_sheet")
    return log.join(sheets, "file_id", "left")


@register("select_lenient", V.with_views("""
SELECT file_id, row_ix, CAST(l_quantity AS VARCHAR) AS "Qty", 'SKU' || CAST(l_partkey AS VARCHAR) AS "SKU", 5 AS kept_without_match
FROM (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) + 2 AS INTEGER)
      AS row_ix, * FROM li_v)""", "grid_v"))
def q_select_lenient(spark, sf_dir):
    """Asked-for columns that are there, in request order; none there: all are kept."""
    from gridflow.operators.grid import as_text, select_columns
    from gridflow.plans.queries import _promoted
    _, p = _promoted(spark, sf_dir)
    every = [c for c in select_columns(p, ["Colour", "Weight"], "lenient").columns if c not in ("file_id", "sheet", "row_ix")]
    return as_text(select_columns(p, ["Qty", "Colour", "SKU"], "lenient")).drop("sheet").withColumn("kept_without_match", F.lit(len(every)))


@register("quality_faults", """
WITH t AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS "SKU", s_acctbal AS "Price", 'S' || (s_nationkey % 2) AS supplier_id FROM supplier),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE "SKU" IS NULL) AS ns, count(DISTINCT supplier_id) AS o FROM t)
SELECT 'row_count' AS "check", CAST(n AS VARCHAR) AS value, n > 0 AS passed FROM a
UNION ALL SELECT 'required_columns', 'Date,Qty', false FROM a
UNION ALL SELECT 'null_values', 'Price=0,SKU=' || ns || ',supplier_id=0', false FROM a
UNION ALL SELECT 'supplier_consistency', CAST(o AS VARCHAR), false FROM a""")
def q_quality_faults(spark, sf_dir):
    """G2 and E7 where every check but the first fails."""
    from gridflow.operators.quality import quality_report
    s = V.table(spark, sf_dir, "supplier")
    t = s.select(F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("SKU"), F.col("s_acctbal").alias("Price"),
                 F.concat(F.lit("S"), (F.col("s_nationkey") % 2).cast("string")).alias("supplier_id"))
    return quality_report(t, required=("Date", "SKU", "Qty", "supplier_id"))


@register("run_states", """
WITH n AS (SELECT count(*) AS n FROM supplier)
SELECT 1 AS step, 'success' AS status, n AS rows_processed, 4 AS n_checks, true AS passed FROM n
UNION ALL SELECT 2, 'skipped', NULL, NULL, NULL FROM n
UNION ALL SELECT 3, 'dq_failed', n, 4, false FROM n
UNION ALL SELECT 4, 'error', NULL, NULL, NULL FROM n
UNION ALL SELECT 5, 'skipped', NULL, NULL, NULL FROM n""")
def q_run_states(spark, sf_dir):
    """K6 (with H9, H10, E7): a workbook of all suppliers is run, run again unchanged, comes newer without a required column,
    comes cut off, and is gone."""
    from gridflow.plans.jobs import run_sync
    from gridflow.sinks import tables as S
    from gridflow.sources.workbook import as_documents, encode_workbooks
    from pyspark.sql import Window
    s = V.table(spark, sf_dir, "supplier")
    cell = lambda k, x: F.struct(F.lit(k).alias("kind"), x.cast("string").alias("raw"))

    def workbook(names):
        data = s.select((F.row_number().over(Window.orderBy("s_suppkey")) + 2).cast("int").alias("row_ix"), F.array(
            cell("s", F.lit("2024-01-01")), cell("s", F.col("s_name")), cell("n", F.col("s_suppkey")), cell("n", F.col("s_acctbal"))).alias("cells"))
        rows = [(0, ["Supplier ID", "SUPP001"]), (2, names)]
        head = spark.createDataFrame([(i, [("s", x) for x in r]) for i, r in rows], "row_ix int, cells array<struct<kind:string,raw:string>>")
        g = head.unionByName(data).select(F.lit("suppliers.xlsx").alias("file_id"), F.lit(0).alias("sheet_ix"), F.lit("Sheet1").alias("sheet"), "row_ix", "cells")
        return encode_workbooks(g)
    at = lambda d, t, gone=False: as_documents(d, F.lit(t).cast("timestamp")).withColumn("is_deleted", F.lit(gone))
    good, bad = workbook(["Date", "SKU", "Qty", "Price"]), workbook(["Date", "Name", "Qty", "Price"])
    cut = good.withColumn("content", F.expr("substring(content, 1, octet_length(content) div 2)"))
    name = _fresh("run")
    out = []
    try:
        for step, docs in enumerate((at(good, "2024-01-01 00:00:00"), at(good, "2024-01-01 00:00:00"), at(bad, "2999-01-01 00:00:00"),
                                     at(cut, "2999-01-02 00:00:00"), at(good, "2999-01-03 00:00:00", True)), 1):
            r = run_sync(spark, {"file_name": "suppliers.xlsx", "target_table": name}, docs)
            parsed, dq = r["parse"] or {}, r["dq"] or {}
            out.append((step, r["status"], parsed.get("rows_processed"), dq.get("total_checks"), dq.get("checks_passed")))
    finally:
        S.drop_table(spark, name)
    return spark.createDataFrame(out, "step int, status string, rows_processed long, n_checks int, passed boolean")


@register("sync_files", V.with_views("""
WITH f AS (SELECT file_id, count(*) - 3 AS n FROM grid_v GROUP BY file_id),
k AS (SELECT *, CAST('0x' || substr(md5(file_id), 1, 1) AS INTEGER) AS d FROM f)
SELECT file_id, CASE WHEN d < 2 THEN 'READ_ERROR' WHEN d < 4 THEN 'FILE_NOT_FOUND' ELSE 'SUCCESS' END AS first_run,
       CASE WHEN d < 2 THEN 'READ_ERROR' WHEN d < 4 THEN 'FILE_NOT_FOUND' ELSE 'NO_CHANGES' END AS second_run FROM k""", "grid_v"))
def q_sync_files(spark, sf_dir):
    """K4/K5 outcome codes: every workbook is tracked, some are cut off and some deleted; the readable ones go to one shared
    target, the others to one each kind of fault; the second run finds nothing new."""
    from gridflow.plans.jobs import sync_all
    from gridflow.sinks import tables as S
    docs = land(workbook_docs(spark, sf_dir), "workbook-docs")
    d = F.conv(F.substring(F.md5("file_id"), 1, 1), 16, 10).cast("int")
    half = F.expr("substring(content, 1, octet_length(content) div 2)")
    docs = docs.withColumn("content", F.when(d < 2, half).otherwise(F.col("content"))).withColumn("is_deleted", d.between(2, 3))
    names = {k: _fresh(k) for k in ("good", "broken", "gone", "state")}
    target = F.when(d < 2, F.lit(names["broken"])).when(d < 4, F.lit(names["gone"])).otherwise(F.lit(names["good"]))
    tracked = docs.select(F.col("file_id").alias("connection_id"), "file_id", target.alias("target_table"), F.lit(V.GRID_HEADER_ROW).alias("header_row"),
                          F.lit(None).cast("array<string>").alias("selected_columns"), F.lit(True).alias("sync_enabled"))
    try:
        runs = [sync_all(spark, tracked, docs, names["state"]).select("file_id", F.col("status").alias(c)) for c in ("first_run", "second_run")]
        return land(runs[0].join(runs[1], "file_id"), "sync-files")
    finally:
        for n in names.values():
            S.drop_table(spark, n)


# --------------------------------------------------------------- catalog
_WANTED = [("orders", "o_orderkey", "BIGINT"), ("orders", "o_comment", "STRING"), ("customer", "c_custkey", "INT"), ("nation", "n_name", "STRING"),
           ("nation", "n_nationkey", "INT"), ("nation", "n_regionkey", "INT"), ("nothere", "x", "INT")]


@register("catalog_contracts", """
SELECT * FROM (VALUES ('orders', false, 'o_comment', ''), ('customer', false, '', 'c_custkey'), ('nation', true, '', ''), ('nothere', false, 'x', ''))
  AS t(table_name, valid, missing, mismatched)""")
def q_catalog_contracts(spark, sf_dir):
    """K8: contracts on tables of the catalog; a table that is not there misses all its columns."""
    from gridflow.operators.contracts import validate_tables
    with _catalogued(spark, sf_dir) as db:
        expected = spark.createDataFrame([(f"{db}.{t}", c, k) for t, c, k in _WANTED], "table_name string, column_name string, type string")
        out = validate_tables(spark, expected)
        return land(out.select(F.element_at(F.split("table_name", r"\."), -1).alias("table_name"), "valid",
                               F.array_join("missing_columns", ",").alias("missing"),
                               F.array_join(F.transform("type_mismatches", lambda x: x["column"]), ",").alias("mismatched")), "contracts")


@register("catalog_tables", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, {{n}} AS n_columns FROM {t}".replace("{n}", n)
    for t, n in (("customer", "5"), ("conversations", "4"), ("nation", "3"), ("region", "2"))))
def q_catalog_tables(spark, sf_dir):
    """K7: tables of a schema by glob, with statistics and columns."""
    from gridflow.operators.contracts import discover_tables
    with _catalogued(spark, sf_dir) as db:
        found = discover_tables(spark, db, ["c*", "*ion"], "SIMPLE")
        columns = found["columns"].groupBy("table_name").agg(F.count("*").cast("int").alias("n_columns"))
        out = found["tables"].join(columns, "table_name")
        return land(out.select(F.element_at(F.split("table_name", r"\."), -1).alias("table_name"), "n_rows", "n_columns"), "catalog")


class _catalogued:
    """The given tables as external tables of a schema of their own."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir, self.db = spark, sf_dir, f"gridflow_given_{uuid.uuid4().hex[:8]}"

    def __enter__(self) -> str:
        self.spark.sql(f"CREATE SCHEMA {self.db}")
        for t in GIVEN_TABLES:
            self.spark.sql(f"CREATE TABLE {self.db}.{t} USING parquet LOCATION '{self.sf_dir}/{t}.parquet'")
        return self.db

    def __exit__(self, *exc):
        self.spark.sql(f"DROP SCHEMA IF EXISTS {self.db} CASCADE")      # external: the files stay


# -------------------------------------------------------------- streams
@register("stream_runs", V.with_views("""
SELECT count(*) AS n_documents, 5 AS n_batches, true AS whole FROM docs_v""", "docs_v"))
def q_stream_runs(spark, sf_dir):
    """A stream over five landings of the documents table leaves a row a batch in its run table, which is read
    after the query has ended."""
    import time

    from gridflow.streaming import runs
    base = scratch_path(spark, "stream-runs")
    V.docs_v(spark, sf_dir).select("file_id", "is_deleted").repartition(5).write.parquet(f"{base}/landing")
    name = f"runs {uuid.uuid4().hex[:8]}"
    runs.run_listener(spark).watch(name, f"{base}/runs", lambda batch: {})
    q = (spark.readStream.schema("file_id string, is_deleted boolean").option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
         .writeStream.queryName(name).foreachBatch(lambda d, e: d.write.mode("append").parquet(f"{base}/out"))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    for _ in range(100):          # progress is told a little after the batch
        table = runs.read_runs(spark, f"{base}/runs")
        if table.count() >= 5:
            break
        time.sleep(0.2)
    return table.agg(F.sum("num_input_rows").alias("n_documents"), F.count("*").cast("int").alias("n_batches"),
                     (F.count_distinct("batch_id") == 5).alias("whole"))


# ------------------------------------------------------------- statistics
def _statistics(spark, sf_dir, detailed: bool, out):
    """``out(store)`` of the statistics of all given tables, stored and refreshed twice: the second time nothing is read."""
    from gridflow.operators.statistics import refresh_statistics
    from gridflow.sinks.loads import drop_loads
    store = _fresh("stats")
    roots = {t: f"{sf_dir}/{t}.parquet" for t in GIVEN_TABLES}
    try:
        refresh_statistics(spark, store, roots, detailed)
        assert refresh_statistics(spark, store, roots, detailed) == {"read": 0, "dropped": 0}
        return land(out(store), "statistics")
    finally:
        drop_loads(spark, store)


@register("stored_counts", "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, true AS has_size FROM {t}" for t in GIVEN_TABLES))
def q_stored_counts(spark, sf_dir):
    """E9 from stored statistics, counted from footers."""
    from gridflow.operators.statistics import table_statistics
    return _statistics(spark, sf_dir, False, lambda store: table_statistics(spark, store).select(
        "table_name", "n_rows", (F.col("size_in_bytes") > 0).alias("has_size")))


@register("stored_sketches", f"""
SELECT *, true AS distinct_near, true AS quartiles_near FROM ({_profile_sql()})
UNION ALL SELECT 'embeddings', 'embedding', count(*), count(*) FILTER (WHERE embedding IS NULL), min(len(embedding))::DOUBLE, max(len(embedding))::DOUBLE,
       NULL, NULL, true, true FROM embeddings""")
def q_stored_sketches(spark, sf_dir):
    """E10 from stored sketches, merged over files: distinct counts within 5 % of the exact ones and the ranks of quartiles within 3 %, of
    every column of every given table, arrays included."""
    from gridflow.operators.contracts import column_stats
    from gridflow.operators.statistics import column_statistics
    given = {t: V.table(spark, sf_dir, t) for t in GIVEN_TABLES}
    exact = column_stats(spark, given, "exact").select("table_name", "column_name", F.col("n_distinct").alias("__exact"))
    ranks = None

    def out(store):
        nonlocal ranks
        c = land(column_statistics(spark, store), "sketches")
        for r in c.where("kind = 'number' AND quartiles IS NOT NULL").select("table_name", "column_name", "quartiles").collect():    # a row a column
            x = F.col(r["column_name"]).cast("double")
            q = [F.abs((F.count_if(x < v) + F.count_if(x <= v)) / 2 / F.count(x) - p)
                 - F.count_if(x == v) / 2 / F.count(x) <= 0.03 for v, p in zip(r["quartiles"], (0.25, 0.5, 0.75))]
            one = given[r["table_name"]].agg((q[0] & q[1] & q[2]).alias("__ranks")).select(
                F.lit(r["table_name"]).alias("table_name"), F.lit(r["column_name"]).alias("column_name"), "__ranks")
            ranks = one if ranks is None else ranks.unionByName(one)
        keys = ["table_name", "column_name"]
        d = c.join(exact, keys, "left").join(ranks, keys, "left")
        near = F.abs(F.col("n_distinct") - F.col("__exact")) <= 0.05 * F.col("__exact")
        return d.select(*keys, "n_rows", "n_nulls", "min_num", "max_num", "min_text", "max_text",
                        F.when(F.col("__exact").isNull() | (F.col("__exact") == 0), F.lit(True)).otherwise(near).alias("distinct_near"),
                        F.coalesce("__ranks", F.lit(True)).alias("quartiles_near"))
    return _statistics(spark, sf_dir, True, out)

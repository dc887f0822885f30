"""Deterministic views over the given tables, in Spark and in DuckDB SQL.

The reference's inputs (a documents table of workbooks, a sync registry, a
watermark store, change events) are not among the given tables, so each is
derived from one of them by a fixed rule. Every view is a narrow projection or
a keyed aggregate of its source, so it grows with the data.

| view      | source    | rule |
| docs_v    | documents | file_id = doc_id; name = source_lang_id.xlsx; size = n_chars;
|           |           | modified = 2024-01-01 + (id*37 mod 43200) min; created = + id min;
|           |           | deleted when id mod 11 = 0; content = utf-8 of text |
| state_v   | documents | id mod 3 <> 0: watermark = modified + (id mod 5 - 2) days |
| tracked_v | documents | id mod 10 <> 9; file id bogus when id mod 10 = 7; enabled when
|           |           | id mod 4 <> 0; target exists when id mod 7 <> 0 |
| grid_v    | lineitem  | one workbook per (supplier, block of 32768 order keys): row 0
|           |           | ['Supplier ID', suppkey], row 1 blank, row 2 header, rows 3.. data |
| change_v  | events    | table_name = event_type, ts |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
ORDER_BLOCK = 32768
GRID_HEADER = ("Date", "SKU", "Qty", "Price", "Open")
GRID_HEADER_ROW = 2
CELLS = "array<struct<kind:string,raw:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _minutes(q):
    return F.timestamp_add("MINUTE", q, F.expr(EPOCH))


def docs_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    modified = _minutes((F.col("doc_id") * 37) % 43200)
    name = F.concat(F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string")),
                    F.lit(".xlsx"))
    return d.select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.struct(
            name.alias("name"),
            F.col("n_chars").alias("size_in_bytes"),
            modified.alias("last_modified_timestamp"),
            _minutes(F.col("doc_id")).alias("created_timestamp"),
        ).alias("file_metadata"),
        F.encode("text", "UTF-8").alias("content"),
        ((F.col("doc_id") % 11) == 0).alias("is_deleted"),
    )


def state_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter((F.col("doc_id") % 3) != 0)
    modified = _minutes((F.col("doc_id") * 37) % 43200)
    return d.select(
        F.concat(F.lit("main.sync.t_"), F.col("doc_id").cast("string")).alias("target_table"),
        F.col("doc_id").cast("string").alias("file_id"),
        F.timestamp_add("DAY", (F.col("doc_id") % 5) - 2, modified).alias("watermark"),
        modified.alias("synced_at"),
    )


def tracked_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter((F.col("doc_id") % 10) != 9)
    fid = F.when((F.col("doc_id") % 10) == 7, F.col("doc_id") + 1000000).otherwise(F.col("doc_id"))
    return d.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("connection_id"),
        F.concat(F.lit("conn_"), F.col("doc_id").cast("string")).alias("connection_name"),
        F.lit("documents").alias("document_table"),
        fid.cast("string").alias("file_id"),
        F.concat(F.lit("main.sync.t_"), F.col("doc_id").cast("string")).alias("target_table"),
        F.lit(GRID_HEADER_ROW).alias("header_row"),
        ((F.col("doc_id") % 4) != 0).alias("sync_enabled"),
        ((F.col("doc_id") % 7) != 0).alias("target_exists"),
        _minutes((F.col("doc_id") * 53) % 10007).alias("created_at"),
    )


def _cell(kind, raw):
    return F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"),
                    raw.cast("string").alias("raw"))


def grid_v(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Rows of one-sheet workbooks made from lineitem, in the decoder's shape:
    file_id, sheet_ix, sheet, row_ix, cells array<struct<kind, raw>>.

    The row number is a window over one workbook, which holds at most
    7 x 32768 lines whatever the supplier's share of the data. One scan and one
    shuffle of the bare columns: rows are dealt by file, sorted by the numbers
    that make up its name, and the first line of a file brings its fixed rows.
    ``parts`` holds the number of partitions (None: left to Spark, by bytes).
    """
    li = table(spark, sf_dir, "lineitem")
    named = F.col("l_suppkey").isNotNull() & F.col("l_orderkey").isNotNull()   # else the file's name is NULL
    supp = F.when(named, F.col("l_suppkey"))
    block = F.when(named, F.floor(F.col("l_orderkey") / ORDER_BLOCK).cast("bigint"))
    fid = F.concat(F.lit("supplier_"), supp.cast("string"), F.lit("_"), block.cast("string"), F.lit(".xlsx"))
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
                   "l_linestatus").repartition(*([parts] if parts else []), fid).withColumns({"file_id": fid, "_supp": supp, "_block": block})
    w = Window.partitionBy("_supp", "_block", "file_id").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    price_null = ((F.col("l_orderkey") + F.col("l_linenumber")) % 13) == 0
    li = li.withColumn("_rn", F.row_number().over(w))
    row = lambda ix, *cells: F.struct(ix.cast("int").alias("row_ix"), F.array(*cells).cast(CELLS).alias("cells"))
    data = row(F.col("_rn") + GRID_HEADER_ROW,
               _cell("d", F.col("l_shipdate")),
               _cell("s", F.concat(F.lit("SKU"), F.col("l_partkey").cast("string"))),
               _cell("n", F.col("l_quantity")),
               F.when(price_null, _cell("null", F.lit(None)))
                .otherwise(_cell("n", F.col("l_extendedprice"))),
               _cell("b", F.when(F.col("l_linestatus") == "O", F.lit("true")).otherwise(F.lit("false"))))
    fixed = [row(F.lit(0), _cell("s", F.lit("Supplier ID")), _cell("n", F.col("l_suppkey"))), row(F.lit(1)),
             row(F.lit(GRID_HEADER_ROW), *[_cell("s", F.lit(h)) for h in GRID_HEADER])]
    rows = li.select("file_id", F.inline(F.when(F.col("_rn") == 1, F.array(*fixed, data)).otherwise(F.array(data))))
    return rows.select("file_id", F.lit(0).alias("sheet_ix"), F.lit("Sheet1").alias("sheet"),
                       "row_ix", "cells")


def change_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("table_name"), "ts")


# ---------------------------------------------------------------- DuckDB text
SQL_VIEWS = {
    "docs_v": """
docs_v AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id,
         source || '_' || lang || '_' || CAST(doc_id AS VARCHAR) || '.xlsx' AS name,
         n_chars AS size_in_bytes,
         TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 37) % 43200 AS BIGINT)) AS last_modified_timestamp,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS BIGINT)) AS created_timestamp,
         (doc_id % 11 = 0) AS is_deleted,
         text, doc_id
  FROM documents)""",
    "state_v": """
state_v AS (
  SELECT 'main.sync.t_' || CAST(doc_id AS VARCHAR) AS target_table,
         CAST(doc_id AS VARCHAR) AS file_id,
         TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 37) % 43200 AS BIGINT))
           + to_days(CAST(doc_id % 5 - 2 AS INTEGER)) AS watermark
  FROM documents WHERE doc_id % 3 <> 0)""",
    "tracked_v": """
tracked_v AS (
  SELECT 'c' || CAST(doc_id AS VARCHAR) AS connection_id,
         'conn_' || CAST(doc_id AS VARCHAR) AS connection_name,
         'documents' AS document_table,
         CAST(CASE WHEN doc_id % 10 = 7 THEN doc_id + 1000000 ELSE doc_id END AS VARCHAR) AS file_id,
         'main.sync.t_' || CAST(doc_id AS VARCHAR) AS target_table,
         2 AS header_row,
         (doc_id % 4 <> 0) AS sync_enabled,
         (doc_id % 7 <> 0) AS target_exists,
         TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 53) % 10007 AS BIGINT)) AS created_at
  FROM documents WHERE doc_id % 10 <> 9)""",
    "grid_v": """
li_v AS (
  SELECT *, 'supplier_' || CAST(l_suppkey AS VARCHAR) || '_'
            || CAST(CAST(floor(l_orderkey / 32768) AS BIGINT) AS VARCHAR) || '.xlsx' AS file_id
  FROM lineitem),
grid_v AS (
  SELECT file_id, 0 AS sheet_ix, 'Sheet1' AS sheet,
         CAST(row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey, l_linenumber, l_partkey,
                                 l_quantity, l_extendedprice) + 2 AS INTEGER) AS row_ix,
         [ {'kind': 'd', 'raw': CAST(l_shipdate AS VARCHAR)},
           {'kind': 's', 'raw': 'SKU' || CAST(l_partkey AS VARCHAR)},
           {'kind': 'n', 'raw': CAST(l_quantity AS VARCHAR)},
           CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN {'kind': 'null', 'raw': NULL::VARCHAR}
                ELSE {'kind': 'n', 'raw': CAST(l_extendedprice AS VARCHAR)} END,
           {'kind': 'b', 'raw': CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END} ] AS cells
  FROM li_v
  UNION ALL
  SELECT file_id, 0, 'Sheet1', 0,
         [ {'kind': 's', 'raw': 'Supplier ID'}, {'kind': 'n', 'raw': CAST(any_value(l_suppkey) AS VARCHAR)} ]
  FROM li_v GROUP BY file_id
  UNION ALL
  SELECT file_id, 0, 'Sheet1', 1, CAST([] AS STRUCT(kind VARCHAR, raw VARCHAR)[])
  FROM li_v GROUP BY file_id
  UNION ALL
  SELECT file_id, 0, 'Sheet1', 2,
         [ {'kind': 's', 'raw': 'Date'}, {'kind': 's', 'raw': 'SKU'}, {'kind': 's', 'raw': 'Qty'},
           {'kind': 's', 'raw': 'Price'}, {'kind': 's', 'raw': 'Open'} ]
  FROM li_v GROUP BY file_id)""",
    "change_v": """
change_v AS (SELECT event_type AS table_name, ts FROM events)""",
}

VIEW_DEPS = {"grid_v": [], "docs_v": [], "state_v": [], "tracked_v": [], "change_v": []}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` (a SELECT, optionally starting with more CTEs after a
    comma) with the DuckDB text of the named views."""
    ctes = ",\n".join(SQL_VIEWS[n].strip() for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

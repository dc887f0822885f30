"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame
over the given tables; ``ORACLE`` holds the equivalent DuckDB SQL.

Column names are aliased identically on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridflow.plans import views as V
from gridflow.sources import documents as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# DuckDB list of the missing-value tokens (same values as functions.cells.MISSING_TOKENS)
_NA_SQL = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
           "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------- documents
@register("list_documents", V.with_views("""
SELECT file_id, file_id AS path, name, size_in_bytes AS size,
       last_modified_timestamp AS "modificationTime", created_timestamp AS "createdTime", is_deleted
FROM docs_v WHERE is_deleted = false
ORDER BY last_modified_timestamp DESC, file_id LIMIT 100""", "docs_v"))
def q_list_documents(spark, sf_dir):
    return D.list_documents(V.docs_v(spark, sf_dir), limit=100)


def _new_snapshot(spark, sf_dir):
    """A later snapshot of docs_v: ids with id mod 13 = 5 vanish, id mod 5 = 0
    move one hour later, id mod 17 = 3 become tombstones, and id mod 17 = 0
    gain a new sibling file ``id + 1000000``."""
    from pyspark.sql import functions as F
    d = V.docs_v(spark, sf_dir).withColumn("_id", F.col("file_id").cast("bigint"))
    kept = d.filter((F.col("_id") % 13) != 5).select(
        "file_id",
        F.struct(
            F.col("file_metadata.name").alias("name"),
            F.col("file_metadata.size_in_bytes").alias("size_in_bytes"),
            F.when((F.col("_id") % 5) == 0,
                   F.timestamp_add("HOUR", F.lit(1), F.col("file_metadata.last_modified_timestamp")))
             .otherwise(F.col("file_metadata.last_modified_timestamp")).alias("last_modified_timestamp"),
            F.col("file_metadata.created_timestamp").alias("created_timestamp"),
        ).alias("file_metadata"),
        "content",
        (F.col("is_deleted") | ((F.col("_id") % 17) == 3)).alias("is_deleted"),
    )
    added = d.filter((F.col("_id") % 17) == 0).select(
        (F.col("_id") + 1000000).cast("string").alias("file_id"),
        F.struct(
            F.concat(F.lit("new_"), F.col("file_metadata.name")).alias("name"),
            F.col("file_metadata.size_in_bytes").alias("size_in_bytes"),
            F.col("file_metadata.last_modified_timestamp").alias("last_modified_timestamp"),
            F.col("file_metadata.created_timestamp").alias("created_timestamp"),
        ).alias("file_metadata"),
        "content", F.lit(False).alias("is_deleted"))
    return kept.unionByName(added)


@register("diff_snapshot", V.with_views("""
WITH new_v AS (
  SELECT file_id, name,
         last_modified_timestamp + CASE WHEN doc_id % 5 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END
           AS last_modified_timestamp,
         (is_deleted OR doc_id % 17 = 3) AS is_deleted
  FROM docs_v WHERE doc_id % 13 <> 5
  UNION ALL
  SELECT CAST(doc_id + 1000000 AS VARCHAR), 'new_' || name, last_modified_timestamp, false
  FROM docs_v WHERE doc_id % 17 = 0)
SELECT coalesce(n.file_id, o.file_id) AS file_id,
       CASE WHEN o.file_id IS NULL THEN 'new'
            WHEN n.file_id IS NULL THEN CASE WHEN o.is_deleted THEN 'unchanged' ELSE 'deleted' END
            WHEN n.last_modified_timestamp > o.last_modified_timestamp THEN 'changed'
            WHEN coalesce(o.is_deleted, false) <> coalesce(n.is_deleted, false) THEN 'changed'
            ELSE 'unchanged' END AS change,
       CASE WHEN n.file_id IS NOT NULL THEN n.name ELSE o.name END AS name,
       CASE WHEN n.file_id IS NOT NULL THEN n.last_modified_timestamp ELSE o.last_modified_timestamp END
         AS last_modified_timestamp,
       CASE WHEN n.file_id IS NOT NULL THEN n.is_deleted ELSE true END AS is_deleted
FROM docs_v o FULL OUTER JOIN new_v n ON o.file_id = n.file_id""", "docs_v"))
def q_diff_snapshot(spark, sf_dir):
    from pyspark.sql import functions as F
    out = D.diff_snapshot(V.docs_v(spark, sf_dir), _new_snapshot(spark, sf_dir))
    return out.select("file_id", "change", F.col("file_metadata.name").alias("name"),
                      F.col("file_metadata.last_modified_timestamp").alias("last_modified_timestamp"),
                      "is_deleted")


def _listing(spark, sf_dir):
    return D.list_documents(V.docs_v(spark, sf_dir), limit=None, ordered=False).select("file_id", "name")


@register("search_documents", V.with_views("""
SELECT file_id, name FROM docs_v
WHERE is_deleted = false
  AND (contains(lower(coalesce(name, '')), '_en_1') OR contains(lower(coalesce(file_id, '')), '_en_1'))""",
    "docs_v"))
def q_search_documents(spark, sf_dir):
    from gridflow.functions.filters import search
    return search(_listing(spark, sf_dir), "_EN_1", ["name", "file_id"])


@register("name_contains", V.with_views("""
SELECT file_id, name FROM docs_v
WHERE is_deleted = false AND contains(lower(coalesce(name, '')), 'rc3_f')""", "docs_v"))
def q_name_contains(spark, sf_dir):
    from gridflow.functions.filters import name_contains
    return name_contains(_listing(spark, sf_dir), "RC3_F")


@register("glob_documents", V.with_views("""
SELECT file_id, name FROM docs_v
WHERE is_deleted = false
  AND (name GLOB 'src1?_en_*3.xlsx' OR name GLOB 'src[23]_[!e]?_*[!0-4].xlsx')""", "docs_v"))
def q_glob_documents(spark, sf_dir):
    from gridflow.functions.filters import glob_filter
    return glob_filter(_listing(spark, sf_dir), "name", ["src1?_en_*3.xlsx", "src[23]_[!e]?_*[!0-4].xlsx"])


@register("prefix_documents", V.with_views("""
SELECT file_id, name FROM docs_v WHERE is_deleted = false AND starts_with(name, 'src2_')""", "docs_v"))
def q_prefix_documents(spark, sf_dir):
    from gridflow.functions.filters import starts_with
    return starts_with(_listing(spark, sf_dir), "name", "src2_")


# ----------------------------------------------------------------- scalars
_SAFE_NAME_SQL = ("lower(trim(regexp_replace(regexp_replace(regexp_extract({x}, '[^/]*$', 0), "
                  "'\\.(xlsx|xls)$', '', 'i'), '[^a-zA-Z0-9_]', '_', 'g'), '_'))")


@register("table_names", V.with_views(f"""
SELECT 'doc' AS kind, file_id AS id, name AS input, {_SAFE_NAME_SQL.format(x='name')} AS table_name
FROM docs_v
UNION ALL
SELECT 'page', CAST(page_id AS VARCHAR), url, {_SAFE_NAME_SQL.format(x='url')} FROM pages""", "docs_v"))
def q_table_names(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.functions.scalars import table_name
    docs = V.docs_v(spark, sf_dir).select(
        F.lit("doc").alias("kind"), F.col("file_id").alias("id"),
        F.col("file_metadata.name").alias("input"))
    pages = V.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"),
        F.col("url").alias("input"))
    both = docs.unionByName(pages)
    return both.withColumn("table_name", table_name(F.col("input")))


_UUID_SQL = ("substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 4) || '-' "
             "|| substr(md5(CAST(doc_id AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 17, 4) "
             "|| '-' || substr(md5(CAST(doc_id AS VARCHAR)), 21, 12)")


@register("extract_uuid", f"""
WITH c AS (
  SELECT doc_id, CASE doc_id % 5
      WHEN 0 THEN 'Site ID: ' || {_UUID_SQL}
      WHEN 1 THEN 'see ' || upper({_UUID_SQL}) || ' for the site'
      WHEN 2 THEN 'the id is pending'
      WHEN 3 THEN 'nothing to see here'
      ELSE NULL END AS comment
  FROM documents)
SELECT doc_id, comment,
       CASE WHEN comment IS NULL OR comment = '' THEN ''
            WHEN contains(lower(comment), 'site') OR contains(lower(comment), 'id') THEN
              CASE WHEN regexp_extract(comment, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', 0) <> ''
                   THEN regexp_extract(comment, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', 0)
                   ELSE comment END
            ELSE '' END AS site_id
FROM c""")
def q_extract_uuid(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.functions.scalars import extract_uuid
    h = F.md5(F.col("doc_id").cast("string"))
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                    F.substring(h, 17, 4), F.substring(h, 21, 12))
    m = F.col("doc_id") % 5
    comment = (F.when(m == 0, F.concat(F.lit("Site ID: "), u))
               .when(m == 1, F.concat(F.lit("see "), F.upper(u), F.lit(" for the site")))
               .when(m == 2, F.lit("the id is pending"))
               .when(m == 3, F.lit("nothing to see here")))
    d = V.table(spark, sf_dir, "documents").select("doc_id", comment.alias("comment"))
    return d.withColumn("site_id", extract_uuid(F.col("comment")))


@register("content_bytes", """
SELECT doc_id,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE octet_length(encode(text)) END AS n_bytes,
       CASE WHEN doc_id % 9 = 0 THEN NULL ELSE octet_length(encode(text)) END AS n_bytes_struct,
       octet_length(encode(text)) AS n_bytes_binary
FROM documents""")
def q_content_bytes(spark, sf_dir):
    """H3 on three stored shapes of the same bytes: base64 text (corrupted for
    id mod 9 = 0, which must give NULL, not a failed task), a struct wrapping
    that text, and plain binary."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from gridflow.functions.scalars import normalise_content
    d = V.table(spark, sf_dir, "documents")
    raw = F.encode("text", "UTF-8")
    b64 = F.when((F.col("doc_id") % 9) == 0, F.concat(F.lit("!!"), F.base64(raw))).otherwise(F.base64(raw))
    shaped = d.select("doc_id", b64.alias("as_text"),
                      F.struct(b64.alias("inline_content")).alias("as_struct"), raw.alias("as_binary"))
    st = T.StructType([T.StructField("inline_content", T.StringType())])
    return shaped.select(
        "doc_id",
        F.octet_length(normalise_content(F.col("as_text"), T.StringType())).cast("bigint").alias("n_bytes"),
        F.octet_length(normalise_content(F.col("as_struct"), st)).cast("bigint").alias("n_bytes_struct"),
        F.octet_length(normalise_content(F.col("as_binary"), T.BinaryType())).cast("bigint")
         .alias("n_bytes_binary"))


@register("nonblank_split", """
WITH v AS (
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '   ' WHEN 1 THEN NULL WHEN 2 THEN ''
                 WHEN 3 THEN chr(9) || ' ' ELSE text END AS value
  FROM documents)
SELECT doc_id, value, CASE WHEN regexp_matches(coalesce(value, ''), '\\S') THEN 'ok' ELSE 'reject' END AS status
FROM v""")
def q_nonblank_split(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.functions.filters import require_nonblank
    m = F.col("doc_id") % 7
    v = (F.when(m == 0, F.lit("   ")).when(m == 1, F.lit(None).cast("string"))
         .when(m == 2, F.lit("")).when(m == 3, F.lit("\t "))
         .otherwise(F.col("text")))
    d = V.table(spark, sf_dir, "documents").select("doc_id", v.alias("value"))
    ok, rejects = require_nonblank(d, "value")
    return ok.withColumn("status", F.lit("ok")).unionByName(rejects.withColumn("status", F.lit("reject")))


# ------------------------------------------------------------------ keyed
@register("missing_keys", """
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def q_missing_keys(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.keyed import missing_keys
    cust = V.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return missing_keys(cust, orders, "c_custkey")


@register("insert_if_absent", """
WITH t AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0),
r AS (SELECT c_custkey, c_name || '_new' AS c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0
      UNION ALL
      SELECT c_custkey, c_name || '_dup', c_mktsegment FROM customer WHERE c_custkey % 10 = 4),
u AS (SELECT * FROM r WHERE c_custkey IN (SELECT c_custkey FROM r GROUP BY 1 HAVING count(*) = 1))
SELECT *, 'existing' AS origin FROM t
UNION ALL
SELECT *, 'inserted' FROM u WHERE c_custkey NOT IN (SELECT c_custkey FROM t)""")
def q_insert_if_absent(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.keyed import insert_if_absent
    c = V.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    t = c.filter((F.col("c_custkey") % 3) != 0)
    r = (c.filter((F.col("c_custkey") % 2) == 0).withColumn("c_name", F.concat("c_name", F.lit("_new")))
         .unionByName(c.filter((F.col("c_custkey") % 10) == 4)
                      .withColumn("c_name", F.concat("c_name", F.lit("_dup")))))
    _, inserted, _ = insert_if_absent(t, r, "c_custkey")
    return (t.withColumn("origin", F.lit("existing"))
            .unionByName(inserted.withColumn("origin", F.lit("inserted"))))


@register("update_where", """
SELECT o_orderkey, o_orderstatus,
       CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN '1-URGENT' ELSE o_orderpriority END
         AS o_orderpriority
FROM orders""")
def q_update_where(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.keyed import update_where
    o = V.table(spark, sf_dir, "orders")
    out = update_where(o, (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000),
                       {"o_orderpriority": "1-URGENT"})
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@register("delete_where", """
SELECT o_orderkey, o_custkey, (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') AS deleted FROM orders""")
def q_delete_where(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.keyed import delete_where
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                                 "o_orderstatus")
    kept, gone = delete_where(o, (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"))
    return (kept.select("o_orderkey", "o_custkey", F.lit(False).alias("deleted"))
            .unionByName(gone.select("o_orderkey", "o_custkey", F.lit(True).alias("deleted"))))


@register("keyed_table", """
WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
r AS (SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0
      UNION ALL SELECT o_orderkey, -1, 'D', 0.0 FROM orders WHERE o_orderkey % 10 = 4),
u AS (SELECT * FROM r WHERE o_orderkey IN (SELECT o_orderkey FROM r GROUP BY 1 HAVING count(*) = 1)),
i AS (SELECT * FROM t UNION ALL SELECT * FROM u WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)),
up AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM i),
d AS (SELECT * FROM up WHERE NOT (o_orderstatus = 'F' AND o_custkey % 7 = 3)),
m AS (SELECT o_orderkey + 1000000000 * (o_orderkey % 2) AS o_orderkey, o_custkey, 'M' AS o_orderstatus, o_totalprice
      FROM orders WHERE o_totalprice < 2000)
SELECT * FROM d WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m) UNION ALL SELECT * FROM m""")
def q_keyed_table(spark, sf_dir):
    """B4, B6-B8 on a stored table: two thirds of the orders are stored in key ranges, then
    rows are inserted (some keys exist or repeat), updated, deleted and upserted, each a version of its own."""
    import uuid

    from pyspark.sql import functions as F

    from gridflow.session import land
    from gridflow.sinks import keyed_tables as K
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    name = f"gridflow_queries.keyed_{uuid.uuid4().hex[:8]}"
    K.create_keyed(o.where(k % 3 != 0), name, "o_orderkey")
    try:
        repeated = o.where(k % 10 == 4).select(k, F.lit(-1).cast("long").alias("o_custkey"), F.lit("D").alias("o_orderstatus"),
                                               F.lit(0.0).alias("o_totalprice"))
        K.insert_keyed(o.where(k % 2 == 0).withColumn("o_orderstatus", F.lit("N")).unionByName(repeated), name)
        K.update_keyed(spark, name, F.col("o_totalprice") > 400000, {"o_orderstatus": "X"})
        K.delete_keyed(spark, name, (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 7 == 3))
        some = o.where("o_totalprice < 2000").withColumns({"o_orderkey": k + 1000000000 * (k % 2), "o_orderstatus": F.lit("M")})
        K.upsert_keyed(some, name)
        return land(spark.table(name), "keyed-table")
    finally:
        K.drop_keyed(spark, name)


@register("latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def q_latest_per_key(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.keyed import latest_per_key
    o = V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest_per_key(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@register("best_by_priority", """
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
      CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 99 END,
      CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END,
      o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def q_best_by_priority(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.keyed import best_by_priority
    o = V.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus",
                                                 "o_orderpriority")
    return best_by_priority(o, "o_custkey",
                            [("o_orderstatus", ["F", "O"]),
                             ("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])],
                            tiebreak=[F.col("o_orderkey")])


@register("list_registry", V.with_views("""
SELECT connection_id, connection_name, file_id, target_table, sync_enabled, created_at
FROM tracked_v ORDER BY created_at DESC, connection_id""", "tracked_v"))
def q_list_registry(spark, sf_dir):
    from gridflow.operators.keyed import list_registry
    t = V.tracked_v(spark, sf_dir).select("connection_id", "connection_name", "file_id",
                                          "target_table", "sync_enabled", "created_at")
    return list_registry(t)


# ------------------------------------------------------------------- gate
@register("resolve_tracked", V.with_views("""
SELECT r.connection_id, t.document_table, t.file_id,
       CASE WHEN t.connection_id IS NULL THEN 'job_not_found'
            WHEN NOT EXISTS (SELECT 1 FROM docs_v d WHERE d.file_id = t.file_id AND d.is_deleted = false)
              THEN 'file_not_found'
            ELSE 'ok' END AS outcome
FROM (SELECT 'c' || CAST(doc_id AS VARCHAR) AS connection_id FROM documents) r
LEFT JOIN tracked_v t ON r.connection_id = t.connection_id""", "docs_v", "tracked_v"))
def q_resolve_tracked(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.gate import resolve_tracked
    req = V.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("connection_id"))
    return resolve_tracked(req, V.tracked_v(spark, sf_dir), V.docs_v(spark, sf_dir))


GATE_SQL = """
WITH ft AS (SELECT file_id, max(last_modified_timestamp) AS file_ts
            FROM docs_v WHERE is_deleted = false GROUP BY file_id)
SELECT t.connection_id, t.file_id, t.target_table, t.target_exists, t.sync_enabled,
       CASE WHEN ft.file_ts IS NULL THEN false WHEN NOT t.target_exists THEN true
            WHEN s.watermark IS NULL THEN true WHEN ft.file_ts <= s.watermark THEN false
            ELSE true END AS should_process,
       CASE WHEN ft.file_ts IS NULL THEN 'File not found in documents table'
            WHEN NOT t.target_exists THEN 'Target table does not exist: initial load'
            WHEN s.watermark IS NULL THEN 'No watermark found: full sync'
            WHEN ft.file_ts <= s.watermark THEN 'File is up to date'
            ELSE 'File has newer changes' END AS reason,
       ft.file_ts AS file_last_updated, s.watermark AS table_last_updated
FROM tracked_v t LEFT JOIN ft ON ft.file_id = t.file_id
LEFT JOIN state_v s ON s.target_table = t.target_table AND s.file_id = t.file_id"""


@register("sync_gate", V.with_views(GATE_SQL, "docs_v", "tracked_v", "state_v"))
def q_sync_gate(spark, sf_dir):
    from gridflow.operators.gate import sync_gate
    t = V.tracked_v(spark, sf_dir).select("connection_id", "file_id", "target_table",
                                          "target_exists", "sync_enabled")
    return sync_gate(t, V.docs_v(spark, sf_dir), V.state_v(spark, sf_dir))


@register("registry_targets", V.with_views("""
SELECT connection_id,
       'main' || '.' || 'sync_' || lower(trim(regexp_replace(regexp_replace(regexp_extract(connection_name, '[^/]*$', 0),
             '\\.(xlsx|xls)$', '', 'i'), '[^a-zA-Z0-9_]', '_', 'g'), '_')) || '.' || target_table AS qualified_target,
       coalesce(CASE WHEN connection_id LIKE '%5' THEN NULL ELSE sync_enabled END, false) AS sync_enabled
FROM tracked_v""", "tracked_v"))
def q_registry_targets(spark, sf_dir):
    """H11 + H6 + H1: qualified target names; a missing enabled flag means off."""
    from pyspark.sql import functions as F

    from gridflow.functions.scalars import default_if_null, qualify, table_name
    t = V.tracked_v(spark, sf_dir)
    flag = F.when(F.col("connection_id").endswith("5"), F.lit(None)).otherwise(F.col("sync_enabled"))
    return t.select("connection_id",
                    qualify(F.lit("main"), F.concat(F.lit("sync_"), table_name(F.col("connection_name"))),
                            F.col("target_table")).alias("qualified_target"),
                    default_if_null(flag, False).alias("sync_enabled"))


@register("append_rejects", f"""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'n/a' WHEN o_orderkey % 10 = 5 THEN 'x' || CAST(o_orderkey AS VARCHAR)
                                   WHEN o_orderkey % 10 = 7 THEN NULL
                                   ELSE CAST(o_totalprice AS VARCHAR) END AS raw FROM orders),
w AS (SELECT *, raw IS NULL OR raw IN ({_NA_SQL}) AS missing FROM v)
SELECT o_orderkey, raw, CASE WHEN missing THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS amount,
       (NOT missing AND TRY_CAST(raw AS DOUBLE) IS NULL) AS rejected
FROM w""")
def q_append_rejects(spark, sf_dir):
    """B3/E11 (without the write): text cells cast to DOUBLE; a present value
    that does not survive the cast marks the row rejected (the append skips
    and counts it); an empty cell or a missing-value token such as ``n/a`` is
    a NULL, not a reject (SURVEY 2.12)."""
    from pyspark.sql import functions as F

    from gridflow.functions.cells import cast_cell, cell_present
    m = F.col("o_orderkey") % 10
    raw = (F.when(m == 3, F.lit("n/a"))
           .when(m == 5, F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
           .when(m == 7, F.lit(None).cast("string"))
           .otherwise(F.col("o_totalprice").cast("string")))
    o = V.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.struct(F.when(raw.isNull(), F.lit("null")).otherwise(F.lit("s")).alias("kind"),
                               raw.alias("raw")).alias("cell"))
    amount = cast_cell(F.col("cell"), "DOUBLE")
    present = cell_present(F.col("cell"))
    return o.select("o_orderkey", F.col("cell.raw").alias("raw"), amount.alias("amount"),
                    (present & amount.isNull()).alias("rejected"))


# -------------------------------------------------------------------- SQL
@register("run_sql_params", """
SELECT o_orderstatus, count(*) AS n_orders, max(o_totalprice) AS max_total, min(o_orderdate) AS first_date
FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderpriority = '1-URGENT'
GROUP BY o_orderstatus""")
def q_run_sql_params(spark, sf_dir):
    import datetime as dt

    from gridflow.sources.sql import run_sql
    return run_sql(spark, """
        SELECT o_orderstatus, count(*) AS n_orders, max(o_totalprice) AS max_total,
               min(o_orderdate) AS first_date
        FROM {orders} WHERE o_orderdate >= :since AND o_orderpriority = :prio
        GROUP BY o_orderstatus""",
                   inputs={"orders": V.table(spark, sf_dir, "orders")},
                   args={"since": dt.date(1997, 1, 1), "prio": "1-URGENT"})


# ------------------------------------------------------------------- grid
def grid_rows_table(spark, sf_dir):
    """``grid_v`` landed once as parquet in the shared folder: decoded rows are
    a stored table in real use, and every grid query reads them several times
    (header layout, row counts, cell classes), which must not redo the
    lineitem window each time."""
    from gridflow.session import land
    return land(grid_parts(spark, sf_dir), "grid")


def grid_parts(spark, sf_dir):
    """``grid_v`` in as many partitions as the session's shuffles have: sorting it, and writing and reading workbooks,
    takes far longer than a partition's bytes tell, so few large partitions would leave cores without work."""
    return V.grid_v(spark, sf_dir, int(spark.conf.get("spark.sql.shuffle.partitions")))


# DuckDB text of the cell classes and the type decision, written
# independently of the Spark expressions it checks.
GRID_CELLS_SQL = f"""
cells_x AS (
  SELECT file_id, sheet, row_ix, i - 1 AS col_ix, cells[i].kind AS kind, cells[i].raw AS raw
  FROM (SELECT *, generate_subscripts(cells, 1) AS i FROM grid_v WHERE row_ix > 2)),
cls_x AS (
  SELECT *, CASE
    WHEN kind = 'null' OR raw IS NULL THEN 'null'
    WHEN kind IN ('s', 'e') AND raw IN ({_NA_SQL}) THEN 'null'
    WHEN kind = 'n' THEN CASE WHEN TRY_CAST(raw AS DOUBLE) = floor(TRY_CAST(raw AS DOUBLE))
                               AND abs(TRY_CAST(raw AS DOUBLE)) < 9.223372036854775e18
                              THEN 'int' ELSE 'float' END
    WHEN kind = 'b' THEN 'bool'
    WHEN kind = 'd' THEN 'date'
    WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN
      CASE WHEN TRY_CAST(trim(raw) AS BIGINT) IS NOT NULL THEN 'int' ELSE 'text' END
    WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?') THEN 'float'
    WHEN trim(raw) IN ('True', 'TRUE', 'true', 'False', 'FALSE', 'false') THEN 'bool_text'
    ELSE 'text' END AS cls
  FROM cells_x)"""


@register("infer_columns", V.with_views(f"""
WITH {GRID_CELLS_SQL},
n AS (SELECT file_id, sheet, count(*) AS n_rows FROM grid_v WHERE row_ix > 2 GROUP BY ALL),
cnt AS (
  SELECT file_id, sheet, col_ix,
         count(*) FILTER (WHERE cls = 'int') AS c_int, count(*) FILTER (WHERE cls = 'float') AS c_float,
         count(*) FILTER (WHERE cls = 'bool') AS c_bool, count(*) FILTER (WHERE cls = 'bool_text') AS c_bt,
         count(*) FILTER (WHERE cls = 'date') AS c_date, count(*) FILTER (WHERE cls = 'text') AS c_text,
         count(*) FILTER (WHERE cls <> 'null') AS nn
  FROM cls_x GROUP BY ALL),
names AS (
  SELECT file_id, sheet, i - 1 AS col_ix, cells[i].raw AS name
  FROM (SELECT *, generate_subscripts(cells, 1) AS i FROM grid_v WHERE row_ix = 2))
SELECT names.file_id, names.sheet, CAST(names.col_ix AS INTEGER) AS col_ix, name,
  CASE WHEN coalesce(n_rows, 0) = 0 THEN 'STRING'
       WHEN coalesce(nn, 0) = 0 THEN 'DOUBLE'
       WHEN c_text > 0 THEN 'STRING'
       WHEN c_date > 0 THEN CASE WHEN c_date = nn THEN 'TIMESTAMP' ELSE 'STRING' END
       WHEN c_bt > 0 THEN CASE WHEN c_bt = nn AND n_rows = nn THEN 'BOOLEAN' ELSE 'STRING' END
       WHEN c_bool > 0 THEN CASE WHEN c_float > 0 THEN 'DOUBLE'
                                 WHEN n_rows > nn THEN 'DOUBLE'
                                 WHEN c_int > 0 THEN 'BIGINT' ELSE 'BOOLEAN' END
       WHEN c_float > 0 THEN 'DOUBLE'
       WHEN n_rows > nn THEN 'DOUBLE' ELSE 'BIGINT' END AS type,
  (coalesce(n_rows, 0) - coalesce(nn, 0) > 0) AS nullable
FROM names LEFT JOIN n USING (file_id, sheet) LEFT JOIN cnt USING (file_id, sheet, col_ix)""", "grid_v"))
def q_infer_columns(spark, sf_dir):
    from gridflow.operators.grid import infer_columns
    return infer_columns(grid_rows_table(spark, sf_dir), header_row=V.GRID_HEADER_ROW)


@register("column_samples", V.with_views(f"""
WITH {GRID_CELLS_SQL}
SELECT file_id, sheet, CAST(col_ix AS INTEGER) AS col_ix, string_agg(raw, '|' ORDER BY row_ix) AS samples
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sheet, col_ix ORDER BY row_ix) AS rn
      FROM cls_x WHERE cls <> 'null')
WHERE rn <= 3 GROUP BY ALL""", "grid_v"))
def q_column_samples(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.grid import column_samples
    s = column_samples(grid_rows_table(spark, sf_dir), header_row=V.GRID_HEADER_ROW)
    return s.select("file_id", "sheet", "col_ix", F.array_join("sample_values", "|").alias("samples"))


@register("sheet_shape", V.with_views("""
SELECT file_id, sheet, CAST(count(*) FILTER (WHERE row_ix > 2) AS BIGINT) AS row_count,
       CAST(max(len(cells)) FILTER (WHERE row_ix >= 2) AS INTEGER) AS column_count
FROM grid_v GROUP BY ALL""", "grid_v"))
def q_sheet_shape(spark, sf_dir):
    from gridflow.operators.grid import sheet_shape
    return sheet_shape(grid_rows_table(spark, sf_dir), header_row=V.GRID_HEADER_ROW)


@register("preview_rows", V.with_views("""
SELECT file_id, sheet, row_ix, len(cells) AS n_values,
       array_to_string(list_transform(cells, lambda c: CASE WHEN c.kind = 'null' THEN '' ELSE coalesce(c.raw, '') END), '|')
         AS values_text
FROM grid_v WHERE sheet_ix = 0 AND row_ix < 100""", "grid_v"))
def q_preview_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.grid import preview
    p = preview(grid_rows_table(spark, sf_dir), max_rows=100)
    return p.select("file_id", "sheet", "row_ix", F.size("values").alias("n_values"),
                    F.concat_ws("|", F.transform("values", lambda v: F.coalesce(v, F.lit(""))))
                    .alias("values_text"))


_LI_ROWS_SQL = """
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey, l_linenumber, l_partkey,
                                        l_quantity, l_extendedprice) + 2 AS INTEGER) AS row_ix, *
FROM li_v"""


def _promoted(spark, sf_dir):
    from gridflow.operators.grid import layout_names, promote_header
    rows = grid_rows_table(spark, sf_dir)
    names = layout_names(rows, V.GRID_HEADER_ROW)
    if len(names) != 1:
        raise ValueError(f"expected one header layout, got {len(names)}")
    return rows, promote_header(rows, names[0], header_row=V.GRID_HEADER_ROW)


@register("promote_header", V.with_views(f"""
WITH r AS ({_LI_ROWS_SQL})
SELECT file_id, 'Sheet1' AS sheet, row_ix, CAST(l_shipdate AS VARCHAR) AS "Date", 'SKU' || CAST(l_partkey AS VARCHAR) AS "SKU",
       CAST(l_quantity AS VARCHAR) AS "Qty",
       CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE CAST(l_extendedprice AS VARCHAR) END AS "Price",
       CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END AS "Open"
FROM r""", "grid_v"))
def q_promote_header(spark, sf_dir):
    from gridflow.operators.grid import as_text
    _, p = _promoted(spark, sf_dir)
    return as_text(p)


GRID_SCHEMA = [("Date", "TIMESTAMP"), ("SKU", "STRING"), ("Qty", "BIGINT"), ("Price", "DOUBLE"),
               ("Open", "BOOLEAN")]
_TYPED_SQL = """
SELECT file_id, row_ix, l_shipdate AS "Date", 'SKU' || CAST(l_partkey AS VARCHAR) AS "SKU",
       CAST(l_quantity AS BIGINT) AS "Qty",
       CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_extendedprice END AS "Price",
       l_linestatus = 'O' AS "Open", CAST(l_suppkey AS VARCHAR) AS supplier_id
FROM r"""


@register("apply_schema", V.with_views(f"""
WITH r AS ({_LI_ROWS_SQL}), t AS ({_TYPED_SQL})
SELECT file_id, row_ix, "Date", "SKU", "Qty", "Price", "Open" FROM t""", "grid_v"))
def q_apply_schema(spark, sf_dir):
    from gridflow.operators.grid import apply_schema
    _, p = _promoted(spark, sf_dir)
    return apply_schema(p, GRID_SCHEMA, keys=("file_id", "row_ix"))


def _typed_with_owner(spark, sf_dir):
    from gridflow.operators.grid import apply_schema, attach_fixed_cell
    rows, p = _promoted(spark, sf_dir)
    typed = apply_schema(p, GRID_SCHEMA, keys=("file_id", "row_ix"))
    return attach_fixed_cell(rows, typed, 0, 1, "supplier_id")


@register("attach_fixed_cell", V.with_views(f"""
WITH r AS ({_LI_ROWS_SQL}), t AS ({_TYPED_SQL})
SELECT file_id, row_ix, supplier_id, "SKU" FROM t""", "grid_v"))
def q_attach_fixed_cell(spark, sf_dir):
    return _typed_with_owner(spark, sf_dir).select("file_id", "row_ix", "supplier_id", "SKU")


@register("null_profile", V.with_views(f"""
WITH r AS ({_LI_ROWS_SQL}), t AS ({_TYPED_SQL})
SELECT 'Date' AS column_name, count(*) FILTER (WHERE "Date" IS NULL) AS null_count FROM t
UNION ALL SELECT 'SKU', count(*) FILTER (WHERE "SKU" IS NULL) FROM t
UNION ALL SELECT 'Qty', count(*) FILTER (WHERE "Qty" IS NULL) FROM t
UNION ALL SELECT 'Price', count(*) FILTER (WHERE "Price" IS NULL) FROM t
UNION ALL SELECT 'Open', count(*) FILTER (WHERE "Open" IS NULL) FROM t
UNION ALL SELECT 'supplier_id', count(*) FILTER (WHERE supplier_id IS NULL) FROM t""", "grid_v"))
def q_null_profile(spark, sf_dir):
    from gridflow.operators.quality import null_profile
    t = _typed_with_owner(spark, sf_dir)
    return null_profile(t, ["Date", "SKU", "Qty", "Price", "Open", "supplier_id"])


@register("single_value_check", """
SELECT 'supplier_consistency' AS "check", count(DISTINCT l_suppkey) AS n_distinct,
       count(DISTINCT l_suppkey) = 1 AS passed FROM lineitem""")
def q_single_value_check(spark, sf_dir):
    from gridflow.operators.quality import single_value_check
    return single_value_check(_typed_with_owner(spark, sf_dir), "supplier_id")


@register("quality_report", V.with_views(f"""
WITH r AS ({_LI_ROWS_SQL}), t AS ({_TYPED_SQL}),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE "Price" IS NULL) AS np,
             count(DISTINCT supplier_id) AS owners FROM t)
SELECT 'row_count' AS "check", CAST(n AS VARCHAR) AS value, n > 0 AS passed FROM a
UNION ALL SELECT 'required_columns', '', true FROM a
UNION ALL SELECT 'null_values', 'Date=0,Open=0,Price=' || CAST(np AS VARCHAR) || ',Qty=0,SKU=0,supplier_id=0', true FROM a
UNION ALL SELECT 'supplier_consistency', CAST(owners AS VARCHAR), owners = 1 FROM a""", "grid_v"))
def q_quality_report(spark, sf_dir):
    from gridflow.operators.quality import quality_report
    t = _typed_with_owner(spark, sf_dir).drop("file_id", "row_ix")
    return quality_report(t, required=("Date", "SKU", "Qty", "supplier_id"), owner_col="supplier_id")


@register("summarise_runs", V.with_views(f"""
WITH g AS ({GATE_SQL})
SELECT CASE WHEN should_process THEN 'processed' ELSE 'skipped' END AS status, reason,
       count(*) AS n_items
FROM g GROUP BY ALL""", "docs_v", "tracked_v", "state_v"))
def q_summarise_runs(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.operators.quality import summarise_runs
    g = q_sync_gate(spark, sf_dir)
    log = g.withColumn("status", F.when(F.col("should_process"), F.lit("processed"))
                       .otherwise(F.lit("skipped")))
    return summarise_runs(log)


# --------------------------------------------------------------- workbooks
def workbook_docs(spark, sf_dir):
    """``grid_v`` encoded as real .xlsx files, in the documents schema: one
    workbook per supplier and order block."""
    from gridflow.sources.workbook import as_documents, encode_workbooks
    return as_documents(encode_workbooks(grid_parts(spark, sf_dir)))


def _decoded(spark, sf_dir):
    from gridflow.sources.workbook import decode_workbooks
    return decode_workbooks(workbook_docs(spark, sf_dir))


@register("decode_workbooks", V.with_views("""
SELECT file_id, sheet, row_ix, len(cells) AS n_values,
       array_to_string(list_transform(cells, lambda c: CASE WHEN c.kind = 'null' THEN '' ELSE coalesce(c.raw, '') END), '|')
         AS values_text,
       array_to_string(list_transform(cells, lambda c: c.kind), '|') AS kinds_text
FROM grid_v""", "grid_v"))
def q_decode_workbooks(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.sources.workbook import grid_rows
    r = grid_rows(_decoded(spark, sf_dir))
    return r.select("file_id", "sheet", "row_ix", F.size("cells").alias("n_values"),
                    F.concat_ws("|", F.transform("cells", lambda c: F.when(c.kind == "null", F.lit(""))
                                                 .otherwise(F.coalesce(c.raw, F.lit(""))))).alias("values_text"),
                    F.concat_ws("|", F.transform("cells", lambda c: c.kind)).alias("kinds_text"))


@register("list_sheets", V.with_views("""
SELECT DISTINCT file_id, 'Sheet1' AS sheets_text, 'Sheet1' AS default_sheet FROM li_v""", "grid_v"))
def q_list_sheets(spark, sf_dir):
    from pyspark.sql import functions as F

    from gridflow.sources.workbook import list_sheets
    s = list_sheets(_decoded(spark, sf_dir))
    return s.select("file_id", F.array_join("sheets", "|").alias("sheets_text"), "default_sheet")


@register("decode_log", V.with_views("""
SELECT file_id, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_sheets, CAST(NULL AS VARCHAR) AS error
FROM grid_v GROUP BY file_id""", "grid_v"))
def q_decode_log(spark, sf_dir):
    from gridflow.sources.workbook import decode_log
    return decode_log(_decoded(spark, sf_dir))


PARSE_SELECTED = ["Date", "Qty", "Price", "SKU"]


@register("parse_to_table", """
SELECT l_shipdate AS "Date", CAST(l_quantity AS BIGINT) AS "Qty",
       CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_extendedprice END AS "Price",
       'SKU' || CAST(l_partkey AS VARCHAR) AS "SKU"
FROM lineitem""")
def q_parse_to_table(spark, sf_dir):
    """K3 without the table write: decode all workbooks once (landed as
    parquet in the shared folder), promote row 2, keep four columns in request
    order, infer their types over all files, cast."""
    from gridflow.plans.jobs import build_typed
    from gridflow.session import land
    from gridflow.sources.workbook import grid_rows
    decoded = land(_decoded(spark, sf_dir), "decoded")
    typed, _ = build_typed(grid_rows(decoded), V.GRID_HEADER_ROW, None, PARSE_SELECTED)
    return typed.drop("_rejected")


def _three_layouts(spark, sf_dir):
    """``grid_v`` with three header layouts, by the number of the supplier: as it is; without the price and with
    the other columns in another order; with a note in front and the quantity called ``Qty`` as text."""
    from pyspark.sql import functions as F
    g = grid_parts(spark, sf_dir)
    kind = F.pmod(F.regexp_extract("file_id", r"supplier_(\d+)", 1).cast("int"), F.lit(3))
    c = lambda i: F.get(F.col("cells"), i)
    cell = lambda k, raw: F.struct(F.lit(k).alias("kind"), raw.alias("raw"))
    head = F.col("row_ix") == V.GRID_HEADER_ROW
    data = F.col("row_ix") > V.GRID_HEADER_ROW
    second = F.array(c(1), c(4), c(0), c(2))
    note = F.when(head, cell("s", F.lit("Note"))).otherwise(cell("s", F.concat(F.lit("n"), F.col("row_ix").cast("string"))))
    qty = F.when(data, cell("s", F.concat(F.lit("q"), F.col("cells")[2]["raw"]))).otherwise(c(2))
    third = F.array(note, c(0), c(1), qty, c(3), c(4))
    new = F.when(head | data, F.when(kind == 1, second).when(kind == 2, third).otherwise(F.col("cells"))).otherwise(F.col("cells"))
    return g.withColumn("cells", new)


@register("parse_mixed", V.with_views(f"""
WITH r AS ({_LI_ROWS_SQL}),
p AS (SELECT *, CAST(regexp_extract(file_id, 'supplier_(\\d+)', 1) AS INTEGER) % 3 AS layout FROM r),
a AS (SELECT file_id, l_shipdate AS "Date", 'SKU' || CAST(l_partkey AS VARCHAR) AS "SKU", CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS "Qty",
             CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_extendedprice END AS "Price", l_linestatus = 'O' AS "Open"
      FROM p WHERE layout = 0),
b AS (SELECT 'SKU' || CAST(l_partkey AS VARCHAR) AS "SKU", l_linestatus = 'O' AS "Open", l_shipdate AS "Date",
             CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS "Qty", file_id FROM p WHERE layout = 1),
c AS (SELECT 'n' || CAST(row_ix AS VARCHAR) AS "Note", file_id, l_shipdate AS "Date", 'SKU' || CAST(l_partkey AS VARCHAR) AS "SKU",
             'q' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS "Qty",
             CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_extendedprice END AS "Price", l_linestatus = 'O' AS "Open"
      FROM p WHERE layout = 2)
SELECT "Date", "SKU", split_part("Qty", '.', 1) AS "Qty", "Price", "Open", "Note"
FROM (SELECT * FROM a UNION ALL BY NAME SELECT * FROM b UNION ALL BY NAME SELECT * FROM c)""", "grid_v"))
def q_parse_mixed(spark, sf_dir):
    """K3 with the write: workbooks of three header layouts (columns missing, moved, added, one of another type) are
    parsed into one stored table by one call; the table is read back."""
    import uuid

    from pyspark.sql import functions as F

    from gridflow.plans.jobs import parse_to_table
    from gridflow.session import land
    from gridflow.sinks.tables import drop_table
    from gridflow.sources.workbook import as_documents, encode_workbooks
    name = f"gridflow_queries.mixed_{uuid.uuid4().hex[:8]}"
    try:
        docs = land(as_documents(encode_workbooks(_three_layouts(spark, sf_dir))), "workbook-docs")
        parse_to_table(spark, docs, None, name, V.GRID_HEADER_ROW)
        t = spark.table(name)
        return land(t.select("Date", "SKU", F.split_part("Qty", F.lit("."), F.lit(1)).alias("Qty"), "Price", "Open", "Note"), "mixed")
    finally:
        drop_table(spark, name)


# -------------------------------------------------------------- contracts
GIVEN_TABLES = ("region nation customer supplier part orders lineitem events documents "
                "embeddings pages benchmark labels conversations").split()
# column kinds of the given tables, for the oracle text: n numeric, t other, x skipped
GIVEN_COLUMNS = {
    "region": "r_regionkey:n r_name:t", "nation": "n_nationkey:n n_name:t n_regionkey:n",
    "customer": "c_custkey:n c_name:t c_nationkey:n c_acctbal:n c_mktsegment:t",
    "supplier": "s_suppkey:n s_name:t s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:t p_brand:t p_type:t p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:t o_totalprice:n o_orderdate:t o_orderpriority:t",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n "
                "l_discount:n l_tax:n l_returnflag:t l_linestatus:t l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:t value:n props:t",
    "documents": "doc_id:n text:t lang:t source:t n_chars:n",
    "embeddings": "vec_id:n embedding:x label:n", "pages": "page_id:n url:t html:t",
    "benchmark": "item_id:n text:t", "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:t text:t",
}


def _profile_sql() -> str:
    parts = []
    for t in GIVEN_TABLES:
        for spec in GIVEN_COLUMNS[t].split():
            c, k = spec.split(":")
            if k == "x":
                continue
            if k == "n":
                mm = (f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), "
                      f"CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)")
            else:
                mm = (f"CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), "
                      f"CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR)")
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS n_nulls, {mm} FROM {t}")
    body = "\nUNION ALL ".join(parts)
    return ("SELECT table_name, column_name, n_rows, n_nulls, c4 AS min_num, c5 AS max_num, "
            "c6 AS min_text, c7 AS max_text FROM (" +
            body + ") AS u(table_name, column_name, n_rows, "
            "n_nulls, c4, c5, c6, c7)")


def _given(spark, sf_dir):
    return {t: V.table(spark, sf_dir, t) for t in GIVEN_TABLES}


@register("profile_tables", _profile_sql())
def q_profile_tables(spark, sf_dir):
    """E10 over every given table: one aggregate per table, unioned."""
    from gridflow.operators.contracts import profile_tables
    return profile_tables(spark, _given(spark, sf_dir), level="DETAILED", distinct="none")


@register("table_stats", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, true AS has_size FROM {t}" for t in GIVEN_TABLES))
def q_table_stats(spark, sf_dir):
    """Rows per table; bytes and modification time from file metadata."""
    from pyspark.sql import functions as F

    from gridflow.operators.contracts import profile_tables
    p = profile_tables(spark, _given(spark, sf_dir), level="SIMPLE")
    return p.select("table_name", "n_rows",
                    ((F.col("size_in_bytes") > 0) & F.col("last_modified").isNotNull()).alias("has_size"))


CONTRACT = [
    ("orders", "o_orderkey", "BIGINT", "bigint"), ("orders", "o_custkey", "LONG", "bigint"),
    ("orders", "o_totalprice", "DOUBLE", "double"), ("orders", "o_orderdate", "TIMESTAMP", "timestamp"),
    ("orders", "o_comment", "STRING", "string"),
    ("customer", "c_custkey", "BIGINT", "bigint"), ("customer", "c_name", "STRING", "string"),
    ("customer", "c_nationkey", "INT", "int"), ("customer", "c_acctbal", "DECIMAL(12,2)", "decimal(12,2)"),
    ("nation", "n_nationkey", "INT", "int"), ("nation", "n_name", "STRING", "string"),
    ("nation", "n_regionkey", "INTEGER", "int"),
    ("region", "r_regionkey", "int", "int"), ("region", "r_name", "string", "string"),
]
_CONTRACT_VALUES = ", ".join(f"('{t}', '{c}', '{ty}', '{norm}')" for t, c, ty, norm in CONTRACT)


@register("validate_schema", f"""
WITH e AS (SELECT * FROM (VALUES {_CONTRACT_VALUES}) AS v(table_name, column_name, raw_type, exp_type)),
a AS (
  SELECT DISTINCT table_name, column_name,
         CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
              WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean'
              WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS act_type
  FROM information_schema.columns
  WHERE table_name IN (SELECT DISTINCT table_name FROM e)),
j AS (SELECT coalesce(e.table_name, a.table_name) AS table_name, coalesce(e.column_name, a.column_name) AS column_name,
             e.exp_type, a.act_type
      FROM e FULL OUTER JOIN a ON e.table_name = a.table_name AND e.column_name = a.column_name)
SELECT table_name,
       count(*) FILTER (WHERE act_type IS NULL) = 0
         AND count(*) FILTER (WHERE act_type IS NOT NULL AND exp_type IS NOT NULL AND exp_type <> act_type) = 0 AS valid,
       coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE act_type IS NULL), '') AS missing_columns,
       coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE exp_type IS NULL), '') AS extra_columns,
       coalesce(string_agg(column_name || ':' || exp_type || '->' || act_type, ',' ORDER BY column_name)
         FILTER (WHERE act_type IS NOT NULL AND exp_type IS NOT NULL AND exp_type <> act_type), '') AS type_mismatches
FROM j GROUP BY table_name""")
def q_validate_schema(spark, sf_dir):
    """A column contract against the real tables' schemas."""
    from pyspark.sql import functions as F

    from gridflow.operators.contracts import actual_columns, validate_schema
    exp = spark.createDataFrame([(t, c, ty) for t, c, ty, _ in CONTRACT],
                                "table_name string, column_name string, type string")
    names = sorted({t for t, *_ in CONTRACT})
    act = actual_columns(spark, {n: V.table(spark, sf_dir, n) for n in names})
    v = validate_schema(exp, act)
    return v.select(
        "table_name", "valid",
        F.array_join("missing_columns", ",").alias("missing_columns"),
        F.array_join("extra_columns", ",").alias("extra_columns"),
        F.array_join(F.transform("type_mismatches", lambda m: F.concat(
            m["column"], F.lit(":"), m["expected"], F.lit("->"), m["actual"])), ",").alias("type_mismatches"))


# -------------------------------------------------------------- streaming
@register("debounce_triggers", """
WITH e AS (SELECT event_type AS table_name, ts FROM events),
f AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY table_name ORDER BY ts) IS NULL
                       OR ts - lag(ts) OVER (PARTITION BY table_name ORDER BY ts) > INTERVAL 60 SECOND
                     THEN 1 ELSE 0 END AS new_burst FROM e),
g AS (SELECT *, sum(new_burst) OVER (PARTITION BY table_name ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM f)
SELECT table_name, min(ts) AS first_change, max(ts) AS last_change,
       max(ts) + INTERVAL 60 SECOND AS fire_at, count(*) AS n_changes
FROM g GROUP BY table_name, burst""")
def q_debounce_triggers(spark, sf_dir):
    from gridflow.streaming.debounce import debounce_triggers
    return debounce_triggers(V.change_v(spark, sf_dir), "60 seconds")


@register("debounce_groups", """
WITH e AS (SELECT 'all_tables' AS group_name, ts FROM events),
f AS (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts) IS NULL
                       OR ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new_burst
      FROM e),
g AS (SELECT *, sum(new_burst) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM f)
SELECT group_name, min(ts) AS first_change, max(ts) AS last_change,
       max(ts) + INTERVAL 300 SECOND AS fire_at, count(*) AS n_changes
FROM g GROUP BY group_name, burst""")
def q_debounce_groups(spark, sf_dir):
    """Every event type is a member of one group, so all changes form one
    key -- the hot-key case the range partitioning exists for."""
    from pyspark.sql import functions as F

    from gridflow.streaming.debounce import debounce_triggers
    ch = V.change_v(spark, sf_dir)
    members = ch.select("table_name").distinct().withColumn("group_name", F.lit("all_tables"))
    return debounce_triggers(ch, "300 seconds", group_map=members)


@register("stream_sync", V.with_views(f"""
WITH f AS (SELECT DISTINCT file_id, CAST(substr(md5(file_id), 1, 1) IN ('0', '1', '2') AS INT) AS gone,
                  CAST(substr(md5(file_id), 1, 1) IN ('3', '4', '5', '6') AS INT) AS cut FROM grid_v),
r AS ({_LI_ROWS_SQL}),
s AS (SELECT *, l_shipdate AS "Date", 'SKU' || CAST(l_partkey AS VARCHAR) AS "SKU", CAST(l_quantity AS BIGINT) AS "Qty",
       CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN NULL ELSE l_extendedprice END AS "Price" FROM r)
SELECT "Date", "SKU", "Qty", "Price", s.file_id AS source_file FROM s JOIN f ON s.file_id = f.file_id
WHERE f.gone = 0 AND (f.cut = 0 OR s.row_ix < 40)""", "grid_v"))
def q_stream_sync(spark, sf_dir):
    """Workbooks land and are synced by a checkpointed stream (availableNow, a few files per
    micro-batch). Then some files come in a newer, shorter version and some are deleted, together with older and equal versions of
    others, which must change nothing; the stream is restarted for them. Small loads are compacted and
    the first landing is replayed as a batch. Returns the table."""
    import uuid

    from pyspark.sql import functions as F

    from gridflow.session import land, scratch_path
    from gridflow.sinks import loads as L
    from gridflow.sinks.tables import compact_state, drop_table
    from gridflow.sources.workbook import as_documents, encode_workbooks
    from gridflow.streaming.sync_stream import StreamConfig, stream_sync, sync_batch
    base = scratch_path(spark, "stream")
    landing = f"{base}/landing"
    docs = land(workbook_docs(spark, sf_dir), "workbook-docs")
    docs.write.mode("append").parquet(landing)
    tag = uuid.uuid4().hex[:8]
    cfg = StreamConfig(target_table=f"gridflow_stream.sync_{tag}", state_table=f"gridflow_stream.state_{tag}",
                       checkpoint=f"{base}/checkpoint", pattern="supplier_*.xlsx",
                       header_row=V.GRID_HEADER_ROW, selected_columns=["Date", "SKU", "Qty", "Price"],
                       trigger="availableNow", max_files_per_trigger=8)
    try:
        stream_sync(spark, landing, cfg).awaitTermination()
        digit = F.substring(F.md5("file_id"), 1, 1)
        stamp = F.col("file_metadata.last_modified_timestamp")
        at = lambda d, hours: d.withColumn("file_metadata", F.col("file_metadata").withField(
            "last_modified_timestamp", F.timestamp_add("HOUR", F.lit(hours), stamp)))
        shorter = V.grid_v(spark, sf_dir).where((F.col("row_ix") < 40) & digit.isin("3", "4", "5", "6"))
        later = land(at(as_documents(encode_workbooks(shorter)), 1), "later-docs")
        gone = at(docs.where(digit.isin("0", "1", "2")), 1).withColumn("is_deleted", F.lit(True))
        stale = at(later.where(digit == "3"), -2).unionByName(docs.where(digit.isin("7", "8")))   # older, equal
        second = later.unionByName(gone.select(later.columns)).unionByName(stale.select(later.columns)).select(docs.columns)
        size = second.agg(F.sum("file_metadata.size_in_bytes")).first()[0] or 0
        second.repartition(max(2, size >> 27)).write.mode("append").parquet(landing)     # files of some 128 MB, as those of the first landing
        stream_sync(spark, landing, cfg).awaitTermination()
        L.compact_loads(spark, cfg.target_table)
        compact_state(spark, cfg.state_table)
        sync_batch(docs.where(~digit.isin("0", "1", "2")), -1, cfg)          # a replay: all of it is known
        return land(spark.table(cfg.target_table), "stream-result")
    finally:
        L.drop_loads(spark, cfg.target_table)
        drop_table(spark, cfg.state_table)


@register("sync_marks", V.with_views("""
SELECT file_id, 'main.t' || CAST(doc_id % 3 AS VARCHAR) AS target_table, last_modified_timestamp + CASE WHEN doc_id % 4 = 1
       THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS watermark
FROM docs_v WHERE doc_id % 5 <> 2 OR doc_id % 10 = 7""", "docs_v"))
def q_sync_marks(spark, sf_dir):
    """Marks of all files are recorded and compacted, then some advance, some are cleared and some of these
    recorded anew; half of it is compacted before the rest comes."""
    import uuid

    from pyspark.sql import functions as F

    from gridflow.session import land
    from gridflow.sinks import tables as S
    n = F.col("file_id").cast("bigint")
    m = V.docs_v(spark, sf_dir).select("file_id", F.concat(F.lit("main.t"), (n % 3).cast("string")).alias("target_table"),
                                       F.col("file_metadata.last_modified_timestamp").alias("watermark"))
    name = f"gridflow_queries.marks_{uuid.uuid4().hex[:8]}"
    hour = lambda k: F.timestamp_add("HOUR", F.lit(k), F.col("watermark"))
    try:
        S.advance_watermark(spark, name, m)
        S.compact_state(spark, name)
        S.clear_watermark(spark, name, m.where(n % 5 == 2))
        S.advance_watermark(spark, name, m.where(n % 4 == 1).withColumn("watermark", hour(1)))
        S.compact_state(spark, name)
        S.clear_watermark(spark, name, m.where(n % 5 == 2))
        late = m.where(n % 4 == 1).withColumn("watermark", hour(2)).where(n % 5 != 2)
        back = m.where(n % 10 == 7).withColumn("watermark", F.when(n % 4 == 1, hour(2)).otherwise(F.col("watermark")))
        S.advance_watermark(spark, name, late.unionByName(back).distinct())
        marks = S.current_marks(S.read_marks(spark, name, m.select("file_id", "target_table")))
        return land(marks.where("watermark is not null").select("file_id", "target_table", F.col("watermark").cast("timestamp_ntz")
                                                                .alias("watermark")), "marks")
    finally:
        S.drop_table(spark, name)


# ------------------------------------------------------------ K1 / K2 jobs
@register("preview_files", V.with_views(f"""
SELECT file_id, 'Sheet1' AS sheets_text, 'Sheet1' AS selected_sheet,
       count(*) AS total_rows, CAST(max(len(cells)) AS INTEGER) AS column_count,
       {_SAFE_NAME_SQL.format(x='file_id')} AS recommended_table_name
FROM grid_v WHERE row_ix < 100 GROUP BY file_id""", "grid_v"))
def q_preview_files(spark, sf_dir):
    """K1 over real workbooks: sheets, first 100 raw rows (the decoder stops
    each sheet there), their count and width, and the suggested table name."""
    from pyspark.sql import functions as F

    from gridflow.plans.jobs import preview_files
    p = preview_files(workbook_docs(spark, sf_dir), None, max_rows=100)
    return p["files"].select("file_id", F.array_join("sheets", "|").alias("sheets_text"), "selected_sheet",
                             "total_rows", F.col("column_count").cast("int").alias("column_count"),
                             "recommended_table_name")


@register("analyze_files", V.with_views(f"""
WITH {GRID_CELLS_SQL},
n AS (SELECT file_id, sheet, count(*) AS n_rows FROM grid_v WHERE row_ix > 2 GROUP BY ALL),
cnt AS (
  SELECT file_id, sheet, col_ix,
         count(*) FILTER (WHERE cls = 'int') AS c_int, count(*) FILTER (WHERE cls = 'float') AS c_float,
         count(*) FILTER (WHERE cls = 'bool') AS c_bool, count(*) FILTER (WHERE cls = 'bool_text') AS c_bt,
         count(*) FILTER (WHERE cls = 'date') AS c_date, count(*) FILTER (WHERE cls = 'text') AS c_text,
         count(*) FILTER (WHERE cls <> 'null') AS nn
  FROM cls_x GROUP BY ALL),
smp AS (
  SELECT file_id, sheet, col_ix, string_agg(raw, '|' ORDER BY row_ix) AS samples
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id, sheet, col_ix ORDER BY row_ix) AS rn
        FROM cls_x WHERE cls <> 'null')
  WHERE rn <= 3 GROUP BY ALL),
names AS (
  SELECT file_id, sheet, i - 1 AS col_ix, cells[i].raw AS name
  FROM (SELECT *, generate_subscripts(cells, 1) AS i FROM grid_v WHERE row_ix = 2))
SELECT names.file_id, CAST(names.col_ix AS INTEGER) AS col_ix, name,
  CASE WHEN coalesce(n_rows, 0) = 0 THEN 'STRING'
       WHEN coalesce(nn, 0) = 0 THEN 'DOUBLE'
       WHEN c_text > 0 THEN 'STRING'
       WHEN c_date > 0 THEN CASE WHEN c_date = nn THEN 'TIMESTAMP' ELSE 'STRING' END
       WHEN c_bt > 0 THEN CASE WHEN c_bt = nn AND n_rows = nn THEN 'BOOLEAN' ELSE 'STRING' END
       WHEN c_bool > 0 THEN CASE WHEN c_float > 0 THEN 'DOUBLE'
                                 WHEN n_rows > nn THEN 'DOUBLE'
                                 WHEN c_int > 0 THEN 'BIGINT' ELSE 'BOOLEAN' END
       WHEN c_float > 0 THEN 'DOUBLE'
       WHEN n_rows > nn THEN 'DOUBLE' ELSE 'BIGINT' END AS type,
  (coalesce(n_rows, 0) - coalesce(nn, 0) > 0) AS nullable,
  coalesce(samples, '') AS samples
FROM names LEFT JOIN n USING (file_id, sheet) LEFT JOIN cnt USING (file_id, sheet, col_ix)
LEFT JOIN smp USING (file_id, sheet, col_ix)""", "grid_v"))
def q_analyze_files(spark, sf_dir):
    """K2 over real workbooks with header row 2: name, type, nullability and
    the first three values of every column of every file."""
    from pyspark.sql import functions as F

    from gridflow.plans.jobs import analyze_files
    a = analyze_files(workbook_docs(spark, sf_dir), None, header_row=V.GRID_HEADER_ROW)
    return a["columns"].select("file_id", "col_ix", "name", "type", "nullable",
                               F.array_join("sample_values", "|").alias("samples"))


# ------------------------------------------------------------------ sync of a registry
@register("sync_all", """
WITH c AS (SELECT 'region_' || n_regionkey AS target, n_nationkey AS n, n_regionkey AS r, c_custkey, c_acctbal
           FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT target, c_custkey::BIGINT AS custkey, (CASE WHEN n % 5 = 1 THEN c_acctbal + 1 ELSE c_acctbal END)::DOUBLE AS balance
FROM c WHERE r <> (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) AND n <> 3
UNION ALL
SELECT target, c_custkey::BIGINT, c_acctbal::DOUBLE
FROM c WHERE r = (SELECT n_regionkey FROM nation WHERE n_nationkey = 7)""")
def q_sync_all(spark, sf_dir):
    """K5 over two runs. Customers of a nation stand in workbooks of at most
    20,000 rows, those of odd nations under a title row; a region's workbooks
    share one target. Before the second run nations 1, 6, ... get other
    balances, nation 3's files are deleted and nation 7's are corrupt, so its
    region's target must stay as the first run left it."""
    import uuid

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from gridflow.plans.jobs import sync_all
    from gridflow.session import land
    from gridflow.sinks.tables import drop_table
    from gridflow.sources.workbook import as_documents, encode_workbooks
    c = V.table(spark, sf_dir, "customer").join(
        V.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.col("c_acctbal").cast("double").alias("bal"), F.col("n_nationkey").alias("n"),
                 F.col("n_regionkey").alias("r"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("_"),
                                                           F.floor(F.col("c_custkey") / 20000).cast("string")).alias("file_id"))
    c = land(c, "sync-customers")
    files = c.select("file_id", "n", "r").distinct()
    tag = uuid.uuid4().hex[:8]
    target = F.concat(F.lit(f"gridflow_sync.region_{tag}_"), F.col("r").cast("string"))
    tracked = files.select(F.col("file_id").alias("connection_id"), "file_id", target.alias("target_table"),
                           (F.col("n") % 2).cast("int").alias("header_row"),
                           F.lit(None).cast("array<string>").alias("selected_columns"), F.lit(True).alias("sync_enabled"))
    tracked = land(tracked, "sync-tracked")

    def documents(balance, time):
        def cell(kind, value):
            return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("raw"))
        at = F.row_number().over(Window.partitionBy("file_id").orderBy("c_custkey")) + F.col("n") % 2
        data = c.select("file_id", at.alias("row_ix"), F.array(cell("n", F.col("c_custkey")), cell("n", balance)).alias("cells"))
        head = files.select("file_id", (F.col("n") % 2).alias("row_ix"),
                            F.array(cell("s", F.lit("custkey")), cell("s", F.lit("balance"))).alias("cells"))
        title = files.where("n % 2 = 1").select("file_id", F.lit(0).alias("row_ix"),
                                                F.array(cell("s", F.lit("Customers"))).alias("cells"))
        rows = data.unionByName(head).unionByName(title)
        rows = rows.select("file_id", F.lit(0).alias("sheet_ix"), F.lit("Sheet1").alias("sheet"),
                           F.col("row_ix").cast("int").alias("row_ix"), "cells")
        return as_documents(encode_workbooks(rows), F.lit(time).cast("timestamp_ntz"))
    first = land(documents(F.col("bal"), "2024-01-01 00:00:00"), "sync-docs")
    state = f"gridflow_sync.state_{tag}"
    sync_all(spark, tracked, first, state)
    nation = F.regexp_extract("file_id", r"^n(\d+)_", 1).cast("int")
    moved = documents(F.when(F.col("n") % 5 == 1, F.col("bal") + 1).otherwise(F.col("bal")), "2024-02-01 00:00:00")
    second = first.where(~((nation % 5 == 1) | nation.isin(3, 7))).unionByName(moved.where(nation % 5 == 1))
    second = second.unionByName(moved.where(nation == 7).withColumn("content", F.lit("no workbook").cast("binary")))
    second = second.unionByName(first.where(nation == 3).withColumn("is_deleted", F.lit(True)))
    sync_all(spark, tracked, land(second, "sync-docs"), state)
    out = None
    for (t,) in tracked.select("target_table").distinct().collect():   # one table per region
        one = spark.table(t).select(F.lit("region_" + t.rsplit("_", 1)[1]).alias("target"), "custkey", "balance")
        out = one if out is None else out.unionByName(one)
    out = land(out, "sync-result")
    for (t,) in tracked.select("target_table").distinct().collect():
        drop_table(spark, t)
    drop_table(spark, state)
    return out


from gridflow.plans import stored_queries  # noqa: E402, F401 - registers its queries

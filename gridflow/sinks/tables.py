"""Table sinks.

A table is never overwritten while it is being read: new contents are written to a folder of their own, to which the
catalog entry is then pointed (or under a staging name, where the columns change), and a failed write leaves the
old table intact.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridflow.session import delete_path, land, release

TABLE_FORMAT = "parquet"


def quote_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_name(qualified: str) -> str:
    """``a.b.c`` -> ``a`.`b`.`c`` (each part quoted)."""
    return ".".join(quote_ident(p) for p in qualified.split("."))


def _parts(name: str) -> list[str]:
    return name.split(".")


def ensure_schema(spark: SparkSession, name: str) -> None:
    """B2: create the schema (database) of ``name`` if absent; existing is fine."""
    parts = _parts(name)
    if len(parts) >= 2:
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quote_name('.'.join(parts[:-1]))}")


def ensure_table(spark: SparkSession, name: str, schema: Sequence[tuple[str, str]]) -> None:
    """B1: ``CREATE TABLE IF NOT EXISTS`` from ``[(column, sql_type)]``; every
    name is quoted, so spaces or dots in headers are safe."""
    ensure_schema(spark, name)
    cols = ", ".join(f"{quote_ident(c)} {t}" for c, t in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_name(name)} ({cols}) USING {TABLE_FORMAT}")


def drop_table(spark: SparkSession, name: str) -> None:
    """B9, with the folder that the last replacement left."""
    before = table_property(spark, name, PREVIOUS) if table_exists(spark, name) else None
    spark.sql(f"DROP TABLE IF EXISTS {quote_name(name)}")
    if before:
        delete_path(spark, before)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def rejected(raw_cells: Sequence[Column], typed: Sequence[Column]) -> Column:
    """A row is rejected when a present value did not survive its cast."""
    cond = F.lit(False)
    for r, t in zip(raw_cells, typed):
        cond = cond | (r.isNotNull() & t.isNull())
    return cond


def append_rows(df: DataFrame, name: str, reject_col: str | None = None) -> dict:
    """Append ``df`` to ``name`` by column name; rows flagged in
    ``reject_col`` are skipped and counted, not fatal. One write job; the
    counts come from an ``Observation`` on that same job (no second pass).
    Re-running appends again (explicit append mode)."""
    spark = df.sparkSession
    obs = Observation(f"append_{uuid.uuid4().hex[:8]}")
    bad = F.col(reject_col) if reject_col else F.lit(False)
    observed = df.observe(obs, F.count(F.lit(1)).alias("total_rows"),
                          F.count_if(bad).alias("rejects"))
    good = observed.filter(~bad)
    if reject_col:
        good = good.drop(reject_col)
    if table_exists(spark, name):
        target_cols = spark.table(name).columns
        good = good.select(*[F.col(quote_ident(c)) for c in target_cols])
        good.write.mode("append").insertInto(name)
    else:
        ensure_schema(spark, name)
        good.write.mode("append").format(TABLE_FORMAT).saveAsTable(name)
    m = obs.get
    total = int(m.get("total_rows", 0))
    rej = int(m.get("rejects", 0))
    return {"rows_inserted": total - rej, "total_rows": total, "rejects": rej}


# property of a replaced table: the folder of the contents before, which running queries may still read
PREVIOUS = "gridflow.previous"


def replace_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Replace contents and schema, keeping the table's own properties and comment.

    Contents of the same columns are written to a folder of their own, and the catalog entry is pointed
    there: one change, so a reader sees the old contents or the new, and a crash leaves the old. The old folder stays until the next
    replacement, for queries that run on it. A table of other columns, or a partitioned one, cannot be switched that way: it is
    written under a staging name, the old table renamed aside and the staging table into its place, and the old
    one dropped last; if the second rename fails, the old table is put back.
    """
    spark = df.sparkSession
    ensure_schema(spark, name)
    exists = table_exists(spark, name)
    if exists and not partition_by and _layout(spark.table(name)) == _layout(df):
        described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quote_name(name)}").collect()}
        location = described.get("Location")
        if location and described.get("Provider", "").lower() == TABLE_FORMAT and "# Partition Information" not in described:
            return _switch(df, name, location)
    _swap(df, name, partition_by, exists)


def _layout(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def _switch(df: DataFrame, name: str, location: str) -> None:
    spark = df.sparkSession
    folder = f"{location.rstrip('/').split('__version_')[0]}__version_{uuid.uuid4().hex[:12]}"
    df.write.parquet(folder)
    stale = table_property(spark, name, PREVIOUS)
    spark.sql(f"ALTER TABLE {quote_name(name)} SET LOCATION {_text(folder)}")
    spark.catalog.refreshTable(name)
    set_table_property(spark, name, PREVIOUS, location)
    if stale:
        delete_path(spark, stale)


def _swap(df: DataFrame, name: str, partition_by: Sequence[str], exists: bool) -> None:
    spark = df.sparkSession
    parts = _parts(name)
    tag = uuid.uuid4().hex[:8]
    staging, aside = (".".join(parts[:-1] + [f"{parts[-1]}__{kind}_{tag}"]) for kind in ("staging", "old"))
    writer = df.write.mode("overwrite").format(TABLE_FORMAT)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(staging)
    if exists:
        own = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quote_name(name)}").collect()}
        for k, v in own.items():
            if not k.startswith(RESERVED_PROPERTIES):
                spark.sql(f"ALTER TABLE {quote_name(staging)} SET TBLPROPERTIES ({_text(k)} = {_text(v)})")
        spark.sql(f"ALTER TABLE {quote_name(name)} RENAME TO {quote_name(aside)}")
    try:
        spark.sql(f"ALTER TABLE {quote_name(staging)} RENAME TO {quote_name(name)}")
    except Exception:
        if exists:
            spark.sql(f"ALTER TABLE {quote_name(aside)} RENAME TO {quote_name(name)}")
        raise
    if exists:
        spark.sql(f"DROP TABLE {quote_name(aside)}")


# Properties that the catalog itself keeps
RESERVED_PROPERTIES = ("transient_lastDdlTime", "numFiles", "totalSize", "spark.sql.")


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def set_table_property(spark: SparkSession, name: str, key: str, value: str) -> None:
    """``ALTER TABLE ... SET TBLPROPERTIES`` (keys and values without quotes)."""
    for s in (key, value):
        if "'" in s or "\\" in s:
            raise ValueError(f"quote or backslash in table property {s!r}")
    spark.sql(f"ALTER TABLE {quote_name(name)} SET TBLPROPERTIES ('{key}' = '{value}')")


def table_property(spark: SparkSession, name: str, key: str) -> str | None:
    """Read one table property (``SHOW TBLPROPERTIES``), None when unset."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {quote_name(name)}").filter(F.col("key") == key).collect()
    return rows[0]["value"] if rows else None


# ---- marks (B5) --------------------------------------------------------------
# Partitions of a mark table: hash buckets of the snapshot, and new marks, batch by batch, under DELTA
MARK_BUCKETS = 32
DELTA = -1
SNAPSHOT = "snapshot"


def mark_bucket(target: Column, file_id: Column) -> Column:
    return F.pmod(F.xxhash64(target, file_id), F.lit(MARK_BUCKETS)).cast("int")


def advance_watermark(spark: SparkSession, state_table: str, done: DataFrame) -> None:
    """Record ``(target_table, file_id, watermark)`` of successful writes.

    A mark table is a snapshot in hash buckets of the key and a delta of new marks, in one
    small partition a call; ``compact_state`` merges the delta into the buckets it touches. Readers take
    the mark recorded last per key (``current_marks``). Of a key that occurs twice in ``done`` the highest mark
    counts. Appended after the data write it records, so a crash in between only causes a harmless re-sync.
    """
    new = (done.groupBy("target_table", "file_id").agg(F.max(F.col("watermark").cast("timestamp")).alias("watermark"))
           .withColumn("synced_at", F.current_timestamp()))
    if not table_exists(spark, state_table):
        ensure_schema(spark, state_table)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {quote_name(state_table)} (target_table STRING, file_id STRING, watermark TIMESTAMP, "
                  f"synced_at TIMESTAMP, bucket INT, batch STRING) USING {TABLE_FORMAT} PARTITIONED BY (bucket, batch)")
    batch = f"{time.time_ns():020d}{uuid.uuid4().hex[:6]}"
    new.select("target_table", "file_id", "watermark", "synced_at", F.lit(DELTA).alias("bucket"), F.lit(batch).alias("batch")).write.mode(
        "append").insertInto(state_table)


def clear_watermark(spark: SparkSession, state_table: str, cleared: DataFrame) -> None:
    """Forget the marks of ``(target_table, file_id)`` rows (their file was
    deleted and its rows removed): a NULL mark is recorded, so a file restored
    later with an old modification time is synced again."""
    advance_watermark(spark, state_table,
                      cleared.select("target_table", "file_id", F.lit(None).cast("timestamp").alias("watermark")))


def read_marks(spark: SparkSession, state_table: str, keys: DataFrame | None = None) -> DataFrame | None:
    """All marks of a mark table, or those that ``keys(target_table, file_id)`` may have: the scan is
    pruned to the buckets of the keys and the delta. None if there is no such table."""
    if not table_exists(spark, state_table):
        return None
    state = spark.table(state_table)
    if keys is not None:
        buckets = [r[0] for r in keys.select(mark_bucket(F.col("target_table"), F.col("file_id"))).distinct().collect()]
        state = state.where(F.col("bucket").isin(DELTA, *buckets))
    return state


def current_marks(state: DataFrame) -> DataFrame:
    """Latest mark per ``(target_table, file_id)`` -- the one recorded last,
    which may be a cleared (NULL) mark; a partial aggregate."""
    return state.groupBy("target_table", "file_id").agg(
        F.max_by("watermark", "synced_at").alias("watermark"), F.max("synced_at").alias("synced_at"))


def compact_state(spark: SparkSession, state_table: str) -> int:
    """Merge the delta of a mark table into its snapshot: only the buckets that the delta touches
    are rewritten (dynamic partition overwrite), then the merged part of the delta is dropped. Cleared marks go.
    Returns the number of buckets rewritten. A crash in between leaves marks twice, which read the same;
    marks recorded meanwhile stay in the delta."""
    batches = [r[0].split("batch=")[1] for r in spark.sql(f"SHOW PARTITIONS {quote_name(state_table)}").where(
        F.col("partition").startswith(f"bucket={DELTA}/")).collect()]
    if not batches:
        return 0
    state = spark.table(state_table)
    delta = state.where((F.col("bucket") == DELTA) & F.col("batch").isin(batches))
    own = mark_bucket(F.col("target_table"), F.col("file_id"))
    touched = [r[0] for r in delta.select(own).distinct().collect()]
    merged = current_marks(delta.drop("bucket", "batch").unionByName(
        state.where(F.col("bucket").isin(touched)).drop("bucket", "batch")))
    merged = land(merged.where("watermark is not null").withColumn("bucket", own), "marks-merged")
    full = {r[0] for r in merged.select("bucket").distinct().collect()}
    insert_dynamic(merged.select("target_table", "file_id", "watermark", "synced_at", "bucket", F.lit(SNAPSHOT).alias("batch")), state_table)
    gone = [(b, SNAPSHOT) for b in touched if b not in full] + [(DELTA, x) for x in batches]
    for b, x in gone:
        spark.sql(f"ALTER TABLE {quote_name(state_table)} DROP IF EXISTS PARTITION (bucket = {int(b)}, batch = {_text(x)})")
    release(merged)
    return len(touched)


def insert_dynamic(df: DataFrame, name: str) -> None:
    """Overwrite the partitions of ``name`` that ``df`` has rows of, and no others."""
    spark = df.sparkSession
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        df.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(key, before)

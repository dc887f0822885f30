"""Schema contracts, discovery and table profiles.

Schemas are catalog metadata (driver-side by nature in Spark); they become
small DataFrames of ``(table_name, column_name, type)`` rows so that the set
algebra is one full outer join plus a group-by, however many tables.
Statistics are aggregates run by Spark over the tables themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridflow.functions.filters import glob_match

LEVELS = ("NONE", "SIMPLE", "DETAILED")   # no statistics (nothing is scanned), per table, per column


def actual_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, type, ordinal`` for each table's schema
    (top-level fields; types as Spark's simple strings)."""
    rows = [(t, f.name, f.dataType.simpleString(), i)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, ordinal int")


def normalise_types(spark: SparkSession, types: Iterable[str]) -> dict[str, str]:
    """DDL type text -> Spark's canonical simple string (``LONG`` -> ``bigint``).
    Unparsable text is kept, lower-cased."""
    out = {}
    for t in set(types):
        try:
            out[t] = T._parse_datatype_string(t).simpleString()
        except Exception:  # noqa: BLE001
            out[t] = t.strip().lower()
    return out


def compare_columns(expected: DataFrame, actual: DataFrame, strict: bool = False) -> DataFrame:
    """Expected against actual columns, by name, per table; one row per
    column with its status (``ok``, ``missing``, ``extra``, ``type_mismatch``).

    Types compare after normalisation through Spark's DDL parser unless
    ``strict`` (then exact text). Column names compare exactly. One full outer
    join on ``(table_name, column_name)``.
    """
    spark = expected.sparkSession
    exp = expected.select("table_name", "column_name", F.col("type").alias("exp_type"))
    if not strict:
        # distinct type texts are a vocabulary, not data: normalise them once
        m = normalise_types(spark, [r[0] for r in exp.select("exp_type").distinct().collect()])
        if m:
            mapping = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
            exp = exp.withColumn("exp_type", F.coalesce(F.element_at(mapping, F.col("exp_type")),
                                                        F.col("exp_type")))
    act = (actual.select("table_name", "column_name", F.col("type").alias("act_type"))
           .join(exp.select("table_name").distinct(), "table_name", "left_semi"))
    j = exp.join(act, ["table_name", "column_name"], "full_outer")
    status = (F.when(F.col("act_type").isNull(), F.lit("missing"))
              .when(F.col("exp_type").isNull(), F.lit("extra"))
              .when(F.col("exp_type") != F.col("act_type"), F.lit("type_mismatch"))
              .otherwise(F.lit("ok")))
    return j.select("table_name", "column_name", F.col("exp_type").alias("expected"),
                    F.col("act_type").alias("actual"), status.alias("status"))


def validate_schema(expected: DataFrame, actual: DataFrame, strict: bool = False) -> DataFrame:
    """G1: per table ``valid, missing_columns, extra_columns, type_mismatches``.

    ``missing`` = expected - actual, ``extra`` = actual - expected (allowed),
    mismatches on the intersection; ``valid`` = nothing missing and no mismatch.
    Lists are per table, so bounded by its number of columns.
    """
    c = compare_columns(expected, actual, strict)

    def names(st: str):
        return F.sort_array(F.collect_list(F.when(F.col("status") == st, F.col("column_name"))))

    g = c.groupBy("table_name").agg(
        names("missing").alias("missing_columns"), names("extra").alias("extra_columns"),
        F.sort_array(F.collect_list(F.when(F.col("status") == "type_mismatch", F.struct(
            F.col("column_name").alias("column"), "expected", "actual")))).alias("type_mismatches"))
    return g.select("table_name",
                    ((F.size("missing_columns") == 0) & (F.size("type_mismatches") == 0)).alias("valid"),
                    "missing_columns", "extra_columns", "type_mismatches")


def validate_tables(spark: SparkSession, expected: DataFrame,
                    tables: Mapping[str, DataFrame] | None = None, strict: bool = False) -> DataFrame:
    """K8: contracts of many tables; ``tables`` default to catalog tables named
    in ``expected``. A table that does not exist has every column missing."""
    if tables is None:
        names = [r[0] for r in expected.select("table_name").distinct().collect()]
        tables = {n: spark.table(n) for n in names if spark.catalog.tableExists(n)}
    return validate_schema(expected, actual_columns(spark, tables), strict)


def _file_stats(name: str, df: DataFrame) -> DataFrame | None:
    try:
        return (df.select(F.lit(name).alias("table_name"),
                          F.col("_metadata.file_path").alias("p"),
                          F.col("_metadata.file_size").alias("s"),
                          F.col("_metadata.file_modification_time").alias("m"))
                .distinct())
    except Exception:  # noqa: BLE001 - not file based: statistics stay NULL
        return None


def profile_tables(spark: SparkSession, tables: Mapping[str, DataFrame],
                   level: str = "SIMPLE", distinct: str = "approx") -> DataFrame:
    """E9 (and E10 when ``level='DETAILED'``).

    NONE: the names only, no table is read.
    SIMPLE: ``table_name, n_rows, size_in_bytes, last_modified`` -- counts are
    one union of per-table aggregates; bytes and modification time come from
    the ``_metadata`` of distinct files (NULL when the table is not file based).
    DETAILED: long-form column statistics (see ``column_stats``).
    """
    level = level.upper()
    if level not in LEVELS:
        raise ValueError(f"unknown statistics level {level}; one of {', '.join(LEVELS)}")
    if level == "NONE":
        return spark.createDataFrame([(n,) for n in tables], "table_name string")
    if level == "DETAILED":
        return column_stats(spark, tables, distinct)
    counts = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = c if counts is None else counts.unionByName(c)
    files = None
    for name, df in tables.items():
        f = _file_stats(name, df)
        if f is not None:
            files = f if files is None else files.unionByName(f)
    if counts is None:
        return spark.createDataFrame([], "table_name string, n_rows bigint, size_in_bytes bigint, "
                                         "last_modified timestamp")
    if files is None:
        return counts.select("table_name", "n_rows", F.lit(None).cast("bigint").alias("size_in_bytes"),
                             F.lit(None).cast("timestamp").alias("last_modified"))
    fs = files.groupBy("table_name").agg(F.sum("s").alias("size_in_bytes"), F.max("m").alias("last_modified"))
    return counts.join(fs, "table_name", "left")


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_ORDERED = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def column_stats(spark: SparkSession, tables: Mapping[str, DataFrame], distinct: str = "none") -> DataFrame:
    """Per column ``n_rows, n_nulls, min_num, max_num, min_text, max_text``
    (numbers as double, everything else ordered as text) and, when asked,
    ``n_distinct`` (``approx``: HyperLogLog++, mergeable across partitions;
    ``exact``: count distinct). One aggregate per table; complex columns
    (arrays, maps, structs) are skipped. Exact counts are an aggregate per
    column over that column alone: several in one would send each row through
    it once a column, with all its other columns."""
    out = counted = None
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if isinstance(f.dataType, _NUMERIC + _ORDERED)]
        if not fields:
            continue
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            aggs.append(F.count_if(c.isNull()).alias(f"_n{i}"))
            if isinstance(f.dataType, _NUMERIC):
                aggs += [F.min(c).cast("double").alias(f"_a{i}"), F.max(c).cast("double").alias(f"_b{i}")]
            else:
                aggs += [F.min(c).cast("string").alias(f"_a{i}"), F.max(c).cast("string").alias(f"_b{i}")]
            if distinct == "approx":
                aggs.append(F.approx_count_distinct(c).alias(f"_d{i}"))
            elif distinct == "exact":
                one = df.select(c.alias("_v")).distinct().agg(F.count("_v").alias("n_distinct")).select(
                    F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), "n_distinct")
                counted = one if counted is None else counted.unionByName(one)
        a = df.agg(*aggs)
        structs = []
        for i, f in enumerate(fields):
            num = isinstance(f.dataType, _NUMERIC)
            parts = [F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"),
                     F.col("_rows").alias("n_rows"), F.col(f"_n{i}").alias("n_nulls"),
                     (F.col(f"_a{i}") if num else F.lit(None).cast("double")).alias("min_num"),
                     (F.col(f"_b{i}") if num else F.lit(None).cast("double")).alias("max_num"),
                     (F.lit(None).cast("string") if num else F.col(f"_a{i}")).alias("min_text"),
                     (F.lit(None).cast("string") if num else F.col(f"_b{i}")).alias("max_text")]
            if distinct == "approx":
                parts.append(F.col(f"_d{i}").alias("n_distinct"))
            structs.append(F.struct(*parts))
        rows = a.select(F.inline(F.array(*structs)))
        out = rows if out is None else out.unionByName(rows)
    return out if counted is None else out.join(counted, ["table_name", "column_name"])


def described_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``actual_columns`` with each column's ``nullable`` flag and ``comment``."""
    rows = [(t, f.name, f.dataType.simpleString(), i, f.nullable, (f.metadata or {}).get("comment"))
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, ordinal int, "
                                       "nullable boolean, comment string")


def discover_tables(spark: SparkSession, schema: str | None = None,
                    patterns: Iterable[str] | str | None = None, level: str = "SIMPLE") -> dict:
    """K7: tables of a schema filtered by glob patterns, with their type,
    statistics of the asked level and the column list of each (as rows)."""
    if level.upper() not in LEVELS:
        raise ValueError(f"unknown statistics level {level}; one of {', '.join(LEVELS)}")
    listed = spark.catalog.listTables(schema) if schema else spark.catalog.listTables()
    base = spark.createDataFrame([(f"{schema}.{t.name}" if schema else t.name, t.name, t.tableType) for t in listed],
                                 "qualified string, short string, table_type string")
    if patterns:
        base = base.filter(glob_match(F.col("short"), patterns))
    base = base.select(F.col("qualified").alias("table_name"), "table_type")
    tables = {r["table_name"]: spark.table(r["table_name"]) for r in base.collect()}   # catalog names, no rows
    found = base
    if tables and level.upper() != "NONE":
        found = base.join(profile_tables(spark, tables, level), "table_name")
    return {"tables": found, "columns": described_columns(spark, tables)}

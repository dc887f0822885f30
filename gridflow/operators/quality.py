"""Data-quality checks (E5-E8, G2). Each report is one aggregate pass over the
table (partial aggregation, no shuffle of rows), then a handful of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the quality checks
CHECK_ROW_COUNT = "row_count"
CHECK_REQUIRED = "required_columns"
CHECK_NULLS = "null_values"
CHECK_OWNER = "supplier_consistency"
DEFAULT_REQUIRED = ("Date", "SKU", "Qty", "supplier_id")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """E5: ``column_name, null_count`` for every column, from one aggregate."""
    cols = list(cols or df.columns)
    agg = df.agg(*[F.count_if(_q(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
        for i, c in enumerate(cols)])))


def single_value_check(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of an owner column; consistent means exactly one."""
    return (df.agg(F.count_distinct(_q(col)).alias("n_distinct"))
            .select(F.lit(CHECK_OWNER).alias("check"), "n_distinct",
                    (F.col("n_distinct") == 1).alias("passed")))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from the table (schema only, no job)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def quality_report(df: DataFrame, required: Sequence[str] = DEFAULT_REQUIRED,
                   owner_col: str | None = "supplier_id") -> DataFrame:
    """One row per check: ``check, value, passed``.

    row_count passes when > 0; required_columns when none is missing;
    null_values lists ``name=count`` for every column (sorted by name) and
    passes when no present required column has a NULL; the owner check passes
    at exactly one distinct value. Everything comes from a single aggregate.
    """
    cols = sorted(df.columns)
    missing = missing_columns(df, required)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(_q(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)]
    has_owner = owner_col is not None and owner_col in df.columns
    if has_owner:
        aggs.append(F.count_distinct(_q(owner_col)).alias("_owners"))
    a = df.agg(*aggs)
    null_text = F.concat_ws(",", *[F.concat(F.lit(f"{c}="), F.col(f"_n{i}").cast("string"))
                                   for i, c in enumerate(cols)])
    req_present = [i for i, c in enumerate(cols) if c in set(required)]
    nulls_ok = F.lit(True)
    for i in req_present:
        nulls_ok = nulls_ok & (F.col(f"_n{i}") == 0)
    checks = [
        F.struct(F.lit(CHECK_ROW_COUNT).alias("check"), F.col("_rows").cast("string").alias("value"),
                 (F.col("_rows") > 0).alias("passed")),
        F.struct(F.lit(CHECK_REQUIRED).alias("check"), F.lit(",".join(missing)).alias("value"),
                 F.lit(not missing).alias("passed")),
        F.struct(F.lit(CHECK_NULLS).alias("check"), null_text.alias("value"), nulls_ok.alias("passed")),
    ]
    if has_owner:
        checks.append(F.struct(F.lit(CHECK_OWNER).alias("check"),
                               F.col("_owners").cast("string").alias("value"),
                               (F.col("_owners") == 1).alias("passed")))
    return a.select(F.inline(F.array(*checks)))


def quality_summary(report: DataFrame) -> DataFrame:
    """E7 roll-up: ``status, checks_passed, total_checks`` (all must pass)."""
    return report.agg(
        F.bool_and("passed").alias("checks_passed"),
        F.count(F.lit(1)).alias("total_checks"),
    ).select(F.lit("success").alias("status"), "checks_passed", "total_checks")


def summarise_runs(run_log: DataFrame, status_col: str = "status",
                   detail_col: str | None = "reason") -> DataFrame:
    """Items per outcome (and per reason). Item lists are the run log
    itself filtered by status; they are not gathered into one row."""
    keys = [status_col] + ([detail_col] if detail_col else [])
    return run_log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))

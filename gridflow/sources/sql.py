"""SQL text and table reads."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def run_sql(spark: SparkSession, text: str, inputs: dict[str, DataFrame] | None = None,
            args: dict[str, Any] | None = None, catalog: str | None = None,
            schema: str | None = None) -> DataFrame:
    """SQL over named inputs with bound parameters.

    ``inputs`` are DataFrames referenced as ``{name}`` in the text; ``args``
    are bound as named parameters (``:name``), so no value is ever quoted into
    the text. ``catalog``/``schema`` hold for this statement only. The result
    is a lazy, typed DataFrame (Catalyst parses, analyses and optimises it).
    """
    before = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
    try:
        if catalog:
            spark.catalog.setCurrentCatalog(catalog)
        if schema:
            spark.catalog.setCurrentDatabase(schema)
        return spark.sql(text, args=args or None, **(inputs or {}))   # names are resolved here
    finally:
        if catalog or schema:
            spark.catalog.setCurrentCatalog(before[0])
            spark.catalog.setCurrentDatabase(before[1])


def read_table(spark: SparkSession, name: str) -> tuple[DataFrame | None, str | None]:
    """A table by qualified name. Returns ``(df, None)``, or ``(None, message)``
    when the table does not exist."""
    try:
        if not spark.catalog.tableExists(name):
            return None, f"Table not found: {name}"
        return spark.table(name), None
    except AnalysisException as e:
        return None, f"Table not found: {name} ({e.getMessage() if hasattr(e, 'getMessage') else e})"

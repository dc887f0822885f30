"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space (contracts of the queries).
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_side(df: DataFrame, row_bytes: int | F.Column, limit_bytes: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows, of ``row_bytes`` each (a column where
    rows differ in size), fit ``limit_bytes``; otherwise unmarked, so that Spark
    shuffles both sides of the join.

    Pass a landed (or cheap to recount) frame: the sum is one small job.
    """
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit_bytes else df


def words_expr(text) -> F.Column:
    """array<string> of the words of ``text`` (null: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS + "+"), "")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of an Arrow string column, row by row (null: empty)."""
    for v in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield v.as_py() or b""

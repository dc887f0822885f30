"""Cell classification, type decision (H7), casting and header names (H8).

A grid cell is ``struct<kind string, raw string>`` with kind one of
``n`` (number), ``s`` (text), ``b`` (boolean, raw ``true``/``false``),
``d`` (date-time, raw ``yyyy-MM-dd HH:mm:ss[.ffffff]``), ``e`` (error text)
and ``null`` (empty).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (public pandas behaviour): text read as a missing value
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                  "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                  "nan", "null")
# Fixed values (public pandas behaviour): text read as booleans
TRUE_TEXT = ("True", "TRUE", "true")
FALSE_TEXT = ("False", "FALSE", "false")

INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Inf|INF|infinity|Infinity|INFINITY)$"
DATE_TEXT = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
INT64_LIMIT = 9.223372036854775e18

CLASSES = ("null", "int", "float", "bool", "bool_text", "date", "text")
KINDS = ("n", "s", "b", "d", "e")


def _integral(num: Column) -> Column:
    return (num == F.floor(num)) & (F.abs(num) < F.lit(INT64_LIMIT))


# Casts run only on values shaped like their target (number cells, or text
# matching a number pattern): a failing try_cast takes Spark's exception path,
# which costs far more than the pattern test.
def _number_cell(kind: Column, raw: Column) -> Column:
    return F.when(kind == "n", raw.try_cast("double"))


def cell_class(kind: Column, raw: Column) -> Column:
    """Class of one cell for pandas-compatible inference."""
    t = F.trim(raw)
    return (F.when((kind == "null") | raw.isNull(), F.lit("null"))
            .when(kind.isin("s", "e") & raw.isin(*MISSING_TOKENS), F.lit("null"))
            .when(kind == "n", F.when(_integral(_number_cell(kind, raw)), F.lit("int"))
                  .otherwise(F.lit("float")))
            .when(kind == "b", F.lit("bool"))
            .when(kind == "d", F.lit("date"))
            .when(t.rlike(INT_TEXT),
                  F.when(t.try_cast("bigint").isNotNull(), F.lit("int")).otherwise(F.lit("text")))
            .when(t.rlike(FLOAT_TEXT), F.lit("float"))
            .when(t.isin(*TRUE_TEXT, *FALSE_TEXT), F.lit("bool_text"))
            .otherwise(F.lit("text")))


def typed_kind(kind: Column, raw: Column) -> Column:
    """Class for ``infer='typed'``: the workbook's own cell kind; numbers split
    into int/float by value; text never becomes a number."""
    return (F.when((kind == "null") | raw.isNull(), F.lit("null"))
            .when(kind == "n", F.when(_integral(_number_cell(kind, raw)), F.lit("int"))
                  .otherwise(F.lit("float")))
            .when(kind == "b", F.lit("bool"))
            .when(kind == "d", F.lit("date"))
            .otherwise(F.lit("text")))


def cell_present(cell: Column) -> Column:
    """Not an empty cell and not a missing-value token."""
    kind, raw = cell.kind, cell.raw
    return ~(cell.isNull() | (kind == "null") | raw.isNull() |
             (kind.isin("s", "e") & raw.isin(*MISSING_TOKENS)))


def class_counts(cls: Column) -> list[Column]:
    """Aggregates counting each non-null class (partial-aggregation friendly)."""
    return [F.count_if(cls == c).alias(f"c_{c}") for c in CLASSES if c != "null"]


def decide_type(n_rows: Column, c: dict[str, Column], infer: str = "compat") -> Column:
    """H7: SQL type name of a column from its row count and class counts.

    ``c`` maps class -> count column. Nulls are ``n_rows`` minus non-null cells
    (short rows have no cell at all for trailing columns).
    """
    non_null = sum((c[k] for k in CLASSES if k != "null"), F.lit(0))
    nulls = n_rows - non_null
    if infer == "typed":
        return (F.when(non_null == 0, F.lit("STRING"))
                .when(c["text"] + c["bool_text"] > 0, F.lit("STRING"))
                .when(c["date"] == non_null, F.lit("TIMESTAMP"))
                .when(c["bool"] == non_null, F.lit("BOOLEAN"))
                .when(c["int"] == non_null, F.lit("BIGINT"))
                .when(c["int"] + c["float"] == non_null, F.lit("DOUBLE"))
                .otherwise(F.lit("STRING")))
    return (F.when(n_rows == 0, F.lit("STRING"))
            .when(non_null == 0, F.lit("DOUBLE"))
            .when(c["text"] > 0, F.lit("STRING"))
            .when(c["date"] > 0, F.when(c["date"] == non_null, F.lit("TIMESTAMP"))
                  .otherwise(F.lit("STRING")))
            .when(c["bool_text"] > 0,
                  F.when((c["bool_text"] == non_null) & (nulls == 0), F.lit("BOOLEAN"))
                  .otherwise(F.lit("STRING")))
            .when(c["bool"] > 0,
                  F.when(c["float"] > 0, F.lit("DOUBLE"))
                  .when(c["int"] > 0, F.when(nulls > 0, F.lit("DOUBLE")).otherwise(F.lit("BIGINT")))
                  .otherwise(F.when(nulls > 0, F.lit("DOUBLE")).otherwise(F.lit("BOOLEAN"))))
            .when(c["float"] > 0, F.lit("DOUBLE"))
            .otherwise(F.when(nulls > 0, F.lit("DOUBLE")).otherwise(F.lit("BIGINT"))))


def widen(types: list[str]) -> str:
    """Common type of one column inferred separately on several files."""
    s = set(types)
    if len(s) == 1:
        return types[0]
    if s <= {"BIGINT", "DOUBLE"}:
        return "DOUBLE"
    return "STRING"


def display(cell: Column) -> Column:
    """H5: text of a cell; empty cells are NULL."""
    return F.when(cell.isNull() | (cell.kind == "null"), F.lit(None).cast("string")).otherwise(cell.raw)


def cast_cell(cell: Column, sql_type: str) -> Column:
    """A cell as the given SQL type; unconvertible values become NULL.

    Booleans count as 1/0 in numeric columns; date cells carry ISO text.
    """
    kind, raw = cell.kind, cell.raw
    t = F.trim(raw)
    typ = sql_type.strip().upper()
    as_bool = F.when(raw == "true", F.lit(True)).when(raw == "false", F.lit(False))
    numeric_like = (kind == "n") | t.rlike(FLOAT_TEXT)
    as_double = F.when(numeric_like, t.try_cast("double"))
    if typ in ("BIGINT", "LONG", "INT", "INTEGER", "SMALLINT", "TINYINT"):
        exact = F.when(t.rlike(INT_TEXT), t.try_cast("bigint"))
        via_d = F.when(_integral(as_double), as_double.cast("bigint"))
        v = F.when(kind == "b", as_bool.cast("bigint")).otherwise(F.coalesce(exact, via_d))
        target = "bigint" if typ in ("BIGINT", "LONG") else typ.lower()
        v = v.try_cast(target) if target != "bigint" else v
    elif typ in ("DOUBLE", "FLOAT", "REAL"):
        v = F.when(kind == "b", as_bool.cast("double")).otherwise(as_double)
        if typ != "DOUBLE":
            v = v.cast("float")
    elif typ == "BOOLEAN":
        low = F.lower(t)
        v = (F.when(kind == "b", as_bool)
             .when(kind == "n", as_double != 0)
             .when(low == "true", F.lit(True)).when(low == "false", F.lit(False)))
    elif typ in ("TIMESTAMP", "TIMESTAMP_LTZ", "TIMESTAMP_NTZ", "DATE"):
        target = {"TIMESTAMP_LTZ": "timestamp"}.get(typ, typ.lower())
        v = F.when((kind != "n") & t.rlike(DATE_TEXT), t.try_cast(target))
    elif typ == "STRING":
        v = raw
    else:
        v = F.when(kind == "b", as_bool.try_cast(sql_type)).otherwise(t.try_cast(sql_type))
    return F.when(~cell_present(cell), F.lit(None)).otherwise(v)


# ------------------------------------------------------------------ headers
def unique_names(texts: list[str | None]) -> list[str]:
    """H8: header texts -> unique column names.

    A text keeps its name where it first stands; blanks are called
    ``Unnamed: i`` after all others have been named. A later column of the
    same name gets the lowest free number behind it, ``X.1`` and up, passing
    over every name that stands in the header itself.
    """
    blank = [t is None or t == "" for t in texts]
    wanted = [f"Unnamed: {i}" if b else str(t) for i, (t, b) in enumerate(zip(texts, blank))]
    standing, names, number = set(wanted), {}, {}
    for i in sorted(range(len(texts)), key=lambda i: (blank[i], i)):
        name = wanted[i]
        if name in number:
            k = number[name]
            while f"{name}.{k}" in standing:
                k += 1
            number[name] = k + 1
            name = f"{name}.{k}"
            standing.add(name)
        number.setdefault(name, 1)
        names[i] = name
    return [names[i] for i in range(len(texts))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def header_names_udf(texts: pd.Series, width: pd.Series) -> pd.Series:
    """Header row texts (padded to the sheet width) -> unique names.
    Runs on header rows only: one row per sheet."""
    res = []
    for arr, w in zip(texts, width):
        vals = [] if arr is None else list(arr)
        w = int(w) if w is not None and not pd.isna(w) else len(vals)
        vals = vals + [None] * max(0, w - len(vals))
        res.append(unique_names(vals))
    return pd.Series(res)

"""Operators on decoded grids.

Input is a ``rows`` DataFrame: ``file_id, sheet_ix, sheet, row_ix,
cells array<struct<kind, raw>>``, one record per sheet row (never per cell),
so header promotion and casting are narrow projections of ``cells[i]``. Only
inference explodes cells, and it aggregates them at once with partial
(map-side) aggregation, so a very large workbook costs one row per column per
map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridflow.functions.cells import (CLASSES, MISSING_TOKENS, cast_cell, cell_class, cell_present, class_counts,
                                      decide_type, display, header_names_udf, typed_kind)

KEYS = ["file_id", "sheet"]


def sheet_rows(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows of the named sheet, or of each file's first sheet (the default)."""
    if sheet is None:
        return rows.filter(F.col("sheet_ix") == 0)
    return rows.filter(F.col("sheet") == sheet)


def _texts(cells: Column) -> Column:
    return F.transform(cells, lambda c: display(c))


def sheet_stats(rows: DataFrame, header_row: int = 0, sheet: str | None = None) -> DataFrame:
    """One aggregate per sheet: ``width`` (widest row from the header down)
    and ``n_rows`` (data rows below the header)."""
    r = sheet_rows(rows, sheet).filter(F.col("row_ix") >= header_row)
    return r.groupBy(*KEYS).agg(F.max(F.size("cells")).alias("width"),
                                F.count_if(F.col("row_ix") > header_row).alias("n_rows"))


def header_names(rows: DataFrame, header_row: int = 0, sheet: str | None = None,
                 stats: DataFrame | None = None) -> DataFrame:
    """H8: ``file_id, sheet, names`` -- unique names for every column of the
    sheet, from the header row's texts (one Python call per sheet, on header
    rows only)."""
    width = (stats if stats is not None else sheet_stats(rows, header_row, sheet)).select(*KEYS, "width")
    head = (sheet_rows(rows, sheet).filter(F.col("row_ix") == header_row)
            .select(*KEYS, _texts(F.col("cells")).alias("texts")))
    j = width.join(head, on=KEYS, how="left")
    return j.select(*KEYS, header_names_udf(
        F.coalesce(F.col("texts"), F.array().cast("array<string>")), F.col("width")).alias("names"))


def _data(rows: DataFrame, header_row: int, sheet: str | None) -> DataFrame:
    return sheet_rows(rows, sheet).filter(F.col("row_ix") > header_row)


def sheet_shape(rows: DataFrame, header_row: int = 0, sheet: str | None = None) -> DataFrame:
    """Data rows (after the header) and columns per sheet."""
    return sheet_stats(rows, header_row, sheet).select(
        *KEYS, F.col("n_rows").cast("bigint").alias("row_count"),
        F.coalesce("width", F.lit(0)).cast("int").alias("column_count"))


def column_counts(rows: DataFrame, header_row: int = 0, sheet: str | None = None,
                  infer: str = "compat") -> DataFrame:
    """Per file and column: ``file_id, sheet, col_ix, name, n_rows`` and the
    class counts ``c_*`` that types are decided on.

    One pass over the data rows: each row contributes a marker cell at
    ``col_ix = -1`` (so the same partial aggregate counts rows) plus its
    classified cells; a sheet's counts then travel with its names, so no
    second pass finds its width. Header rows are read separately (a pushed-down
    ``row_ix`` filter).
    """
    data = _data(rows, header_row, sheet)
    classify = typed_kind if infer == "typed" else cell_class
    marker = F.struct(F.lit("_row").alias("kind"), F.lit(None).cast("string").alias("raw"))
    cells = (data.select(*KEYS, F.posexplode(F.concat(F.array(marker), F.col("cells"))).alias("_p", "cell"))
             .select(*KEYS, (F.col("_p") - 1).alias("col_ix"),
                     classify(F.col("cell.kind"), F.col("cell.raw")).alias("cls")))
    # per file: class counts per column, plus the row count at col_ix -1
    per_file = cells.groupBy(*KEYS, "col_ix").agg(F.count(F.lit(1)).alias("_n"),
                                                  *class_counts(F.col("cls")))
    # a row a sheet: its columns stand from -1 to the widest row's without a gap, so a place in the list is a column
    sheets = per_file.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("col_ix", "_n", *COUNT_COLUMNS))).alias("_cols"))
    head = (sheet_rows(rows, sheet).filter(F.col("row_ix") == header_row)
            .select(*KEYS, _texts(F.col("cells")).alias("texts")))
    files = sheets.join(head, on=KEYS, how="full_outer")
    width = F.greatest(F.coalesce(F.size("_cols") - 1, F.lit(0)), F.coalesce(F.size("texts"), F.lit(0)))
    names = (files.select(*KEYS, F.coalesce(F.get(F.col("_cols"), 0)["_n"], F.lit(0)).alias("n_rows"), "_cols",
                          header_names_udf(F.coalesce(F.col("texts"), F.array().cast("array<string>")),
                                           width).alias("names"))
             .select(*KEYS, "n_rows", "_cols", F.posexplode_outer("names").alias("col_ix", "name"))
             .filter(F.col("col_ix").isNotNull()))
    mine = F.get(F.col("_cols"), F.col("col_ix") + 1)
    return names.select(*KEYS, "col_ix", "n_rows", "name", *[F.coalesce(mine[c], F.lit(0)).alias(c) for c in COUNT_COLUMNS])


COUNT_COLUMNS = [f"c_{k}" for k in CLASSES if k != "null"]


def summed_type(infer: str = "compat") -> dict[str, Column]:
    """``type``, ``nullable`` and ``filled`` (any value at all) over ``n_rows`` and ``c_*``."""
    c = {k: F.coalesce(F.col(f"c_{k}"), F.lit(0)) for k in CLASSES if k != "null"}
    n = F.coalesce(F.col("n_rows"), F.lit(0))
    non_null = sum(c.values(), F.lit(0))
    return {"type": decide_type(n, c, infer), "nullable": n - non_null > 0, "filled": non_null > 0}


def infer_columns(rows: DataFrame, header_row: int = 0, sheet: str | None = None,
                  infer: str = "compat", by_file: bool = True) -> DataFrame:
    """``[file_id, sheet,] col_ix, name, type, nullable`` per column.

    The decision table (SURVEY 2.12) runs on ``column_counts``.
    ``by_file=False`` infers one type per column over all given files and adds
    ``filled`` (the column has a value) and ``consistent``: every file has this
    column under the same name.
    """
    j = column_counts(rows, header_row, sheet, infer)
    if not by_file:
        return over_files(j, infer)
    kind = summed_type(infer)
    return j.select(*KEYS, F.col("col_ix").cast("int").alias("col_ix"), "name", kind["type"].alias("type"),
                    kind["nullable"].alias("nullable"))


def over_files(counts: DataFrame, infer: str = "compat") -> DataFrame:
    """``infer_columns(by_file=False)`` of ``column_counts``: summed over files; the layout check compares names and file
    counts per column."""
    kind = summed_type(infer)
    j = counts.groupBy("col_ix").agg(F.min("name").alias("name"), F.max("name").alias("_name_max"),
                                     F.count(F.lit(1)).alias("_files"), F.sum("n_rows").alias("n_rows"),
                                     *[F.sum(c).alias(c) for c in COUNT_COLUMNS])
    # a window without partitioning, but over one row per column (already
    # aggregated), so it never holds data rows
    consistent = ((F.col("name") == F.col("_name_max")) & (F.col("_files") == F.max("_files").over(Window.partitionBy())))
    return j.select(F.col("col_ix").cast("int").alias("col_ix"), "name",
                    *[e.alias(k) for k, e in kind.items()], consistent.alias("consistent"))


def _first_values(k: int):
    """Batches of rows -> the first ``k`` present cells (``cell_present``) of every column in each batch."""
    tokens = pa.array(MISSING_TOKENS)

    def run(batches):
        for b in batches:
            cells = b.column("cells")
            lens = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = cells.flatten()
            kind, raw = flat.field("kind"), flat.field("raw")
            # a cell without kind or text is none; flat.field() has no nulls of the struct itself
            missing = pc.and_(pc.is_in(kind, pa.array(["s", "e"])), pc.is_in(raw, tokens))
            there = pc.and_(pc.and_(flat.is_valid(), raw.is_valid()), pc.and_not(pc.fill_null(pc.not_equal(kind, "null"), False), missing))
            at = np.flatnonzero(there.to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(lens)), lens)[at]
            col = (np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens))[at]
            file, tab = (b.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)[row] for c in KEYS)
            order = np.lexsort((b.column("row_ix").to_numpy(zero_copy_only=False)[row], col, tab, file))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(file[order]) != 0) | (np.diff(tab[order]) != 0) | (np.diff(col[order]) != 0)
            starts = np.flatnonzero(new)
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            best = order[rank < k]
            rows = pa.array(row[best])
            yield pa.RecordBatch.from_arrays(
                [b.column("file_id").take(rows), b.column("sheet").take(rows), b.column("row_ix").take(rows),
                 pa.array(col[best], pa.int32()), raw.take(pa.array(at[best]))], ["file_id", "sheet", "row_ix", "col_ix", "value"])
    return run


def column_samples(rows: DataFrame, header_row: int = 0, sheet: str | None = None,
                   k: int = 3) -> DataFrame:
    """First ``k`` non-null values of each column in sheet order, as text.

    Each batch of rows first keeps the ``k`` of its own (``_first_values``), so of a column at most ``k``
    cells a batch are sorted and shuffled, not all of them; ``row_number() <= k`` then decides.
    """
    data = _data(rows, header_row, sheet).select(*KEYS, "row_ix", "cells")
    cells = data.mapInArrow(_first_values(k), "file_id string, sheet string, row_ix int, col_ix int, value string")
    w = Window.partitionBy(*KEYS, "col_ix").orderBy("row_ix")
    top = cells.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return (top.groupBy(*KEYS, "col_ix")
            .agg(F.sort_array(F.collect_list(F.struct("row_ix", "value"))).alias("_s"))
            .select(*KEYS, F.col("col_ix").cast("int").alias("col_ix"),
                    F.transform("_s", lambda x: x["value"]).alias("sample_values")))


def analyze_columns(rows: DataFrame, header_row: int = 0, sheet: str | None = None,
                    infer: str = "compat") -> DataFrame:
    """K2 core: name, type, nullable and sample values per column."""
    cols = infer_columns(rows, header_row, sheet, infer)
    samples = column_samples(rows, header_row, sheet)
    return (cols.join(samples, on=[*KEYS, "col_ix"], how="left")
            .withColumn("sample_values",
                        F.coalesce("sample_values", F.array().cast("array<string>"))))


def preview(rows: DataFrame, max_rows: int = 100, sheet: str | None = None) -> DataFrame:
    """the first ``max_rows`` grid rows of each file's sheet, raw (no
    header assumed); per file, so no global limit or sort is involved."""
    r = sheet_rows(rows, sheet).filter(F.col("row_ix") < max_rows)
    return r.select(*KEYS, "row_ix", _texts(F.col("cells")).alias("values"))


def layout_names(rows: DataFrame, header_row: int = 0, sheet: str | None = None) -> list[list[str]]:
    """Distinct header layouts among the given files (tiny: one per layout)."""
    got = header_names(rows, header_row, sheet).select("names").distinct().collect()
    return [list(r["names"]) for r in got]


def promote_header(rows: DataFrame, names: Sequence[str], header_row: int = 0,
                   sheet: str | None = None) -> DataFrame:
    """Data rows (below ``header_row``) with one cell column per name:
    ``file_id, sheet, row_ix, <name> struct<kind, raw> ...``. Rows above the
    header are dropped; blank rows in between stay as all-null rows."""
    data = _data(rows, header_row, sheet)
    return data.select(*KEYS, "row_ix",
                       *[F.get(F.col("cells"), i).alias(n) for i, n in enumerate(names)])


def select_columns(df: DataFrame, names: Sequence[str] | None, mode: str = "strict",
                   keys: Sequence[str] = ("file_id", "sheet", "row_ix")) -> DataFrame:
    """Keep requested columns that exist, in request order.

    ``strict``: none found -> ``ValueError``. ``lenient``: none found -> all.
    """
    if not names:
        return df
    avail = [n for n in names if n in df.columns and n not in keys]
    if not avail:
        if mode == "strict":
            raise ValueError(f"no selected column is in the sheet: {list(names)}")
        return df
    return df.select(*[k for k in keys if k in df.columns], *[F.col(f"`{n}`") for n in avail])


def apply_schema(df: DataFrame, schema: Sequence[tuple[str, str]] | dict[str, str],
                 keys: Sequence[str] = ("file_id", "sheet", "row_ix")) -> DataFrame:
    """Cast each cell column to its SQL type (``try_cast``: bad values
    become NULL rather than failing the task). Columns not in the schema are
    dropped; keys are kept."""
    items = list(schema.items()) if isinstance(schema, dict) else list(schema)
    return df.select(*[k for k in keys if k in df.columns],
                     *[cast_cell(F.col(f"`{n}`"), t).alias(n) for n, t in items])


def typed_cells(data: DataFrame, cells: Sequence[Column], schema: Sequence[tuple[str, str]],
                keys: Sequence[str] = ()) -> DataFrame:
    """C13 with the count of rejects: the ``cells`` of ``data`` under the names and types of ``schema``, and ``_rejected``: a
    present value did not survive its cast. Keys are kept.

    Cell, cast and flag are projections of their own. In one, each cast stands there again for the flag and takes its
    cell apart anew at every use, which makes the generated code too long to be compiled."""
    kept, every = [F.col(k) for k in keys if k in data.columns], range(len(schema))
    one = data.select(*kept, *[c.alias(f"_c{i}") for i, c in enumerate(cells)])
    cast = one.select(*kept, *[cast_cell(F.col(f"_c{i}"), t).alias(f"_t{i}") for i, (_, t) in enumerate(schema)],
                      *[F.coalesce(cell_present(F.col(f"_c{i}")), F.lit(False)).alias(f"_p{i}") for i in every])
    flag = F.lit(False)
    for i in every:
        flag = flag | (F.col(f"_p{i}") & F.col(f"_t{i}").isNull())
    return cast.select(*kept, *[F.col(f"_t{i}").alias(n) for i, (n, _) in enumerate(schema)], flag.alias("_rejected"))


def as_text(df: DataFrame, keys: Sequence[str] = ("file_id", "sheet", "row_ix")) -> DataFrame:
    """Cell columns -> display text columns."""
    return df.select(*[F.col(c) if c in keys else display(F.col(f"`{c}`")).alias(c)
                       for c in df.columns])


def attach_fixed_cell(rows: DataFrame, data: DataFrame, row: int = 0, col: int = 1,
                      name: str = "supplier_id") -> DataFrame:
    """H9: the text of one fixed cell of each file (for example the owner id
    in row 0, column 1) attached to every data row of that file. The fixed
    cells are one row per file, so a partition's share of them is hashed: the
    data rows are dealt by file but never sorted by its name."""
    fixed = (rows.filter((F.col("row_ix") == row) & (F.col("sheet_ix") == 0))
             .select("file_id", display(F.get(F.col("cells"), col)).alias(name)))
    return data.join(fixed.hint("shuffle_hash"), on="file_id", how="left")

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridflow.session import get_spark
    work = tempfile.mkdtemp(prefix="gridflow-test-")
    s = get_spark("local[4]", app="gridflow-tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": f"{work}/warehouse",
        "spark.checkpoint.dir": f"{work}/checkpoint",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


CELL = "array<struct<kind:string,raw:string>>"


def make_rows(spark, grid, file_id="f1", sheet="Sheet1", sheet_ix=0):
    """grid: list of rows, each a list of (kind, raw) or None for an empty cell."""
    data = []
    for i, row in enumerate(grid):
        cells = [{"kind": "null", "raw": None} if c is None else {"kind": c[0], "raw": c[1]} for c in row]
        data.append((file_id, sheet_ix, sheet, i, cells))
    return spark.createDataFrame(data, f"file_id string, sheet_ix int, sheet string, row_ix int, cells {CELL}")


def workbook_doc(spark, files):
    """files: {file_id: bytes} -> documents rows (live)."""
    import datetime as dt
    ts = dt.datetime(2024, 1, 1)
    rows = [(fid, (fid.split("/")[-1], len(b), ts, ts), bytearray(b), False) for fid, b in files.items()]
    return spark.createDataFrame(rows, "file_id string, file_metadata struct<name:string, size_in_bytes:bigint, "
                                       "last_modified_timestamp:timestamp, created_timestamp:timestamp>, "
                                       "content binary, is_deleted boolean")

"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of a documents table hold whole files or long texts; Arrow batches
    # are bounded by bytes so that one batch cannot exhaust a Python worker.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),
}

# session settings applied at run time to a session built elsewhere
RUNTIME = {k: DEFAULTS[k] for k in ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxBytesPerBatch")}


def prepare(spark: SparkSession) -> None:
    """Make a session built elsewhere ready: run-time settings, the shared
    folder, and the package on the executors."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    ship_package(spark)


def get_spark(master: str | None = None, app: str = "gridflow", **conf: str) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster pass no master; the launcher decides. Local tests pass
    ``local[8]`` and a small ``spark.sql.shuffle.partitions``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gridflow`` importable in executor Python workers.

    UDFs and ``mapInArrow`` functions are pickled by module reference, so the
    package is zipped once per application into the shared checkpoint folder
    and added with ``addPyFile`` (what ``spark-submit --py-files`` does).
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import hashlib
    import io
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, dirs, files in sorted(os.walk(pkg)):
            dirs[:] = sorted(x for x in dirs if x != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    data = buf.getvalue()
    target = f"{checkpoint_dir(spark).rstrip('/')}/gridflow-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    write_bytes(spark, target, data)
    sc.addPyFile(target)
    _SHIPPED.add(app)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark can reach."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _hadoop(spark, path)
    return fs.exists(hpath)


def write_bytes(spark: SparkSession, path: str, data: bytes, replace: bool = False) -> None:
    """Write ``data`` to ``path``, unless a file is there (or in its place); goes through Hadoop's file systems."""
    fs, hpath = _hadoop(spark, path)
    if replace or not fs.exists(hpath):
        out = fs.create(hpath)
        try:
            out.write(bytearray(data))
        finally:
            out.close()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Read from ``spark.checkpoint.dir``. Only on a ``local`` master, where
    driver and executors are one process, may it be unset: a private temporary
    folder is then chosen and recorded in the session. Elsewhere a machine-local
    folder would be seen by one machine only, so an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not single_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        path = tempfile.mkdtemp(prefix="gridflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def single_machine(master: str) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``)."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def land(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts lineage (an executor loss later re-reads files instead of recomputing,
    for instance, a workbook decode) and gives Spark exact sizes for planning.
    Jobs ``release`` what they landed once their own output is committed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._gridflow_scratch = path
    return out


def release(*dfs: DataFrame) -> None:
    """Delete the scratch folders behind landed DataFrames (any Hadoop file
    system). Only call when nothing will read them again."""
    for df in dfs:
        path = getattr(df, "_gridflow_scratch", None)
        if not path:
            continue
        fs, hpath = _hadoop(df.sparkSession, path)
        fs.delete(hpath, True)
        df._gridflow_scratch = None


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder (any Hadoop file system); none there is fine."""
    fs, hpath = _hadoop(spark, path)
    fs.delete(hpath, True)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for the few helpers that touch local paths."""
    return path[5:] if path.startswith("file:") else path

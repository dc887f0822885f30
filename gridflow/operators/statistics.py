"""Stored table statistics (E9, E10): kept by file, brought up to date by what has changed.

For every data file of a table there are rows with its count, and for every column nulls, smallest and largest
value and mergeable sketches: HyperLogLog for distinct values, KLL for quantiles, and frequent values. A refresh
lists the files, reads those that are new or changed, and supersedes the rows of files that are gone
(``gridflow.sinks.loads``); statistics of a table are merged from its files' rows, so nothing is read twice.

Counts alone (``SIMPLE``) come from the files' footers: such a scan asks for no column. Arrays, maps and structs have
statistics too: of their sizes, with null entries counted (structs: nulls only).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridflow.session import land, release
from gridflow.sinks import loads as L
from gridflow.sources.documents import exact_path

SKETCH_K = 400            # KLL: a rank is off by about 0.7 %
HLL_BITS = 14             # HyperLogLog: an estimate is off by about 0.8 % (one standard deviation)
TOP_ITEMS = 200           # values that the frequent-value sketch tracks
FILES_AT_ONCE = 10_000    # files read by one job
QUANTILES = (0.25, 0.5, 0.75)

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_TOP_TYPE = "struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"
ROW = [("table_name", "string"), ("file_size", "bigint"), ("file_time", "timestamp"), ("n_rows", "bigint"), ("column_name", "string"),
       ("kind", "string"), ("n_nulls", "bigint"), ("n_inner_nulls", "bigint"), ("min_num", "double"), ("max_num", "double"),
       ("min_text", "string"), ("max_text", "string"), ("hll", "binary"), ("kll", "binary"), ("top", _TOP_TYPE)]


def list_files(spark: SparkSession, roots: Mapping[str, str]) -> DataFrame:
    """``table_name, path, size, time`` of the data files of each table's folder; one listing."""
    where = spark.createDataFrame([(t, exact_path(r)) for t, r in roots.items()], "table_name string, root string")
    paths = [r["root"] for r in where.collect()]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("time"))
    listed = listed.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:/+", "/"), "/+$", "")
    # a file's table: its folder with partition folders taken off, or the file itself
    names = spark.createDataFrame(list(roots.items()), "table_name string, root string").select("table_name", plain(F.col("root")).alias("root"))
    own = plain(F.col("path"))
    folder = F.regexp_replace(F.regexp_replace(own, "/[^/]*$", ""), "(/[^/=]+=[^/]*)+$", "")
    listed = listed.withColumn("root", F.explode(F.array(own, folder)))
    return listed.join(names, "root").select("table_name", "path", "size", "time").distinct()


def _column_rows(name: str, df: DataFrame, detailed: bool) -> DataFrame:
    """``ROW`` and ``source_file`` of every file and column of ``df``: one aggregate by file."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.max("__size").alias("file_size"), F.max("__time").alias("file_time")]
    parts = []
    none = lambda t: F.lit(None).cast(t)
    # the metadata column escapes names, the listing does not
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = df.select("*", path.alias("__file"), F.col("_metadata.file_size").alias("__size"),
                      F.col("_metadata.file_modification_time").alias("__time"))
    for i, f in enumerate(df.schema.fields if detailed else []):
        c = F.col(f"`{f.name}`")
        number, inner, text = None, F.lit(0), None
        if isinstance(f.dataType, _NUMBERS):
            kind, number, text = "number", c.cast("double"), c.cast("string")
            number = F.when(~F.isnan(number), number)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            kind, number = "size", F.when(c.isNotNull(), F.size(c).cast("double"))
            values = c if isinstance(f.dataType, T.ArrayType) else F.map_values(c)
            inner = F.coalesce(F.size(F.filter(values, lambda x: x.isNull())), F.lit(0))
        elif isinstance(f.dataType, (T.StructType, T.BinaryType, T.VariantType)):
            kind = "other"
        else:
            kind, text = "text", c.cast("string")
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), F.sum(inner).cast("long").alias(f"i{i}")]
        got = {"hll": none("binary"), "kll": none("binary"), "top": none(_TOP_TYPE)}
        for out, source in (("min", F.min), ("max", F.max)):
            if number is not None:
                aggs.append(source(number).alias(f"{out}{i}"))
            elif text is not None:
                aggs.append(source(text).alias(f"{out}{i}"))
        if number is not None:
            aggs.append(F.kll_sketch_agg_double(number, F.lit(SKETCH_K)).alias(f"k{i}"))
            got["kll"] = F.col(f"k{i}")
        counted = text if text is not None else number
        if counted is not None:
            aggs.append(F.hll_sketch_agg(counted.cast("string"), F.lit(HLL_BITS)).alias(f"h{i}"))
            got["hll"] = F.col(f"h{i}")
            files = files.withColumn(f"__t{i}", F.substring(counted.cast("string"), 1, 256))
            aggs.append(F.expr(f"approx_top_k_accumulate(__t{i}, {TOP_ITEMS})").alias(f"t{i}"))
            got["top"] = _top_state(f"t{i}")
        num = number is not None
        parts.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(kind).alias("kind"), F.col(f"n{i}").alias("n_nulls"), F.col(f"i{i}").alias("n_inner_nulls"),
            *[(F.col(f"{m}{i}") if num else none("double")).alias(f"{m}_num") for m in ("min", "max")],
            *[(F.col(f"{m}{i}") if not num and text is not None else none("string")).alias(f"{m}_text") for m in ("min", "max")],
            *[v.alias(k) for k, v in got.items()]))
    per_file = files.groupBy(F.col("__file").alias(L.FILE)).agg(*aggs)
    whole = F.struct(none("string").alias("column_name"), F.lit("table").alias("kind"), none("bigint").alias("n_nulls"), none("bigint").alias("n_inner_nulls"),
                     none("double").alias("min_num"), none("double").alias("max_num"), none("string").alias("min_text"), none("string").alias("max_text"),
                     none("binary").alias("hll"), none("binary").alias("kll"), none(_TOP_TYPE).alias("top"))
    out = per_file.select(L.FILE, "file_size", "file_time", "n_rows", F.explode(F.array(whole, *parts)).alias("c"))
    return out.select(F.lit(name).alias("table_name"), "file_size", "file_time", "n_rows", "c.*", L.FILE)


def _top_state(c: str):
    """A frequent-value sketch's state without its item place holder (values are always text here)."""
    return F.struct(F.col(f"{c}.sketch").alias("sketch"), F.col(f"{c}.maxItemsTracked").alias("maxItemsTracked"),
                    F.lit("string").alias("itemDataType"), F.col(f"{c}.itemDataTypeDDL").alias("itemDataTypeDDL"))


def refresh_statistics(spark: SparkSession, store: str, roots: Mapping[str, str], detailed: bool = True) -> dict[str, int]:
    """Bring the statistics ``store`` of the parquet tables in ``roots`` (name: folder) up to date; files read and files dropped.

    Only files that are new, or of another size or time than when they were read, are opened.
    """
    listed = land(list_files(spark, roots), "stats-listed")
    if L.data_schema(spark, store) is None:
        known = spark.createDataFrame([], "table_name string, path string, size bigint, time timestamp")
    else:
        known = spark.table(store).where("kind = 'table'").select("table_name", F.col(L.FILE).alias("path"), F.col("file_size").alias("size"),
                                                                 F.col("file_time").alias("time"))
    known = land(known, "stats-known")
    todo = land(listed.join(known, ["table_name", "path", "size", "time"], "left_anti"), "stats-todo")
    gone = known.where(F.col("table_name").isin(list(roots))).join(listed, ["table_name", "path", "size", "time"], "left_anti")
    gone = land(gone.select(F.col("path").alias(L.FILE)).distinct(), "stats-gone")
    n_todo, n_gone = todo.count(), gone.count()
    parts = -(-n_todo // FILES_AT_ONCE)
    if n_gone:
        L.append_load(spark, store, None, gone)
    for i in range(parts):
        mine = todo.where(F.pmod(F.xxhash64("path"), F.lit(parts)) == i)
        names = mine.groupBy("table_name").agg(F.collect_list("path").alias("paths")).collect()      # at most FILES_AT_ONCE names
        rows = None
        for r in names:
            df = spark.read.option("basePath", _folder(roots[r["table_name"]])).parquet(*map(exact_path, r["paths"]))
            one = _column_rows(r["table_name"], df, detailed)
            rows = one if rows is None else rows.unionByName(one)
        rows = land(rows, "stats-rows")
        empty = mine.join(rows.select("table_name", F.col(L.FILE).alias("path")).distinct(), ["table_name", "path"], "left_anti")
        # files without rows have statistics as well: none
        blank = {c: F.lit(None).cast(t) for c, t in ROW}
        blank |= {"table_name": F.col("table_name"), "file_size": F.col("size"), "file_time": F.col("time"), "n_rows": F.lit(0).cast("bigint"), "kind": F.lit("table")}
        rows = rows.unionByName(empty.select(*[blank[c].alias(c) for c, _ in ROW], F.col("path").alias(L.FILE)))
        L.append_load(spark, store, rows, mine.select(F.col("path").alias(L.FILE)), ROW, "statistics", i, n_todo)
    release(listed, known, todo, gone)
    return {"read": n_todo, "dropped": n_gone}


def _folder(path: str) -> str:
    return path if not path.rstrip("/").endswith(".parquet") else path.rstrip("/").rsplit("/", 1)[0]


def table_statistics(spark: SparkSession, store: str) -> DataFrame:
    """``table_name, n_rows, n_files, size_in_bytes, last_modified``."""
    d = spark.table(store).where("kind = 'table'")
    return d.groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_files"), F.sum("file_size").alias("size_in_bytes"),
                                       F.max("file_time").alias("last_modified"))


def column_statistics(spark: SparkSession, store: str, top: int = 3) -> DataFrame:
    """Per column ``n_rows, n_nulls, n_inner_nulls``, smallest and largest value, ``n_distinct``, ``quartiles`` and the
    ``top`` most frequent values with their counts. Of arrays and maps all but the nulls is about their sizes."""
    d = spark.table(store).where("column_name is not null")
    d = d.withColumn("state", F.when(F.col("top").isNotNull(), F.struct(
        F.col("top.sketch").alias("sketch"), F.col("top.maxItemsTracked").alias("maxItemsTracked"), F.lit(None).cast("string").alias("itemDataType"),
        F.col("top.itemDataTypeDDL").alias("itemDataTypeDDL"))))
    common = [F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.sum("n_inner_nulls").alias("n_inner_nulls"),
              F.min("min_num").alias("min_num"), F.max("max_num").alias("max_num"), F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text")]
    keys = ["table_name", "column_name", "kind"]
    base = d.groupBy(*keys).agg(*common)
    sketched = d.where("hll is not null").groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(state, {TOP_ITEMS}), {int(top)})").alias("top"))
    ranks = F.array(*map(F.lit, QUANTILES))
    numbers = d.where("kll is not null and min_num is not null").groupBy(*keys).agg(
        F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("kll", F.lit(SKETCH_K)), ranks).alias("quartiles"))
    return base.join(sketched, keys, "left").join(numbers, keys, "left")

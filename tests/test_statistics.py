"""Stored statistics: footers only for counts, files read once, merged sketches near the truth, complex columns."""

import os

from pyspark.sql import functions as F

from gridflow.operators import statistics as T
from gridflow.sinks import loads as L


def test_refresh_reads_only_what_changed(spark, tmp_path):
    root = str(tmp_path / "t")
    part = lambda a, b: spark.range(a, b).select("id", (F.col("id") % 7).cast("string").alias("s")).coalesce(1)
    part(0, 100).write.parquet(root)
    part(100, 250).write.mode("append").parquet(root)
    roots = {"t": root, "odd[1]": str(tmp_path / "odd[1]")}
    spark.range(5).coalesce(1).write.parquet(roots["odd[1]"])
    store = "main.st_stats"
    assert T.refresh_statistics(spark, store, roots) == {"read": 3, "dropped": 0}
    get = lambda: {r["table_name"]: r for r in T.table_statistics(spark, store).collect()}
    assert (get()["t"]["n_rows"], get()["t"]["n_files"], get()["odd[1]"]["n_rows"]) == (250, 2, 5)
    assert T.refresh_statistics(spark, store, roots) == {"read": 0, "dropped": 0}
    size = get()["t"]["size_in_bytes"]
    assert size == sum(os.path.getsize(f"{root}/{f}") for f in os.listdir(root) if f.endswith(".parquet"))
    part(250, 260).write.mode("append").parquet(root)
    small = min((f for f in os.listdir(root) if f.endswith(".parquet")), key=lambda f: spark.read.parquet(f"{root}/{f}").agg(F.min("id")).first()[0])
    os.remove(f"{root}/{small}")
    assert T.refresh_statistics(spark, store, roots) == {"read": 1, "dropped": 1}
    assert get()["t"]["n_rows"] == spark.read.parquet(root).count() == 160
    c = {(r["table_name"], r["column_name"]): r for r in T.column_statistics(spark, store).collect()}
    assert (c["t", "id"]["min_num"], c["t", "id"]["max_num"], c["t", "s"]["n_distinct"]) == (100.0, 259.0, 7)
    L.compact_loads(spark, store)
    assert get()["t"]["n_rows"] == 160
    L.drop_loads(spark, store)


def test_counts_ask_for_no_column(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.range(100).withColumn("s", F.lit("x")).write.parquet(root)
    plan = T._column_rows("t", spark.read.parquet(root), detailed=False)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<>" in plan


def test_sketches_are_near_the_truth_and_complex_columns_count(spark, tmp_path):
    root = str(tmp_path / "t")
    d = spark.range(20_000).select(
        (F.col("id") % 3000).alias("n"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("v"), F.floor(F.sqrt("id")).cast("string"))).alias("s"),
        F.when(F.col("id") % 4 == 0, F.lit("often")).otherwise(F.col("id").cast("string")).alias("hot"),
        F.when(F.col("id") % 5 != 0, F.array(F.lit(1), F.when(F.col("id") % 2 == 0, F.lit(2)))).alias("a"),
        F.create_map(F.lit("k"), F.col("id")).alias("m"), F.struct("id").alias("st"), F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("id") / 2).alias("x"))
    d.repartition(4).write.parquet(root)
    spark.createDataFrame([], d.schema).coalesce(1).write.mode("append").parquet(root)
    store = "main.st_sketch"
    T.refresh_statistics(spark, store, {"t": root})
    c = {r["column_name"]: r for r in T.column_statistics(spark, store).collect()}
    assert {k: r["n_rows"] for k, r in c.items()} == dict.fromkeys(d.columns, 20_000)
    assert abs(c["n"]["n_distinct"] - 3000) < 150 and abs(c["s"]["n_distinct"] - 142) < 8
    assert all(abs(q - w) < 90 for q, w in zip(c["n"]["quartiles"], (750, 1500, 2250)))
    assert all(abs(q - w) < 300 for q, w in zip(c["x"]["quartiles"], (2500, 5000, 7500))) and c["x"]["max_num"] == 9999.5
    assert c["s"]["n_nulls"] == 2000 and (c["s"]["min_text"], c["s"]["max_text"]) == ("v1", "v99")
    assert c["hot"]["top"][0]["item"] == "often" and abs(c["hot"]["top"][0]["count"] - 5000) < 250
    assert (c["a"]["n_nulls"], c["a"]["n_inner_nulls"], c["a"]["min_num"], c["a"]["max_num"]) == (4000, 8000, 2.0, 2.0)
    assert c["a"]["n_distinct"] == 1 and c["m"]["max_num"] == 1.0 and c["st"]["n_nulls"] == 0 and c["st"]["n_distinct"] is None
    L.drop_loads(spark, store)


def test_exact_distinct_counts_do_not_multiply_rows(spark):
    from gridflow.operators.contracts import column_stats
    d = spark.createDataFrame([(1, "a", 0.0, None), (1, None, -0.0, None), (None, "b", float("nan"), None), (2, "a", float("nan"), None)],
                              "n int, s string, x double, e string")
    got = column_stats(spark, {"t": d, "none": d.limit(0)}, "exact")
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["table_name"], r["column_name"]): (r["n_rows"], r["n_nulls"], r["n_distinct"]) for r in got.collect()} == {
        ("t", "n"): (4, 1, 2), ("t", "s"): (4, 1, 2), ("t", "x"): (4, 0, 2), ("t", "e"): (4, 4, 0),
        **{("none", c): (0, 0, 0) for c in d.columns}}

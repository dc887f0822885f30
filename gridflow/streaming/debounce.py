"""Debounced change triggers.

A burst of changes to a watched table fires once, ``gap`` after the last
change of the burst; two changes at most ``gap`` apart belong to one burst.

Batch form, a segmented scan of Spark's own operators: changes are first counted per table and
time stamp, map side included, so any number of changes at one moment is one row. The moments are
range-partitioned on ``(key, ts)`` (Spark samples the keys, so a hot table is split over many
segments), bursts are found inside each segment by ``lag`` and a running sum, and only the bursts at a segment's ends (at most
two per key and segment) are carried on into the next segments in a second, tiny scan. No task ever holds all
changes of one key.

Streaming form: ``session_window`` with a watermark, append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gap_seconds(gap: str | int | float) -> float:
    if isinstance(gap, (int, float)):
        return float(gap)
    n, unit = gap.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600}[unit]
    return float(n) * mult


def debounce_triggers(events: DataFrame, gap: str | int = "60 seconds", key: str = "table_name",
                      ts: str = "ts", group_map: DataFrame | None = None,
                      partitions: int | None = None) -> DataFrame:
    """``(key, first_change, last_change, fire_at, n_changes)``.

    ``group_map`` (``table_name, group_name``) maps watched tables to a group,
    so a change in any member fires the group (I3); Spark broadcasts the map
    when its measured size allows.
    """
    spark = events.sparkSession
    gap_s = _gap_seconds(gap)
    e = events.select(F.col(key).alias("_key"), F.col(ts).alias("_ts")).filter(F.col("_ts").isNotNull())
    if group_map is not None:
        e = (e.join(group_map.select(F.col("table_name").alias("_key"), F.col("group_name")), "_key")
             .select(F.col("group_name").alias("_key"), "_ts"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    gap_iv = F.make_dt_interval(secs=F.lit(gap_s))
    moments = e.groupBy("_key", "_ts").agg(F.count(F.lit(1)).alias("n"))
    ranged = moments.repartitionByRange(n, "_key", "_ts").withColumn("_pid", F.spark_partition_id())
    seg = Window.partitionBy("_pid", "_key").orderBy("_ts")
    apart = F.col("_ts") > F.lag("_ts").over(seg) + gap_iv
    burst = F.sum(F.when(F.coalesce(apart, F.lit(False)), 1).otherwise(0)).over(seg.rowsBetween(Window.unboundedPreceding, 0))
    local = (ranged.withColumn("_burst", burst).groupBy("_pid", "_key", "_burst")
             .agg(F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"), F.sum("n").alias("n")))
    last = F.max("_burst").over(Window.partitionBy("_pid", "_key"))
    local = local.withColumns({"is_first": F.col("_burst") == 0, "is_last": F.col("_burst") == last})
    # boundary bursts of a key share a window partition (at most
    # two rows per key and range partition) and are stitched there; every
    # interior burst is final and gets a partition key of its own, so no
    # window partition grows with a hot key
    edge = F.col("is_first") | F.col("is_last")
    gk = F.when(edge, F.lit("edge")).otherwise(
        F.concat_ws(":", F.col("_pid").cast("string"), F.col("first_ts").cast("string")))
    w = Window.partitionBy("_key", "_gk").orderBy("_pid", "first_ts")
    prev_last = F.lag("last_ts").over(w)
    starts = F.when(prev_last.isNull() | (F.col("first_ts") > prev_last + gap_iv), 1).otherwise(0)
    sessions = (local.withColumn("_gk", gk)
                .withColumn("_new", starts)
                .withColumn("_grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .groupBy("_key", "_gk", "_grp")
                .agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
                     F.sum("n").alias("n")))
    return sessions.select(
        F.col("_key").alias(key if group_map is None else "group_name"),
        F.col("first_ts").alias("first_change"), F.col("last_ts").alias("last_change"),
        (F.col("last_ts") + gap_iv).alias("fire_at"),
        F.col("n").cast("bigint").alias("n_changes"))


def debounce_stream(events: DataFrame, gap: str = "60 seconds", key: str = "table_name",
                    ts: str = "ts", lateness: str = "0 seconds") -> DataFrame:
    """I2 on a streaming DataFrame: sessions close (and are emitted, append
    mode) once the watermark passes their end, i.e. when later changes arrive."""
    return (events.withWatermark(ts, lateness)
            .groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("s"))
            .agg(F.min(ts).alias("first_change"), F.max(ts).alias("last_change"),
                 F.count(F.lit(1)).alias("n_changes"))
            .select(key, "first_change", "last_change", F.col("s.end").alias("fire_at"), "n_changes"))


__all__ = ["debounce_triggers", "debounce_stream"]

"""Stored keyed tables (B4, B6-B8): every change is a version, switched in at once.

Rows lie in ``<name>__data<n>``, a parquet table partitioned by key range and
version; a folder, once written, is never touched again. (A table that is replaced by one of other columns
gets another data table.) ``<name>`` is a view of the folders
that make up the current version, and replacing it (one catalog change) is the commit: a
reader sees the version before or the one after, never half of one and never no
table, and a running query keeps the files it was planned on.

A change rewrites only the ranges that hold a row it changes. An insert rewrites none: it
adds a folder beside those of its ranges. ``vacuum`` drops folders that no kept version
needs. Writers of one table take turns: a commit on a version that is no longer the
current one is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.operators.keyed import delete_where, insert_if_absent, update_where
from gridflow.session import land, release
from gridflow.sinks.tables import TABLE_FORMAT, _text, drop_table, ensure_schema, quote_ident, quote_name, table_exists

RANGE, VERSION = "key_range", "version"
PROPERTY = "gridflow.keyed."
KEPT = 5                  # versions that stay readable, the current one included


class KeyedTableError(ValueError):
    pass


@dataclass(frozen=True)
class Snapshot:
    """One version: ``folders[range]`` are the versions whose folders hold that range;
    ``bounds[i]`` is the smallest key of range i + 1, as text."""

    data: str
    version: int
    key: str
    columns: tuple[str, ...]
    bounds: tuple[str, ...]
    folders: dict[int, tuple[int, ...]]

    def text(self) -> str:
        return json.dumps({"data": self.data, "version": self.version, "key": self.key, "columns": self.columns, "bounds": self.bounds,
                           "folders": self.folders})

    @staticmethod
    def parse(text: str) -> Snapshot:
        d = json.loads(text)
        return Snapshot(d["data"], d["version"], d["key"], tuple(d["columns"]), tuple(d["bounds"]),
                        {int(r): tuple(v) for r, v in d["folders"].items()})

    def where(self, ranges: Sequence[int] | None = None) -> str:
        """SQL condition that picks this version's folders: both columns are partition
        columns, so nothing else is listed or read."""
        chosen = self.folders if ranges is None else {r: self.folders.get(r, ()) for r in ranges}
        by_versions: dict[tuple[int, ...], list[int]] = {}
        for r, v in chosen.items():
            if v:
                by_versions.setdefault(v, []).append(r)
        parts = [f"({RANGE} IN ({', '.join(map(str, sorted(rs)))}) AND {VERSION} IN ({', '.join(map(str, v))}))"
                 for v, rs in sorted(by_versions.items())]
        return " OR ".join(parts) or "false"


def _properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {quote_name(name)}").collect()}


def snapshot(spark: SparkSession, name: str, version: int | None = None) -> Snapshot:
    """The current snapshot of a keyed table, or an older one that is kept."""
    if not table_exists(spark, name):
        raise KeyedTableError(f"no keyed table {name}")
    text = _properties(spark, name).get(f"{PROPERTY}current")
    if text is None:
        raise KeyedTableError(f"{name} is no keyed table")
    s = Snapshot.parse(text)
    if version is not None and version != s.version:
        text = _properties(spark, s.data).get(f"{PROPERTY}v{version}")
        if text is None:
            raise KeyedTableError(f"{name} keeps no version {version}")
        s = Snapshot.parse(text)
    return s


def read_keyed(spark: SparkSession, name: str, version: int | None = None) -> DataFrame:
    """A version's rows (``spark.table(name)`` reads the current one)."""
    s = snapshot(spark, name, version)
    return spark.table(s.data).where(s.where()).select(*map(quote_ident, s.columns))


def _range_of(s: Snapshot, key: Column, kind: str) -> Column:
    """Range of a key: the number of bounds at or below it."""
    if not s.bounds:
        return F.lit(0)
    bounds = F.array(*[F.lit(b).cast(kind) for b in s.bounds])
    return F.size(F.filter(bounds, lambda b: b <= key))


def _commit(spark: SparkSession, name: str, before: Snapshot | None, after: Snapshot, kept: int = KEPT) -> Snapshot:
    """Switch ``name`` to ``after``; its folders are written."""
    if before is not None and snapshot(spark, name).version != before.version:
        raise KeyedTableError(f"{name} has changed since version {before.version}")
    data = after.data
    spark.sql(f"ALTER TABLE {quote_name(data)} SET TBLPROPERTIES ({_text(f'{PROPERTY}v{after.version}')} = {_text(after.text())})")
    columns = ", ".join(map(quote_ident, after.columns))
    spark.sql(f"CREATE OR REPLACE VIEW {quote_name(name)} TBLPROPERTIES ({_text(PROPERTY + 'current')} = {_text(after.text())}) "
              f"AS SELECT {columns} FROM {quote_name(data)} WHERE {after.where()}")
    old = after.version - kept
    if old >= 0:
        spark.sql(f"ALTER TABLE {quote_name(data)} UNSET TBLPROPERTIES IF EXISTS ({_text(f'{PROPERTY}v{old}')})")
    return after


def _write(spark: SparkSession, s: Snapshot, rows: DataFrame) -> list[int]:
    """Write ``rows`` (with ``key_range``) as folders of version ``s``; the ranges that got rows.

    Folders of an earlier try at this version, which no snapshot names, are overwritten or dropped.
    """
    data, version = s.data, s.version
    stale = [r[0] for r in spark.sql(f"SHOW PARTITIONS {quote_name(data)}").where(
        F.col("partition").endswith(f"{VERSION}={version}")).collect()]
    for p in stale:
        at = p.split("/")[0].split("=")[1]
        spark.sql(f"ALTER TABLE {quote_name(data)} DROP IF EXISTS PARTITION ({RANGE} = {int(at)}, {VERSION} = {version})")
    columns = [F.col(quote_ident(c)) for c in s.columns]
    # a range lies in one file where it fits a task
    out = rows.repartition(RANGE).select(*columns, RANGE, F.lit(version).cast("long").alias(VERSION))
    out.write.mode("append").insertInto(data)
    written = spark.sql(f"SHOW PARTITIONS {quote_name(data)}").where(F.col("partition").endswith(f"/{VERSION}={version}")).collect()
    return sorted(int(r[0].split("/")[0].split("=")[1]) for r in written)


def create_keyed(df: DataFrame, name: str, key: str, ranges: int = 16) -> Snapshot:
    """Store ``df`` as keyed table ``name``, in ``ranges`` key ranges of about equal size.

    Keys must be present and unique. An existing keyed table of this name is replaced
    as a whole, contents, columns and ranges, by one switch (B4).
    """
    spark = df.sparkSession
    if {RANGE, VERSION} & {c.lower() for c in df.columns}:
        raise KeyedTableError(f"columns named {RANGE} or {VERSION} are the layout's own")
    rows = land(df, "keyed-create")
    try:
        bad = rows.groupBy(key).count().where((F.col("count") > 1) | F.col(quote_ident(key)).isNull()).first()
        if bad is not None:
            raise KeyedTableError(f"key {bad[0]!r} occurs {bad['count']} times" if bad[0] is not None else "null key")
        kind = rows.schema[key].dataType.simpleString()
        k = F.col(quote_ident(key))
        # Spark samples the keys to deal them into ranges; a row a range comes back
        dealt = rows.select(k).repartitionByRange(ranges, k).groupBy(F.spark_partition_id().alias("p")).agg(F.min(k).alias("low"))
        lows = [r["low"] for r in dealt.select(F.col("low").cast("string").alias("low"), "p").orderBy("p").collect()]
        before = snapshot(spark, name) if table_exists(spark, name) else None
        version = before.version + 1 if before else 0
        layout = [(f.name, f.dataType) for f in rows.schema]
        if before and [(f.name, f.dataType) for f in spark.table(name).schema] == layout:
            data = before.data
        else:
            data = f"{name}__data{version}"
            ensure_schema(spark, name)
            drop_table(spark, data)          # left by a creation that was broken off
            _empty(spark, data, rows)
        s = Snapshot(data, version, key, tuple(rows.columns), tuple(lows[1:]), {})
        return _commit(spark, name, before, _with_folders(s, {}, _write(spark, s, rows.withColumn(RANGE, _range_of(s, k, kind)))))
    finally:
        release(rows)


def _empty(spark: SparkSession, data: str, rows: DataFrame) -> None:
    columns = ", ".join(f"{quote_ident(f.name)} {f.dataType.simpleString()}" for f in rows.schema)
    spark.sql(f"CREATE TABLE {quote_name(data)} ({columns}, {RANGE} INT, {VERSION} BIGINT) USING {TABLE_FORMAT} "
              f"PARTITIONED BY ({RANGE}, {VERSION})")


def _with_folders(s: Snapshot, kept: dict[int, tuple[int, ...]], written: list[int]) -> Snapshot:
    folders = {r: v for r, v in kept.items() if v}
    for r in written:
        folders[r] = (*folders.get(r, ()), s.version)
    return replace(s, folders=folders)


def _ranged(spark: SparkSession, s: Snapshot, ranges: Sequence[int] | None = None) -> DataFrame:
    """A version's rows with their range, of some ranges only if given."""
    return spark.table(s.data).where(s.where(ranges)).select(*map(quote_ident, s.columns), RANGE)


def _next(s: Snapshot) -> Snapshot:
    return replace(s, version=s.version + 1)


def insert_keyed(rows: DataFrame, name: str) -> tuple[int, DataFrame]:
    """Insert rows whose key is new. Returns the number inserted and the rejects (landed) with
    their ``reason``: key exists, repeated in ``rows``, or null. Reads the keys of the ranges of ``rows``
    only and writes the new rows only."""
    spark = rows.sparkSession
    s = snapshot(spark, name)
    kind = spark.table(name).schema[s.key].dataType.simpleString()
    k = F.col(quote_ident(s.key))
    new = land(rows.select(*map(quote_ident, s.columns)).withColumn(RANGE, _range_of(s, k.cast(kind), kind)), "keyed-rows")
    ranges = [r[0] for r in new.select(RANGE).distinct().collect()]
    there = _ranged(spark, s, ranges)
    _, inserted, rejects = insert_if_absent(there.select(k), new, s.key)
    rejects = land(rejects.drop(RANGE), "keyed-rejects")
    inserted = land(inserted, "keyed-insert")
    n = inserted.count()
    if n:
        after = _next(s)
        _commit(spark, name, s, _with_folders(after, s.folders, _write(spark, after, inserted)))
    release(new, inserted)
    return n, rejects


def _rewrite(spark: SparkSession, name: str, s: Snapshot, hit: DataFrame, change) -> int:
    """Replace the ranges of ``hit`` (their rows that change, with ``key_range``) by ``change(rows)``; the rows hit."""
    counts = {r[RANGE]: r["count"] for r in hit.groupBy(RANGE).count().collect()}      # a row a range
    if not counts:
        return 0
    after = _next(s)
    written = _write(spark, after, change(_ranged(spark, s, sorted(counts))))
    kept = {r: v for r, v in s.folders.items() if r not in counts}
    _commit(spark, name, s, _with_folders(after, kept, written))
    return sum(counts.values())


def update_keyed(spark: SparkSession, name: str, cond: Column, assignments: dict[str, Column | object]) -> int:
    """Set columns of the rows that match ``cond``; returns their number. Ranges without one keep
    their files. The key itself cannot be set."""
    s = snapshot(spark, name)
    if s.key in assignments or not set(assignments) <= set(s.columns):
        raise KeyedTableError(f"cannot set {sorted(set(assignments) - (set(s.columns) - {s.key}))}")
    hit = _ranged(spark, s).where(F.coalesce(cond, F.lit(False)))
    return _rewrite(spark, name, s, hit, lambda d: update_where(d, cond, assignments))


def delete_keyed(spark: SparkSession, name: str, cond: Column) -> DataFrame:
    """Delete the rows that match ``cond`` and return them (landed). Deleting again deletes nothing."""
    s = snapshot(spark, name)
    gone = land(_ranged(spark, s).where(F.coalesce(cond, F.lit(False))), "keyed-deleted")
    _rewrite(spark, name, s, gone, lambda d: delete_where(d, cond)[0])
    return gone.drop(RANGE)


def upsert_keyed(rows: DataFrame, name: str) -> tuple[int, int]:
    """Replace the rows whose key is there and insert the others, in one version; returns both numbers.
    ``rows`` must hold all columns, with present and unique keys."""
    spark = rows.sparkSession
    s = snapshot(spark, name)
    kind = spark.table(name).schema[s.key].dataType.simpleString()
    k = F.col(quote_ident(s.key))
    new = land(rows.select(*map(quote_ident, s.columns)).withColumn(RANGE, _range_of(s, k.cast(kind), kind)), "keyed-rows")
    bad = new.groupBy(s.key).count().where((F.col("count") > 1) | k.isNull()).first()
    if bad is not None:
        raise KeyedTableError(f"key {bad[0]!r} is null or occurs {bad['count']} times")
    ranges = [r[0] for r in new.select(RANGE).distinct().collect()]
    there = _ranged(spark, s, ranges)
    hit = there.join(new.select(k), s.key, "left_semi").groupBy(RANGE).count().collect()
    touched = {r[RANGE] for r in hit}
    updated, total = sum(r["count"] for r in hit), new.count()
    if total:
        after = _next(s)
        # ranges that lose a row are rewritten whole; the others only gain a folder
        stay = _ranged(spark, s, sorted(touched)).join(new.select(k), s.key, "left_anti")
        written = _write(spark, after, stay.select(*new.columns).unionByName(new))
        kept = {r: v for r, v in s.folders.items() if r not in touched}
        _commit(spark, name, s, _with_folders(after, kept, written))
    release(new)
    return updated, total - updated


def vacuum_keyed(spark: SparkSession, name: str, kept: int = 1) -> int:
    """Drop the folders that none of the newest ``kept`` versions needs; their number. Older versions
    can no longer be read, and queries still running on them fail."""
    current = snapshot(spark, name)
    data = current.data
    needed, forgotten = set(), []
    for k, text in _properties(spark, data).items():
        if k.startswith(f"{PROPERTY}v"):
            s = Snapshot.parse(text)
            if s.version > current.version - kept:
                needed |= {(r, v) for r, vs in s.folders.items() for v in vs}
            else:
                forgotten.append(k)
    if forgotten:
        spark.sql(f"ALTER TABLE {quote_name(data)} UNSET TBLPROPERTIES IF EXISTS ({', '.join(map(_text, forgotten))})")
    gone = 0
    for row in spark.sql(f"SHOW PARTITIONS {quote_name(data)}").collect():      # a row a folder
        r, v = (int(x.split("=")[1]) for x in row[0].split("/"))
        if (r, v) not in needed:
            spark.sql(f"ALTER TABLE {quote_name(data)} DROP IF EXISTS PARTITION ({RANGE} = {r}, {VERSION} = {v})")
            gone += 1
    for t in _data_tables(spark, name):
        if t != data:
            drop_table(spark, t)
    return gone


def _data_tables(spark: SparkSession, name: str) -> list[str]:
    """The data tables of ``name``, those of earlier columns included."""
    *schema, own = name.split(".")
    mine = re.compile(re.escape(own.lower()) + r"__data\d+")
    listed = spark.catalog.listTables(".".join(schema) or None, f"{own}__data*")
    return [".".join([*schema, t.name]) for t in listed if mine.fullmatch(t.name.lower())]


def drop_keyed(spark: SparkSession, name: str) -> None:
    """B9 for a keyed table: the view, then the rows."""
    spark.sql(f"DROP VIEW IF EXISTS {quote_name(name)}")
    for t in _data_tables(spark, name):
        drop_table(spark, t)

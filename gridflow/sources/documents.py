"""The documents table: one row per landed file.

Canonical schema::

    file_id string,
    file_metadata struct<name string, size_in_bytes bigint,
                         last_modified_timestamp timestamp, created_timestamp timestamp>,
    content binary,
    is_deleted boolean
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.functions.scalars import normalise_content
from gridflow.operators.keyed import latest_per_key
from gridflow.session import land, scratch_path

METADATA_FIELDS = ("name", "size_in_bytes", "last_modified_timestamp", "created_timestamp")


def land_documents(spark: SparkSession, root: str, pattern: str | None = None,
                   recursive: bool = True, modified_after: str | None = None) -> DataFrame:
    """A1: every file under ``root`` (optionally matching a glob) as a documents row.

    ``binaryFile`` lists and reads files in parallel; the metadata projection is
    pruned to the listing when ``content`` is not selected downstream.
    ``modified_after`` (``yyyy-MM-ddTHH:mm:ss``) lists only files changed since.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return _rows(reader.load(root))


def _rows(raw: DataFrame) -> DataFrame:
    """Listed files as documents rows."""
    return raw.select(
        F.col("path").alias("file_id"),
        F.struct(
            F.element_at(F.split("path", "/"), -1).alias("name"),
            F.col("length").alias("size_in_bytes"),
            F.col("modificationTime").alias("last_modified_timestamp"),
            # the file system reports no creation time
            F.lit(None).cast("timestamp").alias("created_timestamp"),
        ).alias("file_metadata"),
        F.col("content"),
        F.lit(False).alias("is_deleted"),
    )


def live(docs: DataFrame) -> DataFrame:
    """Rows whose ``is_deleted`` is false. A NULL flag is not live."""
    return docs.filter(F.col("is_deleted") == F.lit(False))


def list_documents(docs: DataFrame, limit: int | None = 100, ordered: bool = True) -> DataFrame:
    """C1 + F3: flat listing of live documents, newest first.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject (per-partition
    top-n, then a merge of n rows per partition), never a full sort.
    ``limit=None, ordered=False`` gives the unordered projection (no shuffle)
    for further filtering.
    """
    out = live(docs).select(
        F.col("file_id"),
        F.col("file_id").alias("path"),
        F.col("file_metadata.name").alias("name"),
        F.col("file_metadata.size_in_bytes").alias("size"),
        F.col("file_metadata.last_modified_timestamp").alias("modificationTime"),
        F.col("file_metadata.created_timestamp").alias("createdTime"),
        F.col("is_deleted"),
    )
    if not ordered and limit is None:
        return out
    srt = out.orderBy(F.col("modificationTime").desc_nulls_last(), F.col("file_id"))
    return srt.limit(limit) if limit is not None else srt


def read_content(docs: DataFrame, file_ids: DataFrame | list[str] | None = None,
                 key: str = "file_id") -> DataFrame:
    """A3: bytes of live files, many ids at once.

    ``file_ids`` may be a DataFrame with a ``file_id`` column (semi join; Spark
    broadcasts it only when its measured size is under the broadcast threshold)
    or a short list of literals (pushed into the scan as an IN filter).
    Content is normalised to bytes (H3) whatever its stored shape.
    """
    rows = live(docs)
    if isinstance(file_ids, list):
        rows = rows.filter(F.col(key).isin(file_ids))
    elif file_ids is not None:
        rows = rows.join(file_ids.select(F.col(key)).distinct(), on=key, how="left_semi")
    content_type = docs.schema["content"].dataType
    return rows.select(F.col(key).alias("file_id"),
                       normalise_content(F.col("content"), content_type).alias("content"))


def snapshot_versions(docs: DataFrame) -> DataFrame:
    """One row per file: of several the newest (of equal times a deletion, then the larger). Rows without an id
    are no files and go."""
    return latest_per_key(docs.where(F.col("file_id").isNotNull()), "file_id", [
        F.col("file_metadata.last_modified_timestamp").desc_nulls_last(), F.col("is_deleted").desc_nulls_last(),
        F.col("file_metadata.size_in_bytes").desc_nulls_last(), F.col("file_metadata.name")])


def diff_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """A2: the next documents snapshot from two: ``file_id, file_metadata, content, is_deleted`` and ``change``.

    ``change`` is ``new`` (only in new), ``changed`` (another modification time
    or size, or another deleted flag), ``deleted`` (vanished from new: kept as
    a tombstone with ``is_deleted = true`` and its old contents) or ``unchanged``. A file put back
    to an older version has changed. One full outer join of the snapshots' versions; contents are
    part of it only if they are asked for (or there).
    """
    content = "content" in old.columns and "content" in new.columns
    pick = ["file_metadata", "is_deleted"] + (["content"] if content else [])
    o, n = (snapshot_versions(d).select("file_id", *[F.col(c).alias(f"{side}_{c}") for c in pick], F.lit(True).alias(f"_in_{side}"))
            for d, side in ((old, "old"), (new, "new")))
    j = o.join(n, on="file_id", how="full_outer")
    same = F.lit(True)
    for f in ("last_modified_timestamp", "size_in_bytes"):
        same = same & F.col(f"old_file_metadata.{f}").eqNullSafe(F.col(f"new_file_metadata.{f}"))
    same = same & F.coalesce("old_is_deleted", F.lit(False)).eqNullSafe(F.coalesce("new_is_deleted", F.lit(False)))
    gone = F.when(F.col("old_is_deleted") == F.lit(True), "unchanged").otherwise("deleted")
    change = (F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), gone)
              .when(same, "unchanged").otherwise("changed"))
    there = F.col("_in_new").isNotNull()
    out = [F.col("file_id"), F.when(there, F.col("new_file_metadata")).otherwise(F.col("old_file_metadata")).alias("file_metadata")]
    if content:     # an unchanged file keeps the contents it had
        out.append(F.when(there & ~same.eqNullSafe(True) | F.col("_in_old").isNull(), F.col("new_content")).otherwise(F.col("old_content")).alias("content"))
    out += [F.when(there, F.col("new_is_deleted")).otherwise(F.lit(True)).alias("is_deleted"), change.alias("change")]
    return j.select(*out)


# names of files that are opened by one job: the driver holds so many at a time, however many have changed
NAMES_AT_ONCE = 50_000


def exact_path(path: str) -> str:
    """A path that stands for itself where patterns are allowed."""
    return re.sub(r"([\[\]{}*?\\^])", r"\\\1", path)


def refresh_documents(spark: SparkSession, docs: DataFrame, root: str,
                      pattern: str | None = None) -> DataFrame:
    """A2, incremental: the next documents snapshot, reading file bytes only
    for files that are new or whose time or size has changed.

    The listing is metadata only. Which files to read follows from the
    metadata diff, never from one global time, so a new file with an old time
    stamp is read too; contents of other files stay those of ``docs``. Files are opened by their exact
    names, in jobs of up to ``NAMES_AT_ONCE``, each landed before the next. Returns
    the ``diff_snapshot`` shape; persist it as the new documents table.
    """
    listing = land_documents(spark, root, pattern).drop("content")
    d = land(diff_snapshot(docs.drop("content"), listing), "refresh-diff")
    changed = d.where(F.col("change").isin("new", "changed"))
    cols = ["file_id", "file_metadata", "content", "is_deleted", "change"]
    kept = (d.where(F.col("change").isin("unchanged", "deleted"))
            .join(snapshot_versions(docs).select("file_id", "content"), "file_id").select(*cols))
    n = changed.count()
    if not n:
        return kept
    path = scratch_path(spark, "refresh-read")
    parts = -(-n // NAMES_AT_ONCE)
    for i in range(parts):
        names = [r[0] for r in changed.where(F.pmod(F.xxhash64("file_id"), F.lit(parts)) == i).select("file_id").collect()]
        if names:
            fresh = _rows(spark.read.format("binaryFile").load([exact_path(x) for x in names]))
            fresh.select("file_id", "content").write.mode("append").parquet(path)
    read = spark.read.schema("file_id string, content binary").parquet(path)
    return kept.unionByName(changed.join(read, "file_id").select(*cols))

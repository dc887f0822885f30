"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and rereads it as the next stage's docs. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridflow.llm import line_dedup, mixing, packing, quality, simhash
from gridflow.llm.common import bounded_side
from gridflow.llm.queries import MIX_EPOCHS, MIX_SHARE, MIX_WEIGHTS, vocabulary
from gridflow.session import land, prepare, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null texts are rejected (no words)."""
    prepare(spark)
    return quality.judge_quality(docs).where("q_kept").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site lines; those that lose all they had go.
    ``n_chars``, where there, follows the text."""
    prepare(spark)
    d = line_dedup.remove_boilerplate(docs).where("n_lines_removed = 0 or n_lines_left > 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def dedup_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the one of smallest id.

    Rows that repeat an id are one document and stay or go together; a
    null id stays only where its group has no other.
    """
    prepare(spark)
    groups = simhash.simhash_components(docs)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone"))
    # the ids that go are the smaller side: texts are shuffled only if there are too many to send
    gone = bounded_side(land(gone.distinct(), "pipeline-gone"), 16)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target takes it."""
    prepare(spark)
    return mixing.repeat_documents(mixing.mix_sources(docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the mix in sequences."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_simhash),
          ("mix", mix), ("pack", pack)]

# Fingerprints and token ids have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves is dropped when the next has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = out
    return docs

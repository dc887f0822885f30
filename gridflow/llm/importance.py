"""Quality classifier by importance resampling.

Target text (documents labelled good) and raw text (all documents) are each
modelled by the frequencies of their words and word pairs, hashed to a fixed
number of buckets. A document's importance is the log ratio of the two models;
Gumbel noise on it and a global top-k draw a sample without replacement.

The models are two arrays of ``buckets`` counts, whatever the corpus: a task
sends its own sums, and the log ratios go back to the tasks. The k-th largest
key is found by radix selection over counts, so no sort or single task sees
the documents.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.session import land

from .common import bounded_side

BUCKETS = 10_000
SMOOTHING = 1.0
SEED = 29


def _hashed(text: bytes, buckets: int) -> np.ndarray:
    """Bucket of every word and word pair of ``text``, repeats included."""
    words = text.lower().split()
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pairs ^= pairs >> np.uint64(29)
    return np.concatenate([h, pairs]) % np.uint64(buckets)


@lru_cache(maxsize=200_000)
def _word_hash(word: bytes) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(word, 1)


def gram_counts(docs: DataFrame, text: str, is_target: str, buckets: int) -> DataFrame:
    """``bucket, raw, target`` summed over all rows (``is_target``: boolean)."""
    def run(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for t, good in zip(b.column(0), b.column(1)):
                n = np.bincount(_hashed((t.as_py() or "").encode(), buckets).astype(np.int64), minlength=buckets)
                raw += n
                if good.as_py():
                    target += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])],
                                         ["bucket", "raw", "target"])
    part = docs.select(text, is_target).mapInArrow(run, "bucket long, raw long, target long")
    return part.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p_target / p_raw per bucket; the one collect here has ``buckets`` rows at most."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counts.collect():
        raw[b], target[b] = r, t
    if target.sum() == 0:
        return np.zeros(buckets)     # no target text: all documents alike
    p = (target + smoothing * raw / max(raw.sum(), 1) + 1e-9) / (target.sum() + smoothing + 1e-9 * buckets)
    q = (raw + 1e-9) / (raw.sum() + 1e-9 * buckets)
    return np.log(p / q)


def importance(docs: DataFrame, ratios: np.ndarray, key: str, text: str, evidence: int | None = None) -> DataFrame:
    """``key, n_grams, mean_log_ratio, log_weight`` of every row.

    ``log_weight`` is the sum of the log ratios of all grams: the log ratio of the
    document under the two models. With ``evidence`` it is tempered: the mean log
    ratio times the grams it rests on, of which ``evidence`` count at most.
    """
    buckets = len(ratios)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)   # 8 bytes a bucket

    def run(batches):
        r = shared.value
        for b in batches:
            n, m = [], []
            for t in b.column(1):
                g = _hashed((t.as_py() or "").encode(), buckets).astype(np.int64)
                n.append(len(g))
                m.append(float(r[g].mean()) if len(g) else 0.0)
            n, m = np.array(n, np.int64), np.array(m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(m), pa.array(m * (n if evidence is None else np.minimum(n, evidence)))],
                                             [key, "n_grams", "mean_log_ratio", "log_weight"])
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_grams long, mean_log_ratio double, log_weight double")


def top_k(df: DataFrame, value: str, ties: list[str], k: int, out: str = "kept") -> DataFrame:
    """``df`` (landed) with boolean ``out``: the ``k`` rows of largest ``value``
    (long, no nulls); equal values are ranked by a hash of ``ties``. Rows equal
    in both are kept or dropped together.

    The cut is found by narrowing: rows are counted in 4,096 cells between the
    bounds, and the cell of rank ``k`` gives the next bounds. The driver holds
    one round's counts.
    """
    d = df.withColumn("__t", F.shiftrightunsigned(F.xxhash64(*ties), 12))
    if k <= 0:
        return df.withColumn(out, F.lit(False))
    cut, left, there = _cut(d, value, k)
    keep = F.col(value) >= cut
    if left < there:
        tie, _, _ = _cut(d.where(F.col(value) == cut), "__t", left)
        keep = (F.col(value) > cut) | ((F.col(value) == cut) & (F.col("__t") >= tie))
    return d.withColumn(out, keep).drop("__t")


def _cut(d: DataFrame, c: str, k: int) -> tuple[int, int, int]:
    """The ``k``-th largest value of ``c``, its rank among its equals, their number."""
    lo, hi, there = d.agg(F.min(c), F.max(c), F.count(c)).first()
    if lo is None or k >= there:
        return (lo or 0), there, there
    while lo < hi:
        width = (hi - lo) // 4096 + 1
        cell = F.floor((F.col(c) - lo) / width) if hi - lo < 1 << 52 else F.expr(f"({c} - {lo}) div {width}")
        counts = dict(d.where(F.col(c).between(lo, hi)).groupBy(cell.cast("long").alias("x")).count().collect())
        for x in sorted(counts, reverse=True):
            there = counts[x]
            if k <= there:
                break
            k -= there
        lo, hi = lo + x * width, min(hi, lo + (x + 1) * width - 1)
    return lo, k, there


def gumbel(key, seed: int = SEED):
    """Seeded standard Gumbel noise of a row's key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", share: float | None = None,
             buckets: int = BUCKETS, evidence: int | None = None, seed: int = SEED) -> DataFrame:
    """``key, n_grams, mean_log_ratio, log_weight, kept`` of every row of ``docs``.

    ``labels(key, good)``: 1 for target text; a document with several labels
    is target if all say so. ``share`` of the rows is kept, by default the share of good ones
    among all labelled. Null and empty texts weigh 0, like a document the
    models do not tell apart. Rows that repeat key and weight are kept or
    dropped together; an empty table gives an empty result.
    """
    lab = land(labels.groupBy(F.col(key).alias("__key")).agg(F.min("good").alias("good")), "dsir-labels")
    n, good = lab.agg(F.count("good"), F.coalesce(F.sum("good"), F.lit(0))).first()
    share = (good / n if n else 1.0) if share is None else share
    # labels are given by hand or by a judge, a few bytes each; beyond 64 MiB both sides are shuffled
    side = bounded_side(lab, 24)
    marked = docs.select(key, text).join(side, F.col(key) == F.col("__key"), "left").select(
        text, (F.coalesce("good", F.lit(0)) == 1).alias("good"))
    ratios = log_ratios(gram_counts(marked, text, "good", buckets), buckets)
    scored = importance(docs, ratios, key, text, evidence).withColumn(
        "__key", F.round((F.col("log_weight") + gumbel(F.col(key), seed)) * 1e6).cast("long"))
    scored = land(scored, "dsir-scored")
    return top_k(scored, "__key", [key], round(share * scored.count())).drop("__key")

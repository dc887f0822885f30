"""Line dedup by distinct-site spread [DataFrame functions only].

A line that stands on many sites is boilerplate. Its spread (the number of
distinct sites that carry it) is estimated by a HyperLogLog sketch per line
hash, merged by aggregation; lines whose estimate is near the threshold get an
exact distinct count. Boilerplate is removed from every document but the first
that carries it, so no wording is lost from the corpus.

Lines are handled as 96-bit hashes; texts move once, to meet the positions
that go. Lines of one site are dropped before any sketch is built, and all
per-line figures are pre-aggregated in the task that reads the line, so a line
on a third of all rows costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.session import land, release

from .common import bounded_side

MIN_SITES = 8
LG_K = 12          # 4,096 registers: standard error 1.6 %
MARGIN = 0.10      # estimates this near to the threshold are counted exactly


def line_table(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """``key, t, site, pos, h1, h2``: every line with a word, without its text.
    (key, t) names a text: rows that agree in both are copies of a row."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("t"), F.col(site).alias("site"),
                    F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    d = d.withColumn("line", F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return d.where("line <> ''").select("key", "t", "site", "pos", F.xxhash64("line").alias("h1"),
                                        F.hash("line").alias("h2"))


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """Lines on ``min_sites`` or more sites: ``h1, h2, first`` (struct key, t, pos
    of the first carrier). Null sites are no site."""
    stats = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    some = land(stats.where((F.col("n") >= min_sites) & (F.col("a") < F.col("b")) | F.lit(min_sites <= 1))
                .select("h1", "h2"), "lines-shared")
    shared = lines.join(some, ["h1", "h2"], "left_semi")
    sketched = shared.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("est"),
        F.min(F.struct("key", "t", "pos")).alias("first"))
    slack = max(2.0, margin * min_sites)
    sketched = land(sketched.where(F.col("est") >= min_sites - slack), "lines-sketched")
    near = sketched.where(F.col("est") < min_sites + slack)
    exact = (lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1))
             .groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites))
    sure = sketched.where(F.col("est") >= min_sites + slack)
    return (sure.select("h1", "h2", "first")
            .unionByName(near.join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first")))


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source",
                       min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """``docs`` with the boilerplate lines gone from ``text``, plus
    ``n_lines_removed`` (int) and ``n_lines_left`` (lines with a word).

    Lines are compared without the white space around them; blank lines stay.
    ``keep_first`` leaves each line once in its first carrier (smallest key,
    null first; of equal keys the smallest text hash; there the first
    position, in every copy of that row). Null texts stay null, texts without
    boilerplate stay as they are, rows of equal key and text are treated
    alike, an empty table gives an empty result. Clashing columns are
    replaced.
    """
    lines = land(line_table(docs, key, text, site), "lines")
    bad = land(line_spread(lines, min_sites), "lines-bad")
    hits = lines.join(bad, ["h1", "h2"])
    if keep_first:
        hits = hits.where(~F.struct("key", "t", "pos").eqNullSafe(F.col("first")))
    hits = land(hits.groupBy("key", "t").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "lines-hits")
    release(bad)
    own = [c for c in docs.columns if c.lower() not in ("n_lines_removed", "n_lines_left")]
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*own).withColumn("__t", F.xxhash64(body))
    # texts are shuffled only if there are too many positions to send, counted by the bytes they take
    hits = bounded_side(hits, 64 + 4 * F.size("gone"))
    d = d.join(hits, F.col(key).eqNullSafe(hits["key"]) & (d["__t"] == hits["t"]), "left")
    # lines between the removed positions, as slices
    parts, n, gone = F.split(body, "\n"), F.size("__parts"), F.col("gone")
    d = d.withColumn("__parts", F.when(gone.isNotNull(), parts))

    def between(k):
        lo = F.when(k == 0, 0).otherwise(F.get(gone, k - 1) + 1)
        hi = F.when(k == F.size(gone), n).otherwise(F.get(gone, k))
        return F.slice(F.col("__parts"), lo + 1, F.greatest(F.lit(0), hi - lo))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between))
    d = d.withColumn("__text", F.when(gone.isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    left = F.size(F.filter(F.split(F.coalesce("__text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return d.select(*[F.col("__text").alias(c) if c == text else c for c in own],
                    F.coalesce(F.size(gone), F.lit(0)).alias("n_lines_removed"), left.alias("n_lines_left"))

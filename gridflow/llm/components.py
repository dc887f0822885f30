"""Connected components of an edge table, by alternating star contraction.

Large-star links every node's larger neighbours to its smallest neighbour,
small-star does the same for its smaller ones; both keep the components and
the rounds needed grow with the logarithm of the longest chain (Kiveris et
al., "Connected Components in MapReduce and Beyond", 2014). Every round is
two aggregates and two joins on a node id. The rounds' tables are landed in
the shared checkpoint folder, so lineage stays short and a lost executor
costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.session import land, release


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)``, root the smallest node id.

    Only nodes that occur in an edge between two different nodes are
    returned. Null ends are ignored; repeated edges and loops do no harm. An
    empty table gives an empty result.
    """
    e = (edges.where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = land(e, "cc")
    seen = _state(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        nxt = land(_small_star(_large_star(e)), "cc")
        now = _state(nxt)
        release(e)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    # at the fixed point every edge leads from a node to its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(e: DataFrame) -> tuple[int, int]:
    r = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return (both.join(low, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return (e.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                    F.col("m").alias("v")).distinct())

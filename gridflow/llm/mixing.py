"""Mixing sources to target weights: capped water-filling and seeded sampling.

Every source gets a share of the budget by its weight; a source whose share is
above ``max_epochs`` times its size is clamped there and its excess goes to
the others by weight, until none is above. A target is then met by whole
repetitions of all the source's documents and one partial repetition: the
documents of the source in a seeded random order, as far as the target reaches.

The order is never sorted. The cut is found by radix selection: sizes are
summed per source and next two hex digits of the order key, the digits where
the target falls are kept, and the next round looks only below them. Rows per
(source, digits) are pre-aggregated, so a hot source costs no more in one task
than any other; the number of rounds is the logarithm of the largest source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridflow.session import land, release

from .common import WORD

SEED = 17
LEAF = 256   # the cut's neighbourhood may hold so many documents before it is ordered


def word_count(text: Column) -> Column:
    """Words (runs of anything but ASCII white space) of ``text``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(key: Column, text: Column, seed: int) -> Column:
    """Seeded random order of documents as hex digits. A null key takes the
    text's digest in its place; equal rows share a key and are taken together."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))


def cycle_weights(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """``sizes(source, ...)`` with column ``weight``: the given weights in turn,
    sources by code point, null last. One row per source passes the window."""
    # UTF-8 byte order is code point order
    pos = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                   (pos % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """``sources(source, size, weight)`` with ``target``.

    Clamping and redistributing until feasible has one fixed point: a level
    ``t`` with target = min(cap, t * weight). Sources in ascending order of
    cap / weight are clamped first; the level of the rest is (budget - caps
    so far) / (weights left), and the first source not above its cap at that
    level ends the clamping. The tables here have one row per source. A
    source of weight 0 gets nothing; if all caps together are under the
    budget, every source stands at its cap.
    """
    cap = max_epochs * F.col("size")
    d = sources.withColumns({"__cap": cap, "__budget": budget_share * F.sum("size").over(Window.partitionBy(F.lit(0)))})
    fed = d.where((F.col("weight") > 0) & (F.col("size") > 0))
    w = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    fed = fed.withColumns({"__clamped": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
                           "__left": F.sum("weight").over(onward)})
    level = (F.col("__budget") - F.col("__clamped")) / F.col("__left")
    fed = fed.withColumn("__level", F.when(level * F.col("weight") <= F.col("__cap"), level))
    # the first feasible level in this order is the lowest one
    fed = fed.withColumn("__level", F.first("__level", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("__cap"), F.coalesce(F.col("__level") * F.col("weight"), F.col("__cap")))
    fed = fed.select(F.col("source").alias("__s"), target.alias("__t"))
    return (sources.join(fed, F.col("source").eqNullSafe(F.col("__s")), "left")
            .select(*sources.columns, F.coalesce("__t", F.lit(0.0)).alias("target")))


def plan_mix(docs: DataFrame, weights: list[float], budget_share: float, max_epochs: float = 2.0,
             key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """One row per source: ``source, size, target, copies, cut``.

    A document is taken ``copies`` times, and once more if its order key is
    not above ``cut`` (null: never). Null sources form one source. Documents
    without words weigh nothing. The document the target falls into is taken
    if that comes nearer to the target. An empty table gives an empty plan.
    """
    sized = land(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                             order_key(F.col(key), F.col(text), seed).alias("k")), "mix-sized")
    sizes = land(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-sources")
    plan = land(water_fill(cycle_weights(sizes, weights), budget_share, max_epochs), "mix-targets")
    most = plan.agg(F.max("n")).first()[0] or 0
    copies = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    state = land(plan.select("source", "size", "target", copies.cast("int").alias("copies"),
                             (F.col("target") - copies * F.col("size")).alias("need"), F.lit("").alias("prefix")),
                 "mix-state")
    depth = 0
    while most > LEAF:   # rows left around each cut fall by 256 a round
        below = _narrowed(sized, state, depth).groupBy("source", F.substring("k", 2 * depth + 1, 2).alias("d")).agg(
            F.sum("__size").alias("s"))
        state, old = land(_descend(state, below), "mix-state"), state
        release(old)
        depth, most = depth + 1, most // 256 + 1
    leaf = _narrowed(sized, state, depth).groupBy("source", "k").agg(F.sum("__size").alias("s"))
    w = Window.partitionBy("source").orderBy("k")
    leaf = leaf.withColumns({"hi": F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    leaf = leaf.withColumn("mid", F.col("hi") - F.col("s") / 2)
    st = state.select(F.col("source").alias("__s"), "need")
    cut = (leaf.join(st, F.col("source").eqNullSafe(F.col("__s")))
           .where((F.col("mid") <= F.col("need")) & (F.col("need") > 0))
           .groupBy("source").agg(F.max("k").alias("cut")).withColumnRenamed("source", "__s"))
    # where no document of the neighbourhood is taken, all keys below its prefix still are
    out = state.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left").select(
        "source", "size", "target", "copies",
        F.coalesce("cut", F.when((F.col("need") > 0) | (F.length("prefix") > 0), F.col("prefix"))).alias("cut"))
    out = land(out, "mix-plan")
    release(sized, sizes, plan, state)
    return out


def _narrowed(sized: DataFrame, state: DataFrame, depth: int) -> DataFrame:
    st = state.select(F.col("source").alias("__s"), "prefix")
    d = sized.withColumnRenamed("size", "__size").where("__size > 0")
    return d.join(st, F.col("source").eqNullSafe(F.col("__s")) & (F.substring("k", 1, 2 * depth) == F.col("prefix"))
                  ).drop("__s")


def _descend(state: DataFrame, below: DataFrame) -> DataFrame:
    """Each source's digits where its running size passes what it needs."""
    w = Window.partitionBy("source").orderBy("d")
    cum = below.withColumn("hi", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cum = cum.withColumnRenamed("source", "__s")
    st = state.withColumnRenamed("source", "__t")
    j = st.join(cum, F.col("__t").eqNullSafe(F.col("__s")), "left").groupBy(
        F.col("__t").alias("source"), "size", "target", "copies", "need", "prefix").agg(
        F.min(F.when(F.col("hi") > F.col("need"), F.struct("d", "hi", "s"))).alias("at"),
        F.max(F.struct("d", "hi", "s")).alias("end"))
    at = F.coalesce("at", "end")
    return j.select("source", "size", "target", "copies",
                    (F.col("need") - F.coalesce(at["hi"] - at["s"], F.lit(0))).alias("need"),
                    F.concat("prefix", F.coalesce(at["d"], F.lit("00"))).alias("prefix"))


def mix_sources(docs: DataFrame, weights: list[float], budget_share: float, max_epochs: float = 2.0,
                key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with ``mix_target`` (of the document's source), ``mix_source_size``
    and ``mix_copies`` (how often the mix takes it: 0 and up).

    The plan has a row per source; Spark joins it by its landed size. Columns
    of ``docs`` with those names are replaced, others are kept.
    """
    plan = plan_mix(docs, weights, budget_share, max_epochs, key, text, source, seed)
    own = [c for c in docs.columns if c.lower() not in ("mix_target", "mix_source_size", "mix_copies")]
    p = plan.select(F.col("source").alias("__s"), F.col("size").alias("mix_source_size"),
                    F.col("target").alias("mix_target"), "copies", "cut")
    d = docs.select(*own).withColumn("__k", order_key(F.col(key), F.col(text), seed))
    extra = F.when(F.col("__k") <= F.col("cut"), 1).otherwise(0)
    return d.join(p, F.col(source).eqNullSafe(F.col("__s"))).withColumn(
        "mix_copies", (F.col("copies") + extra).cast("int")).select(
        *own, "mix_source_size", "mix_target", "mix_copies")


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as ``mix_copies`` says."""
    own = [c for c in mixed.columns if c not in ("mix_target", "mix_source_size", "mix_copies")]
    return (mixed.where("mix_copies > 0")
            .select(*own, F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("__copy")).drop("__copy"))

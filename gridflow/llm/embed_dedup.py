"""Embedding near-dedup by sorted projection passes.

In a pass every vector gets a key: the signs of its projections on random
directions, concatenated to 63 bits. Vectors are put in the lexicographic
order of the keys, and each is compared with the next ``window`` in that
order. Near vectors agree on most signs, so they come close in some pass; the
first passes are as many as evenly spread keys need so that a pair at the
threshold is met with the wanted probability. Verified pairs of all passes are
joined to components.

Keys of a dense cluster are not evenly spread. So every pass also measures, row
by row, how far the window reaches: the signs that a neighbour has to share to
be inside it. That gives each row the chance that its pair at the threshold was
missed in all passes so far. Rows above the wanted chance go through further
passes among themselves, or, where that is cheaper (and always if no number of
passes would do), are compared with one another exactly, in tiles. A pair is
settled as soon as one of its rows is.

Window and order cannot show all links of a dense group. So links are counted
afterwards inside each component, exactly and in blocks of rows: the passes
only have to connect a component, not to find its every pair. Equal vectors
are one row with a multiplicity throughout.

The order is made by Spark's range partitioning, so a partition is a stretch
of the order and hot keys are split; vectors at the end of a stretch meet the
next stretch in a second, small step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.session import land, release

from .components import components
from .simhash import forest

THRESHOLD = 0.9
WINDOW = 128
MISS = 0.005        # wanted chance that no pass puts a pair at the threshold in one window
BLOCK = 512         # rows of a component that are compared with as many others at once
TILE = 2048         # dense rows of a tile: n of them are sent to n / TILE tiles, a pass sends them once
SPLIT = 8           # tiles a dense row is sent to at least, so that few rows too are work for many tasks
KEY_BITS = 63
SEED = 11


def passes_needed(n: int, window: int, threshold: float, miss: float = MISS) -> int:
    """Passes after which a pair at ``threshold`` is still apart with chance ``miss``.

    A pair that shares its first b signs is within the window if about
    ``window`` of ``n`` vectors share them: b = log2(n / window).
    """
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(0.0, math.log2(max(1.0, n / window)))
    hit = agree ** math.ceil(bits)
    return 1 if hit >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-hit))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1. Each is first brought near 1 by a power of two, which is exact, so that no square under- or overflows."""
    near = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return near / np.linalg.norm(near, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector):
    """Whether a vector can be compared: not null, no null or non-finite part, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``h, g, id, low, n, dim, v``: each distinct vector once, named by the hashes
    (h, g); ``low`` its smallest key, ``n`` its rows, ``id`` its node in the graph."""
    d = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    d = d.where(usable(F.col("v"))).withColumns({"h": F.xxhash64("v"), "g": F.hash("v")})
    d = d.groupBy("h", "g").agg(F.min("k").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
    return d.select("h", "g", F.coalesce("low", "h").alias("id"), "low", "n", F.size("v").alias("dim"), "v")


def _keys(vectors: np.ndarray, dim: int, number: int) -> np.ndarray:
    """Pass ``number``'s keys: signs of KEY_BITS projections, first sign highest."""
    directions = np.random.default_rng([SEED, number, dim]).standard_normal((dim, KEY_BITS))
    signs = vectors @ directions > 0
    return signs @ (np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))


def window_links(distinct: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW,
                 miss: float = MISS) -> DataFrame:
    """``(a, b)``: links of at least ``threshold`` between the vectors of
    ``distinct`` (landed) that connect all that are connected, as forests: first those
    that meet in a window of some pass, then those of rows too dense for that."""
    n = distinct.count()
    if n < 2:
        return distinct.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    first = number = passes_needed(n, window, threshold, miss)
    left = distinct.select("id", "dim", "v", F.lit(0.0).alias("missed"))
    links, used = None, 0
    while True:
        found, log_miss = _passes(left, n, used, number, threshold, window)
        links = found if links is None else links.unionByName(found)
        used += number
        # rows whose pairs at the threshold are not yet met surely enough, and the passes each still needs
        rest = left.join(log_miss, "id").withColumn("missed", F.col("missed") + F.col("c"))
        rest = rest.where(F.col("missed") > math.log(miss))
        rest = rest.withColumn("need", F.when(F.col("c") < 0, F.ceil((math.log(miss) - F.col("missed")) * number / F.col("c"))))
        left = land(rest.select("id", "dim", "v", "missed", F.col("need").cast("double").alias("need")), "embed-dense")
        n = left.count()
        if n < 2:
            return links
        need = F.least(F.coalesce("need", F.lit(float(n))), F.lit(float(n)))
        passes, middle = left.agg(F.sum(need), F.percentile_approx(need, 0.5)).first()
        if n <= TILE or n * max(SPLIT, n / TILE) <= passes:
            return links.unionByName(dense_links(left, n, threshold))
        number = int(min(max(1, middle), first))


def dense_links(rows: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b)``: a spanning forest of all links of at least ``threshold`` between the
    ``n`` ``rows(id, dim, v)``, exactly: each two chunks are compared in a group of their own."""
    chunks = max(SPLIT, math.ceil(n / TILE))
    d = rows.select("id", "dim", "v", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("own"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    d = d.select("dim", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v")

    def tile(keys, group):
        dim, x, y = (k.as_py() for k in keys)
        m = _unit(_matrix(group.column("v").combine_chunks(), dim))
        own, ids = group.column("own").to_numpy(), group.column("id").to_numpy()
        a, b = np.flatnonzero(own == x), np.flatnonzero(own == y)

        def near():
            for lo in range(0, len(a), BLOCK):
                i, j = np.nonzero(m[a[lo:lo + BLOCK]] @ m[b].T >= threshold)
                yield a[lo + i], b[j]
        label = forest(len(ids), near())
        at = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[at], pa.int64()), "b": pa.array(ids[label[at]], pa.int64())})
    return d.groupBy("dim", "x", "y").applyInArrow(tile, "a long, b long")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits (of KEY_BITS) that two keys share."""
    x = a ^ b
    high, low = (x >> 32).astype(np.float64), (x & 0xFFFFFFFF).astype(np.float64)
    return KEY_BITS - np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


def _log_miss(keys: np.ndarray, window: int, agree: float, open_start: bool, open_end: bool) -> np.ndarray:
    """Log of the chance, at most, that a row's pair is outside its window; signs agree with chance ``agree``.

    ``keys`` ascend. A pair that shares exactly b signs lies on the side that the row's next
    sign tells, and is within the window if the first row beyond the window shares fewer.
    An open end goes on in another partition: there the last row here stands for that row."""
    n = len(keys)
    at, reach = np.arange(n), window + 1
    after, before = (_common(keys, keys[np.clip(at + d, 0, n - 1)]) for d in (reach, -reach))
    if not open_end:
        after[at + reach >= n] = -1
    if not open_start:
        before[at - reach < 0] = -1
    hit = np.where(np.maximum(after, before) < KEY_BITS, agree ** KEY_BITS, 0.0)
    for b in range(KEY_BITS):
        side = np.where((keys >> (KEY_BITS - 1 - b)) & 1, before, after)
        hit += (b > side) * (agree ** b * (1 - agree))
    return np.log1p(-np.minimum(hit, 1 - 1e-12))


def _passes(rows: DataFrame, n: int, begin: int, number: int, threshold: float, window: int) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` between the ``n`` ``rows(id, dim, v)`` that meet in one of ``number``
    passes from pass ``begin`` on, and ``id, c``: log chance that a row's pair was missed in them."""
    agree = 1 - math.acos(threshold) / math.pi

    def keyed(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                sub = b.take(pa.array(at))
                m = _matrix(sub.column(2), int(dim))
                for p in range(begin, begin + number):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), sub.column(1), pa.array(_keys(m, int(dim), p)),
                         sub.column(0), sub.column(2)], ["p", "dim", "key", "id", "v"])
    d = rows.select("id", "dim", "v").mapInArrow(keyed, "p int, dim int, key long, id long, v array<double>")
    parts = max(1, n * number // (16 * window))
    parts = min(parts, 4 * max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), number))
    d = d.repartitionByRange(parts, "p", "dim", "key", "id").sortWithinPartitions("p", "dim", "key", "id")

    def stretch(batches):
        """Links inside the partition; its first and last ``window`` rows of each run (kinds 1 and 2);
        what each row may have missed (kind 3)."""
        from pyspark import TaskContext
        here = TaskContext.get().partitionId()
        held, seen, begun = None, [], True
        for b in batches:
            if not b.num_rows:
                continue
            rows, keys = [b.column(i).to_numpy() for i in (0, 1, 3)] + [b.column(4)], b.column(2).to_numpy()
            runs = np.flatnonzero(np.concatenate([[True], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)]))
            for lo, hi in zip(runs, [*runs[1:], len(rows[0])]):
                run = (int(rows[0][lo]), int(rows[1][lo]))
                ids, m = rows[2][lo:hi], _unit(_matrix(rows[3].slice(lo, hi - lo), run[1]))
                if held is not None and held[0] == run:
                    ids, m = np.concatenate([held[1], ids]), np.concatenate([held[2], m])
                elif held is not None:
                    yield from _edge_rows(here, 2, held, window)
                    yield from _miss_rows(seen, window, agree, begun, False)
                    seen, begun = [], False
                    yield from _edge_rows(here, 1, (run, ids, m), window)
                else:
                    yield from _edge_rows(here, 1, (run, ids, m), window)
                yield from _found(ids, _near(m, threshold, window))
                held = (run, ids[-window:], m[-window:])
                seen.append((keys[lo:hi], rows[2][lo:hi]))
        if held is not None:
            yield from _edge_rows(here, 2, held, window)
            yield from _miss_rows(seen, window, agree, begun, True)

    out = land(d.mapInArrow(stretch, STRETCH), "embed-windows")
    # a run that goes on in another partition: the last rows of one meet the first of the next
    ends = out.where("kind in (1, 2)").select("kind", "p", "dim", "part", F.col("a").alias("id"), "v")
    from pyspark.sql import Window
    order = land(ends.groupBy("p", "dim", "part").agg(F.count("*")).withColumn(
        "next", F.lead("part").over(Window.partitionBy("p", "dim").orderBy("part"))).where("next is not null"), "embed-ends")
    last = ends.where("kind = 2").join(order.select("p", "dim", "part"), ["p", "dim", "part"])
    first = ends.where("kind = 1").join(order.select("p", "dim", F.col("part").alias("before"), F.col("next").alias("part")),
                                        ["p", "dim", "part"])
    met = last.select("kind", "p", "dim", "part", "id", "v").unionByName(
        first.select("kind", "p", "dim", F.col("before").alias("part"), "id", "v"))

    def seam(keys, group):
        t = group.sort_by([("kind", "descending"), ("id", "ascending")])
        dim = keys[1].as_py()
        m = _unit(_matrix(t.column("v").combine_chunks(), dim))
        ids, cut = t.column("id").to_numpy(), int((t.column("kind").to_numpy() == 2).sum())
        s = m[:cut] @ m[cut:].T
        i, j = np.nonzero(s >= threshold)
        rows = next(iter(_found(ids, [(i, j + cut)])), None)
        if rows is None:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return pa.Table.from_batches([rows]).select(["a", "b"])
    seams = met.groupBy("p", "dim", "part").applyInArrow(seam, "a long, b long")
    log_miss = out.where("kind = 3").groupBy(F.col("a").alias("id")).agg(F.sum("c").alias("c"))
    return out.where("kind = 0").select("a", "b").unionByName(seams), log_miss


STRETCH = "kind int, p int, dim int, part int, a long, b long, v array<double>, c double"
NAMES = ["kind", "p", "dim", "part", "a", "b", "v", "c"]


def _near(m: np.ndarray, threshold: float, window: int):
    """Index pairs at most ``window`` apart in the order, block by block."""
    for lo in range(0, len(m), window):
        mine, reach = m[lo:lo + window], m[lo:lo + 2 * window]
        i, j = np.nonzero(mine @ reach.T >= threshold)
        ok = (j > i) & (j - i <= window)
        if ok.any():
            yield i[ok] + lo, j[ok] + lo


def _found(ids: np.ndarray, pairs):
    label = forest(len(ids), pairs)
    at = np.flatnonzero(label != np.arange(len(ids)))
    if len(at):
        k = len(at)
        none = pa.nulls(k, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(k, np.int32)), none, none, none, pa.array(ids[at]), pa.array(ids[label[at]]),
             pa.nulls(k, pa.list_(pa.float64())), pa.nulls(k, pa.float64())], NAMES)


def _miss_rows(seen, window: int, agree: float, open_start: bool, open_end: bool):
    keys, ids = (np.concatenate(x) for x in zip(*seen))
    c = _log_miss(keys, window, agree, open_start, open_end)
    for lo in range(0, len(ids), 65536):
        k = len(ids[lo:lo + 65536])
        none = pa.nulls(k, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, 3, np.int32)), none, none, none, pa.array(ids[lo:lo + k]), pa.nulls(k, pa.int64()),
             pa.nulls(k, pa.list_(pa.float64())), pa.array(c[lo:lo + k])], NAMES)


def _edge_rows(part: int, kind: int, run, window: int):
    (p, dim), ids, m = run
    ids, m = (ids[:window], m[:window]) if kind == 1 else (ids[-window:], m[-window:])
    k = len(ids)
    full = lambda x: pa.array(np.full(k, x, np.int32))
    v = pa.ListArray.from_arrays(pa.array(np.arange(0, (k + 1) * dim, dim, dtype=np.int32)), pa.array(m.ravel()))
    yield pa.RecordBatch.from_arrays([full(kind), full(p), full(dim), full(part), pa.array(ids), pa.nulls(k, pa.int64()), v,
                                      pa.nulls(k, pa.float64())], NAMES)


def count_links(distinct: DataFrame, roots: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``id, links``: for every vector of a component, the rows (multiplicities
    counted) of the other vectors of its component at ``threshold`` or nearer.

    Exact: components over ``block`` rows are cut into chunks, and each two chunks are
    compared in a group of their own."""
    members = land(distinct.join(roots.withColumnRenamed("node", "id"), "id").select("root", "id", "n", "dim", "v"),
                   "embed-members")
    # only components over a block need cutting up: few rows, landed so that Spark sees their size
    big = members.groupBy("root").agg(F.count("*").alias("m")).where(F.col("m") > block)
    big = land(big.select("root", F.ceil(F.col("m") / block).cast("int").alias("chunks")), "embed-big")
    d = members.join(big, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    d = d.withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    d = d.select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "n", "dim", "v")
    # dealt by tile: a partitioning by component alone would satisfy the grouping too, and
    # put all tiles of a large component into one task
    d = d.repartition("root", "x", "y")

    def tile(keys, group):
        x, y = keys[1].as_py(), keys[2].as_py()
        m = _unit(_matrix(group.column("v").combine_chunks(), group.column("dim")[0].as_py()))
        own, ids, n = (group.column(c).to_numpy() for c in ("own", "id", "n"))
        a, b = np.flatnonzero(own == x), np.flatnonzero(own == y)
        near = m[a] @ m[b].T >= threshold
        if x == y:
            np.fill_diagonal(near, False)
            return pa.table({"id": ids[a], "links": near @ n[b]})
        return pa.table({"id": np.concatenate([ids[a], ids[b]]), "links": np.concatenate([near @ n[b], near.T @ n[a]])})
    return d.groupBy("root", "x", "y").applyInArrow(tile, "id long, links long").groupBy("id").agg(
        F.sum("links").alias("links"))


def dedup_embeddings(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                     window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    ``n_links`` counts the other rows at cosine ``threshold`` or nearer (in
    double precision), ``component_id`` is the smallest key reachable over
    links, ``kept`` says that this is the row's own. Vectors that are null,
    empty, zero or hold null or non-finite parts link with nothing; vectors of
    different length do not link. Equal vectors are always linked. Null keys
    take part, but are the smallest of nothing. An empty table gives an empty result.
    """
    distinct = land(distinct_vectors(rows, key, vector), "embed-distinct")
    roots = land(components(window_links(distinct, threshold, window, miss)), "embed-roots")
    links = count_links(distinct, roots, threshold)
    d = distinct.select("h", "g", "id", "low", "n").join(roots.withColumnRenamed("node", "id"), "id", "left")
    d = d.withColumn("root", F.coalesce("root", "id"))
    low = d.groupBy("root").agg(F.min("low").alias("component"))
    d = d.join(low, "root").join(links, "id", "left")
    d = land(d.select("h", "g", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), "embed-found")
    v = F.col(vector).cast("array<double>")
    mine = rows.select(F.col(key), F.when(usable(v), F.xxhash64(v)).alias("h"), F.when(usable(v), F.hash(v)).alias("g"))
    component = F.coalesce("component", F.col(key).cast("long"))
    out = mine.join(d, ["h", "g"], "left")
    release(roots)
    return out.select(key, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col(key) == component, F.lit(False)).alias("kept"))

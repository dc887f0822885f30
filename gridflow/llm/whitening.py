"""Embedding whitening by mixed-precision refinement.

The covariance of the distinct vectors is summed by Spark. Its eigenvectors are
found in float32, which is cheap and gives their places, and then corrected by
Ogita and Aishima's iteration (2018, 2019), which needs nothing but matrix products in
a higher precision and doubles the correct digits each time. Eigenvalues that lie too close
for a step to tell apart are a cluster: the covariance within the span of a cluster is
diagonalised by itself, shifted so that its small differences keep their digits.

Vectors are whole numbers, floor(scale * c) + offset, so counts and sums are exact. They are centred in two
steps, both before anything is multiplied: the nearest whole number to the mean, exactly,
and then the rest of the mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridflow.session import land, release

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 50)    # beyond this a scaled entry is no whole double: such vectors are dropped
SMALLEST = 1e-12            # share of the largest eigenvalue below which a component holds rounding noise only
ROUNDS = 60                 # bound on correction steps; a few are used
ROWS = 4096                 # vectors multiplied at once

HIGH = np.longdouble


# ---- eigenvectors -----------------------------------------------------------

def _clusters(e: np.ndarray, apart: float) -> list[np.ndarray]:
    """Groups of two or more indices whose sorted eigenvalues follow each other within ``apart``."""
    order = np.argsort(e)
    cut = np.flatnonzero(np.diff(e[order]) > apart) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def _split_cluster(a: np.ndarray, x: np.ndarray, e: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The vectors of a cluster, turned within their span to diagonalise ``a`` there."""
    own = x[:, group]
    shift = e[group].mean()
    inner = own.T @ (a @ own - shift * own)
    inner = (inner + inner.T) / 2
    size = np.abs(inner).max()
    if not size > 0:
        return own
    return own @ np.linalg.eigh((inner / size).astype(np.float64))[1].astype(HIGH)


def refined_eigenvectors(a: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), unit eigenvectors (columns) and correction steps of a symmetric matrix.

    ``start`` are approximate eigenvectors, those of ``a`` in float32 by default. Results are
    in ``HIGH`` precision. A step's correction is about the square of the one before; the
    iteration ends when corrections no longer fall.
    """
    a = np.asarray(a, HIGH)
    n = len(a)
    norm = np.abs(a).sum(1).max() if n else HIGH(0)
    if not norm > 0:
        return np.zeros(n, HIGH), np.eye(n, dtype=HIGH), 0
    a = a / norm
    x = (np.linalg.eigh(a.astype(np.float32))[1] if start is None else start).astype(HIGH)
    best, steps, split = None, 0, set()
    for steps in range(1, ROUNDS + 1):
        r = np.eye(n, dtype=HIGH) - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2      # so that the corrections of a pair add up to their overlap
        e = np.diag(s) / (1 - np.diag(r))
        # what this step cannot tell apart
        apart = 2 * (np.linalg.norm((s - np.diag(e)).astype(np.float64)) + np.linalg.norm(r.astype(np.float64)))
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > apart
        c = np.where(far, (s + e[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ c
        size = float(np.abs(c).max())
        groups = _clusters(e, apart)
        if best is not None and size >= best / 2 and all(frozenset(g.tolist()) in split for g in groups):
            break
        best = size if best is None else min(best, size)
        for g in groups:
            x[:, g] = _split_cluster(a, x, e, g)
            name = frozenset(g.tolist())
            if name not in split:        # turned vectors are corrected anew
                split.add(name)
                best = None
    x = x + x @ (np.eye(n, dtype=HIGH) - x.T @ x) / 2
    e = (x * (a @ x)).sum(0) * norm
    order = np.argsort(-e, kind="stable")
    return e[order], x[:, order], steps


# ---- covariance -------------------------------------------------------------

def whole_vectors(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``key, x``: floor(scale * c) of every entry (the offset is left out: it cancels);
    rows whose vector is null or empty, or holds null, non-finite or overlarge entries, are dropped."""
    d = rows.select(key, F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / scale))
    return d.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(fine, F.lit(False))).select(
        key, F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _matrices(batches, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of one length as whole-number matrices, with the rows they belong to."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            x = part.column(column)
            sizes = x.value_lengths().to_numpy()
            for dim in np.unique(sizes):
                own = part if (sizes == dim).all() else part.filter(pa.array(sizes == dim))
                yield own, own.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim)).astype(np.int64)


@dataclass
class Centre:
    """Of the distinct vectors of one length: their number, exact sums, and the mean as a whole number and a rest."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> np.ndarray:
        return np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, self.whole)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.whole, np.int64)).astype(np.float64) - self.rest


def centres(distinct: DataFrame) -> dict[int, Centre]:
    """``Centre`` of the vectors ``distinct(x)`` of each length, by length."""
    def run(batches):
        held: dict[int, list] = {}
        for _, x in _matrices(batches, 0):
            t = held.setdefault(x.shape[1], [0, np.zeros((2, x.shape[1]), np.int64)])
            t[0] += len(x)
            t[1] += np.stack([(x >> 20).sum(0), (x & 0xFFFFF).sum(0)])     # two halves: no sum overflows
        for dim, (n, t) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim + 1, dim, np.int32)), pa.array(np.arange(-1, dim, dtype=np.int32)),
                 pa.array([0, *t[0].tolist()], pa.int64()), pa.array([n, *t[1].tolist()], pa.int64())], ["dim", "at", "high", "low"])
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out: dict[int, Centre] = {}
    rows = distinct.select("x").mapInArrow(run, "dim int, at int, high long, low long").groupBy("dim", "at").agg(total("high"), total("low"))
    for r in sorted(rows.collect()):                  # a row per length and dimension
        value = (int(r["high"]) << 20) + int(r["low"])
        if r["at"] < 0:
            out[r["dim"]] = Centre(value, [])
        else:
            out[r["dim"]].sums.append(value)
    return out


def _products(distinct: DataFrame, project) -> dict[int, np.ndarray]:
    """By vector length, the sum over ``distinct(x)`` of the outer products of ``project(dim, x)`` rows."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for _, x in _matrices(batches, 0):
            dim = x.shape[1]
            y = project(dim, x)
            held[dim] = held[dim] + y.T @ y if dim in held else y.T @ y
        for dim, t in held.items():
            k = t.shape[1]
            yield from pa.Table.from_arrays(
                [pa.array(np.full(k * k, dim, np.int32)), pa.array(np.repeat(np.arange(k, dtype=np.int32), k)),
                 pa.array(np.tile(np.arange(k, dtype=np.int32), k)), pa.array(t.ravel())], ["dim", "i", "j", "v"]).to_batches(1 << 16)
    t = distinct.select("x").mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(
        F.sum("v").alias("v")).toArrow()                # dimension squared, whatever the number of vectors
    out = {}
    dims, i, j, v = (t[c].to_numpy() for c in ("dim", "i", "j", "v"))
    for dim in np.unique(dims):
        own = dims == dim
        k = int(i[own].max()) + 1
        m = np.zeros((k, k))
        m[i[own], j[own]] = v[own]
        out[int(dim)] = (m + m.T) / 2
    return out


@dataclass
class Whitening:
    """``matrix`` turns centred vectors into whitened components; ``explained`` is each one's share of the variance."""

    centre: Centre
    matrix: np.ndarray
    explained: np.ndarray
    eigenvalues: np.ndarray
    identity_error: float = 0.0


def fit_whitening(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """By vector length, the whitening of the distinct vectors ``distinct(x)`` (landed).

    The driver holds a covariance, dimension squared, and its eigenvectors for each
    length. Components without variance are left out.
    """
    at = centres(distinct)
    shared = distinct.sparkSession.sparkContext.broadcast(at)
    sums = _products(distinct, lambda dim, x: shared.value[dim].centred(x))
    out: dict[int, Whitening] = {}
    for dim, c in at.items():
        v = sums[dim].astype(HIGH) / c.n
        e, u, _ = refined_eigenvectors(v)
        keep = [i for i in range(min(components, dim)) if e[i] > SMALLEST * e[0]]
        out[dim] = Whitening(c, (u[:, keep] / np.sqrt(e[keep])).astype(np.float64), (e[keep] / np.trace(v)).astype(np.float64),
                             e[keep].astype(np.float64))
    fitted = distinct.sparkSession.sparkContext.broadcast(out)
    check = _products(distinct, lambda dim, x: _whitened(fitted.value[dim], x))
    for dim, w in out.items():
        k = w.matrix.shape[1]
        if k:
            w.identity_error = float(np.abs(check[dim] / w.centre.n - np.eye(k)).max())
    return out


def _whitened(w: Whitening, x: np.ndarray) -> np.ndarray:
    return w.centre.centred(x) @ w.matrix


def _deviations(c: Centre, x: np.ndarray) -> list[int | None]:
    """Sums over dimensions of (n x - S)², exact; null where that is beyond a long."""
    whole, rest = np.array(c.whole, np.int64), [s - w * c.n for s, w in zip(c.sums, c.whole)]
    y = x - whole
    widest = (int(np.abs(y).max(initial=0)) + 1) * c.n
    if widest * widest * len(rest) < 1 << 63:
        d = y * c.n - np.array(rest, np.int64)
        return (d * d).sum(1).tolist()
    exact = (sum((int(v) * c.n - r) ** 2 for v, r in zip(row, rest)) for row in y)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: up to
    ``components`` rows for every row of ``rows`` with a usable vector.

    The fit is on each distinct vector once, so copies weigh no more than
    one; every row is whitened. Vectors of different lengths are whitened each among
    those of their length. Vectors that are null, empty, or hold null, non-finite or overlarge
    entries (over 2^50 scaled) are dropped. Components whose variance is rounding noise are left out, so a
    single distinct vector, or an empty table, gives no rows. Repeated and null keys each give their rows. ``deviation``
    is null where it is beyond a long. The sign of a component is arbitrary, but the same in all rows.
    """
    d = land(whole_vectors(rows, key, vector, scale), "whiten-rows")
    distinct = land(d.groupBy("x").agg(F.count("*").alias("n")).select("x"), "whiten-distinct")
    fitted = fit_whitening(distinct, components)
    release(distinct)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b, x in _matrices(batches, 1):
            w = shared.value[x.shape[1]]
            k = w.matrix.shape[1]
            if not k:
                continue
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(at), w.centre.n)), pa.array(_deviations(w.centre, x), pa.int64()).take(pa.array(at)),
                 pa.array(_whitened(w, x).ravel()), pa.array(np.tile(w.explained, len(x))),
                 pa.array(np.full(len(at), w.identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return d.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, "
                             "identity_error double")

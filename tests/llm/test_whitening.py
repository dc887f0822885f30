"""Whitening: the eigen-solver on clustered spectra, exact counts, and the whole operator against NumPy."""

import math
import random

import numpy as np
import pytest

from gridflow.llm import queries, whitening
from gridflow.llm.whitening import HIGH, refined_eigenvectors

SF = "/root/testdata/sf0.001"


def turned(eigenvalues, seed=0):
    """A symmetric matrix with these eigenvalues, and its eigenvectors, in high precision."""
    n = len(eigenvalues)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0].astype(HIGH)
    for _ in range(6):
        q = q @ ((3 * np.eye(n) - q.T @ q) / 2)
    e = np.asarray(eigenvalues, HIGH)
    a = (q * e) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("eigenvalues", [
    np.arange(1, 65.), np.geomspace(1e-8, 1, 64), np.r_[5 + np.arange(10) * 1e-9, np.arange(1, 55) * .05],
    np.r_[5 + np.arange(6) * 1e-13, 4 + np.arange(4) * 1e-10, np.arange(1, 40) * .05], np.r_[np.ones(10) * 5, np.arange(1, 55) * .05],
    np.r_[np.ones(10), np.zeros(30)], np.ones(12), [3.0], [1, 1 + 1e-6, 1 + 2e-6, 1 + 1e-12, .5, .5 + 1e-8], np.r_[-2.0, 0, 7]])
def test_eigenvectors_are_right_beyond_double(eigenvalues):
    a, q = turned(eigenvalues)
    e, x, steps = refined_eigenvectors(a)
    size, want = float(np.abs(a).max()), np.sort(np.asarray(eigenvalues, HIGH))[::-1]
    assert steps < 12
    assert np.abs(a @ x - x * e).max() < 2e-17 * size
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-17
    assert np.abs(e - want).max() < 2e-17 * size * len(e)
    gaps = np.diff(want)
    if len(gaps) and -gaps.max() > 1e-14 * float(np.abs(want).max()):     # then every vector is determined
        order = np.argsort(-np.asarray(eigenvalues, HIGH), kind="stable")
        assert np.abs(np.abs((q[:, order] * x).sum(0)) - 1).max() < 1e-8


def test_float32_alone_would_not_do():
    a, _ = turned(np.r_[5 + np.arange(10) * 1e-9, np.arange(1, 55) * .05])
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    assert np.abs(x.T @ x - np.eye(64)).max() > 1e-9


def test_zero_matrix_and_poor_start():
    e, x, _ = refined_eigenvectors(np.zeros((3, 3)))
    assert not e.any() and (x == np.eye(3)).all()
    a, q = turned(np.arange(1, 9.))
    start = q.astype(np.float64) + 1e-3 * np.random.default_rng(2).standard_normal((8, 8))
    e, x, _ = refined_eigenvectors(a, start)
    assert np.abs(a @ x - x * e).max() < 1e-16


SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "clash", None) for i, v in vectors], SCHEMA)


def brute(vectors, components=16):
    """Rows by id; whitened up to sign."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in vectors}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = lambda v: np.array([float(c - t) for c, t in zip(v, [round(t / n) for t in s])]) - np.array(
        [(t - round(t / n) * n) / n for t in s])
    y = np.stack([centred(v) for v in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    keep = [k for k in range(min(components, len(e))) if e[k] > 1e-12 * e[0]]
    return {i: [(k + 1, n, sum((n * c - t) ** 2 for c, t in zip(v, s)), centred(v) @ u[:, k] / math.sqrt(e[k]), e[k] / e.sum())
                for k in keep] for i, v in x.items()}


def check(got, want):
    by_id, signs = {}, {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert by_id.keys() == want.keys()
    for i, rows in by_id.items():
        rows.sort(key=lambda r: r["component"])
        assert [(r["component"], r["n"], r["deviation"]) for r in rows] == [w[:3] for w in want[i]]
        for r, w in zip(rows, want[i]):
            assert abs(r["whitened"]) == pytest.approx(abs(w[3]), abs=1e-8)
            assert r["explained"] == pytest.approx(w[4], rel=1e-9)
            assert r["identity_error"] < 1e-9
            if abs(w[3]) > 1e-6:
                signs.setdefault(r["component"], set()).add(r["whitened"] * w[3] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whole_operator_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((400, 20)) * np.geomspace(1, .05, 20)).tolist()
    vectors = list(enumerate(base)) + [(1000 + i, base[7]) for i in range(200)]        # many copies weigh as one
    check(whitening.whiten(frame(spark, vectors).repartition(5)).collect(), brute(vectors))


def test_registered_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in rows
               if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    check(queries.QUERIES["op12_whitening"](spark, SF).collect(), brute(vectors))


def test_odd_vectors(spark):
    rng = random.Random(1)
    good = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(30)] + [(5, [.5, .25, 0.0]), (5, [.5, .25, 0.0])]
    pairs = [(100 + i, [float(i), 2.0]) for i in range(4)]                              # another length: one component
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 0.0]), (204, [1.0, float("inf"), 0.0]),
           (205, [1e300, 0.0, 0.0])]
    alone = [(300, [1.0] * 5), (301, [1.0] * 5)]                                        # one distinct vector: no variance
    got = whitening.whiten(frame(spark, good + pairs + bad + alone)).collect()
    assert {r["vec_id"] for r in got} == {*range(30), 100, 101, 102, 103}
    assert sum(r["vec_id"] == 5 for r in got) == 9                                     # three rows of three components
    check([r for r in got if r["vec_id"] >= 100], brute(pairs))
    assert {r["n"] for r in got if r["vec_id"] < 100} == {31}
    null_key = frame(spark, [(None, v) for _, v in good[:4]])
    assert [r["vec_id"] for r in whitening.whiten(null_key).collect()] == [None] * 12
    assert whitening.whiten(frame(spark, good).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, bad)).collect() == []


def test_deviation_is_exact_or_null(spark):
    far = [(0, [1e6, 0.0]), (1, [-1e6, 1.0]), (2, [3.0, 2.0]), (3, [1e6, 0.0])]
    check(whitening.whiten(frame(spark, far)).collect(), brute(far))
    huge = [(0, [1e9, 0.0]), (1, [-1e9, 1.0]), (2, [3.0, 2.0])]
    got = {(r["vec_id"], r["deviation"]) for r in whitening.whiten(frame(spark, huge)).collect()}
    n, x = 3, [(64 * 10**9, 0), (-64 * 10**9, 64), (192, 128)]
    s = [sum(c) for c in zip(*x)]
    exact = {i: sum((n * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}
    assert got == {(i, d if d < 2**63 else None) for i, d in exact.items()} and (0, None) in got

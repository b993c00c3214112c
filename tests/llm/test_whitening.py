import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossweave.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=16):
    """Whitening by a dense eigensolver over the distinct vectors."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    length = max(Counter(len(v) for _, v in rows).items(), key=lambda x: (x[1], x[0]))[0]
    rows = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in rows if len(v) == length]
    fit = np.array(sorted({x for _, x in rows}))
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    cov = np.cov(fit.T, bias=True).reshape(length, length)
    e, z = np.linalg.eigh(cov)
    e, z = e[::-1], z[:, ::-1]
    k = min(k, int((e > 1e-10 * e[0]).sum()))
    return rows, n, sums, e[:k], z[:, :k], np.trace(cov)


def check(got, rows, k=16):
    rows, n, sums, e, z, trace = plain(rows, k)
    assert len(got) == len(rows) * len(e)
    # The sign of each component is free, so compare what does not depend on it.
    want, seen = {}, {}
    for i, x in rows:
        w = (np.array(x) - np.array(sums) / n) @ z / np.sqrt(e)
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        want.setdefault(i, Counter())[dev] += 1
        for c in range(len(e)):
            seen.setdefault((i, c + 1), []).append(abs(w[c]))
    out = {}
    for r in got:
        assert r.n == n and abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-6
        out.setdefault((r.vec_id, r.component), []).append(abs(r.whitened))
    assert seen.keys() == out.keys()
    for key, values in seen.items():
        assert np.allclose(sorted(values), sorted(out[key]), rtol=1e-6, atol=1e-6)
    deviations = {}
    for r in got:
        if r.component == 1:
            deviations.setdefault(r.vec_id, Counter())[r.deviation] += 1
    assert deviations == want


def vectors(rng, n, d):
    scale = [1.3**j for j in range(d)]
    return [[rng.gauss(0, 1) * s for s in scale] for _ in range(n)]


def test_against_dense_solver(spark):
    rng = random.Random(3)
    vs = vectors(rng, 300, 20)
    rows = [*enumerate(vs), (5, vs[9]), (5, vs[9]), (None, vs[2]), *((1000 + i, vs[0]) for i in range(150))]
    rows += [(900, None), (901, []), (902, [None] * 20), (903, [float("nan")] * 20), (904, [1.0] * 19 + [float("inf")]), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("x", F.lit(1)).withColumn("c", F.lit("c"))
    check(wh.whiten(df).collect(), rows)


def test_more_tasks_than_one_merge_takes(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", 2)
    monkeypatch.setattr(wh, "BLOCK", 3)
    rows = list(enumerate(vectors(random.Random(4), 90, 6)))
    check(wh.whiten(spark.createDataFrame(rows, SCHEMA).repartition(9), 3).collect(), rows, 3)


def test_fewer_rows_than_dimensions(spark):
    rows = list(enumerate(vectors(random.Random(5), 5, 12)))
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4}
    check(got, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])] * 4, [(1, [])]])
def test_no_spread(spark, rows):
    assert wh.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_deviation_beyond_a_long(spark):
    rows = [(0, [0.0, 0.0]), (1, [1e9, 1.0]), (2, [2.0, 3e12])]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == {0, 1, 2} and all(r.deviation is None for r in got if r.vec_id == 2)


def solve(x, k=16):
    c = x - x.mean(0)
    r = np.linalg.qr(c, mode="r")
    r = np.concatenate([r, np.zeros((max(0, x.shape[1] - len(r)), x.shape[1]))])
    return (*wh.components(r, len(x), k), c.T @ c / len(x))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 12), st.integers(1, 30), st.integers(0, 3), st.integers(0, 10**6))
def test_solver_with_repeated_eigenvalues(d, n, most, seed):
    rng = random.Random(seed)
    e, z, trace, cov = solve(np.array([[rng.randint(0, most) for _ in range(d)] for _ in range(n)], float))
    w = np.linalg.eigvalsh(cov)[::-1]
    assert len(e) == min(16, int((w > 1e-10 * max(w[0], 1e-300)).sum()))
    assert np.allclose(e, w[: len(e)], rtol=1e-9) and np.allclose(trace, np.trace(cov))
    assert np.allclose(z @ z.T, np.eye(len(e)), atol=1e-8) and np.allclose(cov @ z.T, z.T * e, atol=1e-9 * max(w[0], 1))


@pytest.mark.parametrize("scale", [np.logspace(0, -8, 40), np.logspace(-8, 0, 40), np.ones(40)])
def test_graded_columns(scale):
    """Small singular values keep their relative accuracy, which a covariance would lose."""
    x = np.random.default_rng(1).standard_normal((400, 40))
    q = np.linalg.qr(x - x.mean(0))[0]
    e, z, _, _ = solve(q * scale, 40)
    assert np.allclose(np.sqrt(e * 400), np.sort(scale)[::-1], rtol=1e-7) and np.allclose(z @ z.T, np.eye(40), atol=1e-8)

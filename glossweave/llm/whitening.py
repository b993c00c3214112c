"""Embedding whitening by a bidiagonal qd solver.

Vectors become whole numbers, and the fit list is each distinct one once.  Tasks reduce the centred rows block by block
to a triangle (QR), the triangles meet in a tree of the same step, and only the last one, of dimension times dimension
entries, reaches the driver.  There Householder reflections make it bidiagonal, dqds finds the squares of its singular
values, and twisted factorisations give the right vectors, which are the components.  No covariance is ever formed, so the condition of
the data is not squared.  All other work stays in tasks.

Nulls: a null vector, or one with a null or non-finite entry, is dropped; a null vec_id stays and is returned.  An entry
too large for a long drops its row as well.  If lengths differ, the most frequent one (of several, the largest) counts and the other rows are
dropped; empty vectors have no components.  Repeated rows are all returned, but fitted once.  Ties: equal eigenvalues
get any orthonormal vectors of their space.  A component whose eigenvalue is zero to rounding is not returned, so a table of equal vectors,
like an empty one, gives no rows.  A deviation that does not fit a long is null.  Long vectors cost the driver their
length squared.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.scratch import materialise, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK = 4096
FAN_IN = 32
EPS = float(np.finfo(float).eps)
#: Relative gap below which eigenvalues count as one cluster.
CLUSTER = 1e-6


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = u B v.T with the diagonal a and the superdiagonal b of B; v has the right vectors."""
    m, d = np.array(r, float), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        norm = math.hypot(*x) if len(x) > 1 else 0.0
        if norm == 0 or not np.any(x[1:]):
            return None
        w = x.copy()
        w[0] += math.copysign(norm, x[0])
        return w, 2.0 / float(w @ w)

    for k in range(d):
        if h := reflector(m[k:, k]):
            w, t = h
            m[k:, k:] -= np.outer(t * w, w @ m[k:, k:])
        if k + 2 < d and (h := reflector(m[k, k + 1 :])):
            w, t = h
            m[k:, k + 1 :] -= np.outer(m[k:, k + 1 :] @ w, t * w)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ w, t * w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd step; None where the shift is above the smallest value."""
    qs, es, d = [], [], q[0] - shift
    for i, x in enumerate(e):
        if d < 0:
            return None
        top = d + x
        t = q[i + 1] / top if top else 0.0
        qs.append(top)
        es.append(x * t)
        d = d * t - shift
    if d < 0 or d != d:
        return None
    return [*qs, d], es


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal matrix, falling, each to high relative accuracy."""
    out: list[float] = []
    blocks = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        turns, wait = 0, False
        while len(q) > 1:
            tiny = EPS * EPS
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (base + min(q[i], q[i + 1]))), None)
            if cut is None and e[-1] <= EPS * tiny * (base + q[-1]):
                cut = len(e) - 1
            if cut is not None:
                if cut < len(e) - 1:
                    blocks.append((q[: cut + 1], e[:cut], base))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                else:
                    out.append(base + q.pop())
                    e.pop()
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            # The smaller eigenvalue of the last two rows bounds the smallest of all from above.
            x, y, z = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-1] * e[-1]
            half = (x + y) / 2
            shift = 0.0 if wait else max(0.0, (x * y - q[-2] * e[-1]) / (half + math.hypot((x - y) / 2, math.sqrt(q[-2] * e[-1]))))
            shift = min(shift, q[-1]) if z else 0.0
            while (done := _step(q, e, shift)) is None:
                shift = shift / 2 if shift > 1e-3 * q[-1] else 0.0
            q, e = done
            base += shift
            wait = turns % 8 == 7
            turns += 1
            if turns > 200 * (len(q) + 10):
                raise ArithmeticError("dqds does not converge")
        out.append(base + q[0])
    return np.sort(np.maximum(np.array(out), 0))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """The vector of L D L' at ``value`` from the twisted factorisation with the smallest pivot, and the step towards its own value."""
    n, tiny = len(d), np.finfo(float).tiny / EPS
    plus, s = np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        plus[i] = d[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    minus, gamma, p = np.zeros(n), np.zeros(n), d[-1] - value
    gamma[-1] = s[-1] + d[-1]
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p
        pivot = pivot if abs(pivot) > tiny else -tiny
        t = d[i] / pivot
        minus[i] = low[i] * t
        gamma[i] = s[i] + t * p
        p = p * t - value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -minus[i] * z[i]
    norm = float(np.linalg.norm(z))
    return z / norm, float(gamma[k] / norm**2)


def _cluster(t: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal vectors for eigenvalues that are (nearly) one, by inverse iteration and a Rayleigh quotient."""
    rng, n, found = np.random.default_rng(7), len(t), []
    scale = max(float(np.abs(t).max()), np.finfo(float).tiny)
    shifted = t - (values.mean() + 4 * EPS * scale) * np.eye(n)
    for _ in values:
        z = rng.standard_normal(n)
        for _ in range(4):
            for _ in range(2):
                for f in found:
                    z -= f * (f @ z)
            z = np.linalg.solve(shifted, z / np.linalg.norm(z))
            z /= np.linalg.norm(z)
        for _ in range(2):
            for f in found:
                z -= f * (f @ z)
            z /= np.linalg.norm(z)
        found.append(z)
    basis = np.stack(found, 1)
    _, turn = np.linalg.eigh(basis.T @ t @ basis)
    return basis @ turn[:, ::-1]


def components(r: np.ndarray, n: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, directions in rows, trace) of r.T @ r / n: at most ``wanted``, falling, none that is zero to rounding."""
    d = r.shape[1]
    top = float(np.abs(r).max(initial=0.0))
    if not top:
        return np.zeros(0), np.zeros((0, d)), 0.0
    a, b, v = bidiagonal(r / top)
    values = dqds(a, b)
    unit = top * top / n
    trace = float(values.sum()) * unit
    zero = (max(d, 100) * EPS) ** 2 * values[0]
    count = int((values[:wanted] > zero).sum())
    floor = EPS * float(np.abs(a).max())
    a = np.where(np.abs(a) > floor, a, floor)
    diag, low = a * a, b / a[:-1]
    tri = np.diag(diag) + np.diag(np.append(0, a[:-1] * low) * np.append(0, low * a[:-1])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    out, i = [], 0
    while i < count:
        j = i + 1
        while j < d and values[j - 1] - values[j] < CLUSTER * values[i]:
            j += 1
        if j == i + 1:
            value = float(values[i])
            for _ in range(4):
                z, move = _twisted(diag, low, value)
                if abs(move) <= 4 * EPS * value:
                    break
                value += move
            out.append(z[:, None])
        else:
            out.append(_cluster(tri, values[i:j]))
        i = j
    z = (v @ np.concatenate(out, 1))[:, :count]
    z = z / np.linalg.norm(z, axis=0)
    z = z * np.where(z[np.abs(z).argmax(0), np.arange(count)] < 0, -1.0, 1.0)
    return values[:count] * unit, z.T, trace


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: the rows that stay, each entry as floor(64 c) + 1000000, all of one length."""
    c = F.transform(F.col(vector_col).cast("array<double>"), lambda v: v * SCALE)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), c.alias("c")).where(
        F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0**62)))
    )
    rows = materialise(rows.select("vec_id", F.transform("c", lambda v: F.floor(v) + F.lit(SHIFT)).alias("x")), "whole")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0].d if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class _Centre:
    """Rows less the mean, from whole numbers and without rounding before the last step."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.base = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        away = x - self.base
        if len(x) and len(self.base) * (self.n * (int(np.abs(away).max()) + 1)) ** 2 < 2**63:
            return ((self.n * away - self.rest) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in away]
        return [v if v < 2**63 else None for v in exact]


def _fold(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if r is None else np.concatenate([r, block]), mode="r")


def triangle(fit: DataFrame, centre: _Centre, d: int) -> np.ndarray:
    """The triangle of the centred fit list: blocks in a task, then tasks in a tree."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), BLOCK):
                r = _fold(r, centre.rows(x[at : at + BLOCK]))
        if r is not None:
            yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        r = None
        for raw in rows["r"]:
            r = _fold(r, np.frombuffer(raw).reshape(-1, d))
        return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN_IN], "r": [r.tobytes()]})

    parts = materialise(fit.select("x").mapInArrow(reduce, "part long, r binary"), "triangles")
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = materialise(parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, "part long, r binary"), "triangles")
        most //= FAN_IN
    r = np.frombuffer(parts.first().r).reshape(-1, d)
    return r if len(r) == d else np.concatenate([r, np.zeros((d - len(r), d))])


def whiten(vectors: DataFrame, n_components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each remaining row and component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(vectors, id_col, vector_col)
    fit = materialise(rows.select("x").distinct(), "fit-list")
    sums = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    found = sorted(map(tuple, sums.collect()))  # one row a dimension
    if not found:
        return spark.createDataFrame([], schema)
    d, n = len(found), found[0][2]
    centre = _Centre(n, [int(s) for _, s, _ in found])
    values, directions, trace = components(triangle(fit, centre, d), n, n_components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    project = directions.T / np.sqrt(values)
    explained = values / trace

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = centre.rows(_matrix(batch.column(0))) @ project
            total += w.sum(0)
            square += w.T @ w
        both = np.concatenate([total, square.ravel()])
        yield pa.record_batch({"pos": pa.array(np.arange(len(both)), pa.int32()), "v": pa.array(both)})

    m = np.array([v for _, v in sorted(map(tuple, fit.select("x").mapInArrow(moments, "pos int, v double").groupBy("pos").agg(F.sum("v")).collect()))])
    mean = m[:k] / n
    error = float(np.abs(m[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            size = len(x)
            each = np.repeat(np.arange(size), k)
            yield pa.record_batch(
                {
                    "vec_id": batch.column(0).take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    "n": pa.array(np.full(size * k, n, np.int64)),
                    "deviation": pa.array(centre.deviation(x), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array((centre.rows(x) @ project).ravel()),
                    "explained": pa.array(np.tile(explained, size)),
                    "identity_error": pa.array(np.full(size * k, error)),
                }
            )

    return rows.select("vec_id", "x").mapInArrow(place, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))

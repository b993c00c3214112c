"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are training rows whose label is 1; unlabelled text is any other training text, with its
label, if it has one, unseen.  The class prior is estimated as the share of ones among the training labels.
The model is a logistic one over binned shape features of the text; its risk is
``prior * R_pos(+) + max(0, R_unl(-) - prior * R_pos(-))``, and where the second part falls below
zero the step undoes the overfit instead.

Training reads at most ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled rows, chosen by a hash
of the id; that is the only bound.  Every row is scored on its whole text.  No score depends on labels,
language, source or id, and extra columns pass through.  Texts of any length are read whole; ties of the hash that chooses
training rows go by id.  Null and empty texts get the score of a text without words.  With no positive
training row at all, every score is the prior (0.5 without labels).  Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm.kernels import BLOCK, byte_rows, sequence_hashes, word_hashes, word_spans
from glossweave.llm.scratch import table

MAX_POSITIVE = 12_000
MAX_UNLABELLED = 24_000
FOLDS = 5
THRESHOLD = 0.3
BINS = 12
MARKS = b"!*$%&#|@<>{}[]=_~^+\\/\"'()-:;,.?0123456789"
FEATURES = 14 + len(MARKS)


def features(b: np.ndarray) -> np.ndarray:
    """Shape of one text: shares of kinds of bytes, words and repeats."""
    f = np.zeros(FEATURES)
    n = len(b)
    if not n:
        return f
    start, end = word_spans(b)
    count = np.zeros(256, np.int64)
    for lo in range(0, n, BLOCK):
        count += np.bincount(b[lo : lo + BLOCK], minlength=256)
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    wide = count[128:].sum()
    f[0] = np.log1p(n)
    f[1] = upper / max(1, upper + lower)
    f[2] = digit / n
    f[3] = wide / n
    f[4] = (n - upper - lower - digit - wide - count[32]) / n
    f[5] = count[10] / n
    k = len(start)
    if k:
        w = word_hashes(b, True)
        width = end - start
        f[6] = np.log1p(k)
        f[7] = width.mean()
        f[8] = width.std()
        f[9] = len(np.unique(w)) / k
        f[10] = (width <= 2).mean()
        last = b[end - 1]
        f[11] = ((last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 128))).mean()
        first = b[start]
        f[12] = ((first >= 65) & (first <= 90)).mean()
        if k > 5:
            s = sequence_hashes(w, 5)
            f[13] = 1 - len(np.unique(s)) / len(s)
    f[14:] = [count[c] / max(1, k) for c in MARKS]
    return f


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([features(b) for b in byte_rows(column)]).reshape(-1, FEATURES)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Binned logistic regression trained on the non-negative positive-unlabelled risk."""

    def __init__(self, prior: float) -> None:
        self.prior, self.edges, self.weight = prior, None, None

    def _design(self, x: np.ndarray) -> np.ndarray:
        """For each feature, a soft step at each edge, and the feature's place among the edges."""
        out = []
        for j, e in enumerate(self.edges):
            if len(e):
                out.append(x[:, j : j + 1] > e[None, :])
        return np.concatenate([*out, np.ones((len(x), 1), bool)], axis=1).astype(np.float32)

    def fit(self, pos: np.ndarray, unl: np.ndarray, steps: int = 500, rate: float = 0.02) -> Model:
        if not len(pos) or not len(unl):
            return self
        both, decay = np.concatenate([pos, unl]), 1e-3 + 0.5 / len(pos)
        q = np.concatenate([[0.002, 0.005, 0.01, 0.02, 0.04], np.linspace(0.08, 0.92, BINS), [0.96, 0.98, 0.99, 0.995, 0.998]])
        self.edges = [np.unique(np.concatenate([np.quantile(c, q), [0.0]])) for c in both.T]
        self.edges = [e[(e < c.max()) & (e >= c.min())] for e, c in zip(self.edges, both.T, strict=True)]
        p, u = self._design(pos), self._design(unl)
        w = np.zeros(p.shape[1], np.float32)
        w[-1] = np.log(self.prior / (1 - self.prior))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
            up = p.T @ (sp - 1) / len(p)  # of the loss as positives
            down = p.T @ sp / len(p)  # of the positives' loss as negatives
            rest = u.T @ su / len(u)
            negative = -np.log1p(-np.minimum(su, 0.999999)).mean() + self.prior * np.log1p(-np.minimum(sp, 0.999999)).mean()
            g = self.prior * up + (rest - self.prior * down) if negative >= 0 else self.prior * down - rest
            g = g + decay * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = (w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.weight = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), self.prior)
        return _sigmoid((self._design(x) @ self.weight).astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on training folds only: positives from ``labels``, unlabelled rows from ``docs``."""
    doc_id = F.col("doc_id")
    known = labels.select(F.col("doc_id").cast("long"), "quality").where((fold_of(doc_id) != 0) & doc_id.isNotNull())
    got = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    model = Model(min(0.99, max(0.01, 0.5 if got is None else got)))
    positive = known.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(MAX_POSITIVE)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where((fold_of(doc_id) != 0) & doc_id.isNotNull()).distinct()
    unlabelled = ids.orderBy(F.xxhash64(doc_id, F.lit(1)), doc_id).limit(MAX_UNLABELLED)
    chosen = positive.withColumn("kind", F.lit(1)).unionByName(unlabelled.withColumn("kind", F.lit(0)))
    chosen = chosen.groupBy("doc_id").agg(F.max("kind").alias("pos"), F.min("kind").alias("low"))
    schema = "pos int, low int, f binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["pos", "low", "f"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("pos", "low", "text").mapInArrow(run, schema).toPandas()
    x = np.frombuffer(b"".join(rows["f"]), np.float64).reshape(-1, FEATURES)
    return model.fit(x[(rows["pos"] == 1).to_numpy()], x[(rows["low"] == 0).to_numpy()])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus quality_score and quality_predicted, a double and an int; a clash of names is a ValueError."""
    if {"quality_score", "quality_predicted"} & set(docs.columns):
        raise ValueError("docs must not have columns quality_score or quality_predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    names = [*docs.columns, "quality_score", "quality_predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.score(_matrix(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=names)

    schema = docs.select("*", F.lit(0.0).alias("quality_score"), F.lit(0).alias("quality_predicted")).schema
    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns as they are."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())  # no clash with the two names that score adds
    scored = score(plain, train(docs, labels, id_col, text_col), names[id_col], names[text_col])
    return scored.where("quality_predicted = 1").select(*[F.col(n).alias(c) for c, n in names.items()])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted")
    )

"""Gaussian mixture with full covariances, plain EM over one table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import batches


@dataclass(frozen=True)
class FullGaussian:
    """``pi`` (K), ``mu`` (K x D), ``cov`` (K x D x D)."""

    pi: np.ndarray
    mu: np.ndarray
    cov: np.ndarray

    def log_joint(self, y: np.ndarray) -> np.ndarray:
        out = np.empty((len(y), len(self.pi)))
        d = y.shape[1]
        for k, (p, m, c) in enumerate(zip(self.pi, self.mu, self.cov)):
            z = y - m
            _, logdet = np.linalg.slogdet(c)
            out[:, k] = math.log(p) - 0.5 * (d * math.log(2 * math.pi) + logdet + (z @ np.linalg.inv(c) * z).sum(axis=1))
        return out


def scale_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column mapped to [0, 1] by its smallest and largest value."""
    limits = df.agg(F.struct(*[f(c).alias(n + c) for c in columns for n, f in (("lo_", F.min), ("hi_", F.max))]).alias("s"))
    rows = df.withColumn("_s", limits.select("s").scalar())
    scaled = {c: F.try_divide(F.col(c) - F.col("_s")["lo_" + c], F.col("_s")["hi_" + c] - F.col("_s")["lo_" + c]) for c in columns}
    return rows.withColumns(scaled).drop("_s")


def responsibilities(df: DataFrame, model: FullGaussian, keys: list[str], column: str = "y") -> DataFrame:
    """Posterior ``uhat`` and log-likelihood ``ll`` of every row."""
    k = len(model.pi)
    d = model.mu.shape[1]

    def run(it):
        for batch in it:
            names = batch.schema.names
            j = model.log_joint(batches.matrix(batch.column(names.index(column)), d))
            top = j.max(axis=1, keepdims=True)
            ll = top[:, 0] + np.log(np.exp(j - top).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(names.index(c)) for c in keys], batches.list_array(np.exp(j - ll[:, None]).reshape(-1, k)), pa.array(ll)],
                names=[*keys, "uhat", "ll"],
            )

    kinds = dict(df.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keys] + ["uhat array<double>", "ll double"])
    return df.select(*keys, column).mapInArrow(run, schema)


def maximise(df: DataFrame, k: int, d: int, column: str = "y", weight: str = "uhat") -> FullGaussian:
    """M-step from weights: weighted counts, means and second moments in one pass.

    Every task returns K rows of 1 + D + D * D sums; moments are taken around
    zero, so scale the data first (``scale_columns``).
    """
    cols = [f"c{i}" for i in range(1 + d + d * d)]

    def run(it):
        total = np.zeros((k, len(cols)))
        for batch in it:
            names = batch.schema.names
            y = batches.matrix(batch.column(names.index(column)), d)
            u = batches.matrix(batch.column(names.index(weight)), k)
            z = np.concatenate([np.ones((len(y), 1)), y, (y[:, :, None] * y[:, None, :]).reshape(len(y), -1)], axis=1)
            total += u.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *[pa.array(total[:, i]) for i in range(len(cols))]], names=["k", *cols])

    parts = df.select(column, weight).mapInArrow(run, "k long, " + ", ".join(f"{c} double" for c in cols))
    sums = np.zeros((k, len(cols)))
    for r in parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in cols]).collect():
        sums[r["k"]] = [r[c] for c in cols]
    n = sums[:, 0]
    mu = sums[:, 1:1 + d] / n[:, None]
    second = sums[:, 1 + d:].reshape(k, d, d) / n[:, None, None]
    return FullGaussian(n / n.sum(), mu, second - mu[:, :, None] * mu[:, None, :])


def fit(df: DataFrame, model: FullGaussian, iterations: int, column: str = "y") -> tuple[FullGaussian, list[float]]:
    """EM for a number of iterations; the trace holds the log-likelihood before each M-step."""
    k, d = model.mu.shape
    trace = []
    for _ in range(iterations):
        rows = responsibilities(df.select(F.col(column).alias("y")), model, ["y"], "y")
        trace.append(float(rows.agg(F.sum("ll").alias("s")).first()["s"]))
        model = maximise(rows, k, d, "y")
    return model, trace


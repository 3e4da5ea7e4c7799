"""How well posteriors and directions predict labels and data."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import batches
from tessera.operators import labels
from tessera.operators.reduce import gram, sum_by_key

KINDS = ("hard", "average", "expected")

# Fixed value: +infinity counts as the largest single-precision number.
LARGEST = 3.4028234663852886e38


def unit_columns(v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return v / np.sqrt((v * v).sum(axis=0))


def harden(u: np.ndarray) -> np.ndarray:
    """Certain assignment to the most probable parcel (lowest index on ties)."""
    out = np.zeros_like(u)
    out[np.arange(len(u)), np.argmax(u, axis=1)] = 1.0
    return out


def cosine_error(
    rows: DataFrame, v: np.ndarray | Mapping[int, np.ndarray], kind: str = "expected", adjusted: bool = False
) -> DataFrame:
    """Cosine error per subject between data and predicted directions.

    ``rows``: ``subj_id, y, uhat``.  ``hard`` predicts the direction of the most
    probable parcel, ``expected`` the probability-weighted mean, ``average``
    that mean rescaled to unit length.  ``adjusted`` weighs locations by their
    squared length.  Missing locations do not count.  ``v`` may differ between
    the subjects of a cross-validation.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of cosine error {kind}")
    own = {s: unit_columns(d) for s, d in v.items()} if isinstance(v, Mapping) else None
    shape = next(iter(own.values())).shape if own is not None else v.shape
    shared = None if own is not None else unit_columns(v)

    def errors(y, u, vn):
        u = harden(u) if kind == "hard" else u
        with np.errstate(invalid="ignore", divide="ignore"):
            predicted = u @ vn.T
            if kind == "average":
                predicted = predicted / np.sqrt((predicted * predicted).sum(axis=1, keepdims=True))
            n2 = (y * y).sum(axis=1)
            n = np.sqrt(n2)
            fit = (predicted * y).sum(axis=1)
            if adjusted:
                return np.nan_to_num(np.column_stack([n2 - fit * n, n2]))
            error = 1 - fit / n
        return np.column_stack([np.nan_to_num(error), ~np.isnan(error)])

    def values(batch):
        names = batch.schema.names
        y = batches.matrix(batch.column(names.index("y")), shape[0])
        u = batches.matrix(batch.column(names.index("uhat")), shape[1])
        if own is None:
            return errors(y, u, shared)
        subj = batch.column(names.index("subj_id")).to_numpy()
        out = np.empty((len(y), 2))
        for s, mine in batches.groups(subj):
            out[mine] = errors(y[mine], u[mine], own[s])
        return out

    sums = sum_by_key(rows.select("subj_id", "y", "uhat"), "subj_id", ["num", "den"], values)
    return sums.select("subj_id", F.try_divide("num", "den").alias("cosine_error"))


def rmse(rows: DataFrame, v: np.ndarray, soft: bool = True) -> DataFrame:
    """Root mean squared distance to the direction scaled by the data's length."""
    vn = unit_columns(v)

    def values(batch):
        names = batch.schema.names
        y = batches.matrix(batch.column(names.index("y")), vn.shape[0])
        u = batches.matrix(batch.column(names.index("uhat")), vn.shape[1])
        u = u if soft else harden(u)
        n2 = (y * y).sum(axis=1, keepdims=True)
        dist = n2 - 2 * np.sqrt(n2) * (y @ vn) + n2 * (vn * vn).sum(axis=0)
        e = (u * dist).sum(axis=1)
        return np.column_stack([np.nan_to_num(e), ~np.isnan(e)])

    sums = sum_by_key(rows.select("y", "uhat"), None, ["num", "den"], values)
    return sums.select(F.sqrt(F.try_divide("num", "den")).alias("rmse"))


def adjusted_sse(rows: DataFrame, v: np.ndarray, adjusted: bool = True, soft: bool = True) -> DataFrame:
    """Mean squared distance to the prediction; adjusted: of unit data, weighted by length."""

    def values(batch):
        names = batch.schema.names
        y = batches.matrix(batch.column(names.index("y")), v.shape[0])
        u = batches.matrix(batch.column(names.index("uhat")), v.shape[1])
        u = u if soft else harden(u)
        size = np.ones((len(y), 1))
        if adjusted:
            size = np.sqrt((y * y).sum(axis=1, keepdims=True))
            with np.errstate(invalid="ignore", divide="ignore"):
                y = y / size
        sse = (y * y).sum(axis=1, keepdims=True) - 2 * (y @ v) + (v * v).sum(axis=0)
        return np.column_stack([(u * sse * size).sum(axis=1), np.ones(len(y))])

    sums = sum_by_key(rows.select("y", "uhat"), None, ["num", "den"], values)
    return sums.select((F.col("num") / F.col("den")).alias("sse"))


def mean_log_evidence(rows: DataFrame) -> DataFrame:
    """Mean over locations of log sum_k exp(ll_k) uhat_k."""
    value = A.let(
        F.array_max("ll"),
        lambda m: m + F.log(A.total(F.zip_with("ll", "uhat", lambda l, u: F.exp(l - m) * u))),
    )
    return rows.agg(F.avg(value).alias("logpy"))


def cross_entropy(rows: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """-sum p log q, with log 0 counted as 0."""
    term = A.total(F.zip_with(p, q, lambda x, y: x * F.when(y > 0, F.log(y)).otherwise(0.0)))
    return rows.agg((-F.sum(term)).alias("cross_entropy"))


def kl_divergence(rows: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """sum p log(p/q); p = 0 counts as 0, q = 0 as the largest finite number."""

    def term(x, y):
        ratio = F.when((x > 0) & (y > 0), F.log(x / y)).when((x > 0) & (y == 0), F.lit(LARGEST)).otherwise(0.0)
        return x * ratio

    return rows.agg(F.sum(A.total(F.zip_with(p, q, term))).alias("kl"))


def mean_abs_error(rows: DataFrame, u: str = "u", uhat: str = "uhat") -> DataFrame:
    """Mean absolute difference over locations and parcels."""
    d = F.zip_with(u, uhat, lambda x, y: F.abs(x - y))
    return rows.agg((F.sum(A.total(d)) / F.sum(F.size(d))).alias("u_abserr"))


def label_error(rows: DataFrame, k: int, expectation: bool = True) -> DataFrame:
    """Error of ``uhat`` against the true ``label``: expected, or share of wrong assignments."""
    if expectation:
        return mean_abs_error(rows.withColumn("u", A.one_hot(F.col("label"), k))).withColumnRenamed("u_abserr", "u_prederr")
    wrong = F.when(A.argmax(F.col("uhat")) != F.col("label"), 1.0).otherwise(0.0)
    return rows.agg(F.avg(wrong).alias("u_prederr"))


def bic(loglik: Column, n: Column, parameters: Column) -> Column:
    return -2 * loglik + F.log(n) * parameters


def relabelled_error(rows: DataFrame, k: int) -> float:
    """Smallest expected label error over all relabelings of the true labels.

    The error adds up over labels, so K x K sums and one assignment replace
    K! evaluations.
    """
    errors = A.let(
        A.total(F.transform("uhat", F.abs)), lambda s: F.transform("uhat", lambda u: F.abs(1 - u) + s - F.abs(u))
    )
    # The extra 1 counts the rows in the same pass.
    prepared = rows.select(A.one_hot(F.col("label"), k).alias("t"), F.concat(errors, F.array(F.lit(1.0))).alias("c"))
    sums = gram(prepared, "t", "c", k, k + 1)
    cost, n = sums[:, :k], sums[:, k].sum()
    names = labels.best_assignment(cost)
    return float(cost[np.arange(k), names].sum() / (n * k))


def matched_labels(rows: DataFrame, k: int) -> DataFrame:
    """Most probable parcels, renamed to agree best with ``label``; adds ``matched``."""
    hard = rows.withColumn("_h", A.argmax(F.col("uhat")).cast("int"))
    names = labels.relabeling(labels.contingency(hard, "_h", "label"), k)
    lookup = F.array(*[F.lit(int(x)) for x in names])
    return hard.withColumn("matched", lookup[F.col("_h")].cast("long")).drop("_h")

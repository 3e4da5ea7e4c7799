"""Aligning and comparing several solutions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import mixture
from tessera.operators.emissions import VonMisesFisher
from tessera.operators.labels import greedy_pairs
from tessera.operators.reduce import gram
from tessera.session import cut_lineage


def row_correlations(pairs: DataFrame, a: str, b: str, k: int) -> np.ndarray:
    """Correlation over locations of every row of one K x P matrix with every row of another.

    ``pairs`` has one row per location with the K values of both matrices.
    """
    # One gram matrix with a leading 1 gives all sums at once.
    one = F.array(F.lit(1.0))
    rows = pairs.select(F.concat(one, a, b).alias("x"))
    g = gram(rows, "x", "x", 2 * k + 1, 2 * k + 1)
    n, s = g[0, 0], g[0, 1:]
    cov = g[1:, 1:] - np.outer(s, s) / n
    var = np.diag(cov)
    with np.errstate(invalid="ignore", divide="ignore"):
        return cov[:k, k:] / np.sqrt(np.outer(var[:k], var[k:]))


def match_greedy(pairs: DataFrame, target: str, source: str, k: int) -> np.ndarray:
    """Source row for every target row, best correlation first."""
    out = np.empty(k, dtype=int)
    for i, j, _ in greedy_pairs(row_correlations(pairs, target, source, k)):
        out[i] = j
    return out


def consistency(cells: DataFrame, values: str, n_solutions: int, mean_over: Sequence[str] | None = None) -> np.ndarray:
    """Cosine similarity between flattened solutions.

    ``cells`` has one row per matrix cell with the value in every solution.
    ``mean_over=None`` keeps means; ``[]`` removes the mean of each solution;
    otherwise the mean within each group of these columns (row or column).
    """
    g = gram(cells, values, values, n_solutions, n_solutions)
    if mean_over is not None:
        sums = cells.groupBy(*mean_over).agg(
            F.sqrt(F.count(F.lit(1)).cast("double")).alias("r"),
            F.array(*A.sum_elements(F.col(values), n_solutions)).alias("s"),
        )
        scaled = sums.select(F.transform("s", lambda x: x / F.col("r")).alias("s"))
        g = g - gram(scaled, "s", "s", n_solutions, n_solutions)
    d = np.sqrt(np.diag(g))
    out = g / np.outer(d, d)
    np.fill_diagonal(out, 1.0)
    return out


def marginals(models: Sequence[mixture.Model]) -> DataFrame:
    """Marginal probabilities of several models, long over models."""
    out = None
    for i, m in enumerate(models):
        part = m.prior.marginal().select(F.lit(i).cast("long").alias("model_id"), "node_id", "pi")
        out = part if out is None else out.unionByName(part)
    return out


def emission_parameters(models: Sequence[mixture.Model], name: str) -> list[np.ndarray]:
    """One array per dataset, models stacked along the first axis."""
    n = len(models[0].emissions)
    return [np.stack([m.emissions[d].params()[name] for m in models]) for d in range(n)]


def align_models(models: Sequence[mixture.Model]) -> list[mixture.Model]:
    """Reorder the parcels of all models to agree with the first one."""
    k = models[0].prior.k
    target = models[0].prior.marginal().withColumnRenamed("pi", "a")
    out = [models[0]]
    for m in models[1:]:
        pairs = target.join(m.prior.marginal().withColumnRenamed("pi", "b"), "node_id")
        order = match_greedy(pairs, "a", "b", k)
        logpi = F.array(*[F.col("logpi")[int(j)] for j in order])
        prior = m.prior.with_table(m.prior.table.select("node_id", logpi.alias("logpi")))
        emissions = []
        for e in m.emissions:
            e2 = replace(e, v=e.v[:, order])
            if isinstance(e, VonMisesFisher) and e.per_parcel and np.ndim(e.kappa):
                e2 = replace(e2, kappa=np.asarray(e.kappa)[order])
            emissions.append(e2)
        out.append(replace(m, prior=prior, emissions=tuple(emissions)))
    return out


def best_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the rows of ``a`` of the largest product with a row of ``b``."""
    return float((a @ b.T).max(axis=1).mean())


def match_nearest(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """For every column of ``target`` the closest unused column of ``source``."""
    d = ((target[:, :, None] - source[:, None, :]) ** 2).sum(axis=0)
    out = np.empty(target.shape[1], dtype=int)
    for i, j, _ in greedy_pairs(-d):
        out[i] = j
    return out


def parameter_differences(truth: np.ndarray, history: Sequence[np.ndarray]) -> np.ndarray:
    """Mean absolute difference to the true parameters per iteration."""
    return np.array([np.abs(np.asarray(h) - truth).mean() for h in history])


def match_to_group(rows: DataFrame, directions: np.ndarray, by: str = "subj_id") -> DataFrame:
    """Mean over each subject's own directions ``v`` of the best cosine with any group direction."""
    products = [A.dot(F.col("v"), A.literal(directions[:, k])) for k in range(directions.shape[1])]
    best = F.greatest(*products)
    return rows.groupBy(by).agg(F.avg(best).alias("match"))


def two_means(values: DataFrame, group: str, value: str) -> DataFrame:
    """The best split of each group's values in two by squared distances to both means: ``group, cut, cost``.

    Values up to ``cut`` are the lower cluster.  Equal values are one weighted value, so the split is exact; a group
    of one value has no split (NULL).  Values are sorted over ranges of (group, value) and summed inside each range,
    what earlier ranges hold of a group is added, so no group meets in one task.
    """
    mean = values.groupBy(group).agg(F.avg(value).alias("_mean"), F.count(value).alias("_all"))
    each = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    centred = each.join(mean, group).withColumn("_x", F.col(value) - F.col("_mean"))
    parted = cut_lineage(centred.repartitionByRange(group, value).withColumn("_part", F.spark_partition_id()))
    sums = {"_c": F.col("_n"), "_s": F.col("_n") * F.col("_x"), "_q": F.col("_n") * F.col("_x") * F.col("_x")}
    per_range = parted.groupBy(group, "_part").agg(*[F.sum(e).alias(f"{c}r") for c, e in sums.items()])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_range.select(group, "_part", *[F.coalesce(F.sum(f"{c}r").over(before), F.lit(0)).alias(f"{c}b") for c in sums])
    inside = Window.partitionBy(group, "_part").orderBy(value)
    local = parted.select("*", *[F.sum(e).over(inside).alias(c) for c, e in sums.items()])
    upto = local.join(carry, [group, "_part"]).select(
        group, value, "_all", *[(F.col(c) + F.col(f"{c}b")).alias(c) for c in sums])
    total = per_range.groupBy(group).agg(F.sum("_sr").alias("_st"), F.sum("_qr").alias("_qt"))
    right = F.col("_all") - F.col("_c")
    s = F.col("_st") - F.col("_s")
    cost = F.when(right > 0, F.col("_q") - F.col("_s") * F.col("_s") / F.col("_c") + (F.col("_qt") - F.col("_q")) - s * s / right)
    best = upto.join(total, group).withColumn("cost", cost).where("cost IS NOT NULL").groupBy(group).agg(
        F.min(F.struct("cost", F.col(value).alias("cut"))).alias("b"))
    return mean.select(group).join(best, group, "left").select(group, "b.cut", "b.cost")


def trim_starts(starts: DataFrame, model: str = "model", start: str = "start", value: str = "value") -> DataFrame:
    """The starts that ended in no local minimum: in the lower of two clusters of every model's values (errors).

    Returns the rows of ``starts`` of those.  A start without a value in one of its rows does not stay.
    """
    cuts = two_means(starts, model, value)
    low = F.col(value).isNotNull() & (F.col("cut").isNull() | (F.col(value) <= F.col("cut")))
    kept = starts.join(cuts, model).groupBy(start).agg(F.min(low.cast("int")).alias("_low")).where("_low = 1")
    return starts.join(kept.select(start), start, "left_semi")

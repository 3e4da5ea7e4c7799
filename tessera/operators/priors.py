"""Independent arrangement priors, with or without a hemisphere layout."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import randoms

# Fixed value: log(0) becomes the most negative single-precision number.
LOG_ZERO = -3.4028234663852886e38
# Fixed value: added to every probability until none is zero.
PROB_EPSILON = 1e-8


@dataclass(frozen=True)
class Layout:
    """How locations map to the nodes of a prior that treats hemispheres jointly.

    ``table`` has ``vox_id, node_id, side`` (0 left, 1 right); a midline
    location appears on both sides.  With ``same_parcels`` both sides share all
    parcels; otherwise the left side owns the first half of the parcels and
    the right side the second half.
    """

    table: DataFrame
    same_parcels: bool = False

    @classmethod
    def symmetric(cls, pairs: DataFrame, same_parcels: bool = False) -> Layout:
        """``pairs``: ``node_id, left_vox, right_vox`` (equal on the midline; NULL where a side has no location)."""
        sides = F.array(
            F.struct(F.col("left_vox").alias("vox_id"), F.lit(0).alias("side")),
            F.struct(F.col("right_vox").alias("vox_id"), F.lit(1).alias("side")),
        )
        table = pairs.select("node_id", F.explode(sides).alias("s")).select("s.vox_id", "node_id", "s.side")
        return cls(table.where("vox_id is not null"), same_parcels)

    @classmethod
    def separate(cls, sides: DataFrame) -> Layout:
        """``sides``: ``vox_id, side`` with -1 left, 0 midline, 1 right."""
        both = F.when(F.col("side") < 0, F.array(F.lit(0))).when(
            F.col("side") > 0, F.array(F.lit(1))
        ).otherwise(F.array(F.lit(0), F.lit(1)))
        return cls(sides.select("vox_id", F.col("vox_id").alias("node_id"), F.explode(both).alias("side")))


@dataclass(frozen=True)
class IndependentPrior:
    """Every node draws its parcel from its own (or one common) distribution.

    ``flat`` holds K log-probabilities for all nodes; ``table`` (``node_id,
    logpi``) replaces it when the prior is spatially specific.  A prior can
    have millions of nodes, so the table is never collected.
    """

    k: int
    flat: np.ndarray | None = None
    table: DataFrame | None = None
    spatial: bool = True
    drop_last: bool = False
    layout: Layout | None = None

    @property
    def start(self) -> np.ndarray:
        return np.zeros(self.k) if self.flat is None else np.asarray(self.flat, dtype=float)

    @property
    def k_full(self) -> int:
        halves = self.layout is not None and not self.layout.same_parcels
        return 2 * self.k if halves else self.k

    def with_table(self, table: DataFrame) -> IndependentPrior:
        return replace(self, table=table)

    def randomised(self, nodes: DataFrame, seed) -> IndependentPrior:
        """Standard normal log-probabilities, centred over parcels."""
        if not self.spatial:
            z = np.random.default_rng(seed).standard_normal(self.k)
            return replace(self, flat=z - z.mean(), table=None)
        draws = F.array(*[randoms.normal(seed, F.col("node_id"), F.lit(k)) for k in range(self.k)])
        centred = A.let(draws, lambda d: A.let(A.total(d) / self.k, lambda m: F.transform(d, lambda x: x - m)))
        return self.with_table(nodes.select("node_id", centred.alias("logpi")))

    def marginal(self, nodes: DataFrame | None = None) -> DataFrame:
        """Marginal probability of every node: the softmax of its prior.  A flat prior is given its ``nodes``."""
        if self.table is None:
            if nodes is None:
                raise ValueError("a flat prior has no nodes of its own: pass them")
            logpi = F.array(*[F.lit(float(x)) for x in self.start])
            return nodes.select("node_id", A.softmax(logpi).alias("pi"))
        return self.table.select("node_id", A.softmax(F.col("logpi")).alias("pi"))

    def marginal_full(self, nodes: DataFrame | None = None) -> DataFrame:
        """Marginal probability per location and full set of parcels."""
        if self.table is None and nodes is None and self.layout is not None:
            nodes = self.layout.table.select("node_id").distinct()
        if self.layout is None:
            return self.marginal(nodes).withColumnRenamed("node_id", "vox_id")
        return spread(self.marginal(nodes).withColumnRenamed("pi", "u"), self.layout, self.k).withColumnRenamed("u", "pi")


def log_prob(p: Column) -> Column:
    """log with zero mapped to a finite floor, as ln(0) is NULL in Spark."""
    return F.when(p > 0, F.log(p)).otherwise(F.lit(LOG_ZERO))


def drop_redundant(logpi: Column) -> Column:
    """Express every log-probability relative to the last parcel."""
    return A.let(F.element_at(logpi, -1), lambda last: F.transform(logpi, lambda x: x - last))


def prior_from_posterior(posterior: DataFrame, k: int, spatial: bool = True, drop_last: bool = False) -> DataFrame:
    """M-step: log of the mean posterior over subjects (and locations if flat).

    K averages per node with map-side combine; a node with many subjects never
    sits in one task.
    """
    by = ["vox_id"] if spatial else []
    mean = posterior.groupBy(*by).agg(*[F.avg(F.col("uhat")[i]).alias(f"p{i}") for i in range(k)])
    logpi = F.array(*[log_prob(F.col(f"p{i}")) for i in range(k)])
    return mean.select(*by, (drop_redundant(logpi) if drop_last else logpi).alias("logpi"))


def clean_probabilities(prob: DataFrame, k: int, by: str = "vox_id") -> DataFrame:
    """Prior from given probabilities: missing values become uniform, zeros positive.

    If any probability of any location is zero, a small number is added to
    *all* probabilities, as often as needed until none is zero.
    """
    filled = prob.select(by, F.transform("prob", lambda x: F.coalesce(x, F.lit(1.0 / k))).alias("p"))
    lowest = filled.agg(F.min(F.array_min("p")).alias("m")).scalar()
    shifted = filled.withColumn("_add", F.when(lowest > 0, 0.0).otherwise(F.lit(PROB_EPSILON)))
    return shifted.select(by, F.transform("p", lambda x: F.log(x + F.col("_add"))).alias("logpi"))


def halve_paired(logpi: DataFrame, layout: Layout, k: int) -> DataFrame:
    """Node prior of a symmetric model from log-probabilities of its locations.

    Both sides are added; where a node has two different locations the sum is
    halved again, on the midline it is kept.
    """
    parts = F.slice("logpi", F.col("side") * k + 1, k)
    if layout.same_parcels:
        parts = F.col("logpi")
    rows = logpi.join(layout.table, "vox_id").select("node_id", "vox_id", parts.alias("part"))
    sums = [F.sum(F.col("part")[i]) for i in range(k)]
    both = rows.groupBy("node_id").agg(F.array(*sums).alias("s"), (F.min("vox_id") == F.max("vox_id")).alias("mid"))
    return both.select("node_id", F.when(F.col("mid"), F.col("s")).otherwise(A.scale(F.col("s"), F.lit(0.5))).alias("logpi"))


def gather(scores: DataFrame, layout: Layout, k: int) -> DataFrame:
    """Log-likelihoods per location to log-likelihoods per node (sum of both sides)."""
    part = F.col("ll") if layout.same_parcels else F.slice("ll", F.col("side") * k + 1, k)
    rows = scores.join(layout.table, "vox_id").select("subj_id", "node_id", part.alias("part"))
    return rows.groupBy("subj_id", "node_id").agg(F.array(*A.sum_elements(F.col("part"), k)).alias("ll"))


def spread(nodes: DataFrame, layout: Layout, k: int) -> DataFrame:
    """Node probabilities ``u`` back to locations, renormalised over all parcels.

    With distinct parcels a left location fills the first half, a right one
    the second, and a midline location both halves equally.
    """
    others = [c for c in nodes.columns if c not in ("node_id", "u")]
    if layout.same_parcels:
        where = layout.table.select("vox_id", "node_id").distinct()
        return nodes.join(where, "node_id").select(*others, "vox_id", "u")
    sides = layout.table.groupBy("vox_id", "node_id").agg(
        F.max(1 - F.col("side")).alias("left"), F.max("side").alias("right")
    )
    rows = nodes.join(sides, "node_id")
    share = F.col("left") + F.col("right")
    full = F.concat(
        F.transform("u", lambda x: x * F.col("left") / share), F.transform("u", lambda x: x * F.col("right") / share)
    )
    return rows.select(*others, "vox_id", full.alias("u"))


def smooth_prior(distances: DataFrame, theta: float, drop_last: bool = False) -> DataFrame:
    """Prior that decays with the squared distance to K centroids.

    ``distances`` holds ``node_id, d2`` with K squared distances.
    """
    logpi = A.log_softmax(F.transform("d2", lambda d: -d / (2 * theta)))  # finite however far the centroids
    return distances.select("node_id", (drop_redundant(logpi) if drop_last else logpi).alias("logpi"))


def uniform_flat(k: int) -> np.ndarray:
    return np.full(k, -math.log(k))


def build_prior(prob: DataFrame, k: int, kind: str = "prob", layout: Layout | None = None) -> IndependentPrior:
    """Independent prior from given values per location (``vox_id, prob`` or ``vox_id, logpi``).

    ``kind="prob"`` cleans probabilities first, ``"logpi"`` takes logarithms as
    they are.  With a layout the values of paired locations are combined.
    """
    if kind not in ("prob", "logpi"):
        raise ValueError(f"unknown kind of prior {kind}")
    logpi = clean_probabilities(prob, k) if kind == "prob" else prob
    if layout is None:
        return IndependentPrior(k, table=logpi.withColumnRenamed("vox_id", "node_id"))
    k_node = k if layout.same_parcels else k // 2
    return IndependentPrior(k_node, table=halve_paired(logpi, layout, k_node), layout=layout)

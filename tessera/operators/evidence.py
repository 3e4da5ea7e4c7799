"""From raw observations to normalised evidence.

Evidence is one row per (subject, location): the sum of the unit-length
response vectors of all complete partitions, and how many there were.
Reducing N observations to M conditions and J partitions to one vector happens
once, before any iteration.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import batches
from tessera.operators import neighbours

# Densities that differ by no more differ by rounding only.
SAME_DENSITY = 1e-12
WEIGHTINGS = (
    "length", "length_sum2P", "lsquare", "lsquare_sum2P", "lsquare_sum2PJ",
    "length_normalized", "ones",
)


def design_matrix(conditions: Sequence, positive: bool = False) -> np.ndarray:
    """Indicator matrix with one column per sorted distinct condition.

    With ``positive`` conditions at or below zero get no column, so their rows
    are all zero.
    """
    c = np.asarray(conditions)
    levels = np.unique(c)
    if positive:
        levels = levels[levels > 0]
    return (c[:, None] == levels[None, :]).astype(float)


def indicator(df: DataFrame, column: str, levels: Sequence, prefix: str = "x", positive: bool = False) -> DataFrame:
    """Indicator columns ``x0, x1, ...`` for the given sorted levels of a column."""
    keep = [v for v in levels if not positive or v > 0]
    return df.select("*", *[
        F.when(F.col(column) == F.lit(v), 1.0).otherwise(0.0).alias(f"{prefix}{i}") for i, v in enumerate(keep)
    ])


# ---------------------------------------------------------------- wide input


def project(observations: DataFrame, x: np.ndarray | None = None, parts: Sequence | None = None) -> DataFrame:
    """Regress each observation vector on the design and normalise it.

    ``observations`` holds ``subj_id, vox_id, y`` with the N observations of a
    location in ``y``; ``x`` is N x M (identity if None), ``parts`` the
    partition of each observation (None: no partitions).  Works row by row in
    Arrow batches, so nothing is shuffled.

    With partitions a location counts only the partitions whose observations
    are all present; a zero-length vector counts but adds nothing.  Without
    partitions a zero-length vector counts as present while its direction,
    hence its likelihood, stays missing.
    """
    solver = _regressors(x, parts)

    def run(batches_in):
        for batch in batches_in:
            if not batch.num_rows:
                continue
            n_obs = sum(len(rows) for rows, _ in solver) if solver else None
            y = batches.matrix(batch.column("y"), n_obs or _width(batch.column("y")))
            evidence, count = _normalise(y, solver, parts is not None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("subj_id"), batch.column("vox_id"), pa.array(count), batches.list_array(evidence)],
                names=["subj_id", "vox_id", "num_part", "y"],
            )

    source = observations.select(
        F.col("subj_id").cast("long").alias("subj_id"), F.col("vox_id").cast("long").alias("vox_id"),
        A.as_double(F.col("y")).alias("y"),
    )
    return source.mapInArrow(run, "subj_id long, vox_id long, num_part double, y array<double>")


def _width(column: pa.Array) -> int:
    lengths = column.value_lengths().drop_null()
    return lengths[0].as_py() if len(lengths) else 0


def _regressors(x, parts):
    """(row indices, pseudo-inverse) per partition; empty when the data pass through."""
    if x is None and parts is None:
        return []
    if x is None:
        x = np.eye(len(parts))
    x = np.asarray(x, dtype=float)
    if parts is None:
        return [(np.arange(x.shape[0]), np.linalg.pinv(x))]
    p = np.asarray(parts)
    if len(p) != x.shape[0]:
        raise ValueError("one partition per row of the design matrix is needed")
    return [(np.flatnonzero(p == j), np.linalg.pinv(x[p == j])) for j in np.unique(p)]


def _normalise(y, solver, partitioned):
    """(summed unit vectors, number of partitions) for a batch of rows."""
    vectors = [y[:, rows] @ pinv.T for rows, pinv in solver] if solver else [y]
    lengths = [np.sqrt((v * v).sum(axis=1)) for v in vectors]
    count = np.sum([~np.isnan(length) for length in lengths], axis=0).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        units = [v / length[:, None] for v, length in zip(vectors, lengths)]
    if not partitioned:
        return units[0], count
    return np.nansum(units, axis=0), count


# ---------------------------------------------------------------- long input


def partition_vectors(cells: DataFrame, conditions: Sequence) -> DataFrame:
    """Mean response per condition of every (subject, location, partition).

    ``cells`` is long: ``subj_id, vox_id, part_id, cond_id, value``.  Averaging
    repeated observations is the least-squares solution for an indicator
    design.  A vector with a missing condition keeps a NULL element; a
    condition outside the list is an error.
    """
    cells = cells.withColumn("cond_id", A.known(F.col("cond_id"), conditions, "unknown condition"))
    means = [F.avg(F.when(F.col("cond_id") == F.lit(c), F.col("value"))) for c in conditions]
    return cells.groupBy("subj_id", "vox_id", "part_id").agg(F.array(*means).alias("y"))


def collapse(vectors: DataFrame, width: int, weight: str | None = None) -> DataFrame:
    """Sum the (weighted) unit vectors of the complete partitions of each location.

    Weights of incomplete partitions still add to ``num_part``, as they were
    given; unweighted, only complete partitions count.
    """
    complete = ~A.has_missing(F.col("y"))
    w = F.col(weight) if weight else F.when(complete, 1.0).otherwise(0.0)
    rows = vectors.select(
        "subj_id", "vox_id", w.alias("_w"), F.when(complete, A.unit(F.col("y"))).alias("_u"),
    )
    sums = [F.coalesce(F.sum(F.col("_u")[m] * F.col("_w")), F.lit(0.0)) for m in range(width)]
    return rows.groupBy("subj_id", "vox_id").agg(F.sum("_w").alias("num_part"), F.array(*sums).alias("y"))


def from_cells(cells: DataFrame, conditions: Sequence, partitions: Sequence | None = None) -> DataFrame:
    """Partitioned evidence from long observations: one row per partition first, then collapsed.

    Every partition of the data counts.  Conditions must be among ``conditions``, partitions among ``partitions`` if
    those are given; others are an error.
    """
    if partitions is not None:
        cells = cells.withColumn("part_id", A.known(F.col("part_id"), partitions, "unknown partition"))
    return collapse(partition_vectors(cells, conditions), len(conditions))


def from_cells_unpartitioned(cells: DataFrame, conditions: Sequence) -> DataFrame:
    """Evidence of a single partition: the unit vector, or missing."""
    means = [F.avg(F.when(F.col("cond_id") == F.lit(c), F.col("value"))) for c in conditions]
    mean = cells.groupBy("subj_id", "vox_id").agg(F.array(*means).alias("y"))
    missing = A.has_missing(F.col("y"))
    return mean.select(
        "subj_id", "vox_id", F.when(missing, 0.0).otherwise(1.0).alias("num_part"),
        F.when(missing, F.array_repeat(F.lit(None).cast("double"), len(conditions)))
        .otherwise(A.unit(F.col("y"))).alias("y"),
    )


# ---------------------------------------------------------------- weights


def add_weights(
    vectors: DataFrame, weighting: str, partitions: int, locations: int | DataFrame, subjects: int | None = None
) -> DataFrame:
    """Append the weight ``w`` of each (subject, location, partition) vector.

    ``locations`` is the number of locations of every one of ``subjects``
    subjects, or a table of them (``subj_id, locations``) where they differ;
    a vector that is absent or incomplete has length zero.  Where all
    lengths of a normalised group are zero, no weight is given (NULL).
    """
    if weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting}")
    length = F.when(A.has_missing(F.col("y")), 0.0).otherwise(A.norm(F.col("y")))
    rows = vectors.withColumn("_d", length)
    if weighting == "length":
        rows = rows.withColumn("w", F.col("_d"))
    elif weighting == "lsquare":
        rows = rows.withColumn("w", F.col("_d") * F.col("_d"))
    elif weighting == "ones":
        rows = rows.withColumn("w", F.lit(1.0))
    else:
        by = [] if weighting == "lsquare_sum2PJ" else ["subj_id", "part_id"]
        if not by:
            each = (F.lit(locations * subjects) if isinstance(locations, int)
                    else locations.agg(F.sum("locations").alias("n")).scalar())
            size = each * partitions
        elif isinstance(locations, int):
            size = F.lit(locations)
        else:
            rows = rows.join(locations.select("subj_id", F.col("locations").alias("_size")), "subj_id", "left")
            size = A.required(F.col("_size"), "subject without a number of locations")
        base = F.col("_d") if weighting in ("length_sum2P", "length_normalized") else F.col("_d") * F.col("_d")
        rows = rows.withColumn("_b", base)
        # Totals are aggregated with map-side combine and joined back: a window
        # would pull a whole partition of the data into one task.
        totals = rows.groupBy(*by).agg(
            F.sum("_b").alias("_sum"), F.max("_b").alias("_max"), F.min("_b").alias("_min"),
        ) if not by else rows.groupBy(*by).agg(
            F.sum("_b").alias("_sum"), F.max("_b").alias("_max"),
            F.when(F.count(F.lit(1)) < F.max(size), F.least(F.lit(0.0), F.min("_b"))).otherwise(F.min("_b")).alias("_min"),
        )
        if by:
            rows = rows.join(totals, by)
        else:
            rows = rows.withColumn("_sum", totals.select("_sum").scalar())
        if weighting == "length_normalized":
            w = F.try_divide(F.col("_b") - F.col("_min"), F.col("_max") - F.col("_min"))
        else:
            w = F.try_divide(F.col("_b") * size.cast("double"), F.col("_sum"))
        rows = rows.withColumn("w", w).drop("_b", "_sum", "_max", "_min", "_size")
    return rows.drop("_d")


def add_density_weights(
    vectors: DataFrame, partitions: int, locations: int | DataFrame, q: int = 20, subjects: int | None = None
) -> DataFrame:
    """Append the weight ``w``: the length scaled to [0, 1] plus the density scaled to [0, 1], both over the locations of
    a subject and partition.

    The density of a location is the mean cosine of its ``q`` nearest neighbours there.  A vector that is incomplete or
    has no neighbour gets no weight (NULL), and neither does any of a group whose densities are equal within SAME_DENSITY.
    """
    by = ["subj_id", "part_id"]
    weighted = add_weights(vectors, "length_normalized", partitions, locations, subjects)
    density = neighbours.cosine_density(vectors, q, group=by)
    scale = density.groupBy(*by).agg(F.min("density").alias("_low"), F.max("density").alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span > SAME_DENSITY, (F.col("density") - F.col("_low")) / span)
    rows = density.join(scale, by).select(*by, "vox_id", scaled.alias("_dense"))
    return weighted.join(rows, [*by, "vox_id"], "left").withColumn("w", F.col("w") + F.col("_dense")).drop("_dense")


# ---------------------------------------------------------------- sessions


def split_sessions(cells: DataFrame, session: str, join: bool = False, ignore_partitions: bool = False) -> DataFrame:
    """Give every session its own ``dataset_id``, or keep one joint dataset.

    Subjects keep their ids in every session.  Joined sessions may also drop
    their partitions, which turns all repeats into one long observation.
    """
    if join:
        out = cells.withColumn("dataset_id", F.lit(0))
        return out.withColumn("part_id", F.lit(1)) if ignore_partitions else out
    # One sorted array of the session names; its length is the number of sessions.
    names = cells.agg(F.array_sort(F.collect_set(session)).alias("names")).scalar()
    return cells.withColumn("dataset_id", F.array_position(names, F.col(session)).cast("int") - 1)

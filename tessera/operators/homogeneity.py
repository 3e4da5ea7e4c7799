"""Similarity of the data inside parcels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import batches

# Locations per side of a block of pairs; a task holds two such sides and forms STRIP rows of their pairs at a time. A parcel
# is cut into smaller blocks only until there are SPLIT of them: a location is sent once for every block of its parcel.
BLOCK, STRIP, SPLIT = 8192, 256, 8


def complete(rows: DataFrame) -> DataFrame:
    """Only locations with all observations and a label."""
    return rows.where(~A.has_missing(F.col("y")) & F.col("label").isNotNull())


def _standardised(rows: DataFrame) -> DataFrame:
    """Centre each location's data and scale it to unit length (NULLs if constant)."""
    centred = A.let(
        A.let(A.total(F.col("y")) / F.size("y"), lambda m: F.transform("y", lambda x: x - m)), A.unit
    )
    return rows.withColumn("z", centred)


def homogeneity(rows: DataFrame, width: int, by: str = "subj_id") -> DataFrame:
    """Mean correlation between the locations of each parcel.

    ``rows``: ``by, y, label``.  The correlations of all pairs add up to the
    squared length of the summed standardised vectors, minus the diagonal, so
    one vector sum per parcel replaces a matrix of all pairs.  A location with
    constant data has no correlations but still counts in the size.
    """
    z = _standardised(complete(rows))
    sums = z.groupBy(by, "label").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count(F.col("z")[0]).cast("double").alias("valid"),
        F.array(*[F.coalesce(F.sum(F.col("z")[m]), F.lit(0.0)) for m in range(width)]).alias("s"),
    )
    value = (A.sum_squares(F.col("s")) - F.col("valid")) / (F.col("n") * (F.col("n") - 1))
    return sums.select(by, "label", "n", F.when(F.col("n") < 2, 1.0).otherwise(value).alias("homogeneity"))


def blocks_of(n: Column, block: int) -> Column:
    """Blocks of a parcel with ``n`` locations."""
    parts = lambda side: F.ceil(n / F.lit(side)).cast("int")
    return F.greatest(parts(BLOCK), F.least(parts(block), F.lit(SPLIT)))


def homogeneity_fisher(rows: DataFrame, by: str = "subj_id", block: int = BLOCK) -> DataFrame:
    """Mean Fisher-transformed correlation between the locations of each parcel.

    The transform is not linear, so every pair has to be looked at.  Parcels
    are cut into blocks of ``block`` locations, but into SPLIT at most unless
    these hold more than BLOCK; each pair of blocks is one unit of work whose
    pairs are formed and summed in numpy, in strips, and never become rows.
    """
    z = _standardised(complete(rows)).select(by, "label", "vox_id", "z")
    sizes = z.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.withColumn("blocks", blocks_of(F.col("n"), block))
    mine = F.pmod(F.xxhash64("vox_id"), F.col("blocks")).cast("int")
    placed = z.join(blocks, [by, "label"]).withColumn("b", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = placed.withColumn("c", other).select(
        by, "label", F.least("b", "c").alias("p"), F.greatest("b", "c").alias("q"), (F.col("b") <= F.col("c")).alias("first"), "z"
    )

    def block_sum(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        z = table["z"].combine_chunks()
        v = batches.matrix(z, batches.width(z))
        ok = ~np.isnan(v).any(axis=1)  # constant data has no direction
        first = table["first"].to_numpy()
        same = key[2] == key[3]
        a = v[ok & first]
        b = a if same else v[ok & ~first]
        total = 0.0
        for top in range(0, len(a), STRIP):
            r = a[top:top + STRIP] @ b.T
            if same:
                r[np.arange(len(r)), top + np.arange(len(r))] = 0.0
            with np.errstate(divide="ignore", invalid="ignore"):
                f = 0.5 * np.log((1 + r) / (1 - r))
            total += float(f.sum(where=np.isfinite(f))) * (1 if same else 2)
        return pa.table({by: pa.array([key[0].as_py()], pa.int64()), "label": pa.array([key[1].as_py()], pa.int64()), "s": [total]})

    sums = units.groupBy(by, "label", "p", "q").applyInArrow(block_sum, f"{by} long, label long, s double")
    total = sums.groupBy(by, "label").agg(F.sum("s").alias("s"))
    n = F.col("n").cast("double")
    return sizes.join(total, [by, "label"]).select(
        by, "label", n.alias("n"), F.when(n < 2, 1.0).otherwise(F.col("s") / (n * (n - 1))).alias("homogeneity")
    )


def weighted_mean(parcels: DataFrame, by: str = "subj_id", value: str = "homogeneity") -> DataFrame:
    """Parcel values averaged with the number of locations as weights."""
    return parcels.groupBy(by).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias(value))


def task_inhomogeneity(rows: DataFrame, by: str = "subj_id", z_transfer: bool = True) -> DataFrame:
    """Standard deviation inside parcels per contrast ``m``, weighted by parcel size.

    One scan gives count, mean and variance per parcel and contrast; the
    overall deviation, by which standardising divides, follows from them.
    """
    cells = complete(rows).select(by, "label", F.posexplode_outer("y").alias("m", "v"))
    parcels = cells.groupBy(by, "label", "m").agg(
        F.count("v").cast("double").alias("n"), F.avg("v").alias("mean"),
        F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var"),  # a single location does not vary
    )
    n, mean = F.col("n"), F.col("mean")
    sums = parcels.groupBy(by, "m").agg(
        F.sum("n").alias("n"), F.sum(n * F.sqrt("var")).alias("dev"),
        F.sum((n - 1) * F.col("var")).alias("within"),
        F.collect_list(F.struct("n", "mean")).alias("parts"),  # one entry per parcel
    )
    grand = A.total(F.transform("parts", lambda q: q["n"] * q["mean"])) / n
    between = A.let(grand, lambda g: A.total(F.transform("parts", lambda q: q["n"] * (q["mean"] - g) * (q["mean"] - g))))
    spread = F.sqrt(F.try_divide(F.col("within") + between, n - 1))
    inner = F.col("dev") / n
    return sums.select(by, F.col("m"), (F.coalesce(F.try_divide(inner, spread), F.lit(0.0)) if z_transfer else inner).alias("inhomogeneity"))


def nan_std(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Population standard deviation of the present values."""
    return df.groupBy(*by).agg(F.stddev_pop(column).alias("std"))

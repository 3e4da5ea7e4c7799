"""Drawing data from emission models.

Draws depend on (seed, subject, location) only.  The digest of each key gives all uniform numbers of a row, four to a block,
and whole Arrow batches are turned into draws at once, so a recomputed task repeats them and SQL can follow them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import batches, randoms
from tessera.operators import emissions as em

# Cells of the table of angles, and the standard deviations that it reaches on both sides of the mode.
ANGLES, REACH = 512, 12.0
# Subjects that are drawn together for a location.
SUBJECT_BLOCK = 1024


def angle_table(dim: int, kappa: float) -> tuple[float, float, np.ndarray]:
    """First edge, width and cumulative weights of cells of the angle to the mean direction.

    The density exp(kappa cos a) sin(a)^(dim - 2) is taken as constant in each of ANGLES equal cells around its mode.
    """
    low, width, middle = _cells(dim, kappa)
    cos, sin = np.cos(middle), np.sin(middle)
    log = kappa * cos + (dim - 2) * np.log(sin)
    return low, width, np.cumsum(np.exp(log - log.max()))


def _cells(dim: int, kappa: float) -> tuple[float, float, np.ndarray]:
    if dim < 2:
        raise ValueError("directions need two dimensions")
    free = dim - 2
    root = free + np.sqrt(free * free + 4 * kappa * kappa)
    mode = 2 * kappa / root if root > 0 else 0.0
    curve = kappa * mode + (free / (1 - mode * mode) if free else 0.0)
    reach = REACH / np.sqrt(curve) if curve > 0 else np.pi
    low, high = max(0.0, np.arccos(mode) - reach), min(np.pi, np.arccos(mode) + reach)
    width = (high - low) / ANGLES
    return low, width, low + (np.arange(ANGLES) + 0.5) * width


def angles(u: np.ndarray, dim: int, kappa: float) -> np.ndarray:
    """The angles at which the cumulative weight reaches a share ``u`` of the total."""
    low, width, upto = angle_table(dim, kappa)
    want = u * upto[-1]
    cell = np.minimum(np.searchsorted(upto, want, side="right"), ANGLES - 1)
    before = np.where(cell > 0, upto[cell - 1], 0.0)
    return low + (cell + (want - before) / (upto[cell] - before)) * width


def normals(u: np.ndarray, n: int) -> np.ndarray:
    """n standard normals a row from 2 * ceil(n / 2) uniforms: pairs by the Box-Muller transform."""
    radius = np.sqrt(-2.0 * np.log1p(-u[:, 0::2]))
    turn = 2 * np.pi * u[:, 1::2]
    return np.stack([radius * np.cos(turn), radius * np.sin(turn)], axis=2).reshape(len(u), -1)[:, :n]


def uniforms_of_direction(dim: int) -> int:
    return 1 + 2 * -(-dim // 2)


def directions(u: np.ndarray, mean: np.ndarray, kappa: float) -> np.ndarray:
    """A draw on the unit sphere around ``mean`` for each row of uniforms: an angle and a tangent direction."""
    mean = np.asarray(mean, dtype=float) / np.linalg.norm(mean)
    angle = angles(u[:, 0], len(mean), kappa)
    tangent = normals(u[:, 1:], len(mean))
    tangent -= np.outer(tangent @ mean, mean)
    tangent /= np.linalg.norm(tangent, axis=1, keepdims=True)
    return np.cos(angle)[:, None] * mean + np.sin(angle)[:, None] * tangent


def vmf_vectors(rng: np.random.Generator, mean: np.ndarray, kappa: float, n: int) -> np.ndarray:
    """n draws on the unit sphere around ``mean``."""
    return directions(rng.random((n, uniforms_of_direction(len(mean)))), mean, kappa)


def _needed(emission: em.Emission, parts) -> int:
    """Uniforms that a draw takes."""
    if isinstance(emission, em.VonMisesFisher):
        return uniforms_of_direction(len(emission.v)) * (1 if parts is None else len(np.unique(parts)))
    if isinstance(emission, em.Multinomial):
        return 1
    if isinstance(emission, em.GaussianExponential | em.IsotropicGaussian):
        return 1 + 2 * -(-len(emission.predicted) // 2)
    raise TypeError(f"cannot draw from {type(emission).__name__}")


def _draws(emission: em.Emission, u: np.ndarray, label: np.ndarray, kappa: np.ndarray | None, x, parts):
    """Observations of all rows of a batch, and their signal strengths."""
    ones = np.ones(len(label))
    if isinstance(emission, em.VonMisesFisher):
        levels = None if parts is None else np.unique(parts)
        n_levels, each = (1 if levels is None else len(levels)), uniforms_of_direction(len(emission.v))
        v = np.empty((len(label), n_levels, len(emission.v)))
        own = np.broadcast_to(np.asarray(emission.kappa, dtype=float), (emission.v.shape[1],))
        at = own[label] if kappa is None else np.where(np.isnan(kappa), own[label], kappa)
        for k, kap in {*zip(label.tolist(), at.tolist())}:
            rows = np.flatnonzero((label == k) & (at == kap))
            for j in range(n_levels):
                v[rows, j] = directions(u[rows, j * each:(j + 1) * each], emission.v[:, k], kap)
        if levels is None:
            return (v[:, 0] if x is None else v[:, 0] @ np.asarray(x).T), ones
        design = np.eye(len(parts)) if x is None else np.asarray(x)
        y = np.empty((len(label), len(parts)))
        for j, level in enumerate(levels):
            rows = np.asarray(parts) == level
            y[:, rows] = v[:, j] @ design[rows].T
        return y, ones
    if isinstance(emission, em.Multinomial):
        p = np.ones((emission.k, emission.k))
        p[np.diag_indices(emission.k)] = np.exp(emission.w)
        upto = np.cumsum(p, axis=1) / p.sum(axis=1, keepdims=True)
        pick = (u[:, :1] >= upto[label]).sum(axis=1).clip(0, emission.k - 1)
        return np.eye(emission.k)[pick], ones
    mean = emission.predicted[:, label].T
    noise = np.sqrt(emission.sigma2) * normals(u[:, 1:], mean.shape[1])
    if isinstance(emission, em.GaussianExponential):
        signal = -np.log1p(-u[:, 0]) / emission.beta
        return mean * signal[:, None] + noise, signal
    return mean + noise, ones


def draw(labels: DataFrame, emission: em.Emission, seed, x: np.ndarray | None = None, parts=None, signal: bool = False) -> DataFrame:
    """Observations for labelled locations: ``subj_id, vox_id, y`` (and ``signal``).

    Directions of a von Mises-Fisher model are drawn once per partition and
    multiplied with that partition's rows of the design ``x``.  A column
    ``kappa`` (a number, or one per parcel) replaces the model's concentration.
    """
    n = _needed(emission, parts)

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            col = lambda c: batch.column(names.index(c))
            u = randoms.from_blocks(col("_u"), n)
            label = col("label").to_numpy(zero_copy_only=False)
            kappa = batches.vector(col("kappa")) if "kappa" in names else None
            y, strength = _draws(emission, u, label, kappa, x, parts)
            arrays = [col("subj_id"), col("vox_id"), batches.list_array(y), *([pa.array(strength)] if signal else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=["subj_id", "vox_id", "y", *(["signal"] if signal else [])])

    ids = [F.col(c).cast("long").alias(c) for c in ("subj_id", "vox_id")]
    keep = [*ids, F.col("label").cast("int").alias("label"), randoms.uniform_blocks(n, seed, *ids).alias("_u")]
    if "kappa" in labels.columns:
        many = dict(labels.dtypes)["kappa"].startswith("array")
        one = F.when(F.size("kappa") > 1, F.get("kappa", F.col("label").cast("int"))).otherwise(F.get("kappa", F.lit(0)))
        keep.append((one if many else F.col("kappa")).cast("double").alias("kappa"))
    schema = "subj_id long, vox_id long, y array<double>" + (", signal double" if signal else "")
    return labels.select(*keep).mapInArrow(run, schema)


def draw_labels(marginal: DataFrame, subjects: DataFrame, seed) -> DataFrame:
    """A label for every subject and location; ``marginal``: ``vox_id, pi``; ``subjects``: ``subj_id``.

    Subjects are dealt to blocks of about SUBJECT_BLOCK; every location is given the
    numbers of all blocks and meets their subjects by that number.
    """
    who = subjects.select("subj_id").distinct()
    blocks = max(1, -(-who.count() // SUBJECT_BLOCK))
    dealt = who.groupBy(F.pmod(F.xxhash64("subj_id"), F.lit(blocks)).alias("_b")).agg(F.collect_list("subj_id").alias("_s"))
    numbered = marginal.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    cells = numbered.join(dealt, "_b").select("vox_id", "pi", F.explode("_s").alias("subj_id"))
    u = randoms.uniform(seed, F.col("subj_id"), F.col("vox_id"))
    return cells.select("subj_id", "vox_id", randoms.pick_category(F.col("pi"), u).alias("label"))


def simulate(model, subject_map: DataFrame, seed, designs=None) -> tuple[DataFrame, list[DataFrame]]:
    """Labels of all subjects and the data of every dataset.

    ``subject_map``: ``dataset_id, local_subj, subj_id``; ``designs`` gives
    (design, partitions) per dataset.
    """
    labels = draw_labels(model.prior.marginal_full(), subject_map.select("subj_id").distinct(), f"{seed}.u")
    data = []
    for d, emission in enumerate(model.emissions):
        x, parts = (None, None) if designs is None else designs[d]
        members = subject_map.where(F.col("dataset_id") == d).select("subj_id").distinct()
        data.append(draw(labels.join(members, "subj_id", "left_semi"), emission, f"{seed}.y{d}", x, parts))
    return labels, data

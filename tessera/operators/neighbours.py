"""Exact nearest neighbours inside groups, and densities from them.

Points are sorted by their nearest pivot and packed into tiles of bounded size. The distance of two tiles' pivots less both
radii bounds the distance of their points from below; the q-th distance inside a point's own tile, or the reach of enough
other tiles, bounds its q-th neighbour from above. Only pairs of tiles that the bounds leave open are compared, each pair in
one matrix product, and only distances under a point's bound leave the task. A matrix of all points is never formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import batches
from tessera.session import cut_lineage

# A tile is sent once for each tile it meets, so what is sent falls with the rows of a tile; distances are formed for
# STRIP rows of it at a time.
PIVOTS, TILE_ROWS, STRIP = 64, 4096, 512
# Numbers that a task holds of the candidates of a strip; ties can make every pair of it one.
HELD = 1 << 20
# Bounds are widened by this part, so that rounding loses no neighbour.
SLACK = 1e-9


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b; rounding may leave small negative numbers."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def _room(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What rounding may add to the squared distances of each row of a."""
    return SLACK * ((a * a).sum(axis=1) + ((b * b).sum(axis=1).max() if len(b) else 0.0))


def _pivots(rows: DataFrame, group: Sequence[str], n: int) -> np.ndarray:
    """``n`` points at most, chosen by a hash of their keys."""
    keyed = rows.select("_v", F.xxhash64(*group, "_id").alias("_h"), *group, "_id")
    found = keyed.orderBy("_h", *group, "_id").limit(n).select("_v").collect()
    return np.unique(np.array([r["_v"] for r in found], dtype=float), axis=0) if found else np.zeros((0, 0))


def _tiles(rows: DataFrame, group: Sequence[str], pivots: np.ndarray, q: int, tile_rows: int) -> DataFrame:
    """Packed tiles: group, pivot, rows, radius, bound of all its points, and the points with their own bounds."""
    keys = [*group]

    def nearest_pivot(it):
        for batch in it:
            v = batches.matrix(batch.column(batch.schema.names.index("_v")), pivots.shape[1])
            d2 = _squares(v, pivots)
            c = d2.argmin(axis=1) if len(v) else np.zeros(0, int)
            r = np.sqrt(((v - pivots[c]) ** 2).sum(axis=1))
            table = pa.Table.from_batches([batch])
            table = table.append_column("_c", pa.array(c.astype(np.int32))).append_column("_r", pa.array(r))
            yield from table.combine_chunks().to_batches()

    fields = ", ".join(f"{k} long" for k in keys)
    assigned = rows.mapInArrow(nearest_pivot, f"{fields}, _id long, _v array<double>, _c int, _r double")
    order = [*keys, "_c", "_r", "_id"]
    ordered = assigned.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(it):
        for batch in it:
            n = batch.num_rows
            if not n:
                continue
            names = batch.schema.names
            parts = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in [*keys, "_c"]]
            ids = batch.column(names.index("_id")).to_numpy()
            radius = batch.column(names.index("_r")).to_numpy()
            v = batches.matrix(batch.column(names.index("_v")), pivots.shape[1])
            new = np.ones(n, bool)
            new[1:] = np.any([p[1:] != p[:-1] for p in parts], axis=0)
            cuts = [*np.flatnonzero(new), n]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                for a in range(lo, hi, tile_rows):
                    b = min(a + tile_rows, hi)
                    x = v[a:b]
                    own = np.full(b - a, np.inf)
                    if b - a > q:
                        for top in range(0, b - a, STRIP):
                            d2 = _squares(x[top:top + STRIP], x)
                            d2[np.arange(len(d2)), top + np.arange(len(d2))] = np.inf
                            d2.partition(q - 1, axis=1)
                            own[top:top + STRIP] = np.maximum(d2[:, q - 1], 0.0)
                        own = np.sqrt(own + _room(x, x))
                    out.append([*(int(p[a]) for p in parts), b - a, float(radius[a:b].max()), float(own.max()),
                                ids[a:b].tobytes(), x.tobytes(), own.tobytes()])
            kinds = [pa.int64()] * len(keys) + [pa.int32(), pa.int32(), pa.float64(), pa.float64()] + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[*keys, "_c", "_n", "_r", "_bound", "_ids", "_vs", "_own"])

    packed = ordered.mapInArrow(
        pack, f"{fields}, _c int, _n int, _r double, _bound double, _ids binary, _vs binary, _own binary")
    return cut_lineage(packed.withColumn("_tile", F.monotonically_increasing_id()))


def _open_pairs(tiles: DataFrame, group: Sequence[str], pivots: np.ndarray, q: int) -> DataFrame:
    """Pairs of tiles (``_a``, ``_b``) of a group that may hold neighbours, with a bound for all points of ``_a``."""
    spark = tiles.sparkSession
    d = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))
    far = F.broadcast(spark.createDataFrame(  # PIVOTS squared rows
        [(i, j, float(d[i, j])) for i in range(len(d)) for j in range(len(d))], "_ca int, _cb int, _d double"))
    side = lambda s: tiles.select(
        *group, *[F.col(c).alias(f"{c}{s}") for c in ("_tile", "_c", "_n", "_r", "_bound")])
    pairs = side("a").join(side("b"), list(group)).join(far, ["_ca", "_cb"])
    reach = F.when(F.col("_tilea") == F.col("_tileb"), 2 * F.col("_ra")).otherwise(F.col("_d") + F.col("_ra") + F.col("_rb"))
    mine = Window.partitionBy("_tilea")
    near = mine.orderBy("_reach", "_tileb").rowsBetween(Window.unboundedPreceding, 0)
    counted = pairs.withColumn("_reach", reach).withColumn("_within", F.sum("_nb").over(near) - 1)
    bound = F.least("_bounda", F.coalesce(F.min(F.when(F.col("_within") >= q, F.col("_reach"))).over(mine), F.lit(float("inf"))))
    low = F.greatest(F.lit(0.0), F.col("_d") - F.col("_ra") - F.col("_rb"))
    return counted.withColumn("_limit", bound * (1 + SLACK) + SLACK).where(low <= F.col("_limit")).select(
        F.col("_tilea").alias("_a"), F.col("_tileb").alias("_b"), "_limit")


def nearest(
    points: DataFrame, q: int, metric: str = "euclidean", group: Sequence[str] = ("subj_id",), id_col: str = "vox_id",
    vector: str = "y", pivots: int = PIVOTS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The ``q`` nearest other points of every point of its group: group, id, ``near``, an array of (d, id) by d, then id.

    ``metric``: ``euclidean`` (d is the distance) or ``cosine`` (d is one less the cosine). A group with fewer points
    gives what it has. Points with a missing vector or element, and for the cosine those of length zero, have no
    neighbours and are none. ``group`` columns and ids are whole numbers, ids unique in a group.

    Rows sent: each tile once for every tile that the bounds leave open, at least itself; all of a group's tiles in the
    worst case. A group's tiles are paired by their sizes alone first.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    if q < 1:
        raise ValueError("at least one neighbour")
    cosine = metric == "cosine"
    value = A.unit(F.col(vector)) if cosine else F.col(vector)
    keys = [F.col(g).cast("long").alias(g) for g in group]
    everyone = points.select(*keys, F.col(id_col).cast("long").alias("_id"), A.as_double(value).alias("_v"))
    rows = everyone.where(~A.has_missing(F.col("_v")))
    chosen = _pivots(rows, group, pivots)
    fields = ", ".join(f"{g} long" for g in group)
    if not len(chosen):
        none = F.array().cast("array<struct<d:double,id:long>>")
        return everyone.select(*group, F.col("_id").alias(id_col), none.alias("near"))
    width = chosen.shape[1]
    tiles = _tiles(rows, group, chosen, q, tile_rows)
    pairs = _open_pairs(tiles, group, chosen, q)
    of = lambda s: tiles.select(F.col("_tile").alias(f"_{s}"), *[F.col(c).alias(f"{c}{s}") for c in ("_ids", "_vs")])
    joined = pairs.join(of("a").join(tiles.select(*group, F.col("_tile").alias("_a"), "_own"), "_a"), "_a").join(of("b"), "_b").select(
        *group, (F.col("_a") == F.col("_b")).alias("_same"), "_limit", "_idsa", "_vsa", "_own", "_idsb", "_vsb", "_a", "_b")

    def strip(key, same, limit, ids_a, a, own, ids_b, b):
        most = np.minimum(own, limit) * (1 + SLACK) + SLACK
        d2 = _squares(a, b)
        d2[ids_a[:, None] == ids_b[None, :]] = np.inf
        room = _room(a, b)
        top = most * most + room
        if d2.shape[1] > q:
            top = np.minimum(top, np.partition(d2, q - 1, axis=1)[:, q - 1] + 2 * room)
        within = (d2 <= top[:, None]) & np.isfinite(d2)
        del d2
        count = np.count_nonzero(within, axis=1)
        parts, lo, ends = [], 0, np.cumsum(count)
        while lo < len(a):  # some rows at a time: points that lie together are all candidates of each other
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + HELD // max(width, 1), side="right")))
            i, j = np.nonzero(within[lo:hi])
            i += lo
            d = 1.0 - (a[i] * b[j]).sum(axis=1) if cosine else np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))
            order = np.lexsort((ids_b[j], d, i))
            # Of a tile, no more than the first q of a point by distance and id can be among its q nearest.
            order = order[np.arange(len(order)) - (np.cumsum(count[lo:hi]) - count[lo:hi])[i[order] - lo] < q]
            parts.append((i[order], j[order], d[order]))
            lo = hi
        i, j, d = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        count = np.minimum(count, q)
        at = np.flatnonzero(count) if not same else np.arange(len(a))
        near = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(count[at]))), pa.int32()),
            pa.StructArray.from_arrays([pa.array(d), pa.array(ids_b[j])], ["d", "id"]))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.full(len(at), k)) for k in key), pa.array(ids_a[at]), near], names=[*group, id_col, "near"])

    def compare(key, pair):
        """One pair of tiles: an Arrow batch of them would hold as many as the task has."""
        *key, same, limit, ids_a, vs_a, own, ids_b, vs_b = (c[0].as_py() for c in pair.columns[:-2])
        ids_a, ids_b = np.frombuffer(ids_a, np.int64), np.frombuffer(ids_b, np.int64)
        a, b = (np.frombuffer(v, float).reshape(-1, width) for v in (vs_a, vs_b))
        own = np.frombuffer(own, float)
        cuts = [slice(lo, lo + STRIP) for lo in range(0, len(a), STRIP)]
        return pa.Table.from_batches([strip(key, same, limit, ids_a[x], a[x], own[x], ids_b, b) for x in cuts])

    found = joined.groupBy("_a", "_b").applyInArrow(compare, f"{fields}, {id_col} long, near array<struct<d:double,id:long>>")
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, q).alias("near")
    best = found.groupBy(*group, id_col).agg(merged)
    lone = everyone.where(A.has_missing(F.col("_v"))).select(
        *group, F.col("_id").alias(id_col), F.array().cast("array<struct<d:double,id:long>>").alias("near"))
    return best.unionByName(lone)


def kernel_density(points: DataFrame, q: int = 20, sigma: float = 100.0, **where) -> DataFrame:
    """Gaussian kernel density: group, id, ``density``, the sum of exp(-d^2 / sigma) over the ``q`` nearest points, the
    point itself among them. NULL for a point without a vector. Further arguments as for ``nearest``."""
    vector = where.get("vector", "y")
    keys = [*where.get("group", ("subj_id",)), where.get("id_col", "vox_id")]
    term = lambda x: F.exp(-x["d"] * x["d"] / F.lit(float(sigma)))
    known = points.where(~A.has_missing(F.col(vector))).select(*[F.col(k).cast("long").alias(k) for k in keys])
    if q == 1:
        out = known.withColumn("density", F.lit(1.0))
    else:
        near = nearest(points, q - 1, "euclidean", **where)
        out = near.join(known, keys, "left_semi").select(*keys, (1.0 + A.total(F.transform("near", term))).alias("density"))
    missing = points.where(A.has_missing(F.col(vector))).select(
        *[F.col(k).cast("long").alias(k) for k in keys], F.lit(None).cast("double").alias("density"))
    return out.unionByName(missing)


def cosine_density(points: DataFrame, q: int = 20, **where) -> DataFrame:
    """Mean cosine of the ``q`` nearest other points: group, id, ``density``; NULL for a point without neighbours."""
    near = nearest(points, q, "cosine", **where)
    keys = [*where.get("group", ("subj_id",)), where.get("id_col", "vox_id")]
    return near.select(*keys, F.try_divide(A.total(F.transform("near", lambda x: 1.0 - x["d"])), F.size("near")).alias("density"))

"""Embedding near-dedup: an exact cosine join by the pigeonhole principle over blocks of rotated coordinates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import components
from tessera.llm.near_dedup import _Forest
from tessera.session import cut_lineage

THRESHOLD = 0.9
#: Coordinates of a block, and rows of a cell at most.
BLOCK_DIMS, CELL_ROWS = 16, 16_384
_LEAST_CELLS = 8
_TILE = 2048
_SLACK = 1e-5


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_dim(batch: pa.RecordBatch):
    """(dimension, rows) of a batch of vectors."""
    sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), np.flatnonzero(sizes == dim)


def _blocks(dim: int) -> int:
    return max(1, math.ceil(dim / BLOCK_DIMS))


def _places(dim: int) -> list[np.ndarray]:
    """Principal components of each block: dealt in turn, so that every block leads with a strong one."""
    return [np.arange(b, dim, _blocks(dim)) for b in range(_blocks(dim))]


def _rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the principal axes of all unit vectors; any rotation would give the same links."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in _by_dim(batch):
                u = _unit(batch.column("embedding").take(pa.array(rows)), dim)
                sums[dim] = sums.get(dim, 0) + u.T @ u
        for dim, s in sums.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(s.size, dim)), "at": pa.array(np.arange(s.size)),
                                              "s": pa.array(s.reshape(-1))})

    table = vectors.select("embedding").mapInArrow(moments, "dim long, at long, s double").groupBy("dim", "at").agg(
        F.sum("s").alias("s")).collect()  # the square of the dimension, whatever the rows
    out = {}
    for dim in {r.dim for r in table}:
        m = np.zeros(dim * dim)
        for r in table:
            if r.dim == dim:
                m[r.at] = r.s
        _, axes = np.linalg.eigh(m.reshape(dim, dim))
        out[dim] = axes[:, ::-1]
    return out


def _leads(vectors: DataFrame, axes) -> DataFrame:
    """The first coordinate of each block of each vector."""

    def run(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch):
                u = _unit(batch.column("embedding").take(pa.array(rows)), dim)
                for b, p in enumerate(_places(dim)):
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array(np.full(len(u), dim)), "block": pa.array(np.full(len(u), b)),
                        "lead": pa.array(u @ axes.value[dim][:, p[0]])})

    return vectors.select("embedding").mapInArrow(run, "dim long, block long, lead double")


def _bounds(vectors: DataFrame, axes, cell_rows: int) -> dict[tuple[int, int], np.ndarray]:
    """Inner bounds of the cells of each block: ranges of the first coordinate with about equally many vectors."""
    total = vectors.count()
    cells = max(_LEAST_CELLS, math.ceil(total / cell_rows))
    probs = [i / cells for i in range(1, cells)]
    rows = _leads(vectors, axes).groupBy("dim", "block").agg(
        F.percentile_approx("lead", probs, 100 * cells).alias("cuts")).collect()
    return {(r.dim, r.block): np.unique(r.cuts) for r in rows}


def _deal(vectors: DataFrame, axes, bounds, radius) -> DataFrame:
    """Each vector, once for each pair of cells of each block in which it may meet another within the radius."""

    def run(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch):
                part = batch.take(pa.array(rows))
                u = _unit(part.column("embedding"), dim)
                for b, p in enumerate(_places(dim)):
                    lead = u @ axes.value[dim][:, p[0]]
                    cuts, r = bounds.value[dim, b], radius(dim, b)
                    home = np.searchsorted(cuts, lead, "right")
                    low, high = np.searchsorted(cuts, lead - r, "right"), np.searchsorted(cuts, lead + r, "right")
                    size = high - low + 1
                    at = np.repeat(np.arange(len(u)), size)
                    other = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + low[at]
                    for lo in range(0, len(at), 4096):
                        a, o = at[lo:lo + 4096], other[lo:lo + 4096]
                        yield pa.RecordBatch.from_pydict({
                            "dim": pa.array(np.full(len(a), dim)), "block": pa.array(np.full(len(a), b)),
                            "c1": pa.array(np.minimum(home[a], o)), "c2": pa.array(np.maximum(home[a], o)),
                            "late": pa.array(home[a] > o), "rep": part.column("rep").take(pa.array(a)),
                            "copies": part.column("copies").take(pa.array(a)),
                            "embedding": part.column("embedding").take(pa.array(a))})

    kind = dict(vectors.dtypes)["embedding"]
    return vectors.mapInArrow(run, "dim long, block long, c1 long, c2 long, late boolean, rep long, copies long, "
                              f"embedding {kind}")


def _meet(axes, threshold: float):
    """Links of the vectors of two cells of a block, counted only in the first block that brings the pair together."""
    budget = 2 * (1 - threshold)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, block, c1, c2 = (k.as_py() for k in key)
        table = table.take(pa.array(np.argsort(table["rep"].to_numpy(), kind="stable")))
        ids, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        column = table["embedding"].combine_chunks()
        x = _unit(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, dim) @ axes.value[dim]
        places = _places(dim)
        share = [budget * len(p) / dim for p in places]
        y = np.ascontiguousarray(x[:, places[block]], np.float32)
        half = (y * y).sum(1)[:, None] / 2
        one = np.ones_like(half)
        left, right = np.hstack((y, -half, one)), np.hstack((y, one, -half))
        late = table["late"].to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~late) if c1 != c2 else np.arange(len(x))
        cols = np.flatnonzero(late) if c1 != c2 else rows
        links, forest = np.zeros(len(x), np.int64), _Forest(len(x))
        for i in range(0, len(rows), _TILE):
            a = rows[i:i + _TILE]
            for j in range(0 if c1 != c2 else i, len(cols), _TILE):
                b = cols[j:j + _TILE]
                hit = np.flatnonzero((left[a] @ right[b].T).reshape(-1) >= -share[block] / 2 - _SLACK)
                for lo in range(0, len(hit), 1 << 17):
                    h = hit[lo:lo + (1 << 17)]
                    p, q = a[h // len(b)], b[h % len(b)]
                    if c1 == c2:
                        p, q = p[p < q], q[p < q]
                    close = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                    p, q = p[close], q[close]
                    square = (x[p] - x[q]) ** 2
                    first = (square[:, places[block]].sum(1) <= share[block] + _SLACK)
                    for k in range(block):
                        first &= square[:, places[k]].sum(1) > share[k] + _SLACK
                    p, q = p[first], q[first]
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    for s, t in zip(p.tolist(), q.tolist()):
                        forest.join(s, t)
        some = np.flatnonzero(links)
        return pa.table({"rep": pa.array(ids[some]), "links": pa.array(links[some]),
                         "root": pa.array(ids[[forest.root(i) for i in some.tolist()]], pa.int64())})

    return run


def mark(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
         cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept (vec_id = component_id).

    Two vectors of equal length are linked if their cosine in double precision is at least ``threshold``: their unit
    vectors then differ by at most 2 (1 - threshold) in squared distance. The unit vectors are rotated and split into
    blocks of about BLOCK_DIMS coordinates; by the pigeonhole principle a linked pair keeps within its proportional
    part of that budget in one block at least. In each block vectors are dealt to cells, ranges of its first
    coordinate, and cells within reach of each other meet in one task, which computes block distances, verifies the
    whole cosine of what is near, and sends per vector a count and the smallest vector it is tied to. No pair leaves
    a task, and a pair is counted only in the first block that finds it. Equal vectors stand as one with a count.

    Vectors that are null, empty, zero or have null or non-finite components link with nothing and are components of
    their own, as are rows with a null id (component null, kept). Rows that repeat an id are vectors of their own.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    if dict(rows.dtypes)["embedding"] != "array<float>":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)))
    valid = rows.filter(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda e: e != 0))
    # Each different vector gets a number of its own, which the checkpoint keeps: ids may repeat.
    reps = cut_lineage(valid.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                       .withColumn("rep", F.monotonically_increasing_id()))
    share = lambda dim, b: math.sqrt(2 * (1 - threshold) * len(_places(dim)[b]) / dim + _SLACK) + _SLACK
    sc = vectors.sparkSession.sparkContext
    axes = sc.broadcast(_rotations(reps))  # the square of the dimension
    bounds = sc.broadcast(_bounds(reps, axes, cell_rows))  # a number per cell of thousands of rows
    met = _deal(reps.drop("first_id"), axes, bounds, share).groupBy("dim", "block", "c1", "c2").applyInArrow(
        _meet(axes, threshold), "rep long, links long, root long")
    found = cut_lineage(met)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components.connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = reps.join(links, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    facts = placed.join(smallest, "component").select(
        "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = valid.join(facts, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda e: e != 0),
                                    F.lit(False)))
    out = out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                       F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

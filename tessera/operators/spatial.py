"""Spatial layouts as node and edge tables.

Neighbours are found by joining coordinates, so the cost grows with the number
of nodes; a nodes x nodes matrix is never formed.  Joins of nodes with nodes are
merge joins: Spark takes a few columns of a compressed table for small and would
broadcast millions of nodes through the driver, and leave the work to the few
tasks that read them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import randoms
from tessera.session import cut_lineage

# Node ids per block when edges are numbered.
EDGE_BLOCK = 1 << 16


def chain_edges(nodes: DataFrame) -> DataFrame:
    """Both directions of every link between consecutive ``node_id``s."""
    ids = nodes.select("node_id").distinct()
    step = ids.select(F.col("node_id").alias("src"), F.explode(F.array(F.col("node_id") - 1, F.col("node_id") + 1)).alias("dst"))
    return step.hint("merge").join(ids.withColumnRenamed("node_id", "dst"), "dst").select("src", "dst", F.lit(1.0).alias("w"))


def grid_edges(nodes: DataFrame) -> DataFrame:
    """Both directions of every link between nodes at distance 1; ``nodes``: ``node_id, x, y``."""
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    step = nodes.select(F.col("node_id").alias("src"), "x", "y", F.explode(moves).alias("m")).select(
        "src", (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y")
    )
    there = nodes.select(F.col("node_id").alias("dst"), "x", "y")
    return step.hint("merge").join(there, ["x", "y"]).select("src", "dst", F.lit(1.0).alias("w"))


def grid_position(node, height: int):
    """Coordinates of a numbered grid node: x = node div height, y = node mod height."""
    return F.floor(node / height).cast("long"), F.pmod(node, F.lit(height)).cast("long")


def incidence(edges: DataFrame) -> DataFrame:
    """Undirected edges numbered by (src, dst), long: ``edge_id, node_id``.

    Numbers are given per block of source nodes and shifted by the sizes of
    the blocks before, so only the short list of block sizes is ordered as a
    whole.
    """
    upper = edges.where("src < dst").select("src", "dst", F.floor(F.col("src") / EDGE_BLOCK).alias("block"))
    sizes = upper.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("block").orderBy("src", "dst")
    numbered = upper.withColumn("i", F.row_number().over(inside) - 1).join(offsets, "block")
    edge = (F.col("i") + F.col("offset")).alias("edge_id")
    return numbered.select(edge, F.explode(F.array("src", "dst")).alias("node_id"))


def centroid_distances(nodes: DataFrame, centroids: Sequence[tuple[float, float]]) -> DataFrame:
    """Squared distance of every node to each of K given centroids, as array ``d2``."""
    d2 = [(F.col("x") - float(cx)) * (F.col("x") - float(cx)) + (F.col("y") - float(cy)) * (F.col("y") - float(cy)) for cx, cy in centroids]
    return nodes.select("node_id", F.array(*d2).alias("d2"))


def within_distance(nodes: DataFrame, radius: float) -> DataFrame:
    """All pairs of nodes closer than ``radius``, with their distance.

    Nodes are binned into squares of that size and joined with the nine squares
    around them, so only near pairs are ever compared.
    """
    cell = lambda c: F.floor(F.col(c) / float(radius)).cast("long")
    here = nodes.select(F.col("node_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = nodes.select("node_id", "x", "y", cell("x").alias("bx"), cell("y").alias("by"), F.explode(shift).alias("s")).select(
        F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"),
        (F.col("bx") + F.col("s.i")).alias("cx"), (F.col("by") + F.col("s.j")).alias("cy"),
    )
    d = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    return here.hint("merge").join(around, ["cx", "cy"]).where(F.col("src") != F.col("dst")).select("src", "dst", d.alias("dist")).where(
        F.col("dist") < radius
    )


def label_borders(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """How many links join each pair of labels: the adjacency of parcels.

    ``labels``: ``node_id, label``; counts each undirected link once.
    """
    a = labels.select(F.col("node_id").alias("src"), F.col("label").alias("a"))
    b = labels.select(F.col("node_id").alias("dst"), F.col("label").alias("b"))
    pairs = edges.where("src < dst").join(a.hint("merge"), "src").join(b.hint("merge"), "dst")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def label_hops(borders: DataFrame) -> DataFrame:
    """Fewest borders to cross between labels: ``source, label, hops``, a row for each label that a source reaches.

    ``borders``: ``a, b`` for each pair of touching labels, in any order, as ``label_borders`` gives them.  The reach
    doubles in every round: a label up to ``2 r`` away lies within ``r`` of one that is exactly ``r`` away, so the rim of
    what is known meets the whole of it.  The rounds grow with the logarithm of the greatest distance; a round's join has a
    row for each pair of a rim and what is near it.
    """
    ends = F.array(
        F.struct(F.col("a").alias("source"), F.col("a").alias("label"), F.lit(0).cast("long").alias("hops")),
        F.struct(F.col("b").alias("source"), F.col("b").alias("label"), F.lit(0).cast("long").alias("hops")),
        F.struct(F.col("a").alias("source"), F.col("b").alias("label"), F.lit(1).cast("long").alias("hops")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("label"), F.lit(1).cast("long").alias("hops")))
    step = borders.select(F.explode(ends).alias("l")).select("l.*")
    known, reach = cut_lineage(step.groupBy("source", "label").agg(F.min("hops").alias("hops"))), 1
    while True:
        rim = known.where(F.col("hops") == reach).select("source", F.col("label").alias("via"))
        near = known.where("hops > 0").select(F.col("source").alias("via"), "label", F.col("hops").alias("more"))
        met = rim.hint("merge").join(near, "via").groupBy("source", "label").agg((F.min("more") + reach).alias("hops"))
        new = cut_lineage(met.hint("merge").join(known.select("source", "label"), ["source", "label"], "left_anti"))
        if new.isEmpty():
            return known
        known, reach = cut_lineage(known.unionByName(new)), 2 * reach


def gradient_magnitude(nodes: DataFrame, value: str) -> DataFrame:
    """Sobel gradient magnitude of a value on the grid; the border repeats its nearest node."""
    bounds = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    kernel = [(dx, dy, gx, gy) for dx, dy, gx, gy in _SOBEL]
    parts = F.array(*[
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(gx)).alias("gx"), F.lit(float(gy)).alias("gy"))
        for dx, dy, gx, gy in kernel
    ])
    # A grid has a clamped neighbour in every direction, so look each one up by position.
    clamp = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    want = nodes.select("node_id", "x", "y", F.explode(parts).alias("k")).select(
        "node_id", clamp(F.col("x") + F.col("k.dx"), bounds["x0"], bounds["x1"]).alias("nx"),
        clamp(F.col("y") + F.col("k.dy"), bounds["y0"], bounds["y1"]).alias("ny"), "k.gx", "k.gy",
    )
    there = nodes.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col(value).alias("v"))
    sums = want.hint("merge").join(there, ["nx", "ny"]).groupBy("node_id").agg(
        F.sum(F.col("v") * F.col("gx")).alias("gx"), F.sum(F.col("v") * F.col("gy")).alias("gy")
    )
    return sums.select("node_id", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("gradient"))


# The Sobel weights (offset x, offset y, weight along x, weight along y).
_SOBEL = (
    (-1, -1, -1, -1), (-1, 0, -2, 0), (-1, 1, -1, 1),
    (0, -1, 0, -2), (0, 1, 0, 2),
    (1, -1, 1, -1), (1, 0, 2, 0), (1, 1, 1, 1),
)


def map_data(nodes: DataFrame, data: DataFrame, default: float = 0.0, value: str = "value") -> DataFrame:
    """Values for all nodes; nodes without data get the default."""
    return nodes.join(data.hint("merge"), "node_id", "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def colour(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Colours such that linked nodes differ: ``node_id, colour``.

    In each round every uncoloured node that outranks its uncoloured
    neighbours (by a hash) takes the smallest colour none of its neighbours
    has.  The number of rounds grows with the logarithm of the graph.
    """
    edges = cut_lineage(edges.select("src", "dst"))  # read in every round
    nodes = edges.select(F.col("src").alias("node_id")).distinct()
    state = cut_lineage(nodes.withColumn("colour", F.lit(None).cast("int")).withColumn("rank", F.xxhash64("node_id")))
    for _ in range(max_rounds):
        other = state.select(F.col("node_id").alias("dst"), F.col("colour").alias("c"), F.struct("rank", F.col("node_id").alias("i")).alias("r"))
        around = edges.join(other.hint("merge"), "dst").groupBy(F.col("src").alias("node_id")).agg(
            F.collect_set("c").alias("taken"), F.max(F.when(F.col("c").isNull(), F.col("r"))).alias("rival")
        )
        wins = F.col("rival").isNull() | (F.struct("rank", F.col("node_id").alias("i")) > F.col("rival"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("taken")), F.col("taken")))
        new = F.when(F.col("colour").isNotNull(), F.col("colour")).when(wins, free)
        state = cut_lineage(state.hint("merge").join(around, "node_id").select("node_id", new.cast("int").alias("colour"), "rank"))
        if state.where("colour is null").limit(1).count() == 0:
            return state.select("node_id", "colour")
    raise RuntimeError("colouring did not finish; raise max_rounds")


def disc_mask(nodes: DataFrame, centre: tuple[float, float], rate: float, size: int) -> DataFrame:
    """Nodes inside a disc that covers about ``rate`` of ``size`` nodes: ``node_id, missing``."""
    r = float(np.sqrt(rate * size / np.pi))
    d = F.sqrt((F.col("x") - centre[0]) * (F.col("x") - centre[0]) + (F.col("y") - centre[1]) * (F.col("y") - centre[1]))
    return nodes.select("node_id", (d < r).alias("missing"))


def random_mask(nodes: DataFrame, rate: float, seed, *keys: str) -> DataFrame:
    """Nodes that go missing independently with a given rate (per key, such as the subject)."""
    u = randoms.uniform(seed, *[F.col(c) for c in keys], F.col("node_id"))
    return nodes.select(*keys, "node_id", (u < rate).alias("missing"))

"""Exact inference for Potts models on trees and forests, by rake and compress.

A round removes leaves (rake: the leaf's message joins its neighbour) and, among nodes with two links, an independent set
(compress: both links and the node become one link with a K x K factor). A chain or a star of any length is gone after a
logarithmic number of rounds. Which nodes go is decided once, for all subjects; the messages of a round are one join each on
(subject, node). Then the rounds are undone from the last one, and every removed node and link gets its exact distribution.
All factors are logarithms, shifted so that the largest is zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import batches
from tessera.operators.potts import PottsModel, _biased
from tessera.session import cut_lineage


@dataclass(frozen=True)
class Round:
    """Nodes removed together. ``raked``: ``node_id, p, wp``; ``joined``: ``node_id, a, b, wa, wb`` with a < b. A weight is
    NULL for a link that an earlier round made."""

    raked: DataFrame
    joined: DataFrame


def schedule(edges: DataFrame, seed=0, max_rounds: int = 200) -> list[Round]:
    """The rounds that remove all links of a forest. ``edges``: ``src, dst, w`` in both directions, links of weight 0 left
    out. A cycle is an error."""
    left = cut_lineage(edges.where("w != 0 AND src != dst").select("src", "dst", F.col("w").cast("double").alias("w")))
    rounds: list[Round] = []
    while not left.isEmpty():
        if len(rounds) == max_rounds:
            raise ValueError("the links hold a cycle")
        by_node = left.groupBy("src").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("dst", "w")).alias("lo"), F.max(F.struct("dst", "w")).alias("hi"))
        degree = by_node.select("src", "n", "lo", "hi", F.xxhash64(F.lit(f"{seed}.{len(rounds)}"), "src").alias("h"))
        seen = degree.select(F.col("src").alias("dst"), F.col("n").alias("n2"), F.col("h").alias("h2"))
        around = left.join(seen, "dst").groupBy("src").agg(
            F.min("n2").alias("least"), F.max(F.when(F.col("n2") == 2, F.struct("h2", "dst"))).alias("rival"))
        known = degree.join(around, "src")
        leaf = (F.col("n") == 1) & ((F.col("least") > 1) | (F.col("src") > F.col("lo.dst")))
        first = F.col("rival").isNull() | (F.struct(F.col("h").alias("h2"), F.col("src").alias("dst")) > F.col("rival"))
        middle = (F.col("n") == 2) & (F.col("least") > 1) & first
        gone = cut_lineage(known.select(
            F.col("src").alias("node_id"), "lo", "hi", leaf.alias("leaf"), middle.alias("middle")).where("leaf OR middle"))
        raked = gone.where("leaf").select("node_id", F.col("lo.dst").alias("p"), F.col("lo.w").alias("wp"))
        joined = gone.where("middle").select(
            "node_id", F.col("lo.dst").alias("a"), F.col("hi.dst").alias("b"), F.col("lo.w").alias("wa"), F.col("hi.w").alias("wb"))
        rounds.append(Round(raked, joined))
        ids = gone.select("node_id")
        stay = left.join(ids.withColumnRenamed("node_id", "src"), "src", "left_anti").join(
            ids.withColumnRenamed("node_id", "dst"), "dst", "left_anti").select("src", "dst", "w")
        none = F.lit(None).cast("double").alias("w")
        made = joined.select(F.col("a").alias("src"), F.col("b").alias("dst"), none).unionByName(
            joined.select(F.col("b").alias("src"), F.col("a").alias("dst"), none))
        left = cut_lineage(stay.unionByName(made))
    return rounds


def _shifted(x: np.ndarray) -> np.ndarray:
    return x - x.reshape(len(x), -1).max(axis=1).reshape((-1,) + (1,) * (x.ndim - 1))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _link(column: pa.Array, weight: pa.Array, k: int, theta: float) -> np.ndarray:
    """Log factors of links, (rows, K, K): the given ones, else theta * w where both labels agree."""
    given = batches.matrix(column, k * k).reshape(-1, k, k)
    w = batches.vector(weight)
    return np.where(np.isnan(w)[:, None, None], given, theta * np.nan_to_num(w)[:, None, None] * np.eye(k))


def _mapped(df: DataFrame, schema: str, work) -> DataFrame:
    """Rows made of each Arrow batch by ``work(column getter) -> dict of arrays``."""

    def run(it):
        for batch in it:
            if batch.num_rows:
                names = batch.schema.names
                out = work(lambda c: batch.column(names.index(c)))
                yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])

    return df.mapInArrow(run, schema)


def _flat(x: np.ndarray) -> pa.Array:
    return batches.list_array(x.reshape(len(x), -1))


def infer(model: PottsModel, scores: DataFrame, rounds: list[Round] | None = None) -> tuple[DataFrame, DataFrame]:
    """Posterior ``subj_id, node_id, uhat`` and links ``subj_id, src, dst, w, agree`` (once each, src < dst).

    ``scores``: ``subj_id, node_id, ll``. ``agree`` is the probability that both ends have one label. Every subject has
    all nodes that are linked; a node without links answers for itself. ``rounds`` may be reused for other scores.
    """
    k, theta = model.k, float(model.theta)
    rounds = schedule(model.edges) if rounds is None else rounds
    array, key = "array<double>", ["subj_id", "node_id"]
    nodes = cut_lineage(_biased(scores, model).select("subj_id", "node_id", F.col("bias").alias("phi")))
    links = nodes.sparkSession.createDataFrame([], f"subj_id long, a long, b long, f {array}")
    undo: list[tuple[DataFrame, DataFrame]] = []

    def factor(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
        """With the factor of the link between two columns, seen from its smaller end."""
        mine = links.select("subj_id", F.col("a").alias("_l"), F.col("b").alias("_r"), F.col("f").alias(name))
        ends = rows.withColumn("_l", F.least(left, right)).withColumn("_r", F.greatest(left, right))
        return ends.join(mine, ["subj_id", "_l", "_r"], "left").drop("_l", "_r")

    def oriented(col, name, weight, first, second):
        """Factors with ``first`` along the first axis."""
        f = _link(col(name), col(weight), k, theta)
        swap = col(first).to_numpy() > col(second).to_numpy()
        f[swap] = f[swap].transpose(0, 2, 1)
        return f

    for r in rounds:
        leaves = factor(nodes.join(r.raked, "node_id"), "node_id", "p", "f")

        def rake(col):
            full = batches.matrix(col("phi"), k)[:, :, None] + oriented(col, "f", "wp", "node_id", "p")
            return {"subj_id": col("subj_id"), "node_id": col("node_id"), "p": col("p"), "w": col("wp"),
                    "full": _flat(full), "m": _flat(_log_sum(full, 1))}

        raked = cut_lineage(_mapped(leaves, f"subj_id long, node_id long, p long, w double, full {array}, m {array}", rake))
        inner = factor(factor(nodes.join(r.joined, "node_id"), "node_id", "a", "fa"), "node_id", "b", "fb")

        def compress(col):
            full = (oriented(col, "fa", "wa", "a", "node_id")[:, :, :, None] + batches.matrix(col("phi"), k)[:, None, :, None]
                    + oriented(col, "fb", "wb", "node_id", "b")[:, None, :, :])
            full = _shifted(full)
            return {"subj_id": col("subj_id"), "node_id": col("node_id"), "a": col("a"), "b": col("b"), "wa": col("wa"),
                    "wb": col("wb"), "full": _flat(full), "f": _flat(_log_sum(full, 2))}

        joined = cut_lineage(_mapped(
            inner, f"subj_id long, node_id long, a long, b long, wa double, wb double, full {array}, f {array}", compress))
        undo.append((raked, joined))
        messages = raked.groupBy("subj_id", F.col("p").alias("node_id")).agg(
            F.array(*[F.sum(F.col("m")[i]) for i in range(k)]).alias("m"))
        gone = r.raked.select("node_id").unionByName(r.joined.select("node_id"))
        met = nodes.join(gone, "node_id", "left_anti").join(messages, key, "left")
        added = F.when(F.col("m").isNull(), F.col("phi")).otherwise(F.zip_with("phi", "m", lambda x, y: x + y))
        nodes = cut_lineage(met.select(*key, F.transform(added, lambda x: x - F.array_max(added)).alias("phi")))
        # Links of removed nodes are used up; the new ones stand between nodes that stay.
        old = links.join(gone.withColumnRenamed("node_id", "a"), "a", "left_anti").join(
            gone.withColumnRenamed("node_id", "b"), "b", "left_anti").select("subj_id", "a", "b", "f")
        links = cut_lineage(old.unionByName(joined.select("subj_id", "a", "b", "f")))

    def settle(col):
        return {"subj_id": col("subj_id"), "node_id": col("node_id"),
                "uhat": batches.list_array(batches.softmax_rows(batches.matrix(col("phi"), k)))}

    known = cut_lineage(_mapped(nodes, f"subj_id long, node_id long, uhat {array}", settle))
    made = nodes.sparkSession.createDataFrame([], f"subj_id long, a long, b long, joint {array}")
    agreement = []
    pair = f"subj_id long, node_id long, uhat {array}, a long, b long, w double, joint {array}, c long, d long, w2 double, joint2 {array}"
    for raked, joined in reversed(undo):
        def unrake(col):
            full = batches.matrix(col("full"), k * k).reshape(-1, k, k)
            joint = np.exp(full - batches.matrix(col("m"), k)[:, None, :]) * batches.matrix(col("uhat"), k)[:, None, :]
            node, p = col("node_id").to_numpy(), col("p").to_numpy()
            stored = np.where((node > p)[:, None, None], joint.transpose(0, 2, 1), joint)
            none = pa.nulls(len(node))
            return {"subj_id": col("subj_id"), "node_id": col("node_id"), "uhat": _flat(joint.sum(axis=2)),
                    "a": pa.array(np.minimum(node, p)), "b": pa.array(np.maximum(node, p)), "w": col("w"), "joint": _flat(stored),
                    "c": none.cast(pa.int64()), "d": none.cast(pa.int64()), "w2": none.cast(pa.float64()),
                    "joint2": none.cast(pa.list_(pa.float64()))}

        def uncompress(col):
            full = batches.matrix(col("full"), k * k * k).reshape(-1, k, k, k)
            f = batches.matrix(col("f"), k * k).reshape(-1, k, 1, k)
            cube = np.exp(full - f) * batches.matrix(col("joint"), k * k).reshape(-1, k, 1, k)
            node, a, b = (col(c).to_numpy() for c in ("node_id", "a", "b"))
            first, second = cube.sum(axis=3), cube.sum(axis=1)  # a x node, node x b
            first = np.where((a > node)[:, None, None], first.transpose(0, 2, 1), first)
            second = np.where((node > b)[:, None, None], second.transpose(0, 2, 1), second)
            return {"subj_id": col("subj_id"), "node_id": col("node_id"), "uhat": _flat(cube.sum(axis=(1, 3))),
                    "a": pa.array(np.minimum(a, node)), "b": pa.array(np.maximum(a, node)), "w": col("wa"), "joint": _flat(first),
                    "c": pa.array(np.minimum(b, node)), "d": pa.array(np.maximum(b, node)), "w2": col("wb"), "joint2": _flat(second)}

        parents = known.select("subj_id", F.col("node_id").alias("p"), "uhat")
        one = _mapped(raked.join(parents, ["subj_id", "p"]), pair, unrake)
        two = _mapped(joined.join(made, ["subj_id", "a", "b"]), pair, uncompress)
        found = cut_lineage(one.unionByName(two))
        known = cut_lineage(known.unionByName(found.select("subj_id", "node_id", "uhat")))
        sides = found.select("subj_id", "a", "b", "w", "joint").unionByName(
            found.where("c IS NOT NULL").select(
                "subj_id", F.col("c").alias("a"), F.col("d").alias("b"), F.col("w2").alias("w"), F.col("joint2").alias("joint")))
        made = cut_lineage(made.unionByName(sides.where("w IS NULL").select("subj_id", "a", "b", "joint")))
        same = sum((F.col("joint")[i * k + i] for i in range(1, k)), F.col("joint")[0])
        agreement.append(sides.where("w IS NOT NULL").select(
            "subj_id", F.col("a").alias("src"), F.col("b").alias("dst"), "w", same.alias("agree")))
    empty = nodes.sparkSession.createDataFrame([], "subj_id long, src long, dst long, w double, agree double")
    for part in agreement:
        empty = empty.unionByName(part)
    return known, empty


def agreement(links: DataFrame) -> DataFrame:
    """Expected weighted number of equal neighbours per subject, both directions of each link counted: ``subj_id, phi``."""
    return links.groupBy("subj_id").agg(F.sum(2 * F.col("w") * F.col("agree")).alias("phi"))

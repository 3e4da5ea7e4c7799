"""Agreement between two labelings, from one contingency table.

Nothing here compares locations pairwise: counting joint labels once gives
every index.  ``by`` columns keep subjects (or any other groups) apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Joint counts ``n`` of labels ``a`` and ``b``, with map-side combine."""
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def _margins(table: DataFrame, by: Sequence[str]):
    rows = table.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    cols = table.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    return rows, cols


def _with_margins(table: DataFrame, by: Sequence[str]) -> DataFrame:
    rows, cols = _margins(table, by)
    return table.join(rows, [*by, "a"]).join(cols, [*by, "b"])


def nmi_distance(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One minus the mutual information over the mean entropy; 0 for two constant labelings.

    With N = sum n: MI = sum n log n / N - sum a log a / N - sum b log b / N + log N, so three
    sums are enough and no total has to be known beforehand.
    """
    table, keys = _grouped(table, by)
    rows, cols = _margins(table, keys)
    t = table.groupBy(*keys).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("j"))
    r = rows.groupBy(*keys).agg(F.sum(F.col("na") * F.log("na")).alias("ra"))
    c = cols.groupBy(*keys).agg(F.sum(F.col("nb") * F.log("nb")).alias("cb"))
    joined = t.join(r, keys).join(c, keys)
    ha = F.log("t") - F.col("ra") / F.col("t")
    hb = F.log("t") - F.col("cb") / F.col("t")
    mi = ha + hb - (F.log("t") - F.col("j") / F.col("t"))
    # Entropies of constant labelings are zero up to rounding.
    constant = (ha < 1e-12) & (hb < 1e-12)
    return joined.select(*by, F.when(constant, 0.0).otherwise(1 - F.try_divide(2 * mi, ha + hb)).alias("nmi"))


def _grouped(table: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Groups to join on; one constant group where none are given."""
    return (table, list(by)) if by else (table.withColumn("_g", F.lit(0)), ["_g"])


def adjusted_rand(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index from ordered pair counts, in DOUBLE because counts are multiplied."""
    table, keys = _grouped(table, by)
    rows, cols = _margins(table, keys)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1))
    t = table.groupBy(*keys).agg(F.sum("n").alias("t"), pairs("n").alias("n11"))
    joined = t.join(rows.groupBy(*keys).agg(pairs("na").alias("pa")), keys).join(
        cols.groupBy(*keys).agg(pairs("nb").alias("pb")), keys
    )
    n11, t = F.col("n11"), F.col("t")
    n10, n01 = F.col("pa") - n11, F.col("pb") - n11
    n00 = t * (t - 1) - n11 - n10 - n01
    value = F.try_divide(
        2.0 * (n11 * n00 - n10 * n01), (n11 + n10) * (n10 + n00) + (n11 + n01) * (n01 + n00)
    )
    return joined.select(*by, F.when((n10 == 0) & (n01 == 0), 1.0).otherwise(value).alias("ari"))


def dice_cells(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dice coefficient of every pair of labels that occur together (others are 0)."""
    return _with_margins(table, by).select(
        *by, "a", "b", (2.0 * F.col("n") / (F.col("na") + F.col("nb"))).alias("dice")
    )


def dice_same_labels(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dice of each label with itself; both labelings must use the same labels."""
    rows, cols = _margins(table, by)
    both = rows.withColumnRenamed("a", "label").join(cols.withColumnRenamed("b", "label"), [*by, "label"], "full")
    hits = table.where("a = b").select(*by, F.col("a").alias("label"), "n")
    joined = both.join(hits, [*by, "label"], "left")
    missing = F.col("na").isNull() | F.col("nb").isNull()
    value = 2.0 * F.coalesce("n", F.lit(0.0)) / (F.col("na") + F.col("nb"))
    guard = F.when(missing, F.raise_error(F.lit("both labelings must have exactly the same labels")))
    return joined.select(*by, "label", F.coalesce(guard.cast("double"), value).alias("dice"))


def dice_greedy(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Greedy one-to-one matching of labels by their Dice coefficient.

    A group is one contingency table: its size is given by the number of
    labels, whatever the number of locations.  Left-over labels are matched
    with coefficient 0.
    """
    table, keys = _grouped(table, by)
    cells = dice_cells(table, keys)
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["rank int", f"a {kinds['a']}", f"b {kinds['b']}", "dice double"])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        la, lb = sorted(pdf["a"].unique()), sorted(pdf["b"].unique())
        m = np.zeros((len(la), len(lb)))
        m[[la.index(x) for x in pdf["a"]], [lb.index(x) for x in pdf["b"]]] = pdf["dice"]
        rows = [(la[i], lb[j], v) for i, j, v in greedy_pairs(m)]
        out = pd.DataFrame(rows, columns=["a", "b", "dice"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        out["rank"] = np.arange(len(out), dtype="int32")
        return out[[*keys, "rank", "a", "b", "dice"]]

    out = cells.groupBy(*keys).applyInPandas(match, schema)
    return out if by else out.drop("_g")


def greedy_pairs(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Repeatedly take the largest remaining cell; row-major order breaks ties."""
    left = np.array(scores, dtype=float)
    left[np.isnan(left)] = -np.inf
    free_r, free_c = list(range(left.shape[0])), list(range(left.shape[1]))
    out = []
    while free_r and free_c:
        sub = left[np.ix_(free_r, free_c)]
        i, j = np.unravel_index(np.argmax(sub), sub.shape)
        out.append((free_r[i], free_c[j], float(sub[i, j])))
        free_r.pop(i)
        free_c.pop(j)
    return out


def best_assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest one-to-one assignment of a square matrix.

    Shortest augmenting paths; the matrix is parcels x parcels.
    """
    n = cost.shape[0]
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        dist, via, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while row_of[j0]:
            done[j0] = True
            i0 = row_of[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~done[1:] & (reduced < dist[1:])
            dist[1:][better], via[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(done[1:], np.inf, dist[1:])))
            step = dist[j1]
            u[row_of[done]] += step
            v[done] -= step
            dist[~done] -= step
            j0 = j1
        while j0:
            row_of[j0] = row_of[via[j0]]
            j0 = via[j0]
    out = np.empty(n, dtype=int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def relabeling(table: DataFrame, k: int) -> np.ndarray:
    """New name of each label ``a`` in 0..k-1 so that most agree with ``b``.

    Minimises the same count as trying all permutations, from k x k counts.
    """
    counts = np.zeros((k, k))
    for r in table.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        counts[int(r["a"]), int(r["b"])] = r["n"]
    return best_assignment(-counts)


def all_relabelings(labels: Sequence) -> list[tuple]:
    """Every ordering of the labels; for checks on few labels only."""
    return list(itertools.permutations(labels))

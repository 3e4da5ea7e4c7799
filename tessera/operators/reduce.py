"""Sums that each task forms in numpy before Spark adds them up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import batches
from tessera.session import cut_lineage

# Rows of a table that may be broadcast, and parts of a key when it may not.
SMALL_ROWS, SALTS = 4096, 32


def sum_by_key(
    df: DataFrame, key: str | None, names: Sequence[str], values: Callable[[pa.RecordBatch], np.ndarray]
) -> DataFrame:
    """Sums of per-row numbers by an integer key (or overall).

    ``values`` turns an Arrow batch into an (n, len(names)) matrix.  Rows with
    the same key are added inside the batch, so the shuffle sees one row per
    key and batch, whatever the key's share of the data.
    """

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            rows = values(batch)
            if key is None:
                keys, sums = np.zeros(1, dtype=np.int64), rows.sum(axis=0)[None, :]
            else:
                keys, inverse = np.unique(
                    batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False), return_inverse=True
                )
                sums = np.zeros((len(keys), rows.shape[1]))
                np.add.at(sums, inverse, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64)), *[pa.array(sums[:, j]) for j in range(sums.shape[1])]],
                names=["_key", *names],
            )

    parts = df.mapInArrow(run, "_key long, " + ", ".join(f"{n} double" for n in names))
    out = parts.groupBy("_key").agg(*[F.sum(n).alias(n) for n in names])
    return out.drop("_key") if key is None else out.withColumnRenamed("_key", key)


def gram(df: DataFrame, left: str, right: str, n_left: int, n_right: int) -> np.ndarray:
    """Sum over all rows of the outer product of two array columns.

    Every task returns n_left rows of n_right numbers; the result is a small
    matrix, its size given by the arrays and not by the number of rows.
    """
    cols = [f"c{j}" for j in range(n_right)]

    def run(it):
        total = np.zeros((n_left, n_right))
        for batch in it:
            names = batch.schema.names
            a = np.nan_to_num(batches.matrix(batch.column(names.index(left)), n_left))
            b = np.nan_to_num(batches.matrix(batch.column(names.index(right)), n_right))
            total += a.T @ b
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n_left)), *[pa.array(total[:, j]) for j in range(n_right)]], names=["i", *cols]
        )

    columns = [left] if left == right else [left, right]
    parts = df.select(*columns).mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in cols))
    out = np.zeros((n_left, n_right))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in cols]).collect():
        out[r["i"]] = [r[c] for c in cols]
    return out


def join_hot(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """Join a table of one row per ``key`` (a subject) to rows of which one key may have nearly all.

    A table of at most SMALL_ROWS rows is broadcast; a larger one is repeated for SALTS parts of each key, which
    ``spread`` tells apart, so that no key meets in one task.
    """
    table = cut_lineage(table)
    if table.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salts = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(salts, [key, "_salt"], how).drop("_salt")

"""Exact dedup: frequent texts are settled in the map side, all others by an ordinary shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Counters of a summary, and so the most rows that are ever broadcast (48 bytes each).
COUNTERS = 1024


def _shrink(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """The merge step of Misra-Gries summaries: subtract the counter that comes after the largest ``counters``."""
    if len(counts) <= counters:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = np.partition(values, len(values) - counters - 1)[len(values) - counters - 1]
    return {d: n - cut for d, n in counts.items() if n > cut}


def frequent(digests: DataFrame, counters: int = COUNTERS) -> list[tuple[bytes, int]]:
    """Every digest that more than one row in ``counters + 1`` has, and perhaps others, ``counters`` at most.

    One summary per task, added up by digest; only the largest ``counters + 1`` sums reach the driver.
    """

    def summarise(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for item in pc.value_counts(batch.column(0)):
                d = item["values"].as_py()
                counts[d] = counts.get(d, 0) + item["counts"].as_py()
            counts = _shrink(counts, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(counts.keys(), pa.binary()), "n": pa.array(map(int, counts.values()), pa.int64())}
        )

    summaries = digests.select("digest").mapInArrow(summarise, "digest binary, n long")
    merged = summaries.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1)
    rows = [(bytes(r.digest), r.n) for r in merged.collect()]
    cut = rows[counters][1] if len(rows) > counters else 0
    return [(d, n - cut) for d, n in rows if n > cut]


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
         counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, digest (SHA-256 of the text), keep_id, group_size, kept, and ``carry``.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays; a
    null id is smaller than any other. Exactly one row of a group is kept: where rows repeat both id and text,
    one of them. ``carry`` names columns of ``docs`` that travel along.

    Digests are written once to the checkpoint folder. Misra-Gries summaries name the digests that might be
    frequent; their exact counts and winners, at most ``counters`` rows, are broadcast. All rows of a frequent
    text are then settled where they lie, and no group left to the shuffle holds more than one row in
    ``counters + 1``.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    rows = cut_lineage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"),
        F.monotonically_increasing_id().alias("_row"), F.struct(*carry).alias("_carry"),
    ) if carry else docs.select(
        F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    spark = docs.sparkSession
    best = F.max(F.struct("doc_id", "_row"))
    candidates = spark.createDataFrame(frequent(rows, counters), "digest binary, _estimate long").select("digest")
    exact = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(
        best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    total = rows.count()
    heavy = [tuple(r) for r in exact.filter(F.col("group_size") * (counters + 1) > total).collect()]
    winners = F.broadcast(spark.createDataFrame(
        heavy, "digest binary, _best struct<doc_id:long,_row:long>, group_size long"))
    settled = rows.join(winners, "digest")
    same = Window.partitionBy("digest")
    others = rows.join(winners, "digest", "left_anti").select(
        "*", best.over(same).alias("_best"), F.count(F.lit(1)).over(same).alias("group_size"))
    out = settled.unionByName(others)
    return out.select(
        "doc_id", "digest", F.col("_best.doc_id").alias("keep_id"), "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"), *(["_carry.*"] if carry else []))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col), F.col(text_col))
    marked = mark(packed, id_col, text_col, ("row",), counters)
    return marked.filter("kept").select("row.*")

"""The benchmark tables seen as observations, labels and layouts.

Every view covers its whole table.  The SQL strings define the same views for
the checks; they are written independently of the DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import evidence

SUBJECTS = 5
PARCELS = 10  # labels 0..9 of the embeddings table
WIDTH = 64  # length of an embedding
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded output; adding 0.0 turns a negative zero into zero."""
    return F.round(c, digits) + F.lit(0.0)


def vox(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as responses of 64 conditions at the locations of five subjects."""
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % SUBJECTS).alias("subj_id"),
        F.expr(f"vec_id div {SUBJECTS}").alias("vox_id"),
        F.col("label").cast("long").alias("label"),
        A.as_double(F.col("embedding")).alias("y"),
    )


def vox_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings already have unit length: one partition everywhere."""
    return vox(spark, sf).select("subj_id", "vox_id", "label", F.lit(1.0).alias("num_part"), "y")


VOX = f"""
vox AS (
  SELECT vec_id % {SUBJECTS} AS subj_id, vec_id // {SUBJECTS} AS vox_id, label::BIGINT AS label,
         list_transform(embedding, lambda e: e::DOUBLE) AS y
  FROM embeddings
),
voxl AS (
  SELECT subj_id, vox_id, label, unnest(y) AS v, generate_subscripts(y, 1) - 1 AS m FROM vox
)"""


def event_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Events as observations: five conditions in five weekly partitions per user."""
    day = F.dayofmonth("ts")
    return table(spark, sf, "events").select(
        (F.col("user_id") % SUBJECTS).alias("subj_id"),
        F.expr(f"user_id div {SUBJECTS}").alias("vox_id"),
        F.floor((day - 1) / 7).cast("int").alias("part_id"),
        F.col("event_type").alias("cond_id"),
        F.col("value").alias("value"),
    )


def event_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.from_cells(event_cells(spark, sf), EVENT_TYPES)


EVT = f"""
evt AS (
  SELECT user_id % {SUBJECTS} AS subj_id, user_id // {SUBJECTS} AS vox_id,
         (extract(day FROM ts)::BIGINT - 1) // 7 AS part_id, event_type AS cond, value
  FROM events
)"""

# Partitioned evidence of the event cells, long over conditions.
EVT_EVIDENCE = EVT + """,
evm AS (SELECT subj_id, vox_id, part_id, cond, avg(value) AS y FROM evt GROUP BY ALL),
evn AS (
  SELECT subj_id, vox_id, part_id, count(y) AS n, sqrt(sum(y * y)) AS len FROM evm GROUP BY ALL
),
evs AS (
  SELECT subj_id, vox_id, sum(CASE WHEN n = 5 THEN 1 ELSE 0 END)::DOUBLE AS num_part FROM evn GROUP BY ALL
),
conds AS (SELECT DISTINCT event_type AS cond FROM events),
eve AS (
  SELECT s.subj_id, s.vox_id, s.num_part, c.cond,
         coalesce(sum(CASE WHEN n.n = 5 AND n.len > 0 THEN m.y / n.len END), 0) AS y
  FROM evs s CROSS JOIN conds c
  LEFT JOIN evm m ON m.subj_id = s.subj_id AND m.vox_id = s.vox_id AND m.cond = c.cond
  LEFT JOIN evn n ON n.subj_id = m.subj_id AND n.vox_id = m.vox_id AND n.part_id = m.part_id
  GROUP BY ALL
)"""


def explode_parcels(df: DataFrame, column: str, *keys: str, alias: str = "p", digits: int = 6) -> DataFrame:
    """One row per element of an array column, rounded for comparison.

    The outer form keeps Spark from adding a filter on the array's size, which
    would evaluate the array expression a second time.
    """
    return df.select(*keys, F.posexplode_outer(column).alias("k", "_v")).select(
        *keys, F.col("k").cast("long").alias("k"), r6(F.col("_v"), digits).alias(alias)
    )

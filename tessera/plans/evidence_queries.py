"""Indicators, design regression, partition collapse and data weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import evidence, neighbours
from tessera.plans import views
from tessera.plans.registry import query
from tessera.plans.views import EVENT_TYPES, EVT, EVT_EVIDENCE, VOX, r6, table

_INDICATOR_SQL = """
SELECT event_id, (event_type = 'click')::INT::DOUBLE AS x0, (event_type = 'error')::INT::DOUBLE AS x1,
       (event_type = 'purchase')::INT::DOUBLE AS x2, (event_type = 'signup')::INT::DOUBLE AS x3,
       (event_type = 'view')::INT::DOUBLE AS x4
FROM events"""


@query("indicator_matrix", _INDICATOR_SQL)
def indicator_matrix(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return evidence.indicator(df, "event_type", EVENT_TYPES).drop("event_type")


_POSITIVE_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       (l_linenumber - 3 = 1)::INT::DOUBLE AS x0, (l_linenumber - 3 = 2)::INT::DOUBLE AS x1,
       (l_linenumber - 3 = 3)::INT::DOUBLE AS x2, (l_linenumber - 3 = 4)::INT::DOUBLE AS x3
FROM lineitem"""


@query("indicator_positive", _POSITIVE_SQL)
def indicator_positive(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        (F.col("l_linenumber") - 3).alias("level"),
    )
    return evidence.indicator(df, "level", range(-2, 5), positive=True).drop("level")


_ONEHOT_SQL = f"""
WITH {VOX}
SELECT subj_id, vox_id, k, (label = k)::INT::DOUBLE AS u FROM vox, range({views.PARCELS}) t(k)"""


@query("onehot_expand", _ONEHOT_SQL)
def onehot_expand(spark, sf):
    df = views.vox(spark, sf).select("subj_id", "vox_id", A.one_hot(F.col("label"), views.PARCELS).alias("u"))
    return views.explode_parcels(df, "u", "subj_id", "vox_id", alias="u")


_ARGMAX_SQL = f"""
WITH {VOX}, top AS (SELECT subj_id, vox_id, max(v) AS v FROM voxl GROUP BY ALL)
SELECT l.subj_id, l.vox_id, min(l.m)::BIGINT AS winner
FROM voxl l JOIN top t ON l.subj_id = t.subj_id AND l.vox_id = t.vox_id AND l.v = t.v GROUP BY ALL"""


@query("argmax_compress", _ARGMAX_SQL)
def argmax_compress(spark, sf):
    return views.vox(spark, sf).select("subj_id", "vox_id", A.argmax(F.col("y")).cast("long").alias("winner"))


_PART_SQL = f"WITH {EVT_EVIDENCE} SELECT subj_id, vox_id, cond, num_part, round(y, 6) + 0.0 AS y FROM eve"


def _by_condition(df):
    names = F.array(*[F.lit(c) for c in EVENT_TYPES])
    return df.select("subj_id", "vox_id", "num_part", F.posexplode_outer("y").alias("i", "v")).select(
        "subj_id", "vox_id", names[F.col("i")].alias("cond"), "num_part", r6(F.col("v")).alias("y")
    )


@query("partition_evidence", _PART_SQL)
def partition_evidence(spark, sf):
    return _by_condition(views.event_evidence(spark, sf))


@query("partition_evidence_two_step", _PART_SQL)
def partition_evidence_two_step(spark, sf):
    """The plan for many conditions and partitions; same rows as the pivot."""
    vectors = evidence.partition_vectors(views.event_cells(spark, sf), EVENT_TYPES)
    return _by_condition(evidence.collapse(vectors, len(EVENT_TYPES)))


_NOPART_SQL = f"""
WITH {EVT}, m AS (SELECT subj_id, vox_id, cond, avg(value) AS y FROM evt GROUP BY ALL),
s AS (SELECT subj_id, vox_id, count(*) AS n, sqrt(sum(y * y)) AS len FROM m GROUP BY ALL),
c AS (SELECT DISTINCT event_type AS cond FROM events)
SELECT s.subj_id, s.vox_id, c.cond, (CASE WHEN s.n = 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS num_part,
       CASE WHEN s.n = 5 THEN round(m.y / s.len, 6) + 0.0 END AS y
FROM s CROSS JOIN c LEFT JOIN m ON m.subj_id = s.subj_id AND m.vox_id = s.vox_id AND m.cond = c.cond"""


@query("evidence_nopart", _NOPART_SQL)
def evidence_nopart(spark, sf):
    return _by_condition(evidence.from_cells_unpartitioned(views.event_cells(spark, sf), EVENT_TYPES))


# A design whose columns average consecutive observations: 64 observations in
# two partitions of 32, 8 conditions of 4 repeats per partition.  The
# pseudo-inverse of each partition then takes means of 4 observations.
_DESIGN_SQL = f"""
WITH {VOX},
means AS (SELECT subj_id, vox_id, m // 32 AS part, (m % 32) // 4 AS c, avg(v) AS b FROM voxl GROUP BY ALL),
len AS (SELECT subj_id, vox_id, part, sqrt(sum(b * b)) AS n FROM means GROUP BY ALL)
SELECT m.subj_id, m.vox_id, m.c::BIGINT AS k, 2.0::DOUBLE AS num_part, round(sum(m.b / n.n), 6) + 0.0 AS y
FROM means m JOIN len n ON m.subj_id = n.subj_id AND m.vox_id = n.vox_id AND m.part = n.part
GROUP BY ALL"""


@query("design_regression", _DESIGN_SQL)
def design_regression(spark, sf):
    obs = np.arange(views.WIDTH)
    x = evidence.design_matrix((obs % 32) // 4)
    out = evidence.project(views.vox(spark, sf), x, parts=obs // 32)
    return out.select("subj_id", "vox_id", "num_part", F.posexplode_outer("y").alias("k", "v")).select(
        "subj_id", "vox_id", F.col("k").cast("long").alias("k"), "num_part", r6(F.col("v")).alias("y")
    )


_WEIGHTS = EVT + """,
vm AS (SELECT subj_id, vox_id, part_id, cond, avg(value) AS y FROM evt GROUP BY ALL),
vec AS (
  SELECT subj_id, vox_id, part_id, CASE WHEN count(*) = 5 THEN sqrt(sum(y * y)) ELSE 0 END AS d FROM vm GROUP BY ALL
),
loc AS (SELECT subj_id, count(DISTINCT vox_id) AS p FROM evt GROUP BY ALL),
size AS (SELECT (SELECT sum(p) FROM loc) AS n, count(DISTINCT part_id) AS j FROM evt),
tot AS (
  SELECT subj_id, part_id, count(*) AS n, sum(d) AS d1, sum(d * d) AS d2, min(d) AS lo, max(d) AS hi FROM vec GROUP BY ALL
),
alltot AS (SELECT sum(d * d) AS d2 FROM vec)"""

_WEIGHT_SQL = {
    "length": "v.d",
    "length_sum2P": "v.d * l.p / t.d1",
    "lsquare": "v.d * v.d",
    "lsquare_sum2P": "v.d * v.d * l.p / t.d2",
    "lsquare_sum2PJ": "v.d * v.d * s.n * s.j / g.d2",
    "length_normalized": "(v.d - CASE WHEN t.n < l.p THEN 0 ELSE t.lo END)"
    " / (t.hi - CASE WHEN t.n < l.p THEN 0 ELSE t.lo END)",
    "ones": "1.0::DOUBLE",
}


def weighted_vectors(spark, sf, mode):
    cells = views.event_cells(spark, sf)
    vectors = evidence.partition_vectors(cells, EVENT_TYPES)
    locations = cells.groupBy("subj_id").agg(F.countDistinct("vox_id").alias("locations"))
    partitions = cells.agg(F.countDistinct("part_id")).first()[0]
    return evidence.add_weights(vectors, mode, partitions, locations)


def _register_weights(mode):
    sql = (
        f"WITH {_WEIGHTS} SELECT v.subj_id, v.vox_id, v.part_id, round(ln(1 + {_WEIGHT_SQL[mode]}), 6) + 0.0 AS log_w "
        "FROM vec v JOIN tot t ON v.subj_id = t.subj_id AND v.part_id = t.part_id JOIN loc l ON v.subj_id = l.subj_id CROSS JOIN size s CROSS JOIN alltot g"
    )

    @query(f"weights_{mode}", sql)
    def weights(spark, sf):
        return weighted_vectors(spark, sf, mode).select(
            "subj_id", "vox_id", F.col("part_id").cast("long").alias("part_id"), r6(F.log(1 + F.col("w"))).alias("log_w")
        )


for _mode in evidence.WEIGHTINGS:
    _register_weights(_mode)


NEAREST = 20

_DENSITY_SQL = f"""
WITH {_WEIGHTS},
full_vec AS (SELECT vm.*, v.d FROM vm JOIN vec v USING (subj_id, vox_id, part_id) WHERE v.d > 0),
cosine AS (
  SELECT a.subj_id, a.part_id, a.vox_id, b.vox_id AS other, sum(a.y / a.d * b.y / b.d) AS c
  FROM full_vec a JOIN full_vec b ON a.subj_id = b.subj_id AND a.part_id = b.part_id AND a.cond = b.cond AND a.vox_id <> b.vox_id
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subj_id, part_id, vox_id ORDER BY c DESC, other) AS r FROM cosine),
dens AS (SELECT subj_id, part_id, vox_id, avg(c) AS density FROM ranked WHERE r <= {NEAREST} GROUP BY ALL),
scaled AS (
  SELECT *, CASE WHEN max(density) OVER g - min(density) OVER g > 1e-12 THEN (density - min(density) OVER g) / (max(density) OVER g - min(density) OVER g) END AS dense
  FROM dens WINDOW g AS (PARTITION BY subj_id, part_id))
SELECT v.subj_id, v.vox_id, v.part_id, round(ln(1 + {_WEIGHT_SQL["length_normalized"]} + dense), 6) + 0.0 AS log_w
FROM vec v JOIN tot t ON v.subj_id = t.subj_id AND v.part_id = t.part_id JOIN loc l ON v.subj_id = l.subj_id
LEFT JOIN scaled s ON s.subj_id = v.subj_id AND s.part_id = v.part_id AND s.vox_id = v.vox_id"""


@query("weights_density", _DENSITY_SQL)
def weights_density(spark, sf):
    cells = views.event_cells(spark, sf)
    vectors = evidence.partition_vectors(cells, EVENT_TYPES)
    locations = cells.groupBy("subj_id").agg(F.countDistinct("vox_id").alias("locations"))
    partitions = cells.agg(F.countDistinct("part_id")).first()[0]
    return evidence.add_density_weights(vectors, partitions, locations, NEAREST).select(
        "subj_id", "vox_id", F.col("part_id").cast("long").alias("part_id"), r6(F.log(1 + F.col("w"))).alias("log_w"))


@query("knn_top_q", f"""
WITH v AS (SELECT vec_id % {views.SUBJECTS} AS subj_id, vec_id // {views.SUBJECTS} AS vox_id,
                  list_transform(embedding, lambda e: e::DOUBLE) AS y FROM embeddings),
d AS (SELECT a.subj_id, a.vox_id, b.vox_id AS other, 1 - list_cosine_similarity(a.y, b.y) AS d
      FROM v a JOIN v b ON a.subj_id = b.subj_id AND a.vox_id <> b.vox_id),
r AS (SELECT *, row_number() OVER (PARTITION BY subj_id, vox_id ORDER BY d, other) AS place FROM d)
SELECT subj_id, vox_id, place, other, round(d, 6) + 0.0 AS d FROM r WHERE place <= {NEAREST}""")
def knn_top_q(spark, sf):
    """The nearest locations of each subject by the cosine of their responses."""
    near = neighbours.nearest(views.vox(spark, sf), NEAREST, "cosine")
    return near.select("subj_id", "vox_id", F.posexplode("near").alias("place", "n")).select(
        "subj_id", "vox_id", (F.col("place") + 1).cast("long").alias("place"), F.col("n.id").alias("other"), r6(F.col("n.d")).alias("d"))


_SESSION = EVT + """,
ses AS (SELECT event_type AS cond, row_number() OVER (ORDER BY event_type) - 1 AS dataset_id
        FROM (SELECT DISTINCT event_type FROM events))"""


@query("session_split", f"""
WITH {_SESSION}
SELECT s.dataset_id::BIGINT AS dataset_id, e.subj_id, e.part_id, count(*)::BIGINT AS n, round(avg(e.value), 6) AS y
FROM evt e JOIN ses s ON e.cond = s.cond GROUP BY ALL""")
def session_split(spark, sf):
    cells = evidence.split_sessions(views.event_cells(spark, sf), "cond_id")
    return cells.groupBy(
        F.col("dataset_id").cast("long").alias("dataset_id"), "subj_id", F.col("part_id").cast("long").alias("part_id")
    ).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("y"))


@query("session_join", f"""
WITH {EVT}
SELECT 0::BIGINT AS dataset_id, subj_id, 1::BIGINT AS part_id, cond, count(*)::BIGINT AS n, round(avg(value), 6) AS y
FROM evt GROUP BY ALL""")
def session_join(spark, sf):
    cells = evidence.split_sessions(views.event_cells(spark, sf), "cond_id", join=True, ignore_partitions=True)
    return cells.groupBy(
        F.col("dataset_id").cast("long").alias("dataset_id"), "subj_id",
        F.col("part_id").cast("long").alias("part_id"), F.col("cond_id").alias("cond"),
    ).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("y"))

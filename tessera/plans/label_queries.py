"""Label agreement and relabeling on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import labels, mixture, prediction
from tessera.plans import views
from tessera.plans.emission_queries import (
    EVENT_PARCELS, EVENT_SUMS, LABEL_SUMS, SHARED_KAPPA, SOFTMAX, VMF_SCORES, event_model, label_vmf, vox_aligned,
)
from tessera.plans.registry import query
from tessera.plans.views import EVT_EVIDENCE, PARCELS, VOX, r6, table

# Pairs of labelings: (name, table, column a, column b)
PAIRS = (
    ("flags", "lineitem", "l_returnflag", "l_linestatus"),
    ("orders", "orders", "o_orderstatus", "o_orderpriority"),
    ("labels", "labels", "quality", "toxic"),
)

_UNION = " UNION ALL ".join(f"SELECT '{n}' AS pair, {a}::VARCHAR AS a, {b}::VARCHAR AS b FROM {t}" for n, t, a, b in PAIRS)
_CT = f"""
pairs AS ({_UNION}),
ct AS (SELECT pair, a, b, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL),
ra AS (SELECT pair, a, sum(n) AS na FROM ct GROUP BY ALL),
cb AS (SELECT pair, b, sum(n) AS nb FROM ct GROUP BY ALL),
tt AS (SELECT pair, sum(n) AS t FROM ct GROUP BY ALL)"""


def _pairs(spark, sf):
    out = None
    for name, t, a, b in PAIRS:
        part = table(spark, sf, t).select(
            F.lit(name).alias("pair"), F.col(a).cast("string").alias("la"), F.col(b).cast("string").alias("lb")
        )
        out = part if out is None else out.unionByName(part)
    return labels.contingency(out, "la", "lb", by=["pair"])


@query("contingency", f"WITH {_CT} SELECT pair, a, b, n FROM ct")
def contingency(spark, sf):
    return _pairs(spark, sf)


@query("nmi_distance", f"""
WITH {_CT},
mi AS (SELECT c.pair, sum(c.n / t.t * ln(c.n * t.t / (r.na * b.nb))) AS mi FROM ct c JOIN ra r ON c.pair = r.pair AND c.a = r.a
       JOIN cb b ON c.pair = b.pair AND c.b = b.b JOIN tt t ON c.pair = t.pair GROUP BY ALL),
ha AS (SELECT r.pair, -sum(na / t * ln(na / t)) AS h FROM ra r JOIN tt t ON r.pair = t.pair GROUP BY ALL),
hb AS (SELECT r.pair, -sum(nb / t * ln(nb / t)) AS h FROM cb r JOIN tt t ON r.pair = t.pair GROUP BY ALL)
SELECT m.pair, round(1 - 2 * m.mi / (a.h + b.h), 6) + 0.0 AS nmi FROM mi m JOIN ha a ON m.pair = a.pair JOIN hb b ON m.pair = b.pair""")
def nmi_distance(spark, sf):
    return labels.nmi_distance(_pairs(spark, sf), ["pair"]).select("pair", r6(F.col("nmi")).alias("nmi"))


_ARI = """
n11 AS (SELECT pair, sum(n * (n - 1)) AS s FROM ct GROUP BY ALL),
pa AS (SELECT pair, sum(na * (na - 1)) AS s FROM ra GROUP BY ALL),
pb AS (SELECT pair, sum(nb * (nb - 1)) AS s FROM cb GROUP BY ALL),
x AS (SELECT n11.pair, n11.s AS n11, pa.s - n11.s AS n10, pb.s - n11.s AS n01, t.t * (t.t - 1) - pa.s - pb.s + n11.s AS n00
      FROM n11 JOIN pa ON n11.pair = pa.pair JOIN pb ON n11.pair = pb.pair JOIN tt t ON n11.pair = t.pair)"""


@query("ari", f"""
WITH {_CT}, {_ARI}
SELECT pair, round(CASE WHEN n10 = 0 AND n01 = 0 THEN 1.0 ELSE
  2 * (n11 * n00 - n10 * n01) / ((n11 + n10) * (n10 + n00) + (n11 + n01) * (n01 + n00)) END, 6) + 0.0 AS ari FROM x""")
def ari(spark, sf):
    return labels.adjusted_rand(_pairs(spark, sf), ["pair"]).select("pair", r6(F.col("ari")).alias("ari"))


@query("dice_matrix", f"""
WITH {_CT}
SELECT c.pair, c.a, c.b, round(2 * c.n / (r.na + b.nb), 6) AS dice
FROM ct c JOIN ra r ON c.pair = r.pair AND c.a = r.a JOIN cb b ON c.pair = b.pair AND c.b = b.b""")
def dice_matrix(spark, sf):
    return labels.dice_cells(_pairs(spark, sf), ["pair"]).select("pair", "a", "b", r6(F.col("dice")).alias("dice"))


@query("dice_same_labels", """
SELECT q.label::BIGINT AS label, round(2 * sum(CASE WHEN l.quality = q.label AND l.toxic = q.label THEN 1 ELSE 0 END)
  / sum((l.quality = q.label)::INT + (l.toxic = q.label)::INT), 6) AS dice
FROM labels l CROSS JOIN (SELECT DISTINCT quality AS label FROM labels) q GROUP BY ALL""")
def dice_same_labels(spark, sf):
    ct = labels.contingency(table(spark, sf, "labels"), "quality", "toxic")
    return labels.dice_same_labels(ct).select(F.col("label").cast("long").alias("label"), r6(F.col("dice")).alias("dice"))


# ---------------------------------------------------------------- labels against posteriors

HARD = f"""{VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {SOFTMAX},
hp AS (SELECT subj_id, vox_id, max(p) AS p FROM post GROUP BY ALL),
hard AS (SELECT p.subj_id, p.vox_id, min(p.k)::BIGINT AS guess FROM post p JOIN hp h ON p.subj_id = h.subj_id AND p.vox_id = h.vox_id AND p.p = h.p GROUP BY ALL),
lb AS (SELECT x.subj_id AS pair, x.label AS a, h.guess AS b FROM vox x JOIN hard h ON x.subj_id = h.subj_id AND x.vox_id = h.vox_id),
ct AS (SELECT pair, a, b, count(*)::DOUBLE AS n FROM lb GROUP BY ALL),
ra AS (SELECT pair, a, sum(n) AS na FROM ct GROUP BY ALL),
cb AS (SELECT pair, b, sum(n) AS nb FROM ct GROUP BY ALL),
tt AS (SELECT pair, sum(n) AS t FROM ct GROUP BY ALL)"""


def guesses(spark, sf):
    """True label and most probable parcel of every embedding."""
    post = mixture.posterior(vox_aligned(spark, sf), label_vmf(spark, sf))
    truth = views.vox(spark, sf).select("subj_id", "vox_id", "label")
    return truth.join(post, ["subj_id", "vox_id"]).withColumn("guess", A.argmax(F.col("uhat")).cast("long"))


def _guess_table(spark, sf):
    return labels.contingency(guesses(spark, sf), "label", "guess", by=["subj_id"])


@query("ari_by_subject", f"""
WITH {HARD}, {_ARI}
SELECT pair AS subj_id, round(CASE WHEN n10 = 0 AND n01 = 0 THEN 1.0 ELSE
  2 * (n11 * n00 - n10 * n01) / ((n11 + n10) * (n10 + n00) + (n11 + n01) * (n01 + n00)) END, 6) + 0.0 AS ari FROM x""")
def ari_by_subject(spark, sf):
    return labels.adjusted_rand(_guess_table(spark, sf), ["subj_id"]).select("subj_id", r6(F.col("ari")).alias("ari"))


def _sql_greedy(steps):
    out = ["""
dc AS MATERIALIZED (SELECT c.pair, c.a, c.b, 2 * c.n / (r.na + b.nb) AS dice FROM ct c
       JOIN ra r ON c.pair = r.pair AND c.a = r.a JOIN cb b ON c.pair = b.pair AND c.b = b.b),
full_dc AS MATERIALIZED (SELECT r.pair, r.a, b.b, coalesce(d.dice, 0) AS dice FROM ra r JOIN cb b ON r.pair = b.pair
       LEFT JOIN dc d ON d.pair = r.pair AND d.a = r.a AND d.b = b.b),
left0 AS (SELECT * FROM full_dc)"""]
    for i in range(steps):
        out.append(f"""
pick{i} AS MATERIALIZED (SELECT pair, {i} AS rank, a, b, dice FROM (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY dice DESC, a, b) AS rn FROM left{i}) WHERE rn = 1),
left{i + 1} AS MATERIALIZED (SELECT l.* FROM left{i} l JOIN pick{i} p ON l.pair = p.pair AND l.a <> p.a AND l.b <> p.b)""")
    return ",".join(out)


_PICKS = " UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(PARCELS))


@query("dice_greedy", f"""
WITH {HARD}, {_sql_greedy(PARCELS)}
SELECT pair AS subj_id, rank::BIGINT AS rank, a, b, round(dice, 6) + 0.0 AS dice FROM ({_PICKS})""")
def dice_greedy(spark, sf):
    out = labels.dice_greedy(_guess_table(spark, sf), ["subj_id"])
    return out.select("subj_id", F.col("rank").cast("long").alias("rank"), "a", "b", r6(F.col("dice")).alias("dice"))


@query("dice_mean", f"""
WITH {HARD}, {_sql_greedy(PARCELS)}
SELECT pair AS subj_id, round(avg(dice), 6) + 0.0 AS dice FROM ({_PICKS}) GROUP BY ALL""")
def dice_mean(spark, sf):
    out = labels.dice_greedy(_guess_table(spark, sf), ["subj_id"])
    return out.groupBy("subj_id").agg(r6(F.avg("dice")).alias("dice"))


# ---------------------------------------------------------------- relabeling

# Four parcels of the event users; the truth is the parcel they were assigned to.
_PERM = " CROSS JOIN ".join(f"range({EVENT_PARCELS}) t{i}(p{i})" for i in range(EVENT_PARCELS))
_EVENT_POST = f"""{EVT_EVIDENCE}, {EVENT_SUMS}, {SOFTMAX},
perms AS (SELECT p0, p1, p2, p3 FROM {_PERM} WHERE p0 <> p1 AND p0 <> p2 AND p0 <> p3 AND p1 <> p2 AND p1 <> p3 AND p2 <> p3)"""


def _event_rows(spark, sf):
    aligned, model = event_model(spark, sf)
    post = mixture.posterior(aligned, model)
    return post.withColumn("label", ((F.col("vox_id") + F.col("subj_id")) % EVENT_PARCELS).cast("int"))


@query("label_assignment_error", f"""
WITH {_EVENT_POST},
cost AS (SELECT (vox_id + subj_id) % {EVENT_PARCELS} AS t, c.c, sum(abs((p.k = c.c)::INT - p.p)) AS e
         FROM post p CROSS JOIN range({EVENT_PARCELS}) c(c) GROUP BY ALL)
SELECT round(min(e) / (SELECT count(*) FROM post), 6) + 0.0 AS u_prederr FROM (
  SELECT a.e + b.e + c.e + d.e AS e FROM perms p JOIN cost a ON a.t = 0 AND a.c = p.p0 JOIN cost b ON b.t = 1 AND b.c = p.p1
  JOIN cost c ON c.t = 2 AND c.c = p.p2 JOIN cost d ON d.t = 3 AND d.c = p.p3)""")
def label_assignment_error(spark, sf):
    err = prediction.relabelled_error(_event_rows(spark, sf), EVENT_PARCELS)
    return spark.createDataFrame([(round(err, 6),)], "u_prederr double")


@query("matched_labels", f"""
WITH {_EVENT_POST},
hp AS (SELECT subj_id, vox_id, max(p) AS p FROM post GROUP BY ALL),
hard AS (SELECT p.subj_id, p.vox_id, min(p.k) AS g FROM post p JOIN hp h ON p.subj_id = h.subj_id AND p.vox_id = h.vox_id AND p.p = h.p GROUP BY ALL),
wrong AS (SELECT p0, p1, p2, p3, sum((CASE g WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END <> (vox_id + subj_id) % {EVENT_PARCELS})::INT) AS w
          FROM hard CROSS JOIN perms GROUP BY ALL)
SELECT round(min(w) / (SELECT count(*) FROM hard), 6) + 0.0 AS error FROM wrong""")
def matched_labels(spark, sf):
    out = prediction.matched_labels(_event_rows(spark, sf), EVENT_PARCELS)
    return out.agg(r6(F.avg(F.when(F.col("matched") != F.col("label"), 1.0).otherwise(0.0))).alias("error"))

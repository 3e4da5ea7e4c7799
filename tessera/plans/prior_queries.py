"""Priors, hemisphere layouts and fusion of datasets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import randoms
from tessera.operators import mixture, priors
from tessera.operators import emissions as em
from tessera.plans import views
from tessera.plans.emission_queries import (
    LABEL_SUMS, SHARED_KAPPA, SOFTMAX, VMF_SCORES, label_vmf, sql_concentration, sql_log_constant, vox_aligned,
)
from tessera.plans.registry import query
from tessera.plans.views import PARCELS, VOX, table

# ---------------------------------------------------------------- label prior

# How often each label occurs at a location over subjects, as logits.
LABEL_PRIOR = f"""
grid AS (SELECT v.vox_id, t.k FROM (SELECT DISTINCT vox_id FROM vox) v CROSS JOIN range({PARCELS}) t(k)),
cnt AS (SELECT g.vox_id, g.k, count(x.label) AS c FROM grid g LEFT JOIN vox x ON x.vox_id = g.vox_id AND x.label = g.k GROUP BY ALL),
pri AS (SELECT vox_id, k, ln(c + 1.0) AS lp FROM cnt)"""


def label_prior(spark, sf) -> priors.IndependentPrior:
    counts = views.vox(spark, sf).groupBy(F.col("vox_id").alias("node_id")).agg(
        F.array(*[F.log(F.count(F.when(F.col("label") == k, 1)) + 1.0) for k in range(PARCELS)]).alias("logpi")
    )
    return priors.IndependentPrior(PARCELS, table=counts)


@query("softmax_prior", f"""
WITH {VOX}, {LABEL_PRIOR}
SELECT vox_id, k, round(exp(lp) / sum(exp(lp)) OVER (PARTITION BY vox_id), 6) + 0.0 AS p FROM pri""")
def softmax_prior(spark, sf):
    return views.explode_parcels(label_prior(spark, sf).marginal_full(), "pi", "vox_id")


@query("marginal_flat", f"""
WITH {VOX}, n AS (SELECT label, count(*)::DOUBLE AS n FROM vox GROUP BY ALL), p AS (SELECT label AS k, n / sum(n) OVER () AS pi FROM n)
SELECT x.vox_id, p.k::BIGINT AS k, round(p.pi, 6) + 0.0 AS p FROM (SELECT DISTINCT vox_id FROM vox) x CROSS JOIN p""")
def marginal_flat(spark, sf):
    """The marginal of a prior without locations of its own, at the locations of the data."""
    rows = views.vox(spark, sf)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = priors.IndependentPrior(PARCELS, flat=np.log([counts.get(k, 0) for k in range(PARCELS)]), spatial=False)
    nodes = rows.select(F.col("vox_id").alias("node_id")).distinct()
    return views.explode_parcels(prior.marginal_full(nodes), "pi", "vox_id")


_POST_SQL = f"{VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {SOFTMAX}"


def _posterior(spark, sf):
    return mixture.posterior(vox_aligned(spark, sf), label_vmf(spark, sf))


_LN = "CASE WHEN p > 0 THEN ln(p) ELSE -3.4028234663852886e38 END"


@query("prior_mstep", f"""
WITH {_POST_SQL}, m AS (SELECT vox_id, k, avg(p) AS p FROM post GROUP BY ALL)
SELECT vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM m""")
def prior_mstep(spark, sf):
    logpi = priors.prior_from_posterior(_posterior(spark, sf), PARCELS)
    return views.explode_parcels(logpi.select("vox_id", F.transform("logpi", F.exp).alias("p")), "p", "vox_id")


@query("prior_mstep_flat", f"""
WITH {_POST_SQL}, m AS (SELECT k, avg(p) AS p FROM post GROUP BY ALL)
SELECT k::BIGINT AS k, round({_LN}, 6) + 0.0 AS lp FROM m""")
def prior_mstep_flat(spark, sf):
    logpi = priors.prior_from_posterior(_posterior(spark, sf), PARCELS, spatial=False)
    return views.explode_parcels(logpi, "logpi", alias="lp")


@query("prior_nonredundant", f"""
WITH {_POST_SQL}, m AS (SELECT k, avg(p) AS p FROM post GROUP BY ALL)
SELECT k::BIGINT AS k, round(ln(p) - (SELECT ln(p) FROM m WHERE k = {PARCELS - 1}), 6) + 0.0 AS lp FROM m""")
def prior_nonredundant(spark, sf):
    logpi = priors.prior_from_posterior(_posterior(spark, sf), PARCELS, spatial=False, drop_last=True)
    return views.explode_parcels(logpi, "logpi", alias="lp")


# Shares of a user's events per type in the first week: some are zero, and a
# user without events has none at all.
_SHARES = """
us AS (SELECT DISTINCT user_id FROM events),
ty AS (SELECT DISTINCT event_type FROM events),
wk AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE extract(day FROM ts) <= 3 GROUP BY ALL),
tt AS (SELECT user_id, sum(n) AS n FROM wk GROUP BY ALL),
pr AS (SELECT u.user_id, t.event_type, CASE WHEN tt.n IS NULL THEN NULL ELSE coalesce(w.n, 0) / tt.n END AS p
       FROM us u CROSS JOIN ty t LEFT JOIN wk w ON w.user_id = u.user_id AND w.event_type = t.event_type
       LEFT JOIN tt ON tt.user_id = u.user_id),
cp AS (SELECT user_id, event_type, coalesce(p, 0.2) AS p FROM pr),
sh AS (SELECT CASE WHEN min(p) > 0 THEN 0 ELSE 1e-8 END AS e FROM cp)"""


@query("clean_prior", f"""
WITH {_SHARES}
SELECT user_id AS vox_id, dense_rank() OVER (ORDER BY event_type) - 1 AS k, round(ln(p + sh.e), 6) + 0.0 AS lp
FROM cp CROSS JOIN sh""")
def clean_prior(spark, sf):
    early = F.dayofmonth("ts") <= 3
    n = F.count(F.when(early, 1))
    shares = [F.try_divide(F.count(F.when(early & (F.col("event_type") == t), 1)), n) for t in views.EVENT_TYPES]
    prob = table(spark, sf, "events").groupBy(F.col("user_id").alias("vox_id")).agg(F.array(*shares).alias("prob"))
    return views.explode_parcels(priors.clean_probabilities(prob, 5), "logpi", "vox_id", alias="lp")


# ---------------------------------------------------------------- hemispheres

HALF = PARCELS // 2

# Blocks of five locations: two left-right pairs and one on the midline.
_PAIRS = """
lay AS (
  SELECT vox_id, CASE vox_id % 5 WHEN 1 THEN vox_id - 1 WHEN 3 THEN vox_id - 1 ELSE vox_id END AS node_id, side
  FROM (SELECT DISTINCT vox_id FROM vox) v CROSS JOIN (VALUES (0), (1)) t(side)
  WHERE vox_id % 5 = 4 OR vox_id % 5 % 2 = side
),
node AS (SELECT node_id, min(vox_id) = max(vox_id) AS mid FROM lay GROUP BY ALL)"""


def pair_layout(spark, sf, same_parcels=False) -> priors.Layout:
    v = views.vox(spark, sf).select("vox_id").distinct()
    r = F.col("vox_id") % 5
    node = F.when(r.isin(1, 3), F.col("vox_id") - 1).otherwise(F.col("vox_id"))
    # The last pair may lack its right location: the left one is not on the midline for that.
    side = lambda *rs: F.max(F.when(r.isin(*rs), F.col("vox_id")))
    pairs = v.groupBy(node.alias("node_id")).agg(side(0, 2, 4).alias("left_vox"), side(1, 3, 4).alias("right_vox"))
    return priors.Layout.symmetric(pairs, same_parcels)


_SYM_POST = f"""
nl AS (
  SELECT s.subj_id, l.node_id, s.k % {HALF} AS k, sum(s.ll) AS ll
  FROM sc s JOIN lay l ON s.vox_id = l.vox_id AND s.k // {HALF} = l.side GROUP BY ALL
),
nm AS (SELECT subj_id, node_id, max(ll) AS m FROM nl GROUP BY ALL),
ne AS (SELECT n.subj_id, n.node_id, n.k, exp(n.ll - m.m) AS e
       FROM nl n JOIN nm m ON n.subj_id = m.subj_id AND n.node_id = m.node_id),
np AS (SELECT subj_id, node_id, k, e / sum(e) OVER (PARTITION BY subj_id, node_id) AS u FROM ne),
full_p AS (
  SELECT p.subj_id, l.vox_id, p.k + {HALF} * t.side AS k,
         CASE WHEN n.mid THEN p.u / 2 WHEN t.side = l.side THEN p.u ELSE 0 END AS p
  FROM np p JOIN (SELECT vox_id, node_id, min(side) AS side FROM lay GROUP BY ALL) l ON p.node_id = l.node_id
  JOIN node n ON n.node_id = p.node_id CROSS JOIN (VALUES (0), (1)) t(side)
)"""


@query("symmetric_estep", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {_PAIRS}, {_SYM_POST}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM full_p""")
def symmetric_estep(spark, sf):
    """Left and right evidence of a node are added before the posterior."""
    prior = priors.IndependentPrior(HALF, layout=pair_layout(spark, sf))
    aligned = mixture.align([views.vox_evidence(spark, sf)], prior)
    post = mixture.posterior(aligned, mixture.Model(prior, label_vmf(spark, sf).emissions))
    return views.explode_parcels(post, "uhat", "subj_id", "vox_id")


@query("symmetric_map_roundtrip", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {_PAIRS}, {_SYM_POST}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM full_p""")
def symmetric_map_roundtrip(spark, sf):
    """The same posterior with the gather and spread maps as table operators."""
    layout = pair_layout(spark, sf)
    ll = mixture.loglik(views.vox_evidence(spark, sf), label_vmf(spark, sf).emissions[0])
    nodes = priors.gather(ll, layout, HALF).select("subj_id", "node_id", A.softmax(F.col("ll")).alias("u"))
    return views.explode_parcels(priors.spread(nodes, layout, HALF), "u", "subj_id", "vox_id")


@query("symmetric_same_parcels_estep", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {_PAIRS},
nl AS (SELECT s.subj_id, l.node_id, s.k, sum(s.ll) AS ll FROM sc s JOIN lay l ON s.vox_id = l.vox_id GROUP BY ALL),
nm AS (SELECT subj_id, node_id, max(ll) AS m FROM nl GROUP BY ALL),
ne AS (SELECT n.subj_id, n.node_id, n.k, exp(n.ll - m.m) AS e
       FROM nl n JOIN nm m ON n.subj_id = m.subj_id AND n.node_id = m.node_id),
np AS (SELECT subj_id, node_id, k, e / sum(e) OVER (PARTITION BY subj_id, node_id) AS u FROM ne)
SELECT p.subj_id, l.vox_id, p.k::BIGINT AS k, round(p.u, 6) + 0.0 AS p
FROM np p JOIN (SELECT DISTINCT vox_id, node_id FROM lay) l ON p.node_id = l.node_id""")
def symmetric_same_parcels_estep(spark, sf):
    prior = priors.IndependentPrior(PARCELS, layout=pair_layout(spark, sf, same_parcels=True))
    aligned = mixture.align([views.vox_evidence(spark, sf)], prior)
    post = mixture.posterior(aligned, mixture.Model(prior, label_vmf(spark, sf).emissions))
    return views.explode_parcels(post, "uhat", "subj_id", "vox_id")


@query("symmetric_prior", f"""
WITH {VOX}, {LABEL_PRIOR}, {_PAIRS},
sy AS (SELECT l.node_id, p.k % {HALF} AS k, sum(p.lp) AS lp FROM pri p JOIN lay l ON p.vox_id = l.vox_id AND p.k // {HALF} = l.side GROUP BY ALL)
SELECT s.node_id, s.k, round(CASE WHEN n.mid THEN s.lp ELSE s.lp / 2 END, 6) + 0.0 AS lp
FROM sy s JOIN node n ON s.node_id = n.node_id""")
def symmetric_prior(spark, sf):
    logpi = label_prior(spark, sf).table.withColumnRenamed("node_id", "vox_id")
    out = priors.halve_paired(logpi, pair_layout(spark, sf), HALF)
    return views.explode_parcels(out, "logpi", "node_id", alias="lp")


@query("separate_hem_estep", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES},
lay AS (
  SELECT vox_id, vox_id AS node_id, side
  FROM (SELECT DISTINCT vox_id FROM vox) v CROSS JOIN (VALUES (0), (1)) t(side)
  WHERE vox_id % 3 = 2 OR vox_id % 3 = side
),
node AS (SELECT node_id, count(*) = 2 AS mid FROM lay GROUP BY ALL), {_SYM_POST}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM full_p""")
def separate_hem_estep(spark, sf):
    sides = views.vox(spark, sf).select("vox_id").distinct().withColumn(
        "side", F.when(F.col("vox_id") % 3 == 0, -1).when(F.col("vox_id") % 3 == 1, 1).otherwise(0)
    )
    prior = priors.IndependentPrior(HALF, layout=priors.Layout.separate(sides))
    aligned = mixture.align([views.vox_evidence(spark, sf)], prior)
    post = mixture.posterior(aligned, mixture.Model(prior, label_vmf(spark, sf).emissions))
    return views.explode_parcels(post, "uhat", "subj_id", "vox_id")


# ---------------------------------------------------------------- samples

@query("sample_prior_md5", f"""
WITH {VOX}, {LABEL_PRIOR},
pp AS (SELECT vox_id, k, exp(lp) / sum(exp(lp)) OVER (PARTITION BY vox_id) AS p FROM pri),
cm AS (SELECT vox_id, k, sum(p) OVER (PARTITION BY vox_id ORDER BY k) AS c FROM pp),
dr AS (SELECT vox_id, s AS subj_id, ('0x' || substr(md5('7|' || s || '|' || vox_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
       FROM (SELECT DISTINCT vox_id FROM vox) CROSS JOIN range(20) t(s))
SELECT d.subj_id, d.vox_id, coalesce(min(CASE WHEN d.u < c.c THEN c.k END), 0)::BIGINT AS label
FROM dr d JOIN cm c ON d.vox_id = c.vox_id GROUP BY ALL""")
def sample_prior_md5(spark, sf):
    """Twenty subjects drawn from the prior by inverse transform."""
    subjects = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))
    cells = label_prior(spark, sf).marginal_full().select("vox_id", "pi", subjects.alias("subj_id"))
    u = randoms.uniform(7, F.col("subj_id"), F.col("vox_id"))
    return cells.select("subj_id", "vox_id", randoms.pick_category(F.col("pi"), u).cast("long").alias("label"))


# ---------------------------------------------------------------- fusion

PART = views.WIDTH // 2

# Two datasets: the halves of every vector; the second one numbers its subjects
# so that local subject s is subject s + 2 of the study.
_HALVES = f"""
hl AS (SELECT h.ds, x.subj_id AS local_subj, x.subj_id + 2 * h.ds AS subj_id, x.vox_id, x.label, x.m - {PART} * h.ds AS m, x.v
       FROM voxl x JOIN (VALUES (0), (1)) h(ds) ON x.m // {PART} = h.ds),
hn AS (SELECT ds, subj_id, vox_id, sqrt(sum(v * v)) AS n FROM hl GROUP BY ALL),
hu AS (SELECT l.ds, l.local_subj, l.subj_id, l.vox_id, l.label, l.m, l.v / n.n AS v
       FROM hl l JOIN hn n ON l.ds = n.ds AND l.subj_id = n.subj_id AND l.vox_id = n.vox_id),
hy AS (SELECT ds, label AS k, m, sum(v) AS s FROM hu GROUP BY ALL),
hj AS (SELECT ds, label AS k, count(*) / {PART} AS j FROM hu GROUP BY ALL),
hlen AS (SELECT ds, k, sqrt(sum(s * s)) AS n FROM hy GROUP BY ALL),
hd AS (SELECT y.ds, y.k, y.m, y.s / l.n AS v FROM hy y JOIN hlen l ON y.ds = l.ds AND y.k = l.k),
hk AS (SELECT ds, {sql_concentration('r', PART)} AS kappa FROM (
  SELECT l.ds, avg(l.n / j.j) AS r FROM hlen l JOIN hj j ON l.ds = j.ds AND l.k = j.k GROUP BY l.ds)),
hs AS (SELECT x.ds, x.subj_id, x.vox_id, d.k, max({sql_log_constant(PART, 'q.kappa')}) + max(q.kappa) * sum(x.v * d.v) AS ll
       FROM hu x JOIN hd d ON x.ds = d.ds AND x.m = d.m JOIN hk q ON q.ds = x.ds GROUP BY x.ds, x.subj_id, x.vox_id, d.k)"""


def halves(spark, sf):
    """Evidence of the two datasets with study-wide subjects, and the subject map."""
    rows = views.vox(spark, sf)
    data = []
    for d in (0, 1):
        part = A.unit(F.slice("y", d * PART + 1, PART))
        local = rows.select("subj_id", "vox_id", "label", F.lit(1.0).alias("num_part"), part.alias("y"))
        data.append(local.withColumn("subj_id", F.col("subj_id") + 2 * d))
    subjects = rows.select("subj_id").distinct()
    subject_map = None
    for d in (0, 1):
        m = subjects.select(
            F.lit(d).alias("dataset_id"), F.col("subj_id").alias("local_subj"), (F.col("subj_id") + 2 * d).alias("subj_id")
        )
        subject_map = m if subject_map is None else subject_map.unionByName(m)
    return data, subject_map


def fused_model(spark, sf, weights=None) -> tuple[mixture.Aligned, mixture.Model]:
    data, _ = halves(spark, sf)
    models = []
    for e in data:
        one = mixture.align([e])
        df = e.select(
            "subj_id", F.col("vox_id").alias("node_id"), F.col("num_part").alias("n0_0"), F.col("y").alias("y0_0"),
            A.one_hot(F.col("label"), PARCELS).alias("uhat"),
        )
        start = mixture.Model(
            priors.IndependentPrior(PARCELS), (em.VonMisesFisher(np.full((PART, PARCELS), 1 / math.sqrt(PART))),)
        )
        models.append(mixture.m_step(mixture.Aligned(df, one.slots), start).emissions[0])
    return mixture.align(data), mixture.Model(priors.IndependentPrior(PARCELS), tuple(models), weights)


@query("fuse_collect", f"""
WITH {VOX}, {_HALVES}
SELECT subj_id, vox_id, k::BIGINT AS k, round(sum(ll), 5) + 0.0 AS ll FROM hs GROUP BY ALL""")
def fuse_collect(spark, sf):
    aligned, model = fused_model(spark, sf)
    return views.explode_parcels(mixture.scores(aligned, model), "ll", "subj_id", "vox_id", alias="ll", digits=5)


_FUSED = f"""
sc AS (SELECT subj_id, vox_id, k, sum(CASE ds WHEN 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * ll) AS ll FROM hs GROUP BY ALL),
{SOFTMAX}"""


@query("fuse_weighted", f"""
WITH {VOX}, {_HALVES}, {_FUSED}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post""")
def fuse_weighted(spark, sf):
    aligned, model = fused_model(spark, sf, (1.0, 0.5))
    return views.explode_parcels(mixture.posterior(aligned, model), "uhat", "subj_id", "vox_id")


@query("fuse_distribute", f"""
WITH {VOX}, {_HALVES}, {_FUSED}
SELECT h.ds::BIGINT AS dataset_id, h.local_subj, p.vox_id, p.k::BIGINT AS k, round(p.p, 6) + 0.0 AS p
FROM post p JOIN (SELECT DISTINCT ds, local_subj, subj_id FROM hu) h ON p.subj_id = h.subj_id""")
def fuse_distribute(spark, sf):
    aligned, model = fused_model(spark, sf, (1.0, 0.5))
    _, subject_map = halves(spark, sf)
    out = mixture.distribute(mixture.posterior(aligned, model), subject_map)
    out = out.withColumn("dataset_id", F.col("dataset_id").cast("long"))
    return views.explode_parcels(out, "uhat", "dataset_id", "local_subj", "vox_id")


@query("fuse_gated", f"""
WITH {VOX}, {_HALVES}, sc AS (SELECT subj_id, vox_id, k, sum(ll * ds) AS ll FROM hs GROUP BY ALL), {SOFTMAX}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post""")
def fuse_gated(spark, sf):
    """A first pass that lets only the second dataset speak."""
    aligned, model = fused_model(spark, sf)
    return views.explode_parcels(mixture.posterior(aligned, model, [False, True]), "uhat", "subj_id", "vox_id")



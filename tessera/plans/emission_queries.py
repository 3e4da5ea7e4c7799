"""Emission models on the benchmark tables: M-steps, scores and posteriors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import special
from tessera.operators import emissions as em
from tessera.operators import evidence, mixture
from tessera.operators.priors import IndependentPrior
from tessera.plans import views
from tessera.plans.registry import query
from tessera.plans.views import EVENT_TYPES, EVT_EVIDENCE, PARCELS, VOX, WIDTH, r6, table

# ---------------------------------------------------------------- constants


def sql_log_bessel(order: str, kappa: str) -> str:
    z = f"(({kappa}) / ({order}))"
    root = f"sqrt(1 + {z} * {z})"
    return (
        f"(-ln(sqrt(2 * pi() * ({order}))) + ({order}) * ({root} + ln({z}) - ln(1 + {root}))"
        f" - 0.25 * ln(1 + {z} * {z}))"
    )


def sql_log_constant(dim: int, kappa: str) -> str:
    h = dim / 2
    return f"({h - 1} * ln({kappa}) - {h} * ln(2 * pi()) - {sql_log_bessel(str(h - 1), kappa)})"


def sql_concentration(r: str, dim: int) -> str:
    c = f"least(greatest({r}, 0.01::DOUBLE), 0.99::DOUBLE)"
    return f"(({c} * {dim} - {c} * {c} * {c}) / (1 - {c} * {c}))"


@query("log_bessel", f"""
SELECT l_suppkey, round(avg({sql_log_bessel('1.5', 'l_quantity')}), 6) + 0.0 AS low,
       round(avg({sql_log_bessel('31', 'l_quantity')}), 6) + 0.0 AS high,
       round(avg({sql_log_constant(64, 'l_quantity')}), 6) + 0.0 AS log_c
FROM lineitem GROUP BY ALL""")
def log_bessel(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        r6(F.avg(special.log_bessel(1.5, q))).alias("low"), r6(F.avg(special.log_bessel(31, q))).alias("high"),
        r6(F.avg(special.vmf_log_constant(64, q))).alias("log_c"),
    )


# ---------------------------------------------------------------- labelled models


def labelled(spark, sf) -> mixture.Aligned:
    """Embeddings with their true label as the (certain) posterior."""
    rows = views.vox_evidence(spark, sf)
    aligned = mixture.align([rows])
    with_label = rows.select(
        "subj_id", F.col("vox_id").alias("node_id"), F.col("num_part").alias("n0_0"), F.col("y").alias("y0_0"),
        A.one_hot(F.col("label"), PARCELS).alias("uhat"),
    )
    return mixture.Aligned(with_label, aligned.slots)


def start_vmf(width=WIDTH, k=PARCELS, **flags):
    v = np.full((width, k), 1 / math.sqrt(width))
    return mixture.Model(IndependentPrior(k), (em.VonMisesFisher(v, **flags),))


def label_vmf(spark, sf, **flags) -> mixture.Model:
    """Directions and concentration of the labelled embeddings: one M-step."""
    return mixture.m_step(labelled(spark, sf), start_vmf(**flags))


def vox_aligned(spark, sf) -> mixture.Aligned:
    return mixture.align([views.vox_evidence(spark, sf)])


# Sums per label; the direction is the normalised sum, and its product with the
# mean vector is the length of the sum over the number of vectors.
LABEL_SUMS = """
yu AS (SELECT label AS k, m, sum(v) AS s FROM voxl GROUP BY ALL),
ju AS (SELECT label AS k, count(*)::DOUBLE AS j FROM vox GROUP BY ALL),
len AS (SELECT k, sqrt(sum(s * s)) AS n FROM yu GROUP BY ALL),
dir AS (SELECT y.k, y.m, y.s / l.n AS v FROM yu y JOIN len l ON y.k = l.k)"""

SHARED_KAPPA = f"""
kap AS (SELECT {sql_concentration('r', WIDTH)} AS kappa FROM (
  SELECT avg(l.n / j.j) AS r FROM len l JOIN ju j ON l.k = j.k))"""

VMF_SCORES = f"""
sc AS (
  SELECT x.subj_id, x.vox_id, d.k, max({sql_log_constant(WIDTH, 'q.kappa')}) + max(q.kappa) * sum(x.v * d.v) AS ll
  FROM voxl x JOIN dir d ON x.m = d.m CROSS JOIN kap q GROUP BY x.subj_id, x.vox_id, d.k
)"""

SOFTMAX = """
mx AS (SELECT subj_id, vox_id, max(ll) AS m FROM sc GROUP BY ALL),
ex AS (SELECT s.subj_id, s.vox_id, s.k, exp(s.ll - m.m) AS e
       FROM sc s JOIN mx m ON s.subj_id = m.subj_id AND s.vox_id = m.vox_id),
post AS (SELECT subj_id, vox_id, k, e / sum(e) OVER (PARTITION BY subj_id, vox_id) AS p FROM ex)"""


def parameter_rows(spark, model: mixture.Model):
    """Parameters of the first emission model as rows ``name, m, k, value``."""
    rows = []
    for name, value in model.emissions[0].params().items():
        value = np.atleast_2d(value)
        for (m, k), x in np.ndenumerate(value):
            rows.append((name, m, k, float(round(x, 6)) + 0.0))
    return spark.createDataFrame(rows, "name string, m long, k long, value double")


_V_SQL = "SELECT 'V' AS name, m::BIGINT AS m, k::BIGINT AS k, round(v, 6) + 0.0 AS value FROM dir"


@query("vmf_mstep_shared", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}
{_V_SQL} UNION ALL SELECT 'kappa', 0, 0, round(kappa, 6) FROM kap""")
def vmf_mstep_shared(spark, sf):
    return parameter_rows(spark, label_vmf(spark, sf))


@query("vmf_mstep_parcel", f"""
WITH {VOX}, {LABEL_SUMS}
{_V_SQL} UNION ALL SELECT 'kappa', 0, l.k, round({sql_concentration('(l.n / j.j)', WIDTH)}, 6)
FROM len l JOIN ju j ON l.k = j.k""")
def vmf_mstep_parcel(spark, sf):
    return parameter_rows(spark, label_vmf(spark, sf, per_parcel=True))


_SUBJECT_SUMS = """
sj AS (SELECT x.subj_id, x.label AS k, sum(x.v * d.v) AS a
       FROM voxl x JOIN dir d ON x.label = d.k AND x.m = d.m GROUP BY ALL),
sn AS (SELECT subj_id, label AS k, count(*)::DOUBLE AS j FROM vox GROUP BY ALL)"""


def _kappa_rows(model):
    return model.kappa_table(0).select("subj_id", F.posexplode("kappa").alias("k", "v")).select(
        "subj_id", F.col("k").cast("long").alias("k"), r6(F.col("v")).alias("kappa")
    )


@query("vmf_mstep_subject", f"""
WITH {VOX}, {LABEL_SUMS}, {_SUBJECT_SUMS},
r AS (SELECT a.subj_id, CASE WHEN count(*) = {PARCELS} THEN avg(a.a / n.j) END AS r
      FROM sj a JOIN sn n ON a.subj_id = n.subj_id AND a.k = n.k GROUP BY ALL)
SELECT subj_id, 0::BIGINT AS k, round({sql_concentration('r', WIDTH)}, 6) AS kappa FROM r""")
def vmf_mstep_subject(spark, sf):
    return _kappa_rows(label_vmf(spark, sf, per_subject=True))


@query("vmf_mstep_both", f"""
WITH {VOX}, {LABEL_SUMS}, {_SUBJECT_SUMS}
SELECT a.subj_id, a.k::BIGINT AS k, round({sql_concentration('(a.a / n.j)', WIDTH)}, 6) AS kappa
FROM sj a JOIN sn n ON a.subj_id = n.subj_id AND a.k = n.k""")
def vmf_mstep_both(spark, sf):
    return _kappa_rows(label_vmf(spark, sf, per_subject=True, per_parcel=True))


@query("vmf_mstep_equal_weight", f"""
WITH {VOX}, {LABEL_SUMS},
ys AS (SELECT subj_id, label AS k, m, sum(v) AS s FROM voxl GROUP BY ALL),
ns AS (SELECT subj_id, label AS k, count(*)::DOUBLE AS j FROM vox GROUP BY ALL),
mu AS (SELECT y.k, y.m, avg(y.s / n.j) AS u FROM ys y JOIN ns n ON y.subj_id = n.subj_id AND y.k = n.k GROUP BY ALL),
un AS (SELECT k, sqrt(sum(u * u)) AS n FROM mu GROUP BY ALL),
vw AS (SELECT m.k, m.m, m.u / n.n AS v FROM mu m JOIN un n ON m.k = n.k),
rb AS (SELECT y.k, sum(y.s / j.j * v.v) AS r FROM yu y JOIN ju j ON y.k = j.k JOIN vw v ON y.k = v.k AND y.m = v.m GROUP BY ALL)
SELECT 'V' AS name, m::BIGINT AS m, k::BIGINT AS k, round(v, 6) + 0.0 AS value FROM vw
UNION ALL SELECT 'kappa', 0, 0, round({sql_concentration('(SELECT avg(r) FROM rb)', WIDTH)}, 6)""")
def vmf_mstep_equal_weight(spark, sf):
    return parameter_rows(spark, label_vmf(spark, sf, equal_weight=True))


# ---------------------------------------------------------------- posteriors

VMF_ESTEP_SQL = f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {SOFTMAX}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post"""


@query("vmf_estep", VMF_ESTEP_SQL)
def vmf_estep(spark, sf):
    """Flagship: posterior of every embedding under the labelled directions."""
    post = mixture.posterior(vox_aligned(spark, sf), label_vmf(spark, sf))
    return views.explode_parcels(post, "uhat", "subj_id", "vox_id")


@query("vmf_loglik", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}
SELECT subj_id, vox_id, k::BIGINT AS k, round(ll, 5) + 0.0 AS ll FROM sc""")
def vmf_loglik(spark, sf):
    out = mixture.loglik(views.vox_evidence(spark, sf), label_vmf(spark, sf).emissions[0])
    return views.explode_parcels(out, "ll", "subj_id", "vox_id", alias="ll", digits=5)


@query("vmf_estep_parcel", f"""
WITH {VOX}, {LABEL_SUMS},
kap AS (SELECT l.k, {sql_concentration('(l.n / j.j)', WIDTH)} AS kappa FROM len l JOIN ju j ON l.k = j.k),
sc AS (
  SELECT x.subj_id, x.vox_id, d.k, max({sql_log_constant(WIDTH, 'q.kappa')}) + max(q.kappa) * sum(x.v * d.v) AS ll
  FROM voxl x JOIN dir d ON x.m = d.m JOIN kap q ON q.k = d.k GROUP BY x.subj_id, x.vox_id, d.k
), {SOFTMAX}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post""")
def vmf_estep_parcel(spark, sf):
    post = mixture.posterior(vox_aligned(spark, sf), label_vmf(spark, sf, per_parcel=True))
    return views.explode_parcels(post, "uhat", "subj_id", "vox_id")


@query("vmf_estep_subject", f"""
WITH {VOX}, {LABEL_SUMS}, {_SUBJECT_SUMS},
kap AS (SELECT a.subj_id, {sql_concentration('avg(a.a / n.j)', WIDTH)} AS kappa
        FROM sj a JOIN sn n ON a.subj_id = n.subj_id AND a.k = n.k GROUP BY ALL),
sc AS (
  SELECT x.subj_id, x.vox_id, d.k, max({sql_log_constant(WIDTH, 'q.kappa')}) + max(q.kappa) * sum(x.v * d.v) AS ll
  FROM voxl x JOIN dir d ON x.m = d.m JOIN kap q ON q.subj_id = x.subj_id GROUP BY x.subj_id, x.vox_id, d.k
), {SOFTMAX}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post""")
def vmf_estep_subject(spark, sf):
    post = mixture.posterior(vox_aligned(spark, sf), label_vmf(spark, sf, per_subject=True))
    return views.explode_parcels(post, "uhat", "subj_id", "vox_id")


# Four parcels of the event users by their location and subject number.
EVENT_PARCELS = 4


def event_model(spark, sf, rows=None):
    rows = views.event_evidence(spark, sf) if rows is None else rows
    aligned = mixture.align([rows])
    fixed = mixture.Aligned(
        aligned.df.withColumn("uhat", A.one_hot((F.col("node_id") + F.col("subj_id")) % EVENT_PARCELS, EVENT_PARCELS)), aligned.slots
    )
    return aligned, mixture.m_step(fixed, start_vmf(len(EVENT_TYPES), EVENT_PARCELS))


EVENT_SUMS = f"""
yu AS (SELECT (vox_id + subj_id) % {EVENT_PARCELS} AS k, cond, sum(y) AS s FROM eve GROUP BY ALL),
ju AS (SELECT (vox_id + subj_id) % {EVENT_PARCELS} AS k, sum(num_part) AS j FROM evs GROUP BY ALL),
len AS (SELECT k, sqrt(sum(s * s)) AS n FROM yu GROUP BY ALL),
dir AS (SELECT y.k, y.cond, y.s / l.n AS v FROM yu y JOIN len l ON y.k = l.k),
kap AS (SELECT {sql_concentration('r', 5)} AS kappa FROM (
  SELECT avg(l.n / j.j) AS r FROM len l JOIN ju j ON l.k = j.k)),
sc AS (
  SELECT x.subj_id, x.vox_id, d.k,
         max({sql_log_constant(5, 'q.kappa')} * x.num_part) + max(q.kappa) * sum(x.y * d.v) AS ll
  FROM eve x JOIN dir d ON x.cond = d.cond CROSS JOIN kap q GROUP BY x.subj_id, x.vox_id, d.k
)"""


@query("vmf_estep_missing", f"""
WITH {EVT_EVIDENCE}, {EVENT_SUMS}, {SOFTMAX}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post""")
def vmf_estep_missing(spark, sf):
    aligned, model = event_model(spark, sf)
    return views.explode_parcels(mixture.posterior(aligned, model), "uhat", "subj_id", "vox_id")


_WVMF_SQL = EVT_EVIDENCE.replace(
    "eve AS (", """wtot AS (
  SELECT subj_id, part_id, sum(CASE WHEN n = 5 THEN len * len ELSE 0 END) AS t FROM evn GROUP BY ALL
),
wp AS (SELECT count(DISTINCT vox_id) AS p FROM evt),
ww AS (
  SELECT n.subj_id, n.vox_id, n.part_id, CASE WHEN n.n = 5 THEN n.len * n.len ELSE 0 END * wp.p / nullif(t.t, 0) AS w
  FROM evn n JOIN wtot t ON n.subj_id = t.subj_id AND n.part_id = t.part_id CROSS JOIN wp
),
evw AS (SELECT subj_id, vox_id, sum(w) AS num_part FROM ww GROUP BY ALL),
old AS (""", 1).replace("SELECT s.subj_id, s.vox_id, s.num_part, c.cond,", "SELECT s.subj_id, s.vox_id, c.cond,") + f""",
eve AS (
  SELECT s.subj_id, s.vox_id, s.num_part, c.cond,
         coalesce(sum(CASE WHEN n.n = 5 AND n.len > 0 THEN m.y / n.len * w.w END), 0) AS y
  FROM evw s CROSS JOIN conds c
  LEFT JOIN evm m ON m.subj_id = s.subj_id AND m.vox_id = s.vox_id AND m.cond = c.cond
  LEFT JOIN evn n ON n.subj_id = m.subj_id AND n.vox_id = m.vox_id AND n.part_id = m.part_id
  LEFT JOIN ww w ON w.subj_id = m.subj_id AND w.vox_id = m.vox_id AND w.part_id = m.part_id
  GROUP BY ALL
), {EVENT_SUMS.replace('FROM evs', 'FROM evw')}, {SOFTMAX}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post"""


@query("wvmf_estep", "WITH " + _WVMF_SQL)
def wvmf_estep(spark, sf):
    """Weighted evidence: a long response counts as if it had been seen more often."""
    from tessera.plans.evidence_queries import weighted_vectors

    weighted = evidence.collapse(weighted_vectors(spark, sf, "lsquare_sum2P"), len(EVENT_TYPES), weight="w")
    aligned, model = event_model(spark, sf, weighted)
    return views.explode_parcels(mixture.posterior(aligned, model), "uhat", "subj_id", "vox_id")


# ---------------------------------------------------------------- Gaussian

GMM_PARAMS = f"""
gmean AS (SELECT y.k, y.m, y.s / j.j AS v FROM yu y JOIN ju j ON y.k = j.k),
gn AS (SELECT k, sqrt(sum(v * v)) AS n FROM gmean GROUP BY ALL),
gv AS (SELECT g.k, g.m, g.v / n.n AS v FROM gmean g JOIN gn n ON g.k = n.k),
gs AS (
  SELECT sum((x.v - g.v) * (x.v - g.v)) / ({WIDTH} * (SELECT count(*) FROM vox)) AS sigma2
  FROM voxl x JOIN gv g ON x.label = g.k AND x.m = g.m
)"""


def label_gmm(spark, sf):
    start = em.IsotropicGaussian(np.zeros((WIDTH, PARCELS)))
    return mixture.m_step(labelled(spark, sf), mixture.Model(IndependentPrior(PARCELS), (start,)))


@query("gmm_mstep", f"""
WITH {VOX}, {LABEL_SUMS}, {GMM_PARAMS}
SELECT 'V' AS name, m::BIGINT AS m, k::BIGINT AS k, round(v, 6) + 0.0 AS value FROM gv
UNION ALL SELECT 'sigma2', 0, 0, round(sigma2, 6) FROM gs""")
def gmm_mstep(spark, sf):
    return parameter_rows(spark, label_gmm(spark, sf))


@query("gmm_estep", f"""
WITH {VOX}, {LABEL_SUMS}, {GMM_PARAMS},
sc AS (
  SELECT x.subj_id, x.vox_id, g.k,
         -0.5 * {WIDTH} * (ln(pi()) + ln(max(s.sigma2))) - 0.5 / max(s.sigma2) * sum((x.v - g.v) * (x.v - g.v)) AS ll
  FROM voxl x JOIN gv g ON x.m = g.m CROSS JOIN gs s GROUP BY x.subj_id, x.vox_id, g.k
), {SOFTMAX}
SELECT s.subj_id, s.vox_id, s.k::BIGINT AS k, round(s.ll, 5) + 0.0 AS ll, round(p.p, 6) + 0.0 AS p
FROM sc s JOIN post p ON s.subj_id = p.subj_id AND s.vox_id = p.vox_id AND s.k = p.k""")
def gmm_estep(spark, sf):
    model = label_gmm(spark, sf)
    ll = mixture.loglik(views.vox_evidence(spark, sf), model.emissions[0])
    both = ll.select("subj_id", "vox_id", F.arrays_zip("ll", A.softmax(F.col("ll")).alias("p")).alias("z"))
    return both.select("subj_id", "vox_id", F.posexplode("z").alias("k", "z")).select(
        "subj_id", "vox_id", F.col("k").cast("long").alias("k"), r6(F.col("z.ll"), 5).alias("ll"), r6(F.col("z.p")).alias("p")
    )


# Weekly means of a user as locations; a missing condition stays missing.
_EVENT_GMM = f"""
cell AS (SELECT subj_id, vox_id * 5 + part_id AS vox_id, cond, avg(value) AS y FROM evt GROUP BY ALL),
loc AS (SELECT subj_id, vox_id, vox_id % {EVENT_PARCELS} AS k, count(*) AS n,
               max(CASE WHEN cond = 'click' THEN 1 ELSE 0 END) AS has_first FROM cell GROUP BY ALL),
num AS (SELECT l.k, c.cond, sum(c.y) AS s FROM cell c JOIN loc l ON c.subj_id = l.subj_id AND c.vox_id = l.vox_id GROUP BY ALL),
den AS (SELECT k, sum(has_first)::DOUBLE AS u FROM loc GROUP BY ALL),
gv AS (SELECT n.k, n.cond, n.s / d.u AS v FROM num n JOIN den d ON n.k = d.k),
gs AS (
  SELECT sum((c.y - g.v) * (c.y - g.v)) / (5 * (SELECT count(*) FROM loc)) AS sigma2
  FROM cell c JOIN loc l ON c.subj_id = l.subj_id AND c.vox_id = l.vox_id
  JOIN gv g ON g.k = l.k AND g.cond = c.cond WHERE l.n = 5
)"""


@query("gmm_mstep_missing", f"""
WITH {views.EVT}, {_EVENT_GMM}
SELECT 'V' AS name, dense_rank() OVER (ORDER BY cond) - 1 AS m, k::BIGINT AS k, round(v, 6) + 0.0 AS value FROM gv
UNION ALL SELECT 'sigma2', 0, 0, round(sigma2, 6) FROM gs""")
def gmm_mstep_missing(spark, sf):
    """Missing observations: a location is valid for the mean if its first one is present."""
    vectors = evidence.partition_vectors(views.event_cells(spark, sf), EVENT_TYPES)
    node = F.col("vox_id") * 5 + F.col("part_id")
    df = vectors.select(
        "subj_id", node.alias("node_id"), F.lit(1.0).alias("n0_0"), F.col("y").alias("y0_0"),
        A.one_hot(node % EVENT_PARCELS, EVENT_PARCELS).alias("uhat"),
    )
    start = em.IsotropicGaussian(np.zeros((5, EVENT_PARCELS)), unit_v=False)
    model = mixture.m_step(
        mixture.Aligned(df, (mixture.Slot(0),)), mixture.Model(IndependentPrior(EVENT_PARCELS), (start,))
    )
    return parameter_rows(spark, model)


# ---------------------------------------------------------------- multinomial

_MULTI = f"""
wt AS (SELECT x.subj_id, x.vox_id, d.k, exp(5 * sum(x.v * d.v)) AS e FROM voxl x JOIN dir d ON x.m = d.m GROUP BY ALL),
uh AS (SELECT subj_id, vox_id, k, e / sum(e) OVER (PARTITION BY subj_id, vox_id) AS u FROM wt),
ag AS (SELECT sum(u.u) / (SELECT count(*) FROM vox) AS a FROM uh u JOIN vox x
       ON u.subj_id = x.subj_id AND u.vox_id = x.vox_id AND u.k = x.label),
mw AS (SELECT ln(1 - {PARCELS} + ({PARCELS} - 1) / (1 - a)) AS w FROM ag)"""


def _multinomial(spark, sf):
    """Labels as noisy indicators; posteriors from the products of the embeddings with the label directions."""
    rows = views.vox(spark, sf)
    v = label_vmf(spark, sf).emissions[0].v
    first = F.array(*[A.dot(F.col("y"), F.array(*[F.lit(float(x)) for x in v[:, k]])) for k in range(PARCELS)])
    df = rows.select(
        "subj_id", F.col("vox_id").alias("node_id"), F.lit(1.0).alias("n0_0"),
        A.one_hot(F.col("label"), PARCELS).alias("y0_0"), A.softmax(A.scale(first, F.lit(5.0))).alias("uhat"),
    )
    aligned = mixture.Aligned(df, (mixture.Slot(0),))
    return aligned, mixture.m_step(aligned, mixture.Model(IndependentPrior(PARCELS), (em.Multinomial(PARCELS),)))


@query("multinomial_mstep", f"WITH {VOX}, {LABEL_SUMS}, {_MULTI} SELECT round(w, 6) + 0.0 AS w FROM mw")
def multinomial_mstep(spark, sf):
    _, model = _multinomial(spark, sf)
    return spark.createDataFrame([(round(model.emissions[0].w, 6),)], "w double")


@query("multinomial_estep", f"""
WITH {VOX}, {LABEL_SUMS}, {_MULTI}
SELECT x.subj_id, x.vox_id, t.k, round(CASE WHEN x.label = t.k THEN mw.w ELSE 0 END - ln({PARCELS} - 1 + exp(mw.w)), 6) + 0.0 AS ll
FROM vox x CROSS JOIN range({PARCELS}) t(k) CROSS JOIN mw""")
def multinomial_estep(spark, sf):
    aligned, model = _multinomial(spark, sf)
    out = mixture.scores(mixture.Aligned(aligned.df.drop("uhat"), aligned.slots), model)
    return views.explode_parcels(out, "ll", "subj_id", "vox_id", alias="ll")


# ---------------------------------------------------------------- signal strength

GME_BINS = 88
GME_SIGMA2, GME_BETA = 0.05, 1.5

_GME = f"""
mxl AS (SELECT max(n) AS top FROM (SELECT sqrt(sum(v * v)) * 1.2 AS n FROM voxl GROUP BY subj_id, vox_id)),
bins AS (SELECT top / {GME_BINS} / 2 + (top - top / {GME_BINS} / 2) * i / {GME_BINS - 1} AS x
         FROM mxl CROSS JOIN range({GME_BINS}) t(i)),
yv AS (SELECT x.subj_id, x.vox_id, d.k, sum(x.v * d.v) AS a FROM voxl x JOIN dir d ON x.m = d.m GROUP BY x.subj_id, x.vox_id, d.k),
lg AS (SELECT y.*, b.x, (2 * y.a * b.x - b.x * b.x) / (2 * {GME_SIGMA2}) - {GME_BETA} * b.x AS l FROM yv y CROSS JOIN bins b),
lm AS (SELECT subj_id, vox_id, k, max(l) AS m FROM lg GROUP BY ALL),
sg AS (SELECT g.subj_id, g.vox_id, g.k, max(g.a) AS a, sum(exp(g.l - m.m) * g.x) / sum(exp(g.l - m.m)) AS s,
              sum(exp(g.l - m.m) * g.x * g.x) / sum(exp(g.l - m.m)) AS s2
       FROM lg g JOIN lm m ON g.subj_id = m.subj_id AND g.vox_id = m.vox_id AND g.k = m.k GROUP BY ALL),
yy AS (SELECT subj_id, vox_id, sum(v * v) AS yy FROM voxl GROUP BY ALL),
sc AS (SELECT s.subj_id, s.vox_id, s.k, -0.5 * {WIDTH} * (ln(2 * pi()) + ln({GME_SIGMA2}))
              - 0.5 / {GME_SIGMA2} * (y.yy - 2 * s.a * s.s + s.s2) + ln({GME_BETA}) - {GME_BETA} * s.s AS ll
       FROM sg s JOIN yy y ON s.subj_id = y.subj_id AND s.vox_id = y.vox_id)"""


def max_length(df) -> float:
    """Largest response length, 0 where nothing is observed: one aggregate."""
    top = df.agg(F.max(F.coalesce(A.norm(F.col("y")), F.lit(0.0))).alias("m")).first()["m"]
    return float(top)


def label_gme(spark, sf):
    v = label_vmf(spark, sf).emissions[0].v
    return em.GaussianExponential(v, max_length(views.vox(spark, sf)), GME_SIGMA2, GME_BETA, GME_BINS)


@query("gauss_exp_estep", f"""
WITH {VOX}, {LABEL_SUMS}, {_GME}
SELECT subj_id, vox_id, k::BIGINT AS k, round(ll, 5) + 0.0 AS ll FROM sc""")
def gauss_exp_estep(spark, sf):
    out = mixture.loglik(views.vox_evidence(spark, sf), label_gme(spark, sf))
    return views.explode_parcels(out, "ll", "subj_id", "vox_id", alias="ll", digits=5)


@query("gauss_exp_mstep", f"""
WITH {VOX}, {LABEL_SUMS}, {_GME},
su AS (SELECT s.* FROM sg s JOIN vox x ON s.subj_id = x.subj_id AND s.vox_id = x.vox_id AND s.k = x.label),
gm AS (SELECT u.k, x.m, sum(u.s * x.v) AS a FROM su u JOIN voxl x ON u.subj_id = x.subj_id AND u.vox_id = x.vox_id GROUP BY ALL),
gn AS (SELECT k, sqrt(sum(a * a)) AS n FROM gm GROUP BY ALL),
gv AS (SELECT g.k, g.m, g.a / n.n AS v FROM gm g JOIN gn n ON g.k = n.k),
gr AS (SELECT u.subj_id, u.vox_id, max(u.s) AS s, max(u.s2) AS s2, sum(x.v * x.v) AS yy, sum(x.v * g.v) AS yv
       FROM su u JOIN voxl x ON u.subj_id = x.subj_id AND u.vox_id = x.vox_id JOIN gv g ON g.k = u.k AND g.m = x.m GROUP BY ALL)
SELECT 'V' AS name, m::BIGINT AS m, k::BIGINT AS k, round(v, 6) + 0.0 AS value FROM gv
UNION ALL SELECT 'beta', 0, 0, round(count(*) / sum(s), 6) FROM su
UNION ALL SELECT 'sigma2', 0, 0, round(sum(yy - 2 * yv * s + s2) / ({WIDTH} * count(*)), 6) FROM gr""")
def gauss_exp_mstep(spark, sf):
    model = mixture.Model(IndependentPrior(PARCELS), (label_gme(spark, sf),))
    return parameter_rows(spark, mixture.m_step(labelled(spark, sf), model))

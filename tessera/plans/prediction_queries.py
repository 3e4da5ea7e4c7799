"""Prediction errors, homogeneity and cross-validation on the benchmark tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import crossval, homogeneity, matching, mixture, prediction
from tessera.plans import views
from tessera.plans.emission_queries import (
    LABEL_SUMS, SHARED_KAPPA, SOFTMAX, VMF_SCORES, label_vmf, vox_aligned,
)
from tessera.plans.label_queries import HARD
from tessera.plans.learning_queries import softened, sql_em
from tessera.plans.prior_queries import LABEL_PRIOR, label_prior
from tessera.plans.registry import query
from tessera.plans.views import PARCELS, SUBJECTS, VOX, WIDTH, r6

POST = f"{VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {SOFTMAX}"


def rows_with_posterior(spark, sf):
    post = mixture.posterior(vox_aligned(spark, sf), label_vmf(spark, sf))
    return views.vox(spark, sf).join(post, ["subj_id", "vox_id"])


def raw_directions(spark, sf) -> np.ndarray:
    return label_vmf(spark, sf).emissions[0].v


# Dot product of every vector with every direction, its length, and the kinds of prediction.
_DOTS = """
yd AS MATERIALIZED (SELECT x.subj_id, x.vox_id, d.k, sum(x.v * d.v) AS dot FROM voxl x JOIN dir d ON x.m = d.m GROUP BY x.subj_id, x.vox_id, d.k),
yn AS MATERIALIZED (SELECT subj_id, vox_id, sum(v * v) AS n2 FROM voxl GROUP BY ALL),
vd AS MATERIALIZED (SELECT a.k AS k, b.k AS l, sum(a.v * b.v) AS g FROM dir a JOIN dir b ON a.m = b.m GROUP BY a.k, b.k)"""
_PREDICT = {
    "expected": "SELECT p.subj_id, p.vox_id, sum(p.p * d.dot) AS fit FROM post p JOIN yd d ON p.subj_id = d.subj_id AND p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL",
    "hard": """SELECT q.subj_id, q.vox_id, d.dot AS fit FROM (
      SELECT *, row_number() OVER (PARTITION BY subj_id, vox_id ORDER BY p DESC, k) AS rn FROM post) q
      JOIN yd d ON q.subj_id = d.subj_id AND q.vox_id = d.vox_id AND q.k = d.k WHERE q.rn = 1""",
    "average": """SELECT e.subj_id, e.vox_id, e.fit / sqrt(s.len2) AS fit FROM (
      SELECT p.subj_id, p.vox_id, sum(p.p * d.dot) AS fit FROM post p JOIN yd d ON p.subj_id = d.subj_id AND p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL) e
      JOIN (SELECT p.subj_id, p.vox_id, sum(p.p * q.p * v.g) AS len2 FROM post p JOIN post q ON p.subj_id = q.subj_id AND p.vox_id = q.vox_id
            JOIN vd v ON v.k = p.k AND v.l = q.k GROUP BY ALL) s ON e.subj_id = s.subj_id AND e.vox_id = s.vox_id""",
}


def _register_cosine(kind, adjusted):
    value = "sum(n.n2 - f.fit * sqrt(n.n2)) / sum(n.n2)" if adjusted else "avg(1 - f.fit / sqrt(n.n2))"
    name = f"cosine_error_{kind}" + ("_adjusted" if adjusted else "")

    @query(name, f"""
WITH {POST}, {_DOTS}, f AS ({_PREDICT[kind]})
SELECT f.subj_id, round({value}, 6) + 0.0 AS cosine_error FROM f JOIN yn n ON f.subj_id = n.subj_id AND f.vox_id = n.vox_id GROUP BY ALL""")
    def cosine(spark, sf):
        e = prediction.cosine_error(rows_with_posterior(spark, sf), raw_directions(spark, sf), kind, adjusted)
        return e.select("subj_id", r6(F.col("cosine_error")).alias("cosine_error"))


for _kind in prediction.KINDS:
    for _adjusted in (False, True):
        _register_cosine(_kind, _adjusted)


_DIST = f"{POST}, {_DOTS}, e AS (SELECT p.subj_id, p.vox_id, p.p, 2 * n.n2 - 2 * sqrt(n.n2) * d.dot AS dist FROM post p JOIN yd d ON p.subj_id = d.subj_id AND p.vox_id = d.vox_id AND p.k = d.k JOIN yn n ON n.subj_id = p.subj_id AND n.vox_id = p.vox_id)"


@query("rmse_prediction", f"WITH {_DIST} SELECT round(sqrt(sum(p * dist) / (SELECT count(*) FROM vox)), 6) AS rmse FROM e")
def rmse_prediction(spark, sf):
    return prediction.rmse(rows_with_posterior(spark, sf), raw_directions(spark, sf)).select(r6(F.col("rmse")).alias("rmse"))


@query("adjusted_sse", f"""
WITH {POST}, {_DOTS}
SELECT round(sum(p.p * sqrt(n.n2) * (2 - 2 * d.dot / sqrt(n.n2))) / (SELECT count(*) FROM vox), 6) AS sse
FROM post p JOIN yd d ON p.subj_id = d.subj_id AND p.vox_id = d.vox_id AND p.k = d.k JOIN yn n ON n.subj_id = p.subj_id AND n.vox_id = p.vox_id""")
def adjusted_sse(spark, sf):
    return prediction.adjusted_sse(rows_with_posterior(spark, sf), raw_directions(spark, sf)).select(r6(F.col("sse")).alias("sse"))


def _scored(spark, sf):
    model = label_vmf(spark, sf)
    ll = mixture.loglik(views.vox_evidence(spark, sf), model.emissions[0])
    return ll.withColumn("uhat", A.softmax(F.col("ll")))


@query("logpy", f"""
WITH {POST},
m AS (SELECT subj_id, vox_id, max(ll) AS m FROM sc GROUP BY ALL),
t AS (SELECT s.subj_id, s.vox_id, max(m.m) + ln(sum(exp(s.ll - m.m) * p.p)) AS l FROM sc s JOIN post p ON s.subj_id = p.subj_id AND s.vox_id = p.vox_id AND s.k = p.k
      JOIN m ON s.subj_id = m.subj_id AND s.vox_id = m.vox_id GROUP BY ALL)
SELECT round(avg(l), 6) + 0.0 AS logpy FROM t""")
def logpy(spark, sf):
    return prediction.mean_log_evidence(_scored(spark, sf)).select(r6(F.col("logpy")).alias("logpy"))


# Posteriors with the label prior (q) against those without (p).
_PQ = f"""{POST}, {LABEL_PRIOR},
wx AS (SELECT s.subj_id, s.vox_id, s.k, s.ll + r.lp AS l FROM sc s JOIN pri r ON s.vox_id = r.vox_id AND s.k = r.k),
wm AS (SELECT subj_id, vox_id, max(l) AS m FROM wx GROUP BY ALL),
we AS (SELECT w.subj_id, w.vox_id, w.k, exp(w.l - m.m) AS e FROM wx w JOIN wm m ON w.subj_id = m.subj_id AND w.vox_id = m.vox_id),
pq AS (SELECT p.subj_id, p.vox_id, p.k, p.p, w.q FROM post p JOIN (
       SELECT subj_id, vox_id, k, e / sum(e) OVER (PARTITION BY subj_id, vox_id) AS q FROM we) w
       ON p.subj_id = w.subj_id AND p.vox_id = w.vox_id AND p.k = w.k)"""


def _two_posteriors(spark, sf):
    return _scored(spark, sf).join(label_prior(spark, sf).table.withColumnRenamed("node_id", "vox_id"), "vox_id").select(
        "subj_id", "vox_id", F.col("uhat").alias("p"), A.softmax(A.add(F.col("ll"), F.col("logpi"))).alias("q")
    )


@query("cross_entropy", f"WITH {_PQ} SELECT round(-sum(CASE WHEN q > 0 THEN p * ln(q) ELSE 0 END), 5) + 0.0 AS cross_entropy FROM pq")
def cross_entropy(spark, sf):
    return prediction.cross_entropy(_two_posteriors(spark, sf)).select(r6(F.col("cross_entropy"), 5).alias("cross_entropy"))


@query("kl_divergence", f"""
WITH {_PQ} SELECT round(sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) WHEN p > 0 THEN p * 3.4028234663852886e38 ELSE 0 END), 5) + 0.0 AS kl FROM pq""")
def kl_divergence(spark, sf):
    return prediction.kl_divergence(_two_posteriors(spark, sf)).select(r6(F.col("kl"), 5).alias("kl"))


@query("u_abserr", f"WITH {POST} SELECT round(avg(abs((x.label = p.k)::INT - p.p)), 6) + 0.0 AS u_abserr FROM post p JOIN vox x ON p.subj_id = x.subj_id AND p.vox_id = x.vox_id")
def u_abserr(spark, sf):
    rows = rows_with_posterior(spark, sf).withColumn("u", A.one_hot(F.col("label"), PARCELS))
    return prediction.mean_abs_error(rows).select(r6(F.col("u_abserr")).alias("u_abserr"))


@query("u_prederr_soft", f"WITH {POST} SELECT round(avg(abs((x.label = p.k)::INT - p.p)), 6) + 0.0 AS u_prederr FROM post p JOIN vox x ON p.subj_id = x.subj_id AND p.vox_id = x.vox_id")
def u_prederr_soft(spark, sf):
    return prediction.label_error(rows_with_posterior(spark, sf), PARCELS).select(r6(F.col("u_prederr")).alias("u_prederr"))


@query("u_prederr_hard", f"WITH {HARD} SELECT round(avg((a <> b)::INT), 6) + 0.0 AS u_prederr FROM lb")
def u_prederr_hard(spark, sf):
    out = prediction.label_error(rows_with_posterior(spark, sf), PARCELS, expectation=False)
    return out.select(r6(F.col("u_prederr")).alias("u_prederr"))


@query("bic", f"""
WITH {POST}, t AS (SELECT s.subj_id, sum(p.p * s.ll) AS ll, count(DISTINCT s.vox_id)::DOUBLE AS n FROM sc s JOIN post p
  ON s.subj_id = p.subj_id AND s.vox_id = p.vox_id AND s.k = p.k GROUP BY ALL)
SELECT subj_id, round(-2 * ll + ln(n) * {WIDTH * PARCELS + 1}, 4) + 0.0 AS bic FROM t""")
def bic(spark, sf):
    sums = _scored(spark, sf).groupBy("subj_id").agg(
        F.sum(A.dot(F.col("ll"), F.col("uhat"))).alias("ll"), F.count("*").cast("double").alias("n")
    )
    return sums.select("subj_id", r6(prediction.bic(F.col("ll"), F.col("n"), F.lit(WIDTH * PARCELS + 1)), 4).alias("bic"))


@query("elbo", f"""
WITH {POST}
SELECT p.subj_id, round(sum(p.p * s.ll), 4) + 0.0 AS ll_e, round(sum(p.p * -ln({PARCELS})), 4) + 0.0 AS ll_a,
       round(sum(CASE WHEN p.p > 0 THEN p.p * ln(p.p) ELSE 0 END), 4) + 0.0 AS lq,
       round(sum(p.p * s.ll) + sum(p.p * -ln({PARCELS})) - sum(CASE WHEN p.p > 0 THEN p.p * ln(p.p) ELSE 0 END), 4) + 0.0 AS elbo
FROM post p JOIN sc s ON p.subj_id = s.subj_id AND p.vox_id = s.vox_id AND p.k = s.k GROUP BY ALL""")
def elbo(spark, sf):
    """Evidence lower bound: expected likelihoods minus the entropy term."""
    h = A.total(F.transform("uhat", lambda u: F.when(u > 0, u * F.log(u)).otherwise(0.0)))
    sums = _scored(spark, sf).groupBy("subj_id").agg(
        F.sum(A.dot(F.col("ll"), F.col("uhat"))).alias("e"),
        F.sum(A.total(F.transform("uhat", lambda u: u * F.lit(-float(np.log(PARCELS)))))).alias("a"), F.sum(h).alias("q"),
    )
    return sums.select(
        "subj_id", r6(F.col("e"), 4).alias("ll_e"), r6(F.col("a"), 4).alias("ll_a"), r6(F.col("q"), 4).alias("lq"),
        r6(F.col("e") + F.col("a") - F.col("q"), 4).alias("elbo"),
    )


# ---------------------------------------------------------------- homogeneity

_Z = """
mean AS (SELECT subj_id, vox_id, label, avg(v) AS mu FROM voxl GROUP BY ALL),
cz AS (SELECT x.subj_id, x.vox_id, x.label, x.m, x.v - m.mu AS c FROM voxl x JOIN mean m ON x.subj_id = m.subj_id AND x.vox_id = m.vox_id),
cn AS (SELECT subj_id, vox_id, sqrt(sum(c * c)) AS n FROM cz GROUP BY ALL),
zz AS MATERIALIZED (SELECT c.subj_id, c.vox_id, c.label, list(c.c / n.n ORDER BY c.m) AS z FROM cz c JOIN cn n ON c.subj_id = n.subj_id AND c.vox_id = n.vox_id GROUP BY ALL),
size AS (SELECT subj_id, label, count(*)::DOUBLE AS n FROM vox GROUP BY ALL),
rr AS (SELECT a.subj_id, a.label, list_dot_product(a.z, b.z) AS r FROM zz a JOIN zz b ON a.subj_id = b.subj_id AND a.label = b.label AND a.vox_id <> b.vox_id)"""


def _homogeneity_sql(f):
    return f"""
WITH {VOX}, {_Z}, rs AS (SELECT subj_id, label, sum({f}) AS s FROM rr GROUP BY ALL)
SELECT s.subj_id, s.label, s.n, round(CASE WHEN s.n < 2 THEN 1.0 ELSE r.s / (s.n * (s.n - 1)) END, 6) + 0.0 AS homogeneity
FROM size s LEFT JOIN rs r ON s.subj_id = r.subj_id AND s.label = r.label"""


@query("homogeneity", _homogeneity_sql("r"))
def homogeneity_pearson(spark, sf):
    out = homogeneity.homogeneity(views.vox(spark, sf), WIDTH)
    return out.select("subj_id", "label", "n", r6(F.col("homogeneity")).alias("homogeneity"))


@query("homogeneity_fisher", _homogeneity_sql("0.5 * ln((1 + r) / (1 - r))"))
def homogeneity_fisher(spark, sf):
    """Small blocks here, so that the split into pairs of blocks is exercised."""
    out = homogeneity.homogeneity_fisher(views.vox(spark, sf), block=16)
    return out.select("subj_id", "label", "n", r6(F.col("homogeneity")).alias("homogeneity"))


@query("homogeneity_global", f"""
WITH h AS ({_homogeneity_sql('r').replace(', 6) + 0.0', ', 15)')})
SELECT subj_id, round(sum(homogeneity * n) / sum(n), 6) + 0.0 AS homogeneity FROM h GROUP BY ALL""")
def homogeneity_global(spark, sf):
    out = homogeneity.weighted_mean(homogeneity.homogeneity(views.vox(spark, sf), WIDTH))
    return out.select("subj_id", r6(F.col("homogeneity")).alias("homogeneity"))


_INHOM = f"""
WITH {VOX},
tot AS (SELECT subj_id, m, stddev_samp(v) AS t FROM voxl GROUP BY ALL),
par AS (SELECT subj_id, label, m, count(*) AS n, coalesce(stddev_samp(v), 0) AS d FROM voxl GROUP BY ALL),
con AS (SELECT p.subj_id, p.m, sum(p.n * p.d / t.t) / sum(p.n) AS v FROM par p JOIN tot t ON p.subj_id = t.subj_id AND p.m = t.m GROUP BY ALL)"""


@query("task_inhomogeneity", f"{_INHOM} SELECT subj_id, m::BIGINT AS k, round(v, 6) + 0.0 AS inhomogeneity FROM con")
def task_inhomogeneity(spark, sf):
    out = homogeneity.task_inhomogeneity(views.vox(spark, sf))
    return out.select("subj_id", F.col("m").cast("long").alias("k"), r6(F.col("inhomogeneity")).alias("inhomogeneity"))


@query("task_inhomogeneity_global", f"{_INHOM} SELECT subj_id, round(avg(v), 6) + 0.0 AS inhomogeneity FROM con GROUP BY ALL")
def task_inhomogeneity_global(spark, sf):
    out = homogeneity.task_inhomogeneity(views.vox(spark, sf))
    return out.groupBy("subj_id").agg(r6(F.avg("inhomogeneity")).alias("inhomogeneity"))


@query("nan_std", f"""
WITH {views.EVT}, c AS (SELECT subj_id, vox_id, part_id, cond, avg(value) AS y FROM evt GROUP BY ALL)
SELECT subj_id, cond, round(stddev_pop(y), 6) + 0.0 AS std FROM c GROUP BY ALL""")
def nan_std(spark, sf):
    cells = views.event_cells(spark, sf).groupBy("subj_id", "vox_id", "part_id", F.col("cond_id").alias("cond")).agg(F.avg("value").alias("y"))
    return homogeneity.nan_std(cells, "y", ["subj_id", "cond"]).select("subj_id", "cond", r6(F.col("std")).alias("std"))


# ---------------------------------------------------------------- solutions

# Two solutions per embedding: its posterior and its label prior with shifted parcels.
@query("match_greedy_corr", f"""
WITH {POST}, {LABEL_PRIOR},
tg AS (SELECT vox_id, k, avg(p) AS a FROM post GROUP BY ALL),
so AS (SELECT vox_id, (k + 3) % {PARCELS} AS k, lp AS b FROM pri),
co AS MATERIALIZED (SELECT 0 AS pair, t.k AS a, s.k AS b, corr(t.a, s.b) AS dice FROM tg t JOIN so s ON t.vox_id = s.vox_id GROUP BY t.k, s.k),
left0 AS (SELECT * FROM co)
{"".join(f''',
pick{i} AS MATERIALIZED (SELECT pair, {i} AS rank, a, b, dice FROM (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY dice DESC, a, b) AS rn FROM left{i}) WHERE rn = 1),
left{i + 1} AS MATERIALIZED (SELECT l.* FROM left{i} l JOIN pick{i} p ON l.pair = p.pair AND l.a <> p.a AND l.b <> p.b)''' for i in range(PARCELS))}
SELECT a::BIGINT AS target, b::BIGINT AS source FROM ({" UNION ALL ".join(f"SELECT * FROM pick{i}" for i in range(PARCELS))})""")
def match_greedy_corr(spark, sf):
    from tessera.operators.priors import prior_from_posterior

    post = mixture.posterior(vox_aligned(spark, sf), label_vmf(spark, sf))
    target = prior_from_posterior(post, PARCELS).select("vox_id", F.transform("logpi", F.exp).alias("a"))
    shifted = F.array(*[F.col("logpi")[(k - 3) % PARCELS] for k in range(PARCELS)])
    source = label_prior(spark, sf).table.select(F.col("node_id").alias("vox_id"), shifted.alias("b"))
    order = matching.match_greedy(target.join(source, "vox_id"), "a", "b", PARCELS)
    return spark.createDataFrame([(i, int(j)) for i, j in enumerate(order)], "target long, source long")


_CONS = f"""
WITH {POST}, {LABEL_PRIOR},
ps AS (SELECT vox_id, k, avg(p) AS a FROM post GROUP BY ALL),
ce AS (SELECT s.vox_id, s.k, s.a, exp(r.lp) AS b, r.lp AS c FROM ps s JOIN pri r ON s.vox_id = r.vox_id AND s.k = r.k)"""


def _solution_cells(spark, sf):
    from tessera.operators.priors import prior_from_posterior

    post = mixture.posterior(vox_aligned(spark, sf), label_vmf(spark, sf))
    a = prior_from_posterior(post, PARCELS).select("vox_id", F.transform("logpi", F.exp).alias("a"))
    c = label_prior(spark, sf).table.select(F.col("node_id").alias("vox_id"), F.col("logpi").alias("c"))
    zipped = F.arrays_zip("a", F.transform("c", F.exp).alias("b"), "c")
    return a.join(c, "vox_id").select("vox_id", F.posexplode(zipped).alias("k", "z")).select(
        "vox_id", "k", F.array("z.a", "z.b", "z.c").alias("values")
    )


def _consistency_rows(spark, r):
    rows = [(i, j, float(round(r[i, j], 6))) for i in range(3) for j in range(i + 1, 3)]
    return spark.createDataFrame(rows, "i long, j long, r double")


def _cons_sql(centre):
    # centre: grouping columns whose mean is removed, or None
    base = _CONS
    src = "ce"
    if centre is not None:
        over = f"PARTITION BY {centre}" if centre else ""
        base += f", cc AS (SELECT vox_id, k, a - avg(a) OVER ({over}) AS a, b - avg(b) OVER ({over}) AS b, c - avg(c) OVER ({over}) AS c FROM ce)"
        src = "cc"
    cos = lambda x, y: f"round(sum({x} * {y}) / sqrt(sum({x} * {x}) * sum({y} * {y})), 6) + 0.0"
    return base + f"""
SELECT 0::BIGINT AS i, 1::BIGINT AS j, {cos('a', 'b')} AS r FROM {src} UNION ALL
SELECT 0, 2, {cos('a', 'c')} FROM {src} UNION ALL SELECT 1, 2, {cos('b', 'c')} FROM {src}"""


@query("solution_consistency", _cons_sql(None))
def solution_consistency(spark, sf):
    return _consistency_rows(spark, matching.consistency(_solution_cells(spark, sf), "values", 3))


@query("solution_consistency_centred", _cons_sql(""))
def solution_consistency_centred(spark, sf):
    return _consistency_rows(spark, matching.consistency(_solution_cells(spark, sf), "values", 3, []))


@query("solution_consistency_rows", _cons_sql("vox_id"))
def solution_consistency_rows(spark, sf):
    """Mean over parcels removed within each location."""
    return _consistency_rows(spark, matching.consistency(_solution_cells(spark, sf), "values", 3, ["vox_id"]))


@query("solution_consistency_columns", _cons_sql("k"))
def solution_consistency_columns(spark, sf):
    """Mean over locations removed within each parcel."""
    return _consistency_rows(spark, matching.consistency(_solution_cells(spark, sf), "values", 3, ["k"]))


# ---------------------------------------------------------------- cross-validation

_LOSO = f"""
own AS (SELECT p.subj_id, p.k, x.m, sum(p.p * x.v) AS s FROM post p JOIN voxl x ON p.subj_id = x.subj_id AND p.vox_id = x.vox_id GROUP BY ALL),
al AS (SELECT k, m, sum(s) AS s FROM own GROUP BY ALL),
rest AS (SELECT o.subj_id, o.k, o.m, a.s - o.s AS s FROM own o JOIN al a ON o.k = a.k AND o.m = a.m),
rl AS (SELECT subj_id, k, sqrt(sum(s * s)) AS n FROM rest GROUP BY ALL),
lv AS MATERIALIZED (SELECT r.subj_id, r.k, r.m, r.s / l.n AS v FROM rest r JOIN rl l ON r.subj_id = l.subj_id AND r.k = l.k),
ld AS MATERIALIZED (SELECT x.subj_id, x.vox_id, v.k, sum(x.v * v.v) AS dot FROM voxl x JOIN lv v ON x.subj_id = v.subj_id AND x.m = v.m GROUP BY ALL),
yn AS MATERIALIZED (SELECT subj_id, vox_id, sum(v * v) AS n2 FROM voxl GROUP BY ALL),
gp AS (SELECT vox_id, k, exp(lp) / sum(exp(lp)) OVER (PARTITION BY vox_id) AS p FROM pri)"""


def _loso_inputs(spark, sf):
    rows = rows_with_posterior(spark, sf)
    pi = label_prior(spark, sf).marginal_full().withColumnRenamed("pi", "uhat")
    group = views.vox(spark, sf).join(pi, "vox_id")
    return rows, {"individual": rows, "group": group}


@query("loso_error", f"""
WITH {POST}, {LABEL_PRIOR}, {_LOSO},
fi AS (SELECT d.subj_id, d.vox_id, sum(p.p * d.dot) AS f FROM ld d JOIN post p ON p.subj_id = d.subj_id AND p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL),
fg AS (SELECT d.subj_id, d.vox_id, sum(p.p * d.dot) AS f FROM ld d JOIN gp p ON p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL)
SELECT 'individual' AS parcellation, f.subj_id, round(sum(n.n2 - f.f * sqrt(n.n2)) / sum(n.n2), 6) + 0.0 AS error FROM fi f JOIN yn n ON f.subj_id = n.subj_id AND f.vox_id = n.vox_id GROUP BY ALL
UNION ALL SELECT 'group', f.subj_id, round(sum(n.n2 - f.f * sqrt(n.n2)) / sum(n.n2), 6) + 0.0 FROM fg f JOIN yn n ON f.subj_id = n.subj_id AND f.vox_id = n.vox_id GROUP BY ALL""")
def loso_error(spark, sf):
    rows, evals = _loso_inputs(spark, sf)
    out = crossval.leave_one_subject_out(rows, evals, WIDTH, PARCELS)
    return out.select("parcellation", "subj_id", r6(F.col("error")).alias("error"))


@query("loso_error_average", f"""
WITH {POST}, {LABEL_PRIOR}, {_LOSO},
vg AS MATERIALIZED (SELECT a.subj_id, a.k AS k, b.k AS l, sum(a.v * b.v) AS g FROM lv a JOIN lv b ON a.subj_id = b.subj_id AND a.m = b.m GROUP BY a.subj_id, a.k, b.k),
f AS (SELECT d.subj_id, d.vox_id, sum(p.p * d.dot) AS f FROM ld d JOIN gp p ON p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL),
g AS (SELECT v.subj_id, p.vox_id, sqrt(sum(p.p * q.p * v.g)) AS n FROM gp p JOIN gp q ON p.vox_id = q.vox_id JOIN vg v ON v.k = p.k AND v.l = q.k GROUP BY ALL)
SELECT 'group' AS parcellation, f.subj_id, round(avg(1 - f.f / g.n / sqrt(n.n2)), 6) + 0.0 AS error
FROM f JOIN g ON f.subj_id = g.subj_id AND f.vox_id = g.vox_id JOIN yn n ON f.subj_id = n.subj_id AND f.vox_id = n.vox_id GROUP BY ALL""")
def loso_error_average(spark, sf):
    rows, evals = _loso_inputs(spark, sf)
    out = crossval.leave_one_subject_out(rows, {"group": evals["group"]}, WIDTH, PARCELS, "average", adjusted=False)
    return out.select("parcellation", "subj_id", r6(F.col("error")).alias("error"))


def _sql_refit(fold: int) -> str:
    """Three passes without one subject, then its errors with the resulting directions."""
    t = f"f{fold}_"
    error = "round(sum(n.n2 - f.f * sqrt(n.n2)) / sum(n.n2), 6) + 0.0"
    return sql_em(3, fit_prior=False, gated=True, given_prior=True, tag=t, without=fold) + f""",
{t}d AS MATERIALIZED (SELECT x.subj_id, x.vox_id, v.k, sum(x.v * v.v) AS dot FROM voxl x JOIN v{t}2 v ON x.m = v.m WHERE x.subj_id = {fold} GROUP BY ALL),
{t}m AS (SELECT d.vox_id, max(q.kappa * d.dot) AS m FROM {t}d d CROSS JOIN q{t}2 q GROUP BY ALL),
{t}o AS (SELECT d.vox_id, d.k, exp(q.kappa * d.dot - m.m) / sum(exp(q.kappa * d.dot - m.m)) OVER (PARTITION BY d.vox_id) AS p FROM {t}d d CROSS JOIN q{t}2 q JOIN {t}m m ON d.vox_id = m.vox_id),
{t}e AS (
  SELECT 'individual' AS parcellation, f.subj_id, {error} AS error FROM (SELECT d.subj_id, d.vox_id, sum(p.p * d.dot) AS f FROM {t}d d JOIN post p ON p.subj_id = d.subj_id AND p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL) f JOIN yn n ON f.subj_id = n.subj_id AND f.vox_id = n.vox_id GROUP BY ALL
  UNION ALL SELECT 'group', f.subj_id, {error} FROM (SELECT d.subj_id, d.vox_id, sum(p.p * d.dot) AS f FROM {t}d d JOIN gp p ON p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL) f JOIN yn n ON f.subj_id = n.subj_id AND f.vox_id = n.vox_id GROUP BY ALL
  UNION ALL SELECT 'floor', f.subj_id, {error} FROM (SELECT d.subj_id, d.vox_id, sum(p.p * d.dot) AS f FROM {t}d d JOIN {t}o p ON p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL) f JOIN yn n ON f.subj_id = n.subj_id AND f.vox_id = n.vox_id GROUP BY ALL)"""


_REFIT = ",".join(_sql_refit(f) for f in range(SUBJECTS))


@query("loso_refit_error", f"""
WITH {POST}, {LABEL_PRIOR}, {_LOSO}, {_REFIT}
{" UNION ALL ".join(f"SELECT * FROM f{f}_e" for f in range(SUBJECTS))}""")
def loso_refit_error(spark, sf):
    """Emission model refitted without each of the five subjects, three parcellations."""
    _, evals = _loso_inputs(spark, sf)
    model = mixture.Model(label_prior(spark, sf), softened(spark, sf, 0.5).emissions)
    out = crossval.leave_one_subject_out_refit(
        model, views.vox_evidence(spark, sf), evals, list(range(SUBJECTS)), max_iter=3, tol=0.1, with_floor=True
    )
    return out.select("parcellation", "subj_id", r6(F.col("error")).alias("error"))


@query("completion_error", f"""
WITH {VOX}, {LABEL_SUMS}, {LABEL_PRIOR}, {_DOTS},
gp AS (SELECT vox_id, k, exp(lp) / sum(exp(lp)) OVER (PARTITION BY vox_id) AS p FROM pri),
f AS (SELECT d.subj_id, d.vox_id, sum(p.p * d.dot) AS f FROM yd d JOIN gp p ON p.vox_id = d.vox_id AND p.k = d.k GROUP BY ALL)
SELECT f.subj_id, round(avg(1 - f.f / sqrt(n.n2)), 6) + 0.0 AS cosine_error FROM f JOIN yn n ON f.subj_id = n.subj_id AND f.vox_id = n.vox_id GROUP BY ALL""")
def completion_error(spark, sf):
    rows = views.vox(spark, sf)
    guess = crossval.completion_independent(rows, label_prior(spark, sf))
    joined = rows.select("subj_id", "vox_id", "y").join(guess, ["subj_id", "vox_id"])
    out = prediction.cosine_error(joined, raw_directions(spark, sf))
    return out.select("subj_id", r6(F.col("cosine_error")).alias("cosine_error"))



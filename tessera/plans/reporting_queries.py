"""Model choice, result tables, full-covariance mixtures and streaming."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays as A
from tessera.operators import gaussian_mixture as gm
from tessera.operators import labels, matching, mixture
from tessera.plans import views
from tessera.plans.emission_queries import (
    GME_BETA, GME_BINS, GME_SIGMA2, LABEL_SUMS, SHARED_KAPPA, VMF_ESTEP_SQL, label_gme, label_vmf, sql_log_constant, vox_aligned,
)
from tessera.plans.label_queries import HARD, guesses
from tessera.plans.learning_queries import NEVER, T_NODE, _flat_uniform, softened, sql_em, sql_trace
from tessera.plans.prior_queries import LABEL_PRIOR, label_prior
from tessera.plans.registry import query
from tessera.plans.views import PARCELS, SUBJECTS, VOX, WIDTH, r6, table
from tessera.session import ensure_checkpoint_dir
from tessera.sources import tables
from tessera.streaming import scoring

# ---------------------------------------------------------------- model choice

SCALES = (0.5, 1.0, 2.0)


@query("model_select", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA.replace("kap AS", "shared AS")},
kap AS (SELECT s.i AS model_id, s.f * q.kappa AS kappa FROM (VALUES {", ".join(f"({i}, {f}::DOUBLE)" for i, f in enumerate(SCALES))}) s(i, f)
        CROSS JOIN shared q),
dt AS (SELECT x.subj_id, x.vox_id, d.k, sum(x.v * d.v) AS dot FROM voxl x JOIN dir d ON x.m = d.m GROUP BY ALL),
sc AS (SELECT q.model_id, t.subj_id, t.vox_id, t.k, {sql_log_constant(WIDTH, 'q.kappa')} + q.kappa * t.dot AS ll FROM dt t CROSS JOIN kap q),
mx AS (SELECT model_id, subj_id, vox_id, max(ll) AS m FROM sc GROUP BY ALL),
ev AS (SELECT s.model_id, s.subj_id, s.vox_id, max(m.m) + ln(sum(exp(s.ll - m.m)) / {PARCELS}) AS l FROM sc s JOIN mx m ON s.model_id = m.model_id AND s.subj_id = m.subj_id AND s.vox_id = m.vox_id GROUP BY ALL),
tl AS (SELECT model_id, sum(l) AS loglik FROM ev GROUP BY ALL)
SELECT model_id::BIGINT AS model_id, round(loglik, 4) + 0.0 AS loglik FROM tl ORDER BY loglik DESC, model_id LIMIT 1""")
def model_select(spark, sf):
    """Best of three concentrations by the evidence of all data."""
    base = label_vmf(spark, sf).emissions[0]
    info = None
    for i, f in enumerate(SCALES):
        ll = mixture.loglik(views.vox_evidence(spark, sf), replace(base, kappa=f * base.kappa))
        flat = ll.withColumn("uhat", F.array_repeat(F.lit(1.0 / PARCELS), PARCELS))
        value = A.let(F.array_max("ll"), lambda m: m + F.log(A.total(F.zip_with("ll", "uhat", lambda a, u: F.exp(a - m) * u))))
        part = flat.agg(F.sum(value).alias("loglik")).select(F.lit(i).cast("long").alias("model_id"), "loglik")
        info = part if info is None else info.unionByName(part)
    return tables.select_model(info).select("model_id", r6(F.col("loglik"), 4).alias("loglik"))


@query("ll_delta", f"""
WITH {VOX}, {sql_em(T_NODE)}, t AS ({sql_trace(T_NODE)})
SELECT iter, round(ll_a + ll_e, 4) + 0.0 AS ll, round(ll_a + ll_e - lag(ll_a + ll_e) OVER (ORDER BY iter), 4) + 0.0 AS gain FROM t""")
def ll_delta(spark, sf):
    fit = mixture.fit_em(_flat_uniform(softened(spark, sf, 0.5)), vox_aligned(spark, sf), T_NODE, NEVER, first_evidence=True)
    trace = fit.trace_table(spark).select(F.col("iter").cast("long").alias("iter"), (F.col("ll_a") + F.col("ll_e")).alias("ll"))
    return tables.loglik_gain(trace).select("iter", r6(F.col("ll"), 4).alias("ll"), r6(F.col("gain"), 4).alias("gain"))


# ---------------------------------------------------------------- result tables


@query("metric_pivot", f"""
WITH {HARD}
SELECT a AS label, {", ".join(f"sum((b = {k})::INT)::BIGINT AS guess{k}" for k in range(PARCELS))} FROM lb GROUP BY ALL""")
def metric_pivot(spark, sf):
    """True against guessed parcels as a table."""
    wide = guesses(spark, sf).groupBy("label").pivot("guess", list(range(PARCELS))).count().na.fill(0)
    return wide.select("label", *[F.col(str(k)).alias(f"guess{k}") for k in range(PARCELS)])


@query("metric_rollup", f"""
WITH {VOX}, {LABEL_SUMS}, d AS (SELECT x.subj_id, x.vox_id, x.label, 1 - sum(x.v * d.v) AS e FROM voxl x JOIN dir d ON x.m = d.m AND x.label = d.k GROUP BY ALL)
SELECT subj_id, label, count(*)::BIGINT AS n, round(avg(e), 6) + 0.0 AS mean, round(stddev_samp(e) / sqrt(count(*)), 6) + 0.0 AS sem
FROM d GROUP BY ROLLUP (subj_id, label)""")
def metric_rollup(spark, sf):
    """Distance to the own direction by subject and label, with subtotals and standard errors."""
    v = A.literal_rows(label_vmf(spark, sf).emissions[0].v.T)
    e = 1 - A.dot(F.col("y"), F.element_at(v, F.col("label").cast("int") + 1))
    rows = views.vox(spark, sf).select("subj_id", "label", e.alias("e"))
    return rows.rollup("subj_id", "label").agg(
        F.count("*").alias("n"), r6(F.avg("e")).alias("mean"), r6(F.stddev_samp("e") / F.sqrt(F.count("*"))).alias("sem")
    )


@query("u_err_by_subject", f"WITH {HARD} SELECT pair AS subj_id, round(avg((a <> b)::INT), 6) + 0.0 AS u_err FROM lb GROUP BY ALL")
def u_err_by_subject(spark, sf):
    wrong = F.when(F.col("label") != F.col("guess"), 1.0).otherwise(0.0)
    return guesses(spark, sf).groupBy("subj_id").agg(r6(F.avg(wrong)).alias("u_err"))


@query("nmi_by_subject", f"""
WITH {HARD},
mi AS (SELECT c.pair, sum(c.n / t.t * ln(c.n * t.t / (r.na * b.nb))) AS mi FROM ct c JOIN ra r ON c.pair = r.pair AND c.a = r.a
       JOIN cb b ON c.pair = b.pair AND c.b = b.b JOIN tt t ON c.pair = t.pair GROUP BY ALL),
ha AS (SELECT r.pair, -sum(na / t * ln(na / t)) AS h FROM ra r JOIN tt t ON r.pair = t.pair GROUP BY ALL),
hb AS (SELECT r.pair, -sum(nb / t * ln(nb / t)) AS h FROM cb r JOIN tt t ON r.pair = t.pair GROUP BY ALL)
SELECT m.pair AS subj_id, round(1 - 2 * m.mi / (a.h + b.h), 6) + 0.0 AS nmi FROM mi m JOIN ha a ON m.pair = a.pair JOIN hb b ON m.pair = b.pair""")
def nmi_by_subject(spark, sf):
    ct = labels.contingency(guesses(spark, sf), "label", "guess", ["subj_id"])
    return labels.nmi_distance(ct, ["subj_id"]).select("subj_id", r6(F.col("nmi")).alias("nmi"))


@query("run_average", """
SELECT l_suppkey AS vox_id, l_returnflag AS cond, round(avg(nullif(l_discount, 0)), 6) + 0.0 AS value FROM lineitem GROUP BY ALL""")
def run_average(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("vox_id"), F.col("l_returnflag").alias("cond"), F.col("l_discount").alias("value"))
    return tables.average_runs(rows, "value", ["vox_id", "cond"]).select("vox_id", "cond", r6(F.col("value")).alias("value"))


@query("match_to_group", f"""
WITH {VOX}, {LABEL_SUMS},
ys AS (SELECT subj_id, label AS k, m, sum(v) AS s FROM voxl GROUP BY ALL),
yl AS (SELECT subj_id, k, sqrt(sum(s * s)) AS n FROM ys GROUP BY ALL),
pr AS (SELECT y.subj_id, y.k, d.k AS g, sum(y.s / l.n * d.v) AS c FROM ys y JOIN yl l ON y.subj_id = l.subj_id AND y.k = l.k JOIN dir d ON d.m = y.m GROUP BY ALL),
be AS (SELECT subj_id, k, max(c) AS c FROM pr GROUP BY ALL)
SELECT subj_id, round(avg(c), 6) + 0.0 AS match FROM be GROUP BY ALL""")
def match_to_group(spark, sf):
    """Each subject's own parcel directions against those of the group."""
    sums = views.vox(spark, sf).groupBy("subj_id", "label").agg(F.array(*A.sum_elements(F.col("y"), WIDTH)).alias("s"))
    own = sums.select("subj_id", A.unit(F.col("s")).alias("v"))
    out = matching.match_to_group(own, label_vmf(spark, sf).emissions[0].v)
    return out.select("subj_id", r6(F.col("match")).alias("match"))


# ---------------------------------------------------------------- full covariances

FLAGS = ("A", "N", "R")


def _shipments(spark, sf):
    """Quantity and discount of every line item, scaled, with the return flag as parcel."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    flag = F.array_position(F.array(*[F.lit(f) for f in FLAGS]), F.col("l_returnflag")).cast("int") - 1
    scaled = gm.scale_columns(rows, ["l_quantity", "l_discount"])
    return scaled.select(
        flag.alias("flag"), "l_linestatus", F.array("l_quantity", "l_discount").alias("y"),
        F.transform(A.one_hot(flag, 3), lambda x: 0.1 + 0.7 * x).alias("uhat"),
    )


_SHIP = """
lm AS (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1 FROM lineitem),
li AS (SELECT row_number() OVER () AS id, l_linestatus, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
              (l_quantity - q0) / (q1 - q0) AS q, (l_discount - d0) / (d1 - d0) AS d FROM lineitem CROSS JOIN lm),
w AS (SELECT l.*, t.k, CASE WHEN l.flag = t.k THEN 0.8 ELSE 0.1 END::DOUBLE AS u FROM li l CROSS JOIN range(3) t(k)),
mo AS (SELECT k, sum(u) AS n, sum(u * q) / sum(u) AS mq, sum(u * d) / sum(u) AS md,
              sum(u * q * q) / sum(u) - (sum(u * q) / sum(u)) ** 2 AS cqq, sum(u * d * d) / sum(u) - (sum(u * d) / sum(u)) ** 2 AS cdd,
              sum(u * q * d) / sum(u) - sum(u * q) / sum(u) * (sum(u * d) / sum(u)) AS cqd FROM w GROUP BY k),
pr AS (SELECT *, n / sum(n) OVER () AS pi, cqq * cdd - cqd * cqd AS det FROM mo)"""


@query("minmax_scale", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - a.q0) / (a.q1 - a.q0), 6) + 0.0 AS l_quantity, round((l_extendedprice - a.p0) / (a.p1 - a.p0), 6) + 0.0 AS l_extendedprice
FROM lineitem CROSS JOIN (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_extendedprice) AS p0, max(l_extendedprice) AS p1 FROM lineitem) a""")
def minmax_scale(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = gm.scale_columns(rows, ["l_quantity", "l_extendedprice"])
    return out.withColumns({c: r6(F.col(c)) for c in ("l_quantity", "l_extendedprice")})


@query("full_gmm_mstep", f"""
WITH {_SHIP}
SELECT k::BIGINT AS k, round(pi, 9) AS pi, round(mq, 6) AS mu0, round(md, 6) AS mu1, round(cqq, 6) + 0.0 AS c00, round(cqd, 6) + 0.0 AS c01, round(cdd, 6) + 0.0 AS c11 FROM pr""")
def full_gmm_mstep(spark, sf):
    m = gm.maximise(_shipments(spark, sf), 3, 2)
    r = lambda v: float(round(v, 6)) + 0.0
    rows = [(k, float(round(m.pi[k], 9)), r(m.mu[k, 0]), r(m.mu[k, 1]), r(m.cov[k, 0, 0]), r(m.cov[k, 0, 1]), r(m.cov[k, 1, 1])) for k in range(3)]
    return spark.createDataFrame(rows, "k long, pi double, mu0 double, mu1 double, c00 double, c01 double, c11 double")


@query("full_gmm_estep", f"""
WITH {_SHIP},
jo AS (SELECT l.id, l.flag, l.l_linestatus, p.k, ln(p.pi) - ln(2 * pi()) - 0.5 * ln(p.det)
         - 0.5 * (p.cdd * (l.q - p.mq) ** 2 - 2 * p.cqd * (l.q - p.mq) * (l.d - p.md) + p.cqq * (l.d - p.md) ** 2) / p.det AS j FROM li l CROSS JOIN pr p),
jm AS (SELECT id, max(j) AS m FROM jo GROUP BY id),
lr AS (SELECT o.id, max(m.m) + ln(sum(exp(o.j - m.m))) AS ll FROM jo o JOIN jm m ON o.id = m.id GROUP BY o.id)
SELECT o.flag::BIGINT AS flag, o.l_linestatus AS status, o.k::BIGINT AS k, round(avg(exp(o.j - r.ll)), 6) + 0.0 AS p, round(avg(r.ll), 6) + 0.0 AS ll
FROM jo o JOIN lr r ON o.id = r.id GROUP BY ALL""")
def full_gmm_estep(spark, sf):
    rows = _shipments(spark, sf)
    model = gm.maximise(rows, 3, 2)
    post = gm.responsibilities(rows, model, ["flag", "l_linestatus"])
    means = post.groupBy("flag", "l_linestatus").agg(F.array(*[F.avg(F.col("uhat")[k]) for k in range(3)]).alias("p"), F.avg("ll").alias("ll"))
    return means.select(F.col("flag").cast("long").alias("flag"), F.col("l_linestatus").alias("status"), F.posexplode("p").alias("k", "p"), "ll").select(
        "flag", "status", F.col("k").cast("long").alias("k"), r6(F.col("p")).alias("p"), r6(F.col("ll")).alias("ll")
    )


# ---------------------------------------------------------------- signal strength, other estimates

_GME_HEAD = f"""
yv AS MATERIALIZED (SELECT x.subj_id, x.vox_id, d.k, sum(x.v * d.v) AS a FROM voxl x JOIN dir d ON x.m = d.m GROUP BY x.subj_id, x.vox_id, d.k),
yy AS MATERIALIZED (SELECT subj_id, vox_id, sum(v * v) AS yy FROM voxl GROUP BY ALL)"""
_GME_TAIL = f"""
SELECT s.subj_id, s.vox_id, s.k::BIGINT AS k, round(-0.5 * {WIDTH} * (ln(2 * pi()) + ln({GME_SIGMA2}))
  - 0.5 / {GME_SIGMA2} * (y.yy - 2 * s.a * s.s + s.s2) + ln({GME_BETA}) - {GME_BETA} * s.s, 5) + 0.0 AS ll
FROM sg s JOIN yy y ON s.subj_id = y.subj_id AND s.vox_id = y.vox_id"""


@query("gauss_exp_max", f"""
WITH {VOX}, {LABEL_SUMS}, {_GME_HEAD},
sg AS (SELECT subj_id, vox_id, k, a, greatest(a - {GME_BETA} * {GME_SIGMA2}, 0) AS s, greatest(a - {GME_BETA} * {GME_SIGMA2}, 0) ** 2 AS s2 FROM yv)
{_GME_TAIL}""")
def gauss_exp_max(spark, sf):
    out = mixture.loglik(views.vox_evidence(spark, sf), replace(label_gme(spark, sf), estep="max"))
    return views.explode_parcels(out, "ll", "subj_id", "vox_id", alias="ll", digits=5)


@query("gauss_exp_import", f"""
WITH {VOX}, {LABEL_SUMS}, {_GME_HEAD},
bi AS MATERIALIZED (SELECT -ln(1 - ('0x' || substr(md5('0|signal|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / {GME_BETA} AS x FROM range({GME_BINS}) t(i)),
lg AS (SELECT y.*, b.x, (2 * y.a * b.x - b.x * b.x) / (2 * {GME_SIGMA2}) AS l FROM yv y CROSS JOIN bi b),
lm AS (SELECT subj_id, vox_id, k, max(l) AS m FROM lg GROUP BY ALL),
sg AS (SELECT g.subj_id, g.vox_id, g.k, max(g.a) AS a, sum(exp(g.l - m.m) * g.x) / sum(exp(g.l - m.m)) AS s,
              sum(exp(g.l - m.m) * g.x * g.x) / sum(exp(g.l - m.m)) AS s2
       FROM lg g JOIN lm m ON g.subj_id = m.subj_id AND g.vox_id = m.vox_id AND g.k = m.k GROUP BY ALL)
{_GME_TAIL}""")
def gauss_exp_import(spark, sf):
    """Signal strength from exponential draws, weighted by the likelihood."""
    out = mixture.loglik(views.vox_evidence(spark, sf), replace(label_gme(spark, sf), estep="import"))
    return views.explode_parcels(out, "ll", "subj_id", "vox_id", alias="ll", digits=5)


@query("gauss_exp_reject", f"""
WITH {VOX}, {LABEL_SUMS}, {_GME_HEAD},
bi AS MATERIALIZED (SELECT i, -ln(1 - ('0x' || substr(md5('0|signal|' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE) / {GME_BETA} AS x FROM range({GME_BINS}) t(i)),
th AS MATERIALIZED (SELECT k.k, t.i, ('0x' || substr(md5('0|accept' || k.k || '|' || t.i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range({PARCELS}) k(k) CROSS JOIN range({GME_BINS}) t(i)),
lg AS (SELECT y.*, b.i, b.x, (2 * y.a * b.x - b.x * b.x) / (2 * {GME_SIGMA2}) AS l FROM yv y CROSS JOIN bi b),
ra AS (SELECT *, exp(l - max(l) OVER (PARTITION BY subj_id, vox_id, k)) AS ratio FROM lg),
sg AS (SELECT r.subj_id, r.vox_id, r.k, max(r.a) AS a, avg(r.x) AS s, avg(r.x * r.x) AS s2 FROM ra r JOIN th t ON t.k = r.k AND t.i = r.i WHERE t.u <= r.ratio GROUP BY ALL)
{_GME_TAIL}""")
def gauss_exp_reject(spark, sf):
    out = mixture.loglik(views.vox_evidence(spark, sf), replace(label_gme(spark, sf), estep="reject"))
    return views.explode_parcels(out, "ll", "subj_id", "vox_id", alias="ll", digits=5)


# ---------------------------------------------------------------- model store


def _stored(spark, sf) -> str:
    """Two models in a store: the second, which is the better one, has the label prior and the label directions."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    best = replace(label_vmf(spark, sf), prior=label_prior(spark, sf))
    halved = best.prior.table.select("node_id", F.transform("logpi", lambda x: x / 2).alias("logpi"))
    models = [replace(best, prior=best.prior.with_table(halved)), best]
    info = spark.createDataFrame([(0, 1.0), (1, 2.0)], "model_id long, loglik double")
    tables.save_models(info, mixture.parameter_table(spark, models), path)
    return path


@query("store_group_prior", f"""
WITH {VOX}, {LABEL_PRIOR} SELECT vox_id AS node_id, k::BIGINT AS k, round(lp, 6) + 0.0 AS logpi FROM pri""")
def store_group_prior(spark, sf):
    """The prior of the best stored model, read back."""
    prior, _ = tables.load_group_prior(spark, _stored(spark, sf), PARCELS)
    return views.explode_parcels(prior, "logpi", "node_id", alias="logpi")


@query("store_directions", f"""
WITH {VOX}, {LABEL_SUMS} SELECT m::BIGINT AS m, k::BIGINT AS k, round(v, 6) + 0.0 AS value FROM dir""")
def store_directions(spark, sf):
    """The directions of the best stored model, read back."""
    v = tables.load_emission_params(spark, _stored(spark, sf), "V")[0].reshape(WIDTH, PARCELS)
    rows = [(m, k, round(float(v[m, k]), 6) + 0.0) for m in range(WIDTH) for k in range(PARCELS)]
    return spark.createDataFrame(rows, "m long, k long, value double")


@query("align_models", f"""
WITH {VOX}, {LABEL_PRIOR}
SELECT vox_id AS node_id, k::BIGINT AS k, round(exp(lp) / sum(exp(lp)) OVER (PARTITION BY vox_id), 6) + 0.0 AS p FROM pri""")
def align_models(spark, sf):
    """A model whose parcels are shifted by three comes back in the order of the first."""
    one = replace(label_vmf(spark, sf), prior=label_prior(spark, sf))
    order = [(k + 3) % PARCELS for k in range(PARCELS)]
    moved = one.prior.table.select("node_id", F.array(*[F.col("logpi")[k] for k in order]).alias("logpi"))
    two = replace(one, prior=one.prior.with_table(moved),
                  emissions=tuple(replace(e, v=e.v[:, order]) for e in one.emissions))
    back = matching.align_models([one, two])[1]
    return views.explode_parcels(back.prior.marginal(), "pi", "node_id")


# ---------------------------------------------------------------- streaming

_EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
])


@query("stream_posterior", VMF_ESTEP_SQL)
def stream_posterior(spark, sf):
    """The flagship posterior, computed on a stream of files with a frozen model."""
    ensure_checkpoint_dir(spark)
    model = label_vmf(spark, sf)
    # The braces make the path a pattern: a table may be one file, which no stream takes as its folder, or a folder of files.
    stream = scoring.read_stream(spark, f"{sf}/{{embeddings.parquet}}", _EMBEDDINGS).select(
        (F.col("vec_id") % SUBJECTS).alias("subj_id"), F.expr(f"vec_id div {SUBJECTS}").alias("vox_id"), F.col("embedding").alias("y")
    )
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    scoring.run_available(scoring.score_stream(stream, model, normalised=True), f"{base}/out", f"{base}/state")
    return views.explode_parcels(spark.read.parquet(f"{base}/out"), "uhat", "subj_id", "vox_id")


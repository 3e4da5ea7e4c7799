"""Learning: EM traces, stop rules, restarts, frozen priors, cross-validation."""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import emissions as em
from tessera.operators import mixture, priors
from tessera.operators.priors import IndependentPrior
from tessera.plans import views
from tessera.plans.emission_queries import (
    LABEL_SUMS, SHARED_KAPPA, label_vmf, labelled, sql_concentration, sql_log_constant, start_vmf, vox_aligned,
)
from tessera.plans.prior_queries import HALF, LABEL_PRIOR, PART, fused_model, label_prior, pair_layout
from tessera.plans.registry import query
from tessera.plans.views import PARCELS, SUBJECTS, VOX, WIDTH, r6
from tessera.session import ensure_checkpoint_dir
from tessera.streaming import learning, scoring

# ---------------------------------------------------------------- starting points


def softened(spark, sf, mix: float, flags=None, model=None) -> mixture.Model:
    """Start from label posteriors blurred towards uniform: mix * onehot + (1 - mix) / K."""
    rows = labelled(spark, sf)
    blur = F.transform("uhat", lambda x: x * mix + (1 - mix) / PARCELS)
    start = mixture.Aligned(rows.df.withColumn("uhat", blur), rows.slots)
    return mixture.m_step(start, start_vmf(**(flags or {})) if model is None else model)


# ---------------------------------------------------------------- unrolled SQL


def sql_em(
    iterations: int, mix: float = 0.5, kind: str = "vmf", spatial: bool = False, fit_prior: bool = True,
    gated: bool = False, tag: str = "", given_prior: bool = False, without: int | None = None,
) -> str:
    """EM written out as one block of tables per iteration.

    Iteration t leaves ``post{t}`` (posterior), ``tr{t}`` (ll_a, ll_e).
    """
    out = []
    by = "vox_id, " if spatial else ""
    where = "" if without is None else f"WHERE x.subj_id <> {without} "

    def params(t, u):
        """M-step from the posterior table ``u`` (subj_id, vox_id, k, p)."""
        out.append(f"""
yu{t} AS MATERIALIZED (SELECT u.k, x.m, sum(u.p * x.v) AS s FROM {u} u JOIN voxl x ON u.subj_id = x.subj_id AND u.vox_id = x.vox_id GROUP BY u.k, x.m),
ju{t} AS MATERIALIZED (SELECT k, sum(p) AS j FROM {u} GROUP BY k),
le{t} AS MATERIALIZED (SELECT k, sqrt(sum(s * s)) AS n FROM yu{t} GROUP BY k),
v{t} AS MATERIALIZED (SELECT y.k, y.m, y.s / l.n AS v FROM yu{t} y JOIN le{t} l ON y.k = l.k)""")
        if kind == "vmf":
            out.append(f"""
q{t} AS MATERIALIZED (SELECT {sql_concentration('r', WIDTH)} AS kappa FROM (SELECT avg(l.n / j.j) AS r FROM le{t} l JOIN ju{t} j ON l.k = j.k))""")
        else:
            out.append(f"""
q{t} AS MATERIALIZED (
  SELECT (sum(u.p * x.yy) - (SELECT sum(2 * s * v) FROM yu{t} y JOIN v{t} w ON y.k = w.k AND y.m = w.m) + sum(u.p))
         / ({WIDTH} * (SELECT count(*) FROM vox)) AS sigma2
  FROM {u} u JOIN (SELECT subj_id, vox_id, sum(v * v) AS yy FROM voxl GROUP BY ALL) x ON u.subj_id = x.subj_id AND u.vox_id = x.vox_id)""")

    out.append(f"""
u0{tag} AS MATERIALIZED (SELECT x.subj_id, x.vox_id, t.k, {mix}::DOUBLE * (x.label = t.k)::INT + (1 - {mix}::DOUBLE) / {PARCELS} AS p FROM vox x CROSS JOIN range({PARCELS}) t(k))""")
    params(f"{tag}0", f"u0{tag}")
    if given_prior:
        out.append(f"""
lp{tag}0 AS MATERIALIZED (SELECT vox_id, k, lp - ln(sum(exp(lp)) OVER (PARTITION BY vox_id)) AS lp FROM pri)""")
    elif spatial:
        out.append(f"\nlp{tag}0 AS MATERIALIZED (SELECT DISTINCT vox_id, t.k, -ln({PARCELS}) AS lp FROM vox CROSS JOIN range({PARCELS}) t(k))")
    else:
        out.append(f"\nlp{tag}0 AS MATERIALIZED (SELECT t.k, -ln({PARCELS}) AS lp FROM range({PARCELS}) t(k))")
    for i in range(iterations):
        t = f"{tag}{i}"
        if kind == "vmf":
            ll = f"max({sql_log_constant(WIDTH, 'q.kappa')}) + max(q.kappa) * sum(x.v * d.v)"
        else:
            ll = f"-0.5 * {WIDTH} * (ln(pi()) + ln(max(q.sigma2))) - 0.5 / max(q.sigma2) * sum((x.v - d.v) * (x.v - d.v))"
        if gated and i == 0:
            ll = f"0 * ({ll})"
        on = "l.k = s.k" + (" AND l.vox_id = s.vox_id" if spatial or given_prior else "")
        out.append(f"""
sc{t} AS MATERIALIZED (SELECT x.subj_id, x.vox_id, d.k, {ll} AS ll FROM voxl x JOIN v{t} d ON x.m = d.m CROSS JOIN q{t} q {where}GROUP BY x.subj_id, x.vox_id, d.k),
jo{t} AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.k, s.ll, l.lp FROM sc{t} s JOIN lp{t} l ON {on}),
mx{t} AS MATERIALIZED (SELECT subj_id, vox_id, max(ll + lp) AS m FROM jo{t} GROUP BY ALL),
post{t} AS MATERIALIZED (
  SELECT j.subj_id, j.vox_id, j.k, j.ll, j.lp, exp(j.ll + j.lp - m.m) / sum(exp(j.ll + j.lp - m.m)) OVER (PARTITION BY j.subj_id, j.vox_id) AS p
  FROM jo{t} j JOIN mx{t} m ON j.subj_id = m.subj_id AND j.vox_id = m.vox_id),
tr{t} AS MATERIALIZED (SELECT sum(CASE WHEN p > 0 THEN p * lp ELSE 0 END) AS ll_a, sum(p * ll) AS ll_e FROM post{t})""")
        if i < iterations - 1:
            params(f"{tag}{i + 1}", f"post{t}")
            nxt = f"lp{tag}{i + 1}"
            if fit_prior:
                out.append(f"\n{nxt} AS MATERIALIZED (SELECT {by}k, CASE WHEN avg(p) > 0 THEN ln(avg(p)) ELSE -3.4028234663852886e38 END AS lp FROM post{t} GROUP BY ALL)")
            else:
                out.append(f"\n{nxt} AS MATERIALIZED (SELECT * FROM lp{t})")
    return ",".join(out)


def sql_trace(iterations: int, tag: str = "", gated: bool = False) -> str:
    rows = []
    for i in range(iterations):
        e = "'-Infinity'::DOUBLE" if gated and i == 0 else "ll_e"
        rows.append(f"SELECT {i}::BIGINT AS iter, ll_a, {e} AS ll_e FROM tr{tag}{i}")
    return " UNION ALL ".join(rows)


def _trace_rows(spark, fit: mixture.FitResult, digits=4):
    return fit.trace_table(spark).select(
        F.col("iter").cast("long").alias("iter"), r6(F.col("ll_a"), digits).alias("ll_a"), r6(F.col("ll_e"), digits).alias("ll_e")
    )


def _flat_uniform(model: mixture.Model) -> mixture.Model:
    return replace(model, prior=priors.IndependentPrior(PARCELS, flat=priors.uniform_flat(PARCELS), spatial=False))


def _node_uniform(spark, sf, model: mixture.Model) -> mixture.Model:
    nodes = views.vox(spark, sf).select(F.col("vox_id").alias("node_id")).distinct()
    table = nodes.withColumn("logpi", A.literal(priors.uniform_flat(PARCELS)))
    return replace(model, prior=priors.IndependentPrior(PARCELS, table=table))


NEVER = 1e-9  # a tolerance so small that only a drop of the log-likelihood stops early

# ---------------------------------------------------------------- EM

T_FLAT, T_NODE = 4, 3


@query("em_vmf_trace", f"""
WITH {VOX}, {sql_em(T_FLAT)}, t AS ({sql_trace(T_FLAT)})
SELECT iter, round(ll_a, 4) + 0.0 AS ll_a, round(ll_e, 4) + 0.0 AS ll_e FROM t""")
def em_vmf_trace(spark, sf):
    model = _flat_uniform(softened(spark, sf, 0.5))
    fit = mixture.fit_em(model, vox_aligned(spark, sf), T_FLAT, NEVER, first_evidence=True)
    return _trace_rows(spark, fit)


@query("em_vmf_posterior", f"""
WITH {VOX}, {sql_em(T_NODE, spatial=True)}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post{T_NODE - 1}""")
def em_vmf_posterior(spark, sf):
    """A prior per location, learned together with the directions."""
    model = _node_uniform(spark, sf, softened(spark, sf, 0.5))
    fit = mixture.fit_em(model, vox_aligned(spark, sf), T_NODE, NEVER, first_evidence=True)
    return views.explode_parcels(fit.posterior(), "uhat", "subj_id", "vox_id")


@query("em_gmm_trace", f"""
WITH {VOX}, {sql_em(T_NODE, kind='gmm')}, t AS ({sql_trace(T_NODE)})
SELECT iter, round(ll_a, 4) + 0.0 AS ll_a, round(ll_e, 4) + 0.0 AS ll_e FROM t""")
def em_gmm_trace(spark, sf):
    gmm = mixture.Model(priors.IndependentPrior(PARCELS), (em.IsotropicGaussian(np.zeros((WIDTH, PARCELS))),))
    model = _flat_uniform(softened(spark, sf, 0.5, model=gmm))
    fit = mixture.fit_em(model, vox_aligned(spark, sf), T_NODE, NEVER, first_evidence=True)
    return _trace_rows(spark, fit)


@query("em_gated_start", f"""
WITH {VOX}, {LABEL_PRIOR}, {sql_em(3, fit_prior=False, gated=True, given_prior=True)}, t AS ({sql_trace(3, gated=True)})
SELECT iter, round(ll_a, 4) + 0.0 AS ll_a, round(ll_e, 4) + 0.0 AS ll_e FROM t""")
def em_gated_start(spark, sf):
    """Frozen group prior, no evidence in the first pass: how subjects are parcellated."""
    model = replace(softened(spark, sf, 0.5), prior=label_prior(spark, sf))
    fit = mixture.fit_em(model, vox_aligned(spark, sf), 3, NEVER, fit_prior=False, first_evidence=False)
    return _trace_rows(spark, fit)


@query("individual_maps", f"""
WITH {VOX}, {LABEL_PRIOR}, {sql_em(3, fit_prior=False, gated=True, given_prior=True)}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM post2""")
def individual_maps(spark, sf):
    model = replace(softened(spark, sf, 0.5), prior=label_prior(spark, sf))
    fit = mixture.fit_em(model, vox_aligned(spark, sf), 3, NEVER, fit_prior=False, first_evidence=False)
    return views.explode_parcels(fit.posterior(), "uhat", "subj_id", "vox_id")


T_STOP, STOP_TOL = 5, 150.0


@query("em_stop_rule", f"""
WITH {VOX}, {sql_em(T_STOP)}, t AS ({sql_trace(T_STOP)}),
d AS (SELECT iter, ll_a + ll_e AS ll, ll_a + ll_e - lag(ll_a + ll_e) OVER (ORDER BY iter) AS change FROM t),
s AS (SELECT min(iter) AS last FROM d WHERE iter = {T_STOP - 1} OR change < {STOP_TOL})
SELECT d.iter, round(d.ll, 4) + 0.0 AS ll, (d.iter = s.last AND change < -{STOP_TOL})::BIGINT AS rolled_back
FROM d CROSS JOIN s WHERE d.iter <= s.last""")
def em_stop_rule(spark, sf):
    """Stops at the first gain below the tolerance; a drop beyond it rolls back."""
    model = _flat_uniform(softened(spark, sf, 0.5))
    fit = mixture.fit_em(model, vox_aligned(spark, sf), T_STOP, STOP_TOL, first_evidence=True)
    last = len(fit.trace) - 1
    back = fit.model is not fit.history[-1]
    rows = [(i, float(round(v, 4)), int(back and i == last)) for i, v in enumerate(fit.loglik)]
    return spark.createDataFrame(rows, "iter long, ll double, rolled_back long")


MIXES = (0.2, 0.5, 0.8)
_STARTS = ", ".join(sql_em(2, m, tag=f"a{i}_") for i, m in enumerate(MIXES))
_STARTS_TRACE = " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS start, iter, ll_a + ll_e AS ll FROM ({sql_trace(2, f'a{i}_')})" for i in range(len(MIXES))
)


@query("em_multistart_best", f"""
WITH {VOX}, {_STARTS}, t AS ({_STARTS_TRACE}),
b AS (SELECT start FROM t WHERE iter = 1 ORDER BY ll DESC, start LIMIT 1)
SELECT t.start, t.iter, round(t.ll, 4) + 0.0 AS ll, (t.start = b.start)::BIGINT AS best FROM t CROSS JOIN b""")
def em_multistart_best(spark, sf):
    """Three starts share every pass; the best one goes on."""
    starts = [_flat_uniform(softened(spark, sf, m)) for m in MIXES]
    fit = mixture.fit_em_starts(starts, vox_aligned(spark, sf), first_iter=2, max_iter=4, tol=NEVER, align_on=None)
    finals = [t[-1] for t in fit.first_traces]
    best = finals.index(max(finals))
    rows = [(s, i, float(round(v, 4)), int(s == best)) for s, t in enumerate(fit.first_traces) for i, v in enumerate(t)]
    return spark.createDataFrame(rows, "start long, iter long, ll double, best long")


@query("em_multistart_spatial", f"""
WITH {VOX}, {", ".join(sql_em(3, m, spatial=True, tag=f"b{i}_") for i, m in enumerate(MIXES[:2]))},
t AS ({" UNION ALL ".join(f"SELECT {i}::BIGINT AS start, iter, ll_a + ll_e AS ll FROM ({sql_trace(3, f'b{i}_')})" for i in range(2))})
SELECT start, iter, round(ll, 4) + 0.0 AS ll FROM t""")
def em_multistart_spatial(spark, sf):
    """Several starts, each with its own prior per location, in shared passes."""
    starts = [_node_uniform(spark, sf, softened(spark, sf, m)) for m in MIXES[:2]]
    fits = mixture.fit_em_starts(starts, vox_aligned(spark, sf), first_iter=3, max_iter=4, tol=NEVER, align_on=None)
    rows = [(s, i, float(round(v, 4))) for s, t in enumerate(fits.first_traces) for i, v in enumerate(t)]
    return spark.createDataFrame(rows, "start long, iter long, ll double")


# Two datasets with partly shared subjects, learned together.
def _sql_fused(iterations):
    from tessera.plans.prior_queries import _HALVES

    out = [_HALVES.replace(" AS (", " AS MATERIALIZED ("), """
d0 AS (SELECT ds, k, m, v FROM hd), w0 AS (SELECT ds, kappa FROM hk)"""]
    out.append(f"\nf0 AS (SELECT t.k, -ln({PARCELS}) AS lp FROM range({PARCELS}) t(k))")
    for i in range(iterations):
        out.append(f"""
s{i} AS MATERIALIZED (SELECT x.ds, x.subj_id, x.vox_id, d.k, max({sql_log_constant(PART, 'q.kappa')}) + max(q.kappa) * sum(x.v * d.v) AS ll
       FROM hu x JOIN d{i} d ON x.ds = d.ds AND x.m = d.m JOIN w{i} q ON q.ds = x.ds GROUP BY x.ds, x.subj_id, x.vox_id, d.k),
c{i} AS MATERIALIZED (SELECT subj_id, vox_id, s.k, sum(s.ll) AS ll, max(f.lp) AS lp FROM s{i} s JOIN f{i} f ON s.k = f.k GROUP BY ALL),
m{i} AS MATERIALIZED (SELECT subj_id, vox_id, max(ll + lp) AS m FROM c{i} GROUP BY ALL),
p{i} AS MATERIALIZED (SELECT c.subj_id, c.vox_id, c.k, c.ll, c.lp, exp(c.ll + c.lp - m.m) / sum(exp(c.ll + c.lp - m.m)) OVER (PARTITION BY c.subj_id, c.vox_id) AS p
       FROM c{i} c JOIN m{i} m ON c.subj_id = m.subj_id AND c.vox_id = m.vox_id),
tr{i} AS MATERIALIZED (SELECT sum(p * lp) AS ll_a, sum(p * ll) AS ll_e FROM p{i})""")
        if i < iterations - 1:
            n = i + 1
            out.append(f"""
y{n} AS MATERIALIZED (SELECT x.ds, u.k, x.m, sum(u.p * x.v) AS s FROM p{i} u JOIN hu x ON u.subj_id = x.subj_id AND u.vox_id = x.vox_id GROUP BY ALL),
j{n} AS MATERIALIZED (SELECT x.ds, u.k, sum(u.p) AS j FROM p{i} u JOIN (SELECT DISTINCT ds, subj_id, vox_id FROM hu) x ON u.subj_id = x.subj_id AND u.vox_id = x.vox_id GROUP BY ALL),
l{n} AS MATERIALIZED (SELECT ds, k, sqrt(sum(s * s)) AS n FROM y{n} GROUP BY ALL),
d{n} AS MATERIALIZED (SELECT y.ds, y.k, y.m, y.s / l.n AS v FROM y{n} y JOIN l{n} l ON y.ds = l.ds AND y.k = l.k),
w{n} AS MATERIALIZED (SELECT ds, {sql_concentration('r', PART)} AS kappa FROM (SELECT l.ds, avg(l.n / j.j) AS r FROM l{n} l JOIN j{n} j ON l.ds = j.ds AND l.k = j.k GROUP BY l.ds)),
f{n} AS MATERIALIZED (SELECT k, ln(avg(p)) AS lp FROM p{i} GROUP BY k)""")
    return ",".join(out)


@query("em_fused_trace", f"""
WITH {VOX}, {_sql_fused(3)}, t AS ({sql_trace(3)})
SELECT iter, round(ll_a, 4) + 0.0 AS ll_a, round(ll_e, 4) + 0.0 AS ll_e FROM t""")
def em_fused_trace(spark, sf):
    aligned, model = fused_model(spark, sf)
    model = _flat_uniform(model)
    return _trace_rows(spark, mixture.fit_em(model, aligned, 3, NEVER, first_evidence=True))


def _sql_symmetric(iterations: int) -> str:
    """EM with one prior per node and directions for both sides, written out."""
    from tessera.plans.prior_queries import _PAIRS

    out = [_PAIRS.replace(" AS (", " AS MATERIALIZED ("), f"""
u0 AS MATERIALIZED (SELECT x.subj_id, x.vox_id, t.k, 0.5::DOUBLE * (x.label = t.k)::INT + 0.05::DOUBLE AS p FROM vox x CROSS JOIN range({PARCELS}) t(k)),
g0 AS MATERIALIZED (SELECT node_id, t.k, -ln({HALF}) AS lp FROM node CROSS JOIN range({HALF}) t(k)),
one AS (SELECT vox_id, node_id, min(side) AS side FROM lay GROUP BY ALL)"""]
    for i in range(iterations):
        u = f"u{i}"
        out.append(f"""
y{i} AS MATERIALIZED (SELECT u.k, x.m, sum(u.p * x.v) AS s FROM {u} u JOIN voxl x ON u.subj_id = x.subj_id AND u.vox_id = x.vox_id GROUP BY u.k, x.m),
l{i} AS MATERIALIZED (SELECT k, sqrt(sum(s * s)) AS n FROM y{i} GROUP BY k),
v{i} AS MATERIALIZED (SELECT y.k, y.m, y.s / l.n AS v FROM y{i} y JOIN l{i} l ON y.k = l.k),
q{i} AS MATERIALIZED (SELECT {sql_concentration('r', WIDTH)} AS kappa FROM (SELECT avg(l.n / j.j) AS r FROM l{i} l JOIN (SELECT k, sum(p) AS j FROM {u} GROUP BY k) j ON l.k = j.k)),
s{i} AS MATERIALIZED (SELECT x.subj_id, x.vox_id, d.k, max({sql_log_constant(WIDTH, 'q.kappa')}) + max(q.kappa) * sum(x.v * d.v) AS ll
       FROM voxl x JOIN v{i} d ON x.m = d.m CROSS JOIN q{i} q GROUP BY x.subj_id, x.vox_id, d.k),
n{i} AS MATERIALIZED (SELECT s.subj_id, l.node_id, s.k % {HALF} AS k, sum(s.ll) AS ll FROM s{i} s JOIN lay l ON s.vox_id = l.vox_id AND s.k // {HALF} = l.side GROUP BY ALL),
b{i} AS MATERIALIZED (SELECT n.subj_id, n.node_id, n.k, n.ll + g.lp AS b FROM n{i} n JOIN g{i} g ON n.node_id = g.node_id AND n.k = g.k),
w{i} AS MATERIALIZED (SELECT subj_id, node_id, k, exp(b - m) / sum(exp(b - m)) OVER (PARTITION BY subj_id, node_id) AS u
       FROM (SELECT *, max(b) OVER (PARTITION BY subj_id, node_id) AS m FROM b{i})),
u{i + 1} AS MATERIALIZED (SELECT w.subj_id, o.vox_id, w.k + {HALF} * t.side AS k, CASE WHEN d.mid THEN w.u / 2 WHEN t.side = o.side THEN w.u ELSE 0 END AS p
       FROM w{i} w JOIN one o ON w.node_id = o.node_id JOIN node d ON d.node_id = w.node_id CROSS JOIN (VALUES (0), (1)) t(side)),
g{i + 1} AS MATERIALIZED (SELECT node_id, k, ln(avg(u)) AS lp FROM w{i} GROUP BY ALL)""")
    return ",".join(out)


@query("em_symmetric_groups", f"""
WITH {VOX}, {_sql_symmetric(3)}
SELECT subj_id, vox_id, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM u3""")
def em_symmetric_groups(spark, sf):
    """Symmetric prior per node, learned with directions for both sides."""
    layout = pair_layout(spark, sf)
    nodes = layout.table.select("node_id").distinct().withColumn("logpi", A.literal(priors.uniform_flat(HALF)))
    prior = priors.IndependentPrior(HALF, table=nodes, layout=layout)
    start = softened(spark, sf, 0.5)
    fit = mixture.fit_em(
        mixture.Model(prior, start.emissions), mixture.align([views.vox_evidence(spark, sf)], prior), 3, NEVER,
        first_evidence=True,
    )
    return views.explode_parcels(fit.posterior(), "uhat", "subj_id", "vox_id")


# ---------------------------------------------------------------- learning from a stream

BATCHES, DECAY = 3, 0.5


def _sql_stream() -> str:
    """Micro-batches by embedding number; sums decay, parameters follow after each."""
    out = [f"""
d0 AS (SELECT k, m, v FROM dir), w0 AS (SELECT kappa FROM kap), f0 AS (SELECT t.k, -ln({PARCELS}) AS lp FROM range({PARCELS}) t(k))"""]
    for b in range(BATCHES):
        mine = f"(x.vox_id * {SUBJECTS} + x.subj_id) % {BATCHES} = {b}"
        old = lambda c, t, on: f"n.{c}" if b == 0 else f"n.{c} + {DECAY} * (SELECT o.{c} FROM {t}{b - 1} o WHERE {on})"  # noqa: E731, B023
        out.append(f"""
s{b} AS MATERIALIZED (SELECT x.subj_id, x.vox_id, d.k, max({sql_log_constant(WIDTH, 'q.kappa')}) + max(q.kappa) * sum(x.v * d.v) + max(f.lp) AS b
  FROM voxl x JOIN d{b} d ON x.m = d.m CROSS JOIN w{b} q JOIN f{b} f ON f.k = d.k WHERE {mine} GROUP BY x.subj_id, x.vox_id, d.k),
p{b} AS MATERIALIZED (SELECT subj_id, vox_id, k, exp(b - t) / sum(exp(b - t)) OVER (PARTITION BY subj_id, vox_id) AS p
  FROM (SELECT *, max(b) OVER (PARTITION BY subj_id, vox_id) AS t FROM s{b})),
y{b} AS MATERIALIZED (SELECT n.k, n.m, {old("s", "y", "o.k = n.k AND o.m = n.m")} AS s
  FROM (SELECT p.k, x.m, sum(p.p * x.v) AS s FROM p{b} p JOIN voxl x ON x.subj_id = p.subj_id AND x.vox_id = p.vox_id GROUP BY p.k, x.m) n),
j{b} AS MATERIALIZED (SELECT n.k, {old("j", "j", "o.k = n.k")} AS j FROM (SELECT k, sum(p) AS j FROM p{b} GROUP BY k) n),
l{b} AS MATERIALIZED (SELECT k, sqrt(sum(s * s)) AS n FROM y{b} GROUP BY k),
d{b + 1} AS MATERIALIZED (SELECT y.k, y.m, y.s / l.n AS v FROM y{b} y JOIN l{b} l ON y.k = l.k),
w{b + 1} AS MATERIALIZED (SELECT {sql_concentration('r', WIDTH)} AS kappa FROM (SELECT avg(l.n / j.j) AS r FROM l{b} l JOIN j{b} j ON l.k = j.k)),
f{b + 1} AS MATERIALIZED (SELECT k, ln(j / (SELECT sum(j) FROM j{b})) AS lp FROM j{b})""")
    return ",".join(out)


@query("stream_learned", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {_sql_stream()}
SELECT 'V' AS name, m::BIGINT AS m, k::BIGINT AS k, round(v, 6) + 0.0 AS value FROM d{BATCHES}
UNION ALL SELECT 'kappa', 0, 0, round(kappa, 6) FROM w{BATCHES}
UNION ALL SELECT 'pi', 0, k, round(exp(lp), 6) FROM f{BATCHES}""")
def stream_learned(spark, sf):
    """Parameters after a stream of three files, each scored with those before it."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/learn-{uuid.uuid4().hex}"
    rows = views.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % SUBJECTS).alias("subj_id"), F.expr(f"vec_id div {SUBJECTS}").alias("vox_id"), "vec_id", F.col("embedding").alias("y"))
    for b in range(BATCHES):  # the files arrive one after the other
        part = rows.where(F.col("vec_id") % BATCHES == b).drop("vec_id")
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    schema = rows.drop("vec_id").schema
    prior = IndependentPrior(PARCELS, flat=priors.uniform_flat(PARCELS), spatial=False)
    model = replace(label_vmf(spark, sf), prior=prior)
    stream = scoring.read_stream(spark, f"{base}/in", schema, files_per_batch=1)
    fit = learning.learn_stream(stream, model, f"{base}/model", f"{base}/state", DECAY, normalised=True)
    e = fit.emissions[0]
    pi = np.exp(fit.prior.flat - fit.prior.flat.max())
    found = [("V", m, k, e.v[m, k]) for m in range(WIDTH) for k in range(PARCELS)]
    found += [("kappa", 0, 0, e.kappa)] + [("pi", 0, k, p) for k, p in enumerate(pi / pi.sum())]
    return spark.createDataFrame(
        [(n, m, k, float(round(float(v), 6)) + 0.0) for n, m, k, v in found], "name string, m long, k long, value double")

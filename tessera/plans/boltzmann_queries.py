"""Boltzmann-machine priors, samplers and stochastic learning."""

from __future__ import annotations

import re
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import randoms
from tessera.operators import boltzmann, crossval, mixture, sampling, spatial, stochastic
from tessera.plans import views
from tessera.plans.emission_queries import (
    GME_BETA, GME_SIGMA2, GMM_PARAMS, LABEL_SUMS, SHARED_KAPPA, VMF_SCORES, label_gme, label_gmm, label_vmf, sql_log_constant,
    vox_aligned,
)
from tessera.plans.prior_queries import LABEL_PRIOR, label_prior
from tessera.plans.registry import query
from tessera.plans.views import PARCELS, VOX, r6
from tessera.session import cut_lineage

HIDDEN = 4
BH = (0.1, -0.2, 0.3, 0.0)
STEPS = 2

_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

# ---------------------------------------------------------------- binary hidden units


def binary_model(spark, sf) -> boltzmann.BinaryHidden:
    """Small hashed weights for every location, biases from the label prior."""
    w = F.array(*[
        F.array(*[(randoms.uniform("w", F.col("node_id"), F.lit(h), F.lit(k)) - 0.5) * 0.4 for k in range(PARCELS)])
        for h in range(HIDDEN)
    ])
    prior = label_prior(spark, sf).table
    return boltzmann.BinaryHidden(prior.select("node_id", w.alias("w"), F.col("logpi").alias("bu")), np.array(BH), PARCELS)


def node_scores(spark, sf):
    ll = mixture.loglik(views.vox_evidence(spark, sf), label_vmf(spark, sf).emissions[0])
    # Soft evidence, so that the hidden units matter.
    return ll.select("subj_id", F.col("vox_id").alias("node_id"), A.scale(F.col("ll"), F.lit(0.1)).alias("ll"))


_BASE = f"{VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {LABEL_PRIOR}"
_BINARY = f"""{_BASE},
bh AS (SELECT * FROM (VALUES {", ".join(f"({h}, {b}::DOUBLE)" for h, b in enumerate(BH))}) b(h, b)),
we AS MATERIALIZED (SELECT v.vox_id, h.h, k.k, ({_U.format("'w|' || v.vox_id || '|' || h.h || '|' || k.k")} - 0.5) * 0.4 AS w
       FROM (SELECT DISTINCT vox_id FROM vox) v CROSS JOIN range({HIDDEN}) h(h) CROSS JOIN range({PARCELS}) k(k)),
base AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.k, 0.1 * s.ll + p.lp AS b FROM sc s JOIN pri p ON s.vox_id = p.vox_id AND s.k = p.k)"""


def _sql_softmax(name: str, source: str, keys: str = "subj_id, vox_id", out: str = "u") -> str:
    on = " AND ".join(f"x.{c} = m.{c}" for c in keys.split(", "))
    part = ", ".join(f"x.{c}" for c in keys.split(", "))
    return f"""
{name}_m AS MATERIALIZED (SELECT {keys}, max(b) AS m FROM {source} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {part}, x.k, exp(x.b - m.m) / sum(exp(x.b - m.m)) OVER (PARTITION BY {part}) AS {out} FROM {source} x JOIN {name}_m m ON {on})"""


def _sql_binary(steps: int) -> str:
    out = [_sql_softmax("u0", "base")]
    for i in range(steps):
        out.append(f"""
a{i} AS MATERIALIZED (SELECT u.subj_id, w.h, sum(u.u * w.w) AS a FROM u{i} u JOIN we w ON u.vox_id = w.vox_id AND u.k = w.k GROUP BY ALL),
h{i} AS MATERIALIZED (SELECT a.subj_id, a.h, 1 / (1 + exp(-(a.a + b.b))) AS e FROM a{i} a JOIN bh b ON a.h = b.h),
f{i} AS MATERIALIZED (SELECT b.subj_id, b.vox_id, b.k, b.b + sum(h.e * w.w) AS b FROM base b JOIN we w ON b.vox_id = w.vox_id AND b.k = w.k
      JOIN h{i} h ON h.subj_id = b.subj_id AND h.h = w.h GROUP BY b.subj_id, b.vox_id, b.k, b.b)""")
        out.append(_sql_softmax(f"u{i + 1}", f"f{i}"))
    return ",".join(out)


@query("rbm_meanfield", f"""
WITH {_BINARY}, {_sql_binary(STEPS)}
SELECT subj_id, vox_id AS node_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM u{STEPS}""")
def rbm_meanfield(spark, sf):
    uhat, _ = boltzmann.mean_field(node_scores(spark, sf), binary_model(spark, sf), STEPS)
    return views.explode_parcels(uhat, "uhat", "subj_id", "node_id")


@query("rbm_hidden", f"""
WITH {_BINARY}, {_sql_binary(STEPS)}
SELECT subj_id, h::BIGINT AS k, round(e, 6) + 0.0 AS p FROM h{STEPS - 1}""")
def rbm_hidden(spark, sf):
    _, hidden = boltzmann.mean_field(node_scores(spark, sf), binary_model(spark, sf), STEPS)
    return views.explode_parcels(hidden, "eh", "subj_id")


_ONE_HOT = f"oh AS (SELECT x.subj_id, x.vox_id, t.k, (x.label = t.k)::INT::DOUBLE AS u FROM vox x CROSS JOIN range({PARCELS}) t(k))"
_BINARY_NEG = f"""
na AS (SELECT u.subj_id, w.h, sum(u.u * w.w) AS a FROM oh u JOIN we w ON u.vox_id = w.vox_id AND u.k = w.k GROUP BY ALL),
ne AS MATERIALIZED (SELECT a.subj_id, a.h, 1 / (1 + exp(-(a.a + b.b))) AS e FROM na a JOIN bh b ON a.h = b.h),
nh AS MATERIALIZED (SELECT subj_id, h, ({_U.format("'5.h0|' || subj_id || '|' || h")} < e)::INT::DOUBLE AS s FROM ne),
nf AS (SELECT x.subj_id, p.vox_id, p.k, p.lp + sum(h.s * w.w) AS b FROM (SELECT DISTINCT subj_id, vox_id FROM vox) x JOIN pri p ON x.vox_id = p.vox_id
       JOIN we w ON p.vox_id = w.vox_id AND p.k = w.k JOIN nh h ON h.subj_id = x.subj_id AND h.h = w.h GROUP BY x.subj_id, p.vox_id, p.k, p.lp),
{_sql_softmax("nu", "nf")}"""


def label_states(spark, sf):
    return views.vox(spark, sf).select(
        "subj_id", F.col("vox_id").alias("node_id"), A.one_hot(F.col("label"), PARCELS).alias("u")
    )


@query("rbm_negative_phase", f"""
WITH {_BINARY}, {_ONE_HOT}, {_BINARY_NEG}
SELECT subj_id, vox_id AS node_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM nu""")
def rbm_negative_phase(spark, sf):
    """One step of contrastive divergence from the labels."""
    states, _ = boltzmann.negative_phase(label_states(spark, sf), binary_model(spark, sf), 1, 5)
    return views.explode_parcels(states, "pu", "subj_id", "node_id")


@query("rbm_gradient_step", f"""
WITH {_BINARY}, {_sql_binary(STEPS)}, {_ONE_HOT}, {_BINARY_NEG},
gp AS (SELECT u.vox_id, h.h, u.k, sum(u.u * h.e) AS g FROM u{STEPS} u JOIN h{STEPS - 1} h ON u.subj_id = h.subj_id GROUP BY ALL),
gn AS (SELECT u.vox_id, h.h, u.k, sum(u.u * h.e) AS g FROM nu u JOIN ne h ON u.subj_id = h.subj_id GROUP BY ALL)
SELECT w.vox_id AS node_id, w.h::BIGINT AS h, w.k::BIGINT AS k, round(w.w + 0.01 * (p.g - n.g), 6) + 0.0 AS w
FROM we w JOIN gp p ON w.vox_id = p.vox_id AND w.h = p.h AND w.k = p.k JOIN gn n ON w.vox_id = n.vox_id AND w.h = n.h AND w.k = n.k""")
def rbm_gradient_step(spark, sf):
    model = binary_model(spark, sf)
    uhat, hidden = boltzmann.mean_field(node_scores(spark, sf), model, STEPS)
    neg, neg_hidden = boltzmann.negative_phase(label_states(spark, sf), model, 1, 5)
    new = boltzmann.binary_step(model, uhat, hidden, neg, neg_hidden)
    rows = new.weights.select("node_id", F.posexplode("w").alias("h", "r"))
    return views.explode_parcels(rows.withColumn("h", F.col("h").cast("long")), "r", "node_id", "h", alias="w")


_COMPLETE = f"""
tr AS (SELECT j.j, o.subj_id, o.vox_id, o.k, CASE WHEN o.vox_id % 3 = j.j THEN 0.5 ELSE o.u END AS u FROM oh o CROSS JOIN range(3) j(j)),
ta AS (SELECT t.j, t.subj_id, w.h, sum(t.u * w.w) AS a FROM tr t JOIN we w ON t.vox_id = w.vox_id AND t.k = w.k GROUP BY ALL),
th AS (SELECT a.j, a.subj_id, a.h, 1 / (1 + exp(-(a.a + b.b))) AS e FROM ta a JOIN bh b ON a.h = b.h),
tf AS (SELECT o.subj_id, o.vox_id, o.k, p.lp + sum(h.e * w.w) AS b FROM oh o JOIN pri p ON o.vox_id = p.vox_id AND o.k = p.k JOIN we w ON w.vox_id = o.vox_id AND w.k = o.k
       JOIN th h ON h.j = o.vox_id % 3 AND h.subj_id = o.subj_id AND h.h = w.h GROUP BY o.subj_id, o.vox_id, o.k, p.lp),
{_sql_softmax("tu", "tf")}"""


@query("rbm_completion", f"""
WITH {_BINARY}, {_ONE_HOT}, {_COMPLETE}
SELECT round(sum(abs(o.u - t.u)), 4) + 0.0 AS loss FROM oh o JOIN tu t ON o.subj_id = t.subj_id AND o.vox_id = t.vox_id AND o.k = t.k""")
def rbm_completion(spark, sf):
    """Each third of the locations predicted from the other two."""
    out = boltzmann.completion_loss(label_states(spark, sf), binary_model(spark, sf), F.col("node_id") % 3, 3)
    return out.select(r6(F.col("loss"), 4).alias("loss"))


@query("rbm_baseline", f"""
WITH {VOX}, {_ONE_HOT}, m AS (SELECT k, avg(u) AS p FROM oh GROUP BY ALL)
SELECT round(sum(abs(o.u - m.p)), 4) + 0.0 AS loss FROM oh o JOIN m ON o.k = m.k""")
def rbm_baseline(spark, sf):
    return boltzmann.baseline_loss(label_states(spark, sf), PARCELS).select(r6(F.col("loss"), 4).alias("loss"))


@query("rbm_sample")
def rbm_sample(spark, sf):
    model = binary_model(spark, sf)
    return boltzmann.sample(model.weights.select("node_id"), model, 3, 2, 9)


# ---------------------------------------------------------------- sparse connections

STRENGTH = (0.6, 0.3)
CHAINS = 4


def sparse_model(spark, sf) -> boltzmann.SparseHidden:
    """One hidden unit per location, linked to it (component 0) and its chain neighbours (component 1)."""
    nodes = views.vox(spark, sf).select(F.col("vox_id").alias("node_id")).distinct()
    own = nodes.select(F.col("node_id").alias("h"), "node_id", F.lit(0).alias("component"), F.lit(1.0).alias("w"))
    near = spatial.chain_edges(nodes).select(
        F.col("src").alias("h"), F.col("dst").alias("node_id"), F.lit(1).alias("component"), F.lit(0.5).alias("w")
    )
    bias = label_prior(spark, sf).table.withColumnRenamed("logpi", "bu")
    return boltzmann.SparseHidden(own.unionByName(near), bias, STRENGTH, PARCELS)


_SPARSE = f"""{_BASE},
nodes AS (SELECT DISTINCT vox_id FROM vox),
ed AS MATERIALIZED (SELECT vox_id AS h, vox_id, 0 AS c, 1.0::DOUBLE AS w FROM nodes UNION ALL
       SELECT a.vox_id, b.vox_id, 1, 0.5::DOUBLE FROM nodes a JOIN nodes b ON abs(a.vox_id - b.vox_id) = 1),
li AS MATERIALIZED (SELECT h, vox_id, sum(w * CASE c WHEN 0 THEN {STRENGTH[0]}::DOUBLE ELSE {STRENGTH[1]}::DOUBLE END) AS w FROM ed GROUP BY ALL),
base AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.k, 0.1 * s.ll + p.lp AS b FROM sc s JOIN pri p ON s.vox_id = p.vox_id AND s.k = p.k)"""


def _sql_sparse(steps: int) -> str:
    out = [_sql_softmax("u0", "base")]
    for i in range(steps):
        out.append(f"""
a{i} AS MATERIALIZED (SELECT u.subj_id, l.h, u.k, sum(l.w * u.u) AS b FROM u{i} u JOIN li l ON u.vox_id = l.vox_id GROUP BY ALL),
{_sql_softmax(f"h{i}", f"a{i}", "subj_id, h", "v")},
g{i} AS MATERIALIZED (SELECT v.subj_id, l.vox_id, v.k, sum(l.w * v.v) AS a FROM h{i} v JOIN li l ON v.h = l.h GROUP BY ALL),
f{i} AS MATERIALIZED (SELECT b.subj_id, b.vox_id, b.k, b.b + coalesce(g.a, 0) AS b FROM base b LEFT JOIN g{i} g ON b.subj_id = g.subj_id AND b.vox_id = g.vox_id AND b.k = g.k)""")
        out.append(_sql_softmax(f"u{i + 1}", f"f{i}"))
    return ",".join(out)


@query("cmp_rbm_meanfield", f"""
WITH {_SPARSE}, {_sql_sparse(STEPS)}
SELECT subj_id, vox_id AS node_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM u{STEPS}""")
def cmp_rbm_meanfield(spark, sf):
    uhat, _ = boltzmann.sparse_mean_field(node_scores(spark, sf), sparse_model(spark, sf), STEPS)
    return views.explode_parcels(uhat, "uhat", "subj_id", "node_id")


@query("cmp_rbm_pretrain", f"""
WITH {_SPARSE}, {_sql_sparse(1)}
SELECT subj_id, h, k::BIGINT AS k, round(v, 6) + 0.0 AS p FROM h0""")
def cmp_rbm_pretrain(spark, sf):
    """Single pass to the hidden units."""
    _, hidden = boltzmann.sparse_mean_field(node_scores(spark, sf), sparse_model(spark, sf), pretrain=True)
    return views.explode_parcels(hidden, "hhat", "subj_id", "h")


@query("cmp_rbm_loglik", f"""
WITH {_SPARSE}, {_sql_sparse(STEPS)},
bi AS (SELECT u.subj_id, sum(u.u * p.lp) AS b FROM u{STEPS} u JOIN pri p ON u.vox_id = p.vox_id AND u.k = p.k GROUP BY ALL),
ln AS (SELECT u.subj_id, sum(l.w * u.u * v.v) AS c FROM u{STEPS} u JOIN li l ON u.vox_id = l.vox_id JOIN h{STEPS - 1} v ON v.subj_id = u.subj_id AND v.h = l.h AND v.k = u.k GROUP BY ALL)
SELECT b.subj_id, round(b.b, 5) + 0.0 AS bias, round(l.c, 5) + 0.0 AS link FROM bi b JOIN ln l ON b.subj_id = l.subj_id""")
def cmp_rbm_loglik(spark, sf):
    model = sparse_model(spark, sf)
    uhat, hidden = boltzmann.sparse_mean_field(node_scores(spark, sf), model, STEPS)
    out = boltzmann.unnormalised_loglik(uhat, hidden, model)
    return out.select("subj_id", r6(F.col("bias"), 5).alias("bias"), r6(F.col("link"), 5).alias("link"))


@query("cmp_rbm_gradient", f"""
WITH {_SPARSE}, {_sql_sparse(STEPS)},
gr AS (SELECT e.c, sum(e.w * u.u * v.v) AS g FROM u{STEPS} u JOIN ed e ON u.vox_id = e.vox_id JOIN h{STEPS - 1} v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL)
SELECT g.c::BIGINT AS component, round(g.g / (SELECT count(DISTINCT subj_id) FROM vox) / (SELECT sum(w) FROM ed WHERE c = g.c), 6) + 0.0 AS gradient FROM gr g""")
def cmp_rbm_gradient(spark, sf):
    model = sparse_model(spark, sf)
    uhat, hidden = boltzmann.sparse_mean_field(node_scores(spark, sf), model, STEPS)
    out = boltzmann.component_gradient(uhat, hidden, model.edges)
    return out.select(F.col("component").cast("long").alias("component"), r6(F.col("gradient")).alias("gradient"))


_SPARSE_NEG = f"""
pp AS (SELECT vox_id, k, exp(lp) / sum(exp(lp)) OVER (PARTITION BY vox_id) AS p FROM pri),
pc AS (SELECT vox_id, k, sum(p) OVER (PARTITION BY vox_id ORDER BY k) AS c FROM pp),
s0 AS MATERIALIZED (SELECT s.s AS subj_id, c.vox_id, coalesce(min(CASE WHEN {_U.format("'2|' || s.s || '|' || c.vox_id")} < c.c THEN c.k END), 0) AS u FROM pc c CROSS JOIN range({CHAINS}) s(s) GROUP BY ALL),
na AS (SELECT s.subj_id, l.h, t.k, sum(CASE WHEN s.u = t.k THEN l.w ELSE 0 END) AS b FROM s0 s JOIN li l ON s.vox_id = l.vox_id CROSS JOIN range({PARCELS}) t(k) GROUP BY ALL),
{_sql_softmax("nh", "na", "subj_id, h", "p")},
nc AS (SELECT subj_id, h, k, sum(p) OVER (PARTITION BY subj_id, h ORDER BY k) AS c FROM nh),
nd AS MATERIALIZED (SELECT subj_id, h, coalesce(min(CASE WHEN {_U.format("'4.h0|' || subj_id || '|' || h")} < c THEN k END), 0) AS v FROM nc GROUP BY ALL),
nf AS (SELECT s.subj_id, p.vox_id, p.k, p.lp + coalesce(sum(CASE WHEN d.v = p.k THEN l.w ELSE 0 END), 0) AS b FROM s0 s JOIN pri p ON s.vox_id = p.vox_id
       LEFT JOIN li l ON l.vox_id = p.vox_id LEFT JOIN nd d ON d.subj_id = s.subj_id AND d.h = l.h GROUP BY s.subj_id, p.vox_id, p.k, p.lp),
{_sql_softmax("nu", "nf")}"""


@query("cmp_rbm_negative_phase", f"""
WITH {_SPARSE}, {_SPARSE_NEG}
SELECT subj_id, vox_id AS node_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM nu""")
def cmp_rbm_negative_phase(spark, sf):
    """One Gibbs step of four chains drawn from the biases, without evidence."""
    model = sparse_model(spark, sf)
    states, _ = boltzmann.sparse_negative_phase(boltzmann.start_chains(model, CHAINS, 2), model, 1, 4)
    return views.explode_parcels(states, "pu", "subj_id", "node_id")


@query("cmp_rbm_step", f"""
WITH {_SPARSE}, {_sql_sparse(STEPS)}, {_SPARSE_NEG},
gp AS (SELECT e.c, sum(e.w * u.u * v.v) / (SELECT count(DISTINCT subj_id) FROM vox) AS g FROM u{STEPS} u JOIN ed e ON u.vox_id = e.vox_id JOIN h{STEPS - 1} v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL),
gn AS (SELECT e.c, sum(e.w * u.u * v.p) / {CHAINS} AS g FROM nu u JOIN ed e ON u.vox_id = e.vox_id JOIN nh v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL)
SELECT p.c::BIGINT AS component, round(CASE p.c WHEN 0 THEN {STRENGTH[0]}::DOUBLE ELSE {STRENGTH[1]}::DOUBLE END + 0.01 * (p.g - n.g) / (SELECT sum(w) FROM ed WHERE c = p.c), 6) + 0.0 AS theta
FROM gp p JOIN gn n ON p.c = n.c""")
def cmp_rbm_step(spark, sf):
    model = sparse_model(spark, sf)
    uhat, hidden = boltzmann.sparse_mean_field(node_scores(spark, sf), model, STEPS)
    neg, neg_hidden = boltzmann.sparse_negative_phase(boltzmann.start_chains(model, CHAINS, 2), model, 1, 4)
    new = boltzmann.sparse_step(model, uhat, hidden, neg, neg_hidden, fit_bias=False)
    return spark.createDataFrame([(c, round(t, 6)) for c, t in enumerate(new.theta)], "component long, theta double")


def _sql_gradients(scale: str) -> str:
    return f"""
gp AS (SELECT e.c, sum({scale} * u.u * v.v) / (SELECT count(DISTINCT subj_id) FROM vox) AS g FROM u{STEPS} u JOIN ed e ON u.vox_id = e.vox_id JOIN h{STEPS - 1} v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL),
gn AS (SELECT e.c, sum({scale} * u.u * v.p) / {CHAINS} AS g FROM nu u JOIN ed e ON u.vox_id = e.vox_id JOIN nh v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL)
SELECT p.c::BIGINT AS component, round(CASE p.c WHEN 0 THEN {STRENGTH[0]}::DOUBLE ELSE {STRENGTH[1]}::DOUBLE END
       + %s 0.01 * (p.g - n.g) / (SELECT sum(w) FROM ed WHERE c = p.c), 6) + 0.0 AS theta
FROM gp p JOIN gn n ON p.c = n.c"""


def _theta_after_step(spark, sf, **settings):
    model = replace(sparse_model(spark, sf), **settings)
    uhat, hidden = boltzmann.sparse_mean_field(node_scores(spark, sf), model, STEPS)
    neg, neg_hidden = boltzmann.sparse_negative_phase(boltzmann.start_chains(model, CHAINS, 2), model, 1, 4)
    new = boltzmann.sparse_step(model, uhat, hidden, neg, neg_hidden, fit_bias=False)
    return spark.createDataFrame([(c, round(t, 6)) for c, t in enumerate(new.theta)], "component long, theta double")


@query("cmp_rbm_step_momentum", f"WITH {_SPARSE}, {_sql_sparse(STEPS)}, {_SPARSE_NEG}," + _sql_gradients("e.w").replace(
    "%s", "0.9 * CASE p.c WHEN 0 THEN 0.01 ELSE -0.02 END +"))
def cmp_rbm_step_momentum(spark, sf):
    """A step with momentum after one whose velocities were 0.01 and -0.02."""
    return _theta_after_step(spark, sf, momentum=0.9, velocity=(0.01, -0.02))


@query("dbm_step", f"WITH {_SPARSE}, {_sql_sparse(STEPS)}, {_SPARSE_NEG}," + _sql_gradients("1.0").replace("%s", ""))
def dbm_step(spark, sf):
    """The sparse machine's rule: the plain sum of products over the summed weights."""
    return _theta_after_step(spark, sf, weighted_gradient=False)


_NORMAL = "sqrt(-2 * ln(1 - {a})) * cos(2 * pi() * {b})".format(
    a=_U.format("'6.a|' || s.s || '|' || n.vox_id || '|' || k.k"), b=_U.format("'6.b|' || s.s || '|' || n.vox_id || '|' || k.k")
)


def _sql_dbm(steps: int) -> str:
    out = [f"""
z AS MATERIALIZED (SELECT s.s AS subj_id, n.vox_id, k.k, {_NORMAL} AS b FROM nodes n CROSS JOIN range(2) s(s) CROSS JOIN range({PARCELS}) k(k))""", _sql_softmax("u0", "z")]
    for i in range(steps):
        out.append(f"""
a{i} AS MATERIALIZED (SELECT u.subj_id, l.h, u.k, sum(l.w * u.u) AS b FROM u{i} u JOIN li l ON u.vox_id = l.vox_id GROUP BY ALL),
{_sql_softmax(f"h{i}", f"a{i}", "subj_id, h", "v")},
f{i} AS MATERIALIZED (SELECT v.subj_id, l.vox_id, v.k, max(p.lp) + sum(l.w * v.v) AS b FROM h{i} v JOIN li l ON v.h = l.h JOIN pri p ON p.vox_id = l.vox_id AND p.k = v.k GROUP BY ALL)""")
        out.append(_sql_softmax(f"u{i + 1}", f"f{i}"))
    return ",".join(out)


@query("dbm_mean_field_sample", f"""
WITH {_SPARSE}, {_sql_dbm(2)}
SELECT subj_id, vox_id AS node_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM u2""")
def dbm_mean_field_sample(spark, sf):
    out = boltzmann.mean_field_sample(sparse_model(spark, sf), 2, 2, 6)
    return views.explode_parcels(out, "uhat", "subj_id", "node_id")


@query("chain_marginal", f"""
WITH {_SPARSE}, {_SPARSE_NEG}
SELECT s.vox_id AS node_id, t.k, avg((s.u = t.k)::INT) AS p FROM s0 s CROSS JOIN range({PARCELS}) t(k) GROUP BY ALL""")
def chain_marginal(spark, sf):
    states = boltzmann.start_chains(sparse_model(spark, sf), CHAINS, 2)
    return views.explode_parcels(boltzmann.chain_marginal(states, PARCELS), "pi", "node_id")


def _renamed(sql: str) -> str:
    """The mean field over the connections and biases after a step."""
    return re.sub(r"\b([uahgf]\d(_m)?)\b", r"z\1", sql).replace(" li ", " li2 ").replace("base", "base2")


# One round without drawn data: all subjects in a batch, chains from the biases, theta and biases moved by 0.1.
_SML_NEG = _SPARSE_NEG.replace(f"range({CHAINS})", f"range({views.SUBJECTS})").replace("'2|'", "'8.chains|'").replace(
    "'4.h0|'", "'8.0.0.h0|'")
_SML = f"""{_SPARSE.replace("0.1 * s.ll", "s.ll")}, {_sql_sparse(2)}, {_SML_NEG},
gp AS (SELECT e.c, sum(e.w * u.u * v.v) / {views.SUBJECTS} AS g FROM u2 u JOIN ed e ON u.vox_id = e.vox_id JOIN h1 v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL),
gn AS (SELECT e.c, sum(e.w * u.u * v.p) / {views.SUBJECTS} AS g FROM nu u JOIN ed e ON u.vox_id = e.vox_id JOIN nh v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL),
th AS MATERIALIZED (SELECT p.c, CASE p.c WHEN 0 THEN {STRENGTH[0]}::DOUBLE ELSE {STRENGTH[1]}::DOUBLE END
       + 0.1 * (p.g - n.g) / (SELECT sum(w) FROM ed WHERE c = p.c) AS t FROM gp p JOIN gn n ON p.c = n.c)"""


def _sml_round(spark, sf):
    return stochastic.fit_sml(
        sparse_model(spark, sf), label_vmf(spark, sf).emissions, vox_aligned(spark, sf), 1, batch_size=views.SUBJECTS,
        rate=0.1, mean_field_iterations=2, chain_steps=1, with_evidence=False, seed=8,
    )


@query("fit_sml_theta", f"""
WITH {_SML} SELECT c::BIGINT AS component, round(t, 5) + 0.0 AS theta FROM th""")
def fit_sml_theta(spark, sf):
    fit = _sml_round(spark, sf)
    return spark.createDataFrame([(c, round(t, 5) + 0.0) for c, t in enumerate(fit.prior.theta)], "component long, theta double")


@query("fit_sml_posterior", f"""
WITH {_SML},
mu AS (SELECT vox_id, k, avg(u) AS m FROM u2 GROUP BY ALL), mn AS (SELECT vox_id, k, avg(u) AS m FROM nu GROUP BY ALL),
bu AS (SELECT p.vox_id, p.k, p.lp + 0.1 * (mu.m - mn.m) AS lp FROM pri p JOIN mu ON mu.vox_id = p.vox_id AND mu.k = p.k
       JOIN mn ON mn.vox_id = p.vox_id AND mn.k = p.k),
li2 AS MATERIALIZED (SELECT h, vox_id, sum(w * th.t) AS w FROM ed JOIN th ON ed.c = th.c GROUP BY ALL),
base2 AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.k, s.ll + b.lp AS b FROM sc s JOIN bu b ON s.vox_id = b.vox_id AND s.k = b.k),
{_renamed(_sql_sparse(2))}
SELECT subj_id, vox_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM zu2""")
def fit_sml_posterior(spark, sf):
    """One round of stochastic maximum likelihood: all of its draws are hashed, so SQL can follow it."""
    return views.explode_parcels(_sml_round(spark, sf).posterior, "uhat", "subj_id", "vox_id")


# ---------------------------------------------------------------- draws of data


def _sql_uniforms(name: str, source: str, seed: str, n: int) -> str:
    """The uniforms of each (subject, location) of ``source``, long."""
    text = f"'{seed}|' || r.subj_id || '|' || r.vox_id || '|' || (j.j // 4)"
    return f"""
{name} AS MATERIALIZED (SELECT r.subj_id, r.vox_id, j.j,
  ('0x' || substr(md5({text}), 1 + 8 * (j.j % 4), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {source} r CROSS JOIN range({n}) j(j))"""


def _sql_normals(name: str, uniforms: str, n: int) -> str:
    return f"""
{name} AS (SELECT a.subj_id, a.vox_id, m.m, sqrt(-2 * ln(1 - a.u)) * CASE WHEN m.m % 2 = 0 THEN cos(2 * pi() * b.u) ELSE sin(2 * pi() * b.u) END AS z
  FROM range({n}) m(m) JOIN {uniforms} a ON a.j = 1 + 2 * (m.m // 2) JOIN {uniforms} b ON b.j = a.j + 1 AND b.subj_id = a.subj_id AND b.vox_id = a.vox_id)"""


_FREE = views.WIDTH - 2
#: Cells of the angle to the mean direction under the shared concentration.
_ANGLES = f"""
mode AS (SELECT kappa, 2 * kappa / ({_FREE} + sqrt({_FREE * _FREE} + 4 * kappa * kappa)) AS c FROM kap),
edge AS (SELECT kappa, greatest(0, acos(c) - reach) AS low, (least(pi(), acos(c) + reach) - greatest(0, acos(c) - reach)) / {sampling.ANGLES} AS width
  FROM (SELECT *, {sampling.REACH} / sqrt(kappa * c + {_FREE} / (1 - c * c)) AS reach FROM mode)),
cellw AS (SELECT i.i, low, width, kappa * cos(low + (i.i + 0.5) * width) + {_FREE} * ln(sin(low + (i.i + 0.5) * width)) AS g
  FROM edge CROSS JOIN range({sampling.ANGLES}) i(i)),
cellp AS (SELECT *, exp(g - max(g) OVER ()) AS p FROM cellw),
cell AS MATERIALIZED (SELECT i, low, width, p, sum(p) OVER (ORDER BY i) AS upto, sum(p) OVER () AS total FROM cellp)"""


def _sql_directions(name: str, source: str, seed: str) -> str:
    """Directions around those of each label: ``subj_id, vox_id, m, y``; ``source`` has ``subj_id, vox_id, label``."""
    n = sampling.uniforms_of_direction(views.WIDTH)
    return f"""{_sql_uniforms(f"{name}u", source, seed, n)},
{_sql_normals(f"{name}z", f"{name}u", views.WIDTH)},
{name}a AS (SELECT r.subj_id, r.vox_id, r.label, c.low + (c.i + (u.u * c.total - (c.upto - c.p)) / c.p) * c.width AS angle
  FROM {source} r JOIN {name}u u ON u.subj_id = r.subj_id AND u.vox_id = r.vox_id AND u.j = 0
  JOIN cell c ON c.upto > u.u * c.total AND c.upto - c.p <= u.u * c.total QUALIFY row_number() OVER (PARTITION BY r.subj_id, r.vox_id ORDER BY c.i) = 1),
{name}t AS (SELECT a.subj_id, a.vox_id, z.m, a.angle, d.v, z.z, sum(z.z * d.v) OVER w AS along
  FROM {name}a a JOIN {name}z z ON z.subj_id = a.subj_id AND z.vox_id = a.vox_id JOIN dir d ON d.k = a.label AND d.m = z.m
  WINDOW w AS (PARTITION BY a.subj_id, a.vox_id)),
{name} AS MATERIALIZED (SELECT subj_id, vox_id, m, cos(angle) * v + sin(angle) * (z - along * v)
  / sqrt(sum((z - along * v) * (z - along * v)) OVER (PARTITION BY subj_id, vox_id)) AS y FROM {name}t)"""


def _sql_negative(n: str, chains: str, li: str, bias: str, seed: str) -> str:
    """One Gibbs step of ``chains`` (``subj_id, vox_id, u``) that see data drawn for their labels: nh (p), nu (u)."""
    logc = sql_log_constant(views.WIDTH, "q.kappa")
    return f"""
na{n} AS (SELECT s.subj_id, l.h, t.k, sum(CASE WHEN s.u = t.k THEN l.w ELSE 0 END) AS b FROM {chains} s JOIN {li} l ON s.vox_id = l.vox_id CROSS JOIN range({PARCELS}) t(k) GROUP BY ALL),
{_sql_softmax(f"nh{n}", f"na{n}", "subj_id, h", "p")},
nc{n} AS (SELECT subj_id, h, k, sum(p) OVER (PARTITION BY subj_id, h ORDER BY k) AS c FROM nh{n}),
nd{n} AS MATERIALIZED (SELECT subj_id, h, coalesce(min(CASE WHEN {_U.format(f"'{seed}.h0|' || subj_id || '|' || h")} < c THEN k END), 0) AS v FROM nc{n} GROUP BY ALL),
nr{n} AS (SELECT subj_id, vox_id, u AS label FROM {chains}),
{_sql_directions(f"ny{n}", f"nr{n}", f"{seed}.y0")},
nl{n} AS (SELECT y.subj_id, y.vox_id, d.k, max({logc}) + max(q.kappa) * sum(y.y * d.v) AS ll FROM ny{n} y JOIN dir d ON d.m = y.m CROSS JOIN kap q GROUP BY ALL),
nf{n} AS (SELECT s.subj_id, p.vox_id, p.k, p.lp + coalesce(sum(CASE WHEN d.v = p.k THEN l.w ELSE 0 END), 0) + max(e.ll) AS b FROM {chains} s JOIN {bias} p ON s.vox_id = p.vox_id
       JOIN nl{n} e ON e.subj_id = s.subj_id AND e.vox_id = p.vox_id AND e.k = p.k
       LEFT JOIN {li} l ON l.vox_id = p.vox_id LEFT JOIN nd{n} d ON d.subj_id = s.subj_id AND d.h = l.h GROUP BY s.subj_id, p.vox_id, p.k, p.lp),
{_sql_softmax(f"nu{n}", f"nf{n}")}"""


_CHAINS = _SPARSE_NEG[:_SPARSE_NEG.index("na AS")].rstrip().rstrip(",")


@query("cmp_rbm_eneg_evidence", f"""
WITH {_SPARSE}, {_CHAINS}, {_ANGLES}, {_sql_negative("0", "s0", "li", "pri", "4")}
SELECT subj_id, vox_id AS node_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM nu0""")
def cmp_rbm_eneg_evidence(spark, sf):
    """One Gibbs step of four chains that see data drawn from the emission model for their labels."""
    model = sparse_model(spark, sf)
    evidence = stochastic.emission_evidence(label_vmf(spark, sf).emissions[0])
    states, _ = boltzmann.sparse_negative_phase(boltzmann.start_chains(model, CHAINS, 2), model, 1, 4, evidence)
    return views.explode_parcels(states, "pu", "subj_id", "node_id")


def _sql_mean_field(prefix: str, li: str, base: str) -> str:
    """Two mean-field steps over other connections and another base, with names of their own."""
    named = re.sub(r"\b([uahgf]\d(_m)?)\b", rf"{prefix}\1", _sql_sparse(2))
    return named.replace(" li ", f" {li} ").replace("base ", f"{base} ")


def _sql_batch(b: int, li: str, bias: str, theta: str) -> str:
    """A step of theta and biases on the subjects of one batch: th{b}, bu{b}, li{b}."""
    sub = f"sub{b}"
    return f"""
{sub} AS MATERIALIZED (SELECT DISTINCT subj_id FROM vox WHERE floor({_U.format("'8.0|' || subj_id")} * 2) = {b}),
base{b} AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.k, s.ll + p.lp AS b FROM sc s JOIN {sub} USING (subj_id) JOIN {bias} p ON s.vox_id = p.vox_id AND s.k = p.k),
{_sql_mean_field(f"p{b}", li, f"base{b}")},
cs{b} AS MATERIALIZED (SELECT s.* FROM s0 s JOIN {sub} USING (subj_id)),
{_sql_negative(str(b), f"cs{b}", li, bias, f"8.0.{b}")},
gp{b} AS (SELECT e.c, sum(e.w * u.u * v.v) / (SELECT count(*) FROM {sub}) AS g FROM p{b}u2 u JOIN ed e ON u.vox_id = e.vox_id JOIN p{b}h1 v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL),
gn{b} AS (SELECT e.c, sum(e.w * u.u * v.p) / (SELECT count(*) FROM {sub}) AS g FROM nu{b} u JOIN ed e ON u.vox_id = e.vox_id JOIN nh{b} v ON v.subj_id = u.subj_id AND v.h = e.h AND v.k = u.k GROUP BY ALL),
th{b} AS MATERIALIZED (SELECT t.c, t.t + 0.1 * (p.g - n.g) / (SELECT sum(w) FROM ed WHERE c = t.c) AS t FROM {theta} t JOIN gp{b} p ON p.c = t.c JOIN gn{b} n ON n.c = t.c),
mu{b} AS (SELECT vox_id, k, avg(u) AS m FROM p{b}u2 GROUP BY ALL), mn{b} AS (SELECT vox_id, k, avg(u) AS m FROM nu{b} GROUP BY ALL),
bu{b} AS MATERIALIZED (SELECT p.vox_id, p.k, p.lp + 0.1 * (mu{b}.m - mn{b}.m) AS lp FROM {bias} p JOIN mu{b} ON mu{b}.vox_id = p.vox_id AND mu{b}.k = p.k
       JOIN mn{b} ON mn{b}.vox_id = p.vox_id AND mn{b}.k = p.k),
li{b} AS MATERIALIZED (SELECT h, vox_id, sum(w * t.t) AS w FROM ed JOIN th{b} t ON ed.c = t.c GROUP BY ALL)"""


def _kept(sql: str) -> str:
    """Every named query computed once."""
    return re.sub(r"(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", sql)


@query("fit_sml_with_evidence", _kept(f"""
WITH {_SPARSE}, {_CHAINS.replace(f"range({CHAINS})", f"range({views.SUBJECTS})").replace("'2|'", "'8.chains|'")}, {_ANGLES},
th_ AS (SELECT * FROM (VALUES (0, {STRENGTH[0]}::DOUBLE), (1, {STRENGTH[1]}::DOUBLE)) t(c, t)),
{_sql_batch(0, "li", "pri", "th_")}, {_sql_batch(1, "li0", "bu0", "th0")},
baseE AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.k, s.ll + b.lp AS b FROM sc s JOIN bu1 b ON s.vox_id = b.vox_id AND s.k = b.k),
{_sql_mean_field("z", "li1", "baseE")}
SELECT subj_id, vox_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM zu2"""))
def fit_sml_with_evidence(spark, sf):
    """One round with two batches of subjects whose chains see data drawn from the emission model."""
    fit = stochastic.fit_sml(
        sparse_model(spark, sf), label_vmf(spark, sf).emissions, vox_aligned(spark, sf), 1, batch_size=3, rate=0.1,
        mean_field_iterations=2, chain_steps=1, seed=8,
    )
    return views.explode_parcels(fit.posterior, "uhat", "subj_id", "vox_id")


# ---------------------------------------------------------------- samples of data


def _labels(spark, sf):
    return views.vox(spark, sf).select("subj_id", "vox_id", "label")


def _sampled(df, digits=6):
    return views.explode_parcels(df, "y", "subj_id", "vox_id", alias="y", digits=digits)


@query("vmf_sample", f"""
WITH {VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {_ANGLES}, {_sql_directions("ys", "vox", "1")}
SELECT subj_id, vox_id, m::BIGINT AS k, round(y, 6) + 0.0 AS y FROM ys""")
def vmf_sample(spark, sf):
    return _sampled(sampling.draw(_labels(spark, sf), label_vmf(spark, sf).emissions[0], 1))


@query("gmm_sample", f"""
WITH {VOX}, {LABEL_SUMS}, {GMM_PARAMS}, {_sql_uniforms("un", "vox", "1", views.WIDTH + 1)}, {_sql_normals("nz", "un", views.WIDTH)}
SELECT x.subj_id, x.vox_id, z.m::BIGINT AS k, round(g.v + sqrt(s.sigma2) * z.z, 6) + 0.0 AS y
FROM vox x JOIN nz z ON z.subj_id = x.subj_id AND z.vox_id = x.vox_id JOIN gv g ON g.k = x.label AND g.m = z.m CROSS JOIN gs s""")
def gmm_sample(spark, sf):
    return _sampled(sampling.draw(_labels(spark, sf), label_gmm(spark, sf).emissions[0], 1))


@query("gauss_exp_sample", f"""
WITH {VOX}, {LABEL_SUMS}, {_sql_uniforms("un", "vox", "1", views.WIDTH + 1)}, {_sql_normals("nz", "un", views.WIDTH)},
sg AS (SELECT subj_id, vox_id, -ln(1 - u) / {GME_BETA} AS s FROM un WHERE j = 0),
yy AS (SELECT x.subj_id, x.vox_id, g.s, g.s * d.v + sqrt({GME_SIGMA2}::DOUBLE) * z.z AS y
  FROM vox x JOIN sg g ON g.subj_id = x.subj_id AND g.vox_id = x.vox_id JOIN nz z ON z.subj_id = x.subj_id AND z.vox_id = x.vox_id
  JOIN dir d ON d.k = x.label AND d.m = z.m)
SELECT subj_id, vox_id, round(max(s), 6) + 0.0 AS signal, round(sqrt(sum(y * y)), 6) + 0.0 AS length FROM yy GROUP BY ALL""")
def gauss_exp_sample(spark, sf):
    out = sampling.draw(_labels(spark, sf), label_gme(spark, sf), 1, signal=True)
    return out.select("subj_id", "vox_id", r6(F.col("signal")).alias("signal"), r6(A.norm(F.col("y"))).alias("length"))


# ---------------------------------------------------------------- completion under a coupled prior

TURNS = 3
_COMPLETED = f"""{_SPARSE.split("base AS MATERIALIZED")[0].rstrip().rstrip(",")},
one AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.k, 0.1 * s.ll AS ll, p.lp FROM sc s JOIN pri p ON s.vox_id = p.vox_id AND s.k = p.k),
base AS MATERIALIZED (SELECT o.subj_id * 100 + t.t AS subj_id, o.vox_id, o.k, o.lp + CASE WHEN o.vox_id % {TURNS} = t.t THEN 0 ELSE o.ll END AS b
  FROM one o CROSS JOIN range({TURNS}) t(t)),
{_sql_sparse(2)},
done AS MATERIALIZED (SELECT subj_id // 100 AS subj_id, vox_id, k, u FROM u2 WHERE vox_id % {TURNS} = subj_id % 100)"""


def _completed(spark, sf):
    scores = node_scores(spark, sf)
    out = boltzmann.sparse_completion(scores, sparse_model(spark, sf), F.col("node_id") % TURNS, 2)
    return scores, out


@query("completion_coupled_posterior", f"""
WITH {_COMPLETED} SELECT subj_id, vox_id AS node_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM done""")
def completion_coupled_posterior(spark, sf):
    """Every location from the other two partitions, through the hidden units."""
    return views.explode_parcels(_completed(spark, sf)[1], "uhat", "subj_id", "node_id")


@query("completion_coupled", _kept(f"""
WITH {_COMPLETED},
ly AS (SELECT avg(ln(e)) AS v FROM (SELECT sum(exp(o.ll) * d.u) AS e FROM one o JOIN done d USING (subj_id, vox_id, k) GROUP BY o.subj_id, o.vox_id)),
ua AS (SELECT avg(abs((x.label = d.k)::INT - d.u)) AS v FROM done d JOIN vox x USING (subj_id, vox_id)),
dot AS (SELECT x.subj_id, x.vox_id, d.k, sum(x.v * d.v) / sqrt(sum(x.v * x.v)) AS c FROM voxl x JOIN dir d ON d.m = x.m GROUP BY ALL),
hard AS (SELECT subj_id, vox_id, k FROM done QUALIFY row_number() OVER (PARTITION BY subj_id, vox_id ORDER BY u DESC, k) = 1),
ch AS (SELECT subj_id, avg(1 - c) AS e FROM dot JOIN hard USING (subj_id, vox_id, k) GROUP BY ALL),
ce AS (SELECT subj_id, avg(e) AS e FROM (SELECT d.subj_id, d.vox_id, 1 - sum(d.u * t.c) AS e FROM done d JOIN dot t USING (subj_id, vox_id, k) GROUP BY ALL) GROUP BY ALL)
SELECT 'logpY' AS criterion, round(v, 6) + 0.0 AS value FROM ly UNION ALL SELECT 'u_abserr', round(v, 6) FROM ua
UNION ALL SELECT 'cos_err', round(avg(e), 6) FROM ch UNION ALL SELECT 'Ecos_err', round(avg(e), 6) FROM ce"""))
def completion_coupled(spark, sf):
    """All four criteria of the completed locations."""
    scores, uhat = _completed(spark, sf)
    data = views.vox(spark, sf).select(
        "subj_id", F.col("vox_id").alias("node_id"), "y", A.one_hot(F.col("label"), PARCELS).alias("u"))
    rows = uhat.join(scores, ["subj_id", "node_id"]).join(data, ["subj_id", "node_id"])
    rows = cut_lineage(rows)
    v = label_vmf(spark, sf).emissions[0].v
    found = [(c, float(round(crossval.evaluate(rows, c, v), 6)) + 0.0) for c in crossval.CRITERIA]
    return spark.createDataFrame(found, "criterion string, value double")

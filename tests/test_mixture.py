"""Inference and learning against plain numpy on small arrays."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.functions.batches import log_softmax_rows, softmax_rows
from tessera.operators import emissions as em
from tessera.operators import mixture, priors, sampling

S, P, K, M = 3, 12, 3, 5


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((M, K))
    v /= np.linalg.norm(v, axis=0)
    u = rng.integers(0, K, (S, P))
    y = np.stack([[sampling.vmf_vectors(rng, v[:, u[s, p]], 8.0, 1)[0] for p in range(P)] for s in range(S)])
    return v, u, y  # y is S x P x M


def evidence(spark, y, dataset=None):
    rows = [(s, p, 1.0, [float(x) for x in y[s, p]]) for s in range(y.shape[0]) for p in range(y.shape[1])]
    return spark.createDataFrame(rows, "subj_id long, vox_id long, num_part double, y array<double>")


def as_array(df, s, p, k):
    out = np.full((s, p, k), np.nan)
    for r in df.collect():
        out[r["subj_id"], r["vox_id"]] = r["uhat"]
    return out


def numpy_em(y, v, kappa, logpi, steps, fit_prior=True):
    """Straight EM; returns trace and last posterior."""
    trace = []
    for t in range(steps):
        c = special.vmf_log_constant_np(M, kappa)
        ll = c + kappa * (y @ v)
        u = softmax_rows((ll + logpi).reshape(-1, K)).reshape(ll.shape)
        trace.append(((u * log_softmax_rows(np.broadcast_to(logpi, ll.shape))).sum(), (u * ll).sum()))
        if t == steps - 1:
            return np.array(trace), u
        if fit_prior:
            logpi = np.log(u.mean(axis=0))
        yu = np.einsum("spm,spk->mk", y, u)
        ju = u.sum(axis=(0, 1))
        v = yu / np.linalg.norm(yu, axis=0)
        kappa = special.concentration_np((yu / ju * v).sum(axis=0).mean(), M)


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_spatial_em_matches_numpy(spark, data, partitions):
    v, _, y = data
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        nodes = spark.range(P).select(F.col("id").alias("node_id"))
        rng = np.random.default_rng(0)
        start = rng.standard_normal((P, K))
        table = spark.createDataFrame([(p, start[p].tolist()) for p in range(P)], "node_id long, logpi array<double>")
        model = mixture.Model(priors.IndependentPrior(K, table=table), (em.VonMisesFisher(v, 5.0),))
        fit = mixture.fit_em(model, mixture.align([evidence(spark, y)]), 4, 1e-9, first_evidence=True)
        trace, u = numpy_em(y, v, 5.0, start, 4)
        assert np.array(fit.trace) == pytest.approx(trace)
        assert as_array(fit.posterior(), S, P, K) == pytest.approx(u, abs=1e-9)
        assert nodes.count() == P
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_node_is_salted(spark, data, monkeypatch):
    v, _, y = data
    monkeypatch.setattr(mixture, "ROWS_PER_SALT", 2)
    table = spark.createDataFrame([(p, [0.0] * K) for p in range(P)], "node_id long, logpi array<double>")
    model = mixture.Model(priors.IndependentPrior(K, table=table), (em.VonMisesFisher(v, 5.0),))
    rows, salts = mixture.colocate(mixture.align([evidence(spark, y)]).df)
    assert salts.agg(F.max("n_salt").alias("n")).first()["n"] == 2 and rows.count() == S * P
    fit = mixture.fit_em(model, mixture.align([evidence(spark, y)]), 3, 1e-9, first_evidence=True)
    trace, _ = numpy_em(y, v, 5.0, np.zeros((P, K)), 3)
    assert np.array(fit.trace) == pytest.approx(trace)


def test_likelihood_grows_and_posteriors_sum_to_one(spark, data):
    v, _, y = data
    prior = priors.IndependentPrior(K, flat=priors.uniform_flat(K), spatial=False)
    model = mixture.Model(prior, (em.IsotropicGaussian(v, 0.5),))
    fit = mixture.fit_em(model, mixture.align([evidence(spark, y)]), 6, 1e-6, first_evidence=True)
    assert all(b >= a - 1e-9 for a, b in zip(fit.loglik, fit.loglik[1:]))
    assert as_array(fit.posterior(), S, P, K).sum(axis=2) == pytest.approx(np.ones((S, P)))


def test_gated_first_pass_has_no_likelihood(spark, data):
    v, _, y = data
    prior = priors.IndependentPrior(K, flat=np.log([0.5, 0.3, 0.2]), spatial=False)
    model = mixture.Model(prior, (em.VonMisesFisher(v, 5.0),))
    fit = mixture.fit_em(model, mixture.align([evidence(spark, y)]), 1, first_evidence=False)
    assert fit.trace[0][1] == -np.inf
    assert as_array(fit.posterior(), S, P, K) == pytest.approx(np.broadcast_to([0.5, 0.3, 0.2], (S, P, K)))


def test_rollback_keeps_the_rejected_posterior(spark, data):
    v, _, y = data
    prior = priors.IndependentPrior(K, flat=priors.uniform_flat(K), spatial=False)

    class Spoiler(em.VonMisesFisher):
        def updated(self, totals, rows):
            return replace(self, kappa=0.1)  # makes the likelihood drop

    model = mixture.Model(prior, (Spoiler(v, 8.0),))  # the concentration that the data were drawn with
    fit = mixture.fit_em(model, mixture.align([evidence(spark, y)]), 5, 0.01, fit_prior=False, first_evidence=True)
    assert len(fit.trace) == 2 and fit.model is fit.history[0] and fit.model.emissions[0].kappa == 8.0
    rejected = softmax_rows((0.1 * (y @ v)).reshape(-1, K)).reshape(S, P, K)
    assert as_array(fit.posterior(), S, P, K) == pytest.approx(rejected)


def test_frozen_parameters_stay(spark, data):
    v, _, y = data
    prior = priors.IndependentPrior(K, flat=priors.uniform_flat(K), spatial=False)
    model = mixture.Model(prior, (em.VonMisesFisher(v, 5.0, fit_v=False),))
    fit = mixture.fit_em(model, mixture.align([evidence(spark, y)]), 3, 1e-9, fit_prior=False, first_evidence=True)
    assert (fit.model.emissions[0].v == v).all() and fit.model.emissions[0].kappa != 5.0
    assert (fit.model.prior.start == priors.uniform_flat(K)).all()


def test_subject_kappa_in_em(spark, data):
    v, u, y = data
    hot = np.eye(K)[u]
    rows = [(s, p, 1.0, y[s, p].tolist(), hot[s, p].tolist()) for s in range(S) for p in range(P)]
    df = spark.createDataFrame(rows, "subj_id long, node_id long, n0_0 double, y0_0 array<double>, uhat array<double>")
    model = mixture.Model(priors.IndependentPrior(K), (em.VonMisesFisher(v, per_subject=True, per_parcel=True),))
    new = mixture.m_step(mixture.Aligned(df, (mixture.Slot(0),)), model)
    got = {r["subj_id"]: r["kappa"] for r in new.kappa_table(0).collect()}
    nv = new.emissions[0].v
    for s in range(S):
        r = [(y[s][u[s] == k] @ nv[:, k]).mean() for k in range(K)]
        assert got[s] == pytest.approx(special.concentration_np(np.array(r), M))
    fit = mixture.fit_em(new, mixture.align([evidence(spark, y)]), 3, 1e-9, fit_prior=False, first_evidence=True)
    assert len(fit.trace) >= 2 and fit.model.kappa_table(0).count() == S


def test_fusion_adds_evidence_and_ignores_absent_subjects(spark, data):
    v, _, y = data
    a, b = evidence(spark, y), evidence(spark, y[:2])
    prior = priors.IndependentPrior(K)
    e = em.VonMisesFisher(v, 4.0)
    got = as_array(mixture.posterior(mixture.align([a, b]), mixture.Model(prior, (e, e), (1.0, 0.5))), S, P, K)
    weight = np.array([1.5, 1.5, 1.0])[:, None, None]
    assert got == pytest.approx(softmax_rows((weight * 4.0 * (y @ v)).reshape(-1, K)).reshape(S, P, K))


def numpy_symmetric_em(y, v, kappa, pairs, steps):
    """Symmetric EM with two directions per parcel; pairs of (left, right) locations."""
    half = K
    logpi = np.full((len(pairs), half), -np.log(half))
    trace = []
    for t in range(steps):
        ll = special.vmf_log_constant_np(M, kappa) + kappa * (y @ v)
        node = np.stack([ll[:, l, :half] + ll[:, r, half:] for l, r in pairs], axis=1)
        u = softmax_rows((node + logpi).reshape(-1, half)).reshape(node.shape)
        full = np.zeros((S, P, 2 * half))
        for i, (l, r) in enumerate(pairs):
            full[:, l, :half] += u[:, i]
            full[:, r, half:] += u[:, i]
        full /= full.sum(axis=2, keepdims=True)
        trace.append(((u * logpi).sum(), (full * ll).sum()))
        if t == steps - 1:
            return np.array(trace), full
        logpi = np.log(u.mean(axis=0))
        yu = np.einsum("spm,spk->mk", y, full)
        v = yu / np.linalg.norm(yu, axis=0)
        kappa = special.concentration_np((yu / full.sum(axis=(0, 1)) * v).sum(axis=0).mean(), M)


def test_symmetric_em_matches_numpy(spark, data):
    v, _, y = data
    rng = np.random.default_rng(2)
    v2 = np.concatenate([v, rng.standard_normal((M, K))], axis=1)
    v2 /= np.linalg.norm(v2, axis=0)
    pairs = [(i, i + 5) for i in range(5)] + [(10, 10), (11, 11)]
    table = spark.createDataFrame([(i, l, r) for i, (l, r) in enumerate(pairs)], "node_id long, left_vox long, right_vox long")
    layout = priors.Layout.symmetric(table)
    nodes = table.select("node_id").withColumn("logpi", F.array(*[F.lit(-float(np.log(K)))] * K))
    prior = priors.IndependentPrior(K, table=nodes, layout=layout)
    model = mixture.Model(prior, (em.VonMisesFisher(v2, 6.0),))
    fit = mixture.fit_em(model, mixture.align([evidence(spark, y)], prior), 3, 1e-9, first_evidence=True)
    trace, full = numpy_symmetric_em(y, v2, 6.0, pairs, 3)
    assert np.array(fit.trace) == pytest.approx(trace)
    assert as_array(fit.posterior(), S, P, 2 * K) == pytest.approx(full, abs=1e-9)


def test_parameters_round_trip(data):
    v, _, _ = data
    prior = priors.IndependentPrior(K, flat=np.array([0.1, 0.2, 0.3]), spatial=False)
    model = mixture.Model(prior, (em.VonMisesFisher(v, np.array([1.0, 2.0, 3.0]), per_parcel=True), em.IsotropicGaussian(v, 0.7)))
    theta, where = mixture.parameter_vector(model)
    assert list(where) == ["arrange.logpi", "emissions.0.V", "emissions.0.kappa", "emissions.1.V", "emissions.1.sigma2"]
    moved = mixture.with_parameters(model, theta + 1)
    assert moved.emissions[1].sigma2 == pytest.approx(1.7) and moved.emissions[0].kappa.tolist() == [2.0, 3.0, 4.0]
    assert moved.prior.flat == pytest.approx([1.1, 1.2, 1.3])


def test_recovers_directions_and_concentration(spark):
    """Simulated data with known parameters, fixed flat prior."""
    rng = np.random.default_rng(7)
    k, m, p, s, j = 4, 6, 150, 4, 3
    v = np.linalg.qr(rng.standard_normal((m, k)))[0]
    u = rng.integers(0, k, (s, p))
    rows = spark.createDataFrame([(a, b, int(u[a, b])) for a in range(s) for b in range(p)], "subj_id long, vox_id long, label int")
    parts = np.repeat(np.arange(j), m)
    from tessera.operators import evidence as ev

    y = sampling.draw(rows, em.VonMisesFisher(v, 12.0), 5, x=np.tile(np.eye(m), (j, 1)), parts=parts)
    e = ev.project(y, np.tile(np.eye(m), (j, 1)), parts)
    start = em.VonMisesFisher(v + 0.3 * rng.standard_normal(v.shape), 3.0)
    prior = priors.IndependentPrior(k, flat=priors.uniform_flat(k), spatial=False)
    fit = mixture.fit_em(mixture.Model(prior, (start,)), mixture.align([e]), 15, 0.01, fit_prior=False, first_evidence=True)
    got = fit.model.emissions[0]
    assert np.diag(got.v.T @ v).min() > 0.98
    assert got.kappa == pytest.approx(12.0, rel=0.15)


def test_repeated_rows_are_refused(spark, data):
    _, _, y = data
    e = evidence(spark, y)
    model = mixture.Model(priors.IndependentPrior(K, flat=priors.uniform_flat(K), spatial=False), (em.VonMisesFisher(np.eye(M)[:, :K], 5.0),))
    twice = mixture.align([e.unionByName(e.limit(1))])
    assert mixture.posterior(twice, model).count() == S * P + 1  # each row is scored by itself
    with pytest.raises(ValueError, match="2 rows"):
        mixture.fit_em(model, twice, 2)
    with pytest.raises(Exception, match="2 rows"):
        mixture.align([e, e.unionByName(e.limit(1))]).df.collect()


def test_aligning_runs_nothing(spark, data, monkeypatch):
    _, _, y = data
    e = evidence(spark, y)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("aligning", "align")
    mixture.align([e])
    mixture.align([e, e])
    assert len(tracker.getJobIdsForGroup("aligning")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_missing_keys_are_refused(spark, data):
    v, _, y = data
    table = spark.createDataFrame([(p, [0.0] * K) for p in range(P - 1)], "node_id long, logpi array<double>")
    model = mixture.Model(priors.IndependentPrior(K, table=table), (em.VonMisesFisher(v, 5.0),))
    with pytest.raises(Exception, match="without a prior"):
        mixture.posterior(mixture.align([evidence(spark, y)]), model).collect()
    who = spark.createDataFrame([(0, 0)], "local_subj long, subj_id long")
    with pytest.raises(Exception, match="without an entry"):
        mixture.map_subjects(evidence(spark, y), who).collect()


def test_frozen_prior_is_joined_once(spark, data, monkeypatch):
    """With a given prior the passes after the first move no evidence."""
    v, _, y = data
    table = spark.createDataFrame([(p, [0.1 * p, 0.0, -0.1]) for p in range(P)], "node_id long, logpi array<double>")
    model = mixture.Model(priors.IndependentPrior(K, table=table), (em.VonMisesFisher(v, 5.0),))
    plans, inner = [], mixture._pass

    def spy(aligned, df, *args, **kw):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return inner(aligned, df, *args, **kw)

    monkeypatch.setattr(mixture, "_pass", spy)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fit = mixture.fit_em(model, mixture.align([evidence(spark, y)]), 3, 1e-9, fit_prior=False, first_evidence=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(plans) == 3 and all(p.startswith("InMemoryRelation") for p in plans)
    trace, _ = numpy_em(y, v, 5.0, np.array([[0.1 * p, 0.0, -0.1] for p in range(P)]) - np.log(
        np.exp([[0.1 * p, 0.0, -0.1] for p in range(P)]).sum(axis=1, keepdims=True)), 3, fit_prior=False)
    assert np.array(fit.trace)[:, 1] == pytest.approx(trace[:, 1])


def test_several_starts_with_a_frozen_prior(spark, data):
    v, _, y = data
    table = spark.createDataFrame([(p, [0.1 * p, 0.0, -0.1]) for p in range(P)], "node_id long, logpi array<double>")
    prior = priors.IndependentPrior(K, table=table)
    starts = [mixture.Model(prior, (em.VonMisesFisher(w, 5.0),)) for w in (v, np.roll(v, 1, axis=1))]
    both = mixture._fit(starts, mixture.align([evidence(spark, y)]), 12, 0.5, True, False, True)
    for s, r in zip(starts, both):
        one = mixture.fit_em(s, mixture.align([evidence(spark, y)]), 12, 0.5, fit_prior=False, first_evidence=True)
        assert np.array(one.trace) == pytest.approx(np.array(r.trace))


def test_multistart_with_few_iterations(spark, data):
    v, _, y = data
    prior = priors.IndependentPrior(K, flat=priors.uniform_flat(K), spatial=False)
    starts = [mixture.Model(prior, (em.VonMisesFisher(w, 5.0),)) for w in (v, np.roll(v, 1, axis=0))]
    fit = mixture.fit_em_starts(starts, mixture.align([evidence(spark, y)]), first_iter=3, max_iter=3, tol=1e-9, align_on=None)
    assert len(fit.trace) == 3 and len(fit.first_traces) == 2 and fit.posterior().count() == S * P


def test_marginal_of_a_flat_prior(spark):
    prior = priors.IndependentPrior(3, flat=np.log([0.5, 0.3, 0.2]), spatial=False)
    nodes = spark.createDataFrame([(0,), (4,)], "node_id long")
    assert [r["pi"] for r in prior.marginal(nodes).collect()] == [pytest.approx([0.5, 0.3, 0.2])] * 2
    assert prior.marginal_full(nodes).columns == ["vox_id", "pi"]
    with pytest.raises(ValueError):
        prior.marginal()

"""Layouts, Potts fields, hidden units, samplers, stochastic learning."""

import itertools
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions.batches import softmax_rows
from tessera.operators import boltzmann, mixture, potts, priors, sampling, spatial, stochastic
from tessera.operators import emissions as em


def grid(spark, w, h):
    return spark.createDataFrame([(x * h + y, x, y) for x in range(w) for y in range(h)], "node_id long, x long, y long")


def exact_marginals(q, links, theta):
    n, k = q.shape
    out, z = np.zeros((n, k)), 0.0
    for state in itertools.product(range(k), repeat=n):
        e = np.exp(sum(q[i, s] for i, s in enumerate(state)) + theta * sum(state[i] == state[j] for i, j in links))
        z += e
        for i, s in enumerate(state):
            out[i, s] += e
    return out / z


def test_colours_differ_between_neighbours(spark):
    edges = spatial.grid_edges(grid(spark, 4, 3))
    c = spatial.colour(edges)
    a = c.select(F.col("node_id").alias("src"), F.col("colour").alias("a"))
    b = c.select(F.col("node_id").alias("dst"), F.col("colour").alias("b"))
    assert c.count() == 12 and edges.join(a, "src").join(b, "dst").where("a = b").count() == 0


def test_edges_are_numbered_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "EDGE_BLOCK", 3)
    rows = spatial.incidence(spatial.grid_edges(grid(spark, 3, 3))).groupBy("edge_id").agg(F.array_sort(F.collect_list("node_id")).alias("e"))
    got = [tuple(r["e"]) for r in rows.orderBy("edge_id").collect()]
    assert got == sorted(got) and len(got) == 12


@pytest.mark.parametrize("block,theta", [(2, 0.7), (3, 0.0), (100, 1.5)])
def test_chain_posterior_is_exact(spark, block, theta):
    rng = np.random.default_rng(1)
    q = rng.standard_normal((7, 3)) * 2
    df = spark.createDataFrame([(0, i, q[i].tolist()) for i in range(7)], "subj_id long, node_id long, logq array<double>")
    got = potts.chain_posterior(df, 3, theta, block).orderBy("node_id").collect()
    want = exact_marginals(q, [(i, i + 1) for i in range(6)], theta)
    assert np.array([r["uhat"] for r in got]) == pytest.approx(want)
    assert got[0]["agree"] is None and all(0 <= r["agree"] <= 1 for r in got[1:])


def test_two_nodes_closed_form_equals_enumeration(spark):
    q = np.array([[1.0, -0.5, 0.2], [0.0, 0.3, -1.0]])
    d = spark.range(1).select(potts.duo_posterior(A.literal(q[0]), A.literal(q[1]), 1.0).alias("d")).first()["d"]
    want = exact_marginals(q, [(0, 1)], 1.0)
    assert d["u1"] == pytest.approx(want[0]) and d["u2"] == pytest.approx(want[1])


def potts_model(spark, q, theta):
    n = len(q)
    prior = spark.createDataFrame([(i, q[i].tolist()) for i in range(n)], "node_id long, logpi array<double>")
    nodes = prior.select("node_id")
    colours = nodes.withColumn("colour", (F.col("node_id") % 2).cast("int"))
    return potts.PottsModel(spatial.chain_edges(nodes), q.shape[1], prior, theta, drop_last=False), colours


def test_gibbs_reaches_the_exact_marginals(spark):
    q = np.random.default_rng(2).standard_normal((4, 2))
    model, colours = potts_model(spark, q, 0.8)
    states = potts.gibbs(model, colours, 2, chains=1500, sweeps=4, seed=1)
    got = np.array([r["uhat"] for r in potts.frequencies(states, 2).orderBy("node_id").collect()])
    assert got == pytest.approx(exact_marginals(q, [(0, 1), (1, 2), (2, 3)], 0.8), abs=0.05)
    again = potts.gibbs(model, colours, 2, chains=1500, sweeps=4, seed=1)
    assert states.exceptAll(again).count() == 0


def test_gradient_moves_towards_the_data(spark):
    model, _ = potts_model(spark, np.zeros((2, 2)), 1.0)
    uhat = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [1.0, 0.0])], "subj_id long, node_id long, uhat array<double>")
    neg = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.5, 0.5])], "node_id long, uhat array<double>")
    agreement = spark.createDataFrame([(0, 2.0)], "subj_id long, phi double")
    new = potts.gradient_step(model, uhat, agreement, neg, 1.0, step=0.1)
    assert new.theta == pytest.approx(1.1)
    assert new.prior.orderBy("node_id").first()["logpi"] == pytest.approx([0.05, -0.05])


def test_mean_field_without_coupling_is_the_softmax(spark):
    q = np.random.default_rng(3).standard_normal((4, 3))
    model, colours = potts_model(spark, q, 0.0)
    scores = spark.createDataFrame([(0, i, [0.0, 1.0, 0.0]) for i in range(4)], "subj_id long, node_id long, ll array<double>")
    got = [r["uhat"] for r in potts.mean_field(model, scores, colours, 2, 2).orderBy("node_id").collect()]
    assert np.array(got) == pytest.approx(softmax_rows(q + [0.0, 1.0, 0.0]))


def sparse(spark, p, k, theta=(0.5,), **flags):
    nodes = spark.range(p).select(F.col("id").alias("node_id"))
    edges = spatial.chain_edges(nodes).select(F.col("src").alias("h"), F.col("dst").alias("node_id"), F.lit(0).alias("component"), "w")
    bias = nodes.withColumn("bu", A.literal(np.linspace(0, 1, k)))
    return boltzmann.SparseHidden(edges, bias, theta, k, **flags)


def test_sparse_mean_field_matches_numpy(spark):
    p, k = 5, 3
    model = sparse(spark, p, k)
    ll = np.random.default_rng(4).standard_normal((2, p, k))
    scores = spark.createDataFrame([(s, i, ll[s, i].tolist()) for s in range(2) for i in range(p)], "subj_id long, node_id long, ll array<double>")
    w = 0.5 * (np.abs(np.subtract.outer(np.arange(p), np.arange(p))) == 1)
    base = ll + np.linspace(0, 1, k)
    sm = lambda a: np.exp(a) / np.exp(a).sum(axis=-1, keepdims=True)
    u = sm(base)
    for _ in range(3):
        h = sm(np.einsum("hi,sik->shk", w, u))
        u = sm(base + np.einsum("hi,shk->sik", w, h))
    uhat, hidden = boltzmann.sparse_mean_field(scores, model, 3)
    got = np.zeros((2, p, k))
    for r in uhat.collect():
        got[r["subj_id"], r["node_id"]] = r["uhat"]
    assert got == pytest.approx(u)
    e = boltzmann.unnormalised_loglik(uhat, hidden, model).orderBy("subj_id").collect()
    link = np.einsum("hi,sik,shk->s", w, u, h)
    assert [r["link"] for r in e] == pytest.approx(link)
    p_mean = boltzmann.mean_unnormalised_probability(uhat, hidden, model).first()["p"]
    bias = (u * np.linspace(0, 1, k)).sum(axis=(1, 2))
    assert p_mean == pytest.approx(np.exp(bias + link).mean())


def test_momentum_accumulates(spark):
    model = sparse(spark, 3, 2, momentum=0.9)
    states = boltzmann.start_chains(model, 2, 1)
    uhat = states.select("subj_id", "node_id", A.one_hot(F.lit(1), 2).alias("uhat"))
    hid = spark.createDataFrame([(s, h, [0.0, 1.0]) for s in range(2) for h in range(3)], "subj_id long, h long, hhat array<double>")
    neg, neg_hidden = boltzmann.sparse_negative_phase(states, model, 1, 2)
    one = boltzmann.sparse_step(model, uhat, hid, neg, neg_hidden, rate=0.1, fit_bias=False)
    g = (one.theta[0] - 0.5) / 0.1
    two = boltzmann.sparse_step(one, uhat, hid, neg, neg_hidden, rate=0.1, fit_bias=False)
    assert g > 0 and two.theta[0] - one.theta[0] == pytest.approx(0.9 * 0.1 * g + 0.1 * g)


def test_stochastic_learning_runs_and_repeats(spark):
    rng = np.random.default_rng(5)
    v = np.linalg.qr(rng.standard_normal((4, 3)))[0]
    rows = spark.createDataFrame([(s, i, int(i % 3)) for s in range(4) for i in range(6)], "subj_id long, vox_id long, label int")
    e = sampling.draw(rows, em.VonMisesFisher(v, 15.0), 3).select("subj_id", "vox_id", F.lit(1.0).alias("num_part"), "y")
    aligned = mixture.align([e])
    fits = [
        stochastic.fit_sml(sparse(spark, 6, 3), (em.VonMisesFisher(v, 5.0),), aligned, 2, batch_size=2, rate=0.1,
                           mean_field_iterations=2, chain_steps=1, seed=4)
        for _ in range(2)
    ]
    assert np.array(fits[0].trace) == pytest.approx(np.array(fits[1].trace)) and len(fits[0].trace) == 2
    sums = fits[0].posterior.select(A.total(F.col("uhat")).alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).first()
    assert sums["a"] == pytest.approx(1.0) and sums["b"] == pytest.approx(1.0) and sums["n"] == 24
    assert fits[0].emissions[0].kappa > 5.0


def test_individual_maps_follow_the_kind_of_prior(spark):
    v = np.eye(3)
    rows = spark.createDataFrame([(s, i, 1.0, v[i % 3].tolist()) for s in range(2) for i in range(6)], "subj_id long, vox_id long, num_part double, y array<double>")
    table = spark.createDataFrame([(i, [0.0] * 3) for i in range(6)], "node_id long, logpi array<double>")
    maps, fit = stochastic.individual_maps(priors.IndependentPrior(3, table=table), [rows], (em.VonMisesFisher(v, 5.0),), 3)
    assert maps.count() == 12 and fit.trace[0][1] == -np.inf
    maps, fit = stochastic.individual_maps(sparse(spark, 6, 3), [rows], (em.VonMisesFisher(v, 5.0),), 1)
    assert maps.count() == 12 and fit.prior.theta == (0.5,)


def test_largest_proper_divisor():
    assert [stochastic.largest_proper_divisor(n) for n in (1, 2, 12, 13)] == [None, 1, 6, 1]


def test_samples_have_the_right_moments(spark):
    rows = spark.range(4000).select(F.lit(0).alias("subj_id"), F.col("id").alias("vox_id"), (F.col("id") % 2).cast("int").alias("label"))
    v = np.array([[2.0, -1.0], [0.0, 3.0]])
    y = sampling.draw(rows, em.IsotropicGaussian(v, 0.25), 1).join(rows, ["subj_id", "vox_id"])
    m = {r["label"]: r for r in y.groupBy("label").agg(F.avg(F.col("y")[0]).alias("a"), F.avg(F.col("y")[1]).alias("b"), F.stddev(F.col("y")[0]).alias("s")).collect()}
    assert m[0]["a"] == pytest.approx(2.0, abs=0.05) and m[1]["b"] == pytest.approx(3.0, abs=0.05) and m[0]["s"] == pytest.approx(0.5, abs=0.03)
    z = sampling.draw(rows, em.Multinomial(3, 2.0), 1).join(rows, ["subj_id", "vox_id"])
    hit = z.agg(F.avg(F.col("y")[F.col("label")]).alias("h")).first()["h"]
    assert hit == pytest.approx(np.exp(2) / (np.exp(2) + 2), abs=0.03)
    g = sampling.draw(rows, em.GaussianExponential(v, 5.0, 0.1, 2.0), 1, signal=True)
    assert g.agg(F.avg("signal").alias("s")).first()["s"] == pytest.approx(0.5, abs=0.04)


def test_free_weights_follow_their_gradient(spark):
    model = sparse(spark, 3, 2, theta=(1.0,))
    uhat = spark.createDataFrame([(0, i, [1.0, 0.0]) for i in range(3)], "subj_id long, node_id long, uhat array<double>")
    hid = spark.createDataFrame([(0, h, [0.5, 0.5]) for h in range(3)], "subj_id long, h long, hhat array<double>")
    neg = spark.createDataFrame([(0, i, [0.5, 0.5]) for i in range(3)], "subj_id long, node_id long, pu array<double>")
    neg_hid = spark.createDataFrame([(0, h, [0.25, 0.25]) for h in range(3)], "subj_id long, h long, ph array<double>")
    new = boltzmann.weight_step(model, uhat, hid, neg, neg_hid, rate=0.1)
    assert [r["w"] for r in new.edges.collect()] == pytest.approx([1.0 + 0.1 * (0.5 - 0.25)] * 4)


def test_simulation_covers_all_datasets(spark):
    v = np.linalg.qr(np.random.default_rng(0).standard_normal((5, 3)))[0]
    table = spark.createDataFrame([(i, [5.0 if k == i % 3 else 0.0 for k in range(3)]) for i in range(9)], "node_id long, logpi array<double>")
    e = em.VonMisesFisher(v, 50.0)
    model = mixture.Model(priors.IndependentPrior(3, table=table), (e, e))
    who = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2)], "dataset_id int, local_subj long, subj_id long")
    labels, data = sampling.simulate(model, who, 3)
    assert labels.count() == 27 and [d.count() for d in data] == [18, 18]
    ready = [d.select("subj_id", "vox_id", F.lit(1.0).alias("num_part"), "y") for d in data]
    post = mixture.posterior(mixture.align(ready), model).join(labels, ["subj_id", "vox_id"])
    assert post.agg(F.avg((A.argmax(F.col("uhat")) == F.col("label")).cast("int")).alias("a")).first()["a"] > 0.95


def test_prior_from_probabilities(spark):
    prob = spark.createDataFrame([(0, [0.0, 1.0]), (1, [None, None])], "vox_id long, prob array<double>")
    rows = priors.build_prior(prob, 2).table.orderBy("node_id").collect()
    assert rows[0]["logpi"] == pytest.approx([np.log(1e-8), np.log(1 + 1e-8)])
    assert rows[1]["logpi"] == pytest.approx([np.log(0.5 + 1e-8)] * 2)
    with pytest.raises(ValueError):
        priors.build_prior(prob, 2, kind="odds")


def test_bias_and_weight_momentum(spark):
    model = sparse(spark, 3, 2, theta=(1.0,), momentum=0.5)
    uhat = spark.createDataFrame([(0, i, [1.0, 0.0]) for i in range(3)], "subj_id long, node_id long, uhat array<double>")
    hid = spark.createDataFrame([(0, h, [0.5, 0.5]) for h in range(3)], "subj_id long, h long, hhat array<double>")
    neg = spark.createDataFrame([(0, i, [0.5, 0.5]) for i in range(3)], "subj_id long, node_id long, pu array<double>")
    neg_hid = spark.createDataFrame([(0, h, [0.25, 0.25]) for h in range(3)], "subj_id long, h long, ph array<double>")
    one = boltzmann.weight_step(model, uhat, hid, neg, neg_hid, rate=0.1)
    two = boltzmann.weight_step(one, uhat, hid, neg, neg_hid, rate=0.1)
    g = 0.1 * 0.25
    assert [r["w"] for r in two.edges.collect()] == pytest.approx([1.0 + g + 1.5 * g] * 4)
    one = boltzmann.sparse_step(model, uhat, hid, neg, neg_hid, rate=0.1, fit_theta=False)
    two = boltzmann.sparse_step(one, uhat, hid, neg, neg_hid, rate=0.1, fit_theta=False)
    before = {r["node_id"]: r["bu"] for r in model.bias.collect()}
    for r in two.bias.collect():
        assert np.subtract(r["bu"], before[r["node_id"]]) == pytest.approx([0.05 * 2.5, -0.05 * 2.5])


def test_sparse_machine_sums_plain_products(spark):
    edges = spark.createDataFrame([(0, 0, 0, 2.0), (1, 0, 0, 0.5)], "h long, node_id long, component int, w double")
    uhat = spark.createDataFrame([(0, 0, [1.0, 0.0])], "subj_id long, node_id long, uhat array<double>")
    hid = spark.createDataFrame([(0, 0, [0.5, 0.5]), (0, 1, [0.2, 0.8])], "subj_id long, h long, hhat array<double>")
    plain = boltzmann.component_gradient(uhat, hid, edges, weighted=False).first()["gradient"]
    assert plain == pytest.approx((0.5 + 0.2) / 2.5)
    assert boltzmann.component_gradient(uhat, hid, edges).first()["gradient"] == pytest.approx((1.0 + 0.1) / 2.5)


def test_isolated_nodes_stay(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    prior = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(3)], "node_id long, logpi array<double>")
    model = potts.PottsModel(edges, 2, prior)
    colours = spatial.colour(edges)
    assert potts.gibbs(model, colours, 2, 3, 2, 1).count() == 3
    scores = spark.createDataFrame([(0, i, [0.0, 0.0]) for i in range(3)], "subj_id long, node_id long, ll array<double>")
    uhat, _ = potts.posterior(model, scores, colours, 2, 3, 1, 1)
    assert uhat.count() == 3 and potts.mean_field(model, scores, colours, 2, 1).count() == 3
    with pytest.raises(Exception, match="without a prior"):
        potts.mean_field(replace(model, prior=prior.limit(2)), scores, colours, 2, 1).collect()

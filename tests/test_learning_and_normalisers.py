"""Completion by down-dating, Potts learning, annealed normalisers, label graphs and trimming against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import boltzmann, crossval, matching, potts, spatial, stochastic
from tessera.operators.potts import PottsModel

K = 3


def sparse(spark, nodes=9):
    rng = np.random.default_rng(2)
    edges = [(h, n, 0, float(rng.random())) for h in range(4) for n in range(nodes - 1) if (h + n) % 3 < 2]
    links = spark.createDataFrame(edges, "h long, node_id long, component int, w double")
    bias = spark.createDataFrame([(n, rng.standard_normal(K).tolist()) for n in range(nodes)], "node_id long, bu array<double>")
    return boltzmann.SparseHidden(links, bias, (0.9,), K)


def evidence(spark, subjects, nodes, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(s, n, rng.standard_normal(K).tolist()) for s in range(subjects) for n in range(nodes)]
    return spark.createDataFrame(rows, "subj_id long, node_id long, ll array<double>")


@pytest.mark.parametrize("iterations", [1, 3])
def test_completion_equals_hiding_one_partition_at_a_time(spark, iterations):
    model, scores = sparse(spark), evidence(spark, 2, 9)
    part = F.col("node_id") % 4
    got = boltzmann.sparse_completion(scores, model, part, iterations).collect()

    def infer(hidden):
        rows = hidden.withColumnRenamed("vox_id", "node_id")
        return boltzmann.sparse_mean_field(rows, model, iterations)[0].withColumnRenamed("node_id", "vox_id")

    loop = crossval.completion(scores.withColumnRenamed("node_id", "vox_id"), F.col("vox_id") % 4, infer, 4)
    want = {(r.subj_id, r.vox_id): r.uhat for r in loop.collect()}
    assert len(got) == len(want) == 18
    for r in got:  # the last location has no link
        assert r.uhat == pytest.approx(want[r.subj_id, r.node_id])


def chain(spark, n, theta):
    edges = [(i, i + 1, 1.0) for i in range(n - 1)]
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src long, dst long, w double")
    prior = spark.createDataFrame([(i, [0.3 * j for j in range(K)]) for i in range(n)], "node_id long, logpi array<double>")
    colours = spark.createDataFrame([(i, i % 2) for i in range(n)], "node_id long, colour int")
    return PottsModel(both, K, prior, theta, drop_last=False), colours


def test_annealed_normaliser(spark):
    model, colours = chain(spark, 4, 0.9)
    z = sum(np.exp(0.3 * sum(x) + 0.9 * sum(a == b for a, b in zip(x, x[1:]))) for x in itertools.product(range(K), repeat=4))
    out = potts.log_normaliser(model, colours, 2, 400, [0.25, 0.5, 0.75, 1.0], 5).first()
    assert out.log_z == pytest.approx(np.log(z), abs=0.1) and 200 < out.ess <= 400
    free, _ = chain(spark, 4, 0.0)
    flat = potts.log_normaliser(free, colours, 2, 3, [1.0], 5).first()
    assert flat.log_z == pytest.approx(4 * np.log(np.exp(0.3 * np.arange(K)).sum())) and flat.ess == pytest.approx(3)
    with pytest.raises(ValueError):
        potts.annealed_weights(model, colours, 2, 3, [1.0, 0.5], 5)


def test_potts_learning_with_an_exact_positive_phase(spark):
    model, colours = chain(spark, 5, 0.2)
    scores = evidence(spark, 3, 5, seed=4)
    fit = stochastic.fit_potts_sml(model, scores, stochastic.exact_phase(model.edges), colours, 2, 2, chains=6, sweeps=1, rate=0.05, seed=3)
    assert len(fit.theta) == 3 and len(fit.trace) == 2 and fit.theta[0] == 0.2
    assert fit.chains.count() == 5 and all(len(r.labels) == 6 for r in fit.chains.collect())
    # The first step by hand: exact agreements of the chain, and the chains that the same seed draws.
    phi = []
    for s in range(3):
        ll = {r.node_id: np.array(r.ll) for r in scores.where(F.col("subj_id") == s).collect()}
        z = total = 0.0
        for x in itertools.product(range(K), repeat=5):
            equal = sum(a == b for a, b in zip(x, x[1:]))
            p = np.exp(sum(ll[i][x[i]] + 0.3 * x[i] for i in range(5)) + 0.2 * equal)
            z, total = z + p, total + 2 * p * equal
        phi.append(total / z)
    drawn = potts.gibbs(model, colours, 2, 6, 1, "3.0.neg").collect()
    labels = np.array([r.labels for r in sorted(drawn, key=lambda r: r.node_id)])
    neg = 2 * (labels[1:] == labels[:-1]).sum() / 6
    assert fit.theta[1] == pytest.approx(0.2 + 0.05 * (np.mean(phi) - neg))


def test_label_hops(spark):
    borders = spark.createDataFrame([(0, 1, 3), (1, 2, 1), (2, 3, 1), (3, 1, 1), (5, 6, 2), (9, 9, 4)], "a long, b long, n long")
    got = {(r.source, r.label): r.hops for r in spatial.label_hops(borders).collect()}
    assert got[0, 3] == got[3, 0] == 2 and got[0, 2] == 2 and got[5, 6] == 1 and got[9, 9] == 0
    assert len(got) == 16 + 4 + 1


def test_two_means(spark):
    rng = np.random.default_rng(6)
    groups = {0: [*rng.standard_normal(40), *(8 + rng.standard_normal(10))], 1: [2.0] * 5, 2: [1.0, 1.0, 1.0, 4.0], 3: [7.0, 3.0]}
    rows = [(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)] + [(0, 99, None)]
    df = spark.createDataFrame(rows, "model long, start long, value double").repartition(3)
    got = {r.model: (r.cut, r.cost) for r in matching.two_means(df, "model", "value").collect()}
    for g, vs in groups.items():
        x = np.sort(vs)
        cuts = [(((x[:i] - x[:i].mean()) ** 2).sum() + ((x[i:] - x[i:].mean()) ** 2).sum(), x[i - 1])
                for i in range(1, len(x)) if x[i] > x[i - 1]]
        if cuts:
            assert got[g] == (pytest.approx(min(cuts)[1]), pytest.approx(min(cuts)[0], abs=1e-9))
        else:
            assert got[g] == (None, None)
    kept = {r.start for r in matching.trim_starts(df.where("model <> 3")).collect()}
    low = {i for i in range(50) if groups[0][i] <= got[0][0]}
    assert kept == {i for i in low if i >= 4 or groups[2][i] <= got[2][0]}

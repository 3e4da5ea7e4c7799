import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import batches, randoms, special
from tessera.operators import evidence, labels, sampling


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else A.literal(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("r")).first()["r"]


def test_softmax_does_not_overflow(spark):
    got = one(spark, A.softmax(F.col("a")), a=[1000.0, 999.0])
    assert got == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.e)])


def test_log_softmax_sums_to_one(spark):
    got = one(spark, A.log_softmax(F.col("a")), a=[1.0, -2.0, 0.5])
    assert sum(math.exp(x) for x in got) == pytest.approx(1.0)


def test_unit_of_zero_vector_is_missing(spark):
    assert one(spark, A.unit(F.col("a")), a=[0.0, 0.0]) == [None, None]


def test_argmax_lowest_index_wins(spark):
    assert one(spark, A.argmax(F.col("a")), a=[1.0, 3.0, 3.0]) == 1


def test_log_bessel_matches_series():
    # I_v(x) by its power series
    for order, x in ((1.5, 2.0), (4.0, 10.0), (31.0, 60.0)):
        terms = [
            (2 * m + order) * math.log(x / 2) - math.lgamma(m + 1) - math.lgamma(m + order + 1) for m in range(400)
        ]
        top = max(terms)
        exact = top + math.log(sum(math.exp(t - top) for t in terms))
        assert special.log_bessel_np(order, x) == pytest.approx(exact, abs=0.1 / order)


def test_log_bessel_needs_three_dimensions():
    with pytest.raises(ValueError):
        special.log_bessel_np(0.0, 1.0)


def test_uniforms_do_not_depend_on_partitioning(spark):
    u = randoms.uniform(3, F.col("id")).alias("u")
    a = {r["id"]: r["u"] for r in spark.range(0, 100, 1, 1).select("id", u).collect()}
    b = {r["id"]: r["u"] for r in spark.range(0, 100, 1, 7).select("id", u).collect()}
    assert a == b and len(set(a.values())) == 100 and all(0 <= x < 1 for x in a.values())


def test_normals_have_unit_variance(spark):
    r = spark.range(20000).select(randoms.normal(1, F.col("id")).alias("z")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(r["m"]) < 0.03 and abs(r["s"] - 1) < 0.03


def test_pick_category(spark):
    p = A.literal([0.2, 0.3, 0.5])
    got = [spark.range(1).select(randoms.pick_category(p, F.lit(u)).alias("k")).first()["k"] for u in (0.1, 0.2, 0.49, 0.5, 0.999, 1.5)]
    assert got == [0, 1, 1, 2, 2, 0]


def test_matrix_with_missing():
    import pyarrow as pa

    m = batches.matrix(pa.array([[1.0, None], None, [3.0, 4.0]]), 2)
    assert np.isnan(m[0, 1]) and np.isnan(m[1]).all() and m[2].tolist() == [3.0, 4.0]
    assert batches.list_array(m).to_pylist() == [[1.0, None], [None, None], [3.0, 4.0]]


def test_design_matrix():
    assert evidence.design_matrix([3, 1, 3]).tolist() == [[0, 1], [1, 0], [0, 1]]
    assert evidence.design_matrix([0, 2, -1, 5], positive=True).tolist() == [[0, 0], [1, 0], [0, 0], [0, 1]]


def test_best_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n in (1, 2, 4, 6):
        for _ in range(20):
            c = rng.random((n, n))
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert c[np.arange(n), labels.best_assignment(c)].sum() == pytest.approx(best)


def test_greedy_pairs_breaks_ties_in_row_order():
    assert [(i, j) for i, j, _ in labels.greedy_pairs(np.array([[1.0, 1.0], [1.0, 0.0]]))] == [(0, 0), (1, 1)]


def test_vmf_draws_recover_concentration():
    rng = np.random.default_rng(1)
    mean = np.eye(5)[0]
    x = sampling.vmf_vectors(rng, mean, 20.0, 20000)
    assert np.linalg.norm(x, axis=1) == pytest.approx(np.ones(len(x)))
    r = np.linalg.norm(x.mean(axis=0))
    assert special.concentration_np(r, 5) == pytest.approx(20.0, rel=0.05)

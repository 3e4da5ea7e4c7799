import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence


def observations(spark, y):
    """(S, N, P) array to rows; NaN becomes NULL."""
    rows = [
        (s, p, [None if np.isnan(v) else float(v) for v in y[s, :, p]])
        for s in range(y.shape[0]) for p in range(y.shape[2])
    ]
    return spark.createDataFrame(rows, "subj_id long, vox_id long, y array<double>")


def collect(df, s, p, m):
    out, n = np.full((s, m, p), np.nan), np.full((s, p), np.nan)
    for r in df.collect():
        n[r["subj_id"], r["vox_id"]] = r["num_part"]
        out[r["subj_id"], :, r["vox_id"]] = [np.nan if v is None else v for v in r["y"]]
    return out, n


def test_partitions_with_missing_and_zero(spark):
    rng = np.random.default_rng(0)
    y = rng.standard_normal((2, 6, 4))
    x = np.vstack([np.eye(3), np.eye(3)])
    part = [1, 1, 1, 2, 2, 2]
    y[0, 1, 0] = np.nan  # first partition incomplete
    y[1, 3:, 2] = 0.0  # second partition has length zero
    y[1, :, 3] = np.nan  # nothing there
    got, n = collect(evidence.project(observations(spark, y), x, part), 2, 4, 3)
    want = np.zeros((2, 3, 4))
    count = np.zeros((2, 4))
    for s in range(2):
        for p in range(4):
            for half in (slice(0, 3), slice(3, 6)):
                v = y[s, half, p]
                if np.isnan(v).any():
                    continue
                count[s, p] += 1
                if np.linalg.norm(v) > 0:
                    want[s, :, p] += v / np.linalg.norm(v)
    assert n.tolist() == count.tolist()
    assert got == pytest.approx(want)


def test_without_partitions_missing_stays_missing(spark):
    y = np.array([[[3.0, np.nan, 0.0], [4.0, 1.0, 0.0]]])
    got, n = collect(evidence.project(observations(spark, y)), 1, 3, 2)
    assert n.tolist() == [[1, 0, 1]]
    assert got[0, :, 0] == pytest.approx([0.6, 0.8]) and np.isnan(got[0, :, 1:]).all()


def test_regression_uses_pseudo_inverse(spark):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((5, 2)), rng.standard_normal((1, 5, 3))
    got, _ = collect(evidence.project(observations(spark, y), x), 1, 3, 2)
    b = np.linalg.pinv(x) @ y[0]
    assert got[0] == pytest.approx(b / np.linalg.norm(b, axis=0))


def test_partitions_outside_the_list_are_an_error(spark):
    cells = spark.createDataFrame([(0, 0, j, 0, 1.0) for j in range(3)], "subj_id long, vox_id long, part_id int, cond_id int, value double")
    assert evidence.from_cells(cells, [0]).first()["num_part"] == 3
    with pytest.raises(Exception, match="unknown partition"):
        evidence.from_cells(cells, [0], [0, 1]).collect()
    with pytest.raises(Exception, match="unknown condition"):
        evidence.from_cells(cells, [1]).collect()


def test_weights_follow_the_locations_of_a_subject(spark):
    rows = [(s, v, 0, 0, float(v + 1)) for s, n in ((0, 2), (1, 4)) for v in range(n)]
    cells = spark.createDataFrame(rows, "subj_id long, vox_id long, part_id int, cond_id int, value double")
    sizes = cells.groupBy("subj_id").agg(F.countDistinct("vox_id").alias("locations"))
    out = evidence.add_weights(evidence.partition_vectors(cells, [0]), "length_sum2P", 1, sizes)
    sums = {r["subj_id"]: r["w"] for r in out.groupBy("subj_id").agg(F.sum("w").alias("w")).collect()}
    assert sums == pytest.approx({0: 2.0, 1: 4.0})


def test_one_and_two_shuffle_plans_agree(spark):
    rows = [(0, v, j, c, float(v + j + c)) for v in range(3) for j in range(2) for c in range(2) if not (v == 1 and j == 0 and c == 1)]
    cells = spark.createDataFrame(rows, "subj_id long, vox_id long, part_id int, cond_id int, value double")
    a = evidence.from_cells(cells, [0, 1], [0, 1]).orderBy("vox_id").collect()
    b = evidence.collapse(evidence.partition_vectors(cells, [0, 1]), 2).orderBy("vox_id").collect()
    for r, s in zip(a, b):
        assert r["num_part"] == s["num_part"] and r["y"] == pytest.approx(s["y"])
    assert [r["num_part"] for r in a] == [2, 1, 2]


def test_unit_weights_reproduce_plain_evidence(spark):
    rows = [(0, v, j, c, float(1 + v * j + c)) for v in range(3) for j in range(2) for c in range(2)]
    cells = spark.createDataFrame(rows, "subj_id long, vox_id long, part_id int, cond_id int, value double")
    vectors = evidence.partition_vectors(cells, [0, 1])
    plain = evidence.collapse(vectors, 2).orderBy("vox_id").collect()
    ones = evidence.collapse(evidence.add_weights(vectors, "ones", 2, 3, 1), 2, weight="w").orderBy("vox_id").collect()
    assert [r["num_part"] for r in plain] == [r["num_part"] for r in ones]
    assert [r["y"] for r in plain] == [r["y"] for r in ones]


def test_joined_sessions_drop_partitions(spark):
    cells = spark.createDataFrame([(0, 0, 3, "a", 1.0, "s2"), (0, 0, 4, "b", 1.0, "s1")], "subj_id long, vox_id long, part_id int, cond_id string, value double, sess string")
    split = {r["sess"]: r["dataset_id"] for r in evidence.split_sessions(cells, "sess").collect()}
    assert split == {"s1": 0, "s2": 1}
    joint = evidence.split_sessions(cells, "sess", join=True, ignore_partitions=True)
    assert joint.select("dataset_id", "part_id").distinct().count() == 1


def test_unknown_weighting_is_refused(spark):
    with pytest.raises(ValueError):
        evidence.add_weights(spark.range(1), "heavy", 1, 1, 1)


def test_length_of_units(spark):
    df = spark.createDataFrame([(0, 0, [3.0, 4.0])], "subj_id long, vox_id long, y array<double>")
    v = evidence.project(df).select(F.col("y")).first()["y"]
    assert math.hypot(*v) == pytest.approx(1.0)

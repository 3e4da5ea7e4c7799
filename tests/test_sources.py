import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import emissions as em
from tessera.operators import evidence, mixture, priors
from tessera.plans import reporting_queries, views
from tessera.sources import tables
from tessera.streaming import learning, scoring


def test_info_tables(spark, tmp_path):
    (tmp_path / "info.tsv").write_text("sess\trun\thalf\tnet_id\tnames\nses-1\t1\t1\t3\tnet3 \nses-1\t2\t2\t1\tnet1\n")
    df = tables.read_tsv(spark, str(tmp_path / "info.tsv"), tables.REST_NETWORKS)
    assert [r["names"] for r in df.orderBy("net_id").collect()] == ["net1", "net3"]
    (tmp_path / "a.lut").write_text("1 0.5 0.25 0 red\n2 1 1 1 white")
    assert tables.read_colours(spark, str(tmp_path / "a.lut")).where("id = 2").first()["name"] == "white"
    tables.write_tsv(df, str(tmp_path / "out"))
    assert tables.read_tsv(spark, str(tmp_path / "out"), tables.REST_NETWORKS).count() == 2


def test_observations_are_checked(spark, tmp_path):
    rows = [(0, 1, 2, [1.0, float("nan")])]
    spark.createDataFrame(rows, "dataset_id int, subj_id int, vox_id int, y array<float>").write.parquet(str(tmp_path / "ok"))
    assert tables.read_observations(spark, str(tmp_path / "ok")).first()["y"] == [1.0, None]
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        tables.read_observations(spark, str(tmp_path / "bad"))


def test_array_files(spark, tmp_path):
    for s in (1, 2):
        a = np.arange(6, dtype=float).reshape(2, 3) + s
        a[0, 0] = np.nan
        np.save(tmp_path / f"sub-{s:02d}.npy", a)
    got = tables.read_npy(spark, str(tmp_path / "*.npy")).orderBy("subj_id", "vox_id").collect()
    assert len(got) == 6 and got[0]["y"] == [None, 4.0] and got[5]["y"] == [4.0, 7.0]


def test_model_store(spark, tmp_path):
    def model(shift):
        t = spark.createDataFrame([(i, [shift, float(i), 0.5]) for i in range(3)], "node_id long, logpi array<double>")
        return mixture.Model(priors.IndependentPrior(3, table=t), (em.VonMisesFisher(np.eye(3) + shift, 7.0 + shift),))

    info = spark.createDataFrame([(0, -5.0), (1, -2.0), (2, -2.0)], "model_id long, loglik double")
    tables.save_models(info, mixture.parameter_table(spark, [model(0.0), model(1.0), model(2.0)]), str(tmp_path))
    prior, best = tables.load_group_prior(spark, str(tmp_path), 3)
    assert best.first()["model_id"] == 1
    assert [r["logpi"] for r in prior.orderBy("node_id").collect()] == [[1.0, 0.0, 0.5], [1.0, 1.0, 0.5], [1.0, 2.0, 0.5]]
    marginal, _ = tables.load_group_prior(spark, str(tmp_path), 3, index=0, marginal=True)
    assert all(sum(r["pi"]) == pytest.approx(1.0) for r in marginal.collect())
    assert tables.load_emission_params(spark, str(tmp_path), "kappa")[0].tolist() == [8.0]
    assert tables.load_emission_params(spark, str(tmp_path), "V", index=2)[0] == pytest.approx((np.eye(3) + 2).ravel())
    with pytest.raises(KeyError):
        tables.load_emission_params(spark, str(tmp_path), "beta")


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(s, p, rng.standard_normal(6).tolist()) for s in range(2) for p in range(5)]
    df = spark.createDataFrame(rows, "subj_id long, vox_id long, y array<double>")
    x, parts = np.vstack([np.eye(3), np.eye(3)]), [0, 0, 0, 1, 1, 1]
    table = spark.createDataFrame([(p, rng.standard_normal(3).tolist()) for p in range(5)], "node_id long, logpi array<double>")
    model = mixture.Model(priors.IndependentPrior(3, table=table), (em.VonMisesFisher(np.eye(3), 4.0),))
    folder = str(tmp_path / "in")
    df.where("subj_id = 0").write.parquet(folder)
    stream = scoring.read_stream(spark, folder, T.StructType(df.schema.fields), files_per_batch=1)
    scored = scoring.score_stream(stream, model, x, parts)
    scoring.run_available(scored, str(tmp_path / "out"), str(tmp_path / "state"))
    df.where("subj_id = 1").write.mode("append").parquet(folder)  # a new subject arrives
    scoring.run_available(scored, str(tmp_path / "out"), str(tmp_path / "state"))
    want = mixture.posterior(mixture.align([evidence.project(df, x, parts)]), model)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 10
    close = got.alias("a").join(want.alias("b"), ["subj_id", "vox_id"]).select(F.abs(F.col("a.uhat")[0] - F.col("b.uhat")[0]).alias("d"))
    assert close.agg(F.max("d").alias("d")).first()["d"] < 1e-12


def test_zero_runs_are_missing(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 4.0), (2, 0.0)], "vox_id int, value double")
    assert {r["vox_id"]: r["value"] for r in tables.average_runs(df, "value", ["vox_id"]).collect()} == {1: 4.0, 2: None}


def test_learning_from_a_stream_equals_the_batch_loop(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, p, rng.standard_normal(6).tolist()) for s in range(4) for p in range(8)]
    df = spark.createDataFrame(rows, "subj_id long, vox_id long, y array<double>")
    x, parts = np.vstack([np.eye(3), np.eye(3)]), [0, 0, 0, 1, 1, 1]
    prior = priors.IndependentPrior(3, flat=priors.uniform_flat(3), spatial=False)
    model = mixture.Model(prior, (em.VonMisesFisher(np.eye(3), 4.0),))
    now, sums, folder = model, {}, str(tmp_path / "in")
    for s in range(3):
        new = mixture.batch_statistics(mixture.align([evidence.project(df.where(F.col("subj_id") == s), x, parts)]), now)
        sums = {k: v + 0.7 * sums[k] if k in sums else v for k, v in new.items()}
        now = mixture.model_from_statistics(now, sums)
        df.where(F.col("subj_id") == s).coalesce(1).write.mode("append").parquet(folder)
    stream = scoring.read_stream(spark, folder, T.StructType(df.schema.fields), files_per_batch=1)
    out = (str(tmp_path / "model"), str(tmp_path / "state"), 0.7, x, parts)
    got = learning.learn_stream(stream, model, *out)
    assert got.emissions[0].v == pytest.approx(now.emissions[0].v) and got.emissions[0].kappa == pytest.approx(now.emissions[0].kappa)
    assert got.prior.flat == pytest.approx(now.prior.flat)
    version, again, _ = learning.load(spark, out[0], model)
    assert version == 2 and again.emissions[0].kappa == got.emissions[0].kappa
    # Nothing new: nothing changes. A micro-batch that is run again reads the version below it.
    assert learning.learn_stream(stream, model, *out).emissions[0].kappa == got.emissions[0].kappa
    assert learning.load(spark, out[0], model, 2)[0] == 1 and learning.load(spark, out[0], model, 0)[0] == learning.START
    df.where("subj_id = 3").coalesce(1).write.mode("append").parquet(folder)
    assert learning.learn_stream(stream, model, *out).emissions[0].kappa != got.emissions[0].kappa
    with pytest.raises(ValueError):
        mixture.batch_statistics(mixture.align([evidence.project(df, x, parts)]), mixture.Model(
            prior, (em.VonMisesFisher(np.eye(3), 4.0, per_subject=True),)))


def test_stream_posterior_reads_a_table_in_parts(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = reporting_queries.stream_posterior(spark, str(tmp_path))
    want = reporting_queries.stream_posterior(spark, "/root/testdata/sf0.001")
    assert got.count() == want.count() == rows.count() * views.PARCELS
    assert got.exceptAll(want).isEmpty()

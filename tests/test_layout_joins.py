"""Joins of layouts move keys, not whole tables, and hops take few rounds."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import randoms
from tessera.operators import potts, spatial, stochastic


def _grid(spark, height=4, n=40):
    x, y = spatial.grid_position(F.col("id"), height)
    return spark.range(n).select(F.col("id").alias("node_id"), x.alias("x"), y.alias("y"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def cuts(monkeypatch):
    """Plans of the tables that spatial materialises."""
    seen, cut = [], spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: (seen.append(_plan(df)), cut(df))[1])
    return seen


def test_hops_double_their_reach(spark, cuts):
    ring = [(i, (i + 1) % 40, 1) for i in range(40)] + [(100, 100, 1)]  # a label that touches only itself
    got = {(r["source"], r["label"]): r["hops"] for r in spatial.label_hops(spark.createDataFrame(ring, "a int, b int, n long")).collect()}
    want = {(i, j): min(abs(i - j), 40 - abs(i - j)) for i in range(40) for j in range(40)} | {(100, 100): 0}
    assert got == want
    assert len(cuts) <= 12  # 20 rings


def test_near_nodes_are_not_broadcast(spark):
    nodes = _grid(spark)
    pairs = spatial.within_distance(nodes, 2.5)
    at = {r["node_id"]: (r["x"], r["y"]) for r in nodes.collect()}
    near = lambda a, b: ((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5 < 2.5
    assert {(r["src"], r["dst"]) for r in pairs.collect()} == {(a, b) for a in at for b in at if a != b and near(a, b)}
    labels = nodes.select("node_id", F.col("x").alias("label"))
    for df in (pairs, spatial.grid_edges(nodes), spatial.chain_edges(nodes), spatial.label_borders(labels, spatial.grid_edges(nodes))):
        assert "Broadcast" not in _plan(df)


def test_colours_are_not_broadcast(spark, cuts):
    edges = spatial.grid_edges(_grid(spark))
    colours = {r["node_id"]: r["colour"] for r in spatial.colour(edges).collect()}
    assert all(colours[r["src"]] != colours[r["dst"]] for r in edges.collect()) and len(colours) == 40
    assert cuts and not any("Broadcast" in plan for plan in cuts)


def test_conditional_is_not_broadcast(spark):
    nodes = _grid(spark)
    model = potts.PottsModel(spatial.grid_edges(nodes), 2, nodes.select("node_id", F.array(F.lit(0.0), F.lit(0.5)).alias("logpi")), 0.8)
    states = nodes.select("node_id", F.array((F.col("x") % 2).cast("int"), (F.col("y") % 2).cast("int")).alias("labels"))
    out = potts.conditional(model, states)
    assert "Broadcast" not in _plan(out)
    assert out.count() == 80


def test_sweeps_read_made_tables(spark, monkeypatch):
    """Layout, colours and first labels are made once, not by every colour of every sweep."""
    nodes = _grid(spark)
    colours = nodes.select("node_id", ((F.col("x") + F.col("y")) % 2).cast("int").alias("colour"))
    prior = nodes.select("node_id", F.array(F.lit(0.0), F.lit(0.5)).alias("logpi"))
    model = potts.PottsModel(spatial.grid_edges(nodes), 2, prior, 0.8)
    scores = spark.range(2).withColumnRenamed("id", "subj_id").crossJoin(prior.withColumnRenamed("logpi", "ll"))
    seen, sweep = [], potts.sweep

    def watched(model, states, edges, *more):
        seen.extend(_plan(df) for df in (states, edges, model.prior))
        return sweep(model, states, edges, *more)

    monkeypatch.setattr(potts, "sweep", watched)
    phase = stochastic.sampled_phase(colours, 2, 3, 1)
    fit = stochastic.fit_potts_sml(model, scores, phase, colours, 2, 1, 3, 1, seed=5)
    assert fit.posterior.count() == 80 and len(seen) == 6
    assert not any(word in plan for plan in seen for word in ("Join", "md5", "Range"))


def test_draws_hash_once(spark):
    u = spark.range(50).select(F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5)).alias("p"), randoms.uniform(1, F.col("id")).alias("u"))
    rows = u.select("u", randoms.pick_category(F.col("p"), F.col("u")).alias("k"))
    assert all(r["k"] == (0 if r["u"] < 0.2 else 1 if r["u"] < 0.5 else 2) for r in rows.collect())

"""Layouts and Potts models on nodes taken from the benchmark tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import forest, matching, mixture, neighbours, potts, priors, spatial, stochastic
from tessera.plans import views
from tessera.plans.emission_queries import (
    EVENT_PARCELS, EVENT_SUMS, LABEL_SUMS, SHARED_KAPPA, VMF_SCORES, event_model, label_vmf,
)
from tessera.plans.prior_queries import LABEL_PRIOR, label_prior
from tessera.plans.registry import query
from tessera.plans.views import EVT_EVIDENCE, PARCELS, VOX, r6, table
from tessera.session import cut_lineage

HEIGHT = 20  # parts fill a grid column by column
CENTROIDS = ((1.0, 2.0), (30.0, 10.0), (60.0, 17.0), (90.0, 5.0))


def part_grid(spark, sf):
    x, y = spatial.grid_position(F.col("p_partkey"), HEIGHT)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), x.alias("x"), y.alias("y"))


_GRID = f"grid AS (SELECT p_partkey AS node_id, p_partkey // {HEIGHT} AS x, p_partkey % {HEIGHT} AS y FROM part)"
_LINKS = f"""{_GRID},
links AS (SELECT a.node_id AS src, b.node_id AS dst FROM grid a JOIN grid b
          ON (a.x = b.x AND abs(a.y - b.y) = 1) OR (a.y = b.y AND abs(a.x - b.x) = 1))"""


@query("chain_layout", """
SELECT a.c_custkey AS src, b.c_custkey AS dst, 1.0::DOUBLE AS w FROM customer a JOIN customer b
ON b.c_custkey = a.c_custkey + 1 OR b.c_custkey = a.c_custkey - 1""")
def chain_layout(spark, sf):
    return spatial.chain_edges(table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id")))


@query("grid_layout", f"WITH {_LINKS} SELECT src, dst, 1.0::DOUBLE AS w FROM links")
def grid_layout(spark, sf):
    return spatial.grid_edges(part_grid(spark, sf))


@query("edge_incidence", f"""
WITH {_LINKS}, e AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS edge_id FROM links WHERE src < dst)
SELECT edge_id, src AS node_id FROM e UNION ALL SELECT edge_id, dst FROM e""")
def edge_incidence(spark, sf):
    return spatial.incidence(spatial.grid_edges(part_grid(spark, sf)))


_SMOOTH = f"""{_GRID},
cen AS (SELECT * FROM (VALUES {", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(CENTROIDS))}) c(k, cx, cy)),
d2 AS (SELECT g.node_id, c.k, (g.x - c.cx) * (g.x - c.cx) + (g.y - c.cy) * (g.y - c.cy) AS d2 FROM grid g CROSS JOIN cen c),
sp AS (SELECT node_id, k, -d2 / 800.0 AS s, max(-d2 / 800.0) OVER (PARTITION BY node_id) AS top FROM d2),
slp AS (SELECT node_id, k, s - top - ln(sum(exp(s - top)) OVER (PARTITION BY node_id)) AS lp FROM sp)"""


def part_prior(spark, sf):
    return priors.smooth_prior(spatial.centroid_distances(part_grid(spark, sf), CENTROIDS), 400.0)


@query("smooth_prior", f"WITH {_SMOOTH} SELECT node_id, k::BIGINT AS k, round(lp, 6) + 0.0 AS lp FROM slp")
def smooth_prior(spark, sf):
    return views.explode_parcels(part_prior(spark, sf), "logpi", "node_id", alias="lp")


@query("centroid_distance", f"WITH {_SMOOTH} SELECT node_id, k::BIGINT AS k, round(sqrt(d2), 6) AS dist FROM d2")
def centroid_distance(spark, sf):
    d = spatial.centroid_distances(part_grid(spark, sf), CENTROIDS)
    return views.explode_parcels(d.select("node_id", F.transform("d2", F.sqrt).alias("d")), "d", "node_id", alias="dist")


@query("within_distance", f"""
WITH {_GRID}
SELECT a.node_id AS src, b.node_id AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS dist
FROM grid a JOIN grid b ON a.node_id <> b.node_id AND b.x BETWEEN a.x - 3 AND a.x + 3
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 2.5""")
def within_distance(spark, sf):
    return spatial.within_distance(part_grid(spark, sf), 2.5).select("src", "dst", r6(F.col("dist")).alias("dist"))


# Kernel density of the parts on the grid, by their retail price as height over it.
@query("knn_kernel_density", f"""
WITH {_GRID}, pt AS (SELECT g.*, p.p_retailprice / 100 AS z, p.p_size % 3 AS grp FROM grid g JOIN part p ON p.p_partkey = g.node_id),
d AS (SELECT a.grp, a.node_id, b.node_id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
      FROM pt a JOIN pt b ON a.grp = b.grp),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, node_id ORDER BY d, other) AS place FROM d)
SELECT grp::BIGINT AS grp, node_id, round(sum(exp(-d * d / 100.0)), 6) + 0.0 AS density FROM r WHERE place <= 20 GROUP BY ALL""")
def knn_kernel_density(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"), (F.col("p_retailprice") / 100).alias("z"), (F.col("p_size") % 3).cast("long").alias("grp"))
    at = part_grid(spark, sf).join(part, "node_id")
    points = at.select("grp", "node_id", F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("y"))
    out = neighbours.kernel_density(points, 20, 100.0, group=("grp",), id_col="node_id")
    return out.select("grp", "node_id", r6(F.col("density")).alias("density"))


# A labeling of the parts: their size modulo four.
_PART_LABEL = f"lab AS (SELECT p_partkey AS node_id, p_size % {len(CENTROIDS)} AS label FROM part)"


def part_labels(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"), (F.col("p_size") % len(CENTROIDS)).cast("int").alias("label")
    )


@query("label_borders", f"""
WITH {_LINKS}, {_PART_LABEL}
SELECT least(a.label, b.label)::BIGINT AS a, greatest(a.label, b.label)::BIGINT AS b, count(*)::BIGINT AS n
FROM links l JOIN lab a ON l.src = a.node_id JOIN lab b ON l.dst = b.node_id WHERE l.src < l.dst GROUP BY ALL""")
def label_borders(spark, sf):
    out = spatial.label_borders(part_labels(spark, sf), spatial.grid_edges(part_grid(spark, sf)))
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


@query("gradient_magnitude", f"""
WITH {_GRID}, val AS (SELECT p_partkey AS node_id, p_retailprice AS v FROM part),
lim AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid),
ker AS (SELECT * FROM (VALUES (-1,-1,-1,-1),(-1,0,-2,0),(-1,1,-1,1),(0,-1,0,-2),(0,1,0,2),(1,-1,1,-1),(1,0,2,0),(1,1,1,1)) k(dx,dy,gx,gy)),
g AS (SELECT a.node_id, sum(v.v * k.gx) AS gx, sum(v.v * k.gy) AS gy FROM grid a CROSS JOIN ker k CROSS JOIN lim
      JOIN grid b ON b.x = greatest(lim.x0, least(lim.x1, a.x + k.dx)) AND b.y = greatest(lim.y0, least(lim.y1, a.y + k.dy))
      JOIN val v ON v.node_id = b.node_id GROUP BY ALL)
SELECT node_id, round(sqrt(gx * gx + gy * gy), 4) + 0.0 AS gradient FROM g""")
def gradient_magnitude(spark, sf):
    price = table(spark, sf, "part").select(F.col("p_partkey").alias("node_id"), "p_retailprice")
    nodes = part_grid(spark, sf).join(price, "node_id")
    return spatial.gradient_magnitude(nodes, "p_retailprice").select("node_id", r6(F.col("gradient"), 4).alias("gradient"))


@query("map_data", f"""
SELECT c.c_custkey AS node_id, round(coalesce(o.v, -1), 6) AS value FROM customer c
LEFT JOIN (SELECT o_custkey, avg(o_totalprice) / 1e6 AS v FROM orders GROUP BY ALL) o ON o.o_custkey = c.c_custkey""")
def map_data(spark, sf):
    """Mean order price (in millions) of every customer; customers without orders get the default."""
    data = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(
        (F.avg("o_totalprice") / 1e6).alias("value"))
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node_id"))
    return spatial.map_data(nodes, data, default=-1.0).select("node_id", r6(F.col("value")).alias("value"))


@query("disc_mask", f"""
WITH {_GRID}, c AS (SELECT sqrt(0.1 * count(*) / pi()) AS r FROM grid)
SELECT node_id, (sqrt((x - 50) * (x - 50) + (y - 10) * (y - 10)) < r)::BIGINT AS missing FROM grid CROSS JOIN c""")
def disc_mask(spark, sf):
    """A tenth of the parts missing around a point: the missing-data simulation."""
    nodes = part_grid(spark, sf)
    return spatial.disc_mask(nodes, (50.0, 10.0), 0.1, nodes.count()).select("node_id", F.col("missing").cast("long").alias("missing"))


@query("random_mask", """
SELECT p_partkey AS node_id, (('0x' || substr(md5('5|' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15)::BIGINT AS missing FROM part""")
def random_mask(spark, sf):
    out = spatial.random_mask(part_grid(spark, sf), 0.15, 5)
    return out.select("node_id", F.col("missing").cast("long").alias("missing"))


@query("graph_colouring", f"""
WITH {_GRID} SELECT g.node_id, 1::BIGINT AS coloured, 0::BIGINT AS conflicts FROM grid g""")
def graph_colouring(spark, sf):
    """The property that counts: every node has a colour, and no neighbour has the same."""
    nodes = part_grid(spark, sf).select("node_id")
    edges = spatial.grid_edges(part_grid(spark, sf))
    colours = spatial.colour(edges)
    far = colours.select(F.col("node_id").alias("dst"), F.col("colour").alias("other"))
    clash = edges.join(colours.withColumnRenamed("node_id", "src").hint("merge"), "src").join(far.hint("merge"), "dst").where("colour = other").groupBy(
        F.col("src").alias("node_id")).agg(F.count("*").alias("conflicts"))
    linked = edges.select(F.col("src").alias("node_id")).distinct().withColumn("linked", F.lit(True))
    found = nodes.join(linked.hint("merge"), "node_id", "left").join(colours.hint("merge"), "node_id", "left").join(
        clash.hint("merge"), "node_id", "left")
    done = F.col("colour").isNotNull() | F.col("linked").isNull()  # a node without links takes any colour
    return found.select("node_id", done.cast("long").alias("coloured"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


# ---------------------------------------------------------------- Potts

THETA = 0.8
K = len(CENTROIDS)


def part_potts(spark, sf) -> potts.PottsModel:
    return potts.PottsModel(spatial.grid_edges(part_grid(spark, sf)), K, part_prior(spark, sf), THETA)


def part_states(spark, sf):
    """Two chains: labels by size and by price."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("node_id"),
        F.array((F.col("p_size") % K).cast("int"), (F.floor("p_retailprice") % K).cast("int")).alias("labels"),
    )


_STATES = f"""
st AS (SELECT p_partkey AS node_id, 0 AS chain, p_size % {K} AS u FROM part
       UNION ALL SELECT p_partkey, 1, floor(p_retailprice)::BIGINT % {K} FROM part)"""


@query("potts_energy", f"""
WITH {_LINKS}, {_SMOOTH[len(_GRID) + 1:]}, {_STATES},
phi AS (SELECT a.chain, sum((a.u = b.u)::INT) AS phi FROM links l JOIN st a ON l.src = a.node_id JOIN st b ON l.dst = b.node_id AND a.chain = b.chain GROUP BY ALL),
loc AS (SELECT s.chain, sum(p.lp) AS l FROM st s JOIN slp p ON s.node_id = p.node_id AND s.u = p.k GROUP BY ALL)
SELECT p.chain::BIGINT AS chain, round(p.phi, 4)::DOUBLE AS phi, round(l.l, 4) + 0.0 AS local, round({THETA} * p.phi + l.l, 4) + 0.0 AS loglik
FROM phi p JOIN loc l ON p.chain = l.chain""")
def potts_energy(spark, sf):
    out = potts.energy(part_potts(spark, sf), part_states(spark, sf))
    return out.select(
        F.col("chain").cast("long").alias("chain"), r6(F.col("phi"), 4).alias("phi"), r6(F.col("local"), 4).alias("local"),
        r6(F.col("loglik"), 4).alias("loglik"),
    )


_COND = f"""
nb AS (SELECT l.src AS node_id, s.chain, s.u, count(*) AS n FROM links l JOIN st s ON l.dst = s.node_id GROUP BY ALL),
ac AS (SELECT s.node_id, s.chain, p.k, {THETA} * coalesce(n.n, 0) + p.lp AS a FROM st s JOIN slp p ON s.node_id = p.node_id
       LEFT JOIN nb n ON n.node_id = s.node_id AND n.chain = s.chain AND n.u = p.k),
am AS (SELECT node_id, chain, max(a) AS m FROM ac GROUP BY ALL),
cp AS (SELECT a.node_id, a.chain, a.k, exp(a.a - m.m) / sum(exp(a.a - m.m)) OVER (PARTITION BY a.node_id, a.chain) AS p
       FROM ac a JOIN am m ON a.node_id = m.node_id AND a.chain = m.chain)"""


@query("potts_conditional", f"""
WITH {_LINKS}, {_SMOOTH[len(_GRID) + 1:]}, {_STATES}, {_COND}
SELECT node_id, chain::BIGINT AS chain, k::BIGINT AS k, round(p, 6) + 0.0 AS p FROM cp""")
def potts_conditional(spark, sf):
    out = potts.conditional(part_potts(spark, sf), part_states(spark, sf)).withColumn("chain", F.col("chain").cast("long"))
    return views.explode_parcels(out, "p", "node_id", "chain")


def _sql_colour_step(states: str, colour: int, tag: str, seed: str) -> str:
    other = "(x + y) % 2"
    return f"""
nb{tag} AS MATERIALIZED (SELECT l.src AS node_id, s.chain, s.u, count(*) AS n FROM links l JOIN {states} s ON l.dst = s.node_id GROUP BY ALL),
ac{tag} AS MATERIALIZED (SELECT s.node_id, s.chain, p.k, {THETA} * coalesce(n.n, 0) + p.lp AS a FROM {states} s JOIN grid g ON g.node_id = s.node_id AND {other} = {colour}
       JOIN slp p ON s.node_id = p.node_id LEFT JOIN nb{tag} n ON n.node_id = s.node_id AND n.chain = s.chain AND n.u = p.k),
cp{tag} AS MATERIALIZED (SELECT node_id, chain, k, sum(exp(a - m)) OVER (PARTITION BY node_id, chain ORDER BY k) / sum(exp(a - m)) OVER (PARTITION BY node_id, chain) AS c
       FROM (SELECT *, max(a) OVER (PARTITION BY node_id, chain) AS m FROM ac{tag})),
dr{tag} AS MATERIALIZED (SELECT node_id, chain, min(CASE WHEN ('0x' || substr(md5('{seed}|' || node_id || '|' || chain), 1, 8))::BIGINT / 4294967296.0::DOUBLE < c THEN k END) AS u FROM cp{tag} GROUP BY ALL),
st{tag} AS MATERIALIZED (SELECT s.node_id, s.chain, coalesce(d.u, s.u) AS u FROM {states} s LEFT JOIN dr{tag} d ON s.node_id = d.node_id AND s.chain = d.chain)"""


def checkerboard(spark, sf):
    return part_grid(spark, sf).select("node_id", ((F.col("x") + F.col("y")) % 2).cast("int").alias("colour"))


@query("potts_gibbs_sweep", f"""
WITH {_LINKS}, {_SMOOTH[len(_GRID) + 1:]}, {_STATES}, {_sql_colour_step('st', 0, '_a', '11.0.0')}, {_sql_colour_step('st_a', 1, '_b', '11.0.1')}
SELECT node_id, chain::BIGINT AS chain, u::BIGINT AS label FROM st_b""")
def potts_gibbs_sweep(spark, sf):
    """One Gibbs sweep of two chains over a checkerboard."""
    out = potts.gibbs(part_potts(spark, sf), checkerboard(spark, sf), 2, 2, 1, 11, states=part_states(spark, sf))
    return out.select("node_id", F.posexplode("labels").alias("chain", "label")).select(
        "node_id", F.col("chain").cast("long").alias("chain"), F.col("label").cast("long").alias("label")
    )


@query("potts_agreement", f"""
WITH {_LINKS}, {_STATES}
SELECT round(sum((a.u = b.u)::INT) / 2.0, 6) + 0.0 AS phi FROM links l JOIN st a ON l.src = a.node_id JOIN st b ON l.dst = b.node_id AND a.chain = b.chain""")
def potts_agreement(spark, sf):
    out = potts.expected_agreement(spatial.grid_edges(part_grid(spark, sf)), part_states(spark, sf))
    return out.select(r6(F.col("phi")).alias("phi"))


@query("potts_frequencies", f"""
WITH {_STATES}
SELECT p.node_id, t.k, sum((p.u = t.k)::INT) / 2.0::DOUBLE AS p FROM st p CROSS JOIN range({K}) t(k) GROUP BY ALL""")
def potts_frequencies(spark, sf):
    return views.explode_parcels(potts.frequencies(part_states(spark, sf), K), "uhat", "node_id")


_DRAW = "('0x' || substr(md5('{seed}|' || subj_id || '|' || vox_id || '|' || chain), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _sql_chain_step(states: str, colour: int, tag: str, seed: str) -> str:
    """One colour of a Gibbs sweep over the chain of every subject, given its evidence."""
    return f"""
nb{tag} AS MATERIALIZED (SELECT a.subj_id, a.vox_id, a.chain, b.u, count(*) AS n FROM {states} a JOIN {states} b
       ON a.subj_id = b.subj_id AND a.chain = b.chain AND abs(a.vox_id - b.vox_id) = 1 GROUP BY ALL),
ac{tag} AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.chain, p.k, 0.7 * coalesce(n.n, 0) + p.b AS a FROM {states} s
       JOIN pb p ON s.subj_id = p.subj_id AND s.vox_id = p.vox_id
       LEFT JOIN nb{tag} n ON n.subj_id = s.subj_id AND n.vox_id = s.vox_id AND n.chain = s.chain AND n.u = p.k WHERE s.vox_id % 2 = {colour}),
cp{tag} AS MATERIALIZED (SELECT subj_id, vox_id, chain, k, sum(exp(a - m)) OVER (PARTITION BY subj_id, vox_id, chain ORDER BY k)
       / sum(exp(a - m)) OVER (PARTITION BY subj_id, vox_id, chain) AS c
       FROM (SELECT *, max(a) OVER (PARTITION BY subj_id, vox_id, chain) AS m FROM ac{tag})),
dr{tag} AS MATERIALIZED (SELECT subj_id, vox_id, chain, coalesce(min(CASE WHEN {_DRAW.format(seed=seed)} < c THEN k END), 0) AS u FROM cp{tag} GROUP BY ALL),
st{tag} AS MATERIALIZED (SELECT s.subj_id, s.vox_id, s.chain, coalesce(d.u, s.u) AS u FROM {states} s
       LEFT JOIN dr{tag} d ON s.subj_id = d.subj_id AND s.vox_id = d.vox_id AND s.chain = d.chain)"""


_SAMPLER = f"""{EVT_EVIDENCE}, {EVENT_SUMS},
pb AS MATERIALIZED (SELECT subj_id, vox_id, k, ll + 0.1 * k AS b FROM sc),
p0 AS (SELECT subj_id, vox_id, k, sum(exp(b - m)) OVER (PARTITION BY subj_id, vox_id ORDER BY k) / sum(exp(b - m)) OVER (PARTITION BY subj_id, vox_id) AS c
       FROM (SELECT *, max(b) OVER (PARTITION BY subj_id, vox_id) AS m FROM pb)),
s0 AS MATERIALIZED (SELECT subj_id, vox_id, chain, coalesce(min(CASE WHEN {_DRAW.format(seed=3)} < c THEN k END), 0) AS u
       FROM p0 CROSS JOIN range(5) t(chain) GROUP BY ALL),
{_sql_chain_step("s0", 0, "_00", "3.0.0")}, {_sql_chain_step("st_00", 1, "_01", "3.0.1")},
{_sql_chain_step("st_01", 0, "_10", "3.1.0")}, {_sql_chain_step("st_10", 1, "_11", "3.1.1")}"""


@query("potts_chain_sampler", f"""
WITH {_SAMPLER}
SELECT s.subj_id, s.vox_id AS node_id, t.k::BIGINT AS k, round(avg((s.u = t.k)::INT), 6) + 0.0 AS p
FROM st_11 s CROSS JOIN range({EVENT_PARCELS}) t(k) GROUP BY s.subj_id, s.vox_id, t.k""")
def potts_chain_sampler(spark, sf):
    """Positive phase by sampling: event users on a chain, five chains, two sweeps."""
    scores, model = _event_chain(spark, sf)
    colours = scores.select("node_id").distinct().withColumn("colour", (F.col("node_id") % 2).cast("int"))
    uhat, _ = potts.posterior(model, scores, colours, 2, chains=5, sweeps=2, seed=3)
    return views.explode_parcels(uhat, "uhat", "subj_id", "node_id")


def _event_chain(spark, sf):
    """Evidence of the event users, whose locations form a chain, and a flat prior."""
    aligned, model = event_model(spark, sf)
    scores = mixture.scores(aligned, model).withColumnRenamed("vox_id", "node_id")
    # Links, colours and priors all come from the nodes: the events are read for them once.
    nodes = cut_lineage(views.event_cells(spark, sf).select(F.col("vox_id").alias("node_id")).distinct())
    flat = nodes.withColumn("logpi", A.literal([0.1 * k for k in range(EVENT_PARCELS)]))
    return scores, potts.PottsModel(spatial.chain_edges(nodes), EVENT_PARCELS, flat, 0.7, drop_last=False)


_CHAIN = f"""{EVT_EVIDENCE}, {EVENT_SUMS},
lq AS MATERIALIZED (SELECT subj_id, vox_id, list(ll + 0.1 * k ORDER BY k) AS q FROM sc GROUP BY ALL),
fw AS (
  SELECT subj_id, vox_id, q, q AS f FROM lq WHERE vox_id = 0
  UNION ALL
  SELECT n.subj_id, n.vox_id, n.q, list_transform([1, 2, 3, 4], lambda j: n.q[j] + ln(
    exp(w.f[1] - list_max(w.f) + CASE WHEN j = 1 THEN 0.7 ELSE 0 END) + exp(w.f[2] - list_max(w.f) + CASE WHEN j = 2 THEN 0.7 ELSE 0 END)
    + exp(w.f[3] - list_max(w.f) + CASE WHEN j = 3 THEN 0.7 ELSE 0 END) + exp(w.f[4] - list_max(w.f) + CASE WHEN j = 4 THEN 0.7 ELSE 0 END)))
  FROM fw w JOIN lq n ON n.subj_id = w.subj_id AND n.vox_id = w.vox_id + 1
),
last AS (SELECT max(vox_id) AS v FROM lq),
bw AS (
  SELECT subj_id, vox_id, q, [0.0::DOUBLE, 0.0, 0.0, 0.0] AS b FROM lq WHERE vox_id = (SELECT v FROM last)
  UNION ALL
  SELECT n.subj_id, n.vox_id, n.q, list_transform([1, 2, 3, 4], lambda j: ln(
    exp(w.q[1] + w.b[1] - w.q[1] - w.q[2] + CASE WHEN j = 1 THEN 0.7 ELSE 0 END) + exp(w.q[2] + w.b[2] - w.q[1] - w.q[2] + CASE WHEN j = 2 THEN 0.7 ELSE 0 END)
    + exp(w.q[3] + w.b[3] - w.q[1] - w.q[2] + CASE WHEN j = 3 THEN 0.7 ELSE 0 END) + exp(w.q[4] + w.b[4] - w.q[1] - w.q[2] + CASE WHEN j = 4 THEN 0.7 ELSE 0 END)))
  FROM bw w JOIN lq n ON n.subj_id = w.subj_id AND n.vox_id = w.vox_id - 1
),
cu AS (SELECT f.subj_id, f.vox_id, t.k, f.f[t.k + 1] + b.b[t.k + 1] AS s FROM fw f JOIN bw b ON f.subj_id = b.subj_id AND f.vox_id = b.vox_id CROSS JOIN range(4) t(k)),
cm AS (SELECT subj_id, vox_id, max(s) AS m FROM cu GROUP BY ALL)"""


@query("potts_chain_exact", f"""
WITH RECURSIVE {_CHAIN}
SELECT c.subj_id, c.vox_id AS node_id, c.k, round(exp(c.s - m.m) / sum(exp(c.s - m.m)) OVER (PARTITION BY c.subj_id, c.vox_id), 6) + 0.0 AS p
FROM cu c JOIN cm m ON c.subj_id = m.subj_id AND c.vox_id = m.vox_id""")
def potts_chain_exact(spark, sf):
    """Exact chain posterior by messages; short blocks, so that borders are exercised."""
    scores, model = _event_chain(spark, sf)
    logq = scores.join(model.prior, "node_id").select("subj_id", "node_id", A.add(F.col("ll"), F.col("logpi")).alias("logq"))
    return views.explode_parcels(potts.chain_posterior(logq, EVENT_PARCELS, model.theta, block=7), "uhat", "subj_id", "node_id")


_DUO_POST = f"{VOX}, {LABEL_SUMS}, {SHARED_KAPPA}, {VMF_SCORES}, {LABEL_PRIOR}"


@query("potts_duo_exact", f"""
WITH {_DUO_POST},
q AS (SELECT s.subj_id, s.vox_id, s.k, s.ll + p.lp AS q FROM sc s JOIN pri p ON s.vox_id = p.vox_id AND s.k = p.k),
jt AS (SELECT a.subj_id, a.vox_id AS pair, a.k AS i, b.k AS j, a.q + b.q + CASE WHEN a.k = b.k THEN {THETA} ELSE 0 END AS l
       FROM q a JOIN q b ON a.subj_id = b.subj_id AND b.vox_id = a.vox_id + 1 WHERE a.vox_id % 2 = 0),
jm AS (SELECT subj_id, pair, max(l) AS m FROM jt GROUP BY ALL),
jp AS (SELECT t.subj_id, t.pair, t.i, t.j, exp(t.l - m.m) / sum(exp(t.l - m.m)) OVER (PARTITION BY t.subj_id, t.pair) AS p FROM jt t JOIN jm m ON t.subj_id = m.subj_id AND t.pair = m.pair),
ag AS (SELECT subj_id, pair, sum(CASE WHEN i = j THEN p ELSE 0 END) AS a FROM jp GROUP BY ALL),
u1 AS (SELECT subj_id, pair, i AS k, sum(p) AS u FROM jp GROUP BY ALL),
u2 AS (SELECT subj_id, pair, j AS k, sum(p) AS u FROM jp GROUP BY ALL)
SELECT a.subj_id, a.pair, a.k::BIGINT AS k, round(a.u, 6) + 0.0 AS u1, round(b.u, 6) + 0.0 AS u2, round(g.a, 6) + 0.0 AS agree
FROM u1 a JOIN u2 b ON a.subj_id = b.subj_id AND a.pair = b.pair AND a.k = b.k JOIN ag g ON g.subj_id = a.subj_id AND g.pair = a.pair
UNION ALL
SELECT s.subj_id, s.pair, s.k::BIGINT, CASE WHEN s.vox_id % 2 = 0 THEN round(s.u, 6) + 0.0 END, CASE WHEN s.vox_id % 2 = 1 THEN round(s.u, 6) + 0.0 END, NULL
FROM (SELECT subj_id, vox_id, vox_id - vox_id % 2 AS pair, k, exp(q - m) / sum(exp(q - m)) OVER (PARTITION BY subj_id, vox_id) AS u
      FROM (SELECT *, max(q) OVER (PARTITION BY subj_id, vox_id) AS m FROM q)) s
WHERE NOT EXISTS (SELECT 1 FROM jp WHERE jp.subj_id = s.subj_id AND jp.pair = s.pair)""")
def potts_duo_exact(spark, sf):
    """Pairs of consecutive locations as two linked nodes, in closed form."""
    ll = mixture.loglik(views.vox_evidence(spark, sf), label_vmf(spark, sf).emissions[0])
    prior = label_prior(spark, sf).table.withColumnRenamed("node_id", "vox_id")
    q = ll.join(prior, "vox_id").select("subj_id", "vox_id", A.add(F.col("ll"), F.col("logpi")).alias("q"))
    even = F.col("vox_id") % 2 == 0
    pairs = q.groupBy("subj_id", (F.col("vox_id") - F.col("vox_id") % 2).alias("pair")).agg(
        F.first(F.when(even, F.col("q")), ignorenulls=True).alias("a"), F.first(F.when(~even, F.col("q")), ignorenulls=True).alias("b")
    )
    out = pairs.select("subj_id", "pair", potts.pair_posterior(F.col("a"), F.col("b"), THETA).alias("d"))
    none = F.array_repeat(F.lit(None).cast("double"), PARCELS)  # zipping with a missing array would drop the location that is there
    both = F.arrays_zip(F.coalesce("d.u1", none).alias("u1"), F.coalesce("d.u2", none).alias("u2"))
    return out.select("subj_id", "pair", F.posexplode(both).alias("k", "z"), "d.agree").select(
        "subj_id", "pair", F.col("k").cast("long").alias("k"), r6(F.col("z.u1")).alias("u1"), r6(F.col("z.u2")).alias("u2"), r6(F.col("agree")).alias("agree")
    )


@query("potts_enumerate", f"""
WITH {EVT_EVIDENCE}, {EVENT_SUMS},
f AS (SELECT d.subj_id, d.field, a.k AS i, b.k AS j, c.k AS l,
             coalesce(a.ll, 0) + coalesce(b.ll, 0) + coalesce(c.ll, 0) + CASE WHEN a.k = b.k THEN 0.7 ELSE 0 END + CASE WHEN b.k = c.k THEN 0.7 ELSE 0 END AS v
      FROM (SELECT DISTINCT subj_id, vox_id // 3 AS field FROM sc) d
      LEFT JOIN sc a ON a.subj_id = d.subj_id AND a.vox_id = d.field * 3 LEFT JOIN sc b ON b.subj_id = d.subj_id AND b.vox_id = d.field * 3 + 1
      LEFT JOIN sc c ON c.subj_id = d.subj_id AND c.vox_id = d.field * 3 + 2),
fm AS (SELECT subj_id, field, max(v) AS m FROM f GROUP BY ALL),
fp AS (SELECT f.subj_id, f.field, f.i, f.j, f.l, exp(f.v - m.m) / sum(exp(f.v - m.m)) OVER (PARTITION BY f.subj_id, f.field) AS p FROM f JOIN fm m ON f.subj_id = m.subj_id AND f.field = m.field),
al AS (SELECT subj_id, field, 0 AS position, i AS k, p FROM fp UNION ALL SELECT subj_id, field, 1, j, p FROM fp UNION ALL SELECT subj_id, field, 2, l, p FROM fp)
SELECT subj_id, field, position::BIGINT AS position, k::BIGINT AS k, round(sum(p), 6) + 0.0 AS p FROM al WHERE k IS NOT NULL GROUP BY ALL""")
def potts_enumerate(spark, sf):
    """Fields of three linked locations, all states visited."""
    aligned, model = event_model(spark, sf)
    ll = mixture.scores(aligned, model)
    place = F.col("vox_id") % 3
    groups = ll.groupBy("subj_id", F.expr("vox_id div 3").alias("field")).agg(
        *[F.first(F.when(place == p, F.col("ll")), ignorenulls=True).alias(f"s{p}") for p in range(3)]
    ).select("subj_id", "field", F.array("s0", "s1", "s2").alias("score"))
    out = potts.enumerate_field(groups, 3, EVENT_PARCELS, [(0, 1), (1, 2)], 0.7, ["subj_id", "field"])
    out = out.withColumn("position", F.col("position").cast("long"))
    return views.explode_parcels(out, "uhat", "subj_id", "field", "position")


def _sql_mean_field(steps: int) -> str:
    """Softmax of the biased, coupled means, even nodes then odd nodes, per step."""
    out = ["""
mb AS MATERIALIZED (SELECT subj_id, vox_id, k, ll + 0.1 * k AS b FROM sc),
mf AS MATERIALIZED (SELECT subj_id, vox_id, k, exp(b - m) / sum(exp(b - m)) OVER (PARTITION BY subj_id, vox_id) AS u
       FROM (SELECT *, max(b) OVER (PARTITION BY subj_id, vox_id) AS m FROM mb))"""]
    last = "mf"
    for i in range(steps):
        for c in (0, 1):
            n = f"mf{i}{c}"
            out.append(f"""
{n}_b AS MATERIALIZED (SELECT b.subj_id, b.vox_id, b.k, b.b + 0.7 * coalesce(sum(o.u), 0) AS b FROM mb b
       LEFT JOIN {last} o ON o.subj_id = b.subj_id AND o.k = b.k AND abs(o.vox_id - b.vox_id) = 1 GROUP BY b.subj_id, b.vox_id, b.k, b.b),
{n}_u AS MATERIALIZED (SELECT subj_id, vox_id, k, exp(b - m) / sum(exp(b - m)) OVER (PARTITION BY subj_id, vox_id) AS u
       FROM (SELECT *, max(b) OVER (PARTITION BY subj_id, vox_id) AS m FROM {n}_b)),
{n} AS MATERIALIZED (SELECT o.subj_id, o.vox_id, o.k, CASE WHEN o.vox_id % 2 = {c} THEN n.u ELSE o.u END AS u
       FROM {last} o JOIN {n}_u n ON o.subj_id = n.subj_id AND o.vox_id = n.vox_id AND o.k = n.k)""")
            last = n
    return ",".join(out)


@query("potts_mean_field", f"""
WITH {EVT_EVIDENCE}, {EVENT_SUMS}, {_sql_mean_field(2)}
SELECT subj_id, vox_id AS node_id, k::BIGINT AS k, round(u, 6) + 0.0 AS p FROM mf11""")
def potts_mean_field(spark, sf):
    scores, model = _event_chain(spark, sf)
    colours = scores.select("node_id").distinct().withColumn("colour", (F.col("node_id") % 2).cast("int"))
    return views.explode_parcels(potts.mean_field(model, scores, colours, 2, 2), "uhat", "subj_id", "node_id")




# ---------------------------------------------------------------- forests

# Six nodes in a branch; the last field of a subject may be cut short.
BRANCH = ((0, 2, 1.0), (1, 2, 1.0), (2, 3, 1.5), (3, 4, 1.0), (3, 5, 0.5))
_PLACES = range(6)
_FOREST = f"""{EVT_EVIDENCE}, {EVENT_SUMS},
nd AS (SELECT s.subj_id, n.n AS vox_id FROM (SELECT DISTINCT subj_id FROM sc) s CROSS JOIN range((SELECT max(vox_id) FROM sc) + 1) n(n)),
nb AS MATERIALIZED (SELECT nd.subj_id, nd.vox_id, k.k, coalesce(sc.ll, 0) + 0.1 * k.k AS b FROM nd CROSS JOIN range({EVENT_PARCELS}) k(k)
       LEFT JOIN sc ON sc.subj_id = nd.subj_id AND sc.vox_id = nd.vox_id AND sc.k = k.k),
fs AS (SELECT d.subj_id, d.field, {", ".join(f"n{i}.k AS k{i}" for i in _PLACES)},
         {" + ".join(f"coalesce(n{i}.b, 0)" for i in _PLACES)} + 0.7 * ({" + ".join(f"CASE WHEN n{i}.k = n{j}.k THEN {w} ELSE 0 END" for i, j, w in BRANCH)}) AS v
       FROM (SELECT DISTINCT subj_id, vox_id // 6 AS field FROM nd) d
       {" ".join(f"LEFT JOIN nb n{i} ON n{i}.subj_id = d.subj_id AND n{i}.vox_id = d.field * 6 + {i}" for i in _PLACES)}),
fp AS MATERIALIZED (SELECT *, exp(v - max(v) OVER g) / sum(exp(v - top)) OVER g AS p FROM (SELECT *, max(v) OVER (PARTITION BY subj_id, field) AS top FROM fs)
       WINDOW g AS (PARTITION BY subj_id, field))"""


def _event_forest(spark, sf):
    """Every node and subject of the event cells, with nothing known where a subject has no data, in branches of six."""
    scores, model = _event_chain(spark, sf)
    last = scores.agg(F.max("node_id")).first()[0]
    nodes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("node_id")
    grid = scores.select("subj_id").distinct().select("subj_id", nodes)
    none = F.array_repeat(F.lit(0.0), EVENT_PARCELS)
    full = grid.join(scores, ["subj_id", "node_id"], "left").select("subj_id", "node_id", F.coalesce("ll", none).alias("ll"))
    links = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in BRANCH]))
    field = spark.range(last // 6 + 1).select((F.col("id") * 6).alias("o"), links.alias("l"))
    up = field.select((F.col("o") + F.col("l.i")).alias("src"), (F.col("o") + F.col("l.j")).alias("dst"), "l.w").where(F.col("dst") <= last)
    edges = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    known = full.select("node_id").distinct().select("node_id", F.array(*[F.lit(0.1 * k) for k in range(EVENT_PARCELS)]).alias("logpi"))
    return full, replace(model, edges=edges, prior=known)


@query("potts_forest_exact", f"""
WITH {_FOREST}, al AS ({" UNION ALL ".join(f"SELECT subj_id, field * 6 + {i} AS node_id, k{i} AS k, p FROM fp" for i in _PLACES)})
SELECT subj_id, node_id, k::BIGINT AS k, round(sum(p), 6) + 0.0 AS p FROM al WHERE k IS NOT NULL GROUP BY ALL""")
def potts_forest_exact(spark, sf):
    """Branches of six linked locations, exactly, against all their states."""
    scores, model = _event_forest(spark, sf)
    return views.explode_parcels(forest.infer(model, scores)[0], "uhat", "subj_id", "node_id")


@query("potts_forest_agreement", f"""
WITH {_FOREST}
SELECT subj_id, round(2 * sum(p * ({" + ".join(f"CASE WHEN k{i} = k{j} THEN {w} ELSE 0 END" for i, j, w in BRANCH)})), 5) + 0.0 AS phi FROM fp GROUP BY ALL""")
def potts_forest_agreement(spark, sf):
    """Expected agreement of linked locations per subject."""
    scores, model = _event_forest(spark, sf)
    return forest.agreement(forest.infer(model, scores)[1]).select("subj_id", r6(F.col("phi"), 5).alias("phi"))


# ---------------------------------------------------------------- learning a Potts prior

SML_CHAINS, SML_SWEEPS, SML_RATE = 4, 1, 0.1


def _sql_draws(name: str, local: str, keys: list[str], seed: str, chains: int) -> str:
    """First labels of all chains from ``local`` (keys, vox_id, k, b) alone."""
    by = ", ".join([*keys, "vox_id"])
    text = " || '|' || ".join([f"'{seed}'", *keys, "vox_id", "chain"])
    return f"""
{name}c AS MATERIALIZED (SELECT {by}, k, sum(exp(b - m)) OVER (PARTITION BY {by} ORDER BY k) / sum(exp(b - m)) OVER (PARTITION BY {by}) AS c
  FROM (SELECT *, max(b) OVER (PARTITION BY {by}) AS m FROM {local})),
{name} AS MATERIALIZED (SELECT {by}, chain, coalesce(min(CASE WHEN ('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE < c THEN k END), 0) AS u
  FROM {name}c CROSS JOIN range({chains}) t(chain) GROUP BY ALL)"""


def _sql_swept(name: str, states: str, local: str, keys: list[str], seed: str, theta: str) -> str:
    """A sweep over even, then odd nodes of chains of nodes."""
    by = ", ".join([*keys, "vox_id", "chain"])
    same = lambda a, b, *c: " AND ".join(f"{a}.{k} = {b}.{k}" for k in [*keys, *c])
    text = " || '|' || ".join(["'{}'", *keys, "vox_id", "chain"])
    out = []
    for colour in (0, 1):
        n = f"{name}{colour}"
        draw = f"('0x' || substr(md5({text.format(f'{seed}.{colour}')}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
        out.append(f"""
{n}n AS MATERIALIZED (SELECT {", ".join(f"a.{c}" for c in [*keys, "vox_id", "chain"])}, b.u, count(*) AS n FROM {states} a JOIN {states} b
  ON {same("a", "b", "chain")} AND abs(a.vox_id - b.vox_id) = 1 GROUP BY ALL),
{n}a AS MATERIALIZED (SELECT {", ".join(f"s.{c}" for c in [*keys, "vox_id", "chain"])}, p.k, {theta} * coalesce(n.n, 0) + p.b AS a FROM {states} s
  JOIN {local} p ON {same("p", "s", "vox_id")} LEFT JOIN {n}n n ON {same("n", "s", "vox_id", "chain")} AND n.u = p.k WHERE s.vox_id % 2 = {colour}),
{n}c AS MATERIALIZED (SELECT {by}, k, sum(exp(a - m)) OVER (PARTITION BY {by} ORDER BY k) / sum(exp(a - m)) OVER (PARTITION BY {by}) AS c
  FROM (SELECT *, max(a) OVER (PARTITION BY {by}) AS m FROM {n}a)),
{n}d AS MATERIALIZED (SELECT {by}, coalesce(min(CASE WHEN {draw} < c THEN k END), 0) AS u FROM {n}c GROUP BY ALL),
{n} AS MATERIALIZED (SELECT {", ".join(f"s.{c}" for c in [*keys, "vox_id", "chain"])}, coalesce(d.u, s.u) AS u FROM {states} s
  LEFT JOIN {n}d d ON {same("d", "s", "vox_id", "chain")})""")
        states = n
    return ",".join(out)


def _sql_sml_round(r: int, chains: str | None) -> str:
    """Round r from pr{r} (vox_id, k, b) and th{r}; makes those of round r + 1 and the chains ng{r}1."""
    theta, one = f"(SELECT t FROM th{r})", f"{EVENT_PARCELS}"
    phi = "SELECT {by} sum((a.u = b.u)::INT) / {n}.0 AS phi FROM {s} a JOIN {s} b ON {on} a.chain = b.chain AND abs(a.vox_id - b.vox_id) = 1 {group}"
    start = "" if chains else _sql_draws(f"ns{r}", f"pr{r}", [], f"13.{r}.neg", SML_CHAINS) + ","
    return f"""
pb{r} AS MATERIALIZED (SELECT sc.subj_id, sc.vox_id, sc.k, sc.ll + p.b AS b FROM sc JOIN pr{r} p ON p.vox_id = sc.vox_id AND p.k = sc.k),
{_sql_draws(f"ps{r}", f"pb{r}", ["subj_id"], f"13.{r}.pos", SML_CHAINS)},
{_sql_swept(f"pp{r}", f"ps{r}", f"pb{r}", ["subj_id"], f"13.{r}.pos.0", theta)},{start}
{_sql_swept(f"ng{r}", chains or f"ns{r}", f"pr{r}", [], f"13.{r}.neg.0", theta)},
gp{r} AS MATERIALIZED (SELECT s.vox_id, t.k, avg((s.u = t.k)::INT) AS p FROM pp{r}1 s CROSS JOIN range({one}) t(k) GROUP BY ALL),
gn{r} AS MATERIALIZED (SELECT s.vox_id, t.k, avg((s.u = t.k)::INT) AS p FROM ng{r}1 s CROSS JOIN range({one}) t(k) GROUP BY ALL),
fp{r} AS MATERIALIZED ({phi.format(by="a.subj_id,", n=SML_CHAINS, s=f"pp{r}1", on="a.subj_id = b.subj_id AND", group="GROUP BY a.subj_id")}),
fn{r} AS MATERIALIZED ({phi.format(by="", n=SML_CHAINS, s=f"ng{r}1", on="", group="")}),
pr{r + 1} AS MATERIALIZED (SELECT p.vox_id, p.k, p.b + {SML_RATE} * (gp{r}.p - gn{r}.p) AS b FROM pr{r} p JOIN gp{r} ON gp{r}.vox_id = p.vox_id AND gp{r}.k = p.k
  JOIN gn{r} ON gn{r}.vox_id = p.vox_id AND gn{r}.k = p.k),
th{r + 1} AS MATERIALIZED (SELECT t + {SML_RATE} * ((SELECT avg(phi) FROM fp{r}) - (SELECT phi FROM fn{r})) AS t FROM th{r})"""


_POTTS_SML = f"""{EVT_EVIDENCE}, {EVENT_SUMS.replace("sc AS (", "sc AS MATERIALIZED (")},
pr0 AS MATERIALIZED (SELECT v.vox_id, k.k, 0.1 * k.k AS b FROM (SELECT DISTINCT vox_id FROM evt) v CROSS JOIN range({EVENT_PARCELS}) k(k)),
th0 AS (SELECT 0.7::DOUBLE AS t),
{_sql_sml_round(0, None)}, {_sql_sml_round(1, "ng01")}"""


def _potts_sml(spark, sf):
    scores, model = _event_chain(spark, sf)
    colours = model.prior.select("node_id", (F.col("node_id") % 2).cast("int").alias("colour"))
    phase = stochastic.sampled_phase(colours, 2, SML_CHAINS, SML_SWEEPS)
    return stochastic.fit_potts_sml(model, scores, phase, colours, 2, 2, SML_CHAINS, SML_SWEEPS, SML_RATE, seed=13)


@query("potts_sml_theta", f"""
WITH {_POTTS_SML}
SELECT r::BIGINT AS round, round(t, 6) + 0.0 AS theta FROM (SELECT 0 AS r, t FROM th0 UNION ALL SELECT 1, t FROM th1 UNION ALL SELECT 2, t FROM th2)""")
def potts_sml_theta(spark, sf):
    """The coupling over two rounds of stochastic maximum likelihood with persistent chains."""
    rows = [(r, round(t, 6) + 0.0) for r, t in enumerate(_potts_sml(spark, sf).theta)]
    return spark.createDataFrame(rows, "round long, theta double")


@query("potts_sml_prior", f"""
WITH {_POTTS_SML} SELECT vox_id AS node_id, k::BIGINT AS k, round(b, 6) + 0.0 AS p FROM pr2""")
def potts_sml_prior(spark, sf):
    """The local terms after the same rounds."""
    return views.explode_parcels(_potts_sml(spark, sf).model.prior, "logpi", "node_id")


# ---------------------------------------------------------------- normaliser, label graph

TEMPERATURES = (0.25, 0.5, 1.0)


def _sql_annealed() -> str:
    """Chains through all temperatures and the weight that each step adds."""
    out = [_sql_draws("z0", "pr0", [], "17", SML_CHAINS)]
    states, gains, before = "z0", [], 0.0
    for i, t in enumerate(TEMPERATURES):
        gains.append(f"""SELECT a.chain, {t - before}::DOUBLE * 0.7::DOUBLE * sum((a.u = b.u)::INT) AS g FROM {states} a JOIN {states} b
  ON a.chain = b.chain AND b.vox_id = a.vox_id + 1 GROUP BY a.chain""")
        if i < len(TEMPERATURES) - 1:
            out.append(_sql_swept(f"z{i + 1}_", states, "pr0", [], f"17.{i}.0", f"{0.7 * t}"))
            states = f"z{i + 1}_1"
        before = t
    out.append(f"""
lw AS MATERIALIZED (SELECT chain, sum(g) AS logw FROM ({" UNION ALL ".join(gains)}) GROUP BY chain)""")
    return ",".join(out)


_ANNEALED = f"""{EVT_EVIDENCE}, {EVENT_SUMS},
pr0 AS MATERIALIZED (SELECT v.vox_id, k.k, 0.1 * k.k AS b FROM (SELECT DISTINCT vox_id FROM evt) v CROSS JOIN range({EVENT_PARCELS}) k(k)),
{_sql_annealed()}"""


@query("potts_log_z", f"""
WITH {_ANNEALED},
free AS (SELECT sum(l) AS l FROM (SELECT vox_id, ln(sum(exp(b))) AS l FROM pr0 GROUP BY vox_id))
SELECT round(ln(avg(exp(logw - m))) + max(m) + max(free.l), 6) + 0.0 AS log_z,
       round(sum(exp(logw - m)) ** 2 / sum(exp(2 * (logw - m))), 6) + 0.0 AS ess
FROM lw CROSS JOIN (SELECT max(logw) AS m FROM lw) CROSS JOIN free""")
def potts_log_z(spark, sf):
    """Log normaliser of the Potts prior on the chain of event locations, by annealed importance sampling."""
    _, model = _event_chain(spark, sf)
    colours = model.prior.select("node_id", (F.col("node_id") % 2).cast("int").alias("colour"))
    out = potts.log_normaliser(model, colours, 2, SML_CHAINS, list(TEMPERATURES), 17)
    return out.select(r6(F.col("log_z")).alias("log_z"), r6(F.col("ess")).alias("ess"))


@query("label_hops", f"""
WITH RECURSIVE {_LINKS}, lab AS (SELECT node_id, x // 25 * 2 + y // 10 AS label FROM grid),
adj AS (SELECT DISTINCT a.label AS a, b.label AS b FROM links JOIN lab a ON a.node_id = src JOIN lab b ON b.node_id = dst),
reach(source, label, h) AS (SELECT DISTINCT a, a, 0 FROM adj UNION
  SELECT source, b, h + 1 FROM reach JOIN adj ON a = label WHERE a <> b AND h < (SELECT count(DISTINCT a) FROM adj))
SELECT source, label, min(h)::BIGINT AS hops FROM reach GROUP BY ALL""")
def label_hops(spark, sf):
    """Borders between blocks of the grid of parts."""
    nodes = part_grid(spark, sf)
    labels = nodes.select("node_id", F.expr("x div 25 * 2 + y div 10").alias("label"))
    return spatial.label_hops(spatial.label_borders(labels, spatial.grid_edges(nodes)))


@query("starts_trimmed", """
WITH v AS (SELECT (event_type IN ('click', 'view'))::INT AS model, user_id AS start, avg(value) AS value FROM events GROUP BY ALL),
e AS (SELECT model, value, count(*) AS n FROM v GROUP BY model, value),
m AS (SELECT model, avg(value) AS mean, count(*) AS total FROM v GROUP BY model),
c AS (SELECT e.model, e.value, m.total, e.n, e.value - m.mean AS x FROM e JOIN m USING (model)),
s AS (SELECT *, sum(n) OVER w AS c1, sum(n * x) OVER w AS s1, sum(n * x * x) OVER w AS q1,
             sum(n * x) OVER (PARTITION BY model) AS st, sum(n * x * x) OVER (PARTITION BY model) AS qt
      FROM c WINDOW w AS (PARTITION BY model ORDER BY value)),
cost AS (SELECT model, value, q1 - s1 * s1 / c1 + (qt - q1) - (st - s1) * (st - s1) / (total - c1) AS cost FROM s WHERE total > c1),
cut AS (SELECT model, arg_min(value, cost) AS cut FROM cost GROUP BY model),
low AS (SELECT start FROM v LEFT JOIN cut USING (model) GROUP BY start HAVING min((cut IS NULL OR value <= cut)::INT) = 1)
SELECT model::BIGINT AS model, start, round(value, 6) + 0.0 AS value FROM v JOIN low USING (start)""")
def starts_trimmed(spark, sf):
    """Users as starts, two kinds of events as models: those in the lower cluster of both."""
    kind = F.col("event_type").isin("click", "view").cast("long").alias("model")
    starts = table(spark, sf, "events").groupBy(kind, F.col("user_id").alias("start")).agg(
        F.avg("value").alias("value"))
    return matching.trim_starts(starts).select("model", "start", r6(F.col("value")).alias("value"))

"""Boltzmann-machine priors: hidden units that tie locations together.

Two families.  ``BinaryHidden`` has a few binary hidden units connected to all
locations; a location's row carries its block of weights, so one sum per
subject moves from locations to hidden units.  ``SparseHidden`` has hidden
units with K states and a sparse table of connections (``h, node_id,
component, w``); both directions are joins with that table.

Rows are keyed by ``subj_id``; sampling chains use the same code with the chain
number in its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import randoms
from tessera.operators.mixture import colocate, repeat_for_salts
from tessera.session import cut_lineage


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


# ---------------------------------------------------------------- binary hidden units


@dataclass(frozen=True)
class BinaryHidden:
    """``weights``: ``node_id, w`` (n_hidden rows of K), ``bu`` (K); ``bh``: n_hidden numbers."""

    weights: DataFrame
    bh: np.ndarray
    k: int

    @property
    def n_hidden(self) -> int:
        return len(self.bh)


def _activation(rows: DataFrame, model: BinaryHidden, u: str) -> DataFrame:
    """Input of every hidden unit per subject: one vector sum over locations."""
    part = F.transform("w", lambda row: A.dot(row, F.col(u)))
    sums = rows.select("subj_id", part.alias("a")).groupBy("subj_id").agg(
        *[F.sum(F.col("a")[h]).alias(f"a{h}") for h in range(model.n_hidden)]
    )
    return sums.select("subj_id", F.array(*[F.col(f"a{h}") + float(b) for h, b in enumerate(model.bh)]).alias("a"))


def hidden_probability(rows: DataFrame, model: BinaryHidden, u: str = "uhat") -> DataFrame:
    """Probability of every hidden unit: ``subj_id, eh``."""
    return _activation(rows, model, u).select("subj_id", F.transform("a", sigmoid).alias("eh"))


def _field(hidden: str, model: BinaryHidden) -> Column:
    """Input of a location from the hidden units (K numbers)."""
    zero = F.array_repeat(F.lit(0.0), model.k)
    scaled = F.zip_with(hidden, "w", lambda e, row: F.transform(row, lambda x: x * e))
    return F.aggregate(scaled, zero, A.add)


def mean_field(scores: DataFrame, model: BinaryHidden, iterations: int = 5) -> tuple[DataFrame, DataFrame]:
    """Posterior and hidden probabilities given the evidence ``subj_id, node_id, ll``.

    The evidence is placed by location and written once; every iteration joins
    the weights to it in place and moves only sums per subject.
    """
    placed, hot = colocate(scores.select("subj_id", "node_id", "ll"))
    base = cut_lineage(placed).join(repeat_for_salts(model.weights, hot), ["node_id", "salt"])
    rows = base.withColumn("uhat", A.softmax(A.add(F.col("ll"), F.col("bu"))))
    hidden = None
    for _ in range(iterations):
        hidden = cut_lineage(hidden_probability(rows, model))  # subjects x hidden units
        rows = base.join(hidden, "subj_id").withColumn(
            "uhat", A.softmax(A.add(A.add(_field("eh", model), F.col("bu")), F.col("ll")))
        ).drop("eh")
    return rows.select("subj_id", "node_id", "uhat"), hidden


def draw_hidden(rows: DataFrame, model: BinaryHidden, seed, u: str = "uhat") -> DataFrame:
    """Probabilities ``eh`` and 0/1 draws ``h`` of the hidden units."""
    p = hidden_probability(rows, model, u)
    draw = F.transform("eh", lambda x, i: F.when(randoms.uniform(seed, F.col("subj_id"), i) < x, 1.0).otherwise(0.0))
    return p.select("subj_id", "eh", draw.alias("h"))


def draw_locations(rows: DataFrame, hidden: DataFrame, model: BinaryHidden, seed) -> DataFrame:
    """Probabilities ``pu`` and one-hot draws ``u`` of every location; ``rows``: ``subj_id, node_id``."""
    joined = rows.select("subj_id", "node_id").join(model.weights, "node_id").join(hidden, "subj_id")
    p = joined.withColumn("pu", A.softmax(A.add(_field("h", model), F.col("bu"))))
    label = randoms.pick_category(F.col("pu"), randoms.uniform(seed, F.col("subj_id"), F.col("node_id")))
    return p.select("subj_id", "node_id", "pu", A.one_hot(label, model.k).alias("u"))


def negative_phase(states: DataFrame, model: BinaryHidden, steps: int, seed) -> tuple[DataFrame, DataFrame]:
    """Alternate hidden units and locations from given states (``subj_id, node_id, u``).

    Persistent chains pass in the result of the previous call, contrastive
    divergence passes in the data.  Returns the states (with ``pu``) and the
    hidden probabilities of the last step.
    """
    hidden = None
    for i in range(steps):
        rows = states.join(model.weights, "node_id")
        hidden = draw_hidden(rows, model, f"{seed}.h{i}", "u")
        states = cut_lineage(draw_locations(states, hidden, model, f"{seed}.u{i}"))
    return states, hidden


def random_states(nodes: DataFrame, chains: int, k: int, seed) -> DataFrame:
    """Starting chains with independent uniform numbers per parcel."""
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chains - 1).cast("long")))
    rows = nodes.select("node_id", ids.alias("subj_id"))
    u = F.array(*[randoms.uniform(seed, F.col("subj_id"), F.col("node_id"), F.lit(i)) for i in range(k)])
    return rows.select("subj_id", "node_id", u.alias("u"))


def sample(nodes: DataFrame, model: BinaryHidden, subjects: int, steps: int, seed) -> DataFrame:
    """Labels of new subjects after some burn-in from uniformly random labels."""
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(subjects - 1).cast("long")))
    rows = nodes.select("node_id", ids.alias("subj_id"))
    label = F.floor(randoms.uniform(f"{seed}.start", F.col("subj_id"), F.col("node_id")) * model.k)
    states, _ = negative_phase(rows.select("subj_id", "node_id", A.one_hot(label, model.k).alias("u")), model, steps, seed)
    return states.select("subj_id", "node_id", A.argmax(F.col("u")).alias("label"))


def binary_step(
    model: BinaryHidden, uhat: DataFrame, hidden: DataFrame, neg_u: DataFrame, neg_hidden: DataFrame, rate: float = 0.01,
    neg_column: str = "pu",
) -> BinaryHidden:
    """Gradient step on weights and biases: data minus N/M times the chains."""
    n = hidden.count()
    ratio = n / neg_hidden.count()
    nh, k = model.n_hidden, model.k

    def sums(u, h, column):
        joined = u.select("subj_id", "node_id", F.col(column).alias("x")).join(h.select("subj_id", "eh"), "subj_id")
        products = [F.sum(F.col("eh")[i] * F.col("x")[j]) for i in range(nh) for j in range(k)]
        return joined.groupBy("node_id").agg(F.array(*products).alias("g"), F.array(*A.sum_elements(F.col("x"), k)).alias("s"))

    pos = sums(uhat, hidden, "uhat").withColumnsRenamed({"g": "gp", "s": "sp"})
    neg = sums(neg_u, neg_hidden, neg_column).withColumnsRenamed({"g": "gn", "s": "sn"})
    diff = lambda a, b: F.zip_with(a, b, lambda x, y: rate * (x - ratio * y))
    rows = model.weights.join(pos, "node_id").join(neg, "node_id").withColumn("d", diff("gp", "gn"))
    w = F.transform("w", lambda row, i: F.transform(row, lambda x, j: x + F.col("d")[i * k + j]))
    weights = cut_lineage(rows.select("node_id", w.alias("w"), A.add(F.col("bu"), diff("sp", "sn")).alias("bu")))
    total = lambda h: np.array(h.agg(F.array(*A.sum_elements(F.col("eh"), nh)).alias("s")).first()["s"])
    return replace(model, weights=weights, bh=model.bh + rate * (total(hidden) - ratio * total(neg_hidden)))


# ---------------------------------------------------------------- sparse connections


@dataclass(frozen=True)
class SparseHidden:
    """Hidden units with K states and sparse, possibly multi-component connections.

    ``edges``: ``h, node_id, component, w``; the weight of a connection is the
    sum over components of ``w * theta[component]``.  ``bias``: ``node_id, bu``.
    """

    edges: DataFrame
    bias: DataFrame
    theta: tuple[float, ...]
    k: int
    momentum: float | None = None
    weight_decay: float = 0.0
    velocity: tuple[float, ...] | None = None
    # Sparse machines divide the plain sum of products by the summed weights, others weigh the products.
    weighted_gradient: bool = True
    # With momentum: node_id, vb (biases) and h, node_id, vw (free weights).
    bias_velocity: DataFrame | None = None
    weight_velocity: DataFrame | None = None

    def connections(self) -> DataFrame:
        scale = F.element_at(A.literal(self.theta), F.col("component") + 1)
        return self.edges.groupBy("h", "node_id").agg(F.sum(F.col("w") * scale).alias("w"))

    def marginal(self) -> DataFrame:
        return self.bias.select("node_id", A.softmax(F.col("bu")).alias("pi"))


def to_hidden(rows: DataFrame, links: DataFrame, k: int, u: str = "uhat") -> DataFrame:
    """Input of every hidden unit: ``subj_id, h, a``."""
    sums = rows.select("subj_id", "node_id", F.col(u).alias("u")).join(links, "node_id").groupBy("subj_id", "h").agg(
        F.array(*[F.sum(F.col("w") * F.col("u")[i]) for i in range(k)]).alias("a")
    )
    return sums


def to_locations(hidden: DataFrame, links: DataFrame, k: int, h: str = "hhat") -> DataFrame:
    """Input of every location from the hidden units: ``subj_id, node_id, a``."""
    return hidden.select("subj_id", "h", F.col(h).alias("v")).join(links, "h").groupBy("subj_id", "node_id").agg(
        F.array(*[F.sum(F.col("w") * F.col("v")[i]) for i in range(k)]).alias("a")
    )


def sparse_mean_field(
    scores: DataFrame, model: SparseHidden, iterations: int = 10, pretrain: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Posterior ``uhat`` and hidden ``hhat`` given the evidence ``subj_id, node_id, ll``.

    ``pretrain`` does a single pass to the hidden units only.
    """
    links = cut_lineage(model.connections())
    base = scores.join(model.bias, "node_id").select("subj_id", "node_id", A.add(F.col("ll"), F.col("bu")).alias("base"))
    base = cut_lineage(base)  # read by every iteration
    rows = base.withColumn("uhat", A.softmax(F.col("base")))
    hidden = None
    for _ in range(1 if pretrain else iterations):
        # Not written out: it is read once here, and once more from the last locations if asked for.
        hidden = to_hidden(rows, links, model.k).select("subj_id", "h", A.softmax(F.col("a")).alias("hhat"))
        if pretrain:
            break
        a = to_locations(hidden, links, model.k)
        none = F.array_repeat(F.lit(0.0), model.k)
        rows = cut_lineage(
            base.join(a, ["subj_id", "node_id"], "left")
            .select("subj_id", "node_id", "base", A.softmax(A.add(F.col("base"), F.coalesce("a", none))).alias("uhat"))
        )
    return rows.select("subj_id", "node_id", "uhat"), hidden


def _expected_products(uhat: DataFrame, hidden: DataFrame, edges: DataFrame, u: str, h: str) -> DataFrame:
    """Sum over subjects of <h, u> along every connection."""
    return (
        uhat.select("subj_id", "node_id", F.col(u).alias("u")).join(edges, "node_id")
        .join(hidden.select("subj_id", "h", F.col(h).alias("v")), ["subj_id", "h"])
        .select("subj_id", "h", "node_id", "component", "w", A.dot(F.col("u"), F.col("v")).alias("x"))
    )


def unnormalised_loglik(uhat: DataFrame, hidden: DataFrame, model: SparseHidden, u: str = "uhat", h: str = "hhat") -> DataFrame:
    """Bias plus connection energy of every subject: ``subj_id, bias, link``."""
    b = uhat.join(model.bias, "node_id").groupBy("subj_id").agg(F.sum(A.dot(F.col(u), F.col("bu"))).alias("bias"))
    links = model.connections().withColumn("component", F.lit(0))
    c = _expected_products(uhat, hidden, links, u, h).groupBy("subj_id").agg(F.sum(F.col("w") * F.col("x")).alias("link"))
    return b.join(c, "subj_id", "left").select("subj_id", "bias", F.coalesce("link", F.lit(0.0)).alias("link"))


def mean_unnormalised_probability(uhat: DataFrame, hidden: DataFrame, model: SparseHidden) -> DataFrame:
    e = unnormalised_loglik(uhat, hidden, model)
    return e.agg(F.avg(F.exp(F.col("bias") + F.col("link"))).alias("p"))


def component_gradient(
    uhat: DataFrame, hidden: DataFrame, edges: DataFrame, u: str = "uhat", h: str = "hhat", weighted: bool = True
) -> DataFrame:
    """Mean over subjects of sum w <h, u> (or of sum <h, u>) per component, over the summed weights."""
    scale = F.col("w") if weighted else F.lit(1.0)
    n = uhat.select("subj_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = _expected_products(uhat, hidden, edges, u, h).groupBy("component").agg(F.sum(scale * F.col("x")).alias("g"))
    weights = edges.groupBy("component").agg(F.sum("w").alias("t"))
    return sums.join(weights, "component").select("component", (F.col("g") / n / F.col("t")).alias("gradient"))


def sparse_step(
    model: SparseHidden, uhat: DataFrame, hidden: DataFrame, neg_u: DataFrame, neg_hidden: DataFrame,
    rate: float = 0.01, fit_theta: bool = True, fit_bias: bool = True,
) -> SparseHidden:
    """Gradient step on the component strengths and the biases."""
    new = model
    if fit_theta:
        pos = {r["component"]: r["gradient"] for r in component_gradient(
            uhat, hidden, model.edges, weighted=model.weighted_gradient).collect()}
        neg = {r["component"]: r["gradient"] for r in component_gradient(
            neg_u, neg_hidden, model.edges, "pu", "ph", model.weighted_gradient).collect()}
        theta, velocity = [], []
        for c, t in enumerate(model.theta):
            g = pos.get(c, 0.0) - neg.get(c, 0.0)
            if model.momentum is None:
                step = rate * g
            else:
                step = model.momentum * (model.velocity[c] if model.velocity else 0.0) + rate * g
                velocity.append(step)
            theta.append(t + step - rate * model.weight_decay * t)
        new = replace(new, theta=tuple(theta), velocity=tuple(velocity) or None)
    if fit_bias:
        k = model.k
        mean = lambda df, c: df.groupBy("node_id").agg(F.array(*[F.avg(F.col(c)[i]) for i in range(k)]).alias(c))
        rows = model.bias.join(mean(uhat, "uhat"), "node_id").join(mean(neg_u, "pu"), "node_id")
        step = F.transform(F.arrays_zip("uhat", "pu"), lambda z: rate * (z["uhat"] - z["pu"]))
        if model.momentum is not None and model.bias_velocity is not None:
            rows = rows.join(model.bias_velocity, "node_id", "left")
            before = F.coalesce("vb", F.array_repeat(F.lit(0.0), k))
            step = F.zip_with(before, step, lambda v, g: model.momentum * v + g)
        moved = cut_lineage(rows.select("node_id", "bu", step.alias("vb")))
        new = replace(new, bias=moved.select("node_id", A.add(F.col("bu"), F.col("vb")).alias("bu")))
        if model.momentum is not None:
            new = replace(new, bias_velocity=moved.select("node_id", "vb"))
    return new


def weight_step(
    model: SparseHidden, uhat: DataFrame, hidden: DataFrame, neg_u: DataFrame, neg_hidden: DataFrame, rate: float = 0.01
) -> SparseHidden:
    """Gradient step on freely trained connections: every edge has its own weight.

    For models of one component with strength 1.
    """
    if len(model.theta) != 1:
        raise ValueError("free weights need a single component")

    def mean(u, h, uc, hc, name):
        n = u.select("subj_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
        x = _expected_products(u, h, model.edges, uc, hc)
        return x.groupBy("h", "node_id").agg(F.sum("x").alias("s")).select("h", "node_id", (F.col("s") / n).alias(name))

    pos, neg = mean(uhat, hidden, "uhat", "hhat", "gp"), mean(neg_u, neg_hidden, "pu", "ph", "gn")
    rows = model.edges.join(pos, ["h", "node_id"], "left").join(neg, ["h", "node_id"], "left")
    g = F.coalesce("gp", F.lit(0.0)) - F.coalesce("gn", F.lit(0.0))
    if model.momentum is None:
        moved = F.col("w") + rate * (1 - model.weight_decay) * g
        return replace(model, edges=cut_lineage(rows.select("h", "node_id", "component", moved.alias("w"))))
    velocity = rate * g
    if model.weight_velocity is not None:
        rows = rows.join(model.weight_velocity, ["h", "node_id"], "left")
        velocity = model.momentum * F.coalesce("vw", F.lit(0.0)) + velocity
    moved = cut_lineage(rows.select("h", "node_id", "component", "w", velocity.alias("vw")))
    w = F.col("w") + (1 - rate * model.weight_decay) * F.col("vw")
    return replace(model, edges=moved.select("h", "node_id", "component", w.alias("w")),
                   weight_velocity=moved.select("h", "node_id", "vw"))


def random_weights(h: DataFrame, nodes: DataFrame, seed, scale: float = 0.1) -> DataFrame:
    """Normal starting weights between every hidden unit and every location of a dense layer.

    The number of hidden units is a model setting, so this is one row per
    weight and nothing else.
    """
    units = h.agg(F.collect_set("h").alias("u")).scalar()
    rows = nodes.withColumn("h", F.explode(units))
    z = randoms.normal(seed, F.col("h"), F.col("node_id")) * scale
    return rows.select("h", "node_id", F.lit(0).alias("component"), z.alias("w"))


def chain_marginal(states: DataFrame, k: int, column: str = "label") -> DataFrame:
    """Marginal probability of every location as the mean over chains."""
    share = [F.avg(F.when(F.col(column) == i, 1.0).otherwise(0.0)) for i in range(k)]
    return states.groupBy("node_id").agg(F.array(*share).alias("pi"))


def sparse_negative_phase(
    states: DataFrame, model: SparseHidden, steps: int, seed, evidence: Callable[[DataFrame, str], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Gibbs steps of chains ``subj_id, node_id, label``; returns states (``pu``, ``label``) and hidden ``ph``.

    ``evidence(states, seed)`` may draw data from an emission model for the
    current labels and score them again (``subj_id, node_id, ll``), so that the
    chains see the same kind of evidence as the subjects.
    """
    links = cut_lineage(model.connections())
    none = F.array_repeat(F.lit(0.0), model.k)
    hidden = None
    for i in range(steps):
        ll = None if evidence is None else evidence(states, f"{seed}.y{i}")
        rows = states.select("subj_id", "node_id", A.one_hot(F.col("label"), model.k).alias("u"))
        p = to_hidden(rows, links, model.k, "u").select("subj_id", "h", A.softmax(F.col("a")).alias("ph"))
        draw = randoms.pick_category(F.col("ph"), randoms.uniform(f"{seed}.h{i}", F.col("subj_id"), F.col("h")))
        hidden = p.withColumn("s", A.one_hot(draw, model.k))
        a = to_locations(hidden, links, model.k, "s")
        base = states.select("subj_id", "node_id").join(model.bias, "node_id").join(a, ["subj_id", "node_id"], "left")
        act = A.add(F.col("bu"), F.coalesce("a", none))
        if ll is not None:
            base = base.join(ll, ["subj_id", "node_id"])
            act = A.add(act, F.col("ll"))
        pu = base.select("subj_id", "node_id", A.softmax(act).alias("pu"))
        label = randoms.pick_category(F.col("pu"), randoms.uniform(f"{seed}.u{i}", F.col("subj_id"), F.col("node_id")))
        states = cut_lineage(pu.withColumn("label", label))
    return states, hidden


def start_chains(model: SparseHidden, chains: int, seed) -> DataFrame:
    """Chains drawn from the biases alone."""
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chains - 1).cast("long")))
    rows = model.marginal().select("node_id", "pi", ids.alias("subj_id"))
    label = randoms.pick_category(F.col("pi"), randoms.uniform(seed, F.col("subj_id"), F.col("node_id")))
    return rows.select("subj_id", "node_id", label.alias("label"))


def mean_field_sample(model: SparseHidden, subjects: int, iterations: int, seed) -> DataFrame:
    """Probabilities reached by mean field from random starts, without evidence."""
    ids = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(subjects - 1).cast("long")))
    nodes = model.bias.select("node_id", ids.alias("subj_id"))
    z = F.array(*[randoms.normal(seed, F.col("subj_id"), F.col("node_id"), F.lit(i)) for i in range(model.k)])
    rows = cut_lineage(nodes.select("subj_id", "node_id", A.softmax(z).alias("uhat")))
    links = cut_lineage(model.connections())
    none = F.array_repeat(F.lit(0.0), model.k)
    for _ in range(iterations):
        hidden = to_hidden(rows, links, model.k).select("subj_id", "h", A.softmax(F.col("a")).alias("hhat"))
        a = to_locations(hidden, links, model.k)
        rows = nodes.join(model.bias, "node_id").join(a, ["subj_id", "node_id"], "left").select(
            "subj_id", "node_id", A.softmax(A.add(F.col("bu"), F.coalesce("a", none))).alias("uhat")
        )
        rows = cut_lineage(rows)
    return rows


# ---------------------------------------------------------------- completion


def sparse_completion(scores: DataFrame, model: SparseHidden, part: Column, iterations: int = 10) -> DataFrame:
    """Posterior of every location when the evidence of its own partition is hidden: ``subj_id, node_id, uhat``.

    ``scores``: ``subj_id, node_id, ll``; ``part`` numbers the partition of a location.  All partitions are hidden in the
    same passes: the turn is part of the key.  The first input of a hidden unit is its total over all locations less
    what the turn's own partition adds and plus what its bare biases add, so it takes one aggregate for all turns; the
    last pass visits each location in its own turn only.  Between them every location is there once for each turn.
    """
    k = model.k
    links = cut_lineage(model.connections())
    none = F.array_repeat(F.lit(0.0), k)
    base = cut_lineage(scores.join(model.bias, "node_id").select(
        "subj_id", "node_id", part.cast("long").alias("part"), "bu", A.add(F.col("ll"), F.col("bu")).alias("base")))
    sums = lambda c: F.array(*[F.sum(F.col("w") * F.col(c)[i]) for i in range(k)])
    first = base.select("subj_id", "node_id", "part", A.softmax(F.col("base")).alias("u"), A.softmax(F.col("bu")).alias("v"))
    own = cut_lineage(first.join(links, "node_id").groupBy("subj_id", "h", "part").agg(sums("u").alias("x"), sums("v").alias("y")))
    total = own.groupBy("subj_id", "h").agg(F.array(*[F.sum(F.col("x")[i]) for i in range(k)]).alias("t"))
    less = lambda x, y: F.zip_with(F.zip_with("t", x, lambda a, b: a - b), y, lambda a, b: a + b)
    if iterations == 1:  # only turns of partitions that the unit is linked to are asked for
        inputs = total.join(own, ["subj_id", "h"]).select("subj_id", "h", F.col("part").alias("turn"), less("x", "y").alias("a"))
    else:
        turns = base.agg(F.array_sort(F.collect_set("part")).alias("turns")).scalar()
        keyed = total.select("subj_id", "h", "t", F.explode(turns).alias("turn"))
        inputs = keyed.join(own.withColumnRenamed("part", "turn"), ["subj_id", "h", "turn"], "left").select(
            "subj_id", "h", "turn", less(F.coalesce("x", none), F.coalesce("y", none)).alias("a"))
    rows = None
    for i in range(iterations):
        hidden = inputs.select("subj_id", "h", "turn", A.softmax(F.col("a")).alias("v"))
        final = i == iterations - 1
        reached = hidden.join(links, "h").join(base.select("subj_id", "node_id", "part", "bu", "base"), ["subj_id", "node_id"])
        if final:
            reached = reached.where(F.col("turn") == F.col("part"))
        given = F.when(F.col("turn") == F.col("part"), F.col("bu")).otherwise(F.col("base"))
        field = reached.groupBy("subj_id", "node_id", "turn").agg(F.first(given).alias("b"), sums("v").alias("a"))
        rows = cut_lineage(field.select("subj_id", "node_id", "turn", A.softmax(A.add(F.col("b"), F.col("a"))).alias("uhat")))
        if not final:
            inputs = rows.join(links, "node_id").groupBy("subj_id", "h", "turn").agg(sums("uhat").alias("a"))
    # A location without links has its bare biases.
    found = base.join(rows.select("subj_id", "node_id", "uhat"), ["subj_id", "node_id"], "left")
    return found.select("subj_id", "node_id", F.coalesce("uhat", A.softmax(F.col("bu"))).alias("uhat"))


# ---------------------------------------------------------------- visible-unit machines


def completion_loss(
    rows: DataFrame, model: BinaryHidden, part: Column, n_parts: int, visible: str = "u", loss: str = "abserr"
) -> DataFrame:
    """Loss of reconstructing each partition from the others (its own set to 0.5).

    ``rows``: ``subj_id, node_id, u``.  Location partitions are hidden in turn;
    the hidden units are sums over locations, so every turn is one aggregate.
    """
    out = None
    base = rows.join(model.weights, "node_id").withColumn("_part", part)
    for j in range(n_parts):
        masked = base.withColumn(
            "_m", F.when(F.col("_part") == j, F.transform(visible, lambda x: F.lit(0.5))).otherwise(F.col(visible))
        )
        hidden = hidden_probability(masked, model, "_m")
        p = A.softmax(A.add(_field("eh", model), F.col("bu")))
        here = base.where(F.col("_part") == j).join(hidden, "subj_id").withColumn("_p", p)
        out_part = here.select(_loss(F.col(visible), F.col("_p"), loss).alias("l"))
        out = out_part if out is None else out.unionByName(out_part)
    return out.agg(F.sum("l").alias("loss"))


def _loss(v: Column, p: Column, loss: str) -> Column:
    if loss == "abserr":
        return A.total(F.zip_with(v, p, lambda x, y: F.abs(x - y)))
    return A.total(F.zip_with(v, p, lambda x, y: x * F.log(y) + (1 - x) * F.log(1 - y)))


def baseline_loss(rows: DataFrame, k: int, visible: str = "u", loss: str = "abserr") -> DataFrame:
    """Loss of predicting every location by the overall mean of each parcel."""
    mean = rows.agg(F.array(*[F.avg(F.col(visible)[i]) for i in range(k)]).alias("m"))
    both = rows.withColumn("_p", mean.select("m").scalar())
    return both.select(_loss(F.col(visible), F.col("_p"), loss).alias("l")).agg(F.sum("l").alias("loss"))

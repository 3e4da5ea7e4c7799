"""Potts models: parcels that prefer equal neighbours.

Chains are kept side by side: a node's row holds its label in every chain, so
a sweep joins nodes with edges once, however many chains run.  Nodes of one
colour have no links among themselves and are drawn together, which is a valid
order of Gibbs updates and needs one join per colour instead of one step per
node.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import randoms
from tessera.session import cut_lineage


@dataclass(frozen=True)
class PottsModel:
    """``edges``: ``src, dst, w`` in both directions; ``prior``: ``node_id, logpi``."""

    edges: DataFrame
    k: int
    prior: DataFrame
    theta: float = 1.0
    drop_last: bool = True

    def marginal(self) -> DataFrame:
        """Softmax of the local terms (the coupling is ignored)."""
        return self.prior.select("node_id", A.softmax(F.col("logpi")).alias("pi"))


def energy(model: PottsModel, states: DataFrame) -> DataFrame:
    """Log-likelihood of every chain up to a constant, and its two parts.

    ``states``: ``node_id, labels`` with one label per chain.
    """
    a = states.select(F.col("node_id").alias("src"), F.col("labels").alias("a"))
    b = states.select(F.col("node_id").alias("dst"), F.col("labels").alias("b"))
    linked = model.edges.join(a, "src").join(b, "dst")
    same = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    pair = linked.select(F.posexplode(same).alias("chain", "s"), "w").groupBy("chain").agg(F.sum(F.col("s") * F.col("w")).alias("phi"))
    local = states.join(model.prior, "node_id").select(
        F.posexplode(F.transform("labels", lambda u: F.col("logpi")[u])).alias("chain", "l")
    ).groupBy("chain").agg(F.sum("l").alias("local"))
    return pair.join(local, "chain", "full").select(
        "chain", F.coalesce("phi", F.lit(0.0)).alias("phi"), "local",
        (model.theta * F.coalesce("phi", F.lit(0.0)) + F.col("local")).alias("loglik"),
    )


def neighbour_counts(edges: DataFrame, states: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Number of neighbours per label of every node and chain: array (chains) of arrays (K)."""
    other = states.select(*keys, F.col("node_id").alias("dst"), "labels")
    rows = edges.where("w != 0").select("src", "dst").join(other, "dst").select(
        *keys, F.col("src").alias("node_id"), F.posexplode("labels").alias("chain", "u")
    )
    counts = rows.groupBy(*keys, "node_id", "chain").agg(
        F.array(*[F.sum(F.when(F.col("u") == i, 1.0).otherwise(0.0)) for i in range(k)]).alias("same")
    )
    return counts


def conditional(model: PottsModel, states: DataFrame, bias: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distribution of every node given its neighbours: ``node_id, chain, p``."""
    local = model.prior.select("node_id", F.col("logpi").alias("bias")) if bias is None else bias
    # Merge joins, as in the layouts: states and priors are as long as the nodes, however small Spark takes them.
    counts = neighbour_counts(model.edges.hint("merge"), states, model.k, keys)
    own = states.select(*keys, "node_id", F.posexplode("labels").alias("chain", "u"))
    rows = own.join(counts.hint("merge"), [*keys, "node_id", "chain"], "left").join(local.hint("merge"), [*keys, "node_id"])
    none = F.array_repeat(F.lit(0.0), model.k)
    score = F.zip_with(F.coalesce("same", none), "bias", lambda s, b: s * model.theta + b)
    return rows.select(*keys, "node_id", "chain", "u", A.softmax(score).alias("p"))


def start(prior: DataFrame, chains: int, seed, keys: tuple[str, ...] = (), column: str = "logpi") -> DataFrame:
    """First labels of every chain, drawn from the local terms alone."""
    ids = [F.col(c) for c in keys]
    p = prior.withColumn("_p", A.softmax(F.col(column)))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(chains - 1)),
        lambda c: randoms.pick_category(F.col("_p"), randoms.uniform(seed, *ids, F.col("node_id"), c)),
    )
    return p.select(*keys, "node_id", draws.alias("labels"))


def sweep(
    model: PottsModel, states: DataFrame, edges: DataFrame, n_colours: int, seed, bias: DataFrame | None = None,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """One Gibbs sweep: all nodes of a colour at once, colour after colour.

    ``states`` and ``edges`` carry the ``colour`` of their node (of ``src``).
    """
    ids = [F.col(c) for c in keys]
    local = model.prior.select("node_id", F.col("logpi").alias("bias")) if bias is None else bias
    none = F.array_repeat(F.lit(0.0), model.k)
    for c in range(n_colours):
        mine, rest = states.where(F.col("colour") == c), states.where(F.col("colour") != c)
        # Neighbours have other colours: counts need all states, updates go to this colour only.
        counts = neighbour_counts(edges.where(F.col("colour") == c), states, model.k, keys)
        own = mine.select(*keys, "node_id", F.posexplode("labels").alias("chain", "u"))
        rows = own.join(counts, [*keys, "node_id", "chain"], "left").join(local, [*keys, "node_id"])
        p = A.softmax(F.zip_with(F.coalesce("same", none), "bias", lambda s, b: s * model.theta + b))
        u = randoms.uniform(f"{seed}.{c}", *ids, F.col("node_id"), F.col("chain"))
        drawn = rows.select(*keys, "node_id", "chain", randoms.pick_category(p, u).alias("label"))
        ordered = F.array_sort(F.collect_list(F.struct("chain", "label")))  # one entry per chain
        new = drawn.groupBy(*keys, "node_id").agg(F.transform(ordered, lambda s: s["label"]).alias("labels"))
        states = rest.unionByName(new.withColumn("colour", F.lit(c)).select(rest.columns))
        if c < n_colours - 1:  # the next colour reads the states three times: the plan must not grow with the colours
            states = cut_lineage(states)
    return states


def gibbs(
    model: PottsModel, colours: DataFrame, n_colours: int, chains: int, sweeps: int, seed,
    states: DataFrame | None = None, bias: DataFrame | None = None, keys: tuple[str, ...] = (),
) -> DataFrame:
    """Several sweeps of several chains; ``bias`` (per key and node) replaces the prior."""
    if states is None:
        local = model.prior.select("node_id", F.col("logpi").alias("bias")) if bias is None else bias
        states = start(local, chains, seed, keys, "bias")
    # A node without links has no colour: it may be drawn with any.
    states = states.join(colours, "node_id", "left").select(
        *keys, "node_id", "labels", F.coalesce(F.col("colour"), F.lit(0)).cast("int").alias("colour"))
    if sweeps:
        states = cut_lineage(states)  # the first colour reads them three times, and first labels are drawn by hashes
    edges = model.edges.join(colours.select(F.col("node_id").alias("src"), "colour"), "src")
    edges = cut_lineage(edges.where("w != 0"))  # read by every colour of every sweep
    for i in range(sweeps):
        states = cut_lineage(sweep(model, states, edges, n_colours, f"{seed}.{i}", bias, keys))
    return states.select(*keys, "node_id", "labels")


def frequencies(states: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of chains in each label: the posterior estimate of every node."""
    def share_of(i):
        return F.size(F.filter("labels", lambda u: u == i)).cast("double") / F.size("labels")

    share = F.array(*[share_of(i) for i in range(k)])
    return states.select(*keys, "node_id", share.alias("uhat"))


def expected_agreement(edges: DataFrame, states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over chains of the weighted number of equal neighbours, per key."""
    a = states.select(*keys, F.col("node_id").alias("src"), F.col("labels").alias("a"))
    b = states.select(*keys, F.col("node_id").alias("dst"), F.col("labels").alias("b"))
    linked = edges.join(a, "src").join(b, [*keys, "dst"])
    same = A.total(F.zip_with("a", "b", lambda x, y: F.when(x == y, 1.0).otherwise(0.0))) / F.size("a")
    return linked.groupBy(*keys).agg(F.sum(same * F.col("w")).alias("phi"))


def _biased(scores: DataFrame, model: PottsModel) -> DataFrame:
    """Scores plus local terms; a node without a local term is an error."""
    rows = scores.join(model.prior, "node_id", "left")
    return rows.withColumn("bias", A.add(F.col("ll"), A.required(F.col("logpi"), "node without a prior")))


def posterior(model: PottsModel, scores: DataFrame, colours: DataFrame, n_colours: int, chains: int, sweeps: int, seed):
    """Positive phase: chains per subject given its evidence ``subj_id, node_id, ll``.

    Returns the posterior (``subj_id, node_id, uhat``) and the agreement per subject.
    """
    bias = _biased(scores, model).select("subj_id", "node_id", "bias")
    bias = cut_lineage(bias)  # read by every colour of every sweep
    states = gibbs(model, colours, n_colours, chains, sweeps, seed, bias=bias, keys=("subj_id",))
    return frequencies(states, model.k, ("subj_id",)), expected_agreement(model.edges, states, ("subj_id",))


def log_likelihood(model: PottsModel, uhat: DataFrame, agreement: DataFrame) -> DataFrame:
    """Unnormalised expected log-likelihood of the arrangement per subject."""
    rows = uhat.join(model.prior, "node_id")
    local = A.dot(F.col("uhat"), F.col("logpi"))
    if model.drop_last:
        z = F.log(A.total(F.transform("logpi", F.exp)))
        local = local - z
    sums = rows.groupBy("subj_id").agg(F.sum(local).alias("l"))
    phi = F.coalesce(F.col("phi"), F.lit(0.0))  # a subject without any link
    return sums.join(agreement, "subj_id", "left").select("subj_id", (model.theta * phi + F.col("l")).alias("ll_a"))


def gradient_step(
    model: PottsModel, uhat: DataFrame, agreement: DataFrame, neg_uhat: DataFrame, neg_agreement: float, step: float = 0.1,
    fit_theta: bool = True,
) -> PottsModel:
    """Move the local terms and the coupling along positive minus negative statistics."""
    k = model.k
    pos = uhat.groupBy("node_id").agg(F.array(*[F.avg(F.col("uhat")[i]) for i in range(k)]).alias("pos"))
    rows = model.prior.join(pos, "node_id").join(neg_uhat.withColumnRenamed("uhat", "neg"), "node_id")
    last = k - 1 if model.drop_last else k
    moved = [F.col("logpi")[i] + step * (F.col("pos")[i] - F.col("neg")[i]) if i < last else F.col("logpi")[i] for i in range(k)]
    prior = cut_lineage(rows.select("node_id", F.array(*moved).alias("logpi")))
    theta = model.theta
    if fit_theta:
        theta += step * (agreement.agg(F.avg("phi").alias("m")).first()["m"] - neg_agreement)
    return replace(model, prior=prior, theta=theta)


# ---------------------------------------------------------------- normaliser


def _pair_sums(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Weighted number of equal neighbours of every chain, each link counted once: ``chain, phi``."""
    a = states.select(F.col("node_id").alias("src"), F.col("labels").alias("a"))
    b = states.select(F.col("node_id").alias("dst"), F.col("labels").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    linked = edges.where("src < dst").join(a, "src").join(b, "dst")
    return linked.select(F.posexplode(same).alias("chain", "s"), "w").groupBy("chain").agg(F.sum(F.col("s") * F.col("w")).alias("phi"))


def annealed_weights(
    model: PottsModel, colours: DataFrame, n_colours: int, chains: int, temperatures: list[float], seed=0,
) -> DataFrame:
    """Log importance weights of annealed chains: ``chain, logw``.

    A chain starts from the local terms alone and takes one Gibbs sweep under each share of the coupling in
    ``temperatures``, which ascend to 1; before each sweep its weight grows by the raise of the share times the
    coupling of its state.  Draws are hashes of the keys.
    """
    if not temperatures or sorted(temperatures) != list(temperatures) or temperatures[-1] != 1.0:
        raise ValueError("temperatures ascend to 1")
    ids = F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain")
    spark = model.prior.sparkSession
    weights = spark.range(1).select(ids, F.lit(0.0).alias("logw"))
    states = cut_lineage(start(model.prior, chains, seed))
    before = 0.0
    for i, t in enumerate(temperatures):
        gain = _pair_sums(model.edges, states).select("chain", ((t - before) * model.theta * F.col("phi")).alias("gain"))
        weights = cut_lineage(weights.join(gain, "chain", "left").select(
            "chain", (F.col("logw") + F.coalesce("gain", F.lit(0.0))).alias("logw")))
        if i < len(temperatures) - 1:
            states = gibbs(replace(model, theta=model.theta * t), colours, n_colours, chains, 1, f"{seed}.{i}", states=states)
        before = t
    return weights


def log_normaliser(
    model: PottsModel, colours: DataFrame, n_colours: int, chains: int, temperatures: list[float], seed=0,
) -> DataFrame:
    """Estimate of the log of the sum over all states of exp(theta * equal links + local terms): ``log_z`` and ``ess``, the
    number of equally weighted chains that the weights are worth."""
    weights = annealed_weights(model, colours, n_colours, chains, temperatures, seed)
    free = F.array_max("logpi") + F.log(A.total(F.transform("logpi", lambda x: F.exp(x - F.array_max("logpi")))))
    local = model.prior.agg(F.sum(free).alias("l")).scalar()
    top = weights.agg(F.max("logw").alias("m")).scalar()
    e = F.exp(F.col("logw") - top)
    return weights.agg(
        (F.log(F.avg(e)) + F.max(top) + F.max(local)).alias("log_z"), (F.sum(e) * F.sum(e) / F.sum(e * e)).alias("ess"))


# ---------------------------------------------------------------- exact inference


def pair_posterior(a: Column, b: Column, theta: float) -> Column:
    """Posterior of two linked nodes, or of the only one of them that is there (the other has none)."""
    alone = F.struct(
        F.when(a.isNotNull(), A.softmax(a)).alias("u1"), F.when(b.isNotNull(), A.softmax(b)).alias("u2"),
        F.lit(None).cast("double").alias("agree"),
    )
    return F.when(a.isNotNull() & b.isNotNull(), duo_posterior(a, b, theta)).otherwise(alone)


def duo_posterior(a: Column, b: Column, theta: float) -> Column:
    """Posterior of two linked nodes from their scores (evidence plus prior).

    Struct of ``u1``, ``u2`` (K each) and ``agree`` (probability of equal labels).
    """
    shift = F.array_max(a) + F.array_max(b) + max(theta, 0.0)
    joint = F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.exp(x + y + F.when(i == j, theta).otherwise(0.0) - shift)))

    def finish(w):
        z = A.total(F.transform(w, A.total))
        diag = A.total(F.transform(w, lambda row, i: row[i]))
        first = F.transform(w, A.total)
        second = F.transform(b, lambda y, j: A.total(F.transform(w, lambda row: row[j])))
        return A.let(
            z, lambda t: F.struct(
                F.transform(first, lambda x: x / t).alias("u1"), F.transform(second, lambda x: x / t).alias("u2"),
                (diag / t).alias("agree"),
            )
        )

    return A.let(joint, finish)


def enumerate_field(groups: DataFrame, positions: int, k: int, links: list[tuple[int, int]], theta: float, keys: list[str]) -> DataFrame:
    """Exact marginals of small fields by visiting all K^positions states.

    ``groups``: keys and ``score``, an array (positions) of arrays (K).  A
    position whose score is NULL is not there: it has no links and no result.
    Serves to check approximate inference; the number of states must stay small.
    """
    states = F.explode(F.sequence(F.lit(0), F.lit(k**positions - 1)))
    rows = groups.select(*keys, "score", states.alias("state"))
    digit = [F.floor(F.col("state") / k**p).cast("int") % k for p in range(positions)]
    part = [F.coalesce(F.col("score")[p][digit[p]], F.lit(0.0)) for p in range(positions)]
    there = [F.col("score")[p].isNotNull() for p in range(positions)]
    value = sum(part[1:], part[0])
    for i, j in links:
        value = value + F.when((digit[i] == digit[j]) & there[i] & there[j], theta).otherwise(0.0)
    scored = rows.select(*keys, "state", value.alias("v"), F.array(*there).alias("there"))
    top = scored.groupBy(*keys).agg(F.max("v").alias("m"), F.min("there").alias("there"))
    weight = scored.join(top, keys).select(*keys, "state", F.exp(F.col("v") - F.col("m")).alias("e"))
    sums = weight.groupBy(*keys).agg(
        F.sum("e").alias("z"),
        *[F.sum(F.when(digit[p] == i, F.col("e")).otherwise(0.0)).alias(f"s{p}_{i}") for p in range(positions) for i in range(k)],
    )
    marg = F.array(*[F.array(*[F.col(f"s{p}_{i}") / F.col("z") for i in range(k)]) for p in range(positions)])
    out = sums.join(top.select(*keys, "there"), keys).select(*keys, "there", F.posexplode(marg).alias("position", "uhat"))
    return out.where(F.col("there")[F.col("position")]).drop("there")


def chain_posterior(scores: DataFrame, k: int, theta: float, block: int = 256) -> DataFrame:
    """Exact posterior of a chain of nodes per subject, and expected agreement.

    ``scores``: ``subj_id, node_id, logq`` (evidence plus prior), nodes numbered
    along the chain.  A chain is cut into blocks.  Every block is reduced to one
    K x K transfer matrix, the short list of matrices of a subject gives the
    messages at all block borders, and then each block finishes on its own.  No
    task ever sees a whole chain; with ``block`` near the square root of its
    length both levels stay equally small.

    Returns ``subj_id, node_id, uhat, agree``; ``agree`` is the probability
    that the node equals its predecessor (NULL for the first).
    """
    rows = scores.select("subj_id", F.floor(F.col("node_id") / block).alias("block"), "node_id", "logq")
    coupling = np.exp(theta * np.eye(k))

    def local(pdf):
        pdf = pdf.sort_values("node_id")
        q = np.array(pdf["logq"].tolist())
        return pdf, np.exp(q - q.max(axis=1, keepdims=True))

    def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, e = local(pdf)
        m, opening = np.eye(k), None
        for row in e:
            m = (m @ coupling) * row
            m /= m.sum()
            opening = row if opening is None else (opening @ coupling) * row
            opening = opening / opening.sum()
        head = pdf.iloc[0]
        return pd.DataFrame({"subj_id": [head["subj_id"]], "block": [head["block"]], "m": [m.ravel().tolist()], "o": [opening.tolist()]})

    transfer = rows.groupBy("subj_id", "block").applyInPandas(
        matrices, "subj_id long, block long, m array<double>, o array<double>"
    )

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        ms = [np.array(m).reshape(k, k) for m in pdf["m"]]
        before, after, f, g = [], [], np.array(pdf["o"].iloc[0]), np.ones(k)
        for b in range(len(ms)):
            before.append([] if b == 0 else f.tolist())
            if b:
                f = f @ ms[b]
                f = f / f.sum()
        for m in reversed(ms):
            after.append(g.tolist())
            g = m @ g
            g = g / g.sum()
        return pd.DataFrame({"subj_id": pdf["subj_id"], "block": pdf["block"], "f": before, "g": after[::-1]})

    ends = transfer.groupBy("subj_id").applyInPandas(borders, "subj_id long, block long, f array<double>, g array<double>")

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, e = local(left)
        f0, n = np.array(right["f"].iloc[0]), len(e)
        fwd, bwd, agree = np.empty((n, k)), np.empty((n, k)), np.full(n, np.nan)
        prev = f0 if len(f0) else None
        for i in range(n):
            m = e[i] if prev is None else (prev @ coupling) * e[i]
            prev = fwd[i] = m / m.sum()
        message = np.array(right["g"].iloc[0])
        for i in range(n - 1, -1, -1):
            bwd[i] = message / message.sum()
            message = coupling @ (e[i] * bwd[i])
        u = fwd * bwd
        for i in range(n):
            prev = fwd[i - 1] if i else (f0 if len(f0) else None)
            if prev is not None:
                joint = prev[:, None] * coupling * (e[i] * bwd[i])
                agree[i] = np.trace(joint) / joint.sum()
        u /= u.sum(axis=1, keepdims=True)
        return pd.DataFrame({"subj_id": left["subj_id"], "node_id": left["node_id"], "uhat": u.tolist(), "agree": agree})

    out = rows.groupBy("subj_id", "block").cogroup(ends.groupBy("subj_id", "block")).applyInPandas(
        finish, "subj_id long, node_id long, uhat array<double>, agree double"
    )
    present = F.when(~F.isnan("agree"), F.col("agree")).alias("agree")
    return out.select("subj_id", "node_id", "uhat", present)


def mean_field(model: PottsModel, scores: DataFrame, colours: DataFrame, n_colours: int, iterations: int) -> DataFrame:
    """Mean-field posterior per subject: ``subj_id, node_id, uhat``.

    Each node takes the coupled mean of its neighbours; nodes of one colour
    are updated together.
    """
    base = _biased(scores, model).join(colours, "node_id", "left").select(
        "subj_id", "node_id", F.coalesce(F.col("colour"), F.lit(0)).alias("colour"), "bias"
    )
    state = base.withColumn("uhat", A.softmax(F.col("bias")))
    k = model.k
    for _ in range(iterations):
        for c in range(n_colours):
            other = state.select("subj_id", F.col("node_id").alias("dst"), F.col("uhat").alias("v"))
            own = state.where(F.col("colour") == c).select(F.col("node_id").alias("src")).distinct()
            field = model.edges.join(own, "src", "left_semi").join(other, "dst").groupBy("subj_id", F.col("src").alias("node_id")).agg(
                F.array(*[F.sum(F.col("w") * F.col("v")[i]) for i in range(k)]).alias("field")
            )
            none = F.array_repeat(F.lit(0.0), k)
            new = A.softmax(F.zip_with("bias", F.coalesce("field", none), lambda b, f: b + model.theta * f))
            state = state.join(field, ["subj_id", "node_id"], "left").select(
                "subj_id", "node_id", "colour", "bias", F.when(F.col("colour") == c, new).otherwise(F.col("uhat")).alias("uhat")
            )
            state = cut_lineage(state)
    return state.select("subj_id", "node_id", "uhat")

"""Stochastic maximum likelihood for priors with a negative phase.

Mini-batches of subjects move the prior; the emission models are updated from
the posteriors of all subjects once per round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import randoms
from tessera.operators import boltzmann, forest, mixture, potts, sampling
from tessera.operators import emissions as em
from tessera.operators.priors import IndependentPrior
from tessera.session import cut_lineage


def largest_proper_divisor(n: int) -> int | None:
    """Largest divisor below ``n``; None for 1."""
    return next((d for d in range(n // 2, 0, -1) if n % d == 0), None)


def batches_of_subjects(scores: DataFrame, n_batches: int, seed) -> DataFrame:
    """``subj_id, batch``: subjects spread over batches by a hash, without sorting them."""
    batch = F.floor(randoms.uniform(seed, F.col("subj_id")) * n_batches).cast("int")
    return scores.select("subj_id").distinct().select("subj_id", batch.alias("batch"))


@dataclass
class StochasticFit:
    prior: boltzmann.SparseHidden
    emissions: tuple[em.Emission, ...]
    trace: list[tuple[float, float]]
    posterior: DataFrame
    theta: list[tuple[float, ...]]


def emission_evidence(emission: em.Emission, parts=None) -> Callable[[DataFrame, str], DataFrame]:
    """Draws data for chain labels from an emission model and scores them again."""

    def evidence(states: DataFrame, seed: str) -> DataFrame:
        rows = states.select("subj_id", F.col("node_id").alias("vox_id"), "label")
        y = sampling.draw(rows, emission, seed)
        ev = y.select("subj_id", "vox_id", F.lit(1.0).alias("num_part"), "y")
        return mixture.loglik(ev, emission).withColumnRenamed("vox_id", "node_id")

    return evidence


def fit_sml(
    prior: boltzmann.SparseHidden, emissions: tuple[em.Emission, ...], aligned: mixture.Aligned, rounds: int,
    batch_size: int | None = None, rate: float = 0.8, mean_field_iterations: int = 5, chain_steps: int = 2,
    fit_prior: bool = True, fit_emission: bool = True, first_evidence: bool = True, with_evidence: bool = True, seed=0,
) -> StochasticFit:
    """Alternate mini-batch steps of the prior with M-steps of the emissions.

    Each batch runs its positive phase (mean field) and its own persistent
    chains, one per subject.  The trace holds the negative cross-entropy
    between both phases and the expected emission log-likelihood.
    """
    chains = None
    trace, thetas = [], []
    k = prior.k
    uhat = None
    for r in range(rounds):
        thetas.append(prior.theta)
        model = mixture.Model(IndependentPrior(k), emissions)
        scores = mixture.scores(aligned, model).withColumnRenamed("vox_id", "node_id")
        if r == 0 and not first_evidence:
            scores = scores.withColumn("ll", F.transform("ll", lambda x: F.lit(0.0)))
        scores = cut_lineage(scores)
        entropy = 0.0
        if fit_prior:
            n_subjects = scores.select("subj_id").distinct().count()
            n_batches = -(-n_subjects // (batch_size or largest_proper_divisor(n_subjects) or 1))
            batch = cut_lineage(batches_of_subjects(scores, n_batches, f"{seed}.{r}"))
            if chains is None:
                # One persistent chain per subject, drawn from the biases.
                ids = scores.select("subj_id", "node_id").join(prior.marginal(), "node_id")
                u = randoms.uniform(f"{seed}.chains", F.col("subj_id"), F.col("node_id"))
                chains = cut_lineage(ids.select("subj_id", "node_id", randoms.pick_category(F.col("pi"), u).alias("label")))
            present = sorted(x["batch"] for x in batch.select("batch").distinct().collect())
            evidence = emission_evidence(emissions[0]) if with_evidence else None
            for b in present:
                mine = batch.where(F.col("batch") == b).select("subj_id")
                pos, hid = boltzmann.sparse_mean_field(scores.join(mine, "subj_id", "left_semi"), prior, mean_field_iterations)
                own = chains.join(mine, "subj_id", "left_semi")
                neg, neg_hid = boltzmann.sparse_negative_phase(own, prior, chain_steps, f"{seed}.{r}.{b}", evidence)
                prior = boltzmann.sparse_step(prior, pos, hid, neg, neg_hid, rate)
                moved = neg.select("subj_id", "node_id", "label")
                chains = cut_lineage(chains.join(mine, "subj_id", "left_anti").unionByName(moved))
                if b == present[-1]:
                    q = neg.select("subj_id", "node_id", F.col("pu").alias("q"))
                    both = pos.join(q, ["subj_id", "node_id"])
                    term = A.total(F.zip_with("uhat", "q", lambda x, y: x * F.when(y > 0, F.log(y)).otherwise(0.0)))
                    entropy = both.agg(F.sum(term).alias("c")).first()["c"]
        uhat, _ = boltzmann.sparse_mean_field(scores, prior, mean_field_iterations)
        uhat = cut_lineage(uhat)
        ll_e = uhat.join(scores, ["subj_id", "node_id"]).agg(F.sum(A.dot(F.col("uhat"), F.col("ll"))).alias("l")).first()["l"]
        trace.append((float(entropy), float(ll_e)))
        if r == rounds - 1:
            break
        if fit_emission:
            emissions = mixture.m_step(aligned, model, uhat.withColumnRenamed("node_id", "vox_id")).emissions
    return StochasticFit(prior, emissions, trace, uhat.withColumnRenamed("node_id", "vox_id"), thetas)


@dataclass
class PottsFit:
    """``chains``: the persistent labels, ``node_id, labels``; ``theta``: the coupling of every round, the last one's step
    included; ``trace``: mean expected log-likelihood of the arrangement before each step."""

    model: potts.PottsModel
    chains: DataFrame
    theta: list[float]
    trace: list[float]
    posterior: DataFrame


#: (model, scores, seed) to the posterior ``subj_id, node_id, uhat`` and the agreement ``subj_id, phi``.
PositivePhase = Callable[[potts.PottsModel, DataFrame, str], tuple[DataFrame, DataFrame]]


def sampled_phase(colours: DataFrame, n_colours: int, chains: int = 20, sweeps: int = 5) -> PositivePhase:
    """Positive phase of a Potts model by chains of each subject."""
    return lambda model, scores, seed: potts.posterior(model, scores, colours, n_colours, chains, sweeps, seed)


def exact_phase(edges: DataFrame) -> PositivePhase:
    """Exact positive phase on a forest; which nodes are removed when is decided once."""
    rounds = forest.schedule(edges)

    def phase(model: potts.PottsModel, scores: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
        uhat, links = forest.infer(model, scores, rounds)
        return uhat, forest.agreement(links)

    return phase


def fit_potts_sml(
    model: potts.PottsModel, scores: DataFrame, positive: PositivePhase, colours: DataFrame, n_colours: int, rounds: int,
    chains: int = 20, sweeps: int = 5, rate: float = 0.1, fit_theta: bool = True, seed=0,
) -> PottsFit:
    """Stochastic maximum likelihood of a Potts prior for given evidence ``subj_id, node_id, ll``.

    Every round has a positive phase, given the evidence, and ``sweeps`` sweeps of persistent chains without it; local
    terms and coupling move by ``rate`` times the difference of both phases' means.  The chains go on where the round
    before left them, under the new parameters.  Every round's chains and prior are checkpointed under new names, and
    draws are hashes of round and keys, so that a lost task repeats them.
    """
    scores = cut_lineage(scores.select("subj_id", "node_id", "ll"))
    # Every sweep of every round reads the layout and the local terms: what they were made of is read once.
    model = replace(model, edges=cut_lineage(model.edges), prior=cut_lineage(model.prior))
    colours = cut_lineage(colours)
    states, uhat = None, None
    thetas, trace = [float(model.theta)], []
    for r in range(rounds):
        uhat, agreement = positive(model, scores, f"{seed}.{r}.pos")
        uhat, agreement = cut_lineage(uhat), cut_lineage(agreement)
        states = potts.gibbs(model, colours, n_colours, chains, sweeps, f"{seed}.{r}.neg", states=states)
        drawn = potts.expected_agreement(model.edges, states).first()
        ll = potts.log_likelihood(model, uhat, agreement).agg(F.avg("ll_a").alias("l")).first()["l"]
        trace.append(float(ll))
        model = potts.gradient_step(
            model, uhat, agreement, potts.frequencies(states, model.k), drawn["phi"] if drawn else 0.0, rate, fit_theta)
        thetas.append(float(model.theta))
    return PottsFit(model, states, thetas, trace, uhat)


def individual_maps(
    prior, evidence: list[DataFrame], emissions: tuple[em.Emission, ...], n_iter: int = 200, fit_prior: bool = False,
    fit_emission=True, rate: float = 0.5,
):
    """Subject parcellations under a given group prior (frozen unless asked otherwise).

    An independent prior is fitted by EM without evidence in the first pass, a
    Boltzmann prior by stochastic maximum likelihood of the emissions.
    """
    if isinstance(prior, boltzmann.SparseHidden):
        fit = fit_sml(prior, emissions, mixture.align(evidence), n_iter, rate=rate, fit_prior=fit_prior, fit_emission=bool(fit_emission))
        return fit.posterior, fit
    model = mixture.Model(prior, emissions)
    fit = mixture.fit_em(
        model, mixture.align(evidence, prior), n_iter, 0.01, fit_emission=fit_emission, fit_prior=fit_prior, first_evidence=False
    )
    return fit.posterior(), fit



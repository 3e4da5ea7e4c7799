"""Cross-validation over subjects and over partitions of locations."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import batches
from tessera.operators import mixture
from tessera.operators.prediction import KINDS, cosine_error, harden, mean_abs_error, mean_log_evidence
from tessera.operators.mixture import MAX_HELD_SUMS
from tessera.operators.reduce import join_hot, sum_by_key
from tessera.session import cut_lineage


def _subject_sums(rows: DataFrame, width: int, k: int, weight: Callable, kind: str) -> DataFrame:
    """Weighted data sums per subject: rows ``subj_id, m, c0..`` for every condition m.

    ``weight`` gives the factor of each location from its length.  The row with
    m = -1 holds the squared lengths in ``c0`` and the number of locations in
    ``c1``.  Each task adds up its rows per subject first, so a subject with
    very many locations stays cheap to shuffle.
    """
    cols = [f"c{j}" for j in range(max(k, 2))]

    def emit(acc):
        m = np.append(np.arange(width), -1)
        stacked = np.vstack(list(acc.values()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(list(acc), width + 1)), pa.array(np.tile(m, len(acc)))]
            + [pa.array(stacked[:, j]) for j in range(len(cols))],
            names=["subj_id", "m", *cols],
        )

    def run(it):
        acc: dict[int, np.ndarray] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            y = batches.matrix(batch.column(names.index("y")), width)
            u = batches.matrix(batch.column(names.index("uhat")), k)
            u = harden(u) if kind == "hard" else u
            length = np.sqrt((y * y).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                w = weight(length)
            yw = np.nan_to_num(y * w[:, None])
            ok = np.isfinite(length * w)
            subj = batch.column(names.index("subj_id")).to_numpy()
            for s, mine in batches.groups(subj):
                block = np.zeros((width + 1, len(cols)))
                block[:width, :k] = yw[mine].T @ u[mine]
                block[width, :2] = np.nansum(length[mine] ** 2), ok[mine].sum()
                acc[s] = acc.get(s, 0) + block
            if len(acc) * (width + 1) > MAX_HELD_SUMS:
                yield emit(acc)
                acc = {}
        if acc:
            yield emit(acc)

    schema = "subj_id long, m long, " + ", ".join(f"{c} double" for c in cols)
    parts = rows.select("subj_id", "y", "uhat").mapInArrow(run, schema)
    return parts.groupBy("subj_id", "m").agg(*[F.sum(c).alias(c) for c in cols])


def _directions_without(stats: DataFrame, k: int) -> DataFrame:
    """Unit directions from everyone but the subject: ``subj_id, m, v0..``.

    Total sums minus the subject's own, then scaled to unit length per parcel.
    """
    sums = stats.where("m >= 0")
    total = sums.groupBy("m").agg(*[F.sum(f"c{j}").alias(f"t{j}") for j in range(k)])
    rest = sums.join(total, "m").select(
        "subj_id", "m", *[(F.col(f"t{j}") - F.col(f"c{j}")).alias(f"r{j}") for j in range(k)]
    )
    lengths = rest.groupBy("subj_id").agg(
        *[F.sqrt(F.sum(F.col(f"r{j}") * F.col(f"r{j}"))).alias(f"l{j}") for j in range(k)]
    )
    return rest.join(lengths, "subj_id").select(
        "subj_id", "m", *[F.try_divide(F.col(f"r{j}"), F.col(f"l{j}")).alias(f"v{j}") for j in range(k)]
    )


def leave_one_subject_out(
    fit_rows: DataFrame, eval_rows: Mapping[str, DataFrame], width: int, k: int,
    kind: str = "expected", adjusted: bool = True,
) -> DataFrame:
    """Test error of each parcellation with directions from the other subjects.

    ``fit_rows`` carries normalised evidence with individual posteriors; the
    directions without subject s are the overall sums minus those of s, so all
    folds share one pass.  ``eval_rows`` names the parcellations to compare,
    each ``subj_id, y, uhat``.  For hard and expected predictions the error is
    linear in the directions and needs only sums per subject; the average
    prediction is rescaled per location, so the directions join the rows.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of cosine error {kind}")
    # Subjects x conditions x parcels numbers: written out once, then read by every parcellation.
    stats = cut_lineage(_subject_sums(fit_rows, width, k, np.ones_like, "soft"))
    v = _directions_without(stats, k)
    out = None
    for name, rows in eval_rows.items():
        if kind == "average":
            part = _average_errors(rows, v, width, k, adjusted)
        else:
            weight = (lambda n: n) if adjusted else (lambda n: 1 / n)
            sums = _subject_sums(rows, width, k, weight, kind)
            fit = sum((F.col(f"c{j}") * F.col(f"v{j}") for j in range(1, k)), F.col("c0") * F.col("v0"))
            size = F.col("c0") if adjusted else F.col("c1")
            part = sums.join(v, ["subj_id", "m"], "left").groupBy("subj_id").agg(
                F.sum(F.when(F.col("m") >= 0, fit)).alias("fit"), F.sum(F.when(F.col("m") < 0, size)).alias("size")
            ).select("subj_id", F.try_divide(F.col("size") - F.col("fit"), F.col("size")).alias("error"))
        part = part.select(F.lit(name).alias("parcellation"), "subj_id", "error")
        out = part if out is None else out.unionByName(part)
    return out


def _average_errors(rows: DataFrame, v: DataFrame, width: int, k: int, adjusted: bool) -> DataFrame:
    def values(batch):
        cols = batch.schema.names
        y = batches.matrix(batch.column(cols.index("y")), width)
        u = batches.matrix(batch.column(cols.index("uhat")), k)
        vs = batches.matrix(batch.column(cols.index("v")), width * k).reshape(-1, width, k)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.einsum("nmk,nk->nm", vs, u)
            p = p / np.sqrt((p * p).sum(axis=1, keepdims=True))
            n2 = (y * y).sum(axis=1)
            n = np.sqrt(n2)
            fit = (p * y).sum(axis=1)
            if adjusted:
                return np.nan_to_num(np.column_stack([n2 - fit * n, n2]))
            e = 1 - fit / n
        return np.column_stack([np.nan_to_num(e), ~np.isnan(e)])

    ordered = F.array_sort(F.collect_list(F.struct("m", F.array(*[f"v{j}" for j in range(k)]).alias("r"))))
    flat = v.groupBy("subj_id").agg(F.flatten(F.transform(ordered, lambda s: s["r"])).alias("v"))  # width rows each
    met = join_hot(rows, flat, "subj_id", F.col("y"), "inner")
    sums = sum_by_key(met.select("subj_id", "y", "uhat", "v"), "subj_id", ["num", "den"], values)
    return sums.select("subj_id", F.try_divide("num", "den").alias("error"))


def leave_one_subject_out_refit(
    model: mixture.Model, evidence: DataFrame, eval_rows: Mapping[str, DataFrame], subjects: Sequence[int],
    max_iter: int = 200, tol: float = 0.1, kind: str = "expected", adjusted: bool = True, with_floor: bool = False,
    folds_per_pass: int = 32,
) -> DataFrame:
    """Test error with the emission model refitted (prior frozen) without each subject.

    Every fold starts from the given parameters.  Several folds share each pass
    over the data, as many as their parameters fit side by side.
    ``with_floor`` adds the parcellation from the test subject's own likelihood.
    """
    out = None
    aligned = mixture.align([evidence])
    for lo in range(0, len(subjects), folds_per_pass):
        chunk = list(subjects[lo:lo + folds_per_pass])
        fits = mixture.fit_em_folds(model, aligned, chunk, max_iter, tol)
        emissions = {s: f.model.emissions[0] for s, f in zip(chunk, fits)}
        directions = {s: e.v for s, e in emissions.items()}
        test = {name: rows.where(F.col("subj_id").isin(chunk)) for name, rows in eval_rows.items()}
        if with_floor:
            test["floor"] = _own_likelihood(evidence.where(F.col("subj_id").isin(chunk)), emissions)
        for name, rows in test.items():
            e = cosine_error(rows, directions, kind, adjusted)
            part = e.select(F.lit(name).alias("parcellation"), "subj_id", F.col("cosine_error").alias("error"))
            out = part if out is None else out.unionByName(part)
    return out


def _own_likelihood(rows: DataFrame, emissions: Mapping[int, mixture.em.Emission]) -> DataFrame:
    """``subj_id, y, uhat``: the softmax of each subject's likelihood under its own fold's model."""

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            subj = batch.column(names.index("subj_id")).to_numpy()
            first = next(iter(emissions.values()))
            y = batches.matrix(batch.column(names.index("y")), first.width)
            n = batches.vector(batch.column(names.index("num_part")), 0.0)
            u = np.empty((len(y), first.n_parcels))
            for s, mine in batches.groups(subj):
                u[mine] = batches.softmax_rows(emissions[s].loglik(y[mine], n[mine]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("subj_id")), batch.column(names.index("y")), batches.list_array(u)],
                names=["subj_id", "y", "uhat"],
            )

    return rows.select("subj_id", "y", "num_part").mapInArrow(run, "subj_id long, y array<double>, uhat array<double>")


def completion(
    scores: DataFrame, part: Column, infer: Callable[[DataFrame], DataFrame], n_parts: int
) -> DataFrame:
    """Posterior of every location when the evidence of its own partition is hidden.

    ``scores``: ``subj_id, vox_id, ll``; ``infer`` maps such a table to
    ``subj_id, vox_id, uhat``.  One inference per partition; its locations
    keep the result.
    """
    out = None
    for j in range(n_parts):
        hidden = scores.withColumn("ll", F.when(part == j, F.transform("ll", lambda x: F.lit(0.0))).otherwise(F.col("ll")))
        here = infer(hidden).where(part == j)
        out = here if out is None else out.unionByName(here)
    return out


def completion_independent(scores: DataFrame, prior: mixture.IndependentPrior) -> DataFrame:
    """The same for an independent prior: a hidden location just has its prior."""
    pi = prior.marginal_full().withColumnRenamed("pi", "uhat")
    return scores.select("subj_id", "vox_id").join(pi, "vox_id")


CRITERIA = ("logpY", "u_abserr", "cos_err", "Ecos_err")


def evaluate(rows: DataFrame, criterion: str, v: np.ndarray | None = None) -> float:
    """One number for a parcellation on new data, averaged over subjects.

    ``rows`` holds ``uhat`` and, as the criterion needs, ``ll`` (logpY), true
    indicators ``u`` (u_abserr), or ``subj_id, y`` (hard or expected cosine
    error).
    """
    if criterion == "logpY":
        return mean_log_evidence(rows).first()["logpy"]
    if criterion == "u_abserr":
        return mean_abs_error(rows).first()["u_abserr"]
    if criterion in ("cos_err", "Ecos_err"):
        kind = "hard" if criterion == "cos_err" else "expected"
        return cosine_error(rows, v, kind).agg(F.avg("cosine_error").alias("e")).first()["e"]
    raise ValueError(f"unknown criterion {criterion}, use one of {CRITERIA}")

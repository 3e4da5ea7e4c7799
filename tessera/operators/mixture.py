"""Inference and learning for fused mixture models.

All datasets of a subject are first aligned to one row per (subject, node), so
that adding their evidence needs no shuffle later.  One pass over the aligned
rows then scores every emission model, applies the prior, and emits per-task
sums of all sufficient statistics.  Only those sums are shuffled; parameters
return to the driver as K x M numbers, and a per-node prior stays a table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import batches, special
from tessera.functions.batches import log_softmax_rows, softmax_rows
from tessera.operators import emissions as em
from tessera.operators.priors import IndependentPrior, drop_redundant, log_prob
from tessera.operators.reduce import join_hot
from tessera.session import cut_lineage

# Rows of one node that may share a task before the node is split (salted).
ROWS_PER_SALT = 50_000
# Sums a task holds before it hands them on; only per-subject sums get that many.
MAX_HELD_SUMS = 100_000


@dataclass(frozen=True)
class Slot:
    """One response vector of an aligned row: a dataset seen on one side."""

    dataset: int
    side: int = 0

    @property
    def name(self):
        return f"{self.dataset}_{self.side}"


@dataclass(frozen=True)
class Aligned:
    df: DataFrame
    slots: tuple[Slot, ...]
    sided: bool = False
    grouped: bool = False  # one row per subject and node is certain


@dataclass(frozen=True)
class Model:
    """A prior and one emission model per dataset."""

    prior: IndependentPrior
    emissions: tuple[em.Emission, ...]
    weights: tuple[float, ...] | None = None
    # Per dataset: table (subj_id, kappa array) for subject-specific concentrations.
    subject_kappa: tuple[DataFrame | None, ...] | None = None

    def weight(self, d: int) -> float:
        return 1.0 if self.weights is None else self.weights[d]

    def kappa_table(self, d: int) -> DataFrame | None:
        return None if self.subject_kappa is None else self.subject_kappa[d]


@dataclass
class FitResult:
    """Outcome of learning; ``posterior()`` is lazy."""

    model: Model
    trace: list[tuple[float, float]]
    history: list[Model]
    _inference: tuple = field(repr=False, default=())
    first_traces: list[list[float]] | None = None

    @property
    def loglik(self) -> list[float]:
        return [a + e for a, e in self.trace]

    def posterior(self) -> DataFrame:
        """Posterior of the last inference pass (after a rollback: of the rejected parameters)."""
        aligned, model, gates = self._inference
        return posterior(aligned, model, gates)

    def trace_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(a), float(e)) for i, (a, e) in enumerate(self.trace)]
        return spark.createDataFrame(rows, "iter int, ll_a double, ll_e double")


# ---------------------------------------------------------------- alignment


def map_subjects(evidence: DataFrame, subject_map: DataFrame | None) -> DataFrame:
    """Replace dataset-local subject numbers by overall ones."""
    if subject_map is None:
        return evidence
    rows = subject_map.select(F.col("local_subj").alias("subj_id"), F.col("subj_id").alias("_subj"))
    subject = A.required(F.col("_subj"), "subject without an entry in the subject map")
    return evidence.join(rows, "subj_id", "left").withColumn("subj_id", subject).drop("_subj")


def _reject_repeats(rows: DataFrame) -> None:
    """Stop if a subject has several rows at a node; ``rows`` are kept, so only their keys are read and shuffled."""
    twice = rows.groupBy("subj_id", "node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['n']} rows of subject {twice['subj_id']} at location {twice['node_id']}")


def _only(value: Column, dataset: int) -> Column:
    """The one non-NULL value of a group; an error if there are several."""
    n = F.count(value)
    message = F.concat(n.cast("string"), F.lit(f" rows of a subject at one location in dataset {dataset}"))
    return F.when(n > 1, F.raise_error(message)).otherwise(F.first(value, ignorenulls=True))


def align(evidence: Sequence[DataFrame], prior: IndependentPrior | None = None) -> Aligned:
    """One row per (subject, node) with the evidence of all datasets side by side.

    A subject that is absent from a dataset has NULLs there, which add nothing.
    With one dataset and no layout this is only a projection, which streams may
    take as well.  Nothing is run here.  Repeated rows of a dataset, subject and
    location are an error: where rows are grouped, when the plan runs; for one
    dataset, when a model is learned from them (each is scored by itself).
    """
    layout = prior.layout if prior is not None else None
    if layout is None and len(evidence) == 1:
        df = evidence[0].select(
            F.col("subj_id").cast("long").alias("subj_id"), F.col("vox_id").cast("long").alias("node_id"),
            F.col("num_part").cast("double").alias("n0_0"), F.col("y").alias("y0_0"),
        )
        return Aligned(df, (Slot(0),))
    rows = None
    for d, e in enumerate(evidence):
        ids = [F.col(c).cast("long").alias(c) for c in ("subj_id", "vox_id")]
        part = e.select(F.lit(d).alias("_d"), *ids, F.col("num_part").cast("double").alias("num_part"), "y")
        rows = part if rows is None else rows.unionByName(part)
    if layout is None:
        rows = rows.withColumn("node_id", F.col("vox_id")).withColumn("side", F.lit(0))
    else:
        place = layout.table.withColumnRenamed("node_id", "_node")
        rows = rows.join(place, "vox_id", "left").withColumn(
            "node_id", A.required(F.col("_node"), "location without a place in the layout")).drop("_node")
    slots = tuple(Slot(d, s) for d in range(len(evidence)) for s in range(1 if layout is None else 2))
    picked = []
    for s in slots:
        here = (F.col("_d") == s.dataset) & (F.col("side") == s.side)
        value = F.when(here, F.struct("num_part", "y", "vox_id"))
        picked.append(_only(value, s.dataset).alias(f"s{s.name}"))
    wide = rows.groupBy("subj_id", "node_id").agg(*picked)
    cols = ["subj_id", "node_id"]
    for s in slots:
        cols += [F.col(f"s{s.name}.num_part").alias(f"n{s.name}"), F.col(f"s{s.name}.y").alias(f"y{s.name}")]
    if layout is not None:
        # The locations of a node are the layout's: a subject may have data at one of them only.
        ends = layout.table.groupBy("node_id").agg(
            *[F.max(F.when(F.col("side") == side, F.col("vox_id"))).cast("long").alias(f"vox{side}") for side in (0, 1)])
        df = wide.select(*cols).join(ends, "node_id").withColumn("share", F.when(F.col("vox0") == F.col("vox1"), 0.5).otherwise(1.0))
        return Aligned(df, slots, sided=True, grouped=True)
    return Aligned(wide.select(*cols), slots, grouped=True)


def colocate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread rows by node so that per-node tables can be joined without moving them again.

    A node with very many subjects is split over several salts.  The returned
    table lists only those hot nodes with their number of salts, at most one
    per ``ROWS_PER_SALT`` rows; ``repeat_for_salts`` repeats a per-node table
    to match.
    """
    hot = rows.groupBy("node_id").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_SALT).cast("int").alias("n_salt")).where("n_salt > 1")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("subj_id"), F.coalesce("n_salt", F.lit(1))).cast("int")
    placed = rows.join(hot, "node_id", "left").withColumn("salt", salt).drop("n_salt")
    return placed.repartition(n, "node_id", "salt"), hot


def repeat_for_salts(table: DataFrame, hot: DataFrame) -> DataFrame:
    """A per-node table with one copy per salt of its node."""
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("n_salt", F.lit(1)) - 1))
    return table.join(hot, "node_id", "left").withColumn("salt", salts).drop("n_salt")


# ---------------------------------------------------------------- scoring


class _Batch:
    """Numpy view of the columns of one Arrow batch."""

    def __init__(self, batch, slots, widths):
        names = batch.schema.names
        col = lambda name: batch.column(names.index(name))
        self.rows = batch.num_rows
        self.subj, self.node = col("subj_id"), col("node_id")
        self.y = [batches.matrix(col(f"y{s.name}"), widths[s.dataset]) for s in slots]
        self.present = [np.asarray(col(f"n{s.name}").is_valid()) for s in slots]
        self.n = [batches.vector(col(f"n{s.name}"), 0.0) for s in slots]
        self.share = batches.vector(col("share")) if "share" in names else np.ones(self.rows)
        self.logpi = col("logpi") if "logpi" in names else None
        self.uhat = col("uhat") if "uhat" in names else None
        self.kappa = {
            s.dataset: batches.matrix(col(f"kappa{s.dataset}"), batches.width(col(f"kappa{s.dataset}")))
            for s in slots if f"kappa{s.dataset}" in names
        }


def _score(b: _Batch, slots, emissions, weights, gates, offsets, k):
    """Log-likelihood of each slot (n x K) and their sum."""
    parts = []
    for i, s in enumerate(slots):
        if not gates[s.dataset]:
            parts.append(np.zeros((b.rows, k)))
            continue
        ll = emissions[s.dataset].loglik(b.y[i], b.n[i], b.kappa.get(s.dataset))
        ll = np.nan_to_num(ll)[:, offsets[s.side]:offsets[s.side] + k] * weights[s.dataset]
        ll[~b.present[i]] = 0.0
        parts.append(ll)
    return parts, np.sum(parts, axis=0)


def _settings(models: Sequence[Model]):
    """Picklable driver-side parameters of several models of the same shape."""
    k = models[0].prior.k
    half = models[0].prior.layout is not None and not models[0].prior.layout.same_parcels
    return {
        "k": k,
        "k_full": models[0].prior.k_full,
        "offsets": (0, k if half else 0),
        "emissions": [m.emissions for m in models],
        "weights": [[m.weight(d) for d in range(len(m.emissions))] for m in models],
        "flat": [m.prior.start for m in models],
        "widths": [e.width for e in models[0].emissions],
    }


def _log_prior(b: _Batch, cfg, i):
    if b.logpi is None:
        return cfg["flat"][i][None, :]
    k, n = cfg["k"], len(cfg["flat"])
    return batches.matrix(b.logpi, k * n)[:, i * k:(i + 1) * k]


def posterior(aligned: Aligned, model: Model, gates: Sequence[bool] | None = None) -> DataFrame:
    """Posterior parcel probabilities of every (subject, location): one inference pass.

    With a layout both locations of a node get the node's posterior, also where the subject has data at one of them only.
    """
    cfg = _settings([model])
    slots = aligned.slots
    gates = [True] * len(model.emissions) if gates is None else list(gates)
    sided = aligned.sided

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            b = _Batch(batch, slots, cfg["widths"])
            _, ll = _score(b, slots, cfg["emissions"][0], cfg["weights"][0], gates, cfg["offsets"], cfg["k"])
            u = softmax_rows(ll + _log_prior(b, cfg, 0))
            extra = [batch.column("vox0"), batch.column("vox1")] if sided else []
            yield pa.RecordBatch.from_arrays(
                [b.subj, b.node, batches.list_array(u), *extra],
                names=["subj_id", "node_id", "uhat"] + (["vox0", "vox1"] if sided else []),
            )

    df = _attach(aligned.df, model)
    schema = "subj_id long, node_id long, uhat array<double>" + (", vox0 long, vox1 long" if sided else "")
    out = df.mapInArrow(run, schema)
    if not sided:
        return out.withColumnRenamed("node_id", "vox_id")
    # Back to locations: a row stands for up to two of them.
    left, right = F.col("uhat"), F.col("uhat")
    if not model.prior.layout.same_parcels:
        zero = F.array_repeat(F.lit(0.0), model.prior.k)
        half = F.transform("uhat", lambda x: x / 2)
        mid = F.col("vox0") == F.col("vox1")
        left = F.when(mid, F.concat(half, half)).otherwise(F.concat("uhat", zero))
        right = F.concat(zero, F.col("uhat"))
    items = F.array(
        F.struct(F.col("vox0").alias("vox_id"), left.alias("uhat")),
        F.when(~F.col("vox0").eqNullSafe(F.col("vox1")), F.struct(F.col("vox1").alias("vox_id"), right.alias("uhat"))),
    )
    return out.select("subj_id", F.explode(items).alias("i")).where("i.vox_id is not null").select(
        "subj_id", "i.vox_id", "i.uhat"
    )


def scores(aligned: Aligned, model: Model) -> DataFrame:
    """Combined log-likelihood ``ll`` of every (subject, node), weighted over datasets."""
    cfg = _settings([model])
    slots, gates = aligned.slots, [True] * len(model.emissions)

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            b = _Batch(batch, slots, cfg["widths"])
            _, ll = _score(b, slots, cfg["emissions"][0], cfg["weights"][0], gates, cfg["offsets"], cfg["k"])
            yield pa.RecordBatch.from_arrays(
                [b.subj, b.node, batches.list_array(ll)], names=["subj_id", "vox_id", "ll"]
            )

    return _attach(aligned.df, model, prior=False).mapInArrow(run, "subj_id long, vox_id long, ll array<double>")


def loglik(evidence: DataFrame, emission: em.Emission) -> DataFrame:
    """Log-likelihood of each location under each parcel of one emission model."""
    prior = IndependentPrior(emission.n_parcels)
    return scores(align([evidence]), Model(prior, (emission,)))


def distribute(uhat: DataFrame, subject_map: DataFrame) -> DataFrame:
    """Posteriors back to the datasets: one row per dataset a subject belongs to."""
    return uhat.join(subject_map, "subj_id")


def join_prior(df: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """Rows with the prior of their node; a node without a prior is an error."""
    met = df.join(table, list(by) or ["node_id"], "left")
    return met.withColumn("logpi", A.required(F.col("logpi"), "location without a prior"))


def _attach(df: DataFrame, model: Model, prior: bool = True) -> DataFrame:
    if prior and model.prior.table is not None and "logpi" not in df.columns:
        df = join_prior(df, model.prior.table)
    for d in range(len(model.emissions)):
        table = model.kappa_table(d)
        if table is not None:
            df = join_hot(df, table.select("subj_id", F.col("kappa").alias(f"kappa{d}")), "subj_id", F.col("node_id"))
    return df


# ---------------------------------------------------------------- one pass


def _pass(
    aligned: Aligned, df: DataFrame, models: Sequence[Model], gates, want_nodes: bool, held_out: Sequence[int | None] | None = None
) -> DataFrame:
    """Sums of all sufficient statistics of one inference pass.

    Long result: ``init, ds, stat, key, subj`` identify a row of K sums
    ``c0..``; ``rows, ll_a, ll_e`` count rows and add up log-likelihoods.
    ``held_out`` names a subject per model whose rows do not count for it.
    """
    held_out = list(held_out) if held_out is not None else [None] * len(models)
    cfg, slots = _settings(models), aligned.slots
    kf, k = cfg["k_full"], cfg["k"]
    by_subject = [isinstance(e, em.VonMisesFisher) and e.equal_weight for e in models[0].emissions]
    spatial = models[0].prior.spatial
    values = [f"c{i}" for i in range(kf)] + ["rows", "ll_a", "ll_e"]
    schema = "init int, ds int, stat string, key long, subj long, " + ", ".join(f"{c} double" for c in values)

    def run(it):
        acc: dict[tuple, np.ndarray] = {}

        def put(init, ds, stat, key, subj, c, extra=(0.0, 0.0, 0.0)):
            row = np.zeros(kf + 3)
            row[: len(c)], row[kf:] = c, extra
            at = (init, ds, stat, key, subj)
            if at in acc:
                acc[at] += row
            else:
                acc[at] = row

        for batch in it:
            if not batch.num_rows:
                continue
            b = _Batch(batch, slots, cfg["widths"])
            node = subj = None
            nodes_out = []
            for i in range(len(models_emissions)):
                keep = np.ones(b.rows) if held_out[i] is None else (b.subj.to_numpy() != held_out[i]).astype(float)
                if b.uhat is not None:
                    u = batches.matrix(b.uhat, k)
                else:
                    parts, ll = _score(b, slots, models_emissions[i], cfg["weights"][i], gates, cfg["offsets"], k)
                    logpi = _log_prior(b, cfg, i)
                    u = softmax_rows(ll + logpi)
                    with np.errstate(invalid="ignore"):
                        ll_a = (np.nan_to_num(u * log_softmax_rows(logpi), neginf=0.0) * keep[:, None]).sum()
                    ll_e = sum(((u * p).sum(axis=1) * b.share * keep).sum() for p in parts)
                    put(i, -1, "total", 0, None, [], (keep.sum(), ll_a, ll_e))
                u = u * keep[:, None]
                if want_nodes and spatial:
                    if node is None:
                        node, inverse = np.unique(b.node.to_numpy(), return_inverse=True)
                    sums = np.zeros((len(node), kf + 3))
                    np.add.at(sums[:, :k], inverse, u)
                    sums[:, kf] = np.bincount(inverse, weights=keep, minlength=len(node))
                    nodes_out.append((i, sums))
                elif want_nodes:
                    put(i, -1, "node", 0, None, u.sum(axis=0), (keep.sum(), 0.0, 0.0))
                for j, s in enumerate(slots):
                    full = np.zeros((b.rows, kf))
                    o = cfg["offsets"][s.side]
                    full[:, o:o + k] = u * b.share[:, None]
                    full[~b.present[j]] = 0.0
                    count = float((b.share * b.present[j] * keep).sum())
                    emission = models_emissions[i][s.dataset]
                    put(i, s.dataset, "rows", 0, None, [], (count, 0.0, 0.0))
                    if by_subject[s.dataset]:
                        subj = [*batches.groups(b.subj.to_numpy())] if subj is None else subj
                        groups = subj
                    else:
                        groups = [(None, slice(None))]
                    for sid, rows in groups:
                        for name, m in emission.stats(full[rows], b.y[j][rows], b.n[j][rows]).items():
                            for r in range(m.shape[0]):
                                put(i, s.dataset, name, r, sid, m[r])
            if len(acc) > MAX_HELD_SUMS:
                yield _emit([list(c) for c in zip(*acc)], np.array(list(acc.values())), values)
                acc.clear()
            for i, sums in nodes_out:
                yield _emit(
                    [np.full(len(node), i), np.full(len(node), -1), ["node"] * len(node), node, [None] * len(node)],
                    sums, values,
                )
        if acc:
            keys = list(acc)
            yield _emit([list(c) for c in zip(*keys)], np.array(list(acc.values())), values)

    models_emissions = cfg["emissions"]
    out = df.mapInArrow(run, schema)
    return out.groupBy("init", "ds", "stat", "key", "subj").agg(*[F.sum(c).alias(c) for c in values])


def _emit(keys, numbers, values):
    init, ds, stat, key, subj = keys
    arrays = [
        pa.array(init, pa.int32()), pa.array(ds, pa.int32()), pa.array(stat, pa.string()),
        pa.array(key, pa.int64()), pa.array(subj, pa.int64()),
    ] + [pa.array(numbers[:, j]) for j in range(numbers.shape[1])]
    return pa.RecordBatch.from_arrays(arrays, names=["init", "ds", "stat", "key", "subj", *values])


def _collect(step: DataFrame, model: Model):
    """Statistics per (init, dataset) and totals per init; no per-node or per-subject rows."""
    k_full = model.prior.k_full
    values = [f"c{i}" for i in range(k_full)]
    small = step if not model.prior.spatial else step.where(F.col("stat") != "node")
    if any(getattr(e, "equal_weight", False) for e in model.emissions):
        small = small.groupBy("init", "ds", "stat", "key").agg(
            *[F.sum(c).alias(c) for c in [*values, "rows", "ll_a", "ll_e"]]
        )
    stats: dict = {}
    total: dict = {}
    counts: dict = {}
    for r in small.collect():
        if r["stat"] == "total":
            total[r["init"]] = (r["ll_a"], r["ll_e"])
        elif r["stat"] == "node":  # the flat prior's sums
            stats.setdefault((r["init"], -1), {}).setdefault("node", {})[0] = [r[c] for c in values] + [r["rows"]]
        elif r["stat"] == "rows":
            counts[r["init"], r["ds"]] = counts.get((r["init"], r["ds"]), 0.0) + r["rows"]
        else:
            stats.setdefault((r["init"], r["ds"]), {}).setdefault(r["stat"], {})[r["key"]] = [r[c] for c in values]
    packed = {
        at: {name: np.array([rows[i] for i in sorted(rows)]) for name, rows in names.items()}
        for at, names in stats.items()
    }
    return packed, counts, total


def _mean_of_subject_means(step: DataFrame, init: int, ds: int, k_full: int) -> np.ndarray:
    """Mean over subjects of each subject's mean direction (M x K)."""
    mine = step.where((F.col("init") == init) & (F.col("ds") == ds))
    weight = mine.where("stat = 'ju'").select("subj", *[F.col(f"c{i}").alias(f"j{i}") for i in range(k_full)])
    means = (
        mine.where("stat = 'yu'").join(weight, "subj").groupBy("key")
        .agg(*[F.avg(F.try_divide(F.col(f"c{i}"), F.col(f"j{i}"))).alias(f"c{i}") for i in range(k_full)])
    )
    rows = {r["key"]: [np.nan if r[f"c{i}"] is None else r[f"c{i}"] for i in range(k_full)] for r in means.collect()}
    return np.array([rows[i] for i in sorted(rows)])


def _subject_kappa(aligned: Aligned, df: DataFrame, model: Model, new: em.VonMisesFisher, ds: int, gates) -> DataFrame:
    """Concentration of every subject (or subject and parcel), given the new directions."""
    cfg, slots = _settings([model]), aligned.slots
    kf, k = cfg["k_full"], cfg["k"]
    v = new.v

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            b = _Batch(batch, slots, cfg["widths"])
            if b.uhat is not None:
                u = batches.matrix(b.uhat, k)
            else:
                _, ll = _score(b, slots, cfg["emissions"][0], cfg["weights"][0], gates, cfg["offsets"], k)
                u = softmax_rows(ll + _log_prior(b, cfg, 0))
            subj, inverse = np.unique(b.subj.to_numpy(), return_inverse=True)
            sums = np.zeros((len(subj), 2 * kf))
            for j, s in enumerate(slots):
                if s.dataset != ds:
                    continue
                o = cfg["offsets"][s.side]
                w = u * b.share[:, None] * b.present[j][:, None]
                np.add.at(sums[:, o:o + k], inverse, w * np.nan_to_num(b.y[j] @ v[:, o:o + k]))
                np.add.at(sums[:, kf + o:kf + o + k], inverse, w * b.n[j][:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array(subj), *[pa.array(sums[:, j]) for j in range(2 * kf)]],
                names=["subj_id", *[f"a{i}" for i in range(kf)], *[f"j{i}" for i in range(kf)]],
            )

    cols = [f"a{i}" for i in range(kf)] + [f"j{i}" for i in range(kf)]
    schema = "subj_id long, " + ", ".join(f"{c} double" for c in cols)
    sums = df.mapInArrow(run, schema).groupBy("subj_id").agg(*[F.sum(c).alias(c) for c in cols])
    r = [F.try_divide(F.col(f"a{i}"), F.col(f"j{i}")) for i in range(kf)]
    if new.per_parcel:
        kappa = F.array(*[special.concentration(x, new.width) for x in r])
    else:
        mean = sum(r[1:], r[0]) / kf
        kappa = F.array(special.concentration(mean, new.width))
    return cut_lineage(sums.select("subj_id", kappa.alias("kappa")))


def _flat_prior(sums: np.ndarray, prior: IndependentPrior) -> IndependentPrior:
    """Common log prior from the summed posteriors and the number of rows."""
    with np.errstate(divide="ignore"):
        logpi = np.log(sums[: prior.k] / sums[-1])
    if prior.drop_last:
        logpi = logpi - logpi[-1]
    return replace(prior, flat=np.nan_to_num(logpi))


def _node_prior(step: DataFrame, inits: Sequence[int], prior: IndependentPrior) -> DataFrame:
    """Per-node log prior; several starts side by side in one array."""
    rows = step.where(F.col("stat") == "node")
    logpi = F.array(*[log_prob(F.col(f"c{i}") / F.col("rows")) for i in range(prior.k)])
    if prior.drop_last:
        logpi = drop_redundant(logpi)
    rows = rows.select("init", F.col("key").alias("node_id"), logpi.alias("logpi"))
    if len(inits) == 1:
        return rows.where(F.col("init") == inits[0]).select("node_id", "logpi")
    side = [F.first(F.when(F.col("init") == i, F.col("logpi")), ignorenulls=True) for i in inits]
    return rows.groupBy("node_id").agg(F.concat(*side).alias("logpi"))


def _joined_priors(models: Sequence[Model]) -> DataFrame | None:
    """The prior tables of several starts as one table with concatenated arrays."""
    if models[0].prior.table is None:
        return None
    first = models[0].prior.table
    if all(m.prior.table is first for m in models):
        repeated = F.concat(*[F.col("logpi")] * len(models))
        return first.select("node_id", repeated.alias("logpi"))
    out = first
    for i, m in enumerate(models[1:], 1):
        out = out.join(m.prior.table.select("node_id", F.col("logpi").alias(f"_l{i}")), "node_id")
    return out.select("node_id", F.concat("logpi", *[f"_l{i}" for i in range(1, len(models))]).alias("logpi"))


# ---------------------------------------------------------------- learning


def _stop(trace, t, max_iter, tol):
    """'go', 'stop' or 'back' after iteration ``t``."""
    if t == max_iter - 1:
        return "stop"
    if t >= 1:
        change = sum(trace[t]) - sum(trace[t - 1])
        if change < -tol:
            return "back"
        if change < tol:
            return "stop"
    return "go"


def _update_emissions(model, scored, aligned, data, step, stats, counts, pos, gates, fit_emission) -> Model:
    """M-step of every emission model from the sums of one pass.

    ``scored`` holds the parameters the posteriors of that pass came from.
    """
    new = list(model.emissions)
    tables = list(model.subject_kappa or [None] * len(new))
    for d, e in enumerate(model.emissions):
        if not fit_emission[d]:
            continue
        args = {}
        if getattr(e, "equal_weight", False):
            args["mean_direction"] = _mean_of_subject_means(step, pos, d, model.prior.k_full)
        new[d] = e.updated(stats[pos, d], counts[pos, d], **args)
        if getattr(e, "per_subject", False) and e.fit_kappa:
            tables[d] = _subject_kappa(aligned, data, scored, new[d], d, gates)
    return replace(model, emissions=tuple(new), subject_kappa=tuple(tables))


def m_step(aligned: Aligned, model: Model, uhat: DataFrame | None = None) -> Model:
    """One M-step of the emission models for given posteriors.

    The posteriors come as a ``uhat`` column of the aligned rows, or as a
    table (``subj_id, vox_id, uhat``) that is joined to them.
    """
    df = aligned.df
    if uhat is not None:
        df = df.join(uhat.select("subj_id", F.col("vox_id").alias("node_id"), "uhat"), ["subj_id", "node_id"])
    gates = [True] * len(model.emissions)
    step = _pass(aligned, df, [model], gates, want_nodes=False)
    stats, counts, _ = _collect(step, model)
    return _update_emissions(model, model, aligned, df, step, stats, counts, 0, gates, gates)


def batch_statistics(aligned: Aligned, model: Model) -> dict[str, np.ndarray]:
    """All sums of one inference pass by name, empty without rows: they may be added to those of other data.

    For models without parameters per subject; the sums of a flat prior are ``node``.
    """
    if any(getattr(e, "per_subject", False) or getattr(e, "equal_weight", False) for e in model.emissions):
        raise ValueError("parameters per subject cannot be added up")
    gates = [True] * len(model.emissions)
    step = _pass(aligned, _attach(aligned.df, model), [model], gates, want_nodes=not model.prior.spatial)
    stats, counts, total = _collect(step, model)
    if not total:
        return {}
    out = {f"{d}.{name}": m for (_, d), names in stats.items() if d >= 0 for name, m in names.items()}
    out |= {f"{d}.rows": np.array([n]) for (_, d), n in counts.items()}
    if (0, -1) in stats:
        out["node"] = np.asarray(stats[0, -1]["node"][0], dtype=float)
    return out


def model_from_statistics(model: Model, sums: dict[str, np.ndarray], fit_prior: bool = True, fit_emission: bool = True) -> Model:
    """The M-step of the sums of ``batch_statistics``."""
    prior, new = model.prior, list(model.emissions)
    if fit_prior and "node" in sums:
        prior = _flat_prior(sums["node"], prior)
    for d, e in enumerate(model.emissions):
        own = {name.split(".", 1)[1]: m for name, m in sums.items() if name.startswith(f"{d}.")}
        if fit_emission and own:
            rows = float(own.pop("rows")[0])
            new[d] = e.updated(own, rows)
    return replace(model, prior=prior, emissions=tuple(new))


def _as_list(value, n):
    return list(value) if hasattr(value, "__len__") else [bool(value)] * n


def fit_em(
    model: Model, aligned: Aligned, max_iter: int = 30, tol: float = 0.01,
    fit_emission=True, fit_prior: bool = True, first_evidence=False,
) -> FitResult:
    """Expectation-maximisation until the log-likelihood settles.

    Stops at ``max_iter`` inference passes, when the gain falls below ``tol``,
    or when the log-likelihood drops by more than ``tol``, in which case the
    previous parameters are returned.  Datasets whose ``first_evidence`` is
    false contribute nothing to the first pass.
    """
    return _fit([model], aligned, max_iter, tol, fit_emission, fit_prior, first_evidence)[0]


def fit_em_starts(
    starts: Sequence[Model], aligned: Aligned, first_iter: int = 7, max_iter: int = 30, tol: float = 0.01,
    fit_emission=True, fit_prior: bool = True, align_on="prior",
) -> FitResult:
    """EM from several starts: short runs, then the best one is continued.

    All starts share each pass over the data.  ``align_on``: ``None`` passes
    all evidence in the first pass, ``"prior"`` none, a number only that
    dataset's.
    """
    n = len(starts[0].emissions)
    gates = [align_on is None] * n
    if isinstance(align_on, int) and not isinstance(align_on, bool):
        gates[align_on] = True
    first = _fit(starts, aligned, first_iter, tol, fit_emission, fit_prior, gates)
    best = 0
    for i, r in enumerate(first):
        if r.loglik[-1] > first[best].loglik[-1]:
            best = i
    if max_iter <= first_iter:
        short = first[best]
        return replace(short, first_traces=[r.loglik for r in first])
    rest = _fit([first[best].model], replace(aligned, grouped=True), max_iter - first_iter, tol, fit_emission, fit_prior, True)[0]
    return FitResult(
        rest.model, first[best].trace + rest.trace[1:], first[best].history + rest.history[1:], rest._inference,
        first_traces=[r.loglik for r in first],
    )


def fit_em_folds(
    model: Model, aligned: Aligned, held_out: Sequence[int], max_iter: int = 200, tol: float = 0.1, fit_emission=True,
) -> list[FitResult]:
    """EM once per held-out subject, all fits in the same passes; the prior stays frozen."""
    return _fit([model] * len(held_out), aligned, max_iter, tol, fit_emission, False, False, list(held_out))


def _fit(models, aligned, max_iter, tol, fit_emission, fit_prior, first_evidence, held_out=None) -> list[FitResult]:
    held_out = held_out or [None] * len(models)
    n_ds = len(models[0].emissions)
    fit_emission, first = _as_list(fit_emission, n_ds), _as_list(first_evidence, n_ds)
    prior0 = models[0].prior
    node_prior = prior0.spatial and (fit_prior or prior0.table is not None)
    if len(models) > 1 and any(getattr(e, "per_subject", False) for e in models[0].emissions):
        return [
            _fit([m], aligned, max_iter, tol, fit_emission, fit_prior, first_evidence, [h])[0] for m, h in zip(models, held_out)
        ]

    salts = None
    df = aligned.df
    if node_prior and fit_prior:
        df, salts = colocate(df)
        salts = salts.persist(StorageLevel.MEMORY_AND_DISK)
    table = _joined_priors(models)
    frozen = table is not None and salts is None
    if frozen:  # a given prior never changes: it is joined once, before the evidence is kept
        df = join_prior(df, table)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if not aligned.grouped:
        _reject_repeats(df)

    n = len(models)
    current = list(models)
    traces: list[list] = [[] for _ in range(n)]
    history: list[list] = [[] for _ in range(n)]
    used: list = [None] * n
    active = list(range(n))
    for t in range(max_iter):
        gates = first if t == 0 else [True] * n_ds
        running = [current[i] for i in active]
        data = df
        if frozen:
            if len(active) < n:
                k = prior0.k
                data = df.withColumn("logpi", F.concat(*[F.slice("logpi", i * k + 1, k) for i in active]))
        elif table is not None:
            data = join_prior(df, repeat_for_salts(table, salts), "node_id", "salt")
        for d in range(n_ds):
            kt = running[0].kappa_table(d)
            if kt is not None:
                data = join_hot(data, kt.select("subj_id", F.col("kappa").alias(f"kappa{d}")), "subj_id", F.col("node_id"))
        step = _pass(aligned, data, running, gates, fit_prior, [held_out[i] for i in active])
        if (fit_prior and prior0.spatial) or any(getattr(e, "equal_weight", False) for e in running[0].emissions):
            step = cut_lineage(step)
        stats, counts, total = _collect(step, current[0])

        going = []
        for pos, i in enumerate(active):
            history[i].append(current[i])
            ll_a, ll_e = total[pos]
            if t == 0 and not all(first):
                ll_e = -math.inf
            if math.isnan(ll_a + ll_e):
                raise ArithmeticError("the log-likelihood is not a number")
            traces[i].append((ll_a, ll_e))
            used[i] = (aligned, current[i], gates)
            verdict = _stop(traces[i], t, max_iter, tol)
            if verdict == "back":
                current[i] = history[i][t - 1]
            elif verdict == "go":
                going.append((pos, i))
        if not going:
            break
        if fit_prior and prior0.spatial:
            table = _node_prior(step, [pos for pos, _ in going], prior0)
        for rank, (pos, i) in enumerate(going):
            m = current[i]
            if fit_prior and prior0.spatial:
                k = prior0.k
                m = replace(m, prior=replace(m.prior, table=table.select(
                    "node_id", F.slice("logpi", rank * k + 1, k).alias("logpi"))))
            elif fit_prior:
                m = replace(m, prior=_flat_prior(stats[pos, -1]["node"][0], m.prior))
            current[i] = _update_emissions(
                m, running[pos], aligned, data, step, stats, counts, pos, gates, fit_emission
            )
        active = [i for _, i in going]
    df.unpersist()
    if salts is not None:
        salts.unpersist()
    return [FitResult(current[i], traces[i], history[i], used[i]) for i in range(n)]


# ---------------------------------------------------------------- parameters


def parameter_vector(model: Model) -> tuple[np.ndarray, dict[str, range]]:
    """All driver-side parameters as one vector, with the range of each name.

    Names read ``arrange.logpi`` (flat priors only) and ``emissions.<d>.<name>``.
    """
    parts, where, at = [], {}, 0
    named = []
    if model.prior.table is None:
        named.append(("arrange.logpi", model.prior.start))
    for d, e in enumerate(model.emissions):
        named += [(f"emissions.{d}.{name}", value) for name, value in e.params().items()]
    for name, value in named:
        flat = np.asarray(value, dtype=float).ravel()
        where[name] = range(at, at + flat.size)
        at += flat.size
        parts.append(flat)
    return np.concatenate(parts), where


def with_parameters(model: Model, theta: np.ndarray) -> Model:
    """A model with the parameters of ``theta``, laid out as by ``parameter_vector``."""
    _, where = parameter_vector(model)
    renamed = {"V": "v"}
    prior = model.prior
    if "arrange.logpi" in where:
        prior = replace(prior, flat=np.array(theta[where["arrange.logpi"]]))
    new = []
    for d, e in enumerate(model.emissions):
        args = {}
        for name, value in e.params().items():
            raw = np.asarray(theta[where[f"emissions.{d}.{name}"]], dtype=float).reshape(np.shape(value))
            args[renamed.get(name, name)] = raw if raw.size > 1 or name == "V" else float(raw.ravel()[0])
        new.append(replace(e, **args))
    return replace(model, prior=prior, emissions=tuple(new))


def parameter_table(spark: SparkSession, models: Sequence[Model]) -> DataFrame:
    """Parameters of several models, long: ``model_id, name, idx, value``."""
    out = None
    for i, m in enumerate(models):
        theta, where = parameter_vector(m)
        rows = [(i, name, j - r.start, float(theta[j])) for name, r in where.items() for j in r]
        part = spark.createDataFrame(rows, "model_id long, name string, idx long, value double")
        if m.prior.table is not None:
            wide = m.prior.table.select(
                F.lit(i).cast("long").alias("model_id"), F.lit("arrange.logpi").alias("name"),
                F.posexplode("logpi").alias("k", "value"), "node_id",
            )
            part = part.unionByName(wide.select("model_id", "name", (F.col("node_id") * m.prior.k + F.col("k")).alias("idx"), "value"))
        out = part if out is None else out.unionByName(part)
    return out


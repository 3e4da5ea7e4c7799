"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from dataclasses import replace
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tessera import plans  # noqa: E402
from tessera.operators import mixture  # noqa: E402
from tessera.operators.priors import IndependentPrior  # noqa: E402
from tessera.plans import views  # noqa: E402
from tessera.plans.emission_queries import label_vmf  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = (
    "partition_evidence", "design_regression", "weights_lsquare_sum2P", "vmf_mstep_shared", "vmf_estep",
    "vmf_estep_missing", "gmm_estep", "prior_mstep", "symmetric_estep", "fuse_weighted", "em_vmf_trace",
    "em_vmf_posterior", "em_multistart_best", "nmi_distance", "ari", "dice_greedy", "cosine_error_expected",
    "homogeneity", "homogeneity_fisher", "task_inhomogeneity", "loso_error", "solution_consistency",
    "potts_energy", "potts_gibbs_sweep", "cmp_rbm_meanfield",
)
# Timed as well, but not part of the total.
MORE = ("individual_maps", "fit_sml_posterior")


COPIES, PASSES = 50, 5


def em_iterations(spark, sf_dir: str) -> dict[str, float]:
    """Seconds per EM iteration on the embeddings repeated COPIES times at other locations, with a learned and with a
    given prior per location."""
    rows = views.vox_evidence(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    evidence = rows.withColumn("vox_id", F.col("vox_id") * COPIES + F.col("copy")).drop("copy").repartition("vox_id").persist()
    nodes = evidence.select(F.col("vox_id").alias("node_id")).distinct()
    uniform = F.array(*[F.lit(0.0)] * views.PARCELS)
    prior = IndependentPrior(views.PARCELS, table=nodes.withColumn("logpi", uniform).persist())
    start = replace(label_vmf(spark, sf_dir), prior=prior)
    aligned, out = mixture.align([evidence]), {}
    for name, fit_prior in (("em_iteration_learned_x50", True), ("em_iteration_frozen_x50", False)):
        t0 = time.perf_counter()
        fit = mixture.fit_em(start, aligned, PASSES, -1e300, fit_prior=fit_prior, first_evidence=True)
        out[name] = round((time.perf_counter() - t0) / len(fit.trace), 3)
    evidence.unpersist()
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tessera-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.queries()
    # Start the JVM's code paths and the Python workers before the clock runs.
    for name in ("vmf_estep", "partition_evidence"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE + MORE:
        if name not in queries:
            continue
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = sum(v for k, v in times.items() if k in HEADLINE)
    times |= em_iterations(spark, sf_dir)
    print(json.dumps({
        "metric": "headline queries, total wall-clock", "value": round(total, 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()

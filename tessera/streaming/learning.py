"""Learning a model from a stream of subjects.

Sufficient statistics decay from micro-batch to micro-batch. Every micro-batch leaves the sums and the parameters after it
under its own number; it reads the latest ones below that number, so a micro-batch that is run again after a failure
writes the same again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import evidence, mixture

START = -1  # the version before any micro-batch


def _write(spark: SparkSession, folder: str, version: int, model: mixture.Model, sums: dict[str, np.ndarray]) -> None:
    theta, _ = mixture.parameter_vector(model)
    named = {"theta": theta} | {f"sum.{name}": np.asarray(v, dtype=float) for name, v in sums.items()}
    rows = [(name, i, float(x), list(v.shape)) for name, v in named.items() for i, x in enumerate(v.ravel())]
    table = spark.createDataFrame(rows, "name string, idx long, value double, shape array<int>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def load(spark: SparkSession, folder: str, model: mixture.Model, below: int | None = None):
    """(version, model, sums) of the latest version, or of the latest one below a number. ``model`` gives the layout."""
    rows = spark.read.parquet(folder)
    rows = rows if below is None else rows.where(F.col("version") < below)
    version = rows.agg(F.max("version").alias("v")).first()["v"]
    found: dict[str, list] = {}
    for r in rows.where(F.col("version") == version).orderBy("name", "idx").collect():
        found.setdefault(r["name"], [r["shape"], []])[1].append(r["value"])
    values = {name: np.array(v).reshape(shape) for name, (shape, v) in found.items()}
    sums = {name.removeprefix("sum."): v for name, v in values.items() if name.startswith("sum.")}
    return version, mixture.with_parameters(model, values["theta"]), sums


def learn_stream(
    observations: DataFrame, model: mixture.Model, folder: str, checkpoint: str, decay: float = 0.5,
    x: np.ndarray | None = None, parts: Sequence | None = None, normalised: bool = False, fit_prior: bool = True,
    fit_emission: bool = True,
) -> mixture.Model:
    """Learn from all that has arrived (``subj_id, vox_id, y``) and return the model after it.

    Each micro-batch is scored with the parameters before it; its sums are added to ``decay`` times the earlier ones and
    give the next parameters.  The model has one dataset, a flat prior or a given one, and no parameters per subject.
    Called again with the same folders it goes on where it ended.
    """
    spark = observations.sparkSession
    _write(spark, folder, START, model, {})

    def absorb(batch: DataFrame, number: int) -> None:
        _, now, sums = load(spark, folder, model, number)
        if normalised:
            rows = batch.select("subj_id", "vox_id", F.lit(1.0).alias("num_part"), A.as_double(F.col("y")).alias("y"))
        else:
            rows = evidence.project(batch, x, parts)
        new = mixture.batch_statistics(mixture.align([rows]), now)
        if new:
            sums = {name: v + decay * sums[name] if name in sums else v for name, v in new.items()}
            now = mixture.model_from_statistics(now, sums, fit_prior, fit_emission)
        _write(spark, folder, number, now, sums)

    query = observations.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return load(spark, folder, model)[1]

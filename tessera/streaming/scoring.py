"""Scoring new subjects as their data arrive, with a frozen model.

Inference needs nothing but the model, so the stream is stateless: every
micro-batch is normalised, scored and joined with the static prior.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays as A
from tessera.operators import evidence, mixture


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_stream(
    observations: DataFrame, model: mixture.Model, x: np.ndarray | None = None, parts: Sequence | None = None,
    normalised: bool = False,
) -> DataFrame:
    """Posterior of every arriving (subject, location); ``observations``: ``subj_id, vox_id, y``."""
    if normalised:
        rows = observations.select("subj_id", "vox_id", F.lit(1.0).alias("num_part"), A.as_double(F.col("y")).alias("y"))
    else:
        rows = evidence.project(observations, x, parts)
    return mixture.posterior(mixture.align([rows]), model)


def run_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process everything that has arrived, exactly once, into parquet files."""
    query = (
        stream.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()

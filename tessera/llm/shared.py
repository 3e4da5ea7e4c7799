"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tessera.session import ensure_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, read again: compressed, and safe from lost executors."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)

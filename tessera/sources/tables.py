"""Reading observations and info tables, writing results, storing models."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas
from tessera.functions import arrays as A

# Column layouts of the tab-separated info tables.
TASK_CONDITIONS = T.StructType([
    T.StructField("half", T.IntegerType()), T.StructField("cond_num", T.IntegerType()),
    T.StructField("n_rep", T.DoubleType()), T.StructField("instruction", T.IntegerType()),
    T.StructField("task_name", T.StringType()), T.StructField("cond_name", T.StringType()),
    T.StructField("task_num", T.IntegerType()), T.StructField("reg_id", T.IntegerType()),
    T.StructField("study", T.IntegerType()), T.StructField("cond_num_uni", T.IntegerType()),
    T.StructField("task_num_uni", T.IntegerType()), T.StructField("common", T.IntegerType()),
    T.StructField("names", T.StringType()),
])
REST_NETWORKS = T.StructType([
    T.StructField("sess", T.StringType()), T.StructField("run", T.IntegerType()),
    T.StructField("half", T.IntegerType()), T.StructField("net_id", T.IntegerType()),
    T.StructField("names", T.StringType()),
])
COLOURS = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("r", T.DoubleType()), T.StructField("g", T.DoubleType()),
    T.StructField("b", T.DoubleType()), T.StructField("name", T.StringType()),
])


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Parquet observations; NaN elements become NULL, the schema is checked."""
    df = spark.read.parquet(path)
    missing = [f.name for f in schemas.OBSERVATIONS if f.name not in df.columns]
    if missing:
        raise ValueError(f"observations lack the columns {missing}")
    return df.select(
        F.col("dataset_id").cast("int").alias("dataset_id"), F.col("subj_id").cast("long").alias("subj_id"),
        F.col("vox_id").cast("long").alias("vox_id"), A.nan_to_null(A.as_double(F.col("y"))).alias("y"),
    )


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated table with a header; blanks around values are dropped."""
    reader = spark.read.option("sep", "\t").option("header", True)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_colours(spark: SparkSession, path: str) -> DataFrame:
    """Colour table: id, red, green, blue, name, separated by blanks, without header."""
    return spark.read.option("sep", " ").schema(COLOURS).csv(path)


def read_npy(spark: SparkSession, glob: str, subject: str = r"(\d+)") -> DataFrame:
    """One N x P array file per subject to rows ``subj_id, vox_id, y``.

    The subject number is the last match of the pattern in the file name.  A
    file is one task's work, as it cannot be split.
    """
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    number = F.element_at(F.regexp_extract_all(F.element_at(F.split("path", "/"), -1), F.lit(subject)), -1)

    def run(it):
        for pdf in it:
            for sid, content in zip(pdf["subj_id"], pdf["content"]):
                y = np.load(io.BytesIO(content)).astype(float)
                for lo in range(0, y.shape[1], 4096):
                    part = y[:, lo:lo + 4096].T
                    yield pd.DataFrame({
                        "subj_id": np.full(len(part), sid), "vox_id": np.arange(lo, lo + len(part)), "y": part.tolist()
                    })

    rows = files.select(number.cast("long").alias("subj_id"), "content").mapInPandas(run, "subj_id long, vox_id long, y array<double>")
    return rows.withColumn("y", A.nan_to_null(F.col("y")))


def average_runs(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean over runs with zeros taken as missing."""
    return cells.groupBy(*by).agg(F.avg(F.nullif(F.col(value), F.lit(0.0))).alias(value))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


# ---------------------------------------------------------------- model store


def save_models(info: DataFrame, parameters: DataFrame, path: str) -> None:
    """``info``: ``model_id, loglik, ...``; ``parameters``: ``model_id, name, idx, value``."""
    write_parquet(info, f"{path}/models")
    write_parquet(parameters, f"{path}/params", ["name"])


def select_model(info: DataFrame, index: int | None = None) -> DataFrame:
    """The given model, or the one with the highest log-likelihood (first of ties)."""
    if index is not None:
        return info.where(F.col("model_id") == index)
    return info.orderBy(F.desc("loglik"), "model_id").limit(1)  # top one, found per task first


def load_group_prior(spark: SparkSession, path: str, k: int, index: int | None = None, marginal: bool = False):
    """Prior of the selected model (``node_id, logpi`` or ``pi``) and its info row."""
    info = select_model(spark.read.parquet(f"{path}/models"), index)
    rows = spark.read.parquet(f"{path}/params").where(F.col("name") == "arrange.logpi").join(F.broadcast(info.select("model_id")), "model_id")
    node = F.floor(F.col("idx") / k).cast("long")
    values = F.array_sort(F.collect_list(F.struct("idx", "value")))  # k entries per node
    prior = rows.groupBy(node.alias("node_id")).agg(F.transform(values, lambda s: s["value"]).alias("logpi"))
    if marginal:
        prior = prior.select("node_id", A.softmax(F.col("logpi")).alias("pi"))
    return prior, info


def load_emission_params(spark: SparkSession, path: str, name: str, index: int | None = None) -> list[np.ndarray]:
    """Named parameter of every emission model of the selected model, one vector per dataset."""
    info = select_model(spark.read.parquet(f"{path}/models"), index)
    rows = spark.read.parquet(f"{path}/params").where(F.col("name").rlike(rf"^emissions\.\d+\.{name}$"))
    picked = rows.join(F.broadcast(info.select("model_id")), "model_id").orderBy("name", "idx").collect()  # driver-side parameters
    if not picked:
        raise KeyError(f"no emission parameter {name}")
    out: dict[int, list[float]] = {}
    for r in picked:
        out.setdefault(int(r["name"].split(".")[1]), []).append(r["value"])
    return [np.array(out[d]) for d in sorted(out)]


def loglik_gain(trace: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Change of the log-likelihood from one iteration to the next."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("iter")  # one row per iteration
    return trace.withColumn("gain", F.col("ll") - F.lag("ll").over(w))

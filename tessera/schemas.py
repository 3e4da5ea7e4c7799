"""Schemas of the tables that pass between operators.

Missing values are NULL inside the engine and become NaN only inside numpy
batches.
"""

from pyspark.sql import types as T

_vec = T.ArrayType(T.DoubleType())

OBSERVATIONS = T.StructType([
    T.StructField("dataset_id", T.IntegerType()),
    T.StructField("subj_id", T.LongType()),
    T.StructField("vox_id", T.LongType()),
    T.StructField("y", _vec),
])

DESIGN = T.StructType([
    T.StructField("dataset_id", T.IntegerType()),
    T.StructField("obs_id", T.IntegerType()),
    T.StructField("part_id", T.IntegerType()),
    T.StructField("cond_id", T.IntegerType()),
    T.StructField("x", _vec),
])

EVIDENCE = T.StructType([
    T.StructField("subj_id", T.LongType()),
    T.StructField("vox_id", T.LongType()),
    T.StructField("num_part", T.DoubleType()),
    T.StructField("y", _vec),
])

PRIOR = T.StructType([
    T.StructField("node_id", T.LongType()),
    T.StructField("logpi", _vec),
])

POSTERIOR = T.StructType([
    T.StructField("subj_id", T.LongType()),
    T.StructField("vox_id", T.LongType()),
    T.StructField("uhat", _vec),
])

EDGES = T.StructType([
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("w", T.DoubleType()),
])

SUBJECT_MAP = T.StructType([
    T.StructField("dataset_id", T.IntegerType()),
    T.StructField("local_subj", T.LongType()),
    T.StructField("subj_id", T.LongType()),
])

PARAMS = T.StructType([
    T.StructField("model_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

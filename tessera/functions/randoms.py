"""Random numbers that depend on keys only, never on partitioning.

``rand(seed)`` changes with the number of partitions and with task retries;
hashing (seed, keys) does not, so a lost executor recomputes the same draws.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import arrays as A


def uniform(seed, *keys: Column) -> Column:
    """Uniform in [0, 1) from the first 32 bits of md5(seed|key|key...)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed, *keys: Column) -> Column:
    """Standard normal by the Box-Muller transform of two hashed uniforms."""
    u1 = 1.0 - uniform(f"{seed}.a", *keys)
    u2 = uniform(f"{seed}.b", *keys)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def pick_category(p: Column, u: Column) -> Column:
    """Index of the first cumulative probability above ``u``; 0 if none is."""
    state = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("i"), F.lit(-1).alias("hit"))

    def pick(v):
        def step(acc, x):
            c = acc["c"] + x
            hit = F.when((acc["hit"] < 0) & (v < c), acc["i"]).otherwise(acc["hit"])
            return F.struct(c.alias("c"), (acc["i"] + 1).alias("i"), hit.alias("hit"))

        return F.aggregate(p, state, step, lambda acc: F.greatest(acc["hit"], F.lit(0)))

    return A.let(u, pick)  # ``u`` is hashed once, not for every element


def uniform_blocks(n: int, seed, *keys: Column) -> Column:
    """The digests md5(seed|key|key...|block) that hold ``n`` uniforms of 32 bits each, as array<binary>."""
    names = [k.cast("string") for k in keys]
    digest = lambda j: F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), *names, j.cast("string"))))
    return F.transform(F.sequence(F.lit(0), F.lit(-(-n // 4) - 1)), digest)


def from_blocks(column: pa.Array, n: int) -> np.ndarray:
    """The uniforms of ``uniform_blocks`` as an (rows, n) matrix."""
    flat = column.flatten()
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.view(">u4").reshape(len(column), -1)[:, :n] / 4294967296.0

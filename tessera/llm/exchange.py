"""Corpus-wide figures of hashed keys (windows, shingles, n-grams), and back to their documents.

A table of one row per (document, key) would be many times the corpus. Here documents are dealt to chunks of a
few megabytes. Each chunk sorts its keys, combines repeated ones and sends one packed row per key range; a
range combines what all chunks sent and answers each chunk in the chunk's own order. A key found in every
document is sent once per chunk, so no key is hot, and no group grows with the corpus: the number of chunks
and of key ranges does. Both readers of the chunks share one exchange of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
_CODEC = ("zstd", 1)

ASKED = "bucket long, chunk long, n long, keys binary, vals binary"
ANSWERED = "chunk long, bucket long, n long, others binary"

#: Distinct keys of a chunk in ascending order, and one number for each.
Keys = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]


def pack(values: np.ndarray) -> bytes:
    """64-bit integers as byte planes, so that equal high bytes stand together, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return pa.Codec(_CODEC[0], compression_level=_CODEC[1]).compress(planes.tobytes(), asbytes=True)


def unpack(packed: bytes, n: int, dtype: type = np.uint64) -> np.ndarray:
    raw = pa.Codec(_CODEC[0]).decompress(packed, decompressed_size=8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).reshape(-1).view(dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(packed, n), dtype=np.uint64)


def combine(keys: np.ndarray, values: np.ndarray, op: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, their combined values, and for each entry the place of its key."""
    if len(keys) == 0:
        return keys, values, np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return ordered[first], op.reduceat(values[order], first), place


@dataclass(frozen=True)
class Chunked:
    """Documents dealt to chunks, and the number of bits that choose a key range."""

    rows: DataFrame
    bits: int


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> Chunked:
    """(doc_id, text, chunk), spread over as many partitions as chunks. Reads the sizes of the texts once."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    floor = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(floor, 1 + size // (chunk_bytes // 16)), math.ceil(size / chunk_bytes))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = narrow.withColumn("chunk", F.pmod(spread, F.lit(n))).repartition(n, "chunk")
    return Chunked(rows, max(3, math.ceil(math.log2(n))))


def ask(base: Chunked, keys: Keys) -> DataFrame:
    bits = base.bits

    def send(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        uniq, vals = keys(table)
        at = np.searchsorted(uniq, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        at = np.append(at, len(uniq))
        full = np.flatnonzero(np.diff(at))
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "chunk": pa.array([group[0].as_py()] * len(full), pa.int64()),
            "n": pa.array(np.diff(at)[full], pa.int64()),
            "keys": pa.array([pack_sorted(uniq[at[b]:at[b + 1]]) for b in full], pa.binary()),
            "vals": pa.array([pack(vals[at[b]:at[b + 1]].astype(np.int64)) for b in full], pa.binary()),
        })

    return base.rows.groupBy("chunk").applyInArrow(send, ASKED)


def answer(asked: DataFrame, op: np.ufunc) -> DataFrame:
    """For each key of each chunk: the combined value of all chunks less the chunk's own value."""

    def reply(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ns = table["n"].to_numpy()
        keys = np.concatenate([unpack_sorted(p.as_py(), n) for p, n in zip(table["keys"], ns)])
        own = np.concatenate([unpack(p.as_py(), n, np.int64) for p, n in zip(table["vals"], ns)])
        _, all_, place = combine(keys, own, op)
        others = all_[place] - own
        ends = np.cumsum(ns)
        return pa.table({
            "chunk": table["chunk"], "bucket": table["bucket"], "n": table["n"],
            "others": pa.array([pack(others[e - n:e]) for e, n in zip(ends, ns)], pa.binary()),
        })

    return asked.groupBy("bucket").applyInArrow(reply, ANSWERED)


def replies(table: pa.Table) -> np.ndarray:
    """The answers to a chunk in the order of its sorted keys."""
    if table.num_rows == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(table["bucket"].to_numpy())
    ns, packed = table["n"].to_numpy(), table["others"]
    return np.concatenate([unpack(packed[int(i)].as_py(), ns[i], np.int64) for i in order])


def corpus_figures(
    base: Chunked, keys: Keys, op: np.ufunc, finish: Callable[[pa.Table, np.ndarray], pa.Table], schema: str
) -> DataFrame:
    """Rows that ``finish`` makes of a chunk and of what the other chunks hold of its keys."""

    def last(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        return finish(chunk, replies(answers))

    answered = answer(ask(base, keys), op)
    return base.rows.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(last, schema)

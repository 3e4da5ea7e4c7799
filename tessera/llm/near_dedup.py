"""Near-dedup: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import components, exchange, textops
from tessera.session import cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold agrees on a band with probability 0.8^3, and misses all 14 in 4 cases of 100,000.
BANDS, ROWS = 14, 3
#: The rarest shingle weighs this much more than one found everywhere. More would let the edits of a copy outweigh
#: the text that it shares with a large group.
RARITY = 0.25
#: Groups of candidates up to this many documents and shingles are verified in one task, larger ones in tiles.
GROUP_DOCS, GROUP_SHINGLES = 3000, 6_000_000

_DOCS = np.uint64(0)
_DRAWN = "doc_id long, content binary, bands array<long>, n long, vector binary"


@functools.lru_cache(maxsize=1)
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of the Gamma(2, 1) distribution, and their logarithms."""
    x = np.concatenate(([0.0], np.geomspace(1e-4, 30, 200_000)))
    r = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x)
    return r.astype(np.float32), np.log(r).astype(np.float32)


def bands_of(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per document and band of its improved consistent weighted samples.

    ``keys`` are the distinct shingles of all documents in ascending order within each, ``starts`` the first of
    each document. For sample i a shingle draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash;
    t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The shingle with the least a is the sample,
    together with its t.
    """
    gamma, log_gamma = _quantiles()
    log_w = np.log(weights).astype(np.float32)
    counts = np.diff(np.append(starts, len(keys)))
    out = np.zeros((len(starts), BANDS), np.uint64)
    low = np.uint64(0xFFFF)
    for i in range(BANDS * ROWS):
        h = textops.mix(keys ^ np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64)))
        r = gamma[h & low]
        b = ((h >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_w / r + b)
        a = log_gamma[(h >> np.uint64(16)) & low] - r * (t - b) - r
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), counts))
        at = least[np.searchsorted(least, starts)]
        sample = textops.mix(h[at] ^ textops.mix(t[at].astype(np.int64).view(np.uint64) + np.uint64(i)))
        out[:, i // ROWS] = textops.mix(out[:, i // ROWS] ^ sample) + np.uint64(i)
    return out


def _shingles(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Per document its distinct shingles in ascending order: rows, keys and counts. A text of fewer words than a
    shingle is one shingle as a whole."""
    words = textops.words_of(table["text"])
    hashes, start = textops.windows(words.hashes, words.counts, SHINGLE)
    row = words.row_of[start]
    short = np.flatnonzero(words.counts < SHINGLE)
    begin = np.cumsum(words.counts) - words.counts
    whole = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
    for k in range(SHINGLE - 1):
        has = words.counts[short] > k
        whole[has] = textops.mix(whole[has] * np.uint64(31) + words.hashes[begin[short[has]] + k])
    keys = np.maximum(np.concatenate((hashes, whole)), np.uint64(1))
    rows = np.concatenate((row, short))
    known = ~np.asarray(table["doc_id"].is_null())[rows]
    keys, rows = keys[known], rows[known]
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return rows[first], keys[first], np.diff(np.append(first, len(keys)))


def _pack_vector(keys: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> bytes:
    planes = keys.view(np.uint8).reshape(-1, 8).T.tobytes()
    raw = planes + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() + idf.astype(np.float32).tobytes()
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack_vector(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(packed, decompressed_size=16 * n, asbytes=True)
    delta = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).reshape(-1).view(np.uint64)
    counts = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8 * n).reshape(4, n).T).reshape(-1).view(np.uint32)
    return np.cumsum(delta, dtype=np.uint64), counts.astype(np.int64), np.frombuffer(raw, np.float32, n, 12 * n)


def draw(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Bands and weighted shingles of every document that can have a partner.

    A document's similarity to another is at most the share of its weight that lies in shingles found elsewhere; if
    that is below the threshold it has no partner, and neither bands nor vector are needed.
    """

    def send(table: pa.Table):
        rows, keys, _ = _shingles(table)
        uniq, n, _ = exchange.combine(keys, np.ones(len(keys), np.int64), np.add)
        return np.concatenate(([_DOCS], uniq)), np.concatenate(([table.num_rows], n))

    def finish(table: pa.Table, others: np.ndarray) -> pa.Table:
        rows, keys, counts = _shingles(table)
        uniq, own, place = exchange.combine(keys, np.ones(len(keys), np.int64), np.add)
        total = table.num_rows + int(others[0])
        frequency = (own + others[1:])[place]
        idf = (1 + RARITY * np.log(total / frequency) / math.log(max(total, 2))).astype(np.float32)
        weights = counts * idf.astype(np.float64)
        size = table.num_rows
        shared = np.bincount(rows, weights * (frequency > 1), size)
        some = shared >= (THRESHOLD - 1e-6) * np.bincount(rows, weights, size)
        some &= np.bincount(rows, minlength=size) > 0
        use = some[rows]
        rows, keys, counts, idf, weights = rows[use], keys[use], counts[use], idf[use], weights[use]
        chosen = np.flatnonzero(some)
        at = np.append(np.searchsorted(rows, chosen), len(rows))
        bands = np.zeros((0, BANDS), np.uint64)
        if len(chosen):  # a few documents at a time
            parts, lo = [], 0
            while lo < len(chosen):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 18), "right")) - 1)
                span = slice(at[lo], at[hi])
                parts.append(bands_of(keys[span], weights[span], at[lo:hi] - at[lo]))
                lo = hi
            bands = np.concatenate(parts)
        contents, vectors = [], []
        for a, b in zip(at, at[1:]):
            contents.append(hashlib.md5(keys[a:b].tobytes() + counts[a:b].tobytes()).digest())
            vectors.append(_pack_vector(np.diff(keys[a:b], prepend=np.uint64(0)), counts[a:b], idf[a:b]))
        return pa.table({
            "doc_id": table["doc_id"].take(pa.array(chosen)), "content": pa.array(contents, pa.binary()),
            "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(chosen) + 1) * BANDS, pa.int32()),
                                              pa.array(bands.reshape(-1).view(np.int64))),
            "n": pa.array(np.diff(at), pa.int64()), "vector": pa.array(vectors, pa.binary()),
        })

    return exchange.corpus_figures(exchange.chunked(docs, id_col, text_col), send, np.add, finish, _DRAWN)


class _Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def linked(ids: np.ndarray, vectors: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """For each document the smallest id reachable by pairs of weighted Jaccard similarity of THRESHOLD or more.

    Every pair that shares a shingle is computed, through the lists of the documents of each shingle. A shingle that
    a document has k times stands as k elements, so that the sum of minima is the weight of common elements.
    """
    order = np.argsort(ids)
    ids, sizes = ids[order], sizes[order]
    n = len(ids)
    keys, idf, row = [], [], []
    for i, j in enumerate(order):
        k, c, w = _unpack_vector(vectors[j], sizes[i])
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        k = np.repeat(k, c)
        keys.append(np.where(nth > 0, textops.mix(k + nth.astype(np.uint64)), k))
        idf.append(np.repeat(w, c).astype(np.float64))
        row.append(np.full(len(k), i))
    keys, idf, row = np.concatenate(keys), np.concatenate(idf), np.concatenate(row)
    weight = np.bincount(row, idf, n)
    _, first, column = np.unique(keys, return_index=True, return_inverse=True)
    by_column = np.argsort(column, kind="stable")
    counts = np.bincount(column)
    begin = np.cumsum(counts) - counts
    docs_of = row[by_column]
    bounds = np.searchsorted(row, np.arange(n + 1))
    forest = _Forest(n)
    value = idf[first]
    for d in range(n):
        mine = column[bounds[d]:bounds[d + 1]]
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        size = counts[mine]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(begin[mine] - (np.cumsum(size) - size), size)
        common = np.bincount(docs_of[at], np.repeat(value[mine], size), n)[:d]
        near = np.flatnonzero(common >= (THRESHOLD - 1e-9) * (weight[:d] + weight[d] - common))
        for other in near.tolist():
            forest.join(d, other)
    out = np.empty(n, np.int64)
    out[order] = ids[[forest.root(i) for i in range(n)]]
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of every document that is like another: the smallest id of its class.

    Documents are linked if their weighted Jaccard similarity over five-word shingles, weighted by count and rarity,
    is THRESHOLD or more; a class is what links reach. Candidates share a band; groups of candidates are the
    components of that relation, and all pairs of a group are verified, so no link of a group is lost. Groups beyond
    GROUP_DOCS or GROUP_SHINGLES are verified in pairs of tiles: bounded memory, work by the square of the group.

    Documents of the same shingles are one for the search and join their class at the end. Null and empty texts
    count as equal to each other, texts below five words as one shingle. Rows with a null id are left out; rows that
    repeat an id count as one document, linked to all that any of them is like.
    """
    drawn = cut_lineage(draw(docs, id_col, text_col))
    narrow = drawn.select("doc_id", "content", "bands", "n")
    reps = narrow.groupBy("content").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    band_rows = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    leads = band_rows.groupBy("band", "key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = band_rows.join(leads, ["band", "key"]).filter("rep <> lead").select(F.col("rep").alias("a"),
                                                                             F.col("lead").alias("b"))
    groups = components.connected(met)
    members = narrow.select("doc_id", "content").join(reps.select("content", "rep"), "content").select("doc_id", "rep")
    found = groups.join(narrow.select(F.col("doc_id").alias("node"), "n"), "node")
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).withColumn(
        "tiles", F.greatest(F.ceil(F.col("docs") / (GROUP_DOCS / 2)), F.ceil(F.col("shingles") / (GROUP_SHINGLES / 2))))
    large = (F.col("docs") > GROUP_DOCS) | (F.col("shingles") > GROUP_SHINGLES)
    placed = drawn.select("doc_id", "n", "vector").join(
        groups.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", "tiles", large.alias("large")),
        "doc_id")
    tile = F.pmod(F.xxhash64("doc_id"), F.col("tiles"))
    other = F.when(F.col("large"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(
        F.array(F.lit(0).cast("long")))
    dealt = placed.withColumn("tile", F.when(F.col("large"), tile).otherwise(F.lit(0).cast("long"))).withColumn(
        "other", F.explode(other)).select(
        "component", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "doc_id", "n", "vector")

    def verify(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        return pa.table({"a": pa.array(ids), "b": pa.array(linked(ids, table["vector"].to_pylist(), table["n"].to_numpy()))})

    links = dealt.groupBy("component", "t1", "t2").applyInArrow(verify, "a long, b long")
    ties = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components.connected(links.unionByName(ties))
    return joined.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id"))


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (itself if it is like no other) and kept."""
    found = classes(docs, id_col, text_col)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    class_id = F.coalesce("class_id", "doc_id")
    return ids.join(found, "doc_id", "left").select(
        "doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are like one of a smaller id; rows with a null id stay."""
    gone = classes(docs, id_col, text_col).filter("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")

"""A trie of conversations: one node for each distinct sequence of first turns.

A prefix is known by its depth and two 62-bit sums of hashes of (place, role, text) over its turns, so that its digest is a
running sum and its parent's digest a difference. Sums over subtrees are made in shards. A shard holds whole paths from the
root (long ones in blocks); it gives each distinct digest a slot by a minimal perfect hash, scatters the counts into flat
arrays and adds them to the parents' slots from the deepest level up. What several shards hold of a node is added last.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textops
from tessera.llm.shared import written

_BITS = 62
_MASK = (1 << _BITS) - 1
_WORD = r"[^\x20\x09-\x0D]+"
SHARD_ROWS = 1 << 14  # rows of a shard on average
BLOCK = 1 << 12  # levels of a path that stay in one shard
KEY = ["depth", "a", "b"]
EMPTY_SHA = hashlib.sha256(b"").digest()


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _within(conv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each stretch of one conversation, and the stretch of each row."""
    head = np.ones(len(conv), bool)
    head[1:] = conv[1:] != conv[:-1]
    return np.flatnonzero(head), np.cumsum(head) - 1


def running(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums modulo 2 ** 62, the row included, along ``order`` in each conv_id. ``sums`` maps new
    columns to columns of non-negative longs.

    Rows are sorted over ranges of (conv_id, order), so a conversation of any length is spread over tasks. Each task sums
    what it has; what earlier ranges hold of a conversation is added from a list of at most two rows a range.
    """
    names = [*sums]
    sorted_ = rows.repartitionByRange("conv_id", *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(
        "conv_id", *order)
    where = [sorted_.columns.index(c) for c in sums.values()]
    at = sorted_.columns.index("conv_id")

    def scan(batches):
        last, carry = None, np.zeros(len(where), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            conv = batch.column(at).to_numpy(zero_copy_only=False)
            first, of = _within(conv)
            columns = []
            for k, c in enumerate(where):
                value = batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint64)
                total = np.cumsum(value, dtype=np.uint64)
                total -= (total[first] - value[first])[of]
                if conv[0] == last:
                    total[of == 0] += np.uint64(carry[k])
                columns.append((total & np.uint64(_MASK)).astype(np.int64))
            last, carry = conv[-1], np.array([c[-1] for c in columns])
            table = pa.Table.from_batches([batch])
            for name, c in zip(names, columns):
                table = table.append_column(name, pa.array(c))
            yield from table.combine_chunks().to_batches()

    local = written(sorted_.mapInArrow(scan, ", ".join([_fields(sorted_), *(f"`{n}` long" for n in names)])))
    # The last row of a conversation in a range holds the range's sums; it is the one that nothing follows.
    count = F.count(F.lit(1)).alias("_n")
    last = F.max(F.struct(*order, *names)).alias("_last")
    per_range = local.groupBy("conv_id", "_part").agg(count, last)
    spread = Window.partitionBy("conv_id")
    over = per_range.withColumn("_ranges", F.count(F.lit(1)).over(spread)).filter("_ranges > 1").select(
        "conv_id", "_part", *[F.col(f"_last.`{n}`").alias(n) for n in names])
    carried = [f"_carry{k}" for k in range(len(names))]

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by("_part")
        out = {"conv_id": table["conv_id"], "_part": table["_part"]}
        for n, c in zip(names, carried):
            before = np.concatenate(([0], table[n].to_numpy()[:-1])).astype(np.uint64)
            out[c] = pa.array((np.cumsum(before, dtype=np.uint64) & np.uint64(_MASK)).astype(np.int64))
        return pa.table(out)

    carries = over.groupBy("conv_id").applyInArrow(
        carry, "conv_id long, _part int, " + ", ".join(f"{c} long" for c in carried))
    joined = local.join(F.broadcast(carries), ["conv_id", "_part"], "left")
    add = [(F.col(n) + F.coalesce(c, F.lit(0))).bitwiseAND(_MASK).alias(n) for n, c in zip(names, carried)]
    return joined.select(*rows.columns, *add)


def number(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """conv_id, depth (1 for the first turn), role, text_sha256, n_words of every turn. Conversations are ordered by turn
    (null first), then role, then digest of the text; null roles and texts count as empty. Rows without a conversation
    are left out. Repeated rows are turns of their own. Other columns are not read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_sha256"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), F.lit(1).cast("long").alias("_one"),
    ).filter(F.col("conv_id").isNotNull())
    return running(rows, ["turn", "role", "text_sha256"], {"depth": "_one"}).drop("_one", "turn")


class NodeTable:
    """A minimal perfect hash of distinct digests, and the digests by slot. Each level gives a slot to the keys that are
    alone in their cell; the others go on to the next level. A key is only found where its own digest is stored."""

    def __init__(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray):
        n = len(a)
        self.depth, self.a, self.b = (np.zeros(n, np.int64) for _ in range(3))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(n), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("repeated digests have no slots of their own")
            cell = self._cell(depth[left], a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(cell, minlength=2 * len(left)) == 1
            slot = np.where(alone, base + np.cumsum(alone) - 1, -1)
            self.levels.append((slot, alone))
            placed = alone[cell]
            at = slot[cell[placed]]
            self.depth[at], self.a[at], self.b[at] = depth[left[placed]], a[left[placed]], b[left[placed]]
            base += int(alone.sum())
            left = left[~placed]

    @staticmethod
    def _cell(depth: np.ndarray, a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        h = textops.mix(a.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & (1 << 64) - 1))
        h = textops.mix(h ^ textops.mix(b.astype(np.uint64) + depth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
        return (h % np.uint64(size)).astype(np.int64)

    def find(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not in the table."""
        out, open_ = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (slot, alone) in enumerate(self.levels):
            cell = self._cell(depth[open_], a[open_], b[open_], level, len(slot))
            hit = alone[cell]
            at, which = slot[cell[hit]], open_[hit]
            same = (self.depth[at] == depth[which]) & (self.a[at] == a[which]) & (self.b[at] == b[which])
            out[which[same]] = at[same]
            open_ = open_[~hit]
        return out


_SHARD = "shard long, depth long, a long, b long, pa long, pb long, own long, leaf long, saved long"
_PARTIAL = "depth long, a long, b long, n_children long, n_leaves long, saved_tokens long"


def _sum_shard(table: pa.Table, block: int) -> pa.Table:
    """Children of each node of a shard, and sums over its subtree, of what the shard's rows bring. Nothing passes from
    one block of levels to the one above: those sums come in at its last nodes."""
    depth, a, b, pa_, pb, own, leaf, saved = (
        table[c].to_numpy() for c in ("depth", "a", "b", "pa", "pb", "own", "leaf", "saved"))
    order = np.lexsort((b, a, depth))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(depth[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    one = order[new]
    root = np.zeros(0 if (depth[one] == 0).any() else 1, np.int64)
    nodes = NodeTable(*(np.concatenate((root, x[one])) for x in (depth, a, b)))
    n = len(nodes.a)
    children, leaves, tokens = (np.zeros(n, np.int64) for _ in range(3))
    parent = np.full(n, -1, np.int64)
    below = one[(depth[one] == 1) | (depth[one] > 1) & ((depth[one] - 1) % block > 0)]
    slot = nodes.find(depth[below], a[below], b[below])
    parent[slot] = nodes.find(depth[below] - 1, pa_[below], pb[below])
    at = nodes.find(depth, a, b)
    np.add.at(leaves, at, leaf)
    np.add.at(tokens, at, saved)
    owned = np.flatnonzero((own > 0) & (depth > 0))
    up = parent[at[owned]]
    np.add.at(children, up[up >= 0], 1)
    apart = owned[up < 0]  # tops of later blocks
    by_depth = np.argsort(-nodes.depth, kind="stable")
    cuts = np.flatnonzero(np.diff(nodes.depth[by_depth])) + 1
    for level in np.split(by_depth, cuts):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(tokens, parent[level], tokens[level])
    zero = np.zeros(len(apart), np.int64)
    columns = [(nodes.depth, depth[apart] - 1), (nodes.a, pa_[apart]), (nodes.b, pb[apart]), (children, zero + 1),
               (leaves, zero), (tokens, zero)]
    return pa.table([pa.array(np.concatenate(c)) for c in columns],
                    names=["depth", "a", "b", "n_children", "n_leaves", "saved_tokens"])


def _join_ids(batches):
    """Ascending ids of each node, joined by commas, a row for each batch of rows and node."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        depth, a, b, conv = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        head = np.ones(len(conv), bool)
        head[1:] = (np.diff(depth) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
        first = np.flatnonzero(head)
        bounds = np.append(first, len(conv))
        ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pc.cast(pa.array(conv), pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[first]) for x in (depth, a, b, conv)] + [pa.array(np.diff(bounds)), pc.binary_join(ids, ",")],
            names=["depth", "a", "b", "first_id", "n", "ids"])


def _digest_ids(batches):
    """SHA-256 of all ids of a node; rows come by node, then first_id."""
    key, n, state = None, 0, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([key[1]]), pa.array([key[2]]), pa.array([n]), pa.array([state.digest()])],
            names=["depth", "a", "b", "n_ends", "ends"])

    for batch in batches:
        out = []
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        for this, more, ids in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            if this != key:
                if key is not None:
                    out.append(done())
                key, n, state = this, 0, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
            n += more
        yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else []
    if key is not None:
        yield done()


def ends_of(ends: DataFrame) -> DataFrame:
    """n_ends and SHA-256 of the ascending decimal conv_ids, joined by commas, for each node of (depth, a, b, conv_id).

    The ids are sorted and joined in ranges, so a node of any size is spread; only its joined strings meet in one task,
    which reads them once in order and keeps a hash state.
    """
    chunks = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(
        _join_ids, "depth long, a long, b long, first_id long, n long, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first_id").mapInArrow(
        _digest_ids, "depth long, a long, b long, n_ends long, ends binary")


def _same(column: str, name: str) -> Column:
    """The one value of a column in a group; an error if there are two."""
    return F.when(F.min(column) == F.max(column), F.min(column)).otherwise(
        F.raise_error(F.lit("two prefixes share a digest")).cast("long")).alias(name)


def build(numbered: DataFrame, conversations: DataFrame | None = None, shard_rows: int = SHARD_ROWS,
          block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``numbered`` turns (see ``number``; depths of a conversation are 1 to its length):

    conv_id (smallest conversation that starts with the node's turns), depth, parent_conv_id, n_convs (conversations that
    do), n_ends (those that have no further turn), n_children, n_leaves (nodes without children in the subtree),
    saved_tokens (sum over the subtree of (n_convs - 1) * n_words), n_words of the last turn, ends (SHA-256 of the ends).

    ``conversations`` (conv_id) also lists those without turns; they end at the root. Without any conversation there is
    no node. Group sums by digest combine in the map side, so a frequent prefix is no hot key; a parent with very many
    children meets them in a join that adaptive execution splits.
    """
    content = [F.col("role"), F.col("text_sha256")]
    hashed = numbered.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "n_words",
        F.xxhash64(F.lit(1), "depth", *content).bitwiseAND(_MASK).alias("_f"),
        F.xxhash64(F.lit(2), "depth", *content).bitwiseAND(_MASK).alias("_g"), F.xxhash64(F.lit(3), *content).alias("_c"))
    rows = running(hashed, ["depth"], {"a": "_f", "b": "_g"}).withColumns({
        "pa": (F.col("a") - F.col("_f")).bitwiseAND(_MASK), "pb": (F.col("b") - F.col("_g")).bitwiseAND(_MASK)})
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("_last")).select("conv_id", "_last.*")
    zero = F.lit(0).cast("long")
    if conversations is None:
        everyone, ends = last.select("conv_id"), last
    else:
        everyone = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long")).distinct()
        ends = everyone.join(last, "conv_id", "left").select(
            "conv_id", *[F.coalesce(c, zero).alias(c) for c in KEY])
    root = everyone.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        *[zero.alias(c) for c in KEY], "n_convs", "conv_id", *[zero.alias(c) for c in ("pa", "pb", "n_words")])
    found = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), _same("pa", "pa"), _same("pb", "pb"),
        F.max("n_words").alias("n_words"), _same("_c", "_c")).drop("_c")
    nodes = written(found.unionByName(root).join(ends_of(ends), KEY, "left").withColumn("n_ends", F.coalesce("n_ends", zero)))
    saved = (F.col("n_convs") - 1) * F.col("n_words")
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    owned = nodes.select("conv_id", *KEY, "pa", "pb", F.lit(1).cast("long").alias("own"), leaf.alias("leaf"), saved.alias("saved"))
    path = rows.join(nodes.select("conv_id").distinct(), "conv_id", "left_semi")
    nothing = [zero.alias(c) for c in ("own", "leaf", "saved")]
    along = path.select("conv_id", *KEY, "pa", "pb", *nothing)
    # A path longer than a block: the sums of its later blocks come in at the last node of each block.
    number_of = F.floor(F.greatest(F.col("depth") - 1, zero) / block)
    later = owned.filter(F.col("depth") > block).groupBy("conv_id", number_of.alias("_block")).agg(
        F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    seams = path.filter(F.col("depth") % block == 0).withColumn("_block", F.floor(F.col("depth") / block)).join(
        later, ["conv_id", "_block"], "left").select(
        "conv_id", *KEY, "pa", "pb", zero.alias("own"), F.sum(F.coalesce("leaf", zero)).over(upward).alias("leaf"),
        F.sum(F.coalesce("saved", zero)).over(upward).alias("saved"))
    shards = max(1, math.ceil((rows.count() + nodes.count()) / shard_rows))
    dealt = owned.unionByName(along).unionByName(seams).select(
        F.pmod(F.xxhash64("conv_id", number_of), F.lit(shards)).cast("long").alias("shard"), *KEY, "pa", "pb", "own", "leaf", "saved")
    partial = dealt.groupBy("shard").applyInArrow(lambda table: _sum_shard(table, block), _PARTIAL)
    sums = partial.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    above = nodes.select(F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"),
                         F.col("b").alias("pb"))
    return nodes.join(sums, KEY).join(above, ["depth", "pa", "pb"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_ends", "n_children", "n_leaves", "saved_tokens", "n_words",
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends"))


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
         text_col: str = "text") -> DataFrame:
    """``build`` over a table of turns, ordered as ``number`` does."""
    return build(number(turns, conv_col, turn_col, role_col, text_col))

"""Mixing of sources by temperature, realised as budgeted block permutations, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

#: Part of the greatest entropy that the mix aims at, and how often a source may be read for one reading of the
#: source that is read least.
ENTROPY_SHARE, MAX_REPEATS = 0.97, 2.0
#: Blocks of a source, and rows of the block table that may be broadcast.
BLOCKS, BROADCAST_ROWS = 64, 20_000
_GRID, _ROUNDS = 32, 4
_SEED = "mix"


@dataclass(frozen=True)
class Mix:
    """The exponent found, and the weights: source, tokens, weight, budget."""

    exponent: float
    weights: DataFrame


def _hash(*columns):
    return F.md5(F.concat_ws("|", F.lit(_SEED), *columns))


def _source(source_col: str):
    return F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def _tokens(text_col: str):
    """Words of a text, at least 1: runs of spaces and line feeds count as often as they have characters."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (F.length(text) - F.length(F.translate(text, " \n", "")) + 1).cast("long")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int) -> DataFrame:
    """source, block, order key, id and tokens of each document."""
    order = _hash(F.col(id_col).cast("string"))
    block = (F.conv(F.substring(order, 1, 8), 16, 10).cast("long") % blocks).alias("block")
    return docs.select(_source(source_col).alias("source"), block, order.alias("order_key"), _tokens(text_col).alias("tokens"))


def weights(totals: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> Mix:
    """Weights of the sources of ``totals`` (source, tokens).

    A source of share p weighs p^x / sum p^x. The exponent x is the largest in [0, 1] at which the entropy is at
    least ``entropy_share`` of ln(sources), so the mix stays as near to the data as the target allows; but it is not
    below the least x at which no source is repeated over ``max_repeats`` times for one reading of the largest
    source, (p_max / p)^(1 - x). Both are found by bisection, of _GRID parts a round. The budget of a source is its
    weight times the size at which every source is read at least once.
    """
    facts = totals.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count(F.lit(1))).first()
    if not facts[3]:
        return Mix(1.0, totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.col("tokens").alias("budget")))
    total, largest, smallest, n = facts
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        step = (high - low) / _GRID
        powers = totals.select(
            F.log(F.col("tokens") / F.lit(total)).alias("lp"),
            F.explode(F.transform(F.sequence(F.lit(0), F.lit(_GRID)), lambda i: F.lit(low) + i * step)).alias("x"))
        sums = powers.groupBy("x").agg(F.sum(F.exp(F.col("x") * F.col("lp"))).alias("z"),
                                       F.sum(F.exp(F.col("x") * F.col("lp")) * F.col("x") * F.col("lp")).alias("s"))
        entropy = F.log("z") - F.col("s") / F.col("z")
        met = sums.filter(entropy >= entropy_share * F.log(F.lit(float(n))) - 1e-12).agg(F.max("x")).first()[0]
        low = low if met is None else met
        high = min(high, low + step)
    for_entropy = low
    low, high = 0.0, 1.0
    ratio = largest / smallest
    for _ in range(60):  # the rarest source repeats most
        mid = (low + high) / 2
        low, high = (low, mid) if ratio ** (1 - mid) <= max_repeats else (mid, high)
    x = round(max(for_entropy, high), 6)
    z = totals.agg(F.sum(F.pow(F.col("tokens") / F.lit(total), F.lit(x)))).first()[0]
    weighed = totals.select(
        "source", "tokens", (F.pow(F.col("tokens") / F.lit(total), F.lit(x)) / z).alias("weight"),
        F.greatest("tokens", F.round(F.col("tokens") * F.pow(F.lit(float(largest)) / F.col("tokens"), F.lit(1 - x)))
                   .cast("long")).alias("budget"))
    return Mix(x, weighed)


def _plan(narrow: DataFrame, weighed: DataFrame, blocks: int) -> DataFrame:
    """For each source and block: full readings, and how the last, partial reading treats it: all of it, none, or the
    documents up to an order key."""
    per_block = narrow.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    known = per_block.join(weighed.select("source", "tokens", "budget"), "source").select(
        "source", "block", "block_tokens", F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("full"),
        (F.col("budget") % F.col("tokens")).alias("rest"))
    turn = _hash("source", F.col("full").cast("string"), F.col("block").cast("string"))
    before = Window.partitionBy("source").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("before", F.coalesce(F.sum("block_tokens").over(before), F.lit(0))).withColumn(
        "left", F.col("rest") - F.col("before"))
    # The block in which a budget ends: first the range of order keys (one of 4,096), then the document in it.
    ends = placed.filter("left > 0 AND left < block_tokens").select("source", "block", "left")
    inside = narrow.join(ends, ["source", "block"]).withColumn("range", F.substring("order_key", 1, 3))
    block = Window.partitionBy("source", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = inside.groupBy("source", "block", "left", "range").agg(F.sum("tokens").alias("t")).withColumn(
        "passed", F.coalesce(F.sum("t").over(block), F.lit(0))).filter("passed <= left")
    whole = ranges.filter("passed + t <= left").groupBy("source", "block").agg(F.concat(F.max("range"), F.lit("~")).alias("cut"))
    last = ranges.filter("passed + t > left").select("source", "block", "range", "passed")
    so_far = Window.partitionBy("source", "block").orderBy("order_key").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    partly = inside.join(last, ["source", "block", "range"]).withColumn(
        "until", F.col("passed") + F.sum("tokens").over(so_far)).filter("until <= left").groupBy("source", "block").agg(
        F.max("order_key").alias("cut"))
    cuts = whole.unionByName(partly).groupBy("source", "block").agg(F.max("cut").alias("cut"))
    return placed.join(cuts, ["source", "block"], "left").select(
        "source", "block", "full",
        F.when(F.col("left") >= F.col("block_tokens"), F.lit("~")).when(F.col("left") <= 0, F.lit("")).otherwise(
            F.coalesce("cut", F.lit(""))).alias("upto"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, blocks: int = BLOCKS,
        reading_col: str = "reading") -> DataFrame:
    """``docs`` with a row for each reading of a document, and its number from 0 in ``reading_col``.

    Weights are those of ``weights``. A source is read ``budget`` tokens long: whole readings, then blocks of
    documents in a permutation of their own up to the budget, the last block in the order of a hash up to the budget.
    Every document is thus read at least once, and the mix has the target weights up to a document per source.

    A document's tokens are its spaces and line feeds plus one. Null texts count as empty, null sources as the
    source ''; the hash of a null id is that of no id. Rows that repeat an id share block and order and are taken or
    left together. Other columns stay, but for one named like ``reading_col``, which is replaced.
    """
    narrow = _narrow(docs, id_col, text_col, source_col, blocks)
    totals = narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    totals = cut_lineage(totals)
    plan = cut_lineage(_plan(narrow, weights(totals, entropy_share, max_repeats).weights, blocks)).select(
        F.col("source").alias("_source"), F.col("block").alias("_block"), "full", "upto")
    small = plan.count() <= BROADCAST_ROWS
    order = _hash(F.col(id_col).cast("string"))
    rows = docs.drop(reading_col).withColumn("_order", order).withColumn("_s", _source(source_col)).withColumn(
        "_b", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % blocks)
    met = rows.join(F.broadcast(plan) if small else plan,
                    (F.col("_s") == F.col("_source")) & (F.col("_b") == F.col("_block")))
    readings = F.col("full") + F.when(F.col("_order") <= F.col("upto"), 1).otherwise(0)
    kept = [c for c in docs.columns if c != reading_col]
    return met.withColumn("_n", readings).filter("_n > 0").select(
        *kept, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias(reading_col))

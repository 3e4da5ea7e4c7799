"""Periodic runs of words, found on a Re-Pair grammar of the texts.

The words of a slice of documents get dense ids. Re-Pair replaces repeated pairs of neighbours by new symbols, round by
round; what is left of each document is paired level by level until one symbol derives it. A symbol stands for a stretch
of words with a boundary between its two halves. Every run of a document crosses the boundary of the smallest symbol that
derives all of it, so it is enough to look at each different symbol once and to copy what is found to its other places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops
from tessera.llm.substring_dedup import _kept_text

SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
          "best struct<start:long,length:long,period:long>, collapsed_text string")
BLOCK_BYTES = 4 << 20  # of texts under one grammar; a longer text has its own
MIN_WORDS, MIN_REPEATS = 24, 3
_WORD_BASE = 0x9E3779B97F4A7C15


def word_ids(words: textops.Words) -> np.ndarray:
    """A number for each word: equal exactly when the bytes are."""
    size = words.ends - words.starts
    column = textops.binary_column(
        textops.gather(words.data, words.starts, size), np.concatenate(([0], np.cumsum(size))))
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _by_key(keys: np.ndarray) -> np.ndarray:
    """Places ordered by key, then by place."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    place = int(n - 1).bit_length()
    if int(keys.max()).bit_length() + place <= 63:
        packed = (keys.astype(np.int64) << place) | np.arange(n)
        packed.sort()
        return packed & ((1 << place) - 1)
    return np.argsort(keys, kind="stable")


def _chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (at and at + 1 share a symbol) those that are replaced: better ranks first, equal pairs from
    the left, until every other pair overlaps one of them. ``at`` ascends."""
    done = []
    while len(at):
        joined = at[1:] == at[:-1] + 1
        # A stretch of one repeated pair, as in a a a: every second counts.
        same = np.concatenate(([False], joined & (rank[1:] == rank[:-1])))
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
        free = (np.arange(len(at)) - head) % 2 == 0
        wins = free.copy()
        wins[1:] &= ~(joined & (rank[1:] > rank[:-1]))
        wins[:-1] &= ~(joined & (rank[:-1] > rank[1:]))
        wins[1:] &= ~(joined & wins[:-1] & wins[1:])
        done.append(at[wins])
        out = wins.copy()
        out[1:] |= joined & wins[:-1]
        out[:-1] |= joined & wins[1:]
        at, rank = at[~out], rank[~out]
    return np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)


@dataclass
class Grammar:
    """Symbols of ``least`` words or more, by one of their places: start, boundary and end in the text, and every place
    (``symbol``, ``place``) at which a symbol stands."""

    start: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    symbol: np.ndarray
    place: np.ndarray


def re_pair(ids: np.ndarray, bounds: np.ndarray, least: int = MIN_WORDS) -> Grammar:
    """The grammar of documents ids[bounds[d]:bounds[d + 1]]. A round counts all pairs of neighbours and replaces the
    repeated ones, the most frequent first by powers of two, equal ones in hashed order, so that symbols stay balanced."""
    n = len(ids)
    symbols, place = ids.astype(np.int64), np.arange(n, dtype=np.int64)
    ends_doc = np.zeros(n, bool)
    ends_doc[bounds[1:][np.diff(bounds) > 0] - 1] = True
    next_id = int(ids.max()) + 1 if n else 0
    last_place = np.append(place[1:], n)
    found: list[tuple[np.ndarray, ...]] = []
    places: list[tuple[np.ndarray, np.ndarray]] = []
    n_rules = 0

    def keep(at: np.ndarray, rule: np.ndarray) -> None:
        nonlocal n_rules
        begin, middle, end = place[at], place[at + 1], last_place[at + 1]
        long = np.flatnonzero(end - begin >= least)
        if len(long) == 0:
            return
        _, first, which = np.unique(rule[long], return_index=True, return_inverse=True)
        first = long[first]
        found.append((begin[first], middle[first], end[first]))
        places.append((which + n_rules, begin[long]))
        n_rules += len(first)

    def merge(at: np.ndarray, new: np.ndarray) -> None:
        nonlocal symbols, place, last_place, ends_doc
        symbols[at] = new
        last_place[at] = last_place[at + 1]
        ends_doc[at] = ends_doc[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, place, last_place, ends_doc = symbols[stay], place[stay], last_place[stay], ends_doc[stay]

    fresh = 0  # pairs of two older symbols that were not repeated never become so
    while len(symbols) > 1:
        live = ~ends_doc[:-1] & ((symbols[:-1] >= fresh) | (symbols[1:] >= fresh))
        at = np.flatnonzero(live)
        left, right = symbols[at], symbols[at + 1]
        width = int(next_id).bit_length()
        if 2 * width <= 62:
            keys = (left << width) | right
        else:
            keys = np.unique(np.stack([left, right]), axis=1, return_inverse=True)[1].reshape(-1)
        order = _by_key(keys)
        ordered = keys[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        repeated = size[group] > 1
        if not repeated.any():
            break
        # Better is smaller: the class of the count, then a hash of the pair; the group number makes ranks distinct.
        level = 63 - np.floor(np.log2(size)).astype(np.int64)
        mixed = (textops.mix(ordered[new].astype(np.uint64) * np.uint64(_WORD_BASE)) >> np.uint64(34)).astype(np.int64)
        best = np.empty(len(size), np.int64)
        best[np.lexsort((mixed, level))] = np.arange(len(size))
        rank = np.full(len(at), -1, np.int64)
        rank[order[repeated]] = best[group[repeated]]
        pairs = rank >= 0
        at, rank = at[pairs], rank[pairs]
        chosen = _chosen(at, rank)
        rule = rank[np.searchsorted(at, chosen)]
        keep(chosen, rule)
        _, named = np.unique(rule, return_inverse=True)
        fresh, next_id = next_id, next_id + int(named.max()) + 1
        merge(chosen, named + fresh)
    while len(symbols) > 1:  # the rest of each document, level by level
        begins = np.concatenate(([True], ends_doc[:-1]))
        head = np.maximum.accumulate(np.where(begins, np.arange(len(symbols)), 0))
        at = np.flatnonzero(((np.arange(len(symbols)) - head) % 2 == 0) & ~ends_doc)
        if len(at) == 0:
            break
        keep(at, np.arange(len(at)))
        merge(at, symbols[at])
    none = (np.zeros(0, np.int64),) * 3
    start, middle, end = (np.concatenate(x) for x in zip(none, *found))
    symbol, where = (np.concatenate(x) for x in zip(none[:2], *places))
    return Grammar(start, middle, end, symbol, where)


class _Stretches:
    """Lengths of equal stretches in two places, by hashes of prefixes."""

    def __init__(self, ids: np.ndarray):
        values = textops.mix((ids + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.prefix = textops.prefix_hash(values, _WORD_BASE)
        self.powers = textops.powers(_WORD_BASE, len(ids) + 1)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at a and, further right, at b agree."""
        left = (self.prefix[a + length] - self.prefix[a]) * self.powers[b - a]
        return left == self.prefix[b + length] - self.prefix[b]

    def after(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a and b on agree, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(a, b, mid)
            low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(a - mid, b - mid, mid)
            low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
        return low


def _ragged(first: np.ndarray, count: np.ndarray, limit: int = 1 << 20):
    """(which, first[which] + 0 .. count[which] - 1) in slices of about ``limit`` entries."""
    total = np.concatenate(([0], np.cumsum(count)))
    for lo, hi in textops.row_slices(total, limit, 1 << 40):
        n = count[lo:hi]
        which = np.repeat(np.arange(lo, hi), n)
        yield which, first[which] + np.arange(len(which)) - (total[which] - total[lo])


def crossing(ids: np.ndarray, grammar: Grammar, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS):
    """Runs over the boundary of each symbol, inside the symbol: (symbol, start, end, period) with the least period.

    A run has half of its words or more on one side of the boundary, hence the ANCHOR words on that side stand there
    again one period away. Those places come from an index of all stretches of ANCHOR words.
    """
    # With half a run on one side and repeats r, (r / 2 - 1) periods and min_words (1 / 2 - 1 / r) words match at least.
    anchor = max(1, min(4, (min_words * (min_repeats - 2)) // (2 * min_repeats)))
    empty = (np.zeros(0, np.int64),) * 4
    n = len(ids)
    if n < anchor or len(grammar.start) == 0:
        return empty
    powers = textops.powers(_WORD_BASE, anchor)
    grams = np.zeros(n - anchor + 1, np.uint64)
    mixed = textops.mix((ids + 1).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    for i in range(anchor):
        grams += mixed[i:n - anchor + 1 + i] * powers[i]
    bits = max(1, 63 - int(n).bit_length())
    keys = textops.mix(grams) >> np.uint64(64 - bits)
    index = (keys.astype(np.int64) << (63 - bits)) | np.arange(len(keys))
    index.sort()
    places = index & ((1 << (63 - bits)) - 1)
    stretches = _Stretches(ids)
    size = grammar.end - grammar.start
    done = []
    for side in (1, -1):
        at = grammar.middle if side > 0 else grammar.middle - anchor
        furthest = size // min_repeats
        fits = (at >= grammar.start) & (at + anchor <= grammar.end) & (at >= 0) & (at < len(keys))
        which = np.flatnonzero(fits)
        key = keys[at[which]].astype(np.int64) << (63 - bits)
        lo, hi = (at[which] + 1, np.minimum(at + furthest, grammar.end - anchor)[which] + 1) if side > 0 else (
            np.maximum(at - furthest, grammar.start)[which], at[which])
        first = np.searchsorted(index, key | lo)
        count = np.searchsorted(index, key | np.maximum(lo, hi)) - first
        for row, entry in _ragged(first, count):
            symbol = which[row]
            other = places[entry]
            near, far = (at[symbol], other) if side > 0 else (other, at[symbol])
            period = far - near
            # What must agree next to the boundary, before the lengths are sought.
            need = np.maximum(-(-(min_repeats - 2) * period // 2), anchor)
            a = near if side > 0 else near + anchor - need
            ok = (a >= grammar.start[symbol]) & (a + period + need <= grammar.end[symbol])
            symbol, near, far, period, need, a = (x[ok] for x in (symbol, near, far, period, need, a))
            ok = stretches.equal(a, a + period, need)
            symbol, near, far, period = (x[ok] for x in (symbol, near, far, period))
            start = near - stretches.before(near, far, near - grammar.start[symbol])
            end = far + stretches.after(near, far, grammar.end[symbol] - far)
            ok = end - start >= np.maximum(min_words, min_repeats * period)
            done.append((symbol[ok], start[ok], end[ok], period[ok]))
    symbol, start, end, period = (np.concatenate(x) for x in zip(empty, *done))
    order = np.lexsort((period, end, start, symbol))
    symbol, start, end, period = (x[order] for x in (symbol, start, end, period))
    new = np.ones(len(symbol), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    symbol, start, end, period = (x[new] for x in (symbol, start, end, period))
    for row, i in _ragged(start, end - start - period):
        if (ids[i] != ids[i + period[row]]).any():
            raise ArithmeticError("two different stretches of words share a hash")
    return symbol, start, end, period


def runs_of(ids: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS):
    """All runs (start, end, period) of all documents, by start, then period."""
    grammar = re_pair(ids, bounds, min_words)
    symbol, start, end, period = crossing(ids, grammar, min_words, min_repeats)
    # To every place of the symbol.
    by_symbol = np.argsort(grammar.symbol, kind="stable")
    placed = grammar.symbol[by_symbol]
    first = np.searchsorted(placed, symbol)
    count = np.searchsorted(placed, symbol, "right") - first
    parts = [(np.zeros(0, np.int64),) * 3]
    for row, entry in _ragged(first, count):
        shift = grammar.place[by_symbol[entry]] - grammar.start[symbol[row]]
        parts.append((start[row] + shift, end[row] + shift, period[row]))
    start, end, period = (np.concatenate(x) for x in zip(*parts))
    if len(start) == 0:
        return start, end, period
    # Stretches of one period that share a period or more belong to one run.
    doc = np.searchsorted(bounds, start, "right") - 1
    order = np.lexsort((start, period, doc))
    doc, start, end, period = (x[order] for x in (doc, start, end, period))
    head = np.ones(len(start), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (period[1:] != period[:-1])
    group = np.cumsum(head) - 1
    reach = np.maximum.accumulate(end + group * (int(bounds[-1]) + 1)) - group * (int(bounds[-1]) + 1)
    head[1:] |= start[1:] + period[1:] > reach[:-1]
    first = np.flatnonzero(head)
    start, period, end = start[first], period[first], np.maximum.reduceat(end, first)
    # A multiple of a period has the same run.
    order = np.lexsort((period, end, start))
    start, end, period = (x[order] for x in (start, end, period))
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = (x[new] for x in (start, end, period))
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _table(ids: pa.Array, column: pa.Array, min_words: int, min_repeats: int) -> pa.Table:
    words = textops.words_of(column)
    bounds = np.concatenate(([0], np.cumsum(words.counts)))
    start, end, period = runs_of(word_ids(words), bounds, min_words, min_repeats)
    doc = np.searchsorted(bounds, start, "right") - 1
    per_doc = np.bincount(doc, minlength=len(words.counts))
    fields = ["start", "length", "period"]
    values = [start - bounds[doc], end - start, period]
    listed = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(per_doc))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], fields))
    # Quotients of whole numbers below 2 ** 26 are equal as doubles exactly when they are equal.
    order = np.lexsort((period, start, -(end - start) / period, doc))
    best = np.full(len(words.counts), -1, np.int64)
    best[doc[order[::-1]]] = order[::-1]
    none = best < 0
    pick = np.where(none, 0, best)
    chosen = pa.StructArray.from_arrays(
        [pa.array(v[pick] if len(v) else np.zeros(len(pick), np.int64), pa.int64()) for v in values], fields,
        mask=pa.array(none))
    steps = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.subtract.at(steps, end, 1)
    keep = np.cumsum(steps)[:-1] <= 0
    return pa.table({
        "doc_id": ids, "n_words": pa.array(words.counts, pa.int64()), "runs": listed, "best": chosen,
        "collapsed_text": _kept_text(words, keep)})


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
         min_repeats: int = MIN_REPEATS) -> DataFrame:
    """One row per document: its runs by start, then period; the run with most repeats (ties: least start, then
    period); and the text without all but the first period of each run, words joined by one space.

    A word is a maximal stretch of characters other than space and \\x09-\\x0D. A run is a stretch of ``min_words`` words
    or more, and ``min_repeats`` (3 or more) of its least period, in which words one period apart are identical, and
    which no neighbouring word extends. Null, empty and short texts have no runs; rows are taken one by one, so repeated
    ids, null ids and repeated rows are as they come; other columns are not read.

    Nothing is shuffled: a task makes one grammar for BLOCK_BYTES of its texts, or for one longer text. Memory follows
    the block or the longest text, about 200 bytes a word.
    """
    if min_repeats < 3 or min_words < 2 * min_repeats:
        raise ValueError("runs need 3 repeats or more, and twice as many words")

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            _, offsets = textops.text_buffers(column)
            for lo, hi in textops.row_slices(offsets, BLOCK_BYTES):
                yield from _table(ids.slice(lo, hi - lo), column.slice(lo, hi - lo), min_words, min_repeats
                                  ).combine_chunks().to_batches()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)

"""Toxicity from the nearest labelled examples by exact TF-IDF cosine."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops
from tessera.session import cut_lineage

#: Bounds of the fitted model: examples of each label, neighbours that vote. BLOCK is only how examples are shown.
EXAMPLES, BLOCK, NEIGHBOURS = 2048, 64, 16
#: All terms of the examples count. A term weighs x / (x + CHI_SQUARE), where x is its chi-square if it is commoner in
#: label 1 (else 0) plus FLOOR: terms that do not mark label 1 weigh little, none weighs nothing.
CHI_SQUARE, FLOOR = 25, 1
#: The commonest terms of the examples are held as dense rows, the others as lists of the examples that have them.
HEAD = 1024
_ROWS, _PRODUCTS = 128, 1 << 17
#: Terms are words and their first bytes, which catch families of words.
PREFIXES = (3, 4, 5, 6)
_BASE = 0x9E3779B97F4A7C15
_GRID = 1 << 24

SCHEMA = "score double, evidence array<struct<doc_id:long,cosine:double,label:int>>"


def _separators() -> np.ndarray:
    out = np.ones(256, bool)
    out[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return out


_SEPARATOR = _separators()


def _term_slices(column: pa.Array):
    """Per slice of rows: (first row, last row, term hashes, their rows). Words are runs of ASCII letters and
    digits and other characters beyond ASCII; ASCII letters count as lower case."""
    data, offsets = textops.text_buffers(column)
    values = textops.byte_values(fold_ascii=True)
    for lo, hi in textops.row_slices(offsets, rows=1024):
        piece = data[offsets[lo]:offsets[hi]]
        cuts = offsets[lo:hi + 1] - offsets[lo]
        s, e = textops.word_spans(np.where(_SEPARATOR[piece], np.uint8(32), np.uint8(1)), cuts)
        row = np.searchsorted(cuts, s, "right") - 1 + lo
        prefix = textops.prefix_hash(values[piece], _BASE)
        hashes, rows = [textops.mix(textops.range_hash(prefix, s, e, _BASE))], [row]
        for k in PREFIXES:
            long = e - s >= k
            h = textops.range_hash(prefix, s[long], s[long] + k, _BASE)
            hashes.append(textops.mix(h ^ np.uint64(0xA24BAED4963EE407 * k % (1 << 64))))
            rows.append(row[long])
        yield lo, hi, np.concatenate(hashes), np.concatenate(rows)


class _Lookup:
    """Places of term hashes in a sorted vocabulary."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        bits = min(24, max(16, (4 * len(terms)).bit_length()))
        self.shift = np.uint64(64 - bits)
        buckets = np.bincount((terms >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start = np.concatenate(([0], np.cumsum(buckets))).astype(np.int32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and the places of those."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        left, hits, places = np.flatnonzero(at < end), [], []
        while len(left):
            equal = self.terms[at[left]] == hashes[left]
            hits.append(left[equal])
            places.append(at[left[equal]])
            left = left[~equal]
            at[left] += 1
            left = left[at[left] < end[left]]
        return np.concatenate([np.zeros(0, np.int64), *hits]), np.concatenate([np.zeros(0, np.int64), *places])

    def counts(self, column: pa.Array):
        """Per slice of rows: (first row, last row, row, place, count) for the terms found."""
        size = max(len(self.terms), 1)
        for lo, hi, hashes, rows in _term_slices(column):
            hit, at = self.places(hashes)
            key, n = np.unique(rows[hit].astype(np.int64) * size + at, return_counts=True)
            yield lo, hi, key // size, key % size, n


def _weighted(rows: np.ndarray, places: np.ndarray, counts: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Entries of unit TF-IDF vectors of n rows."""
    out = np.log(counts, dtype=np.float64)
    out += 1
    out *= weights[places]
    norm = np.sqrt(np.bincount(rows, out * out, minlength=n))
    return out / norm[rows]


@dataclass(frozen=True)
class Model:
    """Vocabulary, example index and calibration. For term t, ``holders[starts[t]:starts[t + 1]]`` are the numbers of
    the examples that have it and ``values`` its entries in their unit vectors."""

    terms: np.ndarray
    idf: np.ndarray
    mark: np.ndarray
    starts: np.ndarray
    holders: np.ndarray
    values: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    steps: np.ndarray
    step_scores: np.ndarray

    @cached_property
    def weights(self) -> np.ndarray:
        return self.idf * self.mark

    @cached_property
    def head(self) -> tuple[np.ndarray, np.ndarray]:
        """The dense row of each term or -1, and the dense rows."""
        length = np.diff(self.starts)
        common = np.sort(np.argsort(-length, kind="stable")[:HEAD])
        row = np.full(len(length), -1, np.int32)
        row[common] = np.arange(len(common))
        term = np.repeat(row, length)
        dense = np.zeros((len(common), len(self.ids)))
        dense[term[term >= 0], self.holders[term >= 0]] = self.values[term >= 0]
        return row, dense

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        size = min(BLOCK, len(self.ids) - b * BLOCK)
        mine = np.flatnonzero(self.holders // BLOCK == b)
        used, column = np.unique(np.searchsorted(self.starts, mine, "right") - 1, return_inverse=True)
        dense = np.zeros((size, len(used)), np.float32)
        dense[self.holders[mine] % BLOCK, column] = self.values[mine]
        return used, dense

    @property
    def block_terms(self) -> list[np.ndarray]:
        """The terms that occur in each BLOCK of examples."""
        return [self._block(b)[0] for b in range(-(-len(self.ids) // BLOCK))]

    @property
    def block_vectors(self) -> list[np.ndarray]:
        """The unit vectors of each BLOCK of examples over its terms."""
        return [self._block(b)[1] for b in range(-(-len(self.ids) // BLOCK))]

    def _cosines(self, rows: np.ndarray, places: np.ndarray, entries: np.ndarray, n: int) -> np.ndarray:
        row, dense = self.head
        size, at = len(self.ids), row[places]
        common = at >= 0
        queries = np.zeros((n, len(dense)))
        queries[rows[common], at[common]] = entries[common]
        out = (queries @ dense).ravel()
        rows, places, entries = rows[~common], places[~common], entries[~common]
        first, length = self.starts[places], self.starts[places + 1] - self.starts[places]
        upto = np.cumsum(length)
        lo = 0
        while lo < len(rows):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + _PRODUCTS, "right")))
            many = length[lo:hi]
            where = np.repeat(first[lo:hi] - (upto[lo:hi] - many - done), many) + np.arange(many.sum())
            base, end = rows[lo] * size, (rows[hi - 1] + 1) * size
            out[base:end] += np.bincount(np.repeat(rows[lo:hi] * size - base, many) + self.holders[where],
                                         np.repeat(entries[lo:hi], many) * self.values[where], minlength=end - base)
            lo = hi
        return out.reshape(n, size)

    def nearest(self, rows: np.ndarray, places: np.ndarray, entries: np.ndarray, n: int,
                skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the NEIGHBOURS nearest examples with a positive cosine, nearest first; -1 for none.

        The queries are n sparse unit vectors, their entries in the order of rows. Cosines are compared on a grid of
        2^-24, equal ones by the example's number, so the result does not depend on the order of the sums.
        """
        size = len(self.ids)
        best = np.full((n, NEIGHBOURS), -1, np.int64)
        for lo in range(0, n if size else 0, _ROWS):
            hi = min(lo + _ROWS, n)
            a, b = np.searchsorted(rows, (lo, hi))
            grid = np.rint(self._cosines(
                rows[a:b].astype(np.int64) - lo, places[a:b], entries[a:b].astype(np.float64), hi - lo) * _GRID).astype(np.int64)
            key = np.where(grid > 0, grid * size + (size - 1 - np.arange(size)), -1)
            if skip is not None:
                own = np.flatnonzero(skip[lo:hi] >= 0)
                key[own, skip[lo:hi][own]] = -1
            top = min(NEIGHBOURS, size)
            best[lo:hi, :top] = -np.sort(np.partition(-key, top - 1, axis=1)[:, :top], axis=1)
        none = best < 0
        return np.where(none, 0.0, best // max(size, 1) / _GRID), np.where(none, -1, size - 1 - best % max(size, 1))

    def neighbours(self, queries: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` for dense vectors."""
        rows, places = np.nonzero(queries)
        return self.nearest(rows, places, queries[rows, places], len(queries), skip)

    def vote(self, cosines: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Votes weighted by squared cosine, drawn to the prior where the neighbours are far."""
        weight = cosines ** 2
        label = np.where(numbers >= 0, self.labels[np.maximum(numbers, 0)] if len(self.labels) else 0, 0)
        return ((weight * label).sum(1) + 0.2 * self.prior) / (weight.sum(1) + 0.2)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, self.steps, self.step_scores)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the monotone fit of y over x, as the mean x and the value of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order]):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], top)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _sample(labels: DataFrame, label_col: str, examples: int) -> tuple[list, dict[int, int]]:
    """Up to ``examples`` labelled ids of each label in the order of a hash, and how many there are of each."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(label_col).cast("int")).alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        rows += [(r.doc_id, r.label) for r in part.collect()]
    return rows, totals


def _without_copies(texts: DataFrame) -> DataFrame:
    """One of the examples of a label that share their least hash of three words: copies and most near copies. Else the
    words of one toxic text that was copied often would count as marks of toxicity."""

    def sketch(batches):
        for batch in batches:
            words = textops.words_of(batch.column("text"))
            hashes, start = textops.windows(words.hashes, words.counts, 3)
            row = words.row_of[start]
            least = np.zeros(batch.num_rows, np.uint64)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
            if len(first):
                least[row[first]] = np.minimum.reduceat(hashes, first)
            for r in np.flatnonzero(least == 0):  # shorter texts
                at = words.counts[:r].sum()
                least[r] = np.bitwise_xor.reduce(words.hashes[at:at + words.counts[r]], initial=np.uint64(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], [*batch.schema.names, "sketch"])

    known = texts.select("doc_id", "label", "text").mapInArrow(sketch, "doc_id long, label int, text string, sketch long")
    return known.groupBy("sketch", "label").agg(F.min(F.struct("doc_id", "text")).alias("one")).select("one.*", "label")


def _example_terms(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and labels of the examples in the order of both, and the terms of all: example, hash, count."""

    def count(batches):
        for batch in batches:
            for lo, hi, hashes, rows in _term_slices(batch.column("text")):
                order = np.lexsort((hashes, rows))
                hashes, rows = hashes[order], rows[order]
                new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])))[:len(rows)])
                n = np.diff(np.concatenate((new, [len(rows)])))
                at = np.searchsorted(rows[new], np.arange(lo, hi + 1))
                column = lambda x, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo), "label": batch.column("label").slice(lo, hi - lo),
                    "terms": column(hashes[new].view(np.int64), pa.int64()), "counts": column(n, pa.int32())})

    found = texts.select("doc_id", "label", "text").mapInArrow(
        count, "doc_id long, label int, terms array<long>, counts array<int>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    ids, label = (found.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "label"))
    flat = lambda c: pa.chunked_array([x.flatten() for x in found.column(c).chunks]).to_numpy()
    size = pc.list_value_length(found.column("terms")).to_numpy()
    return (ids, label, np.repeat(np.arange(len(ids), dtype=np.int32), size), flat("terms").astype(np.int64).view(np.uint64),
            flat("counts").astype(np.int32))


def _document_frequency(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and their number; a task sends one row per term."""

    def count(batches):
        lookup, total, rows = _Lookup(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for _, _, _, places, _ in lookup.counts(batch.column(0)):
                total += np.bincount(places, minlength=len(terms))
        n = np.concatenate(([rows], total))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"place": pa.array(some - 1), "n": pa.array(n[some], pa.int64())})

    sums = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    out = np.zeros(len(terms) + 1)
    out[found.column("place").to_numpy() + 1] = found.column("n").to_numpy()
    return out[1:], int(out[0])


def _own_votes(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label of each example and the vote of the others on it, in the order of the ids. The examples are scored in tasks
    like any other text, so the driver holds one row of numbers for each."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        lookup = _Lookup(m.terms)
        for batch in batches:
            ids, known = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, hi, rows, places, n in lookup.counts(batch.column(2)):
                own = np.minimum(np.searchsorted(m.ids, ids[lo:hi]), max(len(m.ids) - 1, 0))
                own = np.where(m.ids[own] == ids[lo:hi], own, -1) if len(m.ids) else np.full(hi - lo, -1)
                rows = rows - lo
                entries = _weighted(rows, places, n, m.weights, hi - lo)
                votes = m.vote(*m.nearest(rows, places, entries, hi - lo, own))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids[lo:hi]), "label": pa.array(known[lo:hi]), "vote": pa.array(votes)})

    found = texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, vote double").toArrow()
    shared.destroy()
    found = found.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return found.column("label").to_numpy().astype(np.int64), found.column("vote").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        examples: int = EXAMPLES) -> Model:
    """Learn from the labelled rows of ``labels`` (doc_id and ``label_col``, 0 or 1).

    Examples are at most ``examples`` rows of each label, chosen by a hash of their id, less copies; the vocabulary is
    all of their terms, which the driver holds. The frequency of each term is counted over all of ``docs``.
    A vote of neighbours turns into a probability by a monotone fit over the examples, each scored without
    itself and weighted so that the labels have the shares they have in ``labels``.

    Rows whose label is null or neither 0 nor 1 are not used; an id that is labelled twice has the larger label.
    Without examples of both labels the score is the share of label 1, or 0.5.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen, totals = _sample(labels.select(F.col("doc_id").cast("long").alias("doc_id"), label_col), label_col, examples)
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int"))
    texts = cut_lineage(_without_copies(narrow.join(sample, "doc_id")))
    ids, label, holder, hashes, counts = _example_terms(texts)
    vocabulary = np.unique(hashes)
    # Entries stand in the order of (example, term); they are many, so nothing more than needed is held of them.
    places = np.searchsorted(vocabulary, hashes).astype(np.int32)
    del hashes
    count = sum(totals.values())
    prior = totals.get(1, 0) / count if count else 0.5
    flat = (np.array([0.0, 1.0]), np.array([prior, prior]))
    if not len(vocabulary) or not 0 < label.sum() < len(label):
        none = np.zeros(0, np.int64)
        return Model(none.view(np.uint64), np.zeros(0), np.zeros(0), np.zeros(1, np.int64), none, np.zeros(0, np.float32),
                     none, none, prior, *flat)
    n = np.bincount(places)
    rate = label.sum() / len(label)
    excess = np.bincount(places, label[holder]) - n * rate
    strength = np.where(excess > 0, excess ** 2 / (n * rate * (1 - rate) * (1 - n / (len(label) + 1))), 0) + FLOOR
    mark = strength / (strength + CHI_SQUARE)
    frequency, n_docs = _document_frequency(narrow, vocabulary)
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    # Examples without a term cannot be neighbours; the others are numbered in the order of their ids.
    some = np.bincount(holder, minlength=len(ids)) > 0
    own = np.where(some, np.cumsum(some) - 1, -1)
    entries = _weighted(holder, places, counts, idf * mark, len(ids)).astype(np.float32)
    del counts
    by_term = np.argsort(places, kind="stable")
    starts = np.concatenate(([0], np.cumsum(n)))
    model = Model(vocabulary, idf, mark, starts, own.astype(np.int32)[holder[by_term]], entries[by_term], ids[some],
                  label[some], prior, *flat)
    del by_term
    del holder, places, entries
    label, votes = _own_votes(texts, model)
    share = {k: totals.get(k, 0) / max(1, (label == k).sum()) for k in (0, 1)}
    steps, scores = _isotonic(votes, label.astype(float), np.where(label == 1, share[1], share[0]))
    return replace(model, steps=steps, step_scores=scores)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier) and ``evidence``, the three nearest examples.

    Whole texts are read; nothing is shuffled. The model is broadcast: its size is bounded by the texts of the
    examples (tens of megabytes). Null, empty and all other texts without a known term have no neighbours and get
    the score that such examples have. Other columns stay, but for ones named score or evidence, which are replaced.
    """
    base = docs.drop("score", "evidence")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = base.columns

    def run(batches):
        m = shared.value
        lookup = _Lookup(m.terms)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            text = table.column(names.index(text_col))
            for lo, hi, rows, places, n in lookup.counts(text):
                rows = rows - lo
                cosines, numbers = m.nearest(rows, places, _weighted(rows, places, n, m.weights, hi - lo), hi - lo)
                top = numbers[:, :3]
                at = np.concatenate(([0], np.cumsum((top >= 0).sum(1))))
                flat = top[top >= 0]
                evidence = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(m.ids[flat], pa.int64()), pa.array(cosines[:, :3][top >= 0]),
                     pa.array(m.labels[flat], pa.int32())], ["doc_id", "cosine", "label"]))
                part = table.slice(lo, hi - lo).append_column(
                    "score", pa.array(m.calibrated(m.vote(cosines, numbers)))).append_column("evidence", evidence)
                yield from part.combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{fields}, {SCHEMA}")

"""Stupid-backoff scores of documents under a word n-gram model of all other documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import exchange, textops

BACKOFF = 0.4
#: Smaller chunks than elsewhere: every word stands for several n-grams.
CHUNK_BYTES = 4 << 20
SCHEMA = "doc_id long, n_words long, log10_sum double, log10_mean double"
#: A key that no n-gram is given: its count is the number of words.
_TOTAL = np.uint64(0)


def _grams(words: textops.Words, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of all n-grams, order by order, and for each order the words where its n-grams end."""
    hashes, ends = [], []
    for n in range(1, order + 1):
        h, start = textops.windows(words.hashes, words.counts, n)
        h = textops.mix(h ^ np.uint64(0xA24BAED4963EE407 * n % (1 << 64)))
        hashes.append(np.maximum(h, np.uint64(1)))
        ends.append(start + n - 1)
    return np.concatenate(hashes), ends


def _with_total(uniq: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([_TOTAL], uniq)), np.concatenate(([words], counts))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2,
          backoff: float = BACKOFF) -> DataFrame:
    """One row per document: words, sum and mean of the decimal logarithms of their stupid-backoff scores.

    The score of a word is count(n-gram) / count(context) for the longest n-gram up to ``order`` that other
    documents contain, times ``backoff`` for each shorter step; a word unseen elsewhere counts as half an
    occurrence after one more step. Counts are those of all documents less the document's own, so that a text does
    not vouch for itself. Words are runs of anything but ASCII white space, unchanged.

    The count table is partitioned by the hash of the n-gram; each chunk of documents sends its distinct n-grams
    with their counts, joins the answers to its exploded n-grams and sums them per document.

    Null and empty texts have no words, sum 0 and a null mean. Rows that repeat an id are documents of their own,
    as are rows with a null id. Other columns are not read.
    """

    def send(table: pa.Table):
        words = textops.words_of(table["text"])
        hashes, _ = _grams(words, order)
        uniq, counts, _ = exchange.combine(hashes, np.ones(len(hashes), np.int64), np.add)
        return _with_total(uniq, counts, len(words.hashes))

    def finish(table: pa.Table, others: np.ndarray) -> pa.Table:
        words = textops.words_of(table["text"])
        hashes, ends = _grams(words, order)
        uniq, counts, place = exchange.combine(hashes, np.ones(len(hashes), np.int64), np.add)
        uniq, counts = _with_total(uniq, counts, len(words.hashes))
        counts, place = counts + others, place + 1
        row = words.row_of
        owner = np.concatenate([row[e] for e in ends])
        pairs = owner.astype(np.uint64) * np.uint64(len(uniq)) + place.astype(np.uint64)
        _, own, at = exchange.combine(pairs, np.ones(len(pairs), np.int64), np.add)
        left = counts[place] - own[at]
        n_words = len(words.hashes)
        total = counts[0] - words.counts[row]
        by_order, begin = [], 0
        for e in ends:
            c = np.zeros(n_words, np.int64)
            c[e] = left[begin:begin + len(e)]
            by_order.append(c)
            begin += len(e)
        value = 0.5 * backoff ** order / np.maximum(total, 1)
        for n in range(1, order + 1):
            c = by_order[n - 1]
            context = total if n == 1 else np.concatenate(([0], by_order[n - 2][:-1]))
            seen = c > 0
            value[seen] = backoff ** (order - n) * c[seen] / context[seen]
        sums = np.bincount(row, np.log10(value), len(words.counts)) if n_words else np.zeros(len(words.counts))
        some = words.counts > 0
        mean = np.divide(sums, words.counts, out=np.zeros(len(sums)), where=some)
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(words.counts, pa.int64()), "log10_sum": pa.array(sums),
            "log10_mean": pa.array(mean, mask=~some),
        })

    return exchange.corpus_figures(exchange.chunked(docs, id_col, text_col, CHUNK_BYTES), send, np.add, finish, SCHEMA)

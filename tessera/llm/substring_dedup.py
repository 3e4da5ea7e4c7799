"""Substring dedup: passages that also start in an earlier document are cut out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import exchange, textops

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept_text string"


def _window_keys(width: int):
    def keys(table: pa.Table):
        ids = table["doc_id"].to_numpy(zero_copy_only=False)
        known = ~np.asarray(table["doc_id"].is_null())
        words = textops.words_of(table["text"])
        hashes, start = textops.windows(words.hashes, words.counts, width)
        row = words.row_of[start]
        use = known[row]
        owner = np.where(known, np.nan_to_num(ids), 0).astype(np.int64)[row[use]] if len(row) else np.zeros(0, np.int64)
        uniq, first, place = exchange.combine(hashes[use], owner, np.minimum)
        return words, start[use], owner, uniq, first, place

    return keys


def _kept_text(words: textops.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    row = words.row_of
    parts, ends = [], np.zeros(len(words.counts) + 1, np.int64)
    bounds = np.concatenate(([0], np.cumsum(words.counts)))
    for lo, hi in textops.row_slices(words.offsets):
        at = slice(bounds[lo], bounds[hi])
        k = keep[at]
        s, e, r = words.starts[at][k], words.ends[at][k], row[at][k]
        follows = np.concatenate((r[1:] == r[:-1], [False])) if len(r) else np.zeros(0, bool)
        size = e - s + follows
        # A word is followed by one byte of the text, overwritten by a space where another kept word follows.
        piece = textops.gather(np.append(words.data, np.uint8(32)) if len(e) and e[-1] == len(words.data) else words.data,
                               s, size).copy()
        piece[np.cumsum(size)[follows] - 1] = 32
        ends[lo + 1:hi + 1] = np.bincount(r - lo, size, hi - lo).astype(np.int64)
        parts.append(piece)
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return textops.binary_column(data, np.cumsum(ends), pa.string())


def _spans(words: textops.Words, cut: np.ndarray) -> pa.Array:
    """Maximal runs of removed words of each row, as places counted from 0, both included."""
    row = words.row_of
    begin = np.cumsum(words.counts) - words.counts
    edge = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    before = np.concatenate(([False], cut[:-1])) if len(cut) else cut
    first = np.flatnonzero(cut & (edge | ~before))
    after = np.concatenate((cut[1:], [False])) if len(cut) else cut
    last = np.flatnonzero(cut & (np.append(edge[1:], True) | ~after)) if len(cut) else first
    at = row[first]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(words.counts)))))
    fields = pa.StructArray.from_arrays([pa.array(first - begin[at]), pa.array(last - begin[at])], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """One row per document with its word count, the removed intervals and the kept words.

    A word goes if a window of ``width`` consecutive words covers it whose word sequence also starts in a
    document with a smaller id. Every window gets a 64-bit Rabin-Karp hash; the smallest id of each hash is
    found over the whole corpus, and the windows of a document that have a smaller id elsewhere merge into
    maximal intervals. Windows count as equal when their hashes are: among n windows about n^2 / 2^65 pairs are
    wrongly equal, two pairs in ten billion windows.

    Null texts have no words; a text shorter than a window loses none. Rows with a null id are neither searched
    nor cut. Rows that repeat an id count as one document and never cut each other. Other columns are not read.
    """
    keys = _window_keys(width)

    def send(table: pa.Table):
        _, _, _, uniq, first, _ = keys(table)
        return uniq, first

    def finish(table: pa.Table, others: np.ndarray) -> pa.Table:
        words, start, owner, _, first, place = keys(table)
        smallest = first + others
        repeated = start[owner > smallest[place]] if len(start) else start
        steps = np.zeros(len(words.starts) + 1, np.int64)
        steps[:-1] += np.bincount(repeated, minlength=len(words.starts))
        np.subtract.at(steps, repeated + width, 1)
        cut = np.cumsum(steps)[:-1] > 0
        removed = np.bincount(words.row_of[cut], minlength=len(words.counts))
        return pa.table({
            "doc_id": table["doc_id"], "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "spans": _spans(words, cut),
            "kept_text": _kept_text(words, ~cut),
        })

    return exchange.corpus_figures(exchange.chunked(docs, id_col, text_col), send, np.minimum, finish, SCHEMA)

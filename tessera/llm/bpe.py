"""Byte-level BPE: encoding by replaying all merges over the distinct words of a batch, and decoding."""

from __future__ import annotations

import base64
import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textops

#: White space of the pre-tokenising pattern, and the endings it splits off after an apostrophe.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Distinct words remembered by a task; beyond them it starts afresh, with the same results.
REMEMBERED = 300_000
#: Bytes of text whose new words are replayed together, and that are turned to ids at a time.
CORPUS_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Vocabulary:
    """Ranks as arrays: of single bytes, of pairs of tokens, and the bytes of each token."""

    byte_rank: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    token_bytes: np.ndarray
    token_ends: np.ndarray

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that a pair merges to, or the largest integer."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a rank file: base64 of a token's bytes and its rank in each line; every single byte has a rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = rank
    keys = np.array(sorted(pairs), np.int64)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Vocabulary(
        np.array([ranks[bytes([b])] for b in range(256)], np.int64),
        keys, np.array([pairs[k] for k in keys.tolist()], np.int64),
        np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens]))),
    )


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 anything else, for every code point."""
    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (0, f"[{WHITE_SPACE}]")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def word_starts(points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Where the matches of the pattern begin, for the code points of several rows, each matched on its own.

    White space runs give their last character to what follows: as its prefix if it is a space, else as a match
    of its own. A single apostrophe that no space precedes takes one of ENDINGS from the letters after it.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[row_starts] = True
    edge[n] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    space = kind == 0
    before_is_space = np.zeros(n, bool)
    before_is_space[1:] = points[:-1] == 32
    before_is_space &= ~edge[:-1]
    begin = new & (space | ~before_is_space)
    gives = space[:-1] & ~space[1:] & ~edge[1:-1]
    begin[:-1] |= gives
    quote = np.flatnonzero((points[:-1] == 39) & begin[:-1] & new[1:] & (kind[1:] == 1) & ~edge[1:-1])
    # The ends of rows stand as code point 0, so that no ending reaches over them.
    ahead = [np.where(edge[np.minimum(quote + k, n)], 0, points[np.minimum(quote + k, n - 1)]) for k in (1, 2)]
    for ending in ENDINGS:
        hit = ahead[0] == ord(ending[0])
        if len(ending) == 2:
            hit &= ahead[1] == ord(ending[1])
        at = quote[hit]
        begin[at + 1] = False
        after = at + 1 + len(ending)
        after = after[after < n]
        begin[after[~edge[after]]] |= kind[after[~edge[after]]] == 1
    return np.flatnonzero(begin)


def _one_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """The same merges for a single word, one at a time."""
    ids = vocabulary.byte_rank[np.frombuffer(word, np.uint8)]
    while len(ids) > 1:
        ranks = vocabulary.rank(ids[:-1], ids[1:])
        at = int(ranks.argmin())
        if ranks[at] == _NONE:
            break
        ids = np.concatenate((ids[:at], [ranks[at]], ids[at + 2:]))
    return ids.tolist()


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and the offsets of the words.

    ``index`` maps a merge's rank to the places of its pairs in all words. Merges are applied in the order of
    their ranks, each to all its places at once; only the pairs left and right of a merged place change and are
    entered anew. Where a merge makes a pair of a still lower rank in a word that has the merge twice, the word is
    done by itself, since its order then matters.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    token = vocabulary.byte_rank[data]
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(sizes)
    after[ends[sizes > 0] - 1] = -1
    before[(ends - sizes)[sizes > 0]] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, _NONE)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []
    alone: set[int] = set()

    def enter(places: np.ndarray) -> None:
        ranks = pair[places]
        places, ranks = places[ranks != _NONE], ranks[ranks != _NONE]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        for rank, part in zip(ranks[first].tolist(), np.split(places, first[1:])):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                heapq.heappush(queue, rank)

    left = np.flatnonzero(after >= 0)
    pair[left] = vocabulary.rank(token[left], token[after[left]])
    enter(left)
    while queue:
        rank = heapq.heappop(queue)
        parts = index.pop(rank)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        at = at[pair[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:  # of overlapping places every second one, from the left
            chained = np.concatenate(([False], at[1:] == after[at[:-1]]))
            if chained.any():
                count = np.arange(len(at))
                since = count - np.maximum.accumulate(np.where(chained, 0, count))
                at = at[since % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        several = np.zeros(0, np.int64)
        if len(at) > 1:  # places are in the order of words
            again = word[at[1:]] == word[at[:-1]]
            if again.any():
                several = np.flatnonzero(np.concatenate(([False], again)) | np.concatenate((again, [False])))
                near = np.concatenate((beyond[several], before[at[several]]))
                there = np.maximum(near, 0)
                side = np.full(len(several), rank, np.int64)
                ahead = vocabulary.rank(np.concatenate((side, token[there[len(several):]])),
                                        np.concatenate((token[there[:len(several)]], side)))
                low = np.concatenate((at[several], at[several]))[(near >= 0) & (ahead < rank)]
                alone.update(word[low].tolist())
        token[at] = rank
        after[at] = beyond
        before[beyond[beyond >= 0]] = at[beyond >= 0]
        alive[gone] = False
        pair[gone] = _NONE
        touched = np.concatenate((at, before[at]))
        touched = np.unique(touched[touched >= 0]) if len(touched) > 2 else touched[touched >= 0]
        right = after[touched]
        has = right >= 0
        pair[touched] = np.where(has, vocabulary.rank(token[touched], token[np.where(has, right, 0)]), _NONE)
        if len(several):
            lower = touched[pair[touched] < rank]
            alone.update(np.intersect1d(word[at[several]], word[lower]).tolist())
        enter(touched)
    ids = token[alive]
    counts = np.bincount(word[alive], minlength=len(words))
    if alone:
        split = np.split(ids, np.cumsum(counts)[:-1])
        for w in alone:
            split[w] = np.array(_one_word(words[w], vocabulary), np.int64)
        ids, counts = np.concatenate(split), np.array([len(x) for x in split])
    return ids.astype(np.int32), np.concatenate(([0], np.cumsum(counts)))


class Encoder:
    """Encodes columns of texts; remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _codes(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of a slice and how many words each row has."""
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        size = np.ones(len(points), np.int64)
        for bound in (0x80, 0x800, 0x10000):
            size += points >= bound
        byte_at = np.concatenate(([0], np.cumsum(size)))
        rows = np.searchsorted(byte_at, offsets)
        starts = word_starts(points, np.unique(rows[:-1][rows[:-1] < len(points)]))
        cuts = byte_at[np.append(starts, len(points))].tolist()
        index = self.index
        codes = np.fromiter(
            (index.setdefault(raw[a:b], len(index)) for a, b in zip(cuts, cuts[1:])), np.int32, len(starts))
        return codes, np.diff(np.searchsorted(starts, rows))

    def encode(self, column: pa.Array):
        """Ranges of rows, and for each the ids one after the other and the offsets of the rows in them."""
        data, offsets = textops.text_buffers(column)
        for first, last in textops.row_slices(offsets, CORPUS_BYTES):
            if len(self.index) > REMEMBERED:
                self.forget()
            done = []
            for lo, hi in textops.row_slices(offsets[first:last + 1], SLICE_BYTES):
                lo, hi = lo + first, hi + first
                raw = data[offsets[lo]:offsets[hi]].tobytes()
                done.append((lo, hi, *self._codes(raw, offsets[lo:hi + 1] - offsets[lo])))
            known = len(self.ends) - 1
            if len(self.index) > known:
                ids, ends = replay([*self.index][known:], self.vocabulary)
                self.ids = np.concatenate((self.ids, ids))
                self.ends = np.concatenate((self.ends, self.ends[-1] + ends[1:]))
            for lo, hi, codes, per_row in done:
                starts = self.ends[codes]
                lengths = self.ends[codes + 1] - starts
                total = np.concatenate(([0], np.cumsum(lengths)))
                rows = total[np.concatenate(([0], np.cumsum(per_row)))]
                yield lo, hi, textops.gather(self.ids, starts, lengths), rows


def _valid(column: pa.Array) -> pa.Array:
    """Texts that are not UTF-8 get the replacement character for each wrong part."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in
                         column.cast(pa.binary()).to_pylist()], pa.string())


def _decoded(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """The bytes of each row of ids."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary.token_ends) - 1):
        raise ValueError("token id outside the vocabulary")
    starts = vocabulary.token_ends[ids]
    lengths = vocabulary.token_ends[ids + 1] - starts
    total = np.concatenate(([0], np.cumsum(lengths)))
    return textops.binary_column(textops.gather(vocabulary.token_bytes, starts, lengths), total[bounds])


def _fields(df: DataFrame, *without: str) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without]


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the token ids of each text instead of the text, and if asked for the bytes the ids decode to.

    Special tokens are ordinary text. The text is split by the usual byte-level BPE pattern and each match encoded
    by itself. A task gathers the distinct words of CORPUS_BYTES of texts that it has not met and replays the merges
    over all of them together (``replay``); nothing is shuffled. Null and empty texts have no ids. Other columns are
    left as they are, but for those named like a new one, which are replaced. Memory: an Arrow batch of texts, the
    words remembered, and some ten times the longest text.
    """
    others = [c for c in docs.columns if c not in (text_col, out_col, decoded_col)]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # some 3 MB for 50,000 tokens

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            column = _valid(batch.column(len(others)))
            rest = pa.Table.from_batches([batch]).select(range(len(others)))
            for lo, hi, ids, bounds in encoder.encode(column):
                part = rest.slice(lo, hi - lo) if others else pa.table({})
                part = part.append_column(out_col, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)))
                if decoded_col:
                    part = part.append_column(decoded_col, _decoded(ids, bounds, encoder.vocabulary))
                yield from part.combine_chunks().to_batches()

    narrow = docs.select(*others, F.col(text_col).cast("string").alias(text_col))
    new = [f"`{out_col}` array<int>", *([f"`{decoded_col}` binary"] if decoded_col else [])]
    return narrow.mapInArrow(run, ", ".join([*_fields(narrow, text_col), *new]))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that their ids stand for in a new column. Null ids, and nulls among them, give no
    bytes; ids outside the vocabulary are an error."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    base = rows.drop(out_col).withColumn(ids_col, F.filter(
        F.coalesce(ids_col, F.array().cast("array<int>")), lambda i: i.isNotNull()).cast("array<int>"))
    place = base.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            ids = batch.column(place)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))))
            for lo, hi in textops.row_slices(bounds, SLICE_BYTES // 4):
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                column = _decoded(flat[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], shared.value)
                yield from part.append_column(out_col, column).combine_chunks().to_batches()

    return base.mapInArrow(run, ", ".join([*_fields(base), f"`{out_col}` binary"]))

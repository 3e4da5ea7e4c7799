"""Tokens, scores, licences, mixing and embeddings against brute force, an exact round trip or held-out labels."""

import base64
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, components, embedding_dedup, licenses, lm_scoring, mixing, toxicity
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_odd_texts(vocabulary, tokenizer, monkeypatch):
    rng = random.Random(3)
    parts = ["a", "s", "t", "re", "ve", "m", "ll", "d", "'", " ", "  ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "1",
             "\xbd", "\xe9", "漢", "!", "==", "aaaa", "\U0001f642", "'s", "'re", "​", "́", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [None, "", "x's's't", " 's", "\n's", "a'", "'", "a" * 3000, "=" * 2001, " " * 700 + "x", "\n" * 50]
    texts += ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(30)) for _ in range(500)]
    monkeypatch.setattr(bpe, "CORPUS_BYTES", 5000)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 700)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    import pyarrow as pa
    encoder, got = bpe.Encoder(vocabulary), []
    for _, _, ids, bounds in encoder.encode(pa.array(texts, pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [tokenizer.encode_ordinary(t or "") for t in texts]


def test_bpe_order_of_merges():
    """Ranks under which a merge makes a pair of a lower rank: order within a word then matters."""
    tokens = {bytes([b]): b for b in range(256)} | {b"aaa": 256, b"aa": 257, b"ab": 258, b"aaab": 259, b"aab": 300}
    lines = b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in tokens.items())
    import tempfile
    with tempfile.NamedTemporaryFile() as f:
        f.write(lines)
        f.flush()
        v = bpe.load_vocabulary(f.name)
    ours = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=tokens, special_tokens={})
    words = [("a" * n + "b" * m + "a" * k).encode() for n in range(9) for m in range(3) for k in range(6) if n + m + k]
    ids, ends = bpe.replay(words, v)
    for i, w in enumerate(words):
        assert ids[ends[i]:ends[i + 1]].tolist() == ours.encode_ordinary(w.decode())


def test_bpe_spark(spark, docs, vocabulary, tokenizer):
    both = bpe.encode(docs, vocabulary, decoded_col="decoded")
    assert set(both.columns) == {*docs.columns, "ids", "decoded"} - {"text"}
    want = Counter((r.doc_id, tuple(tokenizer.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both.collect()) == want
    again = bpe.decode(both.select("doc_id", "ids"), vocabulary).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in again) == want
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 65])], "i long, ids array<int>")
    assert {r.i: len(r.decoded) for r in bpe.decode(odd, vocabulary).collect()}[1] == 0
    assert bpe.encode(cases.nothing(spark), vocabulary).collect() == []


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm(spark, docs, order):
    rows = [(r.doc_id, (r.text or "").split()) for r in docs.filter("text IS NULL OR NOT contains(text, '\x85')").collect()]
    counts = Counter(tuple(w[i:i + n]) for _, w in rows for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in rows)
    want = Counter()
    for i, w in rows:
        own = Counter(tuple(w[k:k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
        left, s = total - len(w), 0.0
        for k in range(len(w)):
            value = 0.5 * 0.4 ** order / max(left, 1)
            for n in range(min(order, k + 1), 0, -1):
                gram = tuple(w[k - n + 1:k + 1])
                c = counts[gram] - own[gram]
                if c > 0:
                    context = left if n == 1 else counts[gram[:-1]] - own[gram[:-1]]
                    value = 0.4 ** (order - n) * c / context
                    break
            s += math.log10(value)
        want[(i, len(w), round(s, 6))] += 1
    got = lm_scoring.score(docs.filter("text IS NULL OR NOT contains(text, '\x85')"), order=order).collect()
    assert Counter((r.doc_id, r.n_words, round(r.log10_sum, 6)) for r in got) == want
    assert all((r.log10_mean is None) == (r.n_words == 0) for r in got)
    assert lm_scoring.score(cases.nothing(spark), order=order).collect() == []


def test_licenses(spark, docs):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and "granted" in t)
    words = mit.split(" ")
    wrapped = "\n".join(" ".join(words[i:i + 9]) for i in range(0, len(words), 9))
    rows = [(1, "text before\n\n" + wrapped + "\n\nafter"), (2, "x\nLicensed under the Apache License, version 2.0\ny"),
            (3, mit.replace("charge", "money").replace("sell", "give")), (4, "nothing to see"), (5, None),
            (None, "Released under the MIT License."), (2, "released under the mit license")]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.license, r.n_matches > 0) for r in licenses.scan(small).collect())
    assert got == Counter([(1, "MIT", True), (2, "Apache-2.0", True), (3, "MIT", True), (4, None, False), (5, None, False),
                           (None, "MIT", True), (2, "MIT", True)])
    kinds = {(r.doc_id, r.kind) for r in licenses.matches(small).collect()}
    assert (1, "paragraph") in kinds and (2, "line") in kinds
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(cases.nothing(spark)).collect() == []


def test_mixing(spark, docs):
    rows = docs.collect()
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source or ""] += len((r.text or "")) - len((r.text or "").replace(" ", "").replace("\n", "")) + 1
    got = mixing.mix(docs, entropy_share=0.999, max_repeats=1.5)
    assert got.columns == [*docs.columns, "reading"]
    read = Counter((r.doc_id, r.text) for r in got.collect())
    assert all(read[(r.doc_id, r.text)] >= 1 for r in rows) and set(read) == {(r.doc_id, r.text) for r in rows}
    found = mixing.weights(docs.select(mixing._source("source").alias("source"), mixing._tokens("text").alias("tokens"))
                           .groupBy("source").agg(F.sum("tokens").alias("tokens")), 0.999, 1.5)
    table = {r.source: r for r in found.weights.collect()}
    assert abs(sum(r.weight for r in table.values()) - 1) < 1e-9
    assert max(r.budget / r.tokens for r in table.values()) <= 1.5 + 1e-3
    size = Counter()
    for r in got.collect():
        size[r.source or ""] += len((r.text or "")) - len((r.text or "").replace(" ", "").replace("\n", "")) + 1
    longest = max(len((r.text or "").split(" ")) for r in rows)
    for s, r in table.items():
        assert r.tokens == tokens[s] and r.budget - longest - 60 <= size[s] <= r.budget
    assert mixing.mix(cases.nothing(spark)).collect() == []


def test_mixing_entropy(spark):
    totals = spark.createDataFrame([(f"s{i}", 1000 if i else 30000) for i in range(20)], "source string, tokens long")
    found = mixing.weights(totals, 0.9, 1000.0)
    w = np.array([r.weight for r in found.weights.collect()])
    assert abs(-(w * np.log(w)).sum() / math.log(20) - 0.9) < 1e-4
    bound = mixing.weights(totals, 1.0, 2.0)
    assert abs(max(r.budget / r.tokens for r in bound.weights.collect()) - 2) < 1e-3


def _brute(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows
          if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up = list(range(len(ok)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    best = {}
    for a in range(len(ok)):
        best[root(a)] = min(best.get(root(a), ok[a][0]), ok[a][0])
    out = Counter((ok[a][0], links[a], best[root(a)]) for a in range(len(ok)))
    rest = len(rows) - len(ok)
    return out, rest


@pytest.mark.parametrize("dim", [2, 64, 20])
def test_embeddings(spark, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(12, dim))
    vectors = [c + s * rng.normal(size=dim) for c in centres for s in (0.05, 0.2, 0.4, 0.45, 0.5)] + [centres[0]] * 6
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, [None] * dim), (904, []), (905, [1.0]),
             (906, [2.0]), (907, [float("inf")] * dim), (None, rows[0][1]), (5, rows[5][1]), (8, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, rep string")
    want, rest = _brute(rows)
    got = embedding_dedup.mark(df.repartition(3)).collect()
    assert len(got) == len(rows)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) - want == Counter(
        {(i, 0, i): 1 for i in (900, 901, 902, 903, 904, 907, None)})
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embedding_dedup.mark(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if x not in lone}


def _toxic_corpus(spark):
    rng = random.Random(9)
    bad = ["idiot", "moron", "lowlife"]
    rows, labels = [], []
    for i in range(400):
        words = cases.sentence(rng, 40).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad[:2] + [bad[2] + rng.choice("xyz")]))
        rows.append((i, " ".join(words), "clash", 0.1))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "", 0.0), (1001, "", "", 0.0), (None, "you idiot moron idiot", "", 0.0), (1002, "z " * 30000, "", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, evidence string, score double")
    return docs.repartition(3), spark.createDataFrame([*labels, (1, None), (2, 7), (None, 1)], "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = _toxic_corpus(spark)
    train = labels.filter("doc_id IS NULL OR doc_id % 4 <> 1")
    model = toxicity.fit(docs, train)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(400) if i % 4 == 1]
    assert all((got[i].score >= 0.3) == (i % 5 == 0) for i in held)
    assert got[None].score >= 0.3 and got[1000].score == got[1001].score < 0.3
    assert got[5].evidence and all(e["label"] in (0, 1) for e in got[5].evidence)


def test_toxicity_neighbours_are_exact(spark):
    docs, labels = _toxic_corpus(spark)
    model = toxicity.fit(docs, labels)
    dense = np.zeros((len(model.ids), len(model.idf)))
    for b, (terms, rows) in enumerate(zip(model.block_terms, model.block_vectors)):
        for k, row in enumerate(rows):
            dense[b * toxicity.BLOCK + k, terms] = row
    rng = np.random.default_rng(1)
    queries = np.abs(rng.normal(size=(50, len(model.idf)))) * (rng.random((50, len(model.idf))) < 0.3)
    queries /= np.maximum(np.sqrt((queries ** 2).sum(1, keepdims=True)), 1e-12)
    cosines, _ = model.neighbours(queries)
    want = -np.sort(-np.maximum(queries @ dense.T, 0), axis=1)[:, :toxicity.NEIGHBOURS]
    assert np.allclose(cosines[:, :want.shape[1]], want, atol=1e-6)


def test_toxicity_counts_all_terms(spark):
    """Cosines over every word of the examples and its first bytes, also of texts without a mark of label 1."""
    docs, labels = _toxic_corpus(spark)
    model = toxicity.fit(docs, labels.filter("doc_id % 4 <> 1"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    terms = lambda t: Counter((k, w[:k] if k else w) for w in t.split() for k in (0, 3, 4, 5, 6) if len(w) >= k)
    bags = {i: terms(t) for i, t in texts.items()}
    label, examples = {r.doc_id: r.toxic for r in labels.filter("toxic < 2").collect()}, [int(i) for i in model.ids]
    n, pos = (Counter(t for i in examples for t in bags[i] if label[i] >= k) for k in (0, 1))
    assert len(model.terms) == len(n)
    frequency = Counter(t for b in bags.values() for t in b)
    rate = sum(label[i] for i in examples) / len(examples)

    def weight(t):
        x, all_ = pos[t] - n[t] * rate, len(examples) + 1
        x = toxicity.FLOOR + (x * x / (n[t] * rate * (1 - rate) * (1 - n[t] / all_)) if x > 0 else 0)
        return (math.log((1 + len(texts)) / (1 + frequency[t])) + 1) * x / (x + toxicity.CHI_SQUARE)

    def unit(bag):
        v = {t: (1 + math.log(c)) * weight(t) for t, c in bag.items() if t in n}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    units = {i: unit(bags[i]) for i in examples}
    got = {r.doc_id: r.evidence for r in toxicity.score(docs, model).collect()}
    for i in [1, 5, 9, 13, 17, 1002]:
        mine = unit(bags[i])
        cosines = sorted((sum(x * units[j].get(t, 0) for t, x in mine.items()) for j in examples), reverse=True)
        assert [e["cosine"] for e in got[i]] == pytest.approx([c for c in cosines[:3] if c > 0], abs=1e-6)
    assert got[9] and got[13]


def test_toxicity_without_examples(spark):
    docs, labels = _toxic_corpus(spark)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).collect() == []
    one = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {0.0}

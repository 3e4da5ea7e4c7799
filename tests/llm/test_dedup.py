"""Exact, substring, line and near-dedup of texts against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact(spark, docs, counters):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    want = Counter()
    for text, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        for i in ids:
            want[(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact_dedup.mark(docs, counters=counters).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    whole = exact_dedup.dedup(docs, counters=counters)
    assert whole.columns == docs.columns
    assert Counter(r.text or "" for r in whole.collect()) == Counter(groups.keys())


def test_exact_frequent_bound(spark):
    rows = spark.range(2000).select(F.unhex(F.sha2(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.col("id").cast("string")).cast("binary"), 256)).alias("digest"))
    found = dict(exact_dedup.frequent(rows, 4))
    assert len(found) <= 4
    assert 0 < found[hashlib.sha256(b"hot").digest()] <= 667


def _cut_words(rows, width=13):
    first, words = {}, []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        words.append(w)
        for k in range(len(w) - width + 1 if r.doc_id is not None else 0):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, r.doc_id), r.doc_id)
    out = Counter()
    for r, w in zip(rows, words):
        cut = [False] * len(w)
        for k in range(len(w) - width + 1 if r.doc_id is not None else 0):
            if first[tuple(w[k:k + width])] < r.doc_id:
                cut[k:k + width] = [True] * width
        out[(r.doc_id, len(w), sum(cut), " ".join(x for x, c in zip(w, cut) if not c))] += 1
    return out


def test_substring(spark, docs):
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == _cut_words(docs.collect())
    for r in got:
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:]))


def _within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[p + 1:] == b[p + 1:]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[p + 1:] == short[p:]


def test_line(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    line = " ".join(words)
    variants = [line, line.upper(), "  " + line, " ".join(words[:3] + ["x"] + words[4:]), " ".join(words[1:]),
                " ".join(words + ["iota"]), " ".join(words[:2] + words[3:] + ["x"]), "too short line", "too short line",
                " ".join(["x"] + words[1:]), " ".join(words[:-1] + ["y"]), "p q r s t", "p q r s u", "p q r s", ""]
    extra = [(1000 + i, v + "\nown line number %d of this text" % i) for i, v in enumerate(variants)]
    docs = cases.documents(spark, extra=extra)
    rows = docs.collect()
    lines = []
    for r in rows:
        key = spark.range(1).select(F.xxhash64(F.lit(r.text or ""))).first()[0] if r.doc_id in (3, 7, None) else 0
        place = (r.doc_id if r.doc_id is not None else 1 << 63, key)
        for i, raw in enumerate((r.text or "").split("\n")):
            lines.append((place, i, raw.strip(" ").lower()))
    uniq = {}
    for place, i, norm in lines:
        if norm.count(" ") >= 4:
            uniq[norm] = min(uniq.get(norm, (place, i)), (place, i))
    split = {n: n.split(" ") for n in uniq}
    near = {n for n in uniq for m in uniq if uniq[m] < uniq[n] and _within_one(split[n], split[m])}
    want = Counter()
    for r in rows:
        key = spark.range(1).select(F.xxhash64(F.lit(r.text or ""))).first()[0] if r.doc_id in (3, 7, None) else 0
        place = (r.doc_id if r.doc_id is not None else 1 << 63, key)
        kept, n = [], 0
        for i, raw in enumerate((r.text or "").split("\n")):
            norm = raw.strip(" ").lower()
            n += 1
            if norm not in uniq or (norm not in near and uniq[norm] == (place, i)):
                kept.append(raw)
        want[(r.doc_id, "\n".join(kept), n, n - len(kept))] += 1
    got = line_dedup.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()) == want


def test_line_short(spark):
    """Exact repeats of every line that is not blank go in the pipeline, edit variants only from five words on."""
    import corpus_pipeline

    url = "https://example.org/" + "x" * 200
    texts = ["All rights reserved.\n\nown\na\tb\tc\td\te\tf", "all rights reserved. \n\nmine\nA\tb\tc\td\te\tf\n" + url,
             url + "\nall rights kept.\n\t\n漢字漢字", "漢字漢字\n \n\t\n\r\n\r\none two three four five\none two three four six",
             "", None]
    want = [texts[0], "\nmine\n" + url, "all rights kept.\n\t\n漢字漢字", " \n\t\n\r\n\r\none two three four five", "", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert dict(corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()) == dict(enumerate(want))
    cased = cases.documents(spark, extra=[(1000 + i, t) for i, t in enumerate(texts)])
    seen, n = set(), 0
    for r in sorted(cased.dropDuplicates(["doc_id", "text"]).collect(), key=lambda r: r.doc_id if r.doc_id is not None else 1 << 63):
        for line in (r.text or "").split("\n"):
            norm = line.strip(" ").lower()
            if norm.count(" ") < 4 and norm.strip():
                n += norm in seen
                seen.add(norm)
    with_short = line_dedup.remove_repeats(cased.dropDuplicates(["doc_id", "text"]), short_lines=True).agg(F.sum("n_removed")).first()[0]
    without = line_dedup.remove_repeats(cased.dropDuplicates(["doc_id", "text"])).agg(F.sum("n_removed")).first()[0]
    assert with_short == without + n and n > 0


def _classes(rows):
    texts = {}
    for r in rows:
        if r.doc_id is not None:
            texts.setdefault(r.doc_id, []).append(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    bags = [(i, Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)]))
            for i, ws in texts.items() for w in ws]
    df = Counter(s for _, b in bags for s in b)
    n = len(rows)
    import math
    weight = {s: 1 + near_dedup.RARITY * math.log(n / c) / math.log(n) for s, c in df.items()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(bags):
        for j, y in bags[:a]:
            common = sum(weight[s] * min(c, y[s]) for s, c in x.items() if s in y)
            both = sum(weight[s] * c for s, c in x.items()) + sum(weight[s] * c for s, c in y.items()) - common
            if common >= 0.8 * both:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in texts}


@pytest.mark.parametrize("group", [3000, 4])
def test_near(spark, docs, group, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP_DOCS", group)
    want = _classes(docs.collect())
    got = near_dedup.mark(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.class_id is None and r.kept
        else:
            assert r.class_id == want[r.doc_id] and r.kept == (r.doc_id == r.class_id)
    assert len(set(want.values())) < len(want) - 6
    kept = near_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(want.values())


@pytest.mark.parametrize("run", [
    lambda d: exact_dedup.mark(d), lambda d: exact_dedup.dedup(d), lambda d: substring_dedup.remove_repeats(d),
    lambda d: line_dedup.remove_repeats(d), lambda d: near_dedup.mark(d), lambda d: near_dedup.dedup(d)])
def test_empty_table(spark, run):
    assert run(cases.nothing(spark)).collect() == []

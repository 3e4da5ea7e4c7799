"""Periodic runs, the trie of conversations and page extraction against brute force and planted cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extraction, periodic_runs, prefix_trie
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _runs(w, min_words=24, min_repeats=3):
    """All runs of a list of words, (start, period, end), from every period."""
    n, out = len(w), {}
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(min_words, min_repeats * q):
                out.setdefault((s, i + q), q)
    return sorted((s, q, e) for (s, e), q in out.items())


def _odd_words(rng, kind, n):
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:  # a tail with a long period
        d, a = [rng.randrange(50) for _ in range(n)], rng.randrange(max(n, 1))
        p = 1 + (n - a) // (3 + rng.randrange(8))
        return [d[i if i < a else a + (i - a) % p] for i in range(n)]
    if kind == 3:  # two runs of one period that do not join
        b = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
        return b * rng.randrange(1, 12) + [9] + b * rng.randrange(1, 12)
    x, y = [0], [0, 1]
    if kind == 4:  # Fibonacci word
        while len(y) < n:
            x, y = y, y + x
        return y
    while len(x) < n:  # Thue-Morse word: no cubes
        x = x + [1 - v for v in x]
    return x if kind == 5 else (x[:20] * 4 + [7]) * 4 + [rng.randrange(3)] * 30


@pytest.mark.parametrize("min_words,min_repeats", [(24, 3), (6, 3), (10, 4), (20, 10)])
def test_runs_of_word_numbers(min_words, min_repeats):
    rng = random.Random(min_words)
    found = 0
    for _ in range(150):
        docs = [_odd_words(rng, rng.randrange(7), rng.randrange(160)) for _ in range(rng.randrange(1, 5))]
        bounds = np.cumsum([0, *map(len, docs)])
        start, end, period = periodic_runs.runs_of(np.array(sum(docs, []), np.int64), bounds, min_words, min_repeats)
        want = [(s + b, q, e + b) for d, b in zip(docs, bounds) for s, q, e in _runs(d, min_words, min_repeats)]
        assert list(zip(start.tolist(), period.tolist(), end.tolist())) == want
        found += len(want)
    assert found > 50


def test_grammar_derives_its_places():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile(rng.integers(0, 9, 40), 5), rng.integers(0, 4, 300)])
    bounds = np.array([0, 0, 170, 500, 500])
    g = periodic_runs.re_pair(ids, bounds, 4)
    for s, p in zip(g.symbol, g.place):
        n = g.end[s] - g.start[s]
        assert (ids[p:p + n] == ids[g.start[s]:g.end[s]]).all()
        assert np.searchsorted(bounds, p, "right") == np.searchsorted(bounds, p + n - 1, "right")
    assert ((g.start < g.middle) & (g.middle < g.end)).all()


def test_equal_words_are_few_symbols():
    g = periodic_runs.re_pair(np.zeros(1 << 14, np.int64), np.array([0, 1 << 14]))
    assert len(g.start) < 40


def test_periodic_runs(spark):
    rng = random.Random(2)
    extra = [(100 + k, "\t".join(f"w{v}" for v in _odd_words(rng, k % 7, 150))) for k in range(14)]
    docs = cases.documents(spark, extra=extra).withColumns({"runs": F.lit(1), "best": F.lit("x"), "n_words": F.lit("y")})
    want = Counter()
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        runs = _runs(w)
        gone = {i for s, q, e in runs for i in range(s + q, e)}
        best = min(runs, key=lambda x: (-(x[2] - x[0]) / x[1], x[0], x[1]), default=None)
        want[(r.doc_id, len(w), tuple((s, e - s, q) for s, q, e in runs), best and (best[0], best[2] - best[0], best[1]),
              " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.best and tuple(r.best), r.collapsed_text)
                  for r in periodic_runs.find(docs).collect())
    assert got == want
    assert periodic_runs.find(cases.nothing(spark)).collect() == []


TURNS = "conv_id long, turn long, role string, text string, depth string, a long, _part int"


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "d", 7, 3) for r in rows], TURNS).repartition(3)


def _brute_trie(rows, conversations=None):
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by_conv[c].append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    convs = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in by_conv.items()}
    for c in conversations or ():
        convs.setdefault(c, [])
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    out = set()
    for p, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(ends), children[p], leaves[p], saved[p],
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def _rows(nodes):
    got = nodes.collect()
    rows = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_ends, r.n_children, r.n_leaves, r.saved_tokens,
             bytes(r.ends).hex()) for r in got}
    assert len(rows) == len(got)
    return rows


def _conversations():
    rng = random.Random(4)
    texts = ["a", "b c", "", None, "d e  f"]
    rows = []
    for c in range(-3, 60):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", None, "system"]), rng.choice(texts)))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(5)]  # one common conversation
    rows += [rows[0], rows[5], (None, 1, "user", "no conversation"), (None, None, None, None)]
    rows += [(200, t, "user", f"long {t % 3}") for t in range(90)] + [(201, t, "user", f"long {t % 3}") for t in range(50)]
    return rows


@pytest.mark.parametrize("shard_rows,block", [(1 << 14, 1 << 12), (40, 8), (7, 1)])
def test_trie(spark, shard_rows, block):
    rows = _conversations()
    numbered = prefix_trie.number(_turns(spark, rows))
    got = _rows(prefix_trie.build(numbered, shard_rows=shard_rows, block=block))
    assert got == _brute_trie(rows)


def test_trie_of_conversations_without_turns(spark):
    rows = _conversations()[:40]
    everyone = spark.createDataFrame([(c,) for c in (-9, 3, 500, 501, 500, None)], "conv_id long")
    want = _brute_trie(rows, [-9, 3, 500, 501])
    numbered = prefix_trie.number(_turns(spark, rows))
    got = _rows(prefix_trie.build(numbered, everyone.union(numbered.select("conv_id"))))
    assert got == want
    nobody = prefix_trie.number(_turns(spark, rows).limit(0))
    assert _rows(prefix_trie.build(nobody, everyone)) == _brute_trie([], [-9, 3, 500, 501])
    assert prefix_trie.build(nobody).collect() == [] and prefix_trie.trie(_turns(spark, rows).limit(0)).collect() == []


def test_one_conversation_over_many_ranges(spark):
    rows = [(1, t, "user", f"{t}") for t in range(4000)] + [(0, 0, "user", "0"), (2, 0, "user", "0")]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = prefix_trie.number(_turns(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    text = {hashlib.sha256(f"{t}".encode()).digest(): t for t in range(4000)}
    assert len(numbered) == 4002 and all(text[bytes(r.text_sha256)] + 1 == r.depth for r in numbered)


def test_node_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 50, (3000, 3)), axis=0)
    table = prefix_trie.NodeTable(*keys.T)
    slots = table.find(*keys.T)
    assert sorted(slots) == list(range(len(keys)))
    assert (table.find(keys[:, 0], keys[:, 1], keys[:, 2] + 50) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.NodeTable(np.array([1, 1]), np.array([2, 2]), np.array([3, 3]))


ARTICLE = "<article><h1>Title &amp; {n}</h1><p><b>First {n}<br>line<p>Second&nbsp;<i>part</i> {n}</p></article>"
WANT = "Title & {n}\nFirst {n} line\nSecond part {n}"


def _page(n, body):
    return (f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x="</p><article>no";</script></head>'
            f'<body><nav><ul><li><a href="/{n}">menu {n}</a></ul></nav>{body}<footer>foot {n}</footer></body></html>')


ASIDES = {
    "advert": '<div class="ad">buy {n}</div>', "cookie notice": '<div id="cookie-consent"><p>we use {n}</p></div>',
    "header": "<header><p>site {n}</p></header>", "sidebar": '<aside><p>aside {n}</p></aside>',
    "named sidebar": '<div class="left-sidebar"><p>more {n}</p></div>', "form": "<form><p>mail {n}</p><input></form>",
    "comments": '<section id="comments"><article class="comment"><p>reader {n}</p></article></section>',
    "raw": "<script>if (a<b) {{}}</script><noscript>no {n}</noscript><!-- <p>c {n}</p> -->",
    "role": '<div role="navigation"><p>go {n}</p></div>',
}


@pytest.mark.parametrize("kind", list(ASIDES))
@pytest.mark.parametrize("inside", [False, True])
def test_what_is_no_article(kind, inside):
    aside = ASIDES[kind].format(n=3)
    article = ARTICLE.format(n=3)
    if inside and kind not in ("header", "comments"):
        page = _page(3, article.replace("</h1>", "</h1>" + aside))
    else:
        page = _page(3, aside + article + aside)
    assert html_extraction.extract(page) == WANT.format(n=3)


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain < text &lt;b&gt; &#x41;", "plain < text <b> A"), ("<p>a<p>b<div>c", "a\nb\nc"),
    ("<article><ul><li>one<li>two<ul><li>in</ul>three</ul><table><tr><td>x<td>y<tr><td>z</table>", "one\ntwo\nin\nthree\nx y\nz"),
    ("<main><h1>T</h1><p>x</p></main><div>out</div>", "T\nx"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "end", "deep\nend"),
    ("<article><p title=\"a>b\" data-x='<p>'>q</p></article>", "q"), ("<article><p>open <a href=\"x", 'open <a href="x'),
    ("<head><title>t</title><p>body text", "body text"), ("<article><p>a</p></article><article><p>b</p></article>", "a\nb"),
    ("<body class=\"has-sidebar\"><div class=\"with-sidebar\"><article><p>a</p></article></div>", "a"),
])
def test_odd_pages(page, want):
    assert html_extraction.extract(page) == want


def test_wrapper_of_a_host(spark):
    """Unnamed elements: what all pages share goes, the slot that varies stays."""
    def page(n):
        return (f'<body><div class="q"><p>Our site</p><a href="/">start</a></div><div class="x{n}"><h2>Head {n}</h2><p>Subscribe to us.</p>'
                f"{''.join(f'<p>Par {n} {k} of many words here</p>' for k in range(1 + n % 3))}</div><div><p>All rights reserved</p></div>")
    def want(n):
        return "\n".join([f"Head {n}", *(f"Par {n} {k} of many words here" for k in range(1 + n % 3))])

    rows = [(n, f"http://u@Host.example:80/{n}", page(n)) for n in range(40)]
    rows += [(100 + n, "http://copies.example/x", _page(1, ARTICLE.format(n=1))) for n in range(30)]  # copies of one page
    rows += [(200, "http://few.example/", _page(2, ARTICLE.format(n=2))), (201, None, _page(5, ARTICLE.format(n=5))),
             (202, "no url", _page(6, ARTICLE.format(n=6))), (203, "http://host.example/", None), (None, "http://host.example/", ""),
             (3, "http://u@Host.example:80/3", page(3)),
             (204, "http://long.example/", _page(7, "<article>" + "<h3>a</h3><p>b</p>" * 20000 + "</article>"))]
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, host string, decision string, text int")
    got = defaultdict(list)
    out = html_extraction.main_text(pages.repartition(5)).collect()
    for r in out:
        got[r.page_id].append(r.text)
    assert len(out) == len(rows)
    assert all(got[n] == [want(n)] * (2 if n == 3 else 1) for n in range(40))
    assert all(got[100 + n] == [WANT.format(n=1)] for n in range(30))
    assert [got[i] for i in (200, 201, 202, 203, None)] == [[WANT.format(n=2)], [WANT.format(n=5)], [WANT.format(n=6)], [""], [""]]
    assert got[204] == ["\n".join(["a", "b"] * 20000)]
    assert html_extraction.main_text(pages.limit(0)).collect() == []


def test_no_template_text_is_lost_to_bounds(spark):
    """More texts a node than a template remembers, and more nodes than it keeps: template texts go all the same."""
    word = lambda n: "".join(chr(97 + int(d)) for d in f"{n:03d}")

    def many_texts(n):
        return f"<body><div>{''.join(f'<p>Par {n} {k} of many words</p>' for k in range(40))}<p>Subscribe to us.</p></div><div>Foot</div>"

    def many_nodes(n):  # ten pages of each kind, with 12 nodes of their own
        inner = "".join(f'<div class="{word(n // 10)}{word(k)}"><p>Of kind {n // 10} {k}</p><p>Text {n} {k} of some more words</p></div>' for k in range(12))
        return f"<body><div><p>Our site</p></div><section><div>{inner}</div></section>"

    rows = [(n, "http://texts.example/", many_texts(n)) for n in range(40)]
    rows += [(1000 + n, "http://nodes.example/", many_nodes(n)) for n in range(600)] + [(1000, "http://nodes.example/", many_nodes(0))]
    rows += [(n, "http://h.example/", _page(n, ARTICLE.format(n=n))) for n in range(2000, 2012)] + [(3000, None, ""), (3001, "http://nodes.example/", None)]
    want = {n: "\n".join(f"Par {n} {k} of many words" for k in range(40)) for n in range(40)}
    want |= {1000 + n: "\n".join(f"Text {n} {k} of some more words" for k in range(12)) for n in range(600)}
    want |= {n: WANT.format(n=n) for n in range(2000, 2012)} | {3000: "", 3001: ""}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        out = html_extraction.main_text(pages.repartition(parts)).collect()
        assert len(out) == len(rows) and {r.page_id: r.text for r in out} == want


def test_templates_merge_in_any_order():
    pages = [_page(n, ARTICLE.format(n=n) + f"<p>same</p>{'<hr><ul><li>x</ul>' * (n % 2)}") for n in range(24)]
    def decided(order):
        out = None
        for n in order:
            made = html_extraction.page_template(pages[n])
            out = made if out is None else html_extraction.merge(out, made)
        return html_extraction.decide(html_extraction.Slot.unpacked(out.packed()))
    assert decided(range(24)) == decided(range(23, -1, -1)) != html_extraction.decide(html_extraction.page_template(pages[0]))


def test_tree_matching_pairs_most_nodes():
    tree = lambda page: html_extraction._slot(html_extraction.parse(page), 1)
    a = tree("<div><p>1</p></div><ul><li>x</ul><div><h2>t</h2><p>2</p></div>")
    b = tree("<div><h2>t</h2><p>2</p></div>")
    assert html_extraction._pairs(a.kids, b.kids, {}) == [(2, 0)]
    assert html_extraction._match(a, b, {}) == 4

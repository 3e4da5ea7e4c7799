"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. Each task reads its pages as trees of block elements and merges those of a host by simple
tree matching: the order-keeping matching of children that pairs the most nodes. What the tasks found is merged the same way.
A text that stands at the same node of nearly all pages is template; slots whose texts vary hold content. The second pass
reads each page again, takes the part that holds the article and leaves out template texts and what tags and names mark.

A template in memory is bounded and knows what it had to leave out. Where that could change a decision, the paths and texts
of all pages of the host are counted as rows, without a bound, and decided by the same shares.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written

TEXTS = 16  # texts that a node of a template remembers; it knows how many pages a forgotten one may have had
WITNESSES = 8  # different pages that must show a text before it is template
SHARE = 0.8  # of the pages that have the node
NODES = 512  # of a template; beyond, the rarest go, and its host is counted in rows
COUNTS = 20_000  # paths and texts that a task counts before it hands them on as rows
HOSTS = 512  # templates that a task holds at once; beyond, it hands them on and starts anew
DEPTH = 200  # deeper elements are read as children of the element at this depth
CELLS = 250_000  # of the matching of two lists of children; longer lists are matched by the order of their labels

_SPACE_TAGS = frozenset("br wbr td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
_BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody tfoot thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("html body li dd dt option optgroup caption tbody thead tfoot tr legend summary".split())
_DROPPED = frozenset("head nav aside footer form button select datalist dialog menu search".split())
_DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Parts of class names and ids.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos "
    "promotion banner cookie cookies consent gdpr notice notices alert alerts nav navbar navigation menu menus breadcrumb "
    "breadcrumbs footer sidebar aside widget widgets comment comments respond disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager masthead "
    "topbar copyright".split())
_OUTER_NAMES = frozenset("header search".split())  # only outside an article
_CONTAINERS = frozenset("html body article center div main section table tbody tr".split())
_CONTENT_NAMES = frozenset("articlebody article post entry content story body text main".split())
#: An open element of the first kind ends at a start tag of the second.
_SELF_ENDING = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"},
                "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
_SCOPE = frozenset("ul ol dl table select menu".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Node:
    """A block element, or an inline one that its name marks: kids are nodes and pieces of text. ``linked`` counts
    characters inside links."""

    __slots__ = ("tag", "label", "parts", "role", "kids", "parent", "block", "linked", "depth")

    def __init__(self, tag: str, parent: Node | None, parts: frozenset = frozenset(), role: str = ""):
        self.tag, self.parent, self.parts, self.role = tag, parent, parts, role
        self.label = ".".join((tag, *sorted(parts)[:4])) if parts else tag
        self.kids: list = []
        self.block, self.linked, self.depth = tag in _BLOCK, 0, parent.depth + 1 if parent else 0


def parse(page: str) -> Node:
    """The tree of block elements of a page. Missing end tags are implied as browsers do; comments, scripts, styles and
    other raw elements are left out."""
    root = Node("#page", None)
    node, open_, links, pos, end = root, [], 0, 0, len(page)  # open_: (tag, node or None for plain inline elements)

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            node.kids.append(piece)
            if links:
                node.linked += len(piece)

    def close(at: int) -> None:
        nonlocal node, links
        for tag, made in reversed(open_[at:]):
            if made is not None:
                node = made.parent
            elif tag in _BLOCK:
                node.kids.append(Node("hr", node))
            elif tag == "a":
                links -= 1
        del open_[at:]

    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos:m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    close(i)
                    break
                if open_[i][0] in ("td", "th", "table") and tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in _SPACE_TAGS and tag in _VOID:
            node.kids.append(" ")
            continue
        if tag in _RAW:
            m = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = m.end() if m else end
            continue
        if tag in _ENDS_P:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == "p":
                    close(i)
                    break
                if open_[i][1] is not None and open_[i][0] in _BLOCK:
                    break
        if tag not in ("meta", "link", "base"):  # what cannot stand in the head ends it
            close(next((i for i, x in enumerate(open_) if x[0] == "head"), len(open_)))
        for i in range(len(open_) - 1, -1, -1):
            if tag in _SELF_ENDING.get(open_[i][0], ()):
                close(i)
                break
            if open_[i][0] in _SCOPE:
                break
        parts, role = frozenset(), ""
        if "=" in attributes:
            for name, *values in _NAMED.findall(attributes):
                value = "".join(values).lower()
                if name.lower() == "role":
                    role = value.strip()
                else:
                    parts |= frozenset(_PART.findall(value))
        if tag in ("td", "th"):
            node.kids.append(" ")
        tracked = tag in _BLOCK or tag in _DROPPED or role in _DROPPED_ROLES or not parts.isdisjoint(_NAMES)
        if tag in _VOID:
            if tag == "hr":
                node.kids.append(Node("hr", node))
            continue
        if tracked and node.depth < DEPTH:
            made = Node(tag, node, parts, role)
            node.kids.append(made)
            node = made
            open_.append((tag, made))
        else:
            open_.append((tag, None))
            links += tag == "a"
            if tag in _BLOCK:
                node.kids.append(Node("hr", node))
    return root


def _marked(node: Node, inside: bool) -> bool:
    """Whether tag, role or names say that a node is not part of an article; ``inside``: it stands in one."""
    if node.tag in _DROPPED or node.role in _DROPPED_ROLES or not node.parts.isdisjoint(_NAMES):
        return True
    return not inside and (node.tag == "header" or not node.parts.isdisjoint(_OUTER_NAMES))


def blocks(nodes: list[Node], inside: bool, keep: set[int] = frozenset()):
    """(labels from the page down, text, linked share) of each block under ``nodes`` in page order, marked nodes left out
    but for those in ``keep`` (by id)."""
    out, buffer, path = [], [], []

    def flush() -> None:
        words = " ".join("".join(buffer).split())
        if words:
            out.append((tuple(path), words))
        buffer.clear()

    def walk(node: Node) -> None:
        if node.block:
            flush()
            path.append(node.label)
        for kid in node.kids:
            if isinstance(kid, str):
                buffer.append(kid)
            elif id(kid) in keep or not _marked(kid, inside):
                walk(kid)
            elif kid.block:
                flush()
        if node.block:
            flush()
            path.pop()

    for node in nodes:
        up, at = [], node.parent
        while at is not None:
            if at.block:
                up.append(at.label)
            at = at.parent
        path[:] = up[::-1]
        walk(node)
        flush()
    return out


class Slot:
    """A node of a template: pages that have it, their characters and those in links, frequent texts, and children.
    ``texts``: hash -> [pages, characters, up to WITNESSES digests of pages]. ``missed``: pages that a text may have beyond
    its count, or a forgotten one at all. ``cut``: children were left out."""

    __slots__ = ("label", "pages", "chars", "linked", "texts", "kids", "marked", "missed", "cut")

    def __init__(self, label: str, pages: int = 1, chars: int = 0, linked: int = 0, texts: dict | None = None,
                 kids: list | None = None, marked: bool = False, missed: int = 0, cut: bool = False):
        self.label, self.pages, self.chars, self.linked = label, pages, chars, linked
        self.texts, self.kids, self.marked, self.missed, self.cut = texts or {}, kids or [], marked, missed, cut

    def packed(self) -> list:
        return [self.label, self.pages, self.chars, self.linked, [[k, *v] for k, v in self.texts.items()],
                [k.packed() for k in self.kids], int(self.marked), self.missed, int(self.cut)]

    @staticmethod
    def unpacked(x: list) -> Slot:
        return Slot(x[0], x[1], x[2], x[3], {k: v for k, *v in x[4]}, [Slot.unpacked(k) for k in x[5]], bool(x[6]), x[7], bool(x[8]))


def _pairs(a: list[Slot], b: list[Slot], memo: dict) -> list[tuple[int, int]]:
    """The matching of two lists of children that keeps their order and pairs most nodes, those below included."""
    if [x.label for x in a] == [x.label for x in b]:
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) > CELLS:
        out, j = [], 0
        places: dict[str, list[int]] = {}
        for k, x in enumerate(b):
            places.setdefault(x.label, []).append(k)
        for i, x in enumerate(a):
            k = next((k for k in places.get(x.label, ()) if k >= j), None)
            if k is not None:
                out.append((i, k))
                j = k + 1
        return out
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            most = below[j] if below[j] >= row[j + 1] else row[j + 1]
            if a[i].label == b[j].label:
                most = max(most, below[j + 1] + _match(a[i], b[j], memo))
            row[j] = most
    out, i, j = [], 0, 0
    while i < n and j < m:
        if best[i][j] == best[i + 1][j]:
            i += 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out


def _match(a: Slot, b: Slot, memo: dict) -> int:
    """Pairs of nodes in the simple tree matching of two nodes of one label."""
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + sum(_match(a.kids[i], b.kids[j], memo) for i, j in _pairs(a.kids, b.kids, memo))
    return memo[key]


def merge(a: Slot, b: Slot, same_page: bool = False, memo: dict | None = None) -> Slot:
    """``a`` with what ``b`` has: of other pages, or of the same page where equal neighbours are read as one node."""
    memo = {} if memo is None else memo
    if not same_page:
        a.pages += b.pages
    a.chars += b.chars
    a.linked += b.linked
    a.missed += b.missed
    a.cut |= b.cut
    for text, (pages, chars, witnesses) in b.texts.items():
        mine = a.texts.get(text)
        if mine is None:
            a.texts[text] = [pages, chars, witnesses]
        else:
            mine[0] += 0 if same_page else pages
            mine[2] = sorted({*mine[2], *witnesses})[:WITNESSES]
    if len(a.texts) > TEXTS and not same_page:
        least = sorted((v[0] for v in a.texts.values()), reverse=True)[TEXTS]
        a.texts = {k: [v[0] - least, *v[1:]] for k, v in a.texts.items() if v[0] > least}
        a.missed += least
    if b.kids:
        # Long lists are matched roughly, which may split the counts of a node.
        a.cut |= len(a.kids) * len(b.kids) > CELLS and [x.label for x in a.kids] != [x.label for x in b.kids]
        kids, i, j = [], 0, 0
        for x, y in [*_pairs(a.kids, b.kids, memo), (len(a.kids), len(b.kids))]:
            kids += a.kids[i:x] + b.kids[j:y]
            if x < len(a.kids):
                kids.append(merge(a.kids[x], b.kids[y], same_page, memo))
            i, j = x + 1, y + 1
        a.kids = kids
    return a


def _slot(node: Node, witness: int, marked: bool = False) -> Slot:
    """A page's node as a template; neighbours of one label are one slot."""
    slot = Slot(node.label, linked=node.linked, marked=marked)
    pieces, plain = [], []
    for kid in node.kids:
        if isinstance(kid, str):
            pieces.append(kid)
        elif not kid.block:
            pieces.append(" ")
        else:
            plain.append("".join(pieces))
            pieces = []
            made = _slot(kid, witness, marked or _marked(kid, False))
            if slot.kids and slot.kids[-1].label == made.label:
                merge(slot.kids[-1], made, True)
            else:
                slot.kids.append(made)
    plain.append("".join(pieces))
    for piece in plain:
        words = " ".join(piece.split())
        if words:
            slot.chars += len(words)
            slot.texts[_hash(words)] = [1, len(words), [witness]]
    return slot


def page_template(page: str) -> Slot:
    tree = parse(page)
    return _slot(tree, _hash(*(t for _, t in blocks([tree], False))))


def _size(slot: Slot) -> int:
    return 1 + sum(_size(k) for k in slot.kids)


def _prune(slot: Slot) -> Slot:
    """Without the rarest nodes, if there are too many; their parents are marked as cut."""
    if _size(slot) > NODES:
        counts = []

        def gather(x: Slot) -> None:
            counts.append(x.pages)
            for k in x.kids:
                gather(k)

        gather(slot)
        least = sorted(counts, reverse=True)[NODES // 2]

        def cut(x: Slot) -> None:
            kids = [k for k in x.kids if k.pages > least]
            x.cut |= len(kids) < len(x.kids)
            x.kids = kids
            for k in x.kids:
                cut(k)

        cut(slot)
    return slot


def decide(template: Slot) -> str:
    """What the second pass needs of a template, as JSON: ``fixed``, hashes of (labels, text) of template texts,
    ``region``, labels down to the slot that holds most of the varying text, and ``open``: what the template left out could
    change either, so that ``counted`` has to decide."""
    fixed, open_ = [], []

    def template_text(slot: Slot, path: tuple[str, ...]) -> int:
        path = path if slot.label.startswith("#") else (*path, slot.label)
        chars = 0
        least = SHARE * slot.pages
        if slot.cut or slot.missed and slot.pages >= WITNESSES and max([0, *(
                v[0] for v in slot.texts.values() if v[0] < least or len(v[2]) < WITNESSES)]) + slot.missed >= least:
            open_.append(slot.label)
        for text, (pages, length, witnesses) in slot.texts.items():
            if len(witnesses) >= WITNESSES and pages >= least:
                fixed.append(_hash(*path, str(text)))
                chars += pages * length
        slot.texts = {}
        slot.chars = 0 if slot.marked else max(0, slot.chars - chars - slot.linked)
        slot.chars += sum(template_text(k, path) for k in slot.kids)
        return slot.chars

    template_text(template, ())
    region, at = [], template
    while at.kids:
        most = max(at.kids, key=lambda k: k.chars)
        if most.chars < 0.7 * at.chars or most.chars == 0 or most.label.split(".")[0] not in _CONTAINERS:
            break
        region.append(most.label)
        at = most
    # Counts of a template that was cut start late for nodes that came back, so nothing is taken from it.
    return json.dumps({"fixed": [], "region": [], "open": True} if open_ else {"fixed": sorted(set(fixed)), "region": region, "open": False})


def places(page: str) -> tuple[int, dict]:
    """The digest of a page's texts and, by labels from the page down, [characters, those in links, hash of text -> length].
    What is marked counts no characters."""
    tree = parse(page)
    witness = _hash(*(t for _, t in blocks([tree], False)))
    found: dict[tuple[str, ...], list] = {}

    def walk(slot: Slot, path: tuple[str, ...]) -> None:
        path = path if slot.label.startswith("#") else (*path, slot.label)
        at = found.setdefault(path, [0, 0, {}])
        if not slot.marked:
            at[0] += slot.chars
            at[1] += slot.linked
        at[2] |= {text: 0 if slot.marked else v[1] for text, v in slot.texts.items()}
        for kid in slot.kids:
            walk(kid, path)

    walk(_slot(tree, witness), ())
    return witness, found


def counted(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template texts, regions) of hosts whose templates left something out, counted over all of their pages.

    ``pages``: host, html. A text is template where it stands on SHARE of the pages that have its path, and on WITNESSES
    different ones: ``host, path, text, key``, the last as in ``fixed``. Regions: ``host, region``, labels joined by "/",
    down to the path that holds most of the varying text. Every path and text is a row, added up in tasks first; nothing of a
    host is held together."""

    def count(batches):
        found: dict = {}

        def rows() -> pa.RecordBatch:
            keys = [*found]
            of = lambda i, kind: pa.array([k[i] for k in keys], kind)
            value = lambda i, kind: pa.array([v[i] for v in found.values()], kind)
            return pa.RecordBatch.from_arrays(
                [of(0, pa.string()), of(1, pa.string()), of(2, pa.int64()), value(0, pa.int64()), value(1, pa.int64()),
                 value(2, pa.int64()), value(3, pa.list_(pa.int64()))],
                names=["host", "path", "text", "n", "chars", "linked", "witnesses"])

        def add(key: tuple, chars: int, linked: int, witness: int) -> None:
            at = found.setdefault(key, [0, 0, 0, []])
            at[0] += 1
            at[1] += chars
            at[2] += linked
            if len(at[3]) < WITNESSES and witness not in at[3]:
                at[3].append(witness)

        for batch in batches:
            for host, page in zip(*(batch.column(i).to_pylist() for i in range(2))):
                witness, made = places(page)
                for path, (chars, linked, texts) in made.items():
                    add((host, "/".join(path), None), chars, linked, witness)
                    for text, length in texts.items():
                        add((host, "/".join(path), text), length, 0, witness)
                if len(found) > COUNTS:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    parts = pages.select("host", "html").mapInArrow(
        count, "host string, path string, text long, n long, chars long, linked long, witnesses array<long>")
    sums = written(parts.groupBy("host", "path", "text").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.size(F.array_distinct(F.flatten(F.collect_list("witnesses")))).alias("witnesses")))
    paths = sums.filter("text IS NULL").select("host", "path", F.col("n").alias("pages"), F.col("chars").alias("all"), "linked")
    texts = sums.filter((F.col("text").isNotNull()) & (F.col("witnesses") >= WITNESSES)).select("host", "path", "text", "n", "chars")
    fixed = written(texts.join(paths, ["host", "path"]).filter(F.col("n") >= SHARE * F.col("pages")).select("host", "path", "text", "chars"))

    free = F.greatest(F.lit(0), F.col("all") - F.coalesce("fixed", F.lit(0)) - F.col("linked"))
    left = paths.join(fixed.groupBy("host", "path").agg(F.sum("chars").alias("fixed")), ["host", "path"], "left").select(
        "host", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "/")).alias("labels"),
        free.alias("chars"))
    below = written(left.select("host", "chars", "labels", F.explode(F.sequence(F.lit(0), F.size("labels"))).alias("depth")).groupBy(
        "host", F.array_join(F.slice("labels", 1, F.col("depth")), "/").alias("path"),
        F.array_join(F.slice("labels", 1, F.greatest(F.col("depth") - 1, F.lit(0))), "/").alias("parent"), "depth").agg(
        F.sum("chars").alias("chars")))
    tips = below.filter("depth = 0").select("host", F.col("path").alias("region"), F.col("chars").alias("of"))
    region = tips
    tag = F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)
    kids = below.filter((F.col("depth") > 0) & (F.col("chars") > 0) & tag.isin(*_CONTAINERS)).select("host", "depth", "path", "parent", "chars")
    for depth in range(1, DEPTH + 1):  # a node has one child at most with so much of its text
        tips = written(kids.filter(F.col("depth") == depth).join(
            tips.withColumnRenamed("region", "parent"), ["host", "parent"]).filter("chars >= 0.7 * of").select(
            "host", F.col("path").alias("region"), F.col("chars").alias("of")))
        if tips.isEmpty():
            break
        region = region.join(tips.select("host", F.col("region").alias("_lower")), "host", "left").select(
            "host", F.coalesce("_lower", "region").alias("region"))
    key = F.udf(lambda path, text: _hash(*(path.split("/") if path else ()), str(text)), "long")
    return fixed.select("host", "path", "text", key("path", "text").alias("key")), region.select("host", "region")


def shared_texts(pages: DataFrame, fixed: DataFrame) -> DataFrame:
    """host, digest of html, ``fixed``: the template texts (see ``counted``) that a page has, as keys. A page meets its own
    alone, however many its host has."""

    def keys(batches):
        for batch in batches:
            out = []
            for host, digest, page in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for path, (_, _, texts) in places(page)[1].items():
                    out += [(host, digest, "/".join(path), text) for text in texts]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["host", "digest", "path", "text"])

    rows = pages.select("host", "digest", "html").mapInArrow(keys, "host string, digest string, path string, text long")
    return rows.join(fixed, ["host", "path", "text"]).groupBy("host", "digest").agg(F.collect_set("key").alias("fixed"))


def _outermost(nodes: list[Node]) -> list[Node]:
    known = {id(n) for n in nodes}

    def covered(n: Node) -> bool:
        n = n.parent
        while n is not None:
            if id(n) in known:
                return True
            n = n.parent
        return False

    return [n for n in nodes if not covered(n)]


def _above(node: Node):
    node = node.parent
    while node is not None and node.tag not in ("html", "body", "#page"):
        yield node
        node = node.parent


def regions(tree: Node, path: list[str]) -> tuple[list[Node], bool]:
    """The nodes that hold the article, and whether they are known to be one."""
    every: list[Node] = []

    def gather(node: Node) -> None:
        every.append(node)
        for kid in node.kids:
            if not isinstance(kid, str):
                gather(kid)

    gather(tree)
    plain = lambda n: n.role not in _DROPPED_ROLES and n.parts.isdisjoint(_NAMES)
    articles = [n for n in every if n.tag == "article" and plain(n)]
    clean = [n for n in articles if not any(_marked(x, True) for x in _above(n))]
    found = clean or [n for n in articles if all(plain(x) or x.tag == "div" for x in _above(n))]
    if not found:
        found = [n for n in every if (n.tag == "main" or n.role == "main") and plain(n)]
    if not found:
        found = [n for n in every if "articlebody" in n.parts and plain(n)]
    if found:
        return _outermost(found), True
    at = [tree]
    for label in path:
        below = [k for n in at for k in n.kids if not isinstance(k, str) and k.label == label]
        if not below:
            break
        at = below
    if len(at) == 1 and at[0].tag in ("#page", "html", "body"):
        named = [n for n in every if not n.parts.isdisjoint(_CONTENT_NAMES) and n.tag in ("div", "section") and plain(n)
                 and not any(_marked(x, False) for x in _above(n))]
        if named:
            return _outermost(named), True
    return at, False


def extract(page: str, decision: dict | None = None) -> str:
    """The main text of a page, one line for each block. Template texts stay where they are most of what is found: then
    the pages of the host are copies of each other."""
    decision = decision or {}
    tree = parse(page)
    found, known = regions(tree, decision.get("region", []))
    kept = blocks(found, known)
    fixed = decision.get("fixed")
    if fixed:
        fixed = set(fixed)
        varying = [(p, t) for p, t in kept if _hash(*p, str(_hash(t))) not in fixed]
        if 2 * sum(len(t) for _, t in varying) > sum(len(t) for _, t in kept):
            kept = varying
    return "\n".join(t for _, t in kept)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, decision (see ``decide``) for every host, from all of its pages.

    A task sends one template for each host that it meets, so a host with most of the pages sends one for each task; they
    are merged in groups of about the square root of the tasks, then those."""
    narrow = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html")).filter(
        "host <> '' AND html <> ''")
    tasks = narrow.rdd.getNumPartitions()
    groups = max(1, math.isqrt(tasks))
    tagged = narrow.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(groups)))

    def rows(found: dict) -> pa.RecordBatch:
        keys = [*found]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([json.dumps(_prune(found[k]).packed()) for k in keys], pa.string())], names=["host", "salt", "template"])

    def induce(batches):
        found: dict = {}
        for batch in batches:
            for host, page, salt in zip(*(batch.column(i).to_pylist() for i in range(3))):
                made = page_template(page)
                if (host, salt) in found:
                    merge(found[host, salt], made)
                    if len(found[host, salt].kids) > 64 or found[host, salt].pages % 256 == 0:
                        _prune(found[host, salt])
                else:
                    found[host, salt] = made
                if len(found) > HOSTS:
                    yield rows(found)
                    found = {}
        if found:
            yield rows(found)

    def merged(table: pa.Table) -> Slot:
        out = None
        for text in sorted(table["template"].to_pylist()):
            slot = Slot.unpacked(json.loads(text))
            out = slot if out is None else _prune(merge(out, slot))
        return out

    def some(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"host": [key[0].as_py()], "template": [json.dumps(merged(table).packed())]})

    def all_(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"host": [key[0].as_py()], "decision": [decide(merged(table))]})

    first = tagged.mapInArrow(induce, "host string, salt int, template string")
    second = first.groupBy("host", "salt").applyInArrow(some, "host string, template string")
    return second.groupBy("host").applyInArrow(all_, "host string, decision string")


def host_of(url_col: str = "url"):
    """The host of a URL in small letters; empty for none."""
    return F.regexp_extract(F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), _HOST, 1)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text of every row: the article in blocks, one line each, white space inside a block as one space.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by tag, role, class and
    id), scripts, styles and markup, and texts that the pages of the host share. Null and empty pages have an empty text;
    pages without a host, and of hosts with fewer than WITNESSES different pages, are read by their own tags alone. Rows
    are taken one by one, so repeated pages and ids are as they come; other columns are not read.

    The table of wrappers is written; it is broadcast if it is under Spark's limit and joined by host otherwise. Hosts whose
    wrapper is open are counted in rows, their pages read twice more; equal pages of a host share what is found.
    """
    host = host_of(url_col)
    known = written(wrappers(pages, url_col, html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), host.alias("host")).join(known, "host", "left")
    undecided = known.filter(F.get_json_object("decision", "$.open") == "true").select("host")
    if undecided.isEmpty():
        rows = rows.select("page_id", "url", "html", "decision", F.lit(None).cast("string").alias("region"),
                           F.array().cast("array<long>").alias("fixed"))
    else:
        digest = F.sha2(F.col("html").cast("binary"), 256)
        theirs = pages.select(host.alias("host"), F.col(html_col).cast("string").alias("html")).filter("html <> ''").join(
            undecided, "host", "left_semi").withColumn("digest", digest)
        fixed, region = counted(theirs)
        # Only the pages of open hosts have a digest, so no other page is moved to one task by a missing one.
        own = F.when(F.get_json_object("decision", "$.open") == "true", digest).otherwise(F.xxhash64("page_id", "html").cast("string"))
        rows = rows.withColumn("digest", own).join(shared_texts(theirs.dropDuplicates(["host", "digest"]), fixed), ["host", "digest"], "left").join(
            region, "host", "left").select("page_id", "url", "html", "decision", "region", "fixed")

    def run(batches):
        read: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, decision, region, shared in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                if decision is not None and decision not in read:
                    if len(read) > HOSTS:
                        read = {}
                    made = json.loads(decision)
                    read[decision] = made | {"fixed": frozenset(made["fixed"])}
                wrapper = read.get(decision)
                if wrapper is not None and wrapper["open"]:
                    wrapper = {"fixed": shared or [], "region": region.split("/") if region else []}
                texts.append(extract(page or "", wrapper))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")

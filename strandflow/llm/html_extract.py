"""Main text of web pages by wrapper induction: same-host pages aligned by simple tree matching."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\s++|/|[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+|[\"'=])*+)>|<(?=/?[a-zA-Z])[^>]*\Z", re.S)
MARKS = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}
NEVER = frozenset("head script style noscript template svg math canvas iframe object embed nav footer aside form button select textarea input dialog menu title".split())
#: parts of class names, ids and roles that name a component of a page, not of an article
PARTS = frozenset("ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert comment comments commentlist replies disqus respond discussion sidebar menu menus nav navbar navigation breadcrumb breadcrumbs share sharing social related recommend recommended recommendations newsletter subscribe subscription popup modal overlay footer widget widgets login signup search toolbar masthead copyright legal pagination pager complementary contentinfo outbrain taboola".split())
#: parts that say nothing of their own
PLAIN = frozenset("box list wrap wrapper container block section area bar inner outer unit slot top bottom left right item items header title form link links button buttons primary secondary main site page group panel row col column content body text the js is side up pop sign in reader readers user users visitor post posts article articles entry entries blog story stories policy law media icon icons google x info warning danger success sticky fixed global mobile desktop".split())
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
PAGE_HEAD = re.compile(r"(?:^|[\s\-_])(?:header|site-header|page-header|topbar|top-bar)(?:$|[\s\-_])", re.I)
MAIN = re.compile(r"(?:^|[\s\-_])(?:main|article|post|entry|content|story|articlebody)(?:$|[\s\-_])", re.I)


class Node:
    __slots__ = ("content", "items", "kids", "marks", "mass", "parent", "shape", "size", "tag", "words")

    def __init__(self, tag: str, marks: str, parent):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.items: list = []  # strings and nodes, in page order
        self.kids: list[Node] = []
        self.shape = self.size = self.mass = self.content = self.words = 0


def parse(text: str) -> Node:
    """A DOM tree of the whole page; forgiving: what is open at the end is closed, stray end tags are ignored."""
    root = node = Node("#root", "", None)
    at, n = 0, len(text)
    opened: Counter = Counter()  # open elements by tag, so that no search climbs in vain

    def leave(to: Node) -> Node:
        x = node
        while x is not to:
            opened[x.tag] -= 1
            x = x.parent
        return to

    while at < n:
        m = TOKEN.search(text, at)
        if not m:
            node.items.append(text[at:])
            break
        if m.start() > at:
            node.items.append(text[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                node.items.append(html.escape(m["cdata"], quote=False))
            continue
        tag = tag.lower()
        if m["end"]:
            if opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up.parent)
            elif tag in ("p", "br"):
                node.items.append(Node("br", "", node))
            continue
        if tag in CLOSES_P and opened["p"]:
            up = node
            while up is not root and up.tag not in ("p", "button", "table", "td", "th"):
                up = up.parent
            if up.tag == "p":
                node = leave(up.parent)
        if tag in SAME and any(opened[x] for x in SAME[tag][0].split()):
            close, stop = SAME[tag]
            up = node
            while up is not root and up.tag not in close.split() and up.tag not in stop.split():
                up = up.parent
            if up.tag in close.split():
                node = leave(up.parent)
        attrs = m["attrs"]
        child = Node(tag, " ".join(x.strip("\"'") for x in MARKS.findall(attrs)) if attrs and "=" in attrs else "", node)
        node.items.append(child)
        node.kids.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = close.end() if close else n
        elif tag not in VOID and not (attrs and attrs.rstrip().endswith("/") and tag not in BLOCK):
            node = child
            opened[tag] += 1
    return root


class Forest:
    """Trees by shape (equal for equal tag trees) and by content (equal for equal trees and texts), with their matches."""

    def __init__(self):
        self.shapes: dict = {}
        self.known: list[tuple[str, tuple, int]] = [("", (), 0)]  # shape -> tag, shapes of the children, size
        self.contents: dict = {}
        self.memo: dict = {}

    def add(self, root: Node) -> Node:
        """Shapes, contents, sizes, text mass and words outside links, bottom up."""
        order = _all(root)
        for x in reversed(order):
            key = (x.tag, tuple(k.shape for k in x.kids))
            if key not in self.shapes:
                self.shapes[key] = len(self.known)
                self.known.append((*key, 1 + sum(k.size for k in x.kids)))
            x.shape = self.shapes[key]
            x.size = self.known[x.shape][2]
            strings = [" ".join(html.unescape(i).split()) if isinstance(i, str) else i.content for i in x.items]
            x.content = self.contents.setdefault((x.tag, *(i for i in strings if i != "")), len(self.contents) + 1)
            own = sum(len(i) for i in strings if isinstance(i, str))
            x.mass = own + sum(k.mass for k in x.kids)
            x.words = 0 if x.tag == "a" else own + sum(k.words for k in x.kids)
        return root

    def _ends(self, xs: tuple, ys: tuple) -> tuple[int, int]:
        """How many children pair off at the front and at the back: equal trees there, which no better match undoes."""
        i, least = 0, min(len(xs), len(ys))
        while i < least and xs[i] == ys[i]:
            i += 1
        j = 0
        while j < least - i and xs[-1 - j] == ys[-1 - j]:
            j += 1
        return i, j

    def match(self, a: int, b: int) -> int:
        """Simple tree matching of two shapes: the most node pairs that an order- and ancestor-preserving match of equal tags can have."""
        stack = [(a, b)]
        while stack:
            u, v = stack[-1]
            if self._value(u, v) is not None:
                stack.pop()
                continue
            xs, ys = self.known[u][1], self.known[v][1]
            i, j = self._ends(xs, ys)
            mx, my = xs[i : len(xs) - j], ys[i : len(ys) - j]
            missing = [(p, q) for p in set(mx) for q in set(my) if self._value(p, q) is None]
            if missing:
                stack.extend(missing)
                continue
            rest = self._best(mx, my)[-1] if mx and my else 0
            self.memo[u, v] = 1 + sum(self.known[x][2] for x in (*xs[:i], *xs[len(xs) - j :])) + int(rest)
            stack.pop()
        return self._value(a, b)

    def _value(self, u: int, v: int) -> int | None:
        if u == v:
            return self.known[u][2]
        if self.known[u][0] != self.known[v][0]:
            return 0
        return self.memo.get((u, v))

    def _weights(self, xs: tuple, ys: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dx, ix = np.unique(np.array(xs), return_inverse=True)
        dy, iy = np.unique(np.array(ys), return_inverse=True)
        return np.array([[self._value(p, q) for q in dy.tolist()] for p in dx.tolist()], np.int64), ix, iy

    def _best(self, xs: tuple, ys: tuple) -> np.ndarray:
        """Best match of all xs with each beginning of ys (entry k: the first k)."""
        w, ix, iy = self._weights(xs, ys)
        return _last_row(w, ix, iy)

    def pairs(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """The best order-preserving pairs of children of two matched nodes."""
        sx, sy = tuple(x.shape for x in xs), tuple(y.shape for y in ys)
        i, j = self._ends(sx, sy)
        m, n = len(xs) - j, len(ys) - j
        out = list(zip(xs[:i], ys[:i], strict=True))
        if i < m and i < n:
            for p in set(sx[i:m]):
                for q in set(sy[i:n]):
                    self.match(p, q)
            w, ix, iy = self._weights(sx[i:m], sy[i:n])
            out += [(xs[i + u], ys[i + v]) for u, v in _trace(w, ix, iy)]
        return out + list(zip(xs[m:], ys[n:], strict=True))


def _last_row(w: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    best = np.zeros(len(iy) + 1, np.int64)
    for u in ix:
        best[1:] = np.maximum(best[1:], np.maximum.accumulate(best[:-1] + w[u][iy]))
    return best


def _trace(w: np.ndarray, ix: np.ndarray, iy: np.ndarray, cells: int = 1 << 16) -> list[tuple[int, int]]:
    """Index pairs of a best match, by divide and conquer (Hirschberg) until a table has at most ``cells`` entries."""
    out, work = [], [(0, len(ix), 0, len(iy))]
    while work:
        a, b, c, d = work.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a) * (d - c) > cells:
            mid = (a + b) // 2
            front = _last_row(w, ix[a:mid], iy[c:d])
            back = _last_row(w, ix[mid:b][::-1], iy[c:d][::-1])[::-1]
            cut = c + int((front + back).argmax())
            work += [(mid, b, cut, d), (a, mid, c, cut)]
            continue
        p, q = b - a, d - c
        best = np.zeros((p + 1, q + 1), np.int64)
        for u in range(p):
            best[u + 1, 1:] = np.maximum(best[u, 1:], np.maximum.accumulate(best[u, :-1] + w[ix[a + u]][iy[c:d]]))
        own, u, v = [], p, q
        while u and v:
            if best[u, v] == best[u - 1, v]:
                u -= 1
            elif best[u, v] == best[u, v - 1]:
                v -= 1
            else:
                u, v = u - 1, v - 1
                own.append((a + u, c + v))
        out += own[::-1]
    return out


def align(forest: Forest, a: Node, b: Node) -> dict[int, Node]:
    """id of a node of b -> the node of a it is matched to."""
    out, stack = {}, [(a, b)]
    while stack:
        x, y = stack.pop()
        out[id(y)] = x
        stack.extend((u, v) for u, v in forest.pairs(x.kids, y.kids) if u.tag == v.tag)
    return out


def component(marks: str) -> str:
    """What class names, ids and roles say: "yes" for names of page components alone, "maybe" where other words stand beside them, else ""."""
    said = ""
    for name in marks.split():
        parts = {w.lower() for w in WORD.findall(name)}
        if name.lower() in PARTS or (parts & PARTS and parts <= PARTS | PLAIN):
            return "yes"
        if parts & PARTS:
            said = "maybe"
    return said


def dropped(x: Node, inside: bool, boxes: set[int] = frozenset()) -> bool:
    """Not of the article: by its tag, by its name, or by a name that may say so where the wrapper has such a box on most pages."""
    if x.tag in NEVER or (x.tag == "header" and not inside):
        return True
    if not x.marks:
        return False
    said = component(x.marks) if x.tag not in ("article", "main", "body", "html") else ""
    return said == "yes" or (said == "maybe" and id(x) in boxes) or bool(not inside and PAGE_HEAD.search(x.marks))


def own_text(x: Node) -> str:
    return " ".join(html.unescape("".join(i for i in x.items if isinstance(i, str))).split())


def content_root(root: Node) -> Node:
    """The page's article: article or main elements, else the block with most text that isn't template."""
    best, score = root, -1.0
    stack = [(root, False)]
    while stack:
        x, inside = stack.pop()
        if x is not root and dropped(x, inside):
            continue
        named = x.tag in ("article", "main") or bool(x.marks and MAIN.search(x.marks))
        kept = x.mass - sum(k.mass for k in x.kids if dropped(k, inside))
        value = kept * (4.0 if x.tag == "article" else 3.0 if x.tag == "main" else 2.0 if named else 1.0 if x.tag in BLOCK else 0.25) + (0.5 if named else 0)
        if value > score:
            best, score = x, value
        stack.extend((k, inside or x.tag in ("article", "main")) for k in x.kids)
    return best


def blocks(root: Node, template: set[int], boxes: set[int]) -> list[str]:
    out: list[list[str]] = [[]]

    def walk(x: Node) -> None:
        stack = [iter(x.items)]
        ends = [x.tag in BLOCK]
        while stack:
            i = next(stack[-1], None)
            if i is None:
                stack.pop()
                if ends.pop():
                    out.append([])
            elif isinstance(i, str):
                out[-1].append(i)
            elif id(i) in template or dropped(i, True, boxes):
                out[-1].append(" ")
            else:
                block = i.tag in BLOCK
                if block:
                    out.append([])
                stack.append(iter(i.items))
                ends.append(block)

    walk(root)
    joined = (" ".join(html.unescape("".join(b)).split()) for b in out if b)
    return [b for b in joined if b]


def article_slot(forest: Forest, base: Node, maps: list[tuple[Node, dict[int, Node]]]) -> Node:
    """The node of the aligned tree that holds the article: down from the root to where the varying text outside links parts.

    Text counts at the node of ``base`` it is matched to, or at the nearest matched ancestor, and
    only where it differs from what most pages have there. While one child that has blocks of its
    own holds three fifths of a node's varying text, the article is in that child. Of the nodes on
    the way the innermost article or main element is taken; if there is none, the last one, or its
    parent where a heading that varies stands beside it.
    """
    usual: dict[int, Counter] = {}
    for t, to in maps:
        for y in _all(t):
            if id(y) in to:
                usual.setdefault(id(to[id(y)]), Counter())[y.content] += 1
    constant = {k: c.most_common(1)[0][0] for k, c in usual.items() if len(maps) > 1 and c.most_common(1)[0][1] * 2 > len(maps)}
    mass: Counter = Counter()
    for t, to in maps:
        stack = [(t, base)]
        while stack:
            y, at = stack.pop()
            at = to.get(id(y), at)
            if dropped(y, True) or (id(y) in to and constant.get(id(at)) == y.content) or y.tag == "a":
                continue
            mass[id(at)] += y.words - sum(k.words for k in y.kids)
            stack.extend((k, at) for k in y.kids)
    for x in reversed(_all(base)):
        if x.parent is not None:
            mass[id(x.parent)] += mass[id(x)]
    way = [base]
    while True:
        kids = [k for k in way[-1].kids if any(g.tag in BLOCK for g in k.kids)]
        most = max(kids, key=lambda k: mass[id(k)], default=None)
        if most is None or mass[id(most)] * 5 < mass[id(way[-1])] * 3 or not mass[id(most)]:
            break
        way.append(most)
    named = [x for x in way if x.tag in ("article", "main")]
    if named:
        return named[-1]
    if len(way) > 2 and any(k.tag in ("h1", "h2") and mass[id(k)] for k in way[-2].kids):
        return way[-2]
    return way[-1]


def extract(pages: list[str], least_pages: int = 3, agree: float = 0.8, wrapper: bool = True) -> list[str]:
    """Main text of each of some pages of one host.

    The pages are aligned to the one of median size. The slot whose text varies is the article
    (:func:`article_slot`). Inside it, a block that says the same in ``agree`` of the different
    articles is template, if there are ``least_pages`` of them; where such blocks hold three tenths
    of the text the articles are copies of each other and nothing is template. A block whose name
    may be a component's is one if ``agree`` of the pages have it in that place. A page on which the
    slot can't be aligned, and a host's only page, is read by its own structure; ``wrapper`` false
    reads every page so.
    """
    forest = Forest()
    distinct = sorted(set(pages), key=lambda p: (len(p), p))
    trees = {p: forest.add(parse(p)) for p in distinct}
    if not wrapper or len(distinct) < 2:
        text = {p: "\n".join(blocks(content_root(t), set(), set())) for p, t in trees.items()}
        return [text[p] for p in pages]
    base = trees[distinct[len(distinct) // 2]]
    maps = {p: {id(x): x for x in _all(t)} if t is base else align(forest, base, t) for p, t in trees.items()}
    slot = article_slot(forest, base, [(t, maps[p]) for p, t in trees.items()])
    roots: dict[str, Node] = {}
    for p, t in trees.items():
        own = content_root(t)
        found = next((y for y in _all(t) if maps[p].get(id(y)) is slot), None)
        roots[p] = found if found is not None and found.mass * 2 >= own.mass else own

    # blocks that say the same in most different articles, and boxes that most pages have
    articles = {r.content: (p, r) for p, r in roots.items()}
    said: dict[int, Counter] = {}
    boxed: Counter = Counter()
    for p, r in articles.values():
        for y in _all(r):
            x = maps[p].get(id(y))
            if x is not None and y is not r and y.tag in BLOCK and y.mass:
                said.setdefault(id(x), Counter())[y.content] += 1
    for p, r in roots.items():
        for x in {id(maps[p][id(y)]) for y in _all(r) if id(y) in maps[p] and y.marks and component(y.marks) == "maybe"}:
            boxed[x] += 1
    enough = max(least_pages, agree * len(articles))
    constant = {k: c.most_common(1)[0][0] for k, c in said.items() if c.most_common(1)[0][1] >= enough}
    same = {p: [y for y in _all(r) if y is not r and id(y) in maps[p] and constant.get(id(maps[p][id(y)])) == y.content] for p, r in roots.items()}
    copies = sum(_mass(r, {id(y) for y in same[p]}) for p, r in articles.values()) * 10 > 3 * sum(r.mass for _, r in articles.values())
    boxes = {k for k, c in boxed.items() if len(distinct) >= least_pages and c >= max(least_pages, agree * len(distinct))}
    text = {}
    for p, r in roots.items():
        template = set() if copies else {id(y) for y in same[p]}
        own = {id(y) for y in _all(r) if id(y) in maps[p] and id(maps[p][id(y)]) in boxes}
        text[p] = "\n".join(blocks(r, template, own))
    return [text[p] for p in pages]


def _mass(root: Node, some: set[int]) -> int:
    """Text mass of some nodes, those inside others not counted twice."""
    total, stack = 0, [root]
    while stack:
        x = stack.pop()
        if id(x) in some:
            total += x.mass
        else:
            stack.extend(x.kids)
    return total


def _all(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(x.kids)
    return out


def _group(pages: pa.Table) -> pa.Table:
    texts = extract(pages["html"].to_pylist())
    return pa.table({"page_id": pages["page_id"], "url": pages["url"], "text": pa.array(texts, pa.string())})


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def main_text(pages: DataFrame, group: int = 16) -> DataFrame:
    """(page_id, url, text): the article of each whole page.

    Pages of a host are dealt by a hash of their html into groups of about ``group``; every page
    takes part in inducing the wrapper of its group, and a host with a third of all pages is as many
    groups as any others. Equal pages meet in one group as copies of one page and give the same
    text. A null or empty page has no text; a null url is a host of its own; an empty table gives no
    rows. Other columns are not read.
    """
    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"), F.xxhash64("html").alias("h"))
    sizes = materialize(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("groups")), "hosts")
    dealt = rows.join(sizes, "host").withColumn("g", F.pmod(F.xxhash64("h", "page_id"), F.col("groups")).cast("int")).drop("h", "groups")
    return dealt.groupBy("host", "g").applyInArrow(_group, f"page_id {kinds['page_id']}, url string, text string")

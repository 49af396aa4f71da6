"""Main text of web pages by wrapper induction.

Pages of one host are dealt into groups of about ``GROUP`` pages.  Within a
group every page's DOM tree is aligned with those of reference pages, two of the
whole group and two of each layout in it, by simple tree matching (the largest
top-down, order-keeping mapping of equal tags and marks, found exactly on pages of any
width and depth).  Nodes
whose text is the same on most aligned pages are template and their text goes.
Markup is used on every page as well: menus, headers, footers, asides, forms,
scripts and hidden elements are dropped always, and an <article> or <main>
bounds the content.  Elements whose class, id or role names adverts, notices,
comments and the like are dropped unless the text says otherwise: one that holds
the page's unmarked <main>, an unmarked <article> with more than half of the text
that isn't template, or more than ``MOST`` of that text, is content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

GROUP = 48
GROUP_BYTES = 16 << 20  # of pages that are held and aligned together
SMALL = 300  # cells of a table that plain lists hold faster than arrays, with the same values
SIZES = 500_000  # of matchings that are kept for other pages
#: Pages are of one layout if they share this part of their tag paths.
SAME_LAYOUT = 0.5
#: An element with more than this part of a page's text that isn't template is content whatever its class says.
MOST = 2 / 3
#: Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object audio video canvas xmp".split())
DROPPED = frozenset("head nav footer aside form button select option dialog menu fieldset label datalist map annotation annotation-xml".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img annotation annotation-xml math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body article aside section div main nav table td th ul ol dl form footer header blockquote figure".split())
#: Words in class, id or role that name something other than the article.
NOT_CONTENT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu sidebar rail footer masthead topbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies "
    "disqus discussion related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets disclaimer copyright toolbar search skip".split()
)
#: Elements that don't end the block they stand in, dropped or not.
WITHIN = INLINE | frozenset("br input svg script style button select label iframe object audio video canvas map noscript template textarea datalist".split())
#: Words that make "related" a title of the article's own.
OWN_RELATED = frozenset("work works research literature studies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A quote opens a value only behind "="; elsewhere it is part of a name, as browsers read it.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "parts", "kids", "parent", "mark", "dropped", "named", "template", "sig")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, named: bool = False) -> None:
        self.tag, self.parent = tag, parent
        self.dropped = dropped  # its tag or a hidden attribute says that this isn't content
        self.named = named and not dropped  # only its class, id or role says so
        self.mark = dropped or named  # whether to drop it; judge() may lift what a name gave
        self.parts: list = []  # texts and nodes in page order
        self.kids: list[Node] = []
        self.template = False
        self.sig = 0

    def own_text(self) -> str:
        return " ".join(" ".join(p for p in self.parts if isinstance(p, str)).split())


def _marked(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element's tag or a hidden attribute, and whether its class, id or role says that this isn't content."""
    if tag in DROPPED:
        return True, False
    if not attrs or tag in ("html", "body", "main"):
        return False, False
    words = ("comment", "comments", "reply") if tag == "article" else NOT_CONTENT
    hidden = named = False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            found = [w.lower() for w in WORD.findall(value)]
            named = named or any(w in words and not (w == "related" and OWN_RELATED.intersection(found[k + 1 : k + 2])) for k, w in enumerate(found))
        elif tag != "article":
            hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and NO_DISPLAY.search(value) is not None)
    return hidden, named


def parse(page: str) -> Node:
    """A DOM tree; missing end tags are implied, stray ones ignored, a cut page ends where it ends."""
    root = here = Node("#root", None, False)
    at, n = 0, len(page)

    def add(text: str) -> None:
        if text and here is not None:
            here.parts.append(text)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(html.escape(m[1]))
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            walk = here
            while walk is not root and walk.tag != tag:
                if walk.tag in SCOPE and tag in INLINE | {"p", "li"} and walk.tag not in ("li",):
                    walk = None
                    break
                walk = walk.parent
            if walk is not None and walk is not root:
                here = walk.parent
            continue
        if tag in CLOSES or tag in ENDS_P:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            walk = here
            while walk is not root and (walk.tag in INLINE or walk.tag in ends or (walk.tag == "p" and "p" in ends)):
                if walk.tag in ends:
                    here = walk.parent
                    if tag not in ("tr",):
                        break
                walk = walk.parent
        attrs = m[4]
        node = Node(tag, here, *_marked(tag, attrs))
        here.parts.append(node)
        here.kids.append(node)
        if tag in VOID or attrs.endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        here = node
    return root


class Kinds:
    """Numbers of subtrees, equal where tags and marks are all the way down, and the matchings between them."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.like: list[tuple] = []  # tag and marks of the root
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []  # nodes
        self.found: dict[tuple[int, int], int] = {}

    def number(self, root: Node) -> None:
        stack = [(root, False)]
        while stack:
            x, done = stack.pop()
            if not done:
                stack.append((x, True))
                stack += [(k, False) for k in x.kids]
                continue
            like, kids = (x.tag, x.named, x.dropped), tuple([k.sig for k in x.kids])
            x.sig = self.known.setdefault((like, kids), len(self.size))
            if x.sig == len(self.size):
                self.like.append(like)
                self.kids.append(kids)
                self.size.append(1 + sum(self.size[k] for k in kids))

    def differing(self, a: int, b: int) -> tuple[int, int]:
        """How many children at both ends are equal; the largest mapping pairs these."""
        ka, kb = self.kids[a], self.kids[b]
        most, lo, hi = min(len(ka), len(kb)), 0, 0
        while lo < most and ka[lo] == kb[lo]:
            lo += 1
        while hi < most - lo and ka[-1 - hi] == kb[-1 - hi]:
            hi += 1
        return lo, hi

    def weight(self, a: int, b: int) -> int:
        """Nodes of the largest mapping of two subtrees, 0 if their roots differ."""
        if a == b:
            return self.size[a]
        if self.like[a] != self.like[b]:
            return 0
        return self.found[a, b] if self.kids[a] and self.kids[b] else 1

    def middle(self, a: int, b: int) -> tuple[int, int, tuple, tuple]:
        lo, hi = self.differing(a, b)
        return lo, hi, self.kids[a][lo : len(self.kids[a]) - hi], self.kids[b][lo : len(self.kids[b]) - hi]

    def matching(self, a: int, b: int) -> int:
        """Simple tree matching of two kinds with equal roots: the largest top-down, order-keeping mapping."""
        if a == b:
            return self.size[a]
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.found:
                stack.pop()
                continue
            lo, hi, xs, ys = self.middle(x, y)
            alike: dict[tuple, list[int]] = {}
            for q in set(ys):
                if self.kids[q]:
                    alike.setdefault(self.like[q], []).append(q)
            missing = [(p, q) for p in set(xs) if self.kids[p] for q in alike.get(self.like[p], ()) if p != q and (p, q) not in self.found]
            if missing:
                stack += missing
                continue
            row, step = self.rows(xs, ys)
            for p in xs if ys else ():
                row = step(row, p)
            ends = self.kids[x][:lo] + self.kids[x][len(self.kids[x]) - hi :]
            self.found[x, y] = 1 + sum(self.size[k] for k in ends) + int(row[-1])
            stack.pop()
        return self.found[a, b]

    def rows(self, xs: tuple, ys: tuple) -> tuple[list | np.ndarray, Callable]:
        """The first row of the table of two lists, and what makes the next row from a row and the next of ``xs``."""
        kinds, at = np.unique(np.array(ys, np.int64), return_inverse=True) if len(xs) * len(ys) > SMALL else (sorted(set(ys)), None)
        kinds, weights = [int(q) for q in kinds], {}

        def weights_of(p: int):
            if p not in weights:
                weights[p] = [self.weight(p, q) for q in kinds]
                weights[p] = dict(zip(kinds, weights[p], strict=True)) if at is None else np.array(weights[p], np.int64)
            return weights[p]

        def plain(row: list[int], p: int) -> list[int]:
            own, out, last = weights_of(p), [0], 0
            for j, q in enumerate(ys):
                w = row[j] + own[q]
                last = max(last, row[j + 1], w)
                out.append(last)
            return out

        def wide(row: np.ndarray, p: int) -> np.ndarray:
            out = np.zeros_like(row)
            np.maximum(row[1:], row[:-1] + weights_of(p)[at], out=out[1:])
            return np.maximum.accumulate(out, out=out)

        return ([0] * (len(ys) + 1), plain) if at is None else (np.zeros(len(ys) + 1, np.int64), wide)

    def pairs(self, a: int, b: int) -> list[tuple[int, int]]:
        """Numbers of the children that the largest mapping pairs.

        Some rows of the table are kept and those between made again on the way
        back, so that memory grows with the root of its length.
        """
        lo, hi, xs, ys = self.middle(a, b)
        na, nb = len(self.kids[a]), len(self.kids[b])
        out = [(k, k) for k in range(lo)] + [(na - 1 - k, nb - 1 - k) for k in range(hi)]
        if not xs or not ys:
            return out
        row, step = self.rows(xs, ys)
        every, held = isqrt(len(xs)) + 1, []
        for k, p in enumerate(xs):
            if k % every == 0:
                held.append(row)
            row = step(row, p)
        i, j = len(xs), len(ys)
        while i and j:
            start = (i - 1) // every * every
            block = [held.pop()]
            for p in xs[start:i]:
                block.append(step(block[-1], p))
            while i > start and j:
                here, above = block[i - start], block[i - start - 1]
                if here[j] == above[j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((lo + i, lo + j))
        return out


def align(kinds: Kinds, a: Node, b: Node) -> list[tuple[Node, Node]]:
    """All aligned node pairs of two pages."""
    if len(kinds.found) > SIZES:
        kinds.found.clear()
    kinds.matching(a.sig, b.sig)
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        out.append((x, y))
        if x.sig == y.sig:
            stack += zip(x.kids, y.kids, strict=True)
        elif x.kids and y.kids:
            stack += [(x.kids[i], y.kids[j]) for i, j in kinds.pairs(x.sig, y.sig)]
    return out


def shape(root: Node) -> frozenset[int]:
    """Hashes of the tag paths of a page, however often each occurs."""
    out, stack = set(), [(root, 0)]
    while stack:
        x, above = stack.pop()
        path = hash((above, x.tag, x.dropped or x.named))
        out.add(path)
        stack += [(k, path) for k in x.kids]
    return frozenset(out)


def layouts(pages: list[Node]) -> list[list[Node]]:
    """Lists of pages to align, the most typical page of each first: all pages, then those of each layout of three or more."""
    shapes = [shape(p) for p in pages]
    alike = [[len(a & b) / len(a | b) for b in shapes] for a in shapes]
    typical = sorted(range(len(pages)), key=lambda k: (-sum(alike[k]), k))
    out, left = [typical], typical
    while left:
        own = [k for k in left if alike[left[0]][k] >= SAME_LAYOUT]
        left = [k for k in left if alike[left[0]][k] < SAME_LAYOUT]
        if 3 <= len(own) < len(pages):
            out.append(own)
    return [[pages[k] for k in ks] for ks in out]


def induce(pages: list[Node]) -> None:
    """Mark template nodes: same text on most pages that a reference is aligned with, while the rest varies.

    Pages without elements and text are left out.  The references are the most
    typical page of all and of each layout, and for each of these lists also the
    page with most text outside what its first reference is aligned with.
    """
    pages = [p for p in pages if p.parts]
    if len(pages) < 3:
        return
    kinds = Kinds()
    for p in pages:
        kinds.number(p)
    for group in layouts(pages):
        pairs = _mark_template(kinds, group)
        reached = [{id(y) for _, y in aligned} for aligned in pairs]
        missed = [sum(bool(x.own_text()) for x in _all(p) if id(x) not in ids) for p, ids in zip(group[1:], reached, strict=True)]
        if max(missed):
            second = missed.index(max(missed)) + 1
            _mark_template(kinds, [group[second], *group[:second], *group[second + 1 :]])


def _mark_template(kinds: Kinds, pages: list[Node]) -> list[list[tuple[Node, Node]]]:
    """Mark what the first page shows to be template; its alignments with the others."""
    ref = pages[0]
    pairs = [align(kinds, ref, p) for p in pages[1:]]
    seen: dict[int, list[int]] = {}
    texts: dict[int, str] = {}

    def text_of(x: Node) -> str:
        if id(x) not in texts:
            texts[id(x)] = x.own_text()
        return texts[id(x)]

    for aligned in pairs:
        for x, y in aligned:
            if text_of(x):
                s = seen.setdefault(id(x), [0, 0])
                s[0] += 1
                s[1] += text_of(x) == text_of(y)
    constant = {k for k, (n, same) in seen.items() if n >= 2 and n >= 0.6 * len(pairs) and same >= 0.8 * n}
    if not constant:
        return pairs
    for aligned, own in [(None, ref), *zip(pairs, pages[1:], strict=True)]:
        nodes = [(x, x) for x in _all(ref)] if aligned is None else aligned
        hits = [y for x, y in nodes if id(x) in constant and text_of(x) == text_of(y)]
        fresh = [y for y in hits if not y.template]
        for y in fresh:
            y.template = True
        judge(own)
        agree, varies, same = {id(y) for y in hits}, 0, 0
        stack = [(own, False)]
        while stack:
            y, under = stack.pop()
            if y.dropped:
                continue
            under = under or y.mark
            if id(y) not in agree:
                varies += len(text_of(y))
            elif not under:
                same += len(text_of(y))
            stack += [(k, under) for k in y.kids]
        if not varies or same > varies:  # these pages are copies of one another, and nothing tells template from text
            for y in fresh:
                y.template = False
    return pairs


def _all(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        x = stack.pop()
        yield x
        stack += x.kids


def judge(root: Node) -> None:
    """Lift the marks that only a name gave from elements that hold the content."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        if not x.dropped:
            stack += x.kids
    if not any(x.named for x in order):
        return
    size: dict[int, int] = {}  # text that isn't template, dropped elements left out
    most: dict[int, int] = {}  # of the largest unmarked article below
    main: set[int] = set()  # elements that hold an unmarked main
    for x in reversed(order):
        kids = [k for k in x.kids if id(k) in size]
        size[id(x)] = (0 if x.template or x.dropped else len(x.own_text())) + sum(size[id(k)] for k in kids)
        most[id(x)] = max([most[id(k)] for k in kids] + [size[id(x)] if x.tag == "article" and not x.named else 0])
        if x.tag == "main" or any(id(k) in main for k in kids):
            main.add(id(x))
    whole = size[id(root)]
    for x in order:
        if x.named and x.tag != "article":
            x.mark = not (id(x) in main or 2 * most[id(x)] > whole or size[id(x)] > MOST * whole)


def main_text(root: Node) -> str:
    """Blocks of the content in page order."""
    judge(root)
    roots = []
    stack = [root]
    while stack:  # outermost articles, else mains, that aren't marked
        x = stack.pop()
        if x.mark:
            continue
        if x.tag in ("article", "main"):
            roots.append(x)
        else:
            stack += reversed(x.kids)
    articles = [x for x in roots if x.tag == "article"]
    inner = [y for x in roots if x.tag == "main" for y in _outer_articles(x)]
    found = articles + inner or roots
    bounded = bool(found)
    found = found or [root]
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    for top in found:
        stack2: list = [top]
        while stack2:
            x = stack2.pop()
            if isinstance(x, str):
                line.append(x)
                continue
            if x is None:
                flush()
                continue
            if x.mark and x is not top:
                if x.tag not in WITHIN:
                    flush()
                continue
            if x.tag == "br":
                line.append(" ")
                continue
            if x.tag == "header" and not (bounded and any(k.tag in HEADINGS for k in _all(x))):
                flush()
                continue
            inline = x.tag in INLINE
            if not inline:
                flush()
                stack2.append(None)
            parts = [p for p in x.parts if not isinstance(p, str)] if x.template else x.parts
            stack2 += reversed(parts)
        flush()
    return "\n".join(blocks)


def _outer_articles(node: Node) -> list[Node]:
    out, stack = [], list(reversed(node.kids))
    while stack:
        x = stack.pop()
        if x.mark:
            continue
        if x.tag == "article":
            out.append(x)
        else:
            stack += reversed(x.kids)
    return out


def extract_group(pages: list[str | None]) -> list[str]:
    trees = [parse(p or "") for p in pages]
    first: dict[str, Node] = {}
    for p, t in zip(pages, trees, strict=True):
        first.setdefault(p or "", t)
    distinct = list(first.values())
    induce(distinct)  # equal pages would vote twice
    texts = {p: main_text(t) for p, t in first.items()}
    return [texts[p or ""] for p in pages]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page row.

    A null or empty page has the text ''; a null url belongs to the host ''.
    Ids keep their type; repeated rows are kept; markup that is cut off ends where
    it ends; other columns are ignored; an empty table gives no rows.  Very long
    pages are read whole, in groups of fewer pages: a group is closed at
    ``GROUP_BYTES``.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    # a saved table: the join is a broadcast only if the file is below Spark's checked threshold
    large = saved(base.groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP), "large-hosts")
    dealt = base.join(large, "host", "left").withColumn("chunk", F.pmod(F.xxhash64("page_id", "url"), F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1))))
    rows = dealt.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "host", "chunk")
    placed = rows.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "page_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, size = None, [], 0

        def done() -> pd.DataFrame:
            texts = extract_group([h for _, _, h in held])
            return pd.DataFrame({"page_id": [i for i, _, _ in held], "url": [u for _, u, _ in held], "text": texts, "n_chars": [len(t) for t in texts]})

        for batch in batches:
            for page_id, url, page, host, chunk in batch.itertuples(index=False, name=None):
                if (host, chunk) != key or len(held) >= 4 * GROUP or size >= GROUP_BYTES:
                    if held:
                        yield done()
                    key, held, size = (host, chunk), [], 0
                held.append((page_id, url, page))
                size += len(page or "")
        if held:
            yield done()

    out = placed.mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(pages.select(id_col).schema[0].dataType))

"""HTML extraction (1): wrapper induction.

Pages become DOM trees; runs of siblings of one shape count as one repeatable
node.  The trees of a host are aligned by simple tree matching (equal labels,
the best order-preserving pairing of children, recursively) and merged into the
host's template, node by node.  A node remembers on how many pages it stood and
the candidate of a majority vote over its texts.  A second pass counts on how
many pages the candidate stands: text that more than half of a node's pages
share is template, the varying slots are content.  Neighbouring siblings of one
label are one slot, which varies where their texts differ.

Induction covers every page, equal ones of a host once: copies say nothing about
what is constant, and they are dropped over the whole table, so that it doesn't
matter how the pages are dealt over tasks.  A task merges what it reads of each host into one
tree, and those partial templates are merged again, twice in bounded groups,
then by host, so a host with a third of all pages is never in one task.  A
node keeps all child shapes, and trees have any depth: nothing here recurses.  The
templates are broadcast while their counted bytes are small, else sent once to
each group of a host's pages.

Extraction aligns a page with its host's template, drops constant nodes and the
parts that are never the article (by tag, role and class words; inside an article
element a compound class name counts only if all its parts do, so that
"share-price" stays where "share-buttons" goes), takes the
article elements or else the lowest subtree that holds all of the varying text,
and returns all their blocks that vary, lists of links too.  If nothing varies (a host of copies), constants stay.

Defined results: null and empty html give empty text; a null or odd url counts
as one host; repeated rows are extracted each; broken markup is read as far as
it goes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PAGES = 3  # pages that a constant must have been seen on
FAN_IN = 64
BROADCAST_BYTES = 32_000_000
GROUP_PAGES = 5000  # pages of a host that one copy of its template serves where templates are not broadcast
HOSTS = 2000  # trees that a task holds at once
DENSE = 4096  # pairs of children up to which the whole table of a matching is filled

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
NEVER = frozenset("head script style noscript template iframe svg math canvas object embed audio video nav footer aside form button select option textarea input label fieldset menu dialog search title xmp noembed noframes".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "dt", "dd", "li", "summary", "figcaption"}
#: A start tag that ends an open element of these tags (up to the stop tags).
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Class and id words of what is not the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar "
    "comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations teaser pagination pager paging widget widgets search skip hidden meta byline tags copyright disclaimer rail outbrain taboola feedback rating".split()
)
#: What else a compound name of such a part may hold: words for its place, form or entries.
PARTS = frozenset(
    "area articles bar block body bottom box btn button buttons container content entries entry floating footer form group head header heading holder icon icons inline inner item items label layer left link links list "
    "main media message module off on outer overlay page panel post posts right row section site slot space stories story sticky text title toggle tool tools top unit wrap wrapper zone".split()
)
UNCLOSED = frozenset("iframe svg math noscript template noembed noframes textarea title xmp".split())  # empty where no end tag follows; a script or style then reaches to the end
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("tag", "label", "skip", "soft", "partly", "role", "children", "constant")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.children, self.constant = tag, [], False
        self.role, self.label = "", tag
        never, named, whole = tag in NEVER, False, False  # by tag, role or style; by a class word; by all words of a class name
        if attributes and ("=" in attributes or "hidden" in attributes.lower()):
            names = []
            for key, value in _ATTRIBUTE.findall(attributes):  # in order and whole: what a value holds is no name
                key, value = key.lower(), unescape(value.strip("\"'"))
                if key in ("class", "id"):
                    for name in value.split():
                        words = _WORD.findall(_CAMEL.sub(r"\1 \2", name).lower())
                        names += words
                        if not WORDS.isdisjoint(words):
                            named = True
                            whole |= all(w in WORDS or w in PARTS for w in words)
                elif key == "role":
                    self.role = value.lower()
                    never |= self.role in ROLES
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    never = True
            if names:
                self.label = f"{tag}.{'.'.join(sorted(set(names))[:4])}"
        self.soft = named and not never and tag not in ("html", "body", "article", "main")
        self.skip, self.partly = never or self.soft, self.soft and not whole

    def text(self) -> str:
        """The block's own text, inline elements included, inner blocks not."""
        out: list[str] = []
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append(" ")
            elif c.tag not in BLOCK and c.tag not in RAW:
                stack.extend(reversed(c.children))
        return " ".join("".join(out).split())

    def blocks(self) -> Iterator[Node]:
        """The nearest blocks below, through inline elements."""
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Node):
                if c.tag in BLOCK:
                    yield c
                elif c.tag not in RAW:
                    stack.extend(reversed(c.children))


def parse(html: str) -> Node:
    """The DOM tree, with the usual implied ends of elements."""
    root = Node("html", "")
    stack = [root]
    at, n = 0, len(html)
    pattern, endless = _TAG, set()
    opened: dict[str, list[int]] = {}  # where each tag stands in the stack
    blocks: list[int] = []  # and where blocks do

    def cut(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in BLOCK:
                blocks.pop()

    add = lambda raw: stack[-1].children.append(unescape(raw) if "&" in raw else raw)
    while at < n:
        sign = html.find("<", at)
        if sign != at:
            add(html[at : sign if sign >= 0 else n])
            if sign < 0:
                break
            at = sign
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = end + 3 if end >= 0 else n
            continue
        if html.startswith("<![CDATA[", at) and (end := html.find("]]>", at)) >= 0:
            stack[-1].children.append(html[at + 9 : end])
            at = end + 3
            continue
        m = None
        if html[at + 1 : at + 2] in "!?" and at + 1 < n:
            end = html.find(">", at)
            if end >= 0:
                at = end + 1
                continue
        elif (html[at + 1 : at + 2] or " ").isalpha() or html.startswith("</", at):
            m = pattern.match(html, at)
            if m is None and pattern is _TAG and _BARE_TAG.match(html, at):  # a quote that never ends: from here on quotes count as any other sign
                pattern = _BARE_TAG
                m = pattern.match(html, at)
        if m is None:
            if html.find(">", at) < 0:  # no tag follows
                add(html[at:])
                break
            add("<")
            at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            # an inline end tag doesn't reach over blocks
            if (places := opened.get(tag)) and (tag in BLOCK or not blocks or blocks[-1] < places[-1]):
                cut(places[-1])
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and blocks and stack[blocks[-1]].tag == "p":
            cut(blocks[-1])
        if tag == "body":
            cut(1)
        elif tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            stop = max((opened[x][-1] for x in stops if opened.get(x)), default=0)
            ended = [places[k] for x in ends if (places := opened.get(x)) and (k := bisect_right(places, stop)) < len(places)]
            if ended:
                cut(min(ended))
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            if tag in ("svg", "math") and m[3].endswith("/"):
                continue
            end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*+>", re.I).search(html, at)
            if end is None:
                endless.add(tag)
            at = end.end() if end else at if tag in UNCLOSED else n
        elif tag not in VOID and not m[3].endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(node)
    return root


# -- templates: [label, pages, candidate, votes, children] ---------------------------------------------------


def _shape(node: Node, members: list[Node] | None = None) -> list:
    """A page's tree as a template of one page; with its nodes, as sixth entry, if ``members`` is given."""
    nodes, ends = [node], []  # by levels: a node's blocks stand together, the ends say where
    for n in nodes:
        nodes.extend(n.blocks())
        ends.append(len(nodes))
    shapes: list = [None] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        text = nodes[i].text()
        children: list = []
        for j in range(ends[i - 1] if i else 1, ends[i]):
            shape, shapes[j] = shapes[j], None
            if children and children[-1][0] == shape[0]:
                children[-1] = _merged(children[-1], shape, 0)
            else:
                children.append(shape)
        shapes[i] = [nodes[i].label, 1, crc32(text.encode()) if text else 0, 1 if text else 0, children]
        if members is not None:
            shapes[i].append([nodes[i]])
    return shapes[0]


def _places(t: list) -> dict[str, list[int]]:
    """Where each label stands among a node's children; kept, as seventh entry, by wide nodes of templates that pages are aligned with."""
    if len(t) > 6:
        return t[6]
    where: dict[str, list[int]] = {}
    for j, q in enumerate(t[4]):
        where.setdefault(q[0], []).append(j)
    if len(t) == 6 and len(t[4]) > 64:
        t.append(where)
    return where


def _score(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the size of the largest common top-down part."""
    if a[0] != b[0]:
        return 0
    if not a[4] or not b[4]:
        return 1
    if (id(a), id(b)) not in memo:
        todo, found = [(a, b)], []
        while todo:  # all pairs of nodes that the score rests on, each before those below
            p, q = todo.pop()
            found.append((p, q))
            memo[id(p), id(q)] = 0
            where = _places(q)
            for x in p[4]:
                if x[4]:
                    todo += [(x, y) for j in where.get(x[0], ()) if (y := q[4][j])[4] and (id(x), id(y)) not in memo]
        for p, q in reversed(found):
            memo[id(p), id(q)] = 1 + (_sparse(p[4], q[4], memo, _places(q))[0] if len(p[4]) * len(q[4]) > DENSE else _dense(p[4], q[4], memo))
    return memo[id(a), id(b)]


def _dense(x: list, y: list, memo: dict) -> int:
    """The weight of the best order-preserving pairing, from all pairs."""
    row = [0] * (len(y) + 1)
    for p in x:
        left = row[:]
        for j, q in enumerate(y, 1):
            w = _score(p, q, memo)
            row[j] = max(row[j - 1], left[j], left[j - 1] + w if w else 0)
    return row[-1]


def _sparse(x: list, y: list, memo: dict, where: dict[str, list[int]] | None = None) -> tuple[int, list[tuple[int, int]]]:
    """The weight and pairs of the best order-preserving pairing, from the pairs of equal labels alone (a tree of prefix maxima over those of y that x has labels of)."""
    where = _places([None] * 4 + [y]) if where is None else where
    at = sorted(j for label in {p[0] for p in x} for j in where.get(label, ()))
    place, size = {j: k for k, j in enumerate(at)}, len(at)
    best: list = [(0, None)] * (size + 1)  # (weight, (i, j, the chain before))
    for i, p in enumerate(x):
        for j in reversed(where.get(p[0], ())):
            weight, chain, k = 0, None, place[j]
            while k:
                if best[k][0] > weight:
                    weight, chain = best[k]
                k &= k - 1
            weight += _score(p, y[j], memo)
            k, chain = place[j] + 1, (i, j, chain)
            while k <= size:
                if best[k][0] < weight:
                    best[k] = (weight, chain)
                k += k & -k
    weight, chain, k, out = 0, None, size, []
    while k:
        if best[k][0] > weight:
            weight, chain = best[k]
        k &= k - 1
    while chain is not None:
        out.append(chain[:2])
        chain = chain[2]
    return weight, out[::-1]


def _pairs(x: list, y: list, memo: dict, node: list | None = None) -> list[tuple[int, int]]:
    """The best order-preserving pairing of two lists of children (node: the one with the children y)."""
    if len(x) == len(y) and [c[0] for c in x] == [c[0] for c in y]:
        return [(i, i) for i in range(len(x))]
    if len(x) * len(y) > DENSE:
        return _sparse(x, y, memo, _places(node) if node else None)[1]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    weight = [[_score(p, q, memo) for q in y] for p in x]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            w = weight[i - 1][j - 1]
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + w if w else 0)
    out, i, j = [], len(x), len(y)
    while i and j:
        w = weight[i - 1][j - 1]
        if w and table[i][j] == table[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _merged(a: list, b: list, pages: int | None = None) -> list:
    """Two templates of one label as one.  pages: of b, if not its own (0: a sibling on the same page)."""
    memo: dict = {}  # by identity: a and b stay as they are
    top: list = [None]
    todo = [(a, b, top, 0)]
    while todo:
        s, t, above, at = todo.pop()
        if not s[3] or not t[3] or s[2] == t[2]:
            vote = (s[2] if s[3] else t[2], s[3] + t[3])
        else:
            vote = (s[2], s[3] - t[3]) if s[3] >= t[3] else (t[2], t[3] - s[3])
        if pages == 0:  # siblings: differing texts vary
            vote = (s[2], s[3]) if s[2] == t[2] else (0, 0)
        children: list = []
        i, j = 0, 0
        x, y = s[4], t[4]
        for p, q in [*_pairs(x, y, memo), (len(x), len(y))]:
            children += x[i:p]
            children += y[j:q]
            if p < len(x):
                todo.append((x[p], y[q], children, len(children)))
                children.append(None)
            i, j = p + 1, q + 1
        above[at] = [s[0], s[1] + (t[1] if pages is None else pages), *vote, children]
        if len(s) > 5:
            above[at].append(s[5] + t[5])
    return top[0]


def _held(parts: list[tuple[int, list]], template: list) -> None:
    """Adds a template to those held: neighbours of like numbers of pages are merged, so that a wide one is not gone through for each page."""
    n = 1
    while parts and parts[-1][0] <= n:
        k, before = parts.pop()
        n, template = n + k, _merged(before, template)
    parts.append((n, template))


def _whole(parts: list[tuple[int, list]]) -> list:
    """All that is held as one template."""
    total = parts[-1][1]
    for _, before in reversed(parts[:-1]):
        total = _merged(before, total)
    return total


def dumps(template: list) -> str:
    """JSON of the nodes in preorder, each with the number of its children."""
    return json.dumps([[*t[:4], len(t[4])] for t in preorder(template)], separators=(",", ":"))


def loads(raw: str) -> list:
    rows = json.loads(raw)
    top, missing = [], []  # nodes that still get children, and how many
    for row in rows:
        node = [*row[:4], []]
        if top:
            top[-1][4].append(node)
            missing[-1] -= 1
        else:
            root = node
        top.append(node)
        missing.append(row[4])
        while top and not missing[-1]:
            top.pop()
            missing.pop()
    return root


def preorder(template: list) -> Iterator[list]:
    stack = [template]
    while stack:
        t = stack.pop()
        yield t
        stack.extend(reversed(t[4]))


def _aligned(page: list, template: list) -> Iterator[tuple[list, list]]:
    """The pairs of a page's and a template's nodes."""
    todo, memo = [(page, template)], {}
    while todo:
        p, t = todo.pop()
        yield p, t
        todo += [(p[4][i], t[4][j]) for i, j in _pairs(p[4], t[4], memo, t)]


def tally(page: list, template: list, counts: list[list[int]]) -> None:
    """Adds a page to the counts (pages, pages with the candidate) of the template's nodes, whose sixth entries are their numbers."""
    for p, t in _aligned(page, template):
        count = counts[t[5]]
        count[0] += 1
        count[1] += p[3] > 0 and p[2] == t[2]


def settled(template: list, constants: Iterable[int]) -> list:
    """The template with, as sixth entries, whether a node's candidate is constant (by its number)."""
    constants = frozenset(constants)
    for i, t in enumerate(preorder(template)):
        t[5:] = [i in constants]
    return template


def align(page: list, template: list) -> None:
    """Marks the page's nodes (sixth entries) whose text the settled template holds as constant."""
    for p, t in _aligned(page, template):
        if t[5]:
            for node in p[5]:
                text = node.text()
                node.constant = bool(text) and crc32(text.encode()) == t[2]


# -- extraction ---------------------------------------------------------------------------------------------


def _masses(node: Node) -> dict[int, int]:
    """Characters of varying text below the node and below each element in it, by its id."""
    found = [(node, node.tag in BLOCK and node.constant, 0)]
    total = []
    for i, (n, constant, _) in enumerate(found):
        k = 0
        for c in n.children:
            if isinstance(c, str):
                k += 0 if constant else len(c.strip())
            elif not c.skip:
                found.append((c, c.constant if c.tag in BLOCK else constant, i))
        total.append(k)
    for i in range(len(found) - 1, 0, -1):
        total[found[i][2]] += total[i]
    return {id(n): k for (n, _, _), k in zip(found, total, strict=True)}


def _reconsidered(node: Node, total: int) -> int:
    """Takes back what a class word said of an element that holds an article element or more than half of the page; returns the characters."""
    found, size, holds = [(node, 0)], [], []
    for i, (n, _) in enumerate(found):
        k = 0
        for c in n.children:
            if isinstance(c, str):
                k += len(c.strip())
            elif c.soft or not c.skip:
                found.append((c, i))
        size.append(k)
        holds.append(n.tag in ("article", "main") or n.role in ("article", "main"))
    for i in range(len(found) - 1, 0, -1):
        n, above = found[i]
        if n.soft and (holds[i] or 2 * size[i] > total):
            n.skip = False
        size[above] += size[i]
        holds[above] |= holds[i] and not n.skip
    return size[0]


def _outermost(node: Node, kind: str) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n is not node and (n.tag == kind or n.role == kind):
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if isinstance(c, Node) and not c.skip]
    return out


def _trusted(article: Node) -> None:
    """Inside an article, a word within a longer class name says nothing."""
    stack = [article]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node):
                if c.partly:
                    c.skip = False
                stack.append(c)


def _roots(node: Node) -> list[Node]:
    """The article elements (else the main ones) that vary, or the lowest subtree that holds all varying text of the page."""
    found = _outermost(node, "article") or _outermost(node, "main")
    if varying := [x for x in found if _masses(x)[id(x)]]:
        return varying
    mass = _masses(node)
    total = mass[id(node)]
    while total:
        whole = next((c for c in node.children if isinstance(c, Node) and not c.skip and c.tag in BLOCK and c.tag not in ("p", "pre", "blockquote") and mass[id(c)] == total), None)
        if whole is None:
            break
        node = whole
    return [node]


def _blocks(node: Node, keep: bool) -> Iterator[str | None]:
    """Texts of a root in page order; None ends a block.  A block's constancy holds for its inline elements."""
    constant = node.tag in BLOCK and node.constant
    todo: list = [(c, constant, True) for c in reversed(node.children)]
    while todo:
        c, constant, outer = todo.pop()
        if c is None:
            yield None
        elif isinstance(c, str):
            if keep or not constant:
                yield c
        elif c.tag in ("br", "wbr"):
            yield " " if c.tag == "br" else ""
        elif not c.skip and not (c.tag == "header" and outer and not _has_heading(c)):
            if c.tag in BLOCK:
                yield None
                todo.append((None, False, False))
                constant = c.constant
            todo += [(x, constant, False) for x in reversed(c.children)]


def _has_heading(node: Node) -> bool:
    todo = [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if c.tag in ("h1", "h2"):
                    return True
                todo.append(c)
    return False


def _joined(roots: list[Node], keep: bool) -> str:
    out, now = [], []
    for piece in (piece for root in roots for piece in [*_blocks(root, keep), None]):
        if piece is not None:
            now.append(piece)
        elif now:
            text = " ".join("".join(now).split())
            if text:
                out.append(text)
            now = []
    return "\n\n".join(out)


def extract(html: str | None, template: list | None = None) -> str:
    """The article's text: blocks joined by an empty line."""
    if not html:
        return ""
    page = parse(html)
    _reconsidered(page, _reconsidered(page, 1 << 62))
    for c in page.children:
        if isinstance(c, Node) and c.tag == "header":
            c.skip = True
    for body in page.children:
        if isinstance(body, Node) and body.tag == "body":
            for c in body.children:  # a page's header; an article's own has its heading
                if isinstance(c, Node) and c.tag == "header":
                    c.skip = True
    for article in _outermost(page, "article"):
        _trusted(article)
    if template:
        align(_shape(page, []), template)
    text = _joined(_roots(page), False)
    if not text:  # nothing varies: copies of one page
        text = _joined(_roots(page), True)
    return text


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def originals(pages: DataFrame) -> DataFrame:
    """The pages (url, html) that have html, without a host's copies: one of all equal ones, wherever they lie.

    Hashes alone are shuffled to see which come twice; pages with one of those (all pages, if the hashes are too many to
    broadcast) are then grouped by host and digest, where tasks drop their own copies before the shuffle."""
    from quern.llm import textkernel as tk

    keyed = pages.where("html != ''").select("url", "html", F.xxhash64(_host(), F.col("html")).alias("key"))
    repeated = tk.cut(keyed.groupBy("key").count().where("count > 1").select("key"), "repeated")
    distinct = lambda rows: rows.groupBy(_host().alias("host"), F.sha2("html", 256).alias("mark")).agg(F.min("url").alias("url"), F.first("html").alias("html")).select("url", "html")
    if repeated.count() > tk.BROADCAST_ROWS:
        return distinct(keyed)
    known = F.broadcast(repeated)
    copies = tk.cut(distinct(keyed.join(known, "key", "left_semi")), "copies")
    return keyed.join(known, "key", "left_anti").select("url", "html").unionByName(copies)


def induce(pages: DataFrame) -> DataFrame:
    """(host, template): each host's template as JSON, from all the (original) pages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        found: dict[str, list[tuple[int, list]]] = {}
        for batch in batches:
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _held(found.setdefault(host_of(url), []), _shape(parse(html)))
            if len(found) > HOSTS:
                yield out((host, task, dumps(_whole(parts))) for host, parts in found.items())
                found = {}
        yield out((host, task, dumps(_whole(parts))) for host, parts in found.items())

    def out(rows) -> pa.RecordBatch:
        rows = list(rows)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["host", "task", "template"])

    def add(table: pa.Table) -> pa.Table:
        parts: list[tuple[int, list]] = []
        for row in table.sort_by("task").to_pylist():
            _held(parts, loads(row["template"]))
        return pa.Table.from_batches([out([(row["host"], row["task"] // FAN_IN, dumps(_whole(parts)))])])

    parts = pages.select("url", "html").mapInArrow(read, "host string, task int, template string")
    for _ in range(2):  # at most FAN_IN trees in a group; the last holds one of FAN_IN ** 2 tasks
        parts = parts.groupBy("host", F.floor(F.col("task") / FAN_IN).alias("group")).applyInArrow(lambda t: add(t), "host string, task int, template string")
    return parts.groupBy("host").applyInArrow(lambda t: add(t), "host string, task int, template string").select("host", "template")


def _aside(pages: DataFrame, templates: DataFrame, kernel: Callable[[Iterator[tuple[pa.RecordBatch, Callable[[str], dict | None]]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The kernel over batches of the pages (with a url), each with a function that finds a host's row of templates.

    Templates are broadcast while they are small.  Else pages are dealt by host, a large host's in groups, and its row comes once before each group."""
    size = templates.agg(F.sum(F.length("template"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = pages.sparkSession.sparkContext.broadcast({r.host: r.asDict() for r in templates.collect()})
        return pages.mapInArrow(lambda batches: kernel((batch, known.value.get) for batch in batches), schema)
    n = len(pages.columns)
    hosts = pages.groupBy(_host().alias("__host")).count()
    large = F.broadcast(hosts.where(F.col("count") > GROUP_PAGES).select("__host", F.ceil(F.col("count") / GROUP_PAGES).cast("int").alias("__groups")))
    groups = F.coalesce("__groups", F.lit(1))
    rows = templates.select(F.struct(*templates.columns).alias("__found"), F.col("host").alias("__host")).join(large, "__host", "left").select("__host", F.explode(F.sequence(F.lit(0), groups - 1)).alias("__group"), "__found")
    sent = pages.withColumn("__host", _host()).join(large, "__host", "left").withColumn("__group", F.pmod(F.xxhash64(*pages.columns), groups).cast("int")).drop("__groups")
    both = sent.unionByName(rows, allowMissingColumns=True).select(*pages.columns, "__host", "__group", "__found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parted():
            last: dict[str, dict] = {}
            for batch in batches:
                known, found = dict(last), batch.column(n + 2)
                for row in found.filter(found.is_valid()).to_pylist():
                    known[row["host"]] = row
                    last = {row["host"]: row}
                yield batch.filter(found.is_null()).select(range(n)), known.get

        return kernel(parted())

    return both.repartition("__host", "__group").sortWithinPartitions("__host", "__group", F.col("__found").isNull()).mapInArrow(run, schema)


def constants(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(host, template, constants): with the numbers of the nodes whose candidate stands on more than half of their pages, counted over all (original) pages."""

    def run(given) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[list, list[list[int]]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for host, (_, counts) in found.items():
                at = [i for i, c in enumerate(counts) if c[0]]
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(at), pa.string()), pa.array(at, pa.int32()), *(pa.array([counts[i][k] for i in at], pa.int64()) for k in (0, 1))], ["host", "node", "pages", "hits"])
            found.clear()

        for batch, find in given:
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(url)
                if host not in found:
                    if (row := find(host)) is None:
                        continue
                    template = loads(row["template"])
                    nodes = list(preorder(template))
                    for i, t in enumerate(nodes):
                        t.append(i)
                    found[host] = template, [[0, 0] for _ in nodes]
                tally(_shape(parse(html)), *found[host])
            if len(found) > HOSTS:
                yield from out()
        yield from out()

    counted = _aside(pages.select("url", "html"), templates, run, "host string, node int, pages bigint, hits bigint").groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("hits").alias("hits"))
    most = counted.where((F.col("pages") >= LEAST_PAGES) & (F.col("hits") * 2 > F.col("pages"))).groupBy("host").agg(F.collect_list("node").alias("constants"))
    return templates.join(most, "host", "left")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    from quern.llm import textkernel as tk

    tk.modest_batches(pages)
    given = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    distinct = originals(given)
    templates = tk.cut(induce(distinct), "templates")

    def run(given) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list | None] = {}
        for batch, find in given:
            texts = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                host = host_of(url)
                if host not in parsed:
                    if len(parsed) > 1000:
                        parsed.clear()
                    row = find(host)
                    parsed[host] = settled(loads(row["template"]), row["constants"] or []) if row else None
                texts.append(extract(html, parsed[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return _aside(given, tk.cut(constants(distinct, templates), "constants"), run, "id bigint, url string, text string, n_chars bigint")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")

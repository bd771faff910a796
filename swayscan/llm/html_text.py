"""Main text of web pages by wrapper induction."""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayscan.llm.tables import written

GROUP = 32  # layouts, or templates of such groups, that one task aligns at a time
DEPTH = 40  # levels of a page that are aligned; what lies deeper belongs to the node at that level
WIDTH = 80  # different children of a node that are aligned
MAIN_SHARE = 0.7  # of the varying words that a node must hold to be entered on the way to the main slot
CONSTANT = 3  # pages in which a small text must be the same to be template
MOST = 0.9  # of the words that are not left out otherwise: a form or named part that holds so many is the page itself

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "tfoot thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"body", "html", "head", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
_SCOPE = frozenset(("html", "body", "table", "td", "th", "article", "section", "div", "main", "aside", "nav", "ul", "ol", "dl"))
#: An opening tag ends these if one is open in the same scope.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_DROPPED = frozenset(
    "nav footer aside form button input select textarea script style noscript iframe svg head dialog menu template object "
    "canvas audio video label option title xmp search".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notification alert newsletter subscribe subscription signup login share sharing social sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond disqus related "
    "recommended popup modal overlay widget toolbar pagination pager skip toc".split()
)
#: What may stand beside these words in one class name; "no-sidebar" or "elementor-widget" names no such part.
_PLACES = frozenset(
    "top bottom left right upper lower site page main global primary secondary mobile desktop area bar block box button buttons "
    "container content form group holder inner item items link links list outer panel post posts article articles row section "
    "text title wrap wrapper icons".split()
)
_LANDMARKS = frozenset(("h1", "article", "main"))
_MAIN = frozenset("article main content post entry story body".split())
_KEPT = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt figcaption".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_SPLIT = re.compile(r"[^a-z]+")


def hinted(names: str) -> bool:
    """True if a class or id is a hint word, or made of hint words and words of place alone."""
    for name in names.split():
        parts = list(filter(None, _SPLIT.split(name)))
        if not _HINTS.isdisjoint(parts) and all(p in _HINTS or p in _PLACES for p in parts):
            return True
    return False


class Node:
    __slots__ = ("tag", "hints", "children", "dropped", "unsure")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.hints, self.dropped = (), tag in _DROPPED
        self.unsure = tag == "form"  # dropped, unless it proves to hold the page
        if attributes and not attributes.isspace():
            named = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
            names = f"{named.get('class', '')} {named.get('id', '')}"
            words = _SPLIT.split(names)
            self.hints = tuple(sorted(set(filter(None, words))))
            hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
            body = tag in ("html", "body", "article", "main")
            by_name = not body and (named.get("role") in _ROLES or hinted(names))
            self.unsure = not (hidden and not body) and (self.unsure or (by_name and not self.dropped))
            self.dropped |= by_name or (hidden and not body)


def parse(page: str) -> Node:
    """A tree of a page's elements and decoded texts; tags left open are closed where HTML closes them."""
    root = Node("html")
    stack, at, size, last = [root], 0, len(page), page.rfind(">")

    def close_until(tags, scope) -> None:
        for n in range(len(stack) - 1, 0, -1):
            if stack[n].tag in tags:
                del stack[n:]
                return
            if stack[n].tag in scope:
                return

    def text(value: str) -> None:
        if value:
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    while at < size:
        lt = page.find("<", at)
        if lt < 0 or (lt > last and not page.startswith("<!--", lt)):  # no further tag
            text(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                text(page[at:lt])
                end = page.find("-->", lt + 2)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), lt):
                text(page[at:lt])
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:  # no tag
                text(page[at : lt + 1])
                at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if closing:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    del stack[n:]
                    break
                if tag == "p" and stack[n].tag in _SCOPE:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES_P:
            close_until({"p"}, _SCOPE)
            if stack[-1].tag == "head":
                stack.pop()
        if tag in _ENDS:
            close_until(*_ENDS[tag])
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = size if end is None else (page.find(">", end.start()) + 1 or size)
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.append(node)
    return root


def _has_title(node: Node) -> bool:
    stack = [node]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, Node):
                if child.tag == "h1":
                    return True
                stack.append(child)
    return False


def left_out(node: Node) -> bool:
    """True for menus, notices and the like; a header that holds the title is none."""
    if node.tag == "header":
        return not _has_title(node)
    if node.dropped and node.tag not in _DROPPED and set(node.hints) & _HINTS == {"header"}:
        return not _has_title(node)
    return node.dropped


def _spare(root: Node, every: bool = False) -> None:
    """Keep forms and parts dropped by name that hold the page: all its titles, articles and main elements with half
    of the words not left out otherwise, or if it has none ``MOST`` of those words. With ``every``, keep all of them.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if not node.dropped or node.unsure:
            stack += [c for c in node.children if isinstance(c, Node)]
    if not any(n.dropped for n in order):
        return
    found: dict[int, tuple[int, int, int]] = {}  # of a node: landmarks, all words, words if what is dropped goes
    for node in reversed(order):
        marks, words, kept = int(node.tag in _LANDMARKS), 0, 0
        if not node.dropped or node.unsure:
            for child in node.children:
                if isinstance(child, str):
                    n = len(child.split())
                    words, kept = words + n, kept + n
                else:
                    a, b, c = found[id(child)]
                    marks, words, kept = marks + a, words + b, kept + c * (not child.dropped)
        found[id(node)] = marks, words, kept
    marks = found[id(root)][0]
    stack = [(root, 0)]  # a node, and the words kept outside it
    while stack:
        node, outside = stack.pop()
        if node.dropped and not every:
            own = found[id(node)]
            least = (0.5 if own[0] == marks else 1.1) if marks else MOST
            if not node.unsure or own[1] < least * (own[1] + outside):
                continue
        if node.unsure:
            node.dropped = False
        held = found[id(node)][2]
        for child in node.children:
            if isinstance(child, Node) and (not child.dropped or child.unsure):
                stack.append((child, outside + held - found[id(child)][2] * (not child.dropped)))


class Skeleton:
    """A level of a page for alignment: siblings that look alike are one repeated node."""

    __slots__ = ("label", "nodes", "children", "text", "words")

    def __init__(self, label: str, nodes: list[Node], depth: int = 0):
        self.label, self.nodes, self.children = label, nodes, []
        parts, groups = [], {}
        for node in nodes:
            for child in node.children:
                if isinstance(child, str):
                    parts.append(child)
                elif left_out(child):
                    continue
                elif depth >= DEPTH or (child.tag not in _BLOCK and child.tag not in ("td", "th")):
                    parts.extend(_texts(child))
                else:
                    look = " ".join((child.tag, *child.hints))
                    if look not in groups and len(groups) >= WIDTH:
                        look = child.tag  # beyond that, siblings of a tag are one
                    groups.setdefault(look, []).append(child)
        self.text = " ".join("".join(parts).split())
        self.children = [Skeleton(look, group, depth + 1) for look, group in groups.items()]
        self.words = self.text.count(" ") + bool(self.text) + sum(c.words for c in self.children)


def _texts(node: Node) -> Iterator[str]:
    """Text below an inline node, in order."""
    stack = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            yield item
        elif item.tag in ("br", "td", "th") or item.tag in _BLOCK:
            yield " "
            stack.extend([" ", *reversed(item.children)])
        elif not left_out(item):
            stack.extend(reversed(item.children))


def align(a, b) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two trees with ``label`` and ``children``: most matched nodes, and matched children.

    Roots must have one label; children match in order, each pair counting its own best match.
    """
    if a.label != b.label:
        return 0, []
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    worth = {}
    for i, x in enumerate(a.children, 1):
        row, above = best[i], best[i - 1]
        for j, y in enumerate(b.children, 1):
            w = align(x, y)[0] if x.label == y.label else 0
            worth[i, j] = w
            row[j] = max(above[j], row[j - 1], above[j - 1] + w)
    pairs, i, j = [], m, n
    while i and j:
        if worth[i, j] and best[i][j] == best[i - 1][j - 1] + worth[i, j]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[m][n] + 1, pairs[::-1]


class Wrapper:
    """A node of a host's template: how many pages have it, its text while constant, and the words that vary."""

    __slots__ = ("label", "children", "pages", "text", "words", "varying")

    def __init__(self, label: str, children: list[Wrapper], pages: int, text: str | None, words: int):
        self.label, self.children, self.pages, self.text, self.words = label, children, pages, text, words

    @classmethod
    def of(cls, page: Skeleton) -> Wrapper:
        own = page.words - sum(c.words for c in page.children)
        return cls(page.label, [cls.of(c) for c in page.children], 1, mark(page.text), own)

    @classmethod
    def read(cls, full: list) -> Wrapper:
        label, pages, text, words, children = full
        return cls(label, [cls.read(c) for c in children], pages, text, words)

    def full(self) -> list:
        """All of it, as lists for JSON."""
        return [self.label, self.pages, self.text, self.words, [c.full() for c in self.children]]

    def merge(self, other: Wrapper) -> None:
        """Align the template of further pages; what it adds becomes an optional node."""
        self.pages += other.pages
        self.words += other.words
        if self.text != other.text:
            self.text = None
        matched = dict((j, i) for i, j in align(self, other)[1])
        children, used = [], 0
        for j, child in enumerate(other.children):
            if j in matched:
                children += self.children[used : matched[j] + 1]
                self.children[matched[j]].merge(child)
                used = matched[j] + 1
            else:
                children.append(child)
        self.children = children + self.children[used:]

    def constant(self) -> bool:
        return self.text is not None and self.pages >= CONSTANT

    def mass(self) -> float:
        """Words of the slots: text that is the same in all of several pages is template."""
        self.varying = (0 if self.constant() else self.words) + sum(c.mass() for c in self.children)
        return self.varying

    def main(self) -> list[int]:
        """Way to the main slot, as child numbers: into an article or main element, else where most words vary."""
        total = self.mass()
        way, node = [], self
        named = [
            (c.varying, -len(w), w)
            for c, w in self._below()
            if c.label.split()[0] in ("article", "main") and c.varying > 0.3 * total
        ]
        articles = [x for x in named if self._at(x[2]).label.split()[0] == "article"]
        if named:
            return max(articles or named)[2]
        while node.children:
            best = max(range(len(node.children)), key=lambda i: node.children[i].varying)
            into = node.children[best]
            if into.varying < MAIN_SHARE * node.varying or into.label.split()[0] in _KEPT:
                break
            way.append(best)
            node = into
            if not _MAIN.isdisjoint(node.label.split()[1:]):
                break
        return way

    def _below(self) -> Iterator[tuple[Wrapper, list[int]]]:
        stack = [(self, [])]
        while stack:
            node, way = stack.pop()
            yield node, way
            stack += [(c, [*way, i]) for i, c in enumerate(node.children)]

    def _at(self, way: list[int]) -> Wrapper:
        node = self
        for i in way:
            node = node.children[i]
        return node

    def plain(self, way: list[int] | None) -> tuple[list, list[int]]:
        """What a page needs of the template, as lists for JSON, and the way in it to the node at ``way``.

        Nodes on the way stay, and those that hold constant text outside paragraphs or lead to some.
        """
        keep = self.constant() and self.label.split()[0] not in _KEPT and self.text
        children, path = [], []
        for n, child in enumerate(self.children):
            on_way = bool(way) and n == way[0]
            plain, below = child.plain(way[1:] if on_way else None)
            if on_way:
                path = [len(children), *below]
            if on_way or plain[1] or plain[2]:
                children.append(plain)
        return [self.label, children, self.text if keep else ""], path


class _Known:
    """A template read back from JSON."""

    __slots__ = ("label", "children", "text")

    def __init__(self, plain: list):
        self.label, self.text = plain[0], plain[2]
        self.children = [_Known(c) for c in plain[1]]


@lru_cache(maxsize=512)
def _load(template: str) -> tuple[_Known, list[int]]:
    plain, way = json.loads(template)
    return _Known(plain), way


def mark(text: str) -> str:
    """What stands for a text in templates: a digest, empty for no text."""
    return text and base64.b64encode(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).digest()).decode()


def template_of(page: str) -> Wrapper:
    """The template of one page."""
    root = parse(page)
    _spare(root)
    return Wrapper.of(Skeleton("html", [root]))


def merged(templates: list[Wrapper]) -> Wrapper:
    """One template of several, the first one the frame that the others are aligned with."""
    first, *others = templates
    for other in others:
        first.merge(other)
    return first


def for_pages(wrapper: Wrapper) -> str:
    """A host's template and the way to its main slot, as JSON that pages are read with."""
    return json.dumps(wrapper.plain(wrapper.main()))


def induce(pages: list[str]) -> str:
    """The template of one host from its pages, with the way to the main slot, as JSON."""
    return for_pages(merged([template_of(page) for page in pages]))


def layout(wrapper: Wrapper) -> tuple[str, list[str], list[int]]:
    """The labels of a page's template as JSON, and the texts and words of its nodes in the order of these labels."""
    texts, words = [], []

    def labels(node: Wrapper) -> list:
        texts.append(node.text)
        words.append(node.words)
        return [node.label, [labels(c) for c in node.children]]

    return json.dumps(labels(wrapper)), texts, words


def filled(labels: str, pages: int, nodes: Iterator[tuple[str | None, int]]) -> Wrapper:
    """The template of all pages of one layout."""

    def node(label: str, children: list) -> Wrapper:
        text, words = next(nodes)
        return Wrapper(label, [node(*c) for c in children], pages, text, words)

    return node(*json.loads(labels))


def _blocks(nodes: list[Node], skip: dict[int, str]) -> Iterator[str]:
    """Texts of blocks in page order; ``skip`` has the template texts of nodes that hold one."""
    for top in nodes:
        parts: list[str] = []
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                block = " ".join("".join(parts).split())
                parts = []
                if block:
                    yield block
            elif isinstance(item, str):
                parts.append(item)
            elif item is not top and left_out(item):
                continue
            elif item.tag in ("br", "td", "th"):
                parts.append(" ")
                stack.extend([" ", *reversed(item.children)])
            else:
                children = item.children
                if id(item) in skip:
                    children = [c for c in children if not isinstance(c, str)]
                block = item.tag in _BLOCK
                if block:
                    stack += [None, *reversed(children), None]
                else:
                    stack += reversed(children)
        block = " ".join("".join(parts).split())
        if block:
            yield block


def extract(page: str, template: str | None = None) -> str:
    """Main text of a page: the content of the template's main slot, block by block.

    Where that is empty, the page is cut by itself, and at last with forms and parts dropped by name.
    """
    root = parse(page)
    _spare(root)
    text = _extract(root, template)
    if not text:
        text = _extract(root, None)
    if not text:
        _spare(root, every=True)
        text = _extract(root, None)
    return text


def _extract(root: Node, template: str | None) -> str:
    skeleton = Skeleton("html", [root])
    for known, way in ([_load(template)] if template else []):
        node, mine, skip = known, skeleton, {}
        stack = [(known, skeleton)]
        while stack:
            a, b = stack.pop()
            if a.text and a.text == mark(b.text):
                skip |= {id(n): a.text for n in b.nodes}
            stack += [(a.children[i], b.children[j]) for i, j in align(a, b)[1]]
        for step in way:
            pair = dict(align(node, mine)[1]).get(step) if mine else None
            node, mine = node.children[step], None if pair is None else mine.children[pair]
        if mine and mine.words:
            return "\n".join(_blocks(mine.nodes, skip))
    own = Wrapper.of(skeleton)
    for step in own.main():
        skeleton = skeleton.children[step]
    return "\n".join(_blocks(skeleton.nodes, {}))


def _layouts(source: DataFrame) -> DataFrame:
    """``(host, shape, pages, labels, nodes)``: every layout of a host's different pages, with sums over all of these.

    ``nodes`` has the words of each node, and its text where that is the same in all pages of the layout.
    """

    def shapes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [layout(template_of(page)) for page in batch.column(2).to_pylist()]
            labels, texts, words = (list(column) for column in zip(*found)) if found else ([], [], [])
            arrays = [batch.column(0), batch.column(1), pa.array(labels, pa.string()),
                      pa.array(texts, pa.list_(pa.string())), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "h", "labels", "texts", "words"])

    read = source.filter("html <> ''").select("host", F.xxhash64("html").alias("h"), "html")
    read = read.mapInArrow(shapes, "host string, h long, labels string, texts array<string>, words array<long>")
    shape = F.unhex(F.sha2("labels", 256)).alias("shape")
    # Equal pages count once; they are all alike, so any one of them will do.
    pages = written(read.groupBy("host", "h").agg(*(F.first(c).alias(c) for c in ("labels", "texts", "words"))).select("*", shape))
    names = pages.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.first("labels").alias("labels"))
    each = pages.select("host", "shape", F.posexplode(F.arrays_zip("texts", "words")).alias("at", "node"))
    sums = each.groupBy("host", "shape", "at").agg(
        F.sum("node.words").alias("words"), F.min("node.texts").alias("least"), F.max("node.texts").alias("most")
    )
    text = F.when(F.col("least") == F.col("most"), F.col("least")).alias("text")
    nodes = sums.groupBy("host", "shape").agg(F.array_sort(F.collect_list(F.struct("at", text, "words"))).alias("nodes"))
    return names.join(nodes, ["host", "shape"])


def templates(source: DataFrame) -> DataFrame:
    """``(host, template)`` from all different pages ``(host, html)`` of each host.

    Pages of one layout, that is with the same tree of elements, are summed up by Spark. Layouts are aligned by simple
    tree matching in groups of about ``GROUP``, then the templates of the groups in the same way, until a host has one.
    """
    hosts = "host string, bucket long, pages long, template string"

    def first(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(group.itertuples(), key=lambda r: (-r.pages, r.labels))
        one = merged([filled(r.labels, r.pages, iter([(n["text"], n["words"]) for n in r.nodes])) for r in rows])
        return pd.DataFrame([(*key, one.pages, json.dumps(one.full()))], columns=["host", "bucket", "pages", "template"])

    def further(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(group.itertuples(), key=lambda r: (-r.pages, r.template))
        one = merged([Wrapper.read(json.loads(r.template)) for r in rows])
        return pd.DataFrame([(*key, one.pages, json.dumps(one.full()))], columns=["host", "bucket", "pages", "template"])

    def last(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            done = [for_pages(Wrapper.read(json.loads(t))) for t in batch["template"]]
            yield pd.DataFrame({"host": batch["host"], "template": pd.Series(done, dtype=object)})

    layouts = written(_layouts(source))
    counts = layouts.groupBy("host").agg(F.count("*").alias("n"))
    buckets = F.ceil(F.col("n") / GROUP)
    left = counts.agg(F.max(buckets)).first()[0] or 1
    dealt = layouts.join(counts.select("host", buckets.alias("buckets")), "host")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("shape"), "buckets")).drop("shape", "buckets", "n")
    found = dealt.groupBy("host", "bucket").applyInPandas(first, hosts)
    while left > 1:
        found = found.withColumn("bucket", F.floor(F.col("bucket") / GROUP)).groupBy("host", "bucket").applyInPandas(further, hosts)
        left = -(-left // GROUP)
    return written(found.select("host", "template").mapInPandas(last, "host string, template string"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` for every row of ``pages``: the article, its blocks joined by line feeds.

    For each host all its different pages are aligned by simple tree matching, layout by layout (``templates``).
    What all of several pages share is template, what differs is a slot; the slot with the varying words is the main
    one, and menus, notices, forms, adverts and comments are left out by their elements, roles and names. Every page
    is then aligned with its host's template. Pages whose host has no template, or that do not fit it, are cut by the
    same rules from themselves alone. Null html counts as empty and gives an empty text; pages without a valid host
    share the empty host; repeated rows repeat.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    source = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")
    ).withColumn("host", F.coalesce(host, F.lit("")))
    wrappers = templates(source)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [extract(page, template) for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    fields = source.join(wrappers, "host", "left").select("id", "url", "html", "template")
    kind = source.schema["id"].dataType.simpleString()
    return fields.mapInArrow(batches, f"id {kind}, url string, text string")

"""Main text of web pages: site templates by subtree counts per host, and what else is no article."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.scratch import materialize
from sievewright.llm.texts import slices

#: A subtree is a template if so many distinct articles of its host have it, and either so many more than its spread over all
#: hosts explains (a log likelihood ratio of 20.7 is one chance in a thousand million), or this share of all articles.
TEMPLATE_PAGES, EXCESS, TEMPLATE_SHARE = 5, 20.7, 0.5
#: Templates up to so many go to the tasks as a whole (some 30 MB there at most); more are joined to their pages.
BROADCAST_ROWS = 200_000

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
RAW = "script|style|textarea|title|noscript|template|iframe|svg|math|object|select|canvas|video|audio"
DROPPED = frozenset("nav footer aside form button menu dialog fieldset".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words of a class or id that tell what an element is. An element is judged by such a name if the whole name is made
#: of these words and the neutral ones; otherwise, or by a hint, only if it is made mostly of links.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead topbar cookie cookies consent gdpr notice notification newsletter subscribe subscription signup login search share sharing social "
    "comment comments respond disqus reply replies popup modal overlay pagination pager skip".split()
)
HINTS = frozenset("header aside widget alert related recommended tags toc links more top read next prev previous".split())
NEUTRAL = frozenset("box bar block list item items inner outer wrap wrapper container content body section area panel form text main left right bottom site page global js id the form button buttons icon icons thread count title user reader readers".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("attrs", "chars", "children", "digest", "links", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children, self.digest, self.chars, self.links = tag, attrs, [], b"", 0, 0


def parse(source: str) -> Node:
    """A tree of elements and texts; end tags that are missing or too many are put up with, as is a last tag without its end."""
    root = Node("#root")
    stack, at = [root], 0
    opened: Counter[str] = Counter()

    def shut(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    end, cut = source.rfind(">") + 1, False
    for m in TOKEN.finditer(source, 0, end):
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            cut = m["raw"] is not None and not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I) or m[0].startswith("<!--") and not m[0].endswith("-->")
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    shut(k)
                    break
                # an inline end tag closes nothing outside of its block
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = {"p"} if tag in CLOSES_P else {"td", "th", "tr"} if tag == "tr" else {"td", "th"} if tag in ("td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else {tag}
            for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                if stack[k].tag in ends:
                    shut(k)
                    if tag != "tr":
                        break
                elif stack[k].tag not in INLINE and stack[k].tag != "p":
                    break
        node = Node(tag, m["attrs"].rstrip("/"))
        stack[-1].children.append(node)
        if tag not in VOID and not m["attrs"].endswith("/") or tag in INLINE:
            stack.append(node)
            opened[tag] += 1
    if not cut:
        rest = re.split(r"</?[a-zA-Z!?]", source[at:], maxsplit=1)[0]
        if rest:
            stack[-1].children.append(rest)
    return root


def measure(root: Node) -> None:
    """Bottom-up: the characters of each element and those in links, and the hash of its tags, class names and texts."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in x.children if not isinstance(c, str))
    for x in reversed(order):
        named = re.search(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", x.attrs, re.I) if x.attrs else None
        h = hashlib.blake2b(f"{x.tag} {' '.join(sorted((named[1] or named[2] or named[3] or '').split())) if named else ''}>".encode("utf-8", "replace"), digest_size=8)
        for c in x.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                x.chars += len(words)
                h.update(words.encode("utf-8", "replace"))
            else:
                x.chars += c.chars
                x.links += c.links
                h.update(c.digest)
        if x.tag == "a":
            x.links = x.chars
        x.digest = h.digest()


def dropped(node: Node, inside: bool) -> bool:
    """Whether an element is no part of an article by its tag, role, class or id. ``inside``: it lies in one."""
    if node.tag in DROPPED or node.tag == "header" and not inside or node.tag == "head":
        return True
    if not node.attrs or node.tag in ("body", "html", "main"):
        return False
    for m in ATTRIBUTE.finditer(node.attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and node.tag not in INLINE:
            for token in value.split():
                words = [w for w in re.split(r"[^a-z]+", token) if w]
                some = NAMES.intersection(words)
                if some and all(w in NAMES or w in HINTS or w in NEUTRAL for w in words):
                    return True
                if some or HINTS.intersection(words):
                    if not node.digest:
                        measure(node)
                    if 2 * node.links > node.chars:
                        return True
    return False


def main_nodes(root: Node) -> list[Node]:
    """The articles of a page, outermost, without those that are comments or the like; else its main elements; else the page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag != "#root" and dropped(node, False):
            continue
        if node.tag in found:
            found[node.tag].append(node)
            if node.tag == "article":
                continue
        todo.extend(x for x in reversed(node.children) if not isinstance(x, str))
    mains, within = [], set()
    for node in found["main"]:
        if id(node) not in within:
            mains.append(node)
            todo = [node]
            while todo:
                x = todo.pop()
                within.add(id(x))
                todo.extend(c for c in x.children if not isinstance(c, str))
    return found["article"] or mains or [root]


def blocks(root: Node) -> Iterator[Node]:
    """Every block of a page's main elements, they themselves left out: what may be a template of its site."""
    measure(root)
    for top in main_nodes(root):
        inside = top.tag in ("article", "main")
        todo = [c for c in top.children if not isinstance(c, str)]
        while todo:
            x = todo.pop()
            if x.tag in INLINE or x.tag in VOID or dropped(x, inside):
                continue
            if x.chars and x.tag not in ("html", "body"):
                yield x
            todo.extend(c for c in x.children if not isinstance(c, str))


def text_of(root: Node, templates: frozenset[bytes] = frozenset()) -> str:
    """Text of a page's main elements without what is dropped: references decoded, blanks made one, blocks joined by a space."""
    out: list[str] = []
    if templates and not root.digest:
        measure(root)
    for top in main_nodes(root):
        inside = top.tag in ("article", "main")
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(html.unescape(x) if "&" in x else x)
                continue
            if x is not top and (dropped(x, inside) or x.digest in templates and x.tag not in INLINE):
                out.append(" ")
                continue
            if x.tag not in INLINE and x.tag != "wbr":
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.children))
    return " ".join("".join(out).split())


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each page, and a row without one that counts the page itself; an article is known by its text."""
    for batch in slices(batches, "html"):
        size, article, subtree = [], [], []
        for source in batch.column("html").to_pylist():
            root = parse(source or "")
            own = {int.from_bytes(x.digest, "little", signed=True) for x in blocks(root)}
            text = hashlib.blake2b(text_of(root).encode("utf-8", "replace"), digest_size=8).digest()
            subtree.extend([None, *own])
            size.append(len(own) + 1)
            article.append(int.from_bytes(text, "little", signed=True))
        at = np.repeat(np.arange(batch.num_rows), size)
        yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(at)), batch.column("version").take(pa.array(at)), pa.array(np.array(article, np.int64)[at]), pa.array(subtree, pa.int64())], ["host", "version", "article", "subtree"])


def _texts(known: Broadcast | None):
    """Page texts; the templates come from a broadcast by host, or with each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = known.value if known else {}
        for batch in slices(batches, "html"):
            texts = []
            own = [by_host.get(h, frozenset()) for h in batch.column("host").to_pylist()] if known else [frozenset(x.to_bytes(8, "little", signed=True) for x in cut or ()) for cut in batch.column("templates").to_pylist()]
            for source, cut in zip(batch.column("html").to_pylist(), own):
                texts.append(text_of(parse(source or ""), cut).encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


SUBTREES = "host string, version bigint, article bigint, subtree bigint"


def templates(pages: DataFrame) -> DataFrame:
    """``pages(host, version, html)`` -> ``host, subtree``: what recurs in many distinct articles of one host and is not their prose.

    A passage that articles share is spread over the hosts as the articles are; a template is not. So a subtree
    is one if its count on the host is beyond chance, given its count over all hosts and the host's share of all
    articles; or, where that cannot tell (one host, or a notice that all sites carry), if half of all articles and of
    the host's have it. Copies of an article are one article.
    """
    # each row stands for one distinct (host, article, subtree); partial counts leave the tasks
    seen = pages.select("host", "version", "html").mapInArrow(_subtrees, SUBTREES).select("host", "article", "subtree").distinct()
    counts = materialize(seen.groupBy("host", "subtree").agg(F.count("*").alias("on")))
    articles = counts.where("subtree is null").select("host", F.col("on").alias("own"))
    every = articles.agg(F.coalesce(F.sum("own"), F.lit(0)).cast("double").alias("every"))
    # only subtrees that are frequent somewhere are counted over all hosts
    often = counts.where((F.col("on") >= TEMPLATE_PAGES) & F.col("subtree").isNotNull())
    spread = counts.join(often.select("subtree").distinct(), "subtree").groupBy("subtree").agg(F.sum("on").alias("total"))
    judged = often.join(spread, "subtree").join(articles, "host").join(F.broadcast(every))  # one row
    here, chance = F.col("on") / F.col("total"), F.col("own") / F.col("every")
    rest = F.col("total") - F.col("on")
    ratio = F.col("on") * F.log(here / chance) + F.when(rest > 0, rest * F.log((1 - here) / (1 - chance))).otherwise(0.0)
    beyond = (here > chance) & (ratio >= EXCESS)
    everywhere = (F.col("on") >= TEMPLATE_SHARE * F.col("own")) & (F.col("total") >= TEMPLATE_SHARE * F.col("every"))
    return judged.where(beyond | everywhere).select("host", "subtree")


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``page_id, url, text, n_chars``, one row per page.

    Element subtrees are hashed bottom-up (tags, class names, texts) and counted per host over distinct articles in
    Spark; those that are the site's template (see :func:`templates`) are deleted. Tags and roles that are no prose by
    definition go first, and class names say so only where the whole name does. The text is that of the page's articles,
    else of its main elements, else of what is left of the page.

    Defined cases: null and empty html give an empty text; a null or odd url counts as a host of its own, the
    empty one; copies of an article count once towards a template and give equal texts; nesting of any depth, tags
    without end and pages of any length are read in one pass; an empty table gives no rows; extra columns are ignored.
    """
    own = pages.select("page_id", "url", "html", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))).alias("host"), F.xxhash64("html").alias("version"))
    found = materialize(templates(own))
    out = "page_id bigint, url string, text string, n_chars bigint"
    if found.count() <= BROADCAST_ROWS:
        by_host: dict[str, set] = {}
        for host, subtree in found.collect():
            by_host.setdefault(host, set()).add(subtree.to_bytes(8, "little", signed=True))
        return own.select("page_id", "url", "html", "host").mapInArrow(_texts(pages.sparkSession.sparkContext.broadcast(by_host)), out)
    # more templates than a task should hold: each page gets those of its own blocks
    held = own.select("host", "version", "html").mapInArrow(_subtrees, SUBTREES).select("host", "version", "subtree").distinct()
    cuts = held.join(found, ["host", "subtree"]).groupBy("host", "version").agg(F.collect_set("subtree").alias("templates"))
    return own.join(cuts, ["host", "version"], "left").select("page_id", "url", "html", "templates").mapInArrow(_texts(None), out)

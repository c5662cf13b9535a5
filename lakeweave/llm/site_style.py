"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: a node is a chain of element labels (tag and class) below the
root, and holds how often each child sequence (presentation) and each text (content) occurs there. A node's importance
joins the normalised entropies of both over the pages of the host that have it: what always looks and reads alike is
site furniture. What its own markup declares (menus, notices, adverts, forms and the like) is a prior: the importance of
such a node is its entropy, which is at most 1, times DECLARED, and so below LOW on any host; that is all there is to go
by on hosts of few pages, whose entropies count as 1, or where furniture differs from page to page. Branches of low
importance are removed from each page. Copies of a page count once, so that a host of copies tells
nothing about what is furniture. A low branch loses only what stands outside the articles and main elements in it; an
article or main that is low itself is kept whole but for furniture declared in it.

A tree exists only as rows (page, node, kind, value), made distinct and counted with pre-aggregation in the tasks, so a host of any size is no
group anywhere; only the list of a host's low nodes meets its pages, in a join.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import written

LEAST_PAGES = 5
LOW = 0.15
PRESENTATION_WEIGHT = 0.3
DECLARED = 0.1  # the prior of an element that declares itself furniture; others have 1, and importance is prior x entropy

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"option", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
HIDES_P = frozenset("button table td th".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "main", "body", "div", "nav"}
FURNITURE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea dialog menu object audio video canvas title".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion login menu modal nav navbar navigation newsletter notice pagination popup promo related recommended reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
OUTER_NAMES = frozenset("header footer masthead topbar".split())
MASK = (1 << 63) - 1


def furniture(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element declares itself to be no main text: its importance, at most DECLARED, is low on any host."""
    if tag in FURNITURE_TAGS or tag == "header" and not in_article:
        return True
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            words = set(re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower()))
            if words & (FURNITURE_ROLES if m[1].lower() == "role" else FURNITURE_NAMES if in_article else FURNITURE_NAMES | OUTER_NAMES):
                if tag not in ("html", "body", "article", "main") or words & {"comment", "comments", "reply", "related", "sponsored", "ad", "advert"}:
                    return True
    return False


def label(tag: str, attributes: str) -> int:
    names = sorted((m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes) if m[1].lower() != "id") if attributes else ()
    return zlib.crc32(" ".join((tag, *names)).encode())


class Element:
    __slots__ = ("tag", "node", "furniture", "article", "main", "children", "content", "low", "whole", "open_p")

    def __init__(self, tag, node, is_furniture, article, main, open_p):
        self.tag, self.node, self.furniture, self.article, self.main, self.open_p = tag, node, is_furniture, article, main, open_p
        self.children = self.content = 0
        self.low = self.whole = False


def walk(source: str) -> Iterator[tuple[str, object, list[Element]]]:
    """Events of a page: ("open" | "close", element, stack) and ("text", text, stack). Tolerates whatever is cut off or left open."""
    root = Element("", 7, False, False, False, 0)
    stack, at, size = [root], 0, len(source)
    opened: Counter[str] = Counter()  # how many elements of a tag are open, so that a search down the stack finds one

    def close(k):
        while len(stack) > k:
            e = stack[-1]
            yield "close", e, stack
            stack.pop()
            opened[e.tag] -= 1
            up = stack[-1]
            up.content = (up.content * 31 + e.content) & MASK

    while at < size:
        k = source.find("<", at)
        if k != at:
            yield "text", source[at : k if k >= 0 else size], stack
            if k < 0:
                break
        m = TOKEN.match(source, k)
        if m is None:
            end = source.find("<", k + 1)
            if not re.match(r"</?[a-zA-Z]", source[k : k + 3]):
                yield "text", source[k : end if end >= 0 else size], stack
            elif end < 0:
                break
            at = end if end >= 0 else size
            continue
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    yield from close(k)
                    break
            continue
        if tag in CLOSES_P and stack[-1].open_p:
            yield from close(stack[-1].open_p)
        if tag in ENDED_BY and any(opened[x] for x in ENDED_BY[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDED_BY[tag]:
                    yield from close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        up = stack[-1]
        own = label(tag, m[3])
        up.children = (up.children * 1000003 + own) & MASK
        e = Element(tag, (up.node * 1000003 ^ own) & MASK, up.furniture or furniture(tag, m[3], up.article), up.article or tag == "article", up.main or tag == "main", len(stack) if tag == "p" else 0 if tag in HIDES_P else up.open_p)
        stack.append(e)
        opened[tag] += 1
        yield "open", e, stack
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(source, at)
            at = end.start() if end else size
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            yield from close(len(stack) - 1)
    yield from close(1)


def nodes(source: str) -> tuple[int, dict[int, tuple[int, int]]]:
    """A hash of a page's text outside declared furniture, and its style nodes: of each its children's labels and its text, as hashes over all its elements."""
    out: dict[int, tuple[int, int]] = {}
    page = 0
    for event, what, stack in walk(source):
        if event == "text":
            words = what.split()
            if words:
                own = zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass"))
                stack[-1].content = (stack[-1].content * 31 + own) & MASK
                if not stack[-1].furniture:
                    page = (page * 1000003 + own) & MASK
        elif event == "close" and not what.furniture:
            a, b = out.get(what.node, (0, 0))
            out[what.node] = ((a * 31 + what.children) & MASK, (b * 31 + what.content) & MASK)
    return page, out


def prune(e: Element, up: Element, low: frozenset[int]) -> None:
    """Marks an element just opened as of low importance: no html, body, article or main, and within these last two, unless they are low themselves, blocks only."""
    if e.tag in ("article", "main"):
        e.whole = up.whole or e.node in low
    elif e.tag not in ("html", "body"):
        e.whole = up.whole
        e.low = up.low or e.node in low and not e.whole and (e.tag in BLOCK or not (e.article or e.main))


def main_text(source: str | None, low: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's main text, one a line.

    Blocks in main and article elements are the main text; with articles alone and more text outside them than in
    them, these are teasers, and all blocks are.
    """
    found: list[tuple[str, str]] = []
    parts: list[str] = []
    place = "rest"

    def flush():
        block = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if block:
            found.append((place, block))

    for event, what, stack in walk(source or ""):
        top = stack[-1]
        if event == "text":
            here = "main" if top.main else "article" if top.article else "rest"
            if here != place:
                flush()
                place = here
            if not (top.furniture or top.low):
                parts.append(what)
        elif event == "open":
            prune(what, stack[-2], low)
        if event != "text":
            if what.tag in BLOCK or (what.furniture or what.low) and what.tag not in VOID:
                flush()
            elif what.tag == "br":
                parts.append(" ")
    flush()
    size = Counter()
    for where, block in found:
        size[where] += len(block)
    inner = size["main"] or size["article"] >= size["rest"]
    return "\n".join(block for where, block in found if where != "rest" or not inner)


def host(url: str = "url"):
    """The host of a URL column, lower case; of none, the empty text."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def low_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """(host, nodes): the style nodes of low importance of each host, by its pages of distinct text. pages has host and html."""

    def run(batches):
        for batch in batches:
            hosts, ids, keys, kinds, values = [], [], [], [], []
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, found = nodes(source or "")
                for node, pair in found.items():
                    hosts += [name, name]
                    ids += [page, page]
                    keys += [node, node]
                    kinds += [0, 1]
                    values += pair
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(kinds, pa.int8()), pa.array(values, pa.int64())], names=["host", "page", "node", "kind", "value"])

    rows = pages.select("host", "html").mapInArrow(run, "host string, page long, node long, kind byte, value long").distinct()
    counts = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    entropy = counts.groupBy("host", "node", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("s")).withColumn("e", F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0))
    weight = F.when(F.col("kind") == 0, PRESENTATION_WEIGHT).otherwise(1 - PRESENTATION_WEIGHT)
    importance = entropy.groupBy("host", "node").agg(F.max("m").alias("m"), F.sum(weight * F.col("e")).alias("importance"))
    return importance.where((F.col("m") >= least_pages) & (F.col("importance") < low)).groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", least_pages: int = LEAST_PAGES, low: float = LOW) -> DataFrame:
    """One row per page: its main text and the number of its code points.

    Defined cases: null or empty html gives the empty text; a page that is cut off is read as far as it goes; one
    without article or main element is read whole, less furniture and low branches; pages without a URL share the
    empty host; repeated pages are extracted each; no rows give none. Other columns are not read.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host())
    lows = written(low_nodes(own, least_pages, low), "low_nodes")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [main_text(h, frozenset(x or ())) for h, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.join(lows, "host", "left").select("page_id", "url", "html", "nodes").mapInArrow(run, EXTRACTED)

"""Main texts of pages by site style trees.

Pages of one host are merged into one tree. An element of a page is the same node as that of another page if their
parents are the same node, lay out their children in the same style (the sequence of the children's tags with class
and id, runs of equal ones taken together), and both stand at the same place of it. Text directly inside an element
is a content node. Then

* a presentation node on m pages has the entropy of its styles to the base m as its own importance: who lays out a
  place differently from page to page is likely to say something there;
* a content node has one minus the mean entropy of its blocks of text: a block that stands on all pages counts nothing;
* a node on one page only counts fully;
* the importance of a branch is (1 - GAMMA^l) of its node's own and GAMMA^l of that of its l styles, by their shares of the
  pages; a style's is the mean of its branches.

Branches of less than THRESHOLD, in which no branch has more, are removed from each page. An entropy cannot see what varies from page to page and is
no part of the article for all that (an advert, readers' comments), nor judge a host of one page, so a node whose tag,
role, class or id declares such content has no importance at all. Nor should pages that are copies of each other lose
their article: branches around an element that declares the article always stay; inside it, flow content (paragraphs,
headings, items, cells) stays and other branches are judged only if the article itself has something important; and
where the whole body has nothing important only declared content goes.

The trees are counted, not built: pages give (node, style) and (node, block of text) rows, which Spark adds up by
node, and branches are summed from the deepest level upwards. Equal pages of a host count once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import arrow_batches, settle

GAMMA = 0.9
THRESHOLD = 0.4
DEPTH = 24

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>?)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

INLINE = frozenset("a abbr acronym b bdi bdo big blink cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base basefont bgsound col embed frame img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
PAGE = frozenset("html head body".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
# What an open element is closed by, and the elements that it is not looked for beyond.
CLOSED_BY = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption pre blockquote figure figcaption address hgroup header".split())
NO_CONTENT = frozenset("nav aside footer form menu dialog noscript template object svg canvas audio video map select button option datalist fieldset".split())
DECLARED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar "
    "footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social comment comments "
    "reply replies disqus respond related recommended pagination pager copyright complementary contentinfo search".split()
)
HEADERS = frozenset("header banner".split())
ARTICLES = frozenset("article main".split())
ARTICLE_NAMES = frozenset(("article", "main", "content", "post", "entry", "story", "articlebody"))


class Node:
    """An element: its tag, name (tag with class and id), the words of its names, and its children, texts among them."""

    __slots__ = ("tag", "name", "words", "children", "id", "ids", "article")

    def __init__(self, tag: str, attributes: str) -> None:
        self.tag, self.name, self.words, self.children = tag, tag, frozenset(), []
        self.id: int | None = None
        self.ids: list[int | None] = []
        if "=" in attributes:
            found = [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)]
            # Names differ from page to page by numbers only where they name the page.
            self.name = " ".join([tag, *sorted(_DIGITS.sub("0", v) for k, v in found if k in ("class", "id"))])
            self.words = frozenset(t.lower() for _, v in found for t in _TOKEN.findall(v)) | {v.strip().lower() for _, v in found}
        self.article = (tag in ARTICLES or bool(self.words & ARTICLE_NAMES)) and not self.words & DECLARED

    def declared(self, inside: bool) -> bool:
        """Whether the element says that it is no part of an article; a header may be, ``inside`` one."""
        if self.tag in NO_CONTENT or self.words & DECLARED:
            return True
        return not inside and (self.tag == "header" or bool(self.words & HEADERS))


def parse(page: str) -> Node:
    """The page's body as a tree of block elements; inline markup is dropped, text is decoded and its white space folded."""
    root = Node("body", "")
    stack, held, at = [root], [], 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            stack[-1].children.append(text)

    def close(tags: tuple[str, ...], beyond: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in beyond:
                return

    while m := _TAG.search(page, at):
        held.append(page[at : m.start()])
        at, (slash, tag, attributes) = m.end(), m.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE or tag in VOID:
            continue
        if tag == "br":
            held.append(" ")
            continue
        flush()
        if tag in PAGE or tag == "hr":
            continue
        if slash:
            close((tag,), ("table",) if tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption") else ())
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in CLOSES_P:
            close(("p",), ("td", "th", "table", "button"))
        if tag in CLOSED_BY:
            close(*CLOSED_BY[tag])
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        stack.append(node)
    held.append(page[at:])
    flush()
    return root


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def _bare(root: Node) -> None:
    """Drops elements without any text below them."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        node.children = [c for c in node.children if isinstance(c, str) or c.children]


def branches(root: Node, host: str) -> Iterator[tuple[int, int, int, bool, int]]:
    """(level, style of the parent, node, whether it is a content node, style or block of text); gives elements their ids.

    Elements below DEPTH levels belong to the content of the one above them."""
    _bare(root)
    root.id = _signed(f"host {host}")
    stack = [(0, 0, root)]
    while stack:
        level, up, node = stack.pop()
        names = ["#text" if isinstance(c, str) else c.name for c in node.children]
        places, runs = [], []
        for name in names:
            if not runs or runs[-1] != name:
                runs.append(name)
            places.append(len(runs) - 1)
        style = _signed(f"{node.id} {'|'.join(runs)}")
        yield level, up, node.id, False, style
        for place, child in zip(places, node.children):
            own = _signed(f"{style} {place}")
            node.ids.append(own)
            if isinstance(child, str):
                yield level + 1, style, own, True, _signed(f"text {child}")
            elif level + 1 < DEPTH:
                child.id = own
                stack.append((level + 1, style, child))
            else:
                yield level + 1, style, own, True, _signed(f"text {chr(10).join(_texts(child))}")


def _owned(node: Node) -> list[tuple[Node | str, int | None]]:
    """The children with their ids in the tree; those below DEPTH levels have none."""
    return list(zip(node.children, node.ids or [None] * len(node.children)))


def _texts(node: Node) -> Iterator[str]:
    stack: list[Node | str] = [node]
    while stack:
        one = stack.pop()
        if isinstance(one, str):
            yield one
        else:
            stack += reversed(one.children)


PROFILE = T.ArrayType(
    T.StructType().add("level", T.IntegerType()).add("up", T.LongType()).add("node", T.LongType()).add("text", T.BooleanType()).add("values", T.ArrayType(T.LongType()))
)


@F.pandas_udf(PROFILE)
def _profiles(pages: pd.Series, hosts: pd.Series) -> pd.Series:
    """The branches of each page, each once, with its styles or its blocks of text."""
    out = []
    for page, host in zip(pages, hosts):
        rows: dict[tuple[int, int, int, bool], dict[int, None]] = {}
        for *branch, value in branches(parse(page.decode(errors="replace")), host):
            rows.setdefault(tuple(branch), {})[value] = None
        out.append([dict(zip(("level", "up", "node", "text", "values"), (*branch, list(values)))) for branch, values in rows.items()])
    return pd.Series(out, dtype=object)


def main_text(page: bytes, host: str, low: frozenset[int]) -> str:
    """The page's blocks, joined by line breaks, without its declared branches and those whose ids are in ``low``."""
    root = parse(page.decode(errors="replace"))
    list(branches(root, host))
    order: list[tuple[Node, int | None, int]] = []
    path: list[tuple[Node, int | None, int]] = [(root, root.id, -1)]
    while path:
        order.append(path.pop())
        node = order[-1][0]
        path += [(c, i, len(order) - 1) for c, i in _owned(node) if isinstance(c, Node)]
    around, important = set(), set()
    for node, own, parent in reversed(order):
        if own is not None and (own not in low or any(isinstance(c, str) and i is not None and i not in low for c, i in _owned(node))):
            important.add(id(node))
        for of in (around, important):
            if parent >= 0 and id(node) in of:
                of.add(id(order[parent][0]))
        if node.article and parent >= 0:
            around |= {id(node), id(order[parent][0])}
    blocks: list[str] = []
    stack: list[tuple[Node | str, int | None, bool, bool]] = [(root, None, False, id(root) in important)]
    while stack:
        one, own, inside, judging = stack.pop()
        if isinstance(one, str):
            if inside or not judging or own not in low:
                blocks.append(one)
            continue
        unimportant = judging and own is not None and id(one) not in important and not (inside and one.tag in FLOW)
        if one is not root and id(one) not in around and (unimportant or one.declared(inside)):
            continue
        if one.article:
            inside, judging = True, id(one) in important
        stack += [(c, i, inside, judging) for c, i in reversed(_owned(one))]
    return "\n".join(blocks)


@F.pandas_udf(T.StringType())
def _main_texts(pages: pd.Series, hosts: pd.Series, lows: pd.Series) -> pd.Series:
    none: frozenset[int] = frozenset()
    return pd.Series([main_text(p, h, none if low is None else frozenset(int(x) for x in low)) for p, h, low in zip(pages, hosts, lows)], dtype=object)


def importance(rows: DataFrame) -> DataFrame:
    """(node, text, importance) of every branch of ``rows`` (level, up, node, text, values), one for each page."""
    each = rows.select("level", "up", "node", "text", F.posexplode("values").alias("place", "value"))
    pages = F.sum((F.col("place") == 0).cast("int"))
    values = settle(each.groupBy("level", "up", "node", "text", "value").agg(F.count("*").alias("n"), pages.alias("first")))
    log, n = F.log("n"), F.col("n")
    nodes = values.groupBy("level", "up", "node", "text").agg(
        F.sum("first").alias("m"), F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(n * log).alias("n_log"), F.avg(log).alias("mean_log")
    )
    entropy = F.when(F.col("text"), 1 - F.col("mean_log") / F.log("m")).otherwise((F.log("total") - F.col("n_log") / F.col("total")) / F.log("m"))
    own = F.when(F.col("m") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy)))
    nodes = settle(nodes.withColumn("own", own))
    deepest = nodes.agg(F.max("level")).first()[0]
    out, below = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = nodes.where(F.col("level") == level)
        branch = here.where("text").select("up", "node", "text", F.col("own").alias("importance"))
        elements = here.where("not text")
        if below is not None:
            styles = values.where((F.col("level") == level) & ~F.col("text")).join(below.groupBy(F.col("up").alias("value")).agg(F.avg("importance").alias("inner")), "value")
            inner = styles.groupBy("node").agg((F.sum(n * F.col("inner")) / F.sum("n")).alias("inner"))
            faded = F.pow(F.lit(GAMMA), F.col("kinds"))
            both = (1 - faded) * F.col("own") + faded * F.coalesce("inner", F.lit(0.0))
            branch = branch.unionByName(elements.join(inner, "node", "left").select("up", "node", "text", both.alias("importance")))
        below = settle(branch)
        out = below if out is None else out.unionByName(below)
    return out.drop("up") if out is not None else nodes.select("node", "text", F.col("own").alias("importance"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def main_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``pages`` with ``text``, the page's main text, in place of any column of this name.

    Null and empty pages have empty texts. Pages of one host (null and hostless urls are one) are judged together; equal
    pages of a host count once in this and all get the same text. Other columns stay, whatever their names; an empty
    table stays empty.
    """
    spark = pages.sparkSession
    held = pages.select(
        F.struct(*(pages[f"`{c}`"] for c in pages.columns)).alias("page"), host_of(pages[f"`{url_col}`"]).alias("host"),
        F.coalesce(pages[f"`{html_col}`"].cast("binary"), F.lit(b"")).alias("html"),
    )
    keyed = held.withColumn("k", F.xxhash64("host", "html")).withColumn("size", F.length("html"))
    with arrow_batches(spark, 1000):
        met = keyed.select("k", "size", _profiles("html", "host").alias("rows"))
        met = settle(met.groupBy("k", "size").agg(F.any_value("rows").alias("rows")))
        low = importance(met.select(F.explode("rows").alias("r")).select("r.*")).where(F.col("importance") < threshold)
        shaped = met.select("k", "size", F.array_sort(F.array_distinct(F.transform("rows", lambda r: r["node"]))).alias("nodes"))
        shaped = shaped.withColumn("shape", F.xxhash64("nodes"))
        shapes = shaped.groupBy("shape").agg(F.any_value("nodes").alias("nodes")).select("shape", F.explode("nodes").alias("node"))
        lows = shapes.join(low.select("node"), "node", "left_semi").groupBy("shape").agg(F.collect_list("node").alias("low"))
        known = settle(shaped.select("k", "size", "shape").join(lows, "shape").select("k", "size", "low"))
    text = _main_texts("html", "host", "low")
    return keyed.join(known, ["k", "size"], "left").withColumn("text", text).select(*(F.col(f"page.`{c}`") for c in pages.columns if c != "text"), "text")

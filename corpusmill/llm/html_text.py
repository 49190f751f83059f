"""The main text of web pages, with site templates found by counting element subtrees per host.

A page is read into a tree of elements. The subtrees of its blocks are hashed, and Spark counts for
each host in how many different pages each hash occurs; subtrees that recur in many are the site's
template and are deleted. Paragraphs, headings and the like inside an article are its text and stay,
however often they recur, and copies of a page count once. Elements whose tag, role or class says
that they are menus, headers, footers, sidebars, notices, adverts, forms or comments are deleted as
well. What is left of the article, or of the body where there is none, is the text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import table
from corpusmill.session import stage

PAGES = 5  # of a host that must share a subtree, and
SHARE = 0.2  # of the host's pages, or
MANY = 25  # of them, whatever their share: on a host of so many pages PAGES are the share
TEMPLATES = 200_000  # template subtrees that are broadcast: hash and host, some 20 MB

#: HTML's elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {  # an opening tag that ends open elements of these names, up to a container of its own
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "option": ("option",),
    "body": ("head",),
}
SCOPES = frozenset("html body ul ol dl table select article section div td th main".split())

#: Of a block in an article only these may be a template; the others are its text.
CONTAINERS = frozenset("aside dialog div fieldset footer form header menu nav section".split())
FRAME = frozenset("html body article main caption tbody thead tfoot".split())

#: Names that mark what isn't the page's own text.
SKIPPED = frozenset(
    "head script style title template noscript iframe object svg math canvas audio video nav footer "
    "aside form button select textarea input dialog menu datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu form".split())
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer masthead "
    "sidebar aside widget ad ads adv advert adverts advertisement advertising banner sponsor sponsored "
    "promo promotion cookie cookies consent gdpr notice notification popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments "
    "commentlist disqus reply replies respond header topbar toolbar skip".split()
)
#: Words that may stand beside such a name in one class: with any other word (no-sidebar, related-work)
#: the class is a name of its own.
BESIDE = frozenset(
    "site page post entry article global main top bottom left right upper lower primary secondary first last "
    "box bar button buttons link links list lists item items icon icons container wrapper wrap inner outer "
    "block blocks section sections area panel unit units slot slots holder group row column col text body "
    "title label info form message area region zone js bs us this".split()
)
#: Names of a page's frame: an element of such a class that holds all articles and main elements is the frame itself.
FRAMES = frozenset(
    "nav navbar navigation menu menubar sidebar aside widget banner header masthead topbar toolbar popup modal overlay skip".split()
)
CONTENT = frozenset("article content entry main post story text title headline".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []  # nodes and texts in order

    def attribute(self, *names: str) -> str:
        if not self.attributes.strip():
            return ""
        found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(self.attributes)}
        return " ".join(found.get(n, "") for n in names).strip()


def parse(page: str) -> Node:
    """The elements of a page. Unclosed elements end where HTML ends them or with their parent."""
    root = node = Node("#root", "", None)
    at, end = 0, len(page)
    while at < end:
        tag = _TOKEN.search(page, at)
        if tag is None:
            node.children.append(page[at:])
            break
        if tag.start() > at:
            node.children.append(page[at : tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        if tag[1]:
            node = _closed(node, name)
            continue
        if name in CLOSES or name in BLOCKS:
            node = _ended(node, name)
        child = Node(name, tag[3], node)
        node.children.append(child)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            child.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif name not in VOID and not tag[3].rstrip().endswith("/"):
            node = child
    return root


def _closed(node: Node, name: str) -> Node:
    """Where reading goes on after a closing tag; one that closes nothing is passed over."""
    open_ = node
    while open_ is not None and open_.tag != name:
        if name not in BLOCKS and open_.tag in BLOCKS:
            return node  # a tag inside a line doesn't end the block around it
        open_ = open_.parent
    return node if open_ is None or open_.parent is None else open_.parent


def _ended(node: Node, name: str) -> Node:
    """Where an opening tag goes, after the elements that it ends."""
    ends = (*CLOSES.get(name, ()), *(("p",) if name in BLOCKS else ()))
    open_ = found = node
    while open_ is not None and open_.tag not in SCOPES:
        if open_.tag in ends:
            found = open_.parent
        open_ = open_.parent
    if open_ is not None and open_.tag in ends and open_.tag in ("td", "th"):
        found = open_.parent
    return found


def boilerplate(node: Node) -> bool:
    """Does the element's tag, role, class or id say that it isn't the page's own text?"""
    if node.tag in SKIPPED:
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return node.tag == "header" and not _within(node, "article")
    if node.attribute("role").lower() in ROLES or node.attribute("aria-hidden").lower() == "true":
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", node.attributes.lower()) or re.search(
        r"display\s*:\s*none|visibility\s*:\s*hidden", node.attribute("style").lower()
    ):
        return True
    if node.tag in BLOCKS and _marked(node):  # a word of a line is never dropped for its class
        return True
    return node.tag == "header" and not _within(node, "article")


def _marked(node: Node) -> bool:
    """Does a class or the id name boilerplate as a whole?"""
    for name in node.attribute("class", "id").split():
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w}
        marks = words & MARKS
        if not marks or not words - marks <= BESIDE:
            continue
        if words & CONTENT and marks <= {"header", "post", "text"}:
            continue
        if marks <= FRAMES and _frames(node):
            continue
        return True
    return False


def _frames(node: Node) -> bool:
    """Does the element hold all articles and main elements that the page has?"""
    root = node
    while root.parent is not None:
        root = root.parent
    held = _count(node, ("article", "main"))
    return bool(held) and held == _count(root, ("article", "main"))


def _count(node: Node, tags: tuple[str, ...]) -> int:
    n, stack = 0, [node]
    while stack:
        now = stack.pop()
        n += now.tag in tags
        stack += [c for c in now.children if not isinstance(c, str)]
    return n


def _within(node: Node, tag: str) -> bool:
    while node is not None and node.tag != tag:
        node = node.parent
    return node is not None


def _elements(node: Node, name: str) -> Iterator[Node]:
    """The outermost elements of a name, without those in boilerplate."""
    stack = [node]
    while stack:
        now = stack.pop()
        if now.tag == name:
            yield now
            continue
        if now.tag == "#root" or not boilerplate(now):
            stack += [c for c in reversed(now.children) if not isinstance(c, str)]


def _length(nodes: list[Node]) -> int:
    return sum(len(b) for b in blocks(nodes, set()))


def main_parts(root: Node) -> list[Node]:
    """The articles or the main elements, whichever hold more text, or the whole page. Articles that
    hold at least half of what the main elements do are taken before these."""
    articles, mains = list(_elements(root, "article")), list(_elements(root, "main"))
    if articles and mains:
        return articles if 2 * _length(articles) >= _length(mains) else mains
    return articles or mains or [root]


def subtree_hashes(root: Node, parts: list[Node]) -> list[tuple[Node, int]]:
    """(element, hash of its tag, attributes and everything in it) of the blocks that may belong to a
    template: all but the page's frame, the articles, and the text blocks in them."""
    order, stack = [], [(root, False)]
    article = {id(p) for p in parts if p.tag != "#root"}
    while stack:
        node, inside = stack.pop()
        inside = inside or id(node) in article
        order.append((node, inside))
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]
    known: dict[int, bytes] = {}
    found = []
    for node, inside in reversed(order):
        state = hashlib.blake2b(f"{node.tag} {node.attributes.strip()}".encode(), digest_size=8)
        for child in node.children:
            if isinstance(child, str):
                state.update(b"\0" + " ".join(child.split()).encode())
            else:
                state.update(b"\1" + known[id(child)])
        known[id(node)] = state.digest()
        able = CONTAINERS if inside else BLOCKS
        if node.tag in able and node.tag not in FRAME and id(node) not in article:
            found.append((node, int.from_bytes(known[id(node)], "big", signed=True)))
    return found


def blocks(parts: list[Node], deleted: set[int]) -> list[str]:
    """The texts of the blocks in page order, white space as one space, without empty ones."""
    done: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            done.append(text)

    for part in parts:
        stack: list = [part]
        while stack:
            now = stack.pop()
            if now is None:
                end()
            elif isinstance(now, str):
                line.append(now)
            elif now is not part and (id(now) in deleted or boilerplate(now)):
                line.append(" ")
            elif now.tag == "br":
                line.append(" ")
            else:
                if now.tag in BLOCKS or now is part:
                    end()
                    stack.append(None)
                stack += reversed(now.children)
        end()
    return done


def extract(page: str, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page, without the subtrees whose hashes are in ``template``."""
    root = parse(page)
    parts = main_parts(root)
    deleted = {id(n) for n, h in subtree_hashes(root, parts) if h in template} if template else set()
    return "\n\n".join(blocks(parts, deleted))


def _host() -> Column:
    host = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)"
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), host, 1))


def _safe(page) -> str:
    return "" if page is None else page.encode("utf-8", "replace").decode()


def _subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hosts, marks, found = [], [], []
        for host, mark, page in zip(batch["host"], batch["mark"], batch["html"]):
            root = parse(_safe(page))
            own = {h for _, h in subtree_hashes(root, main_parts(root))}
            hosts += [host] * len(own)
            marks += [mark] * len(own)
            found += own
        yield pd.DataFrame({"host": hosts, "mark": marks, "subtree": found}).astype(
            {"host": "str", "mark": "int64", "subtree": "int64"}
        )


def templates(pages: DataFrame) -> DataFrame:
    """(host, subtree) of the subtrees that recur in many different pages of a host, staged.

    ``pages`` has url and html. Counting is by host and hash, so a host with many pages is spread.
    """
    given = pages.select(_host().alias("host"), F.xxhash64("html").alias("mark"), "html")
    rows = stage(given.mapInPandas(_subtrees, "host string, mark long, subtree long"), "subtrees")
    distinct = given.select("host", "mark").distinct()
    totals = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = rows.distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
    common = counts.where(F.col("n") >= PAGES).join(totals, "host")
    least = F.least(SHARE * F.col("pages"), F.lit(float(MANY)))
    return stage(common.where(F.col("n") >= least).select("host", "subtree"), "templates")


def _extract_with(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value if shared else {}
        for batch in batches:
            texts = [
                extract(_safe(page), known.get(host, frozenset()) if own is None else frozenset(own))
                for host, page, own in zip(batch["host"], batch["html"], batch["own"])
            ]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    return run


def main_texts(pages: DataFrame, most: int = TEMPLATES) -> DataFrame:
    """(page_id, url, text) of each row of ``pages`` (page_id, url, html); empty for a null or empty
    html. Repeated rows give equal texts; a null or malformed URL belongs to the host without name.

    Up to ``most`` template subtrees go to the tasks as one table. Beyond that each page gets the
    ones of its host that it has by a join, and no host's templates are ever gathered.
    """
    spark = pages.sparkSession
    recurring = templates(pages)
    # as text, since pandas would make a column of ids with nulls a float
    given = pages.select(F.col("page_id").cast("string"), "url", "html", _host().alias("host"))
    schema = "page_id string, url string, text string"
    typed = [F.col("page_id").cast("long"), F.col("url"), F.col("text")]
    none = F.lit(None).cast("array<long>").alias("own")
    if recurring.count() <= most:
        table_: dict[str, set[int]] = {}
        for row in recurring.toLocalIterator():
            table_.setdefault(row["host"], set()).add(row["subtree"])
        shared = spark.sparkContext.broadcast({h: frozenset(x) for h, x in table_.items()})
        return given.select("*", none).mapInPandas(_extract_with(shared), schema).select(typed)
    marked = given.withColumn("mark", F.xxhash64("html"))
    rows = marked.select("host", "mark", "html").mapInPandas(
        _subtrees, "host string, mark long, subtree long"
    )
    own = rows.distinct().join(recurring, ["host", "subtree"], "left_semi")
    own = own.groupBy("host", "mark").agg(F.collect_list("subtree").alias("own"))
    joined = marked.join(own, ["host", "mark"], "left")
    joined = joined.withColumn("own", F.coalesce("own", F.array().cast("array<long>")))
    return joined.mapInPandas(_extract_with(None), schema).select(typed)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = main_texts(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))

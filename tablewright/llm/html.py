"""Main text of web pages by consensus of their host on container paths.

1. Every page's containers are scored: characters of text outside links against those inside, in paragraphs above all, less for
   names that speak of furniture. Of a chain of containers the innermost counts that leaves out nothing but links, furniture and signs
   without letters or digits; a title or lead beside an inner container belongs to the text. The best container votes with its generalised path: tags and classes from the root, without
   numbers and other parts that change from page to page.
2. Votes are summed per host in Spark. The paths of a host are ranked by votes.
3. Every page is extracted again by the best path of its host that it has, of all paths on which two pages or more agree; a page that
   has none, and pages without a host, use their own best path.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader comments inside the container are left
out. Scripts, controls and the like always are. Other elements are only suspected, by their tag or by a word in class, id or role: one that
holds the page's ``article`` or ``main``, or most of its text, is a wrapper and stays, whatever it is called. A class that is such a word
weighs more than one that contains it, and headings and paragraphs are not judged by their id. Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one space.

Null, empty and very long pages are taken whole, one page at a time; null and empty ones empty text. An empty table gives no rows. A page without any container of text gives the text of its body. Unclosed and stray tags are
taken as browsers do for paragraphs, list items, table cells and the like; what is never closed ends with the page. Repeated rows
vote once each. Ties of votes go to the longer path, then to the alphabetically first. Extra columns are not read.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.arrow import shares
from tablewright.plans.durable import durable

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that end an open element of the named kinds.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
ENDS_PARAGRAPH = BLOCKS - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}

#: Elements that are never text.
NEVER_TEXT = frozenset("script style noscript template svg math button select input textarea iframe object head canvas audio video".split())
#: Elements that are seldom main text, and words in class, id or role that say so.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog".split())
FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar side widget ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments "
    "discussion disqus reply replies respond masthead topbar toolbar pagination pager search form skip complementary contentinfo".split()
)
#: Those of them that speak of what readers wrote.
READER_WORDS = frozenset("comment comments discussion disqus reply replies respond".split())
#: Share of the page's text that makes a wrapper of an element whose class contains such a word, is one, or is one of readers.
WRAPS, WRAPS_NAMED, WRAPS_READERS = 0.5, 0.8, 0.95
#: Elements that are not judged by their id.
NOT_BY_ID = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
#: Elements that may be the main container.
CONTAINERS = frozenset("article main section div td body".split())
#: Elements that hold text of the container that they are in.
OWN_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
MAIN_WORDS = frozenset("article content main post entry story text body".split())

MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
SAYS = re.compile(r"[^\W_]")


class Node:
    __slots__ = ("tag", "names", "parent", "furniture", "suspect", "children", "plain", "linked", "paragraphs")

    def __init__(self, tag: str, names: str, parent: Node | None, judged: str | None = None):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node | str] = []
        self.plain = self.linked = self.paragraphs = 0
        self.furniture = tag in NEVER_TEXT
        #: Share of the page's text from which on a suspected element is taken for a wrapper; None without a suspicion.
        self.suspect = self._suspicion(names if judged is None else judged)

    def _suspicion(self, names: str) -> float | None:
        if self.tag in ("html", "body", "article", "main"):
            return None
        words = set(WORD.findall(names)) & FURNITURE_WORDS
        named = words & set(names.split())
        if words & READER_WORDS and (named or words - READER_WORDS):
            return WRAPS_READERS
        if self.tag == "form":
            return WRAPS
        if named or self.tag in FURNITURE_TAGS or (self.tag == "header" and not _inside(self.parent, "article")):
            return WRAPS_NAMED
        return WRAPS if words else None

    def step(self) -> str:
        kinds = sorted({w for w in re.split(r"[^a-z]+", self.names.lower()) if len(w) > 2})
        return ".".join([self.tag, *kinds])

    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            steps.append(node.step())
            node = node.parent
        return "/".join(reversed(steps))


def _inside(node: Node | None, tag: str) -> bool:
    while node is not None and node.tag != tag:
        node = node.parent
    return node is not None


def parse(page: str) -> Node:
    """The tree of a page; leaves are undecoded text."""
    root = at = Node("html", "", None)
    place, size = 0, len(page)
    while place < size:
        mark = MARK.search(page, place)
        if mark is None:
            at.children.append(page[place:])
            break
        if mark.start() > place:
            at.children.append(page[place : mark.start()])
        place = mark.end()
        if mark[1] is not None:
            at.children.append(html.escape(mark[1], quote=False))
        if mark[3] is None:
            continue
        tag = mark[3].lower()
        if mark[2]:
            if tag == "br":
                at.children.append(Node("br", "", at))
            open_ = at
            while open_ is not None and open_.tag != tag:
                # a stray end tag of text style does not close blocks around it
                open_ = None if tag not in BLOCKS and open_.tag in BLOCKS else open_.parent
            if open_ is not None and open_.parent is not None:
                at = open_.parent
            continue
        if tag in ("html", "body") and _inside(at, tag):
            continue
        if tag in ENDS_PARAGRAPH:
            open_ = at
            while open_ is not None and open_.tag not in ("p", "div", "article", "td", "th", "li", "body", "section", "button"):
                open_ = open_.parent
            if open_ is not None and open_.tag == "p":
                at = open_.parent
        if tag in ENDS:
            open_ = at
            while open_ is not None and open_.tag not in ENDS[tag] and open_.tag not in ("ul", "ol", "dl", "table", "select", "div", "body"):
                open_ = open_.parent
            if open_ is not None and open_.tag in ENDS[tag]:
                at = open_.parent
                if tag in ("tr", "tbody", "tfoot"):
                    while at.tag in ENDS[tag]:
                        at = at.parent
        found = NAMES.findall(mark[4]) if mark[4] else ()
        names = " ".join(n for f in found for n in f[1:] if n).lower()
        judged = " ".join(n for f in found if f[0].lower() != "id" for n in f[1:] if n).lower() if tag in NOT_BY_ID else names
        node = Node(tag, names, at, judged)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, place)
            place = end.end() if end else size
        elif tag not in VOID and not mark[4].endswith("/"):
            at = node
        elif tag not in VOID and tag in BLOCKS:
            at = node
    return root


def _measure(root: Node) -> list[Node]:
    """Characters in every node, below furniture none: plain, linked and in paragraphs. Returns all nodes, parents first."""
    stack: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
    order = []
    while stack:
        node, linked, paragraph, skipped = stack.pop()
        node.plain = node.linked = node.paragraphs = 0
        skipped = skipped or node.furniture
        linked, paragraph = linked or node.tag == "a", paragraph or node.tag in ("p", "pre", "blockquote")
        order.append(node)
        for child in node.children:
            if isinstance(child, Node):
                stack.append((child, linked, paragraph, skipped))
            elif not skipped:
                n = len(child.strip())
                if n < 20 and not SAYS.search(html.unescape(child)):
                    continue
                if linked:
                    node.linked += n
                else:
                    node.plain += n
                    node.paragraphs += n if paragraph else 0
    for node in reversed(order):
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.linked += node.linked
            node.parent.paragraphs += node.paragraphs
    return order


def measure(root: Node) -> None:
    """Find the furniture among the suspected elements, then measure what is left."""
    order = _measure(root)
    if not any(n.suspect for n in order):
        return
    total = root.plain
    holds: dict[int, int] = {}  # the longest article or main text inside, that is not suspected itself
    for node in reversed(order):
        own = node.plain if node.tag in ("article", "main") else 0
        if node.parent is not None and not node.furniture and node.suspect != WRAPS_READERS:
            holds[id(node.parent)] = max(holds.get(id(node.parent), 0), own, holds.get(id(node), 0))
    longest = holds.get(id(root), 0)
    for node in order:
        if node.suspect is not None and not node.furniture:
            main = holds.get(id(node), 0)
            wraps = main > 0 and (main == longest if node.suspect == WRAPS_READERS else main >= longest / 2)
            node.furniture = not wraps and (node.plain < node.suspect * total or node.linked > node.plain or not node.plain)
    _measure(root)


def containers(root: Node) -> list[tuple[float, Node]]:
    """Score and node of all containers, best first; of a chain around the same text, the innermost."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.furniture:
            order.append(node)
            stack.extend(c for c in node.children if isinstance(c, Node))
    found, factors = [], {}
    for node in reversed(order):
        if node.tag not in CONTAINERS or not node.plain:
            continue
        words = set(WORD.findall(node.names))
        score = node.plain + node.paragraphs - 2 * node.linked
        inner = max((c for c in node.children if isinstance(c, Node) and c.tag in CONTAINERS and not c.furniture), key=lambda c: c.plain, default=None)
        factor = {"article": 1.5, "main": 1.3, "body": 0.7}.get(node.tag, 1.0) * (1.2 if words & MAIN_WORDS else 1.0) * (0.9 if node.suspect else 1.0)
        if inner is not None and inner.plain > 0.8 * node.plain:
            if inner.plain == node.plain:
                score *= 0.8
            elif inner.tag not in ("article", "main") and any(isinstance(c, Node) and c.tag in OWN_TEXT and c.plain and not c.furniture for c in node.children):
                # its own title and paragraphs go on in the inner container, whatever that is called
                factor = max(factor, factors[id(inner)])
        factors[id(node)] = factor
        found.append((score * factor, node))
    return sorted(reversed(found), key=lambda x: -x[0])


def text_of(node: Node) -> str:
    """Blocks of the node's text without furniture."""
    blocks, now, stack = [], [], [(node, False)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            now.append(item)
            continue
        if item is not node and item.furniture:
            continue
        if item.tag in BLOCKS and now:
            blocks.append("".join(now))
            now = []
        if not done:
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
    blocks.append("".join(now))
    cleaned = (SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)
    return " ".join(b for b in cleaned if b)


def best_path(page: str | None) -> str | None:
    """The vote of a page."""
    if not page:
        return None
    root = parse(page)
    measure(root)
    found = containers(root)
    return found[0][1].path() if found else None


def extract(page: str | None, paths: list[str] | None) -> str:
    """Main text by the first path that the page has, else by its own best path."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    found = containers(root)
    if not found:
        return text_of(root)
    at: dict[str, list[Node]] = {}
    for _, node in found:
        at.setdefault(node.path(), []).append(node)
    own = at[next((p for p in paths or () if p in at), found[0][1].path())]
    own = [n for n in own if not any(m is not n and _below(n, m) for m in own)]
    return " ".join(t for t in map(text_of, _in_order(root, own)) if t)


def _below(node: Node, other: Node) -> bool:
    while node is not None and node is not other:
        node = node.parent
    return node is not None


def _in_order(root: Node, chosen: list[Node]) -> list[Node]:
    if len(chosen) == 1:
        return chosen
    wanted, out, stack = {id(n) for n in chosen}, [], [root]
    while stack:
        node = stack.pop()
        if id(node) in wanted:
            out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host``, ``path`` and ``votes``."""

    def work(batches):
        for batch in batches:
            for part in shares(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([best_path(p) for p in part.column(1).to_pylist()], pa.string())], names=["host", "path"])

    found = pages.select(host(F.col(url)).alias("host"), F.col(page).alias("page")).mapInArrow(work, "host string, path string")
    return found.where("host <> '' AND path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"))


#: Votes from which on a path is one that pages agree on.
AGREED = 2


def winners(counted: DataFrame) -> DataFrame:
    """Per host the paths that pages agree on, most votes first."""
    first = F.struct((-F.col("votes")).alias("v"), (-F.length("path")).alias("n"), "path")
    listed = counted.where(F.col("votes") >= AGREED).groupBy("host").agg(F.sort_array(F.collect_list(first)).alias("ranked"))
    return listed.select("host", F.transform("ranked", lambda x: x["path"]).alias("paths"))


#: Bytes up to which the winning paths are broadcast.
BROADCAST_BYTES = 32 << 20


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    paths = durable(winners(votes(pages, url, page)))
    held = paths.agg(F.sum(F.octet_length("host") + F.aggregate("paths", F.lit(32), lambda n, p: n + F.octet_length(p) + 16))).first()[0]
    if (held or 0) <= BROADCAST_BYTES:
        paths = F.broadcast(paths)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("page"), host(F.col(url)).alias("host"))
    rows = rows.join(paths, "host", "left").select("page_id", "url", "page", "paths")

    def work(batches):
        for batch in batches:
            for part in shares(batch, 2):
                texts = [extract(p, w) for p, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    schema = rows.select("page_id", "url").schema
    return rows.mapInArrow(work, schema.add("text", "string"))


def query(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))

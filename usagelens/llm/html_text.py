"""Main text of web pages by wrapper induction.

A page is read as a tree of its block elements; text in inline elements belongs to the
block around it, and brothers of one kind (tag, class and id) are folded into one node.
The trees of a host's pages are merged into its wrapper. As brothers are folded, each
kind is there once among the children of a node, so simple tree matching pairs equal
kinds at equal paths and decides no more than a table of paths would. Each node of a
wrapper counts on how many pages it is and each of its texts is. A text on half of the
pages that have its node is template; all others are content unless they lie in an
element that names itself something else (menu, footer, advert, form, ...). Where a page
marks its article by an element with text, the content of that page lies inside it.

Wrappers are merged within every input task first, so pages are not shuffled and a host
with a third of all pages is read by all tasks; merged wrappers grow with the kinds of
nodes of a host and its fullest page, not with the number of pages. A node on fewer than
``FEW`` pages has no template: names alone decide.

Null pages count as empty and have the empty text. Null addresses form one host. Pages
with equal ids are extracted one by one. An empty table gives no rows.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import whole_text

FEW = 8
SKETCH = 48
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Elements by role (fixed values of the HTML standard).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template noscript iframe object svg math canvas audio video head title select option button textarea".split())
RAW = set("script style textarea title iframe noscript".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr"
    " main menu nav ol p pre section table ul".split()
)
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
NOT_CONTENT = set("nav footer aside form menu dialog fieldset".split())
ARTICLE = set("article main".split())
# Words in class, id and role that name what is no article.
NAMED = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|sidebar|side|nav\w*|menu\w*"
    r"|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|comments?|comment\w*|replies|respond|disqus|share\w*|sharing|social"
    r"|related|recommend\w*|newsletter|subscribe\w*|signup|login|popup|modal|overlay|pagination|pager|widgets?|complementary"
    r"|contentinfo|search|form)(?:$|[^a-z])"
)


def text_hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class Node:
    """A kind of block element at its place: on how many pages it is, and on how many each of its texts.

    A text counts once for each page. Of a wrapper's texts the most frequent are kept, four
    times as many as the fullest page has; texts on half of the pages are at most twice as many.
    """

    __slots__ = ("kind", "children", "counts", "trees", "fullest")

    def __init__(self, kind: str, trees: int = 0):
        self.kind, self.children, self.trees, self.fullest = kind, [], trees, 0
        self.counts: Counter = Counter()

    def child(self, kind: str, trees: int = 0) -> "Node":
        for node in self.children:
            if node.kind == kind:
                return node
        self.children.append(Node(kind, trees))
        return self.children[-1]

    def add(self, text: str) -> None:
        """Note a text of a page."""
        self.counts[text_hash(text)] = 1
        self.fullest = len(self.counts)

    def join(self, other: "Node") -> None:
        """Take over what another node has counted."""
        self.trees += other.trees
        self.fullest = max(self.fullest, other.fullest)
        self.counts.update(other.counts)
        if len(self.counts) > 2 * self.room():
            self.counts = Counter(dict(self.frequent()))

    def room(self) -> int:
        return max(SKETCH, 4 * self.fullest)

    def frequent(self) -> list[tuple[int, int]]:
        return sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))[:self.room()]

    def constant(self) -> frozenset[int]:
        """The hashes of the texts that are on half of the node's pages."""
        return frozenset(value for value, n in self.counts.items() if 2 * n >= self.trees >= FEW)

    def packed(self) -> list:
        return [self.kind, self.trees, self.fullest, self.frequent(), [node.packed() for node in self.children]]

    @staticmethod
    def unpacked(data: list) -> "Node":
        node = Node(data[0])
        _, node.trees, node.fullest, counts, children = data
        node.counts = Counter(dict(map(tuple, counts)))
        node.children = [Node.unpacked(child) for child in children]
        return node


def _kind(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    names = sorted({
        re.sub(r"\d+", "9", word) for found in ATTRIBUTE.findall(attributes) for word in " ".join(found[1:]).lower().split()
    })
    return " ".join([tag, *names])


def read(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The folded tree of a page, and its blocks of text in order with their nodes."""
    root = Node("page", trees=1)
    stack: list[tuple[str, Node]] = [("page", root)]
    blocks: list[tuple[Node, str]] = []
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((stack[-1][1], text))
                stack[-1][1].add(text)

    def close(depth: int) -> None:
        flush()
        del stack[depth:]

    while True:
        found = TOKEN.search(page, at)
        held.append(page[at:found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag in ("br", "hr") and not found[1]:
            held.append(" ")
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        flush()
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if tag in ENDS_PARAGRAPH:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in HOLDS.get(tag, ()) and tag not in ("td", "th"):
                break
            if stack[depth][0] in SAME_ENDS.get(tag, ()):
                close(depth)
                break
        if tag == "hr":
            continue
        stack.append((tag, stack[-1][1].child(_kind(tag, found[3]), trees=1)))
    flush()
    return root, blocks


def match(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the best match of two trees, and the pairs of children in it."""
    if a.kind != b.kind:
        return 0, []
    m, n = len(a.children), len(b.children)
    if m == n and all(x.kind == y.kind for x, y in zip(a.children, b.children)):
        return 1 + sum(match(x, y)[0] for x, y in zip(a.children, b.children)), [(i, i) for i in range(m)]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    weight = [[match(x, y)[0] for y in b.children] for x in a.children]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[m][n], pairs[::-1]


def merge(wrapper: Node, page: Node) -> dict[Node, Node]:
    """Merge a tree into a wrapper of its kind; returns the wrapper's node for each of the tree's.

    Nodes that the alignment leaves over join a brother of their kind, or become new brothers.
    """
    place = {page: wrapper}
    wrapper.join(page)
    _, pairs = match(wrapper, page)
    known = {j: wrapper.children[i] for i, j in pairs}
    for j, node in enumerate(page.children):
        place |= merge(known.get(j) or wrapper.child(node.kind), node)
    return place


def located(wrapper: Node, page: Node) -> dict[Node, Node]:
    """The wrapper's node for each node of a page that was merged into it."""
    place = {page: wrapper}
    known = {j: wrapper.children[i] for i, j in match(wrapper, page)[1]}
    for j, node in enumerate(page.children):
        at = known.get(j) or next((c for c in wrapper.children if c.kind == node.kind), None)
        if at is not None:
            place |= located(at, node)
    return place


def content_nodes(wrapper: Node) -> dict[int, tuple[bool, frozenset[int]]]:
    """The wrapper's nodes that may hold content, by identity: whether in a marked article, and their constant texts."""
    found: dict[int, tuple[bool, frozenset[int]]] = {}

    def visit(node: Node, hidden: bool, article: bool) -> None:
        tag, _, names = node.kind.partition(" ")
        article = article or tag in ARTICLE or "article" in names.split() and tag != "body"
        hidden = hidden or tag in HIDDEN or tag in NOT_CONTENT or tag == "header" and not article
        hidden = hidden or tag not in ("html", "body", "article", "main", "page") and bool(NAMED.search(names))
        if not hidden:
            found[id(node)] = article, node.constant()
        for child in node.children:
            visit(child, hidden, article)

    visit(wrapper, False, False)
    return found


def main_blocks(wrapper: Node, content: dict[int, tuple[bool, frozenset[int]]], page: str) -> list[str]:
    """The blocks of a page that are content; where the page itself marks its article, those inside."""
    tree, blocks = read(page)
    place = located(wrapper, tree)
    slots = [(content[id(place[node])], text) for node, text in blocks if node in place and id(place[node]) in content]
    marked = any(article for (article, _), _ in slots)
    return [text for (article, constant), text in slots if article >= marked and text_hash(text) not in constant]


def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON) over all pages, as a written table."""
    def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Node] = {}
        for batch in batches:
            for name, page in zip(batch["host"], batch["html"]):
                merge(known.setdefault(name, Node("page")), read(page)[0])
        if known:
            yield pd.DataFrame({
                "host": list(known), "wrapper": [json.dumps(node.packed()) for node in known.values()],
            })

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        merged = Node("page")
        for text in sorted(rows["wrapper"]):
            merge(merged, Node.unpacked(json.loads(text)))
        return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [json.dumps(merged.packed())]})

    schema = "host string, wrapper string"
    parts = materialize(
        pages.select(host(url_col).alias("host"), whole_text(html_col).alias("html")).mapInPandas(induce, schema)
        .withColumn("task", F.spark_partition_id()), "wrappers",
    )
    # One row for each task and host: some hundreds are merged at once, then those.
    some = parts.withColumn("some", F.floor(F.col("task") / 256)).groupBy("host", "some").applyInPandas(together, schema)
    return materialize(some.groupBy("host").applyInPandas(together, schema), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    known = wrappers(pages, url_col, html_col)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host(url_col).alias("host"), whole_text(html_col).alias("html")
    ).join(known, "host")

    @F.pandas_udf("string")
    def main_text(pages: pd.Series, found: pd.Series) -> pd.Series:
        texts, ready = [], {}
        for page, wrapper in zip(pages, found):
            if wrapper not in ready:
                root = Node.unpacked(json.loads(wrapper))
                if len(ready) > 256:
                    ready.clear()
                ready[wrapper] = (root, content_nodes(root))
            root, content = ready[wrapper]
            texts.append("\n".join(main_blocks(root, content, page)))
        return pd.Series(texts, dtype="object")

    texts = rows.select("page_id", "url", main_text("html", "wrapper").alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("bigint"))

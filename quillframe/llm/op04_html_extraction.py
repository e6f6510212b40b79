"""HTML extraction by composite text density.

A page becomes a tree of its block elements. Each node's density is its characters per tag,
adjusted for links: C/T * log_b((C/LC) * (T/LT)) with b = ln(C/NLC * LC + LCbody/Cbody * C + e), where C, LC
and NLC are all, linked and other characters, T and LT tags and link tags (0 counts as 1 below a
line). The node with the largest sum of child densities is the core; the least density on the path
from it up to the body is the threshold. Each node of at least that density adds the subtree of the largest
sum below it. The article or main element around the core, or else the elements above it that hold its title and other titled parts, add
their headings, short blocks and bare text too, all but blocks that are mostly links.

Elements that are menus, page headers, footers, sidebars and the like by their tag aren't in the tree. A container whose tag (form), role or
class says that it is such a thing, a notice, an advert or reader comments is left out as well, but never one around the article: see
unwrapped(). A name of several words declares a container with a long paragraph only if its other words mean nothing more, or if it
means comments. Paragraphs, headings, items and inline elements go only if a whole class name says so. A header stays if it
holds the title of an article, or of a part that holds most of the text. Buttons and selections go from within their line.

Cases: null, empty and text-free pages give an empty text. Pages that break off, unclosed and
misnested elements and bare text are read as browsers read them: text in the body is in a block of
its own. Ties in sums take the first node of the page. Very long pages are read whole. Repeated rows each come out; a table without rows gives
none. Further columns are carried; one that is named like the result is replaced by it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import read

#: Elements that start and end a block of text. Fixed values, after the HTML standard's rendering section.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre section summary table tbody tfoot thead tr ul""".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
#: Elements that never belong to the main text.
DROPPED = frozenset("head nav footer aside menu dialog object audio video canvas map".split()) | RAW
#: Controls inside a line, which go with their content if they are closed.
CONTROLS = frozenset("button select datalist".split())
#: Words of class, id and role values that declare an element to be something else than main text, and those of them that mean readers' comments.
DECLARED = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription comment comments disqus reply replies respond sidebar aside complementary menu nav navbar
    navigation breadcrumb breadcrumbs footer contentinfo header masthead share sharing social related recommended pagination pager toolbar login
    signup search form widget""".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Words that say nothing more beside a declared one.
BOXES = frozenset(
    """area articles bar block box button buttons col column container content first group holder icons inner item items last left link links list main outer panel
    posts primary right row secondary section side stories top bottom wrap wrapper zone""".split()
)
#: A paragraph of so many characters outside links keeps a container that one word of a longer name declares.
LONG = 200
#: Blocks that a whole class name alone removes, as it does inline elements.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote summary figcaption legend address hgroup option tr tbody thead tfoot hr".split())
#: Elements that are nodes of the tree.
NESTING = BLOCKS | DROPPED
#: Elements that no class name removes.
KEPT = frozenset("html body main article".split())
#: A start tag of the key closes these, if open in the same container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"thead", "tbody", "tr"}, "tfoot": {"tbody", "tr"},
    "option": {"option"}, "optgroup": {"option", "optgroup"},
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an article is known by.
MARKS = frozenset("article main h1".split())

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")
#: In a class name, what follows one of these says what an element has or lacks, not what it is.
_BESIDE = frozenset("no has have with without".split())
_CLOSED = re.compile(r"""(?:^|[\s"'/])/\Z""")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)""", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "link_chars", "tags", "link_tags", "cut", "named", "dropped", "blocks", "density", "order")

    def __init__(self, tag: str, parent: Node | None, cut: bool, named: str, order: int) -> None:
        self.tag, self.parent, self.cut, self.named, self.order = tag, parent, cut, named, order
        self.children: list[Node] = []
        self.blocks: list[int] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.dropped, self.density = cut, 0.0


def declared(attributes: str, whole: bool = False) -> str:
    """What class, id, role or hidden say that an element is: "", "comments", "other", or "partly" if a name has a declared word among
    others that mean something; whole: only by a name that is one of the words."""
    if not attributes:
        return ""
    partly = ""
    for value in _NAMES.findall(attributes):
        for name in "".join(value).lower().split():
            words = [name] if whole else [w for w in _WORDS.split(name) if w]
            for word in words:
                if word in _BESIDE:
                    break
                if word in COMMENTS:
                    return "comments"
                if word in DECLARED:
                    if all(w in DECLARED or w in BOXES or w.isdigit() for w in words):
                        return "other"
                    partly = "partly"
    return "other" if _HIDDEN.search(re.sub(r"""\"[^"]*"|'[^']*'""", "", attributes)) else partly


def parse(page: str) -> tuple[list[Node], list[str]]:
    """Nodes in page order, the first of them the root, and the page's blocks of text, those of nodes with a declared name too."""
    root = here = Node("html", None, False, "", 0)
    nodes, blocks, pieces = [root], [], []
    links, skipped = 0, []  # open links; open dropped elements that are inline, with the node that they are in
    link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            here.blocks.append(len(blocks))
            blocks.append(text)
            here.chars += len(text)
            here.link_chars += min(link_chars, len(text))
        link_chars = 0

    def add(text: str) -> None:
        nonlocal link_chars
        if not here.cut and not skipped:
            text = entities.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                link_chars += len(text)

    def close(node: Node) -> None:
        """Ends everything open down to node, and node."""
        nonlocal here, links
        flush()
        while True:
            while skipped and skipped[-1][1] is here:
                skipped.pop()
            if here is node:
                break
            here = here.parent
        here = node.parent or root
        links = 0

    def open_of(tags: frozenset[str] | set[str], stop: frozenset[str]) -> Node | None:
        node = here
        while node.parent is not None and node.tag not in tags and node.tag not in stop:
            node = node.parent
        return node if node.tag in tags and node.parent is not None else None

    at, end = 0, len(page)
    while True:
        found = _TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        tag = name.lower()
        if found.group(1):
            if tag == "a":
                links = max(0, links - 1)
            elif tag in NESTING:
                if skipped and tag == skipped[-1][0]:
                    skipped.pop()
                elif (node := open_of({tag} if tag not in HEADINGS else HEADINGS, frozenset())) is not None:
                    close(node)
            elif skipped and tag == skipped[-1][0]:
                skipped.pop()
            elif tag in ("td", "th"):
                add(" ")
            continue
        if tag == "svg" and _CLOSED.search(found.group(3) or ""):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        attributes = found.group(3) or ""
        if tag in CONTROLS:
            if (stop := re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)) is not None:
                at = stop.end()
            continue
        if tag in ("html", "body"):
            continue
        if tag in NESTING:
            if tag in BLOCKS and (p := open_of({"p"}, frozenset(BLOCKS - {"p"}))) is not None:
                close(p)
            if tag in CLOSES and (node := open_of(CLOSES[tag], frozenset({"ul", "ol", "dl", "table", "select", "menu", "nav"}))) is not None:
                close(node)
            if tag in HEADINGS and here.tag in HEADINGS:
                close(here)
            flush()
            links = 0
            if tag in VOID:
                here.tags += 1
                continue
            named = "" if tag in KEPT else tag if tag in ("header", "form") else declared(attributes, tag in LEAVES)
            node = Node(tag, here, here.cut or bool(skipped) or tag in DROPPED, named, len(nodes))
            here.children.append(node)
            nodes.append(node)
            here = node
            continue
        if skipped or here.cut:
            if skipped and tag == skipped[-1][0]:
                skipped.append((tag, here))
            continue
        if tag not in VOID and not attributes.endswith("/") and tag not in ("td", "th", "a") and declared(attributes, whole=True):
            skipped.append((tag, here))
            continue
        here.tags += 1
        if tag == "a":
            links += 1
            here.link_tags += 1
        elif tag in ("br", "td", "th"):
            add(" ")
    flush()
    return nodes, blocks


def unwrapped(nodes: list[Node], blocks: list[str]) -> None:
    """Sets which nodes are dropped: cut ones and those with a declared name, less the ones that are around the article.

    A named node is around the article if it holds an article, a main element or a title, and either none of these is shown outside
    named nodes, or it holds more than half of the text and its name doesn't mean comments. Where nothing else is shown, the largest is.
    """
    size = [0] * len(nodes)  # characters of each subtree, without white space
    titled, in_article = [False] * len(nodes), [False] * len(nodes)
    own = [sum(len("".join(blocks[k].split())) for k in node.blocks) for node in nodes]
    for node in reversed(nodes):
        k = node.order
        size[k] += own[k]
        titled[k] |= node.tag in HEADINGS and size[k] > 0
        if node.parent is not None and not node.cut:
            size[node.parent.order] += size[k]
            titled[node.parent.order] |= titled[k]
    long, rank = [False] * len(nodes), [9] * len(nodes)  # whether it holds a long paragraph; the highest heading outside headers
    menus = [False] * len(nodes)
    for node in reversed(nodes[1:]):
        k, up = node.order, node.parent.order
        long[k] |= own[k] - node.link_chars >= LONG
        menus[k] |= node.tag in ("nav", "menu") or (size[k] > 0 and 2 * node.link_chars > own[k] > 0)
        if node.tag in HEADINGS and size[k]:
            rank[k] = min(rank[k], int(node.tag[1]))
        menus[up] |= menus[k]
        if not node.cut:
            long[up] |= long[k]
            if node.tag != "header":
                rank[up] = min(rank[up], rank[k])
    whole_page = any(node.tag in ("article", "main") and size[node.order] for node in nodes)
    for node in nodes[1:]:
        k, up = node.order, node.parent
        in_article[k] = node.tag == "article" or in_article[up.order]
        if node.tag == "header" and titled[k]:
            # Inside an article, or, where there is none, as the only title of a part with most of the text.
            leads = not whole_page and up.parent is not None and not menus[k] and rank[k] < rank[up.order] and 2 * (size[up.order] - size[k]) > size[0]
            node.named = "" if in_article[k] or leads else node.named
        elif (node.named == "partly" and long[k]) or (node.named == "form" and 2 * size[k] > size[0] and long[k]):
            node.named = ""
    while True:
        outer: list[Node | None] = [None] * len(nodes)  # of each node, the outermost named one that it is in
        shown, marked = own.copy(), set()
        for node in nodes[1:]:
            outer[node.order] = outer[node.parent.order] or (node if node.named and not node.cut else None)
        free = False
        for node in reversed(nodes[1:]):
            if node.cut:
                continue
            if outer[node.order] is None:
                shown[node.parent.order] += shown[node.order]
                free |= node.tag in MARKS and shown[node.order] > 0
            elif node.tag in MARKS and size[node.order]:
                marked.add(outer[node.order].order)
        named = [node for node in nodes if outer[node.order] is node and size[node.order] and node.named != "header"]
        if free:
            around = [node for node in named if node.order in marked and node.named != "comments" and 2 * size[node.order] > size[0]]
        else:
            around = [node for node in named if node.order in marked] or (named if not shown[0] else [])
        if not around:
            break
        most = max(around, key=lambda node: (size[node.order], -node.order))
        for node in nodes:  # those inside that hold the same text are around it too
            if outer[node.order] is most and size[node.order] == size[most.order] and node.named in ("other", "partly", "form", most.named):
                node.named = ""
    for node in nodes[1:]:
        node.dropped = node.cut or bool(node.named) or node.parent.dropped


def score(nodes: list[Node]) -> None:
    """Adds up the subtrees, and sets densities."""
    for node in reversed(nodes[1:]):
        if not node.dropped:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    body = nodes[0]
    linked = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if node.dropped or not node.chars:
            continue
        c, lc, t, lt = node.chars, max(node.link_chars, 1), max(node.tags, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + linked * c + math.e)
        node.density = c / t * max(math.log(c / lc * (t / lt)), 0.0) / max(math.log(base), 1e-3) if base > 1.0 + 1e-9 else c / t * max(math.log(c / lc * (t / lt)), 0.0)


def holds_title(node: Node) -> bool:
    work = [node]
    while work:
        n = work.pop()
        if not n.dropped and n.chars:
            if n.tag in HEADINGS:
                return True
            work += n.children
    return False


def around(core: Node) -> Node | None:
    """The nearest article that holds the core, else the nearest main element, else the lowest element above the core that holds a title, and those above
    it as long as they add another part with a title that isn't mostly links. None if no title is above the core."""
    above, node = [], core
    while node is not None:
        above.append(node)
        node = node.parent
    for tag in ("article", "main"):
        if (found := next((n for n in above if n.tag == tag), None)) is not None:
            return found
    k = next((k for k, n in enumerate(above) if holds_title(n)), None)
    if k is None:
        return None
    for j in range(k + 1, len(above)):
        if any(c is not above[j - 1] and 2 * c.link_chars <= c.chars and holds_title(c) for c in above[j].children):
            k = j
    return above[k]


def main_text(page: str | None) -> str:
    nodes, blocks = parse(page or "")
    unwrapped(nodes, blocks)
    if not any(node.blocks and not node.dropped for node in nodes):
        return ""
    score(nodes)
    sums = [sum(child.density for child in node.children if not child.dropped) for node in nodes]
    best = list(range(len(nodes)))  # of each subtree, the node with the largest sum
    for node in reversed(nodes[1:]):
        if not node.dropped:
            k, up = best[node.order], node.parent.order
            if sums[k] > sums[best[up]] or (sums[k] == sums[best[up]] and k != up and best[up] != up and k < best[up]):
                best[up] = k
    core = nodes[best[0]]
    threshold, node = math.inf, core
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    taken: list[int] = []
    chosen = {core.order}
    for node in nodes[1:]:
        if not node.dropped and node.density >= threshold > 0 and node is not core:
            chosen.add(best[node.order])
    container = around(core)
    belongs = [False] * len(nodes)  # to the article, outside blocks that are mostly links
    inside = [False] * len(nodes)
    for node in nodes:
        inside[node.order] = not node.dropped and (node.order in chosen or (node.parent is not None and inside[node.parent.order]))
        few_links = 2 * node.link_chars <= node.chars
        belongs[node.order] = not node.dropped and (node is container or (few_links and node.parent is not None and belongs[node.parent.order]))
        if inside[node.order] or belongs[node.order]:
            taken += node.blocks
    return "\n".join(blocks[k] for k in sorted(taken))


def extract_main_text(pages: DataFrame, html_col: str = "html", column: str = "text") -> DataFrame:
    """pages and the main text of each."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(page) for page in batch], dtype=object)

    return pages.withColumn(column, extract(html_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""HTML extraction by composite text density.

A page becomes a tree of nodes.  Every node gets its composite text density:
characters per tag, lowered by the share of link characters and link tags, against
the balance of the whole page.  What the densities decide:

1. The anchor is the node whose children have the largest sum of densities.
2. The threshold is the smallest density on the path from the body to the anchor.
3. Kept are the anchor and, of every other node that reaches the threshold, the part
   with the largest sum of child densities.  A kept part takes in what stands around
   it in the same parent (titles, bylines, short lines) while that is less than half
   of it and no link list.  Headings above the anchor on the path stay.
4. Below what is kept, navigation and link lists under the threshold go.

Names and labels decide only what density cannot: a notice, an advert or a reader's
comment is as dense as an article.  Elements and classes that say so are ruled out
before densities are summed, however much text they hold; where nothing would be
left, those that hold the anchor come back.  A class says so by a label word among its parts
(``comment-body``), unless it speaks of a state (``with-sidebar``) or of the article's
own header.  A single paragraph is judged by its element, never by its class, nor is
a box of one paragraph among an article's by a part of one.  A label within a class of the content
itself (``content-sidebar-wrap``) counts where the density is under the page's.

White space inside a block becomes one space; blocks are joined by one line feed in
page order.  Null or empty html: empty text.  Unclosed, crossed or cut-off markup is
read as browsers do (a new paragraph ends the open one, a stray end tag is dropped),
in time linear in the page, however long or deep it is.  Equal sums: the node first
in the page.  Each row is read alone; repeated rows and extra columns do no harm.
Empty table: no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import batches

# Element names and label words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
#: Never text of an article.
HIDDEN = frozenset("head form button select dialog object audio video canvas svg annotation annotation-xml".split())
#: Furniture by name; a header inside an article is the article's.
FURNITURE = frozenset("header footer aside".split())
LISTS = frozenset("nav menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = frozenset("p li blockquote h1 h2 h3 h4 h5 h6 ul ol pre td th tr tbody dd dt dl".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ("td", "th", "li", "div", "article", "section", "body", "blockquote", "button")}
LABEL = (
    r"(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|comment-list|respond|cookies?|consent|disclaimer|footer|gdpr|"
    r"header|masthead|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|promoted|related|share|sharing|sidebar|"
    r"skip|social|sponsored|sponsor|subscribe|toolbar|topbar|replies|signup|login|overlay|modal|alert)"
)
LABELS = re.compile(rf"(?:{LABEL}|adsbox|adsense|adslot|disqus|widget)$", re.I)
#: Labels only where they are the whole class.
ALONE = frozenset("legal copyright feedback responses discussion".split())
#: First parts of classes that speak of a state, and parts that speak of the content.
STATES = frozenset("with has have no not non without is js hide show hidden visible".split())
CONTENT = frozenset("content main article post entry story page body-text".split())
#: Elements that are one paragraph.
SINGLE = frozenset("p li blockquote h1 h2 h3 h4 h5 h6 pre td th dd dt figcaption".split())
ROLES = frozenset("banner contentinfo complementary search form dialog alert alertdialog toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("name", "parent", "children", "skip", "named", "part", "hint", "text", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "open_in")

    def __init__(self, name, parent, skip=False):
        self.name, self.parent, self.children, self.skip, self.named, self.part, self.hint = name, parent, [], skip, False, False, False
        self.text, self.chars, self.tags, self.link_chars, self.link_tags, self.density = "", 0, 0, 0, 0, 0.0
        self.open_in = ()  # searches upward from here that are known to find nothing


def _marks(node: Node, attributes: str) -> None:
    """Sets skip (never text), named (furniture by name or whole label), part (by a part of a class) and hint (a label within a class of the content) of a new node."""
    node.skip = node.name in HIDDEN
    node.named = node.name in FURNITURE
    if not attributes.strip():
        return
    judged = node.name not in ("body", "html", "article", "main") and node.name not in SINGLE
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            node.skip = True
        elif key == "role" and value.lower() in ROLES and node.name not in SINGLE:
            node.named = True
        elif key in ("class", "id") and judged:
            for token in value.lower().split():
                _label(node, [x for x in re.split("[_-]", token) if x])


def _label(node: Node, parts: list[str]) -> None:
    labels = [bool(LABELS.match(x)) for x in parts]
    if not parts or parts[0] in STATES and len(parts) > 1:
        return
    if all(labels) or len(parts) == 1 and parts[0] in ALONE:
        node.named = node.named or parts != ["widget"]
        node.hint = node.hint or parts == ["widget"]
    elif any(labels):
        own = not CONTENT.isdisjoint(parts)
        if own and parts[-1] in ("header", "masthead"):
            return
        if own and not labels[-1] or parts[-1] == "widget":
            node.hint = True
        else:
            node.part = True


def _above(node: Node, root: Node, ends: tuple, scope: tuple, key: str) -> Node | None:
    """The nearest of node and its ancestors named in ends, below any named in scope; what is found missing is remembered."""
    passed = []
    while node is not root and key not in node.open_in:
        if node.name in ends:
            return node
        passed.append(node)
        if node.name in scope:
            break
        node = node.parent
    for x in passed:
        x.open_in += (key,)
    return None


def tree(page: str) -> Node:
    """The page as nodes; text is kept in nodes named #text."""
    root = Node("#root", None)
    here, at, size, drawn, opened = root, 0, len(page), False, Counter()

    def add(raw: str) -> None:
        if raw:
            leaf = Node("#text", here)
            leaf.text = html.unescape(raw)
            here.children.append(leaf)

    def close(node: Node) -> Node:
        """Everything up to node ends; what is open then."""
        x = here
        while True:
            opened[x.name] -= 1
            if x is node:
                return node.parent
            x = x.parent

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                node = here
                while node.name != name:
                    node = node.parent
                here = close(node)
            continue
        if name in SAME_ENDS and (node := _above(here, root, SAME_ENDS[name], SCOPES.get(name, ()), name)):
            here = close(node)
        if name in CLOSES_P:
            if opened["p"] and (node := _above(here, root, ("p",), SCOPES["p"], "p")):
                here = close(node)
            if drawn and (node := _above(here, root, ("svg", "math"), ("foreignobject",), "svg")):  # a block ends an svg or math that was left open
                here = close(node)
        foreign = name in ("svg", "math") or opened["svg"] + opened["math"] > 0
        drawn = drawn or foreign
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        node = Node(name, here)
        _marks(node, m[3])
        here.children.append(node)
        if name not in VOID and not (foreign and m[3].endswith("/")):
            here = node
            opened[name] += 1
    return root


def inner(node: Node) -> list[Node]:
    """The element children that can hold text of the article."""
    return [c for c in node.children if not c.skip and c.name != "#text"]


def measure(root: Node) -> None:
    """Counts and density of every node, children first; what is skipped has no characters."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        link = link or node.name == "a"
        order.append((node, link))
        stack += [(c, link) for c in node.children]
    for node, link in reversed(order):
        if node.name == "#text":
            node.chars = len(" ".join(node.text.split()))
            node.link_chars = node.chars if link else 0
            continue
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        for c in node.children:
            if not c.skip:
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + (c.name != "#text")
                node.link_tags += c.link_tags + (c.name == "a")
    for node, _ in order:
        if node.name != "#text" and node.chars:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, root.link_chars / max(1, root.chars))


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_links: float) -> float:
    """Composite text density: characters per tag times the logarithm of how few of both are links, to a base that grows with links."""
    tags = max(1, tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + page_links * chars + math.e)
    few = chars / max(1, link_chars) * tags / max(1, link_tags)
    return chars / tags * math.log(max(few, 1.0 + 1e-9)) / base


def judge(root: Node) -> None:
    """Rule out what names and labels say and density cannot, then measure."""
    measure(root)
    body, marked, stack = root, [], [(root, False)]
    while stack:
        node, within = stack.pop()
        if node.name == "body":
            body = node
        node.part = node.part and not _one_of_many(node)
        if node.named and not (node.name == "header" and within) or node.part or node.hint:
            marked.append(node)
        within = within or node.name in ("article", "main")
        stack += [(c, within) for c in inner(node)]
    for node in marked:
        node.skip = node.named or node.part or 2 * node.chars < root.chars and (node.density < body.density or 2 * node.link_chars > node.chars)
    if any(node.skip for node in marked):
        measure(root)
        if not root.chars:  # what holds the text was ruled out: back comes what the anchor stands in
            ruled = [node for node in marked if node.skip]
            for node in ruled:
                node.skip = False
            measure(root)
            node, path = anchor(root)[0], set()
            while node is not None:
                path.add(id(node))
                node = node.parent
            for node in ruled:
                node.skip = id(node) not in path
            measure(root)


def _one_of_many(node: Node) -> bool:
    """Whether a node is a box of one paragraph among the paragraphs of an article."""
    blocks_in = [c for c in node.children if c.name in SINGLE]
    beside = [c for c in node.parent.children if c.name == "p"] if node.parent is not None else []
    return len(blocks_in) == 1 and len(beside) > 1 and all(c.name in SINGLE or c.name not in BLOCKS for c in node.children)


def anchor(root: Node) -> tuple[Node, float]:
    """The node with the largest sum of child densities, and the least density from the body to it."""
    body, best, most, stack = root, root, -1.0, [root]
    while stack:
        node = stack.pop()
        if node.name == "body":
            body = node
        children = inner(node)
        total = sum(c.density for c in children)
        if total > most:
            best, most = node, total
        stack += children[::-1]
    least, node = math.inf, best
    while node is not None and node is not root:
        least = min(least, node.density)
        if node is body:
            break
        node = node.parent
    return best, least if least < math.inf else 0.0


def widened(node: Node) -> Node:
    """node, or a node around it: a single line stands for its block, and a part takes in the less that stands beside it."""
    while (node.name not in BLOCKS or node.name in PARTS) and node.parent is not None:
        node = node.parent
    while (up := node.parent) is not None and up.name not in ("body", "html", "#root"):
        rest, links = up.chars - node.chars, up.link_chars - node.link_chars
        if 2 * rest >= node.chars or 2 * links > rest and rest:
            break
        node = up
    return node


def dense(root: Node, top: Node, least: float) -> list[Node]:
    """What is kept: top, headings on the path to it, and of every node with a density of ``least`` or more the node below it
    (or itself) with the largest sum of child densities, widened; in page order, none inside another."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += inner(node)[::-1]
    for node in reversed(order):
        children = inner(node)
        node.total, node.best = sum(c.density for c in children), node
        for c in children:
            if c.best.total > node.best.total:
                node.best = c.best
    path, node = set(), top
    while node is not None:
        path.add(id(node))
        node = node.parent
    taken = {id(top)}
    for node in order:
        if node.chars and node.density >= least > 0 and id(node) not in path:
            part = node.best
            taken.add(id(wide if id(wide := widened(part)) not in path else node))
        elif node.name in HEADINGS and 2 * node.link_chars <= node.chars and node.parent is not None and id(node.parent) in path and node.parent.name not in ("body", "html", "#root"):
            taken.add(id(node))
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in taken:
            out.append(node)
        else:
            stack += inner(node)[::-1]
    return out


def blocks(node: Node, least: float = 0.0, page: bool = False) -> list[str]:
    """Texts of the blocks below node, in page order, without what is skipped and without navigation under the density
    ``least``; in a whole page, any block of mostly links under it."""
    out, words = [], []

    def close():
        text = " ".join("".join(words).split())
        if text:
            out.append(text)
        words.clear()

    stack = [(node, False)]
    while stack:
        x, done = stack.pop()
        if x.name == "#text":
            words.append(x.text)
        elif done:
            close()
        elif not x.skip and not (x.density < least and 2 * x.link_chars > x.chars and (x.name in LISTS or page and x.name in BLOCKS and x.link_tags > 1)):
            if x.name in BLOCKS:
                close()
                stack.append((x, True))
            elif x.name == "br":
                words.append(" ")
            stack += [(c, False) for c in reversed(x.children)]
    close()
    return out


def main_text(page: str) -> str:
    """The article of a page as lines of text; empty if it has none."""
    root = tree(page)
    judge(root)
    if not root.chars:
        return ""
    found, least = anchor(root)
    top = widened(found)
    whole = top.name in ("body", "html", "#root")
    return "\n".join(line for x in dense(root, top, least) for line in blocks(x, least, whole))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of the main text, one row per row of pages."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)

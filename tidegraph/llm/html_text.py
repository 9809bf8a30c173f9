"""The main text of a web page by scoring its tree.

The page is parsed into a tree with the end tags that HTML lets authors leave out. Parts that are never text of
the article (scripts, forms, menus, page headers and footers, and containers whose name says sidebar, advert, comments
and so on) are taken out. Every paragraph then passes points for its length and its commas to its ancestors, all of them to
the container it stands in and a shrinking share further up; a container's points are discounted by the share of its text
that stands in links. The container with the most points, and those of its siblings that look like more of the same text, are
the article. An ``article`` or ``main`` element around them is taken as the page's own word for where the article ends.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import flat, over_texts, structs

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td figcaption".split())
CONTAINERS = frozenset("article main section div body td blockquote center".split())
DROPPED = frozenset(
    "script style noscript template head title meta link nav footer aside form fieldset button select option textarea input label iframe object embed "
    "applet svg canvas audio video map menu dialog search noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

# Names by which pages call what is not the article; compared with the words of class, id and similar attributes.
OTHER_PARTS = frozenset(
    # menus
    "menu menubar nav navbar navigation subnav sidenav breadcrumb breadcrumbs pager pagination toolbar topbar tagcloud dropdown share shares sharing social "
    # headers and footers
    "header masthead banner billboard footer copyright "
    # sidebars
    "sidebar rail widget widgets related recommended recommendations popular trending teasers "
    # notices
    "notice notices notification cookie cookies cookiebar consent gdpr disclaimer paywall interstitial popup modal overlay hidden "
    # adverts
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion outbrain taboola skyscraper "
    # forms
    "search subscribe subscription newsletter login signin signup captcha feedback "
    # readers' comments
    "comment comments commentlist disqus reply replies respond shoutbox".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# An open element of the first kind ends where one of the second starts.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
             "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
             "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
_SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}, "tr": {"table"}, "td": {"table"},
           "th": {"table"}, "thead": {"table"}, "tbody": {"table"}}
_STARTERS = frozenset().union(*_ENDED_BY.values())

DEEPEST = 512
"""Elements nested deeper are taken side by side, as browsers do; no text is lost."""
LINK_LIST = 0.6
"""A list or table within the article of which more text than this share stands in links is a menu."""
SIBLING = 0.2
"""Share of the best container's points that makes a sibling part of the article."""


class Node:
    """An element: children are elements and strings."""

    __slots__ = ("name", "attributes", "parent", "depth", "children", "points", "text", "linked")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list = []
        self.points, self.text, self.linked = 0.0, 0, 0


def parse(page: str) -> Node:
    """The tree of a page. Stray end tags are ignored, and what is open at an outer end tag ends with it."""
    root = here = Node("#root", "", None)
    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            here.children.append(page[at:])
            break
        if token.start() > at:
            here.children.append(page[at : token.start()])
        at, name = token.end(), token.group(2)
        if name is None:
            continue
        name = name.lower()
        if token.group(1):
            here = _closed(here, name)
            continue
        here = _made_room(here, name)
        attributes = token.group(3)
        node = Node(name, attributes, here)
        here.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|</{name}\Z", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif name not in VOID and not (attributes.endswith("/") and name not in BLOCKS) and node.depth < DEEPEST:
            here = node
    return root


def _closed(here: Node, name: str) -> Node:
    """Where the text goes on after an end tag."""
    node = here
    while node.parent is not None:
        if node.name == name or name in HEADINGS and node.name in HEADINGS:
            return node.parent
        # The end of an inline element does not reach out of the block it is in.
        if name not in BLOCKS and node.name in BLOCKS:
            return here
        node = node.parent
    return here


def _made_room(here: Node, name: str) -> Node:
    """Ends the elements that cannot hold the one that starts."""
    if name in BLOCKS:
        node = here
        while node.parent is not None and (node.name not in BLOCKS or node.name == "p"):
            if node.name == "p":
                here = node.parent
                break
            node = node.parent
        if here.name in HEADINGS and name in HEADINGS:
            here = here.parent
    if name in _STARTERS:
        node = here
        while node.parent is not None:
            if name in _ENDED_BY.get(node.name, ()):
                here = node.parent
            elif any(node.name in scope for kind, scope in _SCOPES.items() if name in _ENDED_BY[kind]):
                break
            node = node.parent
    return here


def _attributes(node: Node) -> dict[str, str]:
    if not node.attributes.strip(" /"):
        return {}
    return {m.group(1).lower(): html.unescape(m.group(2) or m.group(3) or m.group(4) or "") for m in _ATTRIBUTE.finditer(node.attributes)}


def _within(node: Node, names: frozenset | set) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.name in names:
            return True
    return False


_ARTICLES = frozenset(("article", "main"))


def _is_other(node: Node) -> bool:
    """Whether an element is none of the article's, by its kind and its names."""
    if node.name in DROPPED or node.name == "header" and not _within(node, _ARTICLES):
        return True
    if not node.attributes:
        return False
    attributes = _attributes(node)
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDING.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in DROPPED_ROLES:
        return True
    words = _names(attributes)
    if node.name in ("html", "body", "article", "main"):
        # A page or an article may carry any name; an article element can also be a reader's comment or a teaser.
        return node.name == "article" and bool(words & _NO_ARTICLE)
    if not words & OTHER_PARTS or words & {"with", "has", "no", "without"}:
        return False
    if words & OTHER_PARTS == {"header"} and words & {"article", "entry", "post", "story", "content"}:
        return False
    return not _holds_article(node)


_NO_ARTICLE = frozenset("comment comments reply teaser related promo sponsored ad ads".split())


def _holds_article(node: Node) -> bool:
    """Whether an element is the frame of the page's article, whatever its name."""
    return any(n.name in _ARTICLES and not (_names(_attributes(n)) & _NO_ARTICLE) for n in _ordered(node)[1:])


def _names(attributes: dict[str, str]) -> set[str]:
    return {w.lower() for key in ("class", "id", "itemprop", "data-component") for w in _NAME_WORDS.findall(attributes.get(key, ""))}


def _pruned(root: Node) -> None:
    """Takes out what is not the article's; headings of an article's own header stay."""
    stack = [root]
    while stack:
        node = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
            elif _is_other(child):
                # The place of what is gone still parts the texts on its two sides, if it was a block.
                if child.name in BLOCKS:
                    kept.append(Node("hr", "", node))
            else:
                kept.append(child)
                stack.append(child)
        node.children = kept


def _ordered(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def _measured(nodes: list[Node]) -> None:
    """Length of the text, and of that in links, below every element."""
    for node in reversed(nodes):
        node.text += sum(_length(c) for c in node.children if isinstance(c, str))
        if node.name == "a":
            node.linked = node.text
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked


def _link_share(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _own_text(node: Node) -> str:
    """Text of a paragraph without that of the blocks inside it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.name not in BLOCKS:
            stack.extend(reversed(child.children))
    return "".join(out)


def _scored(nodes: list[Node]) -> None:
    """Passes the points of paragraphs, and of text that stands in a container by itself, to the containers above."""
    for node in nodes:
        if node.name not in PARAGRAPHS and node.name not in CONTAINERS:
            continue
        own = _own_text(node)
        length = _length(own)
        if not length:
            continue
        points = (1 + own.count(",") + own.count("、") + own.count("，") + length / 100) * (1 - _link_share(node))
        above, share = (node if node.name in CONTAINERS else node.parent), 1
        while above is not None and above.parent is not None:
            if above.name in CONTAINERS:
                above.points += points / share
                share = 2 if share == 1 else share + 2
            above = above.parent
    for node in nodes:
        node.points *= 1 - _link_share(node)


def _article(nodes: list[Node]) -> list[Node]:
    """The best container with the siblings that belong to it, in page order."""
    marked = [n for n in nodes if n.name in _ARTICLES]
    held = [n for n in nodes if n.name in CONTAINERS and n.text]
    if not held or marked and not any(n.text for n in marked):
        return []
    # Of equal containers an article, else the outer one is taken.
    best = max(held, key=lambda n: (n.points, n.name in _ARTICLES))
    whole, node = None, best
    while node is not None:
        if node.name in _ARTICLES:
            whole = node
            if node.name == "article":
                break
        node = node.parent
    if whole is not None:
        best = whole
    if best.name == "body" or best.parent is None or best.parent.name == "#root":
        return [best]
    least, out = max(best.points * SIBLING, 1.0), []
    for child in best.parent.children:
        if isinstance(child, str):
            continue
        same = child.name in CONTAINERS and child.name not in ("td",) and child.points >= least and (whole is None or child.name == best.name)
        text = whole is None and child.name in (PARAGRAPHS | HEADINGS) and child.text and _link_share(child) < 0.25
        if child is best or same or text:
            out.append(child)
    return out


def _blocks(part: Node) -> list[str]:
    """Texts of the blocks below an element, white space as single spaces."""
    out, line = [], []

    def end():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [part]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(html.unescape(item))
        elif item.name == "br":
            line.append(" ")
        elif item.name in BLOCKS:
            end()
            if item.name in ("ul", "ol", "dl", "table") and item is not part and _link_share(item) > LINK_LIST:
                continue
            stack.append(None)
            stack.extend(reversed(item.children))
        else:
            stack.extend(reversed(item.children))
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends; '' if there is none."""
    if not page:
        return ""
    root = parse(page)
    _pruned(root)
    nodes = _ordered(root)
    _measured(nodes)
    _scored(nodes)
    # A page without any container is all text, one whose article is empty has none.
    parts = _article(nodes) or ([root] if not any(n.name in CONTAINERS for n in nodes) else [])
    return "\n".join(block for part in parts for block in _blocks(part))


TEXTS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extracted(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``pages``, or ``keep``) and ``result``: the main ``text`` of every page and ``n_chars``, its code points.

    A null or empty page, and one without text outside menus and the like, has the empty text. Equal pages have equal texts, row by
    row. Pages are parsed whole, one at a time, in batches that Spark bounds by bytes.
    """
    def make():
        def work(bodies):
            texts = [main_text(body.decode(errors="replace") if body is not None else None) for body in bodies]
            return structs(text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))
        return work

    return over_texts(pages, page, TEXTS, make, keep)


def main_texts(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``extracted`` with the columns side by side."""
    return flat(extracted(pages, page, keep))

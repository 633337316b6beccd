"""Main text of web pages by tree scoring.

A page becomes a tree with the usual implied end tags. Blocks of text (paragraphs, and text that
stands free in a container) get points for their length and commas, discounted by the share of
their text inside links, and pass them up: all to the parent, half to its parent, a shrinking
part further up. The container with most points, discounted by its own link density, is the
best; if it lies in an article element, the page's outermost article elements take its place. Its
siblings are kept unless most of their text is links. Scripts, forms, menus, headers, footers,
sidebars, notices, adverts and reader comments are cut out of the tree before, by tag, role,
state, and words of class and id. A container cut by class or id alone is taken back if it turns
out to be the wrapper of the article, and inline elements go by class or id only where they
stand alone: a link in a sentence stays.

Defined results: a null, empty or textless page gives an empty text; a page without markup is
one block; a very long page is read whole, alone in its chunk; broken markup is read as far as it
goes; of two containers that score alike the first is the best; rows that repeat an identifier
get a row each; a null identifier or address stays null; an empty table gives an empty result;
columns of any other name are left out of sight.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import chunks

SCHEMA = "page_id BIGINT, url STRING, text STRING, n_chars BIGINT"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
DROP = RAW | frozenset("head nav footer aside form button select option input label fieldset menu dialog canvas object audio video map datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
#: Start tags that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: Start tag: open elements that it ends, and those that it does not look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("table td th caption button article section div body html li blockquote".split())
DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id that name what isn't the article.
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside footer comment comments disqus respond replies "
    "share sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget toolbar login masthead skip".split()
)
KEEP_WORDS = frozenset("article content main body post entry story text".split())
#: Words that wrappers of whole pages bear too ("with-sidebar", "nav-open").
LAYOUT_WORDS = frozenset("nav navbar navigation menu menus sidebar sidebars aside footer header toolbar banner masthead".split())
#: With one of these, any word but of a name of its own speaks against a container.
STRICT_WORDS = frozenset("ad ads comment comments sidebar nav menu footer related".split())
#: A class or id with one of these tells a state ("comments-open", "with-sidebar", "no-ads"), not what an element is.
STATE_WORDS = frozenset("open closed on off enabled disabled no not has with without".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
GOOD_TAG = {"article": 30.0, "main": 20.0, "div": 5.0, "section": 5.0, "blockquote": 1.0, "td": 1.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_TAG_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "cut", "links", "name", "parent", "score", "size", "words")

    def __init__(self, name: str, parent: Node | None, words: frozenset[str] = frozenset()):
        self.name, self.parent, self.words = name, parent, words
        self.children: list[Node | str] = []
        self.score = 0.0
        self.size = self.links = 0
        self.cut = ""


def _names(attrs: dict[str, str]) -> list[frozenset[str]]:
    """The words of each class and of the id, but for names that tell a state."""
    names = [frozenset(w.lower() for w in _WORD.findall(x)) for x in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    return [x for x in names if not x & STATE_WORDS]


def _dropped(name: str, attrs: dict[str, str], inside_article: bool) -> tuple[str, frozenset[str]]:
    """Whether an element goes, and its words.

    "tag": by tag, role or state; "inline": by class or id, if it stands alone; "layout", "kept", "words": by
    class and id (layout words only; beside a name of the article; else).
    """
    names = _names(attrs) if attrs else []
    words = frozenset().union(*names)
    if name in DROP or (name == "header" and not inside_article):
        return "tag", words
    if name in ("html", "body") or not attrs:
        return "", words
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in DROP_ROLE or re.search(r"display:\s*none", attrs.get("style", "")):
        return "tag", words
    bad = words & DROP_WORDS
    header = "header" in words and name not in INLINE and not inside_article
    own = any(x & KEEP_WORDS and not x & DROP_WORDS for x in names)
    if own and name in ("div", "section", "article", "main") and not bad & STRICT_WORDS:
        bad = frozenset()
    if not bad and not header:
        return "", words
    if name in INLINE:
        return "inline", words
    if own:
        return "kept", words
    return ("words" if bad - LAYOUT_WORDS else "layout"), words


def parse(page: str) -> Node:
    """The page's tree without what is dropped by tag, role or state; what class and id cut is marked."""
    root = Node("html", None)
    stack = [root]
    skip = 0  # open elements from the first dropped one on
    articles = 0
    at, n = 0, len(page)

    def pop(to: int) -> None:
        nonlocal skip, articles
        for node in stack[to:]:
            articles -= node.name in ("article", "main")
        del stack[to:]
        if skip and len(stack) <= skip:
            skip = 0

    def end_head() -> None:
        while stack[-1].name == "head":
            pop(len(stack) - 1)

    def add(text: str) -> None:
        if skip and stack[-1].name == "head" and not text.isspace() and text:
            end_head()
        if text and not skip:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        comment, other, close, name = m.groups()
        if comment:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        stop = _TAG_END.match(page, m.end())
        end = stop.end() if stop else page.find(">", m.end()) + 1 or n
        at = end
        if other:
            continue
        name = name.lower()
        if close:
            if name in ("body", "html"):
                end_head()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    pop(k)
                    break
                if name in INLINE and stack[k].name not in INLINE:
                    break
            continue
        if name not in IN_HEAD:
            end_head()
        if name in ("html", "body") and (not skip or stack[-1].name == "head"):
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    pop(k)
                    break
                if stack[k].name in SCOPE:
                    break
        if name in ENDS:
            targets, limit = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in limit:
                    break
                if stack[k].name in targets:
                    pop(k)
                    if name != "tr":
                        break
        inside = page[m.end() : end - 1]
        if name in RAW:
            if not inside.endswith("/") or name in ("script", "style", "title", "textarea"):
                found = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, end)
                at = n if not found else page.find(">", found.start()) + 1 or n
            continue
        if name in VOID:
            if not skip:
                stack[-1].children.append(" ")
            continue
        attrs = {a.lower(): v.strip("\"'") for a, v in _ATTR.findall(inside)} if inside.strip() else {}
        drop, words = _dropped(name, attrs, articles > 0) if not skip else ("", frozenset())
        node = Node(name, stack[-1], words)
        if drop != "tag":
            node.cut, drop = drop, ""
        if not skip and not drop:
            stack[-1].children.append(node)
        if inside.endswith("/") and name not in INLINE | PARAGRAPH | {"div", "section", "article"}:
            continue
        if drop:
            skip = len(stack)
        stack.append(node)
        articles += name in ("article", "main")
    return root


def _measure(root: Node) -> list[Node]:
    """Fills in text and link sizes; the nodes, children after parents."""
    order = [root]
    for node in order:
        order.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.size += len(_BLANK.sub(" ", c).strip())
            else:
                node.size += c.size
                node.links += c.size if c.name == "a" else c.links
    return order


def _wrappers(order: list[Node]) -> set[Node]:
    """The cut containers that hold the article: they go back into the tree.

    One is taken back if it has a name of the article too, or an article element while none is left
    outside, and more text outside links than all that isn't cut; or if only its layout words speak
    against it and it has most of the page's text and no article element is left outside.
    """
    prose = lambda node: node.size - node.links
    near: dict[Node, Node | None] = {order[0]: None}  # the cut element that a node lies in, itself included
    own: dict[Node | None, int] = {None: prose(order[0])}  # text of a cut element, or of the page, outside deeper cut ones
    articles: set[Node | None] = set()
    for node in order[1:]:
        above = near[node.parent]
        near[node] = node if node.cut else above
        if node.cut:
            own[above] -= prose(node)
            own[node] = prose(node)
        if node.name in ("article", "main") and prose(node) > 0 and not node.words & DROP_WORDS:
            articles.add(near[node])
    back: set[Node] = set()
    left, outside = own[None], None in articles
    for node in own:
        if node is None or node.name in INLINE or node.name in PARAGRAPH or not ((above := near[node.parent]) is None or above in back):
            continue
        named = node.cut == "kept" or (node in articles and not outside)
        if named and prose(node) > left or node.cut == "layout" and not outside and 2 * prose(node) > prose(order[0]):
            back.add(node)
            left += own[node]
            outside = outside or node in articles
    return back


def _settle_inline(order: list[Node]) -> None:
    """An inline element marked by class or id is cut only if its block has no text but that of such elements."""
    alone: dict[Node, bool] = {}
    for node in order:
        if node.cut == "inline":
            block = node.parent
            while block.parent is not None and block.name in INLINE:
                block = block.parent
            if block not in alone:
                alone[block] = not _own_text(block, but_marked=True)
            node.cut = "words" if alone[block] else ""


def pruned(order: list[Node]) -> list[Node]:
    """The nodes left once what class and id cut is out of the tree, sizes put right."""
    _settle_inline(order)
    if not any(node.cut for node in order):
        return order
    back = _wrappers(order)
    lost: dict[Node, tuple[int, int]] = {}
    for node in reversed(order):
        size, links = (node.size, node.links) if node.cut and node not in back else lost.get(node, (0, 0))
        if size and node.parent is not None:
            a, b = lost.get(node.parent, (0, 0))
            lost[node.parent] = a + size, b + (size if node.name == "a" else links)
    for node, (size, links) in lost.items():
        node.size -= size
        node.links -= links
    left = order[:1]
    for node in left:
        if any(isinstance(c, Node) and c.cut and c not in back for c in node.children):
            node.children = [c for c in node.children if isinstance(c, str) or not c.cut or c in back]
        left.extend(c for c in node.children if isinstance(c, Node))
    return left


def _own_text(node: Node, but_marked: bool = False) -> str:
    """The text of a node and of its inline descendants (but those marked by class or id)."""
    parts, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.name in INLINE and not (but_marked and c.cut):
            todo.extend(reversed(c.children))
    return _BLANK.sub(" ", "".join(parts)).strip()


def _discount(node: Node) -> float:
    return 1 - node.links / node.size if node.size else 0.0


def score(order: list[Node]) -> None:
    """Blocks of text pass their points up."""
    for node in order:
        if node.name in INLINE or not node.size:
            continue
        text = _own_text(node)
        if not text or not node.size:
            continue
        points = (1 + text.count(",") + text.count("、") + min(len(text) / 100, 3)) * _discount(node)
        up, part = (node.parent if node.name in PARAGRAPH and node.parent else node), 1.0
        step = 1
        while up is not None:
            up.score += points * part
            up, step = up.parent, step + 1
            part = 0.5 if step == 2 else 1 / (3 * step)


def best(order: list[Node]) -> Node | None:
    top, most = None, 0.0
    for node in order:
        if node.score > 0 and node.name not in INLINE:
            value = (node.score + GOOD_TAG.get(node.name, 0.0) + (10 if node.words & KEEP_WORDS else 0)) * _discount(node)
            if value > most:
                top, most = node, value
    return top


def kept(top: Node, order: list[Node]) -> list[Node | str]:
    """What stays, in page order: the outermost articles, or the best container with its siblings."""
    up, inside = top, False
    while up is not None:
        inside = inside or up.name in ("article", "main")
        up = up.parent
    if inside:
        outer: set[Node] = set()
        for node in order:  # parents come first
            if node.parent in outer or node.name in ("article", "main"):
                outer.add(node)
        whole = [n for n in order if n in outer and n.parent not in outer and n.size and _discount(n) > 0.5]
        first = {n: k for k, n in enumerate(_in_page_order(order[0]))}
        return sorted(whole, key=first.__getitem__)
    if top.parent is None:
        return [top]
    return [c for c in top.parent.children if c is top or isinstance(c, str) or c.name in INLINE or (c.size and _discount(c) > 0.5)]


def _in_page_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks under some nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _BLANK.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = []
    for node in reversed(nodes):
        todo += [node] if isinstance(node, str) or node.name in INLINE else [None, node]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif c.name in INLINE:
            todo.extend(reversed(c.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(c.children))
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a page, its blocks joined by one space."""
    if not page or page.isspace():
        return ""
    order = pruned(_measure(root := parse(page)))
    score(order)
    top = best(order)
    return " ".join(blocks(kept(top, order) if top is not None else [root]))


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, pages in chunks(batches, "html"):
        texts = [extract(p.decode("utf-8", "replace")) for p in pages]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(_extract, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))

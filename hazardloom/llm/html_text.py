"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to the containers above them: all to the
nearest, half to the next, a third and so on further up.  A container's sum is discounted by
its link density; the best container wins, an article around it is preferred to a part of
it, and siblings that score well beside it are kept too.  Menus, footers and other tags that
never hold an article are taken out of the tree before scoring.  Forms, and containers whose class or id
names a notice, advert, sidebar, comments or the like, only pass a fifth of their points: they
go unless the best container lies inside.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardloom.llm.chunks import small_slices

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "article", "main", "section", "div", "td", "center", "details", "form", "fieldset"}
BLOCKS = CONTAINERS | set(
    "address aside blockquote caption dd dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "legend li menu nav ol p pre summary table tbody tfoot th thead tr ul head option select svg".split()
)
DROPPED = set(
    "nav footer aside script style noscript template iframe select option svg head menu dialog object "
    "canvas audio video map input textarea".split()
)
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
# Text beside a form's fields; amid a sentence it is text like any other.
FIELD_TEXT = {"label", "button", "legend"}
# Words of class and id that name what isn't the article,
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner "
    "sidebar side aside rail menu nav navbar navigation navi breadcrumb breadcrumbs crumbs topbar toolbar footer foot "
    "masthead comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget widgets pagination pager skip hidden copyright".split()
)
COMMENT_MARKS = {"comment", "comments", "commentlist", "disqus", "replies"}
# words that may follow them in a name, such as "related-posts" or "comment_body",
FOLLOWERS = set(
    "area bar block body box button buttons container content form frame group holder icons inner item items left line link "
    "links list media message module panel posts articles stories reading right row section slot text thread top bottom "
    "unit wrap wrapper zone".split()
)
# and words in front that make a name one of the page's state, such as "has-sidebar".
STATES = {"has", "with", "no", "is", "without", "hide", "show"}
MARKED_SHARE = 0.2
# Points of a text that lies in nothing but marked containers, without an article's own tags, to be an article.
LONE_POINTS, LONE_SHARE = 5.0, 0.6
# Containers further up get less than a sixtieth of a paragraph's points; they get none.
FURTHEST = 60
PROSE = {"p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure"}
# Of these, a title block inside an article may bear one.
HEADS = {"header", "head", "masthead", "banner"}
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPES = {"ul", "ol", "dl", "table", "body", "article", "section", "div", "html"}
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "items", "kept", "score", "chars", "link_chars", "marked", "below_mark", "in_article", "taken", "container")

    def __init__(self, tag: str, parent: Node | None, kept: bool = True, marked: bool = False):
        self.tag, self.parent, self.kept, self.marked = tag, parent, kept, marked
        self.items: list = []
        self.score, self.chars, self.link_chars, self.taken = 0.0, 0, 0, False
        self.below_mark = marked or (parent is not None and parent.below_mark)
        self.container = self if tag in CONTAINERS or parent is None else parent.container  # the nearest
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _names(attributes: dict[str, str]) -> list[list[str]]:
    """The words of every class and id name."""
    both = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return [parts for name in both.split() if (parts := [w.lower() for w in NAME_PARTS.findall(name) if not w.isdigit()])]


def _named(parts: list[str], marks: set[str]) -> bool:
    """Whether a name is one of a marked thing: its last word says so, or its first and only followers after it."""
    if parts[0] in STATES:
        return False
    while len(parts) > 1 and parts[-1] in FOLLOWERS:
        parts = parts[:-1]
    return parts[-1] in marks


def _kept(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not in_article):
        return False
    if tag in ("html", "body") or not attributes:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return False
    if attributes.get("role", "").lower() in DROPPED_ROLES and tag not in ("article", "main", "form"):
        return False
    return not re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I)


def _marked(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in ("form", "fieldset"):
        return True
    if tag in ("html", "body") or not attributes:
        return False
    marks = COMMENT_MARKS if tag in ("article", "main") else MARKS - HEADS if in_article else MARKS | HEADS
    return any(_named(parts, marks) for parts in _names(attributes))


def parse(html: str) -> Node:
    """A light tree: nodes hold child nodes and decoded text in page order."""
    root = Node("html", None)
    top, at, size = root, 0, len(html)
    opened: Counter = Counter()  # open elements by tag, so that nothing is looked for in vain

    def leave(to: Node) -> Node:
        up = top
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent
        return to

    while at < size:
        found = MARK.search(html, at)
        end = found.start() if found else size
        if end > at:
            top.items.append(unescape(html[at:end]))
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if not opened[tag]:
                continue
            up = top
            while up.parent is not None and up.tag != tag:
                # A stray inline end tag doesn't close blocks.
                if tag not in BLOCKS and up.tag in BLOCKS:
                    up = root
                    break
                up = up.parent
            if up.parent is not None:
                top = leave(up.parent)
            continue
        raw = found[3] or found[6] or ""
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
            at = close.end() if close else size
            continue
        if tag == "br" or tag == "hr":
            top.items.append("\n")
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            # A block ends an open paragraph, and list items and cells end one another.
            ended, up, to = IMPLIED_END.get(tag, set()) | {"p"}, top, top
            if any(opened[t] for t in ended):
                while up.parent is not None and up.tag not in SCOPES:
                    if up.tag in ended:
                        to = up.parent
                    up = up.parent
                top = leave(to)
        attributes = _attributes(raw)
        node = Node(tag, top, top.kept and _kept(tag, attributes, top.in_article), _marked(tag, attributes, top.in_article))
        top.items.append(node)
        if not raw.rstrip().endswith("/") or tag in BLOCKS:
            top = node
            opened[tag] += 1
    return root


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(nearest block, text, characters in links) of every kept run of text between block borders, in page order."""
    out, parts, linked = [], [], 0

    def close(block: Node) -> None:
        nonlocal parts, linked
        if parts and (text := " ".join("".join(parts).split())):
            out.append((block, text, min(linked, len(text))))
        parts, linked = [], 0

    stack = [(root, iter(root.items), root, False)]
    while stack:
        node, items, block, in_link = stack[-1]
        for item in items:
            if isinstance(item, str):
                parts.append(item)
                linked += len(item.strip()) if in_link else 0
                continue
            if not item.kept:
                if item.tag in BLOCKS:
                    close(block)
                continue
            if item.tag in BLOCKS:
                close(block)
                stack.append((item, iter(item.items), item, in_link))
            else:
                stack.append((item, iter(item.items), block, in_link or item.tag == "a"))
            break
        else:
            stack.pop()
            if node is block:
                close(block)
    return out


def _amid_text(node: Node) -> bool:
    """Whether an element stands between other words of its parent."""
    return any(isinstance(i, str) and i.strip() for i in node.parent.items) and node.parent.tag != "form"


def _pass_points(blocks: list[tuple[Node, str, int]]) -> dict[int, Node]:
    """Containers with points, by id; a block gives all to its nearest, half to the next, and so on."""
    scored: dict[int, Node] = {}
    for block, text, linked in blocks:
        block.chars += len(text)
        block.link_chars += linked
        heading = re.fullmatch("h[1-6]", block.tag)
        points = 0.0 if heading else (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        points *= MARKED_SHARE if block.below_mark else 1
        share, up = 1, block.container
        while up is not None and share <= FURTHEST:
            up.score += points / share
            share += 1
            scored[id(up)] = up
            up = up.parent and up.parent.container
    return scored


def _in_order(root: Node) -> list[Node]:
    """Every kept element, parents before children."""
    out = [root]
    for node in out:
        out.extend(i for i in node.items if isinstance(i, Node) and i.kept)
    return out


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by one space; empty if there is none.  Linear in the page's length and depth."""
    if not html or not html.strip():
        return ""
    root = parse(html)
    order = _in_order(root)
    for node in order:
        if node.tag in FIELD_TEXT and not _amid_text(node):
            node.kept = False
    blocks = _blocks(root)
    scored = _pass_points(blocks)
    order = _in_order(root)
    for node in reversed(order[1:]):
        node.parent.chars += node.chars
        node.parent.link_chars += node.link_chars
    if not scored:
        return ""

    def worth(node: Node) -> float:
        return node.score * (1 - node.link_chars / max(1, node.chars))

    best = max(scored.values(), key=worth)
    up = best
    while up is not None:
        if up.tag == "article" or (up.tag == "main" and best.tag != "article"):
            best = up
        up = up.parent
    if best.below_mark:
        # Nothing better outside: it takes an article's own tags, or most of the page's text.
        own = best.in_article or any(n.tag in ("article", "main", "h1") and n.below_mark for n in order)
        large = best.score >= LONE_POINTS * MARKED_SHARE and best.chars >= LONE_SHARE * root.chars
        if not own and not large:
            return ""
    up = best
    while up is not None:  # what holds the article isn't what its name says
        up.marked = False
        up = up.parent
    best.taken = True
    if best.parent is not None:
        before = True
        for item in best.parent.items:
            before = before and item is not best
            if isinstance(item, Node) and item.kept and not item.marked and item is not best and item.chars:
                dense = item.link_chars / item.chars
                title = before and re.fullmatch("h[1-6]", item.tag)
                good = item.tag in CONTAINERS and worth(item) >= max(3.0, 0.2 * worth(best))
                if dense < 0.25 and (title or good or (item.tag in PROSE and item.chars >= 40)):
                    item.taken = True
    for node in order[1:]:
        node.below_mark = node.marked or (node.parent.below_mark and node.parent.parent is not None)
        node.taken = node.taken or node.parent.taken
    return " ".join(text for block, text, _ in blocks if block.taken and not block.below_mark)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, in one map stage.

    A null or empty page has an empty text; broken markup is read as far as it goes; repeated
    rows each come out; other columns are not read.  An article inside containers with misleading names
    or a form around the page stays, and so do labels and buttons amid a sentence.
    """

    def extract(batches):
        for batch in batches:
            for part in small_slices(batch):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                arrays = [part.column(0), part.column(1), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "url", "text"])

    source = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (url_col, "url"), (html_col, "html"))])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    found = source.mapInArrow(extract, f"id {kinds['id']}, url {kinds['url']}, text string")
    return found.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars")
    )

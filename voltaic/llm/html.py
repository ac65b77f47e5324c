"""Main-text extraction from HTML by tree scoring (operator 10).

A page becomes a tree of elements (missing end tags are implied, as browsers do). Elements that are never
article text go with all they hold: scripts, styles, forms, navigation, page headers, footers, sidebars,
hidden parts, and elements whose role, class or id names a menu, notice, advert or reader comments. Every block
of text passes ``1 + commas + length / 100`` points to its parent, half of that to the grandparent and less to
higher ancestors (five levels); a container's points are discounted by the share of its text in links. The
best container is kept (the ``article`` or ``main`` that holds it, if any), otherwise with all other text of the nearest
element above it that holds more than it, but for blocks that are links by more than half.

Blocks come out in page order, character references decoded, white space collapsed, one newline apart; no
block is shortened or left out. A line break is white space. Null or empty html, or a page without text,
gives an empty text. A page cut short keeps what it holds; an unfinished tag at its end is markup.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select dialog menu object canvas audio "
                          "video fieldset label datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section "
                     "summary table ul".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
                "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("table td th caption ul ol dl html body button object article section div main aside nav".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar "
                  "form status tablist".split())
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus disclaimer discussion footer footnav gdpr hidden login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup privacy promo promotion related "
    "replies respond share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar topbar widget widgets".split())
LIKELY = frozenset("article body content entry main post story text".split())
KEPT_TAGS = frozenset("html body article main".split())
SEMANTIC = ("article", "main")


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "score", "text", "linked")

    def __init__(self, tag, parent, drop):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.parts: list = []          # strings and nodes in page order
        self.score, self.text, self.linked = 0.0, 0, 0


def unwanted(tag: str, attrs: str, parents: Node) -> bool:
    if tag in DROPPED:
        # a header inside the article is its headline
        return not (tag == "header" and within(parents, SEMANTIC))
    if not attrs or attrs.isspace():
        return False
    got = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(attrs)}
    style = got.get("style", "").replace(" ", "").lower()
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style \
            or "visibility:hidden" in style or ROLES & set(got.get("role", "").lower().split()):
        return True
    names = {w.lower() for w in WORD.findall(f"{got.get('class', '')} {got.get('id', '')}")}
    return bool(names & UNLIKELY) and tag not in KEPT_TAGS and not (names & LIKELY and not names & {"comment", "comments", "ad", "ads"})


def within(node, tags) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(html: str) -> Node:
    root = here = Node("html", None, False)
    at, n = 0, len(html)

    def close(tags, bound):
        """Leaves the nearest open element of ``tags`` unless one of ``bound`` is nearer."""
        nonlocal here
        x = here
        while x is not root and x.tag not in tags:
            if x.tag in bound:
                return
            x = x.parent
        if x is not root:
            here = x.parent

    while at < n:
        m = TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            here.parts.append(html[at:end])
        if not m:
            break
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag == "br":
                here.parts.append(" ")
            elif tag not in VOID and tag not in ("html", "body"):
                close({tag}, ("td", "th", "table") if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "div", "article", "section", "main") else ())
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in SIBLING_ENDS:
            for _ in range(2 if tag == "tr" else 3 if tag in ("tbody", "tfoot") else 1):
                close(SIBLING_ENDS[tag], SCOPE - SIBLING_ENDS[tag])
        if tag in VOID:
            here.parts.append(" " if tag in INLINE else Node(tag, here, False))
            continue
        node = Node(tag, here, here.drop or unwanted(tag, attrs, here))
        here.parts.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = n if stop is None else min(n, (html.find(">", stop.start()) + 1) or n)
            continue
        if not attrs.rstrip().endswith("/") or tag in CLOSES_P:
            here = node
    return root


def walk(node: Node):
    """(node, None) on entering and (None, node) on leaving every kept node, (text, node) for its text."""
    stack = [(node, iter(node.parts))]
    yield node, None
    while stack:
        top, parts = stack[-1]
        for x in parts:
            if isinstance(x, str):
                yield x, top
            elif not x.drop:
                yield x, None
                stack.append((x, iter(x.parts)))
                break
        else:
            stack.pop()
            yield None, top


def blocks(node: Node):
    """(block element, its text, the share of it in links) of the kept text under ``node``, white space collapsed."""
    text: list = []
    open_blocks = [node]
    inside, size, linked = 0, 0, 0

    def flush():
        nonlocal size, linked
        got, share = " ".join(unescape("".join(text)).split()), linked / max(1, size)
        text.clear()
        size = linked = 0
        return got, share

    for x, owner in walk(node):
        if isinstance(x, str):
            text.append(x)
            n = len(x.strip())
            size += n
            linked += n if inside else 0
            continue
        edge = x if x is not None else owner
        if edge.tag in INLINE:
            if edge.tag == "a":
                inside += 1 if x is not None else -1
            continue
        got, share = flush()
        if got:
            yield open_blocks[-1] if open_blocks else node, got, share
        if x is not None:
            if x is not node:
                open_blocks.append(x)
        elif open_blocks:
            open_blocks.pop()


def measure(root: Node) -> list[Node]:
    """Adds up text and link text of every node, passes the points and gives the scored containers."""
    inside = 0
    for x, owner in walk(root):
        if isinstance(x, str):
            size = len(x.strip())
            owner.text += size
            owner.linked += size if inside else 0
        elif x is not None:
            inside += x.tag == "a"
        else:
            inside -= owner.tag == "a"
            if owner.parent is not None:
                owner.parent.text += owner.text
                owner.parent.linked += owner.linked
    scored: dict[int, Node] = {}
    for block, text, _ in blocks(root):
        points, up = 1 + text.count(",") + len(text) / 100, block
        if block.tag in ("p", "pre", "td", "blockquote", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"):
            up = block.parent or block
        if block.linked > 0.5 * max(1, block.text):
            points *= 0.1
        for level in range(5):
            if up is None:
                break
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[id(up)] = up
            up = up.parent
    return list(scored.values())


def value(node: Node) -> float:
    return node.score * (1 - min(1.0, node.linked / max(1, node.text)))


def main_text(html: str | None) -> str:
    if not html or html.isspace():
        return ""
    root = parse(html)
    scored = measure(root)
    if not scored:
        return ""
    best = max(scored, key=value)
    x = best
    semantic = None
    while x is not None:
        if x.tag in SEMANTIC and (semantic is None or semantic.tag == "main" or x.tag == "article"):
            semantic = x
        x = x.parent
    if semantic is not None:
        return "\n".join(t for _, t, _ in blocks(semantic))
    top = best
    while top.parent is not None and top.text == best.text:
        top = top.parent
    own = {id(x) for x, _ in walk(best) if isinstance(x, Node)}
    return "\n".join(t for block, t, share in blocks(top) if share <= 0.5 or id(block) in own)


def _extract(batches):
    for batch in batches:
        html = batch.column("html")
        for lo in range(0, batch.num_rows, 256):
            part = html.slice(lo, 256).to_pylist()
            text = [main_text(h) for h in part]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, 256), batch.column("url").slice(lo, 256),
                                              pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                             names=["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

"""Main text of web pages by consensus paths of their hosts.

A page's elements form a tree; a container's path is the chain of its ancestors' tags and classes with digits taken out. Each page
scores its containers and votes for the path of the best. The votes are counted per host in Spark, and every page of the host is
extracted again from its elements on the winning path; a page without such elements falls back on its own best container. The path
only finds the article: the text is that of the article around it, up to the page's frame.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.common import in_pieces, release, settings, staged
from tallywork.operators.joins import bounded_join, row_bound

# Above this length, a digest stands for all of a path but its last element, and for the classes of an element.
PATH_LENGTH = 400

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|select|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<loose>/?[a-zA-Z][^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_LOOSE_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_DIGITS = re.compile(r"\d+")

# What a block's characters are worth to the next container around, and the bonus of a container named as the article.
OUTWARD = 0.75
NAMED = 1.5
# A page whose own best container calls itself the article is not read by a path with less than this share of its points.
SMALL = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img input".split()
)
CONTAINERS = frozenset("article body div main section td".split())
# Blocks that belong to the article where it lies open in the page's frame.
FLOW = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that only the frame of a page holds around the article.
FURNITURE = frozenset("footer header menu nav".split())
# Elements whose text is never the article's.
OUTSIDE = frozenset("aside button dialog footer form head menu nav".split())
# Words in a class, id or role that mark something beside the article. Whole words between non-letters.
_WORDS = (
    "ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|complementary|"
    "consent|contentinfo|cookie|cookies|disqus|footer|form|menu|menubar|nav|navbar|navigation|newsletter|notice|"
    "notices|pager|pagination|popup|promo|promoted|promotion|related|replies|reply|responses|search|share|sharing|sidebar|sidebars|"
    "signup|social|sponsor|sponsored|subscribe|tags|toolbar|widget|widgets"
)
_BESIDE = re.compile(rf"(?:^|[^a-z])(?:{_WORDS})(?:$|[^a-z])")
# Inside the article a name has to consist of such words, and of those for shape and place: `related-posts` is none of its text,
# `related-work` may well be.
_SHAPES = (
    "above|area|articles|bar|below|block|body|bottom|box|button|buttons|card|cards|center|col|column|container|content|count|counts|entry|group|head|"
    "header|heading|icons|inline|inner|item|items|left|links|list|main|media|meta|new|news|outer|panel|post|posts|right|row|section|side|site|slot|"
    "small|stories|story|text|thread|title|top|unit|wrap|wrapper"
)
_ONLY_BESIDE = re.compile(rf"(?=.*?(?:^|[^a-z])(?:{_WORDS})(?:$|[^a-z]))(?:(?:{_WORDS}|{_SHAPES}|[a-z])(?:[^a-z]+|$))+")
# A single such id is often the anchor of a section; these are always meant.
_ANCHORS = frozenset("ad banner consent cookie form menu notice notices pager promotion related reply replies responses search share sharing social sponsor tags widgets".split())
# These mark the head of a page, but inside the article its title.
_HEADS = re.compile(r"(?:^|[^a-z])(?:header|masthead)(?:$|[^a-z])")
_FRAMES = re.compile(r"\b(?:contentinfo|footer|header|masthead|menu|menubar|nav|navbar|navigation)\b")
_CALLED = re.compile(r"\b(?:article|content|entry|post|story)\b")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    """A node of the light tree: `parts` are texts and elements in page order."""

    __slots__ = ("tag", "path", "parts", "beside", "within")

    def __init__(self, tag: str, path: str, beside: bool, within: bool = False):
        self.tag, self.path, self.parts, self.beside, self.within = tag, path, [], beside, within or tag in ("article", "main")


def _digest(text: str) -> str:
    return "#" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _joined(path: str, tag: str, words: str) -> str:
    """The path of an element with these classes in an element on `path`. Different places have different paths at any depth."""
    words = words.replace("/", "|")
    if len(words) > PATH_LENGTH // 2:
        words = ".".join([*sorted({*_CALLED.findall(words), *_FRAMES.findall(words)}), _digest(words)])
    step = f"/{tag if len(tag) <= PATH_LENGTH // 8 else _digest(tag)}{'.' + words if words else ''}"
    return (path if len(path) + len(step) <= PATH_LENGTH else _digest(path)) + step


def _names_beside(name: str, value: str, tag: str, outer: bool) -> bool:
    """Whether a class, id or role says that an element is beside the article. Headings and the page's own frame never say so.

    Outside the article any word will do. Inside it, and for blocks of running text anywhere, every part of a name has to fit, and
    an id alone may be an anchor: `search` on a section is a place in the text, `comments` is not.
    """
    if tag in ("html", "body", "article", "main") or tag in HEADINGS:
        return False
    if outer and tag not in FLOW:
        return bool(_BESIDE.search(value) or _HEADS.search(value))
    if name == "role":
        return any(_ONLY_BESIDE.fullmatch(role) for role in value.split())
    if name == "id" and (tag in FLOW or value.strip() in _ANCHORS):
        return False
    return any(_ONLY_BESIDE.fullmatch(_DIGITS.sub("", part).strip("-_")) for part in value.split())


def _element(tag: str, more: str, parent: Element) -> Element:
    beside, words = tag in OUTSIDE, ""
    # a header of the page is outside, one inside the article holds its title
    outer = not parent.within
    beside = beside or tag == "header" and outer
    if more:
        for name, *values in _NAMES.findall(more):
            name, value = name.lower(), values[0] or values[1] or values[2]
            if name in ("class", "id", "role"):
                value = _CAMEL.sub("-", value).lower()
                beside = beside or _names_beside(name, value, tag, outer)
                # classes of the whole page tell pages apart, not places in them
                if name == "class" and tag not in ("html", "body"):
                    words = ".".join(sorted(_DIGITS.sub("", value).split()))
            elif name == "style":
                beside = beside or bool(_HIDDEN.search(value))
            elif name == "hidden" or value.lower() == "true":
                beside = True
    return Element(tag, _joined(parent.path, tag, words), parent.beside or beside, parent.within)


def parse(html: str) -> Element:
    """The tree of a page, forgiving as browsers are: unclosed elements end with what holds them, stray ends are skipped."""
    root = Element("", "", False)
    stack, at, anchored = [root], 0, []
    for match in _TOKEN.finditer(html):
        if match.start() > at:
            stack[-1].parts.append(html[at : match.start()])
        at = match.end()
        tag, close, more = match["tag"], match["close"], match["more"]
        if match["loose"]:
            close, tag = _LOOSE_TAG.match(match["loose"]).groups()
            more = ""
        if not tag:
            if match["raw"] and match["raw"].lower() not in INLINE:
                stack[-1].parts.append(" ")
            continue
        tag = tag.lower()
        if close:
            if tag in INLINE and stack[-1].tag not in INLINE and stack[-1].tag != tag:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag in ("p", "li", *INLINE) and stack[depth].tag in CONTAINERS:
                    break
            continue
        if tag in VOID:
            if tag not in INLINE:
                stack[-1].parts.append(" ")
            continue
        if tag not in INLINE:
            # a block ends an open paragraph and what inline elements are open in it; an item ends the item before
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p" or stack[depth].tag == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                    del stack[depth:]
                    break
                if stack[depth].tag not in INLINE:
                    break
        element = _element(tag, more, stack[-1])
        if element.within and not element.beside and tag in ("div", "section", "ul") and _anchored(more):
            anchored.append(element)
        stack[-1].parts.append(element)
        if not more.rstrip().endswith("/") or tag in CONTAINERS or tag in ("p", "a"):
            stack.append(element)
    if at < len(html):
        tail = html[at:]
        # a page cut off inside a tag ends before it
        stack[-1].parts.append(tail[: m.start()] if (m := re.search(r"<[/!?a-zA-Z][^>]*\Z", tail)) else tail)
    for element in anchored:
        element.beside = _mostly_links(element)
    return root


def _anchored(more: str) -> bool:
    """Whether an id names furniture or a section called so; what it holds will tell."""
    return any(name.lower() == "id" and (a or b or c).strip().lower() in _ANCHORS for name, a, b, c in _NAMES.findall(more))


def _mostly_links(element: Element) -> bool:
    letters = linked = 0
    todo = [(element, False)]
    while todo:
        here, link = todo.pop()
        link = link or here.tag == "a"
        for part in here.parts:
            if isinstance(part, str):
                size = len("".join(part.split()))
                letters, linked = letters + size, linked + size * link
            else:
                todo.append((part, link))
    return 2 * linked > letters


def text_of(element: Element, left_out: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of an element without what stands beside the article and the elements (by `id`) `left_out`: references decoded, white
    space as one blank, trimmed."""
    pieces: list[str] = []
    _gather(element, pieces, left_out)
    return " ".join(unescape("".join(pieces)).split())


def _gather(element: Element, pieces: list[str], left_out: frozenset[int] | set[int]) -> None:
    todo: list = [iter(element.parts)]
    ends: list[bool] = [False]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            if ends.pop():
                pieces.append(" ")
        elif isinstance(part, str):
            pieces.append(part)
        else:
            block = part.tag not in INLINE
            if block:
                pieces.append(" ")
            if not part.beside and id(part) not in left_out:
                todo.append(iter(part.parts))
                ends.append(block)


def scores(root: Element) -> dict[str, float]:
    """Points of every container path: characters of its own blocks outside links, more for what calls itself the article.

    A block's characters count fully for the container that holds it and three quarters as much for each container further out,
    so that the innermost container of most of the text wins. Link text counts against them.
    """
    points: dict[str, float] = {}
    todo: list[tuple[Element, tuple[str, ...], bool]] = [(root, (), False)]
    while todo:
        element, around, linked = todo.pop()
        if element.beside:
            continue
        if element.tag in CONTAINERS:
            around = (*around, element.path)
            points.setdefault(element.path, 0.0)
        linked = linked or element.tag == "a"
        length = sum(len(p) - p.count(" ") for p in element.parts if isinstance(p, str))
        share = -length if linked else length
        for path in reversed(around):
            points[path] += share
            share *= OUTWARD
        todo.extend((part, around, linked) for part in element.parts if not isinstance(part, str))
    for path in points:
        if _named(path):
            points[path] *= NAMED
    return points


def _named(path: str) -> bool:
    """Whether the last element of a path calls itself the article."""
    last = path.rsplit("/", 1)[-1]
    return bool(re.match(r"(?:article|main)\b", last) or _CALLED.search(last))


def best_path(root: Element) -> str:
    """The container path of most points, the shortest and then the first in order of equals; empty if nothing has any."""
    return _best(scores(root))


def _best(points: dict[str, float]) -> str:
    best = min(points, key=lambda path: (-points[path], len(path), path), default="")
    return best if best and points[best] > 0 else ""


# An element and those around it, from the inside out.
Chain = tuple[Element, "Chain | None"]


def _on_path(root: Element, path: str) -> list[Chain]:
    """The outermost elements on a path with what is around them, in page order, none of them beside the article."""
    found, todo = [], [(root, None)]
    while todo:
        chain = todo.pop()
        element = chain[0]
        if element.beside:
            continue
        if element.path == path:
            found.append(chain)
        else:
            todo.extend((part, chain) for part in reversed(element.parts) if not isinstance(part, str))
    return found


def _frame(element: Element) -> bool:
    """Whether an element holds the page around the article: the body, or what has the page's head, foot or menu in it."""
    return element.tag in ("", "html", "body") or element.tag not in ("article", "main") and any(
        not isinstance(part, str) and part.beside and (part.tag in FURNITURE or part.tag in CONTAINERS and _FRAMES.search(part.path.rsplit("/", 1)[-1]))
        for part in element.parts
    )


def _linked(element: Element) -> bool:
    """Whether an element has more text in links than outside them."""
    balance, todo = 0, [(element, element.tag == "a")]
    while todo:
        inner, linked = todo.pop()
        if not inner.beside:
            length = sum(len(p) - p.count(" ") for p in inner.parts if isinstance(p, str))
            balance += length if linked else -length
            todo.extend((part, linked or part.tag == "a") for part in inner.parts if not isinstance(part, str))
    return balance > 0


def _articles(found: list[Chain]) -> list[str]:
    """Texts of the articles around elements, in page order.

    Around an element inside an `article` that is all of the outermost one. Around another it is what the containers up to the
    page's frame, or up to `main`, hold, but boxes of links; in the frame itself, headings, paragraphs and the like beside it.
    """
    on_chain: set[int] = set()
    roots: dict[int, tuple[Element, Element | None]] = {}
    levels: dict[int, Element] = {}
    for chain in found:
        around = []
        link: Chain | None = chain
        while link is not None:
            around.append(link[0])
            link = link[1]
        on_chain.update(map(id, around))
        outer = next((e for e in reversed(around) if e.tag == "article"), None)
        if outer is not None:
            roots[id(outer)] = outer, None
            continue
        top, frame = around[0], None
        for element in around[1:] if top.tag != "main" and not _whole(top) else ():
            if _frame(element):
                frame = element
                break
            top = levels[id(element)] = element
            if element.tag == "main":
                break
        roots[id(top)] = top, frame
    left_out = {
        id(part)
        for element in levels.values()
        for part in element.parts
        if not isinstance(part, str) and id(part) not in on_chain and part.tag not in INLINE and _linked(part)
    }
    texts, framed = [], set()
    for top, frame in roots.values():
        if frame is None:
            texts.append(text_of(top, left_out))
        elif id(frame) not in framed:
            framed.add(id(frame))
            for part in frame.parts:
                if not isinstance(part, str) and not part.beside and (id(part) in roots or part.tag in FLOW and not _linked(part)):
                    texts.append(text_of(part, left_out))
    return [t for t in texts if t]


def _whole(element: Element) -> bool:
    return element.tag in ("", "html", "body")


def main_text(html: str, path: str | None) -> str:
    """Text of the article around the elements on the host's path, else around the page's own best container, else of the whole page.

    The page's own best container also goes before a path with next to none of its points, if it calls itself the article.
    """
    root = parse(html)
    points = scores(root)
    own = _best(points)
    if path and own and _named(own) and points.get(path, 0.0) < SMALL * points[own]:
        path = own
    on_path = [c for c in _on_path(root, path) if text_of(c[0])] if path else []
    texts = _articles(on_path) or _articles(_on_path(root, own or "/html/body")) or [text_of(root)]
    return " ".join(t for t in texts if t)


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def votes(pages: DataFrame) -> DataFrame:
    """`host`, `path` and how many of the host's pages vote for it. Pages without a container that has text do not vote."""
    out = pa.schema([("host", pa.string()), ("path", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def each() -> Iterator[tuple]:
            for batch in batches:
                for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    if path := best_path(parse(html)):
                        yield host, path

        return in_pieces(each(), out, lambda row: len(row[1]))

    rows = pages.filter(F.length("html") > 0).select(host_of(pages["url"]).alias("host"), "html").filter("host IS NOT NULL")
    return rows.mapInArrow(run, "host STRING, path STRING").groupBy("host", "path").agg(F.count("*").alias("votes"))


def winners(counted: DataFrame) -> DataFrame:
    """One path per host: the most votes, the shortest path and the first in order of equals."""
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.length("path"), "path")
    return counted.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text` of every row of `pages` (page_id, url, html).

    A null or empty page has an empty text. Pages with a null or odd address are extracted by their own best container. Repeated
    rows are extracted one by one. Winning paths are broadcast while they are few and joined by shuffle otherwise, where AQE splits
    a host with many pages.
    """
    settings(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    paths = staged(winners(votes(pages)), "host-paths")
    rows = bounded_join(pages.withColumn("host", host_of(F.col("url"))), paths, "host", "left", row_bound(paths))
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def each() -> Iterator[tuple]:
            for batch in batches:
                for page_id, url, html, path in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "path")), strict=True):
                    yield page_id, url, main_text(html, path) if html else ""

        return in_pieces(each(), out, lambda row: len(row[2]))

    return rows.select("page_id", "url", "html", "path").mapInArrow(run, "page_id BIGINT, url STRING, text STRING")

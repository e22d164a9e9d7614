"""Main text of web pages by tree scoring.

A page is read into a tree of elements; parts that are never the article
(scripts, menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, hidden parts) are left out while the tree is built. Every paragraph
then passes points (one, one for each comma, one for each 100 characters up to
three) to its ancestors: all of them to the parent, half to the grandparent, a
``3 * depth``-th further up. An element's points are discounted by its link
density; the element with the most is the container. If it lies in an
``article`` or ``main`` element, that is the container. Siblings that have a
fifth of its points, or are plain paragraphs with few links, are kept too.

Pages are independent, so there's no shuffle, and memory holds one page a task
at a time beside the Arrow batch.

Defined results: null or empty html has empty text; so has a page without any
paragraph; html that ends in the middle of a tag or reference is read as far as
it goes; a repeated row is returned as often; other columns are dropped unless
named in ``keep``. Ties go to the element that begins first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
#: One attribute after another, each by its whole name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of an article.
DROPPED_TAGS = frozenset("script style textarea title xmp iframe noembed noframes head nav header footer aside form button select noscript template svg object canvas dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start of one of these ends an open paragraph.
ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"}
#: A paragraph outside one of these isn't ended by a start inside it.
ENDS_NO_P = ("td", "th", "table", "button", "object", "caption")
#: A start of the key ends an open element of the value, if no element of the third column is between.
CLOSES = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
#: Words of a class, id or role that mark what is not the article, and those that speak for it. A name counts as a whole:
#: besides marking words it may have only such that say where or what kind of box it is, so related-work or share-prices don't.
UNLIKELY = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion discussions disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion reaction reactions recommended related replies reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo alert alertdialog".split())
LIKELY = frozenset("article body content entry main post story text".split())
ALWAYS_UNLIKELY = frozenset("ad ads advert advertisement comment comments discussion discussions disqus reactions replies sponsored cookie".split())
PLACES = frozenset("area articles bar bars block bottom box btn button buttons center col column container fixed footer global has header icon icons inline inner items js layout left link links list main module news outer page panel posts primary right row secondary section site slot stories sub thread top unit wrap wrapper zone".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
#: Characters of a menu's links on average, at most; longer ones are a list of references.
MENU_LABEL = 24
BASE = {"article": 10, "main": 10, "section": 5, "div": 5, "blockquote": 3, "pre": 3, "td": 3, "ol": -3, "ul": -3, "dl": -3, "form": -3, "th": -5}


class Element:
    __slots__ = ("tag", "parent", "parts", "points", "chars", "links", "n_links")

    def __init__(self, tag: str, parent: Element | None, points: float = 0):
        self.tag, self.parent, self.parts = tag, parent, []
        self.points, self.chars, self.links, self.n_links = points, 0, 0, 0

    def density(self) -> float:
        return self.links / self.chars if self.chars else 0.0


def _unlikely(tag: str, attributes: str, in_article: bool) -> tuple[bool, float]:
    """Whether an element is left out, and the points its names give. The header of an article is part of it."""
    if tag in DROPPED_TAGS and not (tag == "header" and in_article):
        return True, 0
    if not attributes or attributes.isspace():
        return False, 0
    names: list[list[str]] = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return tag not in ("html", "body"), 0
        if name in ("class", "id", "role"):
            names += [[w.lower() for w in _WORD.findall(x)] for x in value.split()]
    if tag in ("html", "body", "main"):
        return False, 0
    likely = any(w in LIKELY for words in names for w in words)
    for words in names:
        marked = [w for w in words if w in UNLIKELY]
        if marked and all(w in UNLIKELY or w in PLACES or w in LIKELY for w in words):
            if any(w in ALWAYS_UNLIKELY for w in marked):
                return True, 0
            # A paragraph, quote or item inside an article is a part of it, whatever box it's drawn in.
            plain = tag != "article" and not (in_article and tag in PARAGRAPHS) and not any(w in LIKELY and w not in PLACES for w in words)
            if plain and not (tag == "header" and in_article) and not any(o is not words and o and all(w in LIKELY for w in o) for o in names):
                return True, 0
    return False, 25 * likely


def parse(html: str) -> Element:
    """The tree of what may be the article.

    The places of open elements are kept by tag, so finding what a tag ends takes the same time at any depth.
    """
    root = Element("html", None)
    open_: list[Element] = [root]
    places: dict[str, list[int]] = {}
    left_out = 0  # how many open elements at the end of ``open_`` belong to a part that is left out
    at, n = 0, len(html)

    def text(s: str) -> None:
        if not left_out and s:
            open_[-1].parts.append(unescape(s) if "&" in s else s)

    def begin(element: Element) -> None:
        places.setdefault(element.tag, []).append(len(open_))
        open_.append(element)

    def close_to(i: int) -> None:
        nonlocal left_out
        left_out = max(0, left_out - (len(open_) - i))
        while len(open_) > i:
            places[open_.pop().tag].pop()

    def last(tags) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < n:
        m = _TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        if not m[0].endswith(">"):
            break
        tag, ending, attributes = tag.lower(), m[1] or m[4], (m[3] if m[2] else m[6]) or ""
        if ending:
            if i := last((tag,)):
                close_to(i)
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P and (i := last(("p",))) > last(ENDS_NO_P):
            close_to(i)
        if tag in CLOSES:
            ended, stop = CLOSES[tag]
            while (i := last(ended)) > last(stop):
                close_to(i)
                if tag != "tr":
                    break
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            if not left_out and tag in ("br", "hr"):
                open_[-1].parts.append(" " if tag == "br" else Element("hr", open_[-1]))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if left_out:
            begin(Element(tag, None))
            left_out += 1
            continue
        out, points = _unlikely(tag, attributes, bool(places.get("article")))
        element = Element(tag, open_[-1], BASE.get(tag, 0) + points)
        if out:
            left_out = 1
        else:
            open_[-1].parts.append(element)
        begin(element)
    return root


def _walk(root: Element) -> list[Element]:
    """All elements, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo.extend(p for p in reversed(e.parts) if not isinstance(p, str))
    return out


def _score(elements: list[Element]) -> None:
    """Text and link lengths, from the leaves up, and the points of paragraphs."""
    commas: dict[int, int] = {}
    for e in reversed(elements):
        for p in e.parts:
            if isinstance(p, str):
                e.chars += len(p.strip())
                commas[id(e)] = commas.get(id(e), 0) + p.count(",")
        if e.tag == "a":
            e.links, e.n_links = e.chars, e.n_links + 1
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.links += e.links
            e.parent.n_links += e.n_links
            commas[id(e.parent)] = commas.get(id(e.parent), 0) + commas.get(id(e), 0)
    for e in elements:
        own = e.tag in PARAGRAPHS or e.tag in ("div", "section", "article", "main") and any(isinstance(p, str) and p.strip() for p in e.parts)
        if not own or not e.chars:
            continue
        points = 1 + commas.get(id(e), 0) + min(e.chars // 100, 3)
        if e.tag not in PARAGRAPHS:
            e.points += points
        up, depth = e.parent, 0
        while up is not None and depth < 5:
            up.points += points / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
            up, depth = up.parent, depth + 1


def _is_menu(e: Element) -> bool:
    """Nothing but short links."""
    return e.tag in ("ul", "ol", "div", "section", "table", "dl") and e.n_links >= 3 and e.density() > 0.95 and e.links <= MENU_LABEL * e.n_links


def _lines(element: Element, lines: list[str]) -> None:
    """The blocks of an element, each with its white space as one space.

    A menu goes at the element's beginning and end; between its paragraphs a list of links is part of what they say.
    """
    run: list[str] = []
    held: list[str] = []  # lines of menus since the last other line
    inside = 0  # open menus

    def flush() -> None:
        line = " ".join("".join(run).split())
        run.clear()
        if line and inside:
            held.append(line)
        elif line:
            if lines[begun:]:
                lines.extend(held)
            held.clear()
            lines.append(line)

    begun = len(lines)
    # (element, next part): a stack of its own, since pages may be nested deeply
    stack = [(element, iter(element.parts))]
    while stack:
        e, parts = stack[-1]
        for p in parts:
            if isinstance(p, str):
                run.append(p)
            else:
                if p.tag in BLOCKS:
                    flush()
                    inside += _is_menu(p)
                stack.append((p, iter(p.parts)))
                break
        else:
            stack.pop()
            if e.tag in BLOCKS:
                flush()
                inside -= e is not element and _is_menu(e)
    flush()
    if lines[begun:] and lines[-1].endswith(":"):
        lines.extend(held)  # what the last paragraph announces


def _has_prose(element: Element) -> bool:
    """Whether there's a paragraph or a heading inside."""
    todo = [element]
    while todo:
        e = todo.pop()
        if e.chars and e.tag in PARAGRAPHS and e.tag not in ("li", "td", "dd"):
            return True
        todo.extend(p for p in e.parts if not isinstance(p, str))
    return False


def main_text(html: str | None) -> str:
    """The article of one page, a line for each block.

    The container is the block with the best score, or the ``article`` or ``main`` around it. Without such a one, its
    siblings are the article's other parts as long as they hold paragraphs or headings and aren't mostly links.
    """
    if not html:
        return ""
    elements = _walk(parse(html))
    _score(elements)
    best, most = None, 0.0
    for e in elements[1:] or elements:
        if e.tag in BLOCKS and e.chars and (value := e.points * (1 - e.density())) > most and e.tag not in PARAGRAPHS:
            best, most = e, value
    if best is None:
        best = elements[0]
        if not best.chars:
            return ""
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best, most = up, max(most, up.points * (1 - up.density()))
        up = up.parent
    lines: list[str] = []
    if best.parent is None or best.tag in ("article", "main") and not any(not isinstance(p, str) and p is not best and p.tag == "article" for p in best.parent.parts):
        _lines(best, lines)
        return "\n".join(lines)
    least = max(10.0, most / 5)
    for p in best.parent.parts:
        if isinstance(p, str):
            continue
        part = p.chars and p.density() < 0.25 and _has_prose(p)
        if p is best or part or p.tag == "p" and p.chars and not p.links or p.tag in ("h1", "h2", "h3") or p.points * (1 - p.density()) >= least:
            _lines(p, lines)
    return "\n".join(lines)


def extract(pages: DataFrame, *, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``text``."""
    kept = [c for c in keep or [] if c not in ("text", html)]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(schema)
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i).cast(to.field(i).type) for i in range(len(kept))] + [pa.array(texts, to.field(len(kept)).type)], schema=to)

    return pages.select(*kept, F.col(html)).mapInArrow(run, schema)


def extraction_report(pages: DataFrame) -> DataFrame:
    return extract(pages, keep=["page_id", "url"]).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass decides blocks on stop-word density, length, link density and the
kind of container they stand in; the second lets the ambiguous ones, mostly short, inherit the label of their nearest
decided neighbours. The text is what is good, in page order.

Names of containers are evidence of two strengths. Those of a place beside the article (a sidebar, a menu, reader comments) decide.
Those that may as well be a topic (search, discussion, related) count against a container only as long as it holds no block
that its own text shows to be good. Names of states (``has-sidebar``, ``comments-open``) and ids of headings and chapters say nothing. An element
inside a paragraph that is set apart takes its own text along, not the paragraph.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    #: Above this share of linked characters a block is boilerplate.
    link_density: float = 0.5
    #: From this share of stop words, and this many characters, a block is main text.
    stop_density: float = 0.3
    long_chars: int = 70
    #: Blocks of so many characters without links are main text even in a language without listed stop words.
    very_long_chars: int = 400


# fixed values: tag names
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
_UNSEEN = frozenset("applet audio button canvas datalist head iframe map math noframes noscript object option script select style svg template textarea title video".split())
_FRAME = frozenset("aside dialog footer form menu nav".split())
_MAIN = frozenset(("article", "main"))
#: What an opening tag closes, if it is the innermost open block.
_CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SECTIONS = frozenset("section article main".split())
# fixed values: words of class, id and role that name a place beside the article
_PLACES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo popup modal overlay cookie cookies consent gdpr newsletter subscribe subscription signup "
    "login menu nav navbar navigation breadcrumb breadcrumbs pagination pager sidebar aside complementary footer contentinfo masthead topbar toolbar widget sharing "
    "comment comments commentlist respond replies disqus".split()
)
# fixed values: such words that may be a topic, too
_TOPICS = frozenset("promotion notice notices alert share social related recommended reply discussion search form skip hidden disclaimer".split())
_COMMENT_CUES = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
# fixed values: words of names that tell a state
_STATES = frozenset("has no with without open closed enabled disabled".split())
# fixed values: frequent function words
_STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she so that the their they this to was we were which will with you "
    "aber als am auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich im ist mit nach nicht sich sie sind und von vor war wie wir zu zum "
    "au aux avec ce ces dans de du elle en est et il je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "al como con del el ella en es esta este ha la las lo los más no o para pero por que se si sin su sus un una y".split()
)

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<(script|style|template|textarea|noscript|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[A-Za-z!?/][^<>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD_PART = re.compile(r"[a-z]+")
#: A value without quotes that ends in a slash.
_BARE_URL = re.compile(r"=[^\s\"']*/\Z")
_GOOD, _BAD, _OPEN = 1, 0, None


@dataclass
class _Block:
    parts: list[str]
    linked: int
    frame: bool
    #: Number of the outermost container whose name is only weak evidence, 0 for none.
    weak: int
    main: bool
    parent: int


@dataclass
class _Element:
    tag: str
    unseen: bool = False
    frame: bool = False
    #: In an inline element that is set apart from its block.
    apart: bool = False
    weak: int = 0
    comments: bool = False
    main: bool = False
    number: int = 0


def _evidence(tag: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool]:
    """Whether an element is set apart from the article, whether its name is weak evidence of that, and whether it holds reader comments."""
    frame, weak = tag in _FRAME or (tag == "header" and not in_main), False
    if not attributes.strip() or tag in ("html", "body"):
        return frame, False, False
    values = {name.lower(): value.strip("\"'").lower() for name, value in _ATTRIBUTE.findall(attributes)}
    names = f"{values.get('class', '')} {values.get('role', '')}".split()
    own = values.get("id", "")
    if tag not in _HEADINGS and (tag not in _SECTIONS or own in _PLACES):  # the others name a chapter
        names += own.split()
    found: set[str] = set()
    for name in names:
        parts = set(_WORD_PART.findall(name))
        # on the article itself only whole names count; a name of a state says nothing
        if parts & _STATES or (tag in _MAIN and len(parts) > 1):
            continue
        found |= parts
        topics = parts & _TOPICS
        if parts & _PLACES or (topics and len(parts) == len(topics) and (not in_main or tag not in _BLOCK)):
            frame = True
        elif topics:
            weak = True
        if not in_main and tag not in _MAIN and "header" in parts and tag != "h1":
            frame = True
    frame = frame or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
    return frame, weak, frame and bool(found & _COMMENT_CUES)


def blocks(page: str) -> list[_Block]:
    """The page's blocks with text, in order."""
    out: list[_Block] = []
    stack = [_Element("")]
    number, links, at = 0, 0, 0
    current: _Block | None = None

    def text(raw: str) -> None:
        nonlocal current
        top = stack[-1]
        if top.unseen or top.apart or not raw:
            return
        plain = html.unescape(raw) if "&" in raw else raw
        if current is None:
            if plain.isspace():
                return
            current = _Block([], 0, top.frame, top.weak, top.main, top.number)
            out.append(current)
        current.parts.append(plain)
        if links:
            current.linked += len(plain.strip())

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue  # comments, scripts and styles leave nothing
        tag = tag.lower()
        if m[2]:  # end tag
            if tag in _BLOCK:
                current = None
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    links -= sum(x.tag == "a" for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "article", "main") and tag not in ("body", "html", "div", "section", "article", "main", "table"):
                    break
            continue
        if tag in _BLOCK:
            current = None
            closes = _CLOSES.get(tag, ("p",))
            while len(stack) > 1 and (stack[-1].tag in closes or (stack[-1].tag not in _BLOCK and any(x.tag == "p" for x in stack))):
                links -= stack[-1].tag == "a"
                stack.pop()
        elif tag in ("br", "td", "th") and current is not None:
            current.parts.append(" ")
        if tag in _VOID or (m[4].endswith("/") and not _BARE_URL.search(m[4])):
            continue  # nothing is in it
        top = stack[-1]
        frame, apart, weak = top.frame or top.apart, top.apart, top.weak
        if tag in _MAIN and frame and not top.comments and not any(x.tag in ("aside", "dialog") for x in stack):
            frame = apart = False  # a menu or notice that was never closed does not swallow the article
            top = _Element("")
        here, doubtful, remarks = _evidence(tag, m[4], top.main)
        number += 1
        block = tag in _BLOCK
        stack.append(_Element(
            tag, top.unseen or tag in _UNSEEN, frame or here if block else top.frame, not block and (apart or here), weak or (number if doubtful and block else 0),
            top.comments or remarks, top.main or tag in _MAIN, number if block else top.number,
        ))
        links += tag == "a"
    text(page[at:])
    return out


def _telling(text: str, linked: float, s: Settings) -> bool:
    """Whether a text shows by itself that it is main text."""
    words = text.lower().split()
    stops = sum(w.strip(".,;:!?") in _STOP_WORDS for w in words) / len(words)
    return linked <= s.link_density and (len(text) >= s.long_chars and stops >= s.stop_density or len(text) >= s.very_long_chars and linked == 0)


def _first_pass(found: list[tuple[str, _Block]], s: Settings) -> list[int | None]:
    linked = [min(1.0, b.linked / len(t)) for t, b in found]
    telling = [not b.frame and _telling(t, x, s) for (t, b), x in zip(found, linked, strict=True)]
    acquitted = {b.weak for (_, b), good in zip(found, telling, strict=True) if good}
    labels: list[int | None] = []
    for (_, b), x, good in zip(found, linked, telling, strict=True):
        if b.frame or (b.weak and b.weak not in acquitted):
            labels.append(_BAD)
        elif b.main:
            labels.append(_GOOD if x <= s.link_density else _OPEN)
        else:
            labels.append(_BAD if x > s.link_density else _GOOD if good else _OPEN)
    return labels


def _second_pass(labels: list[int | None], parents: list[int]) -> list[int]:
    """Ambiguous blocks take the label of the nearest decided neighbour; at equal distance the one in the same element, else good."""
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(n):
        before[i] = i if labels[i] is not None else before[i - 1] if i else -1
    for i in range(n - 1, -1, -1):
        after[i] = i if labels[i] is not None else after[i + 1] if i < n - 1 else n
    out = []
    for i, label in enumerate(labels):
        p, q = before[i], after[i]
        if label is None and p < 0 and q == n:
            label = _GOOD
        elif label is None:
            near = [(abs(i - k), parents[k] != parents[i], -labels[k], labels[k]) for k in (p, q) if 0 <= k < n]
            label = min(near)[3]
        out.append(label)
    return out


def main_text(page: str | None, s: Settings = Settings()) -> str:
    """The page's main text: good blocks in page order, white space inside a block as one space, joined by one newline."""
    if not page:
        return ""
    found = [(joined, b) for b in blocks(page) if (joined := " ".join("".join(b.parts).split()))]
    labels = _first_pass(found, s)
    size = {main: sum(len(t) for (t, b), label in zip(found, labels, strict=True) if label and b.main == main) for main in (True, False)}
    some = any(b.main and not b.frame for _, b in found)
    marked = some and size[True] >= size[False]
    if some and not marked:  # a marked teaser beside a longer article that is not marked: the mark says nothing
        found = [(t, replace(b, main=False)) for t, b in found]
        labels = _first_pass(found, s)
    labels = _second_pass(labels, [b.parent for _, b in found])
    if marked:  # outside a marked article that holds most of the text nothing is main text by length alone
        labels = [label if b.main else _BAD for label, (_, b) in zip(labels, found, strict=True)]
    return "\n".join(t for (t, _), label in zip(found, labels, strict=True) if label)


def extract(page: Column | str, s: Settings = Settings()) -> Column:
    """Main text as a column expression; null and empty pages give an empty text."""

    @F.arrow_udf("string")
    def extracted(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py(), s) for x in column], pa.string())

    return extracted(page)


def extracted_pages(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages (page_id, url, html)``; repeated rows repeat, other columns are ignored."""
    texts = pages.select("page_id", "url", extract("html", s).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))

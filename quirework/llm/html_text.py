"""Main text of web pages by two-pass block rules (operator 3).

A page is split into blocks at block-level tags. Blocks inside regions that never hold the
article - navigation, headers and footers of the page, asides, forms, scripts, notices,
adverts, reader comments, by element, role, class or id - are dropped. Of the others,

* pass 1 looks at each block alone: many link characters are bad; long blocks are good with
  enough stop words, and bad without; short blocks stay undecided (a heading: near good);
* pass 2 gives undecided runs the label of the nearest decided neighbours: between two good
  ones good, between two bad ones bad, otherwise the nearer one's, and good on a tie.

Where a page marks its article (article, main, role=main), blocks outside it are bad, and
long blocks inside are good whatever language they are in; link density still counts.

Behaviour on odd input: null or empty html gives an empty text; text without tags is one
block; unclosed, stray and cut-off tags and character references are read as browsers do;
pages of any length are read whole; repeated rows give repeated results; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.common import map_arrow, pages

# Function words of the languages of the corpus; texts of other languages rely on article marks.
STOP_WORDS = {
    "en": "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you",
    "fr": "à au aux avec ce ces dans de des du elle en est et eux il je la le les leur lui ma mais me ne nous on ou par pas pour qu que qui sa se ses son sur un une vous",
    "es": "a al con como de del el ella en entre es esta este la las le lo los más me mi no nos o para pero por que se si sin son su sus un una y ya",
    "de": "als am an auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war was wie wir zu zum zur",
}
WORDS = frozenset(w for line in STOP_WORDS.values() for w in line.split())

SHORT, LONG = 70, 200  # characters
STOP_LOW, STOP_HIGH = 0.15, 0.25
LINKS = 0.33

#: Elements that begin and end blocks.
BLOCK = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu nav noscript ol optgroup option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page.
RAW = frozenset("script style textarea title template noscript iframe svg math object select button option head".split())
#: Their content runs to their own end tag, whatever it looks like.
OPAQUE = frozenset("script style textarea title iframe".split())
DROPPED = frozenset("nav footer aside form menu dialog".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|breadcrumbs?|comments?|consent|cookies?|disqus|disclaimer|footers?|gdpr|headers?|masthead|menus?|modal|nav|navbar|"
    r"navigation|newsletter|notices?|pagination|pager|popup|promos?|promotions?|related|respond|share|sharing|sidebars?|social|sponsor(?:ed|s)?|subscribe|toolbar|widgets?)(?=$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
ARTICLE_ROLES = frozenset(["main", "article"])

_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:/?>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_SPACE = re.compile(r"\s+")
#: A start tag of the key closes an open element of these.
_P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDARY = frozenset("ul ol dl table article section div main nav aside footer header form body html".split())


class Block:
    __slots__ = ("chars", "dropped", "heading", "in_article", "links", "parts")

    def __init__(self, dropped: bool, in_article: bool, heading: bool):
        self.parts: list[str] = []
        self.links, self.chars = 0, 0
        self.dropped, self.in_article, self.heading = dropped, in_article, heading


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, with what its regions say about them.

    Every tag is handled in constant time, however many elements are open: places of open
    elements are kept by name, and those of elements that end tags don't reach through.
    """
    out: list[Block] = []
    # open elements: name, and the state outside each to go back to
    stack: list[tuple[str, tuple]] = []
    places: dict[str, list[int]] = {}
    boundaries: list[int] = []
    dropped = in_article = heading = skip = False
    links = 0
    now: Block | None = None
    at, end = 0, len(page)

    def text(piece: str) -> None:
        nonlocal now
        if skip or not piece:
            return
        if now is None:
            if piece.isspace():
                return
            now = Block(dropped, in_article, heading)
            out.append(now)
        now.parts.append(piece)
        if links:
            now.links += len(piece.strip())

    def leave(k: int) -> None:
        nonlocal dropped, in_article, heading, skip, links
        dropped, in_article, heading, skip, links = stack[k][1]
        for held, _ in stack[k:]:
            places[held].pop()
            if held in _BOUNDARY:
                boundaries.pop()
        del stack[k:]

    def innermost(names) -> int:
        """Place of the last open element of these names, or -1 if there is none inside the last boundary."""
        k = max((places[n][-1] for n in names if places.get(n)), default=-1)
        return k if not boundaries or k >= boundaries[-1] else -1

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            k = places[name][-1] if name in _BOUNDARY and places.get(name) else innermost((name,))
            if k >= 0:
                leave(k)
            if name in BLOCK:
                now = None
            continue
        if name in BLOCK:
            now = None
        elif name == "br":
            text(" ")
        if name in VOID or m[0].endswith("/>"):
            continue
        closes = _CLOSES.get(name)
        if closes or name in _P_CLOSERS:
            k = innermost({*(closes or ()), *(("p",) if name in _P_CLOSERS else ())})
            if k >= 0:
                leave(k)
        places.setdefault(name, []).append(len(stack))
        if name in _BOUNDARY:
            boundaries.append(len(stack))
        stack.append((name, (dropped, in_article, heading, skip, links)))
        if name in ("html", "body"):
            continue
        if name in RAW:
            skip = True
            if name in OPAQUE:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                leave(len(stack) - 1)
                at = close.end() if close else end
            continue
        given = _attributes(m[3]) if m[3] else {}
        role = given.get("role", "").lower()
        if name in ("article", "main") or role in ARTICLE_ROLES:
            in_article = True
        elif name in DROPPED or (name == "header" and not in_article) or role in ROLES:
            dropped = True
        elif given and ("hidden" in given or given.get("aria-hidden", "").lower() == "true" or MARKED.search(f"{given.get('class', '')} {given.get('id', '')}")):
            dropped = True
        if name == "a":
            links += 1
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = True
    return out


def _clean(parts: list[str]) -> str:
    raw = "".join(parts)
    return _SPACE.sub(" ", html.unescape(raw) if "&" in raw else raw).strip()


GOOD, BAD, NEAR_GOOD, UNDECIDED = 1, 0, 2, 3


def classify(text: str, links: int, heading: bool, in_article: bool) -> int:
    """Pass 1: a block by itself."""
    size = len(text)
    if links > LINKS * size:
        return BAD
    if size < SHORT:
        return NEAR_GOOD if heading else UNDECIDED
    words = [w.strip(".,;:!?\"'()[]{}*#%$&|<>-").lower() for w in text.split()]
    density = sum(w in WORDS for w in words) / max(len(words), 1)
    if size >= LONG and (density >= STOP_HIGH or in_article):
        return GOOD
    if density >= STOP_HIGH or (size >= LONG and density >= STOP_LOW):
        return GOOD if size >= LONG else NEAR_GOOD
    if density >= STOP_LOW or in_article:
        return NEAR_GOOD
    return BAD


def settle(labels: list[int], in_article: list[bool]) -> list[bool]:
    """Pass 2: near good blocks beside a good one and undecided ones take a neighbour's label."""
    n = len(labels)
    decided = [x in (GOOD, BAD) for x in labels]
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        if decided[i]:
            last = i
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        if decided[i]:
            last = i
    out = []
    for i, label in enumerate(labels):
        if decided[i]:
            out.append(label == GOOD)
            continue
        near = [(i - before[i], labels[before[i]])] if before[i] >= 0 else []
        near += [(after[i] - i, labels[after[i]])] if after[i] >= 0 else []
        if not near:  # nothing on the page is decided: the article's short blocks are its text
            out.append(in_article[i] or label == NEAR_GOOD)
        elif label == NEAR_GOOD and any(x == GOOD for _, x in near):
            out.append(True)
        else:
            least = min(d for d, _ in near)
            out.append(any(x == GOOD for d, x in near if d == least) or (in_article[i] and label == NEAR_GOOD))
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines."""
    if not page:
        return ""
    found = [(b, t) for b in blocks(page) if not b.dropped and (t := _clean(b.parts))]
    if any(b.in_article for b, _ in found):
        found = [(b, t) for b, t in found if b.in_article]
    labels = [classify(t, b.links, b.heading, b.in_article) for b, t in found]
    kept = settle(labels, [b.in_article for b, _ in found])
    return "\n".join(t for (_, t), k in zip(found, kept, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; one narrow stage without a shuffle."""
    source = df.select(F.col(f"`{page_id}`").cast("long"), F.col(f"`{url}`").cast("string"), F.col(f"`{content}`").cast("string"))
    return map_arrow(source, _extract, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the main text of every page."""
    return extract_main_text(pages(spark, sf_dir))

"""Main-text extraction from HTML by two-pass block rules.

A page is cut into text blocks at block-level tags. The first pass decides a
block by stop-word density, length and link density; the second gives short or
unclear blocks the label of their nearest decided neighbour.

Tags that never hold the article leave at once. Class and id words are only
hints: a container that is named like an advert or a notice leaves unless most
of the page's running words stand in it, and one named like reader comments
unless it holds the headline or all of them. Blocks inside an ``article`` or
``main`` element are the candidates where at least half of the running words
stand there, and else those of the innermost element with nearly all of them;
for such candidates the thresholds are lower, and they stay where no block of
the page is decided by its words, as in a language without listed stop words.
An ``article`` with less than half of the words is a teaser.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could do for from had has have he her his i if in into is it its more not of on one or our out over said she so some than that the their them there they this to up was we were what when which who will with would you "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sein sich sie sind um und von vor war wenn werden wie wird zu zum zur "
    "al como con del el ella en entre era es esta este fue ha hay la las lo los más muy no para pero por porque que se ser si sin sobre su sus también un una y ya "
    "che di da e i gli il nel non per sono una o os as uma com não em mais dos das het een van te dat op voor zijn aan".split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("aside button canvas datalist dialog embed fieldset footer form head iframe input label legend menu nav noscript object option script select style svg template textarea title".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that hint at what is not the article.
CUES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar warning widget".split())
HEADER_CUES = frozenset(("header", "head", "top"))
COMMENT_CUES = frozenset("comment comments disqus replies reply respond".split())
SCOPE_TAGS = frozenset(("article", "main"))
DIVISIONS = frozenset("article div main section td".split())
CUE = re.compile(r"[a-z]+|[A-Z][a-z]*")
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200
LOW, HIGH = 0.2, 0.3
SCOPE_LOW, SCOPE_HIGH = 0.05, 0.2  # for blocks inside an article
MAX_LINKS = 0.33
NEARLY_ALL = 0.85  # of the running words
FEW_WORDS = 30  # an advert of fewer words may well be longer than the article
ALL_LINKS = 0.9


@dataclass
class _Container:
    """An open element; ``hint`` tells that its class or id names a part that is not the article."""

    tag: str
    bad: bool = False
    scope: bool = False
    hint: str = ""  # "", "part" or "comments"
    headline: bool = False  # an h1, a main element or an article body stands in it
    parent: _Container | None = None  # the division around it
    words: int = 0  # running words in it


@dataclass
class _Block:
    text: str
    link_chars: int
    bad: bool
    heading: bool
    scope: str  # the outermost element that gives scope
    hints: list[_Container]
    division: _Container
    words: int = 0

    @property
    def out(self) -> bool:
        return any(h.hint for h in self.hints)


class _Blocks(HTMLParser):
    """Cuts a page into blocks; every tag is handled in constant time but for the elements that it closes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[_Block] = []
        self.open: list[_Container] = []
        self.tags: Counter[str] = Counter()  # of open elements
        self.hints: list[_Container] = []
        self.divisions = [_Container("html")]  # all of the page, parents first
        self.division = self.divisions[0]
        self.scopes: list[str] = []
        self.bad = 0
        self.parts: list[str] = []
        self.link_chars = 0
        self.heading = False

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(_Block(text, self.link_chars, self.bad > 0, self.heading, self.scopes[0] if self.scopes else "", list(self.hints), self.division))
        self.parts, self.link_chars, self.heading = [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in VOID_TAGS:
            return
        if tag in BLOCK_TAGS or tag == "p":
            self.close_open_paragraph(tag)
        new = self.container(tag, dict(attrs))
        self.open.append(new)
        self.tags[tag] += 1
        self.bad += new.bad
        if tag in DIVISIONS:
            new.parent = self.division
            self.divisions.append(new)
            self.division = new
        if new.scope:
            self.scopes.append(tag)
        if new.headline:
            for h in self.hints:
                h.headline = True
        if new.hint:
            self.hints.append(new)
        self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() or self.heading

    def container(self, tag: str, attrs: dict) -> _Container:
        role = (attrs.get("role") or "").lower()
        body = attrs.get("itemprop") == "articleBody"
        scope = tag in SCOPE_TAGS or role in ("main", "article") or body
        headline = tag in ("h1", "main") or body
        if tag in ("html", "body"):
            return _Container(tag, scope=scope)
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
        cues = {c.lower() for c in CUE.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}
        outside = not self.scopes and not scope
        hint = "comments" if cues & COMMENT_CUES else "part" if cues & CUES or outside and cues & HEADER_CUES else ""
        if tag == "main" or body:
            return _Container(tag, scope=True, headline=True)
        return _Container(tag, tag in BAD_TAGS or role in BAD_ROLES or hidden or outside and tag == "header", scope, hint, headline)

    def close_open_paragraph(self, tag: str):
        """A block-level start tag ends an open paragraph, a list item the item before it."""
        while self.open and (self.open[-1].tag == "p" or self.open[-1].tag == tag in ("li", "option", "dd", "dt", "td", "tr")):
            self.pop()

    def pop(self):
        old = self.open.pop()
        self.tags[old.tag] -= 1
        self.bad -= old.bad
        if old.tag in DIVISIONS:
            self.division = old.parent
        if old.scope:
            self.scopes.pop()
        if old.hint:
            self.hints.pop()

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if self.tags[tag]:
            while self.open[-1].tag != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if self.open and self.open[-1].tag in ("script", "style"):
            return
        self.parts.append(data)
        if self.tags["a"]:
            self.link_chars += len(data.strip())

    def finish(self):
        self.close()
        self.flush()
        return self.blocks, self.divisions


def _density(text: str) -> tuple[int, float]:
    words = WORD.findall(text.lower())
    return len(words), sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _candidates(blocks: list[_Block], divisions: list[_Container]) -> tuple[list[_Block], bool]:
    """The blocks that the passes decide, and whether they are those of one element that holds the article."""
    blocks = [b for b in blocks if not b.bad]
    for b in blocks:
        b.words = _density(b.text)[0] if b.link_chars <= MAX_LINKS * len(b.text) else 0
        for h in b.hints:
            h.words += b.words
    hints = list({id(h): h for b in blocks for h in b.hints}.values())
    total = sum(b.words for b in blocks)
    for h in hints:
        if h.hint == "comments" and (h.headline or total and h.words == total):
            h.hint = ""
    rest = sum(b.words for b in blocks if not any(h.hint == "comments" for h in b.hints))
    for h in hints:
        if h.hint == "part" and 2 * h.words > rest and (h.words >= FEW_WORDS or h.words == rest):
            h.hint = ""
    left = [b for b in blocks if not b.out]
    total, inside = sum(b.words for b in left), sum(b.words for b in left if b.scope)
    if any(b.scope for b in left) and 2 * inside >= total:
        return [b for b in left if b.scope], True
    left = [b for b in left if not b.scope]
    total = sum(b.words for b in left)
    for d in divisions:
        d.words = 0
    for b in left:
        b.division.words += b.words
    for d in reversed(divisions):
        if d.parent:
            d.parent.words += d.words
    inner = [d for d in divisions if d.tag != "html" and d.words >= NEARLY_ALL * total]
    if not total or not inner:
        return left, False
    within = {id(inner[-1])}  # of elements around one another the last one opened is the innermost
    for d in divisions:
        if d.parent and id(d.parent) in within:
            within.add(id(d))
    return [b for b in left if id(b.division) in within], True


def _first_pass(text: str, link_chars: int, in_scope: bool, heading: bool) -> str:
    """good, bad or unclear (near or short), from the block's own text."""
    links = link_chars / len(text)
    _, density = _density(text)
    if links >= ALL_LINKS or links > MAX_LINKS and not in_scope:
        return "bad"
    if len(text) < SHORT or heading:
        return "short"
    if density >= (SCOPE_HIGH if in_scope else HIGH):
        return "good" if len(text) >= LONG or in_scope else "near"
    return "near" if density >= (SCOPE_LOW if in_scope else LOW) else "bad"


def _second_pass(labels: list[str], headings: list[bool], in_scope: bool) -> list[bool]:
    """Unclear blocks take the label of the nearest decided block; of two as near, headings take the later one, others the earlier one.

    In an article a good block goes before a bad one as near, and blocks stay where none is good.
    """
    if in_scope and "good" not in labels:
        return [label != "bad" for label in labels]
    decided = [i for i, label in enumerate(labels) if label in ("good", "bad")]
    keep, after = [], 0
    for i, label in enumerate(labels):
        while after < len(decided) and decided[after] < i:
            after += 1
        if label in ("good", "bad"):
            keep.append(label == "good")
            continue
        near = [(abs(j - i), in_scope and labels[j] == "bad", (j < i) == headings[i], labels[j]) for j in decided[max(0, after - 1) : after + 1]]
        inherited = min(near)[3] if near else "bad"
        keep.append(inherited == "good" or label == "near" and not near)
    return keep


def main_text(html: str | None) -> str:
    """The page's main text; empty for null, empty and text-free pages."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    blocks, in_scope = _candidates(*parser.finish())
    labels = [_first_pass(b.text, b.link_chars, in_scope, b.heading) for b in blocks]
    if in_scope and "good" not in labels:
        # no words that are known: only links speak against a block of the article
        labels = ["bad" if b.link_chars >= ALL_LINKS * len(b.text) else "near" for b in blocks]
    keep = _second_pass(labels, [b.heading for b in blocks], in_scope)
    return " ".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html column, plus ``text`` and ``n_chars`` (code points, long).

    Null and empty pages and pages without main text give an empty text; very
    long pages are taken whole, in time that grows with their length. Other
    columns pass through; columns named ``text`` or ``n_chars`` are replaced.
    Every row is treated alone, so repeated rows repeat their result; there are
    no ties. An empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.lit(0).alias("row"), F.col(html).alias("html"))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(main_text)

    texts = F.pandas_udf(run, "string")
    out = rows.withColumn("text", texts(F.coalesce("html", F.lit(""))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "text", F.length("text").cast("long").alias("n_chars"))

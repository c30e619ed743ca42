"""Main text of web pages from text density.

The standard library's streaming parser turns a page into lines, one for each
block-level element, with the number of text characters and of tags met in
each. The text-to-tag ratio by line is smoothed with a Gaussian and split at a
threshold into content and other lines. Lines lie in regions (the nearest
sectioning container); the regions whose text is mostly content lines are the
article, and all their lines are returned, short ones too. On a page with
article or main elements only these are chosen from, and the longest is always
returned. Lines inside
containers that never hold an article (menus, headers, footers, forms,
adverts, notices, reader comments ...) have ratio zero and are never returned.

What a container's tag, class or id says is a prior, decided once the whole
page was read. Scripts, menus, footers, hidden elements and reader comments
are always out. A container whose name says nothing but such a word ("sidebar",
"cookie-banner") is out unless it holds the page's main element, or articles
with most of its text; a name that only contains such a word ("has-sidebar",
"header-fixed", "ad-free story") or a form is out unless it holds an article, a
main element or most of the text. Work is linear in the page, however deep
its elements are nested.

Defined cases: null or empty html gives an empty text; so does a page without
text outside such containers. Text of labels and buttons counts inside a
paragraph, list item or cell outside forms. Unclosed and stray tags are closed by their
containers. Repeated rows get a row each, extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

# HTML element names by role, and words in class, id and role attributes.
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre
section select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGION = frozenset("article main section div body td aside blockquote".split())
OUT = frozenset("""nav header footer aside script style noscript template head title select textarea
iframe svg canvas object dialog menu option video audio""".split())
CONTROLS = frozenset("label button".split())
OUT_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
comments commentlist consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu
modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion
related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe
subscription toolbar widget contentinfo complementary""".split())
MAIN = frozenset(("article", "main"))
# Reader comments are often marked up as articles inside a list, so these words hold on containers inside an article too;
# there only in class names (of them, ids of plain containers) that say nothing else, since ids of headings, paragraphs and
# sections are made from their text, and headlines, notes and discussions are part of articles.
HOLDERS = frozenset("div section ul ol dl table details figure".split())
ID_HOLDERS = HOLDERS - {"section"}
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
INNER_WORDS = OUT_WORDS - frozenset("header footer discussion notice notices copyright cookie cookies menu login search related".split())
INNER_IDS = frozenset("ad ads comments commentlist disqus respond".split())
INNER_MORE = frozenset("list area box container wrapper wrap slot block buttons links bar section form unit".split())
# Words beside those of OUT_WORDS in a name that says nothing else, and those that mean reader comments.
OUTER_MORE = INNER_MORE | frozenset("""site page top bottom left right main global primary secondary mobile sticky side
content post user body inner outer text slider group item items zone unit panel""".split())
REPLIES = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
TEXTUAL = frozenset("p li td th dd dt blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
# How sure it is that an element holds no article.
UNLIKELY, NAMED, ALWAYS = 1, 2, 3
ROLES = frozenset("banner navigation search menu contentinfo complementary".split())
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"},
           "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option"}
SIGMA = 1.0


def named_out(tag: str, key: str, value: str) -> bool:
    """Whether a name inside an article, or an id of a heading or paragraph,
    says that the element is not part of the text."""
    for name in value.split():
        words = WORDS.findall(CAMEL.sub(" ", name).lower())
        if key == "role":
            if name.lower() in ROLES:
                return True
        elif key == "id":
            if tag in ID_HOLDERS and len(words) == 1 and words[0] in INNER_IDS:
                return True
        elif tag in HOLDERS and INNER_WORDS.intersection(words) and all(w in INNER_WORDS or w in INNER_MORE for w in words):
            return True
    return False


def outer_kind(value: str) -> int:
    """What a class or id outside articles says of its element."""
    kind = 0
    for name in value.split():
        words = WORDS.findall(CAMEL.sub(" ", name).lower())
        if OUT_WORDS.intersection(words):
            if not all(w in OUT_WORDS or w in OUTER_MORE for w in words):
                kind = max(kind, UNLIKELY)
            else:
                kind = max(kind, ALWAYS if REPLIES.intersection(words) else NAMED)
    return kind


@dataclass(slots=True)
class Element:
    """An open element, and what it stands in."""
    tag: str
    zone: int
    region: int
    in_main: bool
    in_form: bool
    in_text: bool


@dataclass(slots=True)
class Zone:
    """A container that may be left out; all else lies in the zone around it."""
    parent: int
    kind: int
    holds: frozenset = frozenset()
    chars: int = 0


class Lines(HTMLParser):
    """Parser events to lines ``[text parts, tags, region, zone]``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Element("", 0, 0, False, False, False)]
        self.count: Counter[str] = Counter()               # open elements by tag
        self.lines: list[list] = []
        self.regions = [""]                                # names
        self.mains = [0]                                   # by region: its outermost article or main, else itself
        self.zones = [Zone(-1, 0)]
        self.open: dict[tuple[int, int], list] = {}        # lines of this block
        self.tags = 0

    def _kind(self, tag: str, attrs, at: Element) -> int:
        if tag in OUT and not (tag == "header" and at.in_main):    # an article's own header holds its headline
            return ALWAYS
        if tag in CONTROLS and (at.in_form or not at.in_text):
            return ALWAYS
        kind = UNLIKELY if tag == "form" else 0
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and HIDDEN.search(v)):
                return ALWAYS
            if not v or k not in ("class", "id", "role") or (k != "role" and tag in ("html", "body", "article", "main")):
                continue
            if k == "role" or at.in_main:
                kind = max(kind, ALWAYS * named_out(tag, k, v))
            elif not (k == "id" and tag in TITLED):
                kind = max(kind, outer_kind(v))
        return kind

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.open = {}
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close_in_block("p")
        for t in IMPLIED.get(tag, ()):
            if t != "p":
                self._close_in_block(t)
        at = self.stack[-1]
        zone, region = at.zone, at.region
        if self.zones[zone].kind < ALWAYS:
            kind = self._kind(tag, attrs, at)
            if kind:
                self.zones.append(Zone(zone, kind))
                zone = len(self.zones) - 1
        if self.zones[zone].kind < ALWAYS:
            if tag in MAIN:
                z = zone
                while z >= 0 and tag not in self.zones[z].holds:
                    self.zones[z].holds |= {tag}
                    z = self.zones[z].parent
            if tag in REGION:
                self.regions.append(tag)
                root = self.mains[region]
                region = len(self.regions) - 1
                self.mains.append(root if self.regions[root] in MAIN else region)
        self.stack.append(Element(tag, zone, region, at.in_main or tag in MAIN, at.in_form or tag == "form",
                                  (at.in_text and tag not in BLOCK) or tag in TEXTUAL))
        self.count[tag] += 1

    def _pop(self, i: int) -> None:
        """Close the elements from place ``i`` on."""
        for e in self.stack[i:]:
            self.count[e.tag] -= 1
        del self.stack[i:]

    def _close_in_block(self, tag: str) -> None:
        """Close an open ``tag`` unless another container lies between."""
        if not self.count[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            t = self.stack[i].tag
            if t == tag:
                self._pop(i)
                return
            if t in BLOCK and t not in ("td", "th", "tr"):
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.open = {}
        if not self.count[tag]:
            return
        i = len(self.stack) - 1
        while self.stack[i].tag != tag:
            i -= 1
        self._pop(i)

    def handle_data(self, data):
        at = self.stack[-1]
        line = self.open.get((at.region, at.zone))
        if line is not None:
            line[0].append(data)
            line[1] += self.tags
        elif data.strip():
            line = [[data], self.tags, at.region, at.zone]
            self.lines.append(line)
            self.open[at.region, at.zone] = line
        else:
            return
        self.tags = 0

    def left_out(self, rows: list[tuple[str, int, int, int]]) -> list[bool]:
        """By zone whether its text is left out."""
        for text, _, _, zone in rows:
            self.zones[zone].chars += len(text)
        for z in reversed(self.zones[1:]):
            if z.kind < ALWAYS:
                self.zones[z.parent].chars += z.chars
        out = [False]
        for z in self.zones[1:]:
            most = 2 * z.chars > self.zones[0].chars
            kept = z.kind < ALWAYS and ("main" in z.holds or (z.kind == UNLIKELY and ("article" in z.holds or most))
                                        or ("article" in z.holds and most))
            out.append(out[z.parent] or not kept)
        return out


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends are weighted by what lies inside."""
    r = int(3 * sigma + 0.5)
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(x, k)[r:r + len(x)] / np.convolve(np.ones(len(x)), k)[r:r + len(x)]


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by newlines."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    rows = [(" ".join("".join(parts).split()), tags, region, zone) for parts, tags, region, zone in p.lines]
    rows = [r for r in rows if r[0]]
    left_out = p.left_out(rows)
    rows = [(text, tags, region, left_out[zone]) for text, tags, region, zone in rows]
    if not any(not r[3] for r in rows):
        return ""
    ratio = np.array([0.0 if out else len(text) / max(1, tags) for text, tags, _, out in rows])
    level = smooth(ratio)
    inside = np.array([not r[3] for r in rows])
    content = inside & (level >= min(level.std(), level[inside].max()))
    main = p.mains                                         # region -> its article or main container, else itself
    text_in: dict[int, list[int]] = {}
    for (text, _, region, out), c in zip(rows, content, strict=True):
        if not out:
            t = text_in.setdefault(main[region], [0, 0])
            t[0] += len(text)
            t[1] += len(text) * bool(c)
    articles = {r: t for r, t in text_in.items() if p.regions[r] in MAIN}
    chosen = {r for r, (n, c) in (articles or text_in).items() if 2 * c >= n}
    if articles:                                           # the longest is never lost to its short lines
        chosen.add(max(articles, key=lambda r: articles[r][0]))
    elif not chosen:
        chosen = set(text_in)
    return "\n".join(text for text, _, region, out in rows if not out and main[region] in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; map-only."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = [main_text(h) for h in texts_of(batch, "html")]
        return pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(t, pa.string()),
                                pa.array([len(x) for x in t], pa.int64())],
                               names=["page_id", "url", "text", "n_chars"])
    return map_batches(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html"), run,
                       "page_id bigint, url string, text string, n_chars bigint")

"""HTML extraction: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

A streaming standard-library parser turns a page into lines, one per block
element, each with its text, its number of tags and the elements it stands in.
The text-to-tag ratios of the lines are smoothed and split into two clusters;
the element that holds the high cluster is the content region: an article or main
element if it holds nearly all of it, the parent of several articles that do so
together, or else the innermost container.  Of that region
every line is kept that is not in a menu, advert, form or other side matter.

An element's name is a sign of side matter where it consists of such signs alone;
where only a part of it is one, the line's cluster decides.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import register, table

# fixed values: element names of HTML by their role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
SIDE = frozenset("nav footer aside form script style noscript template svg iframe button select textarea dialog head title menu object canvas".split())
ROOT = frozenset("article main".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre td th tr caption figcaption legend summary address blockquote ul ol dl".split())  # never the region itself
SCOPE = frozenset("table td th caption button object".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager footer comment comments disqus respond reply replies share sharing social "
    "related recommended recommendations widget toolbar login signup search responses feedback announcement toast".split()
)
REMARKS = frozenset("comment comments commentary disqus respond reply replies responses remark remarks".split())  # reader comments, also as articles
#: Parts of a name that say nothing about the role; a name of such parts and hints alone is a hint.
PLAIN = frozenset(
    "a b area bar block body bottom box btn button buttons c col column container content div el element fixed footer form frame global group header "
    "holder i icon icons id in inner item items js l left link links list lists m main module nav new old outer page panel post r right row s section "
    "site slot small large text thread title top unit view wrap wrapper x xl".split()
)
PAGE_HINTS = frozenset("header masthead topbar".split())  # outside an article only
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

SIGMA = 1.0  # lines
SHARE = 0.85  # of the content cluster's text that the region must hold
LINKS = 0.5  # share of link text from which a line is a menu, where no element marks the article


class Lines(HTMLParser):
    """Collects ``(text, tags, link_chars, side, region, doubtful)`` per line; ``region`` is the number of the innermost open block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int, bool]] = []
        self.parent = [-1]  # of each block
        self.name = [""]
        # tag, and what holds outside: block, side, in an article, the open p, in remarks, doubtful
        self.stack: list[tuple[str, int, bool, bool, int, bool, bool]] = []
        self.open: dict[str, int] = {}
        self.block, self.side, self.inner, self.p_at, self.remarks, self.doubtful = 0, False, False, -1, False, False
        self.articles = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.linked, self.side, self.block, self.doubtful))
        self.parts, self.tags, self.linked = [], 0, 0

    def pop_to(self, at: int) -> None:
        """Close the element at place ``at`` of the stack and all inside it."""
        if any(e[0] in BLOCK or e[0] in SIDE or e[2] != self.side or e[6] != self.doubtful for e in self.stack[at:]):
            self.flush()
        for tag, *_ in self.stack[at:]:
            self.open[tag] -= 1
        tag, self.block, self.side, self.inner, self.p_at, self.remarks, self.doubtful = self.stack[at]
        del self.stack[at:]

    def find(self, tags: set[str], stop: frozenset[str] | set[str]) -> int:
        if not any(self.open.get(t) for t in tags):
            return -1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in tags:
                return at
            if self.stack[at][0] in stop:
                return -1
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
            if self.p_at >= 0:
                self.pop_to(self.p_at)
            if tag in CLOSES and (at := self.find(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})) >= 0:
                self.pop_to(at)
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        at = len(self.stack)
        self.stack.append((tag, self.block, self.side, self.inner, self.p_at, self.remarks, self.doubtful))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag == "p":
            self.p_at = at
        elif tag in SCOPE:
            self.p_at = -1
        side, doubtful, remarks = tag in SIDE, False, False
        if (attrs or tag == "header") and tag not in ("html", "body"):
            hinted, doubtful, remarks = self.hinted(tag, dict(attrs))
            side |= hinted
        if tag in ROOT:
            side, doubtful = remarks, False
            # the first article ends what was left open before it; later ones may stand in side matter
            if not self.remarks and (tag == "main" or not self.articles):
                self.side = self.doubtful = False
            self.inner = True
            self.articles += tag == "article" and not remarks
        if tag in BLOCK:
            self.parent.append(self.block)
            self.name.append(tag)
            self.block = len(self.parent) - 1
        elif side and not self.side or doubtful and not self.doubtful:
            self.flush()
        self.side |= side
        self.doubtful |= doubtful
        self.remarks |= remarks

    def hinted(self, tag: str, attrs: dict[str, str | None]) -> tuple[bool, bool, bool]:
        """Whether the attributes mark side matter, may mark it, and mark reader comments."""
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()
        parts = [[p for p in re.split(r"[^a-z]+", n) if p] for n in names]
        sure = [set(p) for p in parts if p and all(x in HINTS or x in PLAIN for x in p)]
        remarks = any(p & REMARKS for p in sure)
        if tag in ROOT:
            return remarks, False, remarks
        every = {x for p in parts for x in p}
        style = (attrs.get("style") or "").replace(" ", "").lower()
        outer = not self.inner and (tag == "header" or every & PAGE_HINTS)
        side = bool(
            outer or any(p & HINTS for p in sure) or (attrs.get("role") or "").lower() in ROLES or "hidden" in attrs
            or attrs.get("aria-hidden") == "true" or "display:none" in style
        )
        return side, bool(every & HINTS) and not side, remarks

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):
            if tag in BLOCK or tag == "br":
                self.parts.append(" ") if tag == "br" else self.flush()
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        if tag in BLOCK:
            self.flush()
        self.pop_to(at)
        self.tags += 1

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += len(data)


def two_clusters(values: np.ndarray) -> float:
    """The threshold between two clusters: half way between the means that it makes."""
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values <= at], values[values > at]
        if not len(low) or not len(high):
            return at
        now = (float(low.mean()) + float(high.mean())) / 2
        if abs(now - at) < 1e-9:
            break
        at = now
    return at


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), "valid")


def main_text(html: str, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The article's blocks joined by empty lines; '' where there is none."""
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<[A-Za-z/!?]", html[cut : cut + 2]):
        html = html[:cut]  # a tag that the page's end cuts off
    parser = Lines()
    parser.feed(html.replace("<![", "<! ["))
    parser.close()
    parser.flush()
    lines = parser.lines
    if not any(text and not side for text, _, _, side, *_ in lines):
        return ""
    own = np.array([0 if side else max(0, len(text) - linked) for text, _, linked, side, *_ in lines], float)
    ratio = smoothed(np.log1p(own / np.array([max(1, tags) for _, tags, *_ in lines])), sigma)
    content = ratio > two_clusters(ratio)
    high = content & (own > 0)
    if not high.any():
        high = own > 0 if own.any() else np.array([bool(text) and not side for text, _, _, side, *_ in lines])
        own = np.array([len(text) for text, *_ in lines], float)

    weight = np.zeros(len(parser.parent))
    for i in np.flatnonzero(high):
        weight[lines[i][4]] += own[i]
    for b in range(len(weight) - 1, 0, -1):  # parents come before their children
        weight[parser.parent[b]] += weight[b]
    everything = weight[0]
    marked = [b for b in range(len(weight)) if parser.name[b] in ROOT and weight[b] > 0]
    region, split = -1, []
    for kind in ("article", "main"):  # one element, else the parts of a split article together
        own_kind = [b for b in marked if parser.name[b] == kind]
        best = max(own_kind, key=lambda b: (weight[b], -b), default=-1)
        if best >= 0 and weight[best] >= share * everything:
            region = best
            break
        parts = [b for b in own_kind if best >= 0 and parser.parent[b] == parser.parent[best]]
        if len(parts) > 1 and sum(weight[b] for b in parts) >= share * everything:
            region, split = parser.parent[best], parts
            break
    exact = region >= 0 and parser.name[region] in ROOT
    if region < 0:  # the innermost container that holds most of the content cluster
        region = max((b for b in range(len(weight)) if weight[b] >= share * everything and parser.name[b] not in LEAF), default=0)
    inside, in_part = np.zeros(len(weight), bool), np.zeros(len(weight), bool)
    inside[region] = True
    in_part[split] = True
    for b in range(region + 1, len(weight)):
        inside[b] = inside[parser.parent[b]]
        in_part[b] |= in_part[parser.parent[b]]
    linked = np.array([line[2] >= LINKS * max(1, len(line[0])) for line in lines])
    kept = [i for i, (text, _, _, side, block, doubtful) in enumerate(lines) if text and not side and inside[block] and (content[i] or not doubtful)]
    if not exact:  # several lines of links are a menu, a single one is a reference
        menu = {i for a, b in zip(kept[:-1], kept[1:], strict=True) if linked[a] and linked[b] for i in (a, b)}
        if split:  # beside the parts of a split article a single one is a menu, too
            menu |= {i for i in kept if linked[i] and not in_part[lines[i][4]]}
        kept = [i for i in kept if i not in menu]
    return "\n\n".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    A null or empty page, or one without an article, gives an empty text.  Broken
    and cut-off markup is read as far as it goes.  Equal rows give equal rows;
    other columns are ignored; an empty table gives no rows.
    """
    read = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def pages_of(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return read.mapInArrow(pages_of, "page_id long, url string, text string, n_chars long")


@register("op10_html_text")
def op10_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")

"""Main text of web pages.

Parser events of the standard library are streamed into lines, one for each run of text
between block-level tags. Every line has a text-to-tag ratio; the ratios are smoothed with
a Gaussian kernel, and lines at or above a threshold (a share of the ratios' standard
deviation) form the content cluster; a heading belongs to it if the next line does. The
cluster decides on the region: of all containers the one in which the characters of the
cluster's lines outnumber those of other lines by most. A region inside an article or main
element grows to that element, and one around such an element that holds most of the cluster
shrinks to it. In any other region, only containers count that have a line whose own, unsmoothed
ratio reaches the threshold, or that is as long as the cluster's lines are: an advert, a list of links or an imprint beside a text is near enough to it to be smoothed
into the cluster, but has no such line. What stands before the first and after the last
of these is left out, but for the headings right before.

Tags and names only say what the task excludes wherever it stands: navigation, page headers
and footers, side bars, notices, adverts, forms and comments. An element that a name marks
as one of these counts as a wrapper if it holds most of the page's text or the only article.
Everything else in the region is kept, short lines too.

White space inside a line becomes one space; lines are joined by an empty line.

Defined cases: null or empty html, and pages without text, give an empty text; unclosed
and stray tags are tolerated; the time is linear in the page whatever its nesting; repeated
rows are extracted once each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

SIGMA = 1.0
THRESHOLD = 0.5  # times the standard deviation of the smoothed ratios
REGION_SHARE = 0.6  # of the cluster's characters that an article must hold to be the region

SKIPPED = frozenset("head title script style noscript template iframe object svg canvas select option button textarea datalist audio video map".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
REGIONS = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
# blocks that are a part of a text and do not hold a whole one
TEXT_PARTS = frozenset("address blockquote dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup legend li ol p pre summary ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE_BREAKS = frozenset(("br", "wbr"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# tags that a new one ends by itself
ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}
# class, id or role names that mark what is not the article: a listed word, alone or with other
# listed words and names of places and parts ("site-footer", "cookie-notice", "ad-slot-2"); so not
# the state of a page ("with-sidebar", "comments-open") and not the headers of articles
_WORD = (
    r"(?:ads?|advert[a-z]*|adbox|adsense|sponsor[a-z]*|promo[a-z]*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|complementary|footer|masthead|header|"
    r"contentinfo|comments?|disqus|replies|reply|respond|discussion|related|recommended|share|sharing|social|"
    r"subscribe|newsletter|signup|login|widget|toolbar|pagination|pager|tags|search)\d*"
)
_PLACE = (
    r"(?:site|page|main|top|bottom|left|right|primary|secondary|global|mobile|user|article|post|posts|entry|story|stories|list|item|items|"
    r"area|section|box|block|bar|body|meta|author|text|form|buttons?|links?|icons?|slot|unit|container|wrap|wrapper|inner|outer|row|col|\d+)"
)
MARKED = re.compile(rf"(?:{_PLACE}[-_]+)*{_WORD}(?:[-_]+(?:{_WORD}|{_PLACE}))*", re.I)
HEADERS = re.compile(r"(?:^|[-_])(?:header|masthead)\d*(?:$|[-_])", re.I)
OWN_HEADER = re.compile(r"(?:^|[-_])(?:article|post|entry|story)(?:$|[-_])", re.I)
# marks that hold also where most of the page's text is: a thread may outgrow its article
OTHERS = re.compile(r"(?:^|[-_])(?:comments?|disqus|replies|reply|respond|discussion|related|recommended)\d*(?:$|[-_])", re.I)
DISCUSSION = re.compile(r"(?:(?:section|post|article|text|body|content)[-_]+)?discussions?\d*(?:[-_]+(?:section|text|body|content))?", re.I)
WRAPPER_SHARE = 0.5  # of the page's characters: what holds more is not beside the article
COMMENT_END = re.compile(r"--(?:!|\s*)>")
# on a paragraph or another part of a text only these count: what else it is named, it is text
BESIDE = re.compile(r"(?:^|[-_])(?:ads?|advert[a-z]*|adbox|adsense|sponsor[a-z]*|promo[a-z]*|cookies?|consent|gdpr|comments?)\d*(?:$|[-_])", re.I)


@lru_cache(4096)
def _marks(names: str, in_region: bool, part: bool) -> tuple[bool, bool]:
    """Whether names mark what is not the article, and whether they do so in any case."""
    found = [n for n in names.split() if MARKED.fullmatch(n) and not (HEADERS.search(n) and (in_region or OWN_HEADER.search(n)))]
    if in_region:  # a paper's own Discussion
        found = [n for n in found if not DISCUSSION.fullmatch(n)]
    if part:
        found = [n for n in found if BESIDE.search(n)]
    return bool(found), any(OTHERS.search(n) for n in found)


class _Lines(HTMLParser):
    """Collects lines (text, tags since the last line, container, whether a tag excludes it)
    and containers. A container is an open block; container 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.parts: list[str] = []
        self.tags = 0
        # of each container: the one around it, its tag, whether a name marks it
        self.parent, self.tag_of, self.marked = [0], [""], [False]
        # open elements: tag, container, skipped, excluded; and where each tag and the blocks stand
        self.open: list[tuple[str, int, bool, bool]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.regions: list[int] = []  # article and main
        self.walls: list[int] = []  # these and body

    def _state(self) -> tuple[int, bool, bool]:
        return self.open[-1][1:] if self.open else (0, False, False)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                container, _, excluded = self._state()
                self.lines.append((text, self.tags, container, excluded))
                self.tags = 0

    def _truncate(self, size: int) -> None:
        while len(self.open) > size:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            for stack in (self.blocks, self.regions, self.walls):
                if stack and stack[-1] == len(self.open):
                    stack.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE_BREAKS:
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if self.blocks and (around := self.open[self.blocks[-1]][0]) and (around == "p" or around in ENDS.get(tag, ())):
                self._truncate(self.blocks[-1])
        if tag in VOID:
            return
        container, skipped, excluded = self._state()
        in_region = bool(self.regions)
        excluded = excluded or tag in OUTSIDE or (tag == "header" and not in_region)
        excluded = excluded or any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        if tag in BLOCKS:
            marked = False
            if not excluded and tag not in ("body", "html") and tag not in REGIONS:
                names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
                if names:
                    marked, in_any_case = _marks(names, in_region, tag in TEXT_PARTS)
                    excluded = in_any_case
            self.parent.append(container)
            self.tag_of.append(tag)
            self.marked.append(marked)
            container = len(self.parent) - 1
        place = len(self.open)
        self.at[tag].append(place)
        self.open.append((tag, container, skipped or tag in SKIPPED, excluded))
        if tag in BLOCKS:
            self.blocks.append(place)
            if tag in REGIONS:
                self.regions.append(place)
            if tag in REGIONS or tag == "body":
                self.walls.append(place)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if not self.at[tag]:
            return
        place = self.at[tag][-1]
        if tag not in BLOCKS and self.blocks and self.blocks[-1] > place:
            return  # an inline end tag does not close the blocks inside
        if tag not in REGIONS and tag not in ("body", "html") and self.walls and self.walls[-1] > place:
            return  # a stray end tag stays inside its region
        self._truncate(place)

    def parse_comment(self, i: int, report: bool = True) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)  # one that is never closed goes to the end

    def handle_data(self, data: str) -> None:
        if not self._state()[1]:
            self.parts.append(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigma and renormed at the ends."""
    radius = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        own = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(a * b for a, b in zip(values[lo:hi], own)) / sum(own))
    return out


def ratios(lines: list[tuple], sigma: float = SIGMA) -> list[float]:
    """The smoothed text-to-tag ratio of each line (as it is for a sigma of 0); excluded lines
    have none."""
    own = [0.0 if x[3] else len(x[0]) / max(1, x[1]) for x in lines]
    return smooth(own, sigma) if sigma > 0 else own


def cluster(values: list[float], threshold: float = THRESHOLD) -> list[bool]:
    """Whether each line's ratio is at least a share of the ratios' standard deviation."""
    mean = sum(values) / max(1, len(values))
    spread = math.sqrt(sum((r - mean) ** 2 for r in values) / max(1, len(values)))
    return [r >= threshold * spread for r in values]


def _sums(parent: list[int], lines: list[tuple], values: list[int]) -> list[int]:
    """For each container the sum over all lines in it, at any depth."""
    out = [0] * len(parent)
    for x, v in zip(lines, values):
        out[x[2]] += v
    for c in range(len(parent) - 1, 0, -1):  # a container comes after the one around it
        out[parent[c]] += out[c]
    return out


def _excluded(parser: _Lines) -> list[bool]:
    """Containers that a name excludes, and all inside. A marked one that holds most of the
    page's text, or its article or main element where no such element is unmarked, is around
    the article and not beside it."""
    parent, marked = parser.parent, parser.marked
    sizes = [0 if x[3] else len(x[0]) for x in parser.lines]
    held = _sums(parent, parser.lines, sizes)
    is_region = [t in REGIONS and held[c] > 0 for c, t in enumerate(parser.tag_of)]
    under = list(marked)  # whether it or one around it is marked
    for c in range(1, len(parent)):
        under[c] = marked[c] or under[parent[c]]
    free = any(r and not u for r, u in zip(is_region, under))
    has_region = list(is_region)
    for c in range(len(parent) - 1, 0, -1):
        has_region[parent[c]] = has_region[parent[c]] or has_region[c]
    total = sum(len(x[0]) for x in parser.lines)
    out = [False] * len(parent)
    for c in range(1, len(parent)):
        wrapper = held[c] > WRAPPER_SHARE * total or (has_region[c] and not free)
        out[c] = out[parent[c]] or (marked[c] and not wrapper)
    return out


def _region(parser: _Lines, lines: list[tuple], content: list[bool]) -> int:
    """The container that the content cluster selects."""
    parent, tag_of = parser.parent, parser.tag_of
    values = [0 if x[3] else len(x[0]) if c else -len(x[0]) for x, c in zip(lines, content)]
    gain = _sums(parent, lines, values)
    held = _sums(parent, lines, [v if v > 0 else 0 for v in values])
    best = 0
    for c in range(1, len(parent)):  # of equal ones the innermost
        if gain[c] >= gain[best] and held[c] and tag_of[c] not in TEXT_PARTS:
            best = c
    around = best
    while around and tag_of[around] not in REGIONS:
        around = parent[around]
    if around:
        return around
    inside = [False] * len(parent)
    inside[best] = True
    for c in range(best + 1, len(parent)):
        inside[c] = inside[parent[c]]
    named = [c for c in range(best, len(parent)) if inside[c] and tag_of[c] in REGIONS and held[c] >= REGION_SHARE * held[best]]
    return max(named, key=lambda c: (held[c], c), default=best)


def blocks(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> list[str]:
    """The blocks of the main text, in page order."""
    if not html:
        return []
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    dropped = _excluded(parser)
    lines = [(*x[:3], x[3] or dropped[x[2]]) for x in parser.lines]
    if all(x[3] for x in lines):
        return []
    content = cluster(ratios(lines, sigma), threshold)
    following = False
    for i in range(len(lines) - 1, -1, -1):
        if not lines[i][3]:
            content[i] = content[i] or (following and parser.tag_of[lines[i][2]] in HEADINGS)
            following = content[i]
        else:
            content[i] = False
    region = _region(parser, lines, content)
    inside, holder = [False] * len(parser.parent), list(range(len(parser.parent)))
    for c in range(len(inside)):
        inside[c] = c == region or (c > 0 and inside[parser.parent[c]])
        if c and parser.tag_of[c] in TEXT_PARTS:
            holder[c] = holder[parser.parent[c]]  # the container that this part of a text stands in
    kept = [i for i, x in enumerate(lines) if inside[x[2]] and not x[3]]
    if parser.tag_of[region] not in REGIONS:
        dense = cluster(ratios(lines, 0), threshold)
        sizes = [len(lines[i][0]) for i in kept if content[i]]
        usual = sum(n * n for n in sizes) / max(1, sum(sizes))  # as long as the line of a character is on average
        with_content = {holder[lines[i][2]] for i in kept if content[i] and (dense[i] or len(lines[i][0]) >= usual)}
        found = [i for i in kept if content[i] and holder[lines[i][2]] in with_content]
        if found:
            first = found[0]
            for i in reversed([i for i in kept if i < first]):  # headings in containers of their own
                if parser.tag_of[lines[i][2]] not in HEADINGS:
                    break
                first = i
            kept = [i for i in kept if first <= i <= found[-1] or holder[lines[i][2]] in with_content]
    return [lines[i][0] for i in kept]


def extract_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    return "\n\n".join(blocks(html, sigma, threshold))


def extract(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(v.as_py(), sigma, threshold) for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

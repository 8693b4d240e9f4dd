"""Main text of web pages from parser events and the ratio of text to tags.

The standard library's parser streams events. Every block element opens a new line; a line knows
its pieces of text with the element each stands in, and the tags met since the line before. The
ratio of unlinked text to tags is smoothed over neighbouring lines by a Gaussian and split in two
clusters. Lines of the upper one are seeds. The content region is what ``main`` or the articles
hold, if at least half of the seeds' text is theirs, else the page. All lines of an article in the
region belong to the text, other lines if they lie between two seeds, stand beside one (same
container), or are sentences of a paragraph. Runs of link lines in the lower cluster are menus and go, inside articles as well.

Elements are set apart by tag and role (menu, footer, aside, header outside the content), by
names in class and id, and as forms. Names are weak evidence: a name counts as a whole
(``sidebar``, ``comment-list``, ``site-footer``, but not ``no-sidebar`` or ``notice-period``),
never for headings, and neither a name nor a form sets apart what holds the content: ``main`` or
the article with the heading or most text, or, without both, more than half of the text.

White space (as Unicode has it, no-break space included) inside a line becomes one space; lines
are joined in page order by a line feed.

Defined cases: null and empty pages and pages without text give an empty text; markup that
breaks off is read to its end; an unclosed tag at the end counts as text, and the time stays
linear in the page; repeated rows are read one by one; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"

SIGMA = 1.0
LINK_SHARE = 0.8
LINK_RUN = 3
SENTENCE_WORDS = 5

# Names of the markup language.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("blockquote dd dl dt li ol p pre ul".split())
BLOCKS = PROSE | frozenset(
    "address article aside body caption center details dialog dir div fieldset figcaption figure footer form "
    "head header hr html legend main menu nav section summary table tbody td tfoot th thead tr".split()
)
BOXES = BLOCKS - PROSE
#: An element of a key ends where one of its values opens directly inside.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
SILENT = frozenset("annotation audio button canvas datalist iframe noscript object option script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("aside dialog footer menu nav".split())
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disclaimer disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications pager "
    "pagination paywall popup promo promotion recommended recommendations related replies reply search share sharebar sharing sidebar sidenav signup "
    "skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
#: What may follow such a name and leave its meaning: boxes, places, sizes.
BESIDE_NAMES = frozenset(
    "area bar block body bottom box buttons column container content count entry form group header heading inner item items left link links list main outer "
    "panel right row section site text thread title top unit wrap wrapper".split()
)
#: What says that the named thing is a state of the page, not the element itself.
STATES = frozenset("has hide no not show with without".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_SENTENCE_END = re.compile(r"[.!?:…。！？][\"'”’»)\]]*$")

OPEN, NAMED, FORM, SHUT = 0, 1, 2, 3


def furniture(token: str) -> bool:
    """Whether one token of a class or an id names page furniture as a whole."""
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words or words[0] in STATES:
        return False
    if token.lower() in APART_NAMES or words[-1] in APART_NAMES:
        return True
    return words[0] in APART_NAMES and all(w in BESIDE_NAMES or w in APART_NAMES or w.isdigit() for w in words[1:])


class Lines(HTMLParser):
    """Parser events to lines (block, pieces of (element, text, linked), tags) and a tree of elements by parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, list[tuple[int, str, bool]], int]] = []
        self.parents, self.tags, self.flags = [0], ["page"], [OPEN]
        self.blocks, self.containers = [0], [0]  # nearest block, nearest block that is no prose
        self.open = [0]
        self.counts: Counter = Counter()
        self.silent: list[str] = []
        self.linked = False
        self.parts: list[tuple[int, str, bool]] = []
        self.tags_met = 0

    # An opening that no later character closes is looked for once, not once per opening.

    def goahead(self, end):
        self.last_close = self.rawdata.rfind(">")
        self.endless: set[str] = set()
        super().goahead(end)

    def parse_starttag(self, i):
        return -1 if i > self.last_close else super().parse_starttag(i)

    def parse_endtag(self, i):
        return -1 if i > self.last_close else super().parse_endtag(i)

    def parse_comment(self, i, report=1):
        return self._once("comment", super().parse_comment, i, report)

    def parse_marked_section(self, i, report=1):
        return self._once("section", super().parse_marked_section, i, report)

    def _once(self, kind: str, parse, i: int, report: int) -> int:
        if kind in self.endless:
            return -1
        found = parse(i, report)
        if found < 0:
            self.endless.add(kind)
        return found

    def end_line(self) -> None:
        if any(x[1].strip() for x in self.parts):
            self.lines.append((self.blocks[self.open[-1]], self.parts, self.tags_met))
            self.tags_met = 0
        self.parts = []

    def _flag(self, tag: str, attrs) -> int:
        if tag in ("html", "body", "main", "head"):
            return OPEN
        if tag in APART or tag == "header" and not self.counts["article"] and not self.counts["main"]:
            return SHUT
        flag = FORM if tag == "form" else OPEN
        for name, value in attrs:
            value = (value or "").strip()
            if name == "hidden" or name == "style" and "display:none" in value.replace(" ", "").lower():
                return SHUT
            if name == "role" and tag != "article" and value.lower() in APART_ROLES:
                return SHUT
            if name == "role" and value.lower() == "form":
                flag = FORM
            if tag in HEADINGS or flag == FORM:
                continue
            if name == "aria-hidden" and value.lower() == "true" or name in ("class", "id") and any(furniture(x) for x in value.split()):
                flag = NAMED
        return flag

    def _close(self) -> None:
        self.counts[self.tags[self.open.pop()]] -= 1

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.append(tag)
            return
        self.tags_met += 1
        if tag in SILENT:
            self.silent.append(tag)
            return
        if tag in BLOCKS:
            self.end_line()
            if self.tags[self.open[-1]] == "p" or self.tags[self.open[-1]] in HEADINGS and tag in HEADINGS:
                self._close()
            while tag in ENDED_BY.get(self.tags[self.open[-1]], ()):
                self._close()
        if tag == "br":
            self.parts.append((self.open[-1], " ", False))
        if tag == "a":
            self.linked = True
        if tag in VOID:
            return
        flag = self._flag(tag, attrs)
        # Inline elements matter if they are set apart; those of the same name inside are counted then.
        if flag or tag in BLOCKS or self.counts[tag]:
            e, parent = len(self.tags), self.open[-1]
            self.parents.append(parent)
            self.tags.append(tag)
            self.flags.append(flag)
            self.blocks.append(e if tag in BLOCKS else self.blocks[parent])
            self.containers.append(e if tag in BOXES else self.containers[parent])
            self.open.append(e)
            self.counts[tag] += 1

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent[-1]:
                self.silent.pop()
            elif tag in ("body", "html"):
                self.silent.clear()
            return
        if tag in BLOCKS:
            self.end_line()
        self.tags_met += 1
        if tag == "a":
            self.linked = False
        if self.counts[tag]:
            while self.tags[self.open[-1]] != tag:
                self._close()
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append((self.open[-1], data, self.linked))


def parse(html: str) -> Lines:
    for page in (html, html.replace("<!", "&lt;!")):
        lines = Lines()
        try:
            lines.feed(page)
            lines.close()
        except AssertionError:  # a declaration that the parser can't read; then it counts as text
            continue
        break
    lines.end_line()
    return lines


def inherited(page: Lines, own: list[bool]) -> list[bool]:
    """For every element whether it or one around it has the mark; parents come before children."""
    marks = list(own)
    for e in range(1, len(marks)):
        marks[e] = marks[e] or marks[page.parents[e]]
    return marks


def summed(page: Lines, own: list[int]) -> list[int]:
    """For every element the sum of its own value and those inside."""
    sums = list(own)
    for e in range(len(sums) - 1, 0, -1):
        sums[page.parents[e]] += sums[e]
    return sums


def apart(page: Lines) -> list[bool]:
    """For every element whether its text is no content."""
    if not any(page.flags):
        return [False] * len(page.flags)
    shut = inherited(page, [f == SHUT for f in page.flags])
    chars, titles = [0] * len(shut), [0] * len(shut)
    for block, parts, _ in page.lines:
        titles[block] += page.tags[block] == "h1" and not shut[block]
        for e, text, _ in parts:
            chars[e] += 0 if shut[e] else len(text)
    chars, titles = summed(page, chars), summed(page, titles)
    articles = [e for e, tag in enumerate(page.tags) if tag == "article" and page.flags[e] == OPEN and chars[e]]
    core = [e for e, tag in enumerate(page.tags) if tag == "main" and chars[e]]
    if not core and articles:
        core = [max(articles, key=lambda e: (titles[e] > 0, chars[e], -e))]
    around = summed(page, [0] * len(shut))
    for e in core[:1]:
        while e and not around[e]:
            around[e], e = 1, page.parents[e]
    holds = [bool(around[e]) if core else 2 * chars[e] > chars[0] for e in range(len(shut))]
    return inherited(page, [f == SHUT or f in (NAMED, FORM) and not holds[e] for e, f in enumerate(page.flags)])


def upper_cluster(ratios: np.ndarray) -> np.ndarray:
    """Which smoothed ratios lie above the threshold between the means of two clusters."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    smooth = padded / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    cut = smooth.mean()
    for _ in range(50):
        high = smooth >= cut
        if high.all() or not high.any():
            return high
        new = (smooth[high].mean() + smooth[~high].mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return smooth >= cut


def main_text(html: str) -> str:
    """The content lines of a page, joined by a line feed."""
    if not html:
        return ""
    page = parse(html)
    hidden = apart(page)
    texts, ratios, links = [], [], []
    for _, parts, tags in page.lines:
        shown = [x for x in parts if not hidden[x[0]]]
        texts.append(" ".join("".join(x[1] for x in shown).split()))
        linked = sum(len(x[1].strip()) for x in shown if x[2])
        links.append(bool(texts[-1]) and linked >= LINK_SHARE * len(texts[-1]))
        ratios.append(max(len(texts[-1]) - linked, 0) / max(tags, 1))
    kept = [i for i, text in enumerate(texts) if text]
    if not kept:
        return ""
    high = upper_cluster(np.array(ratios))
    seeds = [i for i in kept if high[i] and not links[i]] or kept
    blocks = [x[0] for x in page.lines]
    articles = inherited(page, [t == "article" for t in page.tags])
    for marks in (inherited(page, [t == "main" for t in page.tags]), articles):
        inside = [i for i in kept if marks[blocks[i]]]
        if 2 * sum(len(texts[i]) for i in seeds if marks[blocks[i]]) >= sum(len(texts[i]) for i in seeds):
            kept, seeds = inside, [i for i in seeds if marks[blocks[i]]]
            break
    else:
        articles = [False] * len(articles)
    anchors = [i for i in kept if articles[blocks[i]]] + seeds
    seeded = [0] * len(page.tags)
    for i in anchors:
        seeded[blocks[i]] = 1
    seeded = summed(page, seeded)
    first, last, anchored = min(anchors), max(anchors), set(anchors)

    def belongs(i: int) -> bool:
        if i in anchored or first < i < last:
            return True
        if seeded[page.containers[blocks[i]]] or page.tags[blocks[i]] == "h1":
            return True
        text = texts[i]
        return page.tags[blocks[i]] in PROSE and len(text.split()) >= SENTENCE_WORDS and bool(_SENTENCE_END.search(text)) and not text.startswith("©")

    chosen = [i for i in kept if belongs(i)]
    out, run = [], []
    for i in [*chosen, None]:
        if i is not None and links[i] and not high[i] and page.tags[blocks[i]] not in HEADINGS:
            run.append(i)
            continue
        if len(run) < LINK_RUN and all(articles[blocks[j]] or page.lines[j][2] < 2 for j in run):
            out += run
        run = []
        if i is not None:
            out.append(i)
    return "\n".join(texts[i] for i in out or chosen)


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            out = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])

    own = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    return own.mapInArrow(extracted, SCHEMA)

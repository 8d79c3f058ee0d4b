"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; block elements end lines. Each line has a ratio of its characters to
its tags; logarithms of the ratios are smoothed with a Gaussian, and a threshold between their two clusters says
which lines are content. Content lines vote for the regions (the elements) around them, and the votes decide: the text is looked for
in ever smaller regions as long as one of them has most of the votes, and what stands beside content without being
like it goes. Names are hints only: a class, id, role or tag that usually isn't main text (menus, notices, comments)
removes its region unless that wraps most of the page's votes, and an article or main counts twice when regions are
compared. Inside the chosen region every line stays, short ones too. Scripts, styles and form fields are no text.
All steps take time in proportion to the page, however deep its elements are.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import ship

SIGMA, RADIUS = 1.0, 3
#: Clusters whose means differ by a smaller factor are one cluster: all is content.
APART = 10.0
#: Of the characters of content lines, the share that the chosen region must hold.
SHARE = 0.8
#: A second article on a page is main text if it has at least this share of the largest one's content.
SECOND = 0.5
#: Lines beside the region with most content stay if more than this share of their characters is like content.
BESIDE = 0.75
#: A marked region with a line of so many characters and most of the content is a wrapper of the page.
WRAPPED = 80
#: Elements whose regions may be the text's; the text is not looked for inside paragraphs, lists and the like.
HOLDERS = frozenset("html body div section table tbody tr td center form main article header".split())
NAMED = frozenset(("article", "main"))

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template iframe object svg math canvas audio video button select textarea input".split())
#: Tags and roles that mark what isn't main text.
ASIDE = frozenset("nav aside footer dialog menu form".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar status".split())
#: Words of a class or id that mark what isn't main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments commentlist respond "
    "replies disqus share sharing social related recommended widget toolbar skip".split()
)
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = ("h1", "h2", "h3")
RIGHTS = re.compile(r"©|(?i:\bcopyright\b|all rights reserved)")
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Open:
    """The open elements, with the places of each tag and of blocks, so that no look-up walks down the stack."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, region, whether its text is left out
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, region: int, out: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.rows))
        if tag not in INLINE:
            self.blocks.append(len(self.rows))
        self.rows.append((tag, region, out))

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, 0 if there is none."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def close(self, i: int) -> None:
        """Closes the element at a place and all inside it."""
        for tag, _, _ in self.rows[i:]:
            self.at[tag].pop()
        del self.rows[i:]
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()


class _Lines(HTMLParser):
    """Collects lines (text, tags since the line before, region) and regions (parent, tag, whether marked)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = _Open()
        self.parent = [-1]
        self.kind = [""]
        self.marked: dict[int, bool] = {}  # whether the mark is a name, which wrappers of the whole page have too
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []

    def end_line(self) -> None:
        words = "".join(self.text).split()
        if words and not self.open.rows[-1][2]:
            self.lines.append((" ".join(words), self.tags, self.open.rows[-1][1]))
            self.tags = 0
        self.text.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        out, marked = self._left_out(tag, dict(attrs)) if attrs or tag not in INLINE else (False, False)
        inline = tag in INLINE and not out and not marked
        if not inline:
            self.end_line()
            self._close_before(tag)
        if tag in VOID:
            return
        _, region, hidden = self.open.rows[-1]
        if not inline:
            self.parent.append(region)
            self.kind.append(tag)
            region = len(self.parent) - 1
            if marked or (tag == "header" and not any(map(self.open.last, NAMED))):
                self.marked[region] = tag not in ASIDE or tag == "form"
        self.open.push(tag, region, hidden or out)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        i = self.open.last(tag)
        if not i:
            return
        if tag not in INLINE or self.open.rows[i][1:] != self.open.rows[i - 1][1:]:
            self.end_line()
        elif self.open.blocks and self.open.blocks[-1] > i:
            return  # an inline element doesn't close the blocks inside it
        self.open.close(i)

    def handle_data(self, data: str) -> None:
        if not self.open.rows[-1][2]:
            self.text.append(data)

    def _close_before(self, tag: str) -> None:
        """A block element ends an open paragraph, and an item the item before, with what is open inside."""
        ends = {"li": ("li", ("ul", "ol")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "option": ("option", ("select",))}
        if tag in ends:
            own, stops = ends[tag]
            i = self.open.last(own)
            if i > max(map(self.open.last, stops)):
                self.open.close(i)
        elif self.open.blocks and self.open.rows[self.open.blocks[-1]][0] == "p":
            self.open.close(self.open.blocks[-1])

    @staticmethod
    def _left_out(tag: str, attrs: dict) -> tuple[bool, bool]:
        """Whether the text of an element is never shown as text, and whether it is marked as no main text."""
        if tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("style") and re.search(r"display\s*:\s*none", attrs["style"])):
            return True, False
        if tag in ASIDE or (attrs.get("role") or "").lower() in ROLES:
            return False, True
        if not attrs or tag in ("html", "body"):
            return False, False
        if tag in NAMED:
            return False, bool({"comment", "comments"} & {*_SPLIT.split((attrs.get("class") or "").lower())})
        named = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        if tag in TEXT:  # a heading or paragraph is named by its topic: all words of a name must be marks
            return False, any(MARKS.issuperset(w) for x in named.split() if (w := [y for y in _SPLIT.split(x) if y]))
        return False, named != " " and not MARKS.isdisjoint(_SPLIT.split(named))


def smooth(x: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian means; near the ends, over the values that are there."""
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(x, k)[radius : radius + len(x)] / np.convolve(np.ones(len(x)), k)[radius : radius + len(x)]


def threshold(x: np.ndarray, rounds: int = 20) -> float:
    """The middle between the means of two clusters (two-means from the extremes); the least value if they aren't apart."""
    low, high = float(x.min()), float(x.max())
    for _ in range(rounds):
        cut = (low + high) / 2
        below, above = x[x <= cut], x[x > cut]
        new = (float(below.mean()) if len(below) else low, float(above.mean()) if len(above) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low >= np.log(APART) else float(x.min())


class _Votes:
    """What the lines say about regions. Parents come before their children, so one pass each way is enough."""

    def __init__(self, lines: list[tuple[str, int, int]], parent: list[int], kind: list[str]):
        self.parent = parent
        chars = np.array([len(t) for t, _, _ in lines], dtype=float)
        tags = np.maximum(1, [n for _, n, _ in lines])
        ratio = np.log1p(chars / tags)
        even = smooth(ratio)
        cut = threshold(even)
        self.content = even >= cut
        # lines that are like content: headings, and those whose own ratio is over the threshold
        like = self.content | (ratio >= cut) | np.array([kind[r] in HEADINGS for _, _, r in lines])
        like &= ~np.array([bool(RIGHTS.search(t)) for t, _, _ in lines])
        at = np.array([r for _, _, r in lines])
        self.votes, self.good, self.size, self.longest = (np.zeros(len(parent)) for _ in range(4))
        np.add.at(self.votes, at, chars * self.content)
        np.add.at(self.good, at, chars * like)
        np.add.at(self.size, at, chars)
        np.maximum.at(self.longest, at, chars)
        for r in range(len(parent) - 1, 0, -1):
            for x in (self.votes, self.good, self.size):
                x[parent[r]] += x[r]
            self.longest[parent[r]] = max(self.longest[parent[r]], self.longest[r])

    def down(self, own: list, of) -> list:
        """own[r], or where that is None what of() gives for the parent's value."""
        for r in range(1, len(own)):
            if own[r] is None:
                own[r] = of(own[self.parent[r]])
        return own


def _unmarked(p: _Lines) -> list[tuple[str, int, int]]:
    """The lines outside marked regions. A marked region stays if it has an article or main with most of the page's
    votes, or, if a name or a form marks it, most votes and a long line: wrappers of a whole page have such names."""
    v = _Votes(p.lines, p.parent, p.kind)
    big = v.votes >= SHARE * v.votes[0]
    holds = np.zeros(len(p.parent), dtype=bool)  # an article or main with most votes is inside
    for r in range(len(p.parent) - 1, 0, -1):
        if holds[r] or (p.kind[r] in NAMED and big[r] and r not in p.marked):
            holds[p.parent[r]] = True
    gone = v.down([True if r in p.marked and not (holds[r] or (p.marked[r] and big[r] and v.longest[r] >= WRAPPED)) else None if r else False for r in range(len(p.parent))], bool)
    return [x for x in p.lines if not gone[x[2]]]


def main_text(html: str | None) -> str:
    p = _Lines()
    p.feed(html or "")
    p.close()
    p.end_line()
    lines = _unmarked(p) if p.marked and p.lines else p.lines
    if not lines:
        return ""
    parent, kind = p.parent, p.kind
    v = _Votes(lines, parent, kind)
    children: list[list[int]] = [[] for _ in parent]
    named = np.zeros(len(parent))  # the votes of the largest article or main at or inside a region
    for r in range(len(parent) - 1, 0, -1):
        if kind[r] in NAMED:
            named[r] = v.votes[r]
        named[parent[r]] = max(named[parent[r]], named[r])
        if v.size[r]:
            children[parent[r]].append(r)
    here = 0
    while kind[here] != "article":
        # of the regions inside, the one with most votes; those of an article or main count twice
        best = max(children[here], key=lambda r: (v.votes[r] + named[r], -r), default=None)
        if best is None or kind[best] not in HOLDERS or v.votes[best] + named[best] < SHARE * (v.votes[here] + named[best]):
            break
        # lines beside it stay if most of their characters are like content or headings
        if not named[best] and v.good[here] - v.good[best] > BESIDE * (v.size[here] - v.size[best]):
            break
        here = best
    inside, top, above = [False] * len(parent), [0] * len(parent), [False] * len(parent)
    articles: list[int] = []  # the outermost ones inside
    for r in range(1, len(parent)):
        up = parent[r]
        inside[r] = up == here or inside[up]
        top[r] = r if up == here else top[up]
        above[r] = above[up] or kind[up] == "article"
        if inside[r] and kind[r] == "article" and not above[r] and v.size[r]:
            articles.append(r)
    inside[here] = True
    if articles and sum(v.votes[r] for r in articles) >= SHARE * v.votes[here]:
        most = max(v.votes[r] for r in articles)
        chosen = [False] * len(parent)
        for r in articles:
            chosen[r] = bool(v.votes[r] >= SECOND * most)
        for r in range(1, len(parent)):
            chosen[r] = chosen[r] or chosen[parent[r]]
        keep = chosen
    elif kind[here] in NAMED:
        keep = inside
    else:  # of the blocks side by side, those that are mostly no content go, unless headings and the like make up for it
        stays = (2 * v.votes >= v.size) | (v.good > BESIDE * v.size)
        keep = [inside[r] and (r == here or bool(stays[top[r]])) for r in range(len(parent))]
    return "\n".join(t for t, _, r in lines if keep[r])


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds to pages (or replaces) the column text: the main text of each whole page, one block per line; empty where
    there is none, as for null or empty html. Each row stands alone, repeated rows and very long pages too; of regions
    with equal votes the first counts, and equal articles all stay. Any other columns stay as they are."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def of(s: pd.Series) -> pd.Series:
        return s.map(main_text, na_action=None)

    return pages.withColumn(text, of(F.coalesce(F.col(html), F.lit(""))))

"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's streaming parser sends start, end and text events.  Text between block
boundaries is one line with its count of tags; a line knows the containers it lies in.  Lines in
boilerplate (menus, adverts, forms, notices, comments and the like, by element, role, class or id) take no part.  A block's class
or id doesn't count if an article or main element lies in it and its own text-to-tag ratio isn't low (under half the
page's), or if nothing else is on the page.  The text-to-tag
ratios of the others are smoothed by a Gaussian along the page and compared with a threshold
(the standard deviation of the smoothed ratios, at most their mean); runs of lines over it are clusters.  A
cluster selects the regions that give it a line over the threshold by itself: the article or main element,
or outside of those the block that holds the line.  A region is kept whole, so its short lines stay.

What names leave open is decided by the ratios:
- Names that as often stand for a topic (a discussion, related work, a share's price), and any id of a section or heading, only weigh: a
  block of such a name stays within the article if its text reaches the threshold with that weight and mostly isn't links.
- Articles within an article are its parts, unless the article has text over the threshold besides them: then they are readers' comments.
  An article named a comment always is.
- Of several articles those of under a third of the longest are cards for other pages.
- Where each block has a container of its own, blocks between those that a cluster selects belong to it, headings before them too, and
  after the last one those that are sentences; blocks of links don't.

Defined results: a null or empty html gives an empty text; text outside any tag counts as a line of the
body; unclosed elements end with their parent or the page; rows that repeat give repeated rows; extra columns
are left out; an empty table gives an empty result; a page of any length is parsed whole, in time and memory
proportional to its length.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import small_batches

#: Element names of HTML by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title noscript template svg math iframe object canvas audio video select textarea button datalist".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of class and id that mark page furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments respond replies disqus footer masthead topbar toolbar pagination pager widget disclaimer skip".split()
)
#: Words of class and id that mark page furniture or a topic of the text.
TOPICS = frozenset("discussion share sharing social related recommended".split())
#: Words that mark readers' comments on any element.
COMMENTS = frozenset("comment comments respond replies disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The weight of a ratio in a block that a topic's name marks; the share of links that makes a block a list of them; that of the longest article under which others are cards.
TOPIC_WEIGHT, LINKS_SHARE, CARD_SHARE = 0.5, 0.5, 1 / 3
SENTENCE = re.compile(r"[.!?。！？…][\"'”’»)]*$")
#: Class names that make an article element a reader's comment.
COMMENT_NAMES = frozenset("comment comments comment-body comment-item reply replies response user-comment".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: An element that a start tag of the same group ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Line:
    """A run of text between block boundaries.  marked and topics number the blocks around it that a name marks, parts the articles within an article."""

    text: str
    tags: int
    region: int
    marked: tuple[int, ...] = ()
    topics: tuple[int, ...] = ()
    parts: tuple[int, ...] = ()
    heading: bool = False
    linked: int = 0

    @property
    def ratio(self) -> float:
        return len(self.text) / max(1, self.tags)


@dataclass
class Open:
    """An open element: its name, whether it's boilerplate, its region, whether an article is around it, and the marked blocks and parts it lies in."""

    tag: str = ""
    hidden: bool = False
    region: int = 0
    article: bool = False
    marked: tuple[int, ...] = ()
    topics: tuple[int, ...] = ()
    parts: tuple[int, ...] = ()
    link: bool = False


class Lines(HTMLParser):
    """Turns parser events into lines; boilerplate leaves none, but for blocks marked by class or id."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        self.marked = 0
        self.around_article: set[int] = set()
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.parents = {0: 0}
        self.articles: set[int] = set()

    @property
    def last(self) -> Open:
        return self.open[-1] if self.open else Open()

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                o = self.last
                heading = any(x.tag in HEADINGS for x in self.open[-3:])
                self.lines.append(Line(line, self.tags, o.region, o.marked, o.topics, o.parts, heading, min(self.linked, len(line))))
            self.text = []
        self.tags = self.linked = 0

    def furniture(self, tag: str, attrs: dict, article: bool) -> bool:
        if tag in BOILERPLATE or tag in UNSEEN or (tag == "header" and not article):
            return True
        if not attrs or tag in ("html", "body", "article", "main"):
            return False
        return attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(HIDDEN.search(attrs.get("style", "")))

    def mark(self, tag: str, attrs: dict) -> str:
        """What the names of an element say: "furniture", "topic", or nothing."""
        if tag == "article":
            named = attrs.get("class", "").lower().split() + [attrs.get("itemprop", "").lower()]
            return "" if COMMENT_NAMES.isdisjoint(named) else "furniture"
        if not attrs or tag in ("html", "body", "main"):
            return ""
        words = lambda k: frozenset(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", attrs.get(k, "")).lower()))
        names, ids = words("class"), words("id")
        # an id of a section or a heading says what it is about
        about = tag == "section" or tag in HEADINGS
        if not MARKS.isdisjoint(names) or not COMMENTS.isdisjoint(ids) or (not about and not MARKS.isdisjoint(ids)):
            return "furniture" if tag not in HEADINGS or not MARKS.isdisjoint(names) else ""
        if tag in HEADINGS:
            return ""
        return "" if (MARKS | TOPICS).isdisjoint(names | ids) else "topic"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in UNSEEN:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        for k in range(len(self.open) - 1, max(-1, len(self.open) - 4), -1):
            if tag in ENDS and self.open[k].tag in ENDS[tag]:
                del self.open[k:]
                break
            if self.open[k].tag in BLOCKS and tag in ENDS and self.open[k].tag != "p":
                break
        o, values = self.last, {k: v or "" for k, v in attrs}
        hidden = o.hidden or self.furniture(tag, values, o.article)
        mark = "" if hidden else self.mark(tag, values)
        new = Open(tag, hidden, o.region, o.article, o.marked, o.topics, o.parts, o.link or tag == "a")
        part = tag == "article" and any(x.tag == "article" for x in self.open)
        if tag in ("article", "main") and not hidden and not mark and not part:
            self.around_article.update(o.marked)
        if mark and tag in BLOCKS:
            self.marked += 1
            if mark == "topic":
                new.topics = (*o.topics, self.marked)
            else:
                new.marked = (*o.marked, self.marked)
        elif mark == "furniture":
            new.hidden = True
        elif part:
            self.marked += 1
            new.parts = (*o.parts, self.marked)
        if not o.article and tag in ("article", "main", "div", "section", "td", "body"):
            new.region = len(self.parents)
            self.parents[new.region] = o.region
            if tag in ("article", "main"):
                new.article = True
                self.articles.add(new.region)
        self.open.append(new)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in UNSEEN:
            self.flush()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break
            if self.open[k].tag in ("article", "main", "body", "div", "section") and tag not in BLOCKS:
                break

    def handle_data(self, data: str) -> None:
        if not self.open or not self.open[-1].hidden:
            self.text.append(data)
            if self.last.link:
                self.linked += len(data.strip())


def smoothed(ratios: list[float], sigma: float = 1.0, radius: int = 2) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(w, ratios[i + d]) for d, w in zip(range(-radius, radius + 1), kernel, strict=True) if 0 <= i + d < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def ratio(lines: list[Line]) -> float:
    return sum(len(x.text) for x in lines) / max(1, sum(x.tags for x in lines))


def links(lines: list[Line]) -> float:
    """The share of the text that is links."""
    return sum(x.linked for x in lines) / max(1, sum(len(x.text) for x in lines))


def unmarked(lines: list[Line], around_article: set[int]) -> list[Line]:
    """The lines outside of marked blocks; marks of blocks around an article count if the block's ratio is under half the page's."""
    low = {m for m in around_article if 2 * ratio([x for x in lines if m in x.marked]) < ratio(lines)}
    return [x for x in lines if all(m in around_article and m not in low for m in x.marked)] or lines


def threshold(lines: list[Line]) -> tuple[list[float], float]:
    """The smoothed ratios, and what they must reach."""
    score = smoothed([x.ratio for x in lines])
    mean = sum(score) / len(score)
    return score, min(mean, math.sqrt(sum((s - mean) ** 2 for s in score) / len(score)))


def content_regions(lines: list[Line]) -> set[int]:
    """The regions that hold a line whose ratio, by itself and smoothed, reaches the threshold."""
    score, least = threshold(lines)
    regions = {x.region for x, s in zip(lines, score, strict=True) if s >= least and x.ratio >= least}
    # lines so short beside their neighbours that none stands by itself
    return regions or {x.region for x, s in zip(lines, score, strict=True) if s >= least}


def within_articles(lines: list[Line], articles: set[int]) -> list[Line]:
    """The lines without blocks of topics' names that aren't text of an article, and without readers' comments on one."""
    plain = [x for x in lines if not x.topics and not x.parts]
    _, least = threshold(plain or lines)
    blocks: dict[int, list[Line]] = {}
    for x in lines:
        for b in x.topics:
            blocks.setdefault(b, []).append(x)
    kept = {b for b, own in blocks.items() if own[0].region in articles and links(own) < LINKS_SHARE and max(x.ratio for x in own) * TOPIC_WEIGHT >= min(least, ratio(lines) * TOPIC_WEIGHT)}
    commented = {x.region for x in plain if not x.heading and x.ratio >= least}
    out = [x for x in lines if all(b in kept for b in x.topics) and not (x.parts and x.region in commented)]
    return out or lines


def without_cards(lines: list[Line], regions: set[int], articles: set[int]) -> set[int]:
    """The regions without articles that are short beside the longest one."""
    size = dict.fromkeys(regions & articles, 0)
    for x in lines:
        if x.region in size:
            size[x.region] += len(x.text)
    longest = max(size.values(), default=0)
    return {r for r in regions if r not in size or size[r] >= longest * CARD_SHARE}


def gathered(lines: list[Line], regions: set[int], parents: dict[int, int], articles: set[int]) -> list[Line]:
    """The lines of the regions, and of the containers beside them what lies between, what heads them, and sentences after them."""
    taken = [x.region in regions for x in lines]
    beside = {parents[x.region] for x, t in zip(lines, taken, strict=True) if t and x.region not in articles}
    first, last = taken.index(True), len(taken) - 1 - taken[::-1].index(True)
    for i in range(len(lines) - 1, -1, -1):
        x = lines[i]
        if taken[i] or x.region in articles or parents[x.region] not in beside or 2 * x.linked >= len(x.text):
            continue
        heads = x.heading and i + 1 < len(lines) and taken[i + 1]
        taken[i] = first < i < last or heads or (i > last and x.linked == 0 and bool(SENTENCE.search(x.text)))
    return [x for x, t in zip(lines, taken, strict=True) if t]


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    lines = within_articles(unmarked(parser.lines, parser.around_article), parser.articles)
    regions = without_cards(lines, content_regions(lines), parser.articles)
    return " ".join(x.text for x in gathered(lines, regions, parser.parents, parser.articles))


def extract_batches(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

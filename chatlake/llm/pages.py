"""Main text of web pages: the contiguous region of a page with the largest sum of word and tag scores.

A page is read as a sequence of words and tags. Words score positive, by the share of words in such an element
that are content; tags score negative, by the logarithm of the share of such tags that lie inside content. Both
shares are counted on labelled pages, which are pages whose content is marked by one ``article`` (or, without it,
one ``main``) element, and smoothed by the priors below. How much tags weigh against words is the factor that
finds the words of the labelled pages best. One linear scan gives the best region; blocks it touches are taken
whole.

Elements that are no content wherever they stand are left out of the sequence, so they neither extend nor split
a region: scripts, styles, forms, menus, footers, sidebars, and elements whose class, id or role names an advert,
a notice, reader comments and the like. A page header is left out, the header of an article is not. Tags that
are never closed end with what surrounds them, as browsers do it.

Null html is empty. Pages without words give an empty text. Character references are decoded once per text; a
``br`` is white space. Unclosed comments and scripts end with the page. Pages of any size are read whole, in time
proportional to their size. Repeated rows get a row each; an empty table gives no rows. Without labelled pages
the priors alone decide. Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import map_texts, sample_rows
from chatlake.session import cut_lineage

#: Labelled pages that weights are learned from.
LABELLED = 2000
#: Factors tried for tags; of equally good ones the first is taken.
FACTORS = (1.0, 2.0, 0.5, 4.0)
#: What a left-out element costs, whatever it holds.
SKIP_COST = 0.5
#: Elements nested deeper than this are taken as not nested, as browsers do it.
MAX_DEPTH = 512
#: A prior counts as much as this many labelled tags or words.
PRIOR_COUNT = 5.0

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Left out wherever they stand.
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frameset head iframe label legend map "
    "menu nav noembed noframes noscript object option optgroup script select style svg template textarea title "
    "video xmp".split()
)
#: Left out inside of a line, which goes on after them.
WITHIN_LINE = INLINE | frozenset(
    "audio button canvas datalist embed iframe label map noscript object script select style svg template textarea video".split()
)
#: Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split()
)
#: Opening the key ends an open element of the value, unless an element of the third group is nearer.
ENDS_LIKE = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
}
_PARAGRAPH_BORDER = frozenset(("table", "td", "th", "caption", "button", "object"))

#: Words of class, id and role that say what an element is.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup paywall nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail aside "
    "complementary widget widgets related recommended recommendations share sharing social foot footer contentinfo "
    "masthead comment comments commentlist reply replies respond discussion disqus form search login toolbar "
    "pagination pager skip skiplink copyright legal disclaimer topbar bottombar hidden".split()
)
#: Of these, an article element may still be one.
ARTICLE_HINTS = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related".split())
#: Say header of a page, unless an article is open or named beside.
HEADER_HINTS = frozenset("header head banner".split())
CONTENT_HINTS = frozenset("article post entry story content main body text title".split())
#: Before another word they turn it into a property of the layout.
_PROPERTY = frozenset("has with without no not is js".split())

#: Share of tags that lie inside content, for tags the labelled pages do not show.
TAG_PRIORS = {
    0.97: "a abbr b br cite code em i mark p q s small span strong sub sup time u blockquote pre h2 h3 h4 h5 h6",
    0.75: "h1 li ul ol dl dt dd figure figcaption img table tbody thead tr td th hr",
    0.30: "div section article main header hgroup center details summary body html",
}
OTHER_PRIOR = 0.5
#: Share of words that are content, by the element around them.
WORD_PRIORS = {0.95: "p blockquote pre h1 h2 h3 h4 h5 h6 li dd td", 0.25: "a"}
OTHER_WORDS = 0.6

_ATTRIBUTES = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]){_ATTRIBUTES}(?:>|\Z)"
    r".*?(?=</(?P=raw)[\s/>]|\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>{_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_NAMED = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names(value: str) -> set[str]:
    """Words of a class or id; what follows a word like "has" or "no" is a property."""
    found: set[str] = set()
    for name in value.split():
        for word in (part.lower() for part in _PART.findall(name)):
            if word in _PROPERTY:
                break
            found.add(word)
    return found


def left_out(name: str, rest: str, in_article: bool) -> bool:
    """Whether an element is no content, by its name and attributes."""
    if name in NEVER:
        return True
    if name in ("html", "body", "main"):
        return False
    words: set[str] = set()
    for key, value in _NAMED.findall(rest) if rest else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif key != "aria-hidden":
            words |= _names(value)
    if name == "article":
        return bool(words & ARTICLE_HINTS)
    if name == "header" or words & HEADER_HINTS:
        if not in_article and not words & CONTENT_HINTS:
            return True
        words -= HEADER_HINTS
    return bool(words & HINTS)


@dataclass
class Page:
    """The sequence of one page: runs of words (amount > 0) and tags (amount 0), each with what it is scored by."""

    kinds: list[str] = field(default_factory=list)
    amounts: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    #: First and last item of article and of main elements that are content.
    marked: dict[str, list[tuple[int, int]]] = field(default_factory=dict)

    def add(self, kind: str, amount: int, block: int, text: str) -> None:
        self.kinds.append(kind)
        self.amounts.append(amount)
        self.blocks.append(block)
        self.texts.append(text)

    def content(self) -> tuple[int, int] | None:
        """The labelled region: that of the only article, or of the only main element."""
        for name in ("article", "main"):
            if len(self.marked.get(name, ())) == 1:
                return self.marked[name][0]
        return None


class _Reader:
    def __init__(self) -> None:
        self.page = Page()
        #: Name, whether left out, and the place in the sequence, of every open element.
        self.stack: list[tuple[str, bool, int]] = []
        #: How many elements of a name are open.
        self.held: Counter[str] = Counter()
        self.out = 0
        self.articles = 0
        self.block = 0

    def _pop(self) -> None:
        name, out, place = self.stack.pop()
        self.held[name] -= 1
        self.out -= out
        if not out and name in ("article", "main"):
            self.articles -= 1
            if not self.out:
                self.page.marked.setdefault(name, []).append((place, len(self.page.kinds)))

    def _end(self, names: Iterable[str], borders: Iterable[str]) -> None:
        """Close the nearest open element of these names, if no border is nearer."""
        if not any(self.held[name] for name in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in borders:
                return

    def open(self, name: str, rest: str) -> None:
        if name in ENDS_PARAGRAPH:
            self._end(("p",), _PARAGRAPH_BORDER)
        if name in ENDS_LIKE:
            self._end(*ENDS_LIKE[name])
        out = left_out(name, rest, self.articles > 0)
        if name in ("article", "main") and not out and self.out:
            # a menu or page header that was never closed ends where the content begins
            while self.stack and self.stack[-1][0] in ("nav", "header", "p", "ul", "ol", "li", "a", "b", "span"):
                self._pop()
        if name not in WITHIN_LINE:
            self.block += 1
        if not self.out:
            self.page.add("#skip" if out else name, 0, self.block, "")
            if name == "br":
                self.page.texts[-1] = " "
        if name not in VOID and len(self.stack) < MAX_DEPTH:
            self.stack.append((name, out, len(self.page.kinds)))
            self.held[name] += 1
            self.out += out
            self.articles += not out and name in ("article", "main")

    def close(self, name: str) -> None:
        if name not in WITHIN_LINE:
            self.block += 1
        if name in ("html", "body") or not self.held[name]:
            return
        shown = not self.out
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] != name:
                continue
            if name in INLINE and any(other not in INLINE for other, _, _ in self.stack[i + 1 :]):
                # an inline tag closed inside a later block ends alone
                self.out -= self.stack.pop(i)[1]
                self.held[name] -= 1
            else:
                while len(self.stack) > i:
                    self._pop()
            break
        if shown and not self.out:
            self.page.add(name, 0, self.block, "")

    def text(self, text: str) -> None:
        if self.out:
            return
        text = references.unescape(text) if "&" in text else text
        parts = text.split()
        if not parts:
            if text and self.page.texts:
                self.page.add("#space", 0, self.block, " ")
            return
        around = "#page"
        for name, _, _ in reversed(self.stack):
            if name == "a" or name not in INLINE:
                around = name
                break
        # scripts without spaces count by their length
        self.page.add(f"words in {around}", max(len(parts), len(text) // 12), self.block, text)


def read_page(source: str) -> Page:
    reader = _Reader()
    at = 0
    for mark in _MARKUP.finditer(source):
        if mark.start() > at:
            reader.text(source[at : mark.start()])
        at = mark.end()
        if mark["raw"]:
            reader.open(mark["raw"].lower(), "")
            reader.close(mark["raw"].lower())
        elif mark["name"]:
            name = mark["name"].lower()
            if mark["close"]:
                reader.close(name)
            else:
                reader.open(name, mark["rest"])
    if at < len(source):
        reader.text(source[at:])
    while reader.stack:
        reader._pop()
    return reader.page


def _prior(priors: dict[float, str], name: str, other: float) -> float:
    return next((share for share, names in priors.items() if name in names.split()), other)


_KNOWN = frozenset(" ".join([*TAG_PRIORS.values(), *WORD_PRIORS.values()]).split())


def feature(kind: str) -> str:
    """What counts are kept for: known elements by name, all others together."""
    words, name = kind.startswith("words in "), kind.removeprefix("words in ")
    name = name if name in _KNOWN else "other"
    return f"words in {name}" if words else name


class Weights:
    """Scores of words and tags from counts inside and outside of content."""

    def __init__(self, inside: dict[str, float] | None = None, outside: dict[str, float] | None = None, factor: float = 1.0) -> None:
        self.inside, self.outside, self.factor = inside or {}, outside or {}, factor
        self.known: dict[str, float] = {"#skip": -SKIP_COST, "#space": 0.0}

    def of(self, kind: str) -> float:
        """Of one word (positive) or one tag (negative)."""
        if kind not in self.known:
            name = feature(kind)
            inside, outside = self.inside.get(name, 0.0), self.outside.get(name, 0.0)
            if kind.startswith("words in "):
                prior = _prior(WORD_PRIORS, name.removeprefix("words in "), OTHER_WORDS)
            else:
                prior = _prior(TAG_PRIORS, name, OTHER_PRIOR)
            share = (inside + PRIOR_COUNT * prior) / (inside + outside + PRIOR_COUNT)
            found = max(share, 0.05) if kind.startswith("words in ") else self.factor * math.log(share)
            if len(self.known) > 10_000:  # made-up element names
                return found
            self.known[kind] = found
        return self.known[kind]

    def scores(self, page: Page) -> list[float]:
        return [self.of(kind) * (amount or 1) for kind, amount in zip(page.kinds, page.amounts, strict=True)]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the largest sum, the first of equal ones; empty if no sum is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(source: str | None, weights: Weights) -> str:
    page = read_page(source or "")
    start, end = best_region(weights.scores(page))
    chosen = {page.blocks[i] for i in range(start, end) if page.amounts[i]}
    parts: dict[int, list[str]] = {}
    for block, text in zip(page.blocks, page.texts, strict=True):
        if text and block in chosen:
            parts.setdefault(block, []).append(text)
    return "\n".join(" ".join("".join(texts).split()) for texts in parts.values())


# -- learning ----------------------------------------------------------------------------------


def _counted(page: Page) -> Iterator[tuple[str, int, int]]:
    """Feature, amount inside, amount outside, of a labelled page."""
    region = page.content()
    inside, outside = Counter(), Counter()
    for i, (kind, amount) in enumerate(zip(page.kinds, page.amounts, strict=True)):
        if not kind.startswith("#"):
            (inside if region[0] <= i < region[1] else outside)[feature(kind)] += amount or 1
    for name in inside | outside:
        yield name, inside[name], outside[name]


def _judged(page: Page, weights: list[Weights]) -> Iterator[tuple[int, int, int, int]]:
    """For each choice of weights: words found, words wrongly found, words missed."""
    first, last = page.content()
    for number, choice in enumerate(weights):
        start, end = best_region(choice.scores(page))
        amounts = page.amounts
        both = sum(amounts[max(start, first) : max(start, first, min(end, last))])
        yield number, both, sum(amounts[start:end]) - both, sum(amounts[first:last]) - both


def train(pages: DataFrame, rows: int = LABELLED) -> Weights:
    """Weights from at most ``rows`` labelled pages; only sums over them reach the driver."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]") & F.col("page_id").isNotNull())
    ids = F.broadcast(sample_rows(marked.select("page_id"), "page_id", rows).dropDuplicates())
    sample = marked.select("page_id", F.col("html").alias("text")).join(ids, "page_id").dropDuplicates(["page_id"])
    sample = cut_lineage(sample.select("text"))

    def labelled(batch: pa.RecordBatch) -> Iterator[Page]:
        for source in batch.column("text").to_pylist():
            page = read_page(source or "")
            if page.content():
                yield page

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [row for page in labelled(batch) for row in _counted(page)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["name", "i", "o"],
        )

    sums = map_texts(sample, count, "name string, i long, o long").groupBy("name").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    counts = sums.collect()
    inside, outside = {r["name"]: r["i"] for r in counts}, {r["name"]: r["o"] for r in counts}

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = [Weights(inside, outside, factor) for factor in FACTORS]
        rows = [row for page in labelled(batch) for row in _judged(page, weights)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["choice", "found", "wrong", "missed"]
        )

    judged = map_texts(sample, judge, "choice long, found long, wrong long, missed long").groupBy("choice")
    quality = dict.fromkeys(range(len(FACTORS)), 0.0)
    for r in judged.agg(*[F.sum(c).alias(c) for c in ("found", "wrong", "missed")]).collect():
        quality[r["choice"]] = 2 * r["found"] / max(1, 2 * r["found"] + r["wrong"] + r["missed"])
    return Weights(inside, outside, FACTORS[max(quality, key=lambda c: (quality[c], -c))])


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(source, weights) for source in batch.column("text").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        lengths = pa.array([len(text) for text in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*columns, lengths], ["page_id", "url", "text", "n_chars"])

    key = pages.schema["page_id"].dataType.simpleString()
    chosen = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").alias("text"))
    return map_texts(chosen, work, f"page_id {key}, url string, text string, n_chars long")

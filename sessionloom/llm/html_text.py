"""Main text of HTML pages from a streaming parse, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser feeds events; nothing but the open elements and the lines found so far is held. A line is
the text between two block borders (block elements and line breaks); it knows its tags and its container. Script, style
and the like are skipped; elements that are by name, role or class a menu, footer, advert, notice, form or comment are
marked as furniture. A class or id counts where all parts of the whole token are such words. The mark of a class, an id or
a form is void inside article, and where the element holds more than half of the words outside links and no article lies
beside it; that of comments and related pages where it holds all words; main voids every mark around it but that of hidden elements. head ends where
body, another element of the page or text begins. The text-to-tag ratio of each line (characters per tag) is smoothed with a Gaussian over the
neighbouring lines; a threshold between two clusters of the smoothed ratios (means of two groups) parts the lines into content and the
rest. Outside article and main, a cluster of two or more neighbouring lines below the threshold whose characters are
mostly those of links is navigation, whatever its elements are called, and is left out. The region starts as the page and goes down to a container only while that holds every selected line that is not
furniture and what lies beside it is no text of the page's own: beside article and main no heading or paragraph, beside
any other container nothing but lines made of links. It never goes below article or main. All lines of the region that
are not furniture are the text, however short.

Character references are decoded, white space inside a line becomes one space, lines join by one newline. Null or empty
html, or a page of menus and the like only, gives the empty string; an empty table gives an empty one. Pages of any length
are parsed whole, in memory that follows the longest page. Repeated rows repeat; result columns replace clashing names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table, text_slices

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math iframe object canvas audio video head title select textarea".split())
FURNITURE = frozenset("nav footer aside form button dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body html blockquote".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: A class or id names furniture where each part of the whole token is one of these words or a filling word.
NAMES = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions banner cookie cookies consent notice notices alert popup modal overlay navbar nav navigation menu breadcrumb breadcrumbs sidebar widget masthead siteheader pageheader sitefooter footer share sharing social newsletter subscribe signup login search pagination pager tags toolbar skiplink legal disclaimer copyright".split())
REPLIES = frozenset("comment comments commentlist respond disqus replies discussion related recommend recommended recommendation recommendations".split())
FILLING = frozenset("area bar block box bottom button buttons container form icon icons inner item items left link links list main page panel posts right section site top wrap wrapper".split())
PAIRS = frozenset({("side", "bar"), ("site", "header"), ("page", "header"), ("skip", "link")})
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Marks of furniture, by what makes them void: article, main or holding most text; main or holding all text; main; nothing.
BY_NAME, OF_REPLIES, BY_ELEMENT, HIDDEN = range(4)
SIGMA, RADIUS = 1.0, 2
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()
_WORD = re.compile(r"\w")
_PART = re.compile(r"[-_]+")
OUTSIDE = ("", 0, 0, 0, False, False, False)  # where no element is open


def named(given: dict[str, str | None]) -> int | None:
    """Kind of the mark that an element's class and id tokens make."""
    kinds = []
    for token in f"{given.get('class') or ''} {given.get('id') or ''}".lower().split():
        parts = [part for part in _PART.split(token) if part]
        pair = any(two in PAIRS for two in zip(parts, parts[1:]))
        if all(part in NAMES or part in REPLIES or part in FILLING or pair and part in ("side", "header", "skip") for part in parts):
            if any(part in REPLIES for part in parts):
                kinds.append(OF_REPLIES)
            elif pair or any(part in NAMES for part in parts):
                kinds.append(BY_NAME)
    return max(kinds, default=None)


class Lines(HTMLParser):
    """Collects (text, tags, mark, container, marked element, in a heading or paragraph, characters outside links) of each line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int, bool, bool, bool]] = []  # name, container number, mark, marked element, silent, prose, link
        self.parents: list[int] = [-1]  # of each container; number 0 is the page
        self.names: list[str] = [""]  # of each container
        self.lines: list[tuple[str, int, int, int, int, bool, int]] = []
        self.marks: list[tuple[int, int, int]] = [(-1, 0, -1)]  # mark around it, element, kind; number 0 is no mark
        self.under: list[tuple[int, int]] = [(0, 0)]  # of each mark: what is left of it inside article, and inside main
        self.marked: list[int] = [-1]  # marked element around each marked element; number 0 is none
        self.open: dict[str, int] = defaultdict(int)  # elements on the stack by name
        self.parts: list[tuple[str, tuple, int]] = []  # text, what it stands in, characters that are words outside links
        self.tags = 0

    def flush(self) -> None:
        """Ends a line. Where its runs of text stand under different marks, the line is under the mark of most of its characters,
        and runs that a hidden element or furniture inside it holds are left out."""
        around = self.stack[-1] if self.stack else OUTSIDE
        parts = self.parts
        marks = {part[1][2] for part in parts}
        if marks and marks != {around[2]}:
            size: Counter[int] = Counter()
            for data, state, _ in parts:
                size[state[2]] += len(data.strip())
            mark = max(size, key=lambda m: (size[m], -m))
            around = next(state for _, state, _ in parts if state[2] == mark)
            parts = [part for part in parts if part[1][2] == mark or self.marks[part[1][2]][2] < BY_ELEMENT]
        text = " ".join("".join([data for data, *_ in parts]).split()) if parts else ""
        if text:
            _, container, mark, marked, _, prose, _ = around
            self.lines.append((text, max(1, self.tags), mark, container, marked, prose, sum([plain for *_, plain in parts])))
            self.tags = 0
        self.parts = []

    def cut(self, k: int) -> None:
        """Closes all elements from the k-th on."""
        for element in self.stack[k:]:
            self.open[element[0]] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK or tag == "br":
            self.flush()
        self.tags += 1
        if tag == "body" or (self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD):
            self.close_open("head", {"body"})
        if tag in CLOSES_P:
            self.close_open("p", {"button", "td", "th", "table", "div", "article", "section", "body"})
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            self.close_open(tag, {"ul", "ol", "dl", "table", "div", "article", "section", "body"})
        if tag in VOID:
            return
        _, container, mark, marked, silent, prose, link = self.stack[-1] if self.stack else OUTSIDE
        silent, prose, link = silent or tag in SILENT, prose or tag in PROSE, link or (tag == "a" and any(name == "href" for name, _ in attrs))
        if tag in ("article", "main"):
            mark = self.under[mark][tag == "main"]
        elif tag not in ("html", "body"):
            kind = self.kind(tag, dict(attrs))
            if kind is not None:
                self.marked.append(marked)
                mark, marked = self.add_mark(mark, kind, tag != "nav"), len(self.marked) - 1
        if tag in CONTAINER:
            self.parents.append(container)
            self.names.append(tag)
            container = len(self.parents) - 1
        self.stack.append((tag, container, mark, marked, silent, prose, link))
        self.open[tag] += 1

    def kind(self, tag: str, given: dict[str, str | None]) -> int | None:
        role = (given.get("role") or "").lower()
        if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true":
            return HIDDEN
        if tag == "header" and not any(name in ("article", "main") for name, *_ in self.stack):
            return BY_ELEMENT
        if tag != "form" and tag in FURNITURE or role != "form" and role in ROLES:
            return BY_ELEMENT
        return BY_NAME if named(given) is None and (tag == "form" or role == "form") else named(given)

    def add_mark(self, around: int, kind: int, lasting: bool = True) -> int:
        """A mark of the newest marked element; what of it holds inside article and main is made beside it. One that does not
        last ends where an article begins: an article in a menu means that the menu's end is missing."""

        def made(around: int, under: tuple[int, int] | None) -> int:
            self.marks.append((around, len(self.marked) - 1, kind))
            self.under.append(under or (len(self.marks) - 1,) * 2)
            return len(self.marks) - 1

        article, main = self.under[around]
        if kind == HIDDEN:
            main = made(main, None)
        if kind == HIDDEN or kind != BY_NAME and lasting:
            article = made(article, None)
            self.under[article] = (article, main)
        return made(around, (article, main))

    def close_open(self, tag: str, borders: set[str]) -> None:
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.flush()
                self.cut(k)
                return
            if self.stack[k][0] in borders:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag == "br":
            self.flush()
        self.tags += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.cut(k)
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.close_open("head", set())
        state = self.stack[-1] if self.stack else OUTSIDE
        if not state[4]:
            self.parts.append((data, state, len(data) if not state[6] and _WORD.search(data) else 0))


def in_article(parser: Lines) -> list[bool]:
    """Of each container: whether it is or lies in article or main."""
    article = [False]
    for parent, name in zip(parser.parents[1:], parser.names[1:]):
        article.append(article[parent] or name in ("article", "main"))
    return article


def in_furniture(parser: Lines, article: list[bool]) -> list[bool]:
    """Of each line: whether a mark holds there."""
    kinds = [BY_NAME]
    for around, _, kind in parser.marks[1:]:  # marks follow those around them
        kinds.append(max(kinds[around], kind))
    words, held = [0] * len(parser.marked), [0] * len(parser.marked)
    for _, _, mark, container, marked, _, plain in parser.lines:
        if kinds[mark] < BY_ELEMENT:
            words[marked] += plain
        if kinds[mark] == BY_NAME and article[container]:
            held[marked] += plain
    for m in range(len(words) - 1, 0, -1):
        words[parser.marked[m]] += words[m]
        held[parser.marked[m]] += held[m]
    holds = [False]
    for around, element, kind in parser.marks[1:]:
        void = kind == BY_NAME and 2 * words[element] > words[0] and held[element] == held[0] or kind == OF_REPLIES and words[element] == words[0] > 0
        holds.append(holds[around] or not void)
    return [holds[line[2]] for line in parser.lines]


def threshold(values: np.ndarray) -> float:
    """Border between two clusters: midpoint of the group means, moved until it stays."""
    cut = float(values.mean())
    for _ in range(20):
        high, low = values[values >= cut], values[values < cut]
        if not len(high) or not len(low):
            break
        new = (float(high.mean()) + float(low.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return min(cut, float(values.mean()))


def link_clusters(parser: Lines, own: np.ndarray, low: np.ndarray, article: list[bool]) -> np.ndarray:
    """Lines in clusters of low ratio, two lines or more, of whose characters most are those of links.

    Smoothing lifts a cluster's edge beside text, so lines made of links alone belong to the cluster that they adjoin.
    """
    out, k = np.zeros(len(own), bool), 0
    loose = [bool(own[i] and (low[i] or not line[6]) and not article[line[3]]) for i, line in enumerate(parser.lines)]
    while k < len(out):
        end = k
        while end < len(out) and loose[end]:
            end += 1
        if end - k > 1 and low[k:end].any():
            total, plain = (sum(of(line) for line in parser.lines[k:end]) for of in (lambda line: len(line[0]), lambda line: line[6]))
            out[k:end] = 2 * plain < total
        k = max(end, k + 1)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    ratio = np.array([len(text) / tags for text, tags, *_ in lines])
    padded = np.pad(ratio, RADIUS, mode="edge")
    smooth = np.convolve(padded, _KERNEL, mode="valid")
    article = in_article(parser)
    own, cut = ~np.array(in_furniture(parser, article)), threshold(smooth)
    own &= ~link_clusters(parser, own, smooth < cut, article)
    if not own.any():
        return ""
    chosen = (smooth >= cut) & own
    if not chosen.any():
        chosen = own
    held = np.zeros((len(parser.parents), 3), np.int64)  # chosen lines, prose lines, lines not made of links
    for k in np.flatnonzero(own):
        held[lines[k][3]] += (chosen[k], lines[k][5], lines[k][6] > 0)
    for k in range(len(held) - 1, 0, -1):  # children follow their parents
        held[parser.parents[k]] += held[k]
    region = 0
    for k, parent in enumerate(parser.parents):
        if parent != region or parser.names[region] in ("article", "main"):
            continue
        selected, prose, text = held[region] - held[k]
        if not selected and not prose and (not text or parser.names[k] in ("article", "main")):
            region = k
    inside = {region}
    for k, parent in enumerate(parser.parents):
        if parent in inside:
            inside.add(k)
    return "\n".join(line[0] for line, kept in zip(lines, own) if kept and line[3] in inside)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Each page's other columns with text and n_chars in place of html."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, html)):
            texts = [main_text(value.as_py()) for value in batch.column(html)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, schema)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

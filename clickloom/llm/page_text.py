"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element. The length of a line's text (links do not count) is its weight, and weights
are summed over WIDTH consecutive lines. The sums surge where an article begins, rising from zero to the threshold without falling
back, and dive to zero where it ends; the lines between the first surge point and the last dive point are kept, whatever their own
length, except runs of WIDTH or more lines of links alone (in a named article, those of such a run with no text in the WIDTH - 1 lines on either side).

Names only change weights. Lines of a part that its tag or a word of its class, id, role or label marks as something else weigh nothing
and are left out. But where words alone mark a part that wraps nearly all of the page's text (WRAPPER_SHARE) they mark nothing, and
parts with a name that articles have too (forms, legal notes, notices) stay if their own sums reach the threshold. A word with a denial (`no-sidebar`, `has-sidebar`, `ad-free`) marks nothing. Parts that stand at an
article's ends (navigation, headers, footers, comments) count as WIDTH empty lines, and so do the ends of article and main; where a page has
text in these, lines elsewhere weigh a tenth.

A null, empty or text-less page gives the empty text. A part that is never closed ends where its parent does. Repeated rows give
equal texts; very long pages are read whole, in linear time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import in_arrow
from clickloom.llm.html_tokens import INLINE, attributes, one_line, tokens

#: Lines in a block.
WIDTH = 3
#: A surge has at least this sum of characters, or this share of the page's largest sum if that is less.
SURGE, SURGE_SHARE = 86, 0.4
#: Weight of lines outside a named article, where a page has one with text.
OUTSIDE = 0.1

#: Share of a page's text, in WIDTH lines or more, that a part marked by words alone wraps only if it is no such part.
WRAPPER_SHARE = 0.8

#: Elements whose text is never shown on the page.
UNSEEN = {"head", "script", "style", "noscript", "template", "svg", "math", "canvas", "button", "select", "datalist", "iframe", "object", "title", "textarea", "audio", "video"}
#: Elements that stand beside an article; header only outside one.
BESIDE = {"nav", "header", "footer", "aside", "menu", "dialog"}
#: Words of names of parts that are not article text.
PART_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promos promotion promotions nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar sidebars rail footer foot masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup comment comments disqus replies respond discussion "
    "share sharing social related recommended recommendations widget pagination pager toc complementary contentinfo skiplink".split()
)
#: The same, two words on end.
PART_PAIRS = {("site", "header"), ("page", "header"), ("skip", "link"), ("side", "bar")}
#: Words that article text may bear too.
WEAK_WORDS = set("notice notices alert alerts login search copyright legal disclaimer".split())
#: Words, and elements, of parts that stand at an article's ends.
EDGE_WORDS = set("nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar contentinfo comment comments".split())
EDGES = {"nav", "header", "footer"}
DENIALS = {"no", "not", "non", "has", "have", "with", "without", "hide"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Part:
    """An element that its name marks."""

    weak: bool
    edge: bool
    #: Whether its tag says so.
    sure: bool = False
    #: Weights of its lines.
    weights: list[int] = field(default_factory=list)

    def left_out(self, whole: int, beside: bool) -> bool:
        """whole: the weight of the page's lines outside sure parts; beside: whether the part is beside a named article."""
        if self.sure:
            return True
        if not beside and len(self.weights) >= WIDTH and sum(self.weights) >= WRAPPER_SHARE * whole > 0:
            return False
        return not self.weak or max((sum(self.weights[k : k + WIDTH]) for k in range(len(self.weights))), default=0) < SURGE


@dataclass
class Line:
    """Text of a block, its characters outside links, whether in a named article, and the marked parts around it; without text, an end of a part or article."""

    text: str
    weight: int
    article: bool
    parts: tuple[Part, ...] = ()
    #: The part whose place this is; None for an end of an article.
    edge: Part | None = None


def part_of(tag: str, raw: str, in_article: bool) -> Part | None:
    """How an element is marked."""
    if tag in BESIDE and not (tag == "header" and in_article):
        return Part(False, tag in EDGES, True)
    if tag in {"html", "body", "article", "main"}:
        return None
    strong = weak = edge = False
    found = attributes(raw) if raw else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        strong = True
    for name in ("class", "id", "role", "aria-label"):
        for one in found.get(name, "").split():
            words = [x.lower() for x in _WORD.findall(one)]
            for k, word in enumerate(words):
                if k and words[k - 1] in DENIALS or words[k + 1 : k + 2] == ["free"]:
                    continue
                pair = k > 0 and (words[k - 1], word) in PART_PAIRS
                strong |= word in PART_WORDS or pair
                weak |= word in WEAK_WORDS
                edge |= word in EDGE_WORDS or pair and word == "header"
    return Part(not strong, edge) if strong or weak or tag == "form" else None


def lines(page: str) -> list[Line]:
    """The lines of a page, and the ends of articles and of parts that stand at them."""
    out: list[Line] = []
    open_tags: list[tuple[str, Part | None]] = []
    parts: list[Part] = []
    unseen = links = articles = 0
    text: list[str] = []
    linked: list[str] = []

    def end_line() -> None:
        if text:
            own = one_line("".join(text))
            if own:
                weight = max(0, len(own.replace(" ", "")) - len(one_line("".join(linked)).replace(" ", "")))
                out.append(Line(own, weight, articles > 0, tuple(parts)))
                for part in parts:
                    part.weights.append(weight)
            text.clear()
            linked.clear()

    def leave(tag: str, part: Part | None) -> None:
        nonlocal unseen, links, articles
        if tag not in INLINE or part is not None:
            end_line()
        unseen -= tag in UNSEEN
        links -= tag == "a"
        if tag in {"article", "main"}:
            articles -= 1
            out.append(Line("", 0, articles > 0))
        if part is not None:
            parts.pop()

    for kind, value, raw in tokens(page):
        if kind == "text":
            if not unseen:
                text.append(value)
                if links:
                    linked.append(value)
        elif kind == "open":
            part = part_of(value, raw, articles > 0)
            if value not in INLINE or part is not None:
                end_line()
            if value in {"p", "li", "tr", "td", "th", "dt", "dd", "option"}:  # these end an open one of their kind
                for k in range(len(open_tags) - 1, -1, -1):
                    if open_tags[k][0] == value:
                        while len(open_tags) > k:
                            leave(*open_tags.pop())
                        break
                    if open_tags[k][0] not in INLINE:
                        break
            unseen += value in UNSEEN
            links += value == "a"
            if value in {"article", "main"}:
                out.append(Line("", 0, articles > 0))
                articles += 1
            if part is not None:
                parts.append(part)
                if part.edge:
                    out.append(Line("", 0, articles > 0, tuple(parts[:-1]), part))
            open_tags.append((value, part))
        else:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == value:
                    while len(open_tags) > k:
                        leave(*open_tags.pop())
                    break
            if value not in INLINE:
                end_line()
    end_line()
    return out


def weighed(found: list[Line]) -> list[tuple[Line | None, float]]:
    """The lines that count, with their weights; None for empty lines."""
    whole = sum(x.weight for x in found if not any(part.sure for part in x.parts))
    # parts with a line of a named article in them wrap it or stand in it
    within = {id(part) for x in found if x.article for part in x.parts}
    has_article = any(x.article or not x.text and x.edge is None for x in found)
    every = {id(part): part for x in found for part in (*x.parts, *((x.edge,) if x.edge is not None else ()))}
    out_of = {k: part.left_out(whole, has_article and k not in within) for k, part in every.items()}
    seen = [x for x in found if not any(out_of[id(part)] for part in x.parts)]
    named = any(x.article and x.text for x in seen)
    out: list[tuple[Line | None, float]] = []
    for x in seen:
        if x.text:
            out.append((x, x.weight if x.article or not named else OUTSIDE * x.weight))
        elif x.edge is None or out_of[id(x.edge)]:
            out += [(None, 0.0)] * WIDTH
    return out


def main_text(page: str | None) -> str:
    """The kept lines, joined by one space."""
    blank: list[tuple[Line | None, float]] = [(None, 0.0)] * (WIDTH - 1)
    found = blank + weighed(lines(page or "")) + blank
    sums = [sum(w for _, w in found[i : i + WIDTH]) for i in range(len(found) - WIDTH + 1)]
    if not sums or not (top := max(sums)):
        return ""
    threshold = min(SURGE, SURGE_SHARE * top)
    first = last = at = 0
    while at < len(sums):
        if not sums[at]:
            at += 1
            continue
        dive = at
        while dive < len(sums) and sums[dive]:
            dive += 1
        if max(sums[at:dive]) >= threshold:
            first, last = (first if last else at), dive + WIDTH - 1
        at = dive
    own = [line for line, _ in found[first:last] if line is not None]
    counted = [k for k, x in enumerate(own) if x.weight]
    kept = own[counted[0] : counted[0] + 1]
    kept = _linked(own[: counted[0]], False, True) + kept
    for a, b in zip(counted, counted[1:], strict=False):
        kept += [*_linked(own[a + 1 : b], True, True), own[b]]
    kept += _linked(own[counted[-1] + 1 :], True, False)
    return " ".join(x.text for x in kept)


def _linked(run: list[Line], after: bool, before: bool) -> list[Line]:
    """What is kept of a run of lines of links alone, after or before a line of text."""
    inside = all(x.article for x in run)
    if after and before and len(run) < WIDTH:
        return run
    if not inside:
        return []
    near = WIDTH - 1
    return [x for k, x in enumerate(run) if after and k < near or before and len(run) - k <= near]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its code points, for every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))

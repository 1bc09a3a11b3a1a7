"""An HTML tokenizer shared by the page operators: one regular expression, no tree. A quote opens a value only after an equals sign; a tag that never ends goes on to the end of the page."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that stand within a line; all others begin and end one.
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_SPACE = re.compile(r"\s+")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, raw attributes) and ("close", tag, ""), in page order; comments, declarations and raw content are left out."""
    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, m[3]
        if tag in VOID or m[3].endswith("/"):
            yield "close", tag, ""
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", tag, ""
    if at < len(page):
        yield "text", page[at:], ""


def one_line(text: str) -> str:
    """Character references decoded, each run of white space one space, trimmed."""
    return _SPACE.sub(" ", html.unescape(text)).strip()

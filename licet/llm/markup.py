"""Tags, texts and character references of HTML, in time linear in the page."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_LONG = re.compile(r"&#(?:([xX])([0-9a-fA-F]{7,})|([0-9]{8,}));?")
#: Elements of HTML whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())


def _short(m: re.Match) -> str:
    digits = (m[2] or m[3]).lstrip("0") or "0"
    return "�" if len(digits) > 7 else f"&#{m[1] or ''}{digits};"


def unescape(said: str) -> str:
    """Character references decoded; a number of more digits than any character has is U+FFFD."""
    return entities.unescape(_LONG.sub(_short, said)) if "&" in said else said


def attributes(raw: str) -> Iterator[tuple[str, str]]:
    """Names in lower case and decoded values, in order."""
    for m in _ATTRIBUTE.finditer(raw):
        yield m[1].lower(), unescape(m[2] or m[3] or m[4] or "")


def tokens(page: str, raw: frozenset[str] = RAW) -> Iterator[tuple[str, str, str]]:
    """("text", said, ""), ("start", tag, attributes) and ("end", tag, "") in order.

    Comments, declarations and the content of ``raw`` elements are left out, as
    is a tag that the page's end cuts off.  Every byte is passed a bounded
    number of times: after one tag whose quotes never close, quotes no longer
    hide the end of a tag.
    """
    at, begin, quotes = 0, 0, True
    while (lt := page.find("<", at)) >= 0:
        m = _NAME.match(page, lt + 1)
        if m is None and page[lt + 1 : lt + 2] not in ("!", "?", "/"):
            at = lt + 1  # a character like any other
            continue
        if begin < lt:
            yield "text", page[begin:lt], ""
        if m is None:
            mark = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(mark, lt + (2 if mark == ">" else 4))
            at = begin = len(page) if end < 0 else end + len(mark)
            continue
        whole = _QUOTED.match(page, m.end()) if quotes else None
        end = whole.end() if whole else page.find(">", m.end()) + 1
        quotes = quotes and whole is not None
        if not end:
            return
        tag = m[2].lower()
        at = begin = end
        if m[1]:
            yield "end", tag, ""
            continue
        yield "start", tag, page[m.end() : end - 1]
        if tag in raw:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = begin = len(page) if end < 0 else end + 1
    if begin < len(page):
        yield "text", page[begin:], ""

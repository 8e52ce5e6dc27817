"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their tag path from the root.  Each path
has two ratios, characters per node and punctuation marks per node, outside
links.  Both are smoothed along the page, so that a short paragraph between
long ones counts as content, and fused into one ratio; paths at or above a
share of the page's highest one and of its deviation are content, and select
their nodes.  The article is the lowest element that holds all selected nodes.
Where it is a part of the page of its own, all its text counts (short headings,
items and links between content too) but for runs of links before the first
and after the last selected node; where nothing smaller than the page itself
holds the selected nodes, the text goes from the first to the last of them,
with the headings right before.

Other parts are left out before the ratios are taken: elements that HTML
declares to be none of the text (navigation, footers, asides, buttons ...) or
hidden, and those whose class, id or role *names* say so.  A name is evidence
that the page's own text may outweigh: a named part that holds over ``SHARE``
of the page's text outside links stays, and its paths are judged by their
ratios like all others (reader comments may be longer than their article, so
they need nearly all of it).

Cases: null and empty html give an empty text, as does a page that has no text
outside the other parts; unclosed and stray tags are repaired by the usual
rules (a block ends an open paragraph, an end tag closes what it matches, and
stray ones are ignored); elements nested more than ``DEEPEST`` deep count as
the one that holds them, as in browsers; a tag that the page's end cuts off
says nothing; references without a semicolon are read as browsers do, and
numbers of no character are U+FFFD.  Time and memory are linear in the page.
Extra columns pass through; columns named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import markup, text

#: Elements of HTML that are no main text, and those that may hold it nevertheless.
OTHER = frozenset("nav footer aside button select option input label dialog menu head object audio video canvas".split())
MAYBE = frozenset("header form fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body html aside nav header footer form td".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " header masthead topbar footer sidebar aside widget cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login"
    " search share sharing social related recommended recommendations pagination pager hidden".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = re.compile(r"[.,;:!?…。，！？；：]")
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: Neighbouring nodes that smooth a ratio, and the share of the highest ratio and of the deviation that content reaches.
SPREAD = 2
THRESHOLD = 0.25
#: Elements that are parts of a text; with inline ones, none of them is the article.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd figure figcaption".split())
DEEPEST = 512
#: What an element declares: nothing, no text, a name, a name of comments; and the share of the text that outweighs names.
PLAIN, GONE, NAMED, TALK = range(4)
SHARE = {NAMED: 0.5, TALK: 0.95}


@dataclass
class Page:
    """Elements by number in the order of their begins (0: the page), and the text nodes."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])
    says: list[int] = field(default_factory=lambda: [PLAIN])
    link: list[bool] = field(default_factory=lambda: [False])
    nodes: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text


def _declared(tag: str, raw: str) -> tuple[int, str]:
    """What an element declares, and its label in paths."""
    if tag in OTHER:
        return GONE, tag
    says, name = (NAMED if tag in MAYBE else PLAIN), ""
    for key, value in markup.attributes(raw):
        if key in ("class", "id"):
            parts = re.split(r"[^a-z]+", _CAMEL.sub(r"\1 \2", value).lower())
            if tag not in ("html", "body", "article", "main"):
                says = TALK if not COMMENTS.isdisjoint(parts) else NAMED if not NAMES.isdisjoint(parts) and says != TALK else says
            if key == "class":
                name = "." + value.lower()
        elif key == "role" and value.lower() in ROLES:
            says = max(says, NAMED)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return GONE, tag
    return says, tag + name


def parse(html: str) -> Page:
    p = Page()
    paths: dict[tuple[int, str], int] = {}
    stack, gone, block = [0], 0, 0  # gone: open elements that are no text
    opened: dict[str, int] = {}
    deeper: dict[str, int] = {}

    def close() -> None:
        nonlocal gone
        x = stack.pop()
        opened[p.tag[x]] -= 1
        gone -= p.says[x] == GONE

    def close_to(place: int) -> None:
        while len(stack) > place:
            close()

    for kind, what, raw in markup.tokens(html):
        if kind == "text":
            if not gone:
                p.nodes.append((stack[-1], block, markup.unescape(what)))
        elif kind == "end":
            if deeper.get(what):
                deeper[what] -= 1
            elif opened.get(what):
                i = len(stack) - 1
                while p.tag[stack[i]] != what and not (what in markup.INLINE and p.tag[stack[i]] in SCOPE):
                    i -= 1
                if p.tag[stack[i]] == what:
                    close_to(i)
                    block += what not in markup.INLINE
        elif what in markup.RAW:
            continue
        else:
            block += what not in markup.INLINE
            if what in markup.VOID:
                continue
            closes = ("p",) if what in ENDS_P else SAME.get(what, ())
            if any(opened.get(c) for c in closes):
                i = len(stack) - 1
                while i and p.tag[stack[i]] not in closes and p.tag[stack[i]] not in SCOPE - set(closes):
                    i -= 1
                if i and p.tag[stack[i]] in closes:
                    close_to(i)
                    if what == "tr" and p.tag[stack[-1]] == "tr":
                        close_to(len(stack) - 1)
            if len(stack) > DEEPEST:
                deeper[what] = deeper.get(what, 0) + 1
                continue
            says, label = _declared(what, raw)
            top = stack[-1]
            p.tag.append(what)
            p.parent.append(top)
            p.path.append(paths.setdefault((p.path[top], label), len(paths) + 1))
            p.says.append(says)
            p.link.append(p.link[top] or what == "a")
            stack.append(len(p.tag) - 1)
            opened[what] = opened.get(what, 0) + 1
            gone += says == GONE
    return p


def _left_out(p: Page) -> list[bool]:
    """Elements whose names declare them, or one that holds them, to be another part."""
    mass = [0] * len(p.tag)
    for e, _, t in p.nodes:
        if not p.link[e]:
            mass[e] += len(t.strip())
    for e in range(len(mass) - 1, 0, -1):
        mass[p.parent[e]] += mass[e]
    last = _last(p)
    articles = [e for e, tag in enumerate(p.tag) if tag in ("article", "main") and mass[e]]

    def outweighs(e: int) -> bool:
        return mass[e] > SHARE[p.says[e]] * mass[0] and not any(last[a] < e or a > last[e] for a in articles)

    out = [False] * len(mass)
    for e in range(1, len(out)):
        out[e] = out[p.parent[e]] or (p.says[e] in SHARE and not outweighs(e))
    return out


def _last(p: Page) -> list[int]:
    """Per element the last one inside it: those inside have the numbers after its own."""
    last = list(range(len(p.tag)))
    for e in range(len(last) - 1, 0, -1):
        last[p.parent[e]] = max(last[p.parent[e]], last[e])
    return last


def _smooth(values: list[float]) -> list[float]:
    kernel = [math.exp(-(d * d) / 2) for d in range(SPREAD + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[abs(j - i)], values[j]) for j in range(max(0, i - SPREAD), min(len(values), i + SPREAD + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def ratios(p: Page, said: list[tuple[int, int, str]]) -> tuple[dict[int, float], float, set[int]]:
    """Per path the fused ratio; the least one of content; the paths with text outside links."""
    chars, marks, count = {}, {}, {}
    for e, _, t in said:
        path = p.path[e]
        count[path] = count.get(path, 0) + 1
        if not p.link[e]:
            chars[path] = chars.get(path, 0) + len(t.strip())
            marks[path] = marks.get(path, 0) + len(MARKS.findall(t))
    at = [p.path[e] for e, _, _ in said]
    long, marked = (_smooth([x.get(i, 0) / count[i] for i in at]) for x in (chars, marks))
    fused = [math.sqrt(a * (1 + b)) for a, b in zip(long, marked)]
    total: dict[int, float] = {}
    for i, f in zip(at, fused):
        total[i] = total.get(i, 0.0) + f
    mean = {i: t / count[i] for i, t in total.items()}
    centre = sum(fused) / len(fused)
    deviation = math.sqrt(sum((f - centre) ** 2 for f in fused) / len(fused))
    return mean, max(THRESHOLD * max(mean.values()), THRESHOLD * deviation), {i for i, n in chars.items() if n}


def extract(html: str | None) -> str:
    if not html:
        return ""
    p = parse(html)
    out = _left_out(p)
    found = [x for x in p.nodes if not out[x[0]]]
    said = [x for x in found if not x[2].isspace()]
    if not said:
        return ""
    mean, least, spoken = ratios(p, said)
    content = {i for i, v in mean.items() if v >= least and i in spoken} or spoken or set(mean)
    chosen = [x[0] for x in said if p.path[x[0]] in content]
    # the lowest element that holds all chosen ones
    last = _last(p)
    article, far = min(chosen), max(chosen)
    while last[article] < far:
        article = p.parent[article]
    # part of a text, such as its one quotation or list, is not an article by itself
    while article and (p.tag[article] in markup.INLINE or p.tag[article] in PARTS):
        article = p.parent[article]
    inside = [x for x in found if article <= x[0] <= last[article]]
    marked = [p.path[e] in content and not t.isspace() for e, _, t in inside]
    begin, end = marked.index(True), len(marked) - 1 - marked[::-1].index(True)
    whole = p.tag[article] not in ("", "html", "body")
    spoke = {b for e, b, t in inside if not p.link[e] and not t.isspace()}

    def keeps(i: int) -> bool:
        e, block, _ = inside[i]
        if begin <= i <= end or block in (inside[begin][1], inside[end][1]):
            return True
        if whole:
            return block in spoke
        return i < begin and _heading(p, e) and all(t.isspace() or _heading(p, x) for x, _, t in inside[max(0, i) : begin][:64])

    parts: list[str] = []
    before = None
    for i, (_, block, t) in enumerate(inside):
        if keeps(i):
            parts.append(t if block == before else " " + t)
            before = block
    return " ".join("".join(parts).split())


def _heading(p: Page, e: int) -> bool:
    while e and p.tag[e] in markup.INLINE:
        e = p.parent[e]
    return p.tag[e] in HEADINGS


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of ``html``."""
    text.ready(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    kept = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(h.as_py()) for h in batch.column(batch.schema.get_field_index("html"))]
            yield text.extended(batch.select(kept), text=pa.array(got, pa.string()), n_chars=pa.array([len(x) for x in got], pa.int64()))

    return pages.mapInArrow(run, text.plus(pages.select(*kept).schema, text="string", n_chars="long"))


def op8(spark, sf_dir: str) -> DataFrame:
    return extracted(text.table(spark, sf_dir, "pages").select("page_id", "url", "html"))

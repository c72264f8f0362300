"""Main text of web pages by the line-block distribution.

Markup is stripped to one line a block element.  A line weighs its characters outside links less ``LINKED`` times
those inside, less ``TAGS`` for each tag beyond the first and ``MOSTLY`` if it is mostly links, between -``CLIP`` and
``CLIP``; what a page says of itself is a prior on top: ``MAIN`` more for text inside a marked main part (``article``, ``main`` or such a role) and ``OUTER`` less
outside it, where the limits are wider.  A line block is ``WIDTH`` lines around each line, and its value the sum of
their weights; blocks do not reach over the borders of a main part.  Text surges where a value rises over the
threshold (``LEAST`` or a quarter of the page's highest value, if that is less; 0 inside a main part) and dives where
a value is 0 or less; all lines of a stretch of positive values with a surge in it are kept.

Scripts, styles, menus, footers, sidebars, notices, adverts, forms and reader comments, known by element, role, class
or id, take no part: a run of them is one line without weight.  A class or id counts by its last word ("post-comments",
not "share-price") or if all its words do.  Forms and page furniture (``SOFT``) give way to a main part in them, and to
text that is four fifths of an unmarked page's.

Character references are decoded, white space inside a line becomes one space, lines are trimmed and joined by
one space in page order; nothing is capped.  The scan is linear in the page: an attribute value that is never closed
makes all later quotes of the page plain characters.  Defined results: NULL or empty html, and pages without text,
give the empty text; unclosed and crossed elements are closed as browsers do in the main cases; rows with a NULL or
repeated id keep a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, LEAST, CLIP, LINKED, MOSTLY, TAGS, MAIN, OUTER, SHARE = 3, 86, 100, 3, 60, 4, 40, 250, 0.8
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?", re.S)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "noembed", "noframes", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SKIPPED = {"head", "nav", "footer", "aside", "button", "select", "menu", "dialog", "audio", "video", "map"}
FORMS = {"form", "fieldset"}
#: Skipped unless inside the main part, where they hold its headline.
HEADERS = {"header", "hgroup"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
MAIN_ROLES = {"main", "article"}
#: Words of class and id names that mark what is not the article, ...
MARKS = {
    "nav", "navbar", "navigation", "menu", "menubar", "topbar", "masthead", "footer", "sidebar", "aside",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "sponsor", "sponsored", "promo", "promoted", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notification", "popup",
    "newsletter", "subscribe", "signup", "signin", "share", "sharing", "social", "follow",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "reactions",
    "related", "recommended", "recommendations", "trending", "popular", "breadcrumb", "breadcrumbs", "pagination", "pager", "widget", "toolbar", "searchform", "copyright", "disclaimer",
}
#: ... those of page furniture that can hold the article, ...
SOFT = {"header", "rail", "banner", "notice", "alert", "modal", "overlay", "paywall", "subscription", "login", "search", "legal", "skip"}
#: ... words that say nothing beside them, and words that make a name a mere setting.
PLAIN = {"bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "global", "group", "inner", "item", "items", "left", "link", "links", "list", "main", "module", "outer", "page", "panel", "post", "posts", "right", "section", "site", "slot", "stories", "articles", "text", "title", "top", "unit", "widget", "wrap", "wrapper"}
SETTINGS = {"has", "is", "no", "not", "with", "without", "hide", "show"}
#: These names hold the whole page or its main part even if another word of the name is marked.
WHOLE = {"html", "body", "main", "article"}
CLOSERS = {
    "p": {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"table", "td", "th", "button", "object", "body", "html"}}
CLOSED_BY = {name: [x for x, by in CLOSERS.items() if name in by] for name in set().union(*CLOSERS.values())}
SCOPES = ("td", "th", "table", "button", "object")
#: What an element makes of the text in it: nothing, the main part, skipped unless main, skipped.
OPEN, PART, GIVES, SHUT = range(4)


@dataclass
class Line:
    text: str
    linked: int  # characters inside links
    tags: int
    kind: int
    region: int  # number of the skipped region, or 0


def _marked(names: str, inside: bool) -> int:
    """What class and id names make of an element; a main part's own header is part of it, its notices are not."""
    kind = OPEN
    for name in names.split():
        words = [w for w in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())]
        if not words or words[0] in SETTINGS:
            continue
        found = [w for w in words if w in MARKS or w in SOFT]
        if found and (words[-1] in found or all(w in PLAIN or w in found for w in words)):
            if not (inside and set(found) == {"header"}):
                kind = max(kind, SHUT if inside or any(w in MARKS for w in found) else GIVES)
    return kind


def _kind(name: str, rest: str, inside: bool) -> int:
    if name in SKIPPED:
        return SHUT
    kind = GIVES if name in FORMS or (name in HEADERS and not inside) else PART if name in ("article", "main") else OPEN
    if rest and not rest.isspace():
        found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(rest)}
        role = found.get("role", "").strip().lower()
        if role in MAIN_ROLES or found.get("itemprop", "").lower() == "articlebody":
            return PART
        if role in ROLES and name not in WHOLE or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
            return SHUT
        if name not in ("html", "body", "main") and (found.get("class") or found.get("id")):
            mark = _marked(found.get("class", "") + " " + found.get("id", ""), inside)
            if name == "article":
                return SHUT if mark == SHUT else PART
            return max(kind, mark)
    return kind


class Scanner:
    """Lines of a page, in one pass over it."""

    def __init__(self, page: str):
        self.page, self.lines = page, []
        self.stack: list[tuple[str, int, int]] = []  # open elements: name, kind of the text in them, region
        self.places: dict[str, list[int]] = defaultdict(list)  # name -> places in the stack
        self.blocks: list[int] = []
        self.parts: list[str] = []
        self.linked = self.tags = self.regions = 0
        self.quotes = True
        self._scan()

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, kind, region = self.stack[-1] if self.stack else ("", OPEN, 0)
            self.lines.append(Line(text, min(self.linked, len(text)), self.tags, kind, region))
        self.parts.clear()
        self.linked = self.tags = 0

    def _put(self, text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.places["a"]:
                self.linked += len(" ".join(text.split()))

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack[-1][0]
            if name not in INLINE:
                self._end_line()
                self.blocks.pop()
            self.stack.pop()
            self.places[name].pop()

    def _place(self, name: str) -> int:
        return self.places[name][-1] if self.places[name] else -1

    def _tag_end(self, at: int) -> int:
        """Behind the tag that begins at ``at``; 0 if it has no end."""
        i = at
        while self.quotes:
            m = STOP.search(self.page, i)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            i = self.page.find(m[0][-1], m.end()) + 1
            if not i:
                break
        self.quotes = False  # an open value or no end: from here on a tag ends at its first bracket
        return self.page.find(">", at) + 1

    def _scan(self) -> None:
        page, at = self.page, 0
        while (k := page.find("<", at)) >= 0:
            nxt = page[k + 1 : k + 2]
            if nxt in ("!", "?"):
                self._put(page[at:k])
                if page.startswith("<!--", k):
                    end = page.find("-->", k + 4)
                    at = end + 3 if end >= 0 else len(page)
                elif page.startswith("<![CDATA[", k):
                    end = page.find("]]>", k)
                    self._put(page[k + 9 : end if end >= 0 else len(page)])
                    at = end + 3 if end >= 0 else len(page)
                else:
                    end = page.find(">", k)
                    at = end + 1 if end >= 0 else len(page)
                continue
            close = nxt == "/"
            m = NAME.match(page, k + 1 + close)
            end = self._tag_end(m.end()) if m else 0
            if not m or not end:
                stop = len(page) if m else k + 1
                self._put(page[at:stop])  # no tag
                at = stop
                continue
            self._put(page[at:k])
            at = end
            if close:
                self._end_tag(m[0].lower())
            else:
                at = self._start_tag(m[0].lower(), page[m.end() : end - 1], at)
        self._put(page[at:])
        self._close(0)
        self._end_line()

    def _end_tag(self, name: str) -> None:
        depth = self._place(name)
        if name in INLINE:
            if depth > (self.blocks[-1] if self.blocks else -1):
                self._close(depth)
        elif depth >= 0 and (name in SCOPES or depth > max(map(self._place, SCOPES))):
            self._close(depth)
        else:
            self._end_line()

    def _start_tag(self, name: str, rest: str, at: int) -> int:
        if name in RAW:
            if name not in INLINE:
                self._end_line()
            if not rest.endswith("/") or name in ("script", "style", "textarea", "title", "iframe"):
                stop = re.compile(rf"</{name if name.isalnum() else re.escape(name)}\s*>", re.I).search(self.page, at)
                return stop.end() if stop else len(self.page)
            return at
        for opened in CLOSED_BY.get(name, ()):
            depth = self._place(opened)
            if depth >= 0 and depth > max(map(self._place, FENCES[opened])):
                self._close(depth)
        if name not in INLINE:
            self._end_line()
        if name in VOID:
            return at
        _, now, region = self.stack[-1] if self.stack else ("", OPEN, 0)
        own = _kind(name, rest, now == PART)
        kind = SHUT if now == SHUT or own == SHUT else PART if own == PART else max(now, own) if now != PART or own == GIVES else PART
        if kind in (GIVES, SHUT) and now not in (GIVES, SHUT):
            self.regions += 1
            region = self.regions
        elif kind < GIVES:
            region = 0
        self.places[name].append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, kind, region))
        self.tags += 1
        return at


def weight(line: Line, inside: bool, outside: bool) -> int:
    """Of one line; ``inside`` a main part, or ``outside`` on a page that has one."""
    own = len(line.text) - line.linked
    w = own - LINKED * line.linked - TAGS * max(0, line.tags - 1)
    if 2 * line.linked > len(line.text):
        return max(-CLIP, w - MOSTLY) - OUTER * outside
    if outside:
        return max(-CLIP, min(4 * CLIP, w)) - OUTER
    return max(-CLIP, min(CLIP, w)) + MAIN * inside


def blocks(weights: list[int], width: int) -> list[int]:
    """The sum of the weights of the ``width`` lines around each line."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    n, back = len(weights), (width - 1) // 2
    return [total[min(n, i - back + width)] - total[max(0, i - back)] for i in range(n)]


def stretches(values: list[int], bar: float) -> Iterator[tuple[int, int]]:
    """[surge, dive) of every stretch of positive values that rises over ``bar``."""
    i, n = 0, len(values)
    while i < n:
        if values[i] <= 0:
            i += 1
            continue
        j = i
        while j < n and values[j] > 0:
            j += 1
        if max(values[i:j]) > bar:
            yield i, j
        i = j


def seen(lines: list[Line]) -> list[Line | None]:
    """The lines that take part, with one None for each run of others."""
    main = any(x.kind == PART for x in lines)
    size = defaultdict(int)
    for x in lines:
        size[x.region if x.kind == GIVES else -1] += len(x.text) - x.linked
    whole = sum(size.values())
    freed = set() if main else {r for r, n in size.items() if r >= 0 and n >= SHARE * whole}
    out: list[Line | None] = []
    for x in lines:
        if x.kind == SHUT or (x.kind == GIVES and x.region not in freed):
            if out and out[-1] is not None:
                out.append(None)
        else:
            out.append(x)
    return out


def extract(page: str, width: int = WIDTH, least: int = LEAST) -> str:
    """The main text; ``width`` 0 switches the blocks off and keeps all lines that take part."""
    found = seen(Scanner(page).lines)
    if not width:
        return " ".join(x.text for x in found if x)
    main = any(x and x.kind == PART for x in found)
    segments: list[list[Line | None]] = []  # blocks stay on one side of the borders of the main part
    last = None
    for x in found:
        side = last if x is None else main and x.kind == PART
        if side != last or not segments:
            segments.append([])
        segments[-1].append(x)
        last = side
    kept: list[str] = []
    for segment in segments:
        inside = main and any(x and x.kind == PART for x in segment)
        values = blocks([weight(x, inside, main and not inside) if x else 0 for x in segment], width)
        bar = 0 if main else min(least, max(values, default=0) / 4)
        for i, j in stretches(values, bar):
            kept += [x.text for x in segment[i:j] if x]
    return " ".join(kept)


def extract_pages(pages: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                texts = [extract(x, width, least) if x else "" for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")

"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text, each at the end of a root-to-leaf tag path (with classes, and the ids of containers).
For every path the length of its text, its punctuation, its link text and its number of blocks are summed; the fusion of
their logarithms is the path's ratio, which is smoothed over the page's order. The paths whose ratio is large beside the
page's mean are its core; a container without any core block is dropped, and what stands between core blocks or directly
beside their containers stays unless its ratio is nearly nothing. A short box outside of the container that holds most of
the core goes, unless it stands between the heading and that container. Names that are usual for boilerplate (classes, ids),
controls beside a short text, and headings of reader comments lower a ratio, elements for articles raise it; only elements
and attributes that say themselves that they are no content (menus, footers, controls, hidden ones) are left out whatever
their ratio. A form is left out unless it holds half of the page's text, a header unless it is an article's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import inf, log1p, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import common

# Element names of HTML by their part in a page.
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXT = _HEADINGS | {"p", "li", "dt", "dd", "blockquote", "pre", "td", "th", "tr", "tbody", "thead", "table", "caption", "figcaption", "figure", "address", "summary", "hgroup", "center"}
_GONE = {"nav", "footer", "aside", "button", "select", "option", "label", "legend", "output", "menu", "dialog", "head", "svg", "canvas", "object", "audio", "video"}
_GONE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
_CONTROLS = {"input", "button", "select", "textarea"}
#: Words of classes and ids that nearly always name boilerplate, those that sometimes do (outside of articles, on containers),
#: and those of adverts, which count in a line of text, too.
_ADVERTS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion"}
_STRONG = _ADVERTS | {
    "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "replies", "respond", "sidebar", "signup", "subscribe", "subscription", "toolbar", "topbar",
}
_WEAK = {"copyright", "discussion", "feedback", "legal", "recommended", "related", "reply", "search", "share", "sharing", "skip", "social", "widget"}
#: Words of names of elements that hold an article, whose header is the article's.
_ARTICLES = {"article", "entry", "post", "story"}
#: Headings of reader comments in the languages of the corpus: those that say so, and words that may head a part of the text, too.
_NOUN = r"(?:(?:reader|user)\s+)?comments?|kommentare?|leserkommentare|commentaires?|comentarios?"
_COMMENTS = re.compile(
    rf"\d+\s+(?:{_NOUN})\s*:?|(?:{_NOUN})\s*(?:\(\d+\)|\d+)\s*:?|(?:leave|post|write|add) an? (?:comment|reply).*|join the (?:conversation|discussion).*|what (?:our )?readers (?:say|think).*", re.I,
).fullmatch
_PERHAPS_COMMENTS = re.compile(rf"(?:{_NOUN})\s*:?", re.I).fullmatch
#: Which open elements an opening tag ends, up to the nearest element of the second set.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Of the page's mean ratio (by length of text): from CORE on a path is core, below LEAST it is no content.
CORE, LEAST = 0.25, 0.03
#: Factors of a ratio below a name that nearly always or sometimes names boilerplate, and in an article or main element.
STRONG, WEAK, ARTICLE = 0.005, 0.25, 2.0
#: Share of a ratio that link text keeps.
LINKED = 0.2
#: Share of the core that the container of most of it holds, at each level; core text of a short box, in characters and of all; its ratio beside that container's.
MOST, SHORT, SHORT_SHARE, BOX = 0.6, 200, 0.15, 0.7
#: Share of the page's text that stands directly beside an article's own header.
BESIDE = 0.25


def read_tag(html: str, at: int) -> tuple[int, dict[str, str]]:
    """Where the tag whose name ends at `at` ends, and its attributes, in one pass; a tag that never ends goes to the end of the page."""
    found: dict[str, str] = {}
    end = len(html)
    while True:
        match = _ATTRIBUTE.match(html, at)
        if not match:
            at = html.find(">", at)
            return (at + 1 if at >= 0 else end), found
        at, value = match.end(), ""
        if match[2]:
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote:
                close = html.find(quote, at + 1)
                if close < 0:
                    return end, found
                value, at = html[at + 1 : close], close + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.setdefault(match[1].lower(), value)


def _named(attributes: dict[str, str]) -> set[str]:
    names = attributes.get("class", "") + " " + attributes.get("id", "")
    return {p.lower() for p in _PARTS.findall(names)} if names != " " else set()


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _GONE_ROLES


class Page:
    """The nodes of a page in document order, and its blocks of text.

    Of each node: parent, tag, path (a number for each distinct tag path), factor of its ratio, and whether it is left
    out. Of each block: node, text, length of its link text. What only the whole page can tell is settled behind its end."""

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.factor, self.gone = [-1], ["html"], [0], [1.0], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []
        self.stack = [0]
        self.open: dict[str, list[int]] = {}
        self.parts: list[str] = []
        self.linked, self.links = 0, 0
        #: Nodes with a control in them, forms, headers (with whether their name or place says that they are an article's), and named nodes.
        self.controls: list[int] = []
        self.forms: list[int] = []
        self.headers: list[tuple[int, bool]] = []
        self.classed: set[int] = set()
        self.holders: set[int] = set()
        self.read(html)
        self.settle()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            node = self.stack[-1]
            while self.tag[node] in _INLINE:
                node = self.parent[node]
            self.blocks.append((node, text, min(self.linked, len(text))))
        self.linked = 0

    def push(self, tag: str, attributes: dict[str, str]) -> None:
        above = self.stack[-1]
        node, label, factor = len(self.tag), tag, self.factor[above]
        inline = tag in _INLINE
        gone = self.gone[above] or tag in _GONE or _hidden(attributes)
        inside = bool(self.open.get("article") or self.open.get("main"))
        names = _named(attributes) if attributes and not inline else set()
        if tag == "form" or attributes.get("role", "").lower() == "form":
            self.forms.append(node)
        elif (tag == "header" or "header" in names and tag not in _TEXT and tag not in ("html", "body", "article", "main", "section")) and not inside:
            self.headers.append((node, bool(names & _ARTICLES) or above in self.holders))
        if tag in _CONTROLS:
            self.controls.append(above)
        if attributes.get("class"):
            self.classed.add(node)
        if names & (_ARTICLES | {"content"}):
            self.holders.add(node)
        if attributes and not inline:
            label += "." + attributes.get("class", "")
            if tag not in _TEXT:
                label += "#" + attributes.get("id", "").rstrip("0123456789")
            if tag not in ("html", "body", "article", "main") and tag not in _HEADINGS:
                if names & _STRONG and not (names & {"article", "content", "body", "main"}):
                    factor *= STRONG
                elif names & _WEAK and tag not in _TEXT and tag != "section" and not inside:
                    factor *= WEAK
        if tag in ("article", "main") and not inside:
            factor *= ARTICLE
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(self.path[above] if inline else self.paths.setdefault((self.path[above], label), len(self.paths) + 1))
        self.factor.append(factor)
        self.gone.append(gone)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop(self, height: int) -> None:
        """Closes the elements from `height` on the stack on."""
        while len(self.stack) > height:
            self.open[self.tag[self.stack.pop()]].pop()

    def add(self, raw: str) -> None:
        if raw and not self.gone[self.stack[-1]]:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.links:
                self.linked += len(text.strip())

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        places = self.open.get(tag)
        if tag in _INLINE:
            # Only inline elements that are left out stand on the stack; others within them may have the same name.
            if places and places[-1] == len(self.stack) - 1:
                self.pop(places[-1])
        elif places:
            self.flush()
            self.links = 0
            self.pop(places[-1])
        elif tag not in _VOID:
            self.flush()

    def begin(self, tag: str, attributes: dict[str, str], empty: bool) -> None:
        if tag == "br":
            self.parts.append("\n")
        elif tag in _INLINE:
            if tag == "a":
                self.links = 1
            top = self.stack[-1]
            inside = self.tag[top] in _INLINE and self.gone[top]
            if not empty and (inside and tag == self.tag[top] or attributes and (_hidden(attributes) or _named(attributes) & _ADVERTS)):
                self.push(tag, attributes)
                self.gone[-1] = True
        elif tag in _VOID:
            if tag == "hr":
                self.flush()
            elif tag == "input" and attributes.get("type", "").lower() != "hidden":
                self.controls.append(self.stack[-1])
        else:
            self.flush()
            self.links = 0
            while self.tag[self.stack[-1]] == "p" or self.tag[self.stack[-1]] in _INLINE and self.open.get("p"):
                self.pop(len(self.stack) - 1)
            if tag in _ENDS:
                ends, stop = _ENDS[tag]
                bar = max((self.open[t][-1] for t in stop if self.open.get(t)), default=0)
                inner = [h for t in ends for h in self.open.get(t, [])[-2:] if h > bar]
                if inner:
                    self.pop(min(inner))
            self.push(tag, attributes)
            if empty:
                self.pop(len(self.stack) - 1)

    def read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            less = html.find("<", at)
            if less < 0:
                break
            self.add(html[at:less])
            after = html[less + 1 : less + 2]
            if after == "!" or after == "?":
                mark = "-->" if html.startswith("<!--", less) else ">"
                close = html.find(mark, less + 2)
                at = close + len(mark) if close >= 0 else end
                continue
            closing = after == "/"
            name = _NAME.match(html, less + 1 + closing)
            if not name:
                self.add("<")
                at = less + 1
                continue
            tag = name[0].lower()
            at, attributes = read_tag(html, name.end())
            if closing:
                self.close(tag)
            elif tag in _RAW:
                if tag in _CONTROLS:
                    self.controls.append(self.stack[-1])
                close = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
                at = html.find(">", close.start()) + 1 or end if close else end
            else:
                self.begin(tag, attributes, html[at - 2 : at - 1] == "/")
        if at < end:
            self.add(html[at:])
        self.flush()

    def container(self, node: int) -> int:
        """The nearest element around that is none of text."""
        while node and (self.tag[node] in _TEXT or self.tag[node] in _INLINE):
            node = self.parent[node]
        return node

    def settle(self) -> None:
        """Forms, headers, boxes with controls and reader comments, by their share and place in the whole page."""
        n, parent = len(self.tag), self.parent
        if self.forms or self.headers or self.controls:
            chars, beside = [0] * n, [0] * n
            for node, text, _ in self.blocks:
                chars[node] += len(text)
                beside[self.container(node)] += len(text)
            for node in range(n - 1, 0, -1):
                chars[parent[node]] += chars[node]
            total, drop, factor = chars[0], [False] * n, [1.0] * n
            for node in self.forms:
                drop[node] = 2 * chars[node] < total
            for node, named in self.headers:
                up = parent[node]
                least = chars[node] if self.tag[up] == "section" else BESIDE * total
                if not named and (self.tag[up] in ("body", "html") or beside[up] < max(1, least)):
                    drop[node] = True
            for node in {self.container(c) for c in self.controls}:
                # A notice, or another box with something to press, not a part of the text that stands beside it.
                if self.tag[node] in ("div", "span", "center", "fieldset") and 4 * chars[node] < total and beside[parent[node]] < BESIDE * total:
                    factor[node] = STRONG
            for node in range(1, n):
                drop[node] = drop[node] or drop[parent[node]]
                factor[node] *= factor[parent[node]]
                self.factor[node] *= factor[node]
            self.blocks = [b for b in self.blocks if not drop[b[0]]]
        self.settle_comments()

    def settle_comments(self) -> None:
        """What follows a heading of reader comments, behind half of the text, has a lower ratio: all of it in the heading's
        container if the heading says so or begins it, else the containers that follow."""
        n, parent = len(self.tag), self.parent
        total, before = sum(len(text) for _, text, _ in self.blocks), 0
        first: dict[int, int] = {}
        lower: dict[int, tuple[int, bool]] = {}
        for k, (node, text, _) in enumerate(self.blocks):
            up = max(0, parent[node])
            if len(text) < 60 and 2 * before >= total and up not in lower and (sure := bool(_COMMENTS(text)) or (_PERHAPS_COMMENTS(text) and (self.tag[node] in _HEADINGS or None))) is not None:
                if sure or _PERHAPS_COMMENTS(text):
                    begins = first.get(up, k) == k
                    follows = self.blocks[k + 1][0] if k + 1 < len(self.blocks) else 0
                    beside = parent[follows] == up and self.tag[follows] in _TEXT
                    if bool(_COMMENTS(text)) or begins or not beside:
                        lower[up] = (node, bool(_COMMENTS(text)) or begins)
            while up and up not in first:
                first[up] = k
                up = parent[up]
            before += len(text)
        if not lower:
            return
        factor = [1.0] * n
        for node in range(1, n):
            factor[node] = factor[parent[node]]
            if (found := lower.get(parent[node])) and (node == found[0] or node > found[0] and (found[1] or self.tag[node] not in _TEXT)):
                factor[node] = STRONG
            self.factor[node] *= factor[node]


def fused(chars: float, marks: float, linked: float, blocks: float) -> float:
    """Length by block and punctuation, without links."""
    return log1p(chars / blocks) * (1 + log1p(marks)) * (1 - (1 - LINKED) * linked / chars)


def path_ratios(page: Page) -> list[float]:
    """The fused ratio of every block's path: length and punctuation by block, without links, smoothed over the page's order."""
    sums: dict[int, list[float]] = {}
    for node, text, linked in page.blocks:
        s = sums.setdefault(page.path[node], [0.0, 0.0, 0.0, 0.0, 0.0])
        for k, x in enumerate((len(text), len(_PUNCTUATION.findall(text)), linked, 1)):
            s[k] += x
    own = {path: fused(*s[:4]) for path, s in sums.items()}
    raw = [own[page.path[node]] * page.factor[node] for node, _, _ in page.blocks]
    last = len(raw) - 1
    for k, (node, _, _) in enumerate(page.blocks):
        sums[page.path[node]][4] += (raw[max(0, k - 1)] + 2 * raw[k] + raw[min(last, k + 1)]) / 4
    mean = {path: s[4] / s[3] for path, s in sums.items()}
    ratio = [sqrt(r * mean[page.path[node]]) if page.factor[node] >= 1 else r for r, (node, _, _) in zip(raw, page.blocks)]
    lower = _boxes_outside(page, _core(page, ratio), ratio)
    return [r * STRONG if lower[node] else r for r, (node, _, _) in zip(ratio, page.blocks)]


def mean_ratio(page: Page, ratio: list[float]) -> float:
    """The mean of all characters."""
    return sum(r * len(text) for r, (_, text, _) in zip(ratio, page.blocks)) / max(1, sum(len(text) for _, text, _ in page.blocks))


def _core(page: Page, ratio: list[float]) -> list[int]:
    """Of each node, the characters of core blocks in it."""
    core, mean = [0] * len(page.tag), mean_ratio(page, ratio)
    for r, (node, text, _) in zip(ratio, page.blocks):
        if r >= CORE * mean and r > 0:
            core[node] += len(text)
    for node in range(len(core) - 1, 0, -1):
        core[page.parent[node]] += core[node]
    return core


def _heading(page: Page) -> int:
    """The node of the page's heading: the first h1, else the first heading, else none."""
    found = [b for b, _, _ in page.blocks if page.tag[b] in _HEADINGS]
    return next((b for b in found if page.tag[b] == "h1"), found[0] if found else len(page.tag))


def _around(page: Page, node: int) -> set[int]:
    """A node and all around it."""
    out = set()
    while 0 < node < len(page.tag):
        out.add(node)
        node = page.parent[node]
    return out


def content(page: Page, ratio: list[float]) -> list[int]:
    """Numbers of the blocks of the main text, given the ratio of each."""
    parent, n = page.parent, len(page.tag)
    mean, core, flow = mean_ratio(page, ratio), _core(page, ratio), [False] * n
    for r, (node, _, _) in zip(ratio, page.blocks):
        if r >= CORE * mean and r > 0:
            flow[node] = True
            if page.tag[node] in _TEXT:
                flow[parent[node]] = True
    around = _around(page, _heading(page))
    # A container without core blocks stays in the flow of core blocks and around the heading; elsewhere only elements of text do.
    kept = [True] * n
    for node in range(1, n):
        up = parent[node]
        kept[node] = kept[up] and (core[node] > 0 or core[up] == 0 or flow[up] or page.tag[node] in _TEXT or node in around)
    return [k for k, (r, (node, _, _)) in enumerate(zip(ratio, page.blocks)) if kept[node] and r >= LEAST * mean]


def _boxes_outside(page: Page, core: list[int], ratio: list[float]) -> list[bool]:
    """Of each node whether it is in a box beside the containers of most of the core: one whose name lowers its ratio, or a short one
    whose own text has a ratio below BOX of the innermost container's mean, but for those with the page's heading and between it
    and that container.

    core: of each node, the characters of core blocks in it. Boxes of one path are told apart here by what each holds."""
    parent, n = page.parent, len(page.tag)
    box = [t not in _TEXT and t not in _INLINE for t in page.tag]
    most = [0] * n
    for node in range(1, n):
        if box[node] and core[node] and (not most[parent[node]] or core[node] > core[most[parent[node]]]):
            most[parent[node]] = node
    way, node = {0}, 0
    while most[node] and core[most[node]] >= MOST * core[node]:
        node = most[node]
        way.add(node)
    heading = _heading(page)
    spared = _around(page, heading) | way
    classed = {page.path[x] for x in way if x in page.classed}
    inside, sums = [0] * n, {}
    for x in range(1, n):
        inside[x] = inside[parent[x]]
        if parent[x] in way and parent[x] != node and x not in spared and box[x] and page.tag[x] not in ("article", "main", "section"):
            inside[x], sums[x] = x, [0, 0, 0, 0]
    for b, text, linked in page.blocks:
        if x := inside[b]:
            for k, value in enumerate((len(text), len(_PUNCTUATION.findall(text)), linked, 1)):
                sums[x][k] += value
    short = min(SHORT, SHORT_SHARE * core[0])
    held = [False] * n
    for x in range(n):
        held[x] = x == node or x > 0 and held[parent[x]]
    least = BOX * sum(r * len(text) for r, (b, text, _) in zip(ratio, page.blocks) if held[b]) / max(1, sum(len(text) for b, text, _ in page.blocks if held[b]))
    if any(page.tag[x] in ("article", "main") for x in way):
        short, least = SHORT, inf  # outside of an article that says so
    lower = {
        x for x, own in sums.items() if own[3] and (
            page.factor[x] < page.factor[parent[x]] or core[x] < short and fused(*own) < least and not heading < x < node and page.path[x] not in classed
        )
    }
    return [x in lower for x in inside]


def main_text(html: str) -> str:
    """The blocks of the content paths, each with single spaces, joined by line feeds; empty if there are none."""
    page = Page(html)
    if not page.blocks:
        return ""
    return "\n".join(page.blocks[k][1] for k in content(page, path_ratios(page)))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id long, url string, html string): page_id, url, text, n_chars.

    Character references are decoded, white space in a block becomes one space. A null or empty page, and one
    without content, has the empty text. Rows that repeat a page_id are separate. An empty table gives an empty
    result. Other columns are not read. Time and memory are linear in the length of a page, of any length and depth.
    """
    common.tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of HTML pages by composite text density.

The parts that are never article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) go first, by element, role and name (see :data:`HINTS`). Over what is left each node's density is its characters for each tag,
adjusted by its links; the node whose children's densities have the largest sum holds the article. What stands beside it,
on each level up to the body, belongs to the article where it is about as dense, or is prose that touches such a part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - set("body dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split()) | {"dd", "dt", "li"}
#: An element that begins closes an open one of these, unless an element of the second set is between.
IMPLIED = {
    "li": (["li"], ["ul", "ol", "menu", "dir"]),
    "dt": (["dt", "dd"], ["dl"]),
    "dd": (["dt", "dd"], ["dl"]),
    "tr": (["tr"], ["table"]),
    "td": (["td", "th"], ["tr", "table"]),
    "th": (["td", "th"], ["tr", "table"]),
    "tbody": (["tbody", "thead", "tfoot"], ["table"]),
    "option": (["option"], ["select"]),
}

HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Blocks that articles are made of; a div or section may hold anything.
PROSE = HEADINGS | set("p ul ol dl blockquote pre table figure address hr".split())

#: Boxes that are a menu if they have as many links and hardly other text.
BOXES, MENU_LINKS = set("ul ol menu dir div section table dl".split()), 5

#: Elements, roles and words of class or id that mark what is not the article (fixed values).
DROPPED = set("nav footer aside script style noscript template iframe object svg math canvas audio video button select textarea input dialog menu head title noembed noframes search label".split())
#: Dropped unless they hold the article or most of the page's text: pages wrapped whole in a form are common.
WRAPPERS = set("form fieldset header".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A class or id made of such words, alone or with words of BESIDE, names a part that is left out. A name that only has one
#: of them, or is one of TOPICS, which are titles of sections as well, does so where most of the part's text is linked. Names
#: count neither on headings nor where the part holds most of the page's text.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion toolbar pagination pager copyright disclaimer outbrain taboola".split()
)

BESIDE = set("site main global top bottom left right primary secondary list box bar block area wrap wrapper container inner outer link links button buttons icon icons item items posts stories slot unit form thread zone".split())
TOPICS = set("discussion related recommended recommendations copyright disclaimer reply replies social share sharing promotion consent subscription alert notice notices".split())
#: Names of what readers wrote, which may be longer than an article that stands elsewhere on the page.
READERS = set("comment comments commentlist respond disqus".split())

_MARKS = r"<!--(?:.*?-->|.*)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>?"
_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
#: Comments and the like; with tags whose quoted values may hold a >; with tags that end at the next one.
_MARK = re.compile(f"{_MARKS}|(?!)(())()", re.S)
_QUOTED = re.compile(rf"{_MARKS}|{_NAME}((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(f"{_MARKS}|{_NAME}([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class _Page:
    """The nodes of a page in page order: node i's subtree is i to ``until[i] - 1``."""

    def __init__(self, html: str):
        self.tag, self.parent, self.until, self.dropped, self.suspect = ["#root"], [-1], [0], [False], [""]
        self.segments: list[tuple[int, int, str, int]] = []  # node, block, text, number of nodes begun before it
        self.stack, self.block = [0], 0
        self.open: dict[str, list[int]] = {}  # where elements of each name stand on the stack
        self._parse(html)
        while self.stack:
            self.until[self.stack.pop()] = len(self.tag)

    def _parse(self, html: str) -> None:
        at, raw = 0, ""
        last, quotes = html.rfind(">"), True
        while at < len(html):
            if raw:
                m = re.compile(rf"</{raw}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                stop = m.start() if m else len(html)
                self._text(html[at:stop], decode=raw in ("title", "textarea"))
                self._close(raw)
                at, raw = (m.end() if m else stop), ""
                continue
            # A tag whose quotes do not close is read up to the next >, and so are all behind it: no place is searched twice.
            pattern = _MARK if at > last else _QUOTED if quotes else _LOOSE
            m = pattern.search(html, at)
            if pattern is _QUOTED and (not m or html.find("<", at, m.start()) >= 0):
                loose = _LOOSE.search(html, at)
                if loose and (not m or loose.start() < m.start()):
                    m, quotes = loose, False
            if not m:
                rest = html[at:]
                if (cut := re.search(r"</?[a-zA-Z][^>]*$|<![^>]*$", rest)) is not None:  # a tag that the end of the page cut off
                    rest = rest[: cut.start()]
                self._text(rest)
                return
            self._text(html[at : m.start()])
            at = m.end()
            name = (m[3] or "").lower()
            if m[1] is not None:
                self._text(m[1], decode=False)
            elif name and m[2]:
                if name in BLOCK:
                    self.block += 1
                self._close(name)
            elif name:
                self._open(name, m[4])
                if name in RAW:
                    raw = name
                elif name in VOID:
                    self._close(name)

    def _text(self, text: str, decode: bool = True) -> None:
        if text:
            self.segments.append((self.stack[-1], self.block, unescape(text) if decode and "&" in text else text, len(self.tag)))

    def _open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._close("p", ["table", "td", "th", "button", "caption", "object"])
        if name in IMPLIED:
            ends, barriers = IMPLIED[name]
            for end in ends:
                self._close(end, barriers)
        if name in BLOCK:
            self.block += 1
        elif name == "br":
            self._text(" ")
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.until.append(0)
        self.dropped.append(name in DROPPED)
        suspicion = "" if not found or name in ("html", "body") else _suspicion(name, found)
        if suspicion not in ("", "hidden") and (self.open.get("pre") or self.open.get("code")):  # names of code's parts
            suspicion = ""
        if not suspicion and name in WRAPPERS:
            suspicion = "partly" if name == "header" and (self.open.get("article") or self.open.get("main")) else "wrapper"
        self.suspect.append(suspicion)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def _close(self, name: str, barriers: list[str] | None = None) -> None:
        places = self.open.get(name)
        if not places:
            return
        depth = places[-1]
        if barriers and any(self.open.get(b) and self.open[b][-1] > depth for b in barriers):
            return
        while len(self.stack) > depth:
            i = self.stack.pop()
            self.open[self.tag[i]].pop()
            self.until[i] = len(self.tag)


def _suspicion(tag: str, attributes: dict[str, str]) -> str:
    """What an element's attributes say of its text: "hidden", or named as a whole "furniture" or "readers", or "partly" so."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return "hidden"
    found = "furniture" if attributes.get("role", "").lower() in ROLES else ""
    if tag in HEADINGS:
        return found
    for name in [*attributes.get("class", "").split(), attributes.get("id", "")]:
        words = {w.lower() for w in _CAMEL.findall(name) if not w.isdigit()}
        hints = words & HINTS
        if not hints:
            continue
        if words <= HINTS | BESIDE and not words <= TOPICS:
            if hints & READERS:
                return "readers"
            found = "furniture"
        else:
            found = found or "partly"
    return found


def _leave_out(page: _Page) -> None:
    """Mark as dropped what is below a dropped node, and the suspects that their text does not clear."""
    n = len(page.tag)
    inner, holders = [0] * (n + 1), [0] * (n + 1)  # elements that hold or head an article, and that hold one, before each node
    linked = [False] * n
    for i in range(n):
        if i and page.dropped[page.parent[i]]:
            page.dropped[i] = True
        linked[i] = i > 0 and (linked[page.parent[i]] or page.tag[i] == "a")
        holders[i + 1] = holders[i] + (page.tag[i] in ("article", "main") and not page.dropped[i])
        inner[i + 1] = inner[i] + (page.tag[i] in ("article", "main", "h1") and not page.dropped[i])
    if not any(page.suspect):
        return
    chars, links = [0] * n, [0] * n
    for node, _, text, _ in page.segments:
        if not page.dropped[node]:
            k = sum(map(len, text.split()))
            chars[node] += k
            links[node] += k * linked[node]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p], links[p] = chars[p] + chars[i], links[p] + links[i]
    for i in range(1, n):
        if page.dropped[page.parent[i]]:
            page.dropped[i] = True
        elif page.suspect[i]:
            # A hint on an element around the article (say, "sidebar") says nothing about the article in it.
            count = holders if page.suspect[i] == "wrapper" else inner
            around = count[page.until[i]] - count[i + 1]
            # What readers said may stand in articles of its own.
            elsewhere = page.suspect[i] == "readers" and inner[n] > inner[page.until[i]] - inner[i]
            # Nor does one on most of the text, if it is not what readers say of an article elsewhere.
            most = 2 * chars[i] > chars[0] and not elsewhere and page.suspect[i] != "hidden"
            if (not around or elsewhere) and not most and (page.suspect[i] != "partly" or 2 * links[i] > chars[i]):
                page.dropped[i] = True


@dataclass
class _Part:
    """A child of a node on the path, or its own text with the inline elements in it."""

    loose: bool
    prose: bool
    core: bool
    chars: int = 0
    links: int = 0
    tags: int = 0
    nodes: list[int] = field(default_factory=list)
    segments: list[int] = field(default_factory=list)


def _article(page: _Page, best: int, body: int, chars: list[int], links: list[int], tags: list[int], link_tags: list[int]) -> list[bool]:
    """For each segment whether it stands in the article, of which ``best`` is a part or the whole.

    The path from the best node to the body sets a threshold: half the characters for each tag of its sparsest node, linked
    ones counted as their opposite. (Composite densities grow with a node's size, so that a paragraph's and a whole
    article's do not compare.) On each level parts that reach it belong to the article, and of the others those without
    many links that stand between such parts, or are prose and touch them. An element on the path that says that it is the
    article or the main part ends the way up, and within it all parts belong that are not mostly links. Lists and other
    boxes of nothing but links are left out wherever they stand.
    """
    n = len(page.tag)
    path = [best]
    while path[-1] > 0 and path[-1] != body:
        path.append(page.parent[path[-1]])
    named = next((k for k, i in enumerate(path) if page.tag[i] in ("article", "main")), None)
    inside = [False] * n
    kept = [False] * len(page.segments)

    def take(i: int) -> None:
        inside[i : page.until[i]] = [True] * (page.until[i] - i)

    take(best)
    if named is not None:
        path = path[: named + 1]
    if len(path) > 1:
        threshold = min((chars[i] - 2 * links[i]) / max(1, tags[i]) for i in path) / 2
        own: dict[int, list[int]] = {i: [] for i in path[1:]}
        for k, (node, *_) in enumerate(page.segments):
            if node in own:
                own[node].append(k)
        for on, i in zip(path, path[1:], strict=False):
            parts = _parts(page, i, on, own[i], chars, links, tags)
            for p in parts:
                p.core = p.core or p.chars - 2 * p.links >= max(1.0, threshold * p.tags)
            core = [k for k, p in enumerate(parts) if p.core]
            first, last = (core[0], core[-1]) if named is None else (0, len(parts) - 1)
            while first > 0 and parts[first - 1].prose and 2 * parts[first - 1].links <= parts[first - 1].chars:
                first -= 1
            while last + 1 < len(parts) and parts[last + 1].prose and 2 * parts[last + 1].links <= parts[last + 1].chars:
                last += 1
            for p in parts[first : last + 1]:
                if p.core or 2 * p.links <= p.chars:
                    for c in p.nodes:
                        if c != on:  # of that what belongs is taken already
                            take(c)
                    for k in p.segments:
                        kept[k] = True
    i = 1
    while i < n:
        box = inside[i] and i != best and page.tag[i] in BOXES and link_tags[i] >= MENU_LINKS and 10 * links[i] >= 9 * chars[i]
        if box:
            inside[i : page.until[i]] = [False] * (page.until[i] - i)
        i = page.until[i] if box else i + 1
    return [k or inside[node] for k, (node, *_) in zip(kept, page.segments, strict=True)]


def _parts(page: _Page, i: int, on: int, own: list[int], chars: list[int], links: list[int], tags: list[int]) -> list[_Part]:
    """What node i holds, in page order; ``on`` is its child on the path. Dropped and empty children are left out."""
    items = [(page.segments[k][3], 0, k) for k in own]
    c = i + 1
    while c < page.until[i]:
        if not page.dropped[c] and chars[c]:
            items.append((c, 1, c))
        c = page.until[c]
    parts: list[_Part] = []
    block = None
    for _, is_node, k in sorted(items):
        loose = not is_node or k != on and not any(t in BLOCK for t in page.tag[k : page.until[k]])
        if not loose:
            parts.append(_Part(False, page.tag[k] in PROSE, k == on, chars[k], links[k], tags[k], [k]))
            block = None
            continue
        if not is_node:
            if not page.segments[k][2].strip():
                if parts and parts[-1].loose:
                    parts[-1].segments.append(k)
                continue
            if not parts or not parts[-1].loose or block not in (None, page.segments[k][1]):  # a block began or ended since
                parts.append(_Part(True, True, False, tags=1))
            block = page.segments[k][1]
        elif not parts or not parts[-1].loose:
            parts.append(_Part(True, True, False, tags=1))
        p = parts[-1]
        if is_node:
            p.chars, p.links, p.tags = p.chars + chars[k], p.links + links[k], p.tags + tags[k]
            p.nodes.append(k)
        else:
            p.chars += sum(map(len, page.segments[k][2].split()))
            p.segments.append(k)
    return parts


def main_text(html: str | None) -> str:
    """The article of a page: blocks in page order joined by one line feed, white space within a block as one space.

    Empty for null, for a page without text and for one whose text is all of the kinds left out. Broken markup is read
    as browsers do in the common cases: unclosed paragraphs, list items and cells end where the next begins.
    """
    if not html:
        return ""
    page = _Page(html)
    n = len(page.tag)
    _leave_out(page)
    chars, links, tags, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
        if not page.dropped[i]:
            tags[i] = 1
            link_tags[i] = int(page.tag[i] == "a")
    for node, _, text, _ in page.segments:
        if not page.dropped[node]:
            k = sum(map(len, text.split()))
            own[node] += k
            chars[node] += k
            links[node] += k * linked[node]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p], links[p], tags[p], link_tags[p] = chars[p] + chars[i], links[p] + links[i], tags[p] + tags[i], link_tags[p] + link_tags[i]
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    share = links[body] / max(1, chars[body])

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], max(1, tags[i]), links[i], link_tags[i]
        if not c:
            return 0.0
        base = log(c / max(1, c - lc) * lc + share * c + e)
        return c / t * max(0.0, log(max(1.0, c / max(1, lc) * t / max(1, lt)))) / max(1.0, log(max(e, base)))

    densities = [density(i) for i in range(n)]
    sums = [float(own[i] if not linked[i] else 0) for i in range(n)]
    for i in range(1, n):
        if not page.dropped[i]:
            sums[page.parent[i]] += densities[i]
    best = max((i for i in range(n) if not page.dropped[i] and chars[i]), key=lambda i: (sums[i], i), default=0)
    kept = _article(page, best, body, chars, links, tags, link_tags)
    out: list[str] = []
    last = None
    for k, (node, block, text, _) in enumerate(page.segments):
        if kept[k] and not page.dropped[node]:
            if block == last:
                out[-1] += text
            else:
                out.append(text)
                last = block
    return "\n".join(t for t in (" ".join(x.split()) for x in out) if t)


def extract(df: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Return ``id, url, text, n_chars`` for each row: the page's :func:`main_text`, read from the whole html.

    Other columns are ignored; repeated rows stay, a null html gives an empty text, an empty table an empty result. There
    is no shuffle: each page stands for itself.
    """
    kind = df.schema[id].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = df.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(texts, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id)

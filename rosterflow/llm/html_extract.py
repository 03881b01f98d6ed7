"""Main text of web pages by tag-path ratios.

A page is read as a run of text blocks, each with the path of tags from the root to it. Per path, the text length and the punctuation
are summed and set against the number of its blocks; the two ratios are smoothed with those of the path's container and of the
containers around it, multiplied, and held against the page's best path. Paths inside site furniture by its tag (navigation, asides, forms
and so on) and paths that are mostly links are never content. A name in class, id or role that is or holds a word of furniture is a weight:
the square of the share of the page's text that its element holds. So is an article or main element: paths outside count by the share of
the text that lies outside.

The paths over the threshold choose the content node: from the root down to the container that holds nearly all of their text, or to an
article that holds most of it. All of that node's text is content, short lines, lists, tables and captions too, but for furniture in it:
by tag, by a name if the ratios of its own paths reject it as well, by links, and, in a node that is no article, bare boxes whose path falls short.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is no markup, and those that end a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: A start tag of the key's group ends an open element of the value's, if no element of the third group lies between.
CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
SCOPES = frozenset("body article aside div section main nav footer header form table ul ol dl blockquote td th button".split())
#: Site furniture, by tag and by the words of class and id.
FURNITURE = frozenset("nav aside footer form button select input dialog menu head object embed audio video canvas map".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent notice gdpr newsletter subscribe subscription popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related share sharing social comment comments respond disqus replies footer header masthead toolbar pagination pager login signup search skip".split()
)
OPEN = re.compile(r"<(?=!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
VALUE_END = re.compile(r"[>\"']")
CLASS = re.compile(r"""\bclass\s*=\s*["']?\s*([^\s"'>]+)""", re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")
#: A block's path is that of its nearest elements, so that pages of open tags without end stay linear.
DEEPEST = 64
HOMES = ("article", "main")
#: Elements that may be the content node, and boxes that hold text of no kind of its own.
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())
BOXES = frozenset("div section center".split())
#: A node is left for a child with this share of its content, a page for an article with that, for its only one with the last.
NEARLY_ALL, MOST, SOME = 0.85, 0.5, 0.1
#: Furniture by a name stays if it holds a paragraph's length of text and its own paths score this share of the best; names of readers'
#: remarks that come in numbers never do.
NAMED_LEAST, PARAGRAPH = 0.6, 140
REMARKS = frozenset("comment comments respond disqus replies".split())


#: A header is furniture within a longer name if that says whose header it is: an entry's header holds its heading.
SITE = frozenset("site page global top nav menu".split())


class Tags:
    """Tags and comments of a page, in order. A quote that does not close before the page ends is no quote; where the last one of a kind
    stands is looked up once, so that open quotes cost no second pass."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, tag, attributes) of the next one from ``at`` on; the tag is empty for comments and declarations."""
        page = self.page
        while m := OPEN.search(page, at):
            start = m.start()
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if page[start + 1] in "!?":
                end = page.find(">", start)
                return start, len(page) if end < 0 else end + 1, False, "", ""
            name = NAME.match(page, start + 1)
            k = name.end()
            while (q := VALUE_END.search(page, k)) and q[0] != ">":
                k = q.end()
                if self.last[q[0]] >= k:
                    k = page.find(q[0], k) + 1
            if not q:
                q = re.compile(">").search(page, name.end())  # an open quote ran to the end: the tag ends at the first bracket
            if not q:  # a tag that the page's end cuts off
                return start, len(page), False, "", ""
            return start, q.end(), bool(name[1]), name[2], page[name.end() : q.start()]
        return None


def _furniture(tag: str, attributes: str, homes: int) -> tuple[int, bool]:
    """2: furniture by its tag, 1: a name is or holds a word of furniture, 0: neither; and is a name one for readers' remarks?"""
    if tag in FURNITURE or (tag == "header" and not homes):
        return 2, False
    found, remarks = 0, False
    if tag not in ("html", "body", "article", "main") and "=" in attributes:
        for m in NAMED.finditer(attributes):
            for name in m[1].lower().strip("\"'").split():
                held = WORDS.intersection(words := re.split(r"[^a-z0-9]+", name))
                if name in WORDS or held - {"header"} or (held and not SITE.isdisjoint(words)):
                    found, remarks = 1, remarks or not REMARKS.isdisjoint(words)
    return found, remarks


class Page:
    """A page's elements in the order of their start tags (parent, tag, kind, whether its name is one for remarks, how many follow within it)
    and its text blocks: (path, text, characters within links, furniture by tag?, element). An element whose name holds a word of furniture
    stands in paths under a name of its own, with a number after #; boxes stand there with their class.

    For each tag the places of its open elements are kept, and those of scopes, so that no tag looks through the open ones."""

    def __init__(self, page: str):
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.kind: list[int] = []
        self.remarks: list[bool] = []
        self.size: list[int] = []
        self.blocks: list[tuple[tuple[str, ...], str, int, bool, int]] = []
        self.open: list[int] = []
        self.names: list[str] = []  # of blocks and of marked elements
        self.shown: list[bool] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []
        self.parts: list[str] = []
        self.linked = self.shut = self.homes = self.marked = 0
        self.filled, self.where, self.buried, self.at = False, (), False, -1
        self._read(page)

    def _end_block(self) -> None:
        self.filled = False
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((self.where, text, min(self.linked, len(text)), self.buried, self.at))
        self.parts, self.linked = [], 0

    def _add(self, text: str) -> None:
        if text:
            if not self.filled and not text.isspace():
                self.where, self.buried, self.filled = tuple(self.names[-DEEPEST:]), self.shut > 0, True
                self.at = self.open[-1] if self.open else -1
            self.parts.append(text)
            if self.places["a"]:
                self.linked += len(text)

    def _pop(self, k: int) -> None:
        while len(self.open) > k:
            at = self.open.pop()
            tag = self.tag[at]
            if self.shown.pop():
                self.names.pop()
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
            self.shut -= self.kind[at] == 2
            self.homes -= tag in HOMES
            self.size[at] = len(self.tag) - at - 1
            if tag in BLOCKS:
                self._end_block()

    def _close(self, tags: tuple[str, ...], bounded: bool = True) -> None:
        """Ends the innermost open element of these tags, unless a scope lies within it."""
        k = max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)
        if k >= 0 and (not bounded or not self.scopes or self.scopes[-1] <= k):
            self._pop(k)

    def _read(self, page: str) -> None:
        at, tags = 0, Tags(page)
        while True:
            m = tags.next(at)
            self._add(page[at : m[0]] if m else page[at:])
            if not m:
                break
            _, at, closing, tag, attributes = m
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                self._close((tag,), tag not in BLOCKS)
                continue
            if tag in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            if tag in CLOSES:
                self._close(CLOSES[tag])
            if tag in BLOCKS:
                self._end_block()
            if tag in VOID or attributes.endswith("/"):
                continue
            if tag == "a":  # links do not nest
                self._close(("a",))
            self._start(tag, attributes)
        self._pop(0)
        self._end_block()

    def _start(self, tag: str, attributes: str) -> None:
        kind, remarks = _furniture(tag, attributes, self.homes)
        here = len(self.tag)
        self.parent.append(self.open[-1] if self.open else -1)
        self.tag.append(tag)
        self.kind.append(kind)
        self.remarks.append(remarks)
        self.size.append(0)
        self.marked += kind == 1
        self.shut += kind == 2
        self.homes += tag in HOMES
        self.places[tag].append(len(self.open))
        if tag in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(here)
        name = tag.replace("#", "").replace(".", "")
        if kind == 1:
            name = f"{name}#{self.marked}"
        elif tag in BOXES and (c := CLASS.search(attributes)):
            name = f"{name}.{c[1].lower()}".replace("#", "")
        self.shown.append(tag in BLOCKS or kind == 1)
        if self.shown[-1]:
            self.names.append(name)


def extract(html: str, threshold: float = 0.15, smooth: float = 0.5) -> str:
    page = Page(html)
    found = [b for b in page.blocks if not b[3]]
    length: dict[tuple, float] = defaultdict(float)
    marks: dict[tuple, float] = defaultdict(float)
    links: dict[tuple, float] = defaultdict(float)
    count: dict[tuple, int] = defaultdict(int)
    for path, text, linked, _, _ in found:
        for p in {path, path[:-1]}:  # a path and its container
            length[p] += len(text)
            marks[p] += len(PUNCTUATION.findall(text))
            links[p] += linked
            count[p] += 1

    def ratio(p: tuple) -> float:
        if not count.get(p) or links[p] > 0.5 * length[p]:
            return 0.0
        return math.log1p(length[p] / count[p]) * math.log1p(1 + marks[p] / count[p]) * math.log1p(length[p])

    # characters that are no links, of the page, of its article and main elements, and of each element with a mark
    held: dict[str, int] = defaultdict(int)
    told = {path: {"", *(x for x in path if "#" in x or x in HOMES)} for path in {b[0] for b in found}}
    for path, text, linked, _, _ in found:
        for part in told[path]:
            held[part] += len(text) - linked
    share = {x: n / max(held[""], 1) for x, n in held.items()}
    homes = [h for h in HOMES if h in share]

    plain: dict[tuple, float] = {}
    score: dict[tuple, float] = {}
    for path in {b[0] for b in found}:
        s, weight, p = ratio(path), smooth, path[:-1]
        while p and weight > 0.01:
            s += weight * ratio(p)
            weight, p = weight * smooth, p[:-1]
        plain[path] = s if links[path] <= 0.5 * length[path] else 0.0
        score[path] = plain[path] * math.prod(share[x] ** 2 for x in path if "#" in x) * math.prod(1 - share[h] for h in homes if h not in path)
    best = max(score.values(), default=0.0)
    if not best:  # links alone
        return ""
    rejected = _rejected(page, found, plain)
    sound = [b for b in found if rejected[b[4]] < 0] or found
    best = max(score[b[0]] for b in sound) or best
    node = _content_node(page, sound, score, threshold * best)
    last = len(page.tag) if node < 0 else node + page.size[node]
    trusted = node >= 0 and page.tag[node] == "article"

    def stays(path: tuple, linked: int, text: str, at: int) -> bool:
        if not (node <= at <= last) or (at > node and rejected[at] > node):
            return False
        bare = at < 0 or page.tag[at] in BOXES or page.tag[at] not in BLOCKS and (not path or path[-1].split(".")[0].split("#")[0] in BOXES)
        return trusted or not bare or ratio(path) >= threshold * best

    return "\n".join(text for path, text, linked, _, at in found if stays(path, linked, text, at))


def _content_node(page: Page, found: list, score: dict[tuple, float], least: float) -> int:
    """The element that holds the text of paths over the threshold, -1 for the whole page: down from the root while a container holds nearly
    all of it; an article that holds most of the page's is the node."""
    mass = [0.0] * (len(page.tag) + 1)  # the page's own stands last, at -1
    for path, text, _, _, at in found:
        if score[path] >= least:
            mass[at] += score[path] * len(text)
    for k in range(len(page.tag) - 1, -1, -1):
        mass[page.parent[k]] += mass[k]
    top = [-1] * (len(page.tag) + 1)
    for k, tag in enumerate(page.tag):
        up = page.parent[k]
        if tag in CONTAINERS and (top[up] < 0 or mass[k] > mass[top[up]]):
            top[up] = k
    articles = [k for k, tag in enumerate(page.tag) if tag == "article"]
    for k in articles:
        if mass[k] > 0 and mass[k] >= (SOME if len(articles) == 1 else MOST) * mass[-1]:
            return k
    node = -1
    while (child := top[node]) >= 0 and mass[child] >= NEARLY_ALL * mass[node]:
        node = child
    return node


def _rejected(page: Page, found: list, plain: dict[tuple, float]) -> list[int]:
    """For each element the innermost of itself and those around it that is furniture by a name or by links, else -1."""
    n = len(page.tag)
    chars, linked, worth = [0] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)
    for path, text, of_links, _, at in found:
        chars[at] += len(text)
        linked[at] += of_links
        worth[at] += plain[path] * len(text)
    for k in range(n - 1, -1, -1):
        for sums in (chars, linked, worth):
            sums[page.parent[k]] += sums[k]
    remarks = sum(page.remarks)
    enough = NAMED_LEAST * max(plain.values(), default=0.0)
    out = [-1] * (n + 1)
    for k in range(n):
        named = page.kind[k] == 1 and ((page.remarks[k] and remarks > 1) or chars[k] < PARAGRAPH or worth[k] < enough * chars[k])
        listed = page.tag[k] in ("ul", "ol", "div", "section", "table") and chars[k] and linked[k] > 0.5 * chars[k]
        out[k] = k if named or listed else out[page.parent[k]]
    return out


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page, in place: id_col, url_col, text, n_chars. A null page is empty; a page without content, such as one of links
    alone, has an empty text. Repeated pages each give a row; pages are read whole, whatever their length; paths of equal scores are kept
    or dropped alike. Other columns are not read. An empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})

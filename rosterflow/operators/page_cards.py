"""Contacts from pages by their element tree: an address belongs to the block around it, and blocks may nest."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import company as co
from ..functions import contact as ct
from ..functions import email as em
from ..functions.signature import bound
from .miners import FIELDS, field_of, label_of, spread

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "noscript", "template"))
#: Tags before and behind which a line ends, and what a start tag closes if it stands open at the top.
LINES = frozenset("p div li tr td th dt dd dl ul ol table section article address h1 h2 h3 h4 h5 h6 header footer nav form br hr".split())
CLOSED_BY = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Blocks that hold a contact, those that do if they hold enough text, how much, how far up they are sought, what else
#: may hold one, and where an address may stand as text.
HOLDERS, BIG_HOLDERS, ENOUGH, HEIGHT = ("tr", "li", "dl", "article", "section"), ("div", "td"), 30, 6
NEAREST = ("tr", "li", "div", "td", "dd", "article", "section")
TEXT_TAGS = ("td", "th", "li", "p", "div", "span", "dd", "dt", "address")
BOLD = ("h1", "h2", "h3", "h4", "h5", "h6", "b", "strong")

#: Trees of so many characters of pages are held at once in a task.
SLICE = 500_000

ELEMENT = "struct<tag:string,parent:int,size:int,start:int,stop:int,chars:int,nearest:int,href:string>"
TREE = f"elements array<{ELEMENT}>, pieces array<struct<owner:int,text:string>>"


class TreeBuilder(HTMLParser):
    """Elements in the order of their start tags, so that an element's descendants follow it, and pieces of text in theirs. Linear in the
    page: each element is opened and closed once, and a closing tag without an open one costs nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.pieces: list[tuple[int, str]] = []
        self.open: list[int] = []
        self.count: dict[str, int] = {}

    def line(self) -> None:
        self.pieces.append((self.open[-1] if self.open else -1, "\n"))

    def shut(self) -> None:
        at = self.open.pop()
        e = self.elements[at]
        self.count[e[0]] -= 1
        if e[0] in LINES:
            self.line()
        e[2], e[4] = len(self.elements) - at - 1, len(self.pieces)
        if e[1] >= 0:
            self.elements[e[1]][5] += e[5]

    def handle_starttag(self, tag, attrs):
        while self.open and self.elements[self.open[-1]][0] in CLOSED_BY.get(tag, ()):
            self.shut()
        if tag in LINES:
            self.line()
        parent = self.open[-1] if self.open else -1
        at = len(self.elements)
        nearest = at if tag in NEAREST else self.elements[parent][6] if parent >= 0 else -1
        href = next((v for k, v in attrs if k == "href"), None) if tag == "a" else None
        self.elements.append([tag, parent, 0, len(self.pieces), len(self.pieces), 0, nearest, href])
        if tag not in VOID:
            self.open.append(at)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if self.count.get(tag, 0):
            while True:
                last = self.elements[self.open[-1]][0]
                self.shut()
                if last == tag:
                    break

    def handle_data(self, data):
        if self.open and self.elements[self.open[-1]][0] in SILENT:
            return
        owner = self.open[-1] if self.open else -1
        self.pieces.append((owner, " ".join(data.split()) + " " if data.strip() else " "))
        if owner >= 0:
            self.elements[owner][5] += len(data.strip())

    def finish(self) -> tuple[list, list]:
        self.close()
        while self.open:
            self.shut()
        return [tuple(e) for e in self.elements], self.pieces


def tree_of(html: str | None) -> tuple[list, list]:
    builder = TreeBuilder()
    builder.feed(html or "")
    return builder.finish()


def _structs(rows: list[list], names: dict[str, pa.DataType]) -> pa.Array:
    """A list of structs for each page, from tuples, column by column."""
    places = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    columns = [pa.array([x[k] for row in rows for x in row], kind) for k, kind in enumerate(names.values())]
    return pa.ListArray.from_arrays(pa.array(places), pa.StructArray.from_arrays(columns, list(names)))


def tree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, elements, pieces from batches of id and html. Trees leave after every SLICE characters of pages, so that no task ever holds
    those of a whole batch."""
    element = {n: pa.string() if n in ("tag", "href") else pa.int32() for n in ("tag", "parent", "size", "start", "stop", "chars", "nearest", "href")}
    piece = {"owner": pa.int32(), "text": pa.string()}
    for batch in batches:
        start, size, trees = 0, 0, []
        for at, html in enumerate(batch.column(1), 1):
            page = html.as_py()
            trees.append(tree_of(page))
            size += len(page or "")
            if size > SLICE or at == batch.num_rows:
                lists = [_structs([t[0] for t in trees], element), _structs([t[1] for t in trees], piece)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, at - start), *lists], ["id", "elements", "pieces"])
                start, size, trees = at, 0, []


def with_trees(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, elements, pieces of each page. elements: tag, parent (its place among the elements, -1 for none), size (how many follow within it),
    start and stop (its pieces), chars of its text, nearest (the closest block that may hold a contact), href. A null page has none."""
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType), *T.StructType.fromDDL(TREE).fields])
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(tree_batches, schema)


def _element(at: Column) -> Column:
    return F.get(F.col("elements"), at)


def holder_of(at: Column) -> Column:
    """The block above an element that holds its contact, HEIGHT steps up at most, else the nearest that may, or -1."""
    fits = lambda e: e["tag"].isin(*HOLDERS) | (e["tag"].isin(*BIG_HOLDERS) & (e["chars"] > ENOUGH))

    def step(acc: Column, _: Column) -> Column:
        up = _element(acc["at"])["parent"]
        go = (acc["found"] < 0) & (up >= 0)
        return F.struct(F.when(go, up).otherwise(acc["at"]).alias("at"), F.when(go & fits(_element(up)), up).otherwise(acc["found"]).alias("found"))

    climbed = F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), F.struct(at.cast("int").alias("at"), F.lit(-1).alias("found")), step)
    return bound(climbed["found"], lambda found: F.when(found >= 0, found).otherwise(F.coalesce(_element(at)["nearest"], F.lit(-1))))


def text_within(e: Column) -> Column:
    """An element's text, a line for each block within it."""
    words = F.transform(F.slice(F.col("pieces"), e["start"] + 1, e["stop"] - e["start"]), lambda p: p["text"])
    return F.array_join(words, "")


def lines_within(e: Column) -> Column:
    return F.filter(F.transform(F.split(text_within(e), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def labelled(lines: Column) -> Column:
    """struct(field, value) of lines that open with a label, and of those that are one, with the next line as their value."""
    bare = lambda x: field_of(F.regexp_replace(x, r"\s*[:\-]\s*$", ""))
    after = lambda i: F.get(lines, i + 1)
    beside = lambda x, i: F.when(bare(x).isNotNull() & after(i).isNotNull() & bare(after(i)).isNull(), F.struct(bare(x).alias("field"), after(i).alias("value")))
    return F.filter(F.transform(lines, lambda x, i: F.coalesce(label_of(x), beside(x, i))), lambda p: p.isNotNull())


def mine_page_cards(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, email, company, name, phone, website, country, city, address, title: a row for each address of a page, from mail links and texts.

    An address's card is the block around it, the smallest of nested ones; labels may stand before their values or beside them (in the cell,
    term or line before). Without a label the company is the card's first heading or bold text, else the domain's words; the phone is the
    first number, the site the first link that is no social network's. Of several cards for an address the first value of a field counts.
    Mailboxes of no person go. Within the row up to the cards, once pages are dealt by id; null and empty pages have none; id_col must tell pages apart.
    """
    trees = with_trees(spread(pages.select(id_col, html_col), id_col), id_col, html_col)
    linked = F.filter(F.transform("elements", lambda e, i: F.struct(F.lower(F.trim(F.regexp_extract(F.coalesce(e["href"], F.lit("")), r"(?i)^mailto:([^?]+)", 1))).alias("email"), i.alias("at"))), lambda x: x["email"].contains("@"))
    stands = F.filter("pieces", lambda p: p["text"].contains("@") & F.coalesce(_element(p["owner"])["tag"].isin(*TEXT_TAGS), F.lit(False)))
    written = F.flatten(F.transform(stands, lambda p: F.transform(em.extract_emails(p["text"]), lambda e: F.struct(e.alias("email"), p["owner"].alias("at")))))
    places = F.filter(F.concat(linked, written), lambda x: ~em.local_part(x["email"]).isin(*em.JUNK_PREFIXES) & em.is_valid(x["email"]))

    def card(place: Column) -> Column:
        return bound(holder_of(place["at"]), lambda h: bound(_element(h), lambda e: bound(lines_within(e), lambda lines: _card(place["email"], h, e, lines))))

    cards = trees.filter(F.size("elements") > 0).select("id", F.posexplode(F.transform(places, card)).alias("n", "c")).select("id", "n", "c.*")
    value = lambda f: F.get(F.filter("fields", lambda p: p["field"] == f), F.lit(0))["value"]
    filled = {f: value(f) for f in FIELDS if f != "email"}
    filled["company"] = F.coalesce(filled["company"], "bold", co.company_of_domain(F.col("email")))
    filled["phone"] = F.coalesce(filled["phone"], value("fax"), "number")
    filled["website"] = F.coalesce(ct.clean_website(filled["website"]), "link")
    rows = cards.select("id", "email", "n", *[v.alias(f) for f, v in filled.items()])
    return rows.groupBy("id", "email").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("n"))).alias(f) for f in filled])


def _card(email: Column, at: Column, e: Column, lines: Column) -> Column:
    inside = F.slice(F.col("elements"), at + 2, e["size"])
    bolds = F.transform(F.filter(inside, lambda x: x["tag"].isin(*BOLD)), lambda x: F.trim(F.regexp_replace(text_within(x), r"\s+", " ")))
    bold = F.get(F.filter(bolds, lambda b: F.length(b).between(2, 200) & ~b.contains("@") & ~F.endswith(b, F.lit(":")) & field_of(b).isNull()), F.lit(0))
    links = F.transform(F.filter(inside, lambda x: F.coalesce(x["href"], F.lit("")).rlike("(?i)^https?://")), lambda x: ct.clean_website(x["href"]))
    number = F.get(ct.extract_phones(F.array_join(lines, "\n")), F.lit(0))
    return F.struct(email.alias("email"), labelled(lines).alias("fields"), bold.alias("bold"), F.get(F.filter(links, lambda u: u.isNotNull()), F.lit(0)).alias("link"), number.alias("number"))

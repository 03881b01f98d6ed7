"""HTML miners as table functions: directory pages of bold labels, and cards that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact as ct
from ..functions import email as em
from .miners import labels_within, spread

#: Class words of the elements that hold one contact each, and the elements that may.
CARD_WORDS = "card|exhibitor|member|profile|company|vendor|listing|person|speaker|team-member|contact-item|exhibitor-item"
CARD = rf"""<(?:div|li|article|section|tr|td)\b[^>]*class\s*=\s*["'](?:[^"']*\s)?(?:{CARD_WORDS})(?:\s[^"']*)?["']"""
_ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#64;": "@", "&amp;": "&"}


def _decoded(x: Column) -> Column:
    for entity, character in _ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(character))
    return x


def _visible(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")


def directory_text(html: Column) -> Column:
    """A directory page as lines of label: value. Mail and web links become their addresses; a bold line without a label is a company's."""
    x = _visible(html)
    x = F.regexp_replace(x, r"""(?is)<a\b[^>]*href\s*=\s*["']mailto:([^"'?]+)[^>]*>.*?</a>""", "$1")
    x = F.regexp_replace(x, r"""(?is)<a\b[^>]*href\s*=\s*["'](https?://[^"']+)["'][^>]*>.*?</a>""", "$1")
    x = F.regexp_replace(x, r"[\r\n]+", " ")
    x = F.regexp_replace(x, r"(?i)\s*(?:<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article)\s*>|;\s*(?=<(?:b|strong)\b))\s*", "\n")
    x = F.regexp_replace(x, r"(?im)^(?:\s|<(?!b>|b\s|strong\b)[^>]*>)*<(b|strong)\b[^>]*>([^<:\n]+)</\1\s*>\s*$", "company: $2")
    return _decoded(F.regexp_replace(x, "<[^>]*>", ""))


def mine_directory(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, contact and its fields, of a page's entries that have an e-mail, as mine_labels gives them. Null pages have none."""
    dealt = spread(pages.select(id_col, html_col), id_col)
    return labels_within(dealt.select(F.col(id_col).alias("id"), directory_text(F.col(html_col)).alias("text")))


def mine_cards(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, card (its number on the page, from 1), email, company, phone, website of cards that hold an address. A card reaches up to the
    next one; its first heading or bold text is its company. Within the row, once pages are dealt by id."""
    pieces = F.split(_visible(F.col(html_col)), f"(?i)(?={CARD})", -1)
    cards = spread(pages.select(id_col, html_col), id_col).select(F.col(id_col).alias("id"), F.posexplode(pieces).alias("card", "piece")).filter(F.col("piece").rlike(f"(?i)^{CARD}") & F.col("piece").rlike("@|&#64;"))
    piece = F.col("piece")
    text = _decoded(F.regexp_replace(piece, "<[^>]*>", " "))
    linked = F.lower(F.regexp_extract(piece, r"""(?i)href\s*=\s*["']mailto:([^"'?]+)""", 1))
    email = F.coalesce(F.nullif(linked, F.lit("")), F.get(em.extract_emails(text), F.lit(0)))
    heading = F.regexp_extract(piece, r"(?is)<(h[1-6]|strong|b)\b[^>]*>(.*?)</\1\s*>", 2)
    dialled = F.nullif(F.regexp_extract(piece, r"""(?i)href\s*=\s*["']tel:([^"']+)""", 1), F.lit(""))
    links = F.transform(F.regexp_extract_all(piece, F.lit(r"""(?i)href\s*=\s*["'](https?://[^"']+)["']"""), F.lit(1)), lambda u: ct.clean_website(u))
    return cards.select(
        "id", F.col("card"), email.alias("email"), ct.clean_text(_decoded(F.regexp_replace(heading, "<[^>]*>", " "))).alias("company"),
        F.coalesce(dialled, F.get(ct.extract_phones(text), F.lit(0))).alias("phone"), F.get(F.filter(links, lambda u: u.isNotNull()), F.lit(0)).alias("website"),
    ).filter("email is not null")

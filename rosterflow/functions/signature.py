"""Contacts from the signature below a message, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that part a signature from the message, closing phrases, words of job titles, and the shapes of numbers and sites.
SEPARATORS = (r"^--\s*$", "^_{3,}$", "^-{3,}$", "^={3,}$")
CLOSINGS = (
    "regards", "best regards", "kind regards", "best", "thanks", "thank you", "cheers", "sincerely", "with regards", "warm regards", "cordially",
    "respectfully", "yours truly", "saygılarımla", "selamlar", "teşekkürler", "iyi dileklerimle", "mit freundlichen grüßen", "cordialement",
    "atentamente", "saludos",
)
TITLE_WORDS = (
    "CEO", "CTO", "CFO", "COO", "CIO", "CMO", "VP", "Vice President", "President", "Founder", "Co-Founder", "Owner", "Partner", "Director",
    "Managing Director", "Head of", "Chief", "Manager", "General Manager", "Regional Manager", "Area Manager", "Sales Manager",
    "Marketing Manager", "Project Manager", "Account Manager", "Supervisor", "Coordinator", "Specialist", "Consultant", "Engineer", "Architect",
    "Analyst", "Developer", "Representative", "Executive", "Officer", "Müdür", "Genel Müdür", "Satış Müdürü", "Pazarlama Müdürü", "Direktör",
    "Koordinatör", "Uzman", "Mühendis", "Geschäftsführer", "Leiter", "Vertrieb", "Directeur", "Responsable", "Gérant",
)
CLOSING = "(?iu)^(?:" + "|".join(CLOSINGS) + r")\s*[,.]?\s*$"
TITLE = r"(?i)\b(?:" + "|".join(TITLE_WORDS) + r")\b[\w /&-]{0,40}"
PHONE = r"(?:\+?\d{1,4}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{2,4}[\s.-]?\d{2,4}(?:[\s.-]?\d{1,4})?"
SITE = r"(?i)(?:www\.|https?://)[\w.-]+\.\w{2,}(?:/[\w./-]*)?"
LONGEST = 20


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once however often f names it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def signature_lines(body: Column) -> Column:
    """The trimmed, filled lines of the signature: those after a separating line, else after a closing phrase (1 to 20 lines either way),
    else the last ten filled lines of a message of three and more. Null if there are none. Quoted lines do not count."""
    text = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?i)<br\s*/?>", "\n"), "<[^>]+>", ""))
    return bound(F.filter(F.split(text, "\n", -1), lambda x: ~F.startswith(F.ltrim(x), F.lit(">"))), _block)


def _block(lines: Column) -> Column:
    filled = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    after = lambda at: F.slice(lines, at + 1, F.size(lines))
    found = []
    for pattern in SEPARATORS:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")
        found.append(F.when((at > 0) & (F.size(lines) - at).between(1, LONGEST), after(at)))
    first = F.greatest(F.size(lines) - LONGEST, F.lit(1))  # closing phrases further up have too many lines after them
    closing = F.array_position(F.transform(F.slice(lines, first, F.greatest(F.size(lines) - first, F.lit(0))), lambda x: x.rlike(CLOSING)), True).cast("int")
    found.append(F.when(closing > 0, after(closing + first - 1)))
    every = filled(lines)
    found.append(F.when(F.size(every) >= 3, F.slice(every, F.greatest(F.size(every) - 9, F.lit(1)), F.lit(10))))
    return bound(filled(F.coalesce(*found)), lambda block: F.when(F.size(block) > 0, block))


def title_in(lines: Column) -> Column:
    found = F.trim(F.regexp_extract(F.array_join(lines, "\n"), TITLE, 0))
    return F.nullif(found, F.lit(""))


def parse_signature(body: Column, lines: Column | None = None) -> Column:
    """struct(full_name, title, company, phone, website), null where a body has no signature or nothing but a site is in it.

    Pass ``lines`` (a column of signature_lines) where the lines are at hand. A number's longest match counts, from 7 digits on. The name
    is the first line that is no number, site, address or title; the company is the first such line behind it, else what follows "at", a
    comma, a slash or a dash in the last line with a title. A name that loses a closing comma is looked for in vain, so it is its own company.
    """
    lines = signature_lines(body) if lines is None else lines
    return bound(lines, lambda xs: bound(title_in(xs), lambda title: bound(_name_in(xs, title), lambda name: _parsed(xs, title, name))))


def _plain(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~(x.rlike(PHONE) | x.rlike(SITE) | x.contains("@")))


def _bare(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "[,.|]+$", ""))


def _name_in(lines: Column, title: Column) -> Column:
    odd = lambda x: F.length(F.regexp_replace(x, r"[a-zA-ZÀ-ÿĞğİıÖöÜüŞşÇç\s.'-]", ""))
    names = F.filter(_plain(lines), lambda x: F.length(x).between(3, 50) & (odd(x) <= 3) & ~F.coalesce(F.lower(x).contains(F.lower(title)), F.lit(False)))
    return _bare(F.get(names, F.lit(0)))


def _parsed(lines: Column, title: Column, name: Column) -> Column:
    block = F.array_join(lines, "\n")
    numbers = F.regexp_extract_all(block, F.lit(f"({PHONE})"), F.lit(1))
    longest = F.array_max(F.transform(numbers, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), F.trim(x).alias("x"))))["x"]
    phone = F.when(F.length(F.regexp_replace(longest, r"\D", "")) >= 7, longest)
    plain = _plain(lines)
    at = F.coalesce(F.array_position(plain, name).cast("int"), F.lit(0))
    rest = F.filter(F.slice(plain, at + 1, F.size(plain)), lambda x: F.length(x).between(2, 80) & ~F.coalesce((F.lower(x) == F.lower(title)) | (x == name), F.lit(False)))
    firm = F.get(F.filter(rest, lambda x: ~x.rlike(TITLE)), F.lit(0))
    split = F.filter(F.transform(F.filter(rest, lambda x: x.rlike(TITLE)), lambda x: F.split(x, r"(?i)\s+(?:at|@|/|,|-|–|—)\s+", -1)), lambda p: F.size(p) > 1)
    company = F.coalesce(_bare(firm), F.trim(F.element_at(F.get(split, F.size(split) - 1), -1)))
    site = F.nullif(F.regexp_extract(block, SITE, 0), F.lit(""))
    useful = F.coalesce(F.nullif(name, F.lit("")), title, F.nullif(company, F.lit("")), phone).isNotNull()
    return F.when(lines.isNotNull() & useful, F.struct(name.alias("full_name"), title.alias("title"), company.alias("company"), phone.alias("phone"), site.alias("website")))

"""Names, positions, industries, templates and verdicts over mined text and pages, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contact import blank_to_null, digits
from .email import domain, local_part

#: Mailbox names of no person, forms of address, and what follows a name.
DESK_PREFIXES = (
    "info", "contact", "support", "hello", "help", "sales", "admin", "webmaster", "noreply", "no-reply", "mail", "email", "enquiry",
    "enquiries", "office", "general", "team", "hr", "marketing", "billing", "accounts", "jobs", "careers", "press", "media", "news",
    "legal", "compliance",
)
TITLES = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "madam", "mx", "rev", "reverend", "fr", "father", "br", "brother", "sr",
    "sister", "hon", "honorable", "judge", "justice", "eng", "engr", "arch", "atty", "attorney", "cpa", "esq", "esquire", "phd", "md",
    "dds", "dvm", "od", "herr", "frau", "señor", "señora", "monsieur", "madame", "bay", "bayan", "sayın",
)
SUFFIXES = ("jr", "sr", "i", "ii", "iii", "iv", "v", "phd", "md", "dds", "dvm", "esq", "cpa")
_NAME = "([A-ZÀ-ÿ][a-zA-ZÀ-ÿ]+)\\s+([A-ZÀ-ÿ][a-zA-ZÀ-ÿ]+)"
#: Where names stand, in the order of trust; the last two in either case.
NAME_PLACES = (_NAME + r"\s*[-|,]", _NAME + r"\s*[<(]", r"(?iu)(?:contact|name|person|rep|representative):\s*" + _NAME, r"(?iu)(?:by|from)\s+" + _NAME)
#: Positions, in English, behind a label, and in Turkish.
POSITIONS = (
    r"(?i)\b(CEO|CFO|CTO|COO|CMO|VP|Director|Manager|Engineer|Developer|Designer|Analyst|Consultant|Sales|Marketing|HR|Admin|Owner|Founder|President|Executive|Specialist|Coordinator|Lead|Head|Chief)\b[^,\n]*",
    r"(?i)(?:position|title|role):\s*([^,\n]+)",
    r"(?iu)\b(Müdür|Yönetici|Mühendis|Uzman|Direktör|Koordinatör|Temsilci|Satış|Pazarlama)\b[^,\n]*",
)
#: A word's edge, where words are of ASCII letters, digits and underscores, whatever the Java release.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Names made up, and cities with what their country's name begins with.
MADE_UP = r"(?i)^((john|jane) (doe|smith)$|(test|user|contact|admin)\s)"
CITIES = {"paris": "france", "london": "uk|united kingdom|england", "tokyo": "japan", "new york": "usa|united states|us"}


def person_name(email: Column, context: Column) -> Column:
    """struct(first_name, last_name) or null: none for a desk's mailbox; else from the context, else from first.last@ or first_last@."""
    person = ~F.lower(local_part(email)).isin(*DESK_PREFIXES)
    good = lambda x: F.length(x).between(2, 50)
    found = []
    for place in NAME_PLACES:
        first, last = (F.regexp_extract(context, place, g) for g in (1, 2))
        found.append(F.when(good(first) & good(last) & ~F.lower(first).isin(*TITLES) & ~F.lower(last).isin(*SUFFIXES), F.struct(first.alias("first_name"), last.alias("last_name"))))
    first, last = (F.initcap(F.regexp_extract(F.lower(local_part(email)), "^([a-z]+)[._]([a-z]+)$", g)) for g in (1, 2))
    found.append(F.when(good(first) & good(last), F.struct(first.alias("first_name"), last.alias("last_name"))))
    return F.when(person, F.coalesce(*found))


def position_of(context: Column) -> Column:
    """The first pattern's match of 2 to 100 characters; of a labelled position the label stays."""
    found = [F.trim(F.regexp_extract(context, p.replace(r"\b", EDGE), 0)) for p in POSITIONS]
    return F.coalesce(*[F.when(F.length(x).between(2, 100), x) for x in found])


def industry_of(raw: Column, aliases: dict[str, str], known: tuple[str, ...]) -> Column:
    """An alias's industry, a known one in its own spelling, that of the first alias of 4 or more characters inside, else raw trimmed."""
    text, low = blank_to_null(raw), F.lower(F.trim(raw))
    exact = {**{k.lower(): k for k in known}, **aliases}
    direct = F.coalesce(*[F.when(low == k, v) for k, v in exact.items()])
    inside = [F.when(low.contains(k), v) for k, v in aliases.items() if len(k) >= 4]
    return F.coalesce(direct, *inside, text)


def render(template: Column, fields: Column, fallback_only: bool = False) -> Column:
    """Placeholders {{name}}, in either case, and chains {{a|b|"text"}} of which the first filled part counts. fields: map<string, string>
    with lower-case keys. A chain without a filled part leaves nothing; a single name that fields lacks stays as it stands."""
    place = r"\{\{([^}]*)\}\}" if not fallback_only else r"\{\{([^}]*\|[^}]*)\}\}"
    value = lambda part: F.when(
        F.trim(part).rlike("""^(".*"|'.*'|".*'|'.*")$"""), F.substring(F.trim(part), F.lit(2), F.length(F.trim(part)) - 2)
    ).otherwise(F.nullif(F.try_element_at(fields, F.lower(F.trim(part))), F.lit("")))
    chain = lambda inner: F.coalesce(F.get(F.filter(F.transform(F.split(inner, r"\|", -1), value), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))
    single = lambda inner: F.when(F.map_contains_key(fields, F.lower(inner)), F.coalesce(F.try_element_at(fields, F.lower(inner)), F.lit(""))).otherwise(F.concat(F.lit("{{"), inner, F.lit("}}")))
    filled = F.transform(F.regexp_extract_all(template, F.lit(place), F.lit(1)), lambda inner: F.when(inner.contains("|"), chain(inner)).otherwise(single(inner)))
    pieces = F.zip_with(F.split(template, place, -1), filled, lambda text, x: F.concat(text, F.coalesce(x, F.lit(""))))
    return F.coalesce(F.array_join(pieces, ""), F.lit(""))


def suspicion(c: dict[str, Column], source: Column, has_evidence: Column, generated: str = "aiMiner") -> Column:
    """How much speaks for a made-up contact, 0 to 100; from 50 on it is rejected. c: email, contact_name, company_name, phone, website,
    country, city, address, job_title."""
    points = lambda condition, p: F.when(condition, p).otherwise(0)
    count = sum((F.when(blank_to_null(x).isNotNull(), 1).otherwise(0) for x in c.values()), F.lit(0))
    host = F.regexp_replace(F.lower(F.try_parse_url(c["website"], F.lit("HOST"))), r"www\.", "")
    number = digits(c["phone"])
    place = F.lit(False)
    for city, lands in CITIES.items():
        place = place | ((F.lower(c["city"]) == city) & ~F.lower(c["country"]).rlike(f"^({lands})"))
    total = (
        points((source == generated) & ~has_evidence, 30) + points((source == generated) & (count >= 8), 20) + points(c["contact_name"].rlike(MADE_UP), 40)
        + points(~domain(c["email"]).contains(F.split_part(host, F.lit("."), F.lit(1))), 15)
        + points(number.rlike(r"^(.)\1+$"), 50) + points(number.rlike("^(123456|654321)"), 50) + points(place & (F.trim(c["country"]) != ""), 25)
    )
    return F.least(total, F.lit(100))


def mineability(reachable: Column, is_pdf: Column, emails: Column, exhibitors: Column, tables: Column, links: Column, blocked: Column, login: Column, scripted: Column, kilobytes: Column) -> Column:
    """0 to 100: how much a page promises; 60 and more is high, 30 and more medium."""
    points = lambda condition, p: F.when(condition, p).otherwise(0)
    base = F.when(~reachable, 0).when(is_pdf, 50).otherwise(30)
    total = (
        base + F.when(emails > 10, 30).when(emails > 0, 15).otherwise(0) + points(exhibitors, 20) + points(tables > 0, 10) + points(links > 50, 10)
        - points(blocked, 50) - points(login, 30) - points(scripted, 20) - points((kilobytes < 5) & reachable & ~is_pdf, 15)
    )
    return F.least(F.lit(100), F.greatest(F.lit(0), total))


def deep_crawl(contacts: Column, enriched: Column, websites: Column, threshold: float = 0.2, large: int = 500) -> Column:
    """skip, limited or full. An unknown share of enriched contacts counts as all of them."""
    share = F.coalesce(F.nanvl(enriched.cast("double"), F.lit(1.0)), F.lit(1.0))
    return (
        F.when(contacts > large, F.when(share >= 0.5, "skip").otherwise("limited")).when(share < threshold, "full")
        .when((websites > 0) & (contacts < 10), "full").otherwise("skip")
    )


def foreign_only(source_url: Column, emails: Column, results: Column) -> Column:
    """One or two results whose every address lies on a domain other than the source's: the organizer's own, not an exhibitor's."""
    host = F.regexp_replace(F.lower(F.try_parse_url(source_url, F.lit("HOST"))), r"^www\.", "")
    other = lambda e: (F.size(F.split(e, "@", -1)) == 2) & ~host.contains(F.regexp_replace(domain(e), r"^www\.", "")) & ~F.regexp_replace(domain(e), r"^www\.", "").contains(host)
    return F.coalesce(results.between(1, 2) & (F.size(emails) > 0) & F.forall(emails, other), F.lit(False))


def page_hash(contacts: Column) -> Column:
    """Addresses and names of a page's first five contacts (array of structs with email, company_name, contact_name), in order of text."""
    key = lambda c: F.concat(F.lower(F.coalesce(c["email"], F.lit(""))), F.lit("|"), F.lower(F.coalesce(F.nullif(c["company_name"], F.lit("")), c["contact_name"], F.lit(""))))
    keys = F.array_sort(F.transform(F.slice(contacts, 1, 5), key))
    return F.when(F.coalesce(F.size(contacts), F.lit(0)) <= 0, "empty").otherwise(F.array_join(keys, "::"))

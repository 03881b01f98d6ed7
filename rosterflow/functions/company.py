"""Companies and sites of contacts, evidence for them, and the pages of a listing, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signature import bound

#: Words that name a page and no company, mailbox providers, and endings of domains, of which the first that fits goes.
PAGE_WORDS = (
    "home", "contact", "about", "services", "products", "team", "blog", "news", "events", "careers", "jobs", "faq", "help", "support", "login",
    "register", "privacy", "terms", "legal", "exhibitors", "exhibitor", "list", "directory", "catalog", "welcome", "loading", "untitled", "page",
    "site", "website",
)
PROVIDERS = (
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com", "aol.com", "mail.com", "protonmail.com", "yandex.com", "zoho.com",
    "live.com", "msn.com",
)
SITELESS_PROVIDERS = PROVIDERS[:8]
ENDINGS = (
    ".com", ".org", ".net", ".io", ".co", ".app", ".dev", ".biz", ".info", ".edu", ".gov", ".mil", ".com.tr", ".org.tr", ".net.tr", ".com.uk",
    ".co.uk", ".com.au", ".co.nz", ".com.br", ".de", ".fr", ".es", ".it",
)
#: Where a company stands in a context, in the order of trust; what follows its name in a page's title; what parts a title.
PLACES = (r"^([^|]+)\s*\|", r"^([^-]+)\s*-", r"(?iu)(?:at|@)\s+([A-ZÀ-ÿ][^,.\n]+)", r"(?iu)from\s+([A-ZÀ-ÿ][^,.\n]+)", r"^([^\n]+)\n")
TITLE_TAILS = ("exhibitor(s)?", "contact", "home", "about", "official", "welcome")
TITLE_PARTS = ("|", "-", "–", "—", ":", "•")
SOCIAL = ("linkedin.", "facebook.", "twitter.", "instagram.")
#: How far a kind of evidence is to be trusted, and what each must hold to be valid.
RELIABILITY = {"mailto_link": 95, "table_cell": 85, "schema_org": 90, "vcard": 90, "microdata": 85, "meta_tag": 80, "dom_element": 75, "text_match": 60, "none": 30}
NEEDS = {"table_cell": ("selector", "text"), "dom_element": ("selector",), "text_match": ("pattern", "text"), "schema_org": ("schema",)}
PAGERS = r"pagination|paging|page-numbers|pager"


def company_name(x: Column) -> Column:
    """A name of 2 to 200 characters that holds a letter and is not a page's, else null."""
    good = lambda c: F.when(F.length(c).between(2, 200) & c.rlike("[a-zA-ZÀ-ÿ]") & ~F.lower(c).isin(*PAGE_WORDS), c)
    return bound(F.trim(F.regexp_replace(x, r"\s+", " ")), good)


def _host(email: Column) -> Column:
    """The domain of an address with exactly one @, else null."""
    parts = F.split(F.lower(email), "@", -1)
    return F.when(F.size(parts) == 2, parts[1])


def company_of_title(title: Column) -> Column:
    t = F.trim(title)
    for tail in TITLE_TAILS:
        t = F.regexp_replace(t, rf"(?i)\s*[-|–—]\s*{tail}.*$", "")
    for part in TITLE_PARTS:
        t = F.regexp_replace(t, rf"(?s)^([^{part}]+)[{part}].*$", "$1") if part != "-" else F.regexp_replace(t, r"(?s)^([^\-]+)-.*$", "$1")
    return company_name(t)


def company_of_domain(email: Column) -> Column:
    """The words of a domain without its ending, each with a capital; none for a mailbox provider's."""
    return bound(_host(email), _company_of_host)


def _company_of_host(host: Column) -> Column:
    bare = F.coalesce(*[F.when(F.endswith(host, F.lit(e)), F.substring(host, F.lit(1), F.length(host) - len(e))) for e in ENDINGS], host)
    words = F.filter(F.split(F.regexp_replace(bare, r"^www\.", ""), "[-_.]", -1), lambda w: w != "")
    named = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(~host.isin(*PROVIDERS), company_name(named))


def resolve_company(email: Column, context: Column, title: Column) -> Column:
    """The context's company, else the page title's, else the domain's."""
    found = [company_name(F.regexp_extract(context, p, 1)) for p in PLACES]
    return F.coalesce(*found, company_of_title(title), company_of_domain(email))


def resolve_website(email: Column, context: Column) -> Column:
    """The context's first address that is no social network's, else the site of the domain unless it is a provider's."""
    links = F.regexp_extract_all(F.coalesce(context, F.lit("")), F.lit(r'(?i)(https?://[^\s<>"]+)'), F.lit(1))
    own = F.filter(links, lambda u: ~F.lower(u).rlike("|".join(s.replace(".", r"\.") for s in SOCIAL)))
    host = _host(email)
    return F.coalesce(F.get(own, F.lit(0)), F.when(~host.isin(*SITELESS_PROVIDERS), F.concat(F.lit("https://"), host)))


def weigh_evidence(confidence: Column, source: Column, kind: Column, parts: dict[str, Column], generated: str = "aiMiner") -> Column:
    """struct(confidence, adjustment). parts: href, selector, text, pattern, schema; those left out count as missing.

    A generated contact without valid evidence is held to 40; valid evidence of 80 and more adds half of what it has over 70, 20 at most;
    evidence of 90 and more lifts to 85. Unknown kinds, and a mail link without its link, count as none.
    """
    filled = lambda p: F.coalesce(parts[p] != "", F.lit(False)) if p in parts else F.lit(False)
    known = kind.isin(*RELIABILITY) & ~((kind == "mailto_link") & ~F.coalesce(F.startswith(parts.get("href", F.lit(None).cast("string")), F.lit("mailto:")), F.lit(False)))
    known = F.coalesce(known, F.lit(False))
    lacking = F.lit(False)
    for k, needs in NEEDS.items():
        held = F.lit(False)
        for p in needs:
            held = held | filled(p)
        lacking = lacking | ((kind == k) & ~held)
    valid = known & ~lacking
    trust = F.when(known, F.coalesce(*[F.when(kind == k, v) for k, v in RELIABILITY.items()])).otherwise(RELIABILITY["none"])
    capped = (source == generated) & ~valid & (confidence > 40)
    raised = F.least(F.lit(100.0), confidence + F.least(F.lit(20.0), (trust - 70) / 2))
    adjusted = F.when(valid & (trust >= 80), raised).when(capped, 40.0).otherwise(confidence.cast("double"))
    name = F.when(trust >= 90, "high_reliability_evidence").when(valid & (trust >= 80), "boosted_good_evidence").when(capped, "capped_no_evidence").otherwise("none")
    final = F.when(trust >= 90, F.greatest(adjusted, F.lit(85.0))).otherwise(adjusted)
    return F.struct(F.floor(final + 0.5).cast("int").alias("confidence"), name.alias("adjustment"))


def page_url(base: Column, page: Column) -> Column:
    """The address of a page of a listing: its number in the path, in the query, or added to the query."""
    number = page.cast("string")
    in_path = F.regexp_replace(base, F.lit(r"(?i)^(.*?)/page/\d+"), F.concat(F.lit("$1/page/"), number))
    in_query = F.regexp_replace(base, F.lit(r"(?i)^(.*?[?&])page=\d+"), F.concat(F.lit("$1page="), number))
    added = F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("page="), number)
    return F.when(base.rlike(r"(?i)/page/\d+"), in_path).when(base.rlike(r"(?i)[?&]page=\d+"), in_query).otherwise(added)


def total_pages(html: Column) -> Column:
    """How many pages a listing says that it has, 1 to 199: numbers and links within its pager, else links of the page, or "page x of y".
    A pager ends at the first closing tag of its own name."""
    text = F.coalesce(html, F.lit(""))
    numbers = lambda x, pattern: F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda n: n.try_cast("int"))
    most = lambda *arrays: F.coalesce(F.array_max(F.filter(F.concat(*arrays), lambda n: n.between(1, 199))), F.lit(1))
    region = rf"""(?is)<(\w+)\b[^>]*(?:class\s*=\s*["'][^"']*(?:{PAGERS})|aria-label\s*=\s*["'][^"']*pagination)[^>]*>(.*?)</\1\s*>"""
    pagers = F.array_join(F.regexp_extract_all(text, F.lit(region), F.lit(2)), "\n")
    link = r"""(?i)href\s*=\s*["'][^"']*(?:[?&]page=|/page/)(\d{1,9})"""
    within = most(numbers(pagers, r"(?i)<(?:a|span|li)\b[^>]*>\s*(\d{1,9})"), numbers(pagers, link))
    anywhere = most(numbers(text, link))
    stated = most(numbers(F.regexp_replace(text, "<[^>]*>", ""), r"(?i)page\s+\d+\s+of\s+(\d{1,9})"))
    return F.greatest(F.when(within > 1, within).otherwise(anywhere), stated)

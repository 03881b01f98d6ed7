"""Cleaners, scores and decisions over contact fields, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Site names whose addresses are no company's own, and file endings.
SOCIAL_HOSTS = ("facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com", "wa.me", "t.me")
FILE_ENDINGS = ("pdf", "doc", "docx", "xls", "xlsx", "csv")
COMPANY_WORDS = ("ltd", "inc", "corp", "llc", "gmbh", "ag", r"co\.", "company", "limited", "group")
ZERO_WIDTH = "[\\u200B-\\u200D\\uFEFF]"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def full_name(first: Column, last: Column, other: Column | None = None) -> Column:
    """First and last name, or the other name where both are missing."""
    name = F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit(""))
    return F.coalesce(name, other) if other is not None else name


def company_of(company: Column) -> Column:
    """A company cell as lists show it: before a bar only the first part, nothing where an @ gives it away as an address."""
    return F.when(company.contains("|"), F.nullif(F.trim(F.split_part(company, F.lit("|"), F.lit(1))), F.lit(""))).when(company.contains("@"), None).otherwise(company)


def mergeable_company(company: Column) -> Column:
    """For keyed merges: blank, or holding @ or |, counts as none."""
    return F.when(company.contains("@") | company.contains("|"), None).otherwise(blank_to_null(company))


def title_case(x: Column) -> Column:
    """Lower case, then the first letter or digit after anything but [A-Za-z0-9_] in upper case."""
    low = F.lower(x)
    pieces = F.regexp_extract_all(low, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[a-z0-9_]"), F.concat(F.upper(F.substring(p, F.lit(1), F.lit(1))), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)), "")


def _one_case(x: Column, both: bool = True) -> Column:
    return ((x == F.upper(x)) | (x == F.lower(x))) if both else (x == F.upper(x))


def clean_name(x: Column) -> Column:
    c = F.regexp_replace(F.trim(x), r"(?i)^(name|contact|person|isim|ad)[\s:]+", "")
    c = F.regexp_replace(c, r"(?i)(email|phone|tel|company|firma)[\s:]+.*", "")
    c = F.trim(F.regexp_replace(c, ZERO_WIDTH, ""))
    c = F.when(F.length(c).between(2, 100) & c.rlike(r"^[A-Za-zÀ-ɏ\s.\-']+$"), c)
    return F.when(_one_case(c), title_case(c)).otherwise(c)


def clean_company(x: Column) -> Column:
    c = F.regexp_replace(F.trim(x), r"(?iu)^(company|organization|firma|şirket)[\s:]+", "")
    c = F.regexp_replace(c, r"(?i)(name|email|phone|tel|country)[\s:]+.*", "")
    c = F.trim(F.regexp_replace(c, ZERO_WIDTH, ""))
    c = F.when(F.length(c).between(2, 200), c)
    return F.when(_one_case(c, both=False), title_case(c)).otherwise(c)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def clean_phone(x: Column, least: int = 7, most: int = 16) -> Column:
    """A phone number's first line without a label: least to most digits and no year, else null."""
    c = F.trim(F.regexp_replace(x, "(?i)^(tel:|phone:|mobile:|cell:|fax:|call:)", ""))
    c = F.trim(F.split(c, r"[\n\r]").getItem(0))
    d = digits(c)
    return F.when(F.length(d).between(least, most) & ~d.rlike(r"^(19|20)\d{2}$"), c)


def normalize_phone(x: Column) -> Column:
    d = digits(x)
    return F.when(x.isNull(), "").when(F.startswith(F.trim(x), F.lit("+")), F.concat(F.lit("+"), d)).otherwise(d)


def extract_phones(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:\+?\d{1,4}[\s\-.]?)?\(?\d{1,5}\)?[\s\-.]?\d{2,5}[\s\-.]?\d{2,5}(?:[\s\-.]?\d{1,5})?)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda p: clean_phone(p)), lambda p: p.isNotNull()))


def clean_website(x: Column, blocked: tuple[str, ...] = SOCIAL_HOSTS) -> Column:
    c = F.trim(F.regexp_replace(F.trim(x), r"(?i)^(website|web|url|site)[\s:]+", ""))
    bad = F.lower(c).rlike(r"\.(" + "|".join(FILE_ENDINGS) + ")$") | (c.contains("%20") & F.lower(c).rlike(r"\.(pdf|doc)"))
    for b in blocked:
        bad = bad | F.lower(c).contains(b)
    c = F.when(~bad, c)
    c = F.when(~F.startswith(c, F.lit("http")) & c.contains("."), F.concat(F.when(F.startswith(c, F.lit("www.")), "https://").otherwise("https://www."), c)).otherwise(c)
    return F.when(F.try_parse_url(c, F.lit("HOST")).isNotNull(), c)


def clean_text(x: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.trim(F.regexp_replace(x, ZERO_WIDTH, "")), r"\s+", " "))


def quality_score(c: dict[str, Column]) -> Column:
    """0 to 100: what the filled fields are worth together."""
    worth = {"email": 30, "contact_name": 20, "company_name": 15, "phone": 15, "website": 5, "country": 5, "job_title": 5, "city": 3, "address": 2}
    total = F.lit(0)
    for name, points in worth.items():
        if name in c:
            total = total + F.when(blank_to_null(c[name]).isNotNull(), points).otherwise(0)
    return F.least(total, F.lit(100))


def quality_decision(score: Column) -> Column:
    return F.when(score >= 80, "EXCELLENT").when(score >= 60, "GOOD").when(score >= 40, "FAIR").when(score >= 25, "POOR").otherwise("RETRY")


def field_score(field: str, x: Column) -> Column:
    """How good a value of a field is; merges take the highest."""
    s = F.trim(x)
    n, low = F.length(s), F.lower(s)
    points = lambda condition, p: F.when(condition, p).otherwise(0)
    dump = lambda words: points(low.rlike(words), -30)
    d = F.length(digits(s))
    rules = {
        "name": lambda: points(n.between(5, 50), 20) + points(s.contains(" "), 15) + dump("email|phone|company|firma") + points(s.rlike("[@:;,]"), -20),
        "company": lambda: points(n.between(3, 100), 20) + points(low.rlike(r"\b(" + "|".join(COMPANY_WORDS) + r")\b"), 15) + dump("email|phone|name|isim") + points(s.contains("@"), -25),
        "phone": lambda: points(d.between(10, 15), 20) + points(F.startswith(s, F.lit("+")), 10) + points(n - d > 6, -10),
        "website": lambda: F.when(F.startswith(s, F.lit("https://")), 15).when(F.startswith(s, F.lit("http://")), 10).otherwise(0) + points(low.rlike(r"\.(pdf|doc|xls)"), -30) + points(s.contains("%20"), -20) + points(s.contains("www."), 5),
        "country": lambda: points(~s.contains(":") & (n <= 30), 15) + dump("email|phone|company"),
        "city": lambda: points(~s.contains(":") & (n <= 30), 15),
        "title": lambda: points(n.between(3, 100), 15) + dump("email|phone|company"),
    }
    return F.when(F.coalesce(s, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(0), F.lit(10) + (rules[field]() if field in rules else F.lit(0))))


def bounce_kind(reason: Column) -> Column:
    """hard, soft or unknown, by what the reason mentions."""
    low = F.lower(reason)
    return F.when(low.rlike("550|invalid|not exist|hard"), "hard").when(low.rlike("temp|full|soft|defer"), "soft").otherwise("unknown")


def js_round(x: Column) -> Column:
    """Half up, towards positive infinity."""
    return F.floor(x + 0.5)


def quote_number(status: Column, office: Column, sequence: Column) -> Column:
    return F.concat(F.when(status == "signed", "A").otherwise("Q"), F.coalesce(blank_to_null(office), F.lit("??")), F.lit("-"), sequence.cast("string"))


def quote_expired(valid_until: Column, status: Column, as_of: Column) -> Column:
    return F.coalesce((status == "sent") & (valid_until < as_of), F.lit(False))


def context_around(text: Column, part: Column, width: int = 50) -> Column:
    """The part's first occurrence with up to width characters on each side."""
    at = F.locate(part, text) if isinstance(part, str) else F.expr("0") + F.call_function("locate", part, text)
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.length(part) + width))


def content_signature(html: Column) -> Column:
    """md5 of a page's text without markup and repeated white space."""
    return F.md5(F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]*>", " "), r"\s+", " ")))


def cell_type(x: Column) -> Column:
    """What a sheet's cell holds: email, url, phone, number, name, company or text."""
    s = F.trim(x)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "empty").when(s.rlike(r"^[^\s@]+@[^\s@]+\.[A-Za-z]{2,}$"), "email").when(F.lower(s).rlike(r"^(https?://|www\.)"), "url")
        .when(F.length(digits(s)).between(7, 16) & s.rlike(r"^[+\d\s().\-]+$"), "phone").when(s.rlike(r"^-?\d+([.,]\d+)?$"), "number")
        .when(F.lower(s).rlike(r"\b(" + "|".join(COMPANY_WORDS) + r")\b"), "company").when(s.rlike(r"^\p{Lu}\p{L}+(\s\p{Lu}\p{L}+){1,3}$"), "name").otherwise("text")
    )


def text_to_html(text: Column) -> Column:
    """Plain text as paragraphs with line breaks; what holds tags already stays as it is, as do blank texts. Placeholders are no tags."""
    tags = F.regexp_replace(text, r"\{\{[^}]+\}\}", "").rlike(r"(?is)<[a-z].*?>")
    parts = F.transform(F.split(text, r"\n\s*\n", -1), lambda p: F.concat(F.lit("<p>"), F.replace(F.trim(F.regexp_replace(p, r"^\s+|\s+$", "")), F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    page = F.concat(F.lit('<div style="font-family:Arial,Helvetica,sans-serif;font-size:14px;line-height:1.6;color:#333">'), F.array_join(parts, ""), F.lit("</div>"))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", text).when(tags, text).otherwise(page)


#: What a field is worth in the weighted score, and words of pages that keep visitors out.
FIELD_WEIGHTS = {"email": 30, "name": 20, "company": 15, "phone": 15, "country": 5, "website": 5, "city": 3, "title": 3, "address": 2}
BLOCK_WORDS = (
    "cloudflare", "cf-error", "access denied", "forbidden", "security check", "captcha", "verify you are human", "please wait", "checking your browser",
    "ddos protection", "rate limit", "too many requests", "blocked", "403 error", "401 error", "unauthorized",
)
PAGE_MARKS = ("<html", "<body", "</html>", "</body>")


def weighted_score(c: dict[str, Column]) -> Column:
    """0 to 100: the weights of filled fields with extra points for a full name, a firm's legal form, an international number and a secure
    site, as a share of all weights. Fields that c lacks count as blank."""
    extra = {
        "name": lambda s: F.when(s.contains(" ") & (F.length(s) >= 5), 5), "company": lambda s: F.when(s.rlike(r"(?i)\b(ltd|inc|corp|llc|gmbh|ag)\b"), 3),
        "phone": lambda s: F.when(F.startswith(s, F.lit("+")), 3), "website": lambda s: F.when(F.startswith(s, F.lit("https://")), 2),
    }
    total = F.lit(0)
    for field, weight in FIELD_WEIGHTS.items():
        if field in c:
            s = F.trim(c[field].cast("string"))
            points = F.lit(weight) + (F.coalesce(extra[field](s), F.lit(0)) if field in extra else 0)
            total = total + F.when(F.coalesce(s, F.lit("")) != "", points).otherwise(0)
    return F.least(F.lit(100.0), total / sum(FIELD_WEIGHTS.values()) * 100)


def blocked_page(html: Column, short: int = 500, small: int = 10_000, least_text: int = 100) -> Column:
    """Why a page holds nothing, or null: too short; a blocking word anywhere in a small page, in the title or first heading of another;
    no page structure; hardly any text. A null page is too short."""
    low = F.lower(html)
    head = F.concat(F.regexp_extract(low, r"<title[^>]*>([^\r\n]*?)</title>", 1), F.lit(" "), F.regexp_extract(low, r"<h1[^>]*>([^\r\n]*?)</h1>", 1))
    is_small = F.length(html) < small
    word = lambda x: F.get(F.filter(F.array(*map(F.lit, BLOCK_WORDS)), lambda w: F.contains(x, w)), F.lit(0))
    in_page, in_head = F.when(is_small, word(low)), F.when(~is_small, word(head))
    structure = low.rlike("|".join(PAGE_MARKS))
    return (
        F.when(F.coalesce(F.length(html), F.lit(0)) < short, "Content too short").when(in_page.isNotNull(), F.concat(F.lit("Contains block indicator: "), in_page))
        .when(in_head.isNotNull(), F.concat(F.lit("Title/H1 contains block indicator: "), in_head)).when(~structure, "Missing HTML structure")
        .when(F.length(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"^\s+|\s+$", "")) < least_text, "Very low text content")
    )

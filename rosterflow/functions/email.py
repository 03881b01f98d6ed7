"""E-mail functions as Columns: extraction, cleaning, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pattern, role prefixes, system prefixes and domains.
PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
GENERIC_PREFIXES = (
    "info", "contact", "admin", "support", "hello", "help", "sales", "webmaster", "noreply", "no-reply", "mail", "email", "enquiry", "enquiries",
    "office", "general", "team", "hr", "marketing", "billing", "accounts", "jobs", "careers", "press", "media", "news", "legal", "compliance",
    "reception", "secretary", "postmaster",
)
JUNK_PREFIXES = (
    "mailer-daemon", "postmaster", "no-reply", "noreply", "donotreply", "bounce", "unsubscribe", "abuse", "root", "webmaster", "daemon", "devnull", "null",
)
JUNK_DOMAINS = (
    "example.com", "example.org", "example.net", "test.com", "test.org", "sentry.io", "sentry-next.wixpress.com", "wix.com", "wordpress.com",
    "squarespace.com", "weebly.com", "shopify.com", "webflow.io", "googleapis.com", "googleusercontent.com", "gstatic.com", "google.com", "w3.org",
    "schema.org", "gravatar.com", "facebook.com", "twitter.com", "instagram.com", "youtube.com", "linkedin.com", "tiktok.com", "pinterest.com",
    "reedexpo.com", "rxglobal.com", "mcexpocomfort.it", "cloudflare.com", "cloudflareinsights.com", "hotjar.com", "segment.io", "mixpanel.com",
)
TYPE_GENERIC = ("info", "contact", "sales", "support", "hello", "enquiry", "enquiries", "office", "admin", "mail", "general")
TYPE_ROLE = ("ceo", "cfo", "cto", "hr", "marketing", "pr", "legal", "accounting")

#: Hosts of trackers and tools, senders of no person, addresses made up, and providers of throw-away mailboxes.
GARBAGE_HOSTS = (
    "wix.com", "sentry.io", "hotjar.com", "googletagmanager.com", "google-analytics.com", "facebook.com", "twitter.com", "linkedin.com",
    "cloudflare.com", "amazonaws.com", "azure.com", "github.com", "gitlab.com", "example.com", "test.com",
)
GARBAGE_PARTS = ("noreply@", "no-reply@", "donotreply@", "mailer-daemon@", "postmaster@", "localhost", "@example.", "@test.")
THROW_AWAY = (
    "mailinator.com", "guerrillamail.com", "tempmail.com", "throwaway.email", "fakeinbox.com", "10minutemail.com", "temp-mail.org",
    "sharklasers.com", "yopmail.com",
)


def is_garbage(email: Column, numbered: bool = False) -> Column:
    """To be rejected at once: null, a listed host or sender, six digits in a row or one or two letters and digits before the @, a local
    part of one character, or no address at all. numbered: six digits count only where nothing else stands before the @, so that a
    mailbox with a long number, as desk100000, passes."""
    low = F.trim(F.lower(email))
    ends = "(" + "|".join(h.replace(".", r"\.") for h in GARBAGE_HOSTS) + ")$"
    parts = "|".join(x.replace(".", r"\.") for x in GARBAGE_PARTS)
    bad = low.rlike(ends) | low.rlike(parts) | low.rlike("^[0-9]{6,}@" if numbered else "[0-9]{6,}@") | low.rlike("^[a-z]{1,2}[0-9]+@")
    return F.coalesce(bad | domain(low).isin(*THROW_AWAY) | (F.length(local_part(low)) == 1) | ~low.contains("@") | ~low.contains("."), F.lit(True))


def extract_emails(text: Column) -> Column:
    """All addresses of a text, lower-cased, each once, in order of appearance; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PATTERN})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(F.lower(x))))


def local_part(email: Column) -> Column:
    return F.split_part(F.lower(email), F.lit("@"), F.lit(1))


def domain(email: Column) -> Column:
    return F.split_part(F.lower(email), F.lit("@"), F.lit(2))


def is_generic(email: Column) -> Column:
    return F.coalesce(local_part(email).isin(*GENERIC_PREFIXES), F.lit(False))


def is_junk(email: Column) -> Column:
    """System prefix, or a listed domain or a subdomain of one; null and empty are junk."""
    listed = r"[@.](" + "|".join(d.replace(".", r"\.") for d in JUNK_DOMAINS) + ")$"
    return F.coalesce((email == "") | local_part(email).isin(*JUNK_PREFIXES) | F.lower(email).rlike(listed), F.lit(True))


def email_type(email: Column) -> Column:
    """generic, role, personal or unknown: the first that applies."""
    low = F.lower(email)
    starts = lambda names: low.rlike("^(" + "|".join(names) + ")@")
    return (
        F.when(email.isNull() | (email == ""), "unknown").when(starts(TYPE_GENERIC), "generic").when(starts(TYPE_ROLE), "role")
        .when(local_part(email).rlike("^[a-z]+[._]?[a-z]+$"), "personal").otherwise("unknown")
    )


def is_valid(email: Column) -> Column:
    """Strict format: 5 to 254 characters, one @, a local part of 1 to 64, a dotted domain whose last label has two letters or more."""
    parts = F.size(F.split(email, "@"))
    return F.coalesce(F.length(email).between(5, 254) & (parts == 2) & F.length(local_part(email)).between(1, 64) & email.rlike(f"^{PATTERN}$"), F.lit(False))


def clean_email(email: Column, compatible: bool = False) -> Column:
    """The address without labels stuck to its end, or null.

    The compatible form cuts at the first phone, tel or fax anywhere, and so loses addresses at domains like hotel.com; the default
    cuts such labels only behind a known end of a domain.
    """
    low = F.trim(F.lower(email))
    head = F.regexp_extract(low, rf"^({PATTERN})", 1)
    low = F.when(head != "", head).otherwise(low)
    if compatible:
        cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "phone.*$", ""), "tel.*$", ""), "fax.*$", "")
    else:
        cut = F.regexp_replace(low, r"(\.(?:com|net|org|edu|gov|info|biz|co|io|de|fr|uk|it|es|tr|ng))(?:phone|tel|fax)[a-z]*$", "$1")
    cut = F.trim(F.regexp_replace(cut, r"[,;:\s]+$", ""))
    return F.when(cut.rlike(f"^{PATTERN}$"), cut)


def decode_obfuscated(hexed: Column) -> Column:
    """Addresses stored as hex whose first byte is the XOR key of the rest; null if the text is not of that form."""
    h = F.lower(hexed)
    value = lambda at: F.conv(F.substring(h, at, F.lit(2)), 16, 10).cast("int")
    letters = F.transform(F.sequence(F.lit(3), F.length(h) - 1, F.lit(2)), lambda i: F.char(value(i).bitwiseXOR(value(F.lit(1)))))
    text = F.array_join(letters, "")
    return F.when(h.rlike("^([0-9a-f]{2}){2,}$"), text)

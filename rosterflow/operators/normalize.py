"""A miner's raw texts to candidates: for each address its name, company, site, position, country and phone, from the words around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import company as co
from ..functions import contact as ct
from ..functions import email as em
from ..functions import mining as mn
from ..functions.signature import bound
from .countries import country_of

#: Addresses of no person, and what is no address.
NO_PERSON = r"^(noreply|no-reply|mailer-daemon|postmaster|hostmaster|abuse|spam|webmaster)@|example\.(com|org|net)$|test@|@localhost$|@127\.0\.0\.1$"
NO_ADDRESS = r"\.(jpg|jpeg|png|gif|svg|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar)$|@[^.]+$|\.{2,}|^[.\-]|[.\-]$"


def addresses_of(text: Column) -> Column:
    """A text's addresses in lower case, each once, without senders of no person, file names and the like."""
    parts = lambda e: F.split(e, "@", -1)
    good = lambda e: F.length(e).between(5, 254) & (F.size(parts(e)) == 2) & (F.length(parts(e)[0]) <= 64) & ~e.rlike(NO_ADDRESS) & ~e.rlike(NO_PERSON)
    return F.filter(em.extract_emails(text), good)


def around(text: Column, part: Column, width: int = 50) -> Column:
    """The first occurrence of a part in lower case with up to width characters on either side, trimmed."""
    at = F.call_function("locate", part, F.lower(text))
    start = F.greatest(at - width, F.lit(1))
    return F.regexp_replace(F.substring(text, start, at - start + F.length(part) + width), r"^\s+|\s+$", "")


def candidates_of(results: DataFrame, countries: dict[str, str], id_col: str = "id", text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """id, email, first_name, last_name, company_name, website, position, country_code, phone, snippet: a row for each address of a text.

    Only the words around an address leave its text's row, so that a text with many addresses is not copied; what several fields ask of
    them is worked out once. A name and a company come from these words, else from the address, the company before that from the title.
    Null texts give nothing; confidence is not for this step to say.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.transform(addresses_of(text), lambda e: F.struct(e.alias("email"), around(text, e).alias("context")))
    title = F.lit(None).cast("string") if title_col is None else F.col(title_col)
    each = results.select(F.col(id_col).alias("id"), title.alias("title"), F.explode(found).alias("c")).select("id", "title", "c.*")
    email, context = F.col("email"), F.col("context")
    name = bound(mn.person_name(email, context), lambda n: n)
    rows = each.withColumn("n", name)
    return rows.select(
        "id", "email", "n.first_name", "n.last_name", co.resolve_company(email, context, F.col("title")).alias("company_name"), co.resolve_website(email, context).alias("website"),
        mn.position_of(context).alias("position"), country_of(context, countries).alias("country_code"), F.get(ct.extract_phones(context), F.lit(0)).alias("phone"), F.substring("context", 1, 200).alias("snippet"),
    )

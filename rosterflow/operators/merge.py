"""Keyed merges: old snapshot and incoming rows give a new snapshot. Nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contact import field_score, mergeable_company

FIELDS = ("name", "company", "phone", "website", "country", "city", "address", "title")


def filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def last_filled(column: str, ord_col: str) -> Column:
    """Of several incoming rows for a key the last filled value counts, as if they came one after another."""
    value = filled(F.col(column))
    return F.max_by(value, F.when(value.isNotNull(), F.col(ord_col)))


def first_filled(column: str, ord_col: str) -> Column:
    value = F.col(column)
    return F.min_by(value, F.when(value.isNotNull(), F.col(ord_col)))


def upsert_persons(old: DataFrame, new: DataFrame, ord_col: str = "ord", fill_only: bool = False) -> DataFrame:
    """Key: organizer_id, lower(email). Names: the incoming one if filled, else the existing one (fill_only: the other way round). The
    owner stays if set. Rows without an e-mail do not merge and are dropped."""
    keyed = new.filter(filled(F.col("email")).isNotNull()).withColumn("email_key", F.lower(F.trim("email")))
    names = ("first_name", "last_name")
    fold = first_filled if fill_only else last_filled
    incoming = keyed.groupBy("organizer_id", "email_key").agg(*[fold(c, ord_col).alias(f"n_{c}") for c in names], first_filled("owner_id", ord_col).alias("n_owner_id"))
    current = old.withColumn("email_key", F.lower(F.trim("email"))).select("organizer_id", "email_key", *[F.col(c).alias(f"o_{c}") for c in (*names, "owner_id")])
    both = current.join(incoming, ["organizer_id", "email_key"], "full")
    pick = (lambda c: F.coalesce(filled(F.col(f"o_{c}")), f"n_{c}")) if fill_only else (lambda c: F.coalesce(f"n_{c}", f"o_{c}"))
    return both.select("organizer_id", F.col("email_key").alias("email"), *[pick(c).alias(c) for c in names], F.coalesce("o_owner_id", "n_owner_id").alias("owner_id"))


def upsert_affiliations(old: DataFrame, new: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Key: organizer_id, person_id, lower(company). Filled incoming values win, confidence is the largest. Rows whose company is
    missing or is no company do not merge: they are added as they are."""
    kept = ("position", "city", "country_code")
    new = new.withColumn("company_name", mergeable_company(F.col("company_name")))
    merge_key = ["organizer_id", "person_id", "company_key"]
    incoming = new.filter("company_name is not null").withColumn("company_key", F.lower("company_name"))
    incoming = incoming.groupBy(*merge_key).agg(F.max_by("company_name", ord_col).alias("n_company_name"), *[last_filled(c, ord_col).alias(f"n_{c}") for c in kept], F.max("confidence").alias("n_confidence"))
    current = old.filter("company_name is not null").withColumn("company_key", F.lower("company_name")).select(*merge_key, *[F.col(c).alias(f"o_{c}") for c in ("company_name", *kept, "confidence")])
    both = current.join(incoming, merge_key, "full").select(
        "organizer_id", "person_id", F.coalesce("o_company_name", "n_company_name").alias("company_name"),
        *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in kept], F.greatest("o_confidence", "n_confidence").alias("confidence"),
    )
    loose = old.filter("company_name is null").unionByName(new.filter("company_name is null"), allowMissingColumns=True)
    return both.unionByName(loose.select("organizer_id", "person_id", "company_name", *kept, "confidence"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], need: str | None = None) -> DataFrame:
    """Rows of new that old does not have by key, the first of equal ones. Where the needed column is null a row is never a duplicate."""
    fresh = new.filter(F.col(need).isNotNull()) if need else new
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_first")).select("_first.*")
    condition = [first[k].eqNullSafe(old[k]) for k in keys]
    out = first.join(old.select(*keys), condition, "left_anti")
    return out.unionByName(new.filter(F.col(need).isNull())) if need else out


def merge_by_field(contacts: DataFrame, ord_col: str = "ord", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Contacts by lower-cased e-mail; each field takes its best-scored value, the first of equals. Rows without e-mail go."""
    keyed = contacts.filter(filled(F.col("email")).isNotNull()).withColumn("email", F.lower(F.trim("email")))
    best = lambda f: F.max_by(F.col(f), F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct(field_score(f, F.col(f)), -F.col(ord_col))))
    return keyed.groupBy("email").agg(*[best(f).alias(f) for f in fields if f in contacts.columns], F.count("*").alias("merged"))


def merge_contacts(contacts: DataFrame, key: str, ord_col: str = "ord", settled: int | None = None) -> DataFrame:
    """Pairwise merges in order: the first of two stays the base unless the other alone has an e-mail or is more confident; texts take
    the longer value, the base's of equal ones; confidence is the larger; other addresses join up, the base's first. With ``settled``, what
    has been merged has that confidence from then on.

    The order decides, but no key's rows are gathered: a row becomes the base if it is the first with an e-mail, or more confident than all
    before it (and not without an e-mail where one before has it). Such rows are found from the least ord of each confidence, of which a key
    has few. A text is then the longest, of equals the last base's, else the first. Rows with a null key are left out; ord_col must tell a
    key's rows apart.
    """
    texts = [c for c in ("contact_name", "job_title", "company_name", "website", "country", "city", "address", "phone") if c in contacts.columns]
    c = contacts.filter(F.col(key).isNotNull()).withColumns({"_k": F.col(key), "_ord": F.col(ord_col), "_conf": F.coalesce("confidence", F.lit(0)), "_has": F.coalesce("email", F.lit("")) != ""})
    bases = _bases(c, settled)
    filled_text = lambda t: F.nullif(F.col(t), F.lit(""))
    value = lambda t: F.struct(F.length(t).alias("n"), F.col(t).alias("v"))
    whole = c.groupBy("_k").agg(
        F.max("confidence").alias("confidence"), F.count("*").cast("int").alias("merged"),
        *[F.min_by(value(t), F.when(filled_text(t).isNotNull(), F.struct(-F.length(t), "_ord"))).alias(f"f_{t}") for t in texts],
    )
    marked = c.join(bases, ["_k", "_ord"])
    leading = marked.groupBy("_k").agg(
        F.max_by(F.struct(F.nullif("email", F.lit("")).alias("email"), "source"), "_ord").alias("base"),
        *[F.max_by(value(t), F.when(filled_text(t).isNotNull(), F.struct(F.length(t), "_ord"))).alias(f"r_{t}") for t in texts],
    )
    others = c.select("_k", "_ord", F.posexplode("additional_emails").alias("_at", "_other")).join(bases.withColumn("_base", F.lit(True)), ["_k", "_ord"], "left")
    # later bases first, then other rows in order
    rank = F.struct(F.when(F.col("_base"), 0).otherwise(1), F.when(F.col("_base"), -F.col("_ord")).otherwise(F.col("_ord")), "_at")
    others = others.groupBy("_k", "_other").agg(F.min(rank).alias("_rank")).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_rank", "_other")))["_other"].alias("additional_emails"))
    out = whole.join(leading, "_k").join(others, "_k", "left")
    text = lambda t: F.when(F.col(f"r_{t}.n") == F.col(f"f_{t}.n"), F.col(f"r_{t}.v")).otherwise(F.col(f"f_{t}.v")).alias(t)
    confidence = F.col("confidence") if settled is None else F.when(F.col("merged") > 1, settled).otherwise(F.col("confidence"))
    named = {"email": F.col("base.email"), **{t: text(t) for t in texts}, "additional_emails": F.coalesce("additional_emails", F.array().cast("array<string>")), "source": F.col("base.source"), "confidence": confidence}
    return out.select(F.col("_k").alias(key), *[v.alias(f"merged_{n}" if n == key else n) for n, v in named.items()], "merged")


def _bases(c: DataFrame, settled: int | None) -> DataFrame:
    """_k, _ord of the rows that become the base when their turn comes."""
    mailed = c.filter("_has").groupBy("_k").agg(F.min("_ord").alias("_mail"))
    if settled is None:
        levels = c.groupBy("_k", "_conf").agg(F.min("_ord").alias("_ord"))
        higher = F.min("_ord").over(Window.partitionBy("_k").orderBy(F.desc("_conf")).rowsBetween(Window.unboundedPreceding, -1))
        best = levels.withColumn("_higher", higher).filter("_higher is null or _ord < _higher").select("_k", "_ord")
    else:  # the first two alone are held against each other, later ones against what is settled
        first = c.groupBy("_k").agg(F.min(F.struct("_ord", "_conf")).alias("_a"))
        second = c.join(first, "_k").filter(F.col("_ord") > F.col("_a._ord")).groupBy("_k").agg(F.min(F.struct("_ord", "_conf")).alias("_b"))
        later = c.filter(F.col("_conf") > settled).groupBy("_k", "_conf").agg(F.min("_ord").alias("_ord"))
        if not later.isEmpty():
            raise ValueError("no confidence may be above the settled one")
        best = first.select("_k", "_a._ord").unionByName(second.join(first, "_k").filter(F.col("_b._conf") > F.col("_a._conf")).select("_k", "_b._ord"))
    told = best.join(c.select("_k", "_ord", "_has"), ["_k", "_ord"]).join(mailed, "_k", "left").filter(F.col("_mail").isNull() | (F.col("_ord") <= F.col("_mail")) | F.col("_has"))
    return told.select("_k", "_ord").unionByName(mailed.select("_k", F.col("_mail").alias("_ord"))).distinct()


def merge_by_length(contacts: DataFrame, key: str, ord_col: str = "ord", phones: int = 3) -> DataFrame:
    """Longest texts, the first of equals; the first distinct phones; all sources."""
    longest = lambda c: F.max_by(F.col(c), F.struct(F.length(c), -F.col(ord_col)))
    texts = [c for c in ("contact_name", "company_name", "website") if c in contacts.columns]
    # the first distinct phones: each number's first place is found before numbers of a key meet
    numbers = contacts.filter("phone is not null").groupBy(key, "phone").agg(F.min(ord_col).alias("_at"))
    first = numbers.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy("_at"))).filter(F.col("_rank") <= phones)
    first = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_rank", "phone"))).getField("phone").alias("phones"))
    merged = contacts.groupBy(key).agg(*[longest(c).alias(c) for c in texts], F.sort_array(F.collect_set("source")).alias("sources"))
    return merged.join(first, key, "left").withColumn("phones", F.coalesce("phones", F.array().cast("array<string>")))


def merge_two_keys(contacts: DataFrame, ord_col: str = "ord", profile_confidence: int = 25, settled: bool = False) -> DataFrame:
    """Contacts with an e-mail merge by it; those without, but with a name and a source URL, by these, with a confidence of at most
    ``profile_confidence``. Others go. kind: email or profile; rank: e-mail rows come first. settled: a profile without a confidence has
    that one, and so has a merged one."""
    name = F.lower(F.trim(F.regexp_replace(F.coalesce("contact_name", F.lit("")), r"\s+", " ")))
    has = F.coalesce(F.col("email"), F.lit("")) != ""
    by_email = merge_contacts(contacts.filter(has).withColumn("key", F.lower("email")), "key", ord_col).withColumn("kind", F.lit("email"))
    profiles = contacts.filter(~has & (name != "") & (F.coalesce("source_url", F.lit("")) != "")).withColumn("key", F.concat(name, F.lit("|"), F.lower("source_url")))
    own = F.coalesce(F.nullif("confidence", F.lit(0)), F.lit(profile_confidence)) if settled else F.col("confidence")
    profiles = merge_contacts(profiles.withColumn("confidence", F.least(own, F.lit(profile_confidence))), "key", ord_col, profile_confidence if settled else None).withColumn("kind", F.lit("profile"))
    return by_email.unionByName(profiles).withColumn("rank", F.when(F.col("kind") == "email", 1).otherwise(2))


def import_batch(rows: DataFrame, is_valid, id_col: str = "id") -> DataFrame:
    """Each row with its first valid address and what becomes of it: imported (the first row of an address), duplicate, or no_email."""
    chosen = rows.withColumn("email", F.get(F.filter(F.transform("emails", lambda e: F.lower(F.trim(e))), is_valid), F.lit(0)))
    first = chosen.filter("email is not null").groupBy("email").agg(F.min(id_col).alias("_first"))
    return chosen.join(first, "email", "left").withColumn("outcome", F.when(F.col("email").isNull(), "no_email").when(F.col(id_col) == F.col("_first"), "imported").otherwise("duplicate")).drop("_first")

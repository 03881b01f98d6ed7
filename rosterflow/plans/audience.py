"""Audience resolution: a list's members, canonical or by e-mail, less those who must not be written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contact import full_name
from ..operators.relational import latest_per_key
from ..registry import query
from ..roles import Roles


def allowed_status(status: Column, mode: str, include_risky: bool = False) -> Column:
    if mode == "verified_only":
        return status.isin("valid", "catchall")
    return status != "invalid" if include_risky else ~status.isin("invalid", "risky")


def resolve(r: Roles, list_id: int, campaign_id: int, mode: str = "exclude_invalid", include_risky: bool = False) -> DataFrame:
    members = r.list_members.filter(F.col("list_id") == list_id)
    persons = r.persons.select(F.col("id").alias("person_id"), "email", "first_name", "last_name", "verification_status", F.lower("email").alias("email_key"))
    prospects = r.prospects.select(F.col("id").alias("prospect_id"), F.col("email").alias("p_email"), F.col("name").alias("p_name"), F.col("company").alias("p_company"), F.col("verification_status").alias("p_status"))
    canonical = members.filter("person_id is not null").select("prospect_id", "person_id").join(persons, "person_id").join(prospects, "prospect_id", "left")
    unnamed = members.filter("person_id is null").select("prospect_id").join(prospects, "prospect_id").withColumn("email_key", F.lower("p_email"))
    # one person for each address of the list: the least id, as keyed people are unique by it
    asked = persons.join(unnamed.select("email_key").distinct(), "email_key", "left_semi")
    by_email = asked.groupBy("email_key").agg(F.min_by(F.struct("person_id", "email", "first_name", "last_name", "verification_status"), "person_id").alias("p")).select("email_key", "p.*")
    fallback = unnamed.join(by_email, "email_key", "left")
    columns = ["prospect_id", "person_id", "email", "first_name", "last_name", "verification_status", "p_email", "p_name", "p_company", "p_status"]
    both = canonical.select(columns).unionByName(fallback.select(columns))
    theirs = r.affiliations.join(both.select("person_id").distinct(), "person_id", "left_semi")
    latest = latest_per_key(theirs, "person_id", "created_at", "id", ["company_name", "position"])
    both = both.join(latest, "person_id", "left").select(
        "prospect_id", "person_id", F.coalesce("email", "p_email").alias("email"), full_name(F.col("first_name"), F.col("last_name"), F.col("p_name")).alias("name"),
        F.coalesce("company_name", "p_company").alias("company"), "position", F.coalesce("verification_status", "p_status", F.lit("unknown")).alias("status"),
    )
    kept = both.filter((F.trim("email") != "") & allowed_status(F.col("status"), mode, include_risky)).withColumn("email_key", F.lower("email"))
    kept = kept.join(r.unsubscribes.select(F.lower("email").alias("email_key")), "email_key", "left_anti")
    kept = kept.join(r.recipients.filter(F.col("campaign_id") == campaign_id).select("prospect_id"), "prospect_id", "left_anti")
    one = kept.groupBy(F.coalesce("person_id", "prospect_id").alias("key")).agg(F.min_by(F.struct("prospect_id", "person_id", "email", "name", "company", "position", "status"), "prospect_id").alias("x"))
    return one.select("x.*")


RESOLVE_SQL = """
with by_email as (select lower(email) as email_key, min(id) as person_id from persons group by 1),
latest as (select * from (select *, row_number() over (partition by person_id order by created_at desc, id desc) as rn from affiliations) where rn = 1),
both_paths as (
  select m.prospect_id, pn.id as person_id, pn.email, pn.first_name, pn.last_name, pn.verification_status, p.email as p_email, p.name as p_name, p.company as p_company, p.verification_status as p_status
  from list_members m join persons pn on pn.id = m.person_id left join prospects p on p.id = m.prospect_id where m.list_id = 1
  union all
  select m.prospect_id, pn.id, pn.email, pn.first_name, pn.last_name, pn.verification_status, p.email, p.name, p.company, p.verification_status
  from list_members m join prospects p on p.id = m.prospect_id left join by_email b on b.email_key = lower(p.email) left join persons pn on pn.id = b.person_id where m.list_id = 1 and m.person_id is null),
resolved as (
  select b.prospect_id, b.person_id, coalesce(b.email, b.p_email) as email, coalesce(nullif(trim(concat_ws(' ', b.first_name, b.last_name)), ''), b.p_name) as name,
    coalesce(a.company_name, b.p_company) as company, a.position, coalesce(b.verification_status, b.p_status, 'unknown') as status
  from both_paths b left join latest a on a.person_id = b.person_id),
kept as (
  select *, row_number() over (partition by coalesce(person_id, prospect_id) order by prospect_id) as rn from resolved r
  where email is not null and trim(email) <> '' and status not in ('invalid', 'risky')
    and not exists (select 1 from unsubscribes u where lower(u.email) = lower(r.email))
    and not exists (select 1 from recipients c where c.campaign_id = 2 and c.prospect_id = r.prospect_id))
select prospect_id, person_id, email, name, company, position, status from kept where rn = 1"""


@query("audience_resolve", RESOLVE_SQL, "persons prospects list_members affiliations unsubscribes recipients")
def audience_resolve(r: Roles) -> DataFrame:
    return resolve(r, 1, 2)


@query(
    "audience_stats",
    """select m.list_id, count(*) as members, count(pn.id) as with_person,
      count(*) filter (where pn.id is not null and coalesce(pn.verification_status, p.verification_status, 'unknown') = 'invalid') as excluded_invalid,
      count(*) filter (where pn.id is not null and coalesce(pn.verification_status, p.verification_status, 'unknown') = 'risky') as excluded_risky,
      count(*) filter (where pn.id is not null and coalesce(pn.verification_status, p.verification_status, 'unknown') not in ('valid', 'catchall', 'invalid')) as excluded_unverified,
      count(*) filter (where pn.id is not null and exists (select 1 from unsubscribes u where lower(u.email) = lower(pn.email))) as excluded_unsubscribed
    from list_members m left join persons pn on pn.id = m.person_id left join prospects p on p.id = m.prospect_id group by m.list_id""",
    "persons prospects list_members unsubscribes",
)
def audience_stats(r: Roles) -> DataFrame:
    persons = r.persons.select(F.col("id").alias("person_id"), F.lower("email").alias("email_key"), F.col("verification_status").alias("v"), F.lit(True).alias("has"))
    gone = r.unsubscribes.select(F.lower("email").alias("email_key"), F.lit(True).alias("gone")).distinct()
    m = r.list_members.join(persons, "person_id", "left").join(r.prospects.select(F.col("id").alias("prospect_id"), F.col("verification_status").alias("pv")), "prospect_id", "left").join(gone, "email_key", "left")
    has, status = F.coalesce("has", F.lit(False)), F.coalesce("v", "pv", F.lit("unknown"))
    return m.groupBy("list_id").agg(
        F.count("*").alias("members"), F.count("has").alias("with_person"), F.count_if(has & (status == "invalid")).alias("excluded_invalid"), F.count_if(has & (status == "risky")).alias("excluded_risky"),
        F.count_if(has & ~status.isin("valid", "catchall", "invalid")).alias("excluded_unverified"), F.count_if(has & F.coalesce("gone", F.lit(False))).alias("excluded_unsubscribed"),
    )

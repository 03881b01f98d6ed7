"""Lists, members, tags, suppressions and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.email import domain, is_valid
from ..operators.merge import import_batch, upsert_persons
from ..operators.relational import count_where
from ..registry import query
from ..roles import Roles


@query("list_counts", """select m.list_id, count(*) as members, count(*) filter (where p.verification_status = 'valid') as verified, count(distinct lower(p.email)) as addresses
    from list_members m left join persons p on p.id = m.person_id group by m.list_id""", "list_members persons")  # fmt: skip
def list_counts(r: Roles) -> DataFrame:
    p = r.persons.select(F.col("id").alias("person_id"), F.lower("email").alias("email_key"), "verification_status")
    return r.list_members.join(p, "person_id", "left").groupBy("list_id").agg(F.count("*").alias("members"), *count_where(verified=F.col("verification_status") == "valid"), F.countDistinct("email_key").alias("addresses"))


@query("list_tags", "select tag, count(*) as members from (select unnest(string_split(tags, ',')) as tag from list_members where tags <> '') group by tag", "list_members")
def list_tags(r: Roles) -> DataFrame:
    return r.list_members.filter("tags != ''").select(F.explode(F.split("tags", ",")).alias("tag")).groupBy("tag").agg(F.count("*").alias("members"))


@query("list_tag_overlap", "select list_id, count(*) as members from list_members where list_has_any(string_split(tags, ','), ['vip', 'other']) group by list_id", "list_members")
def list_tag_overlap(r: Roles) -> DataFrame:
    overlap = F.coalesce(F.arrays_overlap(F.split("tags", ","), F.array(F.lit("vip"), F.lit("other"))), F.lit(False))
    return r.list_members.filter(overlap).groupBy("list_id").agg(F.count("*").alias("members"))


@query("list_detail", """select m.prospect_id, lower(pr.email) as email, pr.name, coalesce(e.opens, 0) as opens, coalesce(e.replies, 0) as replies, e.last_at, u.email is not null as unsubscribed
    from list_members m join prospects pr on pr.id = m.prospect_id left join (select email, count(*) filter (where event_type = 'open') as opens, count(*) filter (where event_type = 'reply') as replies, max(occurred_at) as last_at from campaign_events group by 1) e on lower(e.email) = lower(pr.email)
    left join (select distinct lower(email) as email from unsubscribes) u on u.email = lower(pr.email) where m.list_id = 2 and trim(pr.email) <> ''""", "list_members prospects campaign_events unsubscribes")  # fmt: skip
def list_detail(r: Roles) -> DataFrame:
    kind = F.col("event_type")
    seen = r.campaign_events.groupBy(F.lower("email").alias("email")).agg(F.count_if(kind == "open").alias("opens"), F.count_if(kind == "reply").alias("replies"), F.max("occurred_at").alias("last_at"))
    gone = r.unsubscribes.select(F.lower("email").alias("email"), F.lit(True).alias("unsubscribed")).distinct()
    p = r.prospects.select(F.col("id").alias("prospect_id"), F.lower("email").alias("email"), "name").filter(F.trim("email") != "")
    m = r.list_members.filter("list_id = 2").select("prospect_id").join(p, "prospect_id").join(seen, "email", "left").join(gone, "email", "left")
    return m.select("prospect_id", "email", "name", F.coalesce("opens", F.lit(0)).alias("opens"), F.coalesce("replies", F.lit(0)).alias("replies"), "last_at", F.coalesce("unsubscribed", F.lit(False)).alias("unsubscribed"))


@query("unsubscribes_by_source", "select source, count(*) as n, count(distinct lower(email)) as addresses from unsubscribes group by source", "unsubscribes")
def unsubscribes_by_source(r: Roles) -> DataFrame:
    return r.unsubscribes.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(F.lower("email")).alias("addresses"))


@query("verification_queue", """select coalesce(verification_status, 'unverified') as status, count(*) as n from persons where email is not null and trim(email) <> '' and id in (select person_id from list_members where list_id in (1, 2)) group by 1""", "persons list_members")
def verification_queue(r: Roles) -> DataFrame:
    members = r.list_members.filter(F.col("list_id").isin(1, 2)).select(F.col("person_id").alias("id"))
    p = r.persons.filter("email is not null and trim(email) != ''").join(members, "id", "left_semi")
    return p.groupBy(F.coalesce("verification_status", F.lit("unverified")).alias("status")).agg(F.count("*").alias("n"))


@query("import_outcomes", """with x as (select id, job_id, split_part(emails, ',', 1) as email from mining_results), f as (select *, min(id) over (partition by email) as first_id from x)
    select job_id, case when id = first_id then 'imported' else 'duplicate' end as outcome, count(*) as n from f group by 1, 2""", "mining_results")  # fmt: skip
def import_outcomes(r: Roles) -> DataFrame:
    rows = r.mining_results.withColumn("emails", F.split("emails", ","))
    return import_batch(rows, is_valid).groupBy("job_id", "outcome").agg(F.count("*").alias("n"))


@query("person_upsert_whole", """with p as (select organizer_id, lower(trim(email)) as email, id, nullif(trim(last_name), '') as last_name, owner_id, epoch(created_at) as made, min(epoch(created_at)) over () as lo, max(epoch(created_at)) over () as hi from persons),
    k as (select *, coalesce(2 * made < lo + hi, false) as before from p where email <> ''), f as (select organizer_id, email, before, arg_max(last_name, id) as last_name, arg_min(owner_id, id) as owner_id from k group by 1, 2, 3)
    select coalesce(o.organizer_id, n.organizer_id) as organizer_id, coalesce(o.email, n.email) as email, coalesce(n.last_name, o.last_name) as last_name, coalesce(o.owner_id, n.owner_id) as owner_id
    from (select * from f where before) o full join (select * from f where not before) n on n.organizer_id = o.organizer_id and n.email = o.email""", "persons")  # fmt: skip
def person_upsert_whole(r: Roles) -> DataFrame:
    return upsert_by_time(r.persons).select("organizer_id", "email", "last_name", "owner_id")


def upsert_by_time(persons: DataFrame) -> DataFrame:
    """Rows created before the middle of the time covered are the existing side, one row per key; all others come in."""
    at = F.unix_timestamp("created_at")
    p = persons.withColumns({"last_name": F.nullif(F.trim("last_name"), F.lit("")), "ord": F.col("id")})
    middle = p.agg((F.min(at) + F.max(at)).alias("_middle"))
    p = p.join(F.broadcast(middle)).withColumn("_before", F.coalesce(2 * at < F.col("_middle"), F.lit(False)))
    old = p.filter("_before")
    return upsert_persons(upsert_persons(old.limit(0), old), p.filter("not _before"))


@query("mining_results_summary", """select job_id, count(*) as results, count(*) filter (where coalesce(status, 'new') = 'new') as fresh, count(*) filter (where len(string_split(emails, ',')) > 1) as several, cast(sum(cast(score as decimal(18, 2))) as double) as total_score
    from mining_results group by job_id""", "mining_results")  # fmt: skip
def mining_results_summary(r: Roles) -> DataFrame:
    m = r.mining_results.withColumn("emails", F.split("emails", ","))
    return m.groupBy("job_id").agg(F.count("*").alias("results"), *count_where(fresh=F.coalesce("status", F.lit("new")) == "new", several=F.size("emails") > 1), F.sum(F.col("score").cast("decimal(18,2)")).cast("double").alias("total_score"))


@query("dominant_domains", """with d as (select job_id, split_part(lower(e), '@', 2) as domain, count(*) as n from (select job_id, unnest(string_split(emails, ',')) as e from mining_results) group by 1, 2),
    t as (select *, row_number() over (partition by job_id order by n desc, domain) as rn from d) select job_id, max(case when rn = 1 then domain end) as domain, sum(n)::bigint as emails, floor(max(n) * 100.0 / sum(n) + 0.5)::bigint as pct from t where rn <= 5 group by 1 having sum(n) >= 3""", "mining_results")  # fmt: skip
def dominant_domains(r: Roles) -> DataFrame:
    from ..functions.contact import js_round
    from ..operators.relational import top_per_key

    d = r.mining_results.select("job_id", F.explode(F.split("emails", ",")).alias("email")).groupBy("job_id", domain(F.col("email")).alias("domain")).agg(F.count("*").alias("n"))
    top = top_per_key(d, ["job_id"], [F.desc("n"), F.col("domain")], 5)
    return top.groupBy("job_id").agg(F.max_by("domain", F.struct(F.col("n"), F.lit(0))).alias("_"), F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("domain"), F.sum("n").alias("emails"), js_round(F.max("n") * 100.0 / F.sum("n")).alias("pct")).drop("_").filter("emails >= 3")

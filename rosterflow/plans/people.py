"""People and companies: filtered lists, pages, statistics, exports, boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contact import company_of, full_name
from ..operators.relational import contains_any, count_where, latest_per_key, sorted_page, text_of_list, top_per_key, where
from ..operators.scope import closure, scoped
from ..registry import query
from ..roles import Roles

_LATEST = "(select * from (select *, row_number() over (partition by person_id order by created_at desc, id desc) as rn from affiliations) where rn = 1)"
_COMPANY = "case when company_name like '%|%' then nullif(trim(split_part(company_name, '|', 1)), '') when company_name like '%@%' then null else company_name end"

FILTERS = {
    "search": lambda v: contains_any(["email", "first_name", "last_name"], v),
    "verification": lambda v: F.col("verification_status").isNull() | ~F.col("verification_status").isin("invalid", "risky") if v == "exclude_invalid" else F.col("verification_status") == v,
    "owner": lambda v: F.col("owner_id") == v,
    "statuses": lambda v: F.col("verification_status").isin(*v),
}


def list_people(r: Roles, **given) -> DataFrame:
    return where(r.persons, FILTERS, given)


@query("person_list", f"""select p.id, p.email, p.first_name, p.last_name, {_COMPANY} as company, a.position, exists (select 1 from campaign_events e where e.person_id = p.id and e.event_type in ('reply', 'click')) as has_intent
    from persons p left join {_LATEST} a on a.person_id = p.id where (p.verification_status is null or p.verification_status not in ('invalid', 'risky')) and (p.email ilike '%c1%' or p.first_name ilike '%c1%' or p.last_name ilike '%c1%')
    order by p.created_at desc, p.id limit 50 offset 50""", "persons affiliations campaign_events")  # fmt: skip
def person_list(r: Roles) -> DataFrame:
    people = list_people(r, search="c1", verification="exclude_invalid", owner=None)
    page = sorted_page(people, {"created_at": F.col("created_at"), "email": F.col("email")}, "created_at", "created_at", True, "id", 2, 50)
    latest = latest_per_key(r.affiliations, "person_id", "created_at", "id", ["company_name", "position"]).withColumnRenamed("person_id", "id")
    acted = r.campaign_events.filter(F.col("event_type").isin("reply", "click")).select(F.col("person_id").alias("id")).distinct().withColumn("has_intent", F.lit(True))
    rows = page.join(latest, "id", "left").join(acted, "id", "left")
    return rows.select("id", "email", "first_name", "last_name", company_of(F.col("company_name")).alias("company"), "position", F.coalesce("has_intent", F.lit(False)).alias("has_intent"))


@query("person_stats", """select organizer_id, count(*) as total, count(*) filter (where verification_status = 'valid') as valid, count(*) filter (where verification_status = 'invalid') as invalid,
    count(*) filter (where verification_status = 'risky') as risky, count(*) filter (where verification_status is null or verification_status = 'unknown') as unknown from persons group by organizer_id""", "persons")  # fmt: skip
def person_stats(r: Roles) -> DataFrame:
    v = F.col("verification_status")
    return r.persons.groupBy("organizer_id").agg(F.count("*").alias("total"), *count_where(valid=v == "valid", invalid=v == "invalid", risky=v == "risky", unknown=v.isNull() | (v == "unknown")))


@query("person_industries", "select industry, count(distinct person_id) as people from affiliations where industry is not null and trim(industry) <> '' group by industry", "affiliations")
def person_industries(r: Roles) -> DataFrame:
    return r.affiliations.filter("industry is not null and trim(industry) != ''").groupBy("industry").agg(F.countDistinct("person_id").alias("people"))


@query("person_no_intent", "select p.id from persons p where not exists (select 1 from campaign_events e where e.person_id = p.id) and exists (select 1 from list_members m where m.person_id = p.id and m.list_id = 1)", "persons campaign_events list_members")
def person_no_intent(r: Roles) -> DataFrame:
    seen = r.campaign_events.select(F.col("person_id").alias("id"))
    return r.persons.select("id").join(seen, "id", "left_anti").join(r.list_members.filter("list_id = 1").select(F.col("person_id").alias("id")), "id", "left_semi")


@query("person_export", f"""with l as (select person_id, array_to_string(list_sort(list_distinct(list('List ' || cast(list_id as varchar)))), ', ') as lists from list_members where person_id is not null group by 1),
    ev as (select person_id, count(distinct campaign_id) filter (where event_type = 'sent') as campaigns_sent, count(*) filter (where event_type = 'open') as opens, count(*) filter (where event_type = 'reply') as replies, max(occurred_at) as last_activity from campaign_events group by 1)
    select p.id, lower(p.email) as email, nullif(trim(concat_ws(' ', p.first_name, p.last_name)), '') as name, {_COMPANY} as company, coalesce(l.lists, '') as lists, coalesce(ev.campaigns_sent, 0) as campaigns_sent, coalesce(ev.opens, 0) as opens,
      coalesce(ev.replies, 0) as replies, ev.last_activity from persons p left join {_LATEST} a on a.person_id = p.id left join l on l.person_id = p.id left join ev on ev.person_id = p.id""", "persons affiliations list_members campaign_events")  # fmt: skip
def person_export(r: Roles) -> DataFrame:
    lists = r.list_members.filter("person_id is not null").withColumn("name", F.concat(F.lit("List "), F.col("list_id").cast("string"))).groupBy("person_id").agg(text_of_list("name").alias("lists"))
    kind = F.col("event_type")
    activity = r.campaign_events.groupBy("person_id").agg(F.countDistinct(F.when(kind == "sent", F.col("campaign_id"))).alias("campaigns_sent"), F.count_if(kind == "open").alias("opens"), F.count_if(kind == "reply").alias("replies"), F.max("occurred_at").alias("last_activity"))
    latest = latest_per_key(r.affiliations, "person_id", "created_at", "id", ["company_name"])
    p = r.persons.withColumnRenamed("id", "person_id").join(latest, "person_id", "left").join(lists, "person_id", "left").join(activity, "person_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.select(F.col("person_id").alias("id"), F.lower("email").alias("email"), full_name(F.col("first_name"), F.col("last_name")).alias("name"), company_of(F.col("company_name")).alias("company"), F.coalesce("lists", F.lit("")).alias("lists"), zero("campaigns_sent"), zero("opens"), zero("replies"), "last_activity")


@query("company_list", """select lower(trim(company_name)) as company_key, max(company_name) as company_name, count(distinct person_id) as contacts, count(*) as affiliations, max(created_at) as last_seen
    from affiliations where company_name is not null and trim(company_name) <> '' and company_name not like '%@%' group by 1 having count(distinct person_id) >= 3 order by contacts desc, company_key limit 50""", "affiliations")  # fmt: skip
def company_list(r: Roles) -> DataFrame:
    a = r.affiliations.filter("company_name is not null and trim(company_name) != '' and not contains(company_name, '@')")
    g = a.groupBy(F.lower(F.trim("company_name")).alias("company_key")).agg(F.max("company_name").alias("company_name"), F.countDistinct("person_id").alias("contacts"), F.count("*").alias("affiliations"), F.max("created_at").alias("last_seen"))
    return g.filter("contacts >= 3").orderBy(F.desc("contacts"), "company_key").limit(50)


@query("company_contacts", f"""select p.id, p.email, a.position, coalesce(n.n, 0) as events from {_LATEST} a join persons p on p.id = a.person_id and p.organizer_id = a.organizer_id
    left join (select person_id, count(*) as n from campaign_events group by 1) n on n.person_id = p.id where lower(trim(a.company_name)) = '1-urgent co 7'""", "affiliations persons campaign_events")  # fmt: skip
def company_contacts(r: Roles) -> DataFrame:
    a = latest_per_key(r.affiliations, "person_id", "created_at", "id", ["company_name", "position", "organizer_id"]).filter(F.lower(F.trim("company_name")) == "1-urgent co 7")
    n = r.campaign_events.groupBy("person_id").agg(F.count("*").alias("events"))
    p = r.persons.select(F.col("id").alias("person_id"), "organizer_id", "email")
    return a.join(p, ["person_id", "organizer_id"]).join(n, "person_id", "left").select(F.col("person_id").alias("id"), "email", "position", F.coalesce("events", F.lit(0)).alias("events"))


@query("pipeline_board", f"""select r.id, r.stage_id, r.stage_count, a.company_name, a.position, ev.event_type as last_activity_type, ev.occurred_at as last_activity_at from (
      select *, row_number() over (partition by stage_id order by stage_entered_at desc nulls last, created_at desc) as rn, count(*) over (partition by stage_id) as stage_count from persons where stage_id is not null) r
    left join {_LATEST} a on a.person_id = r.id left join (select * from (select *, row_number() over (partition by person_id order by occurred_at desc, id desc) as rn from campaign_events) where rn = 1) ev on ev.person_id = r.id where r.rn <= 10""", "persons affiliations campaign_events")  # fmt: skip
def pipeline_board(r: Roles) -> DataFrame:
    # a stage may hold a large share of all people: the first ten come by rank within hashed parts of a stage, then among those
    staged = r.persons.filter("stage_id is not null")
    order = [F.desc_nulls_last("stage_entered_at"), F.desc("created_at")]
    parts = top_per_key(staged.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64))), ["stage_id", "_part"], order, 10)
    top = top_per_key(parts.drop("_part"), ["stage_id"], order, 10)
    counts = staged.groupBy("stage_id").agg(F.count("*").alias("stage_count"))
    latest = latest_per_key(r.affiliations, "person_id", "created_at", "id", ["company_name", "position"]).withColumnRenamed("person_id", "id")
    last = latest_per_key(r.campaign_events, "person_id", "occurred_at", "id", ["event_type", "occurred_at"]).toDF("id", "last_activity_type", "last_activity_at")
    return top.join(counts, "stage_id").join(latest, "id", "left").join(last, "id", "left").select("id", "stage_id", "stage_count", "company_name", "position", "last_activity_type", "last_activity_at")


@query("pipeline_stages", "select stage_id, count(*) as people, max(stage_entered_at) as last_entered from persons where stage_id is not null group by stage_id", "persons")
def pipeline_stages(r: Roles) -> DataFrame:
    return r.persons.filter("stage_id is not null").groupBy("stage_id").agg(F.count("*").alias("people"), F.max("stage_entered_at").alias("last_entered"))


_TREE = """reach(viewer, member, depth) as (select id, id, 0 from users union all select r.viewer, u.id, r.depth + 1 from reach r join users u on u.reports_to = r.member)"""


@query("user_closure", f"with recursive {_TREE} select viewer, member, min(depth) as depth from reach group by 1, 2", "users")
def user_closure(r: Roles) -> DataFrame:
    return closure(r.users)


@query("scoped_people", f"with recursive {_TREE} select owner_id, count(*) as people from persons where owner_id in (select member from reach where viewer = 1) group by owner_id", "users persons")
def scoped_people(r: Roles) -> DataFrame:
    return scoped(r.persons, "owner_id", closure(r.users), 1, "manager").groupBy("owner_id").agg(F.count("*").alias("people"))


@query("visible_campaigns", f"with recursive {_TREE} select id, name, visibility from campaigns where visibility = 'shared' or created_by in (select member from reach where viewer = 2)", "users campaigns")
def visible_campaigns(r: Roles) -> DataFrame:
    from ..operators.scope import visible

    return visible(r.campaigns, "created_by", "visibility", closure(r.users), 2, "manager").select("id", "name", "visibility")


@query("user_stats", """select u.id, u.name, u.role, coalesce(p.n, 0) as people, coalesce(t.open, 0) as open_items from users u left join (select owner_id, count(*) as n from persons group by 1) p on p.owner_id = u.id
    left join (select assigned_to, count(*) filter (where status in ('open', 'in_progress')) as open from action_items group by 1) t on t.assigned_to = u.id""", "users persons action_items")  # fmt: skip
def user_stats(r: Roles) -> DataFrame:
    people = r.persons.groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("people"))
    items = r.action_items.groupBy(F.col("assigned_to").alias("id")).agg(F.count_if(F.col("status").isin("open", "in_progress")).alias("open_items"))
    return r.users.join(people, "id", "left").join(items, "id", "left").select("id", "name", "role", F.coalesce("people", F.lit(0)).alias("people"), F.coalesce("open_items", F.lit(0)).alias("open_items"))

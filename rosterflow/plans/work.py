"""Action items, tasks, timelines, waiting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import count_where, latest_per_key, typed_null
from ..registry import query
from ..roles import Roles

AS_OF_DAY = "1997-01-01"


@query("action_summary", "select trigger_reason, count(*) filter (where status = 'open') as open, count(*) filter (where status = 'in_progress') as in_progress, count(*) filter (where status = 'snoozed') as snoozed, count(*) filter (where status = 'done') as done, count(*) filter (where status in ('open', 'in_progress') and priority = 1) as urgent from action_items group by 1", "action_items")
def action_summary(r: Roles) -> DataFrame:
    s = F.col("status")
    return r.action_items.groupBy("trigger_reason").agg(*count_where(open=s == "open", in_progress=s == "in_progress", snoozed=s == "snoozed", done=s == "done", urgent=s.isin("open", "in_progress") & (F.col("priority") == 1)))


@query("action_list", """select i.id, i.priority, p.email, coalesce(p.first_name || ' ' || p.last_name, p.email) as person, a.company_name from action_items i left join persons p on p.id = i.person_id
    left join (select * from (select *, row_number() over (partition by person_id order by created_at desc, id desc) as rn from affiliations) where rn = 1) a on a.person_id = i.person_id where i.status in ('open', 'in_progress') order by i.priority, i.due_at desc nulls last, i.id limit 100""", "action_items persons affiliations")  # fmt: skip
def action_list(r: Roles) -> DataFrame:
    top = r.action_items.filter(F.col("status").isin("open", "in_progress")).orderBy("priority", F.desc_nulls_last("due_at"), "id").limit(100)
    p = r.persons.select(F.col("id").alias("person_id"), "email", F.coalesce(F.concat("first_name", F.lit(" "), "last_name"), "email").alias("person"))
    a = latest_per_key(r.affiliations, "person_id", "created_at", "id", ["company_name"])
    return top.join(p, "person_id", "left").join(a, "person_id", "left").select("id", "priority", "email", "person", "company_name")


@query("task_summary", f"select assigned_to, count(*) filter (where status = 'open' and due_at < timestamp '{AS_OF_DAY}') as overdue, count(*) filter (where status = 'open' and due_at >= timestamp '{AS_OF_DAY}' and due_at < timestamp '{AS_OF_DAY}' + interval 7 day) as due_week, count(*) filter (where status = 'done') as done from action_items group by 1", "action_items")
def task_summary(r: Roles) -> DataFrame:
    day = F.lit(AS_OF_DAY).cast("timestamp")
    s, due = F.col("status"), F.col("due_at")
    return r.action_items.groupBy("assigned_to").agg(*count_where(overdue=(s == "open") & (due < day), due_week=(s == "open") & (due >= day) & (due < day + F.expr("INTERVAL 7 DAYS")), done=s == "done"))


@query("person_timeline", """select * from (select occurred_at as happened_at, event_type as activity, 'email' as channel, c.name as campaign, e.id as ref from campaign_events e left join campaigns c on c.id = e.campaign_id where person_id = 42
    union all select created_at, 'affiliation', 'system', null, id from affiliations where person_id = 42 union all select due_at, trigger_reason, 'manual', null, id from action_items where person_id = 42) order by happened_at desc, ref desc, channel limit 100""", "campaign_events campaigns affiliations action_items")  # fmt: skip
def person_timeline(r: Roles) -> DataFrame:
    none = typed_null("string").alias("campaign")
    e = r.campaign_events.filter("person_id = 42").join(r.campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign")), "campaign_id", "left")
    e = e.select(F.col("occurred_at").alias("happened_at"), F.col("event_type").alias("activity"), F.lit("email").alias("channel"), "campaign", F.col("id").alias("ref"))
    a = r.affiliations.filter("person_id = 42").select(F.col("created_at").alias("happened_at"), F.lit("affiliation").alias("activity"), F.lit("system").alias("channel"), none, F.col("id").alias("ref"))
    t = r.action_items.filter("person_id = 42").select(F.col("due_at").alias("happened_at"), F.col("trigger_reason").alias("activity"), F.lit("manual").alias("channel"), none, F.col("id").alias("ref"))
    return e.unionByName(a).unionByName(t).orderBy(F.desc("happened_at"), F.desc("ref"), "channel").limit(100)


@query("waiting_list", """select p.id, count(i.id) as items, max(e.latest_at) as last_event from persons p join action_items i on i.person_id = p.id and i.status = 'open' left join (select person_id, max(occurred_at) as latest_at from campaign_events group by 1) e on e.person_id = p.id
    group by p.id having count(i.id) >= 2 order by items desc, p.id limit 50""", "persons action_items campaign_events")  # fmt: skip
def waiting_list(r: Roles) -> DataFrame:
    items = r.action_items.filter("status = 'open'").groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("items")).filter("items >= 2")
    last = r.campaign_events.groupBy(F.col("person_id").alias("id")).agg(F.max("occurred_at").alias("last_event"))
    return r.persons.select("id").join(items, "id").join(last, "id", "left").orderBy(F.desc("items"), "id").limit(50)


@query("overall_stats", "select (select count(*) from persons) as people, (select count(*) from affiliations) as affiliations, (select count(*) from campaign_events) as events, (select count(*) from action_items where status = 'open') as open_items", "persons affiliations campaign_events action_items")
def overall_stats(r: Roles) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  a single row each
    return one(r.persons, "people").join(one(r.affiliations, "affiliations")).join(one(r.campaign_events, "events")).join(one(r.action_items.filter("status = 'open'"), "open_items"))

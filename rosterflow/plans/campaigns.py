"""Campaign reports over the event log: summaries, timelines, breakdowns, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contact import bounce_kind
from ..functions.email import domain
from ..operators import events as ev
from ..operators.relational import count_where, percent, timeline, top_per_key, unpivot_times
from ..registry import query
from ..roles import AS_OF, Roles

KINDS = ["sent", "open", "click", "bounce", "reply"]


@query(
    "campaign_summary",
    """select campaign_id, sent, opens, clicks, bounces, replies, case when sent > 0 then round(opens / sent * 100, 2) else 0 end as open_rate, case when opens > 0 then round(clicks / opens * 100, 2) else 0 end as click_rate,
      case when sent > 0 then round(bounces / sent * 100, 2) else 0 end as bounce_rate from (
      select campaign_id, count(distinct case when event_type = 'sent' then email end) as sent, count(distinct case when event_type = 'open' then email end) as opens, count(distinct case when event_type = 'click' then email end) as clicks,
        count(distinct case when event_type = 'bounce' then email end) as bounces, count(distinct case when event_type = 'reply' then email end) as replies from campaign_events group by campaign_id)""",
    "campaign_events",
)
def campaign_summary(r: Roles) -> DataFrame:
    # one row for each campaign, type and address first: no expansion by distinct aggregate
    each = r.campaign_events.groupBy("campaign_id", "event_type", "email").agg(F.count("*").alias("n"))
    s = each.groupBy("campaign_id").agg(*count_where(**{name: F.col("event_type") == kind for name, kind in {"sent": "sent", "opens": "open", "clicks": "click", "bounces": "bounce", "replies": "reply"}.items()}))
    return s.withColumns({"open_rate": percent(F.col("opens"), F.col("sent")), "click_rate": percent(F.col("clicks"), F.col("opens")), "bounce_rate": percent(F.col("bounces"), F.col("sent"))})


@query(
    "events_by_type",
    "select event_type, count(*) as total, count(distinct email) as emails, min(occurred_at) as first_at, max(occurred_at) as last_at from campaign_events group by event_type",
    "campaign_events",
)
def events_by_type(r: Roles) -> DataFrame:
    return r.campaign_events.groupBy("event_type").agg(F.count("*").alias("total"), F.countDistinct("email").alias("emails"), F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"))


_PIVOT = ", ".join(f"count(*) filter (where event_type = '{k}') as {k}" for k in KINDS)


@query("timeline_daily", f"select date_trunc('day', occurred_at)::timestamp as period, {_PIVOT}, count(*) as total from campaign_events group by 1", "campaign_events")
def timeline_daily(r: Roles) -> DataFrame:
    return timeline(r.campaign_events, "occurred_at", "day", "event_type", KINDS)


@query("timeline_hourly", f"select date_trunc('hour', occurred_at)::timestamp as period, {_PIVOT}, count(*) as total from campaign_events where campaign_id = 3 group by 1", "campaign_events")
def timeline_hourly(r: Roles) -> DataFrame:
    return timeline(r.campaign_events.filter("campaign_id = 3"), "occurred_at", "hour", "event_type", KINDS)


@query("recipient_fallback_timeline", """select event_type, cast(occurred_at as date) as day, count(*) as n from (
      select id, 'sent' as event_type, sent_at as occurred_at from recipients union all select id, 'delivered', delivered_at from recipients union all select id, 'open', opened_at from recipients
      union all select id, 'click', clicked_at from recipients union all select id, 'bounce', bounced_at from recipients) where occurred_at is not null group by 1, 2""", "recipients")  # fmt: skip
def recipient_fallback_timeline(r: Roles) -> DataFrame:
    times = {"sent_at": "sent", "delivered_at": "delivered", "opened_at": "open", "clicked_at": "click", "bounced_at": "bounce"}
    return unpivot_times(r.recipients, ["id"], times).groupBy("event_type", F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("n"))


@query("top_domains", """select domain, total, opens, bounces from (select split_part(lower(email), '@', 2) as domain, count(*) as total, count(*) filter (where event_type = 'open') as opens,
      count(*) filter (where event_type = 'bounce') as bounces from campaign_events group by 1) order by total desc, domain limit 20""", "campaign_events")  # fmt: skip
def top_domains(r: Roles) -> DataFrame:
    d = r.campaign_events.groupBy(domain(F.col("email")).alias("domain")).agg(F.count("*").alias("total"), *count_where(opens=F.col("event_type") == "open", bounces=F.col("event_type") == "bounce"))
    return d.orderBy(F.desc("total"), "domain").limit(20)


@query("top_links", "select url, count(*) as clicks, count(distinct email) as people from campaign_events where event_type = 'click' and url is not null group by url order by clicks desc, url limit 10", "campaign_events")
def top_links(r: Roles) -> DataFrame:
    return r.campaign_events.filter("event_type = 'click' and url is not null").groupBy("url").agg(F.count("*").alias("clicks"), F.countDistinct("email").alias("people")).orderBy(F.desc("clicks"), "url").limit(10)


@query("bounce_reasons", """select coalesce(reason, 'unknown') as label, reason is null as missing, count(*) as n, case when reason is null then 'unknown' when lower(reason) like '%550%' or lower(reason) like '%invalid%' then 'hard'
      when lower(reason) like '%temp%' or lower(reason) like '%full%' then 'soft' else 'unknown' end as kind from campaign_events where event_type = 'bounce' group by reason order by n desc, label, missing limit 20""", "campaign_events")  # fmt: skip
def bounce_reasons(r: Roles) -> DataFrame:
    b = r.campaign_events.filter("event_type = 'bounce'").groupBy("reason").agg(F.count("*").alias("n"))
    return b.select(F.coalesce("reason", F.lit("unknown")).alias("label"), F.col("reason").isNull().alias("missing"), "n", bounce_kind(F.col("reason")).alias("kind")).orderBy(F.desc("n"), "label", "missing").limit(20)


@query("engagement_scores", f"""select person_id, sum(case when occurred_at >= timestamp '{AS_OF}' - interval 30 day then w else 0 end) as recent,
      sum(w) + case when max(occurred_at) < timestamp '{AS_OF}' - interval 7 day then -2 else 0 end as all_time
    from (select *, case event_type when 'open' then 1 when 'click' then 3 when 'reply' then 10 else 0 end as w from campaign_events) group by person_id""", "campaign_events")  # fmt: skip
def engagement_scores(r: Roles) -> DataFrame:
    e = r.campaign_events
    recent, all_time = ev.engagement_recent(e, AS_OF), ev.engagement_all_time(e, AS_OF)
    return all_time.withColumnRenamed("score", "all_time").join(recent.withColumnRenamed("score", "recent"), "person_id", "left").select("person_id", F.coalesce("recent", F.lit(0)).alias("recent"), "all_time")


@query("engaged_hot", f"""with e as (select * from campaign_events),
    replied as (select distinct person_id from e where event_type = 'reply' and occurred_at >= timestamp '{AS_OF}' - interval 3 day), src as (select * from e where event_type <> 'reply'),
    a as (select person_id, count(distinct cast(occurred_at as date)) as days, max(occurred_at) as latest_at from src where event_type = 'open' and occurred_at >= timestamp '{AS_OF}' - interval 7 day group by 1 having count(distinct cast(occurred_at as date)) >= 2),
    c as (select *, row_number() over (partition by person_id order by occurred_at desc, id desc) as rn from src where event_type = 'click' and occurred_at >= timestamp '{AS_OF}' - interval 30 day),
    d as (select person_id, max(occurred_at) as latest_at from c where rn <= 5 and lower(url) like '%pricing%' group by 1)
    select person_id, 'opens' as rule, latest_at as last_activity_at from a where person_id not in (select person_id from replied)
    union all select person_id, 'click', latest_at from d where person_id not in (select person_id from a) and person_id not in (select person_id from replied)""", "campaign_events")  # fmt: skip
def engaged_hot(r: Roles) -> DataFrame:
    # nearly everyone replies at some time here: only replies of the last days count as replies, others are left out
    old = (F.col("event_type") == "reply") & (F.col("occurred_at") < ev.ago(AS_OF, 3))
    hot = ev.engaged_hot(r.campaign_events.filter(~old), None, AS_OF)
    return hot.select("person_id", F.when(F.startswith("reason", F.lit("Opened")), "opens").otherwise("click").alias("rule"), "last_activity_at")


@query("intents_by_type", """select intent_type, campaign_id, count(*) as people, min(occurred_at) as first_at from (
      select person_id, campaign_id, case event_type when 'reply' then 'reply' else 'click_through' end as intent_type, min(occurred_at) as occurred_at from campaign_events where event_type in ('reply', 'click') group by 1, 2, 3) group by 1, 2""", "campaign_events")  # fmt: skip
def intents_by_type(r: Roles) -> DataFrame:
    return ev.intents(r.campaign_events).groupBy("intent_type", "campaign_id").agg(F.count("*").alias("people"), F.min("occurred_at").alias("first_at"))


@query("reply_health", f"""select *, case when replies_7d = 0 and replies_30d = 0 then 'error' when replies_7d = 0 then 'warning' else 'active' end as status from (
      select count(*) filter (where occurred_at > timestamp '{AS_OF}' - interval 7 day) as replies_7d, count(*) filter (where occurred_at > timestamp '{AS_OF}' - interval 30 day) as replies_30d, max(occurred_at) as last_reply
      from campaign_events where event_type = 'reply')""", "campaign_events")  # fmt: skip
def reply_health(r: Roles) -> DataFrame:
    return ev.reply_health(r.campaign_events, AS_OF)


@query("event_dedup", """select campaign_id, event_type, count(*) as n from (
      select campaign_id, event_type, lower(email) as e, provider_event_id as p from campaign_events where provider_event_id is not null group by 1, 2, 3, 4
      union all select campaign_id, event_type, lower(email), null from campaign_events where provider_event_id is null) group by 1, 2""", "campaign_events")  # fmt: skip
def event_dedup(r: Roles) -> DataFrame:
    from ..operators.merge import insert_or_ignore

    e = r.campaign_events.withColumn("email_key", F.lower("email"))
    return insert_or_ignore(e.limit(0), e, ["campaign_id", "event_type", "email_key", "provider_event_id"], ["occurred_at", "id"], need="provider_event_id").groupBy("campaign_id", "event_type").agg(F.count("*").alias("n"))


@query("events_onto_held", """with e as (select *, lower(email) as e from campaign_events), old as (select * from e where id % 3 = 0), new as (select * from e where id % 3 > 0 or id % 4 = 0)
    select id, campaign_id, event_type from (select *, row_number() over (partition by campaign_id, event_type, e, provider_event_id order by occurred_at, id) as rn from new) x
    where provider_event_id is null or (rn = 1 and not exists (select 1 from old o where o.campaign_id = x.campaign_id and o.event_type = x.event_type and o.e = x.e and o.provider_event_id = x.provider_event_id))""", "campaign_events")  # fmt: skip
def events_onto_held(r: Roles) -> DataFrame:
    """What is new of events that partly repeat those held."""
    from ..operators.merge import insert_or_ignore

    e = r.campaign_events.withColumn("email_key", F.lower("email"))
    fresh = insert_or_ignore(e.filter("id % 3 = 0"), e.filter("id % 3 > 0 or id % 4 = 0"), ["campaign_id", "event_type", "email_key", "provider_event_id"], ["occurred_at", "id"], need="provider_event_id")
    return fresh.select("id", "campaign_id", "event_type")


@query("recipient_states", """with e as (select person_id, event_type, occurred_at, id, row_number() over (partition by person_id order by occurred_at desc, id desc) as rn from campaign_events where event_type in ('open', 'click', 'bounce', 'reply')),
    x as (select person_id, max(case when event_type = 'reply' then (epoch_us(occurred_at), id) end) as r, max(case when event_type = 'bounce' then (epoch_us(occurred_at), id) end) as b, max(case when rn = 1 then event_type end) as last from e group by 1),
    c as (select person_id, count(*) filter (where event_type = 'open') as opens, count(*) filter (where event_type = 'click') as clicks, min(occurred_at) filter (where event_type = 'open') as first_open from campaign_events group by 1)
    select c.person_id as recipient_id, case when r is not null and (b is null or r > b) then 'replied' when last = 'bounce' then 'bounced' when last = 'open' then 'opened' when last = 'click' then 'clicked' when last = 'reply' then 'replied' else 'sent' end as status,
      opens as open_count, clicks as click_count, first_open as opened_at from c left join x using (person_id)""", "campaign_events")  # fmt: skip
def recipient_states(r: Roles) -> DataFrame:
    e = r.campaign_events.withColumn("recipient_id", F.col("person_id"))
    sent = e.select("recipient_id").distinct().withColumn("status", F.lit("sent"))
    return ev.recipient_state(sent, e).select("recipient_id", "status", "open_count", "click_count", "opened_at")


@query("sequence_steps", "select s.step, count(*) filter (where r.last_sent_step >= s.step) as sent from (select unnest([1, 2, 3, 4]) as step) s, recipients r group by s.step", "recipients")
def sequence_steps(r: Roles) -> DataFrame:
    # counts by last step, then a running sum from the last one: four rows, however many recipients
    by_step = r.recipients.groupBy("last_sent_step").agg(F.count("*").alias("n"))
    reached = by_step.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(4)))).groupBy("step")
    return reached.agg(F.sum(F.when(F.col("last_sent_step") >= F.col("step"), F.col("n")).otherwise(0)).alias("sent"))


@query("campaign_list", """select c.id, c.name, u.name as created_by_name, coalesce(s.max_step, 0) as max_step, coalesce(s.recipients, 0) as recipients from campaigns c left join users u on u.id = c.created_by
      left join (select campaign_id, max(last_sent_step) as max_step, count(*) as recipients from recipients group by 1) s on s.campaign_id = c.id""", "campaigns users recipients")  # fmt: skip
def campaign_list(r: Roles) -> DataFrame:
    steps = r.recipients.groupBy("campaign_id").agg(F.max("last_sent_step").alias("max_step"), F.count("*").alias("recipients"))
    users = r.users.select(F.col("id").alias("created_by"), F.col("name").alias("created_by_name"))
    c = r.campaigns.join(users, "created_by", "left").join(steps, F.col("id") == F.col("campaign_id"), "left")
    return c.select("id", "name", "created_by_name", F.coalesce("max_step", F.lit(0)).alias("max_step"), F.coalesce("recipients", F.lit(0)).alias("recipients"))


@query("sliding_week", """select user_day.day, count(distinct e.person_id) as people from (select distinct cast(occurred_at as date) as day from campaign_events) user_day
      join campaign_events e on cast(e.occurred_at as date) between user_day.day - 6 and user_day.day group by 1""", "campaign_events")  # fmt: skip
def sliding_week(r: Roles) -> DataFrame:
    days = r.campaign_events.select(F.to_date("occurred_at").alias("day"), "person_id").distinct()
    spread = days.withColumn("day", F.explode(F.sequence(F.col("day"), F.date_add("day", 6))))
    counts = spread.groupBy("day").agg(F.countDistinct("person_id").alias("people"))
    return counts.join(days.select("day").distinct(), "day", "left_semi")


@query("recent_people_events", "select person_id, id, event_type, occurred_at, total from (select *, row_number() over (partition by person_id order by occurred_at desc, id desc) as rn, count(*) over (partition by person_id) as total from campaign_events) where rn <= 3", "campaign_events")
def recent_people_events(r: Roles) -> DataFrame:
    return top_per_key(r.campaign_events, ["person_id"], [F.desc("occurred_at"), F.desc("id")], 3, "total").select("person_id", "id", "event_type", "occurred_at", "total")

"""Queries over inbound replies and live states, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as ev
from ..registry import query
from ..roles import EMAIL, Roles
from ..streaming import replies as rp
from ..streaming.ingest import append_once
from .turns import scratch

HEX = "lpad(lower(hex({k})), 8, '0')"
#: Mail from the reply events: a third answers by a tag, some is automatic, some comes from strangers; bodies have signatures of three shapes.
MAIL = f"""select id as mail_id, occurred_at as received_at,
    case when id % 5 = 0 then concat('Some One <', upper(email), '>') when id % 7 = 0 then concat('x', email) else email end as sender,
    case when id % 3 = 0 then concat('a@x.example, Rep <rep+c-', {HEX.format(k="person_id % 7")}, '-r-', {HEX.format(k="person_id")}, '@x.example>') when id % 29 = 0 then 'rep+c-00000000-r-00000000@x.example' else 'rep@x.example' end as receiver,
    case when id % 11 = 0 then 'Automatic reply: away' when id % 4 = 0 then null else concat('Re: offer ', cast(id as string)) end as subject,
    case when id % 13 = 0 then 'Auto-Submitted: auto-replied' else 'Auto-Submitted: no' end as headers,
    case cast(id % 3 as int) when 0 then concat('Hello', chr(10), '-- ', chr(10), 'Ann Mary Smith', chr(10), 'Sales Manager', chr(10), 'Firm ', cast(id % 13 as string), chr(10), 'Tel: +49 30 ', cast(1000000 + id % 8000000 as string))
        when 1 then 'ok' else concat('See you', chr(10), 'Best regards,', chr(10), 'Joe', chr(10), '+49 40 ', cast(1000000 + id % 8000000 as string)) end as body
    from {{campaign_events}} where event_type = 'reply'"""
RECIPIENTS = f"""select id as recipient_id, cast(id % 3 as int) as organizer_id, campaign_id, {HEX.format(k="id % 7")} as campaign_short, {HEX.format(k="id")} as short_id,
    {EMAIL.format(k="id")} as email, status, sent_at from {{recipients}}"""
PERSONS = "select id, organizer_id, email, first_name, last_name, case when id % 2 = 0 then '0' else '' end as phone, stage_id from {persons}"
SEQUENCES = f"select campaign_id, cast(id % 3 as int) as organizer_id, {EMAIL.format(k='id')} as email, case when id % 4 = 0 then 'paused' else 'active' end as status from {{recipients}}"
AFFILIATIONS = "select id, person_id, organizer_id, case when id % 2 = 0 then position end as position, case when id % 3 = 0 then company_name end as company_name, created_at from {affiliations}"
STAGES = [(0, "New"), (1, "Contacted"), (2, "Interested"), (3, "Won")]
ROLES = "campaign_events recipients persons affiliations campaigns"


def tables(r: Roles) -> dict[str, DataFrame]:
    of = lambda sql, *names: r.spark.sql(sql, **{n: getattr(r, n) for n in names})
    organizers = r.spark.createDataFrame([(k,) for k in range(3)], "organizer_id int")
    return {
        "mail": of(MAIL, "campaign_events"), "recipients": of(RECIPIENTS, "recipients"), "persons": of(PERSONS, "persons"), "sequences": of(SEQUENCES, "recipients"), "affiliations": of(AFFILIATIONS, "affiliations"),
        "stages": organizers.select("organizer_id", F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(n).alias("name")) for k, n in STAGES])).alias("s")).select("s.id", "organizer_id", "s.name"),
        "campaigns": r.campaigns.select("id", F.when(F.col("id") != 3, F.col("created_by")).alias("created_by"), "name"), "owners": organizers.filter("organizer_id > 0").withColumn("owner_id", F.lit(0)),
        "intents": r.campaign_events.filter("event_type = 'reply' and id % 50 = 0").select("organizer_id", "person_id", F.expr("cast(person_id % 7 as int)").alias("campaign_id"), F.lit("reply").alias("intent_type")).distinct(),
        "history": r.campaign_events.filter("event_type <> 'reply'"),
    }


def found(r: Roles, name: str) -> DataFrame:
    t = tables(r)
    replies = rp.resolved(t.pop("mail"), t.pop("recipients"), t["persons"])
    return rp.effects(replies, **t)[name]


_names = {n: n for n in ROLES.split()}
CTES = f"""with mail as ({MAIL.format(**_names)}), rec as ({RECIPIENTS.format(**_names)}), per as ({PERSONS.format(**_names)}), seq as ({SEQUENCES.format(**_names)}), aff as ({AFFILIATIONS.format(**_names)}),
    written as (select *, regexp_extract(lower(receiver), 'c-([a-f0-9]{{8}})-r-([a-f0-9]{{8}})@', 1) as tc, regexp_extract(lower(receiver), 'c-([a-f0-9]{{8}})-r-([a-f0-9]{{8}})@', 2) as tr,
        lower(coalesce(nullif(regexp_extract(sender, '<([^>]+)>', 1), ''), sender)) as bare from mail where coalesce(subject, '') not like 'Automatic%' and headers <> 'Auto-Submitted: auto-replied'),
    met as (select w.*, coalesce((select min(recipient_id) from rec where campaign_short = tc and short_id = tr), (select arg_max(recipient_id, (sent_at, recipient_id)) from rec where email = bare and status <> 'bounced')) as recipient_id
        from written w where not (tc = '00000000' and tr = '00000000')),
    rep as (select m.mail_id, m.received_at, m.subject, m.body, rec.recipient_id, rec.organizer_id, rec.campaign_id, rec.email, (select min(id) from per where per.organizer_id = rec.organizer_id and lower(per.email) = rec.email) as person_id
        from met m join rec using (recipient_id)),
    known as (select *, row_number() over (partition by person_id, organizer_id order by received_at, mail_id) as nth from rep where person_id is not null),
    stage(id, name) as (values (0, 'New'), (1, 'Contacted'), (2, 'Interested'), (3, 'Won')),
    moved as (select k.*, s.name as from_stage from known k join per p on p.id = k.person_id left join stage s on s.id = p.stage_id where k.nth = 1 and (p.stage_id is null or s.name in ('New', 'Contacted'))),
    sig as (select *, case mail_id % 3 when 0 then '+49 30 ' || (1000000 + mail_id % 8000000) when 2 then '+49 40 ' || (1000000 + mail_id % 8000000) end as s_phone, case mail_id % 3 when 0 then 'Ann' when 2 then 'Joe' end as s_first,
        case mail_id % 3 when 0 then 'Mary Smith' end as s_last, case mail_id % 3 when 0 then 'Sales Manager' end as s_title, case mail_id % 3 when 0 then 'Firm ' || (mail_id % 13) end as s_company from known),
    latest as (select person_id, organizer_id, arg_max(id, (created_at, id)) as aid from aff group by 1, 2),
    says as (select g.person_id, g.organizer_id, arg_min((mail_id, s_phone), nth) filter (where s_phone is not null) as phone, arg_min((mail_id, s_first), nth) filter (where s_first is not null) as first_name,
        arg_min((mail_id, s_last), nth) filter (where s_first is not null) as last_name, arg_min((mail_id, s_title), nth) filter (where s_title is not null) as position, arg_min((mail_id, s_company), nth) filter (where s_company is not null) as company from sig g group by 1, 2),
    fills as (select s.person_id, s.organizer_id, a.id as aid, case when p.phone = '' then s.phone end as phone, case when coalesce(p.first_name, '') = '' then s.first_name end as first_name,
        case when coalesce(p.first_name, '') = '' and coalesce(p.last_name, '') = '' and s.last_name[2] is not null then s.last_name end as last_name,
        case when a.id is not null and coalesce(a.position, '') = '' then s.position end as position, case when a.id is not null and coalesce(a.company_name, '') = '' then s.company end as company
        from says s join per p on p.id = s.person_id left join latest l on l.person_id = s.person_id and l.organizer_id = s.organizer_id left join aff a on a.id = l.aid)"""


@query("reply_events", CTES + " select mail_id, recipient_id, campaign_id, organizer_id, person_id, email, received_at as occurred_at, length(body)::int as chars from rep", ROLES)
def reply_events(r: Roles) -> DataFrame:
    return found(r, "events").select("mail_id", "recipient_id", "campaign_id", "organizer_id", "person_id", "email", "occurred_at", F.length("text").alias("chars"))


@query("reply_intents", CTES + """ select organizer_id, person_id, campaign_id, min(received_at) as occurred_at from known where (organizer_id, person_id, campaign_id) not in (
    select organizer_id, person_id, person_id % 7 from campaign_events where event_type = 'reply' and id % 50 = 0) group by 1, 2, 3""", ROLES)  # fmt: skip
def reply_intents(r: Roles) -> DataFrame:
    return found(r, "intents").drop("intent_type")


@query("reply_states", CTES + " select recipient_id, 'replied' as status, max(received_at) as replied_at from rep group by 1", ROLES)
def reply_states(r: Roles) -> DataFrame:
    return found(r, "states")


@query("reply_activities", CTES + """ select person_id, organizer_id, 'email_replied' as activity_type, coalesce(subject, '') as description, received_at as occurred_at, mail_id from known
    union all select person_id, organizer_id, 'status_change', 'Auto-moved to Interested (reply received)', received_at, mail_id from moved
    union all select f.person_id, f.organizer_id, 'auto_enrichment', 'Auto-enriched from reply signature: ' || concat_ws(', ', case when f.phone[1] = m.mail_id then 'phone' end, case when f.first_name[1] = m.mail_id then 'first_name' end,
        case when f.last_name[1] = m.mail_id then 'last_name' end, case when f.position[1] = m.mail_id then 'position' end, case when f.company[1] = m.mail_id then 'company_name' end) as d, m.received_at, m.mail_id
        from fills f join known m on m.person_id = f.person_id and m.organizer_id = f.organizer_id where m.mail_id in (f.phone[1], f.first_name[1], f.last_name[1], f.position[1], f.company[1])""", ROLES)  # fmt: skip
def reply_activities(r: Roles) -> DataFrame:
    return found(r, "activities")


@query("reply_people", CTES + """ select f.person_id, f.organizer_id, case when m.mail_id is not null then 2 end as stage_id, m.received_at as moved_at, f.phone[2] as phone, f.first_name[2] as first_name, f.last_name[2] as last_name
    from fills f left join moved m on m.person_id = f.person_id and m.organizer_id = f.organizer_id where m.mail_id is not null or f.phone[2] is not null or f.first_name[2] is not null or f.last_name[2] is not null""", ROLES)  # fmt: skip
def reply_people(r: Roles) -> DataFrame:
    return found(r, "people")


@query("reply_affiliations", CTES + " select aid as id, position[2] as position, company[2] as company_name from fills where position is not null or company is not null", ROLES)
def reply_affiliations(r: Roles) -> DataFrame:
    return found(r, "affiliations")


@query("reply_sequence_stops", CTES + " select campaign_id, organizer_id, email, 'replied' as status from seq where status = 'active' and (campaign_id, organizer_id, email) in (select campaign_id, organizer_id, email from rep)", ROLES)
def reply_sequence_stops(r: Roles) -> DataFrame:
    return found(r, "sequence_stops")


@query("reply_items_made", CTES + """, n as (select person_id, organizer_id, count(*) as n, max(received_at) as last_at from known group by 1, 2),
    h as (select n.person_id, n.organizer_id, sum(case e.event_type when 'open' then 1 when 'click' then 3 else 0 end) as past from n join campaign_events e on e.person_id = n.person_id and e.organizer_id = n.organizer_id and e.event_type <> 'reply' and e.occurred_at >= n.last_at - interval 30 day group by 1, 2)
    select k.mail_id, k.person_id, k.organizer_id, k.campaign_id, coalesce(case when c.id <> 3 then c.created_by end, case when k.organizer_id > 0 then 0 end) as assigned_to, 'Reply received from campaign "' || c.name || '"' as trigger_detail,
      k.received_at as last_activity_at, (coalesce(h.past, 0) + 10 * n.n)::bigint as engagement_score
    from known k join campaigns c on c.id = k.campaign_id join n using (person_id, organizer_id) left join h using (person_id, organizer_id) where not (c.id = 3 and k.organizer_id = 0)""", ROLES)  # fmt: skip
def reply_items_made(r: Roles) -> DataFrame:
    return found(r, "items").select("mail_id", "person_id", "organizer_id", "campaign_id", "assigned_to", "trigger_detail", "last_activity_at", "engagement_score")


HELD = "case cast(person_id % 7 as int) when 0 then 'sent' when 1 then 'delivered' when 2 then 'opened' when 3 then 'clicked' when 4 then 'bounced' when 5 then 'replied' else 'unsubscribed' end"


@query("recipient_states_held", f"""with e as (select person_id, id, occurred_at, case when event_type = 'reply' and id % 8 > 0 then 'deferred' when event_type = 'sent' then 'delivered' when event_type = 'bounce' and id % 3 > 0 then 'unsubscribe' else event_type end as k from campaign_events)
    select person_id as recipient_id, list_reduce(list_prepend({HELD}, list(k order by occurred_at, id)), lambda s, k: case when k = 'delivered' then case when s = 'sent' then k else s end
        when k in ('open', 'click') then case when s in ('replied', 'unsubscribed') then s when k = 'open' then 'opened' else 'clicked' end when k = 'bounce' then 'bounced' when k = 'reply' then 'replied' else s end) as status,
      min(occurred_at) filter (where k = 'open') as opened_at, max(occurred_at) filter (where k = 'bounce') as bounced_at, max(occurred_at) filter (where k = 'reply') as replied_at, count(*) filter (where k = 'open') as open_count, count(*) filter (where k = 'click') as click_count
    from e group by person_id""", "campaign_events")  # fmt: skip
def recipient_states_held(r: Roles) -> DataFrame:
    kind = "case when event_type = 'reply' and id % 8 > 0 then 'deferred' when event_type = 'sent' then 'delivered' when event_type = 'bounce' and id % 3 > 0 then 'unsubscribe' else event_type end"
    e = r.campaign_events.withColumns({"recipient_id": F.col("person_id"), "event_type": F.expr(kind)})
    sent = e.select("recipient_id", F.expr(HELD).alias("status")).distinct()
    return ev.recipient_state(sent, e).select("recipient_id", "status", "opened_at", "bounced_at", "replied_at", "open_count", "click_count")


@query("events_appended_once", """select * exclude (rn) from (select id, campaign_id, event_type, lower(email) as email, provider_event_id, cast(id % 3 as int) as batch,
      row_number() over (partition by campaign_id, event_type, lower(email), provider_event_id order by id % 3, occurred_at, id) as rn from campaign_events) where rn = 1 or provider_event_id is null""", "campaign_events")  # fmt: skip
def events_appended_once(r: Roles) -> DataFrame:
    """Three batches, the second twice."""
    store = scratch(r, "events")
    e = r.campaign_events.select("id", "campaign_id", "event_type", F.lower("email").alias("email"), "provider_event_id", "occurred_at")
    write = append_once(store, order=["occurred_at", "id"], buckets=8)
    for batch in (0, 1, 1, 2):
        write(e.filter(F.col("id") % 3 == batch), batch)
    return r.spark.read.parquet(store).select("id", "campaign_id", "event_type", "email", "provider_event_id", F.col("batch").cast("int").alias("batch"))

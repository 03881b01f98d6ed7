"""The smaller shapes of filters, joins, aggregates, orders and rules, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import relational as rel
from ..operators import rules, scope
from ..registry import query
from ..roles import AS_OF, Roles
from .audience import allowed_status
from .people import list_people

_DAYS = "timestamp '2024-01-01 00:00:00' + interval '1' hour"


@query("people_of_days", "select organizer_id, count(*) as people from persons where created_at between timestamp '2024-01-01 00:00:00' and timestamp '2024-01-01 23:59:59' group by 1", "persons")
def people_of_days(r: Roles) -> DataFrame:
    return r.persons.filter(rel.on_day_range("created_at", "2024-01-01", "2024-01-01")).groupBy("organizer_id").agg(F.count("*").alias("people"))


@query("affiliations_of_countries", "select person_id, company_name from affiliations where lower(trim(position)) in ('o', 'p') and lower(trim(industry)) in ('i1', 'i2', 'i7')", "affiliations")
def affiliations_of_countries(r: Roles) -> DataFrame:
    return r.affiliations.filter(rel.normalized_in("position", [" O", "P"]) & rel.normalized_in("industry", ["I1", "i2 ", "i7"])).select("person_id", "company_name")


@query("results_by_address", "select id, job_id from mining_results where array_to_string(string_split(emails, ','), ',') ilike '%@D1%'", "mining_results")
def results_by_address(r: Roles) -> DataFrame:
    return r.mining_results.filter(F.array_join(F.split("emails", ","), ",").ilike("%@D1%")).select("id", "job_id")


@query("people_by_prefix", "select id, email from persons where left(cast(id as varchar), 2) = '12'", "persons")
def people_by_prefix(r: Roles) -> DataFrame:
    return r.persons.filter(F.substring(F.col("id").cast("string"), 1, 2) == "12").select("id", "email")


@query("addresses_not_held", "select distinct x as email from (select unnest(string_split(emails, ',')) as x from mining_results) where x not in (select lower(email) from persons where id % 2 = 0)", "mining_results persons")
def addresses_not_held(r: Roles) -> DataFrame:
    found = r.mining_results.select(F.explode(F.split("emails", ",")).alias("email")).distinct()
    return found.join(r.persons.filter("id % 2 = 0").select(F.lower("email").alias("email")), "email", "left_anti")


@query("verification_modes", """select organizer_id, count(*) filter (where verification_status in ('valid', 'catchall')) as verified_only, count(*) filter (where verification_status not in ('invalid', 'risky')) as exclude_invalid,
    count(*) filter (where verification_status <> 'invalid') as with_risky from persons group by 1""", "persons")  # fmt: skip
def verification_modes(r: Roles) -> DataFrame:
    s = F.col("verification_status")
    modes = {"verified_only": allowed_status(s, "verified_only"), "exclude_invalid": allowed_status(s, "exclude_invalid"), "with_risky": allowed_status(s, "exclude_invalid", include_risky=True)}
    return r.persons.groupBy("organizer_id").agg(*rel.count_where(**modes))


@query("unknown_filters", "select id from persons where owner_id = 3", "persons")
def unknown_filters(r: Roles) -> DataFrame:
    return list_people(r, owner=3, colour="red").select("id")


@query("sums_of_nothing", """select sum(case when status = 'sent' then 1 else 0 end)::bigint as sent, coalesce(sum(case when status = 'sent' then 1 else 0 end), 0)::bigint as sent_or_zero, count(*) as n
    from recipients where campaign_id = 99""", "recipients")  # fmt: skip
def sums_of_nothing(r: Roles) -> DataFrame:
    sent = F.sum(F.when(F.col("status") == "sent", 1).otherwise(0))
    return r.recipients.filter("campaign_id = 99").agg(sent.alias("sent"), F.coalesce(sent, F.lit(0).cast("long")).alias("sent_or_zero"), F.count("*").alias("n"))


@query("average_scores", "select job_id, ((2 * sum(cast(round(score * 100) as bigint)) + count(*)) // (2 * count(*)))::double / 100 as score, count(*) as results from mining_results group by 1", "mining_results")
def average_scores(r: Roles) -> DataFrame:
    return r.mining_results.groupBy("job_id").agg(F.round(F.avg(F.col("score").cast("decimal(18,2)")), 2).cast("double").alias("score"), F.count("*").alias("results"))


@query("latest_by_kind", "select distinct on (campaign_id, event_type) campaign_id, event_type, id, person_id from campaign_events order by campaign_id, event_type, occurred_at desc, id desc", "campaign_events")
def latest_by_kind(r: Roles) -> DataFrame:
    return rel.distinct_on(r.campaign_events, ["campaign_id", "event_type"], [F.desc("occurred_at"), F.desc("id")]).select("campaign_id", "event_type", "id", "person_id")


@query("enrichment_rate", """select organizer_id, count(*) as people, round((count(*) filter (where trim(first_name) <> '') + count(*) filter (where trim(last_name) <> '') + count(verification_status) + count(stage_id) + count(stage_entered_at)) / (5.0 * count(*)), 4)::double as rate
    from persons group by 1""", "persons")  # fmt: skip
def enrichment_rate(r: Roles) -> DataFrame:
    return rel.enrichment(r.persons, "organizer_id", ["first_name", "last_name", "verification_status", "stage_id", "stage_entered_at"]).withColumnRenamed("rows", "people")


@query("events_once", "select event_type, count(*) as events, min(id) as first from campaign_events e where not exists (select 1 from campaign_events f where f.person_id = e.person_id and f.campaign_id = e.campaign_id and f.event_type = e.event_type and f.id < e.id) group by 1", "campaign_events")
def events_once(r: Roles) -> DataFrame:
    kept = rel.keep_least(r.campaign_events, ["person_id", "campaign_id", "event_type"], "id")
    return kept.groupBy("event_type").agg(F.count("*").alias("events"), F.min("id").alias("first"))


@query("events_with_names", "select name, count(*) as events from campaign_events e join campaigns c on c.id = e.campaign_id group by 1", "campaign_events campaigns")
def events_with_names(r: Roles) -> DataFrame:
    return rel.lookup(r.campaign_events, r.campaigns.select(F.col("id").alias("campaign_id"), "name"), "campaign_id").groupBy("name").agg(F.count("*").alias("events"))


@query("recipients_held", """select case when c.visibility = 'private' then 'held' else r.status end as status, count(*) as n from recipients r left join campaigns c on c.id = r.campaign_id
    where not exists (select 1 from unsubscribes u where u.id = r.person_id) group by 1""", "recipients campaigns unsubscribes")  # fmt: skip
def recipients_held(r: Roles) -> DataFrame:
    kept = r.recipients.join(r.unsubscribes.select(F.col("id").alias("person_id")), "person_id", "left_anti")
    out = rel.update_from(kept, r.campaigns.filter("visibility = 'private'").select(F.col("id").alias("campaign_id"), F.lit("held").alias("status")), ["campaign_id"], ["status"])
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query("reply_owners", """with p as (select lower(email) as e, min(id) as i from persons where id % 3 = 0 group by 1), q as (select lower(email) as e, min(id) as i from prospects group by 1)
    select e.id, coalesce(x.person_id, p.i, q.i) as owner from campaign_events e left join recipients x on x.id = e.person_id and x.id % 5 = 0 left join p on p.e = lower(e.email) left join q on q.e = lower(e.email) where e.event_type = 'reply'""",
    "persons prospects campaign_events recipients")
def reply_owners(r: Roles) -> DataFrame:
    replies = r.campaign_events.filter("event_type = 'reply'").select("id", "person_id", F.lower("email").alias("e"))
    by = lambda df: df.groupBy(F.lower("email").alias("e")).agg(F.min("id").alias("i"))
    direct = r.recipients.filter("id % 5 = 0").select(F.col("id").alias("person_id"), F.col("person_id").alias("i"))
    return rel.first_match(replies, [(direct, ["person_id"], "i"), (by(r.persons.filter("id % 3 = 0")), ["e"], "i"), (by(r.prospects), ["e"], "i")], "owner").select("id", "owner")


@query("users_by_rank", "select id, role from users order by case role when 'owner' then 1 when 'admin' then 2 when 'manager' then 3 else 4 end, name desc limit 6", "users")
def users_by_rank(r: Roles) -> DataFrame:
    return r.users.orderBy(rel.ranked("role", ["owner", "admin", "manager"]), F.desc("name")).limit(6).select("id", "role")


@query("next_events", "select id, event_type from campaign_events where id > 500 order by id limit 100", "campaign_events")
def next_events(r: Roles) -> DataFrame:
    return rel.after(r.campaign_events, "id", 500, 100).select("id", "event_type")


@query("address_sets", """with a as (select distinct lower(email) as e from persons where id % 2 = 0), b as (select distinct lower(email) as e from prospects where id % 3 = 0 and trim(email) <> '')
    select (select count(*) from (select e from a union select e from b)) as either, (select count(*) from (select e from a intersect select e from b)) as both, (select count(*) from (select e from a except select e from b)) as first_only""", "persons prospects")  # fmt: skip
def address_sets(r: Roles) -> DataFrame:
    a = r.persons.filter("id % 2 = 0").select(F.lower("email").alias("e"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = r.prospects.filter("id % 3 = 0 and trim(email) != ''").select(F.lower("email").alias("e"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    held = a.unionByName(b).groupBy("e").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return held.agg(F.count("*").alias("either"), F.count_if(F.expr("a = 1 and b = 1")).alias("both"), F.count_if(F.expr("a = 1 and b = 0")).alias("first_only"))


@query("merged_json", """with m as (select id, json_merge_patch(json_object('a', cast(id as varchar), 'b', coalesce(last_name, '')), json_object('b', email, 'c', cast(organizer_id as varchar))) as j from persons)
    select id, json_extract_string(j, '$.a') as a, json_extract_string(j, '$.b') as b, json_extract_string(j, '$.c') as c from m""", "persons")  # fmt: skip
def merged_json(r: Roles) -> DataFrame:
    old = F.to_json(F.struct(F.col("id").cast("string").alias("a"), F.coalesce("last_name", F.lit("")).alias("b")))
    new = F.to_json(F.struct(F.col("email").alias("b"), F.col("organizer_id").cast("string").alias("c")))
    m = r.persons.select("id", rel.json_merge(old, new).alias("j"))
    return m.select("id", *[F.get_json_object("j", f"$.{k}").alias(k) for k in "abc"])


_TREE = "with recursive up as (select id as owner, reports_to as boss from users where reports_to is not null union all select up.owner, u.reports_to from up join users u on u.id = up.boss where u.reports_to is not null)"


@query("upward_campaigns", f"{_TREE} select id from campaigns c where visibility = 'shared' or created_by = 2 or exists (select 1 from up where up.owner = c.created_by and up.boss = 2)", "users campaigns")
def upward_campaigns(r: Roles) -> DataFrame:
    return scope.visible(r.campaigns, "created_by", "visibility", scope.closure(r.users), 2, "manager").select("id")


@query("access_checks", f"{_TREE} select u.id as viewer, count(*) as campaigns from users u join campaigns c on c.created_by = u.id or u.role in ('owner', 'admin') or exists (select 1 from up where up.owner = c.created_by and up.boss = u.id) group by 1", "users campaigns")
def access_checks(r: Roles) -> DataFrame:
    return scope.access_counts(r.users, scope.closure(r.users), r.campaigns, "created_by").withColumnRenamed("rows", "campaigns")


@query("team_people", "select organizer_id, count(*) as people from persons where owner_id in (1, 3, 5) group by 1", "persons")
def team_people(r: Roles) -> DataFrame:
    return scope.team_scoped(r.persons, "owner_id", [1, 3, 5]).groupBy("organizer_id").agg(F.count("*").alias("people"))


_SEQUENCES = f"""seq as (select id as person_id, campaign_id, cast(id % 4 as int) as current_step, case cast(id % 3 as int) when 0 then 'active' when 1 then 'paused' else 'completed' end as status,
    {_DAYS} * (id % 900) as next_send_at, case when id % 5 > 0 then {_DAYS} * (id % 700) end as last_sent_at, lower(concat('c', cast(id % 1400 as varchar), '@', 'd', cast(id % 37 as varchar), '.example')) as email from recipients)"""
_STEPS = "steps as (select c.id as campaign_id, s as sequence_order, s + 1 as delay_days, case s when 1 then 'no_reply' when 2 then 'no_open' else 'always' end as condition from campaigns c, (values (0), (1), (2)) as t(s))"


def sequences(r: Roles) -> DataFrame:
    when = lambda n: F.expr(f"{_DAYS} * (id % {n})")
    status = F.when(F.col("id") % 3 == 0, "active").when(F.col("id") % 3 == 1, "paused").otherwise("completed")
    email = F.concat(F.lit("c"), (F.col("id") % 1400).cast("string"), F.lit("@d"), (F.col("id") % 37).cast("string"), F.lit(".example"))
    return r.recipients.select(
        F.col("id").alias("person_id"), "campaign_id", (F.col("id") % 4).cast("int").alias("current_step"), status.alias("status"), when(900).alias("next_send_at"), F.when(F.col("id") % 5 > 0, when(700)).alias("last_sent_at"), email.alias("email")
    )


def steps(r: Roles) -> DataFrame:
    s = F.explode(F.array(*map(F.lit, (0, 1, 2))))
    d = r.campaigns.select(F.col("id").alias("campaign_id"), s.alias("sequence_order"))
    return d.select("campaign_id", "sequence_order", (F.col("sequence_order") + 1).alias("delay_days"), F.when(F.col("sequence_order") == 1, "no_reply").when(F.col("sequence_order") == 2, "no_open").otherwise("always").alias("condition"))


@query("sequences_resumed", f"""with {_SEQUENCES}, {_STEPS}
    select person_id, 'active' as status, case when last_sent_at is not null then last_sent_at + interval '1' day * coalesce(s.delay_days, 0) else timestamp '{AS_OF}' end as next_send_at
    from seq left join steps s on s.campaign_id = seq.campaign_id and s.sequence_order = seq.current_step where seq.campaign_id = 3 and seq.status = 'paused'
    union all select person_id, status, next_send_at from seq where campaign_id = 3 and status <> 'paused'""", "recipients campaigns")  # fmt: skip
def sequences_resumed(r: Roles) -> DataFrame:
    return rules.resume(sequences(r).filter("campaign_id = 3"), steps(r), AS_OF).select("person_id", "status", "next_send_at")


@query("sequences_paused", f"with {_SEQUENCES} select case when campaign_id = 3 and status = 'active' then 'paused' else status end as status, count(*) as n from seq group by 1", "recipients")
def sequences_paused(r: Roles) -> DataFrame:
    return rules.pause(sequences(r), 3).groupBy("status").agg(F.count("*").alias("n"))


@query("sequences_due", f"""with {_SEQUENCES}, {_STEPS}, due as (select * from seq where status = 'active' and next_send_at <= timestamp '{AS_OF}' order by next_send_at, campaign_id, person_id limit 50),
    seen as (select campaign_id, person_id, count(*) filter (where event_type = 'reply') as replies, count(*) filter (where event_type = 'open') as opens from campaign_events group by 1, 2)
    select d.campaign_id, d.person_id, d.current_step, case when h.condition is null then 'complete' when h.condition = 'no_reply' and coalesce(replies, 0) > 0 then 'skip' when h.condition = 'no_open' and coalesce(opens, 0) > 0 then 'skip' else 'send' end as action,
        case when n.delay_days is not null then d.current_step + 1 end as next_step, timestamp '{AS_OF}' + interval '1' day * n.delay_days as next_send_at
    from due d left join steps h on h.campaign_id = d.campaign_id and h.sequence_order = d.current_step left join steps n on n.campaign_id = d.campaign_id and n.sequence_order = d.current_step + 1
    left join seen s on s.campaign_id = d.campaign_id and s.person_id = d.person_id""", "recipients campaigns campaign_events")  # fmt: skip
def sequences_due(r: Roles) -> DataFrame:
    return ev.advance_sequences(sequences(r), steps(r), r.campaign_events, AS_OF)


@query("sequences_stopped", f"""with {_SEQUENCES}, k as (select lower(email) as e, campaign_id as c, min(event_type) as kind from campaign_events where event_type in ('bounce', 'reply') group by 1, 2)
    select case when s.status <> 'active' then s.status when exists (select 1 from unsubscribes u where lower(u.email) = s.email) then 'unsubscribed' when k.kind = 'bounce' then 'bounced' when k.kind = 'reply' then 'replied' else s.status end as status, count(*) as n
    from seq s left join k on k.e = s.email and k.c = s.campaign_id group by 1""", "recipients campaign_events unsubscribes")  # fmt: skip
def sequences_stopped(r: Roles) -> DataFrame:
    out = r.campaign_events.filter("event_type in ('bounce', 'reply')").select("email", "campaign_id", F.col("event_type").alias("kind"))
    out = out.unionByName(r.unsubscribes.select("email", F.lit(None).cast("int").alias("campaign_id"), F.lit("unsubscribe").alias("kind")))
    return ev.stop_sequences(sequences(r), out).groupBy("status").agg(F.count("*").alias("n"))


@query("sequences_exhausted", f"""with {_SEQUENCES} select distinct person_id from seq s where status = 'completed' and not exists (select 1 from campaign_events e where e.event_type = 'reply' and e.person_id = s.person_id and e.campaign_id = s.campaign_id)
    and not exists (select 1 from action_items i where i.person_id = s.person_id and i.status in ('open', 'in_progress') and i.trigger_reason = 'sequence_exhausted')""", "recipients campaign_events action_items")  # fmt: skip
def sequences_exhausted(r: Roles) -> DataFrame:
    return ev.sequence_exhausted(sequences(r), r.campaign_events, r.action_items)


@query("events_attributed", """with k as (select lower(trim(p.email)) as e, r.id, r.status in ('sent', 'delivered', 'opened', 'clicked') as live, r.sent_at from recipients r join persons p on p.id = r.person_id),
    f as (select * from (select *, row_number() over (partition by e order by live desc, sent_at desc, id desc) as n from k) where n = 1)
    select c.id, f.id as recipient_id from campaign_events c join f on f.e = lower(trim(c.email))""", "recipients persons campaign_events")  # fmt: skip
def events_attributed(r: Roles) -> DataFrame:
    known = r.recipients.join(r.persons.select(F.col("id").alias("person_id"), "email"), "person_id").select(F.col("id").alias("recipient_id"), "email", "status", F.col("sent_at").alias("created_at"))
    return ev.attribute(r.campaign_events, known).select("id", "recipient_id")


@query("reply_items", """with e as (select *, row_number() over (partition by person_id, organizer_id order by occurred_at desc, id desc) as n from campaign_events where event_type = 'reply' and person_id is not null)
    select e.person_id, e.organizer_id, e.campaign_id, c.created_by as assigned_to, coalesce('Reply received: "' || substr(e.reason, 1, 80) || '"', 'Reply received from campaign "' || c.name || '"') as trigger_detail, 1 as priority, e.occurred_at as last_activity_at
    from e join campaigns c on c.id = e.campaign_id where n = 1""", "campaign_events campaigns")  # fmt: skip
def reply_items(r: Roles) -> DataFrame:
    return rules.reply_received(r.campaign_events, r.campaigns)


@query("items_refreshed", f"""with n as (select person_id, 'engaged_hot' as trigger_reason, 'again' as detail, max(occurred_at) as at from campaign_events where event_type = 'click' group by 1),
    o as (select id, person_id, trigger_reason, 'first' as detail, due_at as at, status from action_items),
    live as (select * from o where status in ('open', 'in_progress') and trigger_reason <> 'reply_received')
    select o.person_id, o.trigger_reason, coalesce(case when live.id is not null then n.detail end, o.detail) as detail, coalesce(case when live.id is not null then n.at end, o.at) as at, o.status from o left join live on live.id = o.id left join n on n.person_id = live.person_id and n.trigger_reason = live.trigger_reason
    union all select n.person_id, n.trigger_reason, n.detail, n.at, 'open' from n where not exists (select 1 from live where live.person_id = n.person_id and live.trigger_reason = n.trigger_reason)""", "campaign_events action_items")  # fmt: skip
def items_refreshed(r: Roles) -> DataFrame:
    new = r.campaign_events.filter("event_type = 'click'").groupBy("person_id").agg(F.max("occurred_at").alias("at")).withColumns({"trigger_reason": F.lit("engaged_hot"), "detail": F.lit("again")})
    old = r.action_items.select("person_id", "trigger_reason", F.lit("first").alias("detail"), F.col("due_at").cast("timestamp").alias("at"), "status")
    return rules.upsert_items(old, new, ["detail", "at"])


@query("people_staged", """select p.id, case when exists (select 1 from campaign_events e where e.person_id = p.id and e.event_type = 'reply') and (stage_id is null or stage_id in (0, 1)) then 2 else stage_id end as stage_id,
    (exists (select 1 from campaign_events e where e.person_id = p.id and e.event_type = 'reply') and (stage_id is null or stage_id in (0, 1))) as moved from persons p""", "persons campaign_events")  # fmt: skip
def people_staged(r: Roles) -> DataFrame:
    return rules.stage_on_reply(r.persons.select("id", "stage_id"), r.campaign_events, early=[0, 1], interested=2)


@query("stale_jobs", f"with j as (select id, case when id % 2 = 0 then 'running' else 'done' end as status, {_DAYS} * (id % 800) as started_at from mining_results) select id, case when status = 'running' and started_at < timestamp '{AS_OF}' - interval '1' hour then 'failed' else status end as status from j", "mining_results")
def stale_jobs(r: Roles) -> DataFrame:
    jobs = r.mining_results.select("id", F.when(F.col("id") % 2 == 0, "running").otherwise("done").alias("status"), F.expr(f"{_DAYS} * (id % 800)").alias("started_at"))
    return rules.fail_stale(jobs, AS_OF).select("id", "status")


@query("items_unsnoozed", f"with i as (select id, status, {_DAYS} * (id % 1500) as until from action_items) select case when status = 'snoozed' and until <= timestamp '{AS_OF}' then 'open' else status end as status, count(*) as n, count(case when not (status = 'snoozed' and until <= timestamp '{AS_OF}') then until end) as waiting from i group by 1", "action_items")
def items_unsnoozed(r: Roles) -> DataFrame:
    i = ev.unsnooze(r.action_items.select("id", "status", F.expr(f"{_DAYS} * (id % 1500)").alias("snoozed_until")), AS_OF)
    return i.groupBy("status").agg(F.count("*").alias("n"), F.count("snoozed_until").alias("waiting"))


@query("crawls_ended", """with p as (select cast(floor(c_custkey / 20) as bigint) as job_id, c_custkey % 20 as page, case when c_custkey % 20 > 12 or c_custkey % 7 = 0 then 0 else 5 end as contacts, cast(floor((c_custkey % 20) / (1 + floor(c_custkey / 20) % 4)) as varchar) as h from customer),
    f as (select *, contacts = 0 as e0, (lag(contacts, 1) over w) = 0 as e1, (lag(contacts, 2) over w) = 0 as e2, h = (lag(h, 1) over w) as s1, (lag(h, 1) over w) = (lag(h, 2) over w) as s2 from p window w as (partition by job_id order by page))
    select job_id, min(case when (e0 and e1 and e2) or (s1 and s2) then page end) as stop_page from f group by 1""")  # fmt: skip
def crawls_ended(r: Roles) -> DataFrame:
    job, page = F.floor(F.col("c_custkey") / 20), F.col("c_custkey") % 20
    contacts = F.when((page > 12) | (F.col("c_custkey") % 7 == 0), 0).otherwise(5)
    pages = r.table("customer").select(job.alias("job_id"), page.alias("page"), contacts.alias("contacts"), F.floor(page / (1 + job % 4)).cast("string").alias("content_hash"))
    return ev.crawl_stop(pages)


@query("typed_json", """with m as (select id, json_merge_patch(json_object('a', id, 'b', last_name is null, 'd', json_object('x', organizer_id)), json_object('b', owner_id, 'c', json_array(id, 1))) as j from persons)
    select id, json_extract_string(j, '$.a') as a, json_extract_string(j, '$.b') as b, json_extract_string(j, '$.c[0]') as c0, json_extract_string(j, '$.d.x') as x,
      concat_ws(',', json_type(j, '$.a') = 'UBIGINT', json_type(j, '$.b') = 'UBIGINT', json_type(j, '$.c') = 'ARRAY', json_type(j, '$.d') = 'OBJECT') as kinds from m""", "persons")  # fmt: skip
def typed_json(r: Roles) -> DataFrame:
    old = F.to_json(F.struct(F.col("id").alias("a"), F.col("last_name").isNull().alias("b"), F.struct(F.col("organizer_id").alias("x")).alias("d")))
    new = F.to_json(F.struct(F.col("owner_id").alias("b"), F.array(F.col("id"), F.lit(1)).alias("c")))
    m = r.persons.select("id", F.parse_json(rel.json_merge(old, new)).alias("j"))
    kind = lambda path, name: F.startswith(F.schema_of_variant(F.variant_get("j", path, "variant")), F.lit(name)).cast("string")
    get = lambda path: F.variant_get("j", path, "string")
    kinds = F.concat_ws(",", kind("$.a", "BIGINT"), kind("$.b", "BIGINT"), kind("$.c", "ARRAY"), kind("$.d", "OBJECT"))
    return m.select("id", get("$.a").alias("a"), get("$.b").alias("b"), get("$.c[0]").alias("c0"), get("$.d.x").alias("x"), kinds.alias("kinds"))


@query("addresses_united", """with m as (select id, string_split(emails, ',') as e, ['first@d1.example', string_split(emails, ',')[1]] as more from mining_results)
    select id, array_to_string(list_sort(list_distinct(list_concat(e, more))), ',') as united, len(list_distinct(list_concat(e, more))) as n_united, len(list_concat(e, more)) as n_all from m""", "mining_results")  # fmt: skip
def addresses_united(r: Roles) -> DataFrame:
    m = r.mining_results.select("id", F.split("emails", ",").alias("e")).withColumn("more", F.array(F.lit("first@d1.example"), F.get("e", F.lit(0))))
    united = F.array_union("e", "more")
    return m.select("id", F.array_join(F.sort_array(united), ",").alias("united"), F.size(united).cast("long").alias("n_united"), F.size(F.concat("e", "more")).cast("long").alias("n_all"))


@query("person_has_intent", "select p.id from persons p where exists (select 1 from campaign_events e where e.person_id = p.id and e.event_type in ('reply', 'click'))", "persons campaign_events")
def person_has_intent(r: Roles) -> DataFrame:
    strong = r.campaign_events.filter(F.col("event_type").isin("reply", "click")).select(F.col("person_id").alias("id"))
    return r.persons.select("id").join(strong, "id", "left_semi")


@query("prospects_without_tags", "select list_id, prospect_id from list_members where coalesce(len(string_split(nullif(tags, ''), ',')), 0) = 0", "list_members")
def prospects_without_tags(r: Roles) -> DataFrame:
    tags = F.filter(F.split("tags", ","), lambda x: x != "")
    return r.list_members.filter(F.coalesce(F.size(tags), F.lit(0)) == 0).select("list_id", "prospect_id")


@query("contacts_by_source", """select source, count(*) as contacts, count(email) as addressed, count(distinct lower(trim(email))) as addresses, count(phone) filter (where email is null) as only_phone
    from contacts group by 1""", "contacts")  # fmt: skip
def contacts_by_source(r: Roles) -> DataFrame:
    return r.contacts.groupBy("source").agg(F.count("*").alias("contacts"), F.count("email").alias("addressed"), F.countDistinct(F.lower(F.trim("email"))).alias("addresses"), F.count(F.when(F.col("email").isNull(), F.col("phone"))).alias("only_phone"))

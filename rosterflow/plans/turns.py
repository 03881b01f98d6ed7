"""Queries over tables in texts, miners in turn, blocked pages, and the rules with scores, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import company as co
from ..functions import contact as ct
from ..functions import email as em
from ..functions import mining as mn
from ..operators import events as ev
from ..operators import miners, rules, tables
from ..operators import normalize as nz
from ..registry import query
from ..roles import AS_OF, Roles
from .enrich import _ATLAS as ATLAS


def scratch(r: Roles, name: str) -> str:
    """A new folder that all executors share; only a session in one JVM may do without the setting."""
    root = r.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = r.spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    path = f"{root.rstrip('/')}/rosterflow-{uuid.uuid4().hex}"
    folder = r.spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(r.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return f"{path}/{name}"


def guest_lists(r: Roles) -> DataFrame:
    """Texts of 20 customers each, as a table with tabs, bars or commas, every other one with a header, between lines of prose."""
    c = r.table("customer").withColumn("id", F.floor(F.col("c_custkey") / 20))
    key = F.col("c_custkey").cast("string")
    cells = [F.concat(F.lit("Guest "), F.translate(key, "0123456789", "abcdefghij")), F.concat(F.lit("Firm "), key, F.lit(" GmbH")), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("G"), key, F.lit("@firm.com"))), F.concat(F.lit("+49 30 "), (1000000 + F.col("c_custkey")).cast("string"))]
    mark = lambda t, b, c: F.when(F.col("id") % 3 == 0, t).when(F.col("id") % 3 == 1, b).otherwise(c)
    quoted = [F.concat(F.lit('"'), x, F.lit('"')) if k == 1 else x for k, x in enumerate(cells)]
    row = mark(F.concat_ws("\t", *cells), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), F.concat_ws(",", *quoted))
    head = mark(F.lit("Name\tCompany\tE-mail\tPhone"), F.lit("| Ad Soyad | Firma | Mail | Tel |"), F.lit("Nom,Société,Courriel,Téléphone"))
    rows = c.select("id", "c_custkey", row.alias("row"), F.when(F.col("id") % 2 == 0, head).alias("head"))
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "row")))["row"].alias("rows"), F.first("head").alias("head"))  # 20 rows a text
    return lists.select("id", F.array_join(F.concat(F.array(F.lit("Dear all, these come"), F.lit("")), F.filter(F.array("head"), lambda x: x.isNotNull()), "rows", F.array(F.lit(""), F.lit("Yours, the desk"))), "\n").alias("text"))


@query("sheets_mined", """with c as (select c_custkey as k, c_custkey // 20 as id, row_number() over (partition by c_custkey // 20 order by c_custkey) as n from customer),
    e as (select *, count(*) over (partition by id) as size, count(*) filter (where k % 7 > 0) over (partition by id) as mails from c)
    select id, (n + 1 + case when id % 2 = 0 then 1 else 0 end)::int as line, 'g' || k || '@firm.com' as email, 'Guest ' || case when true then translate(k::varchar, '0123456789', 'abcdefghij') end as name, 'Firm ' || k || ' GmbH' as company, '+49 30 ' || (1000000 + k) as phone
    from e where k % 7 > 0 and (size >= 2 or id % 2 = 0) and (id % 2 = 0 or 2 * mails >= size)""")  # fmt: skip
def sheets_mined(r: Roles) -> DataFrame:
    return tables.mine_tables(guest_lists(r)).select("id", "line", "email", "name", "company", "phone")


_LABELS = "|".join(w.replace("/", "\\/") for w in sorted(miners.FIELD_OF, key=len, reverse=True))


@query("miners_in_turn", f"""with d as (select doc_id as id, text from documents), l as (select id, trim(unnest(string_split_regex(text, '\\r?\\n'))) as line from d),
    a as (select distinct id from l where regexp_matches(line, '(?i)^({_LABELS})\\s*[:\\-]\\s*.*{em.PATTERN}')),
    b as (select id from d where id not in (select id from a) and regexp_matches(text, '{em.PATTERN}'))
    select id, case when trim(coalesce(text, '')) = '' then 'EMPTY' when id in (select id from a) or id in (select id from b) then 'SUCCESS' else 'FAILED' end as status,
      case when trim(coalesce(text, '')) = '' then null when id in (select id from a) then 'labels' else 'addresses' end as miner from d""")  # fmt: skip
def miners_in_turn(r: Roles) -> DataFrame:
    folder = scratch(r, "stages")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return r.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    states, _ = tables.mine_in_turn(r.table("documents"), [("labels", miners.mine_labels), ("addresses", miners.mine_addresses)], keep, "doc_id", "text")
    return states.select("id", "status", "miner")


_HEAD = r"""regexp_extract(lower(html), '<title[^>]*>([^\r\n]*?)</title>', 1) || ' ' || regexp_extract(lower(html), '<h1[^>]*>([^\r\n]*?)</h1>', 1)"""


@query("pages_blocked", f"""with p as (select page_id, html, lower(html) as low, {_HEAD} as head from (select page_id, case page_id % 4 when 0 then html || '<p>too many requests</p>' when 1 then replace(html, '<title>', '<title>Captcha ') when 2 then substr(html, 1, 400 + page_id::int) else repeat(html, 4) end as html from pages))
    select page_id, case when length(coalesce(html, '')) < 500 then 'Content too short'
      when length(html) < 10000 and list_any_value(list_filter({list(ct.BLOCK_WORDS)}, lambda w: contains(low, w))) is not null then 'Contains block indicator: ' || list_any_value(list_filter({list(ct.BLOCK_WORDS)}, lambda w: contains(low, w)))
      when length(html) >= 10000 and list_any_value(list_filter({list(ct.BLOCK_WORDS)}, lambda w: contains(head, w))) is not null then 'Title/H1 contains block indicator: ' || list_any_value(list_filter({list(ct.BLOCK_WORDS)}, lambda w: contains(head, w)))
      when not regexp_matches(low, '<html|<body|</html>|</body>') then 'Missing HTML structure'
      when length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g')) < 100 then 'Very low text content' end as reason from p""")  # fmt: skip
def pages_blocked(r: Roles) -> DataFrame:
    k = F.col("page_id") % 4
    html = F.when(k == 0, F.concat("html", F.lit("<p>too many requests</p>"))).when(k == 1, F.replace("html", F.lit("<title>"), F.lit("<title>Captcha "))).when(k == 2, F.substring("html", F.lit(1), (400 + F.col("page_id")).cast("int"))).otherwise(F.repeat("html", 4))
    return r.table("pages").withColumn("html", html).select("page_id", ct.blocked_page(F.col("html")).alias("reason"))


@query("contact_scores_weighted", """select id, least(100.0, (case when trim(coalesce(email, '')) <> '' then 30 else 0 end + case when trim(coalesce(contact_name, '')) <> '' then 20 + case when trim(contact_name) like '% %' and length(trim(contact_name)) >= 5 then 5 else 0 end else 0 end
      + case when trim(coalesce(company_name, '')) <> '' then 15 + case when regexp_matches(company_name, '(?i)\\b(ltd|inc|corp|llc|gmbh|ag)\\b') then 3 else 0 end else 0 end + case when trim(coalesce(phone, '')) <> '' then 15 + case when trim(phone) like '+%' then 3 else 0 end else 0 end
      + case when trim(coalesce(country, '')) <> '' then 5 else 0 end + case when trim(coalesce(website, '')) <> '' then 5 + case when website like 'https://%' then 2 else 0 end else 0 end + case when trim(coalesce(city, '')) <> '' then 3 else 0 end) / 98.0::double * 100) as score from contacts""", "contacts")  # fmt: skip
def contact_scores_weighted(r: Roles) -> DataFrame:
    fields = {"email": "email", "name": "contact_name", "company": "company_name", "phone": "phone", "country": "country", "website": "website", "city": "city"}
    return r.contacts.select("id", ct.weighted_score({k: F.col(c) for k, c in fields.items()}).alias("score"))


#: A third of the people never reply.
QUIET = "case when event_type = 'reply' and person_id % 3 = 0 then 'deferred' else event_type end"


@query("engaged_hot_all", f"""with e as (select * replace ({QUIET} as event_type) from campaign_events),
    a as (select person_id, count(distinct cast(occurred_at as date)) as days, arg_max(campaign_id, (occurred_at, id)) as campaign_id, max(occurred_at) as seen from e where event_type = 'open' and occurred_at >= timestamp '{AS_OF}' - interval 7 day group by 1 having count(distinct cast(occurred_at as date)) >= 2),
    c as (select *, row_number() over (partition by person_id order by occurred_at desc, id desc) as rn from e where event_type = 'click' and occurred_at >= timestamp '{AS_OF}' - interval 30 day),
    d as (select person_id, arg_max(campaign_id, (occurred_at, id)) as campaign_id, arg_max(url, (occurred_at, id)) as url, max(occurred_at) as seen from c where rn <= 5 and regexp_matches(lower(url), 'floorplan|pricing|register|book|stand|booth') group by 1),
    f as (select person_id, 'Opened on ' || days || ' different days in the last week' as reason, campaign_id, seen from a union all select person_id, 'Clicked high-value link: ' || substr(url, 1, 80), campaign_id, seen from d where person_id not in (select person_id from a))
    select person_id, reason, campaign_id, seen as last_activity_at, (select coalesce(sum(case event_type when 'open' then 1 when 'click' then 3 when 'reply' then 10 else 0 end), 0)::bigint from e where e.person_id = f.person_id and e.occurred_at >= timestamp '{AS_OF}' - interval 30 day) as engagement_score
    from f where person_id not in (select person_id from e where event_type = 'reply') and person_id not in (select person_id from action_items where trigger_reason = 'engaged_hot' and status in ('open', 'in_progress'))""", "campaign_events action_items")  # fmt: skip
def engaged_hot_all(r: Roles) -> DataFrame:
    hot = ev.engaged_hot(r.campaign_events.withColumn("event_type", F.expr(QUIET)), r.action_items, AS_OF)
    return hot.withColumn("engagement_score", F.col("engagement_score").cast("long"))


@query("item_scores_refreshed", f"""select i.id, case when i.status in ('open', 'in_progress') then coalesce(s.score, 0) else -1 end as engagement_score from action_items i left join (
      select person_id, (sum(case event_type when 'open' then 1 when 'click' then 3 when 'reply' then 10 else 0 end) + case when max(occurred_at) < timestamp '{AS_OF}' - interval 7 day then -2 else 0 end)::bigint as score from campaign_events where person_id % 5 > 0 or occurred_at < timestamp '2024-01-20 00:00:00' group by 1) s on s.person_id = i.person_id""", "action_items campaign_events")  # fmt: skip
def item_scores_refreshed(r: Roles) -> DataFrame:
    """Scores as of ten days before, then brought up to date from what changed. A fifth of the people falls silent between."""
    events = r.campaign_events.filter("person_id % 5 > 0 or occurred_at < timestamp '2024-01-20 00:00:00'")
    items = r.action_items.withColumn("engagement_score", F.lit(-1).cast("long"))
    before = rules.refresh_scores(items, events, "2024-01-21 00:00:00")
    return rules.refresh_scores(before, events, AS_OF, since="2024-01-21 00:00:00").select("id", "engagement_score")


_GOOD = "case when length({x}) between 2 and 200 and regexp_matches({x}, '[a-zA-ZÀ-ÿ]') and lower({x}) not in " + str(co.PAGE_WORDS) + " then {x} end"


def _company(x: str) -> str:
    return _GOOD.replace("{x}", f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))")


def _plain(pattern: str) -> str:
    """A pattern for the SQL side, where words are of ASCII letters as well, and letters of any script fold."""
    return pattern.replace("(?iu)", "(?i)").replace("'", "''")


_PLACES = ", ".join(_company(f"regexp_extract(c, '{_plain(p)}', 1)") for p in co.PLACES)
_BARE = "case " + " ".join(f"when ends_with(host, '{e}') then left(host, length(host) - {len(e)})" for e in co.ENDINGS) + " else host end"
_NAMES = ", ".join(
    f"case when length(regexp_extract(c, '{_plain(p)}', 1)) between 2 and 50 and length(regexp_extract(c, '{_plain(p)}', 2)) between 2 and 50 and lower(regexp_extract(c, '{_plain(p)}', 1)) not in {tuple(mn.TITLES)} "
    f"and lower(regexp_extract(c, '{_plain(p)}', 2)) not in {tuple(mn.SUFFIXES)} then regexp_extract(c, '{_plain(p)}', 1) || ' ' || regexp_extract(c, '{_plain(p)}', 2) end"
    for p in mn.NAME_PLACES
)
_POSITIONS = ", ".join(f"case when length(trim(regexp_extract(c, '{_plain(p)}', 0))) between 2 and 100 then trim(regexp_extract(c, '{_plain(p)}', 0)) end" for p in mn.POSITIONS)
_SOCIAL = "|".join(x.replace(".", "\\.") for x in co.SOCIAL)


@query("candidates_normalized", f"""with n(name, code) as (values {", ".join(map(str, ATLAS))}),
    e as (select distinct doc_id as id, text, lower(x) as email from (select doc_id, text, unnest(regexp_extract_all(text, '{em.PATTERN}')) as x from (select doc_id, replace(text, 'example.', 'acme-tools.') as text from documents))),
    g as (select *, instr(lower(text), email) as pos from e where length(email) between 5 and 254 and length(email) - length(replace(email, '@', '')) = 1 and length(split_part(email, '@', 1)) <= 64 and not regexp_matches(email, '{nz.NO_ADDRESS}') and not regexp_matches(email, '{nz.NO_PERSON}')),
    k as (select id, email, split_part(email, '@', 2) as host, split_part(email, '@', 1) as desk, regexp_replace(substr(text, greatest(pos - 50, 1), pos - greatest(pos - 50, 1) + length(email) + 50), '^\\s+|\\s+$', '', 'g') as c from g),
    w as (select *, list_filter(string_split_regex(regexp_replace({_BARE}, '^www\\.', ''), '[-_.]'), lambda x: x <> '') as words, ' ' || regexp_replace(lower(c), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ' as spaced, regexp_extract(c, '\\b([A-Z]{{2}})\\b', 1) as pair,
      list_filter(regexp_extract_all(c, '(?i)https?://[^\\s<>"]+'), lambda u: not regexp_matches(lower(u), '{_SOCIAL}')) as links from k)
    select id, email, case when desk in {tuple(mn.DESK_PREFIXES)} then null else coalesce({_NAMES}, case when regexp_matches(desk, '^[a-z]+[._][a-z]+$') and length(regexp_extract(desk, '^([a-z]+)', 1)) between 2 and 50 and length(regexp_extract(desk, '([a-z]+)$', 1)) between 2 and 50
        then upper(desk[1]) || regexp_extract(desk, '^.([a-z]*)', 1) || ' ' || upper(regexp_extract(desk, '[._](.)', 1)) || regexp_extract(desk, '[._].(.*)$', 1) end) end as name,
      coalesce({_PLACES}, case when host not in {co.PROVIDERS} then {_company("array_to_string(list_transform(words, lambda x: upper(x[1]) || x[2:]), ' ')")} end) as company_name,
      coalesce(links[1], case when host not in {co.SITELESS_PROVIDERS} then 'https://' || host end) as website, coalesce({_POSITIONS}) as position,
      coalesce((select first(code order by length(name) desc, name) from n where contains(w.spaced, ' ' || name || ' ')), case when pair in (select code from n) then pair end) as country_code, left(c, 200) as snippet from w""")  # fmt: skip
def candidates_normalized(r: Roles) -> DataFrame:
    # all addresses of the supplied texts are examples, which no candidate may be: they get another host
    texts = r.table("documents").select("doc_id", F.replace("text", F.lit("example."), F.lit("acme-tools.")).alias("text"))
    c = nz.candidates_of(texts, dict(ATLAS), "doc_id")
    name = F.when(F.col("first_name").isNotNull(), F.concat_ws(" ", "first_name", "last_name"))
    return c.select("id", "email", name.alias("name"), "company_name", "website", "position", "country_code", "snippet")

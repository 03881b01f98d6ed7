"""Field functions, merges and miners, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contact as co
from ..functions import email as em
from ..functions import mining as mi
from ..operators import merge, miners
from ..registry import query
from ..roles import Roles


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query("mailboxes", f"""with c as (select id, email, lower(email) as l, trim(lower(email)) as t, split_part(lower(email), '@', 1) as p, split_part(lower(email), '@', 2) as d from contacts)
    select id, coalesce(p in ({_list(em.GENERIC_PREFIXES)}), false) as generic, email is null or p in ({_list(em.JUNK_PREFIXES)}) or len(list_filter([{_list(em.JUNK_DOMAINS)}], lambda x: d = x or ends_with(d, '.' || x))) > 0 as junk,
    case when email is null then 'unknown' when regexp_matches(l, '^(info|contact|sales|support|hello|enquiry|enquiries|office|admin|mail|general)@') then 'generic' when regexp_matches(l, '^(ceo|cfo|cto|hr|marketing|pr|legal|accounting)@') then 'role'
        when regexp_matches(p, '^[a-z]+[._]?[a-z]+$') then 'personal' else 'unknown' end as kind,
    email is null or len(list_filter([{_list(em.GARBAGE_HOSTS)}], lambda x: ends_with(t, x))) > 0 or len(list_filter([{_list(em.GARBAGE_PARTS)}], lambda x: contains(t, x))) > 0 or regexp_matches(t, '[0-9][0-9][0-9][0-9][0-9][0-9]@') or regexp_matches(t, '^[a-z][a-z]?[0-9]+@')
        or split_part(t, '@', 2) in ({_list(em.THROW_AWAY)}) or length(split_part(t, '@', 1)) = 1 as garbage from c""", "contacts")  # fmt: skip
def mailboxes(r: Roles) -> DataFrame:
    e = F.col("email")
    return r.contacts.select("id", em.is_generic(e).alias("generic"), em.is_junk(e).alias("junk"), em.email_type(e).alias("kind"), em.is_garbage(e).alias("garbage"))


@query("phones", r"""with c as (select id, phone, trim(regexp_replace(phone, '^(tel:|phone:|mobile:|cell:|fax:|call:)', '', 'i')) as p from contacts)
    select id, case when length(regexp_replace(p, '[^0-9]', '', 'g')) between 7 and 16 then p end as clean, case when phone is null then '' when starts_with(trim(phone), '+') then '+' || regexp_replace(phone, '[^0-9]', '', 'g') else regexp_replace(phone, '[^0-9]', '', 'g') end as plain from c""", "contacts")  # fmt: skip
def phones(r: Roles) -> DataFrame:
    return r.contacts.select("id", co.clean_phone(F.col("phone")).alias("clean"), co.normalize_phone(F.col("phone")).alias("plain"))


_TITLED = "array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("names_cleaned", f"""with c as (select id, trim(regexp_replace(trim(contact_name), '^(name|contact)[\\s:]+', '', 'i')) as n, nullif(trim(regexp_replace(trim(company_name), '^company[\\s:]+', '', 'i')), '') as m, trim(regexp_replace(city, '\\s+', ' ', 'g')) as city from contacts)
    select id, case when strpos(n, '''') > 0 then n when n = upper(n) or n = lower(n) then {_TITLED.format(x='n')} else n end as name, case when m = upper(m) then {_TITLED.format(x='m')} else m end as company, city from c""", "contacts")  # fmt: skip
def names_cleaned(r: Roles) -> DataFrame:
    return r.contacts.select("id", co.clean_name(F.col("contact_name")).alias("name"), co.clean_company(F.col("company_name")).alias("company"), co.clean_text(F.col("city")).alias("city"))


@query("websites_cleaned", "select id, case when strpos(website, 'linkedin.com') = 0 then website end as website from contacts", "contacts")
def websites_cleaned(r: Roles) -> DataFrame:
    return r.contacts.select("id", co.clean_website(F.col("website")).alias("website"))


@query("names_from_addresses", """with c as (select id, split_part(lower(email), '@', 1) as p from contacts), m as (select id, regexp_extract(p, '^([a-z]+)[._]([a-z]+)$', 1) as a, regexp_extract(p, '^([a-z]+)[._]([a-z]+)$', 2) as b from c)
    select id, upper(a[1]) || a[2:] as first_name, upper(b[1]) || b[2:] as last_name from m where length(a) > 1 and length(b) > 1""", "contacts")  # fmt: skip
def names_from_addresses(r: Roles) -> DataFrame:
    return r.contacts.select("id", mi.person_name(F.col("email"), F.lit("")).alias("n")).filter("n is not null").select("id", "n.*")


@query("mineable_pages", """with p as (select page_id, len(regexp_extract_all(html, '@')) as emails, contains(html, '<table') as tables, len(regexp_extract_all(html, '<a ')) as links, octet_length(encode(html)) // 1024 as kb from pages)
    select page_id, least(100, greatest(0, 30 + case when emails > 10 then 30 when emails > 0 then 15 else 0 end + case when tables then 10 else 0 end + case when links > 50 then 10 else 0 end - case when kb < 5 then 15 else 0 end))::int as score from p""")  # fmt: skip
def mineable_pages(r: Roles) -> DataFrame:
    yes, no, html = F.lit(True), F.lit(False), F.col("html")
    tables, links = F.when(html.contains("<table"), 1).otherwise(0), F.regexp_count(html, F.lit("<a "))
    return r.table("pages").select("page_id", mi.mineability(yes, no, F.regexp_count(html, F.lit("@")), no, tables, links, no, no, no, F.floor(F.octet_length(html) / 1024)).alias("score"))


@query("deep_crawls", """with p as (select k as page, count(*) * 150 as contacts, avg(case when company_name <> '' then 1.0 else 0.0 end) as enriched, count(website) as sites from contacts group by 1)
    select page, case when contacts > 500 then case when enriched >= 0.5 then 'skip' else 'limited' end when enriched < 0.2 then 'full' when sites > 0 and contacts < 10 then 'full' else 'skip' end as decision from p""", "contacts")  # fmt: skip
def deep_crawls(r: Roles) -> DataFrame:
    p = r.contacts.groupBy(F.col("k").alias("page")).agg((F.count("*") * 150).alias("contacts"), F.avg(F.when(F.col("company_name") != "", 1.0).otherwise(0.0)).alias("enriched"), F.count("website").alias("sites"))
    return p.select("page", mi.deep_crawl(F.col("contacts"), F.col("enriched"), F.col("sites")).alias("decision"))


@query("organizers_own", """with c as (select id, 'https://www.plain.net/list' as url, case when email is null then [] else [trim(email)] end as e, 1 + id % 3 as n from contacts)
    select id, n <= 2 and len(e) > 0 and strpos('plain.net', split_part(lower(e[1]), '@', 2)) = 0 and strpos(split_part(lower(e[1]), '@', 2), 'plain.net') = 0 as own from c""", "contacts")  # fmt: skip
def organizers_own(r: Roles) -> DataFrame:
    emails = F.when(F.col("email").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.trim("email")))
    return r.contacts.select("id", mi.foreign_only(F.lit("https://www.plain.net/list"), emails, 1 + F.col("id") % 3).alias("own"))


@query("page_contents", r"select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as signature from pages")
def page_contents(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", co.content_signature(F.col("html")).alias("signature"))


@query("letters_rendered", """select id, 'Dear ' || coalesce(nullif(first_name, ''), nullif(last_name, ''), 'friend') || ', {{unknown}} ' || coalesce(email, '') as letter from persons""", "persons")
def letters_rendered(r: Roles) -> DataFrame:
    fields = F.create_map(F.lit("first_name"), "first_name", F.lit("last_name"), "last_name", F.lit("email"), "email")
    return r.persons.select("id", mi.render(F.lit('Dear {{First_Name|last_name|"friend"}}, {{unknown}} {{email}}'), fields).alias("letter"))


@query("texts_as_html", """select id, '<div style="font-family:Arial,Helvetica,sans-serif;font-size:14px;line-height:1.6;color:#333"><p>' || replace(replace(text, chr(10) || chr(10), '</p><p>'), chr(10), '<br>') || '</p></div>' as html from cards""", "cards")
def texts_as_html(r: Roles) -> DataFrame:
    return r.cards.select("id", co.text_to_html(F.col("text")).alias("html"))


@query("industries_known", """select id, case when i = 'Food' or i = 'food' then 'Food' when i = 'i1' then 'Industry One' when i = 'i10' then 'Industry Ten' when contains(i, 'ommerc') then 'Trade' else i end as industry from (select id, nullif(trim(industry), '') as i from affiliations)""", "affiliations")
def industries_known(r: Roles) -> DataFrame:
    return r.affiliations.select("id", mi.industry_of(F.col("industry"), {"i1": "Industry One", "i10": "Industry Ten", "commerce": "Trade"}, ("Food",)).alias("industry"))


@query("contacts_by_field", """with s as (select id, trim(lower(email)) as e, country, city, case when coalesce(trim(country), '') = '' then 0 else greatest(0, 10 + case when contains(trim(country), ':') or length(trim(country)) > 30 then 0 else 15 end - case when regexp_matches(lower(country), 'email|phone|company') then 30 else 0 end) end as cs,
        case when coalesce(trim(city), '') = '' then 0 else 10 + case when contains(trim(city), ':') then 0 else 15 end end as ts from contacts where nullif(trim(email), '') is not null)
    select e as email, arg_max(country, cs::bigint * 1000000000 - id) filter (where coalesce(country, '') <> '') as country, arg_max(city, ts::bigint * 1000000000 - id) filter (where coalesce(city, '') <> '') as city, count(*) as merged from s group by 1""", "contacts")  # fmt: skip
def contacts_by_field(r: Roles) -> DataFrame:
    return merge.merge_by_field(r.contacts.withColumnRenamed("id", "ord"), fields=("country", "city"))


@query("contacts_by_length", """with f as (select k, phone, min(id) as place from contacts where phone is not null group by 1, 2), p as (select k, string_agg(phone, ';' order by place) as phones from (select *, row_number() over (partition by k order by place) as n from f) where n <= 2 group by 1)
    select c.k, arg_max(contact_name, length(contact_name) * 1000000000 - id) as contact_name, arg_max(website, length(website) * 1000000000 - id) as website, coalesce(any_value(p.phones), '') as phones, string_agg(distinct source, ';' order by source) as sources from contacts c left join p on p.k = c.k group by 1""", "contacts")  # fmt: skip
def contacts_by_length(r: Roles) -> DataFrame:
    out = merge.merge_by_length(r.contacts.withColumnRenamed("id", "ord").drop("company_name"), "k", phones=2)
    return out.select("k", "contact_name", "website", F.array_join("phones", ";").alias("phones"), F.array_join("sources", ";").alias("sources"))


@query("contacts_by_two_keys", """with e as (select 'email' as kind, lower(email) as key, max(confidence) as confidence, count(*) as merged from contacts where coalesce(email, '') <> '' group by 2),
    p as (select 'profile' as kind, lower(trim(contact_name)) || '|' || lower(website) as key, max(least(confidence, 25)) as confidence, count(*) as merged from contacts where email is null and trim(contact_name) <> '' and website <> '' group by 2)
    select * from e union all select * from p""", "contacts")  # fmt: skip
def contacts_by_two_keys(r: Roles) -> DataFrame:
    c = r.contacts.withColumnRenamed("id", "ord").withColumns({"source_url": F.col("website"), "additional_emails": F.array().cast("array<string>")})
    return merge.merge_two_keys(c).select("kind", "key", "confidence", F.col("merged").cast("long").alias("merged"))


_AFF = "select id, organizer_id, person_id, position, country_code, case when company_name like '%@%' or company_name like '%|%' then null else nullif(trim(company_name), '') end as c, cast(id % 90 as int) as confidence from affiliations"


@query("affiliations_onto_held", f"""with a as ({_AFF}), o as (select organizer_id, person_id, lower(c) as k, arg_max(c, id) as c, arg_max(position, id) as position, max(confidence) as confidence from a where id % 3 = 0 and c is not null group by 1, 2, 3),
    n as (select organizer_id, person_id, lower(c) as k, arg_max(c, id) as c, arg_max(position, id) filter (where trim(position) <> '') as position, max(confidence) as confidence from a where id % 3 > 0 and c is not null group by 1, 2, 3)
    select coalesce(o.organizer_id, n.organizer_id) as organizer_id, coalesce(o.person_id, n.person_id) as person_id, coalesce(o.c, n.c) as company_name, coalesce(n.position, o.position) as position, greatest(coalesce(o.confidence, n.confidence), coalesce(n.confidence, o.confidence)) as confidence
    from o full join n on n.organizer_id = o.organizer_id and n.person_id = o.person_id and n.k = o.k
    union all select organizer_id, person_id, null, position, confidence from a where c is null and id % 3 > 0""", "affiliations")  # fmt: skip
def affiliations_onto_held(r: Roles) -> DataFrame:
    """Two thirds of the rows onto the rest, which holds one row for each company."""
    rows = r.affiliations.select(F.col("id").alias("ord"), "organizer_id", "person_id", "company_name", "position", F.lit(None).cast("string").alias("city"), F.col("country_code").cast("string").alias("country_code"), (F.col("id") % 90).cast("int").alias("confidence"))
    old = merge.upsert_affiliations(rows.limit(0), rows.filter("ord % 3 = 0")).filter("company_name is not null")
    return merge.upsert_affiliations(old, rows.filter("ord % 3 > 0")).select("organizer_id", "person_id", "company_name", "position", "confidence")


_TEXTS = ("contact_name", "company_name", "website", "country", "city", "phone")
_STEP = ", ".join(f"'{t}': case when coalesce(x.{t}, '') = '' then nullif(y.{t}, '') when coalesce(y.{t}, '') = '' or length(x.{t}) >= length(y.{t}) then x.{t} else y.{t} end" for t in _TEXTS)
_FOLD = f"""list_reduce(list({{'email': email, {", ".join(f"'{t}': nullif({t}, '')" for t in _TEXTS)}, 'source': source, 'confidence': confidence, 'others': others}} order by id),
    lambda a, b: list_transform([case when a.confidence >= b.confidence then {{'x': a, 'y': b}} else {{'x': b, 'y': a}} end], lambda p: list_transform([{{'x': p.x, 'y': p.y}}], lambda q: {{'email': q.x.email, {_STEP.replace("x.", "q.x.").replace("y.", "q.y.")},
      'source': q.x.source, 'confidence': SETTLED(greatest(a.confidence, b.confidence)), 'others': list_concat(q.x.others, list_filter(q.y.others, lambda o: not list_contains(q.x.others, o)))}})[1])[1])"""


@query("contacts_merged", f"""with c as (select *, list_filter([lower(source), website], lambda x: x is not null) as others from (select id, lower(trim(email)) as email, contact_name, company_name, website, country, city, phone, source, confidence from contacts)),
    e as (select 'email' as kind, email as key, {_FOLD.replace("SETTLED", "")} as m, count(*)::int as merged from c where coalesce(email, '') <> '' group by 2),
    p as (select 'profile' as kind, lower(trim(regexp_replace(contact_name, '\\s+', ' ', 'g'))) || '|' || lower(website) as key, {_FOLD.replace("SETTLED(greatest(a.confidence, b.confidence))", "25").replace("'confidence': confidence", "'confidence': least(coalesce(nullif(confidence, 0), 25), 25)")} as m, count(*)::int as merged
      from c where coalesce(email, '') = '' and trim(coalesce(contact_name, '')) <> '' and coalesce(website, '') <> '' group by 2)
    select kind, key, m.contact_name as contact_name, m.company_name as company_name, m.website as website, m.country as country, m.city as city, m.phone as phone, m.source as source, m.confidence as confidence, array_to_string(m.others, ';') as others, merged
    from (select * from e union all select * from p)""", "contacts")  # fmt: skip
def contacts_merged(r: Roles) -> DataFrame:
    others = F.array_distinct(F.filter(F.array(F.lower("source"), "website"), lambda x: x.isNotNull()))
    c = r.contacts.withColumnRenamed("id", "ord").withColumns({"email": F.lower(F.trim("email")), "source_url": F.col("website"), "additional_emails": others})
    return merge.merge_two_keys(c, settled=True).select("kind", "key", *_TEXTS, "source", "confidence", F.array_join("additional_emails", ";").alias("others"), "merged")


@query("people_filled", """with n as (select organizer_id, lower(trim(email)) as e, arg_min(contact, id) filter (where contact is not null) as f from (select id, organizer_id, email, case when id % 4 = 0 then null else 'New ' || cast(id % 3 as varchar) end as contact from persons) group by 1, 2)
    select p.organizer_id, lower(trim(p.email)) as email, coalesce(nullif(trim(p.first_name), ''), n.f) as first_name, p.owner_id from persons p left join n on n.organizer_id = p.organizer_id and n.e = lower(trim(p.email))""", "persons")  # fmt: skip
def people_filled(r: Roles) -> DataFrame:
    new = r.persons.select("organizer_id", "email", F.when(F.col("id") % 4 != 0, F.concat(F.lit("New "), (F.col("id") % 3).cast("string"))).alias("first_name"), F.lit(None).cast("string").alias("last_name"), F.lit(7).cast("bigint").alias("owner_id"), F.col("id").alias("ord"))
    return merge.upsert_persons(r.persons, new, fill_only=True).select("organizer_id", "email", "first_name", "owner_id")


@query("affiliations_merged", """with a as (select id, organizer_id, person_id, position, country_code, case when company_name like '%@%' or company_name like '%|%' then null else nullif(trim(company_name), '') end as c, cast(id % 90 as int) as confidence from affiliations)
    select organizer_id, person_id, arg_max(c, id) as company_name, arg_max(position, id) as position, max(confidence) as confidence from a where c is not null group by organizer_id, person_id, lower(c)
    union all select organizer_id, person_id, null, position, confidence from a where c is null""", "affiliations")  # fmt: skip
def affiliations_merged(r: Roles) -> DataFrame:
    new = r.affiliations.select(F.col("id").alias("ord"), "organizer_id", "person_id", "company_name", "position", F.lit(None).cast("string").alias("city"), F.col("country_code").cast("string").alias("country_code"), (F.col("id") % 90).cast("int").alias("confidence"))
    return merge.upsert_affiliations(new.limit(0), new).select("organizer_id", "person_id", "company_name", "position", "confidence")


@query("mined_labels", """with c as (select id, cast(id as varchar) as s from cards) select id, 0::bigint as contact, 'Firm ' || cast(id % 13 as varchar) as company, 'Person ' || s as name, 'p' || s || '@firm.com' as email, '+49 30 ' || cast(100000 + id as varchar) as phone from c where id % 5 <> 0
    union all select id, 1, 'Other ' || cast(id % 7 as varchar), null, 'other' || cast(id % 7 as varchar) || '@other.de', '12' from c""", "cards")  # fmt: skip
def mined_labels(r: Roles) -> DataFrame:
    return miners.mine_labels(r.cards).select("id", "contact", "company", "name", "email", "phone")


@query("mined_addresses", r"""with l as (select doc_id, string_split(text, chr(10)) as ls from documents where contains(text, '@')), u as (select doc_id, ls, unnest(ls) as t, generate_subscripts(ls, 1) as i from l),
    e as (select distinct doc_id, ls, i, lower(m) as email from (select doc_id, ls, i, unnest(regexp_extract_all(t, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')) as m from u)), f as (select *, row_number() over (partition by doc_id, email order by i) as n from e)
    select doc_id as id, email, (i - 1)::int as line, md5(array_to_string(ls[greatest(i - 8, 1):i + 4], chr(10))) as context from f where n = 1""")  # fmt: skip
def mined_addresses(r: Roles) -> DataFrame:
    return miners.mine_addresses(r.table("documents"), "doc_id").withColumn("context", F.md5("context"))


@query("result_candidates", "select id, trim(lower(email)) as email, split_part(trim(lower(email)), '@', 2) as domain, 'https://' || split_part(trim(lower(email)), '@', 2) as website from contacts where regexp_matches(trim(lower(email)), '^(info|john|anna|sales|desk)')", "contacts")
def result_candidates(r: Roles) -> DataFrame:
    return miners.candidates(r.contacts.drop("website"), "email").select("id", "email", "domain", "website")

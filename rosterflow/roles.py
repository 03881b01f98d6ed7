"""The supplied tables in the roles of an engagement system, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
EMAIL = "concat('c', cast({k} % 1400 as string), '@', 'd', cast({k} % 37 as string), '.example')"

ROLES = {
    "users": """select n_nationkey as id, case when n_nationkey = 0 then cast(null as int) else cast(floor((n_nationkey - 1) / 2) as int) end as reports_to,
        case when n_nationkey = 0 then 'owner' when n_nationkey < 3 then 'manager' else 'sales_rep' end as role, n_name as name from {nation}""",
    "persons": f"""select c_custkey as id, cast(c_custkey % 3 as int) as organizer_id,
        case when c_custkey % 5 = 0 then upper({EMAIL.format(k="c_custkey")}) else {EMAIL.format(k="c_custkey")} end as email,
        case when c_custkey % 7 = 0 then cast(null as string) else c_name end as first_name,
        case when c_custkey % 77 = 0 then '' when c_custkey % 11 = 0 then cast(null as string) else c_mktsegment end as last_name,
        c_nationkey as owner_id,
        case cast(c_custkey % 6 as int) when 0 then 'valid' when 1 then 'invalid' when 2 then 'risky' when 3 then 'catchall' when 4 then 'unknown' else null end as verification_status,
        case when c_custkey % 9 = 0 then cast(null as int) else cast(c_custkey % 5 as int) end as stage_id,
        case when c_custkey % 4 = 0 then cast(null as timestamp) else timestamp '2024-01-01 00:00:00' + interval '1' hour * (c_custkey % 500) end as stage_entered_at,
        timestamp '2024-01-01 00:00:00' + interval '1' minute * c_custkey as created_at from {{customer}}""",
    "affiliations": """select o_orderkey as id, o_custkey as person_id, cast(o_custkey % 3 as int) as organizer_id,
        case cast(o_orderkey % 10 as int) when 0 then null when 1 then concat(o_orderpriority, ' | branch') when 2 then concat('x@', lower(o_orderstatus), '.example')
            else concat(o_orderpriority, ' Co ', cast(o_custkey % 50 as string)) end as company_name,
        o_orderstatus as position, cast(o_custkey % 25 as int) as country_code, case when o_orderkey % 3 = 0 then cast(null as string) else concat('i', cast(o_custkey % 12 as string)) end as industry,
        o_orderdate as created_at from {orders}""",
    "campaign_events": f"""select event_id as id, cast(event_id % 7 as int) as campaign_id, user_id as person_id, cast(user_id % 3 as int) as organizer_id,
        case event_type when 'signup' then 'sent' when 'error' then 'bounce' when 'click' then 'click' when 'view' then 'open' else 'reply' end as event_type,
        {EMAIL.format(k="user_id")} as email,
        case when event_type = 'click' then concat('https://site.example/', case when event_id % 4 = 0 then 'pricing' else 'about' end, '/', cast(event_id % 13 as string)) end as url,
        case when event_type = 'error' then case cast(event_id % 4 as int) when 0 then '550 invalid' when 1 then 'mailbox full' when 2 then null else 'unknown' end end as reason,
        case when event_id % 10 = 0 then cast(null as bigint) else cast(floor(event_id / 3) as bigint) end as provider_event_id, ts as occurred_at from {{events}}""",
    "campaigns": """select cast(n_nationkey as int) as id, concat('Campaign ', n_name) as name, n_nationkey as created_by, n_regionkey as template_id, cast(n_nationkey % 4 as int) as list_id,
        case cast(n_nationkey % 3 as int) when 0 then 'private' when 1 then 'shared' else 'team' end as visibility from {nation} where n_nationkey < 7""",
    "list_members": """select cast(c_custkey % 4 as int) as list_id, case when c_custkey % 3 = 0 then cast(null as bigint) else c_custkey end as person_id, c_custkey + 10000000 as prospect_id,
        case when c_custkey % 17 = 0 then 'vip,new' when c_custkey % 2 = 0 then 'new' else '' end as tags from {customer}""",
    "prospects": f"""select c_custkey + 10000000 as id, case when c_custkey % 19 = 0 then '  ' else {EMAIL.format(k="c_custkey")} end as email, c_name as name, c_mktsegment as company,
        case cast(c_custkey % 5 as int) when 0 then 'invalid' when 1 then 'valid' else null end as verification_status from {{customer}}""",
    "unsubscribes": f"select {EMAIL.format(k='c_custkey')} as email, case when c_custkey % 2 = 0 then 'link' else 'spam_report' end as source, c_custkey as id from {{customer}} where c_custkey % 13 = 0",
    "recipients": """select c_custkey as id, cast(c_custkey % 7 as int) as campaign_id, c_custkey as person_id, c_custkey + 10000000 as prospect_id,
        case cast(c_custkey % 5 as int) when 0 then 'sent' when 1 then 'delivered' when 2 then 'opened' when 3 then 'clicked' else 'bounced' end as status,
        timestamp '2024-01-01 00:00:00' + interval '1' minute * c_custkey as sent_at,
        case when c_custkey % 5 between 1 and 3 then timestamp '2024-01-01 01:00:00' + interval '1' minute * c_custkey end as delivered_at,
        case when c_custkey % 5 between 2 and 3 then timestamp '2024-01-01 02:00:00' + interval '1' minute * c_custkey end as opened_at,
        case when c_custkey % 5 = 3 then timestamp '2024-01-01 03:00:00' + interval '1' minute * c_custkey end as clicked_at,
        case when c_custkey % 5 = 4 then timestamp '2024-01-01 04:00:00' + interval '1' minute * c_custkey end as bounced_at,
        cast(c_custkey % 5 as int) as last_sent_step from {customer}""",
    "action_items": """select o_orderkey as id, o_custkey as person_id, cast(o_orderkey % 25 as int) as assigned_to, cast(o_orderkey % 4 as int) as priority,
        case cast(o_orderkey % 5 as int) when 0 then 'done' when 1 then 'open' when 2 then 'in_progress' when 3 then 'snoozed' else 'dismissed' end as status,
        case when o_orderkey % 2 = 0 then 'engaged_hot' else 'reply_received' end as trigger_reason, o_orderdate as due_at from {orders} where o_orderkey % 3 = 0""",
    "quotes": """select o_orderkey as id, o_custkey as person_id, case o_orderstatus when 'F' then 'signed' when 'O' then 'sent' else 'draft' end as status,
        substring(o_orderpriority, 1, 1) as office_code, o_orderkey as af_sequence, cast(o_orderdate as date) as valid_until, 0.5 + (o_orderkey % 5) / 4.0 as rate from {orders}""",
    "quote_items": """select l_orderkey as quote_id, l_linenumber as line, l_quantity as quantity, l_extendedprice / l_quantity as unit_price, l_discount * 100 as discount_percent,
        l_tax * 100 as tax_percent, case when l_returnflag = 'A' then 'm2' else 'piece' end as unit_type from {lineitem}""",
    "contacts": """select c_custkey as id, cast(floor(c_custkey / 4) as bigint) as k,
        case cast(c_custkey % 11 as int) when 0 then concat('Info@firm', cast(c_custkey % 31 as string), '.com') when 1 then 'noreply@wix.com' when 2 then concat('john.smith@mail.', lower(c_mktsegment), '.org')
            when 3 then concat('x', cast(c_custkey as string), '@shop.example') when 4 then null when 5 then 'ceo@yopmail.com' when 6 then concat('anna_', lower(c_mktsegment), '@sub.google.com')
            when 7 then '1234567@bulk.net' when 8 then 'q@tiny.io' when 9 then concat(' Sales@Firm', cast(c_custkey % 31 as string), '.de') else concat('desk', cast(cast(floor(c_custkey / 4) as bigint) as string), '@plain.net') end as email,
        case cast(c_custkey % 5 as int) when 0 then concat('Name: ', lower(c_mktsegment), ' von berg') when 1 then concat(c_mktsegment, ' SMITH') when 2 then 'Mary O''Neil' when 3 then null else concat(' Ann ', initcap_(c_mktsegment), ' ') end as contact_name,
        case cast(c_custkey % 4 as int) when 0 then concat(c_mktsegment, ' GMBH') when 1 then concat('Company: Acme ', cast(c_custkey % 9 as string)) when 2 then '' else concat('Firm ', cast(c_custkey % 13 as string)) end as company_name,
        case cast(c_custkey % 6 as int) when 0 then concat('Tel: +49 (30) ', cast(100000 + c_custkey as string)) when 1 then '2019' when 2 then '12345' when 3 then null when 4 then concat('0', cast(5550000 + c_custkey as string)) else '+1-202-555-0143' end as phone,
        case cast(c_custkey % 3 as int) when 0 then concat('https://www.firm', cast(c_custkey % 31 as string), '.com/about') when 1 then 'https://linkedin.com/in/x' else null end as website,
        case cast(c_custkey % 7 as int) when 0 then 'Germany' when 1 then 'france' when 2 then null when 3 then 'Email: none' else 'United Kingdom of Great Britain and more' end as country,
        case cast(c_custkey % 4 as int) when 0 then 'Paris' when 1 then 'Berlin: Mitte' when 2 then null else 'London' end as city,
        case cast(c_custkey % 3 as int) when 0 then 'aiMiner' when 1 then 'table' else 'page' end as source, cast(c_custkey % 90 as int) as confidence from {customer}""".replace("initcap_(c_mktsegment)", "concat(substring(c_mktsegment, 1, 1), lower(substring(c_mktsegment, 2, 20)))"),
    "cards": """select c_custkey as id, concat('Company: Firm ', cast(c_custkey % 13 as string), chr(10), 'Contact: Person ', cast(c_custkey as string), chr(10), case when c_custkey % 5 = 0 then '' else concat('E-mail: P', cast(c_custkey as string), '@firm.com', chr(10)) end,
        'no label here', chr(10), 'Telefon - +49 30 ', cast(100000 + c_custkey as string), chr(10), chr(10), 'Firma: Other ', cast(c_custkey % 7 as string), chr(10), 'Web: other', cast(c_custkey % 7 as string), '@other.de', chr(10), 'Phone: 12') as text from {customer}""",
    "mining_results": f"""select c_custkey as id, cast(c_custkey % 40 as int) as job_id, c_name as contact_name,
        concat({EMAIL.format(k="c_custkey")}, case when c_custkey % 3 = 0 then concat(',', {EMAIL.format(k="(c_custkey + 7)")}) else '' end) as emails,
        case when c_custkey % 8 = 0 then cast(null as string) else 'imported' end as status, c_acctbal as score from {{customer}}""",
}


class Roles:
    """DataFrames of the roles and of the tables below them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return {}

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ROLES:
            raise AttributeError(name)
        sql = ROLES[name]
        used = {t: self.table(t) for t in ("nation", "customer", "orders", "events", "lineitem") if "{" + t + "}" in sql}
        return self.spark.sql(sql, **used)


def oracle(sql: str, *roles: str) -> str:
    """A DuckDB query over roles, with their definitions before it."""
    names = ("nation", "customer", "orders", "events", "lineitem")
    parts = [f"{r} as ({ROLES[r].format(**{n: n for n in names})})" for r in roles]
    body = sql.strip()
    if body[:14].lower() == "with recursive":
        return f"with recursive {', '.join(parts)}, {body[14:].strip()}" if parts else body
    if body[:5].lower() == "with ":
        return f"with {', '.join(parts)}, {body[5:]}" if parts else body
    return f"with {', '.join(parts)} {body}" if parts else body

"""What mining adds to contacts: companies, countries, signatures, evidence, and contacts from directory pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import company as co
from ..functions import signature as sg
from ..operators import countries as cn
from ..operators import html_miners as hm
from ..operators import page_cards as pc
from ..registry import query
from ..roles import Roles


@query("companies_resolved", """select id, case when id % 4 = 0 then 'Firm ' || (id % 13) when id % 4 = 1 then 'Acme ' || (id % 9) when id % 4 = 2 then 'Bolt ' || (id % 5) when id % 12 = 3 then 'Blue Sky' else null end as company,
        case when id % 4 = 1 then 'https://acme.example/' || (id % 9) when id % 12 = 3 then 'https://blue-sky.com.tr' when id % 4 = 3 then null else 'https://mail' || (id % 3) || '.example' end as website from persons""", "persons")  # fmt: skip
def companies_resolved(r: Roles) -> DataFrame:
    s, n = lambda k: (F.col("id") % k).cast("string"), F.col("id") % 4
    context = F.when(n == 0, F.concat(F.lit("Firm "), s(13), F.lit(" | stand 4"))).when(n == 1, F.concat(F.lit("see https://linkedin.com/x and https://acme.example/"), s(9)))
    title = F.when(n == 1, F.concat(F.lit("Acme "), s(9), F.lit(" - Exhibitors 2024"))).when(n == 2, F.concat(F.lit("Bolt "), s(5), F.lit(": home"))).when(n == 3, "Home")
    email = F.when(F.col("id") % 12 == 3, "a@blue-sky.com.tr").when(n == 3, "b@gmail.com").otherwise(F.concat(F.lit("c@mail"), s(3), F.lit(".example")))
    return r.persons.select("id", co.resolve_company(email, context, title).alias("company"), co.resolve_website(email, context).alias("website"))


_NAMES = {"Deutschland": "DE", "Saudi Arabia": "SA", "Brésil": "BR", "estados unidos": "US", "Vietnam": "VN", "Giappone": "JP", "uk": "GB", "Peru": "PE"}


@query("countries_coded", """select c_custkey as id, case c_custkey % 4 when 0 then 'TR' when 1 then null else (['DE', 'SA', 'BR', 'US', 'VN', 'JP', 'GB', 'PE'])[c_nationkey % 8 + 1] end as country_iso from customer""")
def countries_coded(r: Roles) -> DataFrame:
    k = F.col("c_custkey") % 4
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_nationkey") % 8 + 1).cast("int"))
    said = F.when(k == 0, F.when(F.col("c_custkey") % 8 == 0, " Türkiye").otherwise("[tr]")).when(k == 1, "Nowhere").when(k == 2, F.concat(F.lit(" ("), name, F.lit(") "))).otherwise(F.upper(F.regexp_replace(name, " ", "   ")))
    rows = r.table("customer").select(F.col("c_custkey").alias("id"), said.alias("said"))
    return cn.with_country_code(rows, "said", cn.country_names(rows.sparkSession)).select("id", "country_iso")


#: Names of a made-up atlas in words of the supplied texts; codes that the texts hold too.
_ATLAS = (("the", "TH"), ("of the", "OF"), ("data", "DA"), ("model", "MO"), ("a", "AA"), ("en", "EN"), ("in the", "US"))


@query("countries_in_texts", r"""with n(name, code) as (values """ + ", ".join(map(str, _ATLAS)) + r"""), t as (select doc_id as id, ' ' || regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+', ' ', 'g') || ' ' as spaced, regexp_extract(coalesce(text, ''), '\b([A-Z]{2})\b', 1) as pair from documents),
    named as (select t.id, first(n.code order by length(n.name) desc, n.name) as code from t join n on contains(t.spaced, ' ' || n.name || ' ') group by 1)
    select id, code from named union all select id, pair from t where pair in (select code from n) and id not in (select id from named)""")  # fmt: skip
def countries_in_texts(r: Roles) -> DataFrame:
    return cn.countries_in(r.table("documents"), "doc_id", "text", r.spark.createDataFrame(list(_ATLAS), "name string, code string"))


@query("signatures_parsed", """select id, 'Ann Smith' as full_name, case when id % 3 = 2 then null else 'Sales Manager' end as title, case when id % 3 = 0 then 'Firm ' || (id % 13) when id % 3 = 1 then 'Bolt' else 'Acme ' || (id % 9) end as company,
        case when id % 2 = 0 then '+49 30 ' || (1000000 + id % 8000000) end as phone, case when id % 3 = 0 then 'www.firm.example/' || (id % 13) end as website from persons""", "persons")  # fmt: skip
def signatures_parsed(r: Roles) -> DataFrame:
    s, n = lambda k: (F.col("id") % k).cast("string"), F.col("id") % 3
    phone = F.when(F.col("id") % 2 == 0, F.concat(F.lit("\nTel: +49 30 "), (1000000 + F.col("id") % 8000000).cast("string"))).otherwise("")
    first = F.concat(F.lit("Hello\n> you wrote\n> -- \n\n-- \nAnn Smith\nSales Manager\nFirm "), s(13), phone, F.lit("\nwww.firm.example/"), s(13))
    second = F.concat(F.lit("<p>See you</p><br>Best regards,<br/>Ann Smith<br>Sales Manager – Bolt"), phone)
    third = F.concat(F.lit("ok\n____\nann@mail.example\nAnn Smith\nAcme "), s(9), phone)
    rows = r.persons.select("id", sg.signature_lines(F.when(n == 0, first).when(n == 1, second).otherwise(third)).alias("lines"))
    return rows.select("id", sg.parse_signature(F.lit(None), F.col("lines")).alias("s")).select("id", "s.*")


@query("evidence_weighed", """select id, case id % 6 when 0 then greatest(least(100, confidence + 12.5), 85) when 1 then case when source = 'aiMiner' then least(confidence, 40) else confidence end when 2 then least(100, confidence + 7.5)
        when 3 then case when source = 'aiMiner' then least(confidence, 40) else confidence end when 4 then case when source = 'aiMiner' then greatest(85, least(confidence, 40)) else greatest(85, confidence) end else confidence end as c,
        case id % 6 when 0 then 'high_reliability_evidence' when 2 then 'boosted_good_evidence' when 4 then 'high_reliability_evidence' when 5 then 'none' else case when source = 'aiMiner' and confidence > 40 then 'capped_no_evidence' else 'none' end end as adjustment from contacts""".replace(
    "select id, case", "select id, cast(floor(0.5 + case", 1).replace("end as c,", "end) as int) as confidence,"), "contacts")
def evidence_weighed(r: Roles) -> DataFrame:
    k = F.col("id") % 6
    kind = F.when(k == 0, "mailto_link").when(k == 1, "mailto_link").when(k == 2, "table_cell").when(k == 3, "guess").when(k == 4, "schema_org").otherwise("text_match")
    parts = {"href": F.when(k == 0, "mailto:a@b.c").otherwise("http://b.c"), "text": F.when(k.isin(2, 5), "seen"), "schema": F.lit("")}
    return r.contacts.select("id", co.weigh_evidence(F.col("confidence"), F.col("source"), kind, parts).alias("e")).select("id", "e.*")


@query("listing_pages", """select page_id, case page_id % 4 when 0 then 'https://x.example/list/Page/7' when 1 then 'https://x.example/list?a=1&page=7&b=2' when 2 then 'https://x.example/list?a=1&page=7' else 'https://x.example/list?page=7' end as next_url,
        case page_id % 4 when 0 then 12 when 1 then 9 when 2 then 30 else 1 end as pages from pages""".replace("/Page/7", "/page/7"))  # fmt: skip
def listing_pages(r: Roles) -> DataFrame:
    k = F.col("page_id") % 4
    base = F.when(k == 0, "https://x.example/list/Page/2").when(k == 1, "https://x.example/list?a=1&page=2&b=2").when(k == 2, "https://x.example/list?a=1").otherwise("https://x.example/list")
    pager = F.when(k == 0, '<ul class="big pagination"><li>1</li><li><a href="/l?page=12">last</a></li></ul>').when(k == 1, '<a href="/l/page/9">on</a>').when(k == 2, "<p>Page 1 of <b>30</b></p>").otherwise("<nav>none 500</nav>")
    return r.table("pages").select("page_id", co.page_url(base, F.lit(7)).alias("next_url"), co.total_pages(pager).alias("pages"))


@query("directories_mined", """select id, 0::bigint as contact, 'Firm ' || (id % 13) as company, 'info' || id || '@firm.com' as email, '+49 30 ' || (100000 + id) as phone, 'https://firm.com/' || id as website, 'Main St. 1 & 2' as address from persons
    union all select id, 1, 'Bolt A.S.', 'b' || id || '@bolt.com', '12', null, null from persons where id % 2 = 0""", "persons")  # fmt: skip
def directories_mined(r: Roles) -> DataFrame:
    s = F.col("id").cast("string")
    first = F.concat(F.lit("<html><script>var x='<b>no</b>';</script><body><p><b>Firm "), (F.col("id") % 13).cast("string"), F.lit("</b><br>A subtitle<br>\n<b>Address:</b> Main St. 1 &amp; 2<br><b>Phone:</b> +49 30 "), (F.col("id") + 100000).cast("string"))
    first = F.concat(first, F.lit('<br><b>Email:</b> <a href="mailto:Info'), s, F.lit('@firm.com?subject=x">write</a><br><b>Website:</b> <a href="https://firm.com/'), s, F.lit('">site</a><br><br>'))
    second = F.when(F.col("id") % 2 == 0, F.concat(F.lit("<b>Firma Adı : Bolt A.S.</b><br><b>Tel:</b> 12; <b>e-mail:</b> b"), s, F.lit("@bolt.com; <b>Faks:</b> 13<br></p></body></html>"))).otherwise("<b>Bolt</b><br>no address<br></p></body></html>")
    return hm.mine_directory(r.persons.select("id", F.concat(first, second).alias("html")), "id").select("id", "contact", "company", "email", "phone", "website", "address")


@query("cards_mined", """select id, 1 as card, 'a' || id || '@firm.com' as email, 'Firm & Co ' || (id % 13) as company, '+49301234567' as phone, 'https://firm.com/' || id as website from persons
    union all select id, 3, 'c' || id || '@bolt.com', 'Bolt', '0212 555 01 02', null from persons""", "persons")  # fmt: skip
def cards_mined(r: Roles) -> DataFrame:
    s = F.col("id").cast("string")
    one = F.concat(F.lit('<p>top@page.com</p><div class="row card"><h3>Firm &amp; Co '), (F.col("id") % 13).cast("string"), F.lit('</h3><a href="mailto:A'), s, F.lit('@firm.com">m</a><a href="tel:+49301234567">t</a><a href="https://linkedin.com/x">l</a><a href="https://firm.com/'), s, F.lit('">w</a></div>'))
    rest = F.concat(F.lit('<div class="card"><h3>No mail</h3></div><li class=\'exhibitor\'><b>Bolt</b> <span>c'), s, F.lit("&#64;bolt.com</span> Tel 0212 555 01 02 </li>"))
    return hm.mine_cards(r.persons.select("id", F.concat(one, rest).alias("html")), "id")


_LI = ('<ul><li><b>Firm ', '</b><br>Phone: +49 30 1234567<br>Country: Germany<br><a href="mailto:A', '@firm.com?x=1">write</a> <a href="https://www.facebook.com/f">f</a> <a href="https://firm.com/x">w</a></li>')
_DL = ('</ul><dl><dt>Firma<dd>Bolt ', '<dt>Tel<dd>+49 40 7654321<dt>E-mail</dt><dd>b', '@bolt.com</dd><dt>Web:</dt><dd>www.bolt.com</dd></dl>')
_NEST = ('<section><h4>Outer</h4><p>Address: Main St. 1</p><section><h4>Inner ', ' &amp; Co</h4><p>City: Rome<br>Ansprechpartner: Eva Roth<br>c', '@inner.org</p></section><p>Phone: 12</p></section>')


@query("cards_in_pages", """with p as (select page_id as id from pages where html is not null)
    select id, 'a' || id || '@firm.com' as email, 'Firm ' || id as company, null as name, '+49 30 1234567' as phone, 'https://firm.com/x' as website, 'Germany' as country, null as city, null as address from p
    union all select id, 'b' || id || '@bolt.com', 'Bolt ' || id, null, '+49 40 7654321', 'https://www.bolt.com', null, null, null from p
    union all select id, 'c' || id || '@inner.org', 'Inner ' || id || ' & Co', 'Eva Roth', null, null, null, 'Rome', null from p""")  # fmt: skip
def cards_in_pages(r: Roles) -> DataFrame:
    """Three shapes of cards, one of them nested, at the end of each supplied page."""
    k = F.col("page_id").cast("string")
    cards = F.concat(*[x for part in (_LI, _DL, _NEST) for x in (F.lit(part[0]), k, F.lit(part[1]), k, F.lit(part[2]))])
    pages = r.table("pages").select("page_id", F.concat(F.regexp_replace("html", "@", " at "), cards).alias("html"))
    return pc.mine_page_cards(pages).drop("title")

"""Quotes: line totals, quote totals, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contact import quote_expired, quote_number
from ..registry import query
from ..roles import Roles


def totals(items: DataFrame) -> DataFrame:
    sub = F.col("quantity") * F.col("unit_price")
    discount = sub * F.coalesce("discount_percent", F.lit(0.0)) / 100
    tax = (sub - discount) * F.coalesce("tax_percent", F.lit(0.0)) / 100
    return items.groupBy("quote_id").agg(F.sum(sub).alias("subtotal"), F.sum(discount).alias("discount"), F.sum(tax).alias("tax"), F.sum(F.when(F.col("unit_type") == "m2", F.col("quantity")).otherwise(0)).alias("m2"), F.count("*").alias("lines"))


@query("quote_totals", """select q.status, count(*) as quotes, sum(t.lines)::bigint as lines, round(sum(t.sub - t.disc + t.tax), 0) as grand_total, round(sum((t.sub - t.disc + t.tax) * q.rate), 0) as grand_total_eur, sum(t.m2) as m2 from quotes q join (
      select quote_id, count(*) as lines, sum(quantity * unit_price) as sub, sum(quantity * unit_price * discount_percent / 100) as disc, sum((quantity * unit_price - quantity * unit_price * discount_percent / 100) * tax_percent / 100) as tax,
        sum(case when unit_type = 'm2' then quantity else 0 end) as m2 from quote_items group by 1) t on t.quote_id = q.id group by 1""", "quotes quote_items")  # fmt: skip
def quote_totals(r: Roles) -> DataFrame:
    t = r.quotes.join(totals(r.quote_items), F.col("id") == F.col("quote_id"))
    grand = F.col("subtotal") - F.col("discount") + F.col("tax")
    return t.groupBy("status").agg(F.count("*").alias("quotes"), F.sum("lines").alias("lines"), F.round(F.sum(grand), 0).alias("grand_total"), F.round(F.sum(grand * F.col("rate")), 0).alias("grand_total_eur"), F.sum("m2").alias("m2"))


@query("quote_list", """select q.id, case when status = 'signed' then 'A' else 'Q' end || office_code || '-' || cast(af_sequence as varchar) as number, status = 'sent' and valid_until < date '1998-01-01' as is_expired, p.email
    from quotes q left join persons p on p.id = q.person_id where cast(q.id as varchar) like '%77%' order by q.id limit 100""", "quotes persons")  # fmt: skip
def quote_list(r: Roles) -> DataFrame:
    p = r.persons.select(F.col("id").alias("person_id"), "email")
    q = r.quotes.filter(F.col("id").cast("string").ilike("%77%")).orderBy("id").limit(100).join(p, "person_id", "left")
    return q.select("id", quote_number(F.col("status"), F.col("office_code"), F.col("af_sequence")).alias("number"), quote_expired(F.col("valid_until"), F.col("status"), F.lit("1998-01-01").cast("date")).alias("is_expired"), "email")

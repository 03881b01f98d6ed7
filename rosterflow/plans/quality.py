"""Contact quality: coverage, scores, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contact import quality_decision, quality_score
from ..operators.relational import coverage
from ..registry import query
from ..roles import Roles


@query("field_coverage", """select count(*) as rows, round(count(*) filter (where coalesce(trim(email), '') <> '') / count(*) * 100, 2) as email_pct, round(count(*) filter (where coalesce(trim(first_name), '') <> '') / count(*) * 100, 2) as first_name_pct,
    round(count(*) filter (where coalesce(trim(last_name), '') <> '') / count(*) * 100, 2) as last_name_pct from persons""", "persons")  # fmt: skip
def field_coverage(r: Roles) -> DataFrame:
    return coverage(r.persons, ["email", "first_name", "last_name"])


@query("contact_scores", """select decision, count(*) as people, min(score)::bigint as least, max(score)::bigint as most from (select *, case when score >= 80 then 'EXCELLENT' when score >= 60 then 'GOOD' when score >= 40 then 'FAIR' when score >= 25 then 'POOR' else 'RETRY' end as decision from (
    select 30 + case when coalesce(trim(p.first_name), '') <> '' then 20 else 0 end + case when a.company_name is not null then 15 else 0 end + case when a.position is not null then 5 else 0 end + case when a.country_code is not null then 5 else 0 end as score
    from persons p left join (select * from (select *, row_number() over (partition by person_id order by created_at desc, id desc) as rn from affiliations) where rn = 1) a on a.person_id = p.id)) group by 1""", "persons affiliations")  # fmt: skip
def contact_scores(r: Roles) -> DataFrame:
    from ..operators.relational import latest_per_key

    a = latest_per_key(r.affiliations, "person_id", "created_at", "id", ["company_name", "position", "country_code"]).withColumnRenamed("person_id", "id")
    p = r.persons.join(a, "id", "left")
    score = quality_score({"email": F.col("email"), "contact_name": F.col("first_name"), "company_name": F.col("company_name"), "job_title": F.col("position"), "country": F.col("country_code").cast("string")})
    p = p.withColumn("score", score).withColumn("decision", quality_decision(F.col("score")))
    return p.groupBy("decision").agg(F.count("*").alias("people"), F.min("score").cast("bigint").alias("least"), F.max("score").cast("bigint").alias("most"))

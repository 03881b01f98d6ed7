"""Extraction of contacts from the supplied texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import email as em
from ..registry import query
from ..roles import Roles


@query("document_emails", """select doc_id, e as email, split_part(e, '@', 2) as domain, split_part(e, '@', 1) in ('info', 'contact', 'admin', 'support', 'hello', 'help', 'sales') as is_desk from (
    select distinct doc_id, lower(x) as e from (select doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) as x from documents))""")  # fmt: skip
def document_emails(r: Roles) -> DataFrame:
    e = r.table("documents").select("doc_id", F.explode(em.extract_emails(F.col("text"))).alias("email"))
    return e.select("doc_id", "email", em.domain(F.col("email")).alias("domain"), em.local_part(F.col("email")).isin("info", "contact", "admin", "support", "hello", "help", "sales").alias("is_desk"))


@query("page_hosts", r"select regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, count(*) as pages, sum(length(html))::bigint as chars from pages group by 1")
def page_hosts(r: Roles) -> DataFrame:
    return r.table("pages").groupBy(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


@query("page_duplicates", "select count(*) as pages, count(distinct md5(html)) as contents from pages")
def page_duplicates(r: Roles) -> DataFrame:
    by = r.table("pages").groupBy(F.md5("html").alias("h")).agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("pages"), F.count("*").alias("contents"))


@query("email_kinds", """select kind, count(*) as n from (select case when split_part(lower(email), '@', 1) in ('info') then 'generic' when regexp_matches(split_part(lower(email), '@', 1), '^[a-z]+[._]?[a-z]+$') then 'personal' else 'unknown' end as kind from persons) group by 1""", "persons")
def email_kinds(r: Roles) -> DataFrame:
    return r.persons.groupBy(em.email_type(F.col("email")).alias("kind")).agg(F.count("*").alias("n"))


@query("documents_by_source", "select lang, source, count(*) as documents, sum(n_chars)::bigint as chars, min(n_chars) as shortest, max(n_chars) as longest from documents group by all")
def documents_by_source(r: Roles) -> DataFrame:
    return r.table("documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))

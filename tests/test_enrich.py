"""Companies, countries, signatures, evidence and pages on small frames, and hand-made edges."""

import pytest
from pyspark.sql import functions as F

from rosterflow.functions import company as co
from rosterflow.functions import signature as sg
from rosterflow.operators import countries as cn
from rosterflow.operators import html_miners as hm


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, "n int, " + schema).orderBy("n").select(expression).collect()]


def numbered(xs):
    return [(k, x) for k, x in enumerate(xs)]


def test_company_names(spark):
    titles = ["Acme - Exhibitors 2024", "Home", None, "", "x", "Bolt | Kontakt", "- Bolt", "123"]
    assert values(spark, numbered(titles), "t string", co.company_of_title(F.col("t"))) == ["Acme", None, None, None, None, "Bolt", "- Bolt", None]
    emails = ["a@blue-sky.com", "a@gmail.com", "no address", "a@b@c", None, "a@www.firm.com.tr"]
    assert values(spark, numbered(emails), "e string", co.company_of_domain(F.col("e"))) == ["Blue Sky", None, None, None, None, "Firm"]


def test_page_numbers(spark):
    pages = [None, "", '<div class="pager"><a href="?page=250">x</a><span>4 of</span></div>', "<a href='/page/3'>3</a>", "page 1 of 99999999999", '<ul class="pagination"><li>' + "9" * 9 + "</li></ul>"]
    assert values(spark, numbered(pages), "h string", co.total_pages(F.col("h"))) == [1, 1, 4, 3, 1, 1]


@pytest.mark.parametrize("name", ["trim by place", "quoted and closed"])
def test_signatures(spark, name):
    body = {"trim by place": "ok\n____\nann@mail.example\nAnn Smith\nAcme 2", "quoted and closed": "ok\n> --\n> Bob\nThanks,\nAnn Smith\nAcme 2\n"}[name]
    (found,) = values(spark, [(0, body)], "b string", sg.parse_signature(F.col("b")))
    assert (found.full_name, found.company, found.title, found.phone) == ("Ann Smith", "Acme 2", None, None)


def test_no_signature(spark):
    assert values(spark, numbered([None, "", "one line", "> a\n> b\n> c"]), "b string", sg.parse_signature(F.col("b"))) == [None] * 4
    long = "\n".join(["word"] * 50_000) + "\n--\nAnn Smith\nAcme"
    assert values(spark, [(0, long)], "b string", sg.parse_signature(F.col("b")))[0].company == "Acme"


def test_country_codes(spark):
    names = spark.createDataFrame([("France", "FR"), ("Côte d'Ivoire", "CI"), ("brasil", "BR"), ("new caledonia", "NC"), ("caledonia", "SC")], "name string, code string")
    said = ["fr", "FRANCE ", "(fränce)", "Brásil", "côte d'ivoire", None, "", "zz", "New  Caledonia"]
    rows = spark.createDataFrame(numbered(said), "n int, said string")
    assert [r.country_iso for r in cn.with_country_code(rows, "said", names).orderBy("n").collect()] == ["FR", "FR", "FR", "BR", "CI", None, None, None, "NC"]
    texts = [(0, "from New-Caledonia, and France"), (1, "made in FR"), (2, "frances"), (3, None), (4, "ZZ then FR"), (5, "caledonia new france")]
    found = cn.countries_in(spark.createDataFrame(texts, "n int, text string"), "n", "text", names)
    assert sorted(map(tuple, found.collect())) == [(0, "NC"), (1, "FR"), (5, "SC")]


def test_pages_without_contacts(spark):
    pages = spark.createDataFrame(numbered([None, "", "<div class='card'>no address</div>", "<p>a@b.com</p>"]), "page_id int, html string")
    assert hm.mine_cards(pages).count() == 0
    assert hm.mine_directory(pages).count() == 0

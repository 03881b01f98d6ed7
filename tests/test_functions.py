"""Cleaners, classifiers and scores on hand-made cases."""

from pyspark.sql import functions as F

from rosterflow.functions import contact as ct
from rosterflow.functions import email as em


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_emails(spark):
    assert one(spark, "A@b.com, c@D.org a@B.com", em.extract_emails) == ["a@b.com", "c@d.org"]
    assert one(spark, None, em.extract_emails) == []
    assert [one(spark, x, em.email_type) for x in ("info@a.co", "ceo@a.co", "jane.doe@a.co", "x9@a.co", None)] == ["generic", "role", "personal", "unknown", "unknown"]
    assert [one(spark, x, em.is_junk) for x in ("noreply@a.co", "x@mail.google.com", "x@a.co", None, "")] == [True, True, False, True, True]
    assert one(spark, "Sales@x.com", em.is_generic)
    assert one(spark, "suer@elan.netphone", em.clean_email) == "suer@elan.net"
    assert one(spark, "x@hotel.com", em.clean_email) == "x@hotel.com"
    assert one(spark, "x@hotel.com", lambda c: em.clean_email(c, compatible=True)) is None
    key, text = 0x2A, "a@b.co"
    assert one(spark, f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in text), em.decode_obfuscated) == text
    assert one(spark, "zz", em.decode_obfuscated) is None
    assert one(spark, "a@b@c.de", em.is_valid) is False


def test_contact_cleaners(spark):
    assert one(spark, "o'neil mc-x", ct.title_case) == "O'Neil Mc-X"
    assert one(spark, "Name: SUER AY", ct.clean_name) == "Suer Ay"
    assert one(spark, "Jane 9", ct.clean_name) is None
    assert one(spark, "ACME LTD phone: 1", ct.clean_company) == "Acme Ltd"
    assert one(spark, "tel:+90 212 555 12 34\nx", ct.clean_phone) == "+90 212 555 12 34"
    assert one(spark, "12345", ct.clean_phone) is None
    assert one(spark, " +90 (212)", ct.normalize_phone) == "+90212"
    assert one(spark, "web: www.a.co", ct.clean_website) == "https://www.a.co"
    assert one(spark, "a.pdf", ct.clean_website) is None
    assert [one(spark, x, ct.company_of) for x in ("A | B", " | B", "x@y", None, "C")] == ["A", None, None, None, "C"]
    assert [one(spark, x, ct.bounce_kind) for x in ("550 no", "Mailbox FULL", None)] == ["hard", "soft", "unknown"]
    assert [one(spark, x, ct.js_round, "double") for x in (2.5, -2.5)] == [3, -2]
    assert [one(spark, x, ct.cell_type) for x in ("a@b.co", "www.a.co", "+90 212 555 1234", "12", "Acme GmbH", "Jane Doe", "some text", None)] == ["email", "url", "phone", "number", "company", "name", "text", "empty"]


def test_scores(spark):
    full = {k: F.lit("x") for k in ("email", "contact_name", "company_name", "phone", "website", "country", "job_title", "city", "address")}
    assert spark.range(1).select(ct.quality_score(full).alias("y")).first().y == 100
    assert spark.range(1).select(ct.quality_score({"email": F.lit(None).cast("string")}).alias("y")).first().y == 0
    assert one(spark, "Jane Doe", lambda c: ct.field_score("name", c)) == 45
    assert one(spark, "Acme Ltd", lambda c: ct.field_score("company", c)) == 45
    assert one(spark, None, lambda c: ct.field_score("name", c)) == 0

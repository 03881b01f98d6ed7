"""Merges, scopes, state and streams on hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from rosterflow.catalogue import QUERIES
from rosterflow.functions.email import is_valid
from rosterflow.operators import events as ev
from rosterflow.operators import merge, relational, scope
from rosterflow.sources import files
from rosterflow.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_person_upsert_keeps_owner_and_takes_filled_names(spark):
    kind = "organizer_id int, email string, first_name string, last_name string, owner_id int"
    old = spark.createDataFrame([(1, "a@x.co", "Ann", "Old", 7)], kind)
    new = spark.createDataFrame([(1, "A@x.co", "", "New", 9, 1), (1, "b@x.co", "Bo", None, None, 2), (1, " ", "No", None, 1, 3)], kind + ", ord int")
    assert rows(merge.upsert_persons(old, new), "email", "first_name", "last_name", "owner_id") == [("a@x.co", "Ann", "New", 7), ("b@x.co", "Bo", None, None)]
    assert rows(merge.upsert_persons(old, new, fill_only=True), "email", "last_name") == [("a@x.co", "Old"), ("b@x.co", None)]


def test_upsert_of_all_persons_takes_every_row(spark):
    from rosterflow.plans.lists import upsert_by_time
    from rosterflow.roles import Roles

    r = Roles(spark, "/root/testdata/sf0.01")
    keys = r.persons.filter("trim(email) != ''").selectExpr("organizer_id", "lower(email) as email").distinct()
    assert keys.exceptAll(QUERIES["person_upsert_whole"](spark, "/root/testdata/sf0.01").select("organizer_id", "email")).count() == 0
    # ids 1, 2 and 1401 are one person of the old side, 1500 comes in
    data = [(1, 0, "A@x.co", "a", None, 5, 1), (2, 0, "a@x.co", "a", "Old", 6, 2), (1401, 0, "a@x.co", "a", " ", 8, 3), (1500, 0, "a@X.co", "a", "New", 9, 100), (1501, 1, "b@x.co", "b", None, None, 100)]
    df = spark.createDataFrame(data, "id long, organizer_id int, email string, first_name string, last_name string, owner_id int, at long").withColumn("created_at", F.timestamp_seconds("at"))
    assert rows(upsert_by_time(df), "organizer_id", "email", "last_name", "owner_id") == [(0, "a@x.co", "New", 5), (1, "b@x.co", None, None)]


def test_affiliation_upsert(spark):
    kind = "organizer_id int, person_id int, company_name string, position string, city string, country_code string, confidence double"
    old = spark.createDataFrame([(1, 1, "Acme", "x", None, "DE", 0.5), (1, 1, None, "y", None, None, 0.1)], kind)
    new = spark.createDataFrame([(1, 1, "ACME", "", "Rome", None, 0.4, 1), (1, 1, "a|b", "z", None, None, 0.2, 2)], kind + ", ord int")
    assert rows(merge.upsert_affiliations(old, new), "company_name", "position", "city", "confidence") == [("Acme", "x", "Rome", 0.5), (None, "y", None, 0.1), (None, "z", None, 0.2)]


def test_merge_contacts_follows_the_order(spark):
    kind = "k int, ord int, email string, contact_name string, phone string, additional_emails array<string>, source string, confidence int"
    data = [(1, 1, "", "Long Name Here", "1", ["x@a.co"], "p", 90), (1, 2, "e@a.co", "Short", None, ["y@a.co"], "q", 10), (2, 1, "f@a.co", "ab", None, None, "p", 5), (2, 2, "g@a.co", "cd", None, None, "q", 5)]
    out = merge.merge_contacts(spark.createDataFrame(data, kind), "k")
    assert rows(out, "k", "email", "contact_name", "phone", "source", "confidence") == [(1, "e@a.co", "Long Name Here", "1", "q", 90), (2, "f@a.co", "ab", None, "p", 5)]
    assert rows(out, "k", "additional_emails")[0] == (1, ["y@a.co", "x@a.co"])


def test_merge_by_field_and_length(spark):
    data = [("A@x.co", "J", "1", 1), ("a@x.co", "Jane Doe", None, 2), (None, "Z", None, 3)]
    out = merge.merge_by_field(spark.createDataFrame(data, "email string, name string, phone string, ord int"))
    assert rows(out, "email", "name", "phone", "merged") == [("a@x.co", "Jane Doe", "1", 2)]
    data = [("k", "ab", "1", "s", 1), ("k", "cd", "2", "t", 2), ("k", "x", "1", "s", 3), ("k", None, "3", "s", 4), ("k", None, "4", "s", 5)]
    out = merge.merge_by_length(spark.createDataFrame(data, "k string, contact_name string, phone string, source string, ord int"), "k")
    assert rows(out, "contact_name", "phones", "sources") == [("ab", ["1", "2", "3"], ["s", "t"])]


def test_import_and_ignore(spark):
    data = [(1, ["bad", "A@x.co"]), (2, ["a@x.co"]), (3, None), (4, ["b@x.co"])]
    assert rows(merge.import_batch(spark.createDataFrame(data, "id int, emails array<string>"), is_valid), "id", "outcome") == [(1, "imported"), (2, "duplicate"), (3, "no_email"), (4, "imported")]
    old = spark.createDataFrame([("a", 1)], "k string, t int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 2), (None, 5), (None, 6)], "k string, t int")
    assert rows(merge.insert_or_ignore(old, new, ["k"], ["t"], need="k"), "k", "t") == [("b", 2), (None, 5), (None, 6)]


def test_scopes_and_a_cycle(spark):
    users = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id int, reports_to int")
    tree = scope.closure(users)
    assert rows(tree.filter("viewer in (1, 2)"), "viewer", "member") == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)]
    assert rows(tree.filter("viewer = 8"), "member") == [(8,), (9,)]
    things = spark.createDataFrame([(1, 1, "private"), (2, 3, "private"), (3, 1, "shared")], "id int, owner int, visibility string")
    assert rows(scope.scoped(things, "owner", tree, 2, "manager"), "id") == [(2,)]
    assert rows(scope.visible(things, "owner", "visibility", tree, 2, "manager"), "id") == [(2,), (3,)]
    assert scope.scoped(things, "owner", tree, 3, "owner").count() == 3
    assert scope.may_see(tree, 1, 3, "manager") and not scope.may_see(tree, 3, 1, "sales_rep")


def events(spark, data):
    return spark.createDataFrame(data, "recipient_id int, event_type string, at string, id int, reason string").withColumn("occurred_at", F.col("at").cast("timestamp")).drop("at")


def test_recipient_state(spark):
    sent = spark.createDataFrame([(k, "sent") for k in range(1, 6)], "recipient_id int, status string")
    e = events(spark, [(1, "delivered", "2024-01-01", 1, None), (2, "open", "2024-01-01", 2, None), (2, "delivered", "2024-01-02", 3, None), (3, "reply", "2024-01-01", 4, None), (3, "open", "2024-01-02", 5, None), (4, "open", "2024-01-01", 6, None), (4, "bounce", "2024-01-02", 7, "full")])
    out = ev.recipient_state(sent, e)
    assert rows(out, "recipient_id", "status", "open_count", "last_error") == [(1, "delivered", 0, None), (2, "opened", 1, None), (3, "replied", 1, None), (4, "bounced", 1, "full"), (5, "sent", 0, None)]
    assert [r.delivered_at is not None for r in out.orderBy("recipient_id").collect()] == [True, False, False, False, False]


def test_engaged_hot(spark):
    data = [(1, "open", "2024-01-29", None), (1, "open", "2024-01-30", None), (2, "open", "2024-01-30", None), (2, "open", "2024-01-30 05:00:00", None), (3, "click", "2024-01-10", "http://a/Pricing"), (4, "click", "2024-01-10", "http://a/x"), (5, "click", "2024-01-10", "http://a/book"), (5, "reply", "2023-01-10", None)]
    e = spark.createDataFrame([(p, k, t, u, n, 1) for n, (p, k, t, u) in enumerate(data)], "person_id int, event_type string, t string, url string, id int, campaign_id int").withColumn("occurred_at", F.col("t").cast("timestamp"))
    assert rows(ev.engaged_hot(e, None, "2024-01-31"), "person_id", "engagement_score") == [(1, 2), (3, 3)]
    items = spark.createDataFrame([(1, "engaged_hot", "open")], "person_id int, trigger_reason string, status string")
    assert rows(ev.engaged_hot(e, items, "2024-01-31"), "person_id") == [(3,)]


def test_sequences_and_crawl(spark):
    r = spark.createDataFrame([(1, 1, 1, "active", "2024-01-01"), (1, 2, 1, "active", "2024-01-01"), (1, 3, 9, "active", "2024-01-01"), (1, 4, 1, "active", "2025-01-01")], "campaign_id int, person_id int, current_step int, status string, t string").withColumn("next_send_at", F.col("t").cast("timestamp"))
    steps = spark.createDataFrame([(1, 1, 0, "no_reply"), (1, 2, 3, "always")], "campaign_id int, sequence_order int, delay_days int, condition string")
    e = spark.createDataFrame([(1, 2, "reply")], "campaign_id int, person_id int, event_type string")
    assert rows(ev.advance_sequences(r, steps, e, "2024-02-01"), "person_id", "action", "next_step") == [(1, "send", 2), (2, "skip", 2), (3, "complete", None)]
    pages = spark.createDataFrame([(1, 1, 3, "a"), (1, 2, 0, "b"), (1, 3, 0, "c"), (1, 4, 0, "d"), (2, 1, 1, "a"), (2, 2, 1, "a"), (2, 3, 1, "a"), (3, 1, 1, "z")], "job_id int, page int, contacts int, content_hash string")
    assert rows(ev.crawl_stop(pages), "job_id", "stop_page") == [(1, 4), (2, 3), (3, None)]


def test_stream_is_idempotent(spark, tmp_path):
    source, store, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    source.mkdir()
    event = {"email": "A@x.co", "event": "open", "timestamp": 1704067200, "sg_event_id": "e1", "campaign_id": 1}
    (source / "1.json").write_text("\n".join(json.dumps(x) for x in (event, event, event | {"sg_event_id": None}, event | {"event": "odd"})))
    ingest.start_ingest(ingest.read_events(spark, str(source)), store, check).awaitTermination()
    (source / "2.json").write_text(json.dumps(event | {"timestamp": 1704067300}) + "\n" + json.dumps(event | {"sg_event_id": "e2"}))
    ingest.start_ingest(ingest.read_events(spark, str(source)), store, check).awaitTermination()
    assert rows(spark.read.parquet(store), "email", "provider_event_id") == [("a@x.co", "e1"), ("a@x.co", "e2"), ("a@x.co", None)]


def test_auto_replies_and_attribution(spark):
    mail = spark.createDataFrame([(1, "x@a.co", "me+c-0a1b2c3d-r-00000001@b.co", "Re: hi", None), (2, "y@a.co", "me@b.co", "Out of Office", None), (3, "y@a.co", "me@b.co", "Hello", "Auto-Submitted: no"), (4, "z@a.co", "me@b.co", "Hello", None)], "mail_id int, sender string, receiver string, subject string, headers string").withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    recipients = spark.createDataFrame([(10, "00000001", "0a1b2c3d", "q@a.co", "2024-01-01"), (11, "00000002", "0a1b2c3d", "Y@a.co", "2024-01-01"), (12, "00000003", "0a1b2c3d", "y@a.co", "2024-01-02")], "recipient_id int, short_id string, campaign_short string, email string, created_at string")
    assert rows(ingest.inbound_replies(mail, recipients), "mail_id", "recipient_id") == [(1, 10), (3, 12)]


def test_files(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('First Name,Surname,E-Mail\n Ann ,"Lee, Jr",A@x.co\n')
    up = files.canonical_upload(files.read_delimited(spark, str(path)))
    assert rows(up, "name", "email") == [("Ann Lee, Jr", "a@x.co")]
    assert files.infer_header([["report"], ["Company", "E-mail", "Tel"]]) == (1, {0: "company", 1: "email", 2: "phone"})
    out = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([('a"b', ["x", "y"], None)], "a string, b array<string>, c string"), out)
    assert rows(files.read_delimited(spark, out), "a", "b") == [('a"b', "x, y")]
    loose = spark.createDataFrame([(["Q@x.co"], None, "N")], "emails array<string>, contact_name string, name string")
    assert rows(files.loose_results(loose), "email", "contact_name") == [("q@x.co", "N")]


def test_filters_ignore_unknown_names(spark):
    df = spark.range(3)
    allowed = {"least": lambda v: F.col("id") >= v}
    assert relational.where(df, allowed, {"least": 1}).count() == 2
    assert relational.where(df, allowed, {"other": 1}).count() == df.count()


def test_sheets_have_a_header_of_their_own_each(spark, tmp_path):
    from rosterflow.sources import files

    (tmp_path / "a.csv").write_text('Exhibitors 2024,,\nE-mail,Company,Name\na@b.de,"Firm, Inc",Ann\nE-mail,Company,Name\n\n')
    (tmp_path / "b.csv").write_text("Company,Email\nOther,c@d.de\n")
    got = files.read_sheet_like(spark, f"file://{tmp_path}")
    assert rows(got.select("email", "company"), "email", "company") == [("E-mail", "Company"), ("a@b.de", "Firm, Inc"), ("c@d.de", "Other")]


def test_closures_follow_any_depth(spark):
    from rosterflow.operators import scope

    users = spark.createDataFrame([(k, k - 1 if k else None) for k in range(70)], "id int, reports_to int")
    tree = scope.closure(users)
    assert tree.count() == 70 * 71 // 2 and tree.filter("viewer = 0 and member = 69 and depth = 69").count() == 1


def test_long_words_keep_all_their_letters(spark):
    from rosterflow.functions import contact

    (r,) = spark.createDataFrame([("A" * 3000,)], "s string").select(contact.title_case(F.col("s"))).collect()
    assert r[0] == "A" + "a" * 2999

"""Streams: states whatever the order of arrival, appends and reply batches that may be repeated."""

import random

import pytest
from pyspark.sql import functions as F

from rosterflow.operators import events as ev
from rosterflow.streaming import ingest, states
from rosterflow.streaming.store import BucketStore

EVENT = "recipient_id long, event_type string, t long, id long, reason string"


def some_events(n, people, seed):
    rnd = random.Random(seed)
    kinds = ["delivered", "open", "open", "click", "reply", "bounce", "dropped", "spamreport", "unsubscribe", "deferred"]
    return [(rnd.choice([rnd.randrange(people), 1]), rnd.choice(kinds), rnd.randrange(40), k, rnd.choice([None, "550", "full"])) for k in range(n)]


def as_events(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("occurred_at", F.timestamp_seconds("t"))


@pytest.mark.parametrize("size", [25, 60])
def test_a_shuffled_stream_equals_the_batch(spark, tmp_path, size):
    rows = some_events(150, 25, size)
    sent = spark.createDataFrame([(k, s) for k, s in enumerate(["sent", "delivered", "opened", "clicked", "bounced", "replied", "unsubscribed"] * 3)], "recipient_id long, status string")
    random.Random(1).shuffle(rows)
    source, table, check = str(tmp_path / "in"), str(tmp_path / "states"), str(tmp_path / "check")
    for k in range(0, len(rows), size):  # files, each a micro-batch
        as_events(spark, rows[k : k + size]).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(as_events(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(source)
    states.start_states(stream, table, check, sent).awaitTermination()
    got = states.latest_states(spark.read.parquet(table))
    every = as_events(spark, rows).select("recipient_id").distinct().join(sent, "recipient_id", "left").withColumn("status", F.coalesce("status", F.lit("sent")))
    want = ev.recipient_state(every, as_events(spark, rows))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {"replied", "bounced"} <= {r.status for r in want.collect()} and spark.read.parquet(table).agg(F.max("batch")).first()[0] > 1


def one_by_one(status, events):
    """The machine as it reads: an event at a time."""
    for kind, _ in events:
        if kind == "delivered" and status == "sent":
            status = "delivered"
        elif kind in ("open", "click") and status not in ("replied", "unsubscribed"):
            status = {"open": "opened", "click": "clicked"}[kind]
        elif kind in ("bounce", "dropped", "spamreport"):
            status = "bounced"
        elif kind == "reply":
            status = "replied"
    return status


def test_the_batch_equals_the_machine_event_by_event(spark):
    rows = some_events(800, 150, 9)
    firsts = {k: random.Random(k).choice(["sent", "delivered", "opened", "clicked", "bounced", "replied", "unsubscribed"]) for k in range(150)}
    sent = spark.createDataFrame(list(firsts.items()), "recipient_id long, status string")
    got = {r.recipient_id: r.status for r in ev.recipient_state(sent, as_events(spark, rows)).collect()}
    for k, first in firsts.items():
        assert got[k] == one_by_one(first, [(r[1], r[4]) for r in sorted(rows, key=lambda r: (r[2], r[3])) if r[0] == k])


def test_appends_read_a_constant_number_of_files_and_may_be_repeated(spark, tmp_path):
    store = str(tmp_path / "store")
    write = ingest.append_once(store, ["k", "provider_event_id"], ["n"], buckets=4, runs=3)
    rnd = random.Random(2)
    batches = [[(rnd.randrange(3), rnd.choice([None, *range(30)]), b * 100 + k) for k in range(12)] for b in range(12)]
    seen, want = set(), []
    for rows in batches:
        for r in sorted(rows, key=lambda r: r[2]):
            if r[1] is None or r[:2] not in seen:
                want.append(r)
                seen.add(r[:2])
    keys, read = None, []
    for b, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k int, provider_event_id long, n int")
        write(df, b)
        if b % 4 == 3:  # again, in another order
            write(df.orderBy(F.desc("n")), b)
        keys = BucketStore(spark, f"{store}/_keys", df.select("k", "provider_event_id").schema, ["k", "provider_event_id"], 4, 3)
        read.append(max(len(keys.runs_of(x, b + 1)) for x in range(4)))
    got = sorted((tuple(r) for r in spark.read.parquet(store).select("k", "provider_event_id", "n").collect()), key=str)
    assert got == sorted(want, key=str) and max(read) <= 4 and max(read[4:]) == max(read[8:])


def test_a_store_holds_the_latest_row_of_each_key(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    store = BucketStore(spark, str(tmp_path / "s"), schema, ["k"], buckets=2, runs=2)
    now = {}
    for b in range(7):
        rows = [(k, f"{b}") for k in range(b, b + 3)] + [(None, str(b))]
        store.put(spark.createDataFrame(rows, schema), b)
        now.update(rows)
        asked = spark.createDataFrame([(k,) for k in (*range(12), None)], "k long")
        assert {tuple(r) for r in store.lookup(asked, b + 1).collect()} == set(now.items())
    assert {r.v for r in store.lookup(spark.createDataFrame([(0,), (1,)], "k long"), 1).collect()} == {"0"}


def reply_tables(spark):
    frame = spark.createDataFrame
    return {
        "recipients": frame([(k, k % 2, k % 3, f"0000000{k % 3}", f"0000000{k}", f"P{k}@x.co", "sent" if k % 4 else "bounced", None) for k in range(8)], "recipient_id long, organizer_id int, campaign_id int, campaign_short string, short_id string, email string, status string, sent_at timestamp"),
        "persons": frame([(100 + k, k % 2, f"p{k}@X.co", None if k % 3 else "Had", "" if k % 2 else None, None, [None, 0, 3, 9][k % 4]) for k in range(7)], "id long, organizer_id int, email string, first_name string, last_name string, phone string, stage_id int"),
        "stages": frame([(s, o, n) for o in (0, 1) for s, n in enumerate(["New", "Contacted", "Interested", "Won"])], "id int, organizer_id int, name string"),
        "campaigns": frame([(0, 5, "A"), (1, None, "B"), (2, None, None)], "id int, created_by int, name string"),
        "owners": frame([(1, 77)], "organizer_id int, owner_id int"),
        "sequences": frame([(k % 3, k % 2, f"p{k}@X.co", "active" if k % 3 else "paused") for k in range(8)], "campaign_id int, organizer_id int, email string, status string"),
        "affiliations": frame([(k, 100 + k // 2, (k // 2) % 2, None if k % 3 else "Boss", "", None) for k in range(14)], "id long, person_id long, organizer_id int, position string, company_name string, created_at timestamp"),
        "intents": frame([(0, 100, 0, "reply")], "organizer_id int, person_id long, campaign_id int, intent_type string"),
        "history": frame([(101, 1, "click", 0), (101, 1, "open", 5000)], "person_id long, organizer_id int, event_type string, t long").withColumn("occurred_at", F.timestamp_seconds("t")).drop("t"),
    }


def reply_mail(spark, n=120):
    rnd = random.Random(7)
    rows = []
    for k in range(n):
        who = rnd.randrange(9)
        body = rnd.choice([None, "", "thanks", f"Hi\n-- \nAnn Lee{k}\nSales Manager\nFirm {k}\n+49 30 12345{k:02d}", f"Hi\n-- \nJoe{k}x\nFirm {k}"])
        to = rnd.choice([None, "me@x.co", f"me@x.co, Rep <rep+C-0000000{who % 3}-r-0000000{who}@x.co>", "rep+c-00000000-r-00000000@x.co"])
        rows.append((k, rnd.choice([f"P{who}@x.co", f"N <p{who}@X.CO>", None]), to, rnd.choice([None, "Re: hi", "Re: hi", "OOO", "Re: " + "x" * 300]), rnd.choice([None, None, None, "Auto-Submitted: no", "Precedence: bulk"]), body, k * 1000))
    return spark.createDataFrame(rows, "mail_id long, sender string, receiver string, subject string, headers string, body string, t long").withColumn("received_at", F.timestamp_seconds("t")).drop("t")


def test_reply_batches_equal_one_and_may_be_repeated(spark, tmp_path):
    from rosterflow.streaming import replies as rp

    out, mail = str(tmp_path / "out"), reply_mail(spark)
    write = rp.apply_replies(out, lambda: reply_tables(spark), buckets=2)
    names = ("events", "intents", "states", "activities", "people", "affiliations", "sequence_stops", "items")

    def held(name, drop=("batch",)):
        df = spark.read.parquet(f"{out}/{name}")
        return sorted(map(str, df.select([c for c in df.columns if c not in drop]).collect()))

    for b in range(3):
        batch = mail.filter(F.col("mail_id").between(b * 40, b * 40 + 39))
        write(batch, b)
        if b == 1:  # again
            was = {n: held(n, ()) for n in names}
            write(batch.orderBy(F.desc("mail_id")), b)
            assert {n: held(n, ()) for n in names} == was
    given = reply_tables(spark)
    whole = rp.effects(rp.resolved(mail, given.pop("recipients"), given["persons"]), **given)
    for name in ("events", "intents", "sequence_stops", "activities"):
        columns = sorted(whole[name].columns)
        assert sorted(map(str, spark.read.parquet(f"{out}/{name}").select(columns).collect())) == sorted(map(str, whole[name].select(columns).collect())), name
    assert whole["events"].count() > 10 and whole["people"].count() > 2
    for name, key in (("people", "person_id"), ("affiliations", "id")):
        last = {}
        for r in spark.read.parquet(f"{out}/{name}").orderBy("batch").collect():
            last.setdefault(r[key], {})
            for c, v in r.asDict().items():
                if v is not None and c not in ("batch", key):
                    assert c == "organizer_id" or c not in last[r[key]]  # a blank is filled once
                    last[r[key]][c] = v
        assert last == {r[key]: {c: v for c, v in r.asDict().items() if v is not None and c != key} for r in whole[name].collect()}
    scores = {r.person_id: r.engagement_score for r in spark.read.parquet(f"{out}/items").orderBy("last_activity_at").collect()}
    assert scores == {r.person_id: r.engagement_score for r in whole["items"].collect()}
    empty = mail.limit(0)
    write(empty, 3)
    assert len(held("events")) == whole["events"].count()

"""Inbound replies: one micro-batch of mail gives events, intents, recipient states, activities, stage moves, sequence stops, items and
what the signatures tell of people, each of which may be written again without harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signature import parse_signature
from ..operators import events as ev
from .ingest import is_auto_reply
from .store import BucketStore

#: States in which a recipient may answer by its address alone; early stages, the one that a reply leads to; a test's tag.
ANSWERING = ("sent", "delivered", "opened", "clicked")
EARLY, INTERESTED = ("New", "Contacted"), "Interested"
TEST_TAG = "00000000"
TAG = r"\+c-([a-f0-9]{8})-r-([a-f0-9]{8})@"
#: What a signature may fill, in the order in which activities name it.
FILLED = ("phone", "first_name", "last_name", "position", "company_name")


def bare_address(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract(x, "<([^>]+)>", 1), F.lit("")), x)))


def tag_of(receivers: Column) -> Column:
    """struct(campaign, recipient): the first tag among comma-separated addresses, else null."""
    tags = F.transform(F.split(F.coalesce(receivers, F.lit("")), ","), lambda a: F.struct(F.regexp_extract(bare_address(a), TAG, 1).alias("campaign"), F.regexp_extract(bare_address(a), TAG, 2).alias("recipient")))
    return F.get(F.filter(tags, lambda t: t["campaign"] != ""), F.lit(0))


def resolved(mail: DataFrame, recipients: DataFrame, persons: DataFrame) -> DataFrame:
    """Mail that someone wrote, with the recipient it answers and the person behind it: by the tag in an address, else by the sender's
    recipient that was last sent something. Automatic and test mail, and mail without a recipient, goes.

    mail: mail_id, sender, receiver, subject, headers, body, received_at. recipients: recipient_id, organizer_id, campaign_id,
    campaign_short, short_id, email, status, sent_at. persons: id, organizer_id, email and others. Of recipients with one tag, and of
    persons with one address, the least id counts. Rows without a mail_id or a time are kept; a null text holds nothing.
    """
    written = mail.filter(~F.coalesce(is_auto_reply(F.col("subject"), F.col("headers"), F.col("sender")), F.lit(False))).withColumn("tag", tag_of(F.col("receiver")))
    written = written.filter(~F.coalesce((F.col("tag.campaign") == TEST_TAG) & (F.col("tag.recipient") == TEST_TAG), F.lit(False)))
    written = written.withColumns({"campaign_short": F.col("tag.campaign"), "short_id": F.col("tag.recipient"), "sender_key": bare_address(F.col("sender"))}).drop("tag")
    whole = F.struct("recipient_id", "organizer_id", "campaign_id", F.lower("email").alias("email"))
    tagged = recipients.groupBy("campaign_short", "short_id").agg(F.min(whole).alias("by_tag"))
    last = F.struct(F.col("sent_at").isNotNull(), "sent_at", "recipient_id")
    senders = recipients.filter(F.col("status").isin(*ANSWERING)).groupBy(F.lower(F.trim("email")).alias("sender_key")).agg(F.max_by(whole, last).alias("by_sender"))
    found = written.join(tagged, ["campaign_short", "short_id"], "left").join(senders, "sender_key", "left").withColumn("r", F.coalesce("by_tag", "by_sender")).filter("r is not null")
    people = persons.groupBy("organizer_id", F.lower("email").alias("email")).agg(F.min("id").alias("person_id"))
    replies = found.select("mail_id", "received_at", "sender", "subject", "body", "r.*")
    return replies.join(people, ["organizer_id", "email"], "left").select("mail_id", "received_at", "sender", "subject", "body", "recipient_id", "organizer_id", "campaign_id", "email", "person_id")


def signature_fills(known: DataFrame, persons: DataFrame, affiliations: DataFrame) -> DataFrame:
    """person_id with the mail and value that fill each blank field, if any: of a person's replies in order the first with a value. Names
    come from one signature together; position and company belong to the person's latest affiliation (affiliation_id)."""
    order = F.struct("received_at", "mail_id")
    s = known.select("person_id", "organizer_id", order.alias("at"), "mail_id", parse_signature(F.col("body")).alias("s"))
    first = lambda v: F.min_by(F.struct("mail_id", v.alias("value")), F.when(F.coalesce(v, F.lit("")) != "", F.col("at")))
    names = F.split(F.col("s.full_name"), r"\s+")
    says = s.groupBy("person_id", "organizer_id").agg(
        first(F.col("s.phone")).alias("phone"), first(F.get(names, F.lit(0))).alias("first_name"),
        F.min_by(F.struct("mail_id", F.when(F.size(names) > 1, F.array_join(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), " ")).alias("value")), F.when(F.coalesce("s.full_name", F.lit("")) != "", F.col("at"))).alias("last_name"),
        first(F.col("s.title")).alias("position"), first(F.col("s.company")).alias("company_name"),
    )
    latest = affiliations.groupBy("person_id", "organizer_id").agg(F.max_by(F.struct(F.col("id").alias("affiliation_id"), F.col("position").alias("had_position"), F.col("company_name").alias("had_company")), F.struct("created_at", "id")).alias("a"))
    had = persons.select(F.col("id").alias("person_id"), "organizer_id", *[F.col(c).alias(f"had_{c}") for c in ("phone", "first_name", "last_name")])
    both = says.join(had, ["person_id", "organizer_id"]).join(latest, ["person_id", "organizer_id"], "left").select("*", "a.*").drop("a")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    may = {
        "phone": blank("had_phone"), "first_name": blank("had_first_name"), "last_name": blank("had_first_name") & blank("had_last_name") & F.col("last_name.value").isNotNull(),
        "position": F.col("affiliation_id").isNotNull() & blank("had_position"), "company_name": F.col("affiliation_id").isNotNull() & blank("had_company"),
    }
    return both.select("person_id", "organizer_id", "affiliation_id", *[F.when(may[c], F.col(c)).alias(c) for c in FILLED])


def effects(replies: DataFrame, persons: DataFrame, stages: DataFrame, campaigns: DataFrame, owners: DataFrame, sequences: DataFrame, affiliations: DataFrame, intents: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """What a batch of resolved() replies changes, as tables by name, as if its replies came one after another in order of time.

    persons: id, organizer_id, email, first_name, last_name, phone, stage_id; stages: id, organizer_id, name; campaigns: id, created_by,
    name; owners: organizer_id, owner_id; sequences: campaign_id, organizer_id, email, status; affiliations: id, person_id, organizer_id,
    position, company_name, created_at; intents: organizer_id, person_id, campaign_id, intent_type, those there already; history: events
    before the batch. Only events, states and sequence stops need no person. An item's score is that of the 30 days before its person's
    last reply in the batch, whose replies it counts. An empty batch changes nothing.
    """
    known = replies.filter("person_id is not null")
    events = replies.select("organizer_id", "campaign_id", "recipient_id", "person_id", F.lit("reply").alias("event_type"), "email", F.col("received_at").alias("occurred_at"), F.substring("body", 1, 2000).alias("text"), "mail_id")
    keys = ["organizer_id", "person_id", "campaign_id"]
    fresh = known.groupBy(*keys).agg(F.min("received_at").alias("occurred_at"))
    fresh = fresh.join(intents.filter("intent_type = 'reply'").select(*keys), keys, "left_anti").withColumn("intent_type", F.lit("reply"))
    states = replies.groupBy("recipient_id").agg(F.max("received_at").alias("replied_at")).withColumn("status", F.lit("replied"))

    stage = stages.select(F.col("id").alias("stage_id"), "organizer_id", F.col("name").alias("from_stage"))
    goal = stages.filter(F.col("name") == INTERESTED).groupBy("organizer_id").agg(F.min("id").alias("to_stage_id"))
    who = known.groupBy("person_id", "organizer_id").agg(F.min(F.struct("received_at", "mail_id")).alias("at"), F.max("received_at").alias("last_at"), F.count("*").alias("n"))
    people = persons.select(F.col("id").alias("person_id"), "organizer_id", "stage_id")
    moved = who.join(people, ["person_id", "organizer_id"]).join(stage, ["stage_id", "organizer_id"], "left").join(goal, "organizer_id")
    moved = moved.filter(F.col("stage_id").isNull() | F.col("from_stage").isin(*EARLY)).select("person_id", "organizer_id", "from_stage", "to_stage_id", F.col("at.received_at").alias("moved_at"), F.col("at.mail_id").alias("mail_id"))

    fills = signature_fills(known, persons, affiliations)
    changed = fills.join(moved.select("person_id", "organizer_id", "to_stage_id", "moved_at"), ["person_id", "organizer_id"], "left")
    changed = changed.select("person_id", "organizer_id", F.col("to_stage_id").alias("stage_id"), "moved_at", *[F.col(f"{c}.value").alias(c) for c in FILLED[:3]])
    changed = changed.filter("coalesce(cast(stage_id as string), phone, first_name, last_name) is not null")
    places = fills.select(F.col("affiliation_id").alias("id"), "position.value", F.col("company_name.value").alias("company_name")).withColumnRenamed("value", "position").filter("coalesce(position, company_name) is not null")

    said = known.select("person_id", "organizer_id", F.lit("email_replied").alias("activity_type"), F.substring(F.coalesce("subject", F.lit("")), 1, 200).alias("description"), F.col("received_at").alias("occurred_at"), "mail_id")
    stepped = moved.select("person_id", "organizer_id", F.lit("status_change").alias("activity_type"), F.lit("Auto-moved to Interested (reply received)").alias("description"), F.col("moved_at").alias("occurred_at"), "mail_id")
    each = F.filter(F.array(*[F.struct(F.col(f"{c}.mail_id").alias("mail_id"), F.lit(k).alias("k"), F.lit(c).alias("field")) for k, c in enumerate(FILLED)]), lambda x: x["mail_id"].isNotNull())
    learned = fills.select("person_id", "organizer_id", F.explode(each).alias("f")).groupBy("person_id", "organizer_id", "f.mail_id").agg(F.array_sort(F.collect_list(F.struct("f.k", "f.field")))["field"].alias("fields"))
    learned = learned.join(known.groupBy("mail_id").agg(F.min("received_at").alias("occurred_at")), "mail_id").select("person_id", "organizer_id", F.lit("auto_enrichment").alias("activity_type"), F.concat(F.lit("Auto-enriched from reply signature: "), F.array_join("fields", ", ")).alias("description"), "occurred_at", "mail_id")

    stopped = replies.select("campaign_id", "organizer_id", "email").distinct()
    live = sequences.filter("status = 'active'").withColumn("email", F.lower("email")).join(stopped, ["campaign_id", "organizer_id", "email"], "left_semi")
    stops = live.select("campaign_id", "organizer_id", "email", F.lit("replied").alias("status"))

    past = history.join(who.select("person_id", "organizer_id", "last_at"), ["person_id", "organizer_id"]).filter(F.col("occurred_at") >= F.col("last_at") - F.make_dt_interval(F.lit(30)))
    score = past.groupBy("person_id", "organizer_id").agg(F.sum(ev.weight()).alias("past"))
    made = campaigns.select(F.col("id").alias("campaign_id"), "created_by", "name")
    items = known.join(made, "campaign_id").join(owners, "organizer_id", "left").join(who.select("person_id", "organizer_id", "n"), ["person_id", "organizer_id"]).join(score, ["person_id", "organizer_id"], "left")
    items = items.withColumn("assigned_to", F.coalesce("created_by", "owner_id")).filter("assigned_to is not null").select(
        "person_id", "organizer_id", "campaign_id", "assigned_to", F.lit("reply_received").alias("trigger_reason"), F.concat(F.lit('Reply received from campaign "'), F.coalesce("name", F.lit("unknown")), F.lit('"')).alias("trigger_detail"),
        F.lit(1).alias("priority"), F.lit("open").alias("status"), F.col("received_at").alias("last_activity_at"), (F.coalesce("past", F.lit(0)) + ev.WEIGHTS["reply"] * F.col("n")).alias("engagement_score"), "mail_id",
    )
    return {"events": events, "intents": fresh, "states": states, "activities": said.unionByName(stepped).unionByName(learned), "people": changed, "affiliations": places, "sequence_stops": stops, "items": items}


def over(base: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """base with the changes' fields where they are filled."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    return base.join(new, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def apply_replies(out: str, tables: Callable[[], dict[str, DataFrame]], buckets: int = 64):
    """For foreachBatch: writes effects() of each batch of mail under ``out``, a folder for each table and batch.

    tables gives recipients and the other tables of effects() as they were before the stream; what earlier batches changed of people,
    affiliations, sequences and intents lies in BucketStores beside the outputs, of which a batch reads what its keys touch. A batch that
    is run again sees only what batches before it left, and so writes the same rows into the same folders.
    """

    def write(mail: DataFrame, batch: int) -> None:
        spark = mail.sparkSession
        given = tables()
        text = lambda kinds: T.StructType([T.StructField(*x) for x in kinds])
        kind = lambda t, c: given[t].schema[c].dataType
        person, place = kind("persons", "id"), kind("affiliations", "id")
        organizer, campaign = kind("persons", "organizer_id"), kind("recipients", "campaign_id")
        people = BucketStore(spark, f"{out}/_people", text([("person_id", person), ("organizer_id", organizer), ("stage_id", kind("persons", "stage_id")), *[(c, T.StringType()) for c in FILLED[:3]]]), ["person_id", "organizer_id"], buckets)
        places = BucketStore(spark, f"{out}/_affiliations", text([("id", place), ("position", T.StringType()), ("company_name", T.StringType())]), ["id"], buckets)
        ended = BucketStore(spark, f"{out}/_sequences", text([("campaign_id", campaign), ("organizer_id", organizer), ("email", T.StringType())]), ["campaign_id", "organizer_id", "email"], buckets)
        had = BucketStore(spark, f"{out}/_intents", text([("organizer_id", organizer), ("person_id", person), ("campaign_id", campaign), ("intent_type", T.StringType())]), ["organizer_id", "person_id", "campaign_id", "intent_type"], buckets)
        replied = BucketStore(spark, f"{out}/_replied", text([("person_id", person), ("organizer_id", organizer), ("times", T.ArrayType(T.TimestampType()))]), ["person_id", "organizer_id"], buckets)

        replies = resolved(mail, given["recipients"], given["persons"])
        replies.write.mode("overwrite").parquet(f"{out}/replies/batch={batch}")
        replies = spark.read.schema(replies.schema).parquet(f"{out}/replies/batch={batch}")
        ids = replies.filter("person_id is not null").select("person_id", "organizer_id").distinct()
        persons = given["persons"].join(ids.withColumnRenamed("person_id", "id"), ["id", "organizer_id"], "left_semi")
        persons = over(persons, people.lookup(ids, batch).withColumnRenamed("person_id", "id"), ["id", "organizer_id"], ["stage_id", *FILLED[:3]])
        affiliations = given["affiliations"].join(ids, ["person_id", "organizer_id"], "left_semi")
        affiliations = over(affiliations, places.lookup(affiliations, batch), ["id"], ["position", "company_name"])
        keys = replies.select("campaign_id", "organizer_id", "email")
        sequences = given["sequences"].withColumn("email", F.lower("email")).join(ended.lookup(keys, batch), ["campaign_id", "organizer_id", "email"], "left_anti")
        asked = replies.filter("person_id is not null").select("organizer_id", "person_id", "campaign_id", F.lit("reply").alias("intent_type"))
        intents = given["intents"].select(*had.keys).unionByName(had.lookup(asked, batch))
        recent = replied.lookup(ids, batch)
        earlier = recent.select("person_id", "organizer_id", F.lit("reply").alias("event_type"), F.explode("times").alias("occurred_at"))
        history = given["history"].select("person_id", "organizer_id", "event_type", "occurred_at").unionByName(earlier)

        found = effects(replies, persons, given["stages"], given["campaigns"], given["owners"], sequences, affiliations, intents, history)
        for name, df in found.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        kept = {name: spark.read.schema(df.schema).parquet(f"{out}/{name}/batch={batch}") for name, df in found.items()}
        values = ("stage_id", *FILLED[:3])
        before = people.lookup(ids, batch).select("person_id", "organizer_id", *[F.col(c).alias(f"had_{c}") for c in values])
        people.put(kept["people"].join(before, ["person_id", "organizer_id"], "left").select("person_id", "organizer_id", *[F.coalesce(c, f"had_{c}").alias(c) for c in values]), batch)
        old = places.lookup(kept["affiliations"], batch).select("id", F.col("position").alias("p"), F.col("company_name").alias("c"))
        places.put(kept["affiliations"].join(old, "id", "left").select("id", F.coalesce("position", "p").alias("position"), F.coalesce("company_name", "c").alias("company_name")), batch)
        ended.put(kept["sequence_stops"].select("campaign_id", "organizer_id", "email").distinct(), batch)
        had.put(kept["intents"].select(*had.keys), batch)
        new = replies.filter("person_id is not null").select("person_id", "organizer_id", F.col("received_at").alias("at"))
        times = new.unionByName(recent.select("person_id", "organizer_id", F.explode("times").alias("at"))).groupBy("person_id", "organizer_id").agg(F.collect_list("at").alias("times"))
        replied.put(times.withColumn("times", F.filter("times", lambda t: t >= F.array_max("times") - F.make_dt_interval(F.lit(30)))), batch)

    return write

"""Provider events as a stream: ingest, idempotent append, recipient state, rules. The batch functions do the work of each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import events as ev
from ..operators.merge import insert_or_ignore
from .store import BucketStore

#: Provider types and what they are here. Other types are left out.
TYPES = {
    "processed": "sent", "delivered": "delivered", "open": "open", "click": "click", "bounce": "bounce", "dropped": "dropped", "deferred": "deferred",
    "spamreport": "spamreport", "unsubscribe": "unsubscribe", "group_unsubscribe": "unsubscribe", "reply": "reply",
}
SCHEMA = T.StructType([
    T.StructField("email", T.StringType()), T.StructField("event", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("sg_event_id", T.StringType()),
    T.StructField("campaign_id", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("reason", T.StringType()),
])
KEY = ["campaign_id", "event_type", "email", "provider_event_id"]


def canonical(raw: DataFrame) -> DataFrame:
    """Provider rows in canonical form; event time is the provider's second."""
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return raw.select(
        "campaign_id", F.element_at(names, F.col("event")).alias("event_type"), F.lower(F.trim("email")).alias("email"), F.col("sg_event_id").alias("provider_event_id"),
        "url", "reason", F.timestamp_seconds("timestamp").alias("occurred_at"),
    ).filter("event_type is not null and email is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return canonical(spark.readStream.schema(SCHEMA).json(path))


def append_once(store: str, keys: list[str] | None = None, order: list[str] | None = None, need: str = "provider_event_id", buckets: int = 256, runs: int = 8):
    """For foreachBatch: adds what the store does not have by the event key, the first of equal ones. A batch that is run again adds
    nothing twice: its rows stand in a folder of its own, and it looks only at the keys of batches before it.

    The keys stand apart in a BucketStore, of which a batch reads the buckets of its own keys; the events themselves are never read.
    Events without an id always count as new.
    """
    keys, order = keys or KEY, order or ["occurred_at", "url"]

    def write(batch: DataFrame, batch_id: int) -> None:
        held = BucketStore(batch.sparkSession, f"{store.rstrip('/')}/_keys", batch.select(*keys).schema, keys, buckets, runs)
        named = batch.filter(F.col(need).isNotNull())
        fresh = insert_or_ignore(held.lookup(named, batch_id), batch, keys, order, need=need)
        fresh.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)
        held.put(named.select(*keys).distinct(), batch_id)

    return write


def start_ingest(events: DataFrame, store: str, checkpoint: str):
    return events.writeStream.foreachBatch(append_once(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by type; a window closes once the stream is past it by ``late``."""
    return events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", size), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


#: What marks an automatic reply.
AUTO_SUBJECTS = (
    "out of office", "automatic reply", "auto-reply", "autoreply", "away from office", "on vacation", "delivery status notification", "undeliverable",
    "mail delivery failed", "delivery failure",
)
AUTO_SENDERS = ("mailer-daemon", "noreply", "no-reply", "postmaster", "mail-daemon")


def is_auto_reply(subject, headers, sender):
    """Columns in, a Column out: do headers, subject or sender say that nobody wrote this?"""
    h, s, f = F.lower(F.coalesce(headers, F.lit(""))), F.lower(F.trim(F.coalesce(subject, F.lit("")))), F.lower(F.coalesce(sender, F.lit("")))
    return (
        h.rlike(r"auto-submitted:\s*(?!no\b)\S+") | h.contains("x-auto-response-suppress:") | h.rlike(r"precedence:\s*(bulk|junk|auto[_-]?reply)")
        | s.rlike("|".join(AUTO_SUBJECTS)) | s.rlike(r"^ooo([\s:]|$)") | f.rlike("|".join(AUTO_SENDERS))
    )


def tagged_ids(address):
    """(campaign prefix, recipient prefix) of a plus-address, else nulls."""
    part = lambda k: F.nullif(F.regexp_extract(F.lower(address), r"\+c-([a-f0-9]{8})-r-([a-f0-9]{8})@", k), F.lit(""))
    return part(1), part(2)


def inbound_replies(mail: DataFrame, recipients: DataFrame) -> DataFrame:
    """Written replies with the recipient that they answer: by the tag in the address, else the sender's most recent recipient.

    mail: mail_id, sender, receiver, subject, headers, received_at; recipients: recipient_id, short_id, campaign_short, email, created_at.
    """
    campaign, recipient = tagged_ids(F.col("receiver"))
    written = mail.filter(~is_auto_reply(F.col("subject"), F.col("headers"), F.col("sender"))).withColumns({"campaign_short": campaign, "short_id": recipient, "email_key": F.lower(F.trim("sender"))})
    tagged = recipients.groupBy("campaign_short", "short_id").agg(F.min("recipient_id").alias("by_tag"))
    latest = recipients.groupBy(F.lower("email").alias("email_key")).agg(F.max_by("recipient_id", F.struct("created_at", "recipient_id")).alias("by_sender"))
    found = written.join(tagged, ["campaign_short", "short_id"], "left").join(latest, "email_key", "left")
    return found.select("mail_id", F.coalesce("by_tag", "by_sender").alias("recipient_id"), F.lit("reply").alias("event_type"), F.col("received_at").alias("occurred_at"), F.substring("subject", 1, 200).alias("subject")).filter("recipient_id is not null")


def reconcile(events: DataFrame, items: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The periodic job: items with due snoozes ended, and persons to act on."""
    current = ev.unsnooze(items, as_of)
    return current, ev.engaged_hot(events, current, as_of)

"""Engagement events: recipient state, scores, rules, sequences. All take as_of instead of the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: What events are worth, and the words of pages that show interest.
WEIGHTS = {"open": 1, "click": 3, "reply": 10}
INACTIVE_PENALTY = -2
HIGH_VALUE = ("floorplan", "pricing", "register", "book", "stand", "booth")
BOUNCES = ("bounce", "dropped", "spamreport")


def ago(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def weight(kind: str = "event_type") -> Column:
    out = F.lit(0)
    for k, v in WEIGHTS.items():
        out = F.when(F.col(kind) == k, v).otherwise(out)
    return out


def engagement_recent(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """person_id, score over the last days."""
    return events.filter(F.col("occurred_at") >= ago(as_of, days)).groupBy("person_id").agg(F.sum(weight()).alias("score"))


def engagement_all_time(events: DataFrame, as_of: str, idle_days: int = 7) -> DataFrame:
    """person_id, score over all events, less for those idle for longer."""
    idle = F.when(F.max("occurred_at") < ago(as_of, idle_days), INACTIVE_PENALTY).otherwise(0)
    return events.groupBy("person_id").agg((F.sum(weight()) + idle).alias("score"))


def recipient_state(sent: DataFrame, events: DataFrame) -> DataFrame:
    """State of each recipient after its events in order of time and id, by aggregates alone.

    delivered counts only while the status is sent, that is, before any open, click or bounce. Opens and clicks keep their first time
    and are counted; the status is that of the last event that sets it. A reply or an unsubscription, once there, stays, but for a
    bounce. sent: recipient_id, status, with the state before; events: recipient_id, event_type, occurred_at, id, reason.
    """
    return settle(sent.join(folded_events(events), "recipient_id", "left"))


#: How an event leaves a recipient; others do not set the status. All bounces leave it bounced.
STATUS_OF = {"open": "opened", "click": "clicked", "reply": "replied", **dict.fromkeys(BOUNCES, "bounced")}


def folded_events(events: DataFrame) -> DataFrame:
    """What a recipient's state needs of its events: firsts and lasts in order of time and id, and counts. Parts of it merge in any order."""
    when = F.struct("occurred_at", "id")
    sets = F.col("event_type").isin(*STATUS_OF)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair]), F.col("event_type"))
    return events.groupBy("recipient_id").agg(
        F.min(F.when(sets, when)).alias("first_set"),
        F.max(F.when(F.col("event_type") == "reply", when)).alias("last_reply"),
        F.max(F.when(F.col("event_type").isin(*BOUNCES), when)).alias("last_bounce"),
        F.max_by(name, F.when(sets, when)).alias("last_status"),
        F.max(F.when(F.col("event_type").isin("open", "click"), when)).alias("last_touch"),
        F.min(F.when(F.col("event_type") == "delivered", when)).alias("first_delivered"),
        F.min(F.when(F.col("event_type") == "open", F.col("occurred_at"))).alias("opened_at"),
        F.min(F.when(F.col("event_type") == "click", F.col("occurred_at"))).alias("clicked_at"),
        F.max(F.when(F.col("event_type").isin(*BOUNCES), F.col("occurred_at"))).alias("bounced_at"),
        F.max_by(F.when(F.col("event_type") == "spamreport", "Spam report").otherwise(F.coalesce("reason", "event_type")), F.when(F.col("event_type").isin(*BOUNCES), when)).alias("last_error"),
        F.count_if(F.col("event_type") == "open").alias("open_count"), F.count_if(F.col("event_type") == "click").alias("click_count"),
        F.max(F.when(F.col("event_type") == "reply", F.col("occurred_at"))).alias("replied_at"),
    )


def settle(s: DataFrame) -> DataFrame:
    """The state of recipients from their status before and folded_events()."""
    delivers = (F.col("status") == "sent") & F.col("first_delivered").isNotNull() & (F.col("first_set").isNull() | (F.col("first_delivered") < F.col("first_set")))
    held = F.col("status").isin("replied", "unsubscribed")
    replied = F.col("last_reply").isNotNull() & (F.col("last_bounce").isNull() | (F.col("last_reply") > F.col("last_bounce")))
    after_bounce = F.col("last_bounce").isNotNull() & (F.col("last_touch").isNull() | (F.col("last_bounce") > F.col("last_touch")))
    status = (
        F.when(replied, "replied").when(after_bounce, "bounced").when(held & F.col("last_bounce").isNull(), F.col("status"))
        .when(F.col("last_status").isNotNull(), F.col("last_status")).when(delivers, "delivered").otherwise(F.col("status"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return s.select("recipient_id", status.alias("status"), F.when(delivers, F.col("first_delivered.occurred_at")).alias("delivered_at"), "opened_at", "clicked_at", "bounced_at", "replied_at", "last_error", zero("open_count"), zero("click_count"))


def attribute(events: DataFrame, recipients: DataFrame) -> DataFrame:
    """Events with the recipient of their e-mail: the most recent that was sent something, else the most recent at all."""
    key = F.lower(F.trim("email"))
    latest = recipients.withColumn("email_key", key).groupBy("email_key").agg(F.max_by("recipient_id", F.struct(F.col("status").isin("sent", "delivered", "opened", "clicked"), "created_at", "recipient_id")).alias("recipient_id"))
    return events.withColumn("email_key", key).join(latest, "email_key").drop("email_key")


def intents(events: DataFrame) -> DataFrame:
    """The first reply and the first click of each person and campaign."""
    kind = F.when(F.col("event_type") == "reply", "reply").when(F.col("event_type") == "click", "click_through")
    return events.withColumn("intent_type", kind).filter("intent_type is not null and person_id is not null").groupBy("person_id", "campaign_id", "intent_type").agg(F.min("occurred_at").alias("occurred_at"))


def engaged_hot(events: DataFrame, items: DataFrame | None, as_of: str) -> DataFrame:
    """person_id, reason, campaign_id, last_activity_at, engagement_score of persons to act on.

    (A) opens on two days or more of the last week, else (D) a high-value address among the last five clicks of 30 days. Not for those
    who replied, and not where an open item of the kind exists. Over all persons at once.
    """
    e = events.filter(F.col("person_id").isNotNull())
    week, month = F.col("occurred_at") >= ago(as_of, 7), F.col("occurred_at") >= ago(as_of, 30)
    opens = e.filter((F.col("event_type") == "open") & week).groupBy("person_id").agg(F.countDistinct(F.to_date("occurred_at")).alias("days"), F.max(F.struct("occurred_at", "id", "campaign_id")).alias("at")).filter("days >= 2")
    opens = opens.select("person_id", F.concat(F.lit("Opened on "), F.col("days").cast("string"), F.lit(" different days in the last week")).alias("reason"), "at.campaign_id", "at.occurred_at")
    clicks = e.filter((F.col("event_type") == "click") & month).withColumn("_rank", F.row_number().over(W.partitionBy("person_id").orderBy(F.desc("occurred_at"), F.desc("id")))).filter("_rank <= 5")
    clicks = clicks.filter(F.lower(F.coalesce("url", F.lit(""))).rlike("|".join(HIGH_VALUE))).groupBy("person_id").agg(F.max(F.struct("occurred_at", "id", "campaign_id", "url")).alias("at"))
    clicks = clicks.select("person_id", F.concat(F.lit("Clicked high-value link: "), F.substring("at.url", 1, 80)).alias("reason"), "at.campaign_id", "at.occurred_at")
    found = opens.unionByName(clicks.join(opens.select("person_id"), "person_id", "left_anti"))
    found = found.join(e.filter("event_type = 'reply'").select("person_id"), "person_id", "left_anti")
    if items is not None:
        found = found.join(items.filter("trigger_reason = 'engaged_hot' and status in ('open', 'in_progress')").select("person_id"), "person_id", "left_anti")
    score = engagement_recent(e, as_of)
    return found.join(score, "person_id", "left").select("person_id", "reason", "campaign_id", F.col("occurred_at").alias("last_activity_at"), F.coalesce("score", F.lit(0)).alias("engagement_score"))


def sequence_exhausted(recipients: DataFrame, events: DataFrame, items: DataFrame) -> DataFrame:
    """Persons whose sequence ended without a reply to its campaign and without an open item of the kind."""
    done = recipients.filter("status = 'completed' and person_id is not null").select("person_id", "campaign_id").distinct()
    done = done.join(events.filter("event_type = 'reply'").select("person_id", "campaign_id"), ["person_id", "campaign_id"], "left_anti")
    return done.join(items.filter("trigger_reason = 'sequence_exhausted' and status in ('open', 'in_progress')").select("person_id"), "person_id", "left_anti").select("person_id").distinct()


def unsnooze(items: DataFrame, as_of: str) -> DataFrame:
    due = (F.col("status") == "snoozed") & (F.col("snoozed_until") <= F.lit(as_of).cast("timestamp"))
    return items.withColumns({"status": F.when(due, "open").otherwise(F.col("status")), "snoozed_until": F.when(due, None).otherwise(F.col("snoozed_until"))})


def advance_sequences(recipients: DataFrame, steps: DataFrame, events: DataFrame, as_of: str, most: int = 50) -> DataFrame:
    """Due recipients, at most ``most`` at a time, with what to do: send, skip (the step's condition does not hold) or complete, and
    their next step and time. recipients: campaign_id, person_id, current_step, status, next_send_at."""
    now = F.lit(as_of).cast("timestamp")
    due = recipients.filter((F.col("status") == "active") & (F.col("next_send_at") <= now)).orderBy("next_send_at", "campaign_id", "person_id").limit(most)
    seen = events.groupBy("campaign_id", "person_id").agg(F.count_if(F.col("event_type") == "reply").alias("replies"), F.count_if(F.col("event_type") == "open").alias("opens"))
    here = steps.select("campaign_id", F.col("sequence_order").alias("current_step"), "condition")
    coming = steps.select("campaign_id", (F.col("sequence_order") - 1).alias("current_step"), F.col("delay_days").alias("next_delay"))
    d = due.join(here, ["campaign_id", "current_step"], "left").join(coming, ["campaign_id", "current_step"], "left").join(seen, ["campaign_id", "person_id"], "left")
    holds = F.when(F.col("condition") == "no_reply", F.coalesce("replies", F.lit(0)) == 0).when(F.col("condition") == "no_open", F.coalesce("opens", F.lit(0)) == 0).otherwise(F.lit(True))
    return d.select(
        "campaign_id", "person_id", "current_step",
        F.when(F.col("condition").isNull(), "complete").when(holds, "send").otherwise("skip").alias("action"),
        F.when(F.col("next_delay").isNotNull(), F.col("current_step") + 1).alias("next_step"),
        F.when(F.col("next_delay").isNotNull(), now + F.make_dt_interval(F.col("next_delay"))).alias("next_send_at"),
    )


def stop_sequences(recipients: DataFrame, stops: DataFrame) -> DataFrame:
    """stops: email, campaign_id, kind. An unsubscription ends all of an address's sequences, a bounce or reply its campaign's."""
    everywhere = stops.filter("kind = 'unsubscribe'").select(F.lower("email").alias("email_key")).distinct().withColumn("_all", F.lit(True))
    one = stops.filter("kind != 'unsubscribe'").groupBy(F.lower("email").alias("email_key"), "campaign_id").agg(F.min("kind").alias("_kind"))
    r = recipients.withColumn("email_key", F.lower("email")).join(everywhere, "email_key", "left").join(one, ["email_key", "campaign_id"], "left")
    status = F.when(F.col("status") != "active", F.col("status")).when(F.col("_all"), "unsubscribed").when(F.col("_kind") == "bounce", "bounced").when(F.col("_kind") == "reply", "replied").otherwise(F.col("status"))
    return r.withColumn("status", status).select(*recipients.columns)


def reply_health(events: DataFrame, as_of: str) -> DataFrame:
    """One row: replies in 7 and 30 days, the last one, and error, warning or active."""
    r = events.filter("event_type = 'reply'").agg(F.count_if(F.col("occurred_at") > ago(as_of, 7)).alias("replies_7d"), F.count_if(F.col("occurred_at") > ago(as_of, 30)).alias("replies_30d"), F.max("occurred_at").alias("last_reply"))
    return r.withColumn("status", F.when((F.col("replies_7d") == 0) & (F.col("replies_30d") == 0), "error").when(F.col("replies_7d") == 0, "warning").otherwise("active"))


def crawl_stop(pages: DataFrame, empty: int = 3, same: int = 2) -> DataFrame:
    """job_id, stop_page: where a crawl of pages in order ends, after so many empty pages or equal contents in a row; null if it does
    not. A job's pages are a bounded few."""
    w = W.partitionBy("job_id").orderBy("page")
    p = pages.withColumn("blank", F.col("contacts") == 0).withColumn("again", F.coalesce(F.col("content_hash") == F.lag("content_hash").over(w), F.lit(False)))
    for flag, run in (("blank", "blank_run"), ("again", "again_run")):
        p = p.withColumn("_part", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w)).withColumn(run, F.sum(F.when(F.col(flag), 1).otherwise(0)).over(W.partitionBy("job_id", "_part").orderBy("page")))
    return p.groupBy("job_id").agg(F.min(F.when((F.col("blank_run") >= empty) | (F.col("again_run") >= same), F.col("page"))).alias("stop_page"))

"""Rules over recipients, action items and jobs. Each gives the new state of its table; all take as_of instead of the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import ago, engaged_hot, engagement_all_time, engagement_recent, unsnooze

LIVE = ("open", "in_progress")


def pause(recipients: DataFrame, campaign_id: int) -> DataFrame:
    """A campaign's active recipients wait."""
    held = (F.col("campaign_id") == campaign_id) & (F.col("status") == "active")
    return recipients.withColumn("status", F.when(held, "paused").otherwise(F.col("status")))


def resume(recipients: DataFrame, steps: DataFrame, as_of: str) -> DataFrame:
    """Paused recipients go on: due their step's delay after what they were last sent, or at once if they were sent nothing."""
    delay = steps.select("campaign_id", F.col("sequence_order").alias("current_step"), F.col("delay_days").alias("_delay"))
    r = recipients.join(delay, ["campaign_id", "current_step"], "left")
    due = F.coalesce(F.col("last_sent_at") + F.make_dt_interval(F.coalesce("_delay", F.lit(0))), F.lit(as_of).cast("timestamp"))
    paused = F.col("status") == "paused"
    return r.withColumns({"next_send_at": F.when(paused, due).otherwise(F.col("next_send_at")), "status": F.when(paused, "active").otherwise(F.col("status"))}).select(*recipients.columns)


def reply_received(events: DataFrame, campaigns: DataFrame, limit: int = 80) -> DataFrame:
    """An item for each person's latest reply, for whoever made the campaign. Replies are not held against items that are there."""
    latest = events.filter("event_type = 'reply' and person_id is not null").groupBy("person_id", "organizer_id").agg(F.max_by(F.struct("campaign_id", "reason", "occurred_at"), F.struct("occurred_at", "id")).alias("e"))
    made = campaigns.select(F.col("id").alias("campaign_id"), F.col("created_by").alias("assigned_to"), "name")
    said = F.concat(F.lit('Reply received: "'), F.substring("reason", 1, limit), F.lit('"'))
    detail = F.coalesce(said, F.concat(F.lit('Reply received from campaign "'), F.coalesce("name", F.lit("unknown")), F.lit('"')))
    found = latest.select("person_id", "organizer_id", "e.*").join(made, "campaign_id").filter("assigned_to is not null")
    return found.select("person_id", "organizer_id", "campaign_id", "assigned_to", detail.alias("trigger_detail"), F.lit(1).alias("priority"), F.col("occurred_at").alias("last_activity_at"))


def upsert_items(old: DataFrame, new: DataFrame, refreshed: list[str]) -> DataFrame:
    """Items after new ones (a row for each person and reason) came in: a live item of the person and reason is refreshed, else an open
    one is added. Closed items, and those for replies, do not count as live."""
    keys = ["person_id", "trigger_reason"]
    live = F.col("status").isin(*LIVE) & (F.col("trigger_reason") != "reply_received")
    come = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in refreshed], F.lit(True).alias("_come"))
    kept = old.join(come, keys, "left")
    kept = kept.withColumns({c: F.when(live & F.col("_come"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in refreshed})
    added = new.join(old.filter(live).select(*keys), keys, "left_anti").withColumn("status", F.lit("open"))
    columns = [*keys, *refreshed, "status"]
    return kept.select(columns).unionByName(added.select(columns))


def stage_on_reply(persons: DataFrame, events: DataFrame, early: list[int], interested: int) -> DataFrame:
    """Persons who replied while in no stage or an early one move to the stage of the interested; moved says so."""
    replied = events.filter("event_type = 'reply'").select(F.col("person_id").alias("id")).distinct().withColumn("_replied", F.lit(True))
    moves = F.coalesce("_replied", F.lit(False)) & (F.col("stage_id").isNull() | F.col("stage_id").isin(early))
    return persons.join(replied, "id", "left").withColumn("moved", moves).withColumn("stage_id", F.when(F.col("moved"), interested).otherwise(F.col("stage_id"))).drop("_replied")


def fail_stale(jobs: DataFrame, as_of: str, hours: int = 1) -> DataFrame:
    """Jobs that have been running for longer than ``hours`` have failed."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return jobs.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def changed_people(events: DataFrame, since: str, as_of: str, idle_days: int = 7) -> DataFrame:
    """person_id of those whose all-time score may differ from what it was at ``since``: they have events since, or were last seen so long
    before that they count as idle from some moment since on. Other events are not looked at."""
    start, now = F.lit(since).cast("timestamp"), F.lit(as_of).cast("timestamp")
    idle = F.make_dt_interval(F.lit(idle_days))
    at = F.col("occurred_at")
    new = (at > start) & (at <= now)
    lapsed = (at >= start - idle) & (at < now - idle)
    return events.filter("person_id is not null").filter(new | lapsed).select("person_id").distinct()


def refresh_scores(items: DataFrame, events: DataFrame, as_of: str, since: str | None = None) -> DataFrame:
    """items with the all-time score of live ones' persons as of a time, 0 for those without events. With ``since``, at which scores were
    right, only events of changed persons are summed, and other items keep theirs. Events after as_of do not count."""
    past = events.filter(F.col("occurred_at") <= F.lit(as_of).cast("timestamp"))
    live = F.col("status").isin(*LIVE)
    if since is not None:
        who = changed_people(past, since, as_of)
        past = past.join(who, "person_id", "left_semi")
    scores = engagement_all_time(past, as_of).withColumnRenamed("score", "_score")
    out = items.join(scores, "person_id", "left")
    fresh = F.coalesce("_score", F.lit(0)) if since is None else F.coalesce("_score", "engagement_score", F.lit(0))
    return out.withColumn("engagement_score", F.when(live, fresh).otherwise(F.col("engagement_score"))).select(*items.columns)


def reconcile(items: DataFrame, events: DataFrame, sequences: DataFrame, campaigns: DataFrame, as_of: str, since: str | None = None, days: int = 7) -> DataFrame:
    """The periodic job as a new state of items: person_id, trigger_reason, trigger_detail, campaign_id, last_activity_at, engagement_score,
    status, snoozed_until.

    Due snoozes end; persons with events in the last days are held against the hot rule, and those whose sequence ended against its own;
    what is found refreshes live items or adds open ones; then live items get their scores. sequences: campaign_id, person_id, status,
    last_sent_step, updated_at; a campaign that is not there gives no item.
    """
    items = unsnooze(items, as_of)
    recent = events.filter((F.col("occurred_at") >= ago(as_of, days)) & F.col("person_id").isNotNull()).select("person_id").distinct()
    theirs = events.join(recent, "person_id", "left_semi")
    made = campaigns.select(F.col("id").alias("campaign_id"))
    hot = engaged_hot(theirs, items, as_of).join(made, "campaign_id", "left_semi").select("person_id", F.lit("engaged_hot").alias("trigger_reason"), F.col("reason").alias("trigger_detail"), "campaign_id", "last_activity_at", F.col("engagement_score").cast("long").alias("engagement_score"))
    replied = events.filter("event_type = 'reply'").select("person_id", "campaign_id")
    ended = sequences.filter("status = 'completed' and person_id is not null").join(made, "campaign_id", "left_semi").join(replied, ["person_id", "campaign_id"], "left_anti")
    ended = ended.groupBy("person_id").agg(F.max_by(F.struct("campaign_id", "last_sent_step", "updated_at"), F.struct("updated_at", "campaign_id")).alias("s")).select("person_id", "s.*")
    ended = ended.join(items.filter(F.col("status").isin(*LIVE) & (F.col("trigger_reason") == "sequence_exhausted")).select("person_id"), "person_id", "left_anti").join(engagement_recent(events, as_of), "person_id", "left")
    ended = ended.select("person_id", F.lit("sequence_exhausted").alias("trigger_reason"), F.concat(F.lit("Sequence completed — no response after "), F.col("last_sent_step").cast("string"), F.lit(" emails")).alias("trigger_detail"),
        "campaign_id", F.col("updated_at").alias("last_activity_at"), F.coalesce("score", F.lit(0)).cast("long").alias("engagement_score"))
    added = hot.unionByName(ended).withColumns({"status": F.lit("open"), "snoozed_until": F.lit(None).cast("timestamp")})
    columns = ["person_id", "trigger_reason", "trigger_detail", "campaign_id", "last_activity_at", "engagement_score", "status", "snoozed_until"]
    return refresh_scores(items.select(columns).unionByName(added.select(columns)), events, as_of, since)

"""The recipient state machine as a stream: one state per recipient, kept in the state store, right whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import BOUNCES, STATUS_OF, settle

#: Places in time, each as the microsecond and the id of an event; whether the least or the largest counts.
PLACES = {"first_set": min, "first_delivered": min, "last_set": max, "last_reply": max, "last_bounce": max, "last_touch": max}
TIMES = ("opened_at", "clicked_at", "bounced_at", "replied_at")
STATE = T.StructType(
    [T.StructField("status", T.StringType())]
    + [T.StructField(f"{p}_{x}", T.LongType()) for p in PLACES for x in ("at", "id")]
    + [T.StructField(t, T.LongType()) for t in TIMES]
    + [T.StructField(x, T.StringType()) for x in ("last_status", "last_error")]
    + [T.StructField(x, T.LongType()) for x in ("open_count", "click_count")]
)
OUT = T.StructType([T.StructField("recipient_id", T.LongType()), *STATE.fields])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def places_of(kind: str) -> list[str]:
    """The places that an event of a kind may move."""
    if kind == "delivered":
        return ["first_delivered"]
    if kind not in STATUS_OF:
        return []
    own = "last_touch" if kind in ("open", "click") else "last_reply" if kind == "reply" else "last_bounce"
    return ["first_set", "last_set", own]


def advanced(state: dict, kind: str, at: int, number: int, reason: str | None) -> None:
    """One event into a state. Firsts are least, lasts are largest and counts add up, so that the order of events does not matter."""
    here = (at, number)
    for place in places_of(kind):
        was = (state[f"{place}_at"], state[f"{place}_id"])
        if was[0] is None or PLACES[place](was, here) == here:
            state[f"{place}_at"], state[f"{place}_id"] = here
            if place == "last_set":
                state["last_status"] = STATUS_OF[kind]
            elif place == "last_bounce":
                state["last_error"] = "Spam report" if kind == "spamreport" else reason or kind
    if kind in ("open", "click"):
        time, count = ("opened_at", "open_count") if kind == "open" else ("clicked_at", "click_count")
        state[time] = at if state[time] is None else min(state[time], at)
        state[count] = (state[count] or 0) + 1
    elif kind == "reply" or kind in BOUNCES:
        time = "replied_at" if kind == "reply" else "bounced_at"
        state[time] = at if state[time] is None else max(state[time], at)


class RecipientMachine(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("recipient", STATE)

    def _state(self) -> dict:
        now = self.held.get() if self.held.exists() else None
        return dict(zip(STATE.names, now, strict=True)) if now else dict.fromkeys(STATE.names) | {"status": "sent"}

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.held.update(tuple((dict.fromkeys(STATE.names) | {"status": initialState.status}).values()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = self._state()
        for r in rows:
            advanced(state, r.event_type, r.at, r.id, r.reason)
        self.held.update(tuple(state[n] for n in STATE.names))
        yield Row(recipient_id=key[0], **state)

    def close(self) -> None:
        pass


def live_states(events: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """A stream of recipients' states after each micro-batch that holds events of theirs; the latest row of a recipient counts.

    events: a stream of recipient_id, event_type, occurred_at, id, reason. sent: recipient_id, status, the states before the stream begins
    (read once, when it first starts); a recipient without one was sent something. Equal to operators.events.recipient_state() over all
    events so far, in whatever batches and order they come. Each row counts: leave out repeated events before (see store.BucketStore).
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = events.select(F.col("recipient_id").cast("long"), "event_type", F.unix_micros("occurred_at").alias("at"), F.col("id").cast("long").alias("id"), "reason")
    before = None if sent is None else sent.select(F.col("recipient_id").cast("long"), "status").groupBy("recipient_id")
    states = keyed.filter("recipient_id is not null").groupBy("recipient_id").transformWithState(RecipientMachine(), OUT, "Update", "None", before)
    place = lambda p: F.when(F.col(f"{p}_at").isNotNull(), F.struct(F.timestamp_micros(f"{p}_at").alias("occurred_at"), F.col(f"{p}_id").alias("id"))).alias(p)
    return settle(states.select("recipient_id", "status", *[place(p) for p in PLACES], *[F.timestamp_micros(t).alias(t) for t in TIMES], "last_status", "last_error", "open_count", "click_count"))


def start_states(events: DataFrame, table: str, checkpoint: str, sent: DataFrame | None = None):
    """Writes each micro-batch's states under ``table``, in a folder of the batch's own, which a repeated batch writes anew."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return live_states(events, sent).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_states(states: DataFrame) -> DataFrame:
    """The last state of each recipient in the table that start_states() writes."""
    columns = [c for c in states.columns if c not in ("recipient_id", "batch")]
    return states.groupBy("recipient_id").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("recipient_id", "s.*")

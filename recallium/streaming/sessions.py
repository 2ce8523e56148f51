"""Structured Streaming forms of the stateful logic: windowed activity, duplicate events, access counts, recent texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A folder of parquet files as a stream; new files are new events. Time is event time in UTC."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_activity(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once; keys are forgotten behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rate_limited(events: DataFrame, cooldown_ms: int = 300_000) -> DataFrame:
    """Events that come a cooldown after the last one that passed, per user; the state is one time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ms", "event_id"])
        passed = []
        for ms in rows["ms"]:
            ok = last is None or ms - last >= cooldown_ms
            passed.append(ok)
            last = int(ms) if ok else last
        if last is not None:
            state.update((last,))
        yield rows.assign(user_id=key[0])[["user_id", "event_id"]][passed]

    timed = events.select("user_id", "event_id", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def fold_access_counts(events: DataFrame, path: str, checkpoint: str):
    """Counts of views by memory, appended a micro-batch; the batch id makes a repeated batch harmless."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.where("event_type = 'view'").groupBy(F.get_json_object("props", "$.k").alias("memory")).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MESSAGES = "session string, place long, role string, text string, at timestamp"
NEW_TEXTS = "session string, place long, role string, text string, turn long, recent array<string>"


def new_texts(messages: DataFrame, recent: int = 6, ttl: str = "24 hours") -> DataFrame:
    """messages (MESSAGES), in which a session may send its whole history again -> the texts not seen before, each
    with its turn (user messages so far) and the latest texts of the session. The state of a session is a count, a turn and a ring of
    `recent` texts; it is dropped when the watermark is a ttl behind its last message."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, turn, ring = state.get if state.exists else (0, 0, [])
        ring, out, sent = list(ring), [], pd.concat(list(frames))
        for row in sent.drop_duplicates("place").sort_values("place").itertuples(index=False):
            if row.place >= seen:
                seen, turn = int(row.place) + 1, turn + (row.role == "user")
                ring = [*ring, row.text][-recent:]
                out.append((key[0], row.place, row.role, row.text, turn, list(ring)))
        state.update((seen, turn, ring))
        forget = int((sent["at"].max() + pd.Timedelta(ttl)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(forget, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in NEW_TEXTS.split(", ")])

    return messages.withWatermark("at", ttl).groupBy("session").applyInPandasWithState(step, NEW_TEXTS, "seen long, turn long, recent array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def shown_memories(recalls: DataFrame, apart: int = 8) -> DataFrame:
    """recalls (session, turn, memory) -> those shown: a memory that was shown less than `apart` turns ago is not shown again. The
    state holds one turn for each memory and session."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        shown = []
        for turn in sorted(int(t) for f in frames for t in f["turn"]):
            if last is None or turn - last >= apart:
                last = turn
                shown.append((*key, turn))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(shown, columns=["session", "memory", "turn"])

    return recalls.groupBy("session", "memory").applyInPandasWithState(step, "session string, memory long, turn long", "last long", "append", GroupStateTimeout.NoTimeout)

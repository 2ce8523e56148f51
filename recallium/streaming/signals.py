"""State with a time limit: error signals of sessions that wait for the next prompt, and access counts that wait for a quiet moment."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from recallium.sources.versions import ConcurrentWrite, Versions

# Signals kept for a session, signals given to a prompt, how long a session is remembered.
MOST_SIGNALS, SHOWN_SIGNALS, REMEMBERED_MS = 30, 3, 30 * 60 * 1000
SIGNALS = "session string, at timestamp, kind string, signature string, text string"
PENDING = "session string, at timestamp, signature string, text string"


class ErrorSignals(StatefulProcessor):
    """Per session: the latest signals, each signature once, and which of them a prompt has had.

    Rows are of kind "error" or "prompt"; a prompt gets the signals since the last one, at most `shown` of them, the latest. The state is a
    list of at most `most` signals and a mark. Both are dropped when neither kind of row has come for the time limit of the clock that
    the stream runs by (event time)."""

    def __init__(self, most: int = MOST_SIGNALS, shown: int = SHOWN_SIGNALS, ttl_ms: int = REMEMBERED_MS):
        self.most, self.shown, self.ttl = most, shown, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.signals = handle.getListState("signals", "signature string, text string")
        self.mark = handle.getValueState("mark", "given int, seen long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given, seen, timer = self.mark.get() if self.mark.exists() else (0, 0, 0)
        kept = list(self.signals.get()) if self.signals.exists() else []
        given, out = int(given), []
        for r in pd.concat(list(rows)).sort_values(["at", "kind", "signature"], kind="stable").itertuples(index=False):
            now = int(r.at.timestamp() * 1000)
            if kept and now - seen > self.ttl:
                kept, given = [], 0
            seen = max(int(seen), now)
            if r.kind == "prompt":
                given = min(given, len(kept))
                out += [(key[0], r.at, s, t) for s, t in kept[given:][-self.shown :]]
                given = len(kept)
            elif r.signature not in {s for s, _ in kept}:
                kept = [*kept, (r.signature, r.text)]
                gone = max(0, len(kept) - self.most)
                kept, given = kept[gone:], max(0, given - gone)
        if kept:
            self.signals.put(kept)
        elif self.signals.exists():
            self.signals.clear()
        if timer:
            self.handle.deleteTimer(int(timer))
        timer = max(seen + self.ttl, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.mark.update((given, seen, timer))
        yield pd.DataFrame(out, columns=["session", "at", "signature", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.signals.clear()
        self.mark.clear()
        yield pd.DataFrame([], columns=["session", "at", "signature", "text"])

    def close(self) -> None:
        pass


def pending_signals(rows: DataFrame, late: str = "1 minute", processor: ErrorSignals | None = None) -> DataFrame:
    """rows (SIGNALS) -> what each prompt is reminded of (PENDING). Needs the RocksDB state store."""
    timed = rows.where("trim(session) <> ''").withColumn("session", F.trim("session")).withWatermark("at", late)
    return timed.groupBy("session").transformWithStateInPandas(processor or ErrorSignals(), outputStructType=PENDING, outputMode="append", timeMode="eventTime")


QUIET_MS, MOST_ATTEMPTS = 5_000, 5


class Debounced(StatefulProcessor):
    """Per memory: counts add up until none has come for `quiet` milliseconds of the clock; then the sum goes out once."""

    def __init__(self, quiet_ms: int = QUIET_MS):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sum = handle.getValueState("sum", "n long, at long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, at, timer = self.sum.get() if self.sum.exists() else (0, 0, 0)
        more = pd.concat(list(rows))
        if timer:
            self.handle.deleteTimer(int(timer))
        timer = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(timer)
        self.sum.update((int(n) + int(more["n"].sum()), max(int(at), int(more["at"].max())), timer))
        yield pd.DataFrame([], columns=["memory", "n", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, at, _ = self.sum.get()
        self.sum.clear()
        yield pd.DataFrame([(key[0], n, at)], columns=["memory", "n", "at"])

    def close(self) -> None:
        pass


def debounced_counts(accesses: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """accesses (memory long, n long, at long) -> one row (memory, n, at) for each burst. Needs the RocksDB state store."""
    return accesses.groupBy("memory").transformWithStateInPandas(Debounced(quiet_ms), outputStructType="memory long, n long, at long", outputMode="append", timeMode="processingTime")


def write_back(memories: Versions, counts: DataFrame, batch_id: int, stream: str, attempts: int = MOST_ATTEMPTS, wait: Callable[[int], None] = lambda i: time.sleep(0.1 * 2**i)) -> int | None:
    """Adds the counts of a batch to access_count and moves last_accessed_at, as one version of the memories; None where the batch was written
    before. The version carries the batch's number, so a batch that comes again, or a try that failed after it had committed, adds nothing
    twice. memories: doc_id, access_count, last_accessed_at."""
    sums = counts.groupBy(F.col("memory").alias("doc_id")).agg(F.sum("n").alias("n"), F.max("at").alias("at"))
    for i in range(attempts):
        try:
            return memories.merge(sums, lambda old, new: {"access_count": F.least(F.lit(10_000), F.coalesce(old("access_count"), F.lit(0)) + new("n")), "last_accessed_at": F.greatest(old("last_accessed_at"), new("at"))}, (stream, batch_id))
        except ConcurrentWrite:
            raise
        except Exception:
            if i == attempts - 1:
                raise
            wait(i)
    return None

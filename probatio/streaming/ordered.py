"""Stateful stream rules that need event order: rate limit and state machine.

Rows wait in list state until the watermark has passed them; an event-time timer then hands
them on in order.  So a replay of stored data gives the same verdicts at any speed, with
late rows (within the watermark's delay) and across restarts.  State holds the rows of one
key within the delay, plus what the rule itself keeps, and ends by itself.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from probatio import fixed_values as fv
from probatio.operators import leads

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``take`` in the order of (time, id)."""

    #: columns of the input besides the key: micros bigint, id bigint, value string
    WAITING = "micros bigint, id bigint, value string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)

    def take(self, key: tuple, due: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def quiet(self, key: tuple, now: int) -> None:
        """Called when a timer found no row due."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            new = [(int(m), int(i), v) for m, i, v in zip(
                batch["micros"], batch["id"], batch["value"])]
            if new:
                self.waiting.appendList(new)
                lowest = min(m for m, _, _ in new)
                first = lowest if first is None else min(first, lowest)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(map(tuple, self.waiting.get()), key=lambda r: (r[:2], r[2] or ""))
        due = [r for r in rows if r[0] // 1000 < now]
        later = rows[len(due):]
        if not due:
            self.quiet(key, now)
            return
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000)
        else:
            self.waiting.clear()
        yield from self.take(key, due, now)

    def close(self) -> None:
        pass


class RateLimit(InOrder):
    """Accepts a submission while few enough were accepted within the window before it."""

    OUTPUT = "client_key string, submission_id bigint, micros bigint, accepted boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.accepted = handle.getListState("accepted", "micros bigint")

    def take(self, key, due, now):
        window = fv.RATE_WINDOW_SECONDS * 1_000_000
        seen = deque(m for (m,) in self.accepted.get())
        verdicts = [leads.accept_in_window(seen, micros, window) for micros, _, _ in due]
        self.accepted.put([(m,) for m in seen])
        # The client is forgotten once its last accepted submission has left the window.
        self.handle.registerTimer((seen[-1] + window) // 1000 + 1)
        yield pd.DataFrame({
            "client_key": key[0], "submission_id": [i for _, i, _ in due],
            "micros": [m for m, _, _ in due], "accepted": verdicts})

    def quiet(self, key, now):
        window = fv.RATE_WINDOW_SECONDS * 1_000
        if all(m // 1000 + window < now for (m,) in self.accepted.get()):
            self.accepted.clear()


class StateMachine(InOrder):
    """Labels requested states; refused requests change nothing.

    A key in a terminal state refuses everything.  It is forgotten ``keep_ms`` after its
    last step: a request that comes later still starts from the initial state.
    """

    OUTPUT = ("key string, step_id bigint, micros bigint, requested string, "
              "state_before string, state_after string, allowed boolean")

    def __init__(self, table: dict[str, tuple[str, ...]], initial: str, keep_ms: int):
        self.table, self.initial, self.keep_ms = dict(table), initial, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "state string, micros bigint")

    def take(self, key, due, now):
        stored = self.state.get()
        current = stored[0] if stored else self.initial
        before, after, allowed = [], [], []
        for _, _, requested in due:
            legal = requested in self.table.get(current, ())
            before.append(current)
            current = requested if legal else current
            after.append(current)
            allowed.append(legal)
        self.state.update((current, due[-1][0]))
        if not self.table.get(current):
            self.handle.registerTimer(due[-1][0] // 1000 + self.keep_ms)
        yield pd.DataFrame({
            "key": key[0], "step_id": [i for _, i, _ in due], "micros": [m for m, _, _ in due],
            "requested": [v for _, _, v in due], "state_before": before, "state_after": after,
            "allowed": allowed})

    def quiet(self, key, now):
        stored = self.state.get()
        if stored and not self.table.get(stored[0]) and stored[1] // 1000 + self.keep_ms < now:
            self.state.clear()


def _in_order(rows: DataFrame, key: str, processor: InOrder) -> DataFrame:
    """``rows``: key, at (watermarked timestamp), micros, id, value."""
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER, None) != ROCKS_DB:
        spark.conf.set(PROVIDER, ROCKS_DB)  # timers and list state need it
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUTPUT, outputMode="Append",
        timeMode="EventTime")


def _waiting(rows: DataFrame, key: str, at: str, number: str, value: str,
             delay: str) -> DataFrame:
    time = F.col(at).cast("timestamp")
    return rows.select(
        F.col(key).cast("string").alias(key), time.alias("at"), F.unix_micros(time)
        .alias("micros"), F.col(number).cast("bigint").alias("id"), F.col(value).alias("value")
    ).where(F.col("at").isNotNull()).withWatermark("at", delay)


def spam_verdicts(submissions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Rate rule per client over a stream of submissions that passed the other checks:
    client_key, submission_id, submitted_at, accepted, reason."""
    checked = leads.spam_rules(submissions).where(
        "spam_reason is null and client_key is not null").withColumn(
            "_none", F.lit(None).cast("string"))
    judged = _in_order(_waiting(checked, "client_key", "submitted_at", "submission_id", "_none",
                                delay), "client_key", RateLimit())
    return judged.select(
        "client_key", "submission_id", F.timestamp_micros("micros").alias("submitted_at"),
        "accepted", F.when(~F.col("accepted"), leads.RATE_REASON).alias("reason"))


def fold_states(log: DataFrame, table: dict[str, tuple[str, ...]], initial: str,
                delay: str = "10 minutes", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """State per key as requests arrive.  ``log``: key, ts, step_id, requested."""
    steps = _in_order(_waiting(log, "key", "ts", "step_id", "requested", delay), "key",
                      StateMachine(table, initial, keep_ms))
    return steps.select("key", "step_id", F.timestamp_micros("micros").alias("ts"),
                        "requested", "state_before", "state_after", "allowed")

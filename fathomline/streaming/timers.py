"""Streams whose answers come by event-time timers: an answer is given once, when the watermark has passed all that it counts.

Rows without a time belong to no window and are left out. Rows behind the watermark are not added to answers that have
been given; ``late_rows`` says how many there were. All processors need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Length of a slice of time: state and timers are kept by pair and slice, so a busy pair spreads over tasks and old slices go.
SLICE_SECONDS = 3600


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the progress reports that the query still holds."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def _after(micros: int) -> int:
    """The first millisecond after a time in microseconds; a timer fires when the watermark is beyond it."""
    return micros // 1000 + 1


class TrailingSums(StatefulProcessor):
    """Snapshots and amounts of one pair and slice; each snapshot's window is summed when the watermark passes the snapshot.

    One timer stands at a time: at the earliest snapshot not yet answered, else at the end of the slice, where all state goes.
    """

    def __init__(self, seconds: int) -> None:
        self.window = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.snapshots = handle.getListState("snapshots", "id bigint, at bigint")
        self.amounts = handle.getListState("amounts", "at bigint, amount bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def _set_timer(self, key: tuple, pending: list[int], now: int) -> None:
        end = _after((int(key[1]) + 1) * SLICE_SECONDS * 1_000_000)
        at = max(now, min([_after(x) for x in pending] or [end]))
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        asked = found[found["amount"].isna()]
        given = found[found["amount"].notna()]
        if len(given):
            self.amounts.appendList([(int(a), int(b)) for a, b in zip(given["micros"], given["amount"], strict=True)])
        if len(asked):
            self.snapshots.appendList([(int(a), int(b)) for a, b in zip(asked["id"], asked["micros"], strict=True)])
        self._set_timer(key, [r[1] for r in self.snapshots.get()] if self.snapshots.exists() else [], timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(columns=["pair_id", "id", "micros", "rows", "amount"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        waiting = [tuple(r) for r in self.snapshots.get()] if self.snapshots.exists() else []
        due = sorted((r for r in waiting if _after(r[1]) < now), key=lambda r: (r[1], r[0]))
        left = [r for r in waiting if _after(r[1]) >= now]
        amounts = sorted(tuple(r) for r in self.amounts.get()) if self.amounts.exists() else []
        out, first, last, total = [], 0, 0, 0
        for id_, at in due:
            while last < len(amounts) and amounts[last][0] <= at:
                total += amounts[last][1]
                last += 1
            while first < last and amounts[first][0] <= at - self.window:
                total -= amounts[first][1]
                first += 1
            out.append((int(key[0]), id_, at, last - first, total))
        if left:
            self.snapshots.put(left)
        else:
            self.snapshots.clear()
        if not left and now > _after((int(key[1]) + 1) * SLICE_SECONDS * 1_000_000):
            self.amounts.clear()
        else:
            self._set_timer(key, [r[1] for r in left], now)
        yield pd.DataFrame(out, columns=["pair_id", "id", "micros", "rows", "amount"])

    def close(self) -> None:
        pass


def trailing_sums(events: DataFrame, seconds: int = 900, lateness: str = "10 minutes") -> DataFrame:
    """The rows and the sum of the window (at - seconds, at] before each snapshot, one row for it, when the watermark passes it.

    ``events``: pair_id, id, at, amount in whole units; rows with a null amount are the snapshots. The window is no longer than
    a slice, so an amount is read in its own slice and in the next one if a window of that can reach it. A snapshot without
    trades has 0; a repeated snapshot is answered again.
    """
    if not 0 < seconds <= SLICE_SECONDS:
        raise ValueError(f"a window of 1 to {SLICE_SECONDS} seconds is wanted")
    e = events.where(F.col("at").isNotNull()).select("pair_id", "id", "at", F.col("amount").cast("bigint").alias("amount"), F.unix_micros("at").alias("micros"))
    slice_ = lambda s: F.floor((F.col("micros") + s * 1_000_000) / F.lit(SLICE_SECONDS * 1_000_000)).cast("bigint")
    reached = F.when(F.col("amount").isNull(), F.array(slice_(0))).otherwise(F.array_distinct(F.array(slice_(0), slice_(seconds))))
    e = e.withWatermark("at", lateness).withColumn("slice", F.explode(reached))
    return e.groupBy("pair_id", "slice").transformWithStateInPandas(
        statefulProcessor=TrailingSums(seconds), outputStructType="pair_id bigint, id bigint, micros bigint, rows bigint, amount bigint", outputMode="Append", timeMode="EventTime"
    )


class Due(StatefulProcessor):
    """Recordings of one bucket that wait for their comparison; one that has none when its delay is over comes out."""

    def __init__(self, delay_seconds: int) -> None:
        self.delay = delay_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id bigint, at bigint, compared boolean")
        self.timer = handle.getValueState("timer", "at bigint")

    def _set_timer(self, waiting: list[tuple], now: int) -> None:
        at = max(now, min(self._over(r) for r in waiting))
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _over(self, row: tuple) -> int:
        """When nothing more can change a row: a recording's delay is over, or no recording of a comparison can still come."""
        return _after(row[1] if row[2] else row[1] + self.delay)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        new = [(int(a), int(b), bool(c)) for a, b, c in zip(found["id"], found["micros"], found["compared"], strict=True)]
        self.waiting.appendList(new)
        self._set_timer([tuple(r) for r in self.waiting.get()], timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(columns=["id", "micros"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        waiting = [tuple(r) for r in self.waiting.get()]
        compared: dict[int, int] = {}
        recorded: dict[int, int] = {}
        for id_, at, of in waiting:
            seen = compared if of else recorded
            seen[id_] = min(at, seen.get(id_, at))
        over = {i for i, at in recorded.items() if self._over((i, at, False)) < now}
        out = [(i, recorded[i]) for i in sorted(over) if not (i in compared and compared[i] <= recorded[i] + self.delay)]
        left = [r for r in waiting if r[0] not in over and not (r[0] not in recorded and self._over(r) < now)]
        if left:
            self.waiting.put(left)
            self._set_timer(left, now)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["id", "micros"])

    def close(self) -> None:
        pass


def overdue(events: DataFrame, delay_seconds: int = 300, lateness: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """Recordings that had no comparison within the delay, each when the watermark passes the end of its delay.

    ``events``: id of the recording, at, compared (false: it was recorded, true: it was compared). Of repeated rows the
    earliest counts. A comparison before its recording counts for it, a comparison without a recording comes to nothing.
    Recordings are kept in ``buckets`` by their hash, so that a task reads state by the bucket and not by the recording.
    """
    e = events.where(F.col("at").isNotNull() & F.col("id").isNotNull()).select("id", "at", "compared", F.unix_micros("at").alias("micros"))
    e = e.withWatermark("at", lateness).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    return e.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Due(delay_seconds), outputStructType="id bigint, micros bigint", outputMode="Append", timeMode="EventTime")

"""Continuous forms of the polls: ingest, scan, dedupe, trailing and daily volumes, absences, delayed comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fathomline.sources import schemas as S
from fathomline.sources import sinks


def recordings(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New recording files as they land, degraded ones too."""
    raw = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").option("maxFilesPerTrigger", max_files).text(path)
    return raw.select(F.from_json("value", S.RECORDING).alias("r")).select("r.*")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def scan(stream: DataFrame, risk_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Risk of every micro-batch, stored idempotently: a batch that runs again appends nothing."""

    def store(batch: DataFrame, _: int) -> None:
        sinks.save_metrics(risk_of(batch), path)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_trades(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each trade once, as long as its copies arrive within the lateness."""
    return stream.withWatermark("closed_at", lateness).dropDuplicatesWithinWatermark(["pair_id", "trade_id"])


def trailing_volume(snapshots: DataFrame, trades: DataFrame, seconds: int = 900, lateness: str = "10 minutes") -> DataFrame:
    """Trades with the snapshots whose trailing window they fall into: a stream-stream interval join, bounded on both sides."""
    s = snapshots.withWatermark("ledger_closed_at", lateness).alias("s")
    t = trades.withWatermark("closed_at", lateness).alias("t")
    on = (F.col("s.pair_id") == F.col("t.pair_id")) & (F.col("t.closed_at") > F.col("s.ledger_closed_at") - F.expr(f"interval {seconds} seconds")) & (F.col("t.closed_at") <= F.col("s.ledger_closed_at"))
    return s.join(t, on).select("s.pair_id", "s.ledger_seq", "s.ledger_closed_at", "t.trade_id", "t.counter_amount", "t.closed_at")


def daily_volumes(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Volume by pair and UTC day; in append mode a day comes out only after the watermark has passed it, so it is final."""
    w = F.window("closed_at", "1 day")
    g = stream.withWatermark("closed_at", lateness).groupBy("pair_id", w.alias("w")).agg(F.sum("base_amount").alias("base_volume"), F.sum("counter_amount").alias("quote_volume"), F.count(F.lit(1)).alias("trades"))
    return g.select("pair_id", F.to_date("w.start").alias("day"), "base_volume", "quote_volume", "trades")


def roll_up(daily: DataFrame, anchor: Column, days: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Trailing sums over final days, up to the day before the anchor's."""
    age = F.date_diff(F.to_date(anchor), F.col("day"))
    return daily.groupBy("pair_id").agg(*(F.sum(F.when(age.between(1, d), F.col("base_volume")).otherwise(F.lit(0))).alias(f"base_{d}d") for d in days))


def last_genuine(stream: DataFrame) -> DataFrame:
    """The newest genuine trade of each pair, for update mode."""
    g = stream.where(F.col("state") == "genuine").groupBy("pair_id").agg(F.max(F.struct("closed_at", "ledger_seq")).alias("m"))
    return g.select("pair_id", F.col("m.closed_at").alias("last_genuine_at"), F.col("m.ledger_seq").alias("last_genuine_ledger"))


class Absences(StatefulProcessor):
    """One maker's absences: the first delete after a post opens one, the next post closes and emits it.

    State is one open time a maker; events of one maker within a batch are ordered by time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "open timestamp, posted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at", "tx"])
        opened, posted = self.state.get() if self.state.exists() else (None, False)
        out = []
        for at, kind in zip(found["at"], found["kind"], strict=True):
            if kind == "delete":
                if posted and opened is None:
                    opened = at
                posted = False
            else:
                if opened is not None:
                    out.append((*key, opened, at, (at - opened).total_seconds()))
                opened, posted = None, True
        self.state.update((opened, posted))
        yield pd.DataFrame(out, columns=["account_id", "pair_id", "open_at", "close_at", "seconds"])

    def close(self) -> None:
        pass


def absences(events: DataFrame) -> DataFrame:
    """Closed absences from a stream of maker events (account_id, pair_id, tx, at, kind); needs the RocksDB state store."""
    return events.groupBy("account_id", "pair_id").transformWithStateInPandas(
        statefulProcessor=Absences(), outputStructType="account_id bigint, pair_id bigint, open_at timestamp, close_at timestamp, seconds double", outputMode="Append", timeMode="None"
    )


def due_for_comparison(recorded: DataFrame, compared: DataFrame, now: Column, delay_minutes: int) -> DataFrame:
    """Recordings that are old enough to be rebuilt and have not been compared yet."""
    due = recorded.where(F.col("recorded_at") + F.expr(f"interval {delay_minutes} minutes") <= now)
    return due.join(compared.select("recording"), "recording", "left_anti")

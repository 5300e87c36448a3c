"""Registered streams: all files that are there are read (``availableNow``), answers are written and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.plans.registry import query
from fathomline.streaming import timers

#: Events with the watermark after the whole table has been read, ten minutes behind the last event, in milliseconds.
_EVENTS = """e AS (SELECT event_id, epoch_us(ts) AS u, user_id % 10 AS pair_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE ts IS NOT NULL),
w AS (SELECT max(u) // 1000 - 600000 AS passed FROM e)"""


def drained(spark: SparkSession, sf_dir: str, name: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over one table has answered when it has read all of it; state, answers and progress lie in the shared folder."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/fathomline-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    out = answer(session.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))
    out.writeStream.format("parquet").option("path", f"{path}/answers").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/answers")


@query(f"""WITH {_EVENTS}, s AS (SELECT * FROM e WHERE event_type = 'view'), t AS (SELECT * FROM e WHERE event_type <> 'view')
SELECT s.pair_id, s.event_id AS snapshot_id, count(t.u) AS trades, CAST(coalesce(sum(t.cents), 0) AS BIGINT) AS cents
FROM s CROSS JOIN w LEFT JOIN t ON t.pair_id = s.pair_id AND t.u > s.u - 900000000 AND t.u <= s.u WHERE s.u // 1000 + 1 < w.passed GROUP BY s.pair_id, s.event_id""")
def stream_trailing_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarter of an hour before every view, answered as the watermark passes the view."""
    def answer(e: DataFrame) -> DataFrame:
        amount = F.when(F.col("event_type") != "view", F.round(F.col("value") * 100).cast("bigint"))
        return timers.trailing_sums(e.select((F.col("user_id") % 10).alias("pair_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), amount.alias("amount")))

    return drained(spark, sf_dir, "events", answer).select("pair_id", F.col("id").alias("snapshot_id"), F.col("rows").alias("trades"), F.col("amount").alias("cents"))


@query(f"""WITH {_EVENTS}, r AS (SELECT event_id // 2 AS id, u FROM e WHERE event_id % 2 = 0), c AS (SELECT event_id // 2 AS id, u FROM e WHERE event_id % 2 = 1 AND event_type <> 'error')
SELECT r.id AS recording_id, r.u AS recorded_us FROM r CROSS JOIN w LEFT JOIN c ON c.id = r.id WHERE (c.u IS NULL OR c.u > r.u + 300000000) AND (r.u + 300000000) // 1000 + 1 < w.passed""")
def stream_overdue_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event is a recording, the next one its comparison unless it is an error: recordings not compared within five minutes."""
    def answer(e: DataFrame) -> DataFrame:
        k = F.col("event_id")
        kept = e.where((k % 2 == 0) | (F.col("event_type") != "error"))
        return timers.overdue(kept.select(F.floor(k / 2).cast("bigint").alias("id"), F.col("ts").cast("timestamp").alias("at"), (k % 2 == 1).alias("compared")))

    return drained(spark, sf_dir, "events", answer).select(F.col("id").alias("recording_id"), F.col("micros").alias("recorded_us"))

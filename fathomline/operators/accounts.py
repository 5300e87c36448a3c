"""Who funds trading accounts, and when makers are absent from the book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import exact as X


def funders(first_ops: DataFrame) -> DataFrame:
    """(account_id, funder): the source of an account's earliest operation where that created it; null before history."""
    first = first_ops.groupBy("account_id").agg(F.min_by(F.struct("type", "source"), "toid").alias("f"))
    return first.select("account_id", F.when(F.col("f.type") == "create_account", F.col("f.source")).alias("funder"))


def shared_funders(found: DataFrame) -> DataFrame:
    return found.where(F.col("funder").isNotNull()).groupBy("funder").agg(F.count(F.lit(1)).alias("accounts")).where("accounts > 1")


def funder_histogram(found: DataFrame) -> DataFrame:
    return found.where(F.col("funder").isNotNull()).groupBy("funder").agg(F.count(F.lit(1)).alias("accounts")).groupBy("accounts").agg(F.count(F.lit(1)).alias("funders"))


def shared_funder_trades(trades: DataFrame, found: DataFrame) -> DataFrame:
    """Per pair: two-sided trades, those with an unknown funder, those between accounts of one funder, volumes and shares."""
    t = trades.where(F.col("base_account").isNotNull() & F.col("counter_account").isNotNull())
    a, b = (found.select(F.col("account_id").alias(f"{s}_account"), F.col("funder").alias(f"{s}_funder")) for s in ("base", "counter"))
    j = t.join(a, "base_account", "left").join(b, "counter_account", "left")
    known = F.col("base_funder").isNotNull() & F.col("counter_funder").isNotNull()
    shared = known & (F.col("base_funder") == F.col("counter_funder"))
    v = F.col("counter_amount")
    out = j.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(~known).alias("unknown"), F.count_if(shared).alias("shared"),
        F.sum(F.when(known, v).otherwise(F.lit(0))).alias("known_volume"), F.sum(F.when(shared, v).otherwise(F.lit(0))).alias("shared_volume"),
    )
    return out.withColumn("shared_pct", F.try_divide(F.col("shared_volume").cast("double") * 100, F.nullif(F.col("known_volume").cast("double"), F.lit(0.0))))


def maker_events(ops: DataFrame) -> DataFrame:
    """(account_id, pair_id, tx, at, kind): a transaction with all amounts 0 deletes, with none 0 posts; mixed ones are dropped."""
    g = ops.groupBy("account_id", "pair_id", "tx").agg(F.min("at").alias("at"), F.count_if(F.col("amount") == 0).alias("z"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("kind", F.when(F.col("z") == F.col("n"), "delete").when(F.col("z") == 0, "post")).where(F.col("kind").isNotNull()).drop("z", "n")


def absence_windows(found: DataFrame, nested: bool = False) -> DataFrame:
    """(account_id, pair_id, open_at, close_at, seconds): the first delete after a post opens, the next post closes; an open end is null.

    With ``nested`` every delete opens a window, so windows that share their end overlap.
    """
    w = Window.partitionBy("account_id", "pair_id").orderBy("at", "tx")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    e = found.withColumn("_before", F.lag("kind").over(w)).withColumn("close_at", F.min(F.when(F.col("kind") == "post", F.col("at"))).over(after))
    opens = F.col("kind") == "delete"
    if not nested:
        opens = opens & (F.col("_before") == "post")
    return e.where(opens).select("account_id", "pair_id", F.col("at").alias("open_at"), "close_at", ((F.unix_micros("close_at") - F.unix_micros("at")) / 1_000_000).alias("seconds"))


def absence_statistics(windows: DataFrame, span_seconds: Column) -> DataFrame:
    """Per maker and pair: closed windows, shortest, median (averaging), longest, total, share of the span, and unclosed windows."""
    s = F.col("seconds")
    return windows.groupBy("account_id", "pair_id").agg(
        F.count(s).alias("windows"), F.count_if(s.isNull()).alias("unclosed"), F.min(s).alias("shortest"), F.percentile(s, F.lit(0.5)).alias("median"), F.max(s).alias("longest"), F.sum(s).alias("total"),
    ).withColumn("span_pct", F.col("total") * 100 / span_seconds)


def modal_minute(windows: DataFrame) -> DataFrame:
    """Per pair the commonest opening minute of the day (of equals the earliest), with the windows and days within one minute of it."""
    m = windows.withColumn("minute", F.hour("open_at") * 60 + F.minute("open_at"))
    counts = m.groupBy("pair_id", "minute").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("pair_id").agg(F.min_by("minute", F.struct((-F.col("n")).alias("n"), "minute")).alias("modal"))
    near = m.join(mode, "pair_id").where(F.least(F.abs(F.col("minute") - F.col("modal")), 1440 - F.abs(F.col("minute") - F.col("modal"))) <= 1)
    return near.groupBy("pair_id", "modal").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct(X.utc_day(F.col("open_at"))).alias("days"))


def union_seconds(windows: DataFrame) -> DataFrame:
    """Sum of nested windows, and of their union (windows that share an end count from the first opening)."""
    by_end = windows.where(F.col("close_at").isNotNull()).groupBy("account_id", "pair_id", "close_at").agg(F.max("seconds").alias("longest"), F.sum("seconds").alias("summed"))
    return by_end.groupBy("account_id", "pair_id").agg(F.sum("summed").alias("sum_seconds"), F.sum("longest").alias("union_seconds"))

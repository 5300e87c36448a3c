"""Depth bounds that trades imply: legs of one taker, price moves within and between them, daily rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import exact as X

RUNGS = ("0.02", "0.05", "0.10", "0.5")


def legs(trades: DataFrame) -> DataFrame:
    """One row a leg: fills of one operation in one direction that follow each other by fill index.

    Fills of an operation share its close time, so islands are found within (pair, close time, operation) and only
    the legs are ordered further. A fill without an operation is a leg of its own; trades without a price are dropped.
    """
    p = trades.withColumn("price", X.price(F.col("price_n"), F.col("price_d"))).where(F.col("price").isNotNull())
    own = F.when(F.coalesce(F.col("operation_id").cast("string"), F.lit("")) == "", F.col("trade_id").cast("string")).otherwise("")
    w = Window.partitionBy("pair_id", "closed_at", F.col("operation_id").cast("string"), "_own").orderBy("fill_index", "trade_id")
    turned = F.coalesce((F.lag("base_is_seller").over(w) != F.col("base_is_seller")).cast("int"), F.lit(0))
    p = p.withColumn("_own", own).withColumn("_turn", turned).withColumn("_leg", F.sum("_turn").over(w))
    order = F.struct("fill_index", "trade_id")
    quote = X.notional(F.col("base_amount"), F.col("price_n"), F.col("price_d"))
    return (
        p.groupBy("pair_id", "closed_at", F.col("operation_id").cast("string").alias("operation_id"), "_own", "_leg")
        .agg(
            F.count(F.lit(1)).alias("fills"), F.min("fill_index").alias("first_fill"),
            F.min_by("price", order).alias("first_price"), F.max_by("price", order).alias("last_price"),
            F.min_by("trade_id", order).alias("first_trade"), F.max_by("trade_id", order).alias("last_trade"),
            F.sum(quote).cast(X.WIDE).alias("notional"),
        )
        .drop("_own", "_leg")
        .withColumn("day", X.utc_day(F.col("closed_at")))
    )


def _with_previous(found: DataFrame) -> DataFrame:
    """Legs with the leg before them: ordered by pair and day, the day's first leg takes the last leg of the last day that had one."""
    order = F.struct("closed_at", "operation_id", "first_fill", "first_trade")
    last = F.struct("last_price", "last_trade", "closed_at")
    days = found.groupBy("pair_id", "day").agg(F.max_by(last, order).alias("_end"))
    carried = days.select("pair_id", "day", F.lag("_end").over(Window.partitionBy("pair_id").orderBy("day")).alias("_carried"))
    w = Window.partitionBy("pair_id", "day").orderBy("closed_at", "operation_id", "first_fill", "first_trade")
    return found.withColumn("_before", F.lag(last).over(w)).join(carried, ["pair_id", "day"], "left").withColumn("previous", F.coalesce("_before", "_carried")).drop("_before", "_carried")


def implied_bounds(trades: DataFrame) -> DataFrame:
    """(pair_id, day, kind, from_trade, to_trade, delta, bound, elapsed_seconds): the bound is the arriving leg's notional; no move gives no row."""
    found = _with_previous(legs(trades))
    between = F.struct(
        F.lit("between_legs").alias("kind"), F.col("previous.last_trade").alias("from_trade"), F.col("first_trade").alias("to_trade"),
        X.relative_move(F.col("previous.last_price"), F.col("first_price")).alias("delta"), X.elapsed_seconds(F.col("previous.closed_at"), F.col("closed_at")).alias("elapsed_seconds"),
    )
    within = F.struct(
        F.lit("within_leg").alias("kind"), F.col("first_trade").alias("from_trade"), F.col("last_trade").alias("to_trade"),
        X.relative_move(F.col("first_price"), F.col("last_price")).alias("delta"), F.lit(0.0).alias("elapsed_seconds"),
    )
    rows = found.select("pair_id", "day", "closed_at", "notional", F.explode(F.array(between, within)).alias("b"))
    return rows.where(F.col("b.delta").isNotNull()).select("pair_id", "day", "closed_at", "b.kind", "b.from_trade", "b.to_trade", "b.delta", F.col("notional").alias("bound"), "b.elapsed_seconds")


def of_kind(bounds: DataFrame, kind: str) -> DataFrame:
    return bounds.where(F.col("kind") == kind)


def tightest(bounds: DataFrame, least_delta: str) -> DataFrame:
    """Per pair the least bound among moves of at least ``least_delta``."""
    return bounds.groupBy("pair_id").agg(F.min(F.when(F.col("delta") >= F.lit(least_delta).cast("decimal(6,4)"), F.col("bound"))).alias("bound"))


def daily_rows(trades: DataFrame, bounds: DataFrame, rungs: tuple[str, ...] = RUNGS) -> DataFrame:
    """Per pair and day: trades, quote volume, open, close, low, high, greatest move of each kind, and per kind and rung the
    tightest bound with its source trade and gap. A bound counts on the day of its arriving trade; of equal bounds the first."""
    p = trades.withColumn("price", X.price(F.col("price_n"), F.col("price_d"))).withColumn("day", X.utc_day(F.col("closed_at")))
    order = F.struct("closed_at", F.col("operation_id").cast("string"), "fill_index", "trade_id")
    day = p.groupBy("pair_id", "day").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("counter_amount").alias("volume_quote"), F.min_by("price", order).alias("price_open"), F.max_by("price", order).alias("price_close"),
        F.min("price").alias("price_low"), F.max("price").alias("price_high"),
    )
    aggs: list[Column] = []
    for kind in ("within_leg", "between_legs"):
        of = F.col("kind") == kind
        aggs.append(F.max(F.when(of, F.col("delta"))).alias(f"max_delta_{kind}"))
        for r in rungs:
            on = of & (F.col("delta") >= F.lit(r).cast("decimal(6,4)"))
            aggs.append(F.min(F.when(on, F.struct("bound", "closed_at", "to_trade", "elapsed_seconds"))).alias(f"{kind}_{r.replace('.', '_')}"))
    found = bounds.groupBy("pair_id", "day").agg(*aggs)
    flat = found.select("pair_id", "day", *(c for c in found.columns if c.startswith("max_")), *(
        F.col(f"{c}.{f}").alias(f"{c}_{n}") for c in found.columns if not c.startswith("max_") and c not in ("pair_id", "day") for f, n in (("bound", "bound"), ("to_trade", "trade"), ("elapsed_seconds", "gap"))
    ))
    return day.join(flat, ["pair_id", "day"], "left")


def verdict(bound: Column, threshold: int) -> Column:
    """yes below the threshold, no at or above it, empty where nothing was observed."""
    return F.when(bound.isNull(), "").when(bound < threshold, "yes").otherwise("no")


def crossing_summary(daily: DataFrame, column: str, threshold: int, mark: str | None = None) -> DataFrame:
    """Per pair the first day below the threshold, days below and observed, and the first day's distance from a mark day."""
    below = F.col(column) < threshold
    out = daily.groupBy("pair_id").agg(F.min(F.when(below, F.col("day"))).alias("first_below"), F.count_if(below).alias("days_below"), F.count(column).alias("days_observed"))
    return out if mark is None else out.withColumn("days_from_mark", F.date_diff("first_below", F.to_date(F.lit(mark))))

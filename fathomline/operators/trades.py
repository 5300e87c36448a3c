"""Trades: upper medians, classification into genuine, excluded and unevaluated, windows and volumes.

A trade has pair_id, trade_id, operation_id, fill_index, ledger_seq, closed_at, price_n, price_d, base_amount,
counter_amount, base_is_seller, base_account, counter_account and pool_id (null for an order-book trade).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.operators.running import window_medians
from fathomline.params import DEFAULT, Params

#: Exclusion conditions in the order in which they are tried.
CONDITIONS = ["self_trade", "dust", "issuer_leg", "off_book_pool_fill", "price_outlier"]

#: Comparison windows in a chunk of time whose prices meet in one task.
COMPARED_CHUNK = 16


def upper_median(df: DataFrame, keys: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """Per key the value at place floor(n / 2) + 1 in ascending order: the upper of two middles, never an average.

    Equal values are counted before the shuffle, so what is sorted for a key is its distinct values.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("_n"))
    w = Window.partitionBy(*keys)
    ranked = counted.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    return ranked.where(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1).groupBy(*keys).agg(F.min(value).alias(name))


def with_price(trades: DataFrame) -> DataFrame:
    return trades.withColumn("price", X.price(F.col("price_n"), F.col("price_d"))).withColumn("day", X.utc_day(F.col("closed_at")))


def daily_medians(trades: DataFrame) -> DataFrame:
    """Upper median price of order-book trades for each (pair_id, day); a day without one has no row."""
    return upper_median(with_price(trades.where(F.col("pool_id").isNull())), ["pair_id", "day"], "price", "day_median")


def day_median(trades: DataFrame, day: str) -> DataFrame:
    """The medians of exactly one day."""
    return daily_medians(trades).where(F.col("day") == F.to_date(F.lit(day)))


def contemporaneous_price(trades: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """For each pool fill the upper median of order-book prices within the comparison window on either side, ends included;
    a fill without a price near it has no row. Book trades of one time and price are counted together first."""
    p, w = with_price(trades).withColumn("at", F.unix_micros("closed_at")), params.book_comparison_seconds * 1_000_000
    fills = p.where(F.col("pool_id").isNotNull()).select("pair_id", "trade_id", (F.col("at") - w).alias("low"), (F.col("at") + w).alias("high"))
    found = window_medians(book_prices(p), fills, ["pair_id"], 2 * w, COMPARED_CHUNK * w)
    return found.where(F.col("median").isNotNull()).select("pair_id", "trade_id", F.col("median").alias("book_reference"))


def book_prices(priced: DataFrame) -> DataFrame:
    """(pair_id, at, price, n): order-book prices of each time, counted."""
    return priced.where(F.col("pool_id").isNull() & F.col("price").isNotNull()).groupBy("pair_id", "at", "price").agg(F.count(F.lit(1)).alias("n"))


def verdict(issuer: Column, params: Params, reference: Column | None = None, median: Column | None = None) -> Column:
    """(state, condition) of a trade: the first condition that holds, given the book's price near a pool fill and the day's median."""
    c = F.col
    reference, median = c("book_reference") if reference is None else reference, c("day_median") if median is None else median
    is_pool = c("pool_id").isNotNull()
    base, counter = F.nullif(c("base_account"), F.lit("")), F.nullif(c("counter_account"), F.lit(""))
    excluded = lambda x: F.struct(F.lit("excluded").alias("state"), F.lit(x).alias("condition"))
    plain = lambda x: F.struct(F.lit(x).alias("state"), F.lit(None).cast("string").alias("condition"))
    return (
        F.when(base == counter, excluded("self_trade"))
        .when(c("counter_amount") < F.lit(params.dust).cast("decimal(4,2)"), excluded("dust"))
        .when((base == issuer) | (counter == issuer), excluded("issuer_leg"))
        .when(is_pool & reference.isNull(), plain("unevaluated"))
        .when(is_pool & X.pool_fill_is_dearer(c("price"), reference), excluded("off_book_pool_fill"))
        .when(X.price_is_outlier(c("price"), median, params.outlier_factor), excluded("price_outlier"))
        .otherwise(plain("genuine"))
    )


def classify(trades: DataFrame, issuers: DataFrame, medians: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """Trades with state, condition, day_median and book_reference.

    The first condition that holds decides. A pool fill without a book price near it is unevaluated; a trade whose
    day has no median passes the outlier test. ``medians`` (pair_id, day_median) replaces the days' own medians.
    """
    p = with_price(trades)
    p = p.join(medians.select("pair_id", "day_median"), "pair_id", "left") if medians is not None else p.join(daily_medians(trades), ["pair_id", "day"], "left")
    p = p.join(contemporaneous_price(trades, params), ["pair_id", "trade_id"], "left").join(issuers.select("pair_id", "issuer"), "pair_id", "left")
    return p.withColumn("_v", verdict(F.nullif(F.col("issuer"), F.lit("")), params)).select("*", "_v.state", "_v.condition").drop("_v", "issuer")


def summarise(classified: DataFrame) -> DataFrame:
    """Count and volumes of each pair's states and conditions; every condition has a row, also one without trades."""
    kinds = [("genuine", None), ("unevaluated", None), *(("excluded", c) for c in CONDITIONS)]
    every = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(c).cast("string").alias("condition")) for s, c in kinds))
    grid = classified.select("pair_id").distinct().select("pair_id", F.explode(every).alias("k")).select("pair_id", "k.*")
    found = classified.groupBy("pair_id", "state", "condition").agg(F.count(F.lit(1)).alias("trades"), F.sum("base_amount").alias("base_volume"), F.sum("counter_amount").alias("quote_volume"))
    f = found.alias("f")
    on = (grid["pair_id"] == F.col("f.pair_id")) & (grid["state"] == F.col("f.state")) & grid["condition"].eqNullSafe(F.col("f.condition"))
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c)  # noqa: E731  nothing seen is a measured zero
    return grid.join(f, on, "left").select(grid["pair_id"], grid["state"], grid["condition"], zero("trades"), zero("base_volume"), zero("quote_volume"))


def excluded_pct(classified: DataFrame) -> DataFrame:
    """Excluded share of each pair's quote volume in percent; null without volume."""
    total = F.sum("counter_amount")
    gone = F.sum(F.when(F.col("state") == "excluded", F.col("counter_amount")).otherwise(F.lit(0)))
    return classified.groupBy("pair_id").agg(F.when(total > 0, gone.cast("double") * 100 / total.cast("double")).alias("trades_excluded_pct"))


def last_genuine(classified: DataFrame, anchor: Column) -> DataFrame:
    """Latest genuine trade at or before the anchor and its age; of equal times the larger ledger."""
    g = classified.where((F.col("state") == "genuine") & (F.col("closed_at") <= anchor))
    last = g.groupBy("pair_id").agg(F.max(F.struct("closed_at", "ledger_seq")).alias("m"))
    return last.select("pair_id", F.col("m.closed_at").alias("last_genuine_at"), F.col("m.ledger_seq").alias("last_genuine_ledger"), F.floor((F.unix_micros(anchor) - F.unix_micros("m.closed_at")) / 1_000_000).alias("last_genuine_age_seconds"))


def window_volumes(classified: DataFrame, anchor: Column, params: Params = DEFAULT) -> DataFrame:
    """For one anchor: genuine base volume of 1, 7 and 30 days, oracle-window quote volume and trades, total and excluded quote."""
    genuine = F.col("state") == "genuine"
    within = lambda s: X.in_trailing_window(F.col("closed_at"), anchor, s)
    sums = [F.sum(F.when(genuine & within(d * 86400), F.col("base_amount")).otherwise(F.lit(0))).alias(f"genuine_base_{d}d") for d in (1, 7, 30)]
    o = params.oracle_window_seconds
    return classified.where(F.col("closed_at") <= anchor).groupBy("pair_id").agg(
        *sums,
        F.sum(F.when(genuine & within(o), F.col("counter_amount")).otherwise(F.lit(0))).alias("oracle_quote"),
        F.count(F.when(within(o), 1)).alias("oracle_trades"),
        F.sum("counter_amount").alias("total_quote"),
        F.sum(F.when(F.col("state") == "excluded", F.col("counter_amount")).otherwise(F.lit(0))).alias("excluded_quote"),
    )


def volume_to_supply(volume: Column, supply: Column) -> Column:
    """(value, why): base volume over supply, or the reason for its absence."""
    why = F.when(volume.isNull(), "volume not measured").when(supply.isNull(), "supply not measured").when(supply <= 0, "supply is not positive")
    return F.struct(F.when(why.isNull(), volume.cast("double") / F.nullif(supply, F.lit(0)).cast("double")).alias("value"), why.alias("why"))


def window_sensitivity(classified: DataFrame, anchor: Column, seconds: list[int], cost: DataFrame | None = None) -> DataFrame:
    """Genuine quote volume and trades of each pair for several window lengths; with ``cost`` (pair_id, cost) their total."""
    c = classified.select("*", F.explode(F.array(*map(F.lit, seconds))).alias("window_seconds"))
    inside = c.where(X.in_trailing_window(F.col("closed_at"), anchor, F.col("window_seconds")))
    grid = classified.select("pair_id").distinct().select("pair_id", F.explode(F.array(*map(F.lit, seconds))).alias("window_seconds"))
    found = inside.groupBy("pair_id", "window_seconds").agg(F.sum(F.when(F.col("state") == "genuine", F.col("counter_amount")).otherwise(F.lit(0))).alias("v"), F.count(F.lit(1)).alias("n"))
    out = grid.join(found, ["pair_id", "window_seconds"], "left").select("pair_id", "window_seconds", F.coalesce("v", F.lit(0)).alias("genuine_quote"), F.coalesce("n", F.lit(0)).alias("trades"))
    return out if cost is None else out.join(cost, "pair_id", "left").withColumn("total_attack_cost", F.col("cost") + F.col("genuine_quote"))


def day_grid(trades: DataFrame, anchor: Column) -> DataFrame:
    """Every (pair_id, day) from a pair's first trade to the day before the anchor's, also days without trades."""
    first = trades.groupBy("pair_id").agg(F.min(X.utc_day(F.col("closed_at"))).alias("first"))
    end = F.date_sub(X.utc_day(anchor), 1)
    return first.where(F.col("first") <= end).select("pair_id", F.explode(F.sequence("first", end)).alias("day"))


def daily_volumes(classified: DataFrame, anchor: Column) -> DataFrame:
    """Genuine base and quote volume of each day of the grid."""
    g = classified.where(F.col("state") == "genuine").groupBy("pair_id", "day").agg(F.sum("base_amount").alias("b"), F.sum("counter_amount").alias("q"))
    return day_grid(classified, anchor).join(g, ["pair_id", "day"], "left").select("pair_id", "day", F.coalesce("b", F.lit(0)).alias("genuine_base"), F.coalesce("q", F.lit(0)).alias("genuine_quote"))


def rolling_extremes(classified: DataFrame, anchor: Column, days: int = 7) -> DataFrame:
    """Least and greatest trailing genuine base volume over ``days`` full days, and the volume-weighted price."""
    return rolling_extremes_of(classified, anchor, [days]).drop("days")


def rolling_extremes_of(classified: DataFrame, anchor: Column, lengths: list[int]) -> DataFrame:
    """The same for several lengths in days, a row for each, from one daily table and one sort of it."""
    over = {n: Window.partitionBy("pair_id").orderBy("day").rowsBetween(1 - n, 0) for n in lengths}
    d = daily_volumes(classified, anchor).select("*", *(F.when(F.count(F.lit(1)).over(w) == n, F.sum("genuine_base").over(w)).alias(f"trailing_{n}") for n, w in over.items()))
    price = F.try_divide(F.sum("genuine_quote").cast("double"), F.sum("genuine_base").cast("double"))
    extremes = [F.struct(F.lit(n).alias("days"), F.min(f"trailing_{n}").alias("least"), F.max(f"trailing_{n}").alias("greatest")) for n in lengths]
    return d.groupBy("pair_id").agg(F.array(*extremes).alias("e"), price.alias("weighted_price")).select("pair_id", F.inline("e"), "weighted_price")


def oracle_window(trades: DataFrame, issuers: DataFrame, anchor: Column, params: Params = DEFAULT) -> DataFrame:
    """Genuine quote volume of the window ending at the anchor, judged by the previous full day's medians."""
    medians = daily_medians(trades).where(F.col("day") == F.date_sub(X.utc_day(anchor), 1)).select("pair_id", "day_median")
    reach = params.oracle_window_seconds + params.book_comparison_seconds
    recent = trades.where(X.in_trailing_window(F.col("closed_at"), anchor, reach))
    c = classify(recent, issuers, medians, params)
    return c.where(X.in_trailing_window(F.col("closed_at"), anchor, params.oracle_window_seconds)).groupBy("pair_id").agg(
        F.sum(F.when(F.col("state") == "genuine", F.col("counter_amount")).otherwise(F.lit(0))).alias("oracle_genuine_volume"), F.count(F.lit(1)).alias("oracle_trades")
    )


def historical_supporting(trades: DataFrame, issuers: DataFrame, anchor: Column, params: Params = DEFAULT) -> DataFrame:
    """Classified trades up to the anchor: full days by their own medians, the anchor's day by the day before it."""
    known = trades.where(F.col("closed_at") <= anchor)
    today = X.utc_day(anchor)
    medians = daily_medians(known).where(F.col("day") == F.date_sub(today, 1)).select("pair_id", "day_median")
    full = classify(known, issuers, None, params).where(F.col("day") < today)
    return full.unionByName(classify(known, issuers, medians, params).where(F.col("day") == today))


def distinct_trades(trades: DataFrame) -> DataFrame:
    return trades.dropDuplicates(["pair_id", "trade_id"])


def recent_trades(trades: DataFrame, since: Column) -> DataFrame:
    return trades.where(F.col("closed_at") >= since).orderBy("pair_id", "closed_at", "trade_id")


def trades_from_ledger(trades: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """A range of the trade log; the predicate reaches the files' statistics."""
    out = trades.where(F.col("ledger_seq") >= first)
    return out if last is None else out.where(F.col("ledger_seq") <= last)


def scope_gate(trades: DataFrame, anchor: Column, most: int) -> DataFrame:
    """scope 'full' where the 30-day count is at most ``most``, else 'last_genuine_only', with the reason."""
    n = trades.groupBy("pair_id").agg(F.count(F.when(X.in_trailing_window(F.col("closed_at"), anchor, 30 * 86400), 1)).alias("trades_30d"))
    big = F.col("trades_30d") > most
    return n.select("pair_id", "trades_30d", F.when(big, "last_genuine_only").otherwise("full").alias("scope"), F.when(big, F.lit(f"more than {most} trades in 30 days")).alias("reason"))


def window_end_seen(trades: DataFrame, end: Column) -> DataFrame:
    """Per pair whether a trade at or after the end of the window proves that the window was read to its end."""
    return trades.groupBy("pair_id").agg(F.coalesce(F.max("closed_at") >= end, F.lit(False)).alias("end_seen"))


def latest_before(at: DataFrame, readings: DataFrame, when: str, hours: int) -> DataFrame:
    """Per row of ``at`` (pair_id, ledger_seq, ledger_closed_at) the latest reading not after it, as a struct ``r``; of readings
    at one time the largest row. Readings without a time count for none.

    Times fall into buckets of ``hours``: the latest reading is looked for in the row's own bucket, else it is the last of
    the buckets before, of which a pair has one row each. So no task holds more of a pair than a bucket.
    """
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(hours * 3_600_000_000)).alias("bucket")
    row = F.struct(F.col(when).alias("_at"), F.struct(*(c for c in readings.columns if c != "pair_id")).alias("row"))
    known = readings.where(F.col(when).isNotNull()).select("pair_id", F.lit(None).cast("bigint").alias("ledger_seq"), F.lit(None).cast("timestamp").alias("ledger_closed_at"), F.col(when).alias("t"), bucket(when), row.alias("r"))
    asked = at.select("pair_id", "ledger_seq", "ledger_closed_at", F.col("ledger_closed_at").alias("t"), bucket("ledger_closed_at"), F.lit(None).cast(known.schema["r"].dataType).alias("r"))
    every = known.union(asked)
    earlier = Window.partitionBy("pair_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = every.groupBy("pair_id", "bucket").agg(F.max("r").alias("most")).select("pair_id", "bucket", F.max("most").over(earlier).alias("before"))
    own = Window.partitionBy("pair_id", "bucket").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = every.withColumn("inside", F.max("r").over(own)).where("ledger_seq IS NOT NULL").drop("r")
    return inside.join(before, ["pair_id", "bucket"]).select("pair_id", "ledger_seq", "ledger_closed_at", F.coalesce("inside", "before")["row"].alias("r")).where("r IS NOT NULL")


def attach_supporting(snapshots: DataFrame, holder_readings: DataFrame, trade_readings: DataFrame, holder_hours: int = 48, trade_hours: int = 36) -> DataFrame:
    """Snapshots with the latest readings not after them and not older than allowed; an absence carries its reason.

    holder_readings: pair_id, read_at, circulating_supply, top1_pct, top10_pct. trade_readings: pair_id, anchor,
    trades_excluded_pct, last_genuine_at, searched_days.
    """
    key = ["pair_id", "ledger_seq"]
    at = snapshots.select(*key, "ledger_closed_at")
    out = snapshots
    for readings, when, hours, name in ((holder_readings, "read_at", holder_hours, "holder"), (trade_readings, "anchor", trade_hours, "trade")):
        latest = latest_before(at, readings, when, hours)
        fresh = F.unix_micros("ledger_closed_at") - F.unix_micros(f"r.{when}") <= hours * 3_600_000_000
        kept = latest.select(*key, fresh.alias("_fresh"), *(F.when(fresh, F.col(f"r.{c}")).alias(c) for c in readings.columns if c not in ("pair_id",)))
        out = out.join(kept, key, "left").withColumn(f"{name}_note", F.when(F.col("_fresh").isNull(), f"no {name} reading").when(~F.col("_fresh"), f"the latest {name} reading is older than {hours} h")).drop("_fresh")
    return out

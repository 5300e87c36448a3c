"""Holder balances: population, concentration, ranking, who of the traders holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def population(holders: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Holders with ``dropped``: 'excluded' (exclusions: asset_id, account_id), 'zero' for balances not above 0, null for those that stay."""
    gone = exclusions.select("asset_id", "account_id", F.lit(True).alias("_gone")).distinct()
    return holders.join(gone, ["asset_id", "account_id"], "left").withColumn("dropped", F.when(F.col("_gone"), "excluded").when(F.col("balance") <= 0, "zero")).drop("_gone")


def population_errors(holders: DataFrame) -> DataFrame:
    """Accounts listed twice for an asset, and negative balances; empty for a sound pull."""
    return holders.groupBy("asset_id", "account_id").agg(F.count(F.lit(1)).alias("n"), F.min("balance").alias("least")).where("n > 1 or least < 0")


def top_k(kept: DataFrame, k: int) -> DataFrame:
    """The k largest balances of each asset; each task keeps only its own k largest before the shuffle."""
    own = Window.partitionBy("asset_id", "_task").orderBy(F.desc("balance"), "account_id")
    first = kept.withColumn("_task", F.pmod(F.xxhash64("account_id"), F.lit(64))).withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= k)
    w = Window.partitionBy("asset_id").orderBy(F.desc("balance"), "account_id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_task", "_r")


def concentration(holders: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Per asset: population, dropped counts, supply, top-1 and top-10 percent, HHI; no figures where nobody is left.

    The sum of squares needs the supply only as a divisor, so one aggregation and a top-10 serve an asset of any size.
    """
    p = population(holders, exclusions)
    kept = F.col("dropped").isNull()
    b = F.when(kept, F.col("balance"))
    sums = p.groupBy("asset_id").agg(
        F.count_if(kept).alias("population"), F.count_if(F.col("dropped") == "excluded").alias("excluded_dropped"), F.count_if(F.col("dropped") == "zero").alias("zero_dropped"),
        F.sum(b).alias("circulating_supply"), F.sum(b.cast("decimal(19,7)") * b.cast("decimal(19,7)")).alias("_squares"), F.max(b).alias("_top1"),
    )
    top10 = top_k(p.where(kept).select("asset_id", "account_id", "balance"), 10).groupBy("asset_id").agg(F.sum("balance").alias("_top10"))
    s = F.col("circulating_supply").cast("double")
    share = lambda c: F.try_divide(F.col(c).cast("double") * 100, s)
    return sums.join(top10, "asset_id", "left").select(
        "asset_id", "population", "excluded_dropped", "zero_dropped", "circulating_supply", share("_top1").alias("top1_pct"), share("_top10").alias("top10_pct"),
        F.try_divide(F.col("_squares").cast("double") * 10_000, s * s).alias("hhi"),
    )


def reading(stats: DataFrame, pull: DataFrame) -> DataFrame:
    """Holder readings: pull (asset_id, ledger_min, ledger_max, truncated) with figures only for a whole, non-empty set."""
    whole = ~F.col("truncated") & (F.coalesce("population", F.lit(0)) > 0)
    figures = ["circulating_supply", "top1_pct", "top10_pct", "hhi"]
    return pull.join(stats, "asset_id", "left").select(
        "asset_id", F.col("ledger_min").alias("snapshot_ledger"), (F.col("ledger_max") - F.col("ledger_min")).alias("ledger_span"), "truncated", *(F.when(whole, F.col(c)).alias(c) for c in figures)
    )


def targets(pairs: DataFrame) -> DataFrame:
    """Distinct issued assets on either side of the pairs."""
    return pairs.select(F.col("base").alias("asset_id")).union(pairs.select(F.col("quote").alias("asset_id"))).where(F.col("asset_id") != "XLM").distinct().orderBy("asset_id")


def ranking(kept: DataFrame) -> DataFrame:
    """Rank, share and cumulative share of every holder (asset_id, account_id, balance), by balance then account.

    Balances are spread over ranges of their size: counts and sums of the ranges above shift each range's own
    ranks, so the sort of one asset is shared by as many tasks as it has ranges.
    """
    banded = kept.withColumn("_band", F.floor(F.log2(F.greatest(F.col("balance").cast("double"), F.lit(1e-7))) * 4))
    bands = banded.groupBy("asset_id", "_band").agg(F.count(F.lit(1)).alias("_n"), F.sum("balance").alias("_s"))
    above = Window.partitionBy("asset_id").orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_n_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).withColumn("_s_above", F.coalesce(F.sum("_s").over(above), F.lit(0)))
    bands = bands.withColumn("_supply", F.sum("_s").over(Window.partitionBy("asset_id")))
    w = Window.partitionBy("asset_id", "_band").orderBy(F.desc("balance"), "account_id")
    out = banded.join(bands.drop("_n", "_s"), ["asset_id", "_band"])
    upto = F.sum("balance").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_s_above")
    supply = F.col("_supply").cast("double")
    return out.select("asset_id", "account_id", "balance", (F.row_number().over(w) + F.col("_n_above")).alias("rank"), (F.col("balance").cast("double") * 100 / supply).alias("share_pct"), (upto.cast("double") * 100 / supply).alias("cumulative_pct"))


def side_counts(trades: DataFrame, windows: list[tuple[str, Column]]) -> DataFrame:
    """Per pair and account: trades as base and as counter, and a bit for each named window in which it traded, with its label."""
    mask = sum((F.when(on, 1 << k).otherwise(0) for k, (_, on) in enumerate(windows)), F.lit(0))
    both = trades.withColumn("_mask", mask).select("pair_id", "_mask", F.explode(F.array(F.struct(F.col("base_account").alias("account_id"), F.lit(1).alias("b"), F.lit(0).alias("c")), F.struct(F.col("counter_account").alias("account_id"), F.lit(0).alias("b"), F.lit(1).alias("c")))).alias("s"))
    out = both.groupBy("pair_id", "s.account_id").agg(F.sum("s.b").alias("as_base"), F.sum("s.c").alias("as_counter"), F.bit_or("_mask").alias("window_mask"))
    names = F.array_compact(F.array(*(F.when(F.col("window_mask").bitwiseAND(F.lit(1 << k)) != 0, n) for k, (n, _) in enumerate(windows))))
    return out.withColumn("window_label", F.array_join(names, " + "))


def trader_status(traders: DataFrame, trustlines: DataFrame) -> DataFrame:
    """Traders (pair_id, account_id, window_label) by status of their trustline (pair_id, account_id, balance) with the quantity held."""
    j = traders.join(trustlines.select("pair_id", "account_id", "balance"), ["pair_id", "account_id"], "left")
    status = F.when(F.col("balance").isNull(), "no_trustline").when(F.col("balance") == 0, "zero_trustline").otherwise("non_zero_balance")
    return j.groupBy("pair_id", "window_label").agg(
        *(F.count_if(status == s).alias(s) for s in ("non_zero_balance", "zero_trustline", "no_trustline")), F.coalesce(F.sum("balance"), F.lit(0)).alias("held")
    )


def ever_traded(kept: DataFrame, traders: DataFrame) -> DataFrame:
    """Holders and quantity of each asset by whether the account ever traded."""
    t = traders.select("asset_id", "account_id", F.lit(True).alias("_t")).distinct()
    j = kept.join(t, ["asset_id", "account_id"], "left").groupBy("asset_id", F.coalesce("_t", F.lit(False)).alias("traded")).agg(F.count(F.lit(1)).alias("holders"), F.sum("balance").alias("quantity"))
    return j.withColumn("share_pct", F.col("quantity").cast("double") * 100 / F.sum("quantity").over(Window.partitionBy("asset_id")).cast("double"))


def pull_spread(pull: DataFrame, limit: int) -> DataFrame:
    return pull.groupBy("asset_id").agg((F.max("latest_ledger") - F.min("latest_ledger")).alias("ledger_span")).withColumn("within", F.col("ledger_span") <= limit)


def page_cap_coverage(holders: DataFrame, caps: list[int], page: int = 200) -> DataFrame:
    """For each page cap the assets whose whole set fits, and the pages read."""
    pages = holders.groupBy("asset_id").agg(F.ceil(F.count(F.lit(1)) / page).cast("bigint").alias("pages"))
    c = pages.select("pages", F.explode(F.array(*map(F.lit, caps))).alias("cap"))
    return c.groupBy("cap").agg(F.count_if(F.col("pages") <= F.col("cap")).alias("covered"), F.count(F.lit(1)).alias("assets"), F.sum(F.least("pages", "cap")).alias("pages_read"))


def supply_sensitivity(volumes: DataFrame, denominators: DataFrame) -> DataFrame:
    """One genuine volume (pair_id, volume) over several denominators (pair_id, name, quantity)."""
    return volumes.join(denominators, "pair_id").select("pair_id", "name", F.try_divide(F.col("volume").cast("double"), F.nullif(F.col("quantity"), F.lit(0)).cast("double")).alias("ratio"))

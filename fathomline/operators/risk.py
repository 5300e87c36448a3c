"""Risk of each (pair_id, ledger_seq): collateral ceiling, oracle resistance, flags in three states, band.

A flag is triggered, clear or unevaluated; null inputs mean not measured and never count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.operators import book
from fathomline.operators.book import DELTA, KEY
from fathomline.params import DEFAULT, METHODOLOGY_VERSION, Params

#: Flags with their tiers, in report order; tiers from least to worst.
FLAGS = [
    ("NO_EXECUTABLE_PRICE", "CRITICAL"), ("ZERO_DEPTH_2PCT", "CRITICAL"), ("MANIPULATION_CHEAP", "CRITICAL"),
    ("MANIPULATION_RATIO_LOW", "HIGH"), ("PRICE_SOURCE_CONFLICT", "HIGH"), ("SPREAD_EXTREME", "HIGH"), ("NO_GENUINE_TRADE_30D", "HIGH"), ("HOLDER_CONCENTRATION_EXTREME", "HIGH"),
    ("THIN_DEPTH_5PCT", "MEDIUM"), ("NO_GENUINE_TRADE_7D", "MEDIUM"), ("HOLDER_CONCENTRATION_HIGH", "MEDIUM"), ("WASH_TRADE_SUSPECTED", "MEDIUM"),
]
TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
#: Columns that a supporting table may have; a missing one is not measured.
SUPPORTING = {
    "circulating_supply": "decimal(30,7)", "top1_pct": "double", "top10_pct": "double", "trades_excluded_pct": "double",
    "last_genuine_age_seconds": "bigint", "searched_days": "int", "oracle_genuine_volume": "decimal(30,7)", "oracle_anchor": "timestamp",
}


def rung(ladder: Column, delta: str) -> Column:
    """The rung with exactly this delta, never the nearest; null if there is none."""
    return F.get(F.filter(ladder, lambda r: r["delta"] == F.lit(delta).cast(DELTA)), F.lit(0))


def collateral(depth: Column, manipulation: Column, params: Params = DEFAULT) -> Column:
    """(max_safe, liquidation_limit, manipulation_limit, warning); the manipulation term counts only where the book reaches it."""
    d, m = rung(depth, params.liquidation_delta), rung(manipulation, params.critical_delta)
    liq = (d["sell_side"] * F.lit(params.liquidation_haircut).cast("decimal(4,2)")).cast("decimal(38,10)")
    man = F.when(m["book_reachable"], (m["book_cost"] * F.lit(params.manipulation_margin).cast("decimal(4,2)")).cast("decimal(38,10)"))
    warning = (
        F.when(d.isNull(), "no depth rung at the liquidation delta")
        .when(m.isNull(), "no manipulation rung at the critical delta")
        .when(~m["book_reachable"], "the critical delta is unreachable through the order book")
    )
    return F.struct(F.when(d.isNotNull(), F.least(liq, man)).alias("max_safe"), liq.alias("liquidation_limit"), F.when(d.isNotNull(), man).alias("manipulation_limit"), warning.alias("warning"))


def oracle_resistance(manipulation: Column, volume: Column, params: Params = DEFAULT) -> Column:
    """(total, ratio, reason): cost plus genuine volume, and cost over it; null without a reachable rung or a measured volume."""
    m = rung(manipulation, params.critical_delta)
    known = m.isNotNull() & volume.isNotNull() & m["book_reachable"]
    reason = F.when(m.isNull(), "no manipulation rung at the critical delta").when(volume.isNull(), "genuine volume was not measured at this ledger").when(~m["book_reachable"], "unreachable")
    cost = m["book_cost"].cast("decimal(30,10)")
    return F.struct(F.when(known, cost + volume).alias("total"), F.when(known, F.try_divide(cost, F.when(volume > 0, volume.cast("decimal(30,10)")))).alias("ratio"), reason.alias("reason"))


def _state(unknown: Column, triggered: Column) -> Column:
    return F.when(F.coalesce(unknown, F.lit(True)), "unevaluated").when(F.coalesce(triggered, F.lit(False)), "triggered").otherwise("clear")


def manipulation_ratio_is_low(ladder: Column, supply: Column, p0: Column, params: Params = DEFAULT) -> Column:
    """Whether any reachable book rung costs less than the given share of supply * p0; strict."""
    cap = supply.cast("double") * p0.cast("double")
    return F.exists(ladder, lambda r: r["book_reachable"] & (r["book_cost"].cast("double") * 100 < cap * float(params.manipulation_ratio_low_pct)))


def flag_states(params: Params = DEFAULT) -> Column:
    """ARRAY<STRUCT<flag, tier, state>> in report order."""
    depth, man = F.col("depth"), F.col("manipulation")
    d2, d5 = rung(depth, "0.02"), rung(depth, "0.05")
    supply, p0, age, searched = F.col("circulating_supply"), F.col("p0"), F.col("last_genuine_age_seconds"), F.col("searched_days")

    def stale(days: int) -> Column:
        return _state(age.isNull() & searched.isNull() | (age.isNull() & (searched < days)), F.coalesce(age > days * 86400, searched >= days))

    rules = {
        "NO_EXECUTABLE_PRICE": _state(F.lit(False), F.col("price_source") == "none"),
        "ZERO_DEPTH_2PCT": _state(d2.isNull(), (d2["buy_side"] == 0) | (d2["sell_side"] == 0)),
        "MANIPULATION_CHEAP": _state(man.isNull(), F.exists(man, lambda r: r["book_reachable"] & (r["book_cost"] < params.manipulation_cheap))),
        "MANIPULATION_RATIO_LOW": _state(man.isNull() | supply.isNull() | p0.isNull() | (supply <= 0) | (p0 <= 0), manipulation_ratio_is_low(man, supply, p0, params)),
        "PRICE_SOURCE_CONFLICT": _state(F.col("spot").isNotNull() & F.col("divergence_pct").isNull(), F.col("divergence_pct") > params.divergence_pct),
        "SPREAD_EXTREME": _state(F.col("spread_pct").isNull(), F.col("spread_pct") > params.spread_pct),
        "NO_GENUINE_TRADE_30D": stale(params.stale_days),
        "HOLDER_CONCENTRATION_EXTREME": _state(F.col("top1_pct").isNull(), F.col("top1_pct") > params.top1_pct),
        "THIN_DEPTH_5PCT": _state(d5.isNull(), F.least(d5["buy_side"], d5["sell_side"]) < params.thin_depth),
        "NO_GENUINE_TRADE_7D": stale(params.stale_warn_days),
        "HOLDER_CONCENTRATION_HIGH": _state(F.col("top10_pct").isNull(), F.col("top10_pct") > params.top10_pct),
        "WASH_TRADE_SUSPECTED": _state(F.col("trades_excluded_pct").isNull(), F.col("trades_excluded_pct") > params.wash_pct),
    }
    return F.array(*(F.struct(F.lit(f).alias("flag"), F.lit(t).alias("tier"), rules[f].alias("state")) for f, t in FLAGS))


def band(states: Column) -> Column:
    """The worst triggered tier, LOW without one."""
    rank = F.array_max(F.transform(F.filter(states, lambda s: s["state"] == "triggered"), lambda s: F.array_position(F.array(*map(F.lit, TIERS)), s["tier"])))
    return F.element_at(F.array(*map(F.lit, TIERS)), F.coalesce(rank, F.lit(1)).cast("int"))


def band_confidence(states: Column) -> Column:
    """partial if a HIGH or CRITICAL flag is unevaluated."""
    return F.when(F.exists(states, lambda s: (s["state"] == "unevaluated") & s["tier"].isin("HIGH", "CRITICAL")), "partial").otherwise("full")


def reconstruction_warnings(crossed: Column, missing: Column, truncated: Column, unsizable: Column, removals: Column) -> Column:
    """Ordered warnings of a rebuilt book, with a final line either way."""
    lines = F.array_compact(
        F.array(
            F.when(crossed, F.lit("the rebuilt book is crossed")),
            F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" offers named by trades were never seen"))),
            F.when(truncated > 0, F.concat(truncated.cast("string"), F.lit(" account walks were cut short"))),
            F.when(unsizable > 0, F.concat(unsizable.cast("string"), F.lit(" operations could not be sized"))),
            F.when(removals > 0, F.concat(removals.cast("string"), F.lit(" known removals were applied"))),
        )
    )
    return F.concat(lines, F.array(F.when(F.size(lines) == 0, "the reconstruction has no known gap").otherwise("the reconstruction has gaps")))


def asset_risk(snapshots: DataFrame, levels: DataFrame, pools: DataFrame, supporting: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """One row for every snapshot: price, ladders, ceiling, oracle resistance, flags, band, warnings.

    ``supporting`` is keyed by pair and ledger and may have the columns of SUPPORTING. The oracle volume counts only
    where its anchor is this ledger's close time.
    """
    return assessed(book.priced_ladders(snapshots, levels, pools, params), supporting, params)


def assessed(out: DataFrame, supporting: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """Priced snapshots with their ladders, and what follows from them: ceiling, oracle resistance, flags, band."""
    if supporting is not None:
        out = out.join(supporting.select(*KEY, *(c for c in SUPPORTING if c in supporting.columns)), KEY, "left")
    for c, kind in SUPPORTING.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    out = out.withColumn("oracle_volume_used", F.when(F.col("oracle_anchor") == F.col("ledger_closed_at"), F.col("oracle_genuine_volume")))
    out = out.withColumn("flag_states", flag_states(params))
    return out.select(
        "*",
        collateral(F.col("depth"), F.col("manipulation"), params).alias("collateral"),
        oracle_resistance(F.col("manipulation"), F.col("oracle_volume_used"), params).alias("oracle"),
        F.transform(F.filter("flag_states", lambda s: s["state"] == "triggered"), lambda s: s["flag"]).alias("flags"),
        F.transform(F.filter("flag_states", lambda s: s["state"] == "unevaluated"), lambda s: s["flag"]).alias("unevaluated_flags"),
        band(F.col("flag_states")).alias("band"),
        band_confidence(F.col("flag_states")).alias("band_confidence"),
        F.lit(METHODOLOGY_VERSION).alias("methodology_version"),
    )

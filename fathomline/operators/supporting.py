"""Trade figures of every (pair, ledger) at once: genuine volumes of trailing windows, last genuine trade, excluded share.

A trade is judged differently by the day of the ledger that asks. On a complete day it is judged by its own day's
median. On the asking ledger's own day it is judged by the day before, which must have been read whole. A pool fill is
compared with book trades around it, of the complete days only or of the asking day only, and none after the asking
ledger. So each trade has three verdicts: as of a later day, of the next day, and of its own day; only pool fills within
the comparison window before a ledger depend on that ledger itself, and only they meet it. All else comes from running
sums: a window is the difference of two places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.operators import trades as T
from fathomline.operators.running import up_to, window_medians
from fathomline.params import DEFAULT, Params

SECOND, DAY = 1_000_000, 86_400_000_000
#: Window lengths in days of the volumes that are set against the supply.
WINDOW_DAYS = (1, 7, 30)
#: Trades of so long a time (microseconds) may meet in one task.
BUCKET = 3_600_000_000
#: Verdicts: for ledgers of a later day, of the next day, of the trade's own day (book trades and pool fills apart).
LATER, NEXT, SAME, SAME_FILL = "later", "next", "same", "fill"
_KEY = ["pair_id", "ledger_seq"]


def _day_start(at: Column) -> Column:
    return F.floor(at / F.lit(DAY)) * DAY


def judged(trades: DataFrame, issuers: DataFrame, anchors: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Trades with their states ``later``, ``next``, ``same``; and (pair_id, ledger_seq, trade_id) with the state ``edge`` of
    each pool fill that the ledger's own time cuts off from book trades after it."""
    w = params.book_comparison_seconds * SECOND
    priced = T.with_price(trades).withColumn("at", F.unix_micros("closed_at"))
    medians = T.daily_medians(trades)
    day_before = medians.select("pair_id", F.date_add("day", 1).alias("day"), F.col("day_median").alias("before_median"))
    fills = priced.where(F.col("pool_id").isNotNull()).select("pair_id", "trade_id", "at")
    start = _day_start(F.col("at"))
    window = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    low, high = F.col("at") - w, F.col("at") + w
    own = fills.select("pair_id", "trade_id", F.explode(F.array_compact(F.array(
        window(LATER, low, high), F.when(high >= start + DAY, window(NEXT, low, start + DAY - 1)), F.when(low < start, window(SAME, start, high)),
    ))).alias("q")).select("pair_id", "trade_id", "q.*")
    prices, chunk = T.book_prices(priced), T.COMPARED_CHUNK * w
    found = window_medians(prices, own, ["pair_id"], 2 * w, chunk)
    seen = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct(F.lit(True).alias("known"), F.col("median"))))
    by_fill = found.groupBy("pair_id", "trade_id").agg(*(seen(k).alias(f"ref_{k}") for k in (LATER, NEXT, SAME)))
    out = priced.join(medians, ["pair_id", "day"], "left").join(day_before, ["pair_id", "day"], "left").join(by_fill, ["pair_id", "trade_id"], "left").join(issuers.select("pair_id", "issuer"), "pair_id", "left")
    cut = lambda k: F.when(F.col(f"ref_{k}.known"), F.col(f"ref_{k}.median")).otherwise(F.col("ref_later.median"))  # noqa: E731  not cut off: as for later days
    issuer = F.nullif(F.col("issuer"), F.lit(""))
    state = lambda reference, median: T.verdict(issuer, params, reference, F.col(median))["state"]
    out = out.withColumns({LATER: state(F.col("ref_later.median"), "day_median"), NEXT: state(cut(NEXT), "day_median"), SAME: state(cut(SAME), "before_median")})
    cut_off = edge_fills(priced.where(F.col("pool_id").isNotNull()), anchors, w).join(day_before, ["pair_id", "day"], "left").join(issuers.select("pair_id", "issuer"), "pair_id", "left")
    edges = window_medians(prices, cut_off.withColumns({"low": F.greatest(low, F.col("day_start")), "high": F.col("anchor")}), ["pair_id"], 2 * w, chunk)
    return out, edges.select(*_KEY, "trade_id", "at", "anchor", "base_amount", "counter_amount", state(F.col("median"), "before_median").alias("edge"))


def edge_fills(fills: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """Pool fills of the ledger's own day within ``width`` before it, with anchor and day_start: a join by time buckets of that width."""
    bucket = F.floor(F.col("at") / width).alias("bucket")
    a = anchors.select(*_KEY, F.unix_micros("ledger_closed_at").alias("anchor")).withColumn("day_start", _day_start(F.col("anchor")))
    fills = fills.drop("ledger_seq")
    own = F.floor(F.col("anchor") / width)
    near = a.select("*", F.explode(F.array(own - 1, own)).alias("bucket")).join(fills.select("*", bucket), ["pair_id", "bucket"])
    return near.where((F.col("at") > F.col("anchor") - width) & (F.col("at") <= F.col("anchor")) & (F.col("at") >= F.col("day_start")))


def supporting_at(trades: DataFrame, issuers: DataFrame, anchors: DataFrame, supply: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """One row for every anchor (pair_id, ledger_seq, ledger_closed_at; one for each pair and ledger).

    genuine_base_{1,7,30}d, oracle_genuine_volume (quote, of the oracle window) with oracle_trades recorded in it and
    oracle_anchor, trades_excluded_pct, last_genuine_at and its age in seconds, searched_days; volume_to_supply_{1,7,30}d
    with volume_to_supply_why. ``refused`` says why the trade figures are null: no trade up to the ledger was read, or
    reading began within the day before the ledger's, whose median would be partial. A day before without book trades
    passes every trade of the ledger's day. ``supply`` has (pair_id, ledger_seq, circulating_supply); the ratios need
    trades that reach back over the longest window.
    """
    w, oracle = params.book_comparison_seconds * SECOND, params.oracle_window_seconds * SECOND
    known, edges = judged(trades, issuers, anchors, params)
    kinds = {LATER: F.col(LATER), NEXT: F.col(NEXT), SAME: F.when(F.col("pool_id").isNull(), F.col(SAME)), SAME_FILL: F.when(F.col("pool_id").isNotNull(), F.col(SAME))}
    columns: dict[str, Column] = {}
    for k, state in kinds.items():
        genuine = state == "genuine"
        columns |= {f"base_{k}": F.when(genuine, F.col("base_amount")), f"quote_{k}": F.when(genuine, F.col("counter_amount")), f"excluded_{k}": F.when(state == "excluded", F.col("counter_amount")), f"last_{k}": F.when(genuine, F.col("at"))}
    entries = known.select("pair_id", "at", F.col("counter_amount").alias("total"), F.lit(1).cast("bigint").alias("recorded"), *(c.alias(n) for n, c in columns.items()))
    sums = ["total", "recorded", *(n for n in columns if not n.startswith("last_"))]
    most = [n for n in columns if n.startswith("last_")]

    at = F.col("anchor")
    a = anchors.select(*_KEY, F.unix_micros("ledger_closed_at").alias("anchor")).withColumn("today", _day_start(at))
    windows = {f"{d}d": d * DAY for d in WINDOW_DAYS} | {"oracle": oracle}
    place = lambda name, where, strict=False: F.struct(F.lit(name).alias("place"), where.alias("at"), F.lit(strict).alias("strict"))
    # the last fills that the ledger does not cut off, but none of an earlier day
    uncut = F.when(at - w >= F.col("today"), place("uncut", at - w)).otherwise(place("uncut", F.col("today"), True))
    places = F.array(place("anchor", at), place("today", F.col("today"), True), place("before", F.col("today") - DAY, True), uncut, *(place(n, at - s) for n, s in windows.items()))
    queries = a.select(*_KEY, "today", F.explode(places).alias("p")).select("pair_id", "ledger_seq", "today", "p.*")
    ran = up_to(entries, queries, ["pair_id"], lambda c: F.floor(c / F.lit(BUCKET)), sums, most)
    figures = ran.groupBy(*_KEY).agg(*(F.max(F.when(F.col("place") == p, F.struct(F.col("at").alias("t"), *sums, *most))).alias(f"p_{p}") for p in ("anchor", "today", "before", "uncut", *windows)))

    state = F.col("edge")
    inside = lambda s: F.col("at") > F.col("anchor") - s
    by_anchor = edges.groupBy(*_KEY).agg(
        *(F.sum(F.when((state == "genuine") & inside(s), F.col(f"{kind}_amount"))).alias(f"edge_{kind}_{n}") for n, s in windows.items() for kind in ("base", "counter")),
        F.sum(F.when(state == "excluded", F.col("counter_amount"))).alias("edge_excluded"), F.max(F.when(state == "genuine", F.col("at"))).alias("edge_last"),
    )
    first = trades.groupBy("pair_id").agg(F.unix_micros(F.min("closed_at")).alias("first"))
    out = a.join(figures, _KEY, "left").join(by_anchor, _KEY, "left").join(first, "pair_id", "left")
    if supply is not None:
        out = out.join(supply.select(*_KEY, "circulating_supply"), _KEY, "left")

    def part(name: str, k: str, low: str, high: str) -> Column:
        """What a verdict's figure gains from one place to another; nothing where the first is behind the second."""
        lo, hi = F.col(f"p_{low}"), F.col(f"p_{high}")
        same = (lo["t"] == hi["t"]) & (F.lit(high == "anchor") | (F.lit(high == "uncut") & (at - w >= F.col("today"))))  # entries at the very place count
        later = (lo["t"] < hi["t"]) | same
        return F.when(later, hi[f"{name}_{k}"] - lo[f"{name}_{k}"]).otherwise(F.lit(0))

    def within(name: str, n: str) -> Column:
        """A figure of a trailing window: its parts on days before the last, on the day before, and on the ledger's day."""
        x = F.col(f"p_{n}.t")
        day_before = F.when(x < F.col("p_before.t"), part(name, NEXT, "before", "today")).otherwise(part(name, NEXT, n, "today"))
        same = F.when(x < F.col("today"), part(name, SAME, "today", "anchor") + part(name, SAME_FILL, "today", "uncut")).otherwise(part(name, SAME, n, "anchor") + part(name, SAME_FILL, n, "uncut"))
        edge = F.coalesce(F.col(f"edge_{'base' if name == 'base' else 'counter'}_{n}"), F.lit(0))
        return (part(name, LATER, n, "before") + day_before + same + edge).cast("decimal(38,7)")

    all_excluded = F.col("p_before.excluded_later") + part("excluded", NEXT, "before", "today") + part("excluded", SAME, "today", "anchor") + part("excluded", SAME_FILL, "today", "uncut") + F.coalesce("edge_excluded", F.lit(0))
    since = lambda c, t: F.when(F.col(c) >= t, F.col(c))  # noqa: E731  a verdict counts on its own days only
    last = F.greatest("p_before.last_later", since("p_today.last_next", F.col("p_before.t")), since("p_anchor.last_same", F.col("today")), since("p_uncut.last_fill", F.col("today")), "edge_last")
    refused = F.when(F.col("first").isNull() | (F.col("first") > at), "no trade at or before the ledger was read").when(F.col("first") > F.col("today") - DAY, "the trades begin within the reference day, whose median would be partial")
    covers = F.col("first") <= at - max(WINDOW_DAYS) * DAY
    total = F.col("p_anchor.total")
    results = {f"genuine_base_{d}d": within("base", f"{d}d") for d in WINDOW_DAYS} | {
        "oracle_genuine_volume": within("quote", "oracle"), "oracle_trades": F.col("p_anchor.recorded") - F.col("p_oracle.recorded"), "oracle_anchor": F.timestamp_micros(at),
        "trades_excluded_pct": F.when(total > 0, all_excluded.cast("double") * 100 / total.cast("double")), "last_genuine_at": F.timestamp_micros(last),
        "last_genuine_age_seconds": F.floor((at - last) / SECOND), "searched_days": F.floor((at - F.col("first")) / DAY).cast("int"),
    }
    out = out.withColumn("refused", refused)
    keep = F.col("refused").isNull()
    chosen = [F.when(keep, c).alias(n) for n, c in results.items()]
    if supply is None:
        return out.select(*_KEY, "refused", *chosen)
    volumes = {d: F.when(keep & covers, results[f"genuine_base_{d}d"]) for d in WINDOW_DAYS}
    ratios = {d: T.volume_to_supply(v, F.col("circulating_supply")) for d, v in volumes.items()}
    why = reduce(lambda x, y: F.coalesce(x, y), (r["why"] for r in ratios.values()))
    return out.select(*_KEY, "refused", *chosen, "circulating_supply", *(r["value"].alias(f"volume_to_supply_{d}d") for d, r in ratios.items()), why.alias("volume_to_supply_why"))

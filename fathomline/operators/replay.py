"""Past order books from an event log, without a sequential fold.

An offer's amount at a target is what its last reset (set, delete or known removal) left, less what trades took since;
so versions of every offer come from window functions over its own events, and any number of targets from one
range join on them. Events: pair_id, offer_id, toid, kind ('set', 'delete', 'trade', 'removal'), fill_index, amount,
side, price_n, price_d.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.operators.book import merge_levels
from fathomline.operators.running import up_to

RESTING = ["pair_id", "offer_id"]


def event_order() -> Column:
    """Removals before trades before own results within one operation; trades by fill index."""
    return F.struct("toid", F.when(F.col("kind") == "removal", -1).when(F.col("kind") == "trade", 0).otherwise(1).alias("o"), F.coalesce("fill_index", F.lit(0)).alias("f"))


def events(offer_ops: DataFrame, trades: DataFrame, removals: DataFrame | None = None, target: int | None = None) -> DataFrame:
    """One event log. offer_ops: pair_id, toid, effect ('set' or 'deleted'), offer_id (result), submitted_offer_id, side, amount,
    price_n, price_d. trades: pair_id, toid, fill_index, offer_id, amount. removals: pair_id, offer_id, gone_by_ledger.

    A set names the result offer, a delete the submitted one; id 0 is no offer; synthetic takers never rest. A known
    removal counts only where the target ledger has reached it.
    """
    null = lambda kind: F.lit(None).cast(kind)
    own = offer_ops.select(
        "pair_id", F.when(F.col("effect") == "deleted", F.col("submitted_offer_id")).otherwise(F.col("offer_id")).alias("offer_id"), "toid", F.when(F.col("effect") == "deleted", "delete").otherwise("set").alias("kind"),
        null("int").alias("fill_index"), F.col("amount").cast(X.AMOUNT).alias("amount"), "side", "price_n", "price_d",
    )
    fills = trades.select("pair_id", "offer_id", "toid", F.lit("trade").alias("kind"), "fill_index", F.col("amount").cast(X.AMOUNT).alias("amount"), null("string").alias("side"), null("bigint").alias("price_n"), null("bigint").alias("price_d"))
    out = own.unionByName(fills)
    if removals is not None:
        known = removals if target is None else removals.where(F.col("gone_by_ledger") <= target)
        out = out.unionByName(known.select("pair_id", "offer_id", F.shiftleft("gone_by_ledger", 32).alias("toid"), F.lit("removal").alias("kind"), null("int").alias("fill_index"), null(X.AMOUNT).alias("amount"), null("string").alias("side"), null("bigint").alias("price_n"), null("bigint").alias("price_d")))
    return out.where((F.col("offer_id") != 0) & ~X.synthetic_offer(F.col("offer_id")))


def versions(log: DataFrame) -> DataFrame:
    """What rests after each event of an offer: amount (null where nothing rests), valid from this toid until the next event's.

    One shuffle by offer; an offer's events are its own, so no key is hot.
    """
    o = Window.partitionBy(*RESTING).orderBy("_at", "_tie")
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    e = log.withColumn("_at", event_order()).withColumn("_tie", F.xxhash64("kind", "amount", "price_n", "price_d"))
    reset = F.col("kind") != "trade"
    e = e.withColumn("_epoch", F.sum(reset.cast("int")).over(upto))
    within = Window.partitionBy(*RESTING, "_epoch").orderBy("_at", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    start = lambda c: F.first(F.when(reset, F.col(c))).over(within)
    left = start("amount") - F.sum(F.when(F.col("kind") == "trade", F.col("amount")).otherwise(F.lit(0).cast(X.AMOUNT))).over(within)
    rests = (start("kind") == "set") & (left > 0)
    return e.select(
        *RESTING, "kind", "toid", F.lead("toid").over(o).alias("next_toid"), F.when(rests, left.cast(X.AMOUNT)).alias("amount"),
        start("side").alias("side"), start("price_n").alias("price_n"), start("price_d").alias("price_d"),
    )


def resting_at(found: DataFrame, target: int) -> DataFrame:
    """Offers that rest after all events up to and in the target ledger, in id order."""
    end = (target + 1) << 32
    live = (F.col("toid") < end) & (F.col("next_toid").isNull() | (F.col("next_toid") >= end)) & F.col("amount").isNotNull()
    return found.where(live).select(*RESTING, "side", "price_n", "price_d", "amount").orderBy(*RESTING)


def resting_series(found: DataFrame, targets: DataFrame, bucket: int = 1 << 12) -> DataFrame:
    """Resting offers at every (pair_id, ledger_seq) of ``targets``: each version joins the targets it is valid at.

    A range join by ledger buckets: a version goes to the buckets that hold a target within its span, found by a join
    with the pair's distinct target buckets, so long spans do not multiply rows beyond the targets they serve.
    """
    t = targets.select("pair_id", "ledger_seq").distinct().withColumn("bucket", F.floor(F.col("ledger_seq") / bucket))
    spans = found.where(F.col("amount").isNotNull()).select("*", X.toid_ledger(F.col("toid")).alias("first"), (X.toid_ledger(F.col("next_toid")) - 1).alias("last"))
    wanted = t.groupBy("pair_id").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    low, high = F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket)
    near = spans.join(wanted, "pair_id").select("*", F.explode(F.filter("buckets", lambda b: (b >= low) & (high.isNull() | (b <= high)))).alias("bucket")).drop("buckets")
    on = (F.col("ledger_seq") >= F.col("first")) & (F.col("last").isNull() | (F.col("ledger_seq") <= F.col("last")))
    return near.join(t, ["pair_id", "bucket"]).where(on).select("pair_id", "ledger_seq", "offer_id", "side", "price_n", "price_d", "amount")


def resting_totals(found: DataFrame, targets: DataFrame, bucket: int = 1 << 8) -> DataFrame:
    """(pair_id, ledger_seq, side, offers, amount) of what rests at every (pair_id, ledger_seq) of ``targets``; sides where nothing rests have no row.

    A version adds itself at its first ledger and takes itself away at the next event's; these changes are summed by
    pair, side and ledger before the running sum, so versions never meet targets. The running sum goes over buckets
    of ledgers first and then within each, so no group holds more rows than the ledgers of a bucket or the buckets.
    """
    total, key = "decimal(38,7)", ["pair_id", "side"]
    spans = found.where(F.col("amount").isNotNull())
    change = lambda toid, sign: F.struct(X.toid_ledger(F.col(toid)).alias("ledger_seq"), F.lit(sign).cast("bigint").alias("offers"), (F.col("amount") * sign).cast(total).alias("amount"), F.lit(False).alias("wanted"))
    changes = spans.select(*key, F.explode(F.array(change("toid", 1), change("next_toid", -1))).alias("c")).select(*key, "c.*").where(F.col("ledger_seq").isNotNull())
    asked = targets.select("pair_id", F.explode(F.array(F.lit("ask"), F.lit("bid"))).alias("side"), "ledger_seq", F.lit(0).cast("bigint").alias("offers"), F.lit(0).cast(total).alias("amount"), F.lit(True).alias("wanted"))
    summed = changes.unionByName(asked).groupBy(*key, "ledger_seq").agg(F.sum("offers").alias("offers"), F.sum("amount").cast(total).alias("amount"), F.bool_or("wanted").alias("wanted"))
    summed = summed.withColumn("bucket", F.floor(F.col("ledger_seq") / bucket))
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = summed.groupBy(*key, "bucket").agg(F.sum("offers").alias("o"), F.sum("amount").cast(total).alias("a"))
    before = buckets.select(*key, "bucket", F.coalesce(F.sum("o").over(earlier), F.lit(0)).alias("o"), F.coalesce(F.sum("a").over(earlier), F.lit(0)).cast(total).alias("a"))
    within = Window.partitionBy(*key, "bucket").orderBy("ledger_seq").rowsBetween(Window.unboundedPreceding, 0)
    inside = summed.select(*key, "bucket", "ledger_seq", "wanted", F.sum("offers").over(within).alias("offers"), F.sum("amount").over(within).cast(total).alias("amount"))
    out = inside.where("wanted").join(before, [*key, "bucket"]).select("pair_id", "ledger_seq", "side", (F.col("offers") + F.col("o")).alias("offers"), (F.col("amount") + F.col("a")).cast(total).alias("amount"))
    return out.where(F.col("offers") > 0)


def as_levels(resting: DataFrame) -> DataFrame:
    """Offers as levels of the book: asks as they are, bids with the price inverted and the amount in base units. Other columns stay."""
    bid = F.col("side") == "bid"
    ok = resting.where(X.price_valid(F.col("price_n"), F.col("price_d")) & (F.col("price_d") > 0))
    base = F.when(bid, X.notional(F.col("amount"), F.col("price_n"), F.col("price_d"))).otherwise(F.col("amount")).cast(X.AMOUNT)
    return ok.withColumns({"amount": base, "price_n": F.when(bid, F.col("price_d")).otherwise(F.col("price_n")), "price_d": F.when(bid, F.col("price_n")).otherwise(F.col("price_d"))})


def book_from_offers(resting: DataFrame) -> DataFrame:
    """Book levels of resting offers, one a fraction."""
    return merge_levels(as_levels(resting).select("pair_id", "ledger_seq", "side", "price_n", "price_d", "amount"))


def missing_offers(offer_ops: DataFrame, trades: DataFrame) -> DataFrame:
    """Offers that trades name and the operation log never created, submitted or claimed."""
    seen = offer_ops.select("pair_id", "offer_id").union(offer_ops.select("pair_id", "submitted_offer_id"))
    if "claimed" in offer_ops.columns:
        seen = seen.union(offer_ops.select("pair_id", F.explode("claimed")))
    named = trades.where((F.col("offer_id") != 0) & ~X.synthetic_offer(F.col("offer_id"))).select(*RESTING).distinct()
    return named.join(seen.distinct(), RESTING, "left_anti")


def accounts_to_walk(trades: DataFrame, live: DataFrame) -> DataFrame:
    """(pair_id, account_id, from_trades, from_live): who owned a real offer in trades, or sells now."""
    a = trades.where(~X.synthetic_offer(F.col("offer_id"))).select("pair_id", "account_id", F.lit(True).alias("t"), F.lit(False).alias("l"))
    b = live.select("pair_id", F.col("seller").alias("account_id"), F.lit(False).alias("t"), F.lit(True).alias("l"))
    return a.union(b).groupBy("pair_id", "account_id").agg(F.bool_or("t").alias("from_trades"), F.bool_or("l").alias("from_live"))


def relevant_operations(ops: DataFrame, floor: int, target: int) -> DataFrame:
    """Successful offer operations of the pair within [floor, target]."""
    return ops.where(F.col("successful") & F.col("touches_pair") & F.col("type").isin("manage_sell_offer", "manage_buy_offer", "create_passive_sell_offer") & F.col("ledger_seq").between(floor, target))


def walk_totals(ops: DataFrame) -> DataFrame:
    """Per account and in total (account null): records, earliest ledger, offer operations, unsizable and failed ones."""
    offer = F.col("type").isin("manage_sell_offer", "manage_buy_offer", "create_passive_sell_offer")
    return ops.rollup("account_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("ledger_seq").alias("earliest"), F.count_if(offer).alias("offer_ops"), F.min(F.when(offer, F.col("ledger_seq"))).alias("earliest_offer_op"),
        F.count_if(F.col("amount").isNull() & offer).alias("unsizable"), F.count_if(~F.col("successful")).alias("failed"),
    )


def completeness(totals: DataFrame, trade_window_start: int) -> DataFrame:
    """may_be_inflated where operations begin before the trades that would reduce them; complete where nothing is missing."""
    return totals.withColumn("may_be_inflated", F.coalesce(F.col("earliest_offer_op") < trade_window_start, F.lit(False))).withColumn("complete", (F.col("unsizable") == 0) & ~F.col("may_be_inflated"))


def persistable(points: DataFrame, accept_gaps: bool = False) -> DataFrame:
    """Points that may be stored: never a crossed book, gaps only where accepted."""
    ok = points.where(~F.col("crossed"))
    return ok if accept_gaps else ok.where(F.col("missing") == 0)


def daily_samples(trades: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(pair_id, day, ledger_seq, offset_seconds): the first trade's ledger of each UTC day, and extra ledgers (pair_id, ledger_seq)."""
    d = trades.withColumn("day", X.utc_day(F.col("closed_at"))).groupBy("pair_id", "day").agg(F.min_by(F.struct("ledger_seq", "closed_at"), F.struct("closed_at", "trade_id")).alias("s"))
    out = d.select("pair_id", "day", "s.ledger_seq", F.floor((F.unix_micros("s.closed_at") - F.unix_micros(F.col("day").cast("timestamp"))) / 1_000_000).alias("offset_seconds"))
    return out if extra is None else out.unionByName(extra.select("pair_id", F.lit(None).cast("date").alias("day"), "ledger_seq", F.lit(None).cast("bigint").alias("offset_seconds")))


def rewind(live: DataFrame, target: int) -> DataFrame:
    """Live offers not modified after the target stay as they were; others are counted as changed."""
    kept = F.col("last_modified_ledger") <= target
    return live.groupBy("pair_id").agg(F.count_if(kept).alias("carried"), F.count_if(~kept).alias("changed_after_target"))


def rewound_books(live: DataFrame, targets: DataFrame) -> DataFrame:
    """Levels of the book at every (pair_id, ledger_seq) of ``targets``: the live offers that were not modified after it."""
    t = targets.select("pair_id", "ledger_seq").distinct()
    return book_from_offers(live.join(t, "pair_id").where(F.col("last_modified_ledger") <= F.col("ledger_seq")))


def rewound_points(live: DataFrame, traded: DataFrame, targets: DataFrame, span: int = 1 << 12) -> DataFrame:
    """For every (pair_id, ledger_seq) of ``targets``: offers carried back, changed after it, and gone: real offers traded at or
    after it (pair_id, ledger_seq, offer_id) that are not live now. certain: nothing on the book was guessed at.

    Counts are running sums over the ledgers, so targets meet neither offers nor trades.
    """
    last = traded.where((F.col("offer_id") != 0) & ~X.synthetic_offer(F.col("offer_id"))).groupBy(*RESTING).agg(F.max("ledger_seq").alias("at"))
    gone = last.join(live.select(*RESTING), RESTING, "left_anti")
    kept, left = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    entries = live.select("pair_id", F.col("last_modified_ledger").alias("at"), kept.alias("offers"), left.alias("gone")).union(gone.select("pair_id", "at", left, kept))
    t = targets.select("pair_id", "ledger_seq").distinct()
    place = lambda name, at, strict=False: F.struct(F.lit(name).alias("place"), at.cast("bigint").alias("at"), F.lit(strict).alias("strict"))
    end = F.lit(1 << 33)
    asked = t.select("*", F.explode(F.array(place("upto", F.col("ledger_seq")), place("before", F.col("ledger_seq"), True), place("all", end))).alias("p")).select("pair_id", "ledger_seq", "p.*")
    ran = up_to(entries, asked, ["pair_id"], lambda c: F.floor(c / F.lit(span)), ["offers", "gone"])
    figure = lambda place, c: F.max(F.when(F.col("place") == place, F.col(c)))
    out = ran.groupBy("pair_id", "ledger_seq").agg(figure("upto", "offers").alias("carried"), (figure("all", "offers") - figure("upto", "offers")).alias("changed_after_target"), (figure("all", "gone") - figure("before", "gone")).alias("gone"))
    return out.withColumn("certain", (F.col("changed_after_target") == 0) & (F.col("gone") == 0))


def gone_offers(trades: DataFrame, live: DataFrame, target: int) -> DataFrame:
    """Real offers traded at or after the target that are not live now, counted per pair."""
    traded = trades.where((F.col("ledger_seq") >= target) & ~X.synthetic_offer(F.col("offer_id"))).select(*RESTING).distinct()
    return traded.join(live.select(*RESTING), RESTING, "left_anti").groupBy("pair_id").agg(F.count(F.lit(1)).alias("gone"))


def pool_reserves_at(effects: DataFrame, pools: DataFrame, target: int) -> DataFrame:
    """Newest reserves of each pool at or before the target: status 'found', 'removed' or 'unreached'."""
    known = effects.where(F.col("ledger_seq") <= target).groupBy("pool_id").agg(F.max_by(F.struct("type", "reserve_base", "reserve_quote"), F.col("token")).alias("e"))
    gone = F.col("e.type") == "liquidity_pool_removed"
    status = F.when(F.col("e").isNull(), "unreached").when(gone, "removed").otherwise("found")
    return pools.select("pool_id").distinct().join(known, "pool_id", "left").select("pool_id", status.alias("status"), F.when(~gone, F.col("e.reserve_base")).alias("reserve_base"), F.when(~gone, F.col("e.reserve_quote")).alias("reserve_quote"))


def removals_applied(log: DataFrame) -> DataFrame:
    """Known removals of offers that were resting just before them."""
    o = Window.partitionBy(*RESTING).orderBy("toid", F.when(F.col("kind") == "removal", 0).otherwise(1))
    v = versions(log).withColumn("_before", F.lag("amount").over(o))
    return v.where((F.col("kind") == "removal") & F.col("_before").isNotNull()).select(*RESTING, X.toid_ledger(F.col("toid")).alias("gone_by_ledger"))

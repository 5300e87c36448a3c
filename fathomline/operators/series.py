"""Risk at every point of a rebuilt series of books, without a book for each point.

Offer versions become level intervals: spans of ledgers over which a level has one amount. For the best prices an
interval is cut into at most two blocks of each power of two of ledgers, and a ledger lies in one block of each power.
Counts and sums need no intervals, only what changes at their ends: the sum of a side up to a price at a ledger is the
sum of the changes at or before both. Changes are dealt to slices of the price, each small enough for one task, where all
sums are read from one wavelet matrix; whole slices below come from running totals. Intervals and ledgers never meet in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.operators import book, replay, risk
from fathomline.operators.book import KEY
from fathomline.operators.running import dominated_sums, up_to
from fathomline.params import DEFAULT, Params
from fathomline.scratch import written

#: Ledgers have so many bits, and blocks so many sizes and one.
LEDGER_BITS = 32
#: A slice of prices begins at one of so many places of a factor of two, and ends where it has so many changes or more.
PLACES_A_DOUBLING, SLICE = 512, 1 << 18
#: So many questions about a slice may meet in one task.
ASKED = 1 << 20
_LEVEL = ["pair_id", "side", "price_n", "price_d"]
_BLOCK = ["pair_id", "side", "size", "block"]
_SIDE = ["pair_id", "side"]


def level_intervals(found: DataFrame) -> DataFrame:
    """(pair_id, side, price_n, price_d, first, until, amount, offers): levels from ledger ``first`` to before ``until`` (null: still).

    ``found`` are the versions of ``replay.versions``. Changes of a level within a ledger are added up first.
    """
    v = replay.as_levels(found.where(F.col("amount").isNotNull()))
    change = lambda toid, sign: F.struct(X.toid_ledger(F.col(toid)).alias("first"), (F.col("amount") * sign).cast("decimal(38,7)").alias("amount"), F.lit(sign).cast("bigint").alias("offers"))
    changes = v.select(*_LEVEL, F.explode(F.array(change("toid", 1), change("next_toid", -1))).alias("c")).select(*_LEVEL, "c.*").where(F.col("first").isNotNull())
    summed = changes.groupBy(*_LEVEL, "first").agg(F.sum("amount").cast("decimal(38,7)").alias("amount"), F.sum("offers").alias("offers"))
    own = Window.partitionBy(*_LEVEL).orderBy("first")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    out = summed.select(*_LEVEL, "first", F.lead("first").over(own).alias("until"), F.sum("amount").over(upto).cast(X.AMOUNT).alias("amount"), F.sum("offers").over(upto).alias("offers"))
    return out.where(F.col("offers") > 0)


def blocks_of(first: Column, until: Column) -> Column:
    """ARRAY<STRUCT<size, block>>: the blocks of 2^size ledgers that make up [first, until), none over another."""
    end = F.coalesce(until, F.lit(1 << LEDGER_BITS))

    def of_size(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        low, high = F.call_function("shiftright", first + width - 1, k), F.call_function("shiftright", end, k)
        block = lambda wanted, b: F.when((low < high) & wanted, F.struct(k.alias("size"), b.alias("block")))
        return F.array(block(low % 2 == 1, low), block(high % 2 == 1, high - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEDGER_BITS)), of_size)))


def _price_place(at: Column) -> Column:
    """Does not fall where the price rises: asks stand at their price, bids at the negative of theirs."""
    log = F.floor(F.log2(F.abs(at).cast("double")) * PLACES_A_DOUBLING)
    return F.when(at < 0, -log).otherwise(log)


def sums_below(changes: DataFrame, queries: DataFrame, size: int = SLICE, asked: int = ASKED) -> DataFrame:
    """``queries`` (pair_id, side, ledger_seq, at, strict, rung) with ``quote``: the sum of the changes (pair_id, side, ledger_seq, at, quote)
    of their side at or before their ledger, and at or below their price (strict: below it).

    A slice has about ``size`` changes, and more only where one place of the price has; of the questions about a slice
    about ``asked`` are answered in one task. Slices below the question's own are added up by blocks of powers of two.
    """
    placed = lambda df: df.withColumn("bucket", _price_place(F.col("at")))
    places = placed(changes).select(*_SIDE, "bucket", F.lit(1).alias("n")).union(placed(queries).select(*_SIDE, "bucket", F.lit(0))).groupBy(*_SIDE, "bucket").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*_SIDE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    numbered = places.select(*_SIDE, "bucket", F.floor(F.coalesce(before, F.lit(0)) / size).alias("slice"))
    slices = numbered.withColumn("slices", F.max("slice").over(Window.partitionBy(*_SIDE)) + 1)
    # from here on a slice is the bucket
    sliced = lambda df, *own: placed(df).join(slices, [*_SIDE, "bucket"]).select(*_SIDE, F.col("slice").alias("bucket"), "ledger_seq", "at", *own)
    entries, questions = sliced(changes, "quote", "slices"), sliced(queries, "strict", "rung")

    slice_key = [*_SIDE, "bucket"]
    parts = questions.groupBy(*slice_key).agg(F.ceil(F.count(F.lit(1)) / asked).alias("parts"))
    known = entries.join(parts, slice_key).select(*slice_key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("ledger_seq").alias("x"), F.col("at").alias("y"), "quote")
    wanted = questions.join(parts, slice_key).select(*slice_key, F.pmod("ledger_seq", "parts").alias("part"), F.col("ledger_seq").alias("x"), F.col("at").alias("y"), "strict", "rung")
    own = dominated_sums(known, wanted, [*slice_key, "part"], "quote").select(*_SIDE, F.col("x").alias("ledger_seq"), "rung", "quote")

    size_of = F.sequence(F.lit(0), F.lit(30))
    shifted = lambda c, k: F.call_function("shiftright", c, k)
    # a block that some question lies behind: it is the left one of two, and the right one begins within the slices
    left = lambda k: F.when((shifted(F.col("bucket"), k) % 2 == 0) & (F.call_function("shiftleft", shifted(F.col("bucket"), k) + 1, k) < F.col("slices")), F.struct(k.alias("size"), shifted(F.col("bucket"), k).alias("block")))
    totals = entries.groupBy(*slice_key, "slices", "ledger_seq").agg(F.sum("quote").cast(X.WIDE).alias("quote"))
    nodes = totals.select(*_SIDE, F.explode(F.array_compact(F.transform(size_of, left))).alias("b"), F.col("ledger_seq").alias("at"), "quote").select(*_SIDE, "b.*", "at", "quote")
    behind = lambda k: F.when(shifted(F.col("bucket"), k) % 2 == 1, F.struct(k.alias("size"), (shifted(F.col("bucket"), k) - 1).alias("block")))
    visits = questions.select(*_SIDE, F.explode(F.array_compact(F.transform(size_of, behind))).alias("b"), F.col("ledger_seq").alias("at"), F.lit(False).alias("strict"), "rung").select(*_SIDE, "b.*", "at", "strict", "rung")
    lower = up_to(nodes, visits, _BLOCK, lambda c: F.floor(c / F.lit(1 << 12)), ["quote"]).select(*_SIDE, F.col("at").alias("ledger_seq"), "rung", "quote")
    return own.union(lower).groupBy(*_SIDE, "ledger_seq", "rung").agg(F.sum("quote").cast(X.WIDE).alias("quote"))


def series_rows(found: DataFrame, targets: DataFrame, pools: DataFrame | None = None, supporting: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """The full risk record of every (pair_id, ledger_seq) of ``targets``, with the levels and offers of each side.

    ``found`` are the versions of ``replay.versions``; ``pools`` and ``supporting`` are keyed by pair and ledger, an oracle
    volume counts only where ``targets`` have the ledger_closed_at that it is anchored to. A target where nothing rests
    has a row too. Prices below 1e-18 count as none.
    """
    closed = F.min("ledger_closed_at") if "ledger_closed_at" in targets.columns else F.lit(None).cast("timestamp")
    points = written(targets.groupBy(*KEY).agg(closed.alias("ledger_closed_at")))
    intervals = level_intervals(found).withColumn("price", X.price(F.col("price_n"), F.col("price_d"))).where(F.col("price") > 0)
    at = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price")).cast(X.PRICE)
    quote = X.notional(F.col("amount"), F.col("price_n"), F.col("price_d"))
    intervals = written(intervals.select(*_SIDE, at.alias("at"), "amount", "offers", quote.alias("quote"), "first", "until"))

    ends = F.explode(F.array(F.struct(F.col("first").alias("ledger_seq"), F.lit(1).alias("sign")), F.struct(F.col("until").alias("ledger_seq"), F.lit(-1).alias("sign"))))
    changes = intervals.select(*_SIDE, "at", "amount", "offers", "quote", F.col("until").isNull().alias("open"), ends.alias("c")).select("*", "c.*").where(F.col("ledger_seq").isNotNull())
    signed = lambda c: F.when(F.col("sign") < 0, -F.col(c)).otherwise(F.col(c))  # noqa: E731  a product would round wide decimals
    of = lambda side, c, name: F.when(F.col("side") == side, c).alias(name)
    count, amount, still = F.col("sign").cast("bigint"), signed("amount"), F.when(F.col("open"), F.col("at"))
    # levels that are never left are seen from every later ledger, so their best prices run on too
    open_most = [of("bid", -still, "open_bid"), of("ask", -still, "open_ask"), of("ask", still, "open_far")]
    sums = [of("bid", count, "bids"), of("ask", count, "asks"), signed("offers").alias("offers"), of("bid", amount, "bid_amount_total"), of("ask", amount, "ask_amount_total")]
    entries = changes.select("pair_id", F.col("ledger_seq").alias("at"), *sums, *open_most)
    asked = points.select("pair_id", F.col("ledger_seq").alias("at"), F.lit(False).alias("strict"), "ledger_closed_at")
    totals = up_to(entries, asked, ["pair_id"], lambda c: F.floor(c / F.lit(1 << 12)), ["bids", "asks", "offers", "bid_amount_total", "ask_amount_total"], ["open_bid", "open_ask", "open_far"]).withColumnRenamed("at", "ledger_seq")

    over = F.transform(F.sequence(F.lit(0), F.lit(LEDGER_BITS)), lambda k: F.struct(k.alias("size"), F.call_function("shiftright", F.col("ledger_seq"), k).alias("block")))
    asked = points.select(*KEY, F.explode(over).alias("b")).select(*KEY, "b.*")
    in_blocks = lambda df: df.select(*_SIDE, "at", "amount", F.explode(blocks_of(F.col("first"), F.col("until"))).alias("b")).select(*_SIDE, "b.*", "at", "amount")
    # in one buffer of fixed width each, so that blocks are combined by hash before the shuffle
    tops = in_blocks(intervals.where(F.col("until").isNotNull())).groupBy(*_BLOCK).agg(F.min("at").alias("best"), F.max("at").alias("far"))
    side = lambda name, c: F.when(F.col("side") == name, F.col(c))
    top = asked.join(tops, ["pair_id", "size", "block"]).groupBy(*KEY).agg((-F.min(side("bid", "best"))).cast(X.PRICE).alias("best_bid"), F.min(side("ask", "best")).alias("best_ask"), F.max(side("ask", "far")).alias("highest_ask"))
    some = lambda n, c: F.when(F.col(n) > 0, F.col(c)).alias(c)
    best = [F.greatest("best_bid", "open_bid").alias("best_bid"), F.least("best_ask", (-F.col("open_ask")).cast(X.PRICE)).alias("best_ask"), F.greatest("highest_ask", "open_far").alias("highest_ask")]
    topped = totals.join(top, KEY, "left").select(*KEY, "ledger_closed_at", *best, "bids", "asks", "offers", some("bids", "bid_amount_total"), some("asks", "ask_amount_total"))
    crossed = F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False))
    priced = written(book.priced_top(topped.withColumn("crossed", crossed), pools, params))

    near, far = book.rungs_of(params)
    price = book.rung_targets(params)
    # sums of a side up to a price, bids at their negative price; strict: without what stands at it
    rungs = [("below", "ask", F.col("highest_ask"), True), *((f"buy{d}", "ask", price[f"up{d}"], False) for d in near), *((f"cost{d}", "ask", price[f"up{d}"], True) for d in far), *((f"sell{d}", "bid", -price[f"down{d}"], False) for d in near)]
    asks = [F.when(c.isNotNull(), F.struct(F.lit(side).alias("side"), c.cast(X.PRICE).alias("at"), F.lit(strict).alias("strict"), F.lit(k).alias("rung"))) for k, (_, side, c, strict) in enumerate(rungs)]
    queries = priced.select(*KEY, F.explode(F.array_compact(F.array(*asks))).alias("q")).select(*KEY, "q.*")
    summed = sums_below(changes.select(*_SIDE, "ledger_seq", "at", signed("quote").alias("quote")), queries)
    sums = summed.groupBy(*KEY).agg(*(F.coalesce(F.sum(F.when(F.col("rung") == k, F.col("quote"))), F.lit(0)).alias(name) for k, (name, *_) in enumerate(rungs)))
    reach = {f"reach{d}": F.col("highest_ask") >= price[f"up{d}"] for d in far}
    out = risk.assessed(book.with_rungs(priced.join(sums, KEY, "left").withColumns(reach), priced.columns, pools, params), supporting, params)
    # last, as a join that falls away where these columns are not used
    best = asked.join(in_blocks(intervals).groupBy(*_BLOCK).agg(F.min(F.struct("at", (-F.col("amount")).alias("minus"))).alias("best")), ["pair_id", "size", "block"])
    amounts = best.groupBy(*KEY).agg(*((-F.min(side(s, "best"))["minus"]).alias(f"best_{s}_amount") for s in ("bid", "ask")))
    return out.join(amounts, KEY, "left")

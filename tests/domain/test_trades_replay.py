"""Replay against a sequential fold, medians, legs and the registered queries' shapes."""

import datetime
import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.operators import bounds, holders, replay, trades
from fathomline.plans import registry

DATA = "/root/testdata/sf0.001"


def fold(events, target):
    """Sequential replay: (offer -> amount)."""
    book = {}
    for toid, _, _, kind, offer, amount in sorted(events, key=lambda e: e[:3]):
        if toid >> 32 > target:
            continue
        if kind == "set":
            book[offer] = amount
        elif kind in ("delete", "removal"):
            book.pop(offer, None)
        elif offer in book:
            book[offer] -= amount
            if book[offer] <= 0:
                del book[offer]
    return book


def test_replay_is_the_fold(spark):
    rng = random.Random(7)
    seen, events = set(), []
    while len(events) < 600:
        toid, offer = (rng.randrange(1, 40) << 32) + rng.randrange(6), rng.randrange(1, 25)
        kind = rng.choice(["set", "set", "delete", "trade", "trade", "trade"])
        order, fill = (0, rng.randrange(3)) if kind == "trade" else (1, 0)
        if (toid, order, fill, offer) not in seen:
            seen.add((toid, order, fill, offer))
            events.append((toid, order, fill, kind, offer, rng.randrange(1, 20)))
    df = spark.createDataFrame([(0, e[4], e[0], e[3], e[2], D(e[5]), "ask", 1, 1) for e in events], "pair_id int, offer_id bigint, toid bigint, kind string, fill_index int, amount decimal(19,7), side string, price_n bigint, price_d bigint")
    v = replay.versions(df).cache()
    for target in (0, 5, 17, 39):
        assert {r["offer_id"]: r["amount"] for r in replay.resting_at(v, target).collect()} == fold(events, target)
    targets = spark.createDataFrame([(0, t) for t in (3, 5, 17, 30)], "pair_id int, ledger_seq bigint")
    got = {}
    for r in replay.resting_series(v, targets, bucket=8).collect():
        got.setdefault(r["ledger_seq"], {})[r["offer_id"]] = r["amount"]
    assert got == {t: b for t in (3, 5, 17, 30) if (b := fold(events, t))}


def test_replay_series_has_every_ledger(spark):
    """The registered query against a fold over all line items, read here without its adapters."""
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    log = spark.read.parquet(f"{DATA}/lineitem.parquet").select(days.alias("day"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity").collect()
    events = sorted((r["day"], r["l_linenumber"] * 1_000_000 + r["l_suppkey"], r["l_returnflag"] != "R", r["l_partkey"] % 1000 if r["l_returnflag"] == "R" else 0, r["l_orderkey"], r["l_returnflag"], r["l_linestatus"], int(r["l_quantity"])) for r in log)
    want, books = {}, {}
    for day, _, _, _, order, flag, status, quantity in events:
        book = books.setdefault(order % 50, {})
        if order == 0:  # no offer
            pass
        elif flag == "A":
            book[order] = ("bid" if status == "F" else "ask", quantity * 10)
        elif flag == "N":
            book.pop(order, None)
        elif order in book:
            book[order] = (book[order][0], book[order][1] - quantity)
            if book[order][1] <= 0:
                del book[order]
        for side in ("bid", "ask"):
            rest = [a for s, a in book.values() if s == side]
            want[order % 50, day, side] = (len(rest), sum(rest) / 10)
    got = {(r["pair_id"], r["ledger_seq"], r["side"]): (r["offers"], r["amount"]) for r in registry.replay_series(spark, DATA).collect()}
    assert got == {k: x for k, x in want.items() if x[0]}


def test_replay_totals_are_the_sums_of_the_series(spark):
    rng = random.Random(8)
    ids = [(rng.randrange(3), rng.randrange(-20, 60) << 32, rng.randrange(1, 9)) for _ in range(300)]
    df = spark.createDataFrame([(p, o, t + i, rng.choice(["set", "delete", "trade"]), 0, D(rng.randrange(1, 20)), rng.choice(["ask", "bid"]), 1, 1) for i, (p, t, o) in enumerate(ids)], "pair_id bigint, offer_id bigint, toid bigint, kind string, fill_index int, amount decimal(19,7), side string, price_n bigint, price_d bigint")
    v = replay.versions(df).cache()
    targets = spark.createDataFrame([(p, t) for p in range(4) for t in range(-25, 65)], "pair_id bigint, ledger_seq bigint")
    want = replay.resting_series(v, targets, bucket=8).groupBy("pair_id", "ledger_seq", "side").agg(F.count(F.lit(1)), F.sum("amount").cast("double"))
    got = replay.resting_totals(v, targets, bucket=8).withColumn("amount", F.col("amount").cast("double"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1.1, 2.2, 3.3, 4.4)] + [("b", 5.0), ("b", None)], "k string, x double")
    assert {r["k"]: r["m"] for r in trades.upper_median(df, ["k"], "x", "m").collect()} == {"a": 3.3, "b": 5.0}


def trade(i, op, fill, at, n, amount="1", seller=True, pair=1):
    return (pair, i, op, fill, at, at, n, 100, D(amount), D(amount) * n / 100, seller, f"a{i}", f"b{i}", None)


TRADE = "pair_id int, trade_id int, operation_id string, fill_index int, ledger_seq bigint, closed_at long, price_n bigint, price_d bigint, base_amount decimal(19,7), counter_amount decimal(19,7), base_is_seller boolean, base_account string, counter_account string, pool_id string"


def test_legs_and_bounds(spark):
    rows = [trade(1, "7", 0, 10, 100), trade(2, "7", 1, 10, 110), trade(3, "7", 2, 10, 120, seller=False), trade(4, "", 0, 90000, 120), trade(5, "", 0, 90001, 60), trade(6, "9", 0, 90002, 0)]
    df = spark.createDataFrame(rows, TRADE).withColumn("closed_at", F.timestamp_seconds("closed_at"))
    assert sorted((r["first_trade"], r["last_trade"], r["fills"]) for r in bounds.legs(df).collect()) == [(1, 2, 2), (3, 3, 1), (4, 4, 1), (5, 5, 1)]
    b = bounds.implied_bounds(df)
    assert sorted((r["kind"], r["from_trade"], r["to_trade"], round(float(r["delta"]), 6)) for r in b.collect()) == [("between_legs", 2, 3, 0.090909), ("between_legs", 4, 5, 0.5), ("within_leg", 1, 2, 0.1)]
    assert bounds.tightest(b, "0.2").first()["bound"] == D("0.6")


def test_classification_order(spark):
    base = spark.createDataFrame([trade(1, "1", 0, 100, 100), trade(2, "2", 0, 200, 100), trade(3, "3", 0, 300, 400), trade(4, "4", 0, 400, 100, "0.001")], TRADE)
    pool = spark.createDataFrame([trade(5, "5", 0, 500, 100), trade(6, "6", 0, 80000, 1), trade(7, "7", 0, 600, 500)], TRADE).withColumn("pool_id", F.lit("p"))
    own = spark.createDataFrame([trade(8, "8", 0, 700, 100)], TRADE).withColumn("counter_account", F.col("base_account"))
    issued = spark.createDataFrame([trade(9, "9", 0, 800, 100)], TRADE).withColumn("base_account", F.lit("issuer"))
    df = base.union(pool).union(own).union(issued).withColumn("closed_at", F.timestamp_seconds("closed_at"))
    c = trades.classify(df, spark.createDataFrame([(1, "issuer")], "pair_id int, issuer string"))
    assert {r["trade_id"]: r["condition"] or r["state"] for r in c.collect()} == {1: "genuine", 2: "genuine", 3: "price_outlier", 4: "dust", 5: "genuine", 6: "unevaluated", 7: "off_book_pool_fill", 8: "self_trade", 9: "issuer_leg"}
    assert trades.summarise(c).count() == 7


def test_registered_rungs_and_windows(spark):
    q = registry.QUERIES
    assert {f"{k}_{r}" for k in ("within_leg", "between_legs") for r in ("0_02", "0_05", "0_10", "0_5")} <= set(q["trade_daily_rows"](spark, DATA).columns)
    assert {r[0] for r in q["trade_window_sensitivity"](spark, DATA).select("window_seconds").distinct().collect()} == {60, 300, 600, 900, 1800, 3600, 7200, 14400, 43200, 86400}
    assert {r[0] for r in q["trade_rolling_extremes"](spark, DATA).select("days").distinct().collect()} == {1, 7, 30}


def test_concentration(spark):
    h = spark.createDataFrame([(1, k, D(b)) for k, b in enumerate((500, 300, 200, 0, 77))] + [(2, 1, D(0))], "asset_id int, account_id int, balance decimal(19,7)")
    r = {x["asset_id"]: x for x in holders.concentration(h, spark.createDataFrame([(1, 4)], "asset_id int, account_id int")).collect()}
    assert (r[1]["top1_pct"], r[1]["top10_pct"], r[1]["zero_dropped"], r[1]["excluded_dropped"]) == (50.0, 100.0, 1, 1) and abs(r[1]["hhi"] - 3800) < 1e-9
    assert r[2]["population"] == 0 and r[2]["top1_pct"] is None


def test_scalars(spark):
    r = spark.range(1).select(
        X.paging_token(F.lit(f"{(7 << 32) + 4096 + 5}-3")).alias("t"), X.paging_token(F.lit("junk")).alias("j"), X.synthetic_offer(F.lit(str((1 << 62) + 5))).alias("s"), X.asset_parsed(F.lit("ABC%3AG" + "A" * 55)).alias("a"), X.asset_parsed(F.lit("nope")).alias("n"),
        X.price_compare(F.lit(1), F.lit(3), F.lit(2), F.lit(6)).alias("c"), X.price_parsed(F.lit("5"), F.lit("0")).alias("p"), X.json_presence(F.lit('{"k": null}'), "k").alias("k"), X.exact_sqrt(F.lit("1.5").cast("decimal(21,16)")).alias("q"),
    ).first()
    assert tuple(r["t"]) == (str((7 << 32) + 4096 + 5), 3, 7) and tuple(r["j"]) == ("", 0, 0) and r["s"] and r["a"]["code"] == "ABC" and r["n"] is None and r["c"] == 0 and r["p"] is None and r["k"] == "null"
    assert abs(float(r["q"]) - 1.224744871391589) < 1e-15


def test_latest_reading_is_that_of_a_plain_search(spark):
    """As-of attach across buckets, at equal times, before any reading, and beyond the age allowed."""
    base = datetime.datetime(2024, 1, 1)
    rng = random.Random(5)
    reads = [(rng.randrange(3), base + datetime.timedelta(hours=rng.randrange(400)), rng.randrange(5)) for _ in range(40)] + [(0, None, 9)]
    asks = [(p, k, base + datetime.timedelta(hours=k - 20)) for p in range(4) for k in range(0, 440, 7)]
    at = spark.createDataFrame(asks, "pair_id bigint, ledger_seq bigint, ledger_closed_at timestamp")
    readings = spark.createDataFrame(reads, "pair_id bigint, read_at timestamp, value int")
    got = {(r["pair_id"], r["ledger_seq"]): (r["r"]["read_at"], r["r"]["value"]) for r in trades.latest_before(at, readings, "read_at", 48).collect()}
    want = {(p, k): max((a, v) for q, a, v in reads if q == p and a and a <= t) for p, k, t in asks if any(q == p and a and a <= t for q, a, _ in reads)}
    assert got == want


def test_supporting_figures_carry_a_reason_for_absence(spark):
    """A fresh reading is attached, an old one and a missing one give notes."""
    base = datetime.datetime(2024, 1, 1)
    hours = lambda h: base + datetime.timedelta(hours=h)
    snapshots = spark.createDataFrame([("a", 1, hours(0)), ("a", 2, hours(60)), ("b", 1, hours(0))], "pair_id string, ledger_seq bigint, ledger_closed_at timestamp")
    held = spark.createDataFrame([("a", hours(-1), D(5), 1.0, 2.0)], "pair_id string, read_at timestamp, circulating_supply decimal(30,7), top1_pct double, top10_pct double")
    traded = spark.createDataFrame([("a", hours(-1), 3.0, hours(-9), 30)], "pair_id string, anchor timestamp, trades_excluded_pct double, last_genuine_at timestamp, searched_days int")
    got = {(r["pair_id"], r["ledger_seq"]): r for r in trades.attach_supporting(snapshots, held, traded).collect()}
    assert len(got) == 3
    assert (got["a", 1]["top1_pct"], got["a", 1]["searched_days"], got["a", 1]["holder_note"]) == (1.0, 30, None)
    assert got["a", 2]["top1_pct"] is None and got["a", 2]["holder_note"] == "the latest holder reading is older than 48 h"
    assert got["b", 1]["trade_note"] == "no trade reading" and got["b", 1]["holder_note"] == "no holder reading"

"""Trade figures at many anchors against a plain computation of each anchor from its own trades."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fathomline.operators import supporting, trades
from fathomline.params import DEFAULT

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "pair_id bigint, trade_id bigint, ledger_seq bigint, closed_at timestamp, price_n bigint, price_d bigint, base_amount decimal(19,7), counter_amount decimal(19,7), base_account string, counter_account string, pool_id string"


def log(seed: int):
    rng = random.Random(seed)
    out = []
    for pair in (1, 2, 3):
        for _ in range(160):
            day = rng.choice([1, 2, 3, 3, 4, 5, 6]) + (5 if pair == 2 else 0)
            minute = rng.choice([0, 1, 5, 14, 15, 16, 700, 710, 715, 1425, 1430, 1439, rng.randrange(1440)])
            at = START + timedelta(days=day, minutes=minute, seconds=rng.choice([0, 0, 30]))
            price = rng.choice([100, 100, 101, 99, 120, 300, 40, 0])
            amount = rng.choice([1, 2, 5])
            counter = Decimal(price * amount) / 100 if rng.random() > 0.05 else Decimal("0.005")
            out.append((pair, len(out), int(at.timestamp()) // 5, at, price, 100, Decimal(amount), counter, rng.choice("abcI"), rng.choice("defab"), "pool" if rng.random() < 0.5 else None))
    return out


def median(prices):
    prices = sorted(prices)
    return prices[len(prices) // 2] if prices else None


def by_hand(known, anchor):
    """What one ledger sees, classified trade by trade."""
    known = [t for t in known if t[3] <= anchor]
    today = anchor.replace(hour=0, minute=0, second=0, microsecond=0)
    if not known:
        return "no trade at or before the ledger was read"
    if min(t[3] for t in known) > today - timedelta(days=1):
        return "the trades begin within the reference day, whose median would be partial"
    price = lambda t: Decimal(t[4]) / t[5] if t[4] > 0 else None
    state = {}
    for t in known:
        own = t[3] >= today
        peers = [u for u in known if (u[3] >= today) == own and u[10] is None and price(u) is not None]
        day = (today - timedelta(days=1)).date() if own else t[3].date()
        middle = median([price(u) for u in known if u[10] is None and price(u) is not None and u[3].date() == day])
        near = median([price(u) for u in peers if abs(u[3] - t[3]) <= timedelta(minutes=15)])
        p = price(t)
        if t[8] == t[9]:
            s = "excluded"
        elif t[7] < Decimal("0.01") or "I" in (t[8], t[9]):
            s = "excluded"
        elif t[10] and near is None:
            s = "unevaluated"
        elif t[10] and p is not None and p > near:
            s = "excluded"
        elif middle is not None and p is not None and (p * 2 > middle * 3 or p * 3 < middle * 2):
            s = "excluded"
        else:
            s = "genuine"
        state[t[1]] = s
    genuine = [t for t in known if state[t[1]] == "genuine"]
    inside = lambda rows, **w: [t for t in rows if t[3] > anchor - timedelta(**w)]
    total = sum(t[7] for t in known)
    last = max((t[3] for t in genuine), default=None)
    first = min(t[3] for t in known)
    return (
        *(sum((t[6] for t in inside(genuine, days=d)), Decimal(0)) for d in (1, 7, 30)), sum((t[7] for t in inside(genuine, minutes=15)), Decimal(0)), len(inside(known, minutes=15)),
        round(float(sum((t[7] for t in known if state[t[1]] == "excluded"), Decimal(0))) * 100 / float(total), 9) if total else None, last, int((anchor - last).total_seconds()) if last else None, (anchor - first).days,
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_supporting_at(spark, seed):
    rows = log(seed)
    rng = random.Random(seed)
    anchors = []
    for k in range(150):
        t = rng.choice(rows)
        at = rng.choice([t[3], t[3] + timedelta(minutes=rng.randrange(30)), START + timedelta(days=rng.randrange(14), minutes=rng.choice([0, 15, 10, 1439]))])
        anchors.append((t[0], k, at))
    anchors.append((9, 999, START))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    issuers = spark.createDataFrame([(p, "I") for p in (1, 2, 3)], "pair_id bigint, issuer string")
    a = spark.createDataFrame(anchors, "pair_id bigint, ledger_seq bigint, ledger_closed_at timestamp")
    supply = a.select("pair_id", "ledger_seq", F.when(F.col("ledger_seq") % 3 != 0, F.col("ledger_seq") - 1).cast("decimal(30,7)").alias("circulating_supply"))
    out = {r["ledger_seq"]: r for r in supporting.supporting_at(df, issuers, a, supply).collect()}
    assert len(out) == len(anchors)
    refused = set()
    for pair, ledger, at in anchors:
        want, got = by_hand([t for t in rows if t[0] == pair], at), out[ledger]
        if isinstance(want, str):
            refused.add(want)
            assert got["refused"] == want and got["genuine_base_30d"] is None and got["searched_days"] is None
            continue
        last = got["last_genuine_at"] and got["last_genuine_at"].astimezone(timezone.utc)
        pct = None if got["trades_excluded_pct"] is None else round(got["trades_excluded_pct"], 9)
        found = (got["genuine_base_1d"], got["genuine_base_7d"], got["genuine_base_30d"], got["oracle_genuine_volume"], got["oracle_trades"], pct, last, got["last_genuine_age_seconds"], got["searched_days"])
        assert found == want, (pair, ledger, at)
        assert got["volume_to_supply_1d"] is None and got["volume_to_supply_why"] == "volume not measured"  # no log reaches back 30 days
    assert len(refused) == 2


def test_supporting_ratios(spark):
    rows = [(1, k, k, START + timedelta(days=k), 100, 100, Decimal(2), Decimal(2), "a", "b", None) for k in range(50)]
    df, issuers = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, None)], "pair_id bigint, issuer string")
    a = spark.createDataFrame([(1, k, START + timedelta(days=40)) for k in (0, 1, 2)], "pair_id bigint, ledger_seq bigint, ledger_closed_at timestamp")
    supply = spark.createDataFrame([(1, 0, Decimal(10)), (1, 1, Decimal(0)), (1, 2, None)], "pair_id bigint, ledger_seq bigint, circulating_supply decimal(30,7)")
    out = {r["ledger_seq"]: r for r in supporting.supporting_at(df, issuers, a, supply).collect()}
    assert [out[0][f"volume_to_supply_{d}d"] for d in (1, 7, 30)] == [0.2, 1.4, 6.0] and out[0]["volume_to_supply_why"] is None
    assert out[1]["volume_to_supply_why"] == "supply is not positive" and out[2]["volume_to_supply_why"] == "supply not measured" and out[2]["volume_to_supply_1d"] is None


def test_book_price_near_fills_reads_each_price_about_once(spark):
    """The plan deals prices and fills to chunks of time; what meets the median is no product of the two."""
    rows = [(1, k, k, START + timedelta(seconds=k), 100 + k % 7, 100, Decimal(2), Decimal(2), "a", "b", "pool" if k % 2 else None) for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = trades.contemporaneous_price(df, DEFAULT)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan
    got = {r["trade_id"]: r["book_reference"] for r in out.collect()}
    assert len(got) == 3000
    for k in (1, 899, 901, 3001, 5999):
        assert got[k] == median([Decimal(t[4]) / 100 for t in rows if t[10] is None and abs(t[1] - k) <= 900])

"""Sums of changes up to a ledger and a price, against adding them up one by one."""

from __future__ import annotations

import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from fathomline.operators import running, series


def test_limbs_keep_wide_decimals():
    given = [Decimal("-1.00000000000001"), Decimal("99999999999999999999.5"), None, Decimal("-99999999999999999999.12345678901234")]
    c = pa.chunked_array([pa.array(given[:2], pa.decimal128(38, 14)), pa.array(given[2:], pa.decimal128(38, 14))])
    assert running.limbs_decimal(running.decimal_limbs(c), 14).to_pylist() == [x or 0 for x in given]
    limbs = running.decimal_limbs(c)
    (total,) = running.limbs_decimal(limbs.sum(axis=1, keepdims=True), 14).to_pylist()
    assert Fraction(total) == sum(Fraction(x or 0) for x in given)


def test_rank_sums():
    r = np.random.default_rng(1)
    for n in (1, 2, 8, 37):
        rank, values, upto, below = r.permutation(n), r.integers(-9, 9, (2, n)), r.integers(0, n + 1, 50), r.integers(0, n + 1, 50)
        want = [[v[:x][rank[:x] < y].sum() for x, y in zip(upto, below, strict=True)] for v in values]
        assert (running.rank_sums(rank, values, upto, below) == want).all()


@pytest.mark.parametrize(("size", "asked"), [(1 << 18, 1 << 20), (20, 7)])
def test_sums_below_in_one_slice_and_in_many(spark, size, asked):
    rng = random.Random(2)
    signed = lambda side, price: Decimal(price if side == "ask" else -price)
    changes = [(rng.randrange(2), s, rng.randrange(30), signed(s, rng.randrange(1, 60)), Decimal(rng.randrange(-50, 50))) for s in rng.choices(["bid", "ask"], k=400)]
    queries = [(rng.randrange(3), s, rng.randrange(40), signed(s, rng.randrange(1, 62)), rng.random() < 0.5, k) for k, s in enumerate(rng.choices(["bid", "ask"], k=300))]
    c = spark.createDataFrame(changes, "pair_id bigint, side string, ledger_seq bigint, at decimal(38,18), quote decimal(38,14)")
    q = spark.createDataFrame(queries, "pair_id bigint, side string, ledger_seq bigint, at decimal(38,18), strict boolean, rung int")
    got = {r["rung"]: r["quote"] for r in series.sums_below(c, q, size, asked).collect()}
    for pair, side, ledger, at, strict, k in queries:
        assert got.get(k, 0) == sum(x for p, s, t, y, x in changes if (p, s) == (pair, side) and t <= ledger and (y < at or (y == at and not strict)))


def test_amounts_at_the_best_prices_fall_away_unused(spark):
    """Their combination sorts every block of every interval, so a report without them must not pay for it."""
    ops = spark.createDataFrame([(1, 5 << 32, "set", 3, 0, "ask", Decimal(2), 3, 2)], "pair_id bigint, toid bigint, effect string, offer_id bigint, submitted_offer_id bigint, side string, amount decimal(19,7), price_n bigint, price_d bigint")
    fills = spark.createDataFrame([], "pair_id bigint, toid bigint, fill_index int, offer_id bigint, amount decimal(19,7)")
    rows = series.series_rows(series.replay.versions(series.replay.events(ops, fills)), spark.createDataFrame([(1, 7)], "pair_id bigint, ledger_seq bigint"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "minus" in plan(rows) and "minus" not in plan(rows.drop("best_bid_amount", "best_ask_amount"))
    assert rows.select("best_ask", "best_ask_amount").first() == (Decimal("1.5"), Decimal(2))

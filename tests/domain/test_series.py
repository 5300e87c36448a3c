"""Risk along a rebuilt series against the risk of each single book."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fathomline.operators import book, replay, risk, series
from fathomline.operators.book import KEY


def versions(spark, seed, n=300):
    rng = random.Random(seed)
    ops, fills = [], []
    for k in range(n):
        pair, offer, ledger = rng.randrange(1, 4), rng.randrange(1, 40), rng.choice([rng.randrange(60), rng.randrange(5000), 70])
        toid = (ledger << 32) + k
        if rng.random() < 0.2:
            fills.append((pair, toid, 0, offer * 3 + pair, Decimal(rng.randrange(1, 40)) / 10))
        elif rng.random() < 0.25:
            ops.append((pair, toid, "deleted", 0, offer * 3 + pair, "ask", Decimal(0), 1, 1))
        else:
            side = rng.choice(["bid", "ask"])
            n_, d_ = (rng.randrange(90, 130), 100) if side == "ask" else (100, rng.randrange(70, 101))
            if rng.random() < 0.1:
                n_, d_ = n_ * 2, d_ * 2  # the same price as another fraction
            ops.append((pair, toid, "set", offer * 3 + pair, 0, side, Decimal(rng.randrange(1, 900)), n_, d_))
    o = spark.createDataFrame(ops, "pair_id bigint, toid bigint, effect string, offer_id bigint, submitted_offer_id bigint, side string, amount decimal(19,7), price_n bigint, price_d bigint")
    t = spark.createDataFrame(fills, "pair_id bigint, toid bigint, fill_index int, offer_id bigint, amount decimal(19,7)")
    ledgers = [(p, rng.choice([rng.randrange(0, 80), rng.randrange(6000), 4_000_000_000])) for p in (1, 2, 3, 9) for _ in range(60)]
    return replay.versions(replay.events(o, t)), spark.createDataFrame(ledgers, "pair_id bigint, ledger_seq bigint")


COMPARED = ["price_source", "p0", "best_bid", "best_ask", "best_bid_amount", "best_ask_amount", "highest_ask", "bids", "asks", "bid_amount_total", "ask_amount_total", "crossed", "spread_pct", "divergence_pct", "depth", "manipulation", "max_reachable_price", "cost_to_max_reachable", "flags", "unevaluated_flags", "band", "band_confidence", "collateral", "oracle"]


@pytest.mark.parametrize("with_pools", [False, True])
def test_series_equals_single_books(spark, with_pools):
    found, targets = versions(spark, 5)
    points = targets.distinct()
    rows = [(1, k, f"p{k % 2}", Decimal(100), Decimal(95 + k % 30), 30) for k in range(0, 80, 3)] + [(9, 5, "q", Decimal(1), Decimal(2), 30)]
    pools = spark.createDataFrame(rows if with_pools else [], "pair_id bigint, ledger_seq bigint, pool_id string, reserve_base decimal(19,7), reserve_quote decimal(19,7), fee_bp int")
    levels = replay.book_from_offers(replay.resting_series(found, points))
    want = risk.asset_risk(points.withColumn("ledger_closed_at", F.lit(None).cast("timestamp")), levels, pools)
    got = series.series_rows(found, targets, pools if with_pools else None)
    shown = lambda df: {(r[0], r[1]): tuple(r)[2:] for r in df.select(*KEY, *COMPARED).collect()}
    want, got = shown(want.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("bids", "asks")})), shown(got)
    assert got.keys() == want.keys()
    for k in want:
        assert dict(zip(COMPARED, got[k], strict=True)) == dict(zip(COMPARED, want[k], strict=True)), k
    assert {x[0] for x in got.values()} >= ({"book", "pool", "none"} if with_pools else {"book", "none"})


def test_plan_has_no_join_of_versions_and_targets(spark):
    """All joins are on equal keys, and what is exploded is blocks, not ledgers."""
    found, targets = versions(spark, 6, 60)
    plan = series.series_rows(found, targets)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert len(joins) >= 4 and not any("Join Cross" in line or "Join Inner\n" in line for line in joins)
    assert all("size#" in line or "ledger_seq#" in line or "bucket#" in line for line in joins)


def test_blocks_cover_each_span_once(spark):
    rng = random.Random(1)
    spans = [(0, 1), (0, 1 << 32), (5, 5), (7, None)] + [(a, a + rng.randrange(0, 700)) for a in (rng.randrange(3000) for _ in range(60))]
    df = spark.createDataFrame(spans, "first bigint, until bigint")
    for r in df.select("*", series.blocks_of(F.col("first"), F.col("until")).alias("b")).collect():
        covered = sorted((x["block"] << x["size"], (x["block"] + 1) << x["size"]) for x in r["b"])
        end = 1 << 32 if r["until"] is None else r["until"]
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
        assert (covered[0][0], covered[-1][1]) == (r["first"], end) if r["first"] < end else covered == []
        assert len(covered) <= 64


def test_middle_of_tiny_prices(spark):
    row = spark.range(1).select(book.middle(F.lit("0.000000000000000003").cast("decimal(38,18)"), F.lit("0.000000000000000005").cast("decimal(38,18)")).alias("m"), book.middle(F.lit("9223372036854775807").cast("decimal(38,18)"), F.lit("9223372036854775805").cast("decimal(38,18)")).alias("w")).first()
    assert row["m"] == Decimal("0.000000000000000004") and row["w"] == 9223372036854775806

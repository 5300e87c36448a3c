"""Hand-computed golden snapshot, with and without its pool."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fathomline.operators import book, risk

LEDGER = 61340263


@pytest.fixture(scope="module")
def golden(spark):
    snapshots = spark.createDataFrame([("p", LEDGER)], "pair_id string, ledger_seq bigint").withColumn("ledger_closed_at", F.lit("2026-02-22 00:10:21").cast("timestamp")).withColumn("data_source", F.lit("offers-implied"))
    levels = spark.createDataFrame(
        [("p", LEDGER, "ask", 266843207, 2500000, D("1.2185312")), ("p", LEDGER, "bid", 1057, 1000, D("0.0001000"))],
        "pair_id string, ledger_seq bigint, side string, price_n bigint, price_d bigint, amount decimal(19,7)",
    )
    pools = spark.createDataFrame([("p", LEDGER, "x", D("15.4791416"), D("16.3389179"), 30)], "pair_id string, ledger_seq bigint, pool_id string, reserve_base decimal(19,7), reserve_quote decimal(19,7), fee_bp int")
    return snapshots, levels, pools


def near(a, b, tol=1e-7):
    assert abs(float(a) - float(b)) < tol, (a, b)


def test_book_only(golden):
    snapshots, levels, pools = golden
    r = risk.asset_risk(snapshots, levels, pools.where("false")).first()
    assert r["price_source"] == "book"
    near(r["p0"], 53.8971414)
    near(r["spread_pct"], 196.0777140585048)
    assert all(d["buy_side"] == 0 and d["sell_side"] == 0 for d in r["depth"])
    costs = {float(m["delta"]): (float(m["book_cost"]), m["book_reachable"]) for m in r["manipulation"]}
    assert costs[0.5] == (0.0, True)
    for x in (1.0, 10.0, 100.0):
        near(costs[x][0], 130.06270929502336)
        assert costs[x][1] is False
    near(r["max_reachable_price"], 106.7372828)
    assert r["cost_to_max_reachable"] == 0
    assert set(r["flags"]) == {"ZERO_DEPTH_2PCT", "MANIPULATION_CHEAP", "SPREAD_EXTREME", "THIN_DEPTH_5PCT"}
    assert len(r["unevaluated_flags"]) == 6
    assert (r["band"], r["band_confidence"]) == ("CRITICAL", "partial")


def test_with_pool(golden):
    r = risk.asset_risk(*golden).first()
    assert r["price_source"] == "pool"
    near(r["p0"], 1.0555441846982)
    near(r["divergence_pct"], 5006.0999796, 1e-6)
    for d, want in zip(r["depth"], (0.1630695103854, 0.4047049438672, 0.7998834132855), strict=True):
        near(d["buy_side"], want)
    for d, want in zip(r["depth"], (0.1637217547299, 0.4124695092746, 0.8359440019113), strict=True):
        near(d["sell_side"], want + 0.0001057)
    assert all(m["book_cost"] == 0 and m["book_reachable"] for m in r["manipulation"])
    for m, want in zip(r["manipulation"], (3.6831374143563, 6.7881658863395, 37.9650373668206, 148.3101050939877), strict=True):
        near(m["combined_cost"], want)
    assert r["max_reachable_price"] is None and r["cost_to_max_reachable"] is None


def test_nothing_still_gives_a_row(golden):
    snapshots, levels, pools = golden
    r = risk.asset_risk(snapshots, levels.where("false"), pools.where("false")).first()
    assert r["price_source"] == "none" and r["p0"] is None and r["depth"] is None
    assert r["flags"] == ["NO_EXECUTABLE_PRICE"] and r["band"] == "CRITICAL"
    states = {s["flag"]: s["state"] for s in r["flag_states"]}
    assert states["PRICE_SOURCE_CONFLICT"] == "clear" and states["ZERO_DEPTH_2PCT"] == "unevaluated"


def test_invariants(golden):
    snapshots, levels, pools = golden
    priced = book.reference_price(snapshots, levels, pools)
    rows = book.manipulation_ladder(priced, levels, pools).orderBy("delta").collect()
    assert all(m["book_cost"] <= m["combined_cost"] for m in rows)
    assert all(a["combined_cost"] <= b["combined_cost"] for a, b in zip(rows, rows[1:], strict=False))


def test_small_prices_and_large_fractions(spark, golden):
    """Prices of 1e-9 keep their digits, and no BIGINT fraction stops the other pairs."""
    snapshots = spark.createDataFrame([(p, 1) for p in "abc"], "pair_id string, ledger_seq bigint").withColumn("ledger_closed_at", F.lit("2026-02-22 00:10:21").cast("timestamp")).withColumn("data_source", F.lit("horizon"))
    rows = [("a", 1, "bid", 100, 100_000_000_000, D(5)), ("a", 1, "ask", 116, 100_000_000_000, D(7)), ("a", 1, "ask", 120, 100_000_000_000, D(7)), ("b", 1, "bid", 2, 1, D(1)), ("b", 1, "ask", 3, 1, D(1)), ("c", 1, "ask", 2**63 - 1, 2**62, D(3)), ("c", 1, "bid", 2**62, 2**63 - 1, D(2))]
    levels = spark.createDataFrame(rows, "pair_id string, ledger_seq bigint, side string, price_n bigint, price_d bigint, amount decimal(19,7)")
    priced = book.reference_price(snapshots, levels, golden[2].where("false"))
    got = {r["pair_id"]: r for r in priced.collect()}
    near(got["a"]["spread_pct"], 16 / 1.08, 1e-6)
    near(got["b"]["spread_pct"], 40)
    rungs = {(r["pair_id"], float(r["delta"])): r for r in book.depth_ladder(priced, levels, golden[2].where("false")).collect()}
    near(rungs["a", 0.1]["buy_side"], 7 * 1.16e-9, 1e-13)  # 1.188e-9 reaches 1.16e-9, not 1.20e-9
    near(rungs["b", 0.1]["buy_side"], 0)
    costs = {(r["pair_id"], float(r["delta"])): r for r in book.manipulation_ladder(priced, levels, golden[2].where("false")).collect()}
    near(costs["c", 10.0]["book_cost"], 6, 1e-6)

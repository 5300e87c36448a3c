"""Recorded bodies, idempotent sinks and streams."""

import gzip
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fathomline.operators import accounts
from fathomline.sources import scans, sinks
from fathomline.streaming import jobs

G = "G" + "A" * 55
BOOK = {"bids": [{"price_r": {"n": 2, "d": 1}, "price": "2", "amount": "10.0"}], "asks": [{"price_r": {"n": "5", "d": "2"}, "price": "2.5", "amount": "3"}], "base": {"asset_type": "credit_alphanum4", "asset_code": "ABC", "asset_issuer": G}, "counter": {"asset_type": "native"}}


def test_order_book(spark):
    rows = [(1, 9, f"ABC:{G}", "XLM", json.dumps(BOOK)), (2, 9, "XLM", "XLM", json.dumps(BOOK)), (3, 9, "XLM", "XLM", "not json"), (4, 9, f"ABC:{G}", "XLM", json.dumps(BOOK | {"bids": [], "asks": []}))]
    got = scans.order_books(spark.createDataFrame(rows, "pair_id int, ledger_seq int, base string, quote string, body string")).orderBy("pair_id", "side").collect()
    assert [(r["pair_id"], r["side"], r["amount"], r["error"]) for r in got] == [
        (1, "ask", D("3.0000000"), None), (1, "bid", D("5.0000000"), None), (2, None, None, "the body is of another pair"), (3, None, None, "unreadable order book"), (4, None, None, None),
    ]


def test_pools_and_trades(spark):
    page = {"_embedded": {"records": [{"id": "p", "fee_bp": 30, "reserves": [{"asset": "native", "amount": "4"}, {"asset": f"ABC:{G}", "amount": "2"}]}, {"id": "q", "fee_bp": 30, "reserves": [{"asset": "native", "amount": "4"}]}]}}
    got = scans.pools(spark.createDataFrame([(1, 9, f"ABC:{G}", "XLM", json.dumps(page))], "pair_id int, ledger_seq int, base string, quote string, body string")).orderBy("pool_id").collect()
    assert (got[0]["reserve_base"], got[0]["reserve_quote"], got[0]["error"]) == (D("2.0000000"), D("4.0000000"), None) and got[1]["error"] == "a reserve is missing"
    trade = {"id": "1-0", "paging_token": f"{5 << 32}-2", "ledger_close_time": "2026-02-01T00:00:00Z", "base_asset_type": "credit_alphanum4", "base_asset_code": "ABC", "base_asset_issuer": G, "counter_asset_type": "native", "base_amount": "1", "counter_amount": "2", "price": {"n": "2", "d": 1}, "counter_liquidity_pool_id": "x"}
    r = scans.trades(spark.createDataFrame([(1, f"ABC:{G}", "XLM", json.dumps(trade))], "pair_id int, base string, quote string, body string")).first()
    assert (r["ledger_seq"], r["fill_index"], r["price_n"], r["pool_id"], r["pool_side"], r["error"]) == (5, 2, 2, "x", "counter", None)


def test_recordings(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    record = {"pair": "a", "recorded_at": "x", "ledger_before": 5, "ledger_after": 5, "sources": [{"endpoint": "order_book", "http_status": 200, "body": "{}", "body_sha256": "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"}]}
    with gzip.open(tmp_path / "deep" / "one.json.gz", "wt") as f:
        json.dump(record, f)
    r = scans.recordings(spark, str(tmp_path)).first()
    assert (r["schema_version"], r["degraded"], r["consistent"], r["hashes_agree"]) == (1, False, True, True)
    assert scans.bodies_of(scans.recordings(spark, str(tmp_path)), "order_book").count() == 1


def test_idempotent_insert(spark, tmp_path):
    row = [(1, 5, "v", "horizon", "none", None, None, "LOW")]
    df = spark.createDataFrame(row, "pair_id int, ledger_seq int, methodology_version string, data_source string, price_source string, p0 decimal(38,18), depth array<int>, band string")
    for _ in range(2):
        sinks.save_metrics(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    with pytest.raises(ValueError):
        sinks.save_metrics(df.withColumn("p0", F.lit(1).cast("decimal(38,18)")), str(tmp_path / "m"))


def test_streams(spark, tmp_path):
    rows = [(1, k // 2, f"2026-01-0{1 + k % 3} 00:0{k % 10}:00", D(k), D(k)) for k in range(12)]
    df = spark.createDataFrame(rows, "pair_id bigint, trade_id int, closed_at string, base_amount decimal(19,7), counter_amount decimal(19,7)").withColumn("closed_at", F.col("closed_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))
    jobs.append_to(jobs.distinct_trades(stream), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 6
    q = jobs.daily_volumes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "t"))).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {str(r["day"]): r["trades"] for r in spark.table("daily").collect()} == {"2026-01-01": 4, "2026-01-02": 4, "2026-01-03": 4}


def test_stateful_absences_are_the_batch_ones(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = ["post", "delete", "delete", "post", "post", "delete", "post", "delete"]
    rows = [(a, 0, k, f"2026-01-01 00:{k:02d}:0{a}", kind) for a in (1, 2) for k, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, "account_id bigint, pair_id bigint, tx bigint, at string, kind string").withColumn("at", F.col("at").cast("timestamp"))
    want = {(r["account_id"], r["open_at"], r["close_at"]) for r in accounts.absence_windows(df).where("close_at is not null").collect()}
    df.write.parquet(str(tmp_path / "e"))
    pytest.importorskip("google.protobuf")
    q = jobs.absences(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("absent").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["account_id"], r["open_at"], r["close_at"]) for r in spark.table("absent").collect()} == want and len(want) == 4

"""Recordings of both schemas, strict list files, and sinks that commit."""

from __future__ import annotations

import gzip
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fathomline.operators import compare, replay, store
from fathomline.sources import scans, sinks

G = "G" + "A" * 55
ASSET = {"code": "ABC", "issuer": G, "type": "credit_alphanum4"}
NATIVE = {"type": "native"}


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, indent=2))


def test_archive_of_both_schemas(spark, tmp_path):
    book = {"bids": [], "asks": [{"price_r": {"n": 2, "d": 1}, "price": "2.0000000", "amount": "10.0000000"}], "base": {"asset_type": "native"}, "counter": {"asset_type": "native"}}
    put(tmp_path / "a" / "tick.json.gz", {"schema_version": 2, "pair": "x/y", "recorded_at": "2026-02-01T00:00:00Z", "ledger_before": 7, "ledger_after": 8, "sources": [{"endpoint": "order_book", "http_status": 200, "body": json.dumps(book)}, {"endpoint": "liquidity_pools", "http_status": 500, "body": None}]})
    put(tmp_path / "b" / "old.json.gz", {"requested_base": "XLM", "requested_quote": "ABC", "fetched_at": "2026-01-01T00:00:00Z", "book_latest_ledger": 5, "pool_latest_ledger": 5, "atomic": True, "order_book": book, "liquidity_pools": {"_embedded": {"records": []}}, "ledger": {"sequence": 5}})
    put(tmp_path / "b" / "holders.json.gz", {"requested_asset": "ABC", "fetched_at": "2026-01-01T00:00:00Z", "first_page_latest_ledger": 5, "last_page_latest_ledger": 6, "truncated": True, "asset_summary": {"x": 1}, "account_pages": [{"p": 1}, {"p": 2}]})
    put(tmp_path / "c" / "broken.json.gz", "{not json")
    put(tmp_path / "c" / "other.json.gz", {"schema_version": 1, "a": 1})
    got = {r["path"].rsplit("/", 1)[1]: r for r in scans.archive(spark, str(tmp_path)).collect()}
    kinds = {k: (r["kind"], r["schema_version"], r["subject"], r["ledger_before"], r["consistent"], r["truncated"], r["error"]) for k, r in got.items()}
    assert kinds == {
        "tick.json.gz": ("tick", 2, "x/y", 7, False, False, None), "old.json.gz": ("snapshot", 1, "XLM/ABC", 5, True, False, None), "holders.json.gz": ("holders", 1, "ABC", 5, False, True, None),
        "broken.json.gz": (None, 1, None, None, False, False, "not a recording"), "other.json.gz": (None, 1, None, None, False, False, "not a recording"),
    }
    assert [b["endpoint"] for b in got["old.json.gz"]["bodies"]] == ["order_book", "liquidity_pools", "ledger"] and [b["endpoint"] for b in got["tick.json.gz"]["bodies"]] == ["order_book"]
    books = scans.archived_bodies(scans.archive(spark, str(tmp_path)), "order_book").collect()
    assert sorted(r["kind"] for r in books) == ["snapshot", "tick"] and all(json.loads(r["body"]) == book for r in books)
    pages = scans.archived_bodies(scans.archive(spark, str(tmp_path)), "account_page")
    assert sorted(json.loads(r["body"])["p"] for r in pages.collect()) == [1, 2]


def test_pair_list_is_strict(spark, tmp_path):
    def errors(value):
        f = tmp_path / "pairs.json"
        f.write_text(value if isinstance(value, str) else json.dumps(value))
        return [r["error"] for r in scans.pair_list(spark, str(f)).orderBy("place").collect()]

    pair = {"base": ASSET, "quote": NATIVE, "note": "why"}
    assert errors({"note": "n", "pairs": [pair, {"base": NATIVE, "quote": ASSET}]}) == [None, None]
    assert errors({"pairs": [pair, pair]}) == [None, "listed before"]
    assert errors({"pairs": [pair], "extra": 1, "more": 2}) == ["unknown field of the list: extra, more"]
    assert errors({"pairs": [pair | {"weight": 1}]}) == ["unknown field of the pair: weight"]
    assert errors({"pairs": [{"base": ASSET | {"home": 1}, "quote": NATIVE}]}) == ["unknown field of the base: home"]
    assert errors({"pairs": [{"base": ASSET, "quote": ASSET}, {"base": ASSET}]}) == ["the same asset on both sides", "the quote is missing"]
    assert errors({"pairs": [{"base": ASSET | {"issuer": "GX"}, "quote": NATIVE}]}) == ["the base's issuer is malformed"]
    assert errors({"pairs": [{"base": {"code": "ABC", "issuer": G}, "quote": NATIVE}]})[0].startswith("the base's type is none of")
    assert errors({"pairs": [{"base": NATIVE | {"code": "X"}, "quote": ASSET}, {"base": {"type": "credit_alphanum4", "code": "A"}, "quote": NATIVE}]}) == ["the base is native and carries a code or an issuer", "the base needs a code and an issuer"]
    assert errors({"pairs": []}) == ["the list holds no pairs"] and errors("[1") == ["unreadable pair list"]


def test_pool_evidence_is_proved(spark, tmp_path):
    entry = lambda ledger, pools, **more: {"Base": {"Code": "ABC", "Issuer": G}, "Quote": {"Code": "", "Issuer": ""}, "LedgerSeq": ledger, "LedgerClosedAt": "2026-01-01T00:00:00Z", "Source": "offers-implied", "Pools": pools} | more
    pool = lambda c, **more: {"PoolID": c * 64, "ReserveBase": "1", "ReserveQuote": "2", "FeeBP": 30} | more
    entries = [entry(1, [pool("a"), pool("b")]), entry(2, []), entry(3, None), entry(4, [pool("a")]), entry(4, [pool("a")]), entry(5, [pool("a"), pool("A")]), entry(6, [pool("a", FeeBP=10000)]), entry(7, [pool("a", ReserveBase="-1")]), entry(8, [pool("a")], Source="horizon")]
    (tmp_path / "e.json").write_text(json.dumps(entries))
    wanted = spark.createDataFrame([(f"ABC:{G}", "XLM", k) for k in range(1, 10)], "base string, quote string, ledger_seq bigint")
    got = {r["ledger_seq"]: (r["pools"], r["error"]) for r in scans.pool_evidence_at(scans.pool_evidence(spark, str(tmp_path / "e.json")), wanted).collect()}
    assert got == {
        1: (2, None), 2: (0, None), 3: (None, "pools are unknown"), 4: (None, "several entries for the pair and ledger"), 5: (None, "a pool is named twice"), 6: (None, "fee out of range"),
        7: (None, "a reserve is missing or negative"), 8: (None, "not of the offers-implied source, or without a close time"), 9: (None, "no pool evidence for the pair and ledger"),
    }


def test_levels_of_any_fraction_fail_no_scan(spark):
    level = lambda n, d, amount: {"price_r": {"n": n, "d": d}, "price": "x", "amount": amount}
    top = (1 << 63) - 1
    book = {"bids": [level(1, 2_000_000_000_000, "0.0000001"), level(1, top, "5"), level(0, 5, "1"), level(7, 0, "1"), level("x", 1, "1"), level(2, -3, "1")], "asks": [level(top, 1, "1"), level(1, top, "2")], "base": {"asset_type": "native"}, "counter": {"asset_type": "credit_alphanum4", "asset_code": "ABC", "asset_issuer": G}}
    df = spark.createDataFrame([(1, 9, "XLM", f"ABC:{G}", json.dumps(book))], "pair_id int, ledger_seq int, base string, quote string, body string")
    got = {(r["side"], r["price_n"], r["price_d"]): (r["amount"], r["error"]) for r in scans.order_books(df).collect()}
    assert got[("bid", 1, 2_000_000_000_000)] == (D("200000.0000000"), None)
    assert got[("bid", 1, top)] == (None, "malformed level")  # more of the base than an amount holds
    assert got[("ask", top, 1)] == (D("1.0000000"), None) and got[("ask", 1, top)] == (D("2.0000000"), None)
    assert sum(e == "malformed level" for _, e in got.values()) == 5


METRIC = "pair_id int, ledger_seq int, methodology_version string, data_source string, price_source string, p0 decimal(38,18), band string, ledger_closed_at timestamp"


def metrics(spark, ledgers, source="none"):
    return spark.createDataFrame([(1, k, "v", "horizon", source, None, "LOW", None) for k in ledgers], METRIC).withColumn("ledger_closed_at", F.timestamp_seconds(F.col("ledger_seq")))


def test_commits_are_whole(spark, tmp_path):
    path = str(tmp_path / "m")
    assert sinks.save_metrics(metrics(spark, [1, 2, 2]), path) == {"rows": 2, "first": "1970-01-01 00:00:01", "last": "1970-01-01 00:00:02"}
    assert sinks.save_metrics(metrics(spark, [2, 1]), path)["rows"] == 0  # a rerun appends nothing
    with pytest.raises(sinks.Contradiction, match="a source but no price"):
        sinks.save_metrics(metrics(spark, [5, 6], "book"), path)
    assert sorted(r["ledger_seq"] for r in spark.read.parquet(path).collect()) == [1, 2]
    assert len(list((tmp_path / "m" / "_commits").glob("*.json"))) == 1


def test_lost_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    sinks.save_metrics(metrics(spark, [1]), path)
    with monkeypatch.context() as m:  # lost before the commit: nothing is seen, ever
        m.setattr(sinks._Folder, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            sinks.save_metrics(metrics(spark, [2]), path)
    assert [r["ledger_seq"] for r in spark.read.parquet(path).collect()] == [1]
    with monkeypatch.context() as m:  # lost between commit and move: the next writer completes it
        m.setattr(sinks._Folder, "complete", lambda _: None)
        sinks.save_metrics(metrics(spark, [3]), path)
    assert sorted(r["ledger_seq"] for r in spark.read.parquet(path).collect()) == [1]
    sinks.save_metrics(metrics(spark, [3, 4]), path)
    assert sorted(r["ledger_seq"] for r in spark.read.parquet(path).collect()) == [1, 3, 4]


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that finds its commit taken leaves out what the other stored."""
    path, commit, other = str(tmp_path / "m"), sinks._Folder.commit, []

    def late(self, n, what):
        if not other:
            other.append(n)
            sinks.save_metrics(metrics(spark, [2, 9]), path)
        return commit(self, n, what)

    monkeypatch.setattr(sinks._Folder, "commit", late)
    assert sinks.save_metrics(metrics(spark, [1, 2]), path)["rows"] == 1
    assert sorted(r["ledger_seq"] for r in spark.read.parquet(path).collect()) == [1, 2, 9]


def test_reading_rules(spark, tmp_path):
    holder = spark.createDataFrame([("A", "G", 5, "v", False, D(10), 1, 9, 60.0, 80.0, "b", "l"), ("B", "G", 5, "v", True, D(1), 1, 9, 1.0, 2.0, "b", "l"), ("C", "G", 50, "v", False, D(1), 1, 9, 1.0, 2.0, "b", "l"), ("D", "G", 5, "v", False, D(1), 1, 9, 5.0, 2.0, "b", "l"), ("E", "G", 5, "v", False, D(1), 1, 9, 5.0, 6.0, "b", " ")],
        "code string, issuer string, snapshot_ledger int, methodology_version string, truncated boolean, circulating_supply decimal(30,7), ledger_min int, ledger_max int, top1_pct double, top10_pct double, basis string, label string")
    assert {r["code"]: r["violation"] for r in store.reading_violations(holder).collect()} == {"B": "truncated with figures", "C": "a ledger outside its span", "D": "ten holders with less than one", "E": "a basis without a label"}
    with pytest.raises(sinks.Contradiction):
        sinks.save_holder_reading(holder, str(tmp_path / "h"))
    assert sinks.save_holder_reading(holder.where("code = 'A'"), str(tmp_path / "h"))["rows"] == 1
    trade = spark.createDataFrame([(1, 30, "full", D(5), 10.0), (1, 90, "full", D(7), 10.0)], "pair_id int, searched_days int, scope string, genuine_base_30d decimal(30,7), trades_excluded_pct double").withColumn("anchor", F.lit("2026-01-01").cast("timestamp"))
    assert sinks.save_trade_reading(trade, str(tmp_path / "t"))["rows"] == 2 and sinks.save_trade_reading(trade, str(tmp_path / "t"))["rows"] == 0
    with pytest.raises(sinks.Contradiction, match="volumes without the full scope"):
        sinks.save_trade_reading(trade.withColumn("scope", F.lit("last_genuine_only")), str(tmp_path / "t"))


def test_rewound_book(spark):
    live = spark.createDataFrame([(1, 10, "ask", D(5), 2, 1, 100), (1, 11, "bid", D(8), 1, 2, 200), (1, 12, "ask", D(1), 2, 1, 300), (2, 20, "ask", D(1), 3, 1, 100)], "pair_id bigint, offer_id bigint, side string, amount decimal(19,7), price_n bigint, price_d bigint, last_modified_ledger bigint")
    traded = spark.createDataFrame([(1, 150, 90), (1, 250, 90), (1, 120, 91), (1, 400, 10), (1, 260, 1 << 62), (1, 260, 0)], "pair_id bigint, ledger_seq bigint, offer_id bigint")
    targets = spark.createDataFrame([(1, 50), (1, 120), (1, 200), (1, 250), (1, 300), (2, 100), (3, 9)], "pair_id bigint, ledger_seq bigint")
    got = {(r["pair_id"], r["ledger_seq"]): tuple(r)[2:] for r in replay.rewound_points(live, traded, targets).collect()}
    assert got == {(1, 50): (0, 3, 2, False), (1, 120): (1, 2, 2, False), (1, 200): (2, 1, 1, False), (1, 250): (2, 1, 1, False), (1, 300): (3, 0, 0, True), (2, 100): (1, 0, 0, True), (3, 9): (0, 0, 0, True)}
    book = {(r["ledger_seq"], r["side"]): r["amount"] for r in replay.rewound_books(live, targets).where("pair_id = 1").collect()}
    assert book == {(120, "ask"): D("5.0000000"), (200, "ask"): D("5.0000000"), (200, "bid"): D("4.0000000"), (250, "ask"): D("5.0000000"), (250, "bid"): D("4.0000000"), (300, "ask"): D("6.0000000"), (300, "bid"): D("4.0000000")}


def test_capped_recording(spark):
    rows = lambda n: [(1, 5, "ask", 100 + k, 100, D(1)) for k in range(n)] + [(1, 5, "bid", 90, 100, D(1))]
    schema = "pair_id bigint, ledger_seq bigint, side string, price_n bigint, price_d bigint, amount decimal(19,7)"
    snapshots = spark.createDataFrame([(1, 5)], "pair_id bigint, ledger_seq bigint").withColumn("ledger_closed_at", F.lit(None).cast("timestamp"))
    capped = compare.crosscheck_with_risk(spark.createDataFrame(rows(200), schema), spark.createDataFrame(rows(230), schema), snapshots).first()
    assert capped["levels_match"] and capped["risk_match"] and capped["explanation"].startswith("a recorded side is at the page limit")
    short = compare.crosscheck_with_risk(spark.createDataFrame(rows(3), schema), spark.createDataFrame(rows(2), schema), snapshots).first()
    assert not short["levels_match"] and short["explanation"] == "ask 3 missing from the rebuilt book" and short["risk_match"] is False and short["risk_differs_at"] == "depth 0.1 buy_side"


def test_trade_log_reads_its_range(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(40_000).select((F.col("id") % 4).alias("pair_id"), F.col("id").alias("trade_id"), (F.col("id") * 50).alias("ledger_seq"), F.lit(1).alias("amount"))
    sinks.trade_log(rows, path)
    files = len(list((tmp_path / "log").glob("span=*/*.parquet")))
    got = scans.trade_log(spark, path, 500_000, 510_000, pair=2)
    assert sorted(r["trade_id"] for r in got.collect()) == [k for k in range(10_000, 10_201) if k % 4 == 2]
    plan = got._jdf.queryExecution().executedPlan()
    scan = [s for s in _nodes(plan) if s.nodeName().startswith("Scan parquet")][0]
    assert scan.metrics().apply("numFiles").value() <= 4 < 12 <= files
    assert "GreaterThanOrEqual(ledger_seq,500000)" in plan.toString()
    ends = {r["pair_id"]: r["complete"] for r in scans.trade_log_coverage(spark, path, 100, 1_999_850).collect()}
    assert ends == {0: False, 1: True, 2: True, 3: False}


def _nodes(plan):
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    out, children = [plan], plan.children()
    for k in range(children.size()):
        out += _nodes(children.apply(k))
    return out

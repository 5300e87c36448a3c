"""Domain tables as views of the benchmark tables, so that every operator runs on data that grows.

Each view is a deterministic expression over one or two tables; integers and decimals only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER = 1000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level a line item of a part: 'F' bids, 'O' asks, priced off the part's retail price by the discount in percent."""
    l = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", "l_discount", "l_quantity")  # noqa: E741
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    bid = F.col("l_linestatus") == "F"
    off = F.round(F.col("l_discount") * 100).cast("bigint")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    kept = (bid & (F.col("l_partkey") % 7 != 0)) | (~bid & (F.col("l_partkey") % 11 != 0))
    return l.join(p, l["l_partkey"] == p["p_partkey"]).where(kept).select(
        F.col("l_partkey").alias("pair_id"), F.lit(LEDGER).cast("bigint").alias("ledger_seq"), F.when(bid, "bid").otherwise("ask").alias("side"),
        (cents * F.when(bid, 100 - off).otherwise(100 + off)).alias("price_n"), F.lit(10000).cast("bigint").alias("price_d"), F.col("l_quantity").cast("decimal(19,7)").alias("amount"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_id"), F.lit(LEDGER).cast("bigint").alias("ledger_seq"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("ledger_closed_at"), F.lit("horizon").alias("data_source"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pool a part (a second where the key is a multiple of 3), up to 12 % off the retail price; some empty, some missing."""
    k = F.col("p_partkey")
    p = _read(spark, sf_dir, "part").where(k % 13 != 0).select(k, F.col("p_size").cast("bigint").alias("size"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"))
    n = F.explode(F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("i")
    base = F.when(k % 17 == 0, 0).otherwise(F.col("size") * 10)
    quote = (base * F.col("cents") * (100 + (k % 5 - 2) * 6)).cast("decimal(19,0)") / F.lit(10000).cast("decimal(5,0)")
    return p.select(k, "size", "cents", n).select(
        k.alias("pair_id"), F.lit(LEDGER).cast("bigint").alias("ledger_seq"), F.concat_ws("-", F.lit("pool"), k.cast("string"), F.col("i").cast("string")).alias("pool_id"),
        base.cast("decimal(19,7)").alias("reserve_base"), quote.cast("decimal(19,7)").alias("reserve_quote"), F.when(F.col("i") == 0, 30).otherwise(100).alias("fee_bp"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events make one operation, closed at the first one's time; 'error' events are pool fills."""
    e = _read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    op = F.floor(F.col("event_id") / 3)
    n = F.round(F.col("value") * 100).cast("bigint")
    pool = F.col("event_type") == "error"
    return e.where("event_id IS NOT NULL").withColumn("op", op).withColumn("closed_at", F.min("ts").over(Window.partitionBy("op"))).select(
        (F.col("user_id") % 10).alias("pair_id"), F.col("event_id").alias("trade_id"), F.col("op").cast("string").alias("operation_id"), (F.col("event_id") % 3).cast("int").alias("fill_index"),
        (F.floor(F.unix_seconds("closed_at") / 5)).alias("ledger_seq"), "closed_at", n.alias("price_n"), F.lit(100).cast("bigint").alias("price_d"),
        F.col("k").cast("decimal(19,7)").alias("base_amount"), (F.col("k").cast("decimal(10,0)") * n.cast("decimal(12,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(19,7)").alias("counter_amount"),
        F.col("event_type").isin("click", "purchase").alias("base_is_seller"), F.col("user_id").cast("string").alias("base_account"), ((F.col("event_id") * 7) % 150).cast("string").alias("counter_account"),
        F.when(pool, F.concat(F.lit("pool-"), (F.col("user_id") % 10).cast("string"))).alias("pool_id"),
    )


def supporting_anchors(trades: DataFrame) -> DataFrame:
    """Ledgers that ask for trade figures: the last trade of every pair in each six hours, and one a week after the log."""
    last = trades.groupBy("pair_id", F.floor(F.unix_seconds("closed_at") / 21600)).agg(F.max("closed_at").alias("ledger_closed_at")).select("pair_id", "ledger_closed_at")
    after = trades.select("pair_id").distinct().withColumn("ledger_closed_at", F.lit("2024-02-05 12:00:00").cast("timestamp"))
    return last.union(after).select("pair_id", F.floor(F.unix_seconds("ledger_closed_at") / 5).alias("ledger_seq"), "ledger_closed_at")


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account p issues the base asset of pair p."""
    return _read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("pair_id")).distinct().withColumn("issuer", F.col("pair_id").cast("string"))


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint") * F.when(k % 50 == 1, 500).otherwise(1)
    return _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("asset_id"), k.alias("account_id"), (cents.cast("decimal(19,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(19,7)").alias("balance"))


def holder_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issuer (smallest account) of each asset, and accounts whose number is a multiple of 97."""
    h = holders(spark, sf_dir).select("asset_id", "account_id")
    return h.groupBy("asset_id").agg(F.min("account_id").alias("account_id")).union(h.where(F.col("account_id") % 97 == 0)).distinct()


def offer_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets ('A') and deletes ('N') of the offer numbered by the order, at the ledger of the ship date; the order's number gives the pair."""
    l = _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "R")  # noqa: E741
    deleted = F.col("l_returnflag") == "N"
    return l.select(
        (F.col("l_orderkey") % 50).alias("pair_id"), _toid().alias("toid"), F.when(deleted, "deleted").otherwise("set").alias("effect"), F.when(deleted, 0).otherwise(F.col("l_orderkey")).alias("offer_id"),
        F.when(deleted, F.col("l_orderkey")).otherwise(0).alias("submitted_offer_id"), F.when(F.col("l_linestatus") == "F", "bid").otherwise("ask").alias("side"), F.col("l_quantity").cast("decimal(19,7)").alias("amount"),
        (F.col("l_suppkey") + 1).alias("price_n"), (F.round(F.col("l_discount") * 100).cast("bigint") + 1).alias("price_d"),
    )


def offer_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _read(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")  # noqa: E741
    return l.select((F.col("l_orderkey") % 50).alias("pair_id"), _toid().alias("toid"), (F.col("l_partkey") % 1000).cast("int").alias("fill_index"), F.col("l_orderkey").alias("offer_id"), (F.col("l_quantity") / 10).cast("decimal(19,7)").alias("amount"))


def _toid():
    """Ledger: days since 1995; operation part: line and supplier, so that ties are rare and total."""
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.to_date(F.lit("1995-01-01"))).cast("bigint")
    return F.shiftleft(days, 32) + F.col("l_linenumber").cast("bigint") * 1_000_000 + F.col("l_suppkey")


def maker_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("account_id"), (F.col("user_id") % 10).alias("pair_id"), F.floor(F.col("event_id") / 2).alias("tx"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type").isin("error", "view"), 0).otherwise(F.get_json_object("props", "$.k").cast("bigint") + 1).alias("amount"),
    )


def account_first_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(k.cast("string").alias("account_id"), k.alias("toid"), F.when(k % 4 == 0, "payment").otherwise("create_account").alias("type"), F.col("c_nationkey").cast("string").alias("source"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    days = F.date_diff(at.cast("date"), F.to_date(F.lit("1995-01-01"))).cast("bigint")
    bands = F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "LOW"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("pair_id"), (days * 1_000_000 + F.col("o_orderkey")).alias("ledger_seq"), at.alias("ledger_closed_at"),
        F.when(F.col("o_orderstatus") == "F", "offers-implied").otherwise("horizon").alias("data_source"), F.lit("1.0.8-draft").alias("methodology_version"), bands.alias("band"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price_cents"),
    )

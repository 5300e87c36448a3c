"""Further registered queries with their DuckDB SQL: scalar rules, readings, replay counts, store reads, asset lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.operators import accounts, book, bounds, compare, holders, replay, store, trades, universe
from fathomline.plans import adapters as A
from fathomline.plans.registry import _A, BOUNDS, CLASSIFIED, HOLDERS, LEVELS, MAKERS, METRICS, TRADES, _classified, _kept, anchor, big, query
from fathomline.scratch import written

DAYS = "(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)))::BIGINT"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(c: str):
    return F.date_diff(F.col(c).cast("date"), F.to_date(F.lit("1995-01-01"))).cast("bigint")


# scalar rules -------------------------------------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, ({DAYS} << 32) | (CAST(l_linenumber AS BIGINT) << 12) | (l_suppkey % 4096) AS id FROM lineitem)
SELECT l_orderkey, l_linenumber, id, id >> 32 AS ledger, id & 4095 AS op, l_suppkey % 3 = 0 AS synthetic, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE CAST(id AS VARCHAR) END AS operation_id,
  CAST(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_linenumber END AS INTEGER) AS fill_index FROM x""")
def scalar_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation ids, their parts, synthetic offers and paging tokens, every fifth malformed."""
    l = _table(spark, sf_dir, "lineitem")  # noqa: E741
    id_ = X.toid(_days("l_shipdate"), F.col("l_linenumber"), F.col("l_suppkey") % 4096)
    offer = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_orderkey").bitwiseOR(F.lit(1 << X.SYNTHETIC_BIT))).otherwise(F.col("l_orderkey"))
    token = F.concat_ws("-", "id", F.when(F.col("l_suppkey") % 5 == 0, F.lit("x")).otherwise(F.col("l_linenumber").cast("string")))
    out = l.select("l_orderkey", "l_linenumber", id_.alias("id"), offer.alias("offer"), "l_suppkey").withColumn("token", X.paging_token(token))
    return out.select("l_orderkey", "l_linenumber", "id", X.toid_ledger(F.col("id")).alias("ledger"), X.toid_operation(F.col("id")).alias("op"), X.synthetic_offer(F.col("offer")).alias("synthetic"), "token.operation_id", "token.fill_index")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey - 3 AS n, l_partkey % 7 AS d, l_partkey % 2 = 0 AS same FROM lineitem)
SELECT l_orderkey, l_linenumber, n > 0 AND d <> 0 AS valid, CASE WHEN n > 0 AND d <> 0 THEN n || '/' || d END AS parsed, CASE WHEN same THEN n ELSE d END AS oriented_n, CASE WHEN same THEN d ELSE n END AS oriented_d,
  CASE WHEN n * 5 < 3 * (d + 1) THEN -1 WHEN n * 5 > 3 * (d + 1) THEN 1 ELSE 0 END AS compared FROM x""")
def scalar_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price fractions read from text, oriented and compared exactly."""
    x = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") - 3).alias("n"), (F.col("l_partkey") % 7).alias("d"), (F.col("l_partkey") % 2).alias("side"))
    p = x.withColumn("p", X.price_parsed(F.col("n").cast("string"), F.col("d").cast("string"))).withColumn("o", X.oriented(F.col("n"), F.col("d"), F.col("side"), F.lit(0)))
    return p.select(
        "l_orderkey", "l_linenumber", X.price_valid(F.col("n"), F.col("d")).alias("valid"), F.when(F.col("p").isNotNull(), X.price_text(F.col("p.n"), F.col("p.d"))).alias("parsed"),
        F.col("o.n").alias("oriented_n"), F.col("o.d").alias("oriented_d"), X.price_compare(F.col("n"), F.col("d") + 1, F.lit(3), F.lit(5)).alias("compared"),
    )


@query("""WITH x AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 4)) AS code, CASE WHEN c_custkey % 5 <> 0 THEN 'G' || repeat(chr(CAST(65 + c_nationkey AS INTEGER)), 55) END AS issuer FROM customer)
SELECT c_custkey, CASE WHEN issuer IS NULL THEN 'XLM' ELSE code || ':' || issuer END AS asset_id, CASE WHEN issuer IS NULL THEN 'XLM' ELSE code || '.' || substr(issuer, 1, 8) END AS slug,
  CASE WHEN issuer IS NULL THEN 'XLM' WHEN c_custkey % 3 = 0 THEN NULL ELSE code END AS parsed, least(code, 'EURO') || '/' || greatest(code, 'EURO') AS label FROM x""")
def scalar_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset ids, slugs, ids parsed back (every third malformed) and pair labels."""
    letter = F.char(F.lit(65) + F.col("c_nationkey"))
    x = _table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.substring("c_mktsegment", 1, 4)).alias("code"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("G"), F.repeat(letter, F.lit(55)))).alias("issuer"))
    id_ = X.asset_id(F.col("code"), F.col("issuer"))
    text = F.when(F.col("issuer").isNull(), id_).when(F.col("c_custkey") % 3 == 0, F.concat(id_, F.lit("!"))).otherwise(F.replace(id_, F.lit(":"), F.lit("%3A")))
    return x.select("c_custkey", id_.alias("asset_id"), X.asset_slug(F.col("code"), F.col("issuer")).alias("slug"), X.asset_parsed(text)["code"].alias("parsed"), X.pair_label(F.col("code"), F.lit("EURO")).alias("label"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS noted, CASE event_id % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'null' ELSE 'value' END AS presence, CAST(event_id % 50 AS DOUBLE) / 1000 * 1000 + CAST(event_id % 7 AS DOUBLE) AS elapsed,
  CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS two_places FROM events""")
def scalar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade counts read from notes, presence of JSON keys, elapsed seconds, fixed decimals."""
    e = _table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    note = F.when(k % 4 == 0, F.lit("few trades")).otherwise(F.concat(F.lit("skipped: "), F.col("user_id").cast("string"), F.lit(" trades in 30 days")))
    body = F.when(k % 3 == 0, F.lit('{"b": 1}')).when(k % 3 == 1, F.lit('{"a": null}')).otherwise(F.lit('{"a": 2}'))
    later = F.timestamp_millis(F.unix_millis("at") + ((k % 50) + (k % 7)) * 1000)
    return e.select("event_id", X.trades_in_30_days(note).alias("noted"), X.json_presence(body, "a").alias("presence"), X.elapsed_seconds(F.col("at"), later).alias("elapsed"), X.fixed(F.col("value").cast("decimal(18,2)"), 2).alias("two_places"))


# trades -------------------------------------------------------------------------------------------------------------


@query(f"{BOUNDS} SELECT pair_id, CAST(min(notional) FILTER (abs(l - f) * 100 >= 5 * f) AS DOUBLE) / 100 AS bound FROM b WHERE kind = 'within_leg' GROUP BY 1")
def trade_tightest_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bounds.of_kind(bounds.implied_bounds(A.trades(spark, sf_dir)), "within_leg")
    return bounds.tightest(found, "0.05").select("pair_id", F.col("bound").cast("double").alias("bound"))


_MARK = "2024-01-15"
_DAY_BOUNDS = f"""{BOUNDS}, d AS (SELECT pair_id, day FROM t GROUP BY ALL), m AS (SELECT pair_id, day, min(notional) FILTER (kind = 'between_legs' AND abs(l - f) * 100 >= 2 * f) AS x FROM b GROUP BY ALL),
j AS (SELECT d.pair_id, d.day, x FROM d LEFT JOIN m ON d.pair_id = m.pair_id AND d.day = m.day)"""


@query(f"""{_DAY_BOUNDS} SELECT pair_id, CAST(min(day) FILTER (x < 500000) AS VARCHAR) AS first_below, count(*) FILTER (x < 500000) AS days_below, count(x) AS days_observed,
  CAST(date_diff('day', DATE '{_MARK}', min(day) FILTER (x < 500000)) AS BIGINT) AS days_from_mark FROM j GROUP BY 1""")
def trade_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day and number of days on which a move of 2 % is bounded below 5,000."""
    t = A.trades(spark, sf_dir)
    s = bounds.crossing_summary(bounds.daily_rows(t, bounds.implied_bounds(t)), "between_legs_0_02_bound", 5000, _MARK)
    return s.select("pair_id", F.col("first_below").cast("string").alias("first_below"), "days_below", "days_observed", *big("days_from_mark"))


@query(f"{_DAY_BOUNDS} SELECT pair_id, CAST(day AS VARCHAR) AS day, CASE WHEN x IS NULL THEN '' WHEN x < 500000 THEN 'yes' ELSE 'no' END AS verdict FROM j")
def trade_day_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trades(spark, sf_dir)
    d = bounds.daily_rows(t, bounds.implied_bounds(t))
    return d.select("pair_id", F.col("day").cast("string").alias("day"), bounds.verdict(F.col("between_legs_0_02_bound"), 5000).alias("verdict"))


@query(f"""WITH {TRADES}, n AS (SELECT pair_id, count(*) FILTER (epoch_us(closed_at) > epoch_us({_A}) - 2592000000000 AND closed_at <= {_A}) AS trades_30d, max(closed_at) >= TIMESTAMP '2024-01-30 12:00:00' AS end_seen FROM t GROUP BY 1)
SELECT pair_id, trades_30d, CASE WHEN trades_30d > 900 THEN 'last_genuine_only' ELSE 'full' END AS scope, end_seen FROM n""")
def trade_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope of each pair's trade pass, and whether its window was read to the end."""
    t = A.trades(spark, sf_dir)
    seen = trades.window_end_seen(t, F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return trades.scope_gate(t, anchor(), 900).join(seen, "pair_id").select("pair_id", "trades_30d", "scope", "end_seen")


@query(f"WITH {TRADES} SELECT trade_id, pair_id FROM t WHERE CAST(floor(epoch(closed_at) / 5) AS BIGINT) BETWEEN 340900000 AND 341200000")
def trade_ledger_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of the trade log by ledger."""
    return trades.trades_from_ledger(A.trades(spark, sf_dir), 340_900_000, 341_200_000).select("trade_id", "pair_id")


@query(f"""{CLASSIFIED}, {HOLDERS}, vol AS (SELECT pair_id, sum(CASE WHEN verdict = 'genuine' AND epoch_us(closed_at) > epoch_us({_A}) - 2592000000000 THEN v.k ELSE 0 END) AS g FROM v WHERE closed_at <= {_A} GROUP BY 1),
s AS (SELECT asset_id, sum(b) AS c FROM k GROUP BY 1)
SELECT pair_id, round(CAST(g AS DOUBLE) * 100 / CAST(c AS DOUBLE), 9) AS value, CASE WHEN c IS NULL THEN 'supply not measured' END AS why FROM vol LEFT JOIN s ON pair_id % 7 * 5 = asset_id""")
def trade_volume_to_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    supply = holders.concentration(A.holders(spark, sf_dir), A.holder_exclusions(spark, sf_dir)).select("asset_id", "circulating_supply")
    w = trades.window_volumes(_classified(spark, sf_dir), anchor())
    r = w.join(supply, F.col("pair_id") % 7 * 5 == F.col("asset_id"), "left").select("pair_id", trades.volume_to_supply(F.col("genuine_base_30d"), F.col("circulating_supply")).alias("r"))
    return r.select("pair_id", F.round("r.value", 9).alias("value"), "r.why")


# holders and accounts -----------------------------------------------------------------------------------------------


@query(f"""WITH {HOLDERS}, s AS (SELECT asset_id, sum(b) AS c FROM k GROUP BY 1), pull AS (SELECT CAST(c_nationkey AS BIGINT) AS asset_id, min(c_custkey) AS lo, max(c_custkey) AS hi, c_nationkey % 5 = 0 AS truncated FROM customer GROUP BY ALL)
SELECT pull.asset_id, lo AS snapshot_ledger, hi - lo AS ledger_span, truncated, CASE WHEN NOT truncated THEN round(CAST(c AS DOUBLE) / 100, 2) END AS circulating_supply, hi - lo <= 1400 AS within FROM pull LEFT JOIN s ON pull.asset_id = s.asset_id""")
def holder_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of whole pulls, with the spread of their pages."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("asset_id"), F.col("c_custkey").alias("latest_ledger"))
    pull = c.groupBy("asset_id").agg(F.min("latest_ledger").alias("ledger_min"), F.max("latest_ledger").alias("ledger_max")).withColumn("truncated", F.col("asset_id") % 5 == 0)
    r = holders.reading(holders.concentration(A.holders(spark, sf_dir), A.holder_exclusions(spark, sf_dir)), pull)
    spread = holders.pull_spread(c, 1400).select("asset_id", "within")
    return r.join(spread, "asset_id").select("asset_id", "snapshot_ledger", "ledger_span", "truncated", F.round(F.col("circulating_supply").cast("double"), 2).alias("circulating_supply"), "within")


@query("SELECT DISTINCT a AS asset_id FROM (SELECT 'A' || c_nationkey AS a FROM customer UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'XLM' ELSE c_mktsegment END FROM customer) WHERE a <> 'XLM'")
def holder_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return holders.targets(c.select(F.concat(F.lit("A"), F.col("c_nationkey").cast("string")).alias("base"), F.when(F.col("c_custkey") % 2 == 0, "XLM").otherwise(F.col("c_mktsegment")).alias("quote")))


@query(f"""WITH {TRADES}, s AS (SELECT pair_id, CAST(base AS VARCHAR) AS a FROM t UNION SELECT pair_id, CAST(counter AS VARCHAR) FROM t),
tl AS (SELECT c_custkey % 10 AS pair_id, CAST(c_custkey AS VARCHAR) AS a, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS b FROM customer)
SELECT s.pair_id, count(*) FILTER (b <> 0) AS non_zero_balance, count(*) FILTER (b = 0) AS zero_trustline, count(*) FILTER (b IS NULL) AS no_trustline, CAST(coalesce(sum(b), 0) AS BIGINT) AS held FROM s LEFT JOIN tl ON s.pair_id = tl.pair_id AND s.a = tl.a GROUP BY 1""")
def trader_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traders of each pair by what they hold."""
    k = F.col("c_custkey")
    lines = _table(spark, sf_dir, "customer").select((k % 10).alias("pair_id"), k.cast("string").alias("account_id"), F.when(k % 3 == 0, 0).otherwise(k).cast("decimal(19,7)").alias("balance"))
    s = holders.trader_status(holders.side_counts(A.trades(spark, sf_dir), [("all", F.lit(True))]), lines)
    return s.select("pair_id", "non_zero_balance", "zero_trustline", "no_trustline", *big("held"))


@query(f"""WITH {HOLDERS}, tr AS (SELECT DISTINCT o_custkey AS account_id FROM orders WHERE o_orderstatus = 'F'), g AS (SELECT asset_id, tr.account_id IS NOT NULL AS traded, count(*) AS holders, sum(b) AS q FROM k LEFT JOIN tr ON k.account_id = tr.account_id GROUP BY ALL)
SELECT asset_id, traded, holders, round(CAST(q AS DOUBLE) / 100, 2) AS quantity, round(CAST(q AS DOUBLE) * 100 / CAST(sum(q) OVER (PARTITION BY asset_id) AS DOUBLE), 6) AS share_pct FROM g""")
def holder_ever_traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("asset_id"), F.col("c_custkey").alias("account_id"))
    traded = _table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("account_id")).distinct().join(c, "account_id")
    e = holders.ever_traded(_kept(spark, sf_dir), traded)
    return e.select("asset_id", "traded", "holders", F.round(F.col("quantity").cast("double"), 2).alias("quantity"), F.round("share_pct", 6).alias("share_pct"))


@query(f"""WITH {TRADES}, g AS (SELECT pair_id, sum(c100) AS c, count(*) AS n, count(DISTINCT base) AS a FROM t GROUP BY 1)
SELECT pair_id, 'accounts' AS name, round(CAST(c AS DOUBLE) / 100 / a, 6) AS ratio FROM g UNION ALL SELECT pair_id, 'trades', round(CAST(c AS DOUBLE) / 100 / n, 6) FROM g""")
def supply_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One volume over two denominators."""
    g = A.trades(spark, sf_dir).groupBy("pair_id").agg(F.sum("counter_amount").alias("volume"), F.count(F.lit(1)).alias("n"), F.countDistinct("base_account").alias("a"))
    names = F.array(F.struct(F.lit("accounts").alias("name"), F.col("a").alias("quantity")), F.struct(F.lit("trades").alias("name"), F.col("n").alias("quantity")))
    d = g.select("pair_id", F.inline(names))
    return holders.supply_sensitivity(g.select("pair_id", "volume"), d).select("pair_id", "name", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {MAKERS}, n AS (SELECT account_id, pair_id, close_at, max(epoch_us(close_at) - epoch_us(at_)) AS longest, sum(epoch_us(close_at) - epoch_us(at_)) AS summed FROM w WHERE kind = 'delete' AND close_at IS NOT NULL GROUP BY ALL)
SELECT account_id, pair_id, round(CAST(sum(summed) AS DOUBLE) / 1000000, 3) AS sum_seconds, round(CAST(sum(longest) AS DOUBLE) / 1000000, 3) AS union_seconds FROM n GROUP BY ALL""")
def maker_nested_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of every delete: their sum and their union."""
    u = accounts.union_seconds(accounts.absence_windows(accounts.maker_events(A.maker_ops(spark, sf_dir)), nested=True))
    return u.select("account_id", "pair_id", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("sum_seconds", "union_seconds")))


# replay and comparison ----------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey % 50 AS pair_id, CAST(l_suppkey AS VARCHAR) AS account_id, bool_or(l_returnflag = 'R') AS from_trades, bool_or(l_returnflag <> 'R') AS from_live FROM lineitem GROUP BY ALL""")
def replay_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts to walk, by where they were seen."""
    l = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("pair_id"), F.col("l_suppkey").cast("string").alias("account_id"), F.col("l_orderkey").alias("offer_id"), "l_returnflag")  # noqa: E741
    return replay.accounts_to_walk(l.where("l_returnflag = 'R'"), l.where("l_returnflag <> 'R'").withColumnRenamed("account_id", "seller"))


_OPS = f"""ops AS (SELECT CAST(l_suppkey AS VARCHAR) AS account_id, l_orderkey AS id, l_linenumber, {DAYS} AS ledger_seq, l_linestatus = 'F' AS ok, l_partkey % 2 = 0 AS touches,
  CASE l_returnflag WHEN 'A' THEN 'manage_sell_offer' WHEN 'N' THEN 'manage_buy_offer' ELSE 'payment' END AS kind, l_quantity > 45 AS unsized FROM lineitem)"""


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "manage_sell_offer").when(F.col("l_returnflag") == "N", "manage_buy_offer").otherwise("payment")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("account_id"), F.col("l_orderkey").alias("id"), "l_linenumber", _days("l_shipdate").alias("ledger_seq"), (F.col("l_linestatus") == "F").alias("successful"),
        (F.col("l_partkey") % 2 == 0).alias("touches_pair"), kind.alias("type"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("amount"),
    )


@query(f"WITH {_OPS} SELECT id, l_linenumber, kind AS type FROM ops WHERE ok AND touches AND kind <> 'payment' AND ledger_seq BETWEEN 300 AND 2000")
def replay_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successful offer operations of the pair between two ledgers."""
    return replay.relevant_operations(_operations(spark, sf_dir), 300, 2000).select("id", "l_linenumber", "type")


@query(f"""WITH {_OPS}, g AS (SELECT account_id, count(*) AS records, min(ledger_seq) AS earliest, count(*) FILTER (kind <> 'payment') AS offer_ops, min(ledger_seq) FILTER (kind <> 'payment') AS first_op,
  count(*) FILTER (unsized AND kind <> 'payment') AS unsizable, count(*) FILTER (NOT ok) AS failed FROM ops GROUP BY ROLLUP (account_id))
SELECT account_id, records, earliest, offer_ops, unsizable, failed, coalesce(first_op < 40, false) AS may_be_inflated, unsizable = 0 AND NOT coalesce(first_op < 40, false) AS complete FROM g""")
def replay_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk totals of every account and of all, with what they leave open."""
    c = replay.completeness(replay.walk_totals(_operations(spark, sf_dir)), 40)
    return c.select("account_id", "records", "earliest", "offer_ops", "unsizable", "failed", "may_be_inflated", "complete")


@query(f"""WITH {TRADES}, f AS (SELECT pair_id, day, arg_min(closed_at, (closed_at, trade_id)) AS at_ FROM t GROUP BY ALL)
SELECT pair_id, CAST(day AS VARCHAR) AS day, CAST(floor(epoch(at_) / 5) AS BIGINT) AS ledger_seq, CAST(floor(epoch(at_) - epoch(CAST(day AS TIMESTAMP))) AS BIGINT) AS offset_seconds FROM f""")
def replay_daily_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.daily_samples(A.trades(spark, sf_dir)).select("pair_id", F.col("day").cast("string").alias("day"), *big("ledger_seq", "offset_seconds"))


@query(f"""WITH {METRICS}, live AS (SELECT pair_id, id AS offer_id, ledger_seq // 1000000 AS modified FROM m)
SELECT pair_id, count(*) FILTER (modified <= 1200) AS carried, count(*) FILTER (modified > 1200) AS changed_after_target FROM live GROUP BY 1""")
def replay_rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live offers that a past ledger already had, and those changed since."""
    live = A.metrics(spark, sf_dir).select("pair_id", F.floor(F.col("ledger_seq") / 1_000_000).alias("last_modified_ledger"))
    return replay.rewind(live, 1200)


@query(f"""SELECT pair_id, count(*) AS gone FROM (SELECT DISTINCT l_orderkey % 50 AS pair_id, l_orderkey AS o FROM lineitem WHERE l_returnflag = 'R' AND {DAYS} >= 1200 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) GROUP BY 1""")
def replay_gone_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers traded since a ledger that are not live now."""
    fills = A.offer_trades(spark, sf_dir).withColumn("ledger_seq", X.toid_ledger(F.col("toid")))
    k = F.col("o_orderkey")
    return replay.gone_offers(fills, _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select((k % 50).alias("pair_id"), k.alias("offer_id")), 1200)


@query(f"""WITH live AS (SELECT o_custkey % 50 AS pair_id, o_orderkey AS o, (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)))::BIGINT AS m FROM orders WHERE o_orderstatus <> 'F'),
tr AS (SELECT l_orderkey % 50 AS pair_id, l_orderkey AS o, max({DAYS}) AS last FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey <> 0 GROUP BY ALL), gn AS (SELECT tr.* FROM tr LEFT JOIN live ON tr.pair_id = live.pair_id AND tr.o = live.o WHERE live.o IS NULL),
tg AS (SELECT DISTINCT l_orderkey % 50 AS pair_id, {DAYS} AS ledger_seq FROM lineitem WHERE l_linenumber = 1),
cl AS (SELECT tg.pair_id, ledger_seq, count(*) FILTER (m <= ledger_seq) AS carried, count(*) FILTER (m > ledger_seq) AS changed FROM tg LEFT JOIN live ON tg.pair_id = live.pair_id GROUP BY ALL),
cg AS (SELECT tg.pair_id, ledger_seq, count(*) FILTER (last >= ledger_seq) AS gone FROM tg LEFT JOIN gn ON tg.pair_id = gn.pair_id GROUP BY ALL)
SELECT cl.pair_id, cl.ledger_seq, carried, changed AS changed_after_target, gone, changed = 0 AND gone = 0 AS certain FROM cl JOIN cg ON cl.pair_id = cg.pair_id AND cl.ledger_seq = cg.ledger_seq""")
def replay_rewound_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What carrying the open orders back to every ledger with a first line leaves unresolved there."""
    o = _table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    live = o.select((F.col("o_custkey") % 50).alias("pair_id"), F.col("o_orderkey").alias("offer_id"), _days("o_orderdate").alias("last_modified_ledger"))
    fills = A.offer_trades(spark, sf_dir).withColumn("ledger_seq", X.toid_ledger(F.col("toid")))
    targets = _table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") % 50).alias("pair_id"), _days("l_shipdate").alias("ledger_seq"))
    return replay.rewound_points(live, fills, targets)


@query("""WITH e AS (SELECT user_id AS pool_id, event_id, CAST(floor(epoch(ts) / 5) AS BIGINT) AS l, event_type = 'error' AS removed, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT pool_id, arg_max(removed, event_id) AS removed, arg_max(k, event_id) AS k FROM e WHERE l <= 341000000 GROUP BY 1)
SELECT p.pool_id, CASE WHEN n.pool_id IS NULL THEN 'unreached' WHEN removed THEN 'removed' ELSE 'found' END AS status, CAST(CASE WHEN NOT removed THEN k END AS BIGINT) AS reserve_base FROM (SELECT DISTINCT pool_id FROM e) p LEFT JOIN n ON p.pool_id = n.pool_id""")
def pool_reserves_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserves of every pool at a ledger: found, removed or not reached."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pool_id"), F.col("event_id").alias("token"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 5).alias("ledger_seq"),
        F.when(F.col("event_type") == "error", "liquidity_pool_removed").otherwise("trade").alias("type"), k.alias("reserve_base"), k.alias("reserve_quote"),
    )
    return replay.pool_reserves_at(e, e.select("pool_id"), 341_000_000).select("pool_id", "status", "reserve_base")


_CHECKED = f"""WITH {LEVELS}, a AS (SELECT pair_id, side, n, sum(amount) AS q FROM levels GROUP BY ALL),
b AS (SELECT pair_id, side, CASE WHEN pair_id % 6 = 2 AND side = 'bid' THEN n + 1 ELSE n END AS n, CASE WHEN pair_id % 10 = 0 THEN q + 1 ELSE q END AS q FROM a WHERE NOT (pair_id % 4 = 1 AND n % 9 = 0)),
ra AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY CASE WHEN side = 'bid' THEN -n ELSE n END) AS r FROM a), rb AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY CASE WHEN side = 'bid' THEN -n ELSE n END) AS r FROM b),
j AS (SELECT coalesce(ra.pair_id, rb.pair_id) AS pair_id, coalesce(ra.side, rb.side) AS side, ra.n AS n0, rb.n AS n1, ra.q AS q0, rb.q AS q1 FROM ra FULL JOIN rb ON ra.pair_id = rb.pair_id AND ra.side = rb.side AND ra.r = rb.r),
c AS (SELECT pair_id, count(n0) FILTER (side = 'bid') AS recorded_bids, count(n0) FILTER (side = 'ask') AS recorded_asks, count(n1) FILTER (side = 'bid') AS rebuilt_bids, count(n1) FILTER (side = 'ask') AS rebuilt_asks,
  count(n0) FILTER (side = 'bid') = count(n1) FILTER (side = 'bid') AND count(n0) FILTER (side = 'ask') = count(n1) FILTER (side = 'ask') AS levels_match, coalesce(bool_and(n0 = n1), true) AS prices_match, coalesce(bool_and(q0 = q1), true) AS amounts_match FROM j GROUP BY 1)"""


def _both_books(spark: SparkSession, sf_dir: str, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Merged books, and books with levels left out, prices moved and amounts changed by rules over all rows; ``kept`` says how
    the merged books are kept for several uses."""
    a = kept(book.merge_levels(A.book_levels(spark, sf_dir)))
    p, n = F.col("pair_id"), F.col("price_n")
    b = a.where(~((p % 4 == 1) & (n % 9 == 0))).withColumn("price_n", F.when((p % 6 == 2) & (F.col("side") == "bid"), n + 1).otherwise(n))
    return a, b.withColumn("amount", F.when(p % 10 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(19,7)"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.crosscheck(*_both_books(spark, sf_dir))


@query(f"{_CHECKED} SELECT * FROM c")
def book_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded books against changed ones."""
    return _checked(spark, sf_dir).select("pair_id", *big("recorded_bids", "recorded_asks", "rebuilt_bids", "rebuilt_asks"), "levels_match", "prices_match", "amounts_match")


def _book_risk_sql(name: str, table: str) -> str:
    """CTE ``name`` with the risk figures of the books (pair_id, side, n, q) of a table, without pools; money in ten-thousandths."""
    near, far = (2, 5, 10), (50, 100, 1000, 10000)
    return f"""{name}_top AS (SELECT p_partkey AS pair_id, max(n) FILTER (side = 'bid') AS bid, min(n) FILTER (side = 'ask') AS ask FROM part LEFT JOIN {table} l ON p_partkey = l.pair_id GROUP BY 1),
{name}_sums AS (SELECT t.pair_id, bid, ask, bid + ask AS p2, {', '.join(f"coalesce(sum(q * n) FILTER (side = 'ask' AND 200 * n <= (bid + ask) * (100 + {d})), 0) AS buy{d}, coalesce(sum(q * n) FILTER (side = 'bid' AND 200 * n >= (bid + ask) * (100 - {d})), 0) AS sell{d}" for d in near)},
  {', '.join(f"CASE WHEN bool_or(side = 'ask' AND 200 * n >= (bid + ask) * (100 + {d})) THEN coalesce(sum(q * n) FILTER (side = 'ask' AND 200 * n < (bid + ask) * (100 + {d})), 0) END AS cost{d}" for d in far)} FROM {name}_top t LEFT JOIN {table} l ON t.pair_id = l.pair_id GROUP BY ALL),
{name}_flags AS (SELECT *, p2 IS NULL AS f1, p2 IS NOT NULL AND (buy2 = 0 OR sell2 = 0) AS f2, p2 IS NOT NULL AND coalesce(least({', '.join(f"cost{d}" for d in far)}) < 100000000, false) AS f3, coalesce((ask - bid) * 200 > 20 * p2, false) AS f4, p2 IS NOT NULL AND least(buy5, sell5) < 500000000 AS f5 FROM {name}_sums),
{name} AS (SELECT *, p2 IS NULL AS none, CASE WHEN f1 OR f2 OR f3 THEN 3 WHEN f4 THEN 2 WHEN f5 THEN 1 ELSE 0 END AS band FROM {name}_flags)"""


@query(f"""{_CHECKED}, {_book_risk_sql("x", "a")}, {_book_risk_sql("y", "b")},
w AS (SELECT x.pair_id, CASE WHEN x.none <> y.none THEN 'price_source' WHEN x.band <> y.band THEN 'band' WHEN x.p2 IS DISTINCT FROM y.p2 THEN 'p0' WHEN abs((x.ask - x.bid) * 200.0 / x.p2 - (y.ask - y.bid) * 200.0 / y.p2) > 0.0000001 THEN 'spread_pct' {' '.join(f"WHEN x.p2 IS NOT NULL AND x.{k}{d} <> y.{k}{d} THEN 'depth {d / 100} {k}_side'" for d in (2, 5, 10) for k in ("buy", "sell"))}
  WHEN x.f1 <> y.f1 OR x.f2 <> y.f2 OR x.f3 <> y.f3 OR x.f4 <> y.f4 OR x.f5 <> y.f5 THEN 'flags' END AS at_ FROM x JOIN y ON x.pair_id = y.pair_id)
SELECT c.pair_id, levels_match, prices_match, amounts_match, at_ IS NULL AS risk_match, at_ AS risk_differs_at, CASE WHEN levels_match AND prices_match AND amounts_match AND at_ IS NULL THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM c JOIN w ON c.pair_id = w.pair_id""")
def book_risk_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded books against changed ones, with the first figure of their risk that differs."""
    checked = compare.crosscheck_with_risk(*_both_books(spark, sf_dir, written), A.snapshots(spark, sf_dir))
    return compare.verdicts(checked).select("pair_id", "levels_match", "prices_match", "amounts_match", "risk_match", "risk_differs_at", "verdict")


@query(f"{_CHECKED} SELECT CASE WHEN pair_id % 13 = 0 THEN 'ERROR' WHEN levels_match AND prices_match AND amounts_match THEN 'MATCH' WHEN pair_id % 5 = 0 THEN 'PARTIAL' ELSE 'MISMATCH' END AS verdict, count(*) AS recordings FROM c GROUP BY 1")
def crosscheck_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over all pairs, some with an error and some with offers unresolved."""
    c = _checked(spark, sf_dir).withColumn("error", F.when(F.col("pair_id") % 13 == 0, "no book")).withColumn("unresolved", F.when(F.col("pair_id") % 5 == 0, 1).otherwise(0))
    return compare.verdict_summary(compare.verdicts(c))


@query(f"WITH {METRICS} SELECT pair_id, band AS flag, CAST(min(CAST(at_ AS DATE)) AS VARCHAR) AS first_day, count(DISTINCT CAST(at_ AS DATE)) AS days FROM m GROUP BY ALL")
def series_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day of each band in a pair's series, and its days."""
    s = A.metrics(spark, sf_dir).select("pair_id", F.col("ledger_closed_at").cast("date").alias("day"), F.array("band").alias("flags"))
    return compare.series_diagnostics(s).select("pair_id", "flag", F.col("first_day").cast("string").alias("first_day"), "days")


@query(f"WITH {LEVELS} SELECT pair_id % 50 AS pair_id, count(*) AS points, count(*) FILTER (bids = 0 AND asks = 0) AS empty_books, count(*) FILTER (coalesce(bid >= ask, false)) AS crossed_points FROM top GROUP BY 1")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = book.book_top(A.book_levels(spark, sf_dir)).select((F.col("pair_id") % 50).alias("pair_id"), "bids", "asks", "crossed")
    return compare.series_summary(points)


# stored tables ------------------------------------------------------------------------------------------------------


@query(f"WITH {METRICS} SELECT pair_id, id, ledger_seq FROM m WHERE src = 'horizon' AND ledger_seq BETWEEN 400000000 AND 1500000000")
def metrics_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source in an inclusive ledger range."""
    return store.history(A.metrics(spark, sf_dir), "horizon", 400_000_000, 1_500_000_000).select("pair_id", "id", "ledger_seq")


@query(f"WITH {METRICS} SELECT id, CASE WHEN src = 'horizon' THEN greatest(id % 100 - 10, 0) ELSE 0 END AS seconds FROM m")
def metrics_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_micros(F.unix_micros("ledger_closed_at") + (F.col("id") % 100 - 10) * 1_000_000)
    return A.metrics(spark, sf_dir).withColumn("computed_at", at).select("id", store.staleness_seconds().cast("bigint").alias("seconds"))


@query(f"""WITH {METRICS}, r AS (SELECT arg_max(id % 7, (at_, id)) AS failed, arg_max(id, (at_, id)) AS ok FROM m), n AS (SELECT max(ledger_seq) AS l FROM m)
SELECT CASE WHEN failed > 0 THEN 'degraded' ELSE 'ok' END AS status, ok, failed, l AS newest_ledger FROM r, n""")
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.metrics(spark, sf_dir)
    at = F.col("ledger_closed_at")
    return store.health(m.select("id", at.alias("started_at"), at.alias("finished_at"), F.col("id").alias("ok"), (F.col("id") % 7).alias("failed")), m)


_PAIRS = "pr AS (SELECT c_custkey AS pair_id, c_mktsegment AS code, CAST(c_custkey // 3 AS VARCHAR) AS issuer, CASE WHEN c_custkey % 4 = 0 THEN 'USDC' WHEN c_custkey % 4 = 1 THEN 'EURC' ELSE 'XLM' END AS quote FROM customer)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    quote = F.when(k % 4 == 0, "USDC").when(k % 4 == 1, "EURC").otherwise("XLM")
    return _table(spark, sf_dir, "customer").select(k.alias("pair_id"), F.col("c_mktsegment").alias("code"), F.floor(k / 3).cast("string").alias("issuer"), quote.alias("quote"))


@query(f"""WITH {_PAIRS}, g AS (SELECT code, issuer, count(*) AS n, min(pair_id) FILTER (quote = 'USDC') AS u, min(pair_id) AS only_, list_sort(list(DISTINCT quote)) AS q FROM pr GROUP BY ALL)
SELECT code, issuer, CASE WHEN n = 1 THEN only_ ELSE u END AS pair_id, CASE WHEN n > 1 AND u IS NULL THEN array_to_string(q, ',') END AS candidates FROM g""")
def primary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.primary_pair(_pairs(spark, sf_dir)).select("code", "issuer", "pair_id", F.array_join("candidates", ",").alias("candidates"))


@query(f"WITH {METRICS} SELECT pair_id, band, id FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, band ORDER BY at_ DESC, id DESC) AS r FROM m) WHERE r = 1")
def latest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_reading(A.metrics(spark, sf_dir), ["pair_id", "band"], ["ledger_closed_at", "id"]).select("pair_id", "band", "id")


@query(f"""WITH {METRICS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ledger_seq DESC, src, id) AS r FROM m) WHERE r = 1 AND pair_id % 9 <> 0)
SELECT pair_id, id, band, count(*) OVER () AS total FROM l WHERE band IN ('LOW')""")
def latest_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of every active pair in one band, with their number."""
    m = A.metrics(spark, sf_dir).withColumn("flags", F.array("band"))
    pairs = m.select("pair_id").distinct().select("pair_id", F.col("pair_id").cast("string").alias("code"), F.lit(None).cast("string").alias("issuer"), F.lit("USDC").alias("quote"), (F.col("pair_id") % 9 != 0).alias("active"))
    return store.latest_summaries(m, pairs, band="LOW", flag="LOW").select("pair_id", "id", "band", "total")


@query(f"""WITH {METRICS}, d AS (SELECT pair_id, min(pair_id) OVER (PARTITION BY pair_id % 20) AS keep FROM (SELECT DISTINCT pair_id FROM m)),
x AS (SELECT m.*, keep, ledger_seq // 10000000 AS l10, row_number() OVER (PARTITION BY keep, ledger_seq // 10000000, src ORDER BY CASE WHEN m.pair_id <> keep THEN 1 ELSE 0 END, m.pair_id, id) AS r FROM m JOIN d ON m.pair_id = d.pair_id)
SELECT keep AS pair_id, id, l10 AS ledger_seq FROM x WHERE r = 1""")
def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics after pairs with one key were merged, without those that would collide."""
    m = A.metrics(spark, sf_dir).withColumn("ledger_seq", F.floor(F.col("ledger_seq") / 10_000_000))
    pairs = m.select("pair_id").distinct().select("pair_id", (F.col("pair_id") % 20).cast("string").alias("code"), F.lit(None).cast("string").alias("issuer"), F.lit("USDC").alias("quote"))
    return store.merge_duplicates(pairs, m)[1].select("pair_id", "id", "ledger_seq")


@query(f"WITH {METRICS} SELECT CASE WHEN band = 'LOW' THEN 'ok' ELSE band END AS reason, count(*) AS pairs FROM m GROUP BY 1")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scan_summary(A.metrics(spark, sf_dir).select(F.when(F.col("band") != "LOW", F.col("band")).alias("reason")))


@query(f"WITH {METRICS} SELECT pair_id, id FROM m WHERE src = 'horizon' AND id % 4 <> 0")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an idempotent insert appends: rows of one source whose key is not stored, though given twice."""
    m = A.metrics(spark, sf_dir)
    rows = m.where("data_source = 'horizon'")
    return store.insert_new(m.where("id % 4 = 0"), rows.union(rows), ["pair_id", "id"]).select("pair_id", "id")


# assets -------------------------------------------------------------------------------------------------------------

_STATS = "st AS (SELECT c_mktsegment AS code, CAST(c_nationkey AS VARCHAR) AS issuer, CASE WHEN c_custkey % 3 = 0 THEN 'native12' ELSE 'credit4' END AS type, c_custkey FROM customer)"


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("code"), F.col("c_nationkey").cast("string").alias("issuer"), F.when(F.col("c_custkey") % 3 == 0, "native12").otherwise("credit4").alias("type"), "c_custkey")


@query(f"WITH {_STATS} SELECT DISTINCT code, issuer, type FROM st WHERE code IN ('BUILDING', 'MACHINERY')")
def assets_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stats(spark, sf_dir)
    wanted = universe.codes(s.where("code = 'BUILDING'"), s.where("code = 'MACHINERY' or trim(code) = ''"))
    return universe.by_code(s.select("code", "issuer", "type"), wanted)


@query(f"WITH {_STATS} SELECT code, count(DISTINCT issuer) AS issuers, count(*) >= 290 AS truncated FROM st GROUP BY 1")
def ticker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.ticker_counts(_stats(spark, sf_dir), 290)


@query(f"""WITH {_STATS}, c AS (SELECT c_custkey, code, issuer, CASE WHEN c_custkey % 4 <> 0 THEN 'd' || (c_custkey % 7) END AS home FROM st)
SELECT c_custkey || code AS code, issuer, CASE WHEN home IS NULL THEN 'unverified' WHEN home IN ('d0', 'd6') THEN 'unreachable' WHEN c_custkey % 5 = 0 THEN 'verified' ELSE 'mismatch' END AS verification FROM c""")
def asset_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against the documents of their home domains."""
    k = F.col("c_custkey")
    c = _stats(spark, sf_dir).select(k, F.concat(k.cast("string"), "code").alias("code"), "issuer", F.when(k % 4 != 0, F.concat(F.lit("d"), (k % 7).cast("string"))).alias("home_domain"))
    docs = c.select("home_domain", (~F.col("home_domain").isin("d0", "d6")).alias("readable")).where("home_domain is not null")
    return universe.verification(c, docs, c.where(k % 5 == 0).select("home_domain", "code", "issuer")).select("code", "issuer", "verification")


@query(f"WITH {_STATS} SELECT c_custkey || code AS code, issuer, type FROM st WHERE c_custkey % 6 = 0 OR (c_custkey % 3 <> 0 AND c_custkey % 2 = 0)")
def asset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared assets whose type is not the listed one, or that are not listed."""
    k = F.col("c_custkey")
    declared = _stats(spark, sf_dir).select(F.concat(k.cast("string"), "code").alias("code"), "issuer", "type", k)
    listed = declared.where((k % 6 == 0) | (k % 2 == 1)).select("code", "issuer", F.when(k % 6 == 0, "other").otherwise(F.col("type")).alias("type"))
    return universe.identity_mismatches(declared, listed).select("code", "issuer", "type")

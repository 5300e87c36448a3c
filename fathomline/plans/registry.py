"""Registered queries over the benchmark tables, each with its DuckDB SQL.

Ratios are rounded to six decimals on both sides; sums and comparisons stay exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.operators import accounts, book, bounds, holders, replay, risk, series, store, supporting, trades
from fathomline.params import DEFAULT
from fathomline.plans import adapters as A
from fathomline.scratch import written
from fathomline.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ANCHOR = "2024-01-31 00:00:00"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def anchor():
    return F.lit(ANCHOR).cast("timestamp")


def r6(c: str, name: str | None = None):
    return F.round(F.col(c).cast("double"), 6).alias(name or c.split(".")[-1])


def big(*names: str):
    return [F.col(c).cast("bigint").alias(c) for c in names]


LEVELS = """levels AS (
  SELECT l_partkey AS pair_id, CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side, CAST(l_quantity AS BIGINT) AS amount,
         CAST(round(p_retailprice * 100) AS BIGINT) * CASE WHEN l_linestatus = 'F' THEN 100 - CAST(round(l_discount * 100) AS BIGINT) ELSE 100 + CAST(round(l_discount * 100) AS BIGINT) END AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE (l_linestatus = 'F' AND l_partkey % 7 <> 0) OR (l_linestatus <> 'F' AND l_partkey % 11 <> 0)),
top AS (
  SELECT pair_id, max(n) FILTER (side = 'bid') AS bid, min(n) FILTER (side = 'ask') AS ask, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks,
         sum(amount) FILTER (side = 'bid') AS bid_total, sum(amount) FILTER (side = 'ask') AS ask_total FROM levels GROUP BY 1)"""
POOLS = """pools AS (
  SELECT p_partkey AS pair_id, i, CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE p_size * 10 END AS rb, CAST(round(p_retailprice * 100) AS BIGINT) * (100 + (p_partkey % 5 - 2) * 6) AS sn,
         CASE WHEN i = 0 THEN 30 ELSE 100 END AS fee
  FROM part, (VALUES (0), (1)) t(i) WHERE p_partkey % 13 <> 0 AND (i = 0 OR p_partkey % 3 = 0)),
deepest AS (SELECT pair_id, max(sn) AS sn FROM pools WHERE rb > 0 GROUP BY 1)"""
PRICED = f"""WITH {LEVELS}, {POOLS}, priced AS (
  SELECT p_partkey AS pair_id, t.*  EXCLUDE (pair_id), d.sn, CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN bid + ask END AS mid2
  FROM part LEFT JOIN top t ON p_partkey = t.pair_id LEFT JOIN deepest d ON p_partkey = d.pair_id),
src AS (SELECT *, CASE WHEN mid2 IS NOT NULL AND (sn IS NULL OR abs(mid2 - 2 * sn) * 100 <= 10 * 2 * sn) THEN 'book' WHEN sn IS NOT NULL THEN 'pool' ELSE 'none' END AS price_source FROM priced),
ref AS (SELECT *, CASE price_source WHEN 'book' THEN mid2 WHEN 'pool' THEN 2 * sn END AS p2 FROM src)"""


def _books(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return A.snapshots(spark, sf_dir), A.book_levels(spark, sf_dir), A.pools(spark, sf_dir)


@query(f"WITH {LEVELS} SELECT pair_id, round(bid / 10000.0, 6) AS best_bid, round(ask / 10000.0, 6) AS best_ask, bids, asks, CAST(bid_total AS DOUBLE) AS bid_amount_total, CAST(ask_total AS DOUBLE) AS ask_amount_total, coalesce(bid >= ask, false) AS crossed FROM top")
def book_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = book.book_top(A.book_levels(spark, sf_dir))
    return t.select("pair_id", r6("best_bid"), r6("best_ask"), "bids", "asks", *(F.col(c).cast("double").alias(c) for c in ("bid_amount_total", "ask_amount_total")), "crossed")


@query(f"WITH {LEVELS} SELECT pair_id, side, n AS price_n, CAST(sum(amount) AS BIGINT) AS amount FROM levels GROUP BY ALL")
def book_merged_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.merge_levels(A.book_levels(spark, sf_dir)).select("pair_id", "side", "price_n", *big("amount"))


@query(f"{PRICED} SELECT pair_id, price_source, round(p2 / 20000.0, 6) AS p0, round(sn / 10000.0, 6) AS spot, CASE WHEN mid2 IS NOT NULL AND sn IS NOT NULL THEN round(abs(mid2 - 2 * sn) * 100.0 / (2 * sn), 4) END AS divergence_pct, CASE WHEN bid IS NOT NULL AND ask IS NOT NULL AND p2 > 0 THEN round((ask - bid) * 200.0 / p2, 4) END AS spread_pct FROM ref")
def book_reference_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = book.reference_price(*_books(spark, sf_dir))
    return r.select("pair_id", "price_source", r6("p0"), r6("spot"), *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("divergence_pct", "spread_pct")))


@query(f"""{PRICED}, c AS (SELECT *, CASE WHEN mid2 IS NOT NULL AND abs(mid2 - 2 * sn) * 100 > 20 * sn THEN 1 WHEN mid2 IS NOT NULL AND sn IS NOT NULL THEN 2 WHEN mid2 IS NOT NULL THEN 3 WHEN sn IS NOT NULL THEN 4 ELSE 5 END AS ladder_case,
  CASE WHEN mid2 IS NOT NULL AND sn IS NOT NULL THEN abs(mid2 - 2 * sn) * 100 END AS x FROM ref)
SELECT ladder_case, CASE WHEN x IS NULL THEN 'none' WHEN x <= 2 * sn THEN '0-1' WHEN x <= 4 * sn THEN '1-2' WHEN x <= 10 * sn THEN '2-5' WHEN x <= 20 * sn THEN '5-10' WHEN x <= 100 * sn THEN '10-50' ELSE '50+' END AS bucket, count(*) AS pairs, count(*) FILTER (x > 20 * sn) AS above FROM c GROUP BY ALL""")
def book_divergence_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.divergence_survey(book.reference_price(*_books(spark, sf_dir))).select("ladder_case", "bucket", "pairs", "above")


@query(f"""{PRICED}, r AS (SELECT pair_id, p2, d FROM ref, (VALUES (2), (5), (10)) t(d) WHERE p2 IS NOT NULL)
SELECT r.pair_id, d AS delta_pct, coalesce(CAST(sum(amount * n) FILTER (side = 'ask' AND 200 * n <= p2 * (100 + d)) AS DOUBLE), 0) / 10000 AS from_book,
  coalesce(CAST(sum(amount * n) FILTER (side = 'bid' AND 200 * n >= p2 * (100 - d)) AS DOUBLE), 0) / 10000 AS sell_book FROM r LEFT JOIN levels l ON r.pair_id = l.pair_id GROUP BY ALL""")
def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, l, p = _books(spark, sf_dir)
    d = book.priced_ladders(s, l, p).select(*book.KEY, F.inline("depth"))
    return d.select("pair_id", (F.col("delta") * 100).cast("int").alias("delta_pct"), F.col("from_book").cast("double").alias("from_book"), F.col("sell_from_book").cast("double").alias("sell_book"))


_POOL_RUNGS = f"""{PRICED}, r AS (SELECT pair_id, p2, d FROM ref, (VALUES (2), (5), (10)) t(d) WHERE p2 IS NOT NULL)
SELECT r.pair_id, d AS delta_pct, round(sum(CASE WHEN rb = 0 OR 200 * sn >= p2 * (100 + d) THEN 0 ELSE rb * (sn / 10000.0) * (sqrt(p2 * (100 + d) / (200.0 * sn)) - 1) / (1 - fee / 10000.0) END) + 1e-6, 2) AS from_pools
FROM r JOIN pools p ON r.pair_id = p.pair_id AND rb > 0 GROUP BY ALL"""


@query(_POOL_RUNGS)
def pool_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, l, p = _books(spark, sf_dir)
    d = book.priced_ladders(s, l, p).select(*book.KEY, F.inline("depth")).join(book.active_pools(p).select(*book.KEY).distinct(), book.KEY, "left_semi")
    return d.select("pair_id", (F.col("delta") * 100).cast("int").alias("delta_pct"), F.round(F.col("from_pools").cast("double") + 1e-6, 2).alias("from_pools"))


@query(f"""{PRICED}, r AS (SELECT pair_id, p2, d, sn FROM ref, (VALUES (50), (100), (1000), (10000)) t(d) WHERE p2 IS NOT NULL)
SELECT r.pair_id, d AS delta_pct, coalesce(CAST(sum(amount * n) FILTER (side = 'ask' AND 200 * n < p2 * (100 + d)) AS DOUBLE), 0) / 10000 AS book_cost, coalesce(bool_or(side = 'ask' AND 200 * n >= p2 * (100 + d)), false) AS book_reachable,
  coalesce(bool_or(side = 'ask' AND 200 * n >= p2 * (100 + d)), false) OR max(r.sn) IS NOT NULL AS combined_reachable FROM r LEFT JOIN levels l ON r.pair_id = l.pair_id GROUP BY ALL""")
def book_manipulation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, l, p = _books(spark, sf_dir)
    m = book.priced_ladders(s, l, p).select(*book.KEY, F.inline("manipulation"))
    return m.select("pair_id", (F.col("delta") * 100).cast("int").alias("delta_pct"), F.col("book_cost").cast("double").alias("book_cost"), "book_reachable", "combined_reachable")


@query(f"""{PRICED} SELECT r.pair_id, CASE WHEN r.sn IS NULL THEN round(r.ask_max / 10000.0, 6) END AS max_reachable_price, CASE WHEN r.sn IS NULL AND r.ask_max IS NOT NULL THEN r.below / 10000 END AS cost_to_max_reachable FROM (
  SELECT ref.pair_id, ref.sn, m.ask_max, (SELECT coalesce(CAST(sum(amount * n) AS DOUBLE), 0) FROM levels l WHERE l.pair_id = ref.pair_id AND side = 'ask' AND n < m.ask_max) AS below
  FROM ref LEFT JOIN (SELECT pair_id, max(n) AS ask_max FROM levels WHERE side = 'ask' GROUP BY 1) m ON ref.pair_id = m.pair_id) r""")
def book_max_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.max_reachable(*_books(spark, sf_dir)).select("pair_id", r6("max_reachable_price"), F.col("cost_to_max_reachable").cast("double").alias("cost_to_max_reachable"))


@query(f"WITH {POOLS} SELECT count(*) AS pools, count(*) FILTER (rb = 0) AS both_empty, CAST(0 AS BIGINT) AS one_empty FROM pools")
def pool_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.empty_pool_census(A.pools(spark, sf_dir))


def _supporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of the nation-wide asset, and trade figures of the traded pair, whose number is the pair's remainder."""
    stats = holders.concentration(A.holders(spark, sf_dir), A.holder_exclusions(spark, sf_dir))
    s, log = A.snapshots(spark, sf_dir), written(A.trades(spark, sf_dir))
    asked = log.select("pair_id").distinct().select("pair_id", F.lit(A.LEDGER).cast("bigint").alias("ledger_seq"), anchor().alias("ledger_closed_at"))
    traded = supporting.supporting_at(log, A.issuers(spark, sf_dir), asked).drop("ledger_seq").withColumnRenamed("pair_id", "traded_id")
    out = s.withColumns({"asset_id": F.col("pair_id") % 25, "traded_id": F.col("pair_id") % 10}).join(stats, "asset_id", "left").join(traded, "traded_id", "left")
    return out.select(*book.KEY, *risk.SUPPORTING)


@query(f"""{PRICED}, asks AS (SELECT r.pair_id, d, coalesce(sum(amount * n) FILTER (side = 'ask' AND 200 * n < p2 * (100 + d)), 0) AS cost, coalesce(bool_or(side = 'ask' AND 200 * n >= p2 * (100 + d)), false) AS reach
  FROM ref r CROSS JOIN (VALUES (50), (100), (1000), (10000)) t(d) LEFT JOIN levels l ON r.pair_id = l.pair_id WHERE p2 IS NOT NULL GROUP BY ALL)
SELECT r.pair_id, price_source = 'none' AS no_price, CASE WHEN p2 IS NULL THEN 'unevaluated' WHEN EXISTS (SELECT 1 FROM asks a WHERE a.pair_id = r.pair_id AND reach AND cost < 100000000) THEN 'triggered' ELSE 'clear' END AS cheap,
  CASE WHEN sn IS NOT NULL AND mid2 IS NULL THEN 'unevaluated' WHEN mid2 IS NOT NULL AND sn IS NOT NULL AND abs(mid2 - 2 * sn) * 100 > 20 * sn THEN 'triggered' ELSE 'clear' END AS conflict,
  CASE WHEN mid2 IS NULL OR p2 IS NULL THEN 'unevaluated' WHEN (ask - bid) * 200 > 20 * p2 THEN 'triggered' ELSE 'clear' END AS spread FROM ref r""")
def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = risk.asset_risk(*_books(spark, sf_dir))
    state = lambda f: F.filter("flag_states", lambda s: s["flag"] == f)[0]["state"]
    return r.select("pair_id", (F.col("price_source") == "none").alias("no_price"), state("MANIPULATION_CHEAP").alias("cheap"), state("PRICE_SOURCE_CONFLICT").alias("conflict"), state("SPREAD_EXTREME").alias("spread"))


TRADES = """e AS (SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS n, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id // 3 AS op, min(ts) OVER (PARTITION BY event_id // 3) AS closed_at FROM events),
t AS (SELECT user_id % 10 AS pair_id, event_id AS trade_id, op, event_id % 3 AS fill, closed_at, CAST(closed_at AS DATE) AS day, n, k, k * n AS c100, event_type IN ('click', 'purchase') AS seller, user_id AS base, (event_id * 7) % 150 AS counter, event_type = 'error' AS pool FROM e),
med AS (SELECT pair_id, day, quantile_disc(n, 0.5 ORDER BY n DESC) AS med FROM t WHERE NOT pool AND n > 0 GROUP BY ALL)"""
CLASSIFIED = f"""WITH {TRADES}, refs AS (SELECT f.trade_id, quantile_disc(b.n, 0.5 ORDER BY b.n DESC) AS ref FROM t f JOIN t b ON f.pair_id = b.pair_id AND NOT b.pool AND b.n > 0 AND abs(epoch_us(f.closed_at) - epoch_us(b.closed_at)) <= 900000000 WHERE f.pool GROUP BY 1),
v AS (SELECT t.*, med, ref, CASE WHEN base = counter THEN 'self_trade' WHEN c100 < 1 THEN 'dust' WHEN base = t.pair_id OR counter = t.pair_id THEN 'issuer_leg' WHEN pool AND ref IS NULL THEN 'unevaluated' WHEN pool AND n > ref THEN 'off_book_pool_fill'
  WHEN med IS NOT NULL AND n > 0 AND (n * 2 > med * 3 OR n * 3 < med * 2) THEN 'price_outlier' ELSE 'genuine' END AS verdict FROM t LEFT JOIN med ON t.pair_id = med.pair_id AND t.day = med.day LEFT JOIN refs ON t.trade_id = refs.trade_id)"""


@query(f"WITH {TRADES} SELECT pair_id, CAST(day AS VARCHAR) AS day, round(med / 100.0, 6) AS day_median FROM med")
def trade_daily_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.daily_medians(A.trades(spark, sf_dir)).select("pair_id", F.col("day").cast("string").alias("day"), r6("day_median"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.classify(A.trades(spark, sf_dir), A.issuers(spark, sf_dir))


@query(f"{CLASSIFIED} SELECT trade_id, CASE WHEN verdict IN ('genuine', 'unevaluated') THEN verdict ELSE 'excluded' END AS state, CASE WHEN verdict NOT IN ('genuine', 'unevaluated') THEN verdict END AS condition, round(ref / 100.0, 6) AS book_reference FROM v")
def trade_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("trade_id", "state", "condition", r6("book_reference"))


@query(f"""{CLASSIFIED}, g AS (SELECT p.pair_id, verdict FROM (SELECT DISTINCT pair_id FROM t) p, (VALUES ('genuine'), ('unevaluated'), ('self_trade'), ('dust'), ('issuer_leg'), ('off_book_pool_fill'), ('price_outlier')) x(verdict))
SELECT g.pair_id, g.verdict, count(v.trade_id) AS trades, CAST(coalesce(sum(k), 0) AS BIGINT) AS base_volume, coalesce(CAST(sum(c100) AS DOUBLE), 0) / 100 AS quote_volume FROM g LEFT JOIN v ON g.pair_id = v.pair_id AND g.verdict = v.verdict GROUP BY ALL""")
def trade_genuine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = trades.summarise(_classified(spark, sf_dir))
    return s.select("pair_id", F.coalesce("condition", "state").alias("verdict"), "trades", *big("base_volume"), F.col("quote_volume").cast("double").alias("quote_volume"))


@query(f"{CLASSIFIED} SELECT pair_id, round(CAST(sum(c100) FILTER (verdict NOT IN ('genuine', 'unevaluated')) AS DOUBLE) * 100 / CAST(sum(c100) AS DOUBLE), 6) AS trades_excluded_pct FROM v GROUP BY 1 HAVING sum(c100) > 0")
def trade_excluded_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.excluded_pct(_classified(spark, sf_dir)).select("pair_id", r6("trades_excluded_pct"))


_A = f"TIMESTAMP '{ANCHOR}'"


@query(f"{CLASSIFIED} SELECT pair_id, max(closed_at) AS last_genuine_at, CAST(floor((epoch_us({_A}) - epoch_us(max(closed_at))) / 1000000) AS BIGINT) AS last_genuine_age_seconds FROM v WHERE verdict = 'genuine' AND closed_at <= {_A} GROUP BY 1")
def trade_last_genuine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.last_genuine(_classified(spark, sf_dir), anchor()).select("pair_id", F.col("last_genuine_at").cast("timestamp_ntz").alias("last_genuine_at"), *big("last_genuine_age_seconds"))


def _win(s: int) -> str:
    return f"epoch_us(closed_at) > epoch_us({_A}) - {s}000000 AND closed_at <= {_A}"


@query(f"""{CLASSIFIED} SELECT pair_id, CAST(coalesce(sum(k) FILTER (verdict = 'genuine' AND {_win(86400)}), 0) AS BIGINT) AS genuine_base_1d, CAST(coalesce(sum(k) FILTER (verdict = 'genuine' AND {_win(604800)}), 0) AS BIGINT) AS genuine_base_7d,
  CAST(coalesce(sum(k) FILTER (verdict = 'genuine' AND {_win(2592000)}), 0) AS BIGINT) AS genuine_base_30d, count(*) FILTER ({_win(900)}) AS oracle_trades FROM v WHERE closed_at <= {_A} GROUP BY 1""")
def trade_window_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trades.window_volumes(_classified(spark, sf_dir), anchor())
    return w.select("pair_id", *big("genuine_base_1d", "genuine_base_7d", "genuine_base_30d", "oracle_trades"))


_SENS = (60, 300, 600, 900, 1800, 3600, 7200, 14400, 43200, 86400)


@query(f"{CLASSIFIED} SELECT p.pair_id, w AS window_seconds, coalesce(CAST(sum(c100) FILTER (verdict = 'genuine' AND epoch_us(closed_at) > epoch_us({_A}) - CAST(w AS BIGINT) * 1000000 AND closed_at <= {_A}) AS DOUBLE), 0) / 100 AS genuine_quote, count(*) FILTER (epoch_us(closed_at) > epoch_us({_A}) - CAST(w AS BIGINT) * 1000000 AND closed_at <= {_A}) AS trades FROM v p, (VALUES {', '.join(f'({s})' for s in _SENS)}) x(w) GROUP BY ALL")
def trade_window_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.window_sensitivity(_classified(spark, sf_dir), anchor(), list(_SENS)).select("pair_id", "window_seconds", F.col("genuine_quote").cast("double").alias("genuine_quote"), "trades")


_EXTREMES = (1, 7, 30)


@query(f"""{CLASSIFIED}, days AS (SELECT pair_id, unnest(generate_series(min(day), DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day FROM v GROUP BY 1),
g AS (SELECT d.pair_id, d.day, coalesce(sum(k) FILTER (verdict = 'genuine'), 0) AS b, coalesce(sum(c100) FILTER (verdict = 'genuine'), 0) AS c FROM days d LEFT JOIN v ON d.pair_id = v.pair_id AND d.day = v.day GROUP BY ALL),
w AS ({' UNION ALL '.join(f'SELECT *, {n} AS days, sum(b) OVER x AS tr, count(*) OVER x AS m FROM g WINDOW x AS (PARTITION BY pair_id ORDER BY day ROWS {n - 1} PRECEDING)' for n in _EXTREMES)})
SELECT pair_id, days, CAST(min(tr) FILTER (m = days) AS BIGINT) AS least, CAST(max(tr) FILTER (m = days) AS BIGINT) AS greatest, round(CAST(sum(c) AS DOUBLE) / 100 / CAST(sum(b) AS DOUBLE), 6) AS weighted_price FROM w GROUP BY ALL""")
def trade_rolling_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades.rolling_extremes_of(_classified(spark, sf_dir), anchor(), list(_EXTREMES)).select("pair_id", "days", *big("least", "greatest"), r6("weighted_price"))


def _supporting_sql(anchors: str) -> str:
    """CTEs after TRADES that end in ``sup``: figures of each (pair_id, a) of the query ``anchors``, every trade judged anew for every anchor."""
    return f"""asked AS ({anchors}),
seen AS (SELECT asked.a, date_trunc('day', asked.a) AS today, t.*, t.closed_at >= date_trunc('day', asked.a) AS own FROM asked JOIN t ON asked.pair_id = t.pair_id AND t.closed_at <= asked.a),
span AS (SELECT *, CASE WHEN own THEN greatest(closed_at - INTERVAL 15 MINUTE, today) ELSE closed_at - INTERVAL 15 MINUTE END AS lo, CASE WHEN own THEN least(closed_at + INTERVAL 15 MINUTE, a) ELSE least(closed_at + INTERVAL 15 MINUTE, today - INTERVAL 1 MICROSECOND) END AS hi FROM seen),
near AS (SELECT q.trade_id, lo, hi, quantile_disc(b.n, 0.5 ORDER BY b.n DESC) AS ref FROM (SELECT DISTINCT pair_id, trade_id, lo, hi FROM span WHERE pool) q JOIN t b ON q.pair_id = b.pair_id AND NOT b.pool AND b.n > 0 AND b.closed_at BETWEEN lo AND hi GROUP BY ALL),
verdicts AS (SELECT span.*, CASE WHEN base = counter OR c100 < 1 OR base = span.pair_id OR counter = span.pair_id THEN 'excluded' WHEN pool AND ref IS NULL THEN 'unevaluated' WHEN pool AND n > ref THEN 'excluded' WHEN med IS NOT NULL AND n > 0 AND (n * 2 > med * 3 OR n * 3 < med * 2) THEN 'excluded' ELSE 'genuine' END AS verdict
  FROM span LEFT JOIN med ON span.pair_id = med.pair_id AND med.day = CASE WHEN own THEN CAST(today AS DATE) - 1 ELSE span.day END LEFT JOIN near ON span.trade_id = near.trade_id AND span.lo = near.lo AND span.hi = near.hi),
s0 AS (SELECT pair_id, a, min(closed_at) AS first, {', '.join(f"coalesce(sum(k) FILTER (verdict = 'genuine' AND closed_at > a - INTERVAL {d} DAY), 0) AS base_{d}d" for d in (1, 7, 30))},
  coalesce(sum(c100) FILTER (verdict = 'genuine' AND closed_at > a - INTERVAL 15 MINUTE), 0) AS oracle_c, count(*) FILTER (closed_at > a - INTERVAL 15 MINUTE) AS oracle_trades, CAST(sum(c100) FILTER (verdict = 'excluded') AS DOUBLE) AS ex, CAST(sum(c100) AS DOUBLE) AS total, max(closed_at) FILTER (verdict = 'genuine') AS last FROM verdicts GROUP BY ALL),
sup AS (SELECT *, first > date_trunc('day', a) - INTERVAL 1 DAY AS partial, first <= a - INTERVAL 30 DAY AS covers, CASE WHEN total > 0 THEN coalesce(ex, 0) * 100 / total END AS excluded_pct, CAST(floor((epoch_us(a) - epoch_us(last)) / 1000000) AS BIGINT) AS age, CAST(floor((epoch_us(a) - epoch_us(first)) / 86400000000) AS INTEGER) AS searched FROM s0)"""


_ASKED = "SELECT pair_id, max(closed_at) AS a FROM t GROUP BY pair_id, epoch_us(closed_at) // 21600000000 UNION ALL SELECT DISTINCT pair_id, TIMESTAMP '2024-02-05 12:00:00' FROM t"


@query(f"""WITH {TRADES}, {_supporting_sql(_ASKED)}, sp AS (SELECT asset_id, circulating FROM (SELECT CAST(c_nationkey AS BIGINT) AS asset_id, CAST(count(*) AS DOUBLE) * 1000 AS circulating FROM customer GROUP BY 1))
SELECT pair_id, CAST(floor(epoch(a) / 5) AS BIGINT) AS ledger_seq, CASE WHEN partial THEN 'the trades begin within the reference day, whose median would be partial' END AS refused, {', '.join(f"CASE WHEN NOT partial THEN CAST(base_{d}d AS BIGINT) END AS genuine_base_{d}d" for d in (1, 7, 30))},
  CASE WHEN NOT partial THEN CAST(oracle_c AS DOUBLE) / 100 END AS oracle_genuine_volume, CASE WHEN NOT partial THEN oracle_trades END AS oracle_trades, CASE WHEN NOT partial THEN round(excluded_pct, 6) END AS trades_excluded_pct, CASE WHEN NOT partial THEN age END AS last_genuine_age_seconds, CASE WHEN NOT partial THEN searched END AS searched_days,
  CASE WHEN NOT partial AND covers THEN round(base_30d / circulating, 9) END AS volume_to_supply_30d, CASE WHEN partial OR NOT covers THEN 'volume not measured' WHEN circulating IS NULL THEN 'supply not measured' END AS volume_to_supply_why FROM sup LEFT JOIN sp ON sup.pair_id = sp.asset_id""")
def trade_supporting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade figures of every pair at the last trade of each six hours, judged as of that ledger, set against a supply of 1,000 a holder."""
    log = written(A.trades(spark, sf_dir))
    asked = A.supporting_anchors(log)
    supply = A.holders(spark, sf_dir).groupBy(F.col("asset_id").alias("pair_id")).agg((F.count(F.lit(1)) * 1000).cast("decimal(30,7)").alias("circulating_supply"))
    found = supporting.supporting_at(log, A.issuers(spark, sf_dir), asked, asked.join(supply, "pair_id"))
    return found.select(
        "pair_id", "ledger_seq", "refused", *big("genuine_base_1d", "genuine_base_7d", "genuine_base_30d"), F.col("oracle_genuine_volume").cast("double").alias("oracle_genuine_volume"), *big("oracle_trades"), r6("trades_excluded_pct"),
        *big("last_genuine_age_seconds"), "searched_days", F.round("volume_to_supply_30d", 9).alias("volume_to_supply_30d"), "volume_to_supply_why",
    )


LEGS = f"""WITH {TRADES}, f AS (SELECT *, CASE WHEN lag(seller) OVER o IS DISTINCT FROM seller AND lag(seller) OVER o IS NOT NULL THEN 1 ELSE 0 END AS turn FROM t WHERE n > 0 WINDOW o AS (PARTITION BY pair_id, op ORDER BY fill)),
g AS (SELECT *, sum(turn) OVER (PARTITION BY pair_id, op ORDER BY fill ROWS UNBOUNDED PRECEDING) AS leg FROM f),
legs AS (SELECT pair_id, op, leg, min(closed_at) AS closed_at, count(*) AS fills, arg_min(n, fill) AS first_n, arg_max(n, fill) AS last_n, min(trade_id) AS first_trade, max(trade_id) AS last_trade, min(fill) AS first_fill, sum(c100) AS notional FROM g GROUP BY ALL)"""
BOUNDS = f"""{LEGS}, seq AS (SELECT *, lag(last_n) OVER o AS prev_n, lag(last_trade) OVER o AS prev_trade FROM legs WINDOW o AS (PARTITION BY pair_id ORDER BY closed_at, CAST(op AS VARCHAR), first_fill)),
b AS (SELECT pair_id, CAST(closed_at AS DATE) AS day, 'between_legs' AS kind, prev_trade AS from_trade, first_trade AS to_trade, prev_n AS f, first_n AS l, notional FROM seq WHERE prev_n IS NOT NULL AND prev_n <> first_n
  UNION ALL SELECT pair_id, CAST(closed_at AS DATE), 'within_leg', first_trade, last_trade, first_n, last_n, notional FROM seq WHERE first_n <> last_n)"""


@query(f"{LEGS} SELECT pair_id, first_trade, last_trade, fills, round(first_n / 100.0, 6) AS first_price, round(last_n / 100.0, 6) AS last_price, CAST(notional AS DOUBLE) / 100 AS notional FROM legs")
def trade_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.legs(A.trades(spark, sf_dir)).select("pair_id", "first_trade", "last_trade", "fills", r6("first_price"), r6("last_price"), F.col("notional").cast("double").alias("notional"))


@query(f"{BOUNDS} SELECT pair_id, kind, from_trade, to_trade, round(abs(CAST(l AS DOUBLE) / f - 1) + 1e-8, 5) AS delta, CAST(notional AS DOUBLE) / 100 AS bound FROM b")
def trade_implied_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.implied_bounds(A.trades(spark, sf_dir)).select("pair_id", "kind", "from_trade", "to_trade", F.round(F.col("delta").cast("double") + 1e-8, 5).alias("delta"), F.col("bound").cast("double").alias("bound"))


_RUNG_SQL = ", ".join(f"CAST(min(notional) FILTER (kind = '{k}' AND abs(l - f) * 100 >= {p} * f) AS DOUBLE) / 100 AS {k}_{r.replace('.', '_')}" for k in ("within_leg", "between_legs") for r, p in (("0.02", 2), ("0.05", 5), ("0.10", 10), ("0.5", 50)))


@query(f"""{BOUNDS}, d AS (SELECT pair_id, day, count(*) AS trades, CAST(sum(c100) AS DOUBLE) / 100 AS volume_quote FROM t GROUP BY ALL), m AS (SELECT pair_id, day, {_RUNG_SQL} FROM b GROUP BY ALL)
SELECT d.* EXCLUDE (day), CAST(d.day AS VARCHAR) AS day, m.* EXCLUDE (pair_id, day) FROM d LEFT JOIN m ON d.pair_id = m.pair_id AND d.day = m.day""")
def trade_daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.trades(spark, sf_dir)
    d = bounds.daily_rows(t, bounds.implied_bounds(t))
    return d.select("pair_id", F.col("day").cast("string").alias("day"), "trades", F.col("volume_quote").cast("double").alias("volume_quote"), *(F.col(f"{k}_{r}_bound").cast("double").alias(f"{k}_{r}") for k in ("within_leg", "between_legs") for r in (x.replace(".", "_") for x in bounds.RUNGS)))


HOLDERS = """h AS (SELECT CAST(c_nationkey AS BIGINT) AS asset_id, c_custkey AS account_id, CAST(round(c_acctbal * 100) AS BIGINT) * CASE WHEN c_custkey % 50 = 1 THEN 500 ELSE 1 END AS b FROM customer),
x AS (SELECT asset_id, min(account_id) AS account_id FROM h GROUP BY 1 UNION SELECT asset_id, account_id FROM h WHERE account_id % 97 = 0),
p AS (SELECT h.*, CASE WHEN x.account_id IS NOT NULL THEN 'excluded' WHEN b <= 0 THEN 'zero' END AS dropped FROM h LEFT JOIN x ON h.asset_id = x.asset_id AND h.account_id = x.account_id),
k AS (SELECT *, row_number() OVER w AS rank, sum(b) OVER (w ROWS UNBOUNDED PRECEDING) AS upto, sum(b) OVER (PARTITION BY asset_id) AS s FROM p WHERE dropped IS NULL WINDOW w AS (PARTITION BY asset_id ORDER BY b DESC, account_id))"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holders.population(A.holders(spark, sf_dir), A.holder_exclusions(spark, sf_dir)).where("dropped IS NULL").select("asset_id", "account_id", "balance")


@query(f"""WITH {HOLDERS} SELECT p.asset_id, count(*) FILTER (dropped IS NULL) AS population, count(*) FILTER (dropped = 'excluded') AS excluded_dropped, count(*) FILTER (dropped = 'zero') AS zero_dropped, round(CAST(sum(b) FILTER (dropped IS NULL) AS DOUBLE) / 100, 2) AS circulating_supply,
  round(CAST(max(b) FILTER (dropped IS NULL) AS DOUBLE) * 100 / CAST(sum(b) FILTER (dropped IS NULL) AS DOUBLE), 6) AS top1_pct, round((SELECT CAST(sum(b) AS DOUBLE) FROM k WHERE k.asset_id = p.asset_id AND rank <= 10) * 100 / CAST(sum(b) FILTER (dropped IS NULL) AS DOUBLE), 6) AS top10_pct,
  round(CAST(sum(CAST(b AS DECIMAL(38, 0)) * b) FILTER (dropped IS NULL) AS DOUBLE) * 10000 / (CAST(sum(b) FILTER (dropped IS NULL) AS DOUBLE) * CAST(sum(b) FILTER (dropped IS NULL) AS DOUBLE)), 4) AS hhi FROM p GROUP BY 1""")
def holder_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = holders.concentration(A.holders(spark, sf_dir), A.holder_exclusions(spark, sf_dir))
    return c.select("asset_id", "population", "excluded_dropped", "zero_dropped", F.round(F.col("circulating_supply").cast("double"), 2).alias("circulating_supply"), r6("top1_pct"), r6("top10_pct"), F.round("hhi", 4).alias("hhi"))


_RUNGS = """conc AS (SELECT asset_id, sum(b) AS s, max(b) AS top1, sum(b) FILTER (rank <= 10) AS top10 FROM k GROUP BY 1),
rung(d) AS (VALUES (2), (5), (10), (50), (100), (1000), (10000)),
bk AS (SELECT r.pair_id, d, coalesce(sum(amount * n) FILTER (side = 'ask' AND 200 * n <= p2 * (100 + d)), 0) AS buy, coalesce(sum(amount * n) FILTER (side = 'bid' AND 200 * n >= p2 * (100 - d)), 0) AS sell,
  coalesce(sum(amount * n) FILTER (side = 'ask' AND 200 * n < p2 * (100 + d)), 0) AS cost, coalesce(bool_or(side = 'ask' AND 200 * n >= p2 * (100 + d)), false) AS reach
  FROM ref r CROSS JOIN rung LEFT JOIN levels l ON r.pair_id = l.pair_id WHERE p2 IS NOT NULL GROUP BY ALL),
pl AS (SELECT r.pair_id, d, sum(CASE WHEN 200 * p.sn >= p2 * (100 + d) THEN 0 ELSE rb * (p.sn / 10000.0) * (sqrt(p2 * (100 + d) / (200.0 * p.sn)) - 1) / (1 - fee / 10000.0) END) AS lift,
  sum(CASE WHEN 200 * p.sn <= p2 * (100 - d) THEN 0 ELSE rb * (p.sn / 10000.0) * (1 - sqrt(greatest(p2 * (100 - d), 0) / (200.0 * p.sn))) * (1 - fee / 10000.0) END) AS sink
  FROM ref r JOIN pools p ON r.pair_id = p.pair_id AND rb > 0 CROSS JOIN rung WHERE p2 IS NOT NULL GROUP BY ALL),
both_sides AS (SELECT bk.pair_id, bk.d, buy / 10000.0 + coalesce(lift, 0) AS buy, sell / 10000.0 + coalesce(sink, 0) AS sell, cost, reach FROM bk LEFT JOIN pl ON bk.pair_id = pl.pair_id AND bk.d = pl.d),
w AS (SELECT pair_id, max(CASE WHEN d = 2 THEN least(buy, sell) END) AS depth2, max(CASE WHEN d = 5 THEN least(buy, sell) END) AS depth5, max(CASE WHEN d = 10 THEN sell END) AS sell10,
  max(CASE WHEN d = 50 AND reach THEN cost END) AS cost50, min(CASE WHEN d >= 50 AND reach THEN cost END) AS least_cost FROM both_sides GROUP BY 1),
traded AS (SELECT pair_id AS traded_id, age, searched, excluded_pct, CAST(oracle_c AS DOUBLE) / 100 AS oracle_volume FROM sup WHERE NOT partial),
known AS (SELECT ref.*, w.* EXCLUDE (pair_id), conc.* EXCLUDE (asset_id), traded.* EXCLUDE (traded_id) FROM ref LEFT JOIN w ON ref.pair_id = w.pair_id LEFT JOIN conc ON ref.pair_id % 25 = conc.asset_id LEFT JOIN traded ON ref.pair_id % 10 = traded_id)"""
#: SQL of each flag over ``known``: when it is unevaluated, and when it is triggered otherwise.
_FLAG_SQL = {
    "NO_EXECUTABLE_PRICE": ("false", "p2 IS NULL"),
    "ZERO_DEPTH_2PCT": ("p2 IS NULL", "depth2 = 0"),
    "MANIPULATION_CHEAP": ("p2 IS NULL", "least_cost < 100000000"),
    "MANIPULATION_RATIO_LOW": ("p2 IS NULL OR s IS NULL", "least_cost / 100.0 < (s / 100.0) * (p2 / 20000.0) * 0.1"),
    "PRICE_SOURCE_CONFLICT": ("sn IS NOT NULL AND mid2 IS NULL", "abs(mid2 - 2 * sn) * 100 > 20 * sn"),
    "SPREAD_EXTREME": ("mid2 IS NULL OR p2 IS NULL", "(ask - bid) * 200 > 20 * p2"),
    "NO_GENUINE_TRADE_30D": ("age IS NULL AND coalesce(searched, 0) < 30", "age > 30 * 86400 OR age IS NULL"),
    "HOLDER_CONCENTRATION_EXTREME": ("s IS NULL", "top1 * 100 > 50 * s"),
    "THIN_DEPTH_5PCT": ("p2 IS NULL", "depth5 < 50000"),
    "NO_GENUINE_TRADE_7D": ("age IS NULL AND coalesce(searched, 0) < 7", "age > 7 * 86400 OR age IS NULL"),
    "HOLDER_CONCENTRATION_HIGH": ("s IS NULL", "top10 * 100 > 80 * s"),
    "WASH_TRADE_SUSPECTED": ("excluded_pct IS NULL", "excluded_pct > 50"),
}
_STATES = ", ".join(f"CASE WHEN {u} THEN 'unevaluated' WHEN {t} THEN 'triggered' ELSE 'clear' END AS {f}" for f, (u, t) in _FLAG_SQL.items())


def _listed(state: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {f} = '{state}' THEN '{f}' END" for f, _ in risk.FLAGS) + ")"


def _any(state: str, *tiers: str) -> str:
    return "(" + " OR ".join(f"{f} = '{state}'" for f, t in risk.FLAGS if t in tiers) + ")"


@query(f"""{PRICED}, {HOLDERS}, {TRADES}, {_supporting_sql(f"SELECT DISTINCT pair_id, {_A} AS a FROM t")}, {_RUNGS}, st AS (SELECT *, {_STATES} FROM known)
SELECT pair_id, CAST(1000 AS BIGINT) AS ledger_seq, price_source, CASE WHEN {_any("triggered", "CRITICAL")} THEN 'CRITICAL' WHEN {_any("triggered", "HIGH")} THEN 'HIGH' WHEN {_any("triggered", "MEDIUM")} THEN 'MEDIUM' ELSE 'LOW' END AS band,
  CASE WHEN {_any("unevaluated", "HIGH", "CRITICAL")} THEN 'partial' ELSE 'full' END AS band_confidence, {_listed("triggered")} AS flags, {_listed("unevaluated")} AS unevaluated_flags,
  round(least(sell10 * 0.5, cost50 / 10000.0 * 0.25) + 1e-6, 2) AS max_safe, round(cost50 / 10000.0 + oracle_volume + 1e-6, 2) AS oracle_total, CASE WHEN oracle_volume > 0 THEN round(cost50 / 10000.0 / oracle_volume + 1e-8, 5) END AS oracle_ratio,
  CASE WHEN p2 IS NULL THEN 'no manipulation rung at the critical delta' WHEN oracle_volume IS NULL THEN 'genuine volume was not measured at this ledger' WHEN cost50 IS NULL THEN 'unreachable' END AS oracle_reason FROM st""")
def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full risk record of every pair with holder concentration and trade figures attached; pool terms take square roots, so the ceiling has two decimals."""
    r = risk.asset_risk(*_books(spark, sf_dir), _supporting(spark, sf_dir))
    return r.select("pair_id", "ledger_seq", "price_source", "band", "band_confidence", F.array_join("flags", ",").alias("flags"), F.array_join("unevaluated_flags", ",").alias("unevaluated_flags"), F.round(F.col("collateral.max_safe").cast("double") + 1e-6, 2).alias("max_safe"),
                    F.round(F.col("oracle.total").cast("double") + 1e-6, 2).alias("oracle_total"), F.round(F.col("oracle.ratio").cast("double") + 1e-8, 5).alias("oracle_ratio"), F.col("oracle.reason").alias("oracle_reason"))


@query(f"WITH {HOLDERS} SELECT asset_id, account_id, CAST(rank AS BIGINT) AS rank, round(CAST(b AS DOUBLE) * 100 / CAST(s AS DOUBLE), 6) AS share_pct, round(CAST(upto AS DOUBLE) * 100 / CAST(s AS DOUBLE), 6) AS cumulative_pct FROM k")
def holder_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holders.ranking(_kept(spark, sf_dir)).select("asset_id", "account_id", *big("rank"), r6("share_pct"), r6("cumulative_pct"))


@query("SELECT cap, count(*) FILTER (pages <= cap) AS covered, count(*) AS assets, CAST(sum(least(pages, cap)) AS BIGINT) AS pages_read FROM (SELECT c_nationkey, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM customer GROUP BY 1), (VALUES (1), (2), (5), (25), (2000)) t(cap) GROUP BY 1")
def holder_page_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holders.page_cap_coverage(A.holders(spark, sf_dir), [1, 2, 5, 25, 2000], 20)


_EARLY = "2024-01-11 00:00:00"


@query(f"""WITH {TRADES}, s AS (SELECT pair_id, CAST(base AS VARCHAR) AS account_id, 1 AS b, 0 AS c, CASE WHEN closed_at < TIMESTAMP '{_EARLY}' THEN 1 ELSE 2 END AS m FROM t UNION ALL SELECT pair_id, CAST(counter AS VARCHAR), 0, 1, CASE WHEN closed_at < TIMESTAMP '{_EARLY}' THEN 1 ELSE 2 END FROM t)
SELECT pair_id, account_id, CAST(sum(b) AS BIGINT) AS as_base, CAST(sum(c) AS BIGINT) AS as_counter, CASE bit_or(m) WHEN 1 THEN 'early' WHEN 2 THEN 'late' ELSE 'early + late' END AS window_label FROM s GROUP BY ALL""")
def trader_side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, cut = F.col("closed_at"), F.lit(_EARLY).cast("timestamp")
    return holders.side_counts(A.trades(spark, sf_dir), [("early", at < cut), ("late", at >= cut)]).select("pair_id", "account_id", *big("as_base", "as_counter"), "window_label")


@query(f"""WITH {TRADES}, fd AS (SELECT CAST(c_custkey AS BIGINT) AS a, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS f FROM customer), j AS (SELECT t.*, x.f AS xf, y.f AS yf FROM t LEFT JOIN fd x ON base = x.a LEFT JOIN fd y ON counter = y.a)
SELECT pair_id, count(*) AS trades, count(*) FILTER (xf IS NULL OR yf IS NULL) AS unknown, count(*) FILTER (xf = yf) AS shared, round(coalesce(CAST(sum(c100) FILTER (xf = yf) AS DOUBLE), 0) * 100 / CAST(sum(c100) FILTER (xf IS NOT NULL AND yf IS NOT NULL) AS DOUBLE), 6) AS shared_pct FROM j GROUP BY 1""")
def shared_funder_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = accounts.funders(A.account_first_ops(spark, sf_dir))
    return accounts.shared_funder_trades(A.trades(spark, sf_dir), f).select("pair_id", "trades", "unknown", "shared", r6("shared_pct"))


@query("WITH f AS (SELECT c_nationkey, count(*) AS accounts FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1) SELECT accounts, count(*) AS funders FROM f GROUP BY 1")
def funder_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.funder_histogram(accounts.funders(A.account_first_ops(spark, sf_dir)))


MAKERS = """g AS (SELECT user_id AS account_id, user_id % 10 AS pair_id, event_id // 2 AS tx, min(ts) AS at_, count(*) FILTER (event_type IN ('error', 'view')) AS z, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT account_id, pair_id, tx, at_, CASE WHEN z = n THEN 'delete' ELSE 'post' END AS kind FROM g WHERE z = n OR z = 0),
w AS (SELECT *, lag(kind) OVER o AS before, min(CASE WHEN kind = 'post' THEN at_ END) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close_at FROM m WINDOW o AS (PARTITION BY account_id, pair_id ORDER BY at_, tx)),
a AS (SELECT account_id, pair_id, at_, close_at, (epoch_us(close_at) - epoch_us(at_)) / 1000000.0 AS seconds FROM w WHERE kind = 'delete' AND before = 'post')"""


@query(f"WITH {MAKERS} SELECT account_id, pair_id, count(seconds) AS windows, count(*) FILTER (seconds IS NULL) AS unclosed, round(min(seconds), 3) AS shortest, round(quantile_cont(seconds, 0.5), 3) AS median, round(max(seconds), 3) AS longest FROM a GROUP BY ALL")
def maker_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = accounts.absence_statistics(accounts.absence_windows(accounts.maker_events(A.maker_ops(spark, sf_dir))), F.lit(30 * 86400))
    return s.select("account_id", "pair_id", "windows", "unclosed", *(F.round(F.col(c).cast("double"), 3).alias(c) for c in ("shortest", "median", "longest")))


@query(f"""WITH {MAKERS}, mm AS (SELECT pair_id, at_, hour(at_) * 60 + minute(at_) AS mi FROM a), c AS (SELECT pair_id, mi, count(*) AS n FROM mm GROUP BY ALL), o AS (SELECT pair_id, mi AS modal FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, mi) AS r FROM c) WHERE r = 1)
SELECT mm.pair_id, CAST(modal AS INTEGER) AS modal, count(*) AS windows, count(DISTINCT CAST(at_ AS DATE)) AS days FROM mm JOIN o ON mm.pair_id = o.pair_id WHERE least(abs(mi - modal), 1440 - abs(mi - modal)) <= 1 GROUP BY ALL""")
def maker_modal_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.modal_minute(accounts.absence_windows(accounts.maker_events(A.maker_ops(spark, sf_dir))))


REPLAY = """ev AS (SELECT l_orderkey AS o, (date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)))::BIGINT AS d, l_linenumber * 1000000 + l_suppkey AS k, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 1 ELSE 0 END AS cls, CASE WHEN l_returnflag = 'R' THEN l_partkey % 1000 ELSE 0 END AS fi,
  l_returnflag AS f, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) * 10 END AS q10 FROM lineitem)"""


def _rebuilt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Offer versions, and every (pair, ledger) with an operation or a trade of the pair."""
    ops, fills = A.offer_ops(spark, sf_dir), A.offer_trades(spark, sf_dir)
    at = X.toid_ledger(F.col("toid")).alias("ledger_seq")
    return replay.versions(replay.events(ops, fills)), ops.select("pair_id", at).union(fills.select("pair_id", at)).distinct()


_VERSIONS = """ev AS (SELECT l_orderkey AS o, l_orderkey % 50 AS pair_id, (date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)))::BIGINT AS d, l_linenumber * 1000000 + l_suppkey AS k, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS cls, CASE WHEN l_returnflag = 'R' THEN l_partkey % 1000 ELSE 0 END AS fi,
  l_returnflag AS f, CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side, CAST(l_quantity AS BIGINT) AS q, l_suppkey + 1 AS n, CAST(round(l_discount * 100) AS BIGINT) + 1 AS pd_ FROM lineitem),
e AS (SELECT *, count(*) FILTER (f <> 'R') OVER (w ROWS UNBOUNDED PRECEDING) AS epoch, lead(d) OVER w AS until FROM ev WHERE o <> 0 WINDOW w AS (PARTITION BY o ORDER BY d, k, cls, fi)),
v AS (SELECT pair_id, d, until, max(side) FILTER (f = 'A') OVER w AS side, max(n) FILTER (f = 'A') OVER w AS pn, max(pd_) FILTER (f = 'A') OVER w AS pd, max(q) FILTER (f = 'A') OVER w * 10 - coalesce(sum(q) FILTER (f = 'R') OVER w, 0) AS tenths FROM e WINDOW w AS (PARTITION BY o, epoch ORDER BY d, k, cls, fi ROWS UNBOUNDED PRECEDING))"""


@query("""WITH ev AS (SELECT l_orderkey AS o, l_orderkey % 50 AS pair_id, (date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)))::BIGINT AS d, l_linenumber * 1000000 + l_suppkey AS k, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS cls, CASE WHEN l_returnflag = 'R' THEN l_partkey % 1000 ELSE 0 END AS fi,
  l_returnflag AS f, CASE WHEN l_linestatus = 'F' THEN 'bid' ELSE 'ask' END AS side, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
e AS (SELECT *, count(*) FILTER (f <> 'R') OVER (w ROWS UNBOUNDED PRECEDING) AS epoch, lead(d) OVER w AS until FROM ev WHERE o <> 0 WINDOW w AS (PARTITION BY o ORDER BY d, k, cls, fi)),
v AS (SELECT pair_id, d, until, max(side) FILTER (f = 'A') OVER w AS side, max(q) FILTER (f = 'A') OVER w * 10 - coalesce(sum(q) FILTER (f = 'R') OVER w, 0) AS tenths FROM e WINDOW w AS (PARTITION BY o, epoch ORDER BY d, k, cls, fi ROWS UNBOUNDED PRECEDING)),
s AS (SELECT * FROM v WHERE tenths > 0 AND (until IS NULL OR until > d)),
t AS (SELECT DISTINCT pair_id, d AS ledger_seq FROM ev)
SELECT t.pair_id, t.ledger_seq, side, count(*) AS offers, CAST(sum(tenths) AS DOUBLE) / 10 AS amount FROM t JOIN s ON t.pair_id = s.pair_id AND s.d <= t.ledger_seq AND (until IS NULL OR until > t.ledger_seq) GROUP BY ALL""")
def replay_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resting offers and their amount on each side of every pair, at every ledger with an operation or a trade of the pair."""
    return replay.resting_totals(*_rebuilt(spark, sf_dir)).select("pair_id", "ledger_seq", "side", "offers", F.col("amount").cast("double").alias("amount"))


#: Prices as whole numbers of 1e-18, rounded as DECIMAL division rounds: half up at 19 places, then at 18.
_E18 = "CAST(({n}::HUGEINT * 20000000000000000000 + {d}) // (2 * {d}) + 5 AS HUGEINT) // 10"
_TIMES = "(p0 * {x} + 5000) // 10000"


def _up(d: str) -> str:
    return _TIMES.format(x=10000 + int(float(d) * 10000))


_NEAR, _FAR = book.rungs_of(DEFAULT)
_NAMED = {d: d.replace(".", "_") for d in (*_NEAR, *_FAR)}
SERIES = f"""{_VERSIONS}, s AS (SELECT * FROM v WHERE tenths > 0 AND (until IS NULL OR until > d)),
t AS (SELECT DISTINCT pair_id, d AS ledger_seq FROM ev),
lv AS (SELECT t.pair_id, ledger_seq, side, CASE WHEN side = 'bid' THEN pd ELSE pn END AS n, CASE WHEN side = 'bid' THEN pn ELSE pd END AS d, CASE WHEN side = 'bid' THEN round(tenths / 10.0 * pn / pd, 7) ELSE tenths / 10.0 END AS amount
  FROM t JOIN s ON t.pair_id = s.pair_id AND s.d <= t.ledger_seq AND (until IS NULL OR until > t.ledger_seq)),
lm AS (SELECT pair_id, ledger_seq, side, n, d, {_E18.format(n="n", d="d")} AS price, sum(amount) AS amount, sum(amount) * max(n) / max(d) AS quote, count(*) AS offers FROM lv GROUP BY ALL),
top AS (SELECT t.pair_id, t.ledger_seq, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask, max(price) FILTER (side = 'ask') AS high, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks, CAST(coalesce(sum(offers), 0) AS BIGINT) AS offers FROM t LEFT JOIN lm ON t.pair_id = lm.pair_id AND t.ledger_seq = lm.ledger_seq GROUP BY ALL),
ref AS (SELECT *, (bid + ask + 1) // 2 AS p0 FROM top),
rungs AS (SELECT ref.pair_id, ref.ledger_seq, {', '.join(f"sum(quote) FILTER (side = 'ask' AND price <= {_up(d)}) AS buy{_NAMED[d]}, sum(quote) FILTER (side = 'bid' AND price >= {_up('-' + d)}) AS sell{_NAMED[d]}" for d in _NEAR)},
  {', '.join(f"sum(quote) FILTER (side = 'ask' AND price < {_up(d)}) AS cost{_NAMED[d]}, coalesce(max(high) >= max({_up(d)}), false) AS reach{_NAMED[d]}" for d in _FAR)}, sum(quote) FILTER (side = 'ask' AND price < high) AS below
  FROM ref LEFT JOIN lm ON ref.pair_id = lm.pair_id AND ref.ledger_seq = lm.ledger_seq GROUP BY ALL),
known AS (SELECT ref.*, rungs.* EXCLUDE (pair_id, ledger_seq), {', '.join(f"coalesce(buy{_NAMED[d]}, 0) AS b{_NAMED[d]}, coalesce(sell{_NAMED[d]}, 0) AS s{_NAMED[d]}" for d in _NEAR)}, {', '.join(f"coalesce(cost{_NAMED[d]}, 0) AS c{_NAMED[d]}" for d in _FAR)} FROM ref JOIN rungs ON ref.pair_id = rungs.pair_id AND ref.ledger_seq = rungs.ledger_seq),
lows AS (SELECT *, least({', '.join(f"CASE WHEN reach{_NAMED[d]} THEN c{_NAMED[d]} END" for d in _FAR)}) AS least_cost FROM known),
states AS (SELECT *, p0 IS NULL AS no_price, p0 IS NOT NULL AND (b0_02 < 1e-9 OR s0_02 < 1e-9) AS zero_depth, p0 IS NOT NULL AND coalesce(least_cost < 10000, false) AS cheap, p0 IS NOT NULL AND (ask - bid) * 100 > 20 * p0 AS spread, p0 IS NOT NULL AND least(b0_05, s0_05) < 50000 AS thin FROM lows)"""


@query(f"""WITH {SERIES} SELECT pair_id, ledger_seq, bids, asks, offers, coalesce(bid >= ask, false) AS crossed, CASE WHEN p0 IS NULL THEN 'none' ELSE 'book' END AS price_source, round(p0 / 1e18, 9) AS p0, round((ask - bid) / p0::DOUBLE * 100, 4) AS spread_pct,
  {', '.join(f"CASE WHEN p0 IS NOT NULL THEN round(b{_NAMED[d]} + 1e-7, 4) END AS depth_buy_{_NAMED[d]}, CASE WHEN p0 IS NOT NULL THEN round(s{_NAMED[d]} + 1e-7, 4) END AS depth_sell_{_NAMED[d]}" for d in _NEAR)},
  {', '.join(f"CASE WHEN p0 IS NOT NULL THEN round(c{_NAMED[d]} + 1e-7, 4) END AS mc_cost_{_NAMED[d]}, CASE WHEN p0 IS NOT NULL THEN reach{_NAMED[d]} END AS mc_reachable_{_NAMED[d]}" for d in _FAR)},
  round(high / 1e18, 9) AS max_reachable_price, CASE WHEN high IS NOT NULL THEN round(coalesce(below, 0) + 1e-7, 4) END AS cost_to_max_reachable,
  CASE WHEN no_price OR zero_depth OR cheap THEN 'CRITICAL' WHEN spread THEN 'HIGH' WHEN thin THEN 'MEDIUM' ELSE 'LOW' END AS band,
  concat_ws(',', CASE WHEN no_price THEN 'NO_EXECUTABLE_PRICE' END, CASE WHEN zero_depth THEN 'ZERO_DEPTH_2PCT' END, CASE WHEN cheap THEN 'MANIPULATION_CHEAP' END, CASE WHEN spread THEN 'SPREAD_EXTREME' END, CASE WHEN thin THEN 'THIN_DEPTH_5PCT' END) AS flags FROM states""")
def series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book-series report: price, ladders, flags and band of the rebuilt book of every pair at every ledger with an operation or a trade of the pair."""
    found, targets = _rebuilt(spark, sf_dir)
    rows = sinks.ladder_columns(series.series_rows(found, targets))
    four = [c for c in rows.columns if c.startswith(("depth_", "mc_cost_"))] + ["cost_to_max_reachable"]
    return rows.select(
        "pair_id", "ledger_seq", *big("bids", "asks", "offers"), "crossed", "price_source", F.round(F.col("p0").cast("double"), 9).alias("p0"), F.round(F.col("spread_pct").cast("double"), 4).alias("spread_pct"),
        *(F.round(F.col(f"`{c}`").cast("double") + 1e-7, 4).alias(c.replace(".", "_")) for c in four), *(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in rows.columns if c.startswith("mc_reachable_")),
        F.round(F.col("max_reachable_price").cast("double"), 9).alias("max_reachable_price"), "band", F.array_join("flags", ",").alias("flags"),
    )


@query(f"WITH {REPLAY} SELECT count(DISTINCT o) AS missing FROM ev WHERE f = 'R' AND o <> 0 AND o NOT IN (SELECT o FROM ev WHERE f <> 'R')")
def replay_missing_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.missing_offers(A.offer_ops(spark, sf_dir), A.offer_trades(spark, sf_dir)).agg(F.count(F.lit(1)).alias("missing"))


METRICS = """m AS (SELECT o_orderkey AS id, o_custkey % 50 AS pair_id, (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)))::BIGINT * 1000000 + o_orderkey AS ledger_seq, o_orderdate AS at_, CASE WHEN o_orderstatus = 'F' THEN 'offers-implied' ELSE 'horizon' END AS src,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS band FROM orders)"""


@query(f"WITH {METRICS} SELECT pair_id, id, ledger_seq, src AS data_source, band FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ledger_seq DESC, src, id) AS r FROM m) WHERE r = 1")
def metrics_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(A.metrics(spark, sf_dir)).select("pair_id", "id", "ledger_seq", "data_source", "band")


@query(f"WITH {METRICS} SELECT pair_id, id, ledger_seq FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ledger_seq DESC, id DESC) AS r FROM m WHERE src = 'horizon') WHERE r <= 5")
def metrics_history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.history_latest(A.metrics(spark, sf_dir), "horizon", 5).select("pair_id", "id", "ledger_seq")


@query(f"""WITH {METRICS}, l AS (SELECT pair_id, CAST(date_trunc('day', at_) AS TIMESTAMP) AS b, max(ledger_seq) AS s FROM m WHERE src = 'horizon' GROUP BY ALL), g AS (SELECT *, lag(b) OVER (PARTITION BY pair_id ORDER BY b) AS pb FROM l)
SELECT pair_id, b AS bucket, false AS is_gap, CAST(s AS DOUBLE) AS ledger_seq FROM g UNION ALL SELECT pair_id, pb + INTERVAL 1 DAY, true, NULL FROM g WHERE date_diff('day', pb, b) > 1""")
def metrics_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = store.downsample(A.metrics(spark, sf_dir).where("data_source = 'horizon'"), "day")
    return d.select("pair_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "is_gap", F.col("ledger_seq").cast("double").alias("ledger_seq"))


@query(f"WITH {METRICS} SELECT pair_id, src AS data_source, min(ledger_seq) AS from_ledger, max(ledger_seq) AS to_ledger, count(*) AS points FROM m GROUP BY ALL")
def metrics_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.history_range(A.metrics(spark, sf_dir))

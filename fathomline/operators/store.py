"""Metric tables: latest and historical reads, downsampling, summaries, monitored pairs, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.risk import rung

#: Rows that a history read returns at most when it is asked for a page.
PAGE_LIMIT = 5000


def latest(metrics: DataFrame, version: str | None = None) -> DataFrame:
    """The newest row of each pair by ledger; of equal ledgers the first source, then the first id. One aggregation, no sort."""
    m = metrics if version is None else metrics.where(F.col("methodology_version") == version)
    row = F.struct(*m.columns)
    return m.groupBy("pair_id").agg(F.min_by(row, F.struct((-F.col("ledger_seq")).alias("l"), "data_source", "id")).alias("r")).select("r.*")


def at_ledger(metrics: DataFrame, pair_id, ledger_seq: int, version: str, source: str) -> DataFrame:
    return metrics.where((F.col("pair_id") == pair_id) & (F.col("ledger_seq") == ledger_seq) & (F.col("methodology_version") == version) & (F.col("data_source") == source))


def history(metrics: DataFrame, source: str, first: int | None = None, last: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows of one source in an inclusive ledger range, ascending; a limit only where one is asked for."""
    m = metrics.where(F.col("data_source") == source)
    m = m if first is None else m.where(F.col("ledger_seq") >= first)
    m = m if last is None else m.where(F.col("ledger_seq") <= last)
    m = m.orderBy("pair_id", "ledger_seq", "id")
    return m if limit is None else m.limit(min(limit, PAGE_LIMIT))


def history_latest(metrics: DataFrame, source: str, count: int) -> DataFrame:
    """The newest ``count`` rows of each pair, ascending."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("ledger_seq"), F.desc("id"))
    return metrics.where(F.col("data_source") == source).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r").orderBy("pair_id", "ledger_seq", "id")


def latest_summaries(metrics: DataFrame, pairs: DataFrame, band: str | None = None, flag: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest row of every active pair with the total, filtered by band and flag, by code, issuer (nulls first) and quote."""
    m = latest(metrics).join(pairs.where("active"), "pair_id")
    m = m if band is None else m.where(F.col("band") == band)
    m = m if flag is None else m.where(F.array_contains("flags", flag))
    total = m.agg(F.count(F.lit(1)).alias("total"))
    out = m.join(F.broadcast(total), F.lit(True)).orderBy("code", F.asc_nulls_first("issuer"), "quote", "pair_id").offset(offset)  # total is one row
    return out if limit is None else out.limit(limit)


def downsample(rows: DataFrame, resolution: str) -> DataFrame:
    """The last row of each pair and bucket ('hour' or 'day'), and a gap row where a bucket before it is missing."""
    if resolution not in ("hour", "day"):
        raise ValueError(f"unknown resolution {resolution}")
    r = rows.withColumn("bucket", F.date_trunc(resolution, F.col("ledger_closed_at")))
    last = r.groupBy("pair_id", "bucket").agg(F.max_by(F.struct("ledger_seq", "ledger_closed_at", "id"), F.struct("ledger_seq", "id")).alias("r"))
    step = 3600 if resolution == "hour" else 86400
    before = F.lag("bucket").over(Window.partitionBy("pair_id").orderBy("bucket"))
    gap = F.coalesce((F.unix_micros("bucket") - F.unix_micros(before)) / 1_000_000 > step, F.lit(False))
    rows_out = last.withColumn("_gap", gap).withColumn("_from", before)
    point = F.struct(F.col("bucket"), F.lit(False).alias("is_gap"), F.col("r.ledger_seq").alias("ledger_seq"))
    hole = F.struct((F.col("_from") + F.expr(f"interval {step} seconds")).alias("bucket"), F.lit(True).alias("is_gap"), F.lit(None).cast("bigint").alias("ledger_seq"))
    return rows_out.select("pair_id", F.explode(F.when(F.col("_gap"), F.array(hole, point)).otherwise(F.array(point))).alias("p")).select("pair_id", "p.*")


def history_range(rows: DataFrame) -> DataFrame:
    """First and last ledger and points of each stored series."""
    return rows.groupBy("pair_id", "data_source").agg(F.min("ledger_seq").alias("from_ledger"), F.max("ledger_seq").alias("to_ledger"), F.count(F.lit(1)).alias("points"))


def staleness_seconds() -> Column:
    """Seconds between ledger close and computation, at least 0; 0 for rebuilt sources."""
    age = F.floor((F.unix_micros("computed_at") - F.unix_micros("ledger_closed_at")) / 1_000_000)
    return F.when(F.col("data_source") == "horizon", F.greatest(age, F.lit(0))).otherwise(F.lit(0))


def health(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: status ('degraded' without a run, with an unfinished or a failed one), counts of the last run, newest ledger."""
    last = runs.agg(F.max_by(F.struct("finished_at", "ok", "failed"), F.struct("started_at", "id")).alias("r"))
    bad = F.col("r").isNull() | F.col("r.finished_at").isNull() | (F.col("r.failed") > 0)
    newest = metrics.agg(F.max("ledger_seq").alias("newest_ledger"))
    return last.select(F.when(bad, "degraded").otherwise("ok").alias("status"), F.col("r.ok").alias("ok"), F.col("r.failed").alias("failed")).join(F.broadcast(newest), F.lit(True))  # one row each


def primary_pair(pairs: DataFrame) -> DataFrame:
    """For each asset its only pair, or the one quoted in USDC; several without USDC give the candidates instead."""
    usdc = F.col("quote").startswith("USDC")
    g = pairs.groupBy("code", "issuer").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(usdc, F.struct("quote", "pair_id"))).alias("u"), F.min("pair_id").alias("only"), F.sort_array(F.collect_set("quote")).alias("quotes"))
    return g.select("code", "issuer", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("u.pair_id")).alias("pair_id"), F.when((F.col("n") > 1) & F.col("u").isNull(), F.col("quotes")).alias("candidates"))


def pairs_for_asset(pairs: DataFrame, code: str, issuer: str | None) -> DataFrame:
    return pairs.where((F.col("code") == code) & F.col("issuer").eqNullSafe(F.lit(issuer))).orderBy(F.asc_nulls_first("quote"))


def latest_reading(readings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest reading of each key by the order columns, descending in turn."""
    return readings.groupBy(*key).agg(F.max_by(F.struct(*readings.columns), F.struct(*order)).alias("r")).select("r.*")


def last_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("kind").agg(F.max_by(F.struct(*(c for c in runs.columns if c != "kind")), F.struct("started_at", "id")).alias("r")).select("kind", "r.*")


def duplicate_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, keep): the smallest id among pairs with one null-safe key."""
    keep = F.min("pair_id").over(Window.partitionBy("code", "issuer", "quote"))
    return pairs.select("pair_id", keep.alias("keep"))


def merge_duplicates(pairs: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs without duplicates, and metrics pointed at the kept ids unless that would collide with a row there."""
    d = duplicate_pairs(pairs)
    kept = pairs.join(d.where("pair_id = keep").select("pair_id"), "pair_id", "left_semi")
    m = metrics.join(d, "pair_id", "left").withColumn("_to", F.coalesce("keep", "pair_id"))
    first = F.row_number().over(Window.partitionBy("_to", "ledger_seq", "methodology_version", "data_source").orderBy((F.col("pair_id") != F.col("_to")).cast("int"), "pair_id", "id"))
    moved = m.withColumn("_r", first).where(F.col("_r") == 1)
    return kept, moved.select(*(F.col("_to").alias("pair_id") if c == "pair_id" else F.col(c) for c in metrics.columns))


def scan_summary(results: DataFrame) -> DataFrame:
    """Reasons of a scan round (reason null: ok) with their counts, most frequent first."""
    return results.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("pairs"), "reason")


def summary_point(metrics: DataFrame) -> DataFrame:
    """The list view: buy depth at 5 % and the book cost at 0.5, null where unreachable."""
    m = rung(F.col("manipulation"), "0.5")
    return metrics.select("pair_id", "ledger_seq", "band", "flags", rung(F.col("depth"), "0.05")["buy_side"].alias("depth_5pct"), F.when(m["book_reachable"], m["book_cost"]).alias("manipulation_cost"))


def history_point(metrics: DataFrame) -> DataFrame:
    m = rung(F.col("manipulation"), "0.5")
    depth = [rung(F.col("depth"), d)["buy_side"].alias(f"depth_{n}") for d, n in (("0.02", "2pct"), ("0.05", "5pct"), ("0.10", "10pct"))]
    return metrics.select("pair_id", "ledger_seq", "ledger_closed_at", "p0", *depth, F.when(m["book_reachable"], m["book_cost"]).alias("manipulation_cost"))


def full_record(metrics: DataFrame) -> DataFrame:
    """Every column, arrays empty rather than null, decimals as strings, one JSON text a row."""
    cols = []
    for f in metrics.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        cols.append((F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else c.cast("string") if kind.startswith("decimal") else c).alias(f.name))
    return metrics.select("pair_id", "ledger_seq", F.to_json(F.struct(*cols)).alias("record"))


def monitored(pairs: DataFrame, active_only: bool = True) -> DataFrame:
    p = pairs.where("active") if active_only else pairs
    return p.orderBy("code", F.asc_nulls_first("issuer"), "quote")


def insert_new(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key is not stored yet, one a key: what an idempotent insert appends."""
    return rows.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def upsert_pairs(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Pairs with changes applied: an empty note keeps the old one, a named pair becomes active."""
    key = ["code", "issuer", "quote"]
    a, b = stored.alias("a"), changes.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = a.join(b, on[0] & on[1] & on[2], "full_outer")
    return both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key), F.coalesce(F.nullif(F.col("b.note"), F.lit("")), F.col("a.note")).alias("note"), (F.col("b.code").isNotNull() | F.coalesce("a.active", F.lit(False))).alias("active"))


def set_active(pairs: DataFrame, ids: list, active: bool) -> DataFrame:
    return pairs.withColumn("active", F.when(F.col("pair_id").isin(ids), F.lit(active)).otherwise(F.col("active")))


def _first_broken(columns: list[str], rules: list[tuple[str, tuple[str, ...], Column]]) -> Column:
    """Why a row is refused: the first rule that it breaks, of those whose columns the table has; null for a good row."""
    held = [F.when(broken, F.lit(why)) for why, needed, broken in rules if {*needed} <= {*columns}]
    return F.coalesce(*held, F.lit(None).cast("string"))


def risk_violation(columns: list[str]) -> Column:
    c = F.col
    return _first_broken(columns, [
        ("no source but a price", ("price_source", "p0"), (c("price_source") == "none") & c("p0").isNotNull()),
        ("a source but no price", ("price_source", "p0"), (c("price_source") != "none") & c("p0").isNull()),
        ("depth without a price", ("price_source", "depth"), (c("price_source") == "none") & c("depth").isNotNull()),
        ("a spread without a price", ("price_source", "spread_pct"), (c("price_source") == "none") & c("spread_pct").isNotNull()),
        ("unknown price source", ("price_source",), ~c("price_source").isin("book", "pool", "none")),
        ("unknown band", ("band",), ~c("band").isin("LOW", "MEDIUM", "HIGH", "CRITICAL")),
        ("unknown data source", ("data_source",), ~c("data_source").isin("horizon", "hubble", "offers-implied", "trades-implied")),
        ("a ledger that is not positive", ("ledger_seq",), ~(c("ledger_seq") > 0) | c("ledger_seq").isNull()),
    ])


def risk_violations(metrics: DataFrame) -> DataFrame:
    """Rows whose parts contradict each other, with the reason; must be empty before a store."""
    return metrics.withColumn("violation", risk_violation(metrics.columns)).where(F.col("violation").isNotNull())


def holder_violation(columns: list[str]) -> Column:
    """Figures and their provenance go together: a truncated reading has none, figures need the ledger and its span."""
    c = F.col
    figures = c("circulating_supply").isNotNull()
    return _first_broken(columns, [
        ("truncated with figures", ("truncated", "circulating_supply"), c("truncated") & figures),
        ("figures without a ledger", ("circulating_supply", "snapshot_ledger"), figures & c("snapshot_ledger").isNull()),
        ("a span that ends before it begins", ("ledger_min", "ledger_max"), c("ledger_max") < c("ledger_min")),
        ("a ledger outside its span", ("snapshot_ledger", "ledger_min", "ledger_max"), (c("snapshot_ledger") < c("ledger_min")) | (c("snapshot_ledger") > c("ledger_max"))),
        ("a basis without a label", ("basis", "label"), c("basis").isNotNull() & (F.coalesce(F.trim("label"), F.lit("")) == "")),
        ("a negative supply", ("circulating_supply",), c("circulating_supply") < 0),
        ("a share outside 0 to 100", ("top1_pct",), ~c("top1_pct").between(0, 100)),
        ("ten holders with less than one", ("top1_pct", "top10_pct"), c("top10_pct") < c("top1_pct")),
    ])


def trade_violation(columns: list[str]) -> Column:
    """A trade reading has an anchor and a searched span; only a full scope has volumes, and nothing lies after the anchor."""
    c = F.col
    return _first_broken(columns, [
        ("no anchor", ("anchor",), c("anchor").isNull()),
        ("a negative span", ("searched_days",), c("searched_days") < 0),
        ("unknown scope", ("scope",), ~c("scope").isin("full", "last_genuine_only")),
        ("volumes without the full scope", ("scope", "genuine_base_30d"), (c("scope") == "last_genuine_only") & c("genuine_base_30d").isNotNull()),
        ("a negative volume", ("genuine_base_30d",), c("genuine_base_30d") < 0),
        ("a longer window with less volume", ("genuine_base_7d", "genuine_base_30d"), c("genuine_base_30d") < c("genuine_base_7d")),
        ("a share outside 0 to 100", ("trades_excluded_pct",), ~c("trades_excluded_pct").between(0, 100)),
        ("a trade after the anchor", ("last_genuine_at", "anchor"), c("last_genuine_at") > c("anchor")),
    ])


def reading_violations(readings: DataFrame) -> DataFrame:
    """Holder readings whose figures and provenance contradict each other, with the reason."""
    return readings.withColumn("violation", holder_violation(readings.columns)).where(F.col("violation").isNotNull())

"""Scans of recorded JSON and CSV data into domain tables.

Bodies are parsed with from_json under declared schemas. A body that is not what was asked for becomes a row with an
``error``, never a failed job and never a silent loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import exact as X
from fathomline.sources import schemas as S
from fathomline.sources.sinks import LOG_BITS

#: A page with so many records may have been cut.
FULL_PAGE = 200


def asset_of(c: Column) -> Column:
    """Canonical id of an asset struct of a body."""
    return F.when(c["asset_type"] == "native", F.lit("XLM")).otherwise(F.concat_ws(":", c["asset_code"], c["asset_issuer"]))


def order_books(bodies: DataFrame) -> DataFrame:
    """Levels of recorded books. bodies: pair_id, ledger_seq, base, quote, body.

    Bid amounts arrive in quote units and become base units. A body of another pair, or one that cannot be read, gives
    one row with ``error``; a book without levels gives one row without side.
    """
    b = bodies.withColumn("_b", F.from_json("body", S.ORDER_BOOK))
    error = F.when(F.col("_b.base").isNull(), "unreadable order book").when((asset_of(F.col("_b.base")) != F.col("base")) | (asset_of(F.col("_b.counter")) != F.col("quote")), "the body is of another pair")

    def side(name: str, levels: Column) -> Column:
        return F.transform(F.coalesce(levels, F.array().cast(f"array<{S.LEVEL}>")), lambda x: F.struct(F.lit(name).alias("side"), x["price_r"]["n"].try_cast("bigint").alias("n"), x["price_r"]["d"].try_cast("bigint").alias("d"), x["amount"].try_cast(X.AMOUNT).alias("a")))

    rows = b.withColumn("error", error).select("pair_id", "ledger_seq", "error", F.explode_outer(F.when(F.col("error").isNull(), F.concat(side("bid", F.col("_b.bids")), side("ask", F.col("_b.asks"))))).alias("l"))
    n, d, a = F.col("l.n"), F.col("l.d"), F.col("l.a")
    bad = F.col("l").isNotNull() & (~X.price_valid(n, d) | a.isNull())
    base = F.when(F.col("l.side") == "bid", F.when(X.price_valid(n, d) & (d > 0), X.notional(a, d, n).try_cast(X.AMOUNT))).otherwise(a)
    bad = bad | (F.col("l").isNotNull() & base.isNull())
    return rows.select("pair_id", "ledger_seq", F.col("l.side").alias("side"), n.alias("price_n"), d.alias("price_d"), base.alias("amount"), F.when(bad, "malformed level").otherwise(F.col("error")).alias("error"))


def pair_of_book(bodies: DataFrame) -> DataFrame:
    """The pair that each body itself names."""
    b = F.from_json("body", S.ORDER_BOOK)
    return bodies.select("*", asset_of(b["base"]).alias("body_base"), asset_of(b["counter"]).alias("body_quote"))


def _reserve(reserves: Column, asset: Column) -> Column:
    return F.get(F.filter(reserves, lambda r: F.when(r["asset"] == "native", F.lit("XLM")).otherwise(r["asset"]) == asset), F.lit(0))["amount"].try_cast(X.AMOUNT)


def pools(bodies: DataFrame) -> DataFrame:
    """Pools of recorded pages (pair_id, ledger_seq, base, quote, body) with reserves by side; a full page and a pool without one side are errors."""
    b = bodies.withColumn("_r", F.from_json("body", S.POOL_PAGE)["_embedded"]["records"])
    error = F.when(F.col("_r").isNull(), "unreadable pool page").when(F.size("_r") >= FULL_PAGE, "the page is full and may be cut")
    rows = b.withColumn("error", error).select("pair_id", "ledger_seq", "base", "quote", "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("_r"))).alias("p"))
    rb, rq = _reserve(F.col("p.reserves"), F.col("base")), _reserve(F.col("p.reserves"), F.col("quote"))
    lacks = F.col("p").isNotNull() & (rb.isNull() | rq.isNull())
    return rows.select("pair_id", "ledger_seq", F.col("p.id").alias("pool_id"), rb.alias("reserve_base"), rq.alias("reserve_quote"), F.col("p.fee_bp").alias("fee_bp"), F.when(lacks, "a reserve is missing").otherwise(F.col("error")).alias("error"))


def trades(bodies: DataFrame) -> DataFrame:
    """Trades of recorded records (pair_id, base, quote, body: one record), oriented to the pair."""
    t = bodies.withColumn("t", F.from_json("body", S.TRADE))
    side = lambda s: asset_of(F.struct(F.col(f"t.{s}_asset_type").alias("asset_type"), F.col(f"t.{s}_asset_code").alias("asset_code"), F.col(f"t.{s}_asset_issuer").alias("asset_issuer")))
    token = X.paging_token(F.col("t.paging_token"))
    price = X.price_parsed(F.col("t.price.n"), F.col("t.price.d"))
    error = (
        F.when(F.col("t.id").isNull(), "unreadable trade").when((side("base") != F.col("base")) | (side("counter") != F.col("quote")), "the record is of another pair").when(price.isNull(), "malformed price")
    )
    pool = F.coalesce("t.base_liquidity_pool_id", "t.counter_liquidity_pool_id")
    return t.select(
        "pair_id", F.col("t.id").alias("trade_id"), token["operation_id"].alias("operation_id"), token["fill_index"].alias("fill_index"), token["ledger_seq"].alias("ledger_seq"), F.col("t.ledger_close_time").alias("closed_at"),
        F.col("t.trade_type").alias("trade_type"), price["n"].alias("price_n"), price["d"].alias("price_d"), F.col("t.base_amount").try_cast(X.AMOUNT).alias("base_amount"), F.col("t.counter_amount").try_cast(X.AMOUNT).alias("counter_amount"),
        F.col("t.base_is_seller").alias("base_is_seller"), F.col("t.base_account").alias("base_account"), F.col("t.counter_account").alias("counter_account"), F.col("t.base_offer_id").alias("base_offer_id"), F.col("t.counter_offer_id").alias("counter_offer_id"),
        pool.alias("pool_id"), F.when(F.col("t.base_liquidity_pool_id").isNotNull(), "base").when(F.col("t.counter_liquidity_pool_id").isNotNull(), "counter").alias("pool_side"), F.col("t.liquidity_pool_fee_bp").alias("fee_bp"), error.alias("error"),
    )


def trades_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TRADES_CSV).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def trade_log(spark: SparkSession, path: str, first: int, last: int, pair: int | None = None) -> DataFrame:
    """The trades of ledgers ``first`` to ``last`` of a log that ``sinks.trade_log`` wrote. Spans of ledgers prune folders, the
    rest of the range and the pair reach the files' statistics."""
    log = spark.read.parquet(path).where(F.col("span").between(first >> LOG_BITS, last >> LOG_BITS) & F.col("ledger_seq").between(first, last))
    return (log if pair is None else log.where(F.col("pair_id") == pair)).drop("span")


def trade_log_coverage(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Per pair whether its log reaches over the whole range: a trade at or before its begin and one at or after its end. Only
    bounds are read."""
    bounds = spark.read.parquet(path).groupBy("pair_id").agg(F.min("ledger_seq").alias("from_ledger"), F.max("ledger_seq").alias("to_ledger"))
    return bounds.withColumn("complete", (F.col("from_ledger") <= first) & (F.col("to_ledger") >= last))


def holders_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.HOLDERS_CSV).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def pull_metadata(holders: DataFrame) -> DataFrame:
    """Rows, pages, ledger and time span, zero and non-zero balances of a pull."""
    return holders.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source_page").alias("pages"), F.min("latest_ledger").alias("ledger_min"), F.max("latest_ledger").alias("ledger_max"),
        F.min("read_at_utc").alias("read_from"), F.max("read_at_utc").alias("read_to"), F.count_if(F.col("balance") == 0).alias("zero"), F.count_if(F.col("balance") != 0).alias("non_zero"),
    )


def trustlines(bodies: DataFrame) -> DataFrame:
    """The one balance of the asked asset (asset_id) in each account record (body); an account without it is an error row."""
    a = bodies.withColumn("a", F.from_json("body", S.ACCOUNT))
    line = F.get(F.filter("a.balances", lambda b: asset_of(b) == F.col("asset_id")), F.lit(0))
    return a.withColumn("l", line).select(
        "asset_id", F.col("a.account_id").alias("account_id"), F.col("l.balance").try_cast(X.AMOUNT).alias("balance"), F.col("l.is_authorized").alias("is_authorized"), F.col("l.buying_liabilities").try_cast(X.AMOUNT).alias("buying_liabilities"),
        F.col("l.selling_liabilities").try_cast(X.AMOUNT).alias("selling_liabilities"), F.when(F.col("l").isNull(), "the account has no such balance").alias("error"),
    )


def asset_stats(bodies: DataFrame) -> DataFrame:
    """Flat asset statistics; empty amounts are 0, supply and holders prefer the nested fields over the deprecated ones."""
    s = bodies.select(F.from_json("body", S.ASSET_STAT).alias("s"))
    num = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("0")).try_cast("decimal(30,7)")
    b, a = F.col("s.balances"), F.col("s.accounts")
    supply = F.when(b.isNotNull(), num(b["authorized"]) + num(b["authorized_to_maintain_liabilities"]) + num(b["unauthorized"])).otherwise(num(F.col("s.amount")))
    holders = F.when(a.isNotNull(), F.coalesce(a["authorized"], F.lit(0)) + F.coalesce(a["authorized_to_maintain_liabilities"], F.lit(0)) + F.coalesce(a["unauthorized"], F.lit(0))).otherwise(F.col("s.num_accounts"))
    return s.select(
        F.col("s.asset_code").alias("code"), F.col("s.asset_issuer").alias("issuer"), F.col("s.asset_type").alias("type"), supply.alias("supply"), holders.alias("trustlines"), F.col("s.num_liquidity_pools").alias("pools"), num(F.col("s.liquidity_pools_amount")).alias("pools_amount"),
        F.col("s.num_claimable_balances").alias("claimable"), num(F.col("s.claimable_balances_amount")).alias("claimable_amount"), F.col("s.num_contracts").alias("contracts"), num(F.col("s.contracts_amount")).alias("contracts_amount"), "s.flags.*",
    )


def pool_effects(bodies: DataFrame) -> DataFrame:
    """Reserves that pool effects report (base, quote, body); the ledger comes from the token."""
    e = bodies.withColumn("e", F.from_json("body", S.POOL_EFFECT))
    token = F.get(F.split("e.paging_token", "-"), F.lit(0)).try_cast("bigint")
    return e.select(
        F.col("e.liquidity_pool.id").alias("pool_id"), F.col("e.paging_token").alias("token"), F.col("e.type").alias("type"), F.col("e.created_at").alias("created_at"), X.toid_ledger(token).alias("ledger_seq"),
        _reserve(F.col("e.liquidity_pool.reserves"), F.col("base")).alias("reserve_base"), _reserve(F.col("e.liquidity_pool.reserves"), F.col("quote")).alias("reserve_quote"),
    )


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded files below ``path`` (gzip is transparent), bodies verbatim, with schema version, degraded, consistent and hash checks."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    r = raw.select("path", F.from_json("value", S.RECORDING).alias("r")).select("path", "r.*")
    known = F.col("ledger_before").isNotNull() & (F.col("ledger_before") != 0)
    return r.withColumn("schema_version", F.greatest(F.coalesce("schema_version", F.lit(1)), F.lit(1))).select(
        "*", F.coalesce(F.exists("sources", lambda s: (s["http_status"] < 200) | (s["http_status"] > 299)), F.lit(True)).alias("degraded"), (known & (F.col("ledger_before") == F.col("ledger_after"))).alias("consistent"),
        F.forall("sources", lambda s: s["body"].isNull() | (F.sha2(s["body"], 256) == s["body_sha256"])).alias("hashes_agree"),
    )


def archive(spark: SparkSession, path: str) -> DataFrame:
    """All recordings below ``path`` in one scan, whatever their schema: ticks, and the snapshots and holder pages of schema 1.

    kind (tick, snapshot, holders), schema_version (absent: 1), subject (pair or asset), recorded_at, ledger_before and
    ledger_after (of the first and the last response), consistent, truncated, bodies as (endpoint, body) in order, and
    ``raw``, the file's own text. A file that is none of these is one row with ``error``.
    """
    at = lambda p: F.get_json_object("raw", f"$.{p}")
    body = lambda endpoint, c: F.struct(F.lit(endpoint).alias("endpoint"), c.alias("body"))
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(path, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"))
    version = F.greatest(F.coalesce(at("schema_version").try_cast("int"), F.lit(1)), F.lit(1))
    kind = F.when((version >= 2) & at("sources").isNotNull(), "tick").when((version == 1) & at("requested_asset").isNotNull(), "holders").when((version == 1) & at("requested_base").isNotNull(), "snapshot").when((version == 1) & at("sources").isNotNull(), "tick")
    rows = raw.withColumns({"schema_version": version, "kind": kind})
    by_kind = lambda tick, snapshot, holders: F.when(F.col("kind") == "tick", tick).when(F.col("kind") == "snapshot", snapshot).when(F.col("kind") == "holders", holders)
    sources = F.transform(F.from_json("raw", S.RECORDING)["sources"], lambda s: F.struct(s["endpoint"].alias("endpoint"), s["body"].alias("body")))
    books = F.array(body("order_book", at("order_book")), body("liquidity_pools", at("liquidity_pools")), body("ledger", at("ledger")))
    pages = F.concat(F.array(body("asset_summary", at("asset_summary"))), F.transform(F.from_json(at("account_pages"), "array<string>"), lambda x: body("account_page", x)))
    number = lambda p: at(p).try_cast("bigint")
    out = rows.select(
        "path", "kind", "schema_version", by_kind(at("pair"), F.concat_ws("/", at("requested_base"), at("requested_quote")), at("requested_asset")).alias("subject"), by_kind(at("recorded_at"), at("fetched_at"), at("fetched_at")).try_cast("timestamp").alias("recorded_at"),
        by_kind(number("ledger_before"), number("book_latest_ledger"), number("first_page_latest_ledger")).alias("ledger_before"), by_kind(number("ledger_after"), number("pool_latest_ledger"), number("last_page_latest_ledger")).alias("ledger_after"),
        F.coalesce(at("truncated").try_cast("boolean"), F.lit(False)).alias("truncated"), F.filter(by_kind(sources, books, pages), lambda b: b["body"].isNotNull()).alias("bodies"), "raw", F.when(F.col("kind").isNull(), "not a recording").alias("error"),
    )
    same = (F.col("ledger_before") == F.col("ledger_after")) & (F.col("ledger_before") != 0)
    return out.withColumn("consistent", F.coalesce(same, F.lit(False)))


def archived_bodies(archived: DataFrame, endpoint: str) -> DataFrame:
    """(path, kind, subject, ledger_seq, recorded_at, body) of one endpoint of each recording, a row a body."""
    return archived.where("error IS NULL").withColumn("b", F.explode("bodies")).where(F.col("b.endpoint") == endpoint).select("path", "kind", "subject", F.col("ledger_before").alias("ledger_seq"), "recorded_at", F.col("b.body").alias("body"))


def bodies_of(recorded: DataFrame, endpoint: str) -> DataFrame:
    """(path, pair, ledger_seq, recorded_at, body) of one endpoint of each recording."""
    return recorded.withColumn("s", F.explode("sources")).where(F.col("s.endpoint") == endpoint).select("path", "pair", F.col("ledger_before").alias("ledger_seq"), "recorded_at", F.col("s.body").alias("body"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """The monitored pairs of a JSON list with a reason for every entry that must be refused."""
    p = spark.read.schema("base struct<code:string,issuer:string>, quote struct<code:string,issuer:string>, note string").option("multiLine", True).json(path)
    b, q = (X.asset_id(F.col(f"{s}.code"), F.col(f"{s}.issuer")) for s in ("base", "quote"))
    ok = lambda s: F.col(f"{s}.issuer").isNull() | (F.col(f"{s}.issuer") == "") | F.col(f"{s}.issuer").rlike("^G[A-Z2-7]{55}$")
    p = p.select(b.alias("base"), q.alias("quote"), "note", ok("base").alias("_b"), ok("quote").alias("_q"))
    n = p.groupBy("base", "quote").agg(F.count(F.lit(1)).alias("_n"))
    why = F.when(~F.col("_b") | ~F.col("_q"), "malformed issuer").when(F.col("base") == F.col("quote"), "base and quote are equal").when(F.col("_n") > 1, "listed twice")
    return p.join(n, ["base", "quote"]).select("base", "quote", "note", why.alias("error"))


#: The fields of a pair list, of its entries and of their assets, and the asset types.
PAIR_FILE, PAIR_ENTRY, PAIR_ASSET = ("note", "pairs"), ("base", "quote", "note"), ("code", "issuer", "type")
ASSET_TYPES = ("native", "credit_alphanum4", "credit_alphanum12")


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of a list file ``{"note", "pairs": [{"base", "quote", "note"}]}`` in their order, each with the reason for which it must be refused.

    Fields that the format does not know are refused by name, at every level; so are malformed assets (the type is stated,
    never taken from the code), equal sides and a pair listed before. A file without pairs gives one row with ``error``.
    """
    keys = "map<string,string>"
    unknown = lambda m, known, where: F.when(F.size(F.array_except(F.map_keys(m), F.array(*map(F.lit, known)))) > 0, F.concat(F.lit(f"unknown field of the {where}: "), F.array_join(F.array_sort(F.array_except(F.map_keys(m), F.array(*map(F.lit, known)))), ", ")))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", keys).alias("file"))
    entries = F.from_json(F.col("file")["pairs"], f"array<{keys}>")
    rows = files.select("path", F.when(F.col("file").isNull(), "unreadable pair list").otherwise(unknown(F.col("file"), PAIR_FILE, "list")).alias("_file"), F.posexplode_outer(entries).alias("place", "e"))
    rows = rows.select("path", "_file", "place", "e", F.from_json(F.col("e")["base"], keys).alias("b"), F.from_json(F.col("e")["quote"], keys).alias("q"))
    text = lambda m, k: F.coalesce(m[k], F.lit(""))

    def refused(side: str, m: Column) -> Column:
        code, issuer, kind = text(m, "code"), text(m, "issuer"), text(m, "type")
        return (
            F.when(m.isNull(), f"the {side} is missing").when(~kind.isin(*ASSET_TYPES), f"the {side}'s type is none of {', '.join(ASSET_TYPES)}")
            .when((kind == "native") & ((code != "") | (issuer != "")), f"the {side} is native and carries a code or an issuer")
            .when((kind != "native") & ((code == "") | (issuer == "")), f"the {side} needs a code and an issuer").when((kind != "native") & ~issuer.rlike("^G[A-Z2-7]{55}$"), f"the {side}'s issuer is malformed")
        )

    name = lambda m: F.when(text(m, "type") == "native", F.lit("XLM")).otherwise(F.concat_ws(":", m["code"], m["issuer"]))
    same = F.struct(name(F.col("b")).alias("base"), text(F.col("b"), "type").alias("x"), name(F.col("q")).alias("quote"), text(F.col("q"), "type").alias("y"))
    first = F.min("place").over(Window.partitionBy("path", same))
    error = F.coalesce(
        "_file", F.when(F.col("e").isNull(), "the list holds no pairs"), unknown(F.col("e"), PAIR_ENTRY, "pair"), unknown(F.col("b"), PAIR_ASSET, "base"), unknown(F.col("q"), PAIR_ASSET, "quote"),
        refused("base", F.col("b")), refused("quote", F.col("q")), F.when((same["base"] == same["quote"]) & (same["x"] == same["y"]), "the same asset on both sides"), F.when(first < F.col("place"), "listed before"),
    )
    return rows.select("path", "place", name(F.col("b")).alias("base"), name(F.col("q")).alias("quote"), F.col("e")["note"].alias("note"), error.alias("error"))


def pool_evidence_at(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every wanted (base, quote, ledger_seq) the proof that ``pool_evidence`` covers it: ``pools`` counted and ``error`` null,
    or why it does not: no entry, several entries, a refused pool, a pool named twice."""
    key = ["base", "quote", "ledger_seq"]
    named = evidence.groupBy(*key, F.lower("pool_id").alias("id")).agg(F.count("pool_id").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("error").alias("error"), F.countDistinct("entry").alias("e"), F.collect_set("entry").alias("entries"))
    found = named.groupBy(*key).agg(F.count("id").alias("pools"), F.min("error").alias("_error"), F.max(F.col("n") > F.col("e")).alias("_twice"), F.size(F.array_distinct(F.flatten(F.collect_list("entries")))).alias("_entries"))
    why = F.when(F.col("_entries").isNull(), "no pool evidence for the pair and ledger").when(F.col("_entries") > 1, "several entries for the pair and ledger").when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_twice"), "a pool is named twice")
    return wanted.select(*key).distinct().join(found, key, "left").select(*key, F.when(why.isNull(), F.col("pools")).alias("pools"), why.alias("error"))


def live_sellers(offers: DataFrame) -> DataFrame:
    """(pair_id, seller): who sells on either side now."""
    return offers.where(F.col("seller").isNotNull()).select("pair_id", "seller").distinct()


def known_removals(spark: SparkSession, path: str) -> DataFrame:
    """Known removals with a reason for every entry that must be refused, in offer order."""
    r = spark.read.schema(S.REMOVAL).option("multiLine", True).json(path)
    n = r.groupBy("offer_id").agg(F.count(F.lit(1)).alias("_n"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = F.when(F.col("offer_id").isNull() | F.col("gone_by_ledger").isNull() | blank(F.col("evidence")) | blank(F.col("why")), "a field is missing").when(F.col("_n") > 1, "listed twice")
    return r.join(n, "offer_id", "left").select("offer_id", "gone_by_ledger", "evidence", "why", why.alias("error")).orderBy("offer_id")


def pool_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Pools at a ledger from evidence files: null pools are unknown and refused, an empty list means none (one row, pool null)."""
    body = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    e = body.select("path", F.posexplode(F.from_json("value", f"array<{S.POOL_EVIDENCE}>")).alias("at", "e")).select(F.concat_ws("#", "path", F.col("at").cast("string")).alias("entry"), "e.*")
    name = lambda s: X.asset_id(F.col(f"{s}.Code"), F.col(f"{s}.Issuer"))
    rows = e.select("entry", name("Base").alias("base"), name("Quote").alias("quote"), F.col("LedgerSeq").alias("ledger_seq"), ((F.col("Source") != "offers-implied") | F.col("LedgerClosedAt").isNull()).alias("_unsourced"), F.col("Pools").isNull().alias("_unknown"), F.explode_outer("Pools").alias("p"))
    why = (
        F.when(F.col("_unknown"), "pools are unknown").when(F.coalesce("_unsourced", F.lit(True)), "not of the offers-implied source, or without a close time").when(F.col("p").isNotNull() & ~F.coalesce(F.col("p.PoolID").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "malformed pool id")
        .when(F.col("p").isNotNull() & ~F.coalesce(F.col("p.FeeBP").between(0, 9999), F.lit(False)), "fee out of range")
        .when(F.col("p").isNotNull() & ~F.coalesce((F.col("p.ReserveBase").try_cast(X.AMOUNT) >= 0) & (F.col("p.ReserveQuote").try_cast(X.AMOUNT) >= 0), F.lit(False)), "a reserve is missing or negative")
    )
    return rows.select("entry", "base", "quote", "ledger_seq", F.col("p.PoolID").alias("pool_id"), F.col("p.ReserveBase").try_cast(X.AMOUNT).alias("reserve_base"), F.col("p.ReserveQuote").try_cast(X.AMOUNT).alias("reserve_quote"), F.col("p.FeeBP").alias("fee_bp"), why.alias("error"))


def live_offers(bodies: DataFrame) -> DataFrame:
    """Offers of both directions of a pair (base, quote, body: one record): id order, side, seller."""
    o = bodies.withColumn("o", F.from_json("body", S.OFFER))
    sells = asset_of(F.col("o.selling"))
    price = X.price_parsed(F.col("o.price_r.n"), F.col("o.price_r.d"))
    return o.select(
        "pair_id", F.col("o.id").try_cast("bigint").alias("offer_id"), F.col("o.seller").alias("seller"), F.when(sells == F.col("base"), "ask").when(sells == F.col("quote"), "bid").alias("side"), F.col("o.amount").try_cast(X.AMOUNT).alias("amount"),
        price["n"].alias("price_n"), price["d"].alias("price_d"), F.col("o.last_modified_ledger").alias("last_modified_ledger"),
    ).orderBy("pair_id", "offer_id")


def with_close_times(rows: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Rows with their ledger's close time (sequence, closed_at); a ledger without one is an error, never a guess."""
    j = rows.join(ledgers.where(F.col("closed_at").isNotNull()).select(F.col("sequence").alias("ledger_seq"), F.col("closed_at").alias("ledger_closed_at")), "ledger_seq", "left")
    return j.withColumn("ledger_error", F.when(F.col("ledger_closed_at").isNull(), "no close time for the ledger"))

"""Exact scalar rules as column expressions: rational prices, identifiers, windows, rounding.

Nothing here runs Python for a row. Prices are fractions n/d; comparisons cross-multiply, quotients are DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT, PRICE, WIDE = "decimal(19,7)", "decimal(38,18)", "decimal(38,14)"
#: Bit that marks an offer id as a taker that never rested on the book.
SYNTHETIC_BIT = 62


def price(n: Column, d: Column) -> Column:
    """n/d as DECIMAL; null where the fraction is not a price."""
    return F.when(price_valid(n, d), (n.cast("decimal(19,0)") / d.cast("decimal(19,0)")).cast(PRICE))


def price_valid(n: Column, d: Column) -> Column:
    return F.coalesce((d != 0) & (n > 0), F.lit(False))


def price_inverted(n: Column, d: Column) -> Column:
    """The fraction of the opposite direction."""
    return F.struct(d.alias("n"), n.alias("d"))


def price_text(n: Column, d: Column) -> Column:
    return F.concat_ws("/", n.cast("string"), d.cast("string"))


def price_compare(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """-1, 0 or 1 by exact cross multiplication (denominators positive)."""
    a, b = n1.cast("decimal(19,0)") * d2.cast("decimal(19,0)"), n2.cast("decimal(19,0)") * d1.cast("decimal(19,0)")
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def price_parsed(n: Column, d: Column) -> Column:
    """(n, d) from numbers or digit strings; null where a part is malformed, d is 0 or n is not positive."""
    a, b = n.cast("string").try_cast("bigint"), d.cast("string").try_cast("bigint")
    return F.when(price_valid(a, b), F.struct(a.alias("n"), b.alias("d")))


def oriented(n: Column, d: Column, record_base: Column, base: Column) -> Column:
    """(n, d) as quote per ``base``: inverted where the record's base is the other asset."""
    return F.when(record_base.eqNullSafe(base), F.struct(n.alias("n"), d.alias("d"))).otherwise(price_inverted(n, d))


def notional(amount: Column, n: Column, d: Column) -> Column:
    """amount * n / d in quote units, 14 decimals, for any BIGINT fraction; null where the result does not fit."""
    short = lambda c: c.try_cast("decimal(12,0)")
    narrow = (amount.cast(AMOUNT) * short(n) / short(d)).cast(WIDE)
    # whole part and remainder of the fraction, each of a size that a product with the amount keeps exactly
    rest = ((n % d).cast("decimal(19,0)") / d.cast("decimal(19,0)")).cast("decimal(18,17)")
    whole = F.try_divide(n - n % d, d).cast("decimal(19,0)").try_cast("decimal(18,0)")
    wide = F.try_add(F.try_multiply(amount.cast(AMOUNT), whole).try_cast(WIDE), (amount.cast(AMOUNT) * rest).cast(WIDE))
    return F.when(short(n).isNotNull() & short(d).isNotNull(), narrow).otherwise(wide)


def ratio_pct(part: Column, whole: Column) -> Column:
    """100 * part / whole of two prices; small ones are scaled up first, so that no digits of theirs are cut. Null where whole is 0."""
    small = (F.abs(whole) < F.lit("0.000001").cast("decimal(7,6)")) & (F.abs(part) < 1)
    up = lambda c: F.when(small, (c.try_cast("decimal(19,18)") * F.lit(10**12).cast("decimal(13,0)")).cast("decimal(30,10)")).otherwise(c.cast("decimal(30,10)"))
    return F.try_divide(up(part) * 100, up(whole))


def spot_price(reserve_base: Column, reserve_quote: Column) -> Column:
    """Quote per base of a pool; 0 where it has no base."""
    return F.when(reserve_base == 0, F.lit(0).cast(PRICE)).otherwise((reserve_quote.cast(AMOUNT) / F.nullif(reserve_base, F.lit(0)).cast(AMOUNT)).cast(PRICE))


def pool_active(reserve_base: Column, reserve_quote: Column) -> Column:
    return (reserve_base > 0) & (reserve_quote > 0)


def fee_fraction(fee_bp: Column) -> Column:
    return (fee_bp.cast("decimal(5,0)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(9,8)")


def exact_sqrt(v: Column) -> Column:
    """Square root of a ratio below 1000 with one Newton step in DECIMAL; raises on a negative."""
    r = F.sqrt(F.when(v < 0, F.raise_error(F.lit("square root of a negative number"))).otherwise(v).cast("double")).cast("decimal(20,16)")
    better = ((r + (v.cast("decimal(21,16)") / F.nullif(r, F.lit(0))).cast("decimal(21,16)")) / 2).cast("decimal(22,16)")
    return F.when(v == 0, F.lit(0).cast("decimal(22,16)")).otherwise(better)


def toid(ledger: Column, tx: Column, op: Column) -> Column:
    return F.shiftleft(ledger.cast("bigint"), 32).bitwiseOR(F.shiftleft(tx.cast("bigint"), 12)).bitwiseOR(op.cast("bigint"))


def toid_ledger(id_: Column) -> Column:
    return F.shiftright(id_.cast("bigint"), 32)


def toid_operation(id_: Column) -> Column:
    return id_.cast("bigint").bitwiseAND(F.lit(4095))


def paging_token(token: Column) -> Column:
    """(operation_id, fill_index, ledger) of ``<toid>-<n>``; a malformed token gives '', 0 and 0."""
    parts = F.split(token, "-")
    id_ = F.get(parts, F.lit(0)).try_cast("bigint")
    fill = F.get(parts, F.lit(1)).try_cast("int")
    ok = F.coalesce((F.size(parts) == 2) & id_.isNotNull() & fill.isNotNull(), F.lit(False))
    return F.struct(
        F.when(ok, F.get(parts, F.lit(0))).otherwise("").alias("operation_id"),
        F.when(ok, fill).otherwise(0).alias("fill_index"),
        F.when(ok, toid_ledger(id_)).otherwise(F.lit(0).cast("bigint")).alias("ledger_seq"),
    )


def synthetic_offer(id_: Column) -> Column:
    return F.coalesce(id_.try_cast("bigint").bitwiseAND(F.lit(1 << SYNTHETIC_BIT)) != 0, F.lit(False))


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def in_trailing_window(ts: Column, anchor: Column, seconds: int | Column) -> Column:
    """anchor - seconds < ts <= anchor."""
    w = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return (F.unix_micros(ts) > F.unix_micros(anchor) - w.cast("bigint") * 1_000_000) & (ts <= anchor)


def in_span(ts: Column, start: Column, end: Column) -> Column:
    """start <= ts < end."""
    return (ts >= start) & (ts < end)


def asset_id(code: Column, issuer: Column) -> Column:
    """``XLM`` for the native asset, else ``CODE:ISSUER``."""
    return F.when(issuer.isNull() | (issuer == ""), F.lit("XLM")).otherwise(F.concat_ws(":", code, issuer))


def asset_slug(code: Column, issuer: Column) -> Column:
    """File-safe name: code and the first eight characters of the issuer."""
    return F.when(issuer.isNull() | (issuer == ""), F.lit("XLM")).otherwise(F.concat_ws(".", code, F.substring(issuer, 1, 8)))


def asset_parsed(text: Column) -> Column:
    """(code, issuer) of ``XLM`` or ``CODE:ISSUER`` (``%3A`` too); null where it is neither."""
    t = F.regexp_replace(text, "(?i)%3A", ":")
    parts = F.split(t, ":")
    code, issuer = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ok = (F.size(parts) == 2) & code.rlike("^[A-Za-z0-9]{1,12}$") & issuer.rlike("^G[A-Z2-7]{55}$")
    return F.when(t == "XLM", F.struct(F.lit("XLM").alias("code"), F.lit(None).cast("string").alias("issuer"))).when(ok, F.struct(code.alias("code"), issuer.alias("issuer")))


def pair_label(a: Column, b: Column) -> Column:
    """One label for both directions of a pair."""
    return F.concat_ws("/", F.least(a, b), F.greatest(a, b))


def relative_move(before: Column, after: Column) -> Column:
    """abs(after / before - 1); null where it is 0 or before is 0."""
    return F.nullif(F.abs(F.try_divide(after.cast("decimal(22,12)"), before.cast("decimal(22,12)")) - 1), F.lit(0))


def price_is_outlier(p: Column, median: Column, factor: float = 1.5) -> Column:
    """p > median * factor or p * factor < median; false without a positive median and price."""
    f = F.lit(str(factor)).cast("decimal(4,2)")
    q, m = p.cast("decimal(30,12)"), median.cast("decimal(30,12)")
    return F.coalesce((m > 0) & (q > 0) & ((q > m * f) | (q * f < m)), F.lit(False))


def pool_fill_is_dearer(p: Column, reference: Column) -> Column:
    return p > reference


def trades_in_30_days(note: Column) -> Column:
    """The trade count that a note states, or null."""
    return F.nullif(F.regexp_extract(note, r"([0-9]+) trades? in 30 days", 1), F.lit("")).try_cast("bigint")


def display(c: Column, places: int = 7) -> Column:
    """Half-even rounding for reports."""
    return F.bround(c, places)


def fixed(c: Column, places: int) -> Column:
    """Text with a fixed number of decimals, rounded half up."""
    return F.round(c, places).cast(f"decimal(38,{places})").cast("string")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times; null where one cannot be read."""
    return (F.unix_millis(end) - F.unix_millis(start)) / 1000


def json_presence(body: Column, key: str) -> Column:
    """'absent', 'null' or 'value' for a key of a JSON object."""
    m = F.from_json(body, "map<string,string>")
    return F.when(m.isNull() | ~F.map_contains_key(m, key), F.lit("absent")).when(F.element_at(m, key).isNull(), F.lit("null")).otherwise(F.lit("value"))

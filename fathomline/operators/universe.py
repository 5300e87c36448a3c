"""Candidate assets: listings by code, verification against their home domain, identity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_code(stats: DataFrame, codes: DataFrame) -> DataFrame:
    """Listed assets with exactly one of the codes, once each, in order."""
    return stats.join(codes.select("code").distinct(), "code", "left_semi").dropDuplicates(["code", "issuer", "type"]).orderBy("code", "issuer", "type")


def verification(candidates: DataFrame, documents: DataFrame, currencies: DataFrame) -> DataFrame:
    """candidates (code, issuer, home_domain) with verified, mismatch, unreachable or unverified and a sentence."""
    docs = documents.select("home_domain", "readable").dropDuplicates(["home_domain"])
    listed = currencies.select("home_domain", "code", "issuer", F.lit(True).alias("listed")).distinct()
    j = candidates.join(docs, "home_domain", "left").join(listed, ["home_domain", "code", "issuer"], "left")
    none = F.coalesce(F.col("home_domain"), F.lit("")) == ""
    kind = F.when(none, "unverified").when(~F.coalesce("readable", F.lit(False)), "unreachable").when(F.col("listed"), "verified").otherwise("mismatch")
    text = (
        F.when(kind == "unverified", "the issuer names no home domain").when(kind == "unreachable", F.concat(F.lit("the document of "), "home_domain", F.lit(" could not be read")))
        .when(kind == "verified", F.concat("home_domain", F.lit(" lists this asset"))).otherwise(F.concat("home_domain", F.lit(" does not list this asset")))
    )
    return j.select("code", "issuer", "home_domain", kind.alias("verification"), text.alias("explanation"))


def ticker_counts(stats: DataFrame, page: int = 200) -> DataFrame:
    """Issuers of each code, and whether the listing was cut at a full page."""
    return stats.groupBy("code").agg(F.countDistinct("issuer").alias("issuers"), (F.count(F.lit(1)) >= page).alias("truncated"))


def identity_mismatches(declared: DataFrame, listed: DataFrame) -> DataFrame:
    """Declared assets whose type is not the listed one, or that are not listed."""
    j = declared.join(listed.select("code", "issuer", F.col("type").alias("listed_type")), ["code", "issuer"], "left")
    return j.where(F.col("listed_type").isNull() | (F.col("type") != F.col("listed_type")))


def codes(inline: DataFrame, listed: DataFrame) -> DataFrame:
    return inline.select("code").union(listed.select("code")).where(F.trim("code") != "").distinct()

"""Operators as filters and rewrites of a document table, for use in a pipeline.

Each takes and returns tables with the same columns; columns that a result of the operator would clash with are
carried in one struct, so any extra column passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import decontaminate, near_dedup, pii, quality_rules, sentencepiece_codec
from fathomline.llm.common import unique_names


def _packed(docs: DataFrame, *cols: str) -> DataFrame:
    return docs.select(F.struct(*docs.columns).alias("_row"), *cols)


def _others(docs: DataFrame):
    """The columns beside the text as one struct, so that a text goes to a task once."""
    return F.struct(F.lit(0).alias("none__"), *(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row")


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The documents that quality rules keep; a null or empty text has no words and goes, repeated rows are judged alike."""
    return quality_rules.judge(_packed(docs, "text", "source"), keep=["_row"]).where("kept").select("_row.*")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The first document of each group of near duplicates; null and empty texts are alone and stay, rows with equal keys stay or go together."""
    return near_dedup.keep_first(docs)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no test item is found; null and empty texts stay."""
    return decontaminate.clean(docs, benchmark)


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; n_chars follows where the table has it. Null and empty
    texts stay, repeated rows are each redacted alike."""
    others, text = _others(docs), F.col("text").alias("_text")
    found = pii.detect(docs.select(others, text), "_text", keep=["_row", "_text"])
    out = pii.redact(found, "_text")
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*(new[c] if c in new else F.col(f"_row.`{c}`") for c in docs.columns)).toDF(*docs.columns)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Documents with their columns, their piece ids and counts, and, as the text, what the ids decode to; a null text has
    no ids and becomes the empty text, repeated rows each stay."""
    coded = sentencepiece_codec.encode(docs.select(_others(docs), F.col("text").alias("_text")), path, "_text", decoded_col="decoded", keep=["_row", "_text"])
    names = unique_names(docs, "token_ids", "n_tokens", "round_trip")
    old = [(F.col("decoded") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns]
    new = [F.col("token_ids"), F.size("token_ids").cast("long"), F.coalesce("_text", F.lit("")) == F.col("decoded")]
    return coded.select(*old, *(c.alias(n) for c, n in zip(new, names, strict=True)))

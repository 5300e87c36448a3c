"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import byte_bpe, conversation_repair, decontaminate, html_extract, language_id, license_scan, near_dedup, oracles, pii, quality_rules, sentencepiece_codec, substring_dedup, token_alignment, token_counts
from fathomline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files keep ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the count and digest of its piece ids and the digest of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"), decoded_col="decoded", keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words removed as repeated and the digest of those kept."""
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item found in a document, with its edit distance."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its shingle count and its group of near duplicates, on shingles of four words."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its language, by models learned from documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    path = tokenizer_path("piece_bpe_32k.model")
    langs, model = language_id.train(docs.where(~F.col("held_out")), path)
    return language_id.identify(docs.drop("lang"), path, langs, model, keep=["doc_id", "held_out"])


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the licences named in it, by base phrases and by the positional rare-word index."""
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the counts and digest of base spans and the list of all spans."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("pii_spans", lambda c: c["base"])
    kinds = F.transform(base, lambda c: c["kind"])
    return found.select(
        "doc_id",
        *((F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("pii_spans")).alias("spans"),
    )


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.train(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words and greedy word pieces."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its quality figures and whether it is kept, given its host's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judge(docs, keep=["doc_id"]).drop("host_rate")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation of the damaged table its faults, its cheapest edits and the digest of the repaired turns; nulls read as one space."""
    return conversation_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the count and digest of its byte-level BPE ids and the digest of the bytes they decode to; a null text has none."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded_col="decoded", keep=["doc_id"], packed=True)
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how its byte-level BPE tokens and its pieces align, and how common the linked id pairs are; texts without tokens have zeros."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), public_tokenizers.PATTERN, tokenizer_path("piece_bpe_32k.model"), digest=True)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_decontaminate, op4_near_dedup, op5_language_id, op6_license_scan, op7_pii, op8_html_extract, op9_token_counts, op10_quality_rules, op11_conversation_repair, op12_byte_bpe, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

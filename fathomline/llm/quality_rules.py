"""Operator 10: quality rules of documents and of their hosts, with built-in functions only.

Document figures come from one pass. Rule failures are then counted by host (partial sums before the shuffle, so
a host with a third of all documents costs one row a task), each host's failure rate is shrunk towards the rate of
all hosts with a beta prior fitted by moments, and the host verdicts are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import CARRIED, SPACE_CLASS, carry, materialize, unpack

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
#: Base rules: fewer words than this, or a greater share of words in repeated windows, fail a document.
MIN_WORDS, MAX_REPEATED_PCT = 50, 50
#: Soft rules: symbols a hundred words, repeated lines among lines with words, bounds of the mean word length.
MAX_SYMBOLS_PCT, MAX_DUP_LINES_PCT, WORD_CHARS = 10, 30, (2, 15)
#: A document with more symbols a hundred words than this is no prose, whatever its host.
SEVERE_SYMBOLS_PCT = 30
#: A host whose shrunk failure rate is above this is not trusted.
MAX_HOST_RATE = 0.5
#: Hosts up to this many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000


def document_figures(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long).

    Words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none. n_repeat_words counts the words that lie in a
    window of three words which occurs twice or more in the text, the first occurrence included. Windows are
    compared by a 64-bit hash within one text. Rows stay as they are, repeated ones too; no shuffle.
    """
    keep = df.columns if keep is None else keep
    t = F.coalesce(F.col(text_col), F.lit(""))
    out = df.select(
        *keep,
        F.array_remove(F.split(t, SPACE_CLASS + "+"), "").alias("_words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    # symbols are no white space, so the joined words hold all of them
    out = out.withColumn("_joined", F.array_join("_words", ""))
    n = F.size("_words")
    out = out.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length("_joined").cast("long").alias("word_chars"),
        (F.length("_joined") - F.length(F.regexp_replace("_joined", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("_words"), i + k) for k in range(WINDOW)))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_windows"),
    )
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn(
        "_sorted",
        F.when(repeated, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    ).drop("_windows")
    s = F.col("_sorted")
    same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))).drop("_sorted")
    at = F.col("_at")
    gap = lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))
    total = F.aggregate(F.transform(at, gap), F.lit(0), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words"))


def soft_failed() -> Column:
    """Whether a document breaks a rule that counts against its host and, on an untrusted host, against itself."""
    n, lo, hi = F.col("n_words"), *WORD_CHARS
    return (
        (100 * F.col("n_symbols") > MAX_SYMBOLS_PCT * n)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PCT * F.col("n_lines"))
        | (F.col("word_chars") < lo * n)
        | (F.col("word_chars") > hi * n)
    )


def host_verdicts(judged: DataFrame, host_col: str = "host") -> DataFrame:
    """One row a host: n_docs, n_failed, rate (shrunk), trusted.

    The beta prior has the mean of all hosts' rates and the strength that their spread leaves beyond chance
    (method of moments); with no spread or one host it is the overall rate with the weight of 100 documents.
    """
    hosts = materialize(judged.groupBy(host_col).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    r = F.col("n_failed") / F.col("n_docs")
    p = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.coalesce(F.var_samp(r), F.lit(0.0)).alias("var"), F.avg(r * (1 - r) / F.col("n_docs")).alias("chance")).first()
    mean, spread = p["mean"] or 0.0, p["var"] - (p["chance"] or 0.0)
    weight = min(10_000.0, max(1.0, mean * (1 - mean) / spread - 1 if spread > 0 else 100.0))
    rate = (F.col("n_failed") + weight * mean) / (F.col("n_docs") + weight)
    return hosts.select(host_col, "n_docs", "n_failed", rate.alias("rate"), (rate <= MAX_HOST_RATE).alias("trusted"))


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the figures of ``document_figures``, base_failed, host_rate and kept.

    A document is kept unless a base rule fails, its symbols are beyond the severe limit, or it breaks a soft
    rule and its host is not trusted; so a clean document stays on any host. A null host counts
    as the empty one. Empty tables give an empty result.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    named = df.select(carry(df, keep), F.col(text_col).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    found = materialize(document_figures(named, "text", [CARRIED, "host"]))
    judged = found.withColumn("base_failed", base_failed()).withColumn("failed", soft_failed() | F.col("base_failed"))
    hosts = host_verdicts(judged, "host")
    few = hosts.count() <= BROADCAST_HOSTS
    verdict = hosts.select("host", F.col("rate").alias("host_rate"), "trusted")
    kept = ~F.col("base_failed") & (100 * F.col("n_symbols") <= SEVERE_SYMBOLS_PCT * F.col("n_words")) & (F.col("trusted") | ~F.col("failed"))
    figures = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate")}
    return unpack(judged.join(F.broadcast(verdict) if few else verdict, "host", "left"), keep, **figures, kept=kept)

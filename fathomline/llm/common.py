"""Helpers shared by the text operators: tables, scratch space and word rules."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``, or the session's checkpoint folder; without one nothing is written."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    It cuts lineage like checkpoint(), in columnar compressed form, so a lost executor costs a
    re-read rather than a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/fathomline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, to be read by Python workers in batches of BATCH_ROWS rows, so that texts take little of their memory (a setting of the session)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


#: Column that carries the caller's columns through an operator, so that none of them clashes with the operator's own.
CARRIED = "__carried"


def carry(df: DataFrame, keep: list[str]) -> Column:
    """The columns ``keep`` as one struct."""
    return (F.struct(*(df[f"`{c}`"].alias(c) for c in keep)) if keep else F.struct(F.lit(0).alias("none"))).alias(CARRIED)


def unpack(df: DataFrame, keep: list[str], **results: Column) -> DataFrame:
    """The carried columns and ``results``, each result with underscores appended where a carried column has its name."""
    names: list[str] = []
    taken = {c.lower() for c in keep}
    for n in results:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        names.append(n)
    return df.select(*(F.col(f"{CARRIED}.`{c}`").alias(c) for c in keep), *(c.alias(n) for n, c in zip(names, results.values(), strict=True)))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_bytes(text: str) -> bytes:
    """UTF-8 of ``text`` with A-Z lower-cased (``bytes.lower`` touches ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower()


def texts(column: pa.ChunkedArray | pa.Array):
    """The strings of an Arrow column one at a time, so that long texts are never all held as Python objects."""
    for x in column:
        yield x.as_py()


def unique_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores appended until no column of ``df`` clashes with it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Bits of a filter of keys, as a power of two.
FILTER_BITS = 26


def key_slot(*keys: Column | str) -> Column:
    """A slot of the key filter, from 1 on as the bitmap functions number them."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << FILTER_BITS)) + 1


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit for the slot of every row of ``keys``: of fixed size, so it may be sent to all tasks.

    It rules out most rows that a join on the keys would drop, before they are shuffled; it lets through every row
    that the join keeps, and with very many keys it lets through more and costs only time.
    """
    slots = keys.select(key_slot(*keys.columns).alias("slot"))
    blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in blocks.toLocalIterator():
        at = (r["block"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(r["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the filter lets each slot through."""
    at = slots - 1
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

"""Running figures over an order and medians of windows, for groups of any size.

What is summed up to a place is the sum of the buckets before it and of the entries of its own bucket, so no task
holds more of a key than the entries of a bucket or one row a bucket. A window is the difference of two places.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def up_to(entries: DataFrame, queries: DataFrame, keys: list[str], bucket: Callable[[Column], Column], sums: list[str], most: list[str] | None = None) -> DataFrame:
    """``queries`` with the sums and maxima of the entries of their key at or before their place.

    Both have the columns ``keys`` and ``at``; entries have the columns ``sums`` and ``most`` (null counts for nothing),
    queries a boolean ``strict`` (entries at their very place do not count) and any columns of their own. ``bucket`` of a
    place must not fall where the place rises. A sum without entries is 0, a maximum null. Entries at one place are
    added up before they are shuffled by bucket; queries are never joined with entries.
    """
    most = most or []
    kind = {f.name: f.dataType for f in entries.schema.fields}
    total = {c: T.DecimalType(38, kind[c].scale) if isinstance(kind[c], T.DecimalType) else T.LongType() for c in sums}
    own = [c for c in queries.columns if c not in (*keys, "at", "strict")]
    added = [*(F.sum(c).cast(total[c]).alias(c) for c in sums), *(F.max(c).alias(c) for c in most)]
    placed = entries.select(*keys, "at", bucket(F.col("at")).alias("bucket"), *sums, *most).groupBy(*keys, "bucket", "at").agg(*added)
    asked = queries.withColumn("bucket", bucket(F.col("at")))
    none = [*(F.lit(None).cast(total[c]).alias(c) for c in sums), *(F.lit(None).cast(kind[c]).alias(c) for c in most)]
    buckets = placed.select(*keys, "bucket", *sums, *most).union(asked.select(*keys, "bucket", *none)).groupBy(*keys, "bucket").agg(*added)
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.select(*keys, "bucket", *(F.sum(c).over(earlier).cast(total[c]).alias(c) for c in sums), *(F.max(c).over(earlier).alias(c) for c in most))
    empty = F.lit(None).cast(T.StructType([queries.schema[c] for c in own])).alias("own")
    at = queries.schema["at"].dataType
    rows = (
        before.select(*keys, "bucket", F.lit(None).cast(at).alias("at"), F.lit(0).alias("turn"), empty, *sums, *most)
        .union(placed.select(*keys, "bucket", F.col("at").cast(at).alias("at"), F.lit(1).alias("turn"), empty, *sums, *most))
        .union(asked.select(*keys, "bucket", "at", F.when(F.col("strict"), 0).otherwise(2).alias("turn"), F.struct(*own).alias("own"), *none))
    )
    # the row of earlier buckets has no place and comes first
    within = Window.partitionBy(*keys, "bucket").orderBy(F.col("at").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    ran = rows.select(*keys, "at", "own", *(F.coalesce(F.sum(c).over(within), F.lit(0)).cast(total[c]).alias(c) for c in sums), *(F.max(c).over(within).alias(c) for c in most))
    return ran.where(F.col("own").isNotNull()).select(*keys, "at", "own.*", *sums, *most)


def window_medians(prices: DataFrame, queries: DataFrame, keys: list[str], longest: int, chunk: int) -> DataFrame:
    """``queries`` with ``median``: the upper median of the prices of their key from ``low`` to ``high``, ends included; null without any.

    prices: ``keys``, at, price, n (how often); queries: ``keys``, low, high and columns of their own, where high - low is
    at most ``longest``. Times are integers of one unit. A key is cut into chunks of time; a price goes to its own chunk
    and, near the end of the one before, to that too, so rows are (1 + longest / chunk) x prices + queries. In a chunk
    all queries descend a wavelet matrix of the prices together: a step a bit of their number.
    """
    own = [f for f in queries.schema.fields if f.name not in keys]
    result = T.StructType([*(queries.schema[k] for k in keys), *own, T.StructField("median", prices.schema["price"].dataType)])
    of = lambda c: F.floor(c / F.lit(chunk)).alias("chunk")
    spread = prices.where("price IS NOT NULL").select(*(F.col(k).alias(f"of_{k}") for k in keys), *(F.col(c).alias(f"of_{c}") for c in ("at", "price", "n")), F.explode(F.array_distinct(F.array(of(F.col("at")), of(F.col("at") - longest)))).alias("of_chunk"))
    asked = queries.withColumn("chunk", of(F.col("low")))

    def found(known: pa.Table, wanted: pa.Table) -> pa.Table:
        out = wanted.select([f.name for f in result.fields[:-1]])
        if not wanted.num_rows or not known.num_rows:
            return out.append_column("median", pa.nulls(wanted.num_rows, known.schema.field("of_price").type))
        by_time = known.sort_by("of_at")
        times, times_n = by_time["of_at"].to_numpy(), by_time["of_n"].to_numpy()
        by_price = pc.sort_indices(by_time["of_price"]).to_numpy()
        rank = np.empty(len(by_price), np.int64)
        rank[by_price] = np.arange(len(by_price))
        i, j = np.searchsorted(times, wanted["low"].to_numpy()), np.searchsorted(times, wanted["high"].to_numpy(), side="right")
        at = ranked_middle(rank, times_n.astype(np.int64), i, np.maximum(i, j))
        return out.append_column("median", by_time["of_price"].take(pa.array(by_price[np.maximum(at, 0)], mask=at < 0)).combine_chunks())

    return spread.groupBy(*(f"of_{k}" for k in keys), "of_chunk").cogroup(asked.groupBy(*keys, "chunk")).applyInArrow(found, result)


def dominated_sums(entries: DataFrame, queries: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``queries`` with the sum of ``value``, a DECIMAL, over the entries of their key with x at or below theirs and y at or
    below theirs (``strict``: below). Both have ``keys``, x (a long) and y; a key must fit one task. 0 without entries."""
    own = [f for f in queries.schema.fields if f.name not in keys]
    scale = entries.schema[value].dataType.scale
    result = T.StructType([*(queries.schema[k] for k in keys), *own, T.StructField(value, T.DecimalType(38, scale))])
    known = entries.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("x").alias("of_x"), F.col("y").alias("of_y"), F.col(value).cast(f"decimal(38,{scale})").alias("of_value"))

    def found(known: pa.Table, wanted: pa.Table) -> pa.Table:
        out = wanted.select([f.name for f in result.fields[:-1]])
        if not wanted.num_rows or not known.num_rows:
            return out.append_column(value, pa.array([0] * wanted.num_rows, pa.decimal128(38, scale)))
        known = known.sort_by("of_x")
        n = known.num_rows
        y = pa.chunked_array([*known["of_y"].chunks, *wanted["y"].chunks])
        turn = np.concatenate([np.ones(n, np.int8), np.where(wanted["strict"].to_numpy(), 0, 2).astype(np.int8)])
        order = pc.sort_indices(pa.table({"y": y, "turn": turn}), [("y", "ascending"), ("turn", "ascending")]).to_numpy()
        behind = np.empty(len(order), np.int64)
        behind[order] = np.cumsum(order < n) - (order < n)
        upto = np.searchsorted(known["of_x"].to_numpy(), wanted["x"].to_numpy(), side="right")
        sums = rank_sums(behind[:n], decimal_limbs(known["of_value"]), upto, behind[n:])
        return out.append_column(value, limbs_decimal(sums, scale))

    return known.groupBy(*(f"of_{k}" for k in keys)).cogroup(queries.groupBy(*keys)).applyInArrow(found, result)


def decimal_limbs(c: pa.ChunkedArray) -> np.ndarray:
    """Four rows of int64: the 32-bit limbs of each DECIMAL from the lowest, of which the highest has the sign; null counts as 0."""
    a = pc.fill_null(c, 0).combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    words = np.frombuffer(a.buffers()[1], np.uint32)[4 * a.offset : 4 * (a.offset + len(a))].reshape(-1, 4)
    return np.stack([*(words[:, k].astype(np.int64) for k in range(3)), words[:, 3].astype(np.int32).astype(np.int64)])


def limbs_decimal(limbs: np.ndarray, scale: int) -> pa.Array:
    """The DECIMAL of limbs that have been added up, each below 2^63."""
    words, carry = np.empty((limbs.shape[1], 4), np.uint32), np.int64(0)
    for k in range(4):
        total = limbs[k] + carry
        words[:, k], carry = (total & 0xFFFFFFFF).astype(np.uint32), total >> 32
    return pa.Array.from_buffers(pa.decimal128(38, scale), len(words), [None, pa.py_buffer(np.ascontiguousarray(words))])


def rank_sums(rank: np.ndarray, values: np.ndarray, upto: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each question the sums of the rows of ``values`` over the first ``upto`` places whose rank is less than ``below``.

    ``rank`` is a permutation. A wavelet matrix: where a bit of ``below`` is 1, all with a 0 there count and the rest is looked into.
    """
    i, j = np.zeros(len(upto), np.int64), upto.astype(np.int64)
    out = np.zeros((len(values), len(upto)), np.int64)
    for bit in reversed(range(int(len(rank)).bit_length())):
        zero = rank >> bit & 1 == 0
        places = np.concatenate([[0], np.cumsum(zero)])
        high, zeros = (below >> bit & 1).astype(bool), places[-1]
        a, b = places[i], places[j]
        for k in range(len(values)):
            summed = np.concatenate([[0], np.cumsum(values[k][zero])])
            out[k] += np.where(high, summed[b] - summed[a], 0)
        i, j = np.where(high, zeros + i - a, a), np.where(high, zeros + j - b, b)
        order = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        rank, values = rank[order], values[:, order]
    return out


def ranked_middle(rank: np.ndarray, times: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each range [i, j) of places the rank whose values reach floor(total / 2) + 1 in order, each counted ``times``; -1 for an empty range.

    A wavelet matrix: level by level the values with a 0 in this bit come first, and a range follows the side that holds
    the wanted count.
    """
    summed = np.concatenate([[0], np.cumsum(times)])
    count = summed[j] - summed[i]
    wanted, out = count // 2 + 1, np.zeros(len(i), np.int64)
    for bit in reversed(range(max(1, int(len(rank) - 1).bit_length()))):
        zero = rank >> bit & 1 == 0
        places, weight = np.concatenate([[0], np.cumsum(zero)]), np.concatenate([[0], np.cumsum(np.where(zero, times, 0))])
        left, zeros = weight[j] - weight[i], places[-1]
        high = wanted > left
        wanted = np.where(high, wanted - left, wanted)
        out |= high.astype(np.int64) << bit
        i, j = (np.where(high, zeros + x - places[x], places[x]) for x in (i, j))
        rank, times = np.concatenate([rank[zero], rank[~zero]]), np.concatenate([times[zero], times[~zero]])
    return np.where(count > 0, out, -1)

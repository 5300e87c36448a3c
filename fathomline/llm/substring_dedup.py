"""Operator 2: removal of repeated word windows behind a count-min prefilter.

A window is counted by its minimizer, the least-hashed run of GRAM words in it; neighbours that share one minimizer
count it once. Equal windows have equal minimizers at different places, so a window that occurs twice is always
estimated repeated.

First pass: a partition sketches its texts piece by piece. A piece's sketch is sparse: the distinct minimizers of the
piece, dealt by hash prefix to shards. Each shard merges the sketches of all pieces into one small count-min block,
whose counters overestimate, and answers every piece with one bit a minimizer: estimated repeated or not. The number
of shards grows with the text, so a block never saturates, no block leaves the task that makes it, and a minimizer in
a third of all documents costs four bytes a piece.

Second pass: only windows estimated repeated are grouped exactly, by a 96-bit key, to the smallest document that holds
them (minima are combined before the shuffle). Documents with the same word sequence are represented by the smallest
of them: the others lose every window, and hold none that it does not hold. Windows are joined to the minima, adaptive
skew splitting deals with hot ones, and the covered words of each document are removed. Bit filters of fixed size keep
documents that need not meet anything from being shuffled; where they fill up they cost time and no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import key_filter, key_slot, materialize, passes, text_batches, texts
from fathomline.llm.word_hash import mixed, of_column

WINDOW, GRAM = 13, 7
#: Hash rows of a count-min block, its counters a row as a power of two, and bytes of text for each counter.
ROWS, BLOCK_BITS, BYTES_A_COUNTER = 3, 22, 6
#: Minimizers of a piece of a partition, after which its sketch is given out.
PIECE = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; bytes.split() cuts at just these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_keys(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every WINDOW consecutive word hashes."""
    n = len(word_hashes) - WINDOW + 1
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    other = mixed(word_hashes)
    for j in range(WINDOW):
        a = a * _A + word_hashes[j : j + n]
        b = b * _B + other[j : j + n]
    return mixed(a), mixed(b)


def minimizers(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every window the least hash of GRAM consecutive words, and its place (the leftmost)."""
    n = len(word_hashes) - GRAM + 1
    g = np.zeros(n, np.uint64)
    for j in range(GRAM):
        g = g * _B + word_hashes[j : j + n]
    g = mixed(g)
    m = n - (WINDOW - GRAM)
    least, at = g[:m].copy(), np.arange(m)
    for j in range(1, WINDOW - GRAM + 1):
        less = g[j : j + m] < least
        least[less] = g[j : j + m][less]
        at[less] = np.flatnonzero(less) + j
    return mixed(least), at


def window_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, number of windows, text) of each run of neighbouring windows that share a minimizer."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    least, at = minimizers(words)
    inside = text[: len(least)] == text[WINDOW - 1 :]
    least, at, of = least[inside], at[inside], text[: len(inside)][inside]
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])]) if len(at) else np.zeros(0, np.int64)
    return least[head], np.diff(np.r_[head, len(at)]).astype(np.uint8), of[head]


def shard_of(least: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a minimizer, by its upper half; rising with it."""
    return ((least >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


PARTS = "piece long, shard int, size int, cells binary, docs binary, runs binary, lengths binary"
_DOC = np.dtype([("key", "<i8"), ("mark", "<i4"), ("n_words", "<i8"), ("runs", "<i4"), ("same", "V16")])


class _Piece:
    """The texts of a piece of a partition: per text its figures, per run of windows its minimizer and length."""

    def __init__(self):
        self.docs, self.least, self.lengths, self.n = [], [], [], 0

    def add(self, words: np.ndarray, text: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> None:
        least, lengths, of = window_runs(words, text)
        n_words = np.bincount(text, minlength=len(keys))
        docs = np.zeros(len(keys), _DOC)
        docs["key"], docs["mark"], docs["n_words"], docs["runs"] = keys, marks, n_words, np.bincount(of, minlength=len(keys))
        ends = np.cumsum(n_words)
        docs["same"] = np.array([xxhash.xxh3_128_digest(words[e - n : e].tobytes()) for e, n in zip(ends, n_words, strict=True)], "V16")
        self.docs.append(docs)
        self.least.append(least)
        self.lengths.append(lengths)
        self.n += len(least) + len(keys)

    def rows(self, piece: int, shards: int) -> Iterator[pa.RecordBatch]:
        """One row a shard with the lower halves of its minimizers, and one with the texts, whose runs point at the minimizers in order."""
        found, runs = np.unique(np.concatenate(self.least), return_inverse=True)
        shard = shard_of(found, shards)
        head = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(found) else np.zeros(0, np.int64)
        low, ends = found.astype(np.uint32), np.r_[head[1:], len(found)]
        k = len(head)
        cells = [low[a:b].tobytes() for a, b in zip(head, ends, strict=False)]
        last = [np.concatenate(self.docs).tobytes(), runs.astype(np.uint32).tobytes(), np.concatenate(self.lengths).tobytes()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([piece] * (k + 1), pa.int64()), pa.array([*shard[head].tolist(), -1], pa.int32()), pa.array([*(ends[:k] - head).tolist(), len(found)], pa.int32()), pa.array([*cells, None], pa.binary()), *(pa.array([None] * k + [x], pa.binary()) for x in last)],
            names=["piece", "shard", "size", "cells", "docs", "runs", "lengths"],
        )


def sketches(docs: DataFrame, shards: int, text_col: str, key_col: str) -> DataFrame:
    """Sparse sketches of the pieces of each partition (PARTS): rows of a shard, and rows of shard -1 with the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, piece = TaskContext.get().partitionId() << 32, _Piece()
        for batch in batches:
            keys, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for first, n, words, text in of_column(batch.column(0)):
                piece.add(words, text, keys[first : first + n], marks[first : first + n])
                if piece.n >= PIECE:
                    yield from piece.rows(number, shards)
                    number, piece = number + 1, _Piece()
        if piece.n:
            yield from piece.rows(number, shards)

    return text_batches(docs).select(text_col, key_col, "_mark").mapInArrow(run, PARTS)


def _cells(low: np.ndarray, row: int) -> np.ndarray:
    """The counters of minimizers in a row of a block."""
    return (mixed(low.astype(np.uint64) + np.uint64((row + 1) * int(_A) % 2**64)) >> np.uint64(64 - BLOCK_BITS)).astype(np.int64)


def estimated_twice(parts: list[np.ndarray]) -> np.ndarray:
    """Whether the merged count-min block of sparse sketches estimates two or more, for each of their entries in turn."""
    low = np.concatenate(parts)
    twice = np.ones(len(low), bool)
    for row in range(ROWS):
        block = np.zeros(1 << BLOCK_BITS, np.uint32)
        cells = _cells(low, row)
        np.add.at(block, cells, np.uint32(1))
        twice &= block[cells] >= 2
    return twice


def answers(parts: DataFrame) -> DataFrame:
    """(piece, shard, size, bits): for every piece and shard one bit a minimizer, whether the shard estimates it repeated."""

    def merge(group: pa.Table) -> pa.Table:
        twice = estimated_twice([np.frombuffer(c.as_py(), np.uint32) for c in group["cells"]])
        cuts = np.cumsum(group["size"].to_numpy())[:-1]
        return group.select(["piece", "shard", "size"]).append_column("bits", pa.array([np.packbits(x).tobytes() for x in np.split(twice, cuts)], pa.binary()))

    return parts.where("shard >= 0").select("piece", "shard", "size", "cells").groupBy("shard").applyInArrow(merge, "piece long, shard int, size int, bits binary")


def repeated_spans(parts: DataFrame) -> DataFrame:
    """(key, mark, n_words, same, spans) of each text: its length, a digest of its words, and as 32-bit pairs the windows
    [from, to) estimated repeated."""

    def spans(docs: pa.Table, found: pa.Table) -> pa.Table:
        d = np.frombuffer(docs["docs"][0].as_py(), _DOC)
        runs, lengths = np.frombuffer(docs["runs"][0].as_py(), np.uint32), np.frombuffer(docs["lengths"][0].as_py(), np.uint8).astype(np.int64)
        found = found.sort_by("shard")
        flags = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for b, n in zip(found["bits"], found["size"], strict=True)]
        twice = np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)
        on = (twice | (np.bincount(runs, minlength=len(twice)) > 1))[runs]  # a piece gives each minimizer once and knows its own repeats
        text = np.repeat(np.arange(len(d)), d["runs"])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        first = np.r_[0, np.cumsum(d["runs"])][:-1]
        base = np.r_[starts, 0][first] if len(starts) else np.zeros(len(d), np.int64)
        new = np.r_[True, (~on[:-1]) | (text[1:] != text[:-1])] if len(on) else on
        old = np.r_[new[1:] | ~on[1:], True] if len(on) else on
        a, b = np.flatnonzero(on & new), np.flatnonzero(on & old)
        of = text[a]
        pairs = np.stack([starts[a] - base[of], ends[b] - base[of]], 1).astype(np.int32)
        cuts = np.searchsorted(of, np.arange(len(d) + 1))
        return pa.table(
            {
                "key": pa.array(d["key"]), "mark": pa.array(d["mark"]), "n_words": pa.array(d["n_words"]), "same": pa.array([x.tobytes() for x in d["same"]], pa.binary()),
                "spans": pa.array([pairs[i:j].tobytes() if j > i else None for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()),
            }
        )

    told = parts.where("shard < 0").select("piece", "docs", "runs", "lengths")
    return told.groupBy("piece").cogroup(answers(parts).groupBy("piece")).applyInArrow(spans, "key long, mark int, n_words long, same binary, spans binary")


def shards_for(docs: DataFrame, text_col: str) -> int:
    """Shards so that a block has a counter for BYTES_A_COUNTER bytes of text."""
    size = docs.select(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(1, -(-size // (BYTES_A_COUNTER << BLOCK_BITS)))


def windows_in_spans(docs: DataFrame, places: bool) -> DataFrame:
    """Windows of (text, key, mark, spans) in their spans as (a, b, key, mark, place); without ``places`` one row (a, b, low, high) a key and chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for first, n, words, text in of_column(batch.column(0)):
                if len(words) < WINDOW:
                    continue
                begin = np.searchsorted(text, np.arange(n))
                pairs = [(np.frombuffer(s.as_py(), np.int32).reshape(-1, 2) + begin[k]) for k, s in enumerate(batch.column(3)[first : first + n])]
                edges = np.concatenate(pairs)
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, edges[:, 0], 1)
                np.add.at(step, edges[:, 1], -1)
                at = np.flatnonzero(np.cumsum(step))
                a, b = window_keys(words)
                a, b, of = a[at].view(np.int64), (b[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), text[at]
                key = keys[first + of]
                if not places:
                    order = np.lexsort((key, b, a))
                    a, b, key = a[order], b[order], key[order]
                    head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
                    tail = np.r_[head[1:], True] if len(a) else head
                    yield pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(b[head]), pa.array(key[head]), pa.array(key[tail])], names=["a", "b", "low", "high"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key), pa.array(marks[first + of]), pa.array((at - begin[of]).astype(np.int32))], names=["a", "b", "key", "mark", "place"])

    schema = "a long, b int, key long, mark int, place int" if places else "a long, b int, low long, high long"
    return docs.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", kept_col: str = "kept_text") -> DataFrame:
    """(``key_col``, n_words, n_removed, ``kept_col``): texts without the words covered by earlier windows.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes when a window of WINDOW consecutive words covers it whose word
    sequence also starts in a document with a smaller ``key_col``; windows are judged on the input. Kept words are
    joined by one space. A null, empty or short text has no window and loses nothing. A document without a key
    neither removes nor loses words; rows with equal keys do not remove each other's words, repeated rows each stay.
    Word and window hashes stand for the words (96 bits a window, 128 a text).
    """
    spark = docs.sparkSession
    found = docs.select(F.col(key_col).cast("long").alias(key_col), text_col, F.hash(text_col).alias("_mark"))
    keyed = found.where(F.col(key_col).isNotNull())
    parts = materialize(sketches(keyed, shards_for(keyed, text_col), text_col, key_col))
    told = materialize(repeated_spans(parts).where((F.col("n_words") >= WINDOW) & F.col("spans").isNotNull()).dropDuplicates(["key", "mark"]))
    earliest = told.groupBy("same").agg(F.min("key").alias("low"))
    judged = materialize(told.join(earliest, "same").select("key", "mark", "n_words", "spans", (F.col("key") > F.col("low")).alias("copy")))
    originals = judged.where(~F.col("copy")).select("key", "mark", "spans")
    wanted = spark.sparkContext.broadcast(key_filter(originals.select("key", "mark")))
    slotted = found.withColumn("_slot", key_slot(key_col, "_mark"))
    with_spans = (
        _let_through(slotted.where(F.col(key_col).isNotNull()), wanted)
        .join(originals.hint("merge"), (F.col(key_col) == F.col("key")) & (F.col("_mark") == F.col("mark")))
        .select(text_col, "key", "mark", "spans")
    )
    first = (
        windows_in_spans(with_spans, False)
        .groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where(F.col("low") < F.col("high")).select("a", "b", "low")
    )
    # a copy of a row has the same places, so each is wanted once
    removed = (
        windows_in_spans(with_spans, True).join(first, ["a", "b"]).where(F.col("key") > F.col("low"))
        .groupBy("key", "mark").agg(F.sort_array(F.collect_set("place")).alias("places"))
    )
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    runs = materialize(removed.select("key", "mark", _runs(F.col("places")).alias("runs")).union(judged.where("copy").select("key", "mark", whole.alias("runs"))))
    affected = spark.sparkContext.broadcast(key_filter(runs.select("key", "mark")))
    touched = _let_through(slotted, affected).join(runs.hint("merge"), (F.col(key_col) == runs["key"]) & (F.col("_mark") == runs["mark"]), "left").select(key_col, text_col, "runs")
    kept = _without(touched, text_col, key_col, kept_col, None)
    return kept.union(_without(slotted.select(key_col, text_col, "_slot"), text_col, key_col, kept_col, affected))


def _let_through(slotted: DataFrame, bits) -> DataFrame:
    """The documents that the filter of those that lose words lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column("_slot").to_numpy(zero_copy_only=False))))

    return slotted.mapInArrow(run, slotted.schema)


def _runs(places):
    """Sorted window places as an array of alternating starts and ends of covered words."""
    n = F.size(places)
    starts = F.filter(places, lambda p, i: F.coalesce(F.get(places, i - 1) + WINDOW < p, F.lit(True)))
    ends = F.filter(F.transform(places, lambda p, i: F.when(F.coalesce(F.get(places, i + 1) > p + WINDOW, i == n - 1), p + WINDOW)), lambda e: e.isNotNull())
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def _without(df: DataFrame, text_col: str, key_col: str, kept_col: str, ruled_out) -> DataFrame:
    """Texts without the words in their runs; with ``ruled_out`` (key, text, slot), whole texts of those that this filter rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if ruled_out is not None:
                batch = batch.filter(pa.array(~passes(ruled_out.value, batch.column(2).to_numpy(zero_copy_only=False))))
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n_words, n_removed, kept = [], [], []
                for k, t in enumerate(texts(part.column(1))):
                    words = split_words(t)
                    n_words.append(len(words))
                    runs = None if ruled_out is not None else part.column(2)[k].as_py()
                    if runs:
                        out, done = [], 0
                        for r in runs:
                            out += words[done : r["start"]]
                            done = r["end"]
                        words = out + words[done:]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[key_col, "n_words", "n_removed", kept_col])

    return df.mapInArrow(run, T.StructType([T.StructField(key_col, T.LongType()), T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField(kept_col, T.StringType(), False)]))

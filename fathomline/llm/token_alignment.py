"""Operator 13: alignment of two tokenizers over the same bytes.

A is a byte-level BPE vocabulary of the tokenizers library over space + text, B a SentencePiece model over the text,
which adds the space itself. Byte offsets where tokens of both end cut the text into groups; every A and B occurrence
of a group are linked. An id pair counts in how many rows it is linked.

Most groups hold one token of each with the same bytes. For these an array maps each A id to the B id of the same
bytes, so a pair is its A id alone: rows count into one vector as long as the vocabulary, and the vectors of all tasks
are summed. Only pairs of irregular groups are shuffled as pairs.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm import sentencepiece_codec
from fathomline.llm.byte_bpe import byte_characters
from fathomline.llm.common import CARRIED, carry, materialize, texts, unpack

#: Remembered pre-tokens in each of a worker's two generations, and the longest that is remembered.
MEMORY, LONGEST_KEPT = 150_000, 64
#: Groups of more links than this are counted by their distinct ids, and results of so many bytes leave a worker together.
WIDE, OUTPUT_BYTES = 4_096, 8_000_000
#: At most so many pairs, those linked in most rows, are answered by a table that every task holds.
FREQUENT = 100_000
#: Longer texts (characters) go to the encoder of operator 1, which holds less at a time than the library; both give the same ids.
LIBRARY_TEXT = 1_000_000
#: A pair as one number: the A id above, the B id below.
SHIFT = 32


class ByteLevel:
    """Ids of a byte-level vocabulary file; the library's merges, remembered by pre-token."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = t.model.tokenize
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        special = {i for i, x in t.get_added_tokens_decoder().items() if x.special}
        self.bytes: list[bytes] = [b""] * t.get_vocab_size()
        for piece, i in t.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = piece.encode() if i in special else bytes([back[c] for c in piece])
        self.special = special
        self.split = regex.compile(pattern).findall
        self.alphabet = dict(enumerate(chars))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        words = self.split(text)
        if len(self.known) > MEMORY:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = [w for w in set(words) if w not in known]
        for w in missing:
            known[w] = older.get(w) or array("I", [x.id for x in self.merges(w.encode().decode("latin-1").translate(self.alphabet))]).tobytes()
        ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32).astype(np.int64)
        for w in missing:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return ids


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b, self.b_library = ByteLevel(path_a, pattern), sentencepiece_codec.model(path_b), SentencePieceProcessor(model_file=path_b)
        self.a_bytes, self.b_bytes = self.a.bytes, self.b.surface
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # of equal bytes the vocabulary's own piece counts, not the byte of the fallback
        ids = {self.b_bytes[i]: i for i in [*self.b.byte_ids, *self.b.ids.values()]}
        self.same = np.array([-1 if i in self.a.special else ids.get(x, -1) for i, x in enumerate(self.a_bytes)], np.int64)
        # decimal ids with what follows them: in a group, at its end
        n, m = range(len(self.a_bytes)), range(len(self.b_bytes))
        self.text = [f"{i}{after}" for ids, after in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in ids]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both, none if the text is null or empty or either changes its bytes."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        encode = self.b_library.encode if len(text) <= LIBRARY_TEXT else self.b.encode
        a, b = self.a.encode(" " + text), np.array(encode(text), np.int64)
        raw = b" " + text.encode()
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        if b"".join([a_bytes[i] for i in a.tolist()]) != raw or b"".join([b_bytes[i] for i in b.tolist()]) != raw:
            return none, none
        return a, b

    def cuts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of each stand before every group and before the end."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        common = ends_b[np.searchsorted(ends_a, ends_b) != np.searchsorted(ends_a, ends_b, side="right")]
        return tuple(np.concatenate([[0], np.searchsorted(e, common) + 1]) for e in (ends_a, ends_b))

    def written(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        n, m = len(self.a_bytes), len(self.b_bytes)
        out = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.repeat(np.arange(len(at_a) - 1), np.diff(at_a)), np.repeat(np.arange(len(at_b) - 1), np.diff(at_b))
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[at_a[1:] - 1], last_b[at_b[1:] - 1] = True, True
        out[np.arange(len(a)) + at_b[group_a]] = a + n * last_a
        out[np.arange(len(b)) + at_a[group_b + 1]] = b + 2 * n + m * last_b
        text = self.text
        return "".join([text[i] for i in out.tolist()])[:-1]

    def links(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct A ids linked with the same bytes and their occurrences, other distinct pairs and theirs."""
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        one = (n_a == 1) & (n_b == 1)
        alone = a[at_a[:-1][one]]
        regular = self.same[alone] == b[at_b[:-1][one]]
        odd = ~one
        odd[np.flatnonzero(one)[~regular]] = True
        wide = odd & (n_a * n_b > WIDE)
        keys, times = [], []
        g = np.flatnonzero(odd & ~wide)
        if len(g):
            n = n_a[g] * n_b[g]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(n_b[g], n)
            keys.append(a[np.repeat(at_a[g], n) + within // width] << SHIFT | b[np.repeat(at_b[g], n) + within % width])
            times.append(np.ones(len(within), np.int64))
        for g in np.flatnonzero(wide):
            x, cx = np.unique(a[at_a[g] : at_a[g + 1]], return_counts=True)
            y, cy = np.unique(b[at_b[g] : at_b[g + 1]], return_counts=True)
            keys.append((x[:, None] << SHIFT | y[None, :]).ravel())
            times.append((cx[:, None] * cy[None, :]).ravel())
        ids, n_ids = [alone[regular]], [np.ones(int(regular.sum()), np.int64)]
        pairs = n_pairs = np.zeros(0, np.int64)
        if keys:
            pairs, n_pairs = _summed(np.concatenate(keys), np.concatenate(times))
            same = self.same[pairs >> SHIFT] == pairs & ((1 << SHIFT) - 1)
            ids.append(pairs[same] >> SHIFT)
            n_ids.append(n_pairs[same])
            pairs, n_pairs = pairs[~same], n_pairs[~same]
        return *_summed(np.concatenate(ids), np.concatenate(n_ids)), pairs, n_pairs


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, times, len(found)).astype(np.int64)


@lru_cache(maxsize=2)
def aligner(path_a: str, pattern: str, path_b: str) -> Aligner:
    return Aligner(path_a, pattern, path_b)


_LONGS, _INTS = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False)
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def groups(df: DataFrame, path_a: str, pattern: str, path_b: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all but the text) as one struct with the groups and links of each row.

    n_a, n_b, n_groups, n_links (long); ``groups`` text ``a1,a2|b1;a3|b2,b3``; ``ids`` and ``n_ids``: A ids linked with
    the B id of the same bytes, and how often; ``pairs`` and ``n_pairs``: other pairs (A id << 32 | B id). A text that is
    null or empty, or whose tokens do not give its bytes back, has none. Repeated rows stay; no shuffle.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    rows = df.select(carry(df, keep), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([rows.schema[CARRIED], *(T.StructField(n, T.LongType(), False) for n in FIGURES), T.StructField("groups", T.StringType(), False)])
    for n, kind in (("ids", _INTS), ("n_ids", _INTS), ("pairs", _LONGS), ("n_pairs", _INTS)):
        schema = schema.add(n, kind, False)

    def lists(found: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        offsets = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else [], kind))

    def result(batch: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
        figures, links = [r[:5] for r in rows], [r[5] for r in rows]
        plain = [pa.array(list(c), pa.string() if k == 4 else pa.int64()) for k, c in enumerate(zip(*figures, strict=True))]
        found = [lists([x[k] for x in links], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), *plain, *found], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = aligner(path_a, pattern, path_b)
        for batch in batches:
            start, size, rows = 0, 0, []
            for t in texts(batch.column(1)):
                a, b = m.tokens(t)
                at_a, at_b = m.cuts(a, b)
                n_links = int((np.diff(at_a) * np.diff(at_b)).sum())
                rows.append((len(a), len(b), len(at_a) - 1, n_links, m.written(a, b, at_a, at_b), m.links(a, b, at_a, at_b)))
                size += 8 * (len(a) + len(b)) + 12 * (len(rows[-1][5][0]) + len(rows[-1][5][2]))
                if size > OUTPUT_BYTES:
                    yield result(batch, start, rows)
                    start, size, rows = start + len(rows), 0, []
            if rows:
                yield result(batch, start, rows)

    return rows.mapInArrow(run, schema)


def identity_counts(found: DataFrame, size: int) -> DataFrame:
    """(a, n_docs): in how many rows of ``groups`` an A id is linked with the B id of the same bytes; a vector of ``size`` for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["a", "n_docs"])

    return found.select("ids").mapInArrow(run, "a long, n_docs long").groupBy("a").agg(F.sum("n_docs").alias("n_docs"))


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n_docs) of irregular pairs of ``groups``: in how many rows each is linked. Counted where the rows are, then summed."""
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))


def _a_of(pair: Column) -> Column:
    return F.shiftright(pair, SHIFT)


def align(df: DataFrame, path_a: str, pattern: str, path_b: str, text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """``keep`` columns with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and ``groups`` of each row.

    A pair's count is the number of rows that hold it linked; count_sum adds it over the row's links, n_best is how many
    links have the highest count of their A id. ``digest`` gives ``groups_sha256`` (empty without tokens) instead of the
    groups themselves. Rows without tokens have zeros, repeated rows count each, an empty table gives none; a clashing
    result name gets an underscore.

    The vectors of identity counts and best counts are as long as the vocabulary and go to every task, with the FREQUENT
    pairs of most rows; the rest of the irregular pairs meet their counts in a join, so no pair there is in many rows.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    found = groups(df, path_a, pattern, path_b, text_col, keep)
    text = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("") if digest else F.col("groups")
    rows = materialize(found.select(F.monotonically_increasing_id().alias("row"), CARRIED, *FIGURES, text.alias("groups"), "ids", "n_ids", "pairs", "n_pairs"))
    size = len(aligner(path_a, pattern, path_b).a_bytes)
    same = identity_counts(rows, size)
    pairs = materialize(pair_counts(rows))
    best = same.unionByName(pairs.groupBy(_a_of(F.col("pair")).alias("a")).agg(F.max("n_docs").alias("n_docs"))).groupBy("a").agg(F.max("n_docs").alias("best"))
    by_a, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in best.join(same, "a", "left").toLocalIterator():  # a row for each id of the vocabulary at most
        by_a[r["a"]], top[r["a"]] = r["n_docs"] or 0, r["best"]
    held = pairs.orderBy(F.desc("n_docs"), "pair").limit(FREQUENT).collect()
    frequent = np.array(sorted((r["pair"], r["n_docs"]) for r in held), np.int64).reshape(-1, 2)
    spark = df.sparkSession
    known = spark.sparkContext.broadcast((by_a, top, frequent[:, 0].copy(), frequent[:, 1].copy()))
    answered = T.StructType([T.StructField("row", T.LongType(), False), T.StructField("n_best", T.LongType(), False), T.StructField("count_sum", T.LongType(), False), T.StructField("rest", _LONGS, False), T.StructField("n_rest", _INTS, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_a, top, keys, counts = known.value
        plain = lambda c: c.flatten().to_numpy(zero_copy_only=False)
        for batch in batches:
            row, ids, n_ids, pair, n_pair = batch.columns
            rows_of = lambda c: np.repeat(np.arange(len(c)), c.value_lengths().to_numpy(zero_copy_only=False))
            x, times, at = plain(ids), plain(n_ids).astype(np.int64), rows_of(ids)
            n_best, total = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            np.add.at(total, at, times * by_a[x])
            np.add.at(n_best, at, times * (by_a[x] == top[x]))
            x, times, at = plain(pair), plain(n_pair).astype(np.int64), rows_of(pair)
            place = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
            hit = keys[place] == x if len(keys) else np.zeros(len(x), bool)
            n = counts[place[hit]] if len(keys) else np.zeros(0, np.int64)
            np.add.at(total, at[hit], times[hit] * n)
            np.add.at(n_best, at[hit], times[hit] * (n == top[x[hit] >> SHIFT]))
            left = np.cumsum([0, *np.bincount(at[~hit], minlength=len(row))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])), pa.ListArray.from_arrays(pa.array(left), pa.array(times[~hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([row, pa.array(n_best), pa.array(total), *rest], names=answered.names)

    some = materialize(rows.select("row", "ids", "n_ids", "pairs", "n_pairs").mapInArrow(run, answered))
    open_pairs = some.select("row", F.explode(F.arrays_zip("rest", "n_rest")).alias("p")).select("row", F.col("p.rest").alias("pair"), F.col("p.n_rest").alias("times"))
    bests = best.select("a", "best")
    counted = pairs.join(F.broadcast(bests), _a_of(F.col("pair")) == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("best")).alias("is_best"))
    late = open_pairs.join(counted, "pair").groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("late_best"), F.sum(F.col("times") * F.col("n_docs")).alias("late_sum"))
    out = rows.select("row", CARRIED, *FIGURES, "groups").join(some.select("row", "n_best", "count_sum"), "row").join(late, "row", "left")
    results = {n: F.col(n) for n in FIGURES}
    results |= {"n_best": F.col("n_best") + F.coalesce("late_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("late_sum", F.lit(0)), "groups_sha256" if digest else "groups": F.col("groups")}
    return unpack(out, keep, **results)

"""Operator 5: language identification with unigram models over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over
all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Piece
probabilities are fitted by expectation-maximisation: Spark counts the words of the training texts by language,
each round's expected piece counts come from tasks over these counts and are summed by language and piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import materialize, text_batches, texts, unique_names

#: Bound of the labelled texts that the models are fitted on; with more labelled rows a sample by document id is taken.
TRAINING_ROWS = 12_000
ROUNDS = 2
SMOOTHING = 0.05
#: Probability of a letter that no piece has.
UNKNOWN = 1e-9
#: Remembered words of a worker.
MEMORY = 400_000
#: Letters that are scored together, and letters after which running products are scaled back.
CHUNK, SCALE_EVERY = 400_000, 8
_WORD = re.compile(r"[^\W\d_]+")
START = "▁"


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Lower-cased letter pieces of the vocabulary with an optional word start, numbered from 0."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kept = sorted({x for p in proto.pieces if p.type == 1 and (x := p.piece.lower()).removeprefix(START).isalpha() and START not in x[1:]})
    return {p: i for i, p in enumerate([*kept, START])}


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, whole."""
    return _WORD.findall(text.lower()) if text else []


def longest_piece(vocabulary: dict[str, int]) -> int:
    """Characters of the longest piece."""
    return max(map(len, vocabulary), default=1)


def _piece_ids(group: list[str], vocabulary: dict[str, int], longest: int) -> list[np.ndarray]:
    """For each length k up to the longest piece the piece numbers (word, end) of substrings of k characters; -1 where none, -2 for a lone unknown letter."""
    get, n = vocabulary.get, len(group[0])
    out = []
    for k in range(1, min(longest, n) + 1):
        none = -2 if k == 1 else -1
        ids = np.array([get(w[j : j + k], none) for w in group for j in range(n - k + 1)], np.int32)
        out.append(ids.reshape(len(group), n - k + 1))
    return out


def _pass(ids: list[np.ndarray], probability: np.ndarray, n: int, back: bool, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log of the sum over all segmentations (word, language), and with ``keep`` those of all beginnings (``back``: endings).

    The sums of the last beginnings are kept as products that are scaled back every few letters, so a word of any
    length neither overflows nor vanishes.
    """
    words, langs = ids[0].shape[0], probability.shape[1]
    recent, scale = [np.ones((words, langs))], np.zeros((words, langs))
    kept = [np.zeros((words, langs))] if keep else []
    for j in range(1, n + 1):
        now = np.zeros((words, langs))
        for k in range(1, min(len(ids), j) + 1):
            # the piece of k letters that ends at j, or read from the end
            now += recent[-k] * probability[ids[k - 1][:, n - j if back else j - k]]
        recent = [*recent[-(len(ids) - 1) :], now] if len(ids) > 1 else [now]
        if keep:
            kept.append(scale + np.log(now))
        if j % SCALE_EVERY == 0:
            recent = [r / now for r in recent]
            scale = scale + np.log(now)
    return scale + np.log(recent[-1]), kept


def forward(group: list[str], vocabulary: dict[str, int], probability: np.ndarray, expected: tuple[np.ndarray, np.ndarray] | None = None, longest: int | None = None) -> np.ndarray:
    """Log probabilities (word, language) of words of equal length that carry the start mark.

    probability: (piece + 2, language); its last rows are those of -2 (an unknown letter) and -1 (no piece).
    expected: weights (word, language) and an array like probability, to which expected piece counts are added.
    """
    n, langs = len(group[0]), probability.shape[1]
    ids = _piece_ids(group, vocabulary, longest or longest_piece(vocabulary))
    total, before = _pass(ids, probability, n, False, expected is not None)
    if expected is not None:
        weights, counts = expected
        _, after = _pass(ids, probability, n, True, True)
        for k in range(1, len(ids) + 1):
            for i in range(n - k + 1):
                x = ids[k - 1][:, i]
                on = x >= 0
                if on.any():
                    share = np.exp(before[i][on] + after[n - i - k][on] - total[on]) * probability[x[on]] * weights[on]
                    for lang in range(langs):
                        counts[:, lang] += np.bincount(x[on], share[:, lang], len(counts))
    return total


def by_length(found: list[str]) -> Iterator[list[int]]:
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(found):
        groups.setdefault(len(w), []).append(k)
    for n, g in groups.items():
        step = max(1, CHUNK // max(1, n))
        for a in range(0, len(g), step):
            yield g[a : a + step]


def _table(counts: np.ndarray) -> np.ndarray:
    """Smoothed probabilities with the rows of an unknown letter and of no piece."""
    p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(0)
    return np.vstack([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def train(labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, probabilities) fitted to texts with a language; null texts and languages are left out.

    With more than TRAINING_ROWS rows a share of them, chosen by a hash of ``key_col``, is used.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > TRAINING_ROWS:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key_col).cast("string"), F.lit("train")), F.lit(1_000_000)) < int(1_000_000 * TRAINING_ROWS / n))
    vocabulary = pieces(path)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, t in zip(batch.column(0), texts(batch.column(1)), strict=True):
                name = lang.as_py()
                for w in words(t):
                    counts[name, w] = counts.get((name, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    counted = materialize(rows.select(F.col(lang_col).cast("string"), text_col).mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = [r[0] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return [], np.zeros((len(vocabulary) + 2, 0))
    table = _table(np.ones((len(vocabulary), len(langs))))
    for _ in range(ROUNDS):
        table = _table(_expected(counted, path, langs, table))
    return langs, table


def _expected(counted: DataFrame, path: str, langs: list[str], table: np.ndarray) -> np.ndarray:
    """Expected piece counts under ``table``; at most languages times pieces numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = pieces(path), np.zeros((len(table) - 2, len(langs)))
        longest = longest_piece(vocabulary)
        for batch in batches:
            found = [START + w for w in texts(batch.column("word"))]
            column = {x: k for k, x in enumerate(langs)}
            weights = np.zeros((len(found), len(langs)))
            weights[np.arange(len(found)), [column[x] for x in batch.column("lang").to_pylist()]] = batch.column("n").to_numpy()
            for g in by_length(found):
                forward([found[k] for k in g], vocabulary, table, (weights[g], counts), longest)
        at, lang = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(lang.astype("int32")), pa.array(counts[at, lang])], names=["piece", "lang", "n"])

    rows = counted.mapInArrow(run, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((len(table) - 2, len(langs)))
    out[rows["piece"].to_numpy(int), rows["lang"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out


def identify(df: DataFrame, path: str, langs: list[str], table: np.ndarray, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred and score.

    lang_pred is the language under which the whole text is most probable (ties: the first by name), ``und`` for a
    text without a letter, a null text, or where nothing was learned. score is that language's share of the
    likelihoods a word (geometric mean), 0 for ``und``. No shuffle; the models (languages times pieces) go to the tasks.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    at = [df.columns.index(c) for c in keep]
    names = unique_names(df.select(*keep), "lang_pred", "score")
    model = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, probability = pieces(path), model.value
        longest = longest_piece(vocabulary)
        place: dict[str, int] = {}
        scores = np.zeros((0, len(langs)))
        for batch in batches:
            column = batch.column(text_col)
            preds, sure = [], []
            for a in range(0, len(column), 500):
                split = [words(t) for t in texts(column[a : a + 500])]
                if len(place) > MEMORY:
                    place, scores = {}, scores[:0]
                new = list({w for ws in split for w in ws if w not in place})
                if new and langs:
                    more = np.zeros((len(new), len(langs)))
                    marked = [START + w for w in new]
                    for g in by_length(marked):
                        more[g] = forward([marked[k] for k in g], vocabulary, probability, None, longest)
                    place.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
                    scores = np.vstack([scores, more])
                for ws in split:
                    if not ws or not langs:
                        preds.append("und")
                        sure.append(0.0)
                        continue
                    total = scores[[place[w] for w in ws]].sum(0)
                    best = int(total.argmax())
                    preds.append(langs[best])
                    sure.append(float(1 / np.exp(np.clip((total - total[best]) / len(ws), -700, 0)).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(preds, pa.string()), pa.array(sure, pa.float64())], names=[*keep, *names])

    return text_batches(df).mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in at), T.StructField(names[0], T.StringType(), False), T.StructField(names[1], T.DoubleType(), False)]))


def held_out(key: Column) -> Column:
    """Documents that the models never see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))

"""Operator 3: benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces: within k edits of the item at least one
piece stands unchanged; an item too short for an edit is its one piece. An Aho-Corasick automaton finds every piece in
every text, each hit gives the window where the item would stand, the windows of an item are merged into regions of the
text that do not overlap, and Myers' bit-parallel distance, one pass over each region, decides whether the item stands
there within its budget. So repetitive items and texts cost a pass over the text for an item. Texts are read once for each block of items; a block is bounded in characters, and with several blocks the
hits of each are written before the next is searched, so a task holds one block and what goes to the tasks does not
grow with the benchmark or the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import materialize, text_batches, texts, unique_names

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 20
#: Characters of normalised items in a block.
BLOCK_CHARS = 8_000_000
_SPACE = re.compile(r"[\W_]+")

HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType(), False), T.StructField("distance", T.IntegerType(), False), T.StructField("end", T.LongType(), False)]), False)


def normalise(text: str | None) -> str:
    """Lower case, with every run of signs and white space as one space."""
    return _SPACE.sub(" ", text.lower()).strip() if text else ""


def distance(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(least edit distance of ``pattern`` to any part of ``text``, where that part ends) if within budget; Myers' bit vectors, first end of equals."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    pv, mv, score = mask, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        pv = (mh << 1 & mask) | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return (best, at) if best <= budget else None


class Items:
    """A block of normalised items, their pieces and an automaton over the pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, len(t) // CHARS_PER_EDIT) for i, t in items if t]
        pieces: dict[str, dict[int, tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * x // (k + 1) for x in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                of = pieces.setdefault(t[a:b], {})
                of[n] = (of[n][0], a) if n in of else (a, a)
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            # an item has a piece once, with its first and its last place
            self.automaton.add_word(p, (len(p), [(n, first, last) for n, (first, last) in where.items()]))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item found, at its best place, the first of equals."""
        if not self.items or not (t := normalise(text)):
            return []
        found: dict[int, tuple[int, int]] = {}
        regions: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.automaton.iter(t):
            for n, first, last in where:
                _, item, budget = self.items[n]
                start = end + 1 - length
                if not budget:
                    if n not in found and not t[start - 1 : start].strip() and not t[end + 1 : end + 2].strip():
                        found[n] = (0, end + 1)
                    continue
                a, b = max(0, start - last - budget), start - first + len(item) + budget
                known = regions.setdefault(n, [[a, b]])
                if a <= known[-1][1] and b >= known[-1][0]:
                    known[-1] = [min(a, known[-1][0]), max(b, known[-1][1])]
                else:
                    known.append([a, b])
        for n, known in regions.items():
            _, item, budget = self.items[n]
            for a, b in _merged(known):
                exact = t.find(item, a, b)
                hit = (0, exact - a + len(item)) if exact >= 0 else distance(item, t[a:b], budget)
                if hit and (n not in found or hit[0] < found[n][0]):
                    found[n] = (hit[0], a + hit[1])
                if hit and not hit[0]:
                    break
        return sorted((self.items[n][0], d, e) for n, (d, e) in found.items())


def _merged(regions: list[list[int]]) -> list[list[int]]:
    """Regions in order, those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(regions):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_CHARS characters (one item at least), streamed to the driver partition by partition."""
    block, size = [], 0
    for r in benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).distinct().toLocalIterator():
        t = normalise(r[1])
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], t))
        size += len(t)
    yield block


def search(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, hits_col: str = "leaks") -> DataFrame:
    """``keep`` columns with ``hits_col``: array of (item_id, distance, end) of the test items found in each text.

    An item is found where its least edit distance to a part of the normalised text is within its budget of one
    edit for CHARS_PER_EDIT characters; a shorter item has no budget and is found where it stands as whole words.
    Each item is listed once a text, at its least distance. A null or empty text has none, null items and items
    without letters and digits are no items, an empty benchmark finds nothing. Copies and repeated rows are each searched.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    text, hits, more = unique_names(docs, "_text", "_hits", "_more")
    out = docs.select(*keep, F.col(text_col).alias(text))
    found = None
    waiting = blocks(benchmark)
    block = next(waiting)
    while block is not None:
        after = next(waiting, None)
        items = docs.sparkSession.sparkContext.broadcast(block)
        out = _add(out, items, text, hits if found is None else more)
        if found is not None:
            out = out.select(*keep, text, F.concat(hits, more).alias(hits))
        if after is not None:
            out = materialize(out)
            items.unpersist()
        found, block = hits, after
    (name,) = unique_names(docs.select(*keep), hits_col)
    return out.select(*keep, F.col(hits).alias(name))


def _add(docs: DataFrame, items, text: str, name: str) -> DataFrame:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(items.value)
        for batch in batches:
            found = [[{"item_id": i, "distance": d, "end": e} for i, d, e in block.matches(t)] for t in texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

    return text_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, HIT, False)]))


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """One row (``key_col``, item_id, distance) for each test item found in a text."""
    found = search(docs.select(key_col, text_col), benchmark, text_col, keep=[key_col])
    return found.select(key_col, F.explode(found.columns[-1]).alias("h")).select(key_col, "h.item_id", F.col("h.distance").cast("long").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no test item is found, with their columns."""
    found = search(docs, benchmark, text_col, keep=docs.columns)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)

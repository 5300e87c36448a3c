"""Operator 9: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary trie has failure links: when no child continues the match, the link leads to the node that stands
for what is left after the pieces that greedy matching pops, and the number of popped pieces is stored with the
link. So a word's count needs one step a character and one addition a link; no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathomline.llm.common import texts, unique_names

START = "▁"
#: Remembered words of a worker.
MEMORY = 400_000


class Automaton:
    """Greedy longest match over a vocabulary. Where no piece starts, a character counts as its UTF-8 bytes."""

    def __init__(self, vocabulary: set[str]):
        self.vocabulary = vocabulary
        self.children: list[dict[str, int]] = [{}]
        piece = [False]
        own = [0]  # pieces that a complete entry counts for
        # single characters complete every entry, so that a match can always go on from some piece
        entries = dict.fromkeys(vocabulary, 1)
        for p in vocabulary:
            for c in p:
                entries.setdefault(c, len(c.encode("utf-8", "surrogatepass")))
        for p, n in sorted(entries.items()):
            v = 0
            for c in p:
                if c not in self.children[v]:
                    self.children[v][c] = len(self.children)
                    self.children.append({})
                    piece.append(False)
                    own.append(0)
                v = self.children[v][c]
            piece[v], own[v] = True, n
        self.link = [0] * len(self.children)
        self.popped = [0] * len(self.children)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.children[u].items():
                if piece[v]:
                    self.link[v], self.popped[v] = 0, own[v]
                else:
                    z, n = self.link[u], self.popped[u]
                    while c not in self.children[z]:
                        n += self.popped[z]
                        z = self.link[z]
                    self.link[v], self.popped[v] = self.children[z][c], n
                queue.append(v)

    def count(self, word: str) -> int:
        """Greedy pieces of a word."""
        children, link, popped = self.children, self.link, self.popped
        v = n = 0
        for c in word:
            while c not in children[v] and v:
                n += popped[v]
                v = link[v]
            if c in children[v]:
                v = children[v][c]
            else:
                n += len(c.encode("utf-8", "surrogatepass"))
        while v:
            n += popped[v]
            v = link[v]
        return n


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Over the normal pieces of a SentencePiece vocabulary file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return Automaton({p.piece for p in proto.pieces if p.type == 1})


def count_tokens(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with n_words and n_tokens (long) of ``text_col``.

    Words are ``[^\\x20\\x09-\\x0D]+``; each is matched with the word-start mark before it. A null or empty text has
    none. Repeated rows stay; a row is counted where it is read, without a shuffle.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    at = [df.columns.index(c) for c in keep]
    names = unique_names(df.select(*keep), "n_words", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        known: dict[bytes, int] = {}
        get = known.get
        for batch in batches:
            n_words, n_tokens = [], []
            for t in texts(batch.column(text_col)):
                found = (t or "").encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at ASCII white space only
                total = 0
                for w in found:
                    n = get(w)
                    if n is None:
                        if len(known) > MEMORY:
                            known.clear()
                        n = known[w] = a.count(START + w.decode("utf-8", "surrogatepass"))
                    total += n
                n_words.append(len(found))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*keep, *names])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in at), T.StructField(names[0], T.LongType(), False), T.StructField(names[1], T.LongType(), False)]))

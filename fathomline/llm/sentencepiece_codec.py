"""Operator 1: exact SentencePiece (merge type) encoding and decoding by backtracking.

A sequence of pieces is the merge result of a text exactly if every piece is the merge result of its own
characters and every two neighbours stay apart when their joined characters are merged anew: merges in a
region that no other merge has entered run as they would alone. So the encoder never runs the merge queue
over a text. Aho-Corasick gives the longest piece at each position, the search takes it, falls back to the
next shorter piece that is a prefix of it when the pair with its left neighbour is not compatible, and marks
positions from which the rest cannot be encoded in a bit field. A prefix of a text has one encoding only, so a
marked position need not be tried again and the search is linear.

Texts are cut where no piece can cross (no piece holds the two adjacent characters), and cut parts are
remembered, so running prose costs a table look-up a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathomline.llm.common import text_batches, texts, unique_names

SPACE = "▁"
#: Remembered parts of texts in a worker; beyond it the memory starts anew (results do not change).
MEMORY = 150_000
#: Parts longer than this are not remembered.
LONGEST_KEPT = 64
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class _Always(dict):
    """What may begin a part: any piece."""

    def get(self, key, default=None):
        return True

    def __bool__(self):
        return True


class PieceModel:
    """The pieces and scores of a SentencePiece merge-type model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        #: What each id decodes to, in UTF-8, before the leading space is dropped.
        self.surface: list[bytes] = []
        self.spaced: set[int] = set()
        for i, p in enumerate(proto.pieces):
            if p.type in (USER_DEFINED, UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
            if p.type == NORMAL:
                self.scores[p.piece], self.ids[p.piece] = p.score, i
                self.surface.append(p.piece.replace(SPACE, " ").encode())
                if p.piece.startswith(SPACE):
                    self.spaced.add(i)
            elif p.type == BYTE:
                b = int(p.piece[1:-1], 16)
                self.byte_ids[b] = i
                self.surface.append(bytes([b]))
            else:
                self.surface.append(" ⁇ ".encode() if p.type == UNKNOWN else b"")
        # a piece that its own characters do not merge to never occurs
        self.pieces = {p for p in self.scores if len(p) == 1 or self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            if len(p) > 1:
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter: dict[str, str] = {}
        for p in self.pieces:
            if len(p) > 1:
                self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.pieces), p[0])
        self.apart: dict[str, dict[str, bool]] = {"": _Always()}
        self.pairs = 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.splitter = self._splitter()

    def _splitter(self) -> re.Pattern:
        """Cuts before a space mark that follows something else, and between letters and signs, where the pieces allow it.

        signs: ASCII characters other than letters that no piece holds beside any other kind of character.
        """
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            return re.compile(r".+", re.DOTALL)
        beside: dict[str, set[str]] = {chr(c): set() for c in range(128) if not chr(c).isalpha()}
        for p in self.pieces:
            for a, b in zip(p, p[1:], strict=False):
                if a in beside:
                    beside[a].add(b)
                if b in beside:
                    beside[b].add(a)
        signs = set(beside)
        while mixed := {c for c in signs if not beside[c] <= signs | {SPACE}}:
            signs -= mixed
        kept = re.escape("".join(sorted(signs)))
        if not kept:
            return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        return re.compile(f"{SPACE}+(?:[{kept}]+|[^{SPACE}{kept}]*)|[{kept}]+|[^{SPACE}{kept}]+")

    def merged(self, s: str) -> list[str]:
        """The merge result of a short string: best score first, then leftmost."""
        parts, scores = list(s), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = scores.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the two pieces stay apart when their characters are merged anew; remembered by the left piece."""
        if self.pairs > 2 * MEMORY:
            self.apart, self.pairs = {"": _Always()}, 0
        self.pairs += 1
        ok = self.apart.setdefault(a, {})[b] = self.merged(a + b) == [a, b]
        return ok

    def pieces_of(self, s: str) -> list[str]:
        """The pieces of a part, by backtracking."""
        n = len(s)
        longest = [1] * n
        for end, k in self.automaton.iter(s):
            if k > longest[end - k + 1]:
                longest[end - k + 1] = k
        failed = 0  # bit i: what follows position i cannot be encoded after the one encoding of what precedes it
        out, pos, last, shorter = [], 0, "", self.shorter
        right = self.apart[""]
        piece: str | None = s[: longest[0]]
        while True:
            end = pos + len(piece)
            if not (failed and failed >> end & 1):
                ok = right.get(piece)
                if ok is None:
                    ok = self.compatible(last, piece)
                if ok:
                    out.append(piece)
                    if end == n:
                        return out
                    pos, last = end, piece
                    right = self.apart.get(piece) or self.apart.setdefault(piece, {})
                    piece = s[pos : pos + longest[pos]]
                    continue
            piece = shorter.get(piece)
            while piece is None:
                failed |= 1 << pos
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else ""
                right = self.apart.get(last) or self.apart.setdefault(last, {})
                piece = shorter.get(piece)

    def part_ids(self, part: str) -> tuple[int, ...]:
        ids: list[int] = []
        for p in self.pieces_of(part):
            i = self.ids.get(p)
            if i is None:
                ids.extend(self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                ids.append(i)
        out = tuple(ids)
        if len(part) <= LONGEST_KEPT:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[part] = out
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        s = text.replace(" ", SPACE)
        if self.dummy_prefix:
            s = SPACE + s
        get, slow = self.known.get, self.part_ids
        return list(chain.from_iterable([get(p) or slow(p) for p in self.splitter.findall(s)]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become one U+FFFD each."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        if self.dummy_prefix and ids and ids[0] in self.spaced:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _lenient(raw)


def _lenient(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode())
            out.append("�" * (e.end - e.start))
            at += e.end
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the piece ids of ``text_col`` as ``ids_col array<int>``, and if asked what they decode to as ``decoded_col``.

    No begin or end ids, no sampling. A null or empty text has no ids and decodes to the empty text. Repeated
    rows stay, other columns (those in ``keep``, by default all) pass through; a clashing result name gets an underscore. No shuffle: a row is
    encoded where it is read, so a skewed key or a group of copies costs no more than its bytes.
    """
    keep = df.columns if keep is None else keep
    names = unique_names(df.select(*keep), ids_col, *([decoded_col] if decoded_col else []))
    at = [df.columns.index(c) for c in keep]
    schema = T.StructType([*(df.schema.fields[i] for i in at), T.StructField(names[0], T.ArrayType(T.IntegerType(), False), False)])
    if decoded_col:
        schema = schema.add(names[1], T.StringType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            ids, decoded = [], []
            for t in texts(batch.column(text_col)):
                ids.append(pa.array(x := m.encode(t or ""), pa.int32()))
                if decoded_col:
                    decoded.append(m.decode(x))
            offsets = pa.array([0, *_running(len(x) for x in ids)], pa.int32())
            values = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
            columns = [*(batch.column(i) for i in at), pa.ListArray.from_arrays(offsets, values)]
            if decoded_col:
                columns.append(pa.array(decoded, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return text_batches(df).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``ids_col`` as ``text_col``; null ids decode to the empty text."""
    (name,) = unique_names(df, text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            out = [m.decode(x.as_py() or []) for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def _running(sizes) -> Iterator[int]:
    total = 0
    for n in sizes:
        total += n
        yield total

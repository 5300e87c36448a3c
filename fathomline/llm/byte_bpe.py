"""Operator 12: byte-level BPE encoding and decoding through a serialised SentencePiece model.

The rank file becomes a SentencePiece merge model without any training: each token is a piece, its bytes written as the
256 printable characters of byte-level vocabularies, scored by its negative rank, and nothing is normalised. Merging the
best-scored pair first, leftmost on ties, is then merging the lowest rank first. A text is cut by the pre-token pattern,
each match is looked up as a whole token and otherwise encoded by that model; ids decode by the inverse mapping.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fathomline.llm.common import texts, unique_names

#: Remembered pre-tokens in each of a worker's two generations, and the longest that is remembered.
MEMORY, LONGEST_KEPT = 200_000, 64
#: A character outside the alphabet of mapped bytes.
UNKNOWN = "▅"
#: Bytes of results that leave a worker together.
OUTPUT_BYTES = 8_000_000


@lru_cache(maxsize=1)
def byte_characters() -> tuple[str, ...]:
    """The character for each byte: itself where it is printable in Latin-1, else the next one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    after = iter(range(256, 512))
    return tuple(chr(b) if b in printable else chr(next(after)) for b in range(256))


def serialised(tokens: list[bytes]) -> bytes:
    """A SentencePiece model whose piece i is ``tokens[i]`` with score -i; one piece more stands for the unknown."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    proto = pb.ModelProto()
    for i, t in enumerate(tokens):
        proto.pieces.add(piece="".join([chars[b] for b in t]), score=-i, type=pb.ModelProto.SentencePiece.NORMAL)
    proto.pieces.add(piece=UNKNOWN, score=0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = proto.trainer_spec
    spec.model_type, spec.vocab_size, spec.byte_fallback = pb.TrainerSpec.BPE, len(tokens) + 1, False
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    norm = proto.normalizer_spec
    norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
    return proto.SerializeToString()


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("the ranks must be 0, 1, 2 and so on, each once")
    if missing := {bytes([b]) for b in range(256)} - ranks.keys():
        raise ValueError(f"{len(missing)} of the 256 single bytes are no tokens")
    return tokens


class ByteBPE:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.pieces = SentencePieceProcessor(model_proto=serialised(self.tokens))
        self.split = regex.compile(pattern).findall
        # bytes read as Latin-1 and translated are the piece alphabet
        self.alphabet = dict(enumerate(byte_characters()))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of matches of the pattern, as little-endian unsigned 32-bit integers."""
        whole, older, known = self.whole, self.older, self.known
        rest: list[str] = []
        for w in words:
            x = older.get(w)
            if x is None:
                at = whole.get(w.encode())
                if at is None:
                    rest.append(w)
                    continue
                x = at.to_bytes(4, "little")
            known[w] = x
        if rest:
            # one call for all: the unknown piece between two of them takes part in no merge
            line = UNKNOWN.join([w.encode().decode("latin-1").translate(self.alphabet) for w in rest])
            ids = np.array(self.pieces.encode(line), "<u4")
            ends = [*(np.flatnonzero(ids == len(self.tokens)) * 4).tolist(), 4 * len(ids)]
            raw, at = ids.tobytes(), 0
            for w, end in zip(rest, ends, strict=True):
                known[w], at = raw[at:end], end + 4

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        words = self.split(text)
        if len(self.known) > MEMORY:  # what is still met moves on from the older half, the rest is forgotten
            self.older, self.known = self.known, {}
        known = self.known
        missing = [w for w in set(words) if w not in known]
        if missing:
            self.learn(missing)
        out = b"".join(map(known.__getitem__, words))
        for w in missing:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return out

    def decode(self, packed: bytes) -> bytes:
        """The bytes of ids."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(packed, "<u4").tolist()])


@lru_cache(maxsize=2)
def model(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None, keep: list[str] | None = None, packed: bool = False
) -> DataFrame:
    """``df`` with the byte-level BPE ids of ``text_col`` as ``ids_col``, and if asked the decoded bytes as ``decoded_col binary``.

    ``ids_col`` is array<int>, or with ``packed`` binary: little-endian unsigned 32-bit integers, as token files hold
    them. No special tokens: their strings are ordinary text. A null or empty text has no ids and decodes to no bytes.
    Repeated rows stay; the columns in ``keep`` (by default all) pass through, a clashing result name gets an underscore.
    No shuffle: a row is encoded where it is read, a very long text alone, and results leave in bounded parts.
    """
    keep = df.columns if keep is None else keep
    names = unique_names(df.select(*(f"`{c}`" for c in keep)), ids_col, *([decoded_col] if decoded_col else []))
    at, text_at = [df.columns.index(c) for c in keep], df.columns.index(text_col)
    schema = T.StructType([*(df.schema.fields[i] for i in at), T.StructField(names[0], T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False), False)])
    if decoded_col:
        schema = schema.add(names[1], T.BinaryType(), False)

    def result(batch: pa.RecordBatch, start: int, ids: list[bytes], decoded: list[bytes]) -> pa.RecordBatch:
        if packed:
            column = pa.array(ids, pa.binary())
        else:
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
        columns = [*(batch.column(i).slice(start, len(ids)) for i in at), column]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(decoded, pa.binary())] if decoded_col else []), names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, pattern)
        for batch in batches:
            start, size, ids, decoded = 0, 0, [], []
            for t in texts(batch.column(text_at)):
                ids.append(x := m.encode(t or ""))
                size += len(x)
                if decoded_col:
                    decoded.append(m.decode(x))
                if size > OUTPUT_BYTES:
                    yield result(batch, start, ids, decoded)
                    start, size, ids, decoded = start + len(ids), 0, [], []
            if ids:
                yield result(batch, start, ids, decoded)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the ids in ``ids_col`` (array of integers or packed binary) as ``decoded_col binary``; null ids decode to no bytes."""
    (name,) = unique_names(df, decoded_col)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType(), False)])
    at = df.columns.index(ids_col)
    packed = isinstance(df.schema.fields[at].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, pattern)
        for batch in batches:
            found = (x.as_py() for x in batch.column(at))
            out = [m.decode((x or b"") if packed else np.array(x or [], "<u4").tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)

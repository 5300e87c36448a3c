"""64-bit hashes of the words of many texts at once, on the bytes of an Arrow column.

Words are ``[^\\x20\\x09-\\x0D]+``. A word's hash is a polynomial of its bytes, taken from one running sum over the
bytes of a piece of the column, so no word becomes a Python object. Words too long for that are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are hashed together, and the longest word that the polynomial is used for.
PIECE, LONG_WORD = 500_000, 256
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _upto(n: int) -> list[np.ndarray]:
    """Powers of the factor and of its inverse, for n places at least."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 65_536)
        for k, f in enumerate((_FACTOR, _INVERSE)):
            p = np.full(size, f, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first byte) of every word in ``data``; a word also ends where one of ``begins`` starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space, begin = _SPACE[data], np.zeros(n + 1, bool)
    begin[begins] = True
    first, last = ~space, ~space
    first[1:] &= space[:-1] | begin[1:-1]
    last[:-1] &= space[1:] | begin[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _upto(n)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=run[1:])
    h = mixed((run[ends] - run[starts]) * up[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return h, starts


def of_column(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, hashes, row of each hash counted from the first) for a few rows at a time.

    ``lower`` lower-cases A-Z. A null text has no words. A text above PIECE bytes comes alone and is hashed piece by
    piece, cut at white space.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1
        stop = min(len(column), max(row + 1, stop))
        a, b = int(offsets[row]), int(offsets[stop])
        part = _UPPER[data[a:b]] if lower else data[a:b]
        if b - a <= PIECE:
            h, starts = hashes(part, offsets[row:stop] - a)
            yield row, stop - row, h, np.searchsorted(offsets[row : stop + 1] - a, starts, side="right") - 1
        else:
            found, at = [], 0
            while at < len(part):
                end = min(len(part), at + PIECE)
                while end < len(part) and not _SPACE[part[end]]:
                    end += 1
                found.append(hashes(part[at:end], np.zeros(1, np.int64))[0])
                at = end
            h = np.concatenate(found)
            yield row, 1, h, np.zeros(len(h), np.int64)
        row = stop

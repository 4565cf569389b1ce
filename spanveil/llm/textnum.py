"""Text columns as numpy arrays: bytes, code points, words and their hashes, without Python strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A chunk of documents ends beyond so many bytes; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    n, row = len(offsets) - 1, 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(n, max(to, row + 1))
        yield row, to
        row = to


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * CHUNK_BYTES), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def words(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that aren't space) and each document's first word index.

    space: a table of 256 booleans. A document's end ends a word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap = space[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets[:-1]] = True
    cut[-1] = True
    start = ~gap
    start[1:] &= gap[:-1] | cut[1:-1]
    end = ~gap
    end[:-1] &= gap[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 512


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z folded; equal words have equal hashes wherever they stand.

    Eight bytes are mixed at a time into what came before, so that no family of words collides by its form."""
    folded = np.concatenate([_FOLD[raw], np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(folded, (len(raw) + 1, 8), (1, 1), writeable=False)
    size = ends - starts
    h = mix64(size.astype(U64) + U64(0xD6E8FEB86659FD93))
    at, live = starts.copy(), np.flatnonzero(size <= LONG_WORD)
    while len(live):
        lane = np.ascontiguousarray(lanes[at[live]]).view("<u8").ravel() & _FIRST[np.minimum(ends[live] - at[live], 8)]
        h[live] = mix64(h[live] ^ (lane * U64(_BASE)))
        at[live] += 8
        live = live[at[live] < ends[live]]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(folded[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and each document's first code point index."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = raw[at].astype(np.uint32)
    points = b.copy()
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    wide = np.flatnonzero(b >= 0xC0)
    if len(wide):
        p, x = at[wide], b[wide]
        c1, c2, c3 = (padded[p + k].astype(np.uint32) & 0x3F for k in (1, 2, 3))
        two = ((x & 0x1F) << 6) | c1
        three = ((x & 0x0F) << 12) | (c1 << 6) | c2
        four = ((x & 0x07) << 18) | (c1 << 12) | (c2 << 6) | c3
        points[wide] = np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))
    return points, np.searchsorted(at, offsets)


_tables: dict[str, np.ndarray] = {}


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For the first 65,536 code points: whether a letter, and the lower-case code point."""
    if not _tables:
        alpha, lower = np.zeros(1 << 16, bool), np.arange(1 << 16, dtype=np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                alpha[i] = True
                if len(low := c.lower()) == 1:
                    lower[i] = ord(low)
        _tables.update(alpha=alpha, lower=lower)
    return _tables["alpha"], _tables["lower"]


def fold_letters(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with every non-letter as a space, and whether each is a letter."""
    alpha, lower = letter_tables()
    if len(points) and int(points.max()) >= 1 << 16:
        high = points >= 1 << 16
        small = np.where(high, 0, points)
        values, back = np.unique(points[high], return_inverse=True)
        letters = alpha[small]
        letters[high] = np.array([chr(v).isalpha() for v in values])[back]
        out = np.where(high, points, lower[small])
    else:
        letters, out = alpha[points], lower[points]
    return np.where(letters, out, 32), letters

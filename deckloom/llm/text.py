"""Vectorised words: spans and 64-bit hashes straight from Arrow buffers.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D, A-Z folded to
lower case.  Working on UTF-8 bytes is exact: no byte of a multi-byte
character lies in those ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random value per byte; upper-case ASCII shares that of lower case.
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_BYTE_VALUE[_IS_SPACE] = 0
_BASE = 0x9E3779B97F4A7C17  # odd, and 3 modulo 4: its powers stay far apart
_BASE_INV = pow(_BASE, -1, 2**64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX2
    return h ^ (h >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; nulls
    are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each text."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_IS_SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, np.flatnonzero(ends) + 1, counts


#: Bytes hashed at once; a longer text is still hashed whole.
BLOCK = 1 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows of Arrow batches in slices of about ``size`` bytes of text (one
    row at least), which bounds what array operations over them hold."""
    for batch in batches:
        _, offsets = column_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            upto = min(batch.num_rows, first + 4096, max(upto, first + 1))
            yield batch.slice(first, upto - first)
            first = upto


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column's texts, in order, and the number of
    words of each text."""
    raw, offsets = column_bytes(column)
    hashes, counts = [], []
    first, last = 0, len(offsets) - 1
    while first < last:
        upto = int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1
        upto = min(last, max(upto, first + 1))
        part, own = raw[offsets[first] : offsets[upto]], offsets[first : upto + 1] - offsets[first]
        starts, ends, n = spans(part, own)
        up, down = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * down[starts]))
        counts.append(n)
        first = upto
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct runs of ``width`` words, ascending
    within a text, and their number.  A text of fewer words has its whole
    sequence as one; a text without words has none."""
    first = np.concatenate([[0], np.cumsum(counts)])
    n_runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), n_runs)
    begin = np.concatenate([[0], np.cumsum(n_runs)])
    at = first[owner] + (np.arange(len(owner)) - begin[owner])
    length = np.minimum(counts, width)[owner]
    h = np.zeros(len(owner), np.uint64)
    for k in range(width):
        has = length > k
        word = np.zeros(len(owner), np.uint64)
        word[has] = words[at[has] + k]
        h = np.where(has, mix(h * _MIX2 + word + np.uint64(k + 1)), h)
    for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        h[x:y].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)

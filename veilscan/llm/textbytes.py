"""Words of Arrow text columns as numpy arrays: no Python object per word.

A text column is one byte buffer with offsets, so word bounds, word hashes and
shingle hashes of a few hundred documents are a handful of vector operations.
Rows are taken in slices of bounded bytes; a text longer than a slice is a
slice of its own, hashed in chunks, so memory follows the longest text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
CHUNK = 1 << 19

_rng = np.random.default_rng(20260101)
#: A random 64-bit value per byte, A-Z as a-z.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with a value of its own for every byte.
CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Multipliers of the words of a shingle by place.
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def byte_class(pattern) -> np.ndarray:
    """Which byte values ``pattern`` (a predicate) accepts."""
    return np.array([bool(pattern(b)) for b in range(256)])


#: Digits, letters and all of the multi-byte characters.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: All but the ASCII blanks.
NOT_BLANK = byte_class(lambda b: b != 32 and not 9 <= b <= 13)


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1, from 0) of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``rows`` rows and about ``limit`` text bytes, one row at least: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
            yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of accepted bytes; no run crosses an offset."""
    ok = accept[data]
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(ok)
    before[0], before[1:] = False, ok[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(ok))]
    before[inner] = False
    starts = np.flatnonzero(ok & ~before)
    after = np.empty_like(ok)
    after[-1], after[:-1] = False, ok[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(ok & ~after) + 1


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        tables = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p))
        _powers[:] = tables
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of each word's bytes, independent of the place; A-Z as a-z unless ``values`` is ``CASED``."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        power, inverse = _power_tables(b - a + 1)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[data[a:b]] * power[:b - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def sequence_hash(words: np.ndarray) -> int:
    """Hash of one short sequence of word hashes, length included."""
    return int(mix(np.array([(words * _PLACE[:len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))[0])


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document and their bounds (with repeats).

    ``bounds`` delimits each document's words. A document of 1 to k - 1 words
    has its whole sequence as its one shingle; without words it has none.
    """
    n_words = np.diff(bounds)
    n_sh = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(n_sh)))
    out = np.empty(out_bounds[-1], np.uint64)
    if len(words) >= k:
        rolled = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            rolled += words[j:len(words) - k + 1 + j] * _PLACE[j]
        rolled = mix(rolled)
        owner = np.repeat(np.arange(len(n_words)), n_words)
        same = owner[:len(rolled)] == owner[k - 1:]
        long_docs = n_words >= k
        place = np.repeat(long_docs, n_sh)
        out[place] = rolled[same]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        out[out_bounds[d]] = sequence_hash(words[bounds[d]:bounds[d + 1]])
    return out, out_bounds


def slice_words(data: np.ndarray, offsets: np.ndarray, accept: np.ndarray):
    """Word hashes of a slice and the bounds of each document's words."""
    starts, ends = word_bounds(data, offsets, accept)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)

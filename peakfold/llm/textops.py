"""Words and shingles of whole Arrow batches as numpy arrays, without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text handled at once; a longer document is handled alone, whole.
CHUNK = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(col: pa.Array, size: int = CHUNK):
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``size`` bytes."""
    data, offs = buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(low: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it.  ``apart`` says of
    each byte whether it is outside of words."""
    inside = ~apart[low]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(low))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, and each row's first word's number (n + 1 of them)."""
    low = _LOWER[data]
    starts, ends, at = word_spans(low, offs)
    return span_hashes(low, starts, ends), at


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes.

    The hash is a polynomial in the span's bytes, taken from one running sum over all bytes, as the
    base has an inverse modulo 2**64; it depends on the span's bytes alone.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(low))
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words: a polynomial in the words' hashes, again from one running sum."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[:n])


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words within a row, and the n + 1 offsets of the rows' runs.
    A row of fewer words has its whole sequence as its one run; a row without words has none."""
    count = np.diff(at)
    made = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(out_at[-1], np.uint64)
    long = np.flatnonzero(count >= k)
    if len(long):
        run = words[: len(words) - k + 1] * _STEPS[0]
        for j in range(1, k):
            run += mixed(words[j : len(words) - k + 1 + j]) * _STEPS[j] if j > 1 else words[j : len(words) - k + 1 + j] * _STEPS[j]
        row = np.repeat(np.arange(len(count)), count)
        whole = row[: len(words) - k + 1] == row[k - 1 :]
        out_row = np.repeat(np.arange(len(count)), made)
        out[count[out_row] >= k] = mixed(run[whole] + np.uint64(k))
    for r in np.flatnonzero((count > 0) & (count < k)):
        w = words[at[r] : at[r + 1]]
        out[out_at[r]] = mixed(np.array([int((w * _STEPS[: len(w)]).sum()) + len(w) & (1 << 64) - 1], np.uint64))[0]
    return out, out_at


def row_shingles(col: pa.Array, k: int, size: int = CHUNK):
    """(first row, end row, shingles, offsets) over a text column, run by run."""
    for i, j, data, offs in chunks(col, size):
        words, at = word_hashes(data, offs)
        yield (i, j, *shingles(words, at, k))

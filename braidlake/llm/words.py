"""Words, shingles and their hashes for whole batches of texts at once, on bytes in numpy.

Defined results: a null text is empty and has no words; texts of a batch never share a word or shingle; memory is that of
about eight numbers a byte of the batch, so callers cut batches by bytes, and a very long text is a batch of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words end at ASCII white space; of letters only A-Z change case.
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters and digits and of all bytes beyond ASCII, for text in lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            x = np.full(max(n, 1 << 18), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit values: every bit of the input moves all bits of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; nulls are empty."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def byte_chunks(batch: pa.RecordBatch, column: int, most: int = 1 << 18):
    """Slices of a batch of about `most` bytes of text, one row at least."""
    _, at = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def word_hashes(column: pa.Array, inside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in a row, A-Z in lower case, and where each text's words begin."""
    data, at = text_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    data = LOWER[data]
    word = inside[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    powers, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, at)


_ORDER = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _ORDER[j]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of a text, ascending; a text of fewer than k words is one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    if len(hashes) < k:
        return mix(np.array([np.sum(hashes * _ORDER[: len(hashes)], dtype=np.uint64) + np.uint64(len(hashes))], np.uint64))
    return np.unique(shingles(hashes, k))

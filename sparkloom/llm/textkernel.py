"""Vectorised byte kernels over Arrow string columns, shared by the text operators.

A text column of an Arrow batch is one buffer of UTF-8 bytes with offsets. Words ``[^\\x20\\x09-\\x0D]+`` are delimited by ASCII
bytes only, so they can be found, hashed and counted in that buffer with numpy, without a Python object for each word. Batches are cut
into chunks of whole documents of about ``CHUNK`` bytes, which bounds the temporary arrays; hashing is cut further at word borders,
so a single very long document needs no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: Random odd values of the 256 byte values and the two bases of the word hash.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, CHUNK // 2 + 2), base, np.uint64)
        steps[0] = 1
        made = np.cumprod(steps)
        if n > CHUNK // 2 + 2:
            return made[:n]
        _powers[key] = made
    return _powers[key][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pa.array([], pa.string()) if column is None else column
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about so many bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words of documents that lie side by side in data, and the number of words before each document.

    offsets are relative to data and cover it: offsets[0] is 0, offsets[-1] its length.
    """
    word = ~IS_SPACE[data]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before = np.zeros(len(word), bool)
    before[1:] = word[:-1]
    before[inner] = False
    after = np.zeros(len(word), bool)
    after[:-1] = word[1:]
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in rising order (of starts and of ends): a mixed random polynomial, alike for like bytes anywhere."""
    out = np.empty(len(starts), np.uint64)
    i, reach = 0, CHUNK // 2
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + reach, "right")))
        top = int(ends[i:j].max())
        values = BYTE_VALUE[data[base:top]] * _power(BASE, top - base)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * _power(INVERSE, top - base + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all windows of so many words that lie in one document, number of windows before each document)."""
    n = len(hashes) - size + 1
    counts = np.maximum(np.diff(first) - size + 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0 or not before[-1]:
        return np.zeros(0, np.uint64), before
    h = hashes[:n].copy()
    for k in range(1, size):
        h = h * _U(0xD6E8FEB86659FD93) + hashes[k : n + k]
    at = np.repeat(first[:-1] - before[:-1], counts) + np.arange(before[-1])
    return mix(h[at]), before

"""Arrow text columns as NumPy byte arrays, cut into words and hashed without a loop over words.

Tasks work on chunks of a batch, so that memory follows the chunk and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
WORD = LETTER.copy()
WORD[[*range(ord("0"), ord("9") + 1)]] = True


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of each batch that hold about ``size`` bytes of ``column``; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, low = np.cumsum(sizes), 0
        while low < batch.num_rows:
            base = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, base + size, "right")))
            yield batch.slice(low, high - low)
            low = high


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, one after another, and each row's offset (one more than rows); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        known = _powers[base] = np.cumprod(step, dtype=np.uint64)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span follows by a difference."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; equal bytes have equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD):
    """Start and end of each word (run of bytes of ``kind`` within a row), and each row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, 0 for a row without any."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))

"""Words of Arrow text columns as numpy arrays: byte spans and 64-bit hashes, without a Python object for each word.

All hashes are polynomials over bytes (or over word hashes) modulo 2**64 with odd bases, taken from prefix sums,
so a hash of any span costs one subtraction and one product; results are mixed before use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document is worked on alone.
SLICE_BYTES = 2 << 20
U = np.uint64

_rng = np.random.default_rng(20240101)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BASE_BYTES, BASE_WORDS, BASE_WORDS_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
WORD_BYTES = ~_SPACES
#: Letters, digits and everything beyond ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[65:91] = ALNUM_BYTES[97:123] = ALNUM_BYTES[128:] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i mod 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        out = np.full(size, U(base), np.uint64)
        out[0] = U(1)
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit (the one of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = U(0)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(inverse(base), len(sums))[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """Some texts of a batch: bytes `buf`, text k at bounds[k]:bounds[k+1]."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf, self.bounds = buf, bounds

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of the bytes marked in `inside` (a table of 256), within texts: starts, ends, first run of each text."""
        on = inside[self.buf]
        if not len(on):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.bounds), np.int64)
        before = np.empty_like(on)
        before[0], before[1:] = False, on[:-1]
        at = self.bounds[:-1]
        before[at[at < len(on)]] = False
        starts = np.flatnonzero(on & ~before)
        after = np.empty_like(on)
        after[-1], after[:-1] = False, on[1:]
        last = self.bounds[1:] - 1
        after[last[last >= 0]] = False
        ends = np.flatnonzero(on & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(WORD_BYTES)

    def sums(self, lower: bool = False) -> np.ndarray:
        return prefix_sums(BYTE_VALUES[LOWER_BYTES[self.buf] if lower else self.buf], BASE_BYTES)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        return span_hashes(self.sums(lower), BASE_BYTES, starts, ends)


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each run, from the first run of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, base: int = BASE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows of `size` runs within texts."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(n) + size <= end)
    return starts, span_hashes(prefix_sums(hashes, base), base, starts, starts + size)


def texts_of(column: pa.Array) -> Texts:
    """Null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(buf, at - at[0])


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of a batch with about `limit` bytes of text each."""
    if not batch.num_rows:
        return
    bounds = texts_of(batch.column(text)).bounds
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        part = batch.slice(at, stop - at)
        yield part, texts_of(part.column(text))
        at = stop


def longs(column: pa.Array) -> np.ndarray:
    """Integers of a column without nulls."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary array of data[bounds[k]:bounds[k+1]] (bounds in items)."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

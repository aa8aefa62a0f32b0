"""Whole-batch tokenising and hashing with numpy, shared by several operators.

A ``Buffer`` lays the texts of a slice of rows end to end as UTF-8 and finds
all words at once, so no Python code runs per word.  Words are maximal runs of
bytes that are not in a separator class; texts are kept apart by a line feed,
which every separator class contains.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; bounds the numpy temporaries of a worker.
SLICE_BYTES = 1 << 20

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_MIX = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U64(2) + _U64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = hex(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[_U64(1)], np.full(size - 1, base, _U64)]), dtype=_U64)
        # a text far beyond the slice size must not keep its table alive
        _powers[key] = have if size <= 4 * SLICE_BYTES else have[: 4 * SLICE_BYTES].copy()
    return have[:n]


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs ``data[start:end]``, the same for equal runs anywhere."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, _U64)
        total[0] = 0
        np.cumsum(_BYTE_CODE[data] * _power(_BASE, n), dtype=_U64, out=total[1:])
        value = (total[end] - total[start]) * _power(_INVERSE, n + 1)[start]
        return mix(value + (end - start).astype(_U64) * _MIX[0])


class Buffer:
    """Words of several texts.

    ``first[i]:first[i+1]`` are the indexes of text ``i``'s words in ``start``
    and ``end`` (byte offsets into ``raw``).
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b"\n".join(texts)
        data = np.frombuffer(raw, np.uint8)
        if lower:
            data = LOWER[data]
            raw = data.tobytes()
        self.raw, self.data = raw, data
        inside = np.empty(len(data) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(SPACES[data], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same for equal words anywhere."""
        if not len(self.start):
            return np.zeros(0, _U64)
        return run_hashes(self.data, self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.raw[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes (runs over text ends too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U64)
    with np.errstate(over="ignore"):
        if k <= 16:
            out = np.zeros(n, _U64)
            for j in range(k):
                out += h[j : j + n] * _MIX[1 + j]
        else:
            size = len(h)
            total = np.concatenate([[_U64(0)], np.cumsum(h * _power(_BASE, size), dtype=_U64)])
            out = (total[k:] - total[:-k]) * _power(_INVERSE, size)[:n]
        return mix(out)


def slices(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``SLICE_BYTES``; a null counts as empty.  Yields (index of the first, texts)."""
    at, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > SLICE_BYTES:
            yield at, held
            at, size, held = i, 0, []
        held.append(t)
        size += len(t) + 1
    if held:
        yield at, held


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``most`` bytes of ``column`` at most (one row at least)."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = _lengths(batch.column(batch.schema.get_field_index(column)))
            group = np.cumsum(size) // most
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield batch.slice(a, b - a)
    finally:
        release()


def release() -> None:
    """Give memory that this worker no longer uses back to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

"""Vectorised tokenising and hashing of Arrow string columns.

Every function works on the bytes of a *piece* - some consecutive rows of an
Arrow batch whose texts together hold about ``PIECE_BYTES`` (one longer text
makes a piece of its own) - so a Python worker's memory stays bounded by the
longest text.  A word's 64-bit hash is a polynomial of its bytes read from
prefix sums; a k-gram's hash is a polynomial of its word hashes; both are mixed
with a finaliser.  Hash equality is followed by an exact check, or by a second
independent hash, wherever a result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93      # odd, so invertible modulo 2^64

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For lexicons: everything in ASCII that is not a letter or digit separates.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NEWLINES = np.zeros(256, bool)
NEWLINES[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64 (kept between calls)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        a = np.full(size, base, U)
        a[0] = 1
        have = _powers[base] = np.multiply.accumulate(a)
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + U((seed * 0xBF58476D1CE4E5B9 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of consecutive texts: ``ptr[d]:ptr[d+1]`` are those of text ``d``;
    ``start``/``end`` are byte offsets in ``buf``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        n = len(buf)
        self.buf, self.offsets = buf, offsets
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[buf]
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True                      # a text begins
        begins = inside[1:-1] & (~inside[:-2] | first[:-1])
        first[n] = True
        ends = inside[1:-1] & (~inside[2:] | first[1:])
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.ptr = np.searchsorted(self.start, offsets)
        self._sums = None

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def hashes(self, end: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of its bytes up to ``end``."""
        if self._sums is None:
            s = np.zeros(len(self.buf) + 1, U)
            np.cumsum((self.buf.astype(U) + U(1)) * powers(_P, len(self.buf)), out=s[1:])
            self._sums = s
        end = self.end if end is None else end
        back = powers(_inverse(_P), len(self.buf) + 1)[self.start]
        return mix((self._sums[end] - self._sums[self.start]) * back + (end - self.start).astype(U))

    def doc_of(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())

    def text(self, d: int) -> bytes:
        return self.buf[self.offsets[d]:self.offsets[d + 1]].tobytes()


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k units beginning at each unit (``len(h)-k+1`` values); those
    that cross from one text into the next are for the caller to mask."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    s = np.zeros(n + 1, U)
    np.cumsum(mix(h, seed) * powers(_Q, n), out=s[1:])
    return mix((s[k:] - s[:n - k + 1]) * powers(_inverse(_Q), n)[:n - k + 1], seed)


def whole(ptr: np.ndarray, k: int) -> np.ndarray:
    """For the first ``ptr[-1]-k+1`` units: does the k-gram end in its own text?"""
    n = int(ptr[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for back in range(1, k):                            # the last k-1 units of each text
        at = ptr[1:-1] - back
        at = at[(at >= ptr[:-2]) & (at < n)]
        ok[at] = False
    return ok


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of each ``w`` consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = x.copy(), np.arange(len(x)), 1
    while span < w:                                     # doubling; the last step may overlap
        step = min(span, w - span)
        m = len(best) - step
        right = best[step:] < best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        span += step
    return at


def pieces(batch: pa.RecordBatch, col: str, limit: int = PIECE_BYTES
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch by the bytes of a string column: (first row, past the last
    row, bytes, byte offset of each text and the end)."""
    arr = batch.column(batch.schema.get_field_index(col))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    wide = pa.types.is_large_string(arr.type)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def as_list(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column: row ``d`` holds ``values[ptr[d]:ptr[d+1]]``."""
    if values.dtype == U:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.asarray(ptr, np.int32)), pa.array(values, kind))


def list_values(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, row pointers) of an Arrow list column without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    ptr = np.asarray(arr.offsets, dtype=np.int64)
    return np.asarray(arr.values)[ptr[0]:ptr[-1]], ptr - ptr[0]

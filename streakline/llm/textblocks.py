"""Vectorised text helpers for Arrow batches: words, windows and hashes without a per-word loop.

A batch's texts are taken as one byte buffer with row offsets and cut into
blocks of whole rows of about ``BLOCK_BYTES``, so the numpy temporaries of a
task stay a few dozen times that size however large the Arrow batch is (a
single text longer than that is a block of its own).

All hashes are 64-bit: bytes go through a fixed random table into a polynomial
prefix sum modulo 2**64, and a finaliser spreads the result. Equal strings have
equal hashes on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective), on a copy."""
    x = x.copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BASE = 0x5851F42D4C957F2D
_TABLES = {0: _table(0x243F6A8885A308D3), 1: _table(0x13198A2E03707344)}
_POW = np.ones(1, U)
_INV = np.ones(1, U)
# odd multipliers for sequences of words (position j of a window)
_SEQ = mix(np.arange(1, 65, dtype=U) * U(0xD1342543DE82EF95)) | U(1)

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
LOWER = _low


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 0..n-1 (kept per worker)."""
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << max(20, (n - 1).bit_length())
        a, b = np.full(m, _BASE, U), np.full(m, pow(_BASE, -1, 1 << 64), U)
        a[0] = b[0] = 1
        _POW, _INV = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _POW[:n], _INV[:n]


def separators(kind: str) -> np.ndarray:
    """Byte table of what is not part of a word.

    ``space``: words are ``[^\\x20\\x09-\\x0D]+``; ``alnum``: words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (of lower-cased text).
    """
    t = np.zeros(256, bool)
    if kind == "space":
        t[[0x20, *range(0x09, 0x0E)]] = True
    else:
        t[0x00:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = True
    return t


class Block:
    """Consecutive rows of a text column: bytes, row offsets, row range of the batch."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int):
        self.data, self.offs, self.lo, self.rows = data, offs, lo, len(offs) - 1

    def lowered(self) -> Block:
        return Block(LOWER[self.data], self.offs, self.lo)

    def prefix(self, seed: int = 0) -> np.ndarray:
        n = len(self.data)
        out = np.zeros(n + 1, U)
        np.cumsum(_TABLES[seed][self.data] * powers(n + 1)[0][:n], out=out[1:])
        return out

    def span_hash(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[starts:ends], elementwise."""
        inv = powers(len(self.data) + 1)[1]
        return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))

    def words(self, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the word offsets of the rows (rows + 1)."""
        n = len(self.data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.rows + 1, np.int64)
        inside = ~sep[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        open_, close = inside.copy(), inside
        open_[1:] &= ~inside[:-1] | cut[1:n]
        close = inside.copy()
        close[:-1] &= ~inside[1:] | cut[1:n]
        starts, ends = np.flatnonzero(open_), np.flatnonzero(close) + 1
        return starts, ends, np.searchsorted(starts, self.offs)


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of whole rows; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, count=n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n)
        yield Block(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], lo)
        lo = hi


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries of ``h`` (len(h) - k + 1 of them, none if shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n] * _SEQ[0]
    for j in range(1, k):
        out += h[j:j + n] * _SEQ[j]
    return mix(out + U(k))


def row_windows(offs: np.ndarray, k: int) -> np.ndarray:
    """Which window starts (of ``k`` entries) lie within one row; ``offs``: entry offsets of the rows."""
    total = int(offs[-1])
    if total < k:
        return np.zeros(0, bool)
    ok = np.ones(total, bool)
    last = offs[1:]
    for j in range(1, k):  # the last k-1 entries of a row start no window
        p = last - j
        ok[p[(p >= offs[:-1]) & (p >= 0)]] = False
    return ok[:total - k + 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive entries, by doubling."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[:len(x) - (w - span)], x[w - span:])
    return x


def lists(flat: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(offs, np.int32)), pa.array(flat, kind))

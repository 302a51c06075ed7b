"""Vectorised fingerprints of byte ranges: one pass of prefix sums, then any range in constant time."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 5  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


mixed = _mixed
#: A random 64-bit value for each byte, from a rule.
VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("p", BASE), ("i", _INVERSE)):
            _POWERS[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return _POWERS["p"], _POWERS["i"]


class Prefixes:
    """Fingerprints of ranges of ``data`` (bytes as uint8)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[data] * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def windows(self, width: int) -> np.ndarray:
        """Fingerprint of every range of ``width`` bytes."""
        d = self.sums[width:] - self.sums[:-width]
        return d * self.inverse[:len(d)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, done = x, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def byte_chunks(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``most`` bytes, one row at least."""
    column = column.cast(pa.large_binary()) if pa.types.is_large_binary(column.type) or pa.types.is_binary(
        column.type) else column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield begin, end, every[at[begin]:at[end]], at[begin:end + 1] - at[begin]
        begin = end

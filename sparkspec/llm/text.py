"""Vectorised work on the bytes of Arrow string columns.

White space is ``[\\x20\\x09-\\x0D]`` and letter case means A-Z only, so all
rules here hold on UTF-8 bytes: none of them can match inside a longer
character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: odd multiplier of the polynomial hash and its inverse modulo 2**64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {}


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system: workers wait for later tasks while the executor's JVM needs room."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; null reads as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, at


def pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, last row + 1, bytes, offsets from 0."""
    flat, at = string_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, rows)
        yield row, end, flat[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, grown by doubling and kept."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 20)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(mark: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true bytes; runs end at row ends."""
    n = len(mark)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mark.copy()
    first[1:] &= ~mark[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = mark[edge]
    starts = np.flatnonzero(first)
    last = mark.copy()
    last[:-1] &= ~mark[1:]
    last[edge - 1] = mark[edge - 1]
    return starts, np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by differences of one prefix sum."""
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)[:n], out=prefix[1:])
    back = powers(pow(_BASE, -1, 1 << 64), n)
    raw = (prefix[ends] - prefix[starts]) * back[starts]
    return mix(raw ^ (mix((ends - starts).astype(np.uint64))))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all white-space separated words, A-Z lower-cased, their starts, and per row the index of its first word (one more than rows)."""
    low = LOWER[data]
    starts, ends = spans(~SPACE[low], offsets)
    return span_hashes(low, starts, ends), starts, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes."""
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[i : i + n])
    return out

"""Vectorised word hashes over Arrow string buffers (numpy; no Python object per word)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 (64 bits)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(1 << int(n - 1).bit_length(), _ODD, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. The bytes are copied only if a null has some."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if column.null_count and np.diff(off)[column.is_null().to_numpy(zero_copy_only=False)].any():
        return buffers(column.fill_null(""))
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def slices(off: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer text stands alone, whole."""
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, to
        at = to


def word_hashes(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each row) for rows ``off`` of ``data``: A-Z lower-cased, cut at ``space``."""
    lo, hi = int(off[0]), int(off[-1])
    n = np.zeros(len(off) - 1, np.int64)
    if hi == lo:
        return np.zeros(0, np.uint64), n
    d = LOWER[data[lo:hi]]
    word = ~space[d]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = off[:-1][off[:-1] < off[1:]] - lo
    starts[first] = word[first]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), n
    lead = at[0]
    length = np.diff(at, append=hi - lo)
    pos = np.arange(lead, hi - lo, dtype=np.int64) - np.repeat(at, length)
    value = (d[lead:].astype(np.uint64) + np.uint64(1)) * word[lead:]
    value *= _power(int(length.max()))[pos]
    h = mix(np.add.reduceat(value, at - lead))
    bounds = np.searchsorted(at, off - lo)
    return h, np.diff(bounds)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``words``-word shingles (fewer words: all of them as one)."""
    h, n = word_hashes(data, off)
    signed = np.int64
    out: list[np.ndarray] = []
    if len(h) >= words:
        s = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            s = mix(s * np.uint64(31) + h[k : len(h) - words + 1 + k] + np.uint64(k + 1))
    else:
        s = np.zeros(0, np.uint64)
    at = 0
    for c in n.tolist():
        if c >= words:
            out.append(np.unique(s[at : at + c - words + 1].view(signed)))
        elif c:
            short = np.full(1, c, np.uint64)
            for k in range(c):
                short = mix(short * np.uint64(37) + h[at + k : at + k + 1])
            out.append(short.view(signed))
        else:
            out.append(np.zeros(0, signed))
        at += c
    return out


def lists(values: list[np.ndarray]) -> pa.ListArray:
    off = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=off[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))

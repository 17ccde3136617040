"""Vectorised work on the UTF-8 bytes of an Arrow text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x = x * _M2
    x ^= x >> np.uint64(33)
    return x


_KEPT: dict[int, np.ndarray] = {}
#: Powers of a base are kept up to so many.
_KEEP = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; not to be written to."""
    kept = _KEPT.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.full(max(n, min(2 * n, _KEEP)), base, dtype=np.uint64)
    out[:1] = 1
    out = np.multiply.accumulate(out)
    if len(out) <= _KEEP:
        out.flags.writeable = False
        _KEPT[base] = out
    return out[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every text, and the text each belongs to.

    A word is a maximal run of bytes that ``is_word`` (a table of 256 booleans)
    accepts, cut at text ends. Hashes are polynomial sums over prefix sums, so
    the whole batch takes a few passes over its bytes.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    w = is_word[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate(([False], w[:-1]))
    starts = np.flatnonzero(w & (~before | cut[:-1]))
    after = np.concatenate((w[1:], [False]))
    ends = np.flatnonzero(w & (~after | cut[1:])) + 1
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE_VALUES[data] * _powers(_P, n), dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * _powers(_P_INV, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts, side="right") - 1


#: ASCII letters and digits, and every byte of a character outside ASCII.
LETTERS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])

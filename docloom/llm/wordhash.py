"""Vectorised word and k-gram hashing over Arrow string columns.

Words are runs of ``[0-9a-z]`` and non-ASCII code points after lower-casing A-Z. In UTF-8 that is a class of bytes, so
whole Arrow buffers are split and hashed with NumPy and no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: bytes.translate table: word bytes lower-cased, anything else a space
SPLIT_TABLE = bytes(int(LOWER[b]) if IS_WORD[LOWER[b]] else 32 for b in range(256))
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int = 1) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def segment_hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte range, read eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix((size.astype(np.uint64) + np.uint64(1 + seed)) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[start] & _MASK[np.minimum(size, 8)]))
        on, at = np.flatnonzero(size > 8), 8
        while len(on):
            rest = size[on] - at
            h[on] = mix((h[on] + np.uint64(at)) * np.uint64(0xD6E8FEB86659FD93) ^ (eight[start[on] + at] & _MASK[np.minimum(rest, 8)]))
            on, at = on[rest > 8], at + 8
    return h


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(SPLIT_TABLE).split() if text else []


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets into them; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and per text the index of its first word (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    low = LOWER[raw]
    isw = IS_WORD[low]
    begin = isw.copy()
    begin[1:] &= ~isw[:-1]
    edges = off[:-1][off[:-1] < len(raw)]
    begin[edges] |= isw[edges]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    stop = isw.copy()
    stop[:-1] &= ~isw[1:]
    stop[edges[edges > 0] - 1] |= isw[edges[edges > 0] - 1]
    return segment_hashes(low, starts, np.flatnonzero(stop) + 1 - starts), np.searchsorted(starts, off)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len(h) - k + 1 values); runs over text edges are to be masked."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = constants(k, seed=7)
    out = h[:n] * c[0]
    for j in range(1, k):
        out += h[j : j + n] * c[j]
    return mix(out)

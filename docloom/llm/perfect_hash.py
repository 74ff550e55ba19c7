"""Minimal perfect hash over 64-bit keys: levels of bit arrays, a key sits where it met no other key of its level."""

from __future__ import annotations

import io

import numpy as np

from docloom.llm.wordhash import mix

GAMMA, LEVELS = 2.0, 32
_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``slots(keys)`` gives each of n distinct keys its own number below n; other keys get any number or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        packed = [(int(s) + 7) // 8 for s in sizes]
        self.begin = np.cumsum([0, *packed])
        self.before = np.append(0, np.cumsum(_BITS[bits]))  # set bits before each byte
        self.n = int(self.before[-1]) + len(rest)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, parts = np.unique(keys.astype(np.uint64)), [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = max(64, int(GAMMA * len(keys)))
            at = _place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.uint8), keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, on = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(on):
                break
            at = _place(keys[on], level, size)
            byte, bit = self.begin[level] + (at >> 3), at & 7
            hit = (self.bits[byte] >> bit.astype(np.uint8)) & 1 == 1
            low = self.bits[byte[hit]] & ((1 << bit[hit]) - 1).astype(np.uint8)
            out[on[hit]] = self.before[byte[hit]] + _BITS[low]
            on = on[~hit]
        if len(on) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[on]), len(self.rest) - 1)
            hit = self.rest[i] == keys[on]
            out[on[hit]] = int(self.before[-1]) + i[hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"mph_sizes": self.sizes, "mph_bits": self.bits, "mph_rest": self.rest}

    @classmethod
    def load(cls, a) -> PerfectHash:
        return cls(a["mph_sizes"], a["mph_bits"], a["mph_rest"])


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}

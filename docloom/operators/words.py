"""Tokens of many texts at once, in arrays: where they stand, and which of them are among given terms.

The same tokens as ``functions.text`` has, for texts in lower case. A token of up to 16 bytes is held as its first and last
eight bytes, which with its size tell it apart; longer ones are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WORD, JOIN, PERCENT = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = WORD
_KIND[[*b"._/-"]] = JOIN
_KIND[ord("%")] = PERCENT
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)
LONG = 16
_ODD = 0x9E3779B97F4A7C15


class Words:
    """Tokens of ``texts`` in order: the text's number, and first and last eight bytes, size and hash. ``technical``: tokens
    of BM25, else words of two or more characters. ``cjk``: numbers of the texts that may have CJK characters."""

    def __init__(self, texts: list[str | None], technical: bool):
        low = "\0".join([s or "" for s in texts]).lower()
        if low.count("\0") >= max(len(texts), 1):  # in a text it parts words, as a space does
            low = "\0".join([(s or "").replace("\0", " ") for s in texts]).lower()
        low = low.replace("ß", "ss") if technical else low
        self.raw = b"\0" + low.encode() + bytes(17)
        data = np.frombuffer(self.raw, np.uint8)
        ends = np.flatnonzero(data[1:-16] == 0) + 1
        kind = _KIND[data]
        inside = kind == WORD
        if technical:
            word = inside.copy()
            middle = kind[1:-1]
            inside[1:-1] |= word[:-2] & ((middle == PERCENT) | (middle == JOIN) & word[2:])
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, stop = edge[::2], edge[1::2]
        if not technical:
            start, stop = start[stop - start > 1], stop[stop - start > 1]
        self.start, self.stop, self.size = start, stop, stop - start
        self.row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(start, ends), prepend=0))
        eight = np.ndarray((len(data) - 7,), "<u8", self.raw, strides=(1,))
        self.first = eight[start] & _MASK[np.minimum(self.size, 8)]
        self.last = np.where(self.size > 8, eight[np.maximum(stop - 8, 0)], 0)
        wide = (data >= 0xE4) & (data <= 0xE9)
        self.cjk = np.unique(np.searchsorted(ends, np.flatnonzero(wide))).tolist() if wide.any() else []

    def hashes(self, seed: int) -> np.ndarray:
        return self.first * np.uint64(seed) + self.last * np.uint64((seed * _ODD | 1) % (1 << 64)) + self.size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)

    def token(self, i: int) -> str:
        return self.raw[self.start[i] : self.stop[i]].decode()

    def distinct(self) -> np.ndarray | None:
        """One place for each different token of a text; None if hashes don't tell tokens apart (then nothing is known)."""
        short = np.flatnonzero(self.size <= LONG)
        h = self.hashes(_ODD)[short] + self.row[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(h)
        h, at = h[order], short[order]
        same = h[1:] == h[:-1]
        for x in (self.row, self.size, self.first, self.last):
            if (x[at[1:]] != x[at[:-1]])[same].any():
                return None
        long = {(self.row[i], self.token(i)): i for i in np.flatnonzero(self.size > LONG).tolist()}
        return np.concatenate([at[:1], at[1:][~same], np.array([*long.values()], np.int64)])


class Terms:
    """Finds those tokens that are among ``number``, numbered terms."""

    def __init__(self, number: dict[str, int]):
        self.number = number
        terms = [t for t in number if t.isascii() and "\0" not in t]
        # each term as a text of its own; one that is not a single token is never found, nor does it have to be
        w = Words(terms, True)
        whole = np.flatnonzero(w.size == np.array([len(t) for t in terms], np.int64)[w.row]) if terms else np.empty(0, np.int64)
        self.seed = _ODD
        while True:
            h = w.hashes(self.seed)[whole]
            short = h[w.size[whole] <= LONG]
            if len(np.unique(short)) == len(short) and not np.isin(h[w.size[whole] > LONG], short).any():
                break
            self.seed = (self.seed * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
        self.hash, at = np.unique(h, return_index=True)
        at = whole[at]
        self.first, self.last, self.size = w.first[at], w.last[at], w.size[at]
        self.of = np.array([number[terms[i]] for i in w.row[at].tolist()], np.int64)
        self.filled = np.zeros(1 << 16, bool)
        self.filled[self.hash >> np.uint64(48)] = True

    def find(self, w: Words, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Texts and terms of the tokens (of those at ``places``) that are terms."""
        if not len(self.hash):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = w.hashes(self.seed)
        places = np.flatnonzero(self.filled[h >> np.uint64(48)]) if places is None else places[self.filled[h[places] >> np.uint64(48)]]
        h = h[places]
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = self.hash[at] == h
        places, at = places[hit], at[hit]
        term = self.of[at]
        good = (self.first[at] == w.first[places]) & (self.last[at] == w.last[places]) & (self.size[at] == w.size[places])
        for i in np.flatnonzero(w.size[places] > LONG).tolist():
            term[i] = self.number.get(w.token(places[i]), -1)
            good[i] = term[i] >= 0
        return w.row[places[good]], term[good]


def joined(parts: Iterable[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, terms) by text as two arrays."""
    rows: list[int] = []
    terms: list[int] = []
    for row, own in parts:
        rows += [row] * len(own)
        terms += own
    return np.array(rows, np.int64), np.array(terms, np.int64)

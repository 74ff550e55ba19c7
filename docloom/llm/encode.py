"""Tokenizer access with a word cache: ids are those of the tokenizers library for the whole text.

Byte-level BPE cuts a text before every single space or newline that stands between non-space characters, and never
merges over such a cut. So pieces between cuts are deduplicated in Arrow, encoded once by the library and kept in a
cache of bounded size; texts with any other white space or with a special token go to the library, long ones in parts that
end at such cuts. Texts are worked on about a megabyte at a time, and ``task_encoder`` gives all memory back with the task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from docloom.llm.wordhash import chunks, segment_hashes, string_buffers
from docloom.llm.worker import release

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
#: pieces that the library encodes in one call
MISSING = 1 << 15
#: words in a generation of the cache
CACHE_WORDS = 1_000_000
CHUNK_BYTES = 1 << 20
#: longer texts go to the library in parts, cut at single spaces between letters
PART_CHARS = 1 << 16
SAFE_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def odd_spacing(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text: is there white space other than single spaces and newlines between other characters?"""
    n = len(off) - 1
    if not len(raw):
        return np.zeros(n, bool)
    cut = (raw == 32) | (raw == 10)
    odd = ((raw >= 9) & (raw <= 13) | (raw >= 28) & (raw <= 31)) & ~cut
    odd[1:] |= cut[1:] & cut[:-1]
    first, last = off[:-1][off[1:] > off[:-1]], off[1:][off[1:] > off[:-1]] - 1
    odd[first] |= cut[first]
    odd[last] |= cut[last]
    lead = np.flatnonzero((raw == 0xC2) | (raw >= 0xE1) & (raw <= 0xE3))
    if len(lead):
        a, b, c = raw[lead], raw[np.minimum(lead + 1, len(raw) - 1)], raw[np.minimum(lead + 2, len(raw) - 1)]
        wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & ((b == 0x9A) | (b == 0xA0)) | (a == 0xE3) & (b == 0x80)
        wide |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8)) | (b == 0x81))
        odd[lead] |= wide
    out = np.zeros(n, bool)
    out[np.searchsorted(off, np.flatnonzero(odd), side="right") - 1] = True
    return out


class WordIds:
    """Ids of words that are known by 96 bits of hash, in arrays sorted by hash: some 30 bytes a word."""

    def __init__(self, dtype: str):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, dtype)

    def __len__(self) -> int:
        return len(self.key)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for others."""
        if not len(self):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), at, -1)

    def take(self, at: np.ndarray) -> np.ndarray:
        """Flat ids of the words at these places."""
        return self.flat[_ranges(self.start[at], self.size[at])]

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        start = len(self.flat) + np.cumsum(size) - size
        if len(self):
            key, check, start, size = (np.concatenate(x) for x in ((self.key, key[order]), (self.check, check[order]), (self.start, start[order]), (self.size, size[order])))
            order = np.argsort(key, kind="stable")  # two sorted runs
        self.key, self.check, self.start, self.size = key[order], check[order], start[order], size[order].astype(np.int32)
        self.flat = np.concatenate([self.flat, flat])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, and so on."""
    end = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


class CachedEncoder:
    """``encode(column)`` gives one id array per text, equal to the library's own result.

    The cache has two generations: when the younger is full, the older goes; words in use move to the younger. New words
    are gathered in ``fresh`` before they are sorted into it.
    """

    def __init__(self, path: str = DEFAULT, specials_as_text: bool = False, dtype: str = "<u2", words: int = CACHE_WORDS):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = specials_as_text
        self.specials = [] if specials_as_text else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.dtype, self.words = dtype, words
        (self.newline,) = self.whole.encode("\n", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.fresh, self.young, self.old = WordIds(self.dtype), WordIds(self.dtype), WordIds(self.dtype)

    def _remember(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.fresh.add(key, check, size, flat)
        if len(self.fresh) > self.words // 8:
            if len(self.young) + len(self.fresh) > self.words:
                self.old, self.young = self.young, WordIds(self.dtype)
            f = self.fresh
            self.young.add(f.key, f.check, f.size, f.take(np.arange(len(f))))
            self.fresh = WordIds(self.dtype)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and flat ids of pieces that have white space at most as their first byte. One call for all, as lines of one
        text: a newline is a token of its own there, and nothing else has its id."""
        line = np.array([p[:1] == b"\n" for p in pieces], bool)
        text = b"".join([p if on else b"\n" + p for p, on in zip(pieces, line.tolist(), strict=True)])
        ids = np.array(self.whole.encode_batch_fast([text.decode("utf-8", "surrogatepass")], add_special_tokens=False)[0].ids, dtype=self.dtype)
        begin = np.flatnonzero(ids == self.newline)
        if len(begin) != len(pieces):
            raise ValueError("the tokenizer does not keep newlines apart")
        size = np.diff(np.append(begin, len(ids))) - ~line
        keep = np.ones(len(ids), bool)
        keep[begin[~line]] = False
        return size, ids[keep]

    def _words(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and flat ids of distinct pieces of ``raw``, from the cache or the library."""
        check = segment_hashes(raw, start, end - start, seed=1).astype(np.uint32)
        size = np.full(len(start), -1, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # pieces, their flat ids
        left = np.arange(len(start))
        for known in (self.young, self.fresh, self.old):
            at = known.find(key[left], check[left])
            hit = at >= 0
            size[left[hit]] = known.size[at[hit]]
            parts.append((left[hit], known.take(at[hit])))
            left = left[~hit]
        again = parts[-1]
        data = raw.tobytes()
        for i in range(0, len(left), MISSING):
            own = left[i : i + MISSING]
            size[own], flat = self._pieces([data[a:b] for a, b in zip(start[own].tolist(), end[own].tolist(), strict=True)])
            parts.append((own, flat))
        for own, flat in [again, *parts[3:]]:
            if len(own):
                self._remember(key[own], check[own], size[own], flat)
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), self.dtype)
        for own, flat in parts:
            out[_ranges(first[own], size[own])] = flat
        return size, out

    def _by_library(self, text: str) -> np.ndarray:
        cuts, at = [0], 0
        while len(text) - at > PART_CHARS and (m := SAFE_CUT.search(text, at + PART_CHARS)):
            at = m.start()
            cuts.append(at)
        cuts.append(len(text))
        ids = [np.array(self.whole.encode_batch_fast([text[a:b]], add_special_tokens=False)[0].ids, dtype=self.dtype) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate(ids)

    def _plain(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Texts without odd spacing."""
        cut = (raw == 32) | (raw == 10)
        cut[off[:-1][off[:-1] < len(raw)]] = True
        at = np.append(np.flatnonzero(cut), len(raw))
        start = at[:-1]
        hashes = segment_hashes(raw, start, np.diff(at))
        idx = pa.array(hashes).dictionary_encode().indices.to_numpy()
        # codes are given in the order in which pieces come first
        seen = np.flatnonzero(np.append(True, idx[1:] > np.maximum.accumulate(idx)[:-1])) if len(idx) else idx
        size, flat = self._words(raw, start[seen], at[seen + 1], hashes[seen])
        first, n = np.cumsum(size) - size, size[idx]
        ids = flat[_ranges(first[idx], n)]
        bounds = np.append(0, np.cumsum(n))[np.searchsorted(at, off)]
        return [ids[bounds[i] : bounds[i + 1]] for i in range(len(off) - 1)]

    def parts(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """Id arrays of about CHUNK_BYTES of texts at a time."""
        raw, off = string_buffers(texts)
        for i, j in chunks(off, CHUNK_BYTES):
            part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            odd = odd_spacing(part, at)
            for s in self.specials:
                b = s.encode()
                if (whole := part.tobytes()).find(b) >= 0:
                    hits = [m.start() for m in re.finditer(re.escape(b), whole)]
                    odd[np.searchsorted(at, np.array(hits), side="right") - 1] = True
            if not odd.any():
                yield self._plain(part, at)
                continue
            size = np.diff(at)
            keep = np.flatnonzero(~odd)
            mine: list = [None] * (j - i)
            for k in np.flatnonzero(odd).tolist():
                mine[k] = self._by_library(texts[i + k].as_py())
            body = part[np.repeat(~odd, size)]
            for k, ids in zip(keep, self._plain(body, np.append(0, np.cumsum(size[keep]))), strict=True):
                mine[k] = ids
            yield mine

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return [ids for part in self.parts(texts) for ids in part]


_MADE: dict[tuple, CachedEncoder] = {}


def encoder(path: str = DEFAULT, specials_as_text: bool = False, dtype: str = "<u2") -> CachedEncoder:
    """One encoder a worker process."""
    key = (path, specials_as_text, dtype)
    if key not in _MADE:
        _MADE[key] = CachedEncoder(*key)
    return _MADE[key]


@contextmanager
def task_encoder(path: str = DEFAULT, specials_as_text: bool = False, dtype: str = "<u2") -> Iterator[CachedEncoder]:
    """The worker's encoder for one task; what it has cached goes when the task ends, the tokenizer stays."""
    enc = encoder(path, specials_as_text, dtype)
    try:
        yield enc
    finally:
        enc.clear()
        release()


def id_dtype(path: str = DEFAULT) -> str:
    """Narrowest unsigned type that holds every id of the vocabulary."""
    return "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

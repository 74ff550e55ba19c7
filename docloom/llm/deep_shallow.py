"""Deep-shallow sorting of byte strings: multikey quicksort down to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Distinct strings by the places where they branch. A walk looks only at those places; one full comparison with the
    leaf it ends in tells where a new string leaves the trie."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None  # an inner node is [depth, {byte: child}], a leaf an index

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = i
            return
        s, node = self.strings[i], self.root
        while isinstance(node, list):
            node = node[1].get(self._at(s, node[0])) if self._at(s, node[0]) in node[1] else next(iter(node[1].values()))
        depth = lcp(s, self.strings[node])
        parent, edge, node = None, 0, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, edge = node, self._at(s, node[0])
            node = node[1][edge]
        if isinstance(node, list) and node[0] == depth:
            node[1][self._at(s, depth)] = i
            return
        other = node
        while isinstance(other, list):
            other = next(iter(other[1].values()))
        split = [depth, {self._at(self.strings[other], depth): node, self._at(s, depth): i}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def ordered(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node is not None:
                out.append(node)
        return out


def deep_shallow_order(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices of distinct ``strings`` in order; all agree in their first ``depth`` bytes."""
    out: list[int] = []
    todo = [(list(range(len(strings))), depth)]
    while todo:
        idx, d = todo.pop()
        if len(idx) < 2:
            out += idx
        elif d >= depth + shallow:
            trie = BlindTrie(strings)
            for i in idx:
                trie.insert(i)
            out += trie.ordered()
        else:
            head = [BlindTrie._at(strings[i], d) for i in idx]
            pivot = sorted(head[:: max(1, len(head) // 9)])[len(head[:: max(1, len(head) // 9)]) // 2]
            less = [i for i, c in zip(idx, head, strict=True) if c < pivot]
            same = [i for i, c in zip(idx, head, strict=True) if c == pivot]
            more = [i for i, c in zip(idx, head, strict=True) if c > pivot]
            todo += [(more, d), (same, d + 1 if pivot >= 0 else depth + shallow), (less, d)]
    return out


class Prefixes:
    """Longest common prefixes of ``strings``, from their sorted order and its neighbours' prefixes; all agree in their first
    ``depth`` bytes. Memory is linear in the number of strings."""

    def __init__(self, strings: list[bytes], depth: int = 0):
        distinct: dict[bytes, int] = {}
        code = np.array([distinct.setdefault(s, len(distinct)) for s in strings])
        own = list(distinct)
        order = deep_shallow_order(own, depth)
        self.near = np.array([lcp(own[i], own[j]) for i, j in zip(order[:-1], order[1:], strict=True)], np.int32)
        self.size = np.array([len(own[i]) for i in order], np.int32)
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        self.rank = rank[code]

    def row(self, i: int) -> np.ndarray:
        """The prefix that string i shares with each."""
        k = int(self.rank[i])
        out = np.empty(len(self.size), np.int32)
        out[k] = self.size[k]
        out[k + 1 :] = np.minimum.accumulate(self.near[k:])
        out[:k] = np.minimum.accumulate(self.near[:k][::-1])[::-1]
        return out[self.rank]


def common_prefixes(strings: list[bytes], depth: int = 0) -> np.ndarray:
    """All rows of ``Prefixes``."""
    p = Prefixes(strings, depth)
    return np.array([p.row(i) for i in range(len(strings))])

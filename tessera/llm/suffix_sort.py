"""Deep-shallow sorting of byte strings that share a group.

Shallow: multikey quicksort to a fixed depth, eight bytes a key; all segments
that are still tied are partitioned in the same vector operation.  Deep: what
stays tied goes, segment by segment, into a blind trie, which branches on single
bytes and looks at whole strings only once per insertion; walking it gives the
order.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


class BlindTrie:
    """Orders equal-length strings; a node is [depth, children] or a list of equal ones."""

    __slots__ = ("size", "root")

    def __init__(self, size: int):
        self.size, self.root = size, None

    def insert(self, string: bytes, row: int) -> None:
        if self.root is None:
            self.root = ("leaf", string, [row])
            return
        node = self.root
        while node[0] != "leaf":  # blind descent: any leaf that agrees on the branching bytes
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == string:
            node[2].append(row)
            return
        differ = int.from_bytes(other, "big") ^ int.from_bytes(string, "big")
        at = self.size - (differ.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] != "leaf" and node[0] < at:
            above, node = node, node[1][string[node[0]]]
        leaf = ("leaf", string, [row])
        if node[0] == at:
            node[1][string[at]] = leaf
            return
        split = (at, {other[at]: node, string[at]: leaf})
        if above is None:
            self.root = split
        else:
            above[1][string[above[0]]] = split

    def walk(self, order: list[int], common: list[int]) -> None:
        """Append rows in order and, for each, the length it shares with the one before."""
        stack = [(self.root, common[-1] if common else 0)] if self.root else []
        first = True
        while stack:
            node, shared = stack.pop()
            if node[0] == "leaf":
                for row in node[2]:
                    order.append(row)
                    common.append(-1 if first else shared)
                    first, shared = False, self.size
                continue
            keys = sorted(node[1])
            for k in reversed(keys[1:]):
                stack.append((node[1][k], node[0]))
            stack.append((node[1][keys[0]], shared))


def keys_at(strings: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    part = strings[rows, depth : depth + 8]
    if part.shape[1] < 8:
        part = np.pad(part, ((0, 0), (0, 8 - part.shape[1])))
    return np.ascontiguousarray(part).view(">u8").reshape(-1).astype(np.uint64)


def deep_shallow(strings: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the rows of strings (uint8, one string a row) within their groups.
    Returns (order, common): common[i] is the length that the i-th string of the
    order shares with the one before it, -1 at the start of a group."""
    n, size = strings.shape
    order = np.argsort(group, kind="stable")
    common = np.full(n, size, dtype=np.int64)
    if not n:
        return order, common
    ranked = group[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    common[new] = -1
    depth = 0
    while depth < min(shallow, size):
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        segment = np.cumsum(new)[tied]
        key = keys_at(strings, order[tied], depth)
        by = np.lexsort((key, segment))
        order[tied] = order[tied][by]
        key = key[by]
        cut = np.flatnonzero((key[1:] != key[:-1]) & (segment[1:] == segment[:-1])) + 1
        # the first byte in which two neighbouring keys differ
        differ = key[cut] ^ key[cut - 1]
        zeros = np.zeros(len(cut), dtype=np.int64)
        for b in range(7, 0, -1):
            zeros += differ < (np.uint64(1) << np.uint64(8 * b))
        common[tied[cut]] = np.minimum(depth + zeros, size)
        new[tied[cut]] = True
        depth += 8
    start = np.flatnonzero(new & ~np.append(new[1:], True))
    stops = np.flatnonzero(new)
    for s in start.tolist():
        at = np.searchsorted(stops, s, side="right")
        e = int(stops[at]) if at < len(stops) else n
        trie = BlindTrie(size)
        for row in order[s:e].tolist():
            trie.insert(strings[row].tobytes(), row)
        rows: list[int] = []
        shared: list[int] = []
        trie.walk(rows, shared)
        order[s:e] = rows
        common[s + 1 : e] = shared[1:]
    return order, common


def classes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Per row (not per place): equal numbers for strings of a group that agree on
    their first `depth` bytes."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out

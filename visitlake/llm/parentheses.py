"""A trie as balanced parentheses: range min-max blocks over the excess find where a subtree closes."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 64


class Parentheses:
    """Open (True) and closing brackets of a tree in preorder."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        #: opening brackets, and leaves (an opening bracket closed at once), before each position
        self.opened = np.concatenate([[0], np.cumsum(bits)])
        leaf = bits.copy()
        leaf[:-1] &= ~bits[1:]
        leaf[-1:] = False
        self.leaves = np.concatenate([[0], np.cumsum(leaf)])
        blocks = -(-len(bits) // BLOCK)
        self.width = 1 << max(0, (max(1, blocks) - 1).bit_length())
        padded = np.full(self.width * BLOCK, np.iinfo(np.int64).max)
        padded[:len(bits)] = self.excess
        #: a heap: the least excess of each block, and of each two below
        self.least = np.full(2 * self.width, np.iinfo(np.int64).max)
        self.least[self.width:] = padded.reshape(-1, BLOCK).min(1)
        self._padded = padded
        level = self.width // 2
        while level:
            self.least[level:2 * level] = np.minimum(self.least[2 * level:4 * level:2], self.least[2 * level + 1:4 * level:2])
            level //= 2

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing bracket of each opening bracket: the first place after it with an excess less by one."""
        aim, out = self.excess[at] - 1, np.full(len(at), -1, np.int64)
        inside = (at + 1) % BLOCK > 0
        ended = np.flatnonzero(~inside)  # the block is over right after the bracket
        open_ = np.concatenate([ended, self._scan(np.flatnonzero(inside), at[inside] + 1, aim, out)])
        # up the heap until a block to the right goes low enough, then down to the first such block
        node, found, places = self.width + at[open_] // BLOCK, [], []
        while len(open_):
            right = node + 1
            hit = (node % 2 == 0) & (self.least[np.minimum(right, 2 * self.width - 1)] <= aim[open_])
            found.append(open_[hit])
            places.append(right[hit])
            open_, node = open_[~hit], node[~hit] // 2
        if found:
            open_, node = np.concatenate(found), np.concatenate(places)
            while (inner := node < self.width).any():
                left = 2 * node[inner]
                node[inner] = np.where(self.least[left] <= aim[open_[inner]], left, left + 1)
            self._scan(open_, (node - self.width) * BLOCK, aim, out)
        return out

    def _scan(self, which: np.ndarray, start: np.ndarray, aim: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Look from `start` to the end of its block; what is not found there is returned."""
        place, lost = start, []
        while len(which):
            hit = self._padded[place] <= aim[which]
            out[which[hit]] = place[hit]
            which, place = which[~hit], place[~hit] + 1
            over = place % BLOCK == 0
            lost.append(which[over])
            which, place = which[~over], place[~over]
        return np.concatenate(lost) if lost else which


@dataclass
class Trie:
    """The nodes of a trie in preorder. Subtree of node i: nodes i to `after[i]` - 1."""
    depth: np.ndarray
    parent: np.ndarray
    path: np.ndarray
    after: np.ndarray
    leaves: np.ndarray
    ends: np.ndarray
    last: np.ndarray


def trie_of(tokens: np.ndarray, lengths: np.ndarray) -> Trie:
    """The trie of distinct paths in lexicographic order, given by their tokens (rows of 64-bit numbers) one after another.

    `path` is the first path through each node, `ends` the node where each path ends, `last` the nodes of the last path.
    """
    n = len(lengths)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(n), lengths)
    place = np.arange(len(row)) - starts[row]
    earlier = np.maximum(row - 1, 0)
    both = (row > 0) & (place < lengths[earlier])
    where = np.flatnonzero(both)
    differ = where[(tokens[where] != tokens[starts[earlier[where]] + place[where]]).any(1)]
    common = np.minimum(lengths, np.concatenate([[-1], lengths[:-1]]))
    np.minimum.at(common, row[differ], place[differ])
    new = lengths - common
    closing = np.concatenate([[0], lengths[:-1] - common[1:]])
    runs = np.concatenate([np.column_stack([closing, new]).ravel(), [lengths[-1] + 1]])
    kinds = np.concatenate([np.tile([False, True], n), [False]])
    tree = Parentheses(np.repeat(kinds, runs))
    opening = np.flatnonzero(tree.bits)
    close = tree.findclose(opening)
    path = np.repeat(np.arange(n), new)
    ends = np.cumsum(new) - 1
    first = ends + 1 - new
    depth = np.arange(len(path)) - first[path] + common[path] + 1
    parent = np.arange(len(path)) - 1
    stack = np.zeros(int(lengths.max(initial=0)) + 1, np.int64)
    for f, c, length in zip(first.tolist(), common.tolist(), lengths.tolist()):
        if f:
            parent[f] = stack[c]
        stack[c + 1:length + 1] = np.arange(f, f + length - c)
    return Trie(depth, parent, path, tree.opened[close], tree.leaves[close] - tree.leaves[opening], ends, stack[:int(lengths[-1]) + 1].copy())


def range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each pair; every range has a value."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    size = hi - lo
    power = np.frexp(size.astype(float))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k, level in enumerate(levels):
        some = np.flatnonzero(power == k)
        out[some] = np.minimum(level[lo[some]], level[hi[some] - 2 ** k])
    return out

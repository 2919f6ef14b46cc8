"""A path-copied persistent search tree held in arrays.

Version v holds the first v + 1 inserted items. Inserting an item copies the nodes on the path from the root to its
place; the other child of each copied node is the newest copy of that subtree made before. Node (level, v) is the copy
made by version v at that level, so a tree of n items takes n * (levels + 1) nodes and all of a level is made at once.
"""

from __future__ import annotations

import numpy as np


class PersistentTree:
    """ranks[v] is the place, among all keys in order, of the item inserted by version v; all places differ."""

    def __init__(self, ranks: np.ndarray):
        n = len(ranks)
        self.size = n
        self.height = max(1, int(n - 1).bit_length()) if n else 1
        r = ranks.astype(np.int64)
        versions = np.arange(n, dtype=np.int64)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        for level in range(self.height):
            side = r >> (self.height - level - 1)
            newest = _newest_of_sibling(side)
            is_right = (side & 1).astype(bool)
            self.left.append(np.where(is_right, newest, versions))
            self.right.append(np.where(is_right, versions, newest))
        # Greatest place below each node, from the leaves up.
        self.greatest = [np.empty(0, np.int64)] * (self.height + 1)
        self.greatest[self.height] = r
        for level in range(self.height - 1, -1, -1):
            below = self.greatest[level + 1]
            right, left = self.right[level], self.left[level]
            self.greatest[level] = np.where(right >= 0, below[right], below[left]) if n else below

    def floor(self, versions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each probe the greatest place not above its bound in its version, or -1. Versions of -1 are empty."""
        node = versions.astype(np.int64).copy()
        bound = bounds.astype(np.int64)
        node[bound < 0] = -1
        best = np.full(len(node), -1, np.int64)
        if not self.size:
            return best
        for level in range(self.height):
            live = node >= 0
            to_right = live & (((bound >> (self.height - level - 1)) & 1) == 1)
            left = np.where(live, self.left[level][node], -1)
            passed = to_right & (left >= 0)
            best[passed] = self.greatest[level + 1][left[passed]]
            node = np.where(to_right, self.right[level][node], left)
        hit = node >= 0
        best[hit] = bound[hit]
        return best


def _newest_of_sibling(side: np.ndarray) -> np.ndarray:
    """For each position the last earlier position whose block is the sibling of its own, or -1."""
    n = len(side)
    if not n:
        return np.empty(0, np.int64)
    order = np.argsort(side >> 1, kind="stable")
    parent, odd = (side >> 1)[order], (side & 1)[order].astype(bool)
    at = np.arange(n)
    starts = np.maximum.accumulate(np.where(np.r_[True, parent[1:] != parent[:-1]], at, 0))
    last_odd = np.maximum.accumulate(np.where(odd, at, -1))
    last_even = np.maximum.accumulate(np.where(odd, -1, at))
    other = np.where(odd, last_even, last_odd)
    found = np.where(other >= starts, order[np.maximum(other, 0)], -1)
    out = np.empty(n, np.int64)
    out[order] = found
    return out


def latest_known(item_shard, item_time, item_key, item_tie, probe_shard, probe_time, probe_key) -> np.ndarray:
    """Index of the item each probe sees, or -1.

    Items are (shard, time at which they become known, key, tie breakers in rising order); a probe sees, of its shard's
    items known by its time, the one with the greatest (key, ties) whose key isn't above the probe's key. All shards
    share one tree: the shard leads both the order of insertion and the order of keys.
    """
    n, m = len(item_shard), len(probe_shard)
    if not n or not m:
        return np.full(m, -1, np.int64)
    inserted = np.lexsort((item_time, item_shard))
    by_key = np.lexsort((*reversed(item_tie), item_key, item_shard))
    place = np.empty(n, np.int64)
    place[by_key] = np.arange(n)
    tree = PersistentTree(place[inserted])
    root = _count_up_to(item_shard, item_time, probe_shard, probe_time) - 1
    bound = _count_up_to(item_shard, item_key, probe_shard, probe_key) - 1
    found = tree.floor(root, bound)
    item = np.where(found >= 0, by_key[np.maximum(found, 0)], -1)
    return np.where((item >= 0) & (item_shard[np.maximum(item, 0)] == probe_shard), item, -1)


def _count_up_to(a1, a2, b1, b2) -> np.ndarray:
    """For each pair (b1, b2) the number of pairs (a1, a2) not above it."""
    n = len(a1)
    which = np.r_[np.zeros(n, np.int8), np.ones(len(b1), np.int8)]
    order = np.lexsort((which, np.r_[a2, b2], np.r_[a1, b1]))
    is_item = which[order] == 0
    counts = np.cumsum(is_item)
    out = np.empty(len(b1), np.int64)
    out[order[~is_item] - n] = counts[~is_item]
    return out

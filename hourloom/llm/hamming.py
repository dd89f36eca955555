"""Majority fingerprints (SimHash) and BK-trees that are built and searched for many values at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 256
BLOCK = 1 << 19
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint per text from the concatenated hashes of all texts; zero for texts without any.

    Bits are summed in byte lanes over runs of at most 255 hashes, then over the runs of a text.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    runs = -(-n // 255)
    run_first = np.cumsum(runs) - runs
    starts = np.repeat(first - 255 * run_first, runs) + 255 * np.arange(runs.sum())
    for low in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(low)) & _LANES, starts)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
        for byte in range(8):
            out[full] |= (2 * sums[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + low)
    return out


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.root = None

    def near(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            other, children = todo.pop()
            d = (value ^ other).bit_count()
            if d <= radius:
                found.append(other)
            for edge in range(d - radius, d + radius + 1):
                if edge in children:
                    todo.append(children[edge])
        return found

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (value, {})
                return
            node = node[1][d]


def tree_pairs(values: np.ndarray, radius: int, group: np.ndarray, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places (i, j), i < j, of all values at `radius` or fewer differing bits whose `group` differs.

    A BK-tree: the first value of a subtree is its root, the others hang below it by their distance to it, and a query
    goes down where the triangle inequality lets a partner be. All queries go down a subtree together, and up to `leaf`
    values, or values that are all equally far, are compared at once. The caller may merge groups (in `group`) between
    blocks; what is one group by then is not searched further.
    """
    todo = [(np.arange(len(values)), np.arange(len(values)))]
    while todo:
        asking, held = todo.pop()
        if group[held[0]] == group[held[-1]] and (group[held] == group[held[0]]).all():
            asking = asking[group[asking] != group[held[0]]]
        asking = asking[asking > held[0]]
        if not len(asking):
            continue
        apart = np.bitwise_count(values[held[1:]] ^ values[held[0]])
        if len(held) <= leaf or (apart == apart[0]).all():
            step = max(1, BLOCK // len(held))
            for low in range(0, len(asking), step):
                own = asking[low : low + step]
                if (group[held] == group[held[0]]).all():
                    own = own[group[own] != group[held[0]]]
                near = np.bitwise_count(values[own][:, None] ^ values[held][None, :]) <= radius
                near &= (held[None, :] < own[:, None]) & (group[held][None, :] != group[own][:, None])
                j, i = np.nonzero(near)
                if len(i):
                    yield held[i], own[j]
            continue
        far = np.bitwise_count(values[asking] ^ values[held[0]])
        hits = asking[(far <= radius) & (group[asking] != group[held[0]])]
        if len(hits):
            yield np.full(len(hits), held[0]), hits
        for edge in np.unique(apart).tolist():
            todo.append((asking[np.abs(far.astype(np.int64) - edge) <= radius], held[1:][apart == edge]))


class Groups:
    """Groups of places that links have joined; `label` holds the group of each."""

    def __init__(self, labels: np.ndarray):
        self.label = np.unique(labels, return_inverse=True)[1]

    def spanning(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which links (i, j) join two groups, taken one after the other; `label` is changed in place."""
        a, b = self.label[i], self.label[j]
        size = len(self.label)
        _, first = np.unique(np.minimum(a, b) * size + np.maximum(a, b), return_index=True)
        parent, kept = {}, []

        def top(x):
            while x in parent:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for k in np.sort(first).tolist():
            x, y = top(int(a[k])), top(int(b[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(k)
        if kept:
            whole = np.arange(size)
            for x in parent:
                whole[x] = top(x)
            self.label[:] = whole[self.label]
        return np.array(kept, dtype=np.int64)

"""Words of whole texts as NumPy columns: A-Z lower-cased, split at the six ASCII white-space characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand; they are not shipped with a function."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __reduce__(self):
        return Powers, (self.base,)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(self.base, -1, 1 << 64)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, k, 1 << 64))])
        return self.up, self.down


_POWERS = Powers(_BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Word i lies at bytes start[i]:end[i] of `data`; text t has the words first[t]:first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def prefix_sums(self) -> np.ndarray:
        up, _ = _POWERS.upto(len(self.data))
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray | None = None, longest: int | None = None) -> np.ndarray:
        """64-bit hash of every word, or of its first `longest` bytes."""
        sums = self.prefix_sums() if sums is None else sums
        _, down = _POWERS.upto(len(self.data) + 1)
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        return mixed((sums[end] - sums[self.start]) * down[self.start])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(column: pa.Array) -> Words:
    """Words of a string column; null texts have none."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    data = _LOWER[raw]
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on; positions near the end run into what follows."""
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(min(size, len(words))):
        out[: len(words) - k] += words[k:] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return mixed(out)

"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, binary search.

Common prefixes are counted up to a depth, the length of the matches sought.
"""

from __future__ import annotations

import numpy as np

_PAD = 16


class Shard:
    """A text with its suffix array; text is given with its length in bytes as a uint8 array."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n, self.depth = len(text), depth
        # no UTF-8 text holds 0xFF, so a text's end differs from all that goes on
        padded = np.concatenate([text, np.full(depth + 2 * _PAD, 0xFF, np.uint8)])
        # the eight bytes from each position on, first byte highest
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: self.n + depth + _PAD].copy().view(">u8")[:, 0].astype(np.uint64)
        self.array, self.rank = self._refine()

    def _refine(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix doubling that sorts again only groups of suffixes not yet told apart."""
        n = self.n
        order = np.argsort(self.words[:n])
        key = self.words[order]
        rank = np.full(n + 1, n, np.int64)
        new = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        at = slots = np.arange(n)
        h = 4
        while len(at):
            h *= 2
            rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
            alone = new & np.concatenate([new[1:], [True]])
            at = at[~alone]
            if not len(at):
                break
            suffixes = order[at]
            key = (rank[suffixes] << np.int64(32)) + rank[np.minimum(suffixes + h, n)]
            by = np.argsort(key)
            key = key[by]
            order[at] = suffixes[by]
            new = np.ones(len(at), bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[order] = slots
        return order, rank[:n]

    def common_prefixes(self, chains: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kasai over the positions in chains (starts, lengths), in the order that the array has them.

        Returns those positions and the bytes, up to depth, that each shares
        with the one before.  Along a chain the shared length falls by one at
        most, if the position before moves along too; so all chains step
        together and compare on from there.
        """
        member = np.zeros(self.n + 1, np.int64)
        np.add.at(member, chains, 1)
        np.add.at(member, chains + lengths, -1)
        member = np.cumsum(member)[:-1] > 0
        sparse = self.array[member[self.array]]
        before = np.full(self.n, -1, np.int64)
        before[sparse[1:]] = sparse[:-1]
        member = np.append(member, False)
        out = np.zeros(self.n, np.int64)
        by = np.argsort(-lengths, kind="stable")
        chains, lengths = chains[by], lengths[by]
        h, follows = np.zeros(len(chains), np.int64), np.zeros(len(chains), bool)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            i = chains[:live] + t
            j = before[i]
            known = np.where(follows[:live] & (j >= 0), np.maximum(h[:live] - 1, 0), 0)
            todo = np.flatnonzero(j >= 0)
            a, b = i[todo] + known[todo], j[todo] + known[todo]
            while len(todo):
                differ = self.words[a] ^ self.words[b]
                same = differ == 0
                known[todo] += np.where(same, 8, _leading_bytes(differ))
                go = same & (known[todo] < self.depth)
                todo, a, b = todo[go], a[go] + 8, b[go] + 8
            # padding is no match
            known = np.where(j >= 0, np.minimum(known, np.minimum(self.depth, self.n - np.maximum(i, j))), 0)
            h[:live], follows[:live] = known, member[j + 1] & (j >= 0)
            out[i] = known
        return sparse, out[sparse]

    def ranges(self, other: Shard, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search: for each string of depth bytes of other, from starts on, the array slots [lo, hi) that begin with it."""
        lo = self._bound(other, starts, False)
        return lo, self._bound(other, starts, True)

    def _bound(self, other: Shard, starts: np.ndarray, after_equal: bool) -> np.ndarray:
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64)
        while len(todo := np.flatnonzero(lo < hi)):
            mid = (lo[todo] + hi[todo]) // 2
            order = self._compare(self.array[mid], other, starts[todo])
            right = order < 0 if not after_equal else order <= 0
            lo[todo] = np.where(right, mid + 1, lo[todo])
            hi[todo] = np.where(right, hi[todo], mid)
        return lo

    def _compare(self, own: np.ndarray, other: Shard, starts: np.ndarray) -> np.ndarray:
        """-1, 0, 1 as the own suffix is below, equal to or above the other's first depth bytes."""
        out = np.zeros(len(own), np.int64)
        todo = np.arange(len(own))
        for k in [*range(0, self.depth - 7, 8), *([self.depth - 8] if self.depth % 8 else [])]:
            a, b = self.words[own[todo] + k], other.words[starts[todo] + k]
            out[todo] = np.where(a < b, -1, np.where(a > b, 1, 0))
            todo = todo[a == b]
            if not len(todo):
                break
        return out


def _leading_bytes(differ: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two words, from their nonzero difference."""
    out = np.zeros(len(differ), np.int64)
    for shift in (32, 16, 8):
        high = (differ >> np.uint64(64 - shift)) == 0
        out += np.where(high, shift // 8, 0)
        differ = np.where(high, differ << np.uint64(shift), differ)
    return out


def repeated_starts(shard: Shard, chains: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A flag for each position: it lies in a chain (start, length), and its first depth bytes begin at another such position too."""
    order, shared = shard.common_prefixes(chains, lengths)
    out = np.zeros(shard.n, bool)
    full = np.append(shared >= shard.depth, False)
    out[order] = full[:-1] | full[1:]
    return out

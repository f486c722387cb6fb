"""Minimal perfect hash of 32-byte digests, in numpy.

A cascade of bit levels: each key that has a level's position to itself sets
that bit, the others go on to the next level.  A key's slot is the number of
bits set before its own.  Lookups of keys outside the set give some slot or
none, so callers compare the full digest in the slot.
"""

from __future__ import annotations

import numpy as np

_GAMMA = 2.0


def _positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    rng = np.random.default_rng(1000 + level)
    odd = rng.integers(1, 2**63, size=4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.zeros(len(words), np.uint64)
    for k in range(4):
        h ^= words[:, k] * odd[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def digest_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def build(words: np.ndarray) -> list[np.ndarray]:
    """Bit levels (uint8, one per position) for distinct keys."""
    levels, rest = [], words
    while len(rest):
        size = max(2, int(_GAMMA * len(rest)))
        at = _positions(rest, len(levels), size)
        own = np.bincount(at, minlength=size) == 1
        levels.append(own.astype(np.uint8))
        rest = rest[~own[at]]
    return levels


def slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 where no level has its bit."""
    found = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for k, bits in enumerate(levels):
        if not len(left):
            break
        at = _positions(words[left], k, len(bits))
        hit = bits[at] == 1
        before = np.cumsum(bits, dtype=np.int64)
        found[left[hit]] = base + before[at[hit]] - 1
        left, base = left[~hit], base + int(before[-1])
    return found


def pack(levels: list[np.ndarray]) -> tuple[bytes, list[int]]:
    return b"".join(np.packbits(x).tobytes() for x in levels), [len(x) for x in levels]


def unpack(blob: bytes, sizes: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for n in sizes:
        width = (n + 7) // 8
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, width, at), count=n))
        at += width
    return out

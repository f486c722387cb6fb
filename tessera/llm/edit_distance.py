"""Banded bit-parallel edit distance over many pairs at once, in numpy."""

from __future__ import annotations

import numpy as np

_TOP = np.uint64(1 << 63)


def _codes(texts: list[str], width: int, left: int, void: int) -> np.ndarray:
    """Code points by place and text, shifted by left; void where a text has none."""
    out = np.full((width, len(texts)), void, np.int32)
    for k, t in enumerate(texts):
        out[left : left + len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<i4")
    return out


def within(pairs: list[tuple[str, str]], most: int) -> np.ndarray:
    """Whether each pair's edit distance is at most `most`.

    Common beginnings and ends come off first.  Column by column, a word of bits holds the differences down the band of
    2 * most + 1 diagonals; the distance is followed along the band's lower
    edge and then along the last row.  Pairs leave as soon as they can no
    longer come back within the limit.
    """
    result = np.zeros(len(pairs), bool)
    pairs = [_stripped(a, b) if abs(len(a) - len(b)) <= most else (a, b) for a, b in pairs]
    for k, (a, b) in enumerate(pairs):
        result[k] = max(len(a), len(b)) <= most
    order = [k for k, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= most < max(len(a), len(b))]
    order.sort(key=lambda k: max(map(len, pairs[k])))
    for at in range(0, len(order), 2048):
        part = order[at : at + 2048]
        result[part] = _within([pairs[k] if len(pairs[k][0]) >= len(pairs[k][1]) else pairs[k][::-1] for k in part], most)
    return result


def _agreeing(a: str, b: str, end: bool) -> int:
    """Length of the common beginning, or end, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if (a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]) if end else (a[low:mid] == b[low:mid]):
            low = mid
        else:
            high = mid - 1
    return low


def _stripped(a: str, b: str) -> tuple[str, str]:
    k = _agreeing(a, b, False)
    a, b = a[k:], b[k:]
    k = _agreeing(a, b, True)
    return a[: len(a) - k], b[: len(b) - k]


def _within(pairs: list[tuple[str, str]], most: int) -> np.ndarray:
    m, n = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    long_, short = _codes([p[0] for p in pairs], int(m.max()) + 2 * most + 1, most, -1), _codes([p[1] for p in pairs], int(n.max()), 0, -2)
    live = np.arange(len(pairs))
    plus = np.full(len(pairs), ((1 << 64) - 1) << (63 - most) & ((1 << 64) - 1), np.uint64)
    minus = np.zeros(len(pairs), np.uint64)
    score = np.full(len(pairs), most, np.int64)
    result = np.zeros(len(pairs), bool)
    bits = [np.uint64(1 << (63 - d)) for d in range(2 * most + 1)]
    one = np.uint64(1)
    for i in range(int(n.max())):
        c = short[i, live]
        x = np.zeros(len(live), np.uint64)
        for d, bit in enumerate(bits):  # bit 63 - d stands for place i + most - d of the longer text
            x |= np.where(long_[i + 2 * most - d, live] == c, bit, np.uint64(0))
        zero = (((x & plus) + plus) ^ plus) | x | minus
        up, down = minus | ~(zero | plus), zero & plus
        diagonal = i < m[live] - most
        row = (62 - (i - (m[live] - most))).clip(0, 63).astype(np.uint64)
        step = (up >> row & one).astype(np.int64) - (down >> row & one).astype(np.int64)
        score += np.where(diagonal, (zero & _TOP == 0).astype(np.int64), step)
        plus = down | ~((zero >> one) | up)
        minus = (zero >> one) & up
        left = n[live] - 1 - i
        done = left == 0
        # each column of the last row takes off one at most
        lost = score > most + np.minimum(left, n[live] - m[live] + most)
        result[live[done]] = score[done] <= most
        stay = ~(done | lost)
        if not stay.all():
            live, plus, minus, score = live[stay], plus[stay], minus[stay], score[stay]
            if not len(live):
                break
    return result

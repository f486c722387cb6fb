"""Plain answers that the operators are held against."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import xxhash


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, k):
        while self.up[k] != k:
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def repeats(rows, length):
    """(doc_id, bytes, removed, spans, sha256 of what stays) for (doc_id, text) rows."""
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def shingles(text, size=5):
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_keepers(rows, least=0.8):
    """doc_ids that stay of (doc_id, text) rows; None sorts last."""
    sets = [shingles(t) for _, t in rows]
    groups = Groups(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            union = sets[a] | sets[b]
            if not union or len(sets[a] & sets[b]) / len(union) >= least:
                groups.join(a, b)
    members = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        members[groups.root(k)].append(doc)
    return sorted(min(m, key=lambda d: (d is None, d or 0)) for m in members.values())


def leaks(text, items, size=10):
    """(words, hit words, items) by comparing every window at every place."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c < "\x7f" or "a" <= c <= "z" or c > "\x7f" else " " for c in t or "").split(" ")
    words = [w for w in fold(text) if w]
    hit, found = set(), set()
    for item, item_text in items:
        own = [w for w in fold(item_text) if w]
        n = min(size, len(own))
        for p in range(len(own) - n + 1) if n else ():
            for q in range(len(words) - n + 1):
                if words[q : q + n] == own[p : p + n]:
                    hit.update(range(q, q + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)

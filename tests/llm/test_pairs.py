"""SimHash, line dedup, suffix-array dedup and near texts against brute force."""

import random

import numpy as np
import pytest

from tessera.llm import line_dedup, near_text, repeats
from tessera.llm import simhash as simhash_module
from tessera.llm.edit_distance import within
from tessera.llm.graph import components
from tessera.llm.simhash import BkTree, links, near_duplicates, shingle_hashes, simhash
from tessera.llm.suffix_array import Shard, repeated_starts

from . import brute

DOCS = "doc_id long, text string"


def test_fingerprints_and_bk_tree():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["A", "bé", "c", "d"]) for _ in range(n))
        assert simhash(shingle_hashes(text.encode().lower().split(), 3)) == brute.fingerprint(text)
    values = list({rng.getrandbits(12) for _ in range(300)})
    tree = BkTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert BkTree.unpacked(tree.packed()).within(q, 2) == tree.within(q, 2)
        assert sorted(values[k] for k in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


@pytest.mark.parametrize(("limit", "nodes"), [(4, 0), (4, 1 << 20), (1024, 0), (1024, 1 << 20)])
def test_links_connect_what_brute_force_connects(spark, limit, nodes):
    """Shard trees probed where they are built and broadcast ones give the same groups."""
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:15]:
        for _ in range(8):
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values | {0, 1, 3})
    groups = brute.Groups(len(values))
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 2:
                groups.join(a, b)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = {r.node: r.root for r in components(links(frame, 2, limit, nodes)).collect()}
    got, want = {}, {}
    for k, v in enumerate(signed):
        got.setdefault(roots.get(v, v), set()).add(v)
        want.setdefault(groups.root(k), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize(("limit", "nodes"), [(4, 0), (4, 1 << 20), (1024, 0), (1024, 1 << 20)])
def test_near_text_proposes_by_bk_trees(spark, monkeypatch, limit, nodes):
    """Texts with fingerprints within the radius meet in a shard, found by its BK-tree alone."""
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(30)]
    prints += [p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for p in prints[:10]] + prints[8:12] + [p ^ 7 for p in prints[12:16]]
    texts = [(bytes([k]), p - (1 << 64) if p >> 63 else p, 1) for k, p in enumerate(prints)]
    frame = spark.createDataFrame(texts, "words binary, fingerprint long, size int")

    def met():
        groups = {}
        for r in near_text._print_rows(frame, 2, limit, nodes).collect():
            groups.setdefault((r.place, r.value), set()).add(bytes(r.words)[0])
        return {(a, b) for g in groups.values() for a in g for b in g if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}

    want = {(a, b) for b in range(len(prints)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 2}
    assert met() == want
    monkeypatch.setattr(simhash_module, "shard_tree", lambda values: BkTree())
    if nodes == 0:
        assert met() == {(a, b) for a, b in want if prints[a] == prints[b]}


def test_near_duplicates_edge_rows(spark):
    rows = [(3, None), (9, ""), (4, "one two"), (7, "ONE two"), (4, "one two"), (None, "one two"), (5, "x y z w"), (None, "lone words here")]
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(3, 3), (9, 3), (4, 4), (7, 4), (4, 4), (None, 4), (5, 5), (None, None)], key=str)
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def edited(rng, line, n):
    line = list(line)
    for _ in range(n):
        k = rng.randrange(len(line) + 1)
        if rng.random() < 0.4 or not line:
            line.insert(k, rng.choice("xyzab"))
        elif rng.random() < 0.4:
            line.pop(min(k, len(line) - 1))
        else:
            line[min(k, len(line) - 1)] = rng.choice("pq𐐷b")
    return "".join(line)


def test_edit_distance():
    rng = random.Random(3)
    for most in (0, 1, 2, 3):
        pairs = []
        for _ in range(600):
            a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 20)))
            pairs.append((a, edited(rng, a, rng.randint(0, most + 2))))
        assert within(pairs, most).tolist() == [brute.edit_distance(a, b) <= most for a, b in pairs]


def test_segment_keys_of_long_lines(monkeypatch):
    """A line keyed by pieces has the keys of one keyed in a portion, and probes hit the segments of near lines."""
    rng = random.Random(12)
    lines = ["".join(rng.choice("abé𐐷 ") for _ in range(n)) for n in (0, 9, 10, 25, 31, 64, 200, 333)]
    flat = lambda probes: sorted((int(k), int(v), int(n)) for a, b, c in line_dedup.SegmentKeys(2, probes).of(lines) for k, v, n in zip(a, b, c))
    whole = flat(False), flat(True)
    monkeypatch.setattr(line_dedup, "_LONG", 20)
    assert (flat(False), flat(True)) == whole
    own = {v for k, v, _ in whole[0] if k == 6}
    for _ in range(30):
        other = edited(rng, lines[6], 2)
        near = {int(v) for a, b, _ in [*line_dedup.SegmentKeys(2, True).of([other]), *line_dedup.SegmentKeys(2, False).of([other])] for v in b}
        shorter = {int(v) for _, b, _ in line_dedup.SegmentKeys(2, False).of([other]) for v in b}
        back = {int(v) for _, b, _ in line_dedup.SegmentKeys(2, True).of([lines[6]]) for v in b} | own
        assert near & own if len(other) >= len(lines[6]) else shorter & back


@pytest.mark.parametrize(("threshold", "group_rows"), [(2, 1024), (1, 4), (3, 64)])
def test_line_join(spark, threshold, group_rows):
    """Lines of 0 to 42 code points, so of all classes of length, exact copies included."""
    rng = random.Random(threshold)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 40))) for _ in range(35)]
    rows = [(k if rng.random() < 0.9 else None, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 1, 2, 3])) for _ in range(rng.randint(0, 6)))) for k in range(50)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, rows[5][1]), rows[6], *((400 + k, f"template line {k:03d} end") for k in range(20))]
    rows += [(500 + k, f"{'x' * 30}{'yz' * (k % 3)}\n  {'long line ' * 4000}{k}") for k in range(4)]
    occurrences = [(d, t, n, x.strip() or None) for d, t in rows for n, x in enumerate((t or "").split("\n"))]
    lines = sorted({o[3] for o in occurrences if o[3]})
    at = {x: k for k, x in enumerate(lines)}
    groups, n_links = brute.Groups(len(lines)), [0] * len(lines)
    for a in range(len(lines)):
        for b in range(a):
            most = min(threshold, min(len(lines[a]), len(lines[b])) // 10)
            if abs(len(lines[a]) - len(lines[b])) > most or len(lines[a]) > 9999 and lines[a][:9999] == lines[b][:9999] and lines[a][:-1] != lines[b][:-1]:
                continue
            if len(lines[a]) > 9999 or brute.edit_distance(lines[a], lines[b]) <= most:
                groups.join(a, b)
                n_links[a] += 1
                n_links[b] += 1
    place = lambda d, t, n: (d is not None, d or 0, repeats.text_key((t or "").encode()), n)
    first = {}
    for d, t, n, x in occurrences:
        if x:
            r = groups.root(at[x])
            first[r] = min(first.get(r, (2,)), place(d, t, n))
    want = {}
    for d, t, n, x in occurrences:
        if x:
            own = groups.root(at[x])
            want[place(d, t, n)] = (n_links[at[x]], first[own] == place(d, t, n))
    frame = spark.createDataFrame(rows, DOCS)
    got = {}
    for r in line_dedup.line_classes(frame, threshold, group_rows).collect():
        if r.links is not None:
            got[(r.doc_id is not None, r.doc_id or 0, r.key, r.line_no)] = (r.links, r.kept)
        else:
            assert r.kept
    assert got == want


def test_repeated_lines_go(spark):
    line, other = "this line is long enough to be looked at", "another line that is long enough as well"
    rows = [(1, f"{line}\nshort", 9, "k"), (2, f"short\n{line}x\n{other}", 9, "k"), (3, line, 9, "k"), (4, None, 9, "k"), (5, "", 9, "k"), (6, "short", 9, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, line string")
    got = {r.doc_id: (r.text, r.n_chars, r.line) for r in line_dedup.drop_repeated_lines(frame, least=10).collect()}
    want = {1: f"{line}\nshort", 2: f"short\n{other}", 4: None, 5: "", 6: "short"}
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame).collect()} == {1: f"{line}\nshort", 2: other, 4: None, 5: ""}
    assert got == {k: (t, None if t is None else len(t), "k") for k, t in want.items()}
    assert line_dedup.drop_repeated_lines(frame.limit(0)).columns == frame.columns


def test_short_equal_lines_go_in_the_queries(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm.queries import op6_line_dedup

    rows = [(1, "Les.\n\nAll rights reserved.\nLas."), (2, "x\n Les. \n\nalone"), (3, "All rights reserved."), (4, ""), (5, None), (6, "The anhely eran."), (7, "The, anhely eran.")]
    frame = spark.createDataFrame(rows, DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.removed, r.class_ids, r.class_id) for r in op6_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, "", "", 1), 2: (4, "1", "1", 1), 3: (1, "0", "1", 1), 4: (1, "", "", 4), 5: (1, "", "", 5), 6: (1, "", "", 6), 7: (1, "0", "6", 6)}
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame, str(tmp_path)).collect()}
    assert kept == {1: rows[0][1], 2: "x\n\nalone", 4: "", 5: None, 6: rows[5][1]}


def test_suffix_array():
    rng = np.random.default_rng(4)
    for _ in range(60):
        depth = int(rng.integers(8, 24))
        parts = [rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(depth, 60))).astype(np.uint8) for _ in range(rng.integers(1, 6))]
        parts.append(np.concatenate([rng.integers(0, 3, 4).astype(np.uint8), parts[0]]))
        text, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        shard, b = Shard(text, depth), text.tobytes()
        assert shard.array.tolist() == sorted(range(len(b)), key=lambda k: b[k:] + b"\xff")
        owned = [p for s, n in zip(starts, lengths) for p in range(s, s + n - depth + 1)]
        order, shared = shard.common_prefixes(starts, lengths - depth + 1)
        assert sorted(order.tolist()) == owned
        for x, y, n in zip(order, order[1:], shared[1:]):
            want = next((k for k in range(depth) if max(x, y) + k >= len(b) or b[x + k] != b[y + k]), depth)
            assert n == want
        strings = [b[p : p + depth] for p in owned]
        flags = repeated_starts(shard, starts, lengths - depth + 1)
        assert [p for p in range(len(b)) if flags[p]] == [p for p in owned if strings.count(b[p : p + depth]) > 1]
        lo, hi = shard.ranges(shard, np.array(owned))
        assert all(sorted(shard.array[x:y].tolist()) == [q for q in range(len(b) - depth + 1) if b[q : q + depth] == s] for s, x, y in zip(strings, lo, hi))


def found(frame, length, **more):
    rows = repeats.remove_repeats(frame, length, **more).collect()
    return sorted([(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in rows], key=str)


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, small):
    if small:  # texts in pieces, groups over several shards, groups in parts
        monkeypatch.setattr(repeats, "SHARD_BYTES", 1000)
        monkeypatch.setattr(repeats, "_PIECE", 300)
        monkeypatch.setattr(repeats, "repeat_spans", lambda docs, length, spans=repeats.repeat_spans: spans(docs, length, 4))
    rng = random.Random(6)
    units = ["ab", "cd", "é", "xy z", "q", "\n"]
    make = lambda a, b: "".join(rng.choice(units) for _ in range(rng.randint(a, b)))
    base = [make(30, 150) for _ in range(8)]
    rows = []
    for k in range(60):
        text = make(0, 40)
        for _ in range(rng.randint(0, 2)):
            b = rng.choice(base)
            at = rng.randrange(len(b) // 2)
            text += b[at : at + rng.randint(10, 120)] + make(0, 20)
        rows.append((k if rng.random() < 0.9 else None, text))
    rows += [(500, "a" * 300), (501, "abc" * 100), (500, "a" * 300), (7, None), (8, ""), (9, rows[3][1]), (9, rows[3][1])]
    assert found(spark.createDataFrame(rows, DOCS).repartition(3), 40) == brute.repeats(rows, 40)


def test_repeats_of_nothing(spark):
    assert found(spark.createDataFrame([], DOCS), 40) == []
    rows = [(1, "alone " * 3), (2, None)]
    assert found(spark.createDataFrame(rows, DOCS), 40) == brute.repeats(rows, 40)


def test_near_texts(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for _ in range(15):
        b = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        rows.append((len(rows), " ".join(b)))
        for _ in range(rng.randint(0, 4)):
            c = list(b)
            for _ in range(int(len(b) * rng.choice([0, 0.01, 0.03, 0.06]))):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append((len(rows), " ".join(c)))
    rows += [(1000, None), (1001, ""), (5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1])]
    frame = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, words string").repartition(3)
    kept = near_text.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute.near_keepers(rows)
    assert near_text.drop_near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [2048, 8])
def test_near_texts_of_one_template(spark, group_rows):
    """Similarities round the limit: a pair that fails must not hide one that passes."""
    rng = random.Random(11)
    rows = []
    for f in range(8):
        base = [f"f{f}w{k}" for k in range(150)]
        for _ in range(25):
            c = list(base)
            for k in rng.sample(range(150), rng.choice([2, 3, 4, 5])):
                c[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(c)))
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = near_text.near_classes(frame, group_rows=group_rows).collect()
    assert sorted({r.keep_id for r in got}) == brute.near_keepers(rows)


def test_equal_fingerprints_are_all_compared():
    """Rows 1 and 2 are alike, the least row 0 is like neither: the pair is found though all share one fingerprint."""
    far, near = np.arange(100, 200, dtype=np.uint64), np.arange(10, dtype=np.uint64)
    sets = [far, near, near]
    rows = [(0, bytes([k]), bytes(near_text.PLACES), [k] * near_text.BANDS, 7, x.tobytes()) for k, x in enumerate(sets)]
    group = near_text._Group(-1, rows, False, 2)
    assert group.compared() == rows and group.forest(0.8) == [(bytes([2]), bytes([1]))]

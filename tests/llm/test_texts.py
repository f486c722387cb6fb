"""Language model, URL filter, WARC, decontamination, mixing, exact dedup, toxicity and the pipeline."""

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, hidden_markov, mixing, perfect_hash, toxicity, url_filter, warc
from tessera.llm.shared import id_fold

from . import brute

DOCS = "doc_id long, text string"


def test_forward_and_counts_match_plain_recursions():
    rng = np.random.default_rng(1)
    k, symbols = 3, 7
    p = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None)
    model = hidden_markov.Hmm(p(k).astype(np.float32), p(k, k).astype(np.float32), np.ascontiguousarray(p(k, symbols).T, np.float32))
    texts = [rng.integers(0, symbols, n).astype(np.int32) for n in (1, 5, 9, 2, 30)]

    def plain(x):
        a = model.start * model.emit[x[0]].astype(float)
        for s in x[1:]:
            a = (a @ model.moves.astype(float)) * model.emit[s]
        return math.log10(a.sum())

    assert np.allclose(hidden_markov.forward(model, texts), [plain(x) for x in texts], rtol=1e-5)
    start, moves, emit, total = hidden_markov._add((x.astype("<u2").tobytes() for x in texts), model, symbols)
    assert np.isclose(start.sum(), len(texts), rtol=1e-5) and np.isclose(emit.sum(), sum(map(len, texts)), rtol=1e-5)
    assert np.isclose(moves.sum(), sum(len(x) - 1 for x in texts), rtol=1e-5) and np.isclose(total / math.log(10), sum(map(plain, texts)), rtol=1e-4)
    new = hidden_markov.normalised(start, moves, emit, np.full(symbols, 1 / symbols))
    assert hidden_markov._add((x.astype("<u2").tobytes() for x in texts), new, symbols)[3] > total - 5


def test_training_cuts_lose_little(monkeypatch):
    """Counts of a long text in segments with context are those of the whole text, but for what reaches beyond the context."""
    rng = np.random.default_rng(2)
    k, symbols = 3, 7
    p = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None)
    model = hidden_markov.Hmm(*(np.ascontiguousarray(x, float) for x in (p(k), 0.3 * np.eye(k) + 0.7 * p(k, k), p(k, symbols).T)))
    blobs = [rng.integers(0, symbols, n).astype("<u2").tobytes() for n in (700, 3, 64, 65, 200)]
    whole = hidden_markov._add(iter(blobs), model, symbols)
    monkeypatch.setattr(hidden_markov, "SEGMENT", 64)
    cut = hidden_markov._add(iter(blobs), model, symbols)
    for a, b in zip(whole, cut):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-4)
    monkeypatch.setattr(hidden_markov, "CONTEXT", 0)
    assert not np.allclose(hidden_markov._add(iter(blobs), model, symbols)[1], whole[1], rtol=1e-4, atol=1e-4)


def test_head_of_words_that_are_all_equally_common(spark):
    counts = spark.createDataFrame([(f"w{k}", 3) for k in range(500)], "word string, c long")
    vocab = hidden_markov.vocabulary(counts, 5, 100, 50)
    assert 50 < len(vocab.counts) <= 120 and len(vocab.symbol) == 50 and vocab.tokens == 1505
    assert sum(vocab.class_tokens) == 450 * 3 and sum(vocab.class_words) == 450


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(hidden_markov, "HEAD_WORDS", 12)
    rng = random.Random(2)
    a, b = ["the", "Cat", "sat", "on", "mats"], ["der", "Hund", "lief", "über", "Felder"]
    rows = [(k, " ".join(rng.choice(a if k % 2 else b) for _ in range(rng.randint(1, 60)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "zzz unseen\twords"), (None, "the cat"), (3, rows[3][1])]
    frame = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(hidden_markov.vocabulary, "__defaults__", (12, 8))
    got = hidden_markov.score_documents(frame, id_fold("doc_id", 5) == 1, states=4).collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), "end"]
    counts = Counter(w for d, t in rows if not out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), out(d), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)
    assert hidden_markov.score_documents(frame.limit(0), F.lit(False)).count() == 0


def test_class_shares_sum_to_one():
    v = hidden_markov.Vocabulary(100, 20, 5, {}, {}, [7] * 64, [3] * 64)
    assert math.isclose(sum((c + 0.5) / (v.class_tokens[0] + 0.5 * (v.class_words[0] + 1)) for c in (3, 3, 1, 0)), 1.0)


RULES = [url_filter.Rule("com/", "allow"), url_filter.Rule("example.com/en/", "block"), url_filter.Rule("www.example.com/en/", "allow"), url_filter.Rule("net/es/", "block")]


def test_url_rules(spark):
    cases = [
        ("http://A.Example.com/en/x?y", "a.example.com", "/en/x", "example.com/en/"), ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/"), ("http://x.com", "x.com", "", None), ("x.net/es/", "", "", None), (None, "", "", None), ("", "", "", None),
        ("a://b://c.net/es/#f", "b:", "//c.net/es/", None), ("http://É.net/es/", "É.net", "/es/", "net/es/"), ("http://com/", "com", "/", "com/"),
    ]
    got = url_filter.judge(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string"), RULES).collect()
    assert [(r.host, r.path, r.rule) for r in sorted(got, key=lambda r: r.page_id)] == [c[1:] for c in cases]
    assert all(r.verdict == {x.text: x.verdict for x in RULES}[r.rule] for r in got if r.rule)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_boosted_trees_learn_and_score_alike():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    prior, trees = url_filter.boost(x[:1500], y[:1500])
    model = url_filter.UrlModel(prior, trees)
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    for row, score in zip(x[:20], model.score(x[:20])):
        z = prior
        for feature, threshold, leaf in trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            z += leaf[node - len(feature)]
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_framing():
    for n in (0, 1, 15, 16, 17, 100):
        data = bytes(range(256))[:n]
        assert warc.dechunked(warc.chunked(data, 16)) == data
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    assert warc.reassemble([(2, 4, b"cd"), (1, None, b"ab")]) == b"abcd"
    for bad in ([(1, None, b"ab")], [(1, None, b"ab"), (3, 4, b"cd")], [(1, None, b"ab"), (2, 5, b"cd")], [(1, None, b"ab"), (1, None, b"ab"), (2, 4, b"cd")]):
        assert warc.reassemble(bad) is None


def test_archives_round_trip(spark, tmp_path):
    long_ = "é<p>\r\n\r\nWARC/1.1\r\n" * 300
    pages = [(5, "http://a\r\nb", long_), (2, None, long_), (9, "u", long_), (2, None, long_), (1, "u", None), (3, "u", ""), (4, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", "y" * 200), (7, "u", "y" * 200), (8, "u", "\r\n" * 80)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(frame, path, segment_bytes=1000, archive_records=4)
    got = warc.read_archives(spark, path).collect()
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if h == html and p is not None] if len(data) >= 100 else []
        refers = min(same) if same and min(same) != page else None
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    texts = {p: (h or "").encode() for p, _, h in pages}
    assert all(r.intact and (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == texts[r.page_id]) for r in got)
    for file in (tmp_path / "warc").glob("*.gz"):
        for fields, block in warc.parse_records(io.BytesIO(gzip.decompress(file.read_bytes()))):
            assert fields[b"warc-type"] in (b"response", b"revisit", b"continuation") and len(block) <= 1000
    warc.write_archives(frame.limit(0), f"{path}-none")
    assert warc.read_archives(spark, f"{path}-none").count() == 0


def test_broken_segments_are_reported(spark, tmp_path):
    records = list(warc.page_records("r", 1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None, 200))
    assert len(records) > 2
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"\r\n\r\n".join([*records[:1], *records[2:], b""])))
    row = warc.read_archives(spark, f"file://{tmp_path}").first()
    assert not row.intact and row.payload_bytes is None and row.payload is None


def test_leaks(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice(["a", "B", "c3", "é", "dd"]) + rng.choice(["", ",", " -"]) for _ in range(n))
    items = [(k, make(rng.randint(1, 14))) for k in range(12)] + [(90, None), (91, "!!"), (None, "a B"), (3, "zz yy xx"), (3, "zz yy xx")]
    docs = [(k, make(rng.randint(0, 80)), "k") for k in range(40)] + [(50, None, "k"), (51, "", "k"), (52, " ".join(t for _, t in items[:4]).upper(), "k"), (52, "zz yy-xx", "k")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, note string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [(k, t) for k, t in items if k is not None]
    want = sorted((d, *brute.leaks(t, named)) for d, t, _ in docs)
    for size, blocks, held in ((decontaminate.BLOCK_BYTES, 8, 1 << 20), (60, 100, 400), (60, 2, 1), (60, 1, 1 << 20)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        monkeypatch.setattr(decontaminate, "PASS_BLOCKS", blocks)
        monkeypatch.setattr(decontaminate, "HELD_BYTES", held)
        got = decontaminate.find_leaks(frame, bench).collect()
        assert sorted((r.doc_id, r.words, sum(s.last - s.first + 1 for s in r.spans), r["items"]) for r in got) == want
    clean = decontaminate.drop_leaked(frame.withColumnRenamed("note", "items"), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[2]) and clean.columns == ["doc_id", "text", "items"]
    assert decontaminate.find_leaks(frame, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def apportion(shares, house):
    seats = [0] * len(shares)
    for _ in range(house):
        best = max(range(len(shares)), key=lambda k: (shares[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
    return seats


def test_apportionment(spark):
    rng = random.Random(5)
    targets = [rng.choice([0.0, 1.0, 5.0, 7.5, 100.0]) * rng.random() for _ in range(17)]
    total = sum(targets)
    rows = [(k + 1, t * 4000 / total, 4000) for k, t in enumerate(targets)]
    got = {r.sid: r.quotas for r in mixing.sainte_lague(spark.createDataFrame(rows, "sid int, target double, total long"), 5, 10).collect()}
    for shard in range(5):
        assert [got[k + 1][shard] for k in range(17)] == apportion([r[1] for r in rows], 400 * (shard + 1) // 5)


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(0, 90), rng.choice(["a", "b", "c", None, "a", "a"])) for k in range(300)]
    rows += [(300, None, "z"), (301, "", "z"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (None, "x y", "a"), (302, "one", "tiny")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    docs, quotas = mixing.mix_sources(frame)
    got = docs.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:  # reshare until no target is above its limit
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        free -= over
        left -= sum(3 * sizes[s] for s in over)
    target = {s: weight[s] * level if s in free else 3.0 * sizes[s] for s in names}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= 32 for s in names)
    again = mixing.mix_sources(frame.repartition(3))[0].collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert quotas.count() == len(names)
    assert mixing.mix_sources(frame.limit(0))[0].count() == 0
    assert [r.taken for r in mixing.mix_sources(frame.where("doc_id IN (300, 301)"))[0].collect()] == [0, 0]


def test_perfect_hash():
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for n in (0, 1, 2, 3000):
        words = perfect_hash.digest_words(digests[:n])
        levels = perfect_hash.build(words)
        assert sorted(perfect_hash.slots(levels, words).tolist()) == list(range(n))
        blob, sizes = perfect_hash.pack(levels)
        assert all((x == y).all() for x, y in zip(levels, perfect_hash.unpack(blob, sizes)))


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", 4)
    rows = [(5, "a b"), (3, "a  b"), (9, "ab"), (9, "ab"), (4, "a\u00a0b"), (7, None), (2, " \t"), (None, "zz"), (None, "yy"), (8, "yy"), *((100 + k, f"t{k % 20}" + " " * (k % 3)) for k in range(60))]
    frame = spark.createDataFrame(rows, DOCS)
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for d, t in rows:
        groups.setdefault(strip(t), []).append((-len(t or ""), d is None, d or 0))
    want = []
    for d, t in rows:
        best = min(groups[strip(t)])
        want.append((d, None if best[1] else best[2], len(groups[strip(t)]), best == (-len(t or ""), d is None, d or 0), hashlib.sha256(strip(t).encode()).hexdigest()))
    got = exact_dedup.dedup_exact(frame).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str) == sorted(want, key=str)
    assert {r.known for r in got} == {True, False}  # the middle of the ids parts the history from the rest
    for split in (F.lit(True), F.lit(False), F.lit(None).cast("boolean"), F.col("doc_id") % 2 == 0):
        again = exact_dedup.dedup_exact(frame.withColumn("row", F.lit(1)), split).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in again], key=str) == sorted(want, key=str)
    past = spark.createDataFrame([(1, "ab"), (2, "new"), (0, "n e w")], DOCS)
    new = exact_dedup.unknown_texts(frame, past).collect()
    assert sorted(str((r.doc_id, r.text_sha256)) for r in new) == sorted(str((d, hashlib.sha256(strip(t).encode()).hexdigest())) for d, t in rows if strip(t) != "ab")
    assert sum(r.kept for r in new) == len({strip(t) for _, t in rows}) - 1
    assert exact_dedup.dedup_exact(frame.limit(0)).count() == 0
    twins = [(None, "same")] * 40 + [(None, "x" * 4)] * 3
    monkeypatch.setattr(exact_dedup.look_up, "__defaults__", (4, False))
    assert [r.group_size for r in exact_dedup.dedup_exact(spark.createDataFrame(twins, DOCS)).collect()].count(40) == 40


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        (None, " "), ("  ", " "), ("You IDIOT!", " you idiot "), ("1d10t", " idiot "), ("\u0456di\u043et", " idiot "), ("i-d-i-o-t", " idiot "), ("ｉdiot", " idiot "),
        ("in 2024, x", " in 2024 x "), ("$tup1d.", " stupid "), ("été", " été "), ("mo\u200bron", " moron "),
    ],
)
def test_folding(text, folded):
    assert toxicity.fold_text(text) == folded


def test_lexicon_counts_words_once_and_spares_exceptions():
    model = toxicity.ToxicModel({"clown": 2.0, "mor*": 1.0, "moron": 3.0})
    assert model.measure("a CLOWN, a moron and morals") == (6.0, 3, 6)
    assert model.measure("clown fish") == (0, 0, 2)
    assert model.measure("clowns unmoron") == (0, 0, 2)
    assert model.measure(None) == (0, 0, 0)
    assert 0 <= model.score(0, 0, 0) < model.score(6, 3, 6) <= 1


def test_toxicity_learns(spark):
    rng = random.Random(8)
    plain = ["and", "the", "house", "garden", "river", "morning", "paper", "clock"]
    bad = ["vilewort", "grimbold", "nastrous"]
    rows, labels = [], []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 60))]
        if k % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), "s"))
        if k < 300:
            labels.append((k, int(k % 4 == 0)))
    rows += [(900, None, "s"), (901, "", "s"), (902, "V1LEWORT and gr!mbold", "s"), (None, "the house", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (4, 1)], "doc_id long, toxic int")
    kept = {r.doc_id for r in toxicity.drop_toxic(frame, known).collect()}
    assert kept == {k for k in range(400) if k % 4} | {900, 901, None}
    assert toxicity.drop_toxic(frame, known).columns == frame.columns
    model = toxicity.learn(frame.select("doc_id", "text"), known.limit(0))
    assert model.units == dict.fromkeys(toxicity.SEED_WORDS, 3.0)
    assert toxicity.score_texts(frame.limit(0), model, "_").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    got = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(got) <= docs.count() and all(0 < r.mix_taken <= 3 * r.mix_size for r in got)
    assert got[0].asDict().keys() > set(columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == columns

"""Hidden Markov language model over all documents.

Words are counted over all training texts.  The commonest words of a bounded
number are symbols of their own, other words fall into a fixed number of classes
by their last bytes; a class word's probability is its class's times its share
of the class.  Baum-Welch counts are summed over partitions, by blocks of
symbols, and the scaled forward recursion gives each whole text's likelihood.
Counts of words beyond the bounded head are never held by one task: such words
meet their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ascii_words, ship, shipped, stash

#: Words whose counts every task holds, at most; the commonest of them are symbols of their own.
HEAD_WORDS, SYMBOL_WORDS = 200_000, 16_000
CLASSES = 64
STATES = 8
#: Rounds of Baum-Welch over all training texts, at most, and the relative gain in log likelihood under which they end;
#: rounds over a bounded sample of segments of texts of all lengths settle the start.
ROUNDS, SETTLED, START_ROUNDS, START_TOKENS = 5, 0.002, 12, 400_000
#: Training goes through texts in segments of this many tokens; the recursions run in from and out to so many tokens
#: beyond each cut, whose own counts belong to the neighbours.  Scoring never cuts.
SEGMENT, CONTEXT = 256, 32
_BLOCK = 1024
_FLUSH = 250_000
_CHUNK = 400_000
_SMOOTH = 0.05


@dataclass
class Vocabulary:
    """counts: the head; symbol: its commonest; tail_n, tail_v: tokens and words of each class beyond the symbols."""

    tokens: int
    words: int
    ends: int
    counts: dict[bytes, int]
    symbol: dict[bytes, int]
    class_tokens: list[int]
    class_words: list[int]

    @property
    def symbols(self) -> int:
        """Symbol words, then classes, then the end."""
        return len(self.symbol) + CLASSES + 1


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _class_column(word: Column) -> Column:
    held = word.cast("binary")
    return (F.crc32(F.substring(held, F.greatest(F.lit(1), F.octet_length(held) - 2), F.lit(3))) % CLASSES).cast("int")


def count_words(texts: DataFrame) -> DataFrame:
    """text -> (word, c): all words of all rows, counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                seen.update(ascii_words(text.as_py()))
                if len(seen) > _FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return texts.select(F.col("text").cast("string")).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, ends: int, head_words: int = HEAD_WORDS, symbol_words: int = SYMBOL_WORDS) -> Vocabulary:
    """The head: all words from the count on at which no more than head_words are left.

    If more words than that share the highest counts, those of them with the least hashes.
    """
    levels = counts.groupBy(F.floor(F.log2("c") * 16).alias("level")).agg(F.count(F.lit(1)).alias("words"), F.sum("c").alias("tokens")).collect()
    least, n = math.inf, 0
    for r in sorted(levels, key=lambda r: -r.level):
        if (n := n + r.words) > head_words:
            break
        least = r.level
    chosen = F.floor(F.log2("c") * 16) >= least if least < math.inf else F.lit(False)
    if least == math.inf and levels:
        top = max(levels, key=lambda r: r.level)
        chosen = (F.floor(F.log2("c") * 16) == top.level) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(0.95 * head_words / top.words * (1 << 20)))
    head = counts.where(chosen).collect()  # about head_words words at most
    head = sorted(((r.word.encode(), r.c) for r in head), key=lambda x: (-x[1], x[0]))
    symbol = {w: k for k, (w, _) in enumerate(head[:symbol_words])}
    by_class = counts.groupBy(_class_column(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    tokens, words = [0] * CLASSES, [0] * CLASSES
    for r in by_class:
        tokens[r.k], words[r.k] = r.c, r.v
    for w, c in head[:symbol_words]:
        tokens[word_class(w)] -= c
        words[word_class(w)] -= 1
    total = sum(r.tokens for r in levels)
    return Vocabulary(total + ends, sum(r.words for r in levels) + (ends > 0), ends, dict(head), symbol, tokens, words)


def encode(docs: DataFrame, vocab: Vocabulary, carry: list[str]) -> DataFrame:
    """carry + text -> carry + symbols (uint16s, the end last), n_tokens, n_head, base_head, class_head, tail.

    base_head: sum of log10(c + 0.5) over the head words and the end; class_head:
    log10 shares of class words in the head; tail: the other words, space-joined.
    """
    held = ship(docs.sparkSession, vocab)
    cols = ["symbols", "n_tokens", "n_head", "base_head", "class_head", "tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shipped(held)
        first = len(v.symbol)
        table = {}
        for w, c in v.counts.items():
            if w in v.symbol:
                table[w] = (v.symbol[w], math.log10(c + 0.5), 0.0)
            else:
                k = word_class(w)
                table[w] = (first + k, math.log10(c + 0.5), math.log10((c + 0.5) / (v.class_tokens[k] + 0.5 * (v.class_words[k] + 1))))
        end, end_base, get = v.symbols - 1, math.log10(v.ends + 0.5), table.get
        for b in batches:
            out: list[list] = [[] for _ in cols]
            for text in b.column(b.schema.get_field_index("text")).cast(pa.binary()):
                words = ascii_words(text.as_py())
                got = [get(w) for w in words]
                if None in got:
                    tail = [w for w, g in zip(words, got) if g is None]
                    symbols = [first + word_class(w) if g is None else g[0] for w, g in zip(words, got)]
                    got = [g for g in got if g is not None]
                else:
                    tail, symbols = [], [g[0] for g in got]
                row = (np.array([*symbols, end], "<u2").tobytes(), len(words) + 1, len(got) + (v.ends > 0), sum([g[1] for g in got]) + end_base, sum([g[2] for g in got]), b" ".join(tail).decode())
                for o, x in zip(out, row):
                    o.append(x)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            kept = [b.schema.get_field_index(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *(pa.array(o, t) for o, t in zip(out, types))], [*carry, *cols])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return docs.select(*carry, F.col("text").cast("string")).mapInArrow(run, f"{kept}, symbols binary, n_tokens long, n_head long, base_head double, class_head double, tail string")


@dataclass
class Hmm:
    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray  # symbols x states


@dataclass
class Segments:
    """Sequences in order of length, longest first: symbols by time and sequence, padded with -1.

    first: whether a sequence starts its text; those that count are the places from own_from up to own_to.
    """

    x: np.ndarray
    first: np.ndarray
    own_from: np.ndarray
    own_to: np.ndarray


def segments(blobs: Iterator[bytes]) -> Iterator[Segments]:
    """Texts as segments with context, in matrices of about _CHUNK tokens."""
    rows, size = [], 0
    for blob in blobs:
        x = np.frombuffer(blob, "<u2").astype(np.int32)
        for at in range(0, len(x), SEGMENT):
            low, end = max(0, at - CONTEXT), min(len(x), at + SEGMENT)
            rows.append((x[low : end + CONTEXT], low == 0, at - low, end - low))
            size += len(rows[-1][0])
            if size >= _CHUNK:
                yield _matrix(rows)
                rows, size = [], 0
    if rows:
        yield _matrix(rows)


def _matrix(rows: list[tuple[np.ndarray, bool, int, int]]) -> Segments:
    rows = sorted(rows, key=lambda r: -len(r[0]))
    out = np.full((len(rows[0][0]), len(rows)), -1, np.int32)
    for k, r in enumerate(rows):
        out[: len(r[0]), k] = r[0]
    return Segments(out, *(np.array([r[k] for r in rows]) for k in (1, 2, 3)))


def expected_counts(model: Hmm, given: Segments, start: np.ndarray, moves: np.ndarray, emit: np.ndarray) -> float:
    """Forward-backward over segments; adds what their own places give to the counts, returns those places' log likelihood."""
    x = given.x
    steps, k = len(x), model.moves.shape[0]
    live = (x >= 0).sum(1)
    alpha, scale, seen, owns = [], [], [], []
    a = None
    total = 0.0
    flat = np.full(k, 1 / k, model.start.dtype)
    for t in range(steps):
        e = model.emit[x[t, : live[t]]]
        a = np.where(given.first[:, None], model.start, flat) * e if a is None else (a[: live[t]] @ model.moves) * e
        s = a.sum(1, keepdims=True)
        a = a / s
        own = ((given.own_from[: live[t]] <= t) & (t < given.own_to[: live[t]])).astype(model.emit.dtype)[:, None]
        total += float((np.log(s) * own).sum())
        alpha.append(a)
        scale.append(s)
        seen.append(e)
        owns.append(own)
    beta, gammas = np.ones((live[-1], k), model.emit.dtype), []
    for t in range(steps - 1, -1, -1):
        gamma = alpha[t] * beta
        gamma /= gamma.sum(1, keepdims=True)
        gammas.append(gamma * owns[t])
        if t == 0:
            start += gamma[given.first].sum(0)
            break
        eb = seen[t] * beta / scale[t]
        moves += model.moves * (alpha[t - 1][: live[t]].T @ (eb * owns[t]))
        beta = np.ones((live[t - 1], k), model.emit.dtype)
        beta[: live[t]] = eb @ model.moves.T
    symbols, gamma = np.concatenate([x[t, : live[t]] for t in range(steps - 1, -1, -1)]), np.concatenate(gammas)
    for j in range(k):
        emit[:, j] += np.bincount(symbols, gamma[:, j], len(emit))
    return total


def normalised(start: np.ndarray, moves: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Hmm:
    """Probabilities from counts, smoothed towards a flat start and move and the corpus shares of symbols."""
    emit = emit + _SMOOTH * len(emit) * share[:, None]
    return Hmm(*(np.ascontiguousarray(p, np.float32) for p in ((start + 1) / (start + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emit / emit.sum(0))))


def _add(blobs: Iterator[bytes], model: Hmm, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    k = len(model.start)
    start, moves, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k)), 0.0
    for x in segments(blobs):
        total += expected_counts(model, x, start, moves, emit)
    return start, moves, emit, total


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS, seed: int = 7) -> Hmm:
    """Baum-Welch on the symbols of encoded's rows.

    The start is settled on a bounded sample of segments; then each round sums
    the expected counts of all partitions, by symbol blocks, in the executors,
    until the likelihood settles.
    """
    spark, symbols = encoded.sparkSession, vocab.symbols
    share = np.full(symbols, 0.5)
    for w, k in vocab.symbol.items():
        share[k] += vocab.counts[w]
    share[len(vocab.symbol) : -1] += vocab.class_tokens
    share[-1] += vocab.ends
    share /= share.sum()
    rng = np.random.default_rng(seed)
    emit = share[:, None] * rng.uniform(0.2, 1.8, (symbols, states))
    sticky = np.full((states, states), 0.02) + np.eye(states) * (1 - 0.02 * states)
    model = Hmm(np.full(states, 1 / states, np.float32), sticky.astype(np.float32), (emit / emit.sum(0)).astype(np.float32))
    # one segment of each sampled text, whatever its length
    cuts = F.ceil(F.col("n_tokens") / SEGMENT)
    cut = F.pmod(F.xxhash64("symbols", F.lit(seed)), cuts)
    drawn = encoded.select(F.substring("symbols", (cut * 2 * SEGMENT + 1).cast("int"), F.lit(2 * SEGMENT)).alias("symbols"), F.xxhash64("symbols").alias("place"))
    drawn = drawn.orderBy("place", "symbols").limit(START_TOKENS // SEGMENT)
    sample = [bytes(r.symbols) for r in drawn.collect()]
    for _ in range(START_ROUNDS if sample else 0):
        start, moves, counts, _ = _add(iter(sample), model, symbols)
        model = normalised(start, moves, counts, share)
    last = -math.inf
    for _ in range(rounds):
        held = ship(spark, model)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            start, moves, counts, total = _add((t.as_py() for b in batches for t in b.column(0)), shipped(held), symbols)
            parts = [(-1, np.vstack([start, moves, np.full(states, total)]).astype("<f4").tobytes())]
            parts += [(at // _BLOCK, counts[at : at + _BLOCK].astype("<f4").tobytes()) for at in range(0, symbols, _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["block", "counts"])

        def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in tables:
                for blob in b.column(b.schema.get_field_index("counts")):
                    x = np.frombuffer(blob.as_py(), "<f4").astype("<f8")
                    total = x if total is None else total + x
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])

        # one row of a fixed size per partition and block; the sums that reach the driver are one model's size
        sums = encoded.select("symbols").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
        got = {r.block: np.frombuffer(r.counts, "<f8").reshape(-1, states) for r in sums}
        if -1 not in got:
            break
        emit = np.vstack([got[k] for k in sorted(got) if k >= 0])
        model = normalised(got[-1][0], got[-1][1:-1], emit, share)
        if got[-1][-1, 0] - last < SETTLED * abs(got[-1][-1, 0]):
            break
        last = got[-1][-1, 0]
    return model


def forward(model: Hmm, texts: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each whole symbol sequence, by the scaled forward recursion; all have an end."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order])
    x = np.concatenate([texts[k] for k in order]) if order else np.zeros(0, np.int32)
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if order else np.zeros(0, np.int64)
    out, a = np.zeros(len(order)), None
    moves, start, emit = (m.astype(np.float32) for m in (model.moves, model.start, model.emit))
    for t in range(lengths[0] if order else 0):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        e = emit[x[at[:live] + t]]
        a = start * e if a is None else (a[:live] @ moves) * e
        s = a.sum(1, keepdims=True)
        a = a / s
        out[:live] += np.log10(s[:, 0], dtype=np.float64)
    result = np.empty(len(order))
    result[order] = out
    return result


def score(encoded: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Hmm) -> DataFrame:
    """encoded (doc_id, held_out, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words beyond the head meet their counts in a join on the word; any one of
    them holds less than a head_words-th of all tokens, so no key is hot.
    """
    held = ship(encoded.sparkSession, model)
    v, n = vocab, vocab.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped(held)
        for b in batches:
            k = b.schema.get_field_index("symbols")
            got = forward(m, [np.frombuffer(t.as_py(), "<u2").astype(np.int32) for t in b.column(k)])
            keep = [j for j in range(b.num_columns) if j != k]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in keep), pa.array(got, pa.float64())], [*(b.schema.names[j] for j in keep), "chain"])

    scored = encoded.drop("tail").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, class_head double, chain double")
    tails = encoded.where("tail <> ''").select("row", F.explode(F.split("tail", " ")).alias("word"))
    found = tails.join(counts.withColumnRenamed("word", "known"), F.col("word") == F.col("known"), "left")
    c = F.coalesce(F.col("c"), F.lit(0)) + 0.5
    classes = F.array(*[F.lit(t + 0.5 * (w + 1)) for t, w in zip(v.class_tokens, v.class_words)])
    sums = found.groupBy("row").agg(
        F.count("c").alias("n_tail"), F.sum(F.log10(c)).alias("base_tail"), F.sum(F.log10(c / F.element_at(classes, _class_column(F.col("word")) + 1))).alias("class_tail")
    )
    none = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_head") + none("base_tail") - F.col("n_tokens") * math.log10(n + 0.5 * (v.words + 1))).alias("base_score"),
        (F.col("chain") + F.col("class_head") + none("class_tail")).alias("score"),
    )


def score_documents(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Trains on the rows of docs (doc_id, text) that aren't held out and scores all, one row per input row.

    Null and empty texts are the end alone.  Repeated rows count and train as
    often as they come.  Nothing to train on: the base is uniform over one
    unknown word, and the chain stays at its start.  Empty table: no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    training = given.where("NOT held_out")
    counts = stash(count_words(training), "word-counts")
    vocab = vocabulary(counts, training.count())
    encoded = stash(encode(given, vocab, ["doc_id", "held_out"]).withColumn("row", F.monotonically_increasing_id()), "encoded")
    encoded = encoded.select("row", "doc_id", "held_out", "symbols", "n_tokens", "n_head", "base_head", "class_head", "tail")
    model = train(encoded.where("NOT held_out"), vocab, states, rounds)
    return score(encoded, counts, vocab, model)

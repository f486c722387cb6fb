"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

The lexicon is whole words and word beginnings whose document rates differ most
between toxic and clean labelled rows.  Texts are folded (case, look-alike
letters, digits for letters, letters spelled apart) before learning and
matching alike.  A word counts its heaviest match once, exception phrases and
words cancel the matches inside them, and the score is a logistic function of
the sum and of the sum by length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ship, shipped, stash

#: Labelled documents that the lexicon and the score are fitted on, at most: those with the smallest id hashes.
SAMPLE_ROWS = 30_000
#: Units of the lexicon, at most: those of the largest weights.  Four times as many are candidates, as a part's model may rank them otherwise.
LEXICON_UNITS = 3000
#: Toxic documents a unit must occur in, and the least log ratio of its document rates.
LEAST_DOCS, LEAST_WEIGHT = 4, 3.0
_PREFIXES = (4, 5, 6, 7)
#: Parts of the sample; each is scored with what the others taught, so that the score's fit isn't flattered.
_PARTS = 5
_COUNTS = [f"{y}_{k}" for k in range(_PARTS) for y in ("clean", "toxic")]
_FLUSH = 60_000

# Look-alike letters (Cyrillic, Greek, full width by rule), signs and digits used for letters,
# and phrases in which a listed word is meant otherwise.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "ο": "o", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "η": "n", "ⅼ": "l", "ⅰ": "i",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "trash bag", "pond scum", "sore loser", "the clown around", "circus clown", "loser bracket")
#: Used where there are no labels to learn from.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting")

_FOLD = {ord(k): v for k, v in _LOOKALIKES.items()}
_FOLD |= {0xFF01 + k: chr(0x21 + k) for k in range(94)} | {0x1D41A + k: chr(97 + k) for k in range(26)}
_FOLD |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], None)
_FOREIGN = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")
_MIXED = re.compile(r"[0-9@$!|]")
_LETTER = re.compile(r"[^\W\d_]")
_APART = re.compile(r"(?<!\w)(?:\w[-_.*]){2,}\w(?!\w)")
_UNDIGIT = str.maketrans(_DIGITS)
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _undo(token: str) -> str:
    core = token.rstrip("!|.,;:?\"')")
    return core.translate(_UNDIGIT) + " " if _LETTER.search(core) else token


def fold_text(text: str | None) -> str:
    """Folded words with one space before, between and after them; no words: one space."""
    t = (text or "").lower()
    if not t.isascii() and _FOREIGN.search(t):
        t = t.translate(_FOLD).lower()
    if _MIXED.search(t):
        t = " ".join([_undo(w) if _MIXED.search(w) else w for w in t.split()])
    if _APART.search(t):
        t = _APART.sub(lambda m: re.sub(r"[-_.*]", "", m[0]), t)
    words = t.encode("utf-8", "replace").translate(_WORDS).split()
    return f" {b' '.join(words).decode('utf-8', 'replace')} " if words else " "


@dataclass
class ToxicModel:
    """units: word -> weight, beginning* -> weight; clear: words and phrases that cancel matches; beta: bias, sum, density, hits."""

    units: dict[str, float] = field(default_factory=dict)
    clear: tuple[str, ...] = EXCEPTIONS
    beta: tuple[float, ...] = (-4.0, 1.0, 4.0, 1.0)
    _automaton: object = None

    def automaton(self) -> object:
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for unit, weight in self.units.items():
                pattern = f" {unit[:-1]}" if unit.endswith("*") else f" {unit} "
                a.add_word(pattern, (len(pattern), weight))
            for phrase in self.clear:
                a.add_word(f" {phrase} ", (len(phrase) + 2, -1.0))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """(sum of weights, words hit, words) of a text."""
        return self.measure_folded(fold_text(text))

    def measure_folded(self, folded: str) -> tuple[float, int, int]:
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        a = self.automaton()
        for end, (length, weight) in a.iter(folded) if len(a) else ():
            start = end - length + 1
            if weight < 0:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        if spared:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}
        return sum(hits.values()), len(hits), folded.count(" ") - 1 if len(folded) > 1 else 0

    def score(self, total: float, hits: int, words: int) -> float:
        z = sum(b * x for b, x in zip(self.beta, _inputs(total, hits, words)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _inputs(total: float, hits: int, words: int) -> tuple[float, ...]:
    return 1.0, math.log1p(total), total / (words + 20.0), math.log1p(hits)


def _units(folded: str) -> set[str]:
    words = set(folded.split())
    return words | {w[:k] + "*" for w in words for k in _PREFIXES if len(w) > k}


def _weight(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))


def learn(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """docs (doc_id, text), labelled (doc_id, toxic); rows with null id or label are left out, of repeated ids the highest counts.

    The sample of labelled ids is bounded; units are counted over it by partial
    aggregation and filtered before the best are taken.  No labels, or of one
    kind: SEED_WORDS with equal weights.  Ties of weight go by code points.
    """
    spark = docs.sparkSession
    labelled = labelled.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    rows = labelled.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    # sample_rows rows at most
    sample = spark.createDataFrame([(r.id, int(r.toxic > 0), k % _PARTS) for k, r in enumerate(rows)], "id long, y int, part int")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fold_text(t.as_py()) for t in b.column(2)], pa.string())], ["y", "part", "folded"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array([v[k] for v in seen.values()], pa.int64()) for k in range(len(_COUNTS))]
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *columns], ["unit", *_COUNTS])
            seen.clear()
            return out

        for b in batches:
            for y, part, folded in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for unit in {"", *_units(folded.as_py())}:
                    seen.setdefault(unit, [0] * len(_COUNTS))[y + 2 * part] += 1
                if len(seen) > _FLUSH:
                    yield flush()
        if seen:
            yield flush()

    folded = stash(given.select("y", "part", "text").mapInArrow(fold, "y int, part int, folded string"), "toxic-sample", 1000)
    counts = folded.mapInArrow(count, "unit string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("unit").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    counts = stash(counts, "toxic-units")
    whole = counts.where("unit = ''").first()
    if whole is None or not all(sum(whole[c] for c in _COUNTS[y::2]) for y in (0, 1)):
        return ToxicModel(dict.fromkeys(SEED_WORDS, 3.0))
    weights = []
    for out in (None, *range(_PARTS)):
        kept = [[c for k, c in enumerate(_COUNTS[y::2]) if k != out] for y in (0, 1)]
        n = [sum(whole[c] for c in own) for own in kept]
        clean, toxic = (sum((F.col(c) for c in own), F.lit(0)) for own in kept)
        weights.append(_weight(toxic, clean, n[1], n[0]))
    toxic = sum((F.col(c) for c in _COUNTS[1::2]), F.lit(0))
    top = counts.where((F.col("unit") != "") & (toxic >= LEAST_DOCS) & (F.greatest(*weights) >= LEAST_WEIGHT))
    top = top.orderBy(F.desc(weights[0]), "unit").limit(4 * LEXICON_UNITS).collect()
    without = lambda rows, part: [(r.unit, *(sum(r[f"{y}_{k}"] for k in range(_PARTS) if k != part) for y in ("clean", "toxic"))) for r in rows]
    totals = [without([whole], part)[0][1:] for part in (None, *range(_PARTS))]
    units = [_lexicon(without(top, part), *totals[k]) for k, part in enumerate((None, *range(_PARTS)))]
    starts = sorted({u[:-1] for own in units for u in own if u.endswith("*")})
    under = F.lit(False)
    for k in _PREFIXES:
        if own := [u for u in starts if len(u) == k]:
            under |= F.substring("unit", 1, k).isin(own)
    # clean words under a listed beginning: of the sample's words, so bounded as it is
    clean = counts.where(~F.col("unit").endswith("*") & under & (F.least(*weights) < 0)).collect() if starts else []
    models = [ToxicModel(own, EXCEPTIONS + _spared(own, without(clean, part), *totals[k])) for k, (own, part) in enumerate(zip(units, (None, *range(_PARTS))))]
    model, others = models[0], ship(spark, models[1:])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped(others)
        for b in batches:
            out = [(y, *own[part].measure_folded(t.as_py())) for y, part, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["y", "total", "hits", "words"])

    # as many rows as the sample has ids (repeated rows count once more)
    got = folded.mapInArrow(measure, "y long, total double, hits long, words long").groupBy("y", "total", "hits", "words").agg(F.count(F.lit(1)).alias("n")).collect()
    got.sort()
    model.beta = _logistic([(_inputs(r.total, r.hits, r.words), r.y, r.n) for r in got])
    return model


def _log_ratio(clean: int, toxic: int, n_clean: int, n_toxic: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _lexicon(counts: list[tuple[str, int, int]], n_clean: int, n_toxic: int) -> dict[str, float]:
    """Weights of the units from (unit, clean, toxic documents)."""
    docs = {u: t for u, _, t in counts}
    units = {u: w for u, c, t in counts if t >= LEAST_DOCS and (w := _log_ratio(c, t, n_clean, n_toxic)) >= LEAST_WEIGHT}
    for u, _, t in counts:  # a beginning that one word accounts for says no more than the word
        for k in _PREFIXES if u in units and not u.endswith("*") else ():
            if t >= 0.8 * docs.get(f"{u[:k]}*", math.inf):
                units.pop(f"{u[:k]}*", None)
    return dict(sorted(units.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_UNITS])


def _spared(units: dict[str, float], counts: list[tuple[str, int, int]], n_clean: int, n_toxic: int) -> tuple[str, ...]:
    """Words that are commoner in clean documents although they begin as a listed beginning."""
    starts = tuple(u[:-1] for u in units if u.endswith("*"))
    return tuple(sorted(u for u, c, t in counts if starts and u.startswith(starts) and u not in units and _log_ratio(c, t, n_clean, n_toxic) < 0))


def _logistic(rows: list[tuple[tuple[float, ...], int, int]], ridge: float = 0.5) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; slopes are not negative, so that more matches never lower a score."""
    x, y, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    size = x.shape[1]
    free, beta, hold = np.ones(size, bool), np.zeros(size), ridge * np.array([0.01] + [1.0] * (size - 1))
    for _ in range(size):
        beta = np.where(free, beta, 0.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (w * (y - p)) - hold * beta
            hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold)
            step = np.zeros(size)
            step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
            beta = beta + np.clip(step, -2, 2)
            if abs(step).max() < 1e-6:
                break
        if not (beta[1:] < 0).any():
            break
        free[1:] &= beta[1:] >= 0
    return tuple(float(b) for b in np.where([True, *(beta[1:] > 0)], beta, 0.0))


def score_texts(docs: DataFrame, model: ToxicModel, prefix: str = "") -> DataFrame:
    """All columns of docs and, named prefix + score, weight, hits: the score and what it came from; columns so named before are replaced.

    Null and empty texts have no matches; they score as the bias says.  Null ids
    and repeated rows are scored like any.  Empty table: no rows.
    """
    held = ship(docs.sparkSession, model)
    names = [f"{prefix}{c}" for c in ("score", "weight", "hits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped(held)
        for b in batches:
            got = [m.measure(t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
            new = [pa.array([m.score(*g) for g in got], pa.float64()), pa.array([t for t, _, _ in got], pa.float64()), pa.array([h for _, h, _ in got], pa.int32())]
            kept = [k for k, c in enumerate(b.schema.names) if c not in names]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *new], [*(b.schema.names[k] for k in kept), *names])

    schema = docs.select("*", F.lit(0.0).alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0).alias(names[2])).schema
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below threshold; labels (doc_id, toxic) are the ones to learn from."""
    scored = score_texts(docs, learn(docs.select("doc_id", "text"), labels), prefix="_tox_")
    return scored.where(F.col("_tox_score") < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])

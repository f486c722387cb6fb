"""URL filter: rules by host and path, and boosted trees on lexical features for the rest.

Suffix statistics are fitted out of fold: a training row sees those of other
hosts only, and each row is also shown once with an unknown suffix, so that the
trees can't read a rule back from the suffix that it labelled, and judge URLs of
suffixes nobody labelled by the rest of what they look like.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ship, shipped

#: Labelled URLs that the trees are fitted on, at most: those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: Suffix statistics are kept by this many hash buckets, whatever the number of suffixes, for each fold of hosts.
SUFFIX_BUCKETS, FOLDS = 1024, 5
_BINS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGITS = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[a-z]")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and its subdomains where the path starts with path; text is host + path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, else null; equal lengths: the first in code point order."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.text)).otherwise(out)
    return out


def suffixes(host: str) -> tuple[int, int]:
    """Buckets of the host's last label and of its last two."""
    labels = host.rsplit(".", 2)
    return zlib.crc32(labels[-1].encode()) % SUFFIX_BUCKETS, zlib.crc32(("2" + ".".join(labels[-2:])).encode()) % SUFFIX_BUCKETS


def host_fold(host: str) -> int:
    return zlib.crc32(("fold " + host).encode()) % FOLDS


def lexical(url: str, host: str, path: str) -> list[float]:
    """Length, depth, ratios, entropy and parameter counts."""
    low, n = url.lower(), max(1, len(url))
    counts = Counter(low)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    query = url.partition("?")[2].partition("#")[0]
    segments = [s for s in path.split("/") if s]
    return [
        len(url), len(host), len(path), len(segments), host.count(".") + 1, host.count("-"), len(_DIGITS.findall(low)) / n,
        len(_LETTERS.findall(low)) / n, entropy, query.count("&") + 1 if query else 0, len(query), float("#" in url),
        float(low.startswith("https:")), len(_DIGITS.findall(host)) / max(1, len(host)), max(map(len, segments), default=0),
    ]


_NONE = (np.zeros(FOLDS), np.zeros(FOLDS))


@dataclass
class UrlModel:
    """Complete binary trees over feature thresholds, and the suffix statistics that two features come from."""

    prior: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: (kind, bucket) -> blocked and all labelled rows by fold of the host
    counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    base: float = 0.5

    def suffix_features(self, host: str, without: int | None = None) -> list[float]:
        """Smoothed blocked share, and whether there is any label, of the last label and the last two; without: a fold left out."""
        out = []
        for kind, bucket in enumerate(suffixes(host), 1):
            blocked, n = (float(x.sum() - (0 if without is None else x[without])) for x in self.counts.get((kind, bucket), _NONE))
            out += [(blocked + 4 * self.base) / (n + 4), float(n > 0)]
        return out

    def features(self, urls: list[str], hosts: list[str], paths: list[str], folds: list[int] | None = None, known: bool = True) -> np.ndarray:
        """folds: the fold whose suffix counts each row doesn't see; not known: as if nobody had labelled its suffix."""
        rows, held = [], {}
        for k, (u, h, p) in enumerate(zip(urls, hosts, paths)):
            fold = None if folds is None else folds[k]
            if (suffix := held.get((h, fold))) is None:
                suffix = held[h, fold] = self.suffix_features(h, fold) if known else [self.base, 0.0] * 2
            rows.append([*lexical(u, h, p), *suffix])
        return np.array(rows, np.float64).reshape(len(urls), -1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(len(leaf).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-z))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> tuple[float, list]:
    """Logistic gradient boosting over binned features; returns the prior log odds and the trees."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    prior, trees = math.log(share / (1 - share)), []
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, _BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    z = np.full(len(y), prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        grad, hess = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            at = np.full(width, -1)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * (_BINS + 1) + binned[:, k]
                g, h = (np.bincount(cell, w, width * (_BINS + 1)).reshape(width, -1) for w in (grad, hess))
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = (gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge))[:, : len(e)]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                feature[first : first + width][better] = k
                threshold[first : first + width][better] = e[top][better]
                at[better] = top[better]
            split = np.where(at >= 0, at, _BINS + 1)
            where = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[where])
        leaf_of = node - (2**depth - 1)
        g, h = (np.bincount(leaf_of, w, 2**depth) for w in (grad, hess))
        leaf = rate * g / (h + ridge)
        trees.append((feature, threshold, leaf))
        z += leaf[leaf_of]
    return prior, trees


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """labelled (url, host, path, blocked boolean).  Suffix statistics take all rows, the trees a bounded sample.

    No rows, or labels of one kind: the model's score is the smoothed share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2, SUFFIX_BUCKETS, FOLDS), np.int64)
        for b in batches:
            for host, blocked in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for kind, bucket in enumerate(suffixes(host)):
                    n[int(blocked), kind, bucket, host_fold(host)] += 1
        kind, bucket, fold = np.nonzero(n.sum(0))
        values = (kind + 1, bucket, fold, n[1, kind, bucket, fold], n[:, kind, bucket, fold].sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["kind", "bucket", "fold", "blocked", "n"])

    counts = labelled.select("host", "blocked").mapInArrow(count, "kind long, bucket long, fold long, blocked long, n long")
    stats = counts.groupBy("kind", "bucket", "fold").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")).collect()  # 2 * SUFFIX_BUCKETS * FOLDS rows at most
    total = sum(r.n for r in stats if r.kind == 1)
    model = UrlModel(base=(sum(r.blocked for r in stats if r.kind == 1) + 0.5) / (total + 1))
    for r in stats:
        blocked, n = model.counts.setdefault((r.kind, r.bucket), (np.zeros(FOLDS), np.zeros(FOLDS)))
        blocked[r.fold], n[r.fold] = r.blocked, r.n
    rows = labelled.orderBy(F.xxhash64("url"), "url", "blocked").limit(sample_rows).collect()
    y = np.array([float(r.blocked) for r in rows])
    model.prior = math.log(model.base / (1 - model.base))
    if rows and 0 < y.mean() < 1:
        given = [[r[c] for r in rows] for c in ("url", "host", "path")]
        seen = model.features(*given, folds=[host_fold(r.host) for r in rows])
        model.prior, model.trees = boost(np.vstack([seen, model.features(*given, known=False)]), np.concatenate([y, y]))
    return model


def labelled_urls(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, url) -> page_id, url, host, path, rule, blocked: what the rules say; null blocked where none fits."""
    parts = urls.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
    ).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.lit(None).cast("boolean")
    for rule in rules:
        blocked = F.when(F.col("rule") == rule.text, F.lit(rule.verdict == "block")).otherwise(blocked)
    return parts.withColumn("blocked", blocked)


def scored_urls(parts: DataFrame, model: UrlModel) -> DataFrame:
    """parts with url, host, path and other columns -> without url, with score."""
    held = ship(parts.sparkSession, model)
    names = [c for c in parts.columns if c != "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped(held)
        for b in batches:
            u, h, p = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("url", "host", "path"))
            score = m.score(m.features(u, h, p)) if u else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(score, pa.float64())], [*names, "score"])

    return parts.mapInArrow(run, parts.drop("url").withColumn("score", F.lit(0.0)).schema)


def held_out_accuracy(urls: DataFrame, rules: list[Rule], fold: int = 0, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> tuple[float, float, int]:
    """(share judged as the rules do, share of the commoner label, rows) of the labelled URLs whose hosts are of one fold, by a model fitted on the others."""
    parts = labelled_urls(urls, rules).where("blocked IS NOT NULL")
    of_fold = F.crc32(F.concat(F.lit("fold "), F.col("host"))) % FOLDS == fold
    model = fit(parts.where(~of_fold), sample_rows)
    row = scored_urls(parts.where(of_fold), model).agg(
        F.avg(((F.col("score") >= threshold) == F.col("blocked")).cast("double")), F.avg(F.col("blocked").cast("double")), F.count(F.lit(1))
    ).first()
    return (row[0] or 0.0, max(row[1] or 0.0, 1 - (row[1] or 0.0)), row[2])


def judge(urls: DataFrame, rules: list[Rule], threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, score; one row per input row.

    URLs that a rule fits are the labelled ones: the rule's verdict stands, and
    the trees learn from it to judge the others, block at scores from threshold
    on.  score is the model's for every row.  Null url, or one without ://: host
    and path empty, no rule, judged as an empty URL.  Repeated rows are judged
    alike and count as often as they come.  Null page_id stays null.  No rule
    fits any row: all scores are one half, all others block at the default
    threshold.  Empty table: no rows.
    """
    parts = labelled_urls(urls, rules)
    scored = scored_urls(parts, fit(parts.where("blocked IS NOT NULL"), sample_rows))
    verdict = F.when(F.coalesce(F.col("blocked"), F.col("score") >= threshold), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

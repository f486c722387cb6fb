"""Line dedup: a segment-partition edit join over the lines of all documents.

Two lines link if as few edits part them as the shorter one's length allows: one
for each POINTS_PER_EDIT code points, THRESHOLD at most, so very short lines
link only if equal.  A line cut into one segment more than that keeps at least
one of them, shifted by little, in any line within the limit.  Segments are
keyed by the line's length, their number and their text, so a probe knows from
the two lengths which substrings can match which segment.  Lines are known by
128-bit hashes until some key has two; only then does text move, and pairs are
verified by banded bit-parallel edit distance.  A pair counts under its first
common segment alone, tasks report a link count for each line and links that
join their groups, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.edit_distance import within
from tessera.llm.graph import components
from tessera.llm.repeats import _held, held_all, key_filter, text_key
from tessera.llm.shared import ship, shipped, stash

#: Edits that may part linked lines, at most, and the code points of the shorter line that allow one edit each.
THRESHOLD, POINTS_PER_EDIT = 2, 10
#: Lines of one key, and their code points, that one part holds; more are cut into parts that meet in pairs.
GROUP_ROWS, GROUP_POINTS = 4096, 16 << 20
#: Code points whose keys are made at once; lines beyond _LONG points are keyed one by one.
_CHUNK, _LONG = 1 << 19, 1 << 16
_BATCH, _TEXTS = 20_000, 1000
_HALF = 1 << 63
_BASE, _MIX, _SALT = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_BINS = 16


def allowed(length: int, threshold: int = THRESHOLD) -> int:
    """Edits by which another line at least as long may differ from one of that many code points."""
    return min(threshold, length // POINTS_PER_EDIT)


def line_text(line: str, least: int = 1) -> str | None:
    """What is compared of a line: without white space at its ends; None if fewer than least points, or none, are left."""
    line = line.strip()
    return line if line and len(line) >= least else None


def line_hash(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def segment_places(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of a line of that length; sizes differ by one at most, the last are the larger."""
    parts = edits + 1
    small = length // parts
    sizes = [small + (k >= parts - length % parts) for k in range(parts)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(parts)]


def probe_starts(length: int, more: int, segment: int, edits: int) -> range:
    """Where a line that is `more` longer can hold the segment of a line of the given length, if so few edits part the lines.

    Before the match at most `segment` edits can lie, else an earlier segment
    matches too; the like holds behind it.
    """
    start, _ = segment_places(length, edits)[segment]
    behind = edits - segment
    return range(max(start - segment, start + more - behind, 0), min(start + segment, start + more + behind) + 1)


def segment_cuts(length: int, threshold: int, probes: bool) -> list[tuple[int, int, int, int]]:
    """(start, end, length of the indexed line, segment number) of a line's own segments, or of the substrings it probes with.

    Probes are for segments of shorter lines and, shifted, of equally long ones.
    """
    out = []
    for more in range(threshold + 1 if probes else 1):
        edits = allowed(length - more, threshold) if length >= more else 0
        if not edits or more > edits:
            continue
        for k, (s, z) in enumerate(segment_places(length - more, edits)):
            starts = probe_starts(length - more, more, k, edits) if probes else [s]
            out += [(at, at + z, length - more, k) for at in starts if at + z <= length and (more or not probes or at != s)]
    return out


class SegmentKeys:
    """Keys of many lines' segments or probes at once.

    Substring hashes are differences of prefix sums; a segment's key also holds
    its line's length and its number.  Built in the task that uses it.
    """

    def __init__(self, threshold: int, probes: bool) -> None:
        self.threshold, self.probes = threshold, probes
        self.cuts: dict[int, np.ndarray] = {}
        self.power = self.inverse = np.ones(1, np.uint64)

    def _of_length(self, length: int) -> np.ndarray:
        if (held := self.cuts.get(length)) is None:
            held = np.array(segment_cuts(length, self.threshold, self.probes), np.int64).reshape(-1, 4)
            if len(self.cuts) < 1 << 16:
                self.cuts[length] = held
        return held

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            powers = []
            for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(n, factor, np.uint64)
                p[0] = 1
                powers.append(np.multiply.accumulate(p))
            self.power, self.inverse = powers

    def of(self, lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(line numbers, keys, segment numbers), in bounded portions."""
        portion, size = [], 0
        for k, line in enumerate(lines):
            if len(line) > _LONG:
                yield self._long(k, line)
                continue
            portion.append(k)
            size += len(line)
            if size > _CHUNK:
                yield self._portion(portion, [lines[k] for k in portion])
                portion, size = [], 0
        if portion:
            yield self._portion(portion, [lines[k] for k in portion])

    def _seeded(self, hashes: np.ndarray, length: np.ndarray, number: np.ndarray) -> np.ndarray:
        h = hashes + (length * 16 + number).astype(np.uint64) * np.uint64(_SALT)
        h ^= h >> np.uint64(33)
        h *= np.uint64(_MIX)
        h ^= h >> np.uint64(29)
        h *= np.uint64(_SALT)
        return (h ^ h >> np.uint64(32)).view(np.int64)

    def _portion(self, numbers: list[int], lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lines])
        cuts = [self._of_length(n) for n in sizes.tolist()]
        counts = np.array([len(c) for c in cuts])
        cut = np.concatenate(cuts)
        at = np.repeat(np.cumsum(sizes) - sizes, counts)
        x = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self._powers(len(x) + 1)
        x += np.uint64(1)
        x *= np.uint64(_MIX)
        x ^= x >> np.uint64(31)
        x *= self.power[: len(x)]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=sums[1:])
        first, last = at + cut[:, 0], at + cut[:, 1]
        hashes = (sums[last] - sums[first]) * self.inverse[first]
        return np.repeat(np.array(numbers), counts), self._seeded(hashes, cut[:, 2], cut[:, 3]), cut[:, 3]

    def _long(self, number: int, line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines of nearly the same length may be keyed in a portion, so the hash is the same one, summed by pieces."""
        cut = self._of_length(len(line))
        hashes = np.zeros(len(cut), np.uint64)
        step = pow(_BASE, _LONG, 1 << 64)
        for j, (a, z) in enumerate(cut[:, :2].tolist()):
            factor = 1
            for b in range(a, z, _LONG):
                x = np.frombuffer(line[b : min(z, b + _LONG)].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                self._powers(_LONG + 1)
                x += np.uint64(1)
                x *= np.uint64(_MIX)
                x ^= x >> np.uint64(31)
                hashes[j] += (x * self.power[: len(x)]).sum(dtype=np.uint64) * np.uint64(factor)
                factor = factor * step % (1 << 64)
        return np.full(len(cut), number), self._seeded(hashes, cut[:, 2], cut[:, 3]), cut[:, 3]


def first_common(short: str, long_: str, edits: int) -> int | None:
    """The first segment of short that long_ holds where it can."""
    more = len(long_) - len(short)
    for k, (s, z) in enumerate(segment_places(len(short), edits)):
        piece = short[s : s + z]
        if any(long_[at : at + z] == piece for at in probe_starts(len(short), more, k, edits)):
            return k
    return None


def _own_columns(threshold: int) -> list[str]:
    return [f"own{k}" for k in range(threshold + 1)]


def line_rows(docs: DataFrame, least: int = 1, threshold: int = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key, line_no, line (hash; null for lines too short), points, own0 ... (keys of the line's segments, null where it has fewer)."""
    names = ["doc_id", "key", "line_no", "line", "points", *_own_columns(threshold)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = SegmentKeys(threshold, False)

        def batch(out: list[tuple], texts: list[str], at: list[int]) -> pa.RecordBatch:
            own, held = np.zeros((threshold + 1, len(out)), np.int64), np.zeros((threshold + 1, len(out)), bool)
            place = np.array(at, np.int64)
            for which, key, number in keys.of(texts):
                own[number, place[which]] = key
                held[number, place[which]] = True
            return pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], t) for k, t in enumerate(types)), *(pa.array(x, mask=~h) for x, h in zip(own, held))], names)

        for b in batches:
            out, texts, at, points = [], [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key = text_key((t or "").encode("utf-8", "surrogatepass"))
                for n, line in enumerate((t or "").split("\n")):
                    text = line_text(line, least)
                    if text is not None:
                        at.append(len(out))
                        texts.append(text)
                        points += len(text)
                    out.append((i, key, n, None if text is None else line_hash(text), None if text is None else len(text)))
                if len(out) > _BATCH or points > _CHUNK:
                    yield batch(out, texts, at)
                    out, texts, at, points = [], [], [], 0
            yield batch(out, texts, at)

    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
    return docs.mapInArrow(run, "doc_id long, key long, line_no int, line binary, points int, " + ", ".join(f"{c} long" for c in _own_columns(threshold)))


def _probes(docs: DataFrame, threshold: int, segments: np.ndarray) -> DataFrame:
    """(segment key, line, points): the probes of all lines that the bitmap of the segments may hold."""
    held = ship(docs.sparkSession, segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, keys, seen = shipped(held), SegmentKeys(threshold, True), set()

        def batch(lines: list[str], names: list[bytes]) -> Iterator[pa.RecordBatch]:
            known, size = pa.array(names, pa.binary()), np.array([len(x) for x in lines], np.int32)
            for which, key, _ in keys.of(lines):
                met = held_all(bitmap, key)
                yield pa.RecordBatch.from_arrays([pa.array(key[met]), known.take(pa.array(which[met])), pa.array(size[which[met]])], ["segment", "line", "points"])

        for b in batches:
            lines, names, points = [], [], 0
            for t in b.column(0):
                for line in (t.as_py() or "").split("\n"):
                    if (text := line_text(line)) is None or (name := line_hash(text)) in seen:
                        continue
                    if len(seen) < 200_000:  # spares repeats within a task, no more
                        seen.add(name)
                    lines.append(text)
                    names.append(name)
                    points += len(text)
                if points > _CHUNK or len(lines) > _BATCH:
                    yield from batch(lines, names)
                    lines, names, points = [], [], 0
            yield from batch(lines, names)

    return docs.select("text").mapInArrow(run, "segment long, line binary, points int")


def line_links(docs: DataFrame, lines: DataFrame, threshold: int = THRESHOLD, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs (text), lines (line, points, own0 ...), distinct -> (a, b, links): a null b gives a's number of links found in a task, others join a to a linked line."""
    spark = docs.sparkSession
    own = F.array(*[F.struct(F.col(c).alias("segment"), F.lit(k).alias("number")) for k, c in enumerate(_own_columns(threshold))])
    own = lines.select("line", "points", F.explode(own).alias("own")).select("own.segment", "line", "points", "own.number").where("segment IS NOT NULL")
    probes = _probes(docs, threshold, key_filter(own.select("segment"))).distinct().withColumn("number", F.lit(-1))
    rows = stash(own.unionByName(probes), "segment-rows", _TEXTS)
    sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"), F.max("number").alias("any")).where("n > 1 AND any >= 0")
    sizes = sizes.select("segment", F.ceil(F.greatest(F.col("n") / group_rows, F.col("points") / GROUP_POINTS)).cast("int").alias("parts"))
    met = rows.drop("points").join(sizes, "segment")
    # a line with its own segment at that place needs no probe there
    met = stash(met.groupBy("segment", "line", "parts").agg(F.max("number").alias("number")), "met")
    part = F.pmod(F.xxhash64("line"), F.col("parts")).cast("int")
    met = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("segment", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "line", "number")
    low = F.xxhash64("line")
    needed = ship(spark, key_filter(met.select(low.alias("k")).distinct()))
    texts = docs.select("text").mapInArrow(_texts(needed), "line binary, words string").dropDuplicates(["line"])
    read = met.join(texts, "line").repartition("segment", "part_a", "part_b").sortWithinPartitions("segment", "part_a", "part_b")
    read = read.select("segment", "part_a", "part_b", "part", "line", "number", "words")
    return read.mapInArrow(_verifier(threshold), "a binary, b binary, links long")


def _texts(needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped(needed)
        for b in batches:
            out = {}
            for t in b.column(0):
                for line in (t.as_py() or "").split("\n"):
                    # Spark's xxhash64 of the hash, as the bitmap holds it
                    if (text := line_text(line)) is not None and _held(bitmap, xxhash.xxh64_intdigest(name := line_hash(text), seed=42)):
                        out[name] = text
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.string())], ["line", "words"])

    return run


def _candidates(rows: list[tuple], cross: bool, threshold: int) -> Iterator[tuple[tuple, tuple]]:
    """Pairs (x, y) of rows (..., part, line, number, words), in order of (length, line), that can be near by length and letters.

    x, the shorter line or of equally long ones that of the lesser hash, has the
    segment; y holds it.  An edit changes the counts of letters by two at most.
    Between two parts only pairs across count.
    """
    rows = sorted(rows, key=lambda r: (len(r[6]), r[4]))
    size = np.array([len(r[6]) for r in rows])
    edits = np.array([allowed(n, threshold) for n in size.tolist()])
    number, part = np.array([r[5] for r in rows]), np.array([r[3] for r in rows])
    letters = np.array([np.bincount(np.frombuffer(r[6].encode("utf-32-le", "surrogatepass"), "<u4") % _BINS, minlength=_BINS) for r in rows], np.int32)
    low = np.searchsorted(size, size - threshold)
    for k in range(1, len(rows)):
        own = np.flatnonzero(number[low[k] : k] >= 0) + low[k]
        if cross:
            own = own[part[own] != part[k]]
        own = own[size[k] - size[own] <= edits[own]]
        if len(own):
            own = own[np.abs(letters[own] - letters[k]).sum(1) <= 2 * edits[own]]
        for j in own.tolist():
            yield rows[j], rows[k]


def _verifier(threshold: int):
    names = ["a", "b", "links"]
    types = (pa.binary(), pa.binary(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[int, list[tuple[bytes, str, bytes, str]]] = {}

        def solve() -> pa.RecordBatch:
            parent: dict[bytes, bytes] = {}
            links: dict[bytes, int] = {}

            def root(x: bytes) -> bytes:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for edits, own in pairs.items():
                for k in np.flatnonzero(within([(p[1], p[3]) for p in own], edits)).tolist():
                    a, _, b, _ = own[k]
                    links[a] = links.get(a, 0) + 1
                    links[b] = links.get(b, 0) + 1
                    a, b = root(a), root(b)
                    parent[max(a, b)] = min(a, b)
            pairs.clear()
            out = [(x, None, n) for x, n in links.items()] + [(x, r, 0) for x in parent if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

        def group(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            points = 0
            for x, y in _candidates(rows, rows[0][1] != rows[0][2], threshold):
                edits = allowed(len(x[6]), threshold)
                if first_common(x[6], y[6], edits) != x[5]:
                    continue
                pairs.setdefault(edits, []).append((x[4], x[6], y[4], y[6]))
                points += len(y[6])
                if len(pairs[edits]) >= _BATCH or points > 16 * _CHUNK:
                    yield solve()
                    points = 0

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if rows and row[:3] != rows[0][:3]:
                    if len(rows) > 1:
                        yield from group(rows)
                    rows = []
                rows.append(row)
        if len(rows) > 1:
            yield from group(rows)
        yield solve()

    return run


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, group_rows: int = GROUP_ROWS, least: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key, line_no, copies, links, keep (doc_id, key, line_no), kept; one row per line occurrence.

    Lines are linked if allowed(points of the shorter, threshold) edits part
    them at most, white space at the ends aside.  links: other line texts
    linked to this one; copies: its occurrences; keep: the first occurrence, by
    doc_id (nulls first), key and number, of the line's connected class.  Lines
    under least points and empty ones have nulls and are kept.  Null text: one
    empty line.  Repeated rows: each line occurs once more, and rows equal in id
    and text share their fate.  Empty table: no rows.
    """
    rows = stash(line_rows(docs, least, threshold), "lines", _TEXTS)
    first = F.min(F.struct("doc_id", "key", "line_no")).alias("first")
    lines = rows.where("line IS NOT NULL").groupBy("line").agg(first, F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in ("points", *_own_columns(threshold))])
    lines = stash(lines, "distinct-lines")
    found = stash(line_links(docs, lines, threshold, group_rows), "line-links", _TEXTS)
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    grouped = lines.join(roots, F.col("line") == F.col("node")).select("line", "root", "first")
    keepers = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    keepers = grouped.join(keepers, "root").select(F.col("line").alias("member"), "keep")
    known = lines.join(keepers, F.col("line") == F.col("member"), "left").join(links, F.col("line") == F.col("linked"), "left").select(
        "line", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("keep", "first").alias("keep")
    )
    # lines that occur once and link to none keep themselves, and need no join
    known = stash(known.where("copies > 1 OR links > 0"), "line-classes").withColumnRenamed("line", "of")
    place = F.struct("doc_id", "key", "line_no")
    joined = rows.join(known, F.col("line") == F.col("of"), "left")
    alone = F.col("of").isNull()
    some = F.col("line").isNotNull()
    return joined.select(
        "doc_id", "key", "line_no", F.when(some, F.coalesce("copies", F.lit(1))).alias("copies"), F.when(some, F.coalesce("links", F.lit(0))).alias("links"),
        F.when(some, F.when(alone, place).otherwise(F.col("keep"))).alias("keep"), (alone | place.eqNullSafe(F.col("keep"))).alias("kept"),
    )


def text_classes(docs: DataFrame, threshold: int = THRESHOLD, least: int = 1) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key, n_lines, n_removed, n_links, removed (line numbers), class_ids (doc_id of each removed line's keeper), class_id, rows.

    One row for each distinct doc_id and text; rows counts those of docs that
    are equal so.  class_id: the least doc_id that keeps a line of this text.  Null and empty texts are one empty line that stays.  Empty
    table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = line_classes(docs, threshold, least=least)
    gone = F.array_sort(F.collect_set(F.when(~F.col("kept"), F.struct("line_no", F.col("keep.doc_id").alias("keeper")))))
    return lines.groupBy("doc_id", "key").agg(
        F.count_distinct("line_no").alias("n_lines"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"), F.min("keep.doc_id").alias("class_id"), gone.alias("gone"),
        (F.count(F.lit(1)) / F.count_distinct("line_no")).cast("long").alias("rows"),
    ).select(
        "doc_id", "key", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.expr("n_links div rows").alias("n_links"),
        F.transform("gone", lambda g: g["line_no"]).alias("removed"), F.transform("gone", lambda g: g["keeper"]).alias("class_ids"), "class_id", "rows",
    )


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = 1) -> DataFrame:
    """docs with all its columns: text without the lines of which an equal or near line comes first elsewhere.

    A document that had text and loses every line goes, as all it said is kept
    in another; null and empty texts stay as they are.  A column n_chars, where
    there is one, becomes the new text's length.  Rows equal in id and text
    share their fate.  Lines under least points stay, see line_classes.  Empty
    table: no rows.
    """
    classes = text_classes(docs, threshold, least).where("n_removed > 0").select(F.col("doc_id").alias("_line_id"), F.col("key").alias("_line_key"), F.col("removed").alias("_line_gone"))
    classes = stash(classes, "line-cuts")
    given = list(docs.columns)
    names = ["_line_text_key", *given]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([text_key(t or b"") for t in texts], pa.int64()), *b.columns], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, gone in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index("_line_gone")).to_pylist()):
                if gone:
                    gone = set(gone)
                    kept = [line for n, line in enumerate(t.split("\n")) if n not in gone]
                    t = "\n".join(kept) if kept else None
                texts.append(t)
            columns = {c: b.column(b.schema.get_field_index(c)) for c in given}
            columns["text"] = pa.array(texts, pa.string())
            gone_all = pa.array([t is None and bool(g) for t, g in zip(texts, b.column(b.schema.get_field_index("_line_gone")).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*columns.values(), gone_all], [*given, "_line_all"])

    held = docs.mapInArrow(keyed, docs.select(F.lit(0).cast("long").alias("_line_text_key"), "*").schema)
    same = held["doc_id"].cast("long").eqNullSafe(classes["_line_id"]) & (held["_line_text_key"] == classes["_line_key"])
    joined = held.join(classes, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_line_gone")
    out = joined.mapInArrow(cut, docs.select("*", F.lit(False).alias("_line_all")).schema).where("NOT _line_all").drop("_line_all")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out

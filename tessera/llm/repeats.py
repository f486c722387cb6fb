"""Suffix-array dedup: removes bytes covered by a string of a given length that occurs twice.

Each string of `length` bytes is named after an anchor inside it, the gram with
the least hash (rightmost of equals): equal strings have equal anchors at equal
places.  An anchor's occurrence owns the run of strings it names, so anchors
deal all strings of the corpus, each exactly once, into groups; only groups
with several occurrences can hold repeats.  Occurrences whose owned stretches have
the same 128-bit hash collapse to one with a count before any bytes move.
What differs within a group goes to shards of bounded size: suffix array, Kasai
common prefixes over the owned starts, and where a group spans shards, binary
search of one shard's strings in the other's array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ship, shipped, stash
from tessera.llm.suffix_array import Shard, repeated_starts

LENGTH = 400
#: Text bytes of one suffix array.
SHARD_BYTES = 256 << 10
#: Stretches of one anchor, and their bytes, that one part holds; a larger group is cut and its parts meet in pairs.
GROUP_ROWS, GROUP_BYTES = 4096, 2 << 20
_PIECE = 1 << 17
_MIX = (np.uint64(33), np.uint64(0xFF51AFD7ED558CCD), np.uint64(29))
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    byte = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = 2 * _PIECE + 1
    out = [byte]
    for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, factor, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return tuple(out)


def anchors(x: np.ndarray, valid: np.ndarray, length: int, tables: tuple) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor place, anchor hash) of the owned runs of x.

    valid marks the starts of whole strings.  x holds at most 2 ** 18 bytes.
    """
    byte, power, inverse = tables
    gram = length // 2
    window = length - gram + 1
    n = len(x)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[x] * power[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]
    h ^= h >> _MIX[0]
    h *= _MIX[1]
    h ^= h >> _MIX[2]
    # least high bits, then the last place
    least = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    width = 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        rest = window - width
        least = np.minimum(least[:-rest], least[rest:])
    start = np.flatnonzero(valid[: len(least)])
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    at = (_LOW - (least[start] & _LOW)).astype(np.int64)
    cut = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(start) - 1]])
    return start[first], start[last], at[first], h[at[first]]


def _batches(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of bounded size and the pieces in them: (text number, offset in the text, start and end in the buffer).

    A long text is cut into pieces that overlap so that each string starts in one.
    """
    parts, pieces, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), _PIECE):
            piece = text[at : at + _PIECE + length - 1]
            if size and size + len(piece) > _PIECE + length:
                yield b"".join(parts), pieces
                parts, pieces, size = [], [], 0
            parts.append(piece)
            pieces.append((k, at, size, size + len(piece)))
            size += len(piece)
    if pieces:
        yield b"".join(parts), pieces


def text_key(text: bytes) -> int:
    """Names a text together with its doc_id; equal rows share their fate, so they may share the name."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def stretches(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text -> anchor, body and more (hash of the owned stretch), doc_id, key, start, place, runs.

    The stretch begins at start; its anchor lies place bytes on, and it owns
    runs + 1 strings.  Of stretches that a text holds again one stays, and what
    they cover comes as spans from start on, with a null anchor and runs + 1
    strings: a text of one short period is two rows, not one for each period.
    """
    names = ["anchor", "body", "more", "doc_id", "key", "start", "place", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            keys = [text_key(t) for t in texts]
            for buffer, pieces in _batches(texts, length):
                x = np.frombuffer(buffer, np.uint8)
                valid = np.zeros(len(x), bool)
                for _, _, s, e in pieces:
                    valid[s : e - length + 1] = True
                first, last, at, anchor = anchors(x, valid, length, tables)
                of = np.searchsorted([p[2] for p in pieces], first, side="right") - 1
                shift = np.array([p[1] - p[2] for p in pieces])[of]
                text = np.array([p[0] for p in pieces])[of].tolist()
                body = np.frombuffer(b"".join([xxhash.xxh3_128_digest(buffer[s : e + length]) for s, e in zip(first.tolist(), last.tolist())]), "<u8").reshape(-1, 2)
                start, runs, place = first + shift, last - first, at - first
                own = np.empty(len(body), [("body", "<u8"), ("more", "<u8"), ("text", "<i8")])
                own["body"], own["more"], own["text"] = body[:, 0], body[:, 1], text
                _, one, back, many = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
                keep, none = np.ones(len(own), bool), np.zeros(len(own), bool)
                if len(one) < len(own):
                    keep[:] = False
                    keep[one] = True
                    covered: list[list[int]] = []
                    for k in np.flatnonzero(many[back] > 1).tolist():
                        if covered and covered[-1][0] == text[k] and start[k] <= covered[-1][2] + 1:
                            covered[-1][2] = max(covered[-1][2], int(start[k] + runs[k]))
                        else:
                            covered.append([text[k], int(start[k]), int(start[k] + runs[k])])
                    more = len(covered)
                    text = [t for t, k in zip(text, keep) if k] + [c[0] for c in covered]
                    start = np.append(start[keep], [c[1] for c in covered])
                    runs = np.append(runs[keep], [c[2] - c[1] for c in covered])
                    place, anchor, body = np.append(place[keep], [0] * more), np.append(anchor[keep], np.zeros(more, np.uint64)), np.vstack([body[keep], np.zeros((more, 2), np.uint64)])
                    none = np.append(none[keep], np.ones(more, bool))
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64), mask=none), *(pa.array(np.ascontiguousarray(body[:, k]).view(np.int64), mask=none) for k in (0, 1)), pa.array([ids[k] for k in text], pa.int64()),
                    pa.array([keys[k] for k in text], pa.int64()), pa.array(start.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(runs.astype(np.int32)),
                ], names)

    schema = "anchor long, body long, more long, doc_id long, key long, start long, place int, runs int"
    return docs.mapInArrow(run, schema)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap that holds the keys' low bits, of 16 bits a key but 16 MB at most.

    It only spares rows a shuffle: what it passes wrongly finds no partner
    later.  Past its bound it passes more, and the results stay the same.
    """
    count = keys.count()
    bits = 1 << min(27, max(16, (16 * count).bit_length()))
    block = 1 << 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            k = b.column(0).to_numpy() & (bits - 1)
            np.bitwise_or.at(own, k >> 3, np.uint8(128) >> (k & 7).astype(np.uint8))
        blocks = own.reshape(-1, block // 8)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([blocks[k].tobytes() for k in used.tolist()], pa.binary())], ["block", "bits"])

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block // 8, np.uint8)
        for b in batches:
            for part in b.column(b.schema.get_field_index("bits")):
                total |= np.frombuffer(part.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["block", "bits"])

    parts = keys.mapInArrow(mark, "block long, bits binary").groupBy("block").applyInArrow(join, "block long, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in parts:
        out[r.block * block // 8 : (r.block + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _held(bitmap: np.ndarray, key: int) -> bool:
    k = key & (8 * len(bitmap) - 1)
    return bool(bitmap[k >> 3] >> (7 - (k & 7)) & 1)


def held_all(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = keys & (8 * len(bitmap) - 1)
    return (bitmap[k >> 3] >> (7 - (k & 7)).astype(np.uint8) & 1).astype(bool)


def _group_repeats(rows: list[tuple[int, int, bytes, int]], length: int) -> dict[int, np.ndarray]:
    """rows (number, group, stretch, owned strings) in order of group -> per number, flags of its strings that repeat.

    Shards are cut at SHARD_BYTES; a group in several is merged by binary search.
    """
    shards: list[tuple[Shard, list, np.ndarray, np.ndarray, np.ndarray]] = []
    part: list[tuple[int, int, bytes, int]] = []
    size = 0
    for row in [*rows, None]:
        if row is None or (part and size + len(row[2]) > SHARD_BYTES):
            if part:
                text = np.frombuffer(b"".join(r[2] for r in part), np.uint8)
                starts = np.cumsum([0, *(len(r[2]) for r in part)])[:-1]
                owned = np.array([r[3] for r in part])
                shard = Shard(text, length)
                shards.append((shard, part, starts, owned, repeated_starts(shard, starts, owned)))
            part, size = [], 0
        if row is not None:
            part.append(row)
            size += len(row[2])
    for k, (shard, part, starts, owned, flags) in enumerate(shards):
        for other, others, other_starts, other_owned, other_flags in shards[k + 1 :]:
            if others[0][1] != part[-1][1]:
                break  # in order of group, so no later shard shares one
            mine = [j for j, r in enumerate(others) if r[1] == part[-1][1]]
            wanted = np.concatenate([np.arange(other_starts[j], other_starts[j] + other_owned[j]) for j in mine])
            lo, hi = shard.ranges(other, wanted)
            is_owned = np.zeros(shard.n, bool)
            for s, n in zip(starts, owned):
                is_owned[s : s + n] = True
            seen = np.concatenate([[0], np.cumsum(is_owned[shard.array])])
            found = seen[hi] > seen[lo]
            other_flags[wanted[found]] = True
            cover = np.zeros(shard.n + 1, np.int64)
            np.add.at(cover, lo[found], 1)
            np.add.at(cover, hi[found], -1)
            hit = shard.array[np.cumsum(cover)[:-1] > 0]
            flags[hit[is_owned[hit]]] = True
    return {r[0]: flags[s : s + n] for _, part, starts, owned, flags in shards for r, s, n in zip(part, starts.tolist(), owned.tolist())}


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def differing_repeats(cut: DataFrame, length: int) -> DataFrame:
    """(anchor, part_a, part_b, doc_id, key, start, owned, stretch) -> spans (doc_id, key, start, end) of repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes, int]] = []
        where: list[tuple[int | None, int, int]] = []
        group, groups, size = None, 0, 0

        def solve() -> pa.RecordBatch:
            out = []
            for k, flags in _group_repeats(rows, length).items():
                doc, key, start = where[k]
                out += [(doc, key, start + a, start + b - 1 + length) for a, b in _runs(flags)]
            rows.clear()
            where.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["doc_id", "key", "start", "end"])

        for b in batches:
            for anchor, pa_, pb, doc, key, start, owned, stretch in zip(*(c.to_pylist() for c in b.columns)):
                if (anchor, pa_, pb) != group:
                    # parts of one anchor hold the same stretches again, which must not meet themselves
                    if size > SHARD_BYTES or group and group[0] == anchor:
                        yield solve()
                        size = 0
                    group, groups = (anchor, pa_, pb), groups + 1
                rows.append((len(where), groups, stretch, owned))
                where.append((doc, key, start))
                size += len(stretch)
        if rows:
            yield solve()

    dealt = cut.repartition("anchor", "part_a", "part_b").sortWithinPartitions("anchor", "part_a", "part_b")
    return dealt.select("anchor", "part_a", "part_b", "doc_id", "key", "start", "owned", "stretch").mapInArrow(run, "doc_id long, key long, start long, end long")


def repeat_spans(docs: DataFrame, length: int = LENGTH, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, key, start, end): byte spans that together cover all repeated strings."""
    rows = stash(stretches(docs, length), "stretches")
    found = rows.where("anchor IS NOT NULL")
    several = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("body", "more")]).where("n > 1")
    several = stash(several.select("anchor", F.expr("min_body = max_body AND min_more = max_more").alias("alike")), "anchors")
    shared = stash(found.join(several, "anchor"), "shared")
    whole = [F.col("start"), (F.col("start") + F.col("runs") + length).alias("end")]
    alike = shared.where("alike").unionByName(rows.where("anchor IS NULL"), allowMissingColumns=True).select("doc_id", "key", *whole)
    mixed = shared.where("NOT alike")
    by = ["anchor", "body", "more", "place", "runs"]
    kinds = stash(mixed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "start")).alias("one")), "kinds")
    copied = mixed.join(kinds.where("n > 1").select(*by), by, "left_semi").select("doc_id", "key", *whole)
    ones = kinds.select("anchor", "one.doc_id", "one.key", "one.start", "runs")
    # larger groups are cut into parts by place, and each pair of parts is a task of its own
    parts = F.greatest(F.count(F.lit(1)) / group_rows, F.sum(F.col("runs") + length) / GROUP_BYTES)
    sizes = kinds.groupBy("anchor").agg(F.ceil(parts).cast("int").alias("parts"))
    ones = ones.join(sizes, "anchor").withColumn("part", F.pmod(F.xxhash64("key", "start"), F.col("parts")).cast("int"))
    ones = ones.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ones = ones.select("anchor", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "doc_id", "key", "start", "runs")
    per_text = stash(ones.groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "part_a", "part_b", "start", "runs")).alias("cuts")), "cuts")
    wanted = ship(docs.sparkSession, key_filter(per_text.select("key")))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped(wanted)
        for b in batches:
            out = [(i, k, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()) if t and len(t) >= length and _held(bitmap, k := text_key(t))]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "key", "text"])

    # of equal rows one is enough to read the bytes from
    held = docs.mapInArrow(texts, "doc_id long, key long, text binary")
    same = held["doc_id"].eqNullSafe(per_text["doc_id"]) & (held["key"] == per_text["key"])
    read = held.join(per_text, same).select(per_text["doc_id"], per_text["key"], "text", F.explode("cuts").alias("cut")).select(
        "doc_id", "key", "cut.*", (F.col("cut.runs") + 1).alias("owned"),
        F.substring("text", (F.col("cut.start") + 1).cast("int"), F.col("cut.runs") + length).alias("stretch"),
    )
    read = read.dropDuplicates(["anchor", "part_a", "part_b", "doc_id", "key", "start"])
    return alike.unionByName(copied).unionByName(differing_repeats(read, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, spans, kept, kept_sha256, one row per input row.

    spans are the maximal removed runs [start, end) in the UTF-8 bytes; kept
    holds the remaining bytes (null unless with_text).  Every string of length
    bytes that starts at two places of the table, in one text or two, is
    covered; overlapping ones count, and matches never cross texts.  Null text
    is empty; texts shorter than length keep everything; repeated rows are
    repeats of each other; null and repeated ids are fine.  Empty table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = repeat_spans(docs, length)
    per_text = stash(spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans")
    wanted = ship(docs.sparkSession, key_filter(per_text.select("key")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped(wanted)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                t = t or b""
                key = text_key(t)
                hit = len(t) >= length and _held(bitmap, key)
                out.append((i, key, len(t), t if hit or with_text else None, None if hit else hashlib.sha256(t).hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["doc_id", "key", "n_bytes", "text", "sha"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, n, text, sha, found in zip(*(c.to_pylist() for c in b.columns)):
                runs: list[list[int]] = []
                for s in sorted((f["start"], f["end"]) for f in found or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                if sha is None:
                    edges = [0, *(x for r in runs for x in r), n]
                    text = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
                    sha = hashlib.sha256(text).hexdigest()
                out.append((i, n, [{"start": a, "end": z} for a, z in runs], text if with_text else None, sha))
            types = (pa.int64(), pa.int64(), span, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])

    held = docs.mapInArrow(split, "doc_id long, key long, n_bytes long, text binary, sha string")
    same = held["doc_id"].eqNullSafe(per_text["doc_id"]) & (held["key"] == per_text["key"])
    joined = held.join(per_text, same, "left").select(held["doc_id"], "n_bytes", "text", "sha", "found")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")

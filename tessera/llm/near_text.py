"""Near-duplicate texts: SimHash links and a verified similarity of word shingles.

Fingerprints of texts that share four fifths of their five-word shingles differ
in far more than two or three bits, so fingerprints alone miss most such pairs.
So the links of the SimHash operator, found by the BK-trees of its shards,
propose pairs, banded minwise signatures of the same shingle hashes propose
those beyond its radius, and the shingle sets decide.  Texts with the same words collapse
first.  A task compares the sets of the pairs it is dealt and reports a spanning
forest of those that pass; only a passing pair spares others a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.repeats import _held, key_filter, text_key
from tessera.llm.shared import ascii_words, ship, shipped, stash
from tessera.llm.simhash import BROADCAST_NODES, SHARD_LIMIT, Met, probed, shingle_hashes, simhash

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 2
#: Signature places, and bands of places that propose a pair if they agree on all places of one.
PLACES, BANDS, BAND_PLACES = 128, 16, 3
#: Proposals need this share of agreeing signature places: far enough below the similarity that chance loses few.
_ESTIMATE = 0.65
#: Rows, and bytes of their shingle sets, of one part of a band or shard.
GROUP_ROWS, GROUP_BYTES = 2048, 64 << 20
_TEXTS = 1000


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(0, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, PLACES, dtype=np.uint64)


def signature(hashes: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per place, the least of the hashes after that place's mixing; no hashes: all ones."""
    least = np.full(PLACES, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * factors[0] + factors[1]
        part ^= part >> np.uint64(31)
        np.minimum(least, part.min(0), out=least)
    return least


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text -> doc_id, key, words (hash of the lower-cased words), fingerprint, places (a byte each), bands, size (shingles)."""
    names = ["doc_id", "key", "words", "fingerprint", "places", "bands", "size"]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                text = t.as_py() or b""
                words = ascii_words(text)
                hashes = shingle_hashes(words, shingle)
                least = signature(hashes, factors)
                bands = [xxhash.xxh3_64_intdigest(least[k * BAND_PLACES : (k + 1) * BAND_PLACES].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)]
                print_ = simhash(hashes)
                out.append((i, text_key(text), xxhash.xxh3_128_digest(b" ".join(words)), print_ - (1 << 64) if print_ >> 63 else print_, (least >> np.uint64(20)).astype(np.uint8).tobytes(), bands, len(hashes)))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names)

    return docs.mapInArrow(run, "doc_id long, key long, words binary, fingerprint long, places binary, bands array<long>, size int")


class _Group:
    """Rows (part, words, places, bands, fingerprint, ...) of one band or shard, and the pairs of them that are its to compare.

    A band (kind is its number) has the pairs that share no earlier band and whose signatures agree enough; a shard (kind -1)
    those with fingerprints within the radius.  Between two parts only pairs across count.
    """

    def __init__(self, kind: int, rows: list[tuple], cross: bool, radius: int) -> None:
        self.kind, self.rows, self.cross, self.radius = kind, rows, cross, radius
        self.parts = np.array([r[0] for r in rows])
        self.places = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), PLACES)
        self.bands = np.array([r[3] for r in rows], np.int64)
        self.prints = np.array([r[4] for r in rows], np.int64).view(np.uint64)

    def before(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows before row k to compare it with, and the signature places each agrees on with it."""
        if self.kind < 0:
            near = np.flatnonzero(np.bitwise_count(self.prints[:k] ^ self.prints[k]) <= self.radius)
            agree = (self.places[near] == self.places[k]).sum(1)
        else:
            agree = (self.places[:k] == self.places[k]).sum(1)
            near = np.flatnonzero(agree >= _ESTIMATE * PLACES)
            near = near[~(self.bands[near, : self.kind] == self.bands[k, : self.kind]).any(1)]
            agree = agree[near]
        if self.cross:
            own = self.parts[near] != self.parts[k]
            near, agree = near[own], agree[own]
        return near, agree

    def compared(self) -> list[tuple]:
        """The rows with some pair to compare."""
        some = np.zeros(len(self.rows), bool)
        for k in range(1, len(self.rows)):
            near, _ = self.before(k)
            some[near] = True
            some[k] |= len(near) > 0
        return [self.rows[k] for k in np.flatnonzero(some).tolist()]

    def forest(self, least: float) -> list[tuple[bytes, bytes]]:
        """Pairs whose sets (the rows' last column) are similar enough, a spanning forest of all such; no other pair joins rows."""
        sets = [np.frombuffer(r[-1], np.uint64) for r in self.rows]
        group = np.arange(len(self.rows))
        out = []
        for k in range(1, len(self.rows)):
            near, agree = self.before(k)
            for at in near[np.argsort(-agree, kind="stable")].tolist():
                if group[at] == group[k] or min(len(sets[at]), len(sets[k])) < least * max(len(sets[at]), len(sets[k])):
                    continue
                if similarity(sets[at], sets[k]) >= least:
                    out.append((self.rows[k][1], self.rows[at][1]))
                    group[group == group[k]] = group[at]
        return out


_ROW = "kind int, place long, value long, part_a int, part_b int, part int, words binary, places binary, bands array<long>, fingerprint long"
_KEY = ["kind", "place", "value", "part_a", "part_b"]


def _by_group(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[tuple[tuple, _Group]]:
    """The groups of sorted rows of _ROW, with their keys."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:5] != key:
                if len(rows) > 1:
                    yield key, _Group(key[0], rows, key[3] != key[4], radius)
                key, rows = row[:5], []
            rows.append(row[5:])
    if len(rows) > 1:
        yield key, _Group(key[0], rows, key[3] != key[4], radius)


def _print_rows(texts: DataFrame, radius: int, limit: int = SHARD_LIMIT, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """texts (words, fingerprint, size), distinct -> place, value, words, size: any two texts with fingerprints within radius share a (place, value).

    Place and value are a shard's mask and bits; its BK-tree finds which of its fingerprints are near another.
    """
    prints = stash(texts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")), "prints")
    met = probed(prints.select("fingerprint"), radius, Met, limit, broadcast_nodes)
    # all bits as the mask: texts with equal fingerprints, whether or not another fingerprint is near
    equal = prints.where("n > 1").select(F.lit(-1).cast("long").alias("place"), F.col("fingerprint").alias("value"), "fingerprint")
    return met.unionByName(equal).join(texts, "fingerprint").select("place", "value", "words", "size")


def _compared(texts: DataFrame, radius: int, group_rows: int) -> DataFrame:
    """texts (words, fingerprint, places, bands, size), distinct -> _ROW: the rows of bands and shards that have a pair to compare.

    Large groups are cut into parts that meet in pairs, by rows and by the bytes of the rows' sets.
    """
    bands = texts.select("words", "size", F.posexplode("bands").alias("kind", "value")).select("kind", F.lit(0).cast("long").alias("place"), "value", "words", "size")
    prints = _print_rows(texts.select("words", "fingerprint", "size"), radius).withColumn("kind", F.lit(-1))
    dealt = stash(bands.unionByName(prints), "bands")
    count = F.greatest(F.count(F.lit(1)) / group_rows, F.sum(F.col("size").cast("long")) / (GROUP_BYTES // 8))
    sizes = dealt.groupBy("kind", "place", "value").agg(F.ceil(count).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = dealt.drop("size").join(sizes, ["kind", "place", "value"]).withColumn("part", F.pmod(F.xxhash64("words"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumns({"part_a": F.least("part", "other"), "part_b": F.greatest("part", "other")})
    met = met.join(texts.drop("size"), "words").select(*_KEY, "part", "words", "places", "bands", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, group in _by_group(batches, radius):
            out += [(*key, *row) for row in group.compared()]
            if len(out) > 10_000:
                yield rows(out)
                out = []
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], [*_KEY, "part", "words", "places", "bands", "fingerprint"])

    return met.repartition(*_KEY).sortWithinPartitions(*_KEY, "words").mapInArrow(run, _ROW)


def near_classes(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, key, rows, keep_id, keep_key: distinct (id, text) pairs and the one of their class that stays.

    Texts whose sets of shingles are similar enough link, and classes are what
    links connect.  The least doc_id stays, null ids last.  Null and empty
    texts have no shingles and are all alike.  Texts equal but for case and
    white space are alike.  Repeated rows are one row here, counted in rows.
    Empty table: no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stash(_sketches(docs, shingle), "sketches", _TEXTS)
    texts = rows.groupBy("words").agg(F.first("fingerprint").alias("fingerprint"), F.first("places").alias("places"), F.first("bands").alias("bands"), F.first("size").alias("size"))
    texts = stash(texts, "texts")
    met = stash(_compared(texts, radius, group_rows), "compared")
    wanted = ship(spark, key_filter(met.select(F.xxhash64("words").alias("k")).distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped(wanted)
        for b in batches:
            out = {}
            for t in b.column(0).cast(pa.binary()):
                words = ascii_words(t.as_py())
                name = xxhash.xxh3_128_digest(b" ".join(words))
                if name not in out and _held(bitmap, xxhash.xxh64_intdigest(name, seed=42)):
                    out[name] = np.unique(shingle_hashes(words, shingle)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["words", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[bytes, bytes]] = set()
        for _, group in _by_group(batches, radius):
            pairs.update(group.forest(least))
            if len(pairs) > 10_000:
                yield batch(pairs)
                pairs.clear()
        yield batch(pairs)

    def batch(pairs: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.binary()), pa.array([min(p) for p in pairs], pa.binary())], ["a", "b"])

    held = stash(docs.select("text").mapInArrow(sets, "words binary, shingles binary").dropDuplicates(["words"]), "shingle-sets", _TEXTS)
    dealt = met.join(held, "words").select(*met.columns, "shingles").repartition(*_KEY).sortWithinPartitions(*_KEY, "words")
    links_ = dealt.mapInArrow(verify, "a binary, b binary").distinct()
    roots = components(links_)
    known = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    own = rows.groupBy("words", "doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    own = stash(own.join(roots, F.col("words") == F.col("node"), "left").select("doc_id", "key", "rows", F.coalesce("root", "words").alias("class")), "members")
    best = own.groupBy("class").agg(F.min(known).alias("best")).select("class", F.col("best.doc_id").alias("keep_id"), F.col("best.key").alias("keep_key"))
    return own.join(best, "class").select("doc_id", "key", "rows", "keep_id", "keep_key")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs with all its columns: one document of each class of near duplicates, the least doc_id; see near_classes.

    Of rows equal in id and text one stays.  Empty table: no rows.
    """
    classes = stash(near_classes(docs, shingle, least, radius), "near-classes")
    staying = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    gone = classes.where(~staying).select(F.col("doc_id").alias("_near_id"), F.col("key").alias("_near_key"))
    twice = classes.where(staying & (F.col("rows") > 1)).limit(1).count() > 0
    given = list(docs.columns)
    names = ["_near_text_key", *given]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([text_key(t or b"") for t in texts], pa.int64()), *b.columns], names)

    held = docs.mapInArrow(keyed, docs.select(F.lit(0).cast("long").alias("_near_text_key"), "*").schema)
    same = held["doc_id"].cast("long").eqNullSafe(F.col("_near_id")) & (held["_near_text_key"] == F.col("_near_key"))
    out = held.join(gone, same, "left_anti")
    if twice:
        out = out.dropDuplicates(["doc_id", "_near_text_key"])
    return out.select(*[F.col(f"`{c}`") for c in given])

"""Exact dedup: a minimal perfect hash over historical distinct digests.

The rows seen earlier are the history.  Its distinct digests, counted with
partial aggregation, so that a text that holds a third of all rows shuffles as
one row per task, are cut into shards of bounded size; each shard's index row
holds its perfect hash and, by slot, full digests, winner locators and group
sizes.  Digests of later rows are looked up, byte-checked: members move their
slot's winner and size on, nonmembers group separately.  Rows then meet the
shard's index in salted groups of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.perfect_hash import build, digest_words, pack, slots, unpack
from tessera.llm.shared import stash

#: Distinct digests in a shard, and rows that look up in one group.
SHARD_KEYS = 8192
GROUP_ROWS = 4096
_SPACES = b" \t\n\x0b\x0c\r"
_SLOT = ("keep_id", "keep_points", "group_size")
_INDEX = "shard int, levels binary, sizes array<int>, digests binary, keep_id array<bigint>, keep_points array<bigint>, group_size array<bigint>"


def text_digests(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, earlier) -> doc_id, points, digest, earlier, row.

    points: code points of the text; digest: SHA-256 of it without ASCII white
    space; null is empty.  row numbers the rows of a task, which tells equal
    rows apart once the table is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            digests = pa.array([hashlib.sha256((t or b"").translate(None, _SPACES)).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), digests, b.column(2), pa.array(np.arange(seen, seen + len(texts)))], ["doc_id", "points", "digest", "earlier", "row"]
            )
            seen += len(texts)

    points = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("points")
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "earlier", points)
    return given.mapInArrow(run, "doc_id long, points long, digest binary, earlier boolean, row long")


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _better(points: str, doc_id: str) -> Column:
    """Larger for the row that stays: most code points, then the smallest doc_id, null ids last."""
    return F.struct(F.col(points).alias("points"), F.col(doc_id).isNotNull().alias("known"), F.bitwise_not(doc_id).alias("minus"))


def digest_groups(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_points, group_size): most code points stay, then the smallest doc_id, null ids last."""
    best = F.max(_better("points", "doc_id"))
    return digests.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.bitwise_not("best.minus").alias("keep_id"), F.col("best.points").alias("keep_points"), "group_size"
    )


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """One row per shard; the rows of a shard are about SHARD_KEYS distinct digests."""

    def one(key: tuple, t: pa.Table) -> pa.Table:
        digests = t.column("digest").to_pylist()
        words = digest_words(digests)
        levels = build(words)
        at = slots(levels, words)
        order = np.empty(len(at), np.int64)
        order[at] = np.arange(len(at))
        t = t.take(pa.array(order))
        blob, sizes = pack(levels)
        row = {"shard": [key[0].as_py()], "levels": [blob], "sizes": [sizes], "digests": [b"".join(t.column("digest").to_pylist())]}
        row |= {c: [t.column(c).to_pylist()] for c in ("keep_id", "keep_points", "group_size")}
        return pa.table(row, schema=pa.schema([
            ("shard", pa.int32()), ("levels", pa.binary()), ("sizes", pa.list_(pa.int32())), ("digests", pa.binary()),
            ("keep_id", pa.list_(pa.int64())), ("keep_points", pa.list_(pa.int64())), ("group_size", pa.list_(pa.int64())),
        ]))

    return groups.withColumn("shard", _shard(F.col("digest"), shards)).groupBy("shard").applyInArrow(one, _INDEX)


def moved_on(index: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    """The index with the winners and sizes of members (digest, keep_id, keep_points, group_size), distinct and all in it, taken into their slots."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left
        digests = right.column("digest").to_pylist()
        at = slots(unpack(left.column("levels")[0].as_py(), left.column("sizes")[0].as_py()), digest_words(digests)).tolist()
        for c in _SLOT:
            values = left.column(c)[0].as_py()
            for k, value in zip(at, right.column(c).to_pylist()):
                values[k] = value
            left = left.set_column(left.schema.get_field_index(c), c, pa.array([values], pa.list_(pa.int64())))
        return left

    dealt = members.withColumn("shard", _shard(F.col("digest"), shards))
    return index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(one, _INDEX)


def look_up(rows: DataFrame, index: DataFrame, shards: int, group_rows: int = GROUP_ROWS, more: bool = False) -> DataFrame:
    """rows (doc_id, points, digest, row and, if so said, more) -> adds keep_id, keep_points, group_size; group_size is null for nonmembers.

    A shard with many rows is dealt over several salts and its index row is
    copied to each; a group holds about group_rows rows whatever the skew.
    """
    given = ["doc_id", "points", "digest", *(["more"] if more else [])]
    keyed = rows.select(*given, "row").withColumn("shard", _shard(F.col("digest"), shards))
    salts = keyed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("salts"))
    salts = stash(salts, "salts")
    left = keyed.join(salts, "shard").withColumn("salt", F.pmod("row", F.col("salts")).cast("int")).drop("salts", "row")
    right = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        out = {c: np.zeros(n, np.int64) for c in ("keep_id", "keep_points", "group_size")}
        void = {c: np.ones(n, bool) for c in out}
        if n and right.num_rows:
            levels = unpack(right.column("levels")[0].as_py(), right.column("sizes")[0].as_py())
            held = right.column("digests")[0].as_py()
            digests = left.column("digest").to_pylist()
            at = slots(levels, digest_words(digests))
            member = np.array([a >= 0 and held[32 * a : 32 * a + 32] == d for a, d in zip(at.tolist(), digests)])
            for c in out:
                value = right.column(c)[0].values
                known = np.asarray(value.is_valid())
                out[c][member] = np.asarray(value.fill_null(0))[at[member]]
                void[c][member] = ~known[at[member]]
        return pa.table([*(left.column(c) for c in given), *(pa.array(out[c], pa.int64(), mask=void[c]) for c in out)], names=[*given, *out])

    pairs = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt"))
    return pairs.applyInArrow(probe, "doc_id long, points long, digest binary, " + "more long, " * more + "keep_id long, keep_points long, group_size long")


def first_half(docs: DataFrame) -> Column:
    """Rows with ids up to the middle of the table's range: those that came earlier, where ids rise with time."""
    ends = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    return F.col("doc_id") <= F.lit(None if ends[0] is None else (ends[0] + ends[1]) // 2).cast("long")


def dedup_exact(docs: DataFrame, earlier: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, known, one row per input row.

    earlier marks the rows of docs that are the history, whose distinct digests
    make the index (first_half if not given; null means later).  Later rows of a
    known digest may win its group; those of unknown ones group among
    themselves.  kept: the row is its group's winner.  known: its digest is in
    the index.  Null text is empty; null doc_id loses to any other and is itself
    kept only in a group without ids; rows equal in id and length are all kept
    or all not.  No history: all rows group among themselves.  Empty table: no
    rows.
    """
    earlier = first_half(docs) if earlier is None else earlier
    rows = stash(text_digests(docs.select("doc_id", "text", F.coalesce(earlier, F.lit(False)).alias("earlier"))), "digests")
    past = stash(digest_groups(rows.where("earlier")), "groups")
    shards = max(1, -(-past.count() // SHARD_KEYS))
    index = stash(build_index(past, shards), "index")
    # one row for each later digest, so no key is hot
    later = digest_groups(rows.where("NOT earlier")).select("digest", F.col("keep_id").alias("doc_id"), F.col("keep_points").alias("points"), F.col("group_size").alias("more"), F.xxhash64("digest").alias("row"))
    later = stash(look_up(later, index, shards, more=True), "later")
    new = later.where("group_size IS NULL").select("digest", F.col("doc_id").alias("keep_id"), F.col("points").alias("keep_points"), F.col("more").alias("group_size"))
    best = F.greatest(_better("points", "doc_id"), _better("keep_points", "keep_id"))
    members = later.where("group_size IS NOT NULL").withColumn("best", best).select(
        "digest", F.bitwise_not("best.minus").alias("keep_id"), F.col("best.points").alias("keep_points"), (F.col("group_size") + F.col("more")).alias("group_size")
    )
    index = stash(moved_on(index, members, shards), "index-moved")
    found = stash(look_up(rows, index, shards), "found")
    win = F.col("points").eqNullSafe(F.col("keep_points")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    own = found.where("group_size IS NULL").select("doc_id", "points", "digest").join(stash(new, "new-groups"), "digest")
    cols = ["doc_id", "keep_id", "group_size", win.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return found.where("group_size IS NOT NULL").select(*cols, F.lit(True).alias("known")).unionByName(own.select(*cols, F.lit(False).alias("known")))


def unknown_texts(docs: DataFrame, history: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of the rows of docs whose text no row of history has, grouped among themselves.

    Empty tables and null texts as in dedup_exact.
    """
    both = docs.select("doc_id", "text", F.lit(False).alias("_old")).unionByName(history.select("doc_id", "text", F.lit(True).alias("_old")))
    return dedup_exact(both, F.col("_old")).where("NOT known").drop("known")

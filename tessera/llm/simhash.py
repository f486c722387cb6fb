"""SimHash near-dedup: fingerprints of word shingles, linked by BK-trees.

Two fingerprints within a radius r agree on at least one of r + 1 bit blocks,
so each block's value deals the distinct fingerprints into shards, and a BK-tree
in each shard finds the links.  A shard with too many fingerprints is dealt
again by blocks of its remaining bits, until so few bits are free that their
number bounds it.  Shard trees are built by the tasks that hold the shards and
broadcast where all of them together have a checked number of nodes; probes then
need no shuffle.  Beyond it, as the fingerprints of all documents have no bound,
each tree is probed in the task that built it, with the same links.  A task
reports a spanning forest of its links, never all pairs, and connected
components join the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components
from tessera.llm.shared import ascii_words, ship, shipped, stash

#: Distinct fingerprints of a shard; a larger one is dealt anew.
SHARD_LIMIT = 1024
#: Nodes of all shard trees together, up to which they are broadcast: 13 bytes each.
BROADCAST_NODES = 1 << 20
_SEED = 42


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of size words, space-joined; fewer words: of the whole sequence; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, _SEED)], np.uint64)
    ends = list(accumulate(map(len, words)))
    starts = [0, *(e + k + 1 for k, e in enumerate(ends[:-size]))]
    return np.array([digest(joined[s : e + k], _SEED) for s, (k, e) in zip(starts, enumerate(ends[size - 1 :], size - 1))], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; none: 0."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


class BkTree:
    """Integers under Hamming distance; a child hangs on the edge of its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def packed(self) -> bytes:
        """Values, then each node's parent and the edge it hangs on."""
        parent, edge = np.zeros(len(self.values), "<i4"), np.zeros(len(self.values), "u1")
        for at, children in enumerate(self.children):
            for e, c in children.items():
                parent[c], edge[c] = at, e
        return np.array(self.values, "<u8").tobytes() + parent.tobytes() + edge.tobytes()

    @staticmethod
    def unpacked(blob: bytes) -> BkTree:
        tree, n = BkTree(), len(blob) // 13
        tree.values = np.frombuffer(blob, "<u8", n).tolist()
        tree.children = [{} for _ in range(n)]
        for k, (at, e) in enumerate(zip(np.frombuffer(blob, "<i4", n, 8 * n).tolist(), np.frombuffer(blob, "u1", n, 12 * n).tolist())):
            if k:
                tree.children[at][e] = k
        return tree

    def within(self, value: int, radius: int) -> list[int]:
        """Positions, in order of adding, of the values within radius; only edges within it are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo += [c for e, c in children.items() if -radius <= e - d <= radius]
            else:
                todo += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found


class Forest:
    """Joins values, and keeps the joins that were needed."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def shard_tree(values: list[int]) -> BkTree:
    """The tree of one shard's distinct values, added in their order."""
    tree = BkTree()
    for value in sorted(values):
        tree.add(value)
    return tree


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and fingerprint (bits of a signed long) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary())
            got = [simhash(shingle_hashes(ascii_words(t.as_py()), shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), pa.array(np.array(got, np.uint64).view(np.int64))], [*carry, "fingerprint"])

    given = docs.select(*carry, F.col("text").cast("string"))
    return given.mapInArrow(run, docs.select(*carry, F.lit(0).cast("long").alias("fingerprint")).schema)


def _split(mask: int, parts: int) -> list[int]:
    """mask with each part of its free bits added."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [round(len(free) * p / parts) for p in range(parts + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def shards(prints: DataFrame, radius: int, limit: int = SHARD_LIMIT) -> DataFrame:
    """prints (fingerprint), distinct -> (mask, value, fingerprint): shards of two or more, each at most limit or 2 ** free bits.

    Any two fingerprints within radius share a shard, at the first level or,
    where that is dealt anew, at one of the next.
    """
    masks, out = {0: [0]}, None
    todo = prints.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"), "fingerprint")
    while True:
        children = {m: _split(m, radius + 1) for ms in masks.values() for m in ms}
        table = F.create_map(*[x for m, c in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in c]))])
        dealt = todo.select(F.explode(F.element_at(table, F.col("mask"))).alias("mask"), "fingerprint")
        dealt = dealt.withColumn("value", F.col("fingerprint").bitwiseAND(F.col("mask")))
        sizes = stash(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-sizes")
        dealt = dealt.join(sizes, ["mask", "value"])
        masks, free = children, max(64 - m.bit_count() for c in children.values() for m in c)
        bounded = 2**free <= limit or free <= radius
        own = dealt if bounded else dealt.where(F.col("n") <= limit)
        out = own.drop("n") if out is None else out.unionByName(own.drop("n"))
        if bounded or sizes.where(F.col("n") > limit).limit(1).count() == 0:
            return out
        todo = dealt.where(F.col("n") > limit).drop("n")


def _shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """Shards (mask, value), fingerprints of rows in order of shard."""
    key, group = None, []
    for b in batches:
        for mask, value, print_ in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("mask", "value", "fingerprint"))):
            if (mask, value) != key:
                if group:
                    yield key, group
                key, group = (mask, value), []
            group.append(print_ & _ALL)
    if group:
        yield key, group


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Unsigned 64-bit columns as signed ones."""
    return pa.RecordBatch.from_arrays([pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in range(len(names))], names)


class Links:
    """Collects edges (a, b) that join all fingerprints found near each other."""

    names = ["a", "b"]

    def __init__(self) -> None:
        self.forest = Forest()

    def add(self, shard: tuple[int, int], value: int, near: list[int]) -> None:
        for other in near:
            self.forest.join(value, other)

    def size(self) -> int:
        return len(self.forest.parent)

    def batch(self) -> pa.RecordBatch:
        done, self.forest = _longs(self.forest.edges, self.names), Forest()
        return done


class Met:
    """Collects the fingerprints that are near another of their shard, with the shard: (place, value, fingerprint)."""

    names = ["place", "value", "fingerprint"]

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []

    def add(self, shard: tuple[int, int], value: int, near: list[int]) -> None:
        if near:
            self.rows.append((shard[0] & _ALL, shard[1] & _ALL, value))

    def size(self) -> int:
        return len(self.rows)

    def batch(self) -> pa.RecordBatch:
        done, self.rows = _longs(self.rows, self.names), []
        return done


def probed(prints: DataFrame, radius: int, found: type[Links] | type[Met], limit: int = SHARD_LIMIT, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """prints (fingerprint), distinct -> what found collects as each fingerprint probes the BK-trees of its shards for others within radius."""
    schema = ", ".join(f"{c} long" for c in found.names)

    def probe_one(tree: BkTree, shard: tuple[int, int], value: int, out: Links | Met) -> None:
        out.add(shard, value, [x for at in tree.within(value, radius) if (x := tree.values[at]) != value])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mask, value), group in _shards_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([mask], pa.int64()), pa.array([value], pa.int64()), pa.array([shard_tree(group).packed()], pa.binary())], ["mask", "value", "tree"])

    def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = found()
        for shard, group in _shards_of(batches):
            tree = shard_tree(group)
            for value in group:
                probe_one(tree, shard, value, out)
            if out.size() > 50_000:
                yield out.batch()
        yield out.batch()

    dealt = stash(shards(prints, radius, limit), "shards")
    by_shard = dealt.repartition("mask", "value").sortWithinPartitions("mask", "value")
    if dealt.count() > broadcast_nodes:
        return by_shard.mapInArrow(in_place, schema)
    # broadcast_nodes nodes at most
    built = by_shard.mapInArrow(build, "mask long, value long, tree binary").collect()
    held = ship(prints.sparkSession, {(r.mask, r.value): bytes(r.tree) for r in built})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, out = shipped(held), found()
        for b in batches:
            for mask, value, print_ in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("mask", "value", "fingerprint"))):
                if isinstance(tree := trees[mask, value], bytes):
                    tree = trees[mask, value] = BkTree.unpacked(tree)
                probe_one(tree, (mask, value), print_ & _ALL, out)
            if out.size() > 200_000:
                yield out.batch()
        yield out.batch()

    return dealt.mapInArrow(probe, schema)


def links(prints: DataFrame, radius: int, limit: int = SHARD_LIMIT, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """prints (fingerprint), distinct -> edges (a, b) that join all fingerprints linked within radius."""
    return probed(prints, radius, Links, limit, broadcast_nodes).distinct()


_ALL = (1 << 64) - 1


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint, component_id, one row per input row.

    Fingerprints within radius bits link; component_id is the least doc_id
    reachable.  Null and empty texts have fingerprint zero, which links like
    any other.  Null ids take part but name no component, unless it has no
    other id: then component_id is null.  Empty table: no rows.
    """
    rows = stash(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "fingerprints")
    # a table of its own, so that both sides of the join are plain shuffles and a hot fingerprint can be split
    groups = stash(print_groups(rows, radius), "print-groups")
    return rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id")


def print_groups(rows: DataFrame, radius: int) -> DataFrame:
    """rows (doc_id, fingerprint) -> (fingerprint, component_id) for each distinct fingerprint."""
    prints = stash(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(prints.select("fingerprint"), radius))
    linked = prints.join(roots, F.col("fingerprint") == F.col("node")).select("fingerprint", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select(F.col("fingerprint").alias("linked"), F.col("component_id").alias("least"))
    return prints.join(linked, F.col("fingerprint") == F.col("linked"), "left").select("fingerprint", F.when(F.col("linked").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))


def hex_print(column: str = "fingerprint"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")

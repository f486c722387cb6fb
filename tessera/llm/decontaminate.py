"""Benchmark decontamination: Wu-Manber search for windows of benchmark words.

The symbols are words.  Windows of one length make one searcher: a block of two
words shifts past all positions at which no window can end; blocks that end a
window lead to buckets by the window's first words, and a direct comparison
confirms.  The benchmark is taken in blocks of bounded size; a block's tables
are built on the driver and broadcast.  A task holds some megabytes of documents
and the tables of one block at a time.  One pass over the documents takes
several blocks; a larger benchmark takes more passes, of which only the hits are
kept, by text, until the last one meets them.  Documents are never rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import ship, shipped, stash

#: Text bytes of benchmark items that one broadcast table is made from, and tables of one pass over the documents.
BLOCK_BYTES, PASS_BLOCKS = 2 << 20, 8
#: Document bytes that a task takes past one table before it loads the next.
HELD_BYTES = 8 << 20
#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII characters; the rest separate.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_TYPES = "int", "array<struct<first:int,last:int>>", "array<string>"


def item_words(text: bytes | None) -> list[bytes]:
    """Runs of 0-9, a-z and non-ASCII characters, after lower-casing A-Z."""
    return text.translate(_FOLD).split() if text else []


def item_windows(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """All runs of size words; a shorter item is one window, an empty one none."""
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


class WuManber:
    """Searches word sequences for windows that all have the same length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length = length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                if length - end < self.shift.get(key, self.skip):
                    self.shift[key] = length - end
            tails = self.buckets.setdefault(window[-self.block :], {})
            tails.setdefault(window[: self.block], []).append((window, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of each occurrence."""
        at, n, length, skip, shift, two = self.length, len(words), self.length, self.skip, self.shift.get, self.block == 2
        while at <= n:
            tail = (words[at - 2], words[at - 1]) if two else (words[at - 1],)
            step = shift(tail, skip)
            if step:
                at += step
                continue
            start = at - length
            for window, items in self.buckets[tail].get(tuple(words[start : start + self.block]), ()):
                if tuple(words[start:at]) == window:
                    yield start, items
            at += 1


def searchers(items: list[tuple[str, bytes]], size: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        for window in item_windows(item_words(text), size):
            by_length.setdefault(len(window), {}).setdefault(window, []).append(item)
    return [WuManber(n, w) for n, w in sorted(by_length.items())]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of word spans, both ends included; touching ones are joined."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def text_name(text: bytes | None) -> bytes:
    return xxhash.xxh3_128_digest(text or b"")


def _loaded(blocks: list) -> list[Callable[[], list[WuManber]]]:
    """Loads each block's tables when called; those of an only block stay."""
    if len(blocks) == 1:
        only = shipped(blocks[0])
        return [lambda: only]
    return [lambda block=block: shipped(block) for block in blocks]


def _hits(texts: list[bytes | None], blocks: list[Callable[[], list[WuManber]]]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, spans, items) of each text; blocks are loaded one after the other."""
    words = [item_words(t) for t in texts]
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        for s in block():
            for k, w in enumerate(words):
                for start, which in s.search(w):
                    hits[k].append((start, start + s.length - 1))
                    items[k].update(which)
    return [(len(w), merge_spans(h), sorted(i)) for w, h, i in zip(words, hits, items)]


def _held(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Batches of up to HELD_BYTES of texts, and their texts."""
    batch: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        batch.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= HELD_BYTES:
            yield _joined(batch, column)
            batch, size = [], 0
    if batch:
        yield _joined(batch, column)


def _joined(batches: list[pa.RecordBatch], column: str) -> tuple[pa.RecordBatch, list[bytes | None]]:
    b = batches[0] if len(batches) == 1 else pa.concat_batches(batches)
    return b, b.column(b.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 10, prefix: str = "") -> DataFrame:
    """All columns of docs and, named prefix + words, spans, items: word count, hit word spans, items found.

    benchmark (item_id, text).  Items with null id are left out, as nothing can
    name them; null text has no words; an id that repeats is one item with the
    windows of all its texts.  Documents: null and empty text have no words and
    no hits; repeated rows are found alike.  The columns of docs may have any
    names but those three.  Empty benchmark: no hits.  No documents: no rows.
    """
    spark = docs.sparkSession
    bench = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    volume = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES))
    names = [f"{prefix}{c}" for c in ("words", "spans", "items")]
    passes = [range(at, min(at + PASS_BLOCKS, blocks)) for at in range(0, blocks, PASS_BLOCKS)]

    def tables(of: range) -> list:
        out = []
        for block in of:
            part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
            out.append(ship(spark, searchers([(r.item, bytes(r.text) if r.text is not None else None) for r in part.toLocalIterator()], size)))
        return out

    found = [_pass_hits(docs, tables(of)) for of in passes[:-1]]
    if found:
        spans = F.flatten(F.collect_list("spans")).alias("spans")
        earlier = found[0]
        for more in found[1:]:
            earlier = earlier.unionByName(more)
        # a text is one row for each pass with a hit
        earlier = stash(earlier.groupBy("name").agg(spans, F.flatten(F.collect_list("items")).alias("items")), "leaks")
    last, several = tables(passes[-1]), bool(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _loaded(last)
        for b, texts in _held(batches, "text"):
            got = _hits(texts, blocks)
            new = [pa.array([g[0] for g in got], pa.int32()), pa.array([[{"first": x, "last": y} for x, y in g[1]] for g in got], _SPANS), pa.array([g[2] for g in got], pa.list_(pa.string()))]
            if several:
                new.append(pa.array([text_name(t) for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *own])

    own = [*names, *(["_hit_text"] if several else [])]
    out = docs.mapInArrow(run, docs.select("*", *[F.lit(None).cast(t).alias(n) for t, n in zip([*_TYPES, "binary"], own)]).schema)
    if not found:
        return out
    earlier = earlier.select(F.col("name").alias("_hit_name"), F.col("spans").alias("_hit_spans"), F.col("items").alias("_hit_items"))
    joined = out.join(earlier, F.col("_hit_text") == F.col("_hit_name"), "left")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(names[0]),
        _merged(F.concat(none(names[1], _TYPES[1]), none("_hit_spans", _TYPES[1]))).alias(names[1]),
        F.array_sort(F.array_distinct(F.concat(none(names[2], _TYPES[2]), none("_hit_items", _TYPES[2])))).alias(names[2]),
    )


def _pass_hits(docs: DataFrame, tables: list) -> DataFrame:
    """docs (text) -> name, spans, items of the distinct texts with a hit in these tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _loaded(tables)
        for _, texts in _held(batches, "text"):
            got = [(text_name(t), [{"first": x, "last": y} for x, y in g[1]], g[2]) for t, g in zip(texts, _hits(texts, blocks)) if g[2]]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.binary(), _SPANS, pa.list_(pa.string())))], ["name", "spans", "items"])

    hits = docs.select("text").mapInArrow(run, f"name binary, spans {_TYPES[1]}, items {_TYPES[2]}")
    return stash(hits.dropDuplicates(["name"]), "pass-hits")


def _merged(spans: Column) -> Column:
    """Union of word spans, as merge_spans has it."""
    start = F.array().cast(_TYPES[1])

    def add(done: Column, s: Column) -> Column:
        end = F.try_element_at(done, F.lit(-1))
        joined = F.struct(end["first"].alias("first"), F.greatest(end["last"], s["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (s["first"] <= end["last"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(s))
        )

    return F.aggregate(F.array_sort(spans), start, add)


def hit_words(spans: Column) -> Column:
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1), F.lit(0).cast("long"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    found = find_leaks(docs, benchmark, size, prefix="_leak_")
    return found.where(F.size("_leak_items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])

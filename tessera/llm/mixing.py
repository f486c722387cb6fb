"""Mixing sources to target weights by Sainte-Lague apportionment.

Only DataFrame expressions: sizes and source totals are one narrow table, the
apportionment works on one row per source and shard, and each document's place
on its source's token line is a two-level prefix sum (bucket totals, then rows
within a bucket), so no source, however large, meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD_PATTERN, stash

#: Rows of one source that one window task orders.
ROWS_PER_BUCKET = 2048
#: Hex digits of a place that deal it to a bucket.
_PLACE_DIGITS = 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, rows) -> adds sid, weight, target.

    Sources in code point order, null last, take the weights in turn and share
    the total size; a target stops at max_epochs times its source's size and
    the excess goes to the others by weight.  In order of limit / weight the
    stopped sources are a prefix, so one running sum finds the common level.
    No sources, or no words at all: targets 0.
    """
    # one row per source: the only global orderings are over that table
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return (
        sources.withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(cycle, (F.col("sid") - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size") * float(max_epochs))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
            / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(whole)["level"])
        .withColumn("target", F.when(F.col("weight") * F.col("level") < F.col("most"), F.col("weight") * F.col("level")).otherwise(F.col("most")))
        .select("source", "source_size", "rows", "total", "sid", "weight", "target")
    )


def sainte_lague(targets: DataFrame, shards: int, block_words: int) -> DataFrame:
    """(sid, target, total) -> (sid, quotas): cumulative whole blocks of each source after each shard.

    House sizes are the shard boundaries.  Rounding target shares gives a
    Sainte-Lague allocation of a nearby house (divisor methods are house
    monotone); the highest next quotients, or lowest last ones, mend the rest.
    A source moves at most share * n / 2 + 1 seats, which bounds the candidates.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("shard"))
    seats = (
        targets.where("total > 0")
        .withColumn("share", F.col("target") / F.col("total"))
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("total") / block_words).cast("long")))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("house", F.floor(F.col("blocks") * F.col("shard") / shards))
        .withColumn("seats", F.floor(F.col("share") * F.col("house") + 0.5))
        .withColumn("short", F.col("house") - F.sum("seats").over(Window.partitionBy("shard")))
        .withColumn("moves", F.ceil(F.col("share") * n / 2) + 1)
    )
    step = seats.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("moves"))))
    add = (
        step.where("short > 0")
        .withColumn("quotient", F.col("share") / (2 * (F.col("seats") + F.col("i")) - 1))
        .withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("quotient"), "sid", "i")))
        .where("rank <= short").select("sid", "shard", F.lit(1).alias("change"))
    )
    cut = (
        step.where("short < 0 AND i <= seats")
        .withColumn("quotient", F.col("share") / (2 * (F.col("seats") - F.col("i") + 1) - 1))
        .withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy("quotient", F.desc("sid"), "i")))
        .where("rank <= -short").select("sid", "shard", F.lit(-1).alias("change"))
    )
    return (
        seats.select("sid", "shard", F.col("seats").alias("change"))
        .unionByName(add.unionByName(cut).select("sid", "shard", F.col("change").cast("long")))
        .groupBy("sid", "shard").agg(F.sum("change").alias("seats"))
        .groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "seats"))), lambda x: x["seats"]).alias("quotas"))
    )


def mix_sources(
    docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, block_words: int = 32, shards: int = 16, seed: str = "mix-1", carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Returns (documents, quotas).

    documents: doc_id, source, size, source_size, target, taken, first_shard,
    one row per input row, and the columns named in carry.  quotas: source, source_size, target, quotas (blocks
    taken up to each shard).  A source's documents lie on a token line in the
    order of md5(seed, doc_id), cut into blocks of block_words words; the
    source's quota takes blocks from the line's start, going round when they
    run out, never past max_epochs rounds.

    Null text: size 0, taken 0.  Null source: a source of its own, last in
    order.  Null or repeated doc_id: each row counts; equal keys are ordered by
    size, so equal rows differ only in which of them the last block cuts.
    Empty table: no rows.  No words at all: target and taken 0.
    """
    base = stash(
        docs.select(
            *carry, "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))).alias("place"),
        ),
        "mix-sizes",
    )
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sources, weights, max_epochs)
    targets = stash(targets, "mix-targets")
    quotas = targets.join(sainte_lague(targets, shards, block_words), "sid", "left")
    quotas = stash(quotas, "mix-quotas")
    plan = quotas.select(
        F.col("source").alias("s_source"), "sid", "source_size", "target",
        F.coalesce("quotas", F.array().cast("array<bigint>")).alias("quotas"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS_PER_BUCKET)).alias("buckets"),
        F.least(F.coalesce(F.element_at("quotas", -1), F.lit(0)) * block_words, F.col("source_size") * max_epochs).alias("words"),
    )
    placed = (
        base.join(plan.select("s_source", "sid", "buckets"), F.col("source").eqNullSafe(F.col("s_source")))
        .withColumn("bucket", F.floor(F.conv(F.substring("place", 1, _PLACE_DIGITS), 16, 10).cast("double") / 16.0**_PLACE_DIGITS * F.col("buckets")))
        .select(*carry, "doc_id", "source", "size", "place", "sid", "bucket")
    )
    totals = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    so_far = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)).alias("offset"))
    within = Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    full, rest = F.expr("words div nullif(source_size, 0)"), F.expr("words % nullif(source_size, 0)")
    out = (
        placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["sid", "bucket"])
        .withColumn("start", F.col("inner") + F.col("offset"))
        .join(plan.select("sid", "source_size", "target", "quotas", "words"), "sid")
        .withColumn(
            "taken",
            F.when(F.col("size") == 0, F.lit(0)).otherwise(
                F.col("size") * full + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
            ).cast("long"),
        )
        .withColumn("block", F.expr(f"start div {block_words}"))
        .withColumn("first_shard", F.when(F.col("taken") > 0, F.size(F.filter("quotas", lambda q: q <= F.col("block"))) + 1))
        .select(*carry, "doc_id", "source", "size", "source_size", "target", "taken", "first_shard")
    )
    return out, quotas.select("source", "source_size", "target", "quotas")


def mix_documents(docs: DataFrame, prefix: str = "mix_", **options) -> DataFrame:
    """The documents the mix takes words of, with all their columns and, named prefix + size, target, taken, first_shard, what it takes.

    The mix holds a text as often as its size goes into taken, and so many of
    its words once more as are left over.  Rows without id, and equal rows, are
    told apart by a number that the written table fixes.  Nothing taken: no rows.
    """
    held = stash(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows")
    names = ("size", "target", "taken", "first_shard")
    mixed = mix_sources(held, carry=("_mix_row",), **options)[0].where("taken > 0")
    mixed = mixed.select(F.col("_mix_row").alias("_mix_of"), *[F.col(c).alias(f"{prefix}{c}") for c in names])
    given = [F.col(f"`{c}`") for c in docs.columns]
    return held.join(mixed, F.col("_mix_row") == F.col("_mix_of")).select(*given, *[f"{prefix}{c}" for c in names])

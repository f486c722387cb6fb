"""Samples, clusters and similar items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import options as O
from tessera.functions import predicates as P
from tessera.functions import scalars as S


def digest_order(seed: str, key: Column) -> Column:
    """A reproducible random order."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample(rows: DataFrame, k: int, seed: str, key: str) -> DataFrame:
    """min(k, n) rows without replacement, the same ones on every run."""
    return rows.orderBy(digest_order(seed, F.col(key)), F.col(key)).limit(k)


def sample_each(rows: DataFrame, by: str, k: int, seed: str, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(digest_order(seed, F.col(key)), F.col(key)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def prefix_clusters(rows: DataFrame, name: str, key: str, seed: str, least: int = 2, members: int = 5, clusters: int = 3) -> DataFrame:
    """First words that several names share: (prefix, size, key, rank) of the first members, in order of key, of a sample of clusters.

    Blank names are skipped.
    """
    tagged = rows.select(key, S.first_word(F.col(name)).alias("prefix")).where("prefix IS NOT NULL")
    sizes = tagged.groupBy("prefix").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    chosen = sample(sizes, clusters, seed, "prefix")  # a few rows
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(key))
    return tagged.join(F.broadcast(chosen), "prefix").withColumn("rank", rank).where(F.col("rank") <= members).select("prefix", "size", key, "rank")


def similar_items(items: DataFrame, current_id, tags: list[str], folders: list[str], seed: str, limit: int = O.SIMILAR_LIMIT, candidates: int = O.SIMILAR_CANDIDATES) -> DataFrame:
    """Items that share one of the first two tags or, if there are none, one of the first two folders, by name.

    Each term gives its latest `candidates`; the first 2 * limit distinct ones,
    by term and date, are sampled down to limit.
    """

    def of(column: str, terms: list[str]) -> DataFrame | None:
        parts = [
            items.where(F.array_contains(column, t)).orderBy(F.desc("modified"), F.col("id")).limit(candidates).withColumn("term", F.lit(k)) for k, t in enumerate(terms[:2])
        ]
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        first = F.row_number().over(Window.partitionBy("id").orderBy("term"))
        rows = rows.where((F.col("id") != current_id) & F.col("id").isNotNull()).withColumn("_n", first).where("_n = 1")
        return rows.orderBy("term", F.desc("modified"), "id").limit(2 * limit).drop("_n")

    by_tag, by_folder = of("tags", tags), of("folders", folders)
    if by_tag is None:
        found = by_folder
    elif by_folder is None:
        found = by_tag
    else:
        found = by_tag.unionByName(by_folder.where(by_tag.agg(F.count(F.lit(1))).scalar() == 0))
    if found is None:
        return items.limit(0)
    return sample(found.drop("term"), limit, seed, "id").orderBy("name", "id")


def local_similar(listing: DataFrame, seed: str, limit: int = O.SIMILAR_LIMIT) -> DataFrame:
    """Up to limit other media of each medium's directory, chosen by a digest of the pair: (relative_path, similar, name, media_type).

    Each medium takes the ones that follow it in its directory's digest order,
    round the end, so that a directory's rows are ranked once and no pair is
    made that isn't returned.
    """
    ext = S.extension(F.col("relative_path"))
    kind = S.item_type(F.lit(False), ext)
    directory = F.struct("library_root", S.dir_name(F.col("relative_path")).alias("dir"))
    name = S.base_name(F.col("relative_path"))
    media = listing.where(~F.col("is_dir") & kind.isin("image", "video") & ~P.hidden(name)).select(
        "library_root", "relative_path", directory.alias("dir"), kind.alias("media_type"), S.stem(name).alias("name")
    )
    order = Window.partitionBy("dir").orderBy(digest_order(seed, F.col("relative_path")), "relative_path")
    ranked = media.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("dir")))
    steps = ranked.where("n > 1").withColumn("step", F.explode(F.sequence(F.lit(1), F.least(F.lit(limit), F.col("n").cast("int") - 1))))
    wanted = steps.select("library_root", "relative_path", "dir", ((F.col("place") + F.col("step")) % F.col("n")).cast("int").alias("place"))
    other = ranked.select("dir", "place", F.col("relative_path").alias("similar"), "name", "media_type")
    return wanted.join(other, ["dir", "place"]).select("library_root", "relative_path", "similar", "name", "media_type")


def feed(items: DataFrame, folders: DataFrame, tags: DataFrame, seed: str) -> dict[str, DataFrame]:
    """The landing page's parts: hero and featured of the newest ten, samples of images, videos, folders and tags, folder clusters."""
    newest = items.orderBy(F.desc("created"), "id").limit(10)
    rank = F.row_number().over(Window.orderBy(F.desc("created"), "id"))  # ten rows
    ranked = newest.withColumn("rank", rank)
    return {
        "hero": ranked.where("rank = 1"), "featured": ranked.where("rank BETWEEN 2 AND 5"),
        "random_images": sample(items.where("media_type = 'image'"), 8, seed, "id"), "random_videos": sample(items.where("media_type = 'video'"), 4, seed, "id"),
        "random_folders": sample(folders, 6, seed, "id"), "random_tags": sample(tags, 20, seed, "name"),
        "clusters": prefix_clusters(folders, "name", "id", seed),
    }

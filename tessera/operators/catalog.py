"""The item catalog: crawl rows, versioned merges, covers and pages.

A merge makes the next version of a table; parquet has no MERGE, so callers
write it beside the old one and switch.  Counts come as one-row DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import options as O
from tessera.functions import predicates as P
from tessera.functions import scalars as S
from tessera.session import cut_lineage


def item_rows(listing: DataFrame) -> DataFrame:
    """Item records from (library_root, relative_path, is_dir, size_bytes), before times and covers."""
    name, ext = S.base_name(F.col("relative_path")), S.extension(F.col("relative_path"))
    directory = S.dir_name(F.col("relative_path"))
    return listing.select(
        S.item_id(F.col("library_root"), F.col("relative_path")).alias("item_id"), name.alias("name"), F.lit("filesystem").alias("data_source"),
        S.item_type(F.col("is_dir"), ext).alias("item_type"), S.stacked_tags(directory).alias("tags"), S.slashes(F.col("relative_path")).alias("relative_path"),
        F.concat("library_root", F.lit("/"), S.slashes(F.col("relative_path"))).alias("absolute_path"), "library_root", ext.alias("ext"),
        S.mime_type(ext).alias("mime_type"), F.when(~F.col("is_dir"), F.col("size_bytes")).alias("size_bytes"),
    )


def crawl(listing: DataFrame) -> DataFrame:
    """Entries of the root (src_rank 0, tags []) and of every directory named #... (src_rank 1), but hidden and # entries.

    Hidden directories on the way don't matter.  An entry found both ways, as
    under a root named #..., comes twice.
    """
    name, directory = S.base_name(F.col("relative_path")), S.dir_name(F.col("relative_path"))
    seen = listing.where(P.crawled(name))
    root = item_rows(seen.where(directory == "")).withColumn("tags", F.array().cast("array<string>")).withColumn("src_rank", F.lit(0))
    whole = F.when(directory == "", F.col("library_root")).otherwise(directory)
    tagged = item_rows(seen.where(P.tag_directory(whole))).withColumn("src_rank", F.lit(1))
    return root.unionByName(tagged)


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def insert_if_absent(catalog: DataFrame, crawled: DataFrame, key: str = "item_id", order: tuple[str, ...] = ("src_rank", "absolute_path")) -> tuple[DataFrame, DataFrame]:
    """(new rows, counts seen, inserted, skipped): rows whose key the catalog lacks, first wins; known rows stay as they are.

    The new rows are written once, so that the counts don't crawl again.
    """
    fresh = cut_lineage(first_wins(crawled, key, *order).join(catalog.select(key), key, "left_anti"))
    counts = crawled.agg(F.count(F.lit(1)).alias("seen")).withColumn("inserted", fresh.agg(F.count(F.lit(1))).scalar())
    return fresh, counts.withColumn("skipped", F.col("seen") - F.col("inserted"))


def delete_vanished(catalog: DataFrame, crawled: DataFrame, root: str, unreadable: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """The catalog without rows of that root that the crawl no longer has; rows below directories that can't be listed stay.

    unreadable: (relative_path) of such directories.
    """
    own = catalog.where(F.col("library_root") == root)
    gone = own.join(crawled.select(key), key, "left_anti")
    if unreadable is not None:
        dirs = unreadable.select(F.concat("relative_path", F.lit("/")).alias("_dir"))
        above = F.transform(F.sequence(F.lit(1), F.size(F.split("relative_path", "/"))), lambda n: F.concat(F.array_join(F.slice(F.split("relative_path", "/"), 1, n), "/"), F.lit("/")))
        spared = gone.select(key, F.explode(above).alias("_dir")).join(dirs, "_dir", "left_semi").select(key)
        gone = gone.join(spared, key, "left_anti")
    return catalog.join(gone.select(key), key, "left_anti")


def refresh(catalog: DataFrame, listing: DataFrame, root: str, now: Column, refresh_known: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next version, counts seen, inserted, skipped, removed) of a crawl of one root: deletions first, then insertions.

    refresh_known also takes size, type and tags of known items from the crawl.
    """
    listing = listing.where(F.col("library_root") == root)
    crawled = crawl(listing)
    unreadable = listing.where(F.col("is_dir") & ~F.coalesce(F.col("readable"), F.lit(True))).select("relative_path") if "readable" in listing.columns else None
    kept = delete_vanished(catalog, crawled.where(F.col("item_id").isNotNull()), root, unreadable)
    fresh, counts = insert_if_absent(kept, crawled)
    fresh = fresh.drop("src_rank").withColumn("created_at", now).withColumn("updated_at", now)
    for f in catalog.schema:
        if f.name not in fresh.columns:
            fresh = fresh.withColumn(f.name, F.lit(False if f.name == "is_archived" else None).cast(f.dataType))
    if refresh_known:
        new = first_wins(crawled, "item_id", "src_rank", "absolute_path").select("item_id", *[F.col(c).alias(f"_{c}") for c in ("size_bytes", "mime_type", "tags", "item_type")])
        kept = kept.join(new, "item_id", "left")
        for c in ("size_bytes", "mime_type", "tags", "item_type"):
            kept = kept.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    size = lambda rows: rows.agg(F.count(F.lit(1))).scalar()
    return kept.select(*catalog.columns).unionByName(fresh.select(*catalog.columns)), counts.withColumn("removed", size(catalog) - size(kept))


def upsert_latest(rows: DataFrame, key: str, *latest: Column, keep_known: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key; columns in keep_known fall back to the last non-null value."""
    struct = F.struct(*[F.col(c) for c in rows.columns])
    order = F.struct(*latest)
    aggs = [F.max_by(struct, order).alias("_row")]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in keep_known]
    out = rows.groupBy(F.col(key).alias("_key")).agg(*aggs)
    return out.select(*[(F.col(f"_{c}") if c in keep_known else F.col(f"_row.{c}")).alias(c) for c in rows.columns])


def fill_thumbnails(catalog: DataFrame, resolved: Column, now: Column, root: str | None = None, force: bool = False) -> DataFrame:
    """Sets missing covers, or all with force, in one root or all; touched rows get updated_at and changed."""
    due = F.lit(True) if force else P.missing_thumbnail(F.col("thumbnail_route"))
    if root is not None:
        due = due & (F.col("library_root") == root)
    return catalog.withColumn("changed", due).withColumn("thumbnail_route", F.when(F.col("changed"), resolved).otherwise(F.col("thumbnail_route"))).withColumn(
        "updated_at", F.when(F.col("changed"), now).otherwise(F.col("updated_at"))
    )


def clear_thumbnails(catalog: DataFrame, now: Column, root: str | None = None) -> DataFrame:
    """Covers become null in one root or, without one, everywhere; touched rows get updated_at and changed."""
    scope = F.lit(True) if root is None else F.col("library_root") == root
    return catalog.withColumn("changed", scope).withColumn("thumbnail_route", F.when(~scope, F.col("thumbnail_route"))).withColumn(
        "updated_at", F.when(scope, now).otherwise(F.col("updated_at"))
    )


def page(items: DataFrame, limit: int = O.PAGE_DEFAULT, offset: int = 0, by: str = "updated_at", key: str = "item_id") -> DataFrame:
    """A page, latest first, ties by key; limits are clamped to 1..PAGE_MOST and offsets to 0."""
    return items.orderBy(F.desc_nulls_last(by), F.col(key)).offset(max(0, offset)).limit(max(1, min(O.PAGE_MOST, limit)))


def with_total(page_rows: DataFrame, items: DataFrame) -> DataFrame:
    """The page's rows with the number of all items, a scalar subquery."""
    return page_rows.withColumn("total", items.agg(F.count(F.lit(1))).scalar())

"""Covers: sidecars, directories, folders, bookmarks."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import options as O
from tessera.functions import predicates as P
from tessera.functions import scalars as S


def video_covers(files: DataFrame, src: str = "external") -> DataFrame:
    """(path of each video, thumbnail_route): a sidecar image, _thumbnail before plain and extensions in listed order, else a generated one, else the default.

    files (path) holds absolute paths, generated covers among them.
    """
    ext = S.extension(F.col("path"))
    rows = files.select("path", ext.alias("ext"), S.stem(F.col("path")).alias("stem"))
    order = F.array(*map(F.lit, O.IMAGE_EXTENSIONS))
    images = rows.where(F.col("ext").isin(*O.IMAGE_EXTENSIONS) & F.col("path").endswith(F.concat(F.lit("."), F.col("ext"))))
    place = F.array_position(order, F.col("ext"))
    thumbs = images.where(F.col("stem").endswith("_thumbnail")).select(F.regexp_replace("stem", "_thumbnail$", "").alias("of"), F.struct((2 * place).alias("prio"), "path").alias("cover"))
    plain = images.select(F.col("stem").alias("of"), F.struct((2 * place + 1).alias("prio"), "path").alias("cover"))
    best = thumbs.unionByName(plain).groupBy("of").agg(F.min("cover").alias("cover"))
    videos = rows.where(F.col("ext").isin(*O.VIDEO_EXTENSIONS)).withColumn("made", S.generated_thumbnail(F.col("path")))
    made = files.select(F.col("path").alias("made_path"))
    out = videos.join(best, F.col("stem") == F.col("of"), "left").join(made, F.col("made") == F.col("made_path"), "left")
    route = S.file_route(F.coalesce(F.col("cover.path"), F.col("made_path")), F.lit(src))
    return out.select("path", F.coalesce(route, F.lit(O.DEFAULT_VIDEO_THUMBNAIL)).alias("thumbnail_route"))


def directory_first_media(files: DataFrame) -> DataFrame:
    """(dir, path): the first medium of each directory's subtree, a directory's own files before its subdirectories, both by name.

    files (path), relative.  Every ancestor is a group, so the minimum is
    partially aggregated and no subtree is gathered.
    """
    ext = S.extension(F.col("path"))
    media = files.where(ext.isin(*O.IMAGE_EXTENSIONS, *O.VIDEO_EXTENSIONS)).withColumn("parts", F.split("path", "/"))
    spread = media.select("path", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("above"))
    rest = F.slice("parts", F.col("above") + 1, F.size("parts"))
    # at each level: files (0) before directories (1), then the name
    key = F.transform(rest, lambda part, i: F.struct((i < F.size(rest) - 1).cast("int").alias("kind"), part.alias("part")))
    directory = F.array_join(F.slice("parts", 1, F.col("above")), "/")
    return spread.select(directory.alias("dir"), key.alias("key"), "path").groupBy("dir").agg(F.min_by("path", "key").alias("path"))


def resolve_cover(item_type: Column, path: Column, folder_cover: Column, video_cover: Column, exists: Column) -> Column:
    """The cover route of an item by type; what no longer exists has the default."""
    return (
        F.when(~exists, O.DEFAULT_THUMBNAIL)
        .when(item_type == "folder", F.coalesce(folder_cover, F.lit(O.DEFAULT_THUMBNAIL)))
        .when(item_type == "image", S.file_route(path, F.lit("external")))
        .when(item_type == "video", F.coalesce(video_cover, F.lit(O.DEFAULT_VIDEO_THUMBNAIL)))
        .otherwise(O.DEFAULT_THUMBNAIL)
    )


def folder_links(items: DataFrame, folders: DataFrame, key: str = "id") -> DataFrame:
    """(item, folder_id, folder_name, rank): an item's distinct folders, named by id where unknown; rank 1.. by lower-case name, then as listed."""
    ids = items.select(F.col(key).alias("item"), F.posexplode(S.ordered_distinct(F.col("folders"))).alias("pos", "folder_id"))
    known = folders.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    name = F.coalesce(S._empty_to_null(F.col("_name")), F.col("folder_id"))
    named = ids.join(known, F.col("folder_id") == F.col("_id"), "left").select("item", "folder_id", name.alias("folder_name"), "pos")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.lower("folder_name"), "pos"))  # an item's folders
    return named.withColumn("rank", rank).drop("pos")


def folder_covers(folders: DataFrame, items: DataFrame) -> DataFrame:
    """Every folder with its first item by name; items (folder_id, item_id, name)."""
    first = items.groupBy("folder_id").agg(F.min_by("item_id", F.struct(F.coalesce("name", F.lit("")), "item_id")).alias("cover"))
    return folders.join(first, F.col("id") == F.col("folder_id"), "left").select("id", "name", "cover")


def bookmark_thumbnails(bookmarks: DataFrame, thumbnails: DataFrame, domains: tuple[str, ...] = O.SPECIAL_DOMAINS) -> DataFrame:
    """bookmarks (id, url, title, html) with media_id, thumbnail_route and sub_type.

    A stored cover (thumbnails: media_id, local_path) wins, then the YouTube
    template, then the page's og:image on special sites, else the default.
    sub_type is special only where such an image was found.
    """
    video = S.youtube_id(F.col("url"))
    special = P.special_site(F.col("url"), domains)
    og = S.html_unescape(S.og_image(F.col("html"))) if domains else F.lit(None).cast("string")
    keyed = bookmarks.withColumn("media_id", S.media_id(F.lit("bookmark"), F.col("url"), F.col("title")))
    held = thumbnails.select(F.col("media_id").alias("_id"), "local_path")
    out = keyed.join(held, F.col("media_id") == F.col("_id"), "left")
    found = F.coalesce(F.col("local_path"), S.youtube_thumbnail(video), F.when(special, og))
    return out.select(
        "id", "media_id", F.coalesce(found, F.lit(O.DEFAULT_THUMBNAIL)).alias("thumbnail_route"),
        F.when(P.is_youtube(F.col("url")), "youtube").when(special & og.isNotNull(), "special").alias("sub_type"),
    )


def store_thumbnails(fetched: DataFrame, folder: str) -> DataFrame:
    """fetched (media_id, bytes, content_type, url, source) -> (media_id, local_path, source), the files written below folder.

    folder: a URI that all executors reach.  The file is named by media_id and
    the type's extension; of equal names the last one written stays.  Rows
    without bytes write nothing and are left out.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for b in batches:
            for name, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                with files.open_output_stream(posixpath.join(base, name)) as out:
                    out.write(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{folder.rstrip('/')}/{n}" for n in b.column(1).to_pylist()], pa.string()), b.column(3)], ["media_id", "local_path", "source"])

    name = F.concat("media_id", F.lit("."), S.image_extension(F.col("content_type"), F.col("url")))
    held = fetched.where("length(bytes) > 0").select("media_id", name.alias("name"), "bytes", "source")
    return held.mapInArrow(write, "media_id string, local_path string, source string")


def registered(bookmarks: DataFrame, at: Column) -> DataFrame:
    """The media rows that bookmarks (url, title, folder_path) register: id, source, original_url, title, media_type, sub_type, extra, updated_at."""
    video = S.youtube_id(F.col("url"))
    extra = F.to_json(F.struct(F.coalesce("folder_path", F.lit("")).alias("folder_path")))
    return bookmarks.select(
        S.media_id(F.lit("bookmark"), F.col("url"), F.col("title")).alias("id"), F.lit("bookmark").alias("source"), F.col("url").alias("original_url"), "title",
        F.lit("bookmark").alias("media_type"), F.when(video != "", "youtube").alias("sub_type"), extra.alias("extra"), at.alias("updated_at"),
    )

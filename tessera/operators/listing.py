"""Listings: directories, searches, tags, folders, pages that are sorted again, entries and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import options as O
from tessera.errors import MediaNotFound
from tessera.functions import predicates as P
from tessera.functions import scalars as S


def directory_listing(listing: DataFrame, path: Column, src: str = "external") -> DataFrame:
    """Entries right below path: directories first, then images and videos, each in code point order of names."""
    name, ext = S.base_name(F.col("relative_path")), S.extension(F.col("relative_path"))
    kind = S.item_type(F.col("is_dir"), ext)
    rows = listing.where((S.dir_name(F.col("relative_path")) == path) & ~P.hidden(name)).withColumn("media_type", kind).where("media_type <> 'file'")
    place, source = F.col("relative_path"), F.lit(src)
    route = F.when(F.col("media_type") == "folder", S.folder_route(place, source)).when(F.col("media_type") == "image", S.image_route(place, source)).otherwise(S.video_route(place, source))
    return rows.select(
        "library_root", "relative_path", name.alias("name"), "media_type", route.alias("url"), F.when(F.col("media_type") != "folder", ext).alias("ext"),
        F.when(F.col("media_type") == "folder", 0).otherwise(1).alias("rank"),
    ).orderBy("library_root", "rank", "name")


def page_then_sort(items: DataFrame, by: str, key: str, limit: int = O.LIST_LIMIT, offset: int = 0, where: Column | None = None, name: str = "name") -> DataFrame:
    """Newest page first, then a filter on that page, then by name: the two sorts must not merge."""
    rows = items.orderBy(F.desc_nulls_last(by), F.col(key)).offset(max(0, offset)).limit(limit)
    if where is not None:
        rows = rows.where(where)
    return rows.orderBy(F.coalesce(F.col(name), F.lit("")), F.col(key))


def list_items(items: DataFrame, limit: int = O.LIST_LIMIT, offset: int = 0, order: str | None = None, keyword: str | None = None, ext: str | None = None,
               tags: list[str] | None = None, folders: list[str] | None = None) -> DataFrame:
    """The parameterised item scan; order: CREATEDATE, MODIFIEDDATE, FILESIZE, RESOLUTION (all descending) or NAME."""
    if keyword:
        items = items.where(P.keyword_hit(keyword, F.col("name"), F.col("tags")))
    if ext:
        items = items.where(F.col("ext") == ext)
    if tags:
        items = items.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if folders:
        items = items.where(F.arrays_overlap("folders", F.array(*map(F.lit, folders))))
    orders = {"CREATEDATE": [F.desc("created")], "MODIFIEDDATE": [F.desc("modified")], "FILESIZE": [F.desc("size")], "RESOLUTION": [F.desc("resolution")], "NAME": [F.asc("name")]}
    return items.orderBy(*orders.get(order or "", []), F.col("id")).offset(max(0, offset)).limit(limit)


def by_tag(items: DataFrame, tag: str, order: str = "created", limit: int = O.LIST_LIMIT) -> DataFrame:
    return items.where(F.array_contains("tags", tag)).orderBy(F.desc(order), F.col("id")).limit(limit)


def by_folder(items: DataFrame, folder: str, limit: int = O.LIST_LIMIT) -> DataFrame:
    return items.where(F.array_contains("folders", folder)).orderBy("id").limit(limit)


def search(items: DataFrame, keyword: str, limit: int = O.SEARCH_LIMIT) -> DataFrame:
    return items.where(P.keyword_hit(keyword, F.col("name"), F.col("tags"))).orderBy(F.desc("created"), F.col("id")).limit(limit)


def tag_counts(items: DataFrame) -> DataFrame:
    """(name, count) of the items' distinct trimmed tags, blanks left out, by lower-case name."""
    tags = items.select(F.explode(S.ordered_distinct(F.col("tags"))).alias("name"))
    return tags.groupBy("name").agg(F.count(F.lit(1)).alias("count")).orderBy(F.lower("name"), "name")


def coalesce_tag(entry: Column) -> tuple[Column, Column]:
    """(name, count) of a tag entry struct with aliased fields; absent fields must be null."""
    name = S._empty_to_null(S.trim_space(S.first_of(entry["name"], entry["tag"], entry["title"])))
    return name, S.first_count(entry["count"], entry["itemCount"], entry["itemsCount"], entry["childCount"])


def format_items(items: DataFrame, library: str) -> DataFrame:
    """Asset entries by name: paths below the library, cover by type; null or missing name and ext get defaults."""
    name, raw = F.coalesce("name", F.lit("unknown")), F.coalesce("ext", F.lit("jpg"))
    ext = F.lower(raw)
    folder = F.concat(F.lit(f"{library}/images/"), F.col("id").cast("string"), F.lit(".info/"), name)
    path = F.concat(folder, F.lit("."), raw)
    route = F.concat(F.lit("/serve_image/"), path)
    return items.select(
        "id", name.alias("name"), route.alias("url"),
        F.when(ext == "mp4", F.concat(F.lit("/serve_image/"), folder, F.lit("_thumbnail.png"))).otherwise(route).alias("thumbnail_route"),
        path.alias("item_path"), F.when(ext.isin(*O.VIDEO_EXTENSIONS), "video").otherwise("image").alias("media_type"), S._empty_to_null(ext).alias("ext"),
    ).orderBy("name", "id")


def with_detail(rows: DataFrame, return_to: str) -> DataFrame:
    """detail_url of images and videos with an id; others have none."""
    head = F.create_map(*[F.lit(x) for pair in O.DETAIL_ROUTES.items() for x in pair])[F.col("media_type")]
    known = F.col("id").isNotNull() & (F.col("id").cast("string") != "")
    return rows.withColumn("detail_url", F.when(known, F.concat(head, F.col("id").cast("string"), F.lit("/?return_to="), S.form_encode(F.lit(return_to)))))


def stream_page(items: DataFrame, limit: int = O.STREAM_DEFAULT, offset: int = 0, return_to: str = "/stream/") -> DataFrame:
    """Six fields of a page, newest first then by name, rows without id dropped; next_offset counts the rows fetched."""
    limit = max(1, min(O.STREAM_MOST, limit))
    got = page_then_sort(items, "created", "id", limit, offset)
    kept = got.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
    out = with_detail(kept, return_to).withColumn("next_offset", F.lit(max(0, offset)) + got.agg(F.count(F.lit(1))).scalar())
    return out.select("id", "name", "media_type", "thumbnail_route", "url", "detail_url", "next_offset")


def serialise(entries: DataFrame) -> DataFrame:
    """One JSON text per entry: null fields left out, path defaulting to url."""
    filled = entries.withColumn("path", F.coalesce("path", "url")) if "path" in entries.columns else entries.withColumn("path", F.col("url"))
    return filled.select(F.to_json(F.struct(*filled.columns)).alias("json"))


def viewer_rows(entries: DataFrame) -> DataFrame:
    """What the single view shows: no folders; download for what is no bookmark either."""
    return entries.where("media_type <> 'folder'").withColumn("download", F.col("media_type") != "bookmark")


def locale_sorted(rows: DataFrame, name: str = "name", ascending: bool = True) -> DataFrame:
    """Locale-aware order of lower-cased names, ties by name."""
    key = F.collate(F.lower(name), "UNICODE")
    return rows.orderBy(key.asc() if ascending else key.desc(), F.col(name))


def file_details(listing: DataFrame, src: str = "external") -> DataFrame:
    """The detail row of each image and video."""
    ext = S.extension(F.col("relative_path"))
    place, source, kind = F.col("relative_path"), F.lit(src), S.item_type(F.lit(False), ext)
    parent = S.dir_name(place)
    rows = listing.where(~F.col("is_dir") & kind.isin("image", "video"))
    absolute = F.concat("library_root", F.lit("/"), place)
    return rows.select(
        "library_root", S.base_name(place).alias("name"), "relative_path", S.file_route(absolute, source).alias("source_url"),
        F.when(kind == "image", S.image_route(place, source)).otherwise(S.video_route(place, source)).alias("url"),
        S.mime_type(ext, kind).alias("mime_type"), "size_bytes", S.human_size(F.col("size_bytes")).alias("size_display"),
        S.local_time(F.col("mtime")).alias("modified_time"), S.file_route(absolute, source).alias("download_url"),
        S.folder_route(parent, source).alias("parent_url"), F.when(parent != "", S.base_name(parent)).alias("folder_name"), kind.alias("media_type"), ext.alias("ext"),
    )


def file_detail(listing: DataFrame, path: str, kind: str, src: str = "external") -> DataFrame:
    """The one detail row at path; raises MediaNotFound unless it is of that kind."""
    row = file_details(listing.where(F.col("relative_path") == P.safe_relative(path)), src).where(F.col("media_type") == kind)
    if row.isEmpty():
        raise MediaNotFound(path)
    return row


def item_info(items: DataFrame, item_id: str, alias: str = "id") -> DataFrame:
    return items.where(F.col(alias) == item_id)


def first_existing(candidates: DataFrame, files: DataFrame, key: str = "id") -> DataFrame:
    """candidates (key, path, prio) that exist in files (path): the one of least prio for each key."""
    found = candidates.join(files.select("path").distinct(), "path", "left_semi")
    return found.groupBy(key).agg(F.min_by("path", F.struct("prio", "path")).alias("path"))


def rank_in(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank 1.. over a bounded page."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def asset_details(items: DataFrame, files: DataFrame, library: str, kind: str) -> DataFrame:
    """One detail row for each asset of that kind (video or image) whose file exists.

    items: id, name, ext, file_name, tags, folders, website, note, any null;
    files (path): absolute paths.  A video's file is sought as name.ext,
    file_name, id.ext, an image's with file_name first, and then as the first
    medium of that kind in the asset's directory.  A missing extension comes
    from file_name or the file found.
    """
    extensions = O.VIDEO_EXTENSIONS if kind == "video" else O.IMAGE_EXTENSIONS
    ident = F.col("id").cast("string")
    stated = S.first_of(F.regexp_replace(F.lower(F.coalesce("ext", F.lit(""))), r"^\.+", ""), S.extension(F.col("file_name")))
    rows = items.withColumn("ext", stated).where(F.col("ext").isNull() | F.col("ext").isin(*extensions))
    folder = F.concat(F.lit(f"{library}/images/"), ident, F.lit(".info/"))
    named = F.concat(S.first_of(F.col("name"), ident), F.lit("."), F.col("ext"))
    order = [named, F.col("file_name")] if kind == "video" else [F.col("file_name"), named]
    tries = F.array(*[F.struct(F.lit(k).alias("prio"), F.concat(folder, c).alias("path")) for k, c in enumerate([*order, F.concat(ident, F.lit("."), F.col("ext"))])])
    candidates = rows.select("id", F.explode(tries).alias("t")).select("id", "t.path", "t.prio").where("path IS NOT NULL")
    inside = files.where(S.extension(F.col("path")).isin(*extensions)).select(F.regexp_extract("path", r"/images/([^/]*)\.info/[^/]*$", 1).alias("of"), "path")
    covers = ~S.stem(F.col("path")).endswith("_thumbnail") if kind == "image" else F.lit(True)
    found_inside = rows.select("id", ident.alias("of")).join(inside.where(covers), "of").select("id", "path", F.lit(9).alias("prio"))
    found = first_existing(candidates.unionByName(found_inside), files).withColumnRenamed("id", "_id")
    thumb = files.where(S.extension(F.col("path")).isin(*O.IMAGE_EXTENSIONS) & S.stem(F.col("path")).endswith("_thumbnail"))
    place = F.array_position(F.array(*map(F.lit, O.IMAGE_EXTENSIONS)), S.extension(F.col("path")))
    thumb = thumb.select(F.regexp_replace(S.stem(F.col("path")), "_thumbnail$", "").alias("_stem"), F.struct(place.alias("prio"), "path").alias("cover"))
    thumb = thumb.groupBy("_stem").agg(F.min("cover").alias("cover"))
    out = rows.join(found, F.col("id") == F.col("_id")).join(thumb, S.stem(F.col("path")) == F.col("_stem"), "left")
    route = F.concat(F.lit("/serve_image/"), F.col("path"))
    own = F.lit(O.DEFAULT_VIDEO_THUMBNAIL) if kind == "video" else route
    return out.select(
        "id", S.first_of(F.col("name"), S.base_name(F.col("path"))).alias("name"), "path", route.alias("source_url"),
        F.coalesce(F.concat(F.lit("/serve_image/"), F.col("cover.path")), own).alias("thumbnail_route"),
        S.mime_type(F.coalesce("ext", S.extension(F.col("path"))), F.lit(kind)).alias("mime_type"), F.coalesce("ext", S.extension(F.col("path"))).alias("ext"),
        S.ordered_distinct(F.col("tags")).alias("tags"), S.ordered_distinct(F.col("folders")).alias("folders"), F.col("website").alias("original_url"), F.col("note").alias("description"),
    )


def panel(similar: Column, shown: int = 5) -> Column:
    """What the side panel shows of a similar list; the viewer shows all."""
    return F.slice(similar, 1, shown)

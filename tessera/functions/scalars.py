"""Scalar rules as Column -> Column functions, all JVM-side but HTML unescaping and path normalising."""

from __future__ import annotations

import html
import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import options as O

# The pattern of an OpenGraph image tag, the texts of a focus mode's summary, a cluster's title.
OG_IMAGE = r"""(?i)<meta[^>]+property=['"]og:image['"][^>]*content=['"]([^'"]+)"""

FOCUS_SUMMARY = ("🎯 {} 專注模式｜", "本層 %d / %d 筆，含子層 %d 筆", "，目前沒有符合的書籤")
FOCUS_COUNT = "%d 個專注書籤"
CLUSTER_TITLE = "%s 精選合集"


def _empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_space(c: Column) -> Column:
    """Strips all Unicode white space, unlike trim."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(slashes(path), r"[^/]*$", 0)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(slashes(path), r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name, leading dots aside; null if there is none."""
    return _empty_to_null(F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*\.([^.]*)$", 1)))


def stem(path: Column) -> Column:
    """The path without its extension and that dot."""
    return F.regexp_replace(path, r"(?<=[^./])\.[^./]*$", "")


def item_type(is_dir: Column, ext: Column) -> Column:
    return (
        F.when(is_dir, "folder").when(ext.isin(*O.IMAGE_EXTENSIONS), "image").when(ext.isin(*O.VIDEO_EXTENSIONS), "video").otherwise("file")
    )


def mime_type(ext: Column, kind: Column | None = None) -> Column:
    """From the fixed table; with kind, unknown images and videos get a type all the same."""
    known = F.create_map(*[F.lit(x) for pair in O.MIME_TYPES.items() for x in pair])[ext]
    if kind is None:
        return known
    return F.coalesce(known, F.when(kind == "video", "video/mp4").when(kind == "image", F.coalesce(F.concat(F.lit("image/"), ext), F.lit("image/jpeg"))))


def clean_tag(tag: Column) -> Column:
    return _empty_to_null(trim_space(F.regexp_replace(tag, "^#+", "")))


def stacked_tags(directory: Column) -> Column:
    """The cleaned # components of a relative directory, outer first."""
    parts = F.filter(F.split(slashes(directory), "/"), lambda p: p.startswith("#"))
    return F.filter(F.transform(parts, clean_tag), lambda t: t.isNotNull())


def source_kind(src: Column) -> Column:
    return F.when(src == "external", "external").otherwise("internal")


def human_size(size: Column, largest: str = "PB") -> Column:
    """Bytes below 1024 whole, else two decimals, half to even, in KB up to the largest unit, which has no upper bound."""
    units = ("KB", "MB", "GB", "TB", "PB")
    units = units[: units.index(largest) + 1]
    shown = [F.format_string(f"%.2f {unit}", F.bround(size / 1024.0**power, 2)) for power, unit in enumerate(units, 1)]
    out = shown[-1]
    for power in range(len(units) - 1, 0, -1):
        out = F.when(size / 1024.0**power < 1024, shown[power - 1]).otherwise(out)
    return F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def local_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def item_id(root: Column, relative_path: Column) -> Column:
    return F.sha1(F.concat(root, F.lit("::"), slashes(relative_path)))


def media_id(source: Column, url: Column, title: Column) -> Column:
    identifier = F.coalesce(_empty_to_null(url), _empty_to_null(title), F.lit("bookmark"))
    return F.sha1(F.concat(source, F.lit("|"), identifier))


def youtube_id(url: Column) -> Column:
    """The id of a watch or short URL; may be empty; null for other URLs."""
    watch = F.split_part(F.split_part(url, F.lit("v="), F.lit(2)), F.lit("&"), F.lit(1))
    short = F.split_part(F.split_part(url, F.lit("youtu.be/"), F.lit(2)), F.lit("?"), F.lit(1))
    return F.when(url.contains("youtube.com/watch") & url.contains("v="), watch).when(url.contains("youtu.be/"), short)


def youtube_thumbnail(video: Column) -> Column:
    head, tail = O.YOUTUBE_THUMBNAIL.split("{}")
    return F.when(video != "", F.concat(F.lit(head), video, F.lit(tail)))


def image_extension(content_type: Column, url: Column) -> Column:
    """From the content type, else the URL path, else jpg."""
    kind = F.lower(content_type)
    ext = extension(F.try_parse_url(url, F.lit("PATH")))
    by_url = F.when(ext == "jpeg", "jpg").when(ext.isin(*O.IMAGE_EXTENSIONS), ext).otherwise("jpg")
    return (
        F.when(kind.contains("jpeg") | kind.contains("jpg"), "jpg").when(kind.contains("png"), "png")
        .when(kind.contains("webp"), "webp").when(kind.contains("gif"), "gif").otherwise(by_url)
    )


def net_location(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def og_image(page: Column) -> Column:
    """The raw content of the first og:image tag that has its property first; null without one."""
    return _empty_to_null(F.regexp_extract(page, OG_IMAGE, 1))


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def normal_path(path: pd.Series) -> pd.Series:
    """Collapses . and .. components."""
    return path.map(posixpath.normpath, na_action="ignore")


def percent_encode(text: Column, colon: bool = False) -> Column:
    """Percent-encoding that leaves / alone, and : too if asked."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), *([("%3A", ":")] if colon else [])):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def form_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def file_route(path: Column, src: Column) -> Column:
    quoted = percent_encode(slashes(path), colon=True)
    return F.concat(F.when(src == "external", "/serve_image/").otherwise("/"), quoted)


def image_route(path: Column, src: Column) -> Column:
    return F.concat(F.lit("/image/"), percent_encode(slashes(F.coalesce(path, F.lit("")))), F.lit("?src="), source_kind(src))


def video_route(path: Column, src: Column) -> Column:
    return F.concat(F.lit("/video/"), percent_encode(slashes(path)), F.lit("?src="), source_kind(src))


def folder_route(path: Column, src: Column) -> Column:
    quoted = percent_encode(slashes(F.coalesce(path, F.lit(""))))
    outside = F.when(quoted != "", F.concat(F.lit("/both/"), quoted)).otherwise("/")
    inside = F.when(quoted != "", F.concat(F.lit("/both/"), quoted, F.lit("/?src=internal"))).otherwise("/?src=internal")
    return F.when(source_kind(src) == "external", outside).otherwise(inside)


def join_labels(labels: Column) -> Column:
    return F.array_join(F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != ""), " / ")


def encode_list(values: Column) -> Column:
    """A JSON list; null for null and empty lists."""
    return F.when(F.size(values) > 0, F.to_json(values))


def decode_list(text: Column) -> Column:
    """The strings of a JSON list; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def parse_flag(text: str | None) -> bool:
    return (text or "").strip().lower() in {"1", "true", "yes", "y"}


def parse_int(text: str | None, default: int) -> int:
    """A request parameter; absent: the default; anything but a whole number raises ValueError."""
    return default if text is None else int(text.strip())


def int_or_null(text: Column) -> Column:
    """Whole numbers of texts, with white space round them and a sign; null for anything else."""
    return F.when(trim_space(text).rlike(r"^[+-]?[0-9]+$"), trim_space(text)).try_cast("long")


def first_word(text: Column) -> Column:
    """The first token between white space; null for blank text."""
    return _empty_to_null(F.regexp_extract(text, r"(?U)^\s*(\S+)", 1))


def folder_title(name: Column) -> Column:
    return F.concat(F.lit("📁 "), name)


def focus_summary(label: str, matched: Column, total: Column, below: Column) -> Column:
    """What a folder page says of its active focus mode."""
    head, counts, none = FOCUS_SUMMARY
    return F.concat(F.lit(head.replace("{}", label)), F.format_string(counts, matched, total, below), F.when(matched == 0, none).otherwise(""))


def focus_count(matched: Column) -> Column:
    return F.format_string(FOCUS_COUNT, matched)


def cluster_title(prefix: Column) -> Column:
    return F.format_string(CLUSTER_TITLE, prefix)


def badge(media_type: Column, ext: Column) -> Column:
    return F.when(media_type == "folder", "📁 Folder").otherwise(F.upper(F.coalesce(_empty_to_null(ext), media_type)))


def generated_thumbnail(absolute_path: Column) -> Column:
    return F.concat(F.lit(f"{O.GENERATED_DIR}/"), F.sha1(absolute_path), F.lit(".jpg"))


def seek_second(duration: Column) -> Column:
    """Where a cover frame is taken: the middle, but second 1 at least; unknown length: second 1."""
    return F.greatest(F.coalesce(duration / 2, F.lit(1.0)), F.lit(1.0))


def first_of(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[_empty_to_null(c) for c in candidates])


def ordered_distinct(values: Column) -> Column:
    """Trimmed values without blanks, first occurrences in order."""
    trimmed = F.transform(values, trim_space)
    return F.coalesce(F.array_distinct(F.filter(trimmed, lambda v: v != "")), F.array().cast("array<string>"))


def first_count(*counts: Column) -> Column:
    """The first count that isn't null, 0 or empty, else the last; text that is no number: null."""
    falsy = lambda c: F.when(~c.cast("string").isin("0", "", "false"), c.cast("string"))
    return F.coalesce(*[falsy(c) for c in counts[:-1]], counts[-1].cast("string")).try_cast("long")

"""Row predicates as Columns."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import options as O
from tessera.errors import AccessDenied
from tessera.functions.scalars import join_labels, net_location, slashes, youtube_id


def hidden(name: Column) -> Column:
    return name.startswith(".")


def crawled(name: Column) -> Column:
    """Neither hidden nor a tag directory."""
    return ~name.rlike("^[.#]")


def tag_directory(directory: Column) -> Column:
    return F.regexp_extract(slashes(directory), r"[^/]*$", 0).startswith("#")


def is_media(item_type: Column) -> Column:
    return item_type.isin("image", "video")


def missing_thumbnail(route: Column) -> Column:
    return F.coalesce(route, F.lit("")) == ""


def is_youtube(url: Column) -> Column:
    return F.coalesce(youtube_id(url) != "", F.lit(False))


def special_site(url: Column, domains: tuple[str, ...] = O.SPECIAL_DOMAINS) -> Column:
    tokens = F.array(*[F.lit(d) for d in domains]).cast("array<string>")
    return F.coalesce(F.exists(tokens, lambda t: net_location(url).contains(t)), F.lit(False))


def keyword_hit(keyword: str, name: Column, tags: Column) -> Column:
    """Case-insensitive substring of the name or of a tag."""
    word = F.lit(keyword.lower())
    return F.lower(name).contains(word) | F.exists(tags, lambda t: F.lower(t).contains(word))


def focus_match(mode: Column, name: Column, url: Column, labels: Column, description: Column | None = None) -> Column:
    """The focus predicate of a mode row (struct with keywords, folders, include_urls, exclude_keywords, exclude_urls).

    Excluded URLs and words win; then any of the kinds of terms that the mode
    has may hit; a mode without positive terms takes all.  Mode all takes all
    whatever its terms.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    path = F.lower(join_labels(F.coalesce(labels, F.array().cast("array<string>"))))
    parts = [low(name), *([low(description)] if description is not None else []), path]
    text = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")
    any_in = lambda terms, blob: F.exists(terms, lambda t: F.contains(blob, F.lower(t)))
    some = lambda terms: F.size(terms) > 0
    kinds = [(mode["keywords"], text), (mode["folders"], path), (mode["include_urls"], low(url))]
    hit, none = F.lit(False), F.lit(True)
    for terms, blob in kinds:
        hit, none = hit | any_in(terms, blob), none & ~some(terms)
    out = any_in(mode["exclude_urls"], low(url)) | any_in(mode["exclude_keywords"], text)
    return (mode["id"] == "all") | (~out & (none | hit))


def within_roots(path: Column, roots: list[str]) -> Column:
    out = F.lit(False)
    for root in roots:
        out = out | (path == root) | path.startswith(root.rstrip("/") + "/")
    return out


def safe_path(path: Column) -> Column:
    """A normalised relative path stays below its root: neither absolute nor beginning with .. ."""
    return ~(path.startswith("/") | (path == "..") | path.startswith("../"))


def safe_relative(path: str | None) -> str:
    """Checks a driver-side argument; raises AccessDenied if it leaves the root."""
    if not path:
        return ""
    normal = posixpath.normpath(path.replace("\\", "/"))
    if normal.startswith("/") or normal == ".." or normal.startswith("../"):
        raise AccessDenied(path)
    return "" if normal == "." else normal

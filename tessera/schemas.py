"""The canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(fields: str) -> T.StructType:
    """name type pairs, parsed without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


LISTING = _schema("library_root string, relative_path string, is_dir boolean, size_bytes long, mtime timestamp, readable boolean, present boolean")
ITEMS = _schema(
    "item_id string, name string, data_source string, item_type string, tags array<string>, actors array<string>, authors array<string>,"
    " face_ids array<string>, is_archived boolean, thumbnail_route string, region string, rating double, is_censored boolean, relative_path string,"
    " absolute_path string, library_root string, ext string, mime_type string, size_bytes long, created_at timestamp, updated_at timestamp"
)
MEDIA_ITEMS = _schema("id string, source string, original_url string, title string, media_type string, sub_type string, metadata map<string,string>, updated_at timestamp")
THUMBNAILS = _schema("media_id string, local_path string, fetched_at timestamp, source string")
ENTRY = _schema(
    "name string, url string, thumbnail_route string, media_type string, item_path string, path string, ext string, description string,"
    " folder_labels array<string>, path_display string, id string"
)
NODES = _schema("id string, parent_id string, root string, name string, type string, url string, pos array<int>, id_path array<string>, labels array<string>")
FOLDERS = _schema("id string, parent_id string, name string, pos int")
FOCUS_MODES = _schema(
    "id string, label string, description string, keywords array<string>, folders array<string>, include_urls array<string>,"
    " exclude_keywords array<string>, exclude_urls array<string>, pos int"
)

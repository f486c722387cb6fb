"""Limits, fixed lists and route templates; every operator takes them as arguments with these defaults."""

from __future__ import annotations

# Extension sets, default covers, templates and labels that results are made of.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp")
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm", "m4v")
DEFAULT_THUMBNAIL = "/static/default_thumbnail.svg"
DEFAULT_VIDEO_THUMBNAIL = "/static/default_video_thumbnail.svg"
YOUTUBE_THUMBNAIL = "https://img.youtube.com/vi/{}/hqdefault.jpg"
GENERATED_DIR = "data/thumbnails/items"
UNNAMED_FOLDER = "(未命名資料夾)"
#: What an unnamed root is called; others by their key.
ROOT_LABELS = {"bookmark_bar": "Bookmarks"}
BOOKMARK_ROOTS = ("bookmark_bar", "other", "synced", "mobile")
ALL_MODE = ("all", "全部書籤", "顯示所有 Chrome 書籤")
#: Sites whose cover comes from their page's OpenGraph tag; an option, none by default.
SPECIAL_DOMAINS: tuple[str, ...] = ()

# MIME types by extension, instead of a table that depends on the host.
MIME_TYPES = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm", "m4v": "video/x-m4v",
    "txt": "text/plain", "pdf": "application/pdf", "html": "text/html", "json": "application/json", "zip": "application/zip",
}

LIST_LIMIT = 200
SEARCH_LIMIT = 120
SIMILAR_CANDIDATES = 120
SIMILAR_LIMIT = 6
STREAM_DEFAULT, STREAM_MOST = 30, 60
PAGE_DEFAULT, PAGE_ROUTE_DEFAULT, PAGE_MOST = 500, 200, 1000
AVAILABILITY_SECONDS = 60
FOLDER_ROUTE = "/assets/folder/"
DETAIL_ROUTES = {"image": "/assets/image/", "video": "/assets/video/"}

"""Pages and images over HTTP, for callers that have no tables of them."""

from __future__ import annotations

import http.client
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PAGE_SECONDS, IMAGE_SECONDS = 6, 8


def fetch(urls: DataFrame, seconds: float = IMAGE_SECONDS) -> DataFrame:
    """urls (url) -> url, bytes, content_type, one row per row; null for null URLs and whatever isn't answered with status 200."""

    def get(url: str | None) -> tuple[bytes | None, str | None]:
        if not url or not url.startswith(("http://", "https://")):
            return None, None
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=seconds) as answer:
                return (answer.read(), answer.headers.get("Content-Type")) if answer.status == 200 else (None, None)
        except (OSError, ValueError, http.client.HTTPException, urllib.error.URLError):
            return None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b.column(0).to_pylist():
                data, kind = get(url)
                yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([data], pa.binary()), pa.array([kind], pa.string())], ["url", "bytes", "content_type"])

    return urls.select("url").mapInArrow(run, "url string, bytes binary, content_type string")

"""The asset manager's REST service as a data source, and its writes as merges of DataFrames."""

from __future__ import annotations

import contextlib
import functools
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera import options as O
from tessera.errors import ExternalServiceError, FeatureUnavailable
from tessera.operators.catalog import upsert_latest

_ITEMS = "id string, name string, ext string, tags array<string>, folders array<string>, url string, annotation string, size long, created timestamp, modified timestamp, pos long"


def request(base: str, endpoint: str, payload: dict | None = None, post: bool = False, seconds: float = 10) -> dict:
    """{"status", "data"} of a call; null parameters are left out, and whatever goes wrong is an error status."""
    payload = {k: v for k, v in (payload or {}).items() if v is not None}
    url, body = f"{base}{endpoint}", None
    if post:
        body = json.dumps(payload).encode()
    elif payload:
        url += "?" + urllib.parse.urlencode(payload, doseq=True)
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=seconds) as answer:
            return json.load(answer)
    except (OSError, ValueError, urllib.error.URLError) as error:
        return {"status": "error", "data": str(error)}


def data_of(answer: dict) -> object:
    if answer.get("status") != "success":
        raise ExternalServiceError(str(answer.get("data")))
    return answer.get("data")


class _Page(InputPartition):
    pass


class ItemReader(DataSourceReader):
    """Pages of a listing, one partition each.

    Options: base, limit (rows of a page), pages (how many; all without it),
    orderby, keyword, ext, tags, folders (comma-separated ids).  pos numbers the
    rows in the service's order.
    """

    def __init__(self, options: dict):
        self.base, self.size = options["base"], int(options.get("limit", O.LIST_LIMIT))
        self.pages = int(options["pages"]) if "pages" in options else None
        self.query = {name: options.get(k) for k, name in (("orderby", "orderBy"), ("keyword", "keyword"), ("ext", "ext"), ("tags", "tags"), ("folders", "folders"))}

    def rows(self, limit: int, offset: int) -> list[dict]:
        return data_of(request(self.base, "/api/item/list", {"limit": limit, "offset": offset, **self.query})) or []

    def last(self) -> int:
        """Pages that have rows, found by doubling and halving."""
        some = lambda page: bool(self.rows(1, page * self.size))
        if not some(0):
            return 0
        low, high = 0, 1
        while some(high):
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if some(mid) else (low, mid)
        return low + 1

    def partitions(self) -> list[InputPartition]:
        return [_Page(k) for k in range(self.last() if self.pages is None else self.pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        start = partition.value * self.size
        for k, item in enumerate(self.rows(self.size, start)):
            yield (*item_tuple(item), start + k)


def moment(value: object) -> datetime | None:
    """A time in milliseconds, or as ISO text; anything else is none."""
    with contextlib.suppress(ValueError, OverflowError, OSError):
        if isinstance(value, int | float) and not isinstance(value, bool):
            return datetime.fromtimestamp(value / 1000, UTC).replace(tzinfo=None)
        if isinstance(value, str) and value:
            return datetime.fromisoformat(value)
    return None


def item_tuple(item: dict) -> tuple:
    """A payload's fields with their aliases coalesced; lists keep first occurrences of trimmed values."""
    return (
        item.get("id"), item.get("name"), item.get("ext"), values_of(item.get("tags"), ("name", "tag")), values_of(item.get("folders") or item.get("folderId"), ("id", "folderId", "folder_id")),
        item.get("website") or item.get("url"), item.get("annotation") or item.get("note"), item.get("size"),
        moment(item.get("btime") or item.get("created") or item.get("modificationTime")), moment(item.get("lastModified") or item.get("mtime") or item.get("modified") or item.get("modificationTime")),
    )


def values_of(values: object, names: tuple[str, ...]) -> list[str]:
    """Strings of a list, a scalar or dicts with aliased names: trimmed, without blanks, first occurrences."""
    out: dict[str, None] = {}
    for value in values if isinstance(values, list) else [values]:
        if isinstance(value, dict):
            value = next((value[n] for n in names if value.get(n)), None)
        if value is not None and (text := str(value).strip()):
            out[text] = None
    return list(out)


class ItemSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_assets"

    def schema(self) -> str:
        return _ITEMS

    def reader(self, schema) -> ItemReader:
        return ItemReader(dict(self.options))


def read_items(spark: SparkSession, base: str, **options: str) -> DataFrame:
    spark.dataSource.register(ItemSource)
    return spark.read.format("tessera_assets").options(base=base, **options).load()


def folder_edges(folders: list[dict], parent: str | None = None) -> Iterator[tuple]:
    """(id, parent_id, name, pos) of a nested folder payload, in pre-order."""
    todo = [(f, parent, k) for k, f in reversed(list(enumerate(folders)))]
    while todo:
        folder, up, pos = todo.pop()
        yield folder.get("id"), up, folder.get("name"), pos
        todo += [(c, folder.get("id"), k) for k, c in reversed(list(enumerate(folder.get("children") or [])))]


def top_folders(folders: list[dict]) -> list[tuple]:
    """(id, name, url) of the folders of the first level."""
    return [(f.get("id"), f.get("name", "Unnamed Folder"), f"{O.FOLDER_ROUTE}{f.get('id')}/") for f in folders]


def folder_list(base: str, recent: bool = False) -> list[dict]:
    """The nested folders, or those used last."""
    return data_of(request(base, "/api/folder/listRecent" if recent else "/api/folder/list")) or []


def folder_table(spark: SparkSession, base: str) -> DataFrame:
    """id, parent_id, name, pos of all folders; none: an empty table with these columns."""
    return spark.createDataFrame(list(folder_edges(folder_list(base))), "id string, parent_id string, name string, pos int")


def tag_list(base: str) -> list:
    return data_of(request(base, "/api/tag/list")) or []


def application_info(base: str) -> dict:
    return data_of(request(base, "/api/application/info")) or {}


def library_info(base: str) -> dict:
    return data_of(request(base, "/api/library/info")) or {}


def library_path(base: str) -> str:
    """Where the current library lies; raises ExternalServiceError if the service doesn't say."""
    path = (library_info(base).get("library") or {}).get("path")
    if not path:
        raise ExternalServiceError("the service names no library path")
    return path


def item_info(base: str, item_id: str) -> dict:
    """An item's payload; services that don't know the first parameter are asked again by the other."""
    answer = request(base, "/api/item/info", {"itemId": item_id})
    return data_of(answer if answer.get("status") == "success" else request(base, "/api/item/info", {"id": item_id}))


def _post(base: str, endpoint: str, **payload: object) -> object:
    return data_of(request(base, endpoint, payload, post=True))


def create_folder(base: str, name: str) -> object:
    return _post(base, "/api/folder/create", folderName=name)


def rename_folder(base: str, folder_id: str, name: str) -> object:
    return _post(base, "/api/folder/rename", folderId=folder_id, newName=name)


def update_folder(base: str, folder_id: str, name: str | None = None, description: str | None = None, color: str | None = None) -> object:
    """Empty values change nothing."""
    return _post(base, "/api/folder/update", folderId=folder_id, newName=name or None, newDescription=description or None, newColor=color or None)


def add_from_url(base: str, url: str, folder_id: str | None = None, name: str | None = None, website: str | None = None, tags: list[str] | None = None) -> object:
    return _post(base, "/api/item/addFromURL", url=url, folderId=folder_id, name=name, website=website, tags=tags)


def add_from_urls(base: str, items: list[dict], folder_id: str | None = None) -> object:
    return _post(base, "/api/item/addFromURLs", items=items, folderId=folder_id)


def add_bookmark(base: str, url: str, name: str, tags: list[str] | None = None) -> object:
    return _post(base, "/api/item/addBookmark", url=url, name=name, tags=tags)


def update_item_tags(base: str, item_id: str, tags: list[str]) -> object:
    return _post(base, "/api/item/update", itemId=item_id, tags=tags)


def add_folders(folders: DataFrame, new: DataFrame) -> DataFrame:
    """Appends folders whose id is new."""
    return folders.unionByName(new.join(folders.select("id"), "id", "left_anti").select(*folders.columns))


def update_fields(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Changes (key, some columns) over rows; null and empty values change nothing, unknown keys are ignored."""
    names = [c for c in changes.columns if c != key]
    last = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in names])
    out = rows.join(last, F.col(key) == F.col("_key"), "left")
    for c in names:
        new = F.col(f"_{c}")
        truthy = new.isNotNull() & (F.size(new) > 0 if rows.schema[c].dataType.typeName() == "array" else new.cast("string") != "")
        out = out.withColumn(c, F.when(truthy, new).otherwise(F.col(c)))
    return out.select(*rows.columns)


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Adds items, the later of equal ids winning."""
    both = items.withColumn("_seq", F.lit(0)).unionByName(new.select(*items.columns).withColumn("_seq", F.lit(1)))
    return upsert_latest(both, "id", F.col("_seq")).drop("_seq")


class Availability:
    """Whether sources answer, asked again after a while."""

    def __init__(self, probes: dict[str, Callable[[], bool]], seconds: float = O.AVAILABILITY_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.probes, self.seconds, self.clock, self.known = probes, seconds, clock, {}

    def __call__(self, name: str) -> bool:
        at, value = self.known.get(name, (-1e18, False))
        if self.clock() - at >= self.seconds:
            value = bool(self.probes[name]())
            self.known[name] = (self.clock(), value)
        return value


def needs(feature: str, available: Availability) -> Callable:
    """Decorator: the function raises FeatureUnavailable while its source doesn't answer."""

    def gate(f: Callable) -> Callable:
        @functools.wraps(f)
        def gated(*args, **named):
            if not available(feature):
                raise FeatureUnavailable(feature)
            return f(*args, **named)

        return gated

    return gate

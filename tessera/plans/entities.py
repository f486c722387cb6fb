"""Catalog entities as views of the driver's tables: one expression text for Spark and for the SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = {
    "doc_id": "doc_id",
    "library_root": "concat('/lib', doc_id % 2)",
    "name": "CASE doc_id % 8 WHEN 0 THEN concat('file', doc_id, '.jpg') WHEN 1 THEN concat('File ', doc_id, '.PNG') WHEN 2 THEN concat('clip', doc_id, '.mp4')"
    " WHEN 3 THEN concat('clip', doc_id, '.WebM') WHEN 4 THEN concat('notes~', doc_id, '.txt') WHEN 5 THEN concat('noext', doc_id)"
    " WHEN 6 THEN concat('.hid', doc_id, '.gif') ELSE concat('dir', doc_id) END",
    "dir": "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('#', lang) WHEN 2 THEN concat(source, '/#', lang, '/##deep ') WHEN 3 THEN source"
    " ELSE concat('#', source, '/plain/#', lang) END",
    "is_dir": "doc_id % 8 = 7",
    "size_bytes": "CASE WHEN doc_id % 8 = 7 THEN NULL ELSE n_chars END",
}
_PATH = "CASE WHEN dir = '' THEN name ELSE concat(dir, '/', name) END AS relative_path"
_BOOKMARKS = {
    "id": "page_id",
    "url": "CASE page_id % 5 WHEN 0 THEN concat('https://www.youtube.com/watch?v=id', page_id, '&t=1') WHEN 1 THEN concat('https://youtu.be/s', page_id, '?x=1')"
    " WHEN 2 THEN 'https://www.youtube.com/watch?v=' ELSE url END",
    "title": "concat('Page ', page_id)",
    "html": "CASE WHEN page_id % 4 = 0 THEN concat('<META property=\"og:image\" content=\"http://img/', page_id, '?a=1&amp;b=2\">', html) ELSE html END",
}
_ITEMS = {
    "id": "p_partkey",
    "name": "p_name",
    "ext": "CASE p_size % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'MOV' WHEN 2 THEN 'png' ELSE 'jpg' END",
    "media_type": "CASE WHEN p_size % 4 < 2 THEN 'video' ELSE 'image' END",
    "created": "(p_partkey * 7919) % 100003",
    "modified": "(p_partkey * 104729) % 1299709",
    "size": "p_size",
    "type": "p_type",
    "brand": "p_brand",
    "folder_a": "concat('n', p_partkey % 25)",
    "folder_b": "concat('s', p_partkey % 40)",
}


def _columns(view: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in view.items()]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*_columns(_FILES)).selectExpr("*", _PATH)


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").selectExpr(*_columns(_BOOKMARKS))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr(*_columns(_ITEMS))
    return rows.withColumn("tags", F.array("type", "brand")).withColumn("folders", F.array("folder_a", "folder_b"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks below the folders of edges(); some have no URL."""
    return read(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS leaf_id", "concat('n', c_nationkey) AS node_id", "c_name AS name", "CASE WHEN c_acctbal >= 0 THEN concat('https://c/', c_custkey) END AS url",
        "c_mktsegment AS segment", "c_acctbal AS balance",
    )


def bookmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): a bookmark file's JSON text for each nation: its pages below the root, those with a video in a folder of their own."""
    video = "CASE WHEN contains(url, 'youtube.com/watch') AND contains(url, 'v=') THEN split_part(split_part(url, 'v=', 2), '&', 1) WHEN contains(url, 'youtu.be/') THEN split_part(split_part(url, 'youtu.be/', 2), '?', 1) ELSE '' END <> ''"
    node = F.struct("id", F.concat(F.lit("p"), "id").alias("key"), "title", "url")
    held = bookmarks(spark, sf_dir).withColumn("nk", F.col("id") % 25).withColumn("video", F.expr(video))
    made = lambda rows: F.transform(F.array_sort(rows), lambda x: F.struct(x["key"].alias("id"), x["title"].alias("name"), F.lit("url").alias("type"), x["url"].alias("url")))
    held = held.groupBy("nk").agg(made(F.collect_list(F.when(F.col("video"), node))).alias("videos"), made(F.collect_list(F.when(~F.col("video"), node))).alias("others"))
    held = held.join(read(spark, sf_dir, "nation"), F.col("nk") == F.col("n_nationkey"))
    folder = "named_struct('id', concat('n', nk, '-v'), 'name', 'Videos', 'type', 'folder', 'children', videos)"
    root = f"to_json(named_struct('id', concat('n', nk), 'name', n_name, 'type', 'folder', 'children', parse_json(concat('[', array_join(array_insert(transform(others, o -> to_json(o)), 1, to_json({folder})), ','), ']'))))"
    return held.selectExpr(f"concat('{{\"roots\": {{\"bookmark_bar\": ', {root}, '}}}}') AS value")


def stream_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr("event_id AS id", "concat('item ', event_id % 97) AS name", "event_type AS media_type", "ts AS created", "value AS rating")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = read(spark, sf_dir, "region").selectExpr("concat('r', r_regionkey) AS id", "CAST(NULL AS STRING) AS parent_id", "r_name AS name", "CAST(r_regionkey AS BIGINT) AS pos")
    mid = read(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent_id", "n_name AS name", "CAST(n_nationkey AS BIGINT) AS pos")
    low = read(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS id", "concat('n', s_nationkey) AS parent_id", "s_name AS name", "CAST(s_suppkey AS BIGINT) AS pos")
    return top.unionByName(mid).unionByName(low)


FILES_SQL = f"files AS (SELECT *, {_PATH} FROM (SELECT {', '.join(_columns(_FILES))} FROM documents))"
BOOKMARKS_SQL = f"bookmarks AS (SELECT {', '.join(_columns(_BOOKMARKS))} FROM pages)"
ITEMS_SQL = f"items AS (SELECT *, [type, brand] AS tags, [folder_a, folder_b] AS folders FROM (SELECT {', '.join(_columns(_ITEMS))} FROM part))"
LEAVES_SQL = """leaves AS (SELECT CAST(c_custkey AS VARCHAR) AS leaf_id, concat('n', c_nationkey) AS node_id, c_name AS name,
    CASE WHEN c_acctbal >= 0 THEN concat('https://c/', c_custkey) END AS url, c_mktsegment AS segment, c_acctbal AS balance FROM customer)"""
VIDEO_SQL = "CASE WHEN contains(url, 'youtube.com/watch') AND contains(url, 'v=') THEN split_part(split_part(url, 'v=', 2), '&', 1) WHEN contains(url, 'youtu.be/') THEN split_part(split_part(url, 'youtu.be/', 2), '?', 1) END"
NODES_SQL = f"""{BOOKMARKS_SQL}, own AS (SELECT *, id % 25 AS nk, coalesce({VIDEO_SQL}, '') <> '' AS video FROM bookmarks),
    placed AS (SELECT own.*, n_name, row_number() OVER (PARTITION BY nk, video ORDER BY id) AS n FROM own JOIN nation ON nk = n_nationkey),
    nodes AS (SELECT DISTINCT concat('n', nk) AS id, CAST(NULL AS VARCHAR) AS parent_id, 'bookmark_bar' AS root, n_name AS name, 'folder' AS type, CAST(NULL AS VARCHAR) AS url, '0' AS pos, n_name AS labels FROM placed
        UNION ALL SELECT DISTINCT concat('n', nk, '-v'), concat('n', nk), 'bookmark_bar', 'Videos', 'folder', NULL, '0/0', concat(n_name, ' / Videos') FROM placed
        UNION ALL SELECT concat('p', id), concat('n', nk, CASE WHEN video THEN '-v' ELSE '' END), 'bookmark_bar', title, 'url', url, CASE WHEN video THEN concat('0/0/', n - 1) ELSE concat('0/', n) END,
            concat(n_name, CASE WHEN video THEN ' / Videos' ELSE '' END, ' / ', title) FROM placed)"""
STREAM_SQL = "stream_items AS (SELECT event_id AS id, concat('item ', event_id % 97) AS name, event_type AS media_type, ts AS created, value AS rating FROM events)"
EDGES_SQL = """edges AS (
    SELECT concat('r', r_regionkey) AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, CAST(r_regionkey AS BIGINT) AS pos FROM region
    UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name, n_nationkey FROM nation
    UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), s_name, s_suppkey FROM supplier)"""
FLAT_SQL = (
    EDGES_SQL
    + """, flat AS (
    SELECT id, parent_id, name, '' AS parent_name, 0 AS depth, [pos] AS pos_path, [id] AS id_path, [name] AS names FROM edges WHERE parent_id IS NULL
    UNION ALL
    SELECT e.id, e.parent_id, e.name, f.name, f.depth + 1, list_append(f.pos_path, e.pos), list_append(f.id_path, e.id), list_append(f.names, e.name)
    FROM flat f JOIN edges e ON e.parent_id = f.id)"""
)

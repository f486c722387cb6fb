"""Bookmark files: nested JSON of unknown depth, flattened level by level from a VARIANT."""

from __future__ import annotations

import os
import platform

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import options as O
from tessera.errors import BookmarkError, BookmarkNotFound
from tessera.session import cut_lineage


def default_path() -> str:
    """Where the browser keeps its bookmarks on this platform."""
    home = os.path.expanduser("~")
    return {
        "Windows": os.path.join(home, "AppData/Local/Google/Chrome/User Data/Default/Bookmarks"),
        "Darwin": os.path.join(home, "Library/Application Support/Google/Chrome/Default/Bookmarks"),
    }.get(platform.system(), os.path.join(home, ".config/google-chrome/Default/Bookmarks"))


def read_nodes(spark: SparkSession, path: str, max_depth: int = 1000) -> DataFrame:
    """All nodes of a file: id, parent_id, root, name, type, url, pos (path of positions), id_path, labels.

    Raises BookmarkNotFound for a missing file, BookmarkError for bad JSON.
    """
    try:
        text = spark.read.text(path, wholetext=True)
        trees = text.select(F.try_parse_json("value").alias("tree"))
        if trees.where("tree IS NULL").limit(1).count():
            raise BookmarkError(f"not JSON: {path}")
    except AnalysisException as error:
        raise BookmarkNotFound(path) from error
    except PySparkException as error:
        raise BookmarkError(path) from error
    return nodes_of(trees, max_depth)


def nodes_of(trees: DataFrame, max_depth: int = 1000) -> DataFrame:
    """trees (tree VARIANT) -> nodes; see read_nodes."""
    roots = None
    for key in O.BOOKMARK_ROOTS:
        title = O.ROOT_LABELS.get(key, key)
        one = trees.select(F.lit(key).alias("root"), F.expr(f"variant_get(tree, '$.roots.{key}', 'variant')").alias("node"), F.lit(title).alias("title"))
        roots = one if roots is None else roots.unionByName(one)
    text = lambda path: F.expr(f"try_variant_get(node, '$.{path}', 'string')")
    fields = [text("id").alias("id"), text("name").alias("name"), text("type").alias("type"), text("url").alias("url")]
    unnamed = F.when(F.col("type") == "folder", O.UNNAMED_FOLDER).otherwise(F.col("url"))
    label = F.coalesce(F.nullif("name", F.lit("")), unnamed)
    level = roots.where("node IS NOT NULL").select("root", "node", "title", *fields).select(
        "node", "id", F.lit(None).cast("string").alias("parent_id"), "root", "name", "type", "url", F.array(F.lit(0)).alias("pos"),
        F.array("id").alias("id_path"), F.array(F.coalesce(F.nullif("name", F.lit("")), "title")).alias("labels"),
    )
    level = cut_lineage(level)
    out, depth = level.drop("node"), 0
    while depth < max_depth and not level.isEmpty():
        depth += 1
        children = level.sparkSession.sql(
            "SELECT l.id AS up_id, l.root, l.pos AS up_pos, l.id_path AS up_ids, l.labels AS up_labels, c.pos AS child_pos, c.value AS node"
            " FROM {level} l, LATERAL variant_explode(variant_get(l.node, '$.children', 'variant')) AS c",
            level=level,
        )
        level = children.select("up_id", "root", "up_pos", "up_ids", "up_labels", "child_pos", "node", *fields).select(
            "node", "id", F.col("up_id").alias("parent_id"), "root", "name", "type", "url", F.concat("up_pos", F.array("child_pos")).alias("pos"),
            F.concat("up_ids", F.array("id")).alias("id_path"), F.concat("up_labels", F.array(label)).alias("labels"),
        )
        level = cut_lineage(level)
        out = out.unionByName(level.drop("node"))
    return out

"""Trees given as edges or as flattened nodes that carry their path.

Levels are joined one by one, so depth, not size, sets the number of rounds;
each level is written before the next one joins it, so none is computed again.
Cycles end at max_depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import options as O
from tessera.errors import BookmarkNotFound
from tessera.functions import predicates as P
from tessera.functions import scalars as S
from tessera.session import cut_lineage


def flatten(edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """edges (id, parent_id, name, pos) -> id, parent_id, name, parent_name, depth, pos_path, id_path, names.

    Roots have a null parent_id and parent_name ''.  pos_path orders the rows
    in pre-order; paths run from the root to the node.
    """
    level = cut_lineage(edges.where("parent_id IS NULL").select(
        "id", "parent_id", "name", F.lit("").alias("parent_name"), F.lit(0).alias("depth"), F.array("pos").alias("pos_path"), F.array("id").alias("id_path"), F.array("name").alias("names")
    ))
    out, depth = level, 0
    child = edges.select(F.col("id").alias("c_id"), F.col("parent_id").alias("c_parent"), F.col("name").alias("c_name"), F.col("pos").alias("c_pos"))
    while depth < max_depth and not level.isEmpty():
        depth += 1
        level = cut_lineage(level.join(child, F.col("id") == F.col("c_parent")).select(
            F.col("c_id").alias("id"), F.col("c_parent").alias("parent_id"), F.col("c_name").alias("name"), F.col("name").alias("parent_name"), F.lit(depth).alias("depth"),
            F.concat("pos_path", F.array("c_pos")).alias("pos_path"), F.concat("id_path", F.array("c_id")).alias("id_path"), F.concat("names", F.array("c_name")).alias("names"),
        ))
        out = out.unionByName(level)
    return out


def ancestors(flat: DataFrame) -> DataFrame:
    """flat -> (id, ancestor_id, steps), the node itself at 0 steps."""
    up = F.posexplode(F.reverse("id_path")).alias("steps", "ancestor_id")
    return flat.select("id", up).select("id", "ancestor_id", "steps")


def breadcrumb(flat: DataFrame, unnamed: str = O.UNNAMED_FOLDER, base: str = "/bookmarks/") -> DataFrame:
    """Labels, joined label and route of each node; blank names get the fallback."""
    labels = F.transform("names", lambda n: F.coalesce(S._empty_to_null(n), F.lit(unnamed)))
    path = F.array_join(F.transform("id_path", lambda i: i.cast("string")), "/")
    return flat.select("id", labels.alias("labels"), S.join_labels(labels).alias("path_display"), F.concat(F.lit(base), S.percent_encode(path)).alias("url"))


def resolve(flat: DataFrame, id_path: list, is_folder: Column | None = None) -> DataFrame:
    """The node at the path of ids; raises BookmarkNotFound if there is none, or if it or a node above it is no folder.

    is_folder: by type, where flat has one; else all nodes are folders.
    """
    row = flat.where(F.col("id_path") == F.array(*map(F.lit, id_path)))
    if is_folder is not None:
        above = [F.array(*map(F.lit, id_path[: k + 1])) for k in range(len(id_path))]
        others = flat.where(~F.coalesce(is_folder, F.lit(False)) & F.col("id_path").isin(*above)).select("id")
        row = row.where(others.agg(F.count(F.lit(1))).scalar() == 0)
    if row.isEmpty():
        raise BookmarkNotFound("/".join(map(str, id_path)))
    return row


def rollup(flat: DataFrame, leaves: DataFrame, matched: Column) -> DataFrame:
    """leaves (node_id, ...) counted at every ancestor of their node: (id, total, matched); folders without leaves have 0.

    Leaves are counted by node before they spread to ancestors, so a node with
    a third of all leaves moves as one row.
    """
    own = leaves.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(matched).alias("m"))
    spread = own.join(ancestors(flat), "id").groupBy(F.col("ancestor_id").alias("id")).agg(F.sum("n").alias("total"), F.sum("m").alias("matched"))
    return flat.select("id").join(spread, "id", "left").select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("matched", F.lit(0)).alias("matched"))


def folder_view(flat: DataFrame, leaves: DataFrame, parent_id, matched: Column, active: bool = True) -> DataFrame:
    """Child folders with matches (all, without an active mode) and matching direct leaves; leaves without a URL count and show nowhere."""
    leaves = leaves.where(F.coalesce("url", F.lit("")) != "")
    counts = rollup(flat, leaves, matched)
    folders = flat.where(F.col("parent_id") == parent_id).join(counts, "id")
    if active:
        folders = folders.where("matched > 0")
    folders = folders.select("id", "name", F.lit("folder").alias("media_type"), F.col("matched").alias("n"), F.lit(0).alias("rank"))
    direct = leaves.where((F.col("node_id") == parent_id) & (matched if active else F.lit(True)))
    direct = direct.select(F.col("leaf_id").alias("id"), "name", F.lit("bookmark").alias("media_type"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("rank"))
    return folders.unionByName(direct)


def focus_stats(flat: DataFrame, leaves: DataFrame, parent_id, matched: Column, label: str | None = None) -> DataFrame:
    """One row: total and matched direct bookmarks, matched with subfolders, has_results, and with a mode's label the summary of it.

    Leaves without a URL count nowhere.
    """
    leaves = leaves.where(F.coalesce("url", F.lit("")) != "")
    below = flat.where(F.array_contains("id_path", parent_id)).select(F.col("id").alias("node_id"))
    hit = F.coalesce(matched, F.lit(False))
    direct = F.col("node_id") == parent_id
    counts = leaves.withColumn("hit", hit).join(below, "node_id").agg(
        F.count_if(direct).alias("total_bookmarks"), F.count_if(direct & F.col("hit")).alias("matched_bookmarks"), F.count_if("hit").alias("matched_including_subfolders")
    )
    counts = counts.withColumn("has_results", F.col("matched_bookmarks") > 0)
    if label is None:
        return counts
    return counts.withColumn("description", S.focus_summary(label, F.col("matched_bookmarks"), F.col("total_bookmarks"), F.col("matched_including_subfolders")))


def youtube_walk(nodes: DataFrame, repeat_root: bool = False) -> DataFrame:
    """Bookmarks with a YouTube id in root order, then pre-order, with their folder path.

    repeat_root writes the root's label twice, as older results have it.
    """
    order = F.array_position(F.array(*map(F.lit, O.BOOKMARK_ROOTS)), F.col("root"))
    labels = F.slice("labels", 1, F.greatest(F.size("labels") - 1, F.lit(0)))
    if repeat_root:
        labels = F.concat(F.slice("labels", 1, 1), labels)
    rows = nodes.where((F.col("type") == "url") & P.is_youtube(F.col("url")) & (order > 0))
    video = S.youtube_id(F.col("url"))
    return rows.select(
        "id", S.first_of(F.col("name"), F.col("url")).alias("name"), "url", video.alias("video_id"), S.youtube_thumbnail(video).alias("thumbnail_route"),
        S.join_labels(labels).alias("path_display"), order.alias("root_rank"), "pos",
    ).orderBy("root_rank", "pos")


def bookmark_leaves(nodes: DataFrame) -> DataFrame:
    """nodes -> leaves of the focus roll-up: leaf_id, node_id, name, url, labels (of their folders); bookmarks without a URL are none."""
    return nodes.where("type = 'url' AND url <> ''").select(
        F.col("id").alias("leaf_id"), F.col("parent_id").alias("node_id"), S.first_of(F.col("name"), F.col("url")).alias("name"), "url",
        F.slice("labels", 1, F.size("labels") - 1).alias("labels"), "pos",
    )


def child_cover(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(folder, child, first item in source order) for every child at any depth; items (folder_id, item_id, pos)."""
    first = items.groupBy("folder_id").agg(F.min_by("item_id", F.struct("pos", "item_id")).alias("cover"))
    return edges.where("parent_id IS NOT NULL").join(first, F.col("id") == F.col("folder_id"), "left").select("parent_id", "id", "name", "cover")


def ranked(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))

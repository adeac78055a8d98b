"""Folder trees, listings, restore roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def nodes(entries: DataFrame) -> DataFrame:
    """path, parent, name, is_folder, real, size: entries (path, is_folder, size) and ancestors that are missing."""
    made = entries.select(F.explode(paths.prefixes(F.col("path"))).alias("path")).distinct().select("path", F.lit(True).alias("is_folder"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("real"))
    have = entries.select("path", "is_folder", "size", F.lit(1).alias("real"))
    best = have.unionByName(made).groupBy("path").agg(F.max(F.struct("real", "is_folder", "size")).alias("x"))
    return best.select("path", paths.parent(F.col("path")).alias("parent"), paths.name(F.col("path")).alias("name"), "x.is_folder", (F.col("x.real") == 1).alias("real"), "x.size")


def folder_sizes(files: DataFrame) -> DataFrame:
    """folder, files, bytes: of all files below, at any depth; summed in the map side first."""
    rows = files.select(F.explode(paths.prefixes(F.col("path"))).alias("folder"), "size")
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def children(tree: DataFrame, folder: str, recursive: bool = False, search: str = "") -> DataFrame:
    """The listing of a folder: direct children, or all below it, with the search filter; folders first."""
    inside = F.col("path").startswith(folder + "/") if recursive else F.col("parent") == folder
    return tree.where(inside & paths.name_matches(F.col("path"), search)).orderBy("parent", F.desc("is_folder"), "name")


def lookup(tree: DataFrame, path: str) -> DataFrame:
    """The node of a path, or its deepest ancestor that is there."""
    split = path.replace("\\", "/").split("/")
    ways = ["/".join(split[:n]) for n in range(1, len(split) + 1)]
    return tree.where(F.col("path").isin(ways)).orderBy(F.desc(F.length("path"))).limit(1)


def summary(listing: DataFrame, selected=None) -> DataFrame:
    """Items and bytes of a listing, and of what is selected."""
    mark = F.lit(False) if selected is None else selected
    return listing.agg(
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"),
        F.count(F.when(mark, 1)).alias("selected_items"),
        F.coalesce(F.sum(F.when(mark, F.col("size"))), F.lit(0)).cast("long").alias("selected_bytes"),
    )


def selection_kind(selected: DataFrame) -> str:
    """none, file, files, folder, folders or both."""
    n = {r.is_folder: r["count"] for r in selected.groupBy("is_folder").count().collect()}
    files, folders = n.get(False, 0), n.get(True, 0)
    if files and folders:
        return "both"
    if folders:
        return "folder" if folders == 1 else "folders"
    return "none" if not files else "file" if files == 1 else "files"


def roots(folders: DataFrame) -> DataFrame:
    """path: folders that lie below no other. A folder given twice is an error."""
    twice = folders.groupBy("path").count().withColumn("path", F.when(F.col("count") > 1, F.raise_error(F.concat(F.lit("folder given twice: "), "path")).cast("string")).otherwise(F.col("path"))).select("path")
    below = twice.select("path", F.explode(paths.prefixes(F.col("path"))).alias("above")).where("above <> path")
    return twice.join(below.join(twice.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct(), "path", "left_anti")


def relative_restore(root_folders: DataFrame) -> bool:
    """Whether files are restored relative to their roots: one root, or roots with names that all differ."""
    n, names = root_folders.agg(F.count(F.lit(1)), F.countDistinct(paths.name(F.col("path")))).first()
    return n == 1 or names == n


def targets(files: DataFrame, root_folders: DataFrame, dest: str | None) -> DataFrame:
    """Adds target: where each file is restored. Without dest the old path; else below dest, relative to its
    root (under the root's name if there are several), or with its whole path where names of roots collide.

    Roots meet files by equality on the files' ancestors, not by comparing each with each."""
    if dest is None:
        return files.withColumn("target", F.col("path"))
    dest = dest.rstrip("/")
    if not relative_restore(root_folders):
        return files.withColumn("target", F.concat(F.lit(dest + "/"), paths.normal(F.col("path"))))
    several = root_folders.count() > 1
    above = files.select("path", F.explode(F.concat(paths.prefixes(F.col("path")), F.array("path"))).alias("root"))
    mine = above.join(root_folders.select(F.col("path").alias("root")), "root").groupBy("path").agg(F.min("root").alias("root"))
    rest = paths.relative(F.col("path"), F.col("root"))
    rest = F.concat_ws("/", paths.name(F.col("root")), rest) if several else rest
    return files.join(mine, "path", "left").withColumn("target", F.concat(F.lit(dest + "/"), F.when(F.col("root").isNull(), paths.normal(F.col("path"))).otherwise(rest))).drop("root")


def ignored(entries: DataFrame, globs: list[str], root: str = "") -> DataFrame:
    """Entries that no glob matches, by their path below root; a matching folder takes all below it along."""
    if not globs:
        return entries
    pattern = "|".join(f"(?:{paths.glob_regex(g)})" for g in globs)
    rel = F.substring("path", len(root) + 2, 1 << 30) if root else F.col("path")
    hit = F.exists(F.concat(paths.prefixes(rel), F.array(rel)), lambda p: p.rlike(pattern))
    return entries.where(~hit)

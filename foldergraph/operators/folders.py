"""Folder trees and guards: which folders are left alone."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.functions.text import ancestors, base_name, is_supported, normal_path, parent_path
from foldergraph.functions.values import GUARD_DEPTH, MIN_FILES
from foldergraph.operators.similarity import folder_coherence
from foldergraph.sources.shared import cut


def folder_counts(files: DataFrame) -> DataFrame:
    """path, file_count: files directly in each folder."""
    return files.groupBy(normal_path(F.col("parent_dir")).alias("path")).agg(F.count("*").alias("file_count"))


def folder_tree(files: DataFrame, root: str) -> DataFrame:
    """path, name, parent, depth, file_count of root and of every folder below it that holds files or lies above one that does."""
    counts = folder_counts(files).filter((F.col("path") == root) | F.col("path").startswith(root + "/"))
    above = root.count("/")
    all_paths = counts.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    all_paths = all_paths.filter((F.col("path") == root) | F.col("path").startswith(root + "/"))
    depth = F.size(F.split("path", "/")) - F.lit(1 + above)
    tree = all_paths.join(counts, "path", "left").select("path", base_name(F.col("path")).alias("name"), F.when(F.col("path") != root, parent_path(F.col("path"))).alias("parent"), depth.alias("depth"), F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"))
    return tree


def folder_trees(files: DataFrame, roots: DataFrame) -> DataFrame:
    """root, path, name, parent, depth, file_count: the trees of all roots(path) in one plan; a folder below two roots is in both trees."""
    counts = folder_counts(files)
    above = counts.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    own = above.join(roots.select(normal_path(F.col("path")).alias("root")).distinct(), "root")
    paths = own.select("root", F.explode(ancestors(F.col("path"))).alias("path")).filter((F.col("path") == F.col("root")) | F.col("path").startswith(F.concat("root", F.lit("/")))).distinct()
    depth = F.size(F.split("path", "/")) - F.size(F.split("root", "/"))
    parent = F.when(F.col("path") != F.col("root"), parent_path(F.col("path")))
    return paths.join(counts, "path", "left").select("root", "path", base_name(F.col("path")).alias("name"), parent.alias("parent"), depth.alias("depth"), F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"))


def subtree_counts(tree: DataFrame) -> DataFrame:
    """path, n_folders: folders at and below each folder of the tree."""
    up = tree.select(F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.count("*").alias("n_folders"))
    return up.join(tree.select("path"), "path", "left_semi")


def guarded_paths(guards: DataFrame) -> DataFrame:
    return guards.filter("guarded").select("path").distinct()


def under_guard(rows: DataFrame, guards: DataFrame, path: str = "parent_dir", guarded: bool = False, below: bool = False) -> DataFrame:
    """Rows whose folder is (guarded=True) or isn't at or below a guarded folder; below: strictly below only.

    Each distinct folder's ancestors are matched with the guards, so that no rows are compared pairwise.
    """
    folder = normal_path(F.col(path))
    up = rows.select(folder.alias("_folder")).distinct().select("_folder", F.explode(ancestors(F.col("_folder"))).alias("_up"))
    if below:
        up = up.filter("_up <> _folder")
    hit = up.join(guarded_paths(guards).select(F.col("path").alias("_up")), "_up", "left_semi").select("_folder").distinct()
    return rows.withColumn("_folder", folder).join(hit, "_folder", "left_semi" if guarded else "left_anti").drop("_folder")


def escalate_guards(tree: DataFrame, guards: DataFrame) -> DataFrame:
    """path, reason of empty folders that become guarded because every child is: from the bottom up.

    An unguarded folder with files, or one without children, blocks: each folder above it, up to its nearest guarded ancestor,
    stays open. All other empty unguarded folders with children are guarded.
    """
    own = guarded_paths(guards).withColumn("g", F.lit(True))
    state = tree.join(own, "path", "left").withColumn("g", F.coalesce("g", F.lit(False)))
    parents = tree.select(F.col("parent").alias("path")).distinct().withColumn("has_child", F.lit(True))
    state = state.join(parents, "path", "left").withColumn("has_child", F.coalesce("has_child", F.lit(False)))
    blockers = state.filter(~F.col("g") & ((F.col("file_count") > 0) | ~F.col("has_child"))).select("path")
    up = blockers.select(F.col("path").alias("blocker"), F.posexplode(ancestors(F.col("path"))).alias("at", "up"))
    nearest = up.join(own.select(F.col("path").alias("up")), "up").groupBy("blocker").agg(F.max("at").alias("stop"))
    still_open = up.join(nearest, "blocker", "left").filter(F.col("at") > F.coalesce("stop", F.lit(-1))).select(F.col("up").alias("path")).distinct()
    out = state.filter(~F.col("g") & F.col("has_child") & (F.col("file_count") == 0)).join(still_open, "path", "left_anti")
    return out.select("path", F.lit("All subfolders are guarded").alias("reason"))


Classifier = Callable[[DataFrame], DataFrame]


def walk_guards(tree: DataFrame, known: DataFrame, classify: Classifier, depth: int = GUARD_DEPTH) -> DataFrame:
    """path, guarded, how, reason for each folder that the walk from the root's children down meets, a level at a time.

    how: known (told by known(path, guarded, source): guarded, or the user's decision), classified, failed (the classifier gave no
    verdict, the folder is open) or too deep (the level below `depth`: guarded, without being asked about). classify gets the folders
    of a level that must be judged, with the tree's columns, and returns path, guarded, and reason and failed where it has them; a
    guarded folder ends its branch, so nothing below one is classified. Every level is written before the next begins, so that no folder
    is asked about twice. Repeated paths count once; of a path known twice the user's row counts, then a guarded one.
    """
    best = F.max_by(F.struct("guarded", F.col("source").eqNullSafe("user").alias("by_user")), F.struct(F.col("source").eqNullSafe("user"), "guarded"))
    told = known.filter("path IS NOT NULL").groupBy("path").agg(best.alias("k")).filter("k.by_user OR k.guarded").select("path", F.col("k.guarded").alias("told"))
    tree = tree.dropDuplicates(["path"])
    frontier, out = tree.filter("depth = 1"), []
    for level in range(1, depth + 1):
        met = cut(frontier.join(told, "path", "left"), "frontier")
        judged = classify(met.filter("told IS NULL").drop("told")).dropDuplicates(["path"])
        verdict = {c: F.col(c) if c in judged.columns else F.lit(None).cast(kind) for c, kind in (("reason", "string"), ("failed", "boolean"))}
        judged = judged.select("path", F.coalesce("guarded", F.lit(False)).alias("guarded"), verdict["reason"].alias("reason"), (F.coalesce(verdict["failed"], F.lit(False)) | F.col("guarded").isNull()).alias("failed"))
        rows = met.select("path", "told").join(judged, "path", "left")
        how = F.when(F.col("told").isNotNull(), "known").when(F.coalesce("failed", F.lit(True)), "failed").otherwise("classified")
        step = cut(rows.select("path", F.coalesce("told", "guarded", F.lit(False)).alias("guarded"), how.alias("how"), F.when(F.col("told").isNull(), F.coalesce("reason", F.lit(""))).alias("reason")), "level")
        out.append(step)
        frontier = tree.filter(F.col("depth") == level + 1).join(step.filter("NOT guarded").select(F.col("path").alias("parent")), "parent", "left_semi")
    out.append(frontier.select("path", F.lit(True).alias("guarded"), F.lit("too deep").alias("how"), F.lit(None).cast("string").alias("reason")))
    return functools.reduce(DataFrame.unionByName, out)


def propagate_guards(tree: DataFrame, known: DataFrame, classify: Column, depth: int = GUARD_DEPTH) -> DataFrame:
    """path, guarded, reason (known, classified or too deep) of walk_guards() where a boolean column over the tree is the classifier."""
    walked = walk_guards(tree, known, lambda folders: folders.select("path", F.coalesce(classify, F.lit(False)).alias("guarded")), depth)
    return walked.select("path", "guarded", F.col("how").alias("reason"))


def coherent_folders(files: DataFrame, keywords: DataFrame, least: int = MIN_FILES) -> Classifier:
    """A classifier that asks no model: a folder is guarded if its own files(file_id, folder) are coherent; one of fewer than `least` isn't."""

    def classify(folders: DataFrame) -> DataFrame:
        own = files.withColumn("folder", normal_path(F.col("folder"))).join(folders.select(F.col("path").alias("folder")), "folder", "left_semi")
        found = folder_coherence(own, keywords, least=least).select(F.col("folder").alias("path"), "coherent", "coherence")
        said = F.coalesce(F.concat(F.lit("coherence "), F.round("coherence", 3).cast("string")), F.lit("few files"))
        return folders.select("path").join(found, "path", "left").select("path", F.coalesce("coherent", F.lit(False)).alias("guarded"), said.alias("reason"))

    return classify


def stored_guards(known: DataFrame, walked: DataFrame) -> DataFrame:
    """The next snapshot of guards(path, guarded, reason, source) after walk_guards() or propagate_guards(): what was classified is stored,
    rows strictly below a guarded folder go; folders that are only too deep, or whose classification failed, are not stored."""
    how = "how" if "how" in walked.columns else "reason"
    new = walked.filter(F.col(how) == "classified").select("path", "guarded", "reason", F.lit("llm").alias("source"))
    rest = known.select("path", "guarded", "reason", "source").join(new.select("path"), "path", "left_anti")
    ends = walked.filter(F.col("guarded") & (F.col(how) != "too deep")).select("path", "guarded")
    return under_guard(rest.unionByName(new), ends, "path", below=True)


def decide_guards(guards: DataFrame, decisions: DataFrame) -> DataFrame:
    """guards(path, guarded, reason, source) after the user's decisions(path, guarded, decided_at): the newest wins; a guarded folder's
    rows below it go."""
    newest = Window.partitionBy("path").orderBy(F.col("decided_at").desc(), F.col("guarded").desc())
    last = decisions.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    new = last.select("path", "guarded", F.lit("user decision").alias("reason"), F.lit("user").alias("source"))
    rest = guards.join(new.select("path"), "path", "left_anti").select("path", "guarded", "reason", "source")
    return under_guard(rest, new, "path", below=True).unionByName(new)


def needs_extraction(files: DataFrame, guards: DataFrame) -> DataFrame:
    """Files of unguarded folders whose text can and should be extracted."""
    ready = files.filter(F.col("processing_status").isin("unprocessed", "stale", "failed") & is_supported(F.col("extension")))
    return under_guard(ready, guards)

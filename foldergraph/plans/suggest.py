"""Folder suggestions end to end: guards, profiles, coherence, orphans, clusters, names and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldergraph.functions.values import MAX_FILES, MIN_FILES, MIN_SIMILARITY, SUB_STEP
from foldergraph.operators import clusters as cl
from foldergraph.operators.folders import under_guard
from foldergraph.operators.keywords import merged_entries, profiles, tfidf
from foldergraph.operators.similarity import folder_coherence, orphan_files, profile_classes, profile_sums, similar_links
from foldergraph.operators.vectors import cluster_cohesion, dbscan
from foldergraph.sources.shared import cut
from foldergraph.sources.snapshots import Snapshots, dealt_by


def orphaned(files: DataFrame, guards: DataFrame, roots: list[str], least_files: int = MIN_FILES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orphan files, keyword profiles and list entries of all unguarded files): what a suggestion run starts from.

    Guards are looked up once, without contents; these are read once, for the entries, and all else goes on without them.
    """
    narrow = cut(under_guard(files.drop("content"), guards).withColumn("folder", F.col("parent_dir")), "files")
    entries, keywords = profiles(merged_entries(narrow, contents=files), narrow)
    folders = folder_coherence(narrow.select("file_id", "folder"), keywords, least=least_files)
    ids = orphan_files(narrow.select("file_id", "folder"), folders, roots)
    return cut(narrow.join(ids, "file_id", "left_semi"), "orphans"), keywords, entries


def suggest_folders(files: DataFrame, guards: DataFrame, roots: list[str], min_similarity: float = MIN_SIMILARITY, min_files: int = MIN_FILES, max_files: int = MAX_FILES) -> DataFrame:
    """rank, cluster_id, name, terms, preview, n_files, score of suggested folders over active files(file_id, name, extension, parent_dir, content)."""
    orphans, keywords, entries = orphaned(files, guards, roots, min_files)
    classes = cut(profile_classes(keywords.join(orphans.select("file_id"), "file_id", "left_semi")), "classes")
    found = cut(cl.class_clusters(classes, similar_links(classes, min_similarity), min_files), "clusters")
    found = cut(cl.subclusters(classes, found, max_files, min_similarity + SUB_STEP, min_files), "clusters")
    members = classes.select("file_id", "class_id").join(found.select("class_id", "cluster_id"), "class_id").select("cluster_id", "file_id")
    names = cut(tfidf(entries.join(orphans.select("file_id"), "file_id", "left_semi"), orphans), "names", rows=entries.count())
    sizes = found.select("cluster_id", "n_files").distinct()
    out = sizes.join(cl.cluster_scores(found, profile_sums(classes, found, min_similarity)), "cluster_id").join(cl.cluster_terms(members, names), "cluster_id", "left").join(cl.cluster_preview(members, orphans), "cluster_id", "left")
    out = out.select("cluster_id", F.coalesce("name", F.lit("group")).alias("name"), F.coalesce("terms", F.lit("")).alias("terms"), "preview", "n_files", F.round("score", 6).alias("score"))
    return cl.ranked(out)


def suggest_by_vectors(vectors: DataFrame, eps: float, min_pts: int = 3) -> DataFrame:
    """rank, cluster_id, n_files, score of clusters of vectors(id, vec)."""
    members = cut(dbscan(vectors, eps, min_pts), "members")
    out = cluster_cohesion(members, vectors).select(F.col("cluster_no").alias("cluster_id"), "n_files", F.round("score", 6).alias("score"))
    return cl.ranked(out)


def saved_suggestions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(suggestions, members) as save_suggestions() left them."""
    saved = Snapshots(spark, folder)
    return saved.read("suggestions"), saved.read("suggestion_files")


def save_suggestions(suggestions: DataFrame, members: DataFrame, folder: str, min_files: int = MIN_FILES) -> None:
    """Replace the saved suggestions(cluster_id, n_files, ...) and their members(cluster_id, file_id) by those of at least min_files files;
    a file that is in a suggestion more than once is saved once. Both are replaced at once: a run that stops before its end leaves
    what was saved before."""
    keep = cut(suggestions.filter(F.col("n_files") >= min_files), "keep")
    own = members.join(keep.select("cluster_id"), "cluster_id", "left_semi").dropDuplicates(["cluster_id", "file_id"])
    Snapshots(keep.sparkSession, folder).commit({"suggestions": (keep, dealt_by("cluster_id")), "suggestion_files": (own, dealt_by("cluster_id"))})

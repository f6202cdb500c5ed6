"""Clusters of similar files: components, smaller pieces of large ones, scores, names, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.functions.values import MAX_FILES, MIN_FILES, MIN_SIMILARITY, SUB_STEP
from foldergraph.operators.components import connected_components
from foldergraph.operators.keywords import top_terms
from foldergraph.operators.similarity import similar_links
from foldergraph.operators.skew import global_rank, group_totals, salt
from foldergraph.sources.shared import cut


def class_clusters(classes: DataFrame, links: DataFrame, least_files: int = MIN_FILES) -> DataFrame:
    """class_id, class_size, cluster_id, n_files of components over links(id1, id2) with at least least_files files."""
    heads = classes.filter("file_id = class_id").select("class_id", "class_size")
    roots = connected_components(links.select(F.col("id1").alias("src"), F.col("id2").alias("dst"))).select(F.col("id").alias("class_id"), "component")
    rows = heads.join(roots, "class_id", "left").withColumn("cluster_id", F.coalesce("component", "class_id")).drop("component")
    rows = group_totals(rows.withColumn("_salt", salt(classes.sparkSession, "class_id")), ["cluster_id"], "_salt", n_files=("sum", "class_size"))
    return rows.filter(F.col("n_files") >= least_files).select("class_id", "class_size", "cluster_id", "n_files")


def subclusters(classes: DataFrame, clusters: DataFrame, most: int = MAX_FILES, least: float = MIN_SIMILARITY + SUB_STEP, least_files: int = MIN_FILES) -> DataFrame:
    """clusters with those of more than `most` files clustered again at a higher similarity; pieces that are too small go."""
    large = cut(clusters.filter(F.col("n_files") > most).select("class_id"), "large")
    if large.isEmpty():
        return clusters
    part = cut(classes.join(large, "class_id", "left_semi"), "part")
    return clusters.filter(F.col("n_files") <= most).unionByName(class_clusters(part, similar_links(part, least), least_files))


def pair_sums(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """cluster_id, total, k of profile_sums(), from the pairs of classes themselves."""
    side = lambda k: clusters.select(F.col("class_id").alias(f"id{k}"), F.col("cluster_id").alias(f"c{k}"))
    n = F.col("n1") * F.col("n2")
    return pairs.join(side(1), "id1").join(side(2), "id2").filter("c1 = c2").groupBy(F.col("c1").alias("cluster_id")).agg(F.sum(n * F.col("sim")).alias("total"), F.sum(n).alias("k"))


def cluster_scores(clusters: DataFrame, between: DataFrame) -> DataFrame:
    """cluster_id, score: the mean similarity of the file pairs that are near enough. between(cluster_id, total, k): sum and number of those
    of different classes; files of a class are pairs of similarity 1."""
    alike = F.col("class_size") * (F.col("class_size") - 1) / 2
    inside = clusters.groupBy("cluster_id").agg(F.sum(alike).alias("same"))
    rows = inside.join(between, "cluster_id", "left")
    pairs_n = F.coalesce("k", F.lit(0)) + F.col("same")
    return rows.select("cluster_id", F.when(pairs_n == 0, 0.0).otherwise((F.coalesce("total", F.lit(0.0)) + F.col("same")) / pairs_n).alias("score"))


def cluster_terms(members: DataFrame, keywords: DataFrame, n: int = 3) -> DataFrame:
    """cluster_id, terms (the n with the highest sum of scores, joined), name."""
    sums = members.join(keywords.select("file_id", "term", "score"), "file_id").groupBy("cluster_id", "term").agg(F.round(F.sum("score"), 9).alias("score"))
    best = top_terms(sums, n, "cluster_id").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    return best.select("cluster_id", F.array_join("t.term", ", ").alias("terms"), F.concat(F.col("t")[0]["term"], F.lit(" files")).alias("name"))


def cluster_preview(members: DataFrame, files: DataFrame, n: int = 5) -> DataFrame:
    """cluster_id, preview: names of the first n files by id."""
    first = Window.partitionBy("cluster_id").orderBy("file_id")
    head = members.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n)
    named = head.join(files.select("file_id", "name"), "file_id").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("p"))
    return named.select("cluster_id", F.array_join("p.name", ", ").alias("preview"))


def ranked(suggestions: DataFrame) -> DataFrame:
    """With rank from 1 by score, then size, then cluster_id."""
    rows = global_rank(suggestions, [F.col("score").desc(), F.col("n_files").desc(), "cluster_id"])
    return rows.withColumn("rank", (F.col("rank") + 1).cast("int"))

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldergraph.operators.skew import group_totals, salt
from foldergraph.sources.shared import cut, recut

#: Edges that a task goes through in memory once they have been counted.
TASK_EDGES = 1 << 22


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the smallest node around it."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    both = group_totals(both.withColumn("_salt", salt(edges.sparkSession, "v")), ["u"], "_salt", m=("min", "v"))
    return both.filter("v > u").select(F.col("v").alias("src"), F.least("u", "m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is hung on the smallest of them. edges: src > dst."""
    down = group_totals(edges.withColumn("_salt", salt(edges.sparkSession, "dst")), ["src"], "_salt", m=("min", "dst"))
    hung = down.select("src", F.col("m").alias("dst")).unionByName(down.filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")))
    return hung.distinct()


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that the edges link it with) for all nodes that aren't the smallest themselves."""
    ids, place = np.unique(np.r_[src, dst], return_inverse=True)
    a, b = place[: len(src)], place[len(src) :]
    label = np.arange(len(ids))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)  # labels are roots here: a root is hung on the smallest one that it meets
        while (label != label[label]).any():
            label = label[label]
    hung = np.flatnonzero(label != np.arange(len(ids)))
    return ids[hung], ids[label[hung]]


def _contracted(edges: DataFrame) -> DataFrame:
    """src, dst, part: the edges of each partition as stars around the smallest node of each of its pieces."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, new, size = np.zeros((2, 0), np.int64), [], 0
        for frame in frames:
            new.append(frame[["src", "dst"]].to_numpy(np.int64).T)
            size += len(frame)
            if size > max(1 << 20, have.shape[1]):  # so that stars aren't gone through for every frame
                have, new, size = np.stack(forest(*np.concatenate([have, *new], axis=1))), [], 0
        have = np.stack(forest(*np.concatenate([have, *new], axis=1)))
        yield pd.DataFrame({"src": have[0], "dst": have[1], "part": TaskContext.get().partitionId()})

    return edges.mapInPandas(run, "src long, dst long, part int")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (id, component): the smallest id reachable, for every id that has an edge to another id.

    ids are whole numbers. Null ends and self loops are left out, repeated and reversed edges do no harm; without edges the result is
    empty. First each task turns its edges into stars; what is left is counted and gone through again in tasks of about TASK_EDGES, so
    that a small graph is done then. A larger one goes on with alternating large and small stars, contracted in the tasks that make
    them. Each round writes its edges to the shared folder in place of the last one's; rounds end when one leaves the edges as they were.
    """
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst")
    edges = cut(_contracted(edges), "edges")
    count, parts = edges.agg(F.count("*"), F.count_distinct("part")).head()
    tasks = -(-count // TASK_EDGES)
    if parts > 1:
        edges = recut(_contracted(edges.coalesce(tasks)), edges, "edges")
    done, before = parts <= 1 or tasks == 1, None
    while not done:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).head()
        done, before = state == before, state
        if not done:
            edges = recut(_contracted(_small_star(_large_star(edges.select("src", "dst")))), edges, "edges")
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(edges.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())

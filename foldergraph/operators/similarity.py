"""Similarity of keyword profiles: pairs above a threshold, coherence of folders, files that don't fit theirs."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.functions.values import COHERENT, MIN_FILES, MIN_SIMILARITY
from foldergraph.operators.skew import group_totals, lookup, salt
from foldergraph.sources.shared import cut, slices

#: Profiles of a term that meet as many others in one group; rows of a group of rarer terms; pairs measured at once, and handed on.
POSTING, PACK, PRODUCT, MEASURED = 8192, 20000, 4096, 1 << 17
#: Rows of a term that are compared with all others of the term at once; a term of so many rows at most goes without bounds by columns.
WIDE, FEW = 64, 32
#: Columns of the bounds; numbers of a table of profiles by terms.
COLUMNS, TABLE = 126, 1 << 21


def unit_terms(keywords: DataFrame) -> DataFrame:
    """file_id, term, u: scores that aren't 0, divided by the length of the file's profile."""
    norm = F.sqrt(F.sum(F.col("score") * F.col("score")).over(Window.partitionBy("file_id")))
    return keywords.filter("score <> 0").select("file_id", "term", (F.col("score") / norm).alias("u"))


def profile_classes(keywords: DataFrame) -> DataFrame:
    """file_id, profile, class_id, class_size: files of one profile are one class, named by its smallest file_id."""
    profile = F.array_sort(F.collect_list(F.struct("term", "score")))  # at most TOP_PROFILE terms
    rows = keywords.filter("score <> 0").groupBy("file_id").agg(profile.alias("profile"))
    rows = rows.withColumn("_salt", salt(keywords.sparkSession, "file_id"))
    return group_totals(rows, ["profile"], "_salt", class_id=("min", "file_id"), class_size=("count", "*")).drop("_salt")


def _postings(classes: DataFrame, least: float, clusters: DataFrame | None = None) -> DataFrame:
    """pack, alone, b1, b2, own, t, file_id, n, cluster_id, k, h, w: a row for each term t of a class's profile on which it is matched.

    h and w are the whole profile, rarest terms first, as hashes of 64 bits and parts of the unit vector; k is the place of t in it. Two
    profiles with a cosine of at least the threshold have, from their rarest common term on, at least as much of their lengths, so only
    terms up to there are matched. With clusters(class_id, cluster_id) only profiles of a cluster meet. All rows that meet have one
    (pack, alone, b1, b2): a term of more than POSTING profiles is dealt to blocks, and each pair of blocks is a group of its own, the
    other terms are dealt to packs of about PACK rows. So rows grow with the profiles, and no pair is written. They are dealt by group.
    """
    spark = classes.sparkSession
    heads = classes.filter("file_id = class_id").select("file_id", "class_size", "profile")
    units = unit_terms(heads.select("file_id", F.explode("profile").alias("p")).select("file_id", "p.term", "p.score"))
    own = heads.select("file_id", F.col("class_size").alias("n"))
    if clusters is not None:
        own = own.join(clusters.select(F.col("class_id").alias("file_id"), "cluster_id"), "file_id")
    else:
        own = own.withColumn("cluster_id", F.lit(0).cast("long"))
    units = units.join(own, "file_id").select("file_id", "n", "cluster_id", F.xxhash64("cluster_id", "term").alias("h"), "u")
    units = group_totals(units.withColumn("_salt", salt(spark, "file_id")), ["h"], "_salt", df=("count", "*"))
    profile = F.array_sort(F.collect_list(F.struct("df", "h", "u"))).alias("p")
    profiles = cut(units.groupBy("file_id", "n", "cluster_id").agg(profile), "profiles")
    packs = (profiles.agg(F.sum(F.size("p"))).head()[0] or 0) // PACK + 1
    rows = profiles.select("*", F.posexplode("p").alias("k", "e"))
    rest = F.aggregate(F.slice("p", F.col("k") + 1, F.size("p")), F.lit(0.0), lambda a, x: a + x["u"] * x["u"])
    rows = rows.filter((F.col("e.df") > 1) & (F.sqrt(rest) >= least - 1e-9))
    rows = rows.withColumn("blocks", F.ceil(F.col("e.df") / POSTING).cast("int")).withColumn("own", F.pmod(F.xxhash64("file_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pack, alone = F.when(F.col("blocks") == 1, F.pmod("e.h", F.lit(packs))).alias("pack"), F.when(F.col("blocks") > 1, F.col("e.h")).alias("alone")
    rows = rows.select(pack, alone, F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", F.col("e.h").alias("t"), "file_id", "n", "cluster_id", "k", F.col("p.h").alias("h"), F.col("p.u").alias("w"))
    return rows.repartition(max(slices(spark), 2 * packs), *_GROUP)  # groups are few and unlike, so tasks of many would be unlike too


_GROUP = ("pack", "alone", "b1", "b2")


class _Group:
    """A group of _postings() as arrays, rows in order of their terms."""

    def __init__(self, frame: pd.DataFrame, least: float) -> None:
        frame = frame.sort_values(["t", "file_id"], kind="stable")
        self.least, self.ids, self.n = least, frame["file_id"].to_numpy(), frame["n"].to_numpy()
        self.cluster, self.k, self.t = frame["cluster_id"].to_numpy(), frame["k"].to_numpy(), frame["t"].to_numpy()
        b1, b2 = frame["b1"].iloc[0], frame["b2"].iloc[0]
        self.sides = None if b1 == b2 else (np.flatnonzero(frame["own"] == b1), np.flatnonzero(frame["own"] == b2))
        size = frame["h"].map(len).to_numpy()
        self.place = np.arange(size.max())
        there = self.place < size[:, None]
        _, code, times = np.unique(np.concatenate(frame["h"].to_numpy()), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1)
        self.terms = int(number[-1])  # numbered from 1; 0 is none, or a term that no other row has
        self.h, self.w = np.zeros(there.shape, np.int64), np.zeros(there.shape)
        self.h[there], self.w[there] = np.where(times > 1, number, 0)[code], np.concatenate(frame["w"].to_numpy())
        self.u = self.w[np.arange(len(frame)), self.k]
        self.after = np.sqrt((self.w * self.w * (self.place > self.k[:, None])).sum(1))
        self.held = max(1, min(WIDE, TABLE // (self.terms + 1)))
        self.table = np.zeros((self.held, self.terms + 1))

    def _columns(self, h: np.ndarray, shared: bool) -> tuple[np.ndarray, int, int]:
        """(the column of each of h, columns, how many of them one term has alone): 0 for terms that no two rows have. Most frequent terms
        have a column alone; where there are more than COLUMNS, the others share half of these if `shared`, and else have column 0."""
        term, code, times = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        order = order[(times[order] > 1) & (term[order] > 0)]
        alone = len(order) if len(order) <= COLUMNS else COLUMNS // 2 if shared else COLUMNS
        place = np.arange(len(order))
        column, width = np.zeros(len(term), np.int64), 1 + (COLUMNS if shared and alone < len(order) else alone)
        column[order] = 1 + np.where(place < alone, place, alone + (place - alone) % (COLUMNS - COLUMNS // 2) if shared else -1)
        return column[code.reshape(h.shape)], width, alone

    def _bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two vectors for each of the rows of a term t: the product of the first of one and the second of another is at least their cosine
        if t is their rarest common term, and may be far below 0 if it isn't.

        Terms after t that share a column count by their lengths. Rarer terms than t have a column alone, of opposite signs, or none.
        """
        later = self.place > self.k[rows][:, None]
        column, width, alone = self._columns(np.where(later, self.h[rows], 0), True)
        at = np.arange(len(rows))[:, None] * width + column
        x = np.sqrt(np.bincount(at.ravel(), (self.w[rows] ** 2).ravel(), len(rows) * width)).astype(np.float32)
        own = (column > 0) & (column <= alone)
        x[at[own]] = self.w[rows][own]
        x = x.reshape(-1, width)
        x[:, 0] = self.u[rows]
        column, width, _ = self._columns(np.where(self.place < self.k[rows][:, None], self.h[rows], 0), False)
        rarer = np.zeros((len(rows), width), np.float32)
        rarer[np.arange(len(rows))[:, None], column] = 8
        rarer = rarer[:, 1:]
        return np.hstack([x, rarer]), np.hstack([x, -rarer])

    def _blocks(self, i: np.ndarray, j: np.ndarray, apart: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of all of i with all of j, rows of one term, the pairs that may reach the threshold; if i is j, each once."""
        same = i is j
        x, y = self._bounds(i if same else np.r_[i, j])
        x, y = (x, y) if same else (x[: len(i)], y[len(i) :])
        for at, end in itertools.pairwise([0, 1, *range(1 + WIDE, len(i), WIDE), len(i)]):  # first the pairs of one row
            first = at if same else 0
            may = x[at:end] @ y[first:].T >= self.least - 1e-4
            if same:
                may &= np.arange(at, end)[:, None] < np.arange(first, len(j))
            if apart is not None:
                may &= apart(i[at:end], j[first:])
            a, b = np.nonzero(may)
            yield i[at + a], j[first + b]

    def candidates(self, apart: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that may reach the threshold, not too many at once, by the first row; with apart(i, j) -> matrix, of those alone."""
        if self.sides is not None:
            if all(map(len, self.sides)):
                yield from self._blocks(*self.sides, apart)
            return
        ends = np.flatnonzero(np.r_[self.t[1:] != self.t[:-1], True]) + 1
        begins = np.r_[0, ends[:-1]]
        few = np.repeat(ends - begins <= FEW, ends - begins)
        left, step, found = np.flatnonzero(few), 1, []
        while len(left := left[left + step < len(few)]):
            left = left[self.t[left] == self.t[left + step]]
            other = left + step
            may = self.u[left] * self.u[other] + self.after[left] * self.after[other] >= self.least - 1e-9
            found.append(np.stack([left[may], other[may]]))
            step += 1
        found = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        yield tuple(found[:, np.argsort(found[0], kind="stable")])
        for begin, end in zip(begins.tolist(), ends.tolist()):
            if end - begin > FEW:
                rows = np.arange(begin, end)
                yield from self._blocks(rows, rows, apart)

    def measured(self, i: np.ndarray, j: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, cosine) of those at least at the threshold; with `once`, of those alone whose rarest common term is t. i is in order."""
        sim, at = np.zeros(len(i)), 0
        while at < len(i):
            low = i[at]
            end = int(np.searchsorted(i, low + self.held))
            rows = slice(low, low + self.held)
            h, w = self.h[rows], self.w[rows]
            own = np.arange(len(h))[:, None]
            self.table[own, h] = np.where(self.place < self.k[rows][:, None], np.nan, w) if once else w  # a rarer term makes a pair none
            self.table[:, 0] = 0
            for a in range(at, end, PRODUCT):
                p, q = i[a : min(a + PRODUCT, end)] - low, j[a : min(a + PRODUCT, end)]
                there = self.table.ravel().take(self.h[q] + (p * self.table.shape[1])[:, None])
                sim[a : a + len(p)] = np.einsum("ij,ij->i", there, self.w[q])
            self.table[own, h] = 0
            at = end
        new = np.round(sim, 9) >= self.least  # not of NaN
        return i[new], j[new], sim[new]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, cosine) of every pair that reaches the threshold and whose rarest common term is t: each pair in one group, once."""
        for i, j in self.candidates():
            for at in range(0, len(i), MEASURED):
                yield self.measured(i[at : at + MEASURED], j[at : at + MEASURED], True)

    def links(self) -> np.ndarray:
        """id1, id2 of some of the pairs that reach the threshold, as many as connect all: those of one piece aren't measured."""
        ids, node = np.unique(self.ids, return_inverse=True)
        label, out = np.arange(len(ids)), []
        piece = label[node]
        for i, j in self.candidates(lambda i, j: piece[i][:, None] != piece[j]):
            for at in range(0, len(i), PRODUCT):
                a, b = i[at : at + PRODUCT], j[at : at + PRODUCT]
                apart = np.flatnonzero(piece[a] != piece[b])
                if not len(apart):
                    continue
                a, b, _ = self.measured(a[apart], b[apart], False)
                if not len(a):
                    continue
                _, first = np.unique(piece[a] * len(ids) + piece[b], return_index=True)  # of two pieces one pair says enough
                a, b = a[first], b[first]
                hung: dict[int, int] = {}  # of labels
                for x, y, p, q in zip(node[a].tolist(), node[b].tolist(), piece[a].tolist(), piece[b].tolist()):
                    while p in hung:
                        p = hung[p]
                    while q in hung:
                        q = hung[q]
                    if p != q:
                        hung[max(p, q)] = min(p, q)
                        out.append((x, y))
                label[list(hung)] = list(hung.values())
                while (label != (up := label[label])).any():
                    label = up
                piece = label[node]
        return np.sort(ids[np.array(out, np.int64).reshape(-1, 2)], axis=1)


def similar_pairs(classes: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """id1, id2, sim, n1, n2: pairs of classes with cosine of at least `least`; files of one class are alike and need no pair.

    Each pair comes from the group of its rarest common term, so nothing is brought together afterwards.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = _Group(pd.concat(frames), least)
        for i, j, sim in group.pairs():  # handed on by parts, as a group may have pairs by the million
            if len(i):
                turn = group.ids[i] > group.ids[j]
                i, j = np.where(turn, j, i), np.where(turn, i, j)
                yield pd.DataFrame({"id1": group.ids[i], "id2": group.ids[j], "sim": sim, "n1": group.n[i], "n2": group.n[j]})

    return _postings(classes, least).groupBy(*_GROUP).applyInPandas(run, "id1 long, id2 long, sim double, n1 long, n2 long")


def similar_links(classes: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """id1, id2: some of similar_pairs(), as many as connect all that they connect, and at most as many as rows of _postings()."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_Group(frame, least).links(), columns=["id1", "id2"])

    return _postings(classes, least).groupBy(*_GROUP).applyInPandas(run, "id1 long, id2 long")


def profile_sums(classes: DataFrame, clusters: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """cluster_id, total, k: over the pairs of files of different classes of a cluster whose cosine is at least `least`, the sum of the
    cosines and their number. A group of _postings() sends two numbers a cluster, not its pairs."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        group = _Group(frame, least)
        ids, place = np.unique(group.cluster, return_inverse=True)
        total, k = np.zeros(len(ids)), np.zeros(len(ids))
        for i, j, sim in group.pairs():
            times = group.n[i].astype(np.float64) * group.n[j]
            total += np.bincount(place[i], times * sim, len(ids))
            k += np.bincount(place[i], times, len(ids))
        return pd.DataFrame({"cluster_id": ids, "total": total, "k": k})[k > 0]

    sums = _postings(classes, least, clusters).groupBy(*_GROUP).applyInPandas(add, "cluster_id long, total double, k double")
    return sums.groupBy("cluster_id").agg(F.sum("total").alias("total"), F.sum("k").alias("k"))


def link_counts(classes: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """class_id, far: to how many files of other classes a class is linked, of those that are. A group of _postings() sends a number for
    each of its classes, not its pairs."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        group = _Group(frame, least)
        far = np.zeros(len(group.ids))
        for i, j, _ in group.pairs():
            far += np.bincount(i, group.n[j], len(far)) + np.bincount(j, group.n[i], len(far))
        return pd.DataFrame({"class_id": group.ids, "far": far.astype(np.int64)})[far > 0]

    sums = _postings(classes, least).groupBy(*_GROUP).applyInPandas(add, "class_id long, far long")
    return sums.groupBy("class_id").agg(F.sum("far").alias("far"))


def linked_files(classes: DataFrame, far: DataFrame) -> DataFrame:
    """file_id, class_id, n_links of every file: links to files of its own class, and far(class_id, far) to those of near classes."""
    rows = classes.select("file_id", "class_id", "class_size").withColumn("_salt", salt(classes.sparkSession, "file_id"))
    heads = classes.filter("file_id = class_id").select("class_id").join(far, "class_id", "left")
    return lookup(rows, heads, ["class_id"], "_salt").select("file_id", "class_id", (F.col("class_size") - 1 + F.coalesce("far", F.lit(0))).cast("long").alias("n_links"))


def file_links(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """linked_files() by pairs of similar_pairs()."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("id1").alias("class_id"), F.col("n2").alias("n")), F.struct(F.col("id2").alias("class_id"), F.col("n1").alias("n")))).alias("e")).select("e.*")
    return linked_files(classes, ends.groupBy("class_id").agg(F.sum("n").alias("far")))


def folder_coherence(files: DataFrame, keywords: DataFrame, coherent: float = COHERENT, least: int = MIN_FILES) -> DataFrame:
    """folder, n_files, coherence, coherent for folders of at least `least` files(file_id, folder).

    The mean cosine of all pairs comes from the sum of the unit profiles: |sum|^2 holds each pair twice, and each profile once. The
    result is written, by tasks that get more, not larger, as the keywords do; these are counted first and so best a written table.
    """
    sizes = files.groupBy("folder").agg(F.count("*").alias("n_files")).filter(F.col("n_files") >= least)
    members = lookup(files.select("file_id", "folder").withColumn("_salt", salt(files.sparkSession, "file_id")), sizes.select("folder"), ["folder"], "_salt").drop("_salt")
    own = unit_terms(keywords).join(members, "file_id")
    full = own.groupBy("folder", "file_id").agg(F.count("*").alias("k")).groupBy("folder").agg(F.count("*").alias("m"))
    sums = own.groupBy("folder", "term").agg(F.sum("u").alias("s")).groupBy("folder").agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    rows = sizes.join(sums, "folder", "left").join(full, "folder", "left")
    mean = F.coalesce((F.col("sq") - F.col("m")) / (F.col("n_files") * (F.col("n_files") - 1)), F.lit(0.0))
    rows = rows.select("folder", "n_files", mean.alias("coherence"), (F.round(mean, 9) >= coherent).alias("coherent"))
    return cut(rows, "coherence", rows=keywords.count())


def folder_outliers(files: DataFrame, keywords: DataFrame, folders: DataFrame, coherent: float = COHERENT) -> DataFrame:
    """folder, file_id, mean_sim of files in incoherent folders whose mean cosine with the folder's other files is too low."""
    bad = folders.filter("NOT coherent").select("folder", "n_files")
    members = lookup(files.select("file_id", "folder").withColumn("_salt", salt(files.sparkSession, "file_id")), bad, ["folder"], "_salt").drop("_salt")
    own = unit_terms(keywords).join(members, "file_id").withColumn("_salt", salt(files.sparkSession, "file_id"))
    near = group_totals(own, ["folder", "term"], "_salt", s=("sum", "u")).groupBy("file_id").agg((F.sum(F.col("u") * F.col("s")) - 1).alias("others"))
    mean = F.coalesce("others", F.lit(0.0)) / (F.col("n_files") - 1)
    out = members.join(near, "file_id", "left").select("folder", "file_id", mean.alias("mean_sim")).filter(F.round("mean_sim", 9) < coherent)
    return cut(out, "outliers", rows=keywords.count())


def orphan_files(files: DataFrame, folders: DataFrame, roots: list[str]) -> DataFrame:
    """file_id of all files of incoherent folders and of those directly in a root."""
    return files.join(folders.filter("NOT coherent").select("folder"), "folder", "left_semi").select("file_id").union(files.filter(F.col("folder").isin(roots)).select("file_id")).distinct()

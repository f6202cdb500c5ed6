"""Near vectors by cells around pivots, and DBSCAN over them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.functions.values import MIN_FILES
from foldergraph.operators.components import connected_components, forest
from foldergraph.operators.skew import global_rank, group_totals, lookup, salt
from foldergraph.sources.shared import cut

#: Rows that a task compares with as many others: to bring a row there costs as much as to compare it with a thousand others.
BLOCK_ROWS = 16384
#: Cells have about so many rows, as long as that takes no more pivots than are sent to all tasks.
CELL_ROWS, PIVOTS = 8192, 1024
#: Rows whose distances to a block or to all pivots are made at once; rows of a frame that is handed on; pairs that are measured at once.
AT_ONCE, FRAME_ROWS, PAIRS = 256, 8192, 16384
#: Distances by matrix products are this exact; what they let pass is measured.
TOLERANCE = 1e-6


def vector_classes(vectors: DataFrame) -> DataFrame:
    """id, class_id, vec (of the class's first row only), n: rows of equal vectors are a class, named by its smallest id; n counts them.

    Rows without id, vector or values are left out. Of rows of one id the one with the smallest vector counts.
    """
    rows = vectors.filter("id IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x))").groupBy("id").agg(F.min("vec").alias("vec"))
    rows = group_totals(rows.withColumn("_salt", salt(vectors.sparkSession, "id")), ["vec"], "_salt", class_id=("min", "id"), n=("count", "*"))
    return rows.select("id", "class_id", F.when(F.col("id") == F.col("class_id"), F.col("vec")).alias("vec"), "n")


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, as exact as a product allows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def pivots_of(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """By vector length: distinct vectors, one for CELL_ROWS rows and PIVOTS at most, those of the least hashes of their ids."""
    first = vectors.filter(F.size("vec") > 0).orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, rows // CELL_ROWS + 1)).select("vec").collect()
    own: dict[int, list] = {}
    for r in first:
        own.setdefault(len(r["vec"]), []).append(r["vec"])
    return {n: np.unique(np.array(v, np.float64), axis=0) for n, v in own.items()}


def in_cells(vectors: DataFrame, eps: float) -> DataFrame:
    """cell, home, and the columns of vectors(id, vec, ...): every row in the cell of its nearest pivot, its home, and as a guest in each
    cell of a smaller number that may hold a row within eps of it. So a near pair meets in exactly one cell, where one of it is at home.

    Rows whose nearest pivot is p lie on p's side of the middle between p and any other. What is further than eps from that middle, or
    further from p than eps and p's farthest row, has no near row there. Pivots are sent to all tasks: at most PIVOTS of them. A length
    of vectors that no pivot has is a cell by itself; empty vectors are in none.
    """
    pivots = pivots_of(vectors, vectors.count())
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())])))  # a length's first cell
    others = [c for c in vectors.columns if c != "vec"]

    def homes(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray | None]]:
        for n, all_of in frame.groupby(frame["vec"].map(len)):
            for at in range(0, len(all_of) if n else 0, AT_ONCE):
                own = all_of.iloc[at : at + AT_ONCE]
                yield n, own, _far(_rows(own["vec"]), pivots[n]) if n in pivots else None

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, _, far in homes(frame):
                if far is not None:
                    yield pd.DataFrame({"cell": first[n] + far.argmin(1), "far": np.sqrt(far.min(1))})

    found = vectors.select("vec").mapInPandas(reach, "cell long, far double").groupBy("cell").agg(F.max("far").alias("far")).collect()  # a row for each pivot
    reached = np.zeros(sum(map(len, pivots.values())))
    for r in found:
        reached[r["cell"]] = r["far"]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, own, far in homes(frame):
                if far is None:
                    yield own.assign(cell=-n, home=True)
                    continue
                home = far.argmin(1)
                yield own.assign(cell=first[n] + home, home=True)
                apart = np.sqrt(_far(pivots[n], pivots[n]))[home]
                with np.errstate(divide="ignore", invalid="ignore"):
                    middle = (far - far[np.arange(len(far)), home][:, None]) / (2 * apart)
                near = (middle <= eps + TOLERANCE) & (np.sqrt(far) <= reached[first[n] : first[n] + far.shape[1]] + eps + TOLERANCE)
                i, k = np.nonzero(near & (np.arange(far.shape[1]) < home[:, None]))
                for at in range(0, len(i), FRAME_ROWS):  # a row may be a guest of all cells
                    yield own.iloc[i[at : at + FRAME_ROWS]].assign(cell=first[n] + k[at : at + FRAME_ROWS], home=False)

    schema = f"cell long, home boolean, {', '.join(f'{c} {t}' for c, t in vectors.dtypes)}"
    rows = vectors.select("vec", *others).mapInPandas(deal, schema)
    return cut(rows, "cells")


def in_blocks(cells: DataFrame) -> DataFrame:
    """cells with kind, b1, b2, first, second: all rows that are to be compared with each other meet in a group of (cell, kind, b1, b2).

    A cell's homes and its guests are each cut to blocks of about BLOCK_ROWS rows: a group compares two blocks of homes (kind 0), or
    one of homes with one of guests (kind 1); first and second say on which side a row is. However full a cell is, no task holds more
    than two blocks.
    """
    sizes = cells.groupBy("cell", "home").agg(F.count("*").alias("n")).groupBy("cell")
    blocks = lambda home: F.greatest(F.lit(1), F.ceil(F.max(F.when(F.col("home") == home, F.col("n"))) / BLOCK_ROWS)).cast("int")
    sizes = sizes.agg(blocks(True).alias("h"), blocks(False).alias("g"))  # a row for each cell
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("h")).otherwise(F.col("g"))).cast("int")
    rows = cells.join(F.broadcast(sizes), "cell").withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = rows.filter("home").withColumn("other", F.explode(upto("h"))).withColumns({"kind": F.lit(0), "b1": F.least("own", "other"), "b2": F.greatest("own", "other")})
    among = among.withColumns({"first": F.col("own") == F.col("b1"), "second": F.col("own") == F.col("b2")})
    guests = cells.filter("NOT home").select("cell").distinct()
    hosts = rows.filter("home").join(F.broadcast(guests), "cell", "left_semi").withColumn("other", F.explode(upto("g"))).withColumns({"kind": F.lit(1), "b1": F.col("own"), "b2": F.col("other"), "first": F.lit(True), "second": F.lit(False)})
    met = rows.filter("NOT home").withColumn("other", F.explode(upto("h"))).withColumns({"kind": F.lit(1), "b1": F.col("other"), "b2": F.col("own"), "first": F.lit(False), "second": F.lit(True)})
    return among.unionByName(hosts).unionByName(met).drop("h", "g", "own", "other")


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row of x, which of AT_ONCE rows from there on are near to which of y), by products as exact as numbers of 32 bits allow, if these
    tell distances about eps apart, and else of 64; pairs that they leave open are measured."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    far_x, far_y = ~np.isfinite(xx), ~np.isfinite(yy)  # of no row within any number
    slack = (x.shape[1] + 8) * (np.max(xx[~far_x], initial=0) + np.max(yy[~far_y], initial=0))
    kind = np.float32 if slack * 2.0**-23 < eps * eps / 100 else np.float64
    slack = slack * (2.0**-23 if kind is np.float32 else 2.0**-51) + TOLERANCE * eps * eps
    one = np.ones((len(y), 1))
    u = np.where(far_x[:, None], 0, np.c_[x, -xx / 2, one[:1].repeat(len(x), 0)]).astype(kind)
    v = np.where(far_y[:, None], 0, np.c_[y, one, -yy / 2]).astype(kind).T  # u @ v: minus half the squared distance
    for at in range(0, len(x), AT_ONCE):
        close = u[at : at + AT_ONCE] @ v
        near = close >= -(eps * eps - slack) / 2
        open_ = np.flatnonzero((close >= -(eps * eps + slack) / 2) != near)
        for k in range(0, len(open_), PAIRS):
            i, j = np.divmod(open_[k : k + PAIRS], len(y))
            near[i, j] = np.sqrt(((x[at + i] - y[j]) ** 2).sum(1)) <= eps
        near[far_x[at : at + AT_ONCE]] = False
        near[:, far_y] = False
        yield at, near


def _near(frame: pd.DataFrame, eps: float, most: int | None = None) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """(rows of the first side, of the second, which are near) of a group of in_blocks(); a row isn't near itself, a pair of one block is
    there both ways. What is held are the rows and a byte for each pair, however many are near; with `most`, so many rows of the first
    side come at once."""
    first, second = frame[frame["first"]], frame[frame["second"]]
    for a, b in _by_length(first, second):
        _, ia, ib = np.intersect1d(a["id"], b["id"], assume_unique=True, return_indices=True)
        step, held, begin = len(a) if most is None else most, [], 0
        for at, part in _within(_rows(a["vec"]), _rows(b["vec"]), eps):
            own, end = (ia >= at) & (ia < at + len(part)), at + len(part)
            part[ia[own] - at, ib[own]] = False
            held.append(part)
            if end - begin >= step or end == len(a):
                yield a.iloc[begin:end], b, held[0] if len(held) == 1 else np.concatenate(held)
                held, begin = [], end


def _weighed(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near @ b, a @ near) by the pairs that are near, not too many at once."""
    rows, columns = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for at in range(0, len(a), AT_ONCE):
        part = near[at : at + AT_ONCE]
        i, j = np.divmod(np.flatnonzero(part), part.shape[1])
        rows[at : at + AT_ONCE] = np.bincount(i, b[j], len(part))  # exact up to 2^53
        columns += np.bincount(j, a[at + i], len(b)).astype(np.int64)
    return rows, columns


_GROUP = ("cell", "kind", "b1", "b2")


def near_pairs(vectors: DataFrame, eps: float) -> DataFrame:
    """id1, id2: pairs of vectors(id, vec) at most eps apart, found in the cells of in_cells().

    ids are distinct, no vector is null; where many are equal, vector_classes() keeps one of them.
    """

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(frames)
        one = frame["first"].eq(frame["second"]).all()  # a block with itself has each pair twice
        for a, b, near in _near(frame, eps, AT_ONCE):  # handed on by parts, as all rows of two blocks may be near
            i, j = np.nonzero(near)
            ids = np.stack([a["id"].to_numpy()[i], b["id"].to_numpy()[j]])
            yield pd.DataFrame((ids[:, ids[0] < ids[1]] if one else np.sort(ids, axis=0)).T, columns=["id1", "id2"])

    return in_blocks(in_cells(vectors.select("id", "vec"), eps)).groupBy(*_GROUP).applyInPandas(pairs, "id1 long, id2 long")


def _by_length(first: pd.DataFrame, second: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Rows of equal vector length; others are never near."""
    b = dict(list(second.groupby(second["vec"].map(len))))
    for n, a in first.groupby(first["vec"].map(len)):
        if n and n in b:
            yield a, b[n]


def near_counts(blocks: DataFrame, eps: float) -> DataFrame:
    """id, around: how many other rows (by their n) are within eps. A group sends a sum for each of its rows, not its pairs."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": np.zeros(0, np.int64), "around": np.zeros(0, np.int64)})]
        one = frame["first"].eq(frame["second"]).all()
        for a, b, near in _near(frame, eps, AT_ONCE):
            rows, columns = _weighed(near, a["n"].to_numpy(), b["n"].to_numpy())
            out.append(pd.DataFrame({"id": a["id"], "around": rows}))
            if not one:
                out.append(pd.DataFrame({"id": b["id"], "around": columns}))
        found = pd.concat(out).groupby("id", as_index=False).sum()
        return found[found["around"] > 0]

    return blocks.groupBy(*_GROUP).applyInPandas(count, "id long, around long").groupBy("id").agg(F.sum("around").alias("around"))


def core_links(blocks: DataFrame, eps: float) -> DataFrame:
    """id, core, rep: what a group knows of its rows(id, core): for each core row the least core id of its piece within the group, for
    each other row the least ids of the pieces that it is near to. A few rows for each row of a group, not its pairs."""

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(frame["id"])
        label, edges = np.arange(len(ids)), [np.zeros((2, 0), np.int64)]  # the least node of each node's piece; (row that isn't core, core row)
        for a, b, near in _near(frame, eps, AT_ONCE):
            ca, cb = a["core"].to_numpy(), b["core"].to_numpy()
            na, nb = np.searchsorted(ids, a["id"]), np.searchsorted(ids, b["id"])
            for at, end in itertools.pairwise((0, 1, 16, AT_ONCE)):  # what the first rows are near to hangs together before others are gone through
                part = near[at:end]
                if np.count_nonzero(part) > part.size // 16:  # pairs of one piece aren't listed, if there are many
                    part = part & (label[na[at:end]][:, None] != label[nb])
                i, j = np.divmod(np.flatnonzero(part), len(nb))
                both = ca[at + i] & cb[j]
                node, least = forest(label[na[at + i[both]]], label[nb[j[both]]])
                label[node] = least
                label = label[label]
            i, j = np.divmod(np.flatnonzero(near & (ca[:, None] != cb)) if not (ca.all() and cb.all()) else np.zeros(0, np.int64), len(nb))  # fewer than min_pts for each row that isn't core
            edges.append(np.where(ca[i], [nb[j], na[i]], [na[i], nb[j]]))
        core = np.flatnonzero(label != np.arange(len(ids)))
        own, other = np.unique(np.stack([(e := np.concatenate(edges, axis=1))[0], label[e[1]]]), axis=1)
        return pd.DataFrame({"id": ids[np.r_[core, own]], "core": np.r_[np.ones(len(core), bool), np.zeros(len(own), bool)], "rep": ids[np.r_[label[core], other]]})

    return blocks.groupBy(*_GROUP).applyInPandas(link, "id long, core boolean, rep long")


def dbscan(vectors: DataFrame, eps: float, min_pts: int = 3, least: int = MIN_FILES) -> DataFrame:
    """id, cluster_no: clusters of core points (min_pts within eps, themselves counted) with the border points next to them.

    Clusters are numbered by their smallest core id; a border point goes to the lowest number near it; clusters of fewer than
    `least` points go, noise has no row. See vector_classes() for null vectors and repeated ids. Near pairs are not written: cells count
    neighbours, then give each core point one link to its piece of the cell; the pieces of all cells are joined by the points that
    they share.
    """
    classes = cut(vector_classes(vectors), "classes")
    heads = classes.filter("id = class_id").select("id", "vec", "n")
    cells = in_cells(heads, eps)
    degree = near_counts(in_blocks(cells), eps)
    empty = F.size("vec") == 0  # near nothing, not even its like
    core = heads.select("id", F.when(empty, 1).otherwise(F.col("n")).alias("n")).join(degree, "id", "left")
    core = cut(core.filter(F.coalesce("around", F.lit(0)) + F.col("n") >= min_pts).select("id"), "core")
    marked = heads.join(core.withColumn("core", F.lit(True)), "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    links = cut(core_links(in_blocks(in_cells(cut(marked, "marked"), eps)), eps), "links")  # in cells anew, which moves fewer rows than to mark all guests
    roots = connected_components(links.filter("core").select(F.col("id").alias("src"), F.col("rep").alias("dst")))
    cores = cut(core.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("first_core")), "cores")
    border = links.filter("NOT core").join(cores.withColumnRenamed("id", "rep"), "rep").groupBy("id").agg(F.min("first_core").alias("first_core"))
    # written, as a union of two tables that are dealt by id may be taken for one that is dealt by id, though each was coalesced by itself
    members = cut(cores.unionByName(border), "members").join(heads.select("id", "n"), "id")
    sizes = members.groupBy("first_core").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    numbers = global_rank(sizes.select("first_core"), ["first_core"]).select("first_core", (F.col("rank") + 1).cast("int").alias("cluster_no"))
    members = members.join(numbers, "first_core").select(F.col("id").alias("class_id"), "cluster_no")
    return lookup(classes.select("id", "class_id").withColumn("_salt", salt(vectors.sparkSession, "id")), members, ["class_id"], "_salt").select("id", "cluster_no")


def cluster_cohesion(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """cluster_no, n_files, score: mean cosine of all pairs, from the sum of the unit vectors; 0 for fewer than two.

    Vectors of length 0 add nothing, but count among the pairs.
    """
    sizes = members.groupBy("cluster_no").agg(F.count("*").alias("n_files"))
    parts = vectors.join(members, "id").select("cluster_no", "id", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    units = parts.withColumn("norm", norm).filter("norm > 0").withColumn("u", F.col("x") / F.col("norm"))
    sums = units.groupBy("cluster_no", "dim").agg(F.sum("u").alias("s"), F.count("*").alias("m")).groupBy("cluster_no").agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("m").alias("m"))
    n = F.col("n_files")
    return sizes.join(sums, "cluster_no", "left").select("cluster_no", "n_files", F.when(n < 2, 0.0).otherwise(F.coalesce((F.col("sq") - F.col("m")) / (n * (n - 1)), F.lit(0.0))).alias("score"))

"""Near vectors and DBSCAN by cells against all pairs and the sequential rule."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldergraph.operators import vectors as ve

POINTS = "id long, vec array<double>"


def _sequential(points, eps, least):
    """Points in order of id, each with all others."""
    near = {a: [b for b, y in points if len(x) == len(y) and sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5 <= eps] for a, x in points}
    label, number = {}, 0
    for a, _ in points:
        if a in label or len(near[a]) < least:
            continue
        number += 1
        todo = [a]
        while todo:
            b = todo.pop()
            if b not in label:
                label[b] = number
                if len(near[b]) >= least:
                    todo += [c for c in near[b] if c not in label]
    # a border point goes to the lowest number near it, which the walk above has done; small clusters go
    sizes = {n: list(label.values()).count(n) for n in label.values()}
    kept = {n: k + 1 for k, n in enumerate(sorted(n for n in sizes if sizes[n] >= 3))}
    return {k: kept[n] for k, n in label.items() if n in kept}


def _points(seed, n=240):
    """A third of all points in a ball that is dense, the others in groups and alone."""
    rnd = random.Random(seed)
    centres = [[rnd.random() * 8 for _ in range(3)] for _ in range(6)]
    out = [[4 + rnd.gauss(0, 0.12) for _ in range(3)] for _ in range(n // 3)]
    out += [[c + rnd.gauss(0, 0.4) for c in rnd.choice(centres)] for _ in range(n // 3)]
    out += [[rnd.random() * 8 for _ in range(3)] for _ in range(n - len(out))]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "block", "cell"), [(1, 4096, 1024), (2, 20, 10), (3, 7, 30), (4, 500, 5)])
def test_cells_lose_nothing(spark, monkeypatch, seed, block, cell):
    monkeypatch.setattr(ve, "BLOCK_ROWS", block)
    monkeypatch.setattr(ve, "CELL_ROWS", cell)
    points = _points(seed)
    frame, eps = spark.createDataFrame(points, POINTS).repartition(3), 0.5
    x = np.array([p for _, p in points])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = [tuple(r) for r in ve.near_pairs(frame, eps).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if far[i, j] <= eps}
    got = {r.id: r.cluster_no for r in ve.dbscan(frame, eps, 4).collect()}
    assert got == _sequential(points, eps, 4) and len(set(got.values())) > 2


def test_lengths_that_no_pivot_has(spark, monkeypatch):
    monkeypatch.setattr(ve, "pivots_of", lambda vectors, rows: {2: np.array([[0.0, 0.0], [5.0, 5.0]])})
    points = [(k, [k / 10, 0.0]) for k in range(8)] + [(20 + k, [k / 10]) for k in range(5)] + [(40, []), (41, [])]
    got = {tuple(r) for r in ve.near_pairs(spark.createDataFrame(points, POINTS), 0.1000001).collect()}
    assert got == {(k, k + 1) for k in range(7)} | {(20 + k, 21 + k) for k in range(4)}


def test_rows_go_to_few_cells(spark, monkeypatch):
    """Groups apart from each other: copies of a row are far fewer than if each went to every block."""
    monkeypatch.setattr(ve, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ve, "CELL_ROWS", 25)
    rnd = random.Random(5)
    centres = [[rnd.random() * 100 for _ in range(8)] for _ in range(40)]
    frame = spark.createDataFrame([(k, [c + rnd.gauss(0, 0.2) for c in centres[k % 40]]) for k in range(4000)], POINTS)
    cells = ve.in_cells(frame, 1.0)
    copies = ve.in_blocks(cells).count() / 4000
    assert cells.filter("home").count() == 4000 and copies < (4000 / 50) / 10
    # with a ball of a third of all rows no group holds more than about two blocks
    ball = spark.createDataFrame([(k, [0.0 if d else k / 1e5 for d in range(8)]) for k in range(5000, 7000)], POINTS)
    groups = ve.in_blocks(ve.in_cells(frame.unionByName(ball), 1.0)).groupBy("cell", "kind", "b1", "b2").count()
    assert groups.agg(F.max("count")).head()[0] < 2 * 50 * 2


def test_empty_and_single(spark):
    none = spark.createDataFrame([], POINTS)
    assert ve.near_pairs(none, 1.0).count() == 0 and ve.dbscan(none, 1.0).count() == 0
    assert ve.near_pairs(spark.createDataFrame([(1, [0.0])], POINTS), 1.0).count() == 0


def test_dealing_and_measuring_take_little_memory(spark, monkeypatch):
    """Rows that are guests of every cell are handed on by parts, and pairs are measured by parts: no frame or product grows with them."""
    rnd = np.random.default_rng(4)
    frame = pd.DataFrame({"id": np.arange(2000), "vec": list(rnd.normal(size=(2000, 64)) * 0.05), "first": True, "second": True})
    tracemalloc.start()
    (_, _, near), = ve._near(frame, 10.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near.sum() == 2000 * 1999 and peak < 100e6  # the differences of all near pairs alone are 2 GB
    n = rnd.integers(1, 9, 2000)
    rows, columns = ve._weighed(near, n, n)
    assert (rows == n.sum() - n).all() and (columns == rows).all()
    points = spark.createDataFrame([(k, v.tolist()) for k, v in zip(range(2000), frame["vec"])], POINTS).coalesce(1)
    monkeypatch.setattr(ve, "CELL_ROWS", 20)
    cells = ve.in_cells(points, 10.0)
    sizes = cells.groupBy("id", "home").count().filter("home").agg(F.sum("count"), F.max("count")).head()
    assert tuple(sizes) == (2000, 1) and cells.count() > 2000 * 40


def test_rows_near_to_no_cell_alone_move_little(spark):
    """Vectors that no pivot tells apart meet all others: in large blocks, so that copies of a row are few."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(9000, 16))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x / np.sqrt((x * x).sum(1))[:, None])], POINTS)
    assert ve.in_blocks(ve.in_cells(frame, 1.2)).count() <= 3 * 9000


@pytest.mark.parametrize(("offset", "scale"), [(0.0, 1.0), (1e4, 1.0), (1e7, 1.0), (0.0, 1e-9)])
def test_products_and_measures_agree(offset, scale):
    """Far from the origin, where products of 32 bits, or of 64, can't tell distances, pairs are measured; rows that aren't finite are near none."""
    rnd = np.random.default_rng(7)
    x, y = (offset + np.round(rnd.normal(size=(n, 3)), 1) for n in (600, 700))
    x[5, 1], y[7, 0] = np.inf, 1e300
    x, y = x * scale, y * scale
    with np.errstate(all="ignore"):
        want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)) <= 0.5 * scale
        got = np.concatenate([near for _, near in ve._within(x, y, 0.5 * scale)])
    assert (got == want).all() and 0 < got.sum() < got.size / 4

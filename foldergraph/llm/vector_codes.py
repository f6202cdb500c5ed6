"""Product codes of vectors: each of a vector's parts becomes the index of the nearest entry of that part's codebook."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldergraph.operators.skew import group_totals, salt
from foldergraph.sources.shared import cut, slices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components lie within so much of 0: the distances of a whole vector then fit 64 bits. That is 16 384 before scaling.
FAR = 1 << 26
#: Leaves of a subtree that is walked as arrays; larger ones are entered child by child.
LEAVES = 4096
#: Components that a task holds as a matrix at a time.
_STEP = 1 << 20


def scaled(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of each component as rows of dims integers, shorter vectors filled with 0."""
    sizes = np.asarray(pc.list_value_length(vectors), np.int64)
    flat = np.asarray(vectors.flatten(), np.float64)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.clip(np.floor(flat * SCALE), -FAR, FAR).astype(np.int64)
    return out


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows in lexicographic order, which of them each row is)"""
    if not parts.size:
        return parts[:1], np.zeros(len(parts), np.int64)
    order = np.lexsort(parts.T[::-1])
    new = np.r_[True, (parts[order[1:]] != parts[order[:-1]]).any(1)]
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    return parts[order[new]], place


def walked(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) for the leaves of the trie over parts: distinct rows in lexicographic order.

    A node is a prefix of components; it holds the distances of that prefix to all entries, which all leaves below it share. The walk
    goes depth first: a child of more than LEAVES leaves is entered by itself, smaller neighbours together, level by level.
    """
    n, dims = parts.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def block(lo: int, hi: int, depth: int, have: np.ndarray) -> None:
        rows = parts[lo:hi]
        node, have = np.zeros(hi - lo, np.int64), have[None, :]
        first = np.zeros(1, np.int64)  # each node's first leaf
        for k in range(depth, dims):
            new = np.r_[True, (np.diff(node) != 0) | (rows[1:, k] != rows[:-1, k])]
            parent, first = node[new], np.flatnonzero(new)
            have = have[parent] + (rows[first, k][:, None] - book[None, :, k]) ** 2
            node = np.cumsum(new) - 1
        best = have.argmin(1)[node]  # the first of equal ones
        code[lo:hi], error[lo:hi] = best, have[node, best]

    def enter(lo: int, hi: int, depth: int, have: np.ndarray) -> None:
        if hi - lo <= LEAVES or depth == dims:
            return block(lo, hi, depth, have)
        starts = lo + np.flatnonzero(np.r_[True, parts[lo + 1 : hi, depth] != parts[lo : hi - 1, depth]])
        ends = np.r_[starts[1:], hi]
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + LEAVES, "right")))
            if to == at + 1 and ends[at] - starts[at] > LEAVES:
                enter(int(starts[at]), int(ends[at]), depth + 1, have + (parts[starts[at], depth] - book[:, depth]) ** 2)
            else:
                block(int(starts[at]), int(ends[to - 1]), depth, have)
            at = to

    if n:
        enter(0, n, 0, np.zeros(len(book), np.int64))
    return code, error


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("vec").isNotNull() & ~bad)


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows with their scaled vectors."""
    rows = max(1, _STEP // max(1, dims))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            own = batch.slice(at, rows)
            yield own, scaled(own.column("vec"), dims)


def distinct_parts(vectors: DataFrame, dims: int) -> DataFrame:
    """part, value, n: each part position's distinct components and how many vectors hold them, a range of the lexicographic order a task.

    A run of rows sends what it holds twice once and Spark adds up before the shuffle, so copies don't pile up. Written once, as every
    round walks it.
    """
    width = dims // PARTS

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in matrices(batches, dims):
            for k in range(PARTS):
                own, place = distinct(rows[:, k * width : (k + 1) * width])
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * width, pa.int32()), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), values, pa.array(np.bincount(place, minlength=len(own)))], ["part", "value", "n"])

    rows = vectors.select("vec").mapInArrow(cut_up, "part int, value array<long>, n long").groupBy("part", "value").agg(F.sum("n").alias("n"))
    return cut(rows.repartitionByRange(slices(vectors.sparkSession), "part", "value").sortWithinPartitions("part", "value"), "parts")


def fitted(parts: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after `rounds` rounds over distinct_parts(): every part goes to its nearest entry, every entry becomes the floor of its
    parts' mean, an entry without parts stays. Tasks send their sums for each entry, Spark adds them up."""

    def totals(books: list[np.ndarray]) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                position, weight = np.asarray(batch.column("part")), np.asarray(batch.column("n"), np.int64)
                for k in np.unique(position).tolist():
                    own = position == k
                    values = np.asarray(batch.column("value").filter(pa.array(own)).flatten(), np.int64).reshape(int(own.sum()), books[k].shape[1])
                    code, _ = walked(values, books[k])
                    np.add.at(total[k], code, values * weight[own][:, None])
                    np.add.at(count[k], code, weight[own])
            found = [(k, e, int(c[e]), total[k][e].tolist()) for k, c in enumerate(count) for e in np.flatnonzero(c).tolist()]
            part, entry, n, total = zip(*found) if found else ((),) * 4
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((part, entry, n, total), kinds)], ["part", "entry", "n", "total"])

        rows = parts.mapInArrow(add, "part int, entry int, n long, total array<long>").select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        return rows.groupBy("part", "entry", "at").agg(wide("x"), wide("n"))

    for _ in range(rounds):
        new = [b.copy() for b in books]
        for r in totals(books).collect():  # PARTS * ENTRIES * width rows at most
            new[r["part"]][r["entry"], r["at"]] = int(r["x"]) // int(r["n"])
        books = new
    return books


def coded(vectors: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """vec_id, label, code, error of every vector: its distinct parts within a run of rows are walked once each."""
    width = dims // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, rows in matrices(batches, dims):
            code, error = np.zeros((len(rows), PARTS), ">u1"), np.zeros(len(rows), np.int64)
            for k, book in enumerate(books):
                values, place = distinct(rows[:, k * width : (k + 1) * width])
                best, far = walked(values, book)
                code[:, k] = best[place]
                error += far[place]
            text = code.tobytes().hex()
            codes = pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string())
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), codes, pa.array(error)], ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return vectors.select("vec_id", "vec", "label").mapInArrow(run, schema)


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error of every usable row of vectors(vec_id, embedding, label); the codebooks).

    Components become floor(SCALE * x), at most FAR away from 0; vectors shorter than the longest are filled with 0, up to a multiple of
    PARTS. Each part position's codebook starts as that part of the ENTRIES smallest vec_ids (nulls last, then by vector) and is
    fitted over all rows. code: the nearest entries in part order, two hex digits each, ties to the lower; error: the squared distances
    summed; label_error: error summed over rows of equal label, nulls together. Rows without vector or with a null or non-finite
    component are left out; repeated rows count as often as they are there; without usable rows the result is empty, codebooks too.
    Other columns are not carried.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"), "label"))
    longest = rows.agg(F.max(F.size("vec"))).head()[0] or 0
    dims = -(-longest // PARTS) * PARTS
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(ENTRIES).select("vec").collect()
    start = scaled(pa.array([r["vec"] for r in first], pa.list_(pa.float64())), dims)
    books = [np.ascontiguousarray(b) for b in np.split(start, PARTS, axis=1)]
    if len(start):
        books = fitted(distinct_parts(rows, dims), books, rounds)
    key = {"_none": F.col("label").isNull(), "_key": F.coalesce(F.col("label").cast("string"), F.lit("")), "_salt": salt(spark, "vec_id")}
    out = group_totals(cut(coded(rows, books, dims), "codes").withColumns(key), ["_none", "_key"], "_salt", label_error=("sum", "error"))
    return out.select("vec_id", "label", "code", "error", "label_error"), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Of all entries' decimal components by part, entry and position within the part, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

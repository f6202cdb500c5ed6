"""Toxicity of texts: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldergraph.llm.words import split_words, steps
from foldergraph.sources.shared import cut, new_dir, write

#: Labelled rows that a fit takes at most: those of the least hashes of doc_id.
SAMPLE = 8192
#: Rows that one task goes through in order; of several tasks the changes are averaged after each pass.
SHARD_ROWS = 4096
PASSES = 12
#: A feature is in at least LEAST of the sample's rows, and in so many more that there are at most MOST features.
LEAST, MOST = 3, 1 << 18
#: Rates are ALPHA / (BETA + the root of the coordinate's squared gradients so far).
ALPHA, BETA = 3.0, 1.0
#: Pairs of words this far apart are features: 1 is a bigram, more a skip-gram.
GAPS = (1, 2, 3)
_EDGE = re.compile(r"^\W+|\W+$")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def l1(rows: int) -> float:
    """What a coordinate's summed gradient must exceed to get a weight: grows with the root of the rows, as chance does."""
    return max(3.0, math.sqrt(rows) / 9)


class Model(NamedTuple):
    """Features with a weight that isn't 0, ascending, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


@functools.lru_cache(1 << 18)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(_EDGE.sub("", word).lower() or word)


def hashed(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, row of each), for single words and then for each gap: 32-bit hashes of words in lower case without signs at their
    ends, and of pairs of them. A feature comes as often as the text has it."""
    words, starts = split_words(texts)
    known = words.dictionary_encode()
    own = np.fromiter(map(_word_hash, known.dictionary.to_pylist()), np.uint64, len(known.dictionary))
    h = own[np.asarray(known.indices)] * _A
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    yield (h >> np.uint64(32)).astype(np.uint32), row
    for gap in GAPS:
        same = row[gap:] == row[:-gap]
        pair = (h[:-gap] ^ (h[gap:] * _B + np.uint64(gap)))[same] * _C
        yield (pair >> np.uint64(32)).astype(np.uint32), row[gap:][same]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from; a null doc_id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """y, at, features of labelled rows of docs that aren't held out. `most` doc_ids at most, so that they can be broadcast: texts are
    not shuffled. at: their order. Of rows of one doc_id the one with the least features (as bytes) counts."""
    told = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    told = told.filter(~held_out(F.col("doc_id"))).withColumn("at", F.xxhash64("doc_id"))
    share = min(1.0, 2 * most / max(1, labels.count()))  # else each task would send as many rows as are taken in the end
    few = told.filter(F.col("at") <= min(2**63 - 1, int(-(2**63) + share * 2**64))).orderBy("at", "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("at", (F.col("toxic") > 0).cast("int").alias("y"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                both = np.unique(np.concatenate([row.astype(np.uint64) << np.uint64(32) | f for f, row in hashed(part.column("text"))]))
                ends = np.searchsorted(both, np.arange(part.num_rows + 1, dtype=np.uint64) << np.uint64(32))
                bits = (both & np.uint64(0xFFFFFFFF)).astype("<u4")
                features = [bits[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("y"), pa.array(features, pa.binary())], ["at", "y", "features"])

    return cut(rows.mapInArrow(run, "at long, y int, features binary").groupBy("at").agg(F.max("y").alias("y"), F.min("features").alias("features")), "examples")


def frequent(examples: DataFrame, least: int = LEAST, most: int = MOST) -> np.ndarray:
    """Features of at least `least` examples, ascending; of so many more that there are at most `most` of them."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                own, n = np.unique(np.frombuffer(b"".join(frame["features"].iloc[at : at + 256]), "<u4"), return_counts=True)
                yield pd.DataFrame({"f": own.astype(np.int64), "n": n})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"data": [frame["f"].to_numpy(np.uint32).tobytes()]})

    counted = examples.select("features").mapInPandas(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n"))
    counted = cut(counted.filter(F.col("n") >= least), "frequent")
    total = 0
    for n, k in sorted(map(tuple, counted.groupBy("n").agg(F.count("*")).collect()), reverse=True):  # a row for each count, SAMPLE at most
        total += k
        if total > most:
            least = n + 1
            break
    data = counted.filter(F.col("n") >= least).select("f").mapInPandas(pack, "data binary").collect()  # four bytes a feature, MOST at most
    return np.sort(np.frombuffer(b"".join(r["data"] for r in data), np.uint32))


def shards_of(examples: DataFrame, features: np.ndarray, shards: int) -> DataFrame:
    """y, coordinates (places among features) of all examples, a shard a partition, in order. Written once; no pass shuffles."""
    spark = examples.sparkSession
    known = spark.sparkContext.broadcast(features)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for data in frame["features"]:
                f = np.frombuffer(data, "<u4")
                at = np.minimum(np.searchsorted(known.value, f), max(0, len(known.value) - 1))
                out.append((at[known.value[at] == f] if len(known.value) else at[:0]).astype("<i4").tobytes())
            yield frame[["shard", "at", "y"]].assign(coordinates=out)

    path = new_dir(spark, "shards")
    dealt = examples.withColumn("shard", F.pmod(F.col("at"), F.lit(shards)).cast("int"))
    write(dealt.mapInPandas(place, "shard int, at long, y int, coordinates binary"), path, ("shard",))
    rows = spark.read.schema("at long, y int, coordinates binary, shard int").parquet(path)
    parts = [rows.filter(F.col("shard") == k).drop("shard").coalesce(1).sortWithinPartitions("at") for k in range(shards)]
    return functools.reduce(DataFrame.unionByName, parts)


def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA))


def went_through(examples: list[tuple[int, np.ndarray]], z: np.ndarray, n: np.ndarray, l1: np.ndarray, start: float) -> None:
    """One pass of FTRL-proximal over (y, coordinates) in order, in place: z holds gradients less what the rates have done, n squares."""
    for y, at in examples:
        have, squares = z[at], n[at]
        w = weights(have, squares, l1[at])
        slope = 1 / (1 + math.exp(-min(35.0, max(-35.0, start + float(w.sum()))))) - y
        rate = (np.sqrt(squares + slope * slope) - np.sqrt(squares)) / ALPHA
        z[at] = have + slope - rate * w
        n[at] = squares + slope * slope


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, passes: int = PASSES) -> Model:
    """Weights of docs(doc_id, text) by labels(doc_id, toxic), of rows that aren't held out.

    A sample of `most` labelled doc_ids is taken. Rows go to shards of SHARD_ROWS, each gone through in a task of its own from what the
    pass before left; a pass ends with the mean of the shards. Each coordinate has its own rate, and none gets a weight before its
    gradients exceed l1(). A doc_id with several labels is toxic if one says so, one row of a doc_id counts, a null label is none. Without examples the model holds a low bias only.
    """
    examples = sample(docs, labels, most)
    rows, positive = examples.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).head()
    rate = (positive + 0.1) / (rows + 1)
    start = math.log(rate / (1 - rate))
    if not positive:
        return Model(np.zeros(0, np.uint32), np.zeros(0), start)
    features = frequent(examples)
    shards, bias = -(-rows // SHARD_ROWS), len(features)
    dealt = shards_of(examples, features, shards)
    least = np.r_[np.full(bias, l1(rows)), 0.0]
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    for _ in range(passes):
        state = docs.sparkSession.sparkContext.broadcast((z, n))

        def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z, n = state.value
            own_z, own_n = z.copy(), n.copy()
            for frame in frames:
                went_through([(y, np.append(np.frombuffer(at, "<i4"), bias)) for y, at in zip(frame["y"], frame["coordinates"])], own_z, own_n, least, start)
            moved = np.flatnonzero(own_n != n)
            yield pd.DataFrame({"at": [moved.astype("<i4").tobytes()], "z": [(own_z - z)[moved].tobytes()], "n": [(own_n - n)[moved].tobytes()]})

        z, n = z.copy(), n.copy()
        for r in dealt.mapInPandas(shard, "at binary, z binary, n binary").collect():  # a row for each shard
            at = np.frombuffer(r["at"], "<i4")
            z[at] += np.frombuffer(r["z"]) / shards
            n[at] += np.frombuffer(r["n"]) / shards
        state.destroy()
    w = weights(z, n, least)
    there = np.flatnonzero(w[:-1])
    return Model(features[there], w[there], start + float(w[-1]))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """From 0 to 1 for each text. A feature counts once a text."""
    total = np.full(len(texts), model.bias)
    if len(model.features):
        some = np.zeros(1 << 16, bool)
        some[model.features & np.uint32(0xFFFF)] = True
        found = []
        for f, row in hashed(texts):
            likely = some[f & np.uint32(0xFFFF)]
            f, row = f[likely], row[likely]
            at = np.minimum(np.searchsorted(model.features, f), len(model.features) - 1)
            good = model.features[at] == f
            found.append(row[good] * len(model.features) + at[good])
        both = np.unique(np.concatenate(found))
        total += np.bincount(both // len(model.features), model.weights[both % len(model.features)], len(texts))
    return 1 / (1 + np.exp(-total))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text).

    The whole text is scored; null and empty texts get the score of the bias. Equal texts have equal scores. Other columns are not
    carried. The model is sent to the tasks: MOST features at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text"), model))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

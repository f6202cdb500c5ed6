"""Texts to embed, the cache of vectors, and batches of an embedding function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 20
MOST_CHARS = 2000


def embedding_text(files: DataFrame, most: int | None = MOST_CHARS) -> DataFrame:
    """file_id, text: name, extension, folder and the first `most` characters of the content (None: all of it), parted by spaces."""
    head = F.nullif(F.col("content") if most is None else F.substring("content", 1, most), F.lit(""))
    return files.select("file_id", F.concat_ws(" ", "name", "extension", "parent_dir", head).alias("text"))


def split_cached(files: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(cached vectors of files, files that have none) under a model."""
    own = cache.filter(F.col("model") == model)
    return own.join(files.select("file_id"), "file_id", "left_semi"), files.join(own.select("file_id"), "file_id", "left_anti")


def hashed_vector(texts: list[str], size: int = 64) -> list[list[float]]:
    """Counts of hashed words; stands for a model where there is none."""
    import zlib

    out = []
    for text in texts:
        vector = [0.0] * size
        for word in text.lower().split():
            vector[zlib.crc32(word.encode()) % size] += 1.0
        out.append(vector)
    return out


def embed_batches(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hashed_vector, batch: int = BATCH) -> DataFrame:
    """file_id, embedding, error of texts(file_id, text), `batch` a call. A call that fails, or returns another number, leaves its files with
    a null embedding and says why. Rows of one id are embedded each, a null text counts as an empty one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    vectors, error = embed([t or "" for t in part["text"]]), None
                    if len(vectors) != len(part):
                        error = f"{len(vectors)} vectors for {len(part)} texts"
                except Exception as e:  # noqa: BLE001  an injected function may raise anything; its files get the message
                    error = str(e)[:500] or type(e).__name__
                yield pd.DataFrame({"file_id": part["file_id"], "embedding": [None] * len(part) if error else list(vectors), "error": error})

    # ids as strings: pandas would make floats of longs beside nulls
    rows = texts.select(F.col("file_id").cast("string").alias("file_id"), "text").mapInPandas(run, "file_id string, embedding array<float>, error string")
    return rows.withColumn("file_id", F.col("file_id").cast("long"))


def put_vectors(cache: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The next snapshot of cache(file_id, model, embedding): vectors(file_id, embedding) of a model replace those it has, null ones don't."""
    new = vectors.filter("embedding IS NOT NULL").select("file_id", F.lit(model).alias("model"), "embedding").dropDuplicates(["file_id"])
    rest = cache.select("file_id", "model", "embedding").join(new.select("file_id", "model"), ["file_id", "model"], "left_anti")
    return rest.unionByName(new)


def all_vectors(files: DataFrame, cache: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]] = hashed_vector) -> DataFrame:
    """file_id, embedding, error, cached of all files: what the cache has under the model, the rest from their texts."""
    cached, rest = split_cached(files, cache, model)
    known = cached.select("file_id", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return known.unionByName(embed_batches(embedding_text(rest), embed).withColumn("cached", F.lit(False)))

"""Token ids in training order: a keyed Feistel permutation gives every sequence a slot, and ranges of slots are written as shards of fixed stride."""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldergraph.llm.common import NO_ID, text_key
from foldergraph.sources.shared import cut, new_dir, slices, store_of

#: Public byte-level BPE, ids below 50256; 50256 is free and ends a document here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
END = 50256
SEQUENCE = 1024
SHARD_BYTES = 16 << 20
KEY = 0x5EED
ROUNDS = 6
IDS = np.dtype("<u2")
#: How such vocabularies part a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space before a space: only there may a pre-token go on over the place before a space.
_BEFORE_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　] ")
#: Parts the chunks that are encoded in one call; a Unicode noncharacter, and an id that no vocabulary here has.
_PART, _PART_ID = "﷐part﷐", 65535
_STEP = 16 << 20


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={_PART: _PART_ID})


def encoded(texts: list[str], path: str = VOCABULARY, end: list[int] | None = None) -> np.ndarray:
    """The ids of the texts, each followed by `end`.

    Where no white space stands before a space, words part as pre-tokens do: distinct words are encoded once, each with the space before
    it, and their ids put together by their places. Other texts, and each text's first word, are encoded by themselves.
    """
    model = encoding(path)
    whole = [_BEFORE_SPACE.search(x) is not None or _PART in x for x in texts]
    parts = pc.split_pattern(pa.array(["" if alone else x for x, alone in zip(texts, whole)], pa.large_string()), " ")
    found = parts.flatten().dictionary_encode()
    ids = model.encode_to_numpy(_PART.join(" " + w for w in found.dictionary.to_pylist()), allowed_special={_PART}).astype(IDS)
    stop = np.r_[np.flatnonzero(ids == _PART_ID), len(ids)]
    start = np.r_[0, stop[:-1] + 1]
    heads = [model.encode_ordinary(x if alone else x.partition(" ")[0]) for x, alone in zip(texts, whole)]
    lone = np.fromiter(map(len, heads), np.int64, len(heads))
    # entries: distinct words, then each text's head, then the end; a text is a row of entries
    size = np.r_[stop - start, lone, len(end or ())]
    begin = np.r_[start, len(ids) + np.cumsum(lone) - lone, len(ids) + lone.sum()]
    flat = np.concatenate([ids, np.fromiter((i for x in heads for i in x), IDS, int(lone.sum())), np.array(end or [], IDS)])
    row, edge = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), parts.offsets.to_numpy().astype(np.int64)
    row[edge[:-1]] = len(start) + np.arange(len(texts))
    row = np.insert(row, edge[1:], len(size) - 1)
    n = size[row]
    return flat[np.repeat(begin[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1 that the key decides: Feistel rounds over the next even number of bits, walked on while n or more."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def mixed(x: np.ndarray, k: int) -> np.ndarray:
        x = (x + np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in range(rounds):
            left, right = right, left ^ (mixed(right, k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def token_runs(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """part, at, ids: the documents in order of (doc_id, text hash), each with its end mark, as runs of ids.

    part counts the ranges of the order, at the ids of a range before the run; a null doc_id comes first.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at = TaskContext.get().partitionId(), 0
        for frame in frames:
            run = np.cumsum([len(x) for x in frame["text"]]) // _STEP
            for _, texts in frame["text"].groupby(run, sort=False):
                data = encoded(texts.tolist(), path, [END]).tobytes()
                yield pd.DataFrame({"part": [part], "at": [at], "ids": [data]})
                at += len(data) // IDS.itemsize

    order = [F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key().alias("key")]
    rows = docs.select(*order, F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(slices(docs.sparkSession), "doc", "key").sortWithinPartitions("doc", "key")
    return rows.select("text").mapInPandas(encode, "part int, at long, ids binary")


SHARD_ROWS = "slot long, shard long, offset long, n_tokens int, crc32 long, path string"


def token_shards(docs: DataFrame, folder: str | None = None, path: str = VOCABULARY, length: int = SEQUENCE, shard_bytes: int = SHARD_BYTES, key: int = KEY) -> DataFrame:
    """Write the texts of docs as shards below folder; a row per sequence: slot, shard, offset in its file, n_tokens, crc32, path.

    The documents, in order of doc_id (then of a hash of the text) and each with an end mark, are one row of ids, which is cut every
    `length`; the last sequence is filled up with end marks. The key alone decides a sequence's slot, so that the same table gives the
    same shards however it is split. Slot s lies in shard s // (sequences a shard) at a fixed stride: training reads shards from front
    to end and resumes at any slot by its number. A shard is written under another name and put in the place of what is there; a
    repeated task writes the same bytes. Null and empty texts give an end mark only, a table without rows gives no shard; repeated rows
    are written again, other columns are not used.
    """
    spark = docs.sparkSession
    stride = length * IDS.itemsize
    per = max(1, shard_bytes // stride)
    folder = folder or new_dir(spark, "shards")
    runs = cut(token_runs(docs, path), "runs")
    sizes = runs.groupBy("part").agg(F.sum(F.expr(f"octet_length(ids) div {IDS.itemsize}")).alias("k"))  # a row for each range
    starts = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("start"))
    n = -(-(sizes.agg(F.sum("k")).head()[0] or 0) // length)
    shards = -(-n // per)
    tasks = max(1, min(shards, slices(spark)))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What a run has for a shard goes as one compressed row: its pieces of sequences with their slots, places and sizes."""
        packer = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            out = []
            for first, data in zip(frame["start"], frame["ids"]):
                last = first + len(data) // IDS.itemsize
                edge = np.r_[first, np.arange(first // length + 1, -(-last // length)) * length, last]
                slot = feistel(edge[:-1] // length, n, key)
                for own in np.split(order := np.argsort(slot), np.flatnonzero(np.diff(slot[order] // per)) + 1):
                    cuts = ((edge[own] - first) * IDS.itemsize).tolist(), ((edge[own + 1] - first) * IDS.itemsize).tolist()
                    place = np.stack([slot[own], edge[own] % length, edge[own + 1] - edge[own]]).astype(np.int64)
                    out.append((int(slot[own[0]]) // per, place.tobytes(), packer.compress(b"".join(data[a:b] for a, b in zip(*cuts)))))
            yield pd.DataFrame(out, columns=["shard", "places", "data"])

    def put(shard: int, rows: list[tuple[bytes, bytes]]) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        slots = min(per, n - shard * per)
        ids, count = np.full(slots * length, END, IDS), np.zeros(slots, np.int32)
        for places, data in rows:
            slot, at, k = np.frombuffer(places, np.int64).reshape(3, -1)
            begin = (slot - shard * per) * length + at
            np.add.at(count, slot - shard * per, k)
            ids[np.repeat(begin - (np.cumsum(k) - k), k) + np.arange(k.sum())] = np.frombuffer(unpack(data), IDS)
        store, top = store_of(folder)
        store.create_dir(top, recursive=True)
        name, raw = f"{top}/shard-{shard:08d}.bin", ids.tobytes()
        own = f"{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(own, compression=None) as out:
            out.write(raw)
        if not isinstance(store, pafs.LocalFileSystem) and store.get_file_info(name).type == pafs.FileType.File:
            store.delete_file(name)
        store.move(own, name)
        slot, crc = np.arange(slots), [zlib.crc32(raw[k * stride : (k + 1) * stride]) for k in range(slots)]
        return pd.DataFrame({"slot": shard * per + slot, "shard": shard, "offset": slot * stride, "n_tokens": count, "crc32": crc, "path": f"{folder}/shard-{shard:08d}.bin"})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task holds a range of shards, sorted; the rows of one shard are in memory at a time."""
        now, rows = None, []
        for frame in frames:
            for shard, *row in frame.itertuples(index=False):
                if rows and shard != now:
                    yield put(now, rows)
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield put(now, rows)

    placed = runs.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at")).alias("start"), "ids")
    dealt = placed.mapInPandas(pieces, "shard long, places binary, data binary").repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {max(1, shards)} AS int)"))
    return dealt.sortWithinPartitions("shard").mapInPandas(write, SHARD_ROWS)


def read_slots(path: str, offset: int, length: int = SEQUENCE, count: int = 1) -> np.ndarray:
    """`count` sequences of a shard from a byte offset on, as an array of ids."""
    store, name = store_of(path)
    with store.open_input_file(name) as f:
        f.seek(offset)
        return np.frombuffer(f.read(count * length * IDS.itemsize), IDS).reshape(-1, length)

"""Quality rules: counted rules, then the perplexity of a modified Kneser-Ney model of word pairs, with an upper and a lower bound for each language.

What the model counts, the distinct pairs of words, grows with the corpus, so no task holds it. Texts are made into chunks of word
numbers; a chunk sends its distinct pairs, as sorted hash arrays, to the buckets that add them up, and each bucket answers every chunk
with the counts of the pairs that it sent. What is left for a chunk to know is a fixed number of word classes: how often each stands
before another word and after how many different ones.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import dataset as pads
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.llm.common import same_row, text_key
from foldergraph.sources.shared import cut, new_dir, slices, store_of, write

#: Words, A-Z as a-z, are known by so many bits of their XXH64. Words of one class count as one word; the tables of a language have a
#: place for each class and so a fixed size, whatever the corpus is.
CLASS_BITS = 22
CLASSES = 1 << CLASS_BITS
#: The class of a text's begin and end; no word gets it.
EDGE = 0
#: An odd factor: multiplying by it modulo 2 ** (2 * CLASS_BITS) deals pairs evenly and can be undone.
MIX = 0x9E3779B97F4A7C15
PAIRS = 1 << 2 * CLASS_BITS
#: Words in a chunk, words for which there is a bucket of pairs, classes in a row of the tables.
CHUNK_WORDS = 3 << 19
BUCKET_WORDS = 3 << 20
RANGE = 1 << 16
#: Pairs whose probabilities are taken at a time.
STEP = 1 << 18
#: Tables of a language: occurrences of a class before another, pairs it begins that occur once, twice, more often; pairs that it ends.
TABLES = 5
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Bounds of log perplexity, in median absolute deviations (scaled to standard deviations) below and above the median. Each is the narrowest
#: of the widths 10, 9, ..., 2 at which the documents beyond it are of label 0 at least ten times as often as of label 1, and 10 where there
#: is none. They were fitted once, on the 3 534 labelled documents of sf0.1 that pass the counted rules; no labels are read here.
LOWER, UPPER = 10.0, 3.0
#: Log perplexities are rounded to this before medians are taken, which bounds the bins.
GRAIN = 0.001
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(text: str | None, words: list[bytes] | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null has none. words: its words, where they are known."""
    text = text or ""
    words = text.encode().split() if words is None else words  # at space and \x09-\x0D
    n, lines = len(words), text.split("\n")
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x.encode().split()]
        dup = len(full) - len(set(full))
    repeated = 0
    if n >= 3:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
        pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1]
        found, place, times = np.unique(pair[:-1] * np.int64(len(names)) + ids[2:], return_inverse=True, return_counts=True)
        if len(found) < n - 2:
            often, cover = times[place] > 1, np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= often
            repeated = int(cover.sum())
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeated


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed bytes; their lowest bytes come first, then the next ones."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 9)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def word_class(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) % (CLASSES - 1) + 1


CHUNK = "g long, lang string, doc_id array<string>, text_key array<long>, n array<long>, counts array<long>, classes binary, words binary"


def chunks(docs: DataFrame) -> DataFrame:
    """CHUNK rows: some documents of one language, their counts, the classes of their distinct words, and the words as numbers of these."""

    class Open:
        """A chunk that is being filled."""

        def __init__(self) -> None:
            self.names: dict[bytes, int] = {}
            self.docs: list[tuple] = []
            self.words: list[np.ndarray] = []
            self.size = 0

        def add(self, doc_id: str | None, key: int, text: str) -> None:
            words = text.encode().split()
            names = self.names
            self.words.append(np.fromiter((names.setdefault(w, len(names)) for w in map(bytes.lower, words)), np.int64, len(words)))
            self.docs.append((doc_id, key, len(words), *counted(text, words)))
            self.size += len(words)

        def row(self, g: int, lang: str) -> pd.DataFrame:
            doc_id, key, n, *counts = zip(*self.docs)
            classes = np.fromiter(map(word_class, self.names), np.int64, len(self.names))
            return pd.DataFrame({"g": [g], "lang": [lang], "doc_id": [list(doc_id)], "text_key": [list(key)], "n": [list(n)], "counts": [np.array(counts, np.int64).T.ravel()], "classes": [packed(classes)], "words": [packed(np.concatenate(self.words))]})

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId() << 32, 0
        filling: dict[str, Open] = {}
        for frame in frames:
            for doc_id, key, lang, text in frame.itertuples(index=False):
                chunk = filling.setdefault(lang, Open())
                chunk.add(doc_id, key, text)
                # many languages share what a task may hold
                if chunk.size * max(1, len(filling) // 8) >= CHUNK_WORDS or len(chunk.docs) >= CHUNK_WORDS:
                    yield filling.pop(lang).row(part + k, lang)
                    k += 1
        while filling:
            lang, chunk = filling.popitem()
            yield chunk.row(part + k, lang)
            k += 1

    # doc_id as string: pandas would make floats of nullable integers
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key().alias("text_key"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(fill, CHUNK)


def chunk_pairs(n: np.ndarray, classes: bytes, words: bytes) -> np.ndarray:
    """The pairs of neighbouring classes of a chunk, mixed, in order of the texts: a text of k words has k + 1, as edges count. Texts without words have none."""
    known = np.r_[unpacked(classes), EDGE]
    words, n = unpacked(words), n[n > 0]
    ends = np.cumsum(n)
    row = known[np.insert(words.astype(np.int32), np.r_[0, ends][: len(n)], len(known) - 1)] if len(n) else np.zeros(0, np.int64)
    row = np.r_[row, EDGE] if len(n) else row
    pair = (row[:-1].astype(np.uint64) << np.uint64(CLASS_BITS)) | row[1:].astype(np.uint64)
    return (pair * np.uint64(MIX)) & np.uint64(PAIRS - 1)


def split_pair(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes of mixed pairs."""
    pair = (mixed * np.uint64(pow(MIX, -1, 1 << 64))) & np.uint64(PAIRS - 1)
    return (pair >> np.uint64(CLASS_BITS)).astype(np.int64), (pair & np.uint64(CLASSES - 1)).astype(np.int64)


ANSWER, TABLE, TIMES = 0, 1, 2


def counted_pairs(parts: DataFrame, buckets: int, low: int = 0, high: int | None = None) -> DataFrame:
    """Of the buckets from low to high: kind, lang, g, k, data from chunks: ANSWER, how often other chunks have the pairs that chunk g sent to bucket k; TABLE, what a bucket adds to the
    tables of the classes from k * RANGE on; TIMES, how many pairs occur once, twice, three and four times in a bucket."""

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, lang, n, classes, words in frame[["g", "lang", "n", "classes", "words"]].itertuples(index=False):
                mixed, times = np.unique(chunk_pairs(np.asarray(n, np.int64), classes, words), return_counts=True)
                at = bucket_bounds(mixed, buckets)
                out = [(lang, k, g, packed(np.diff(mixed[a:b].astype(np.int64), prepend=0)), packed(times[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if a < b and low <= k < (buckets if high is None else high)]
                yield pd.DataFrame(out, columns=["lang", "k", "g", "pairs", "times"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        lang, k = frame["lang"].iloc[0], int(frame["k"].iloc[0])
        sent = [np.cumsum(unpacked(x)) for x in frame["pairs"]]
        found, place = np.unique(np.concatenate(sent), return_inverse=True)
        own_times = np.concatenate([unpacked(x) for x in frame["times"]])
        times = np.bincount(place.ravel(), own_times.astype(np.float64), len(found)).astype(np.int64)
        ends = np.cumsum([len(x) for x in sent])
        # a chunk knows its own counts; what others have is mostly none, which takes little room
        others = times[place.ravel()] - own_times
        out = [(ANSWER, lang, g, k, packed(others[b - len(x) : b])) for g, x, b in zip(frame["g"].tolist(), sent, ends.tolist())]
        first, second = split_pair(found.astype(np.uint64))
        begun = [times, times == 1, times == 2, times > 2]
        order, order2 = np.argsort(first, kind="stable"), np.sort(second)
        edges = np.arange(0, CLASSES + 1, RANGE)
        for r, (a, b, c, d) in enumerate(zip(*(np.searchsorted(x, e).tolist() for x in (first[order], order2) for e in (edges[:-1], edges[1:])))):
            if a < b or c < d:
                own = first[order[a:b]] - r * RANGE
                table = [np.bincount(own, x[order[a:b]].astype(np.float64), RANGE) for x in begun] + [np.bincount(order2[c:d] - r * RANGE, minlength=RANGE)]
                out.append((TABLE, lang, k, r, zstandard.compress(np.stack(table).astype(np.int64).tobytes(), 3)))
        out.append((TIMES, lang, k, 0, packed(np.array([(times == x).sum() for x in (1, 2, 3, 4)], np.int64))))
        return pd.DataFrame(out, columns=["kind", "lang", "g", "k", "data"])

    rows = parts.mapInPandas(send, "lang string, k int, g long, pairs binary, times binary")
    return rows.groupBy("lang", "k").applyInPandas(add, "kind int, lang string, g long, k int, data binary")


def bucket_bounds(mixed: np.ndarray, buckets: int) -> list[int]:
    """Where the pairs of each bucket begin in a sorted array, and where the last end."""
    inner = np.array([k * PAIRS // buckets for k in range(1, buckets)], np.uint64)
    return [0, *np.searchsorted(mixed, inner).tolist(), len(mixed)]


def summed_tables(rows: DataFrame) -> DataFrame:
    """lang, k, data (compressed int64 of TABLES * RANGE) from TABLE rows; added up in two steps, so that no task gets all buckets' rows."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(TABLES * RANGE, np.int64)
        for data in frame["data"]:
            total += np.frombuffer(zstandard.decompress(data), np.int64)
        return frame[["lang", "g", "k"]].head(1).assign(data=zstandard.compress(total.tobytes(), 3))

    schema = "lang string, g long, k int, data binary"
    first = rows.select("lang", F.expr("g div 256").alias("g"), "k", "data").groupBy("lang", "g", "k").applyInPandas(add, schema)
    return first.groupBy("lang", "k").applyInPandas(add, schema).select("lang", "k", "data")


def discounts(times: np.ndarray) -> list[float]:
    """Modified Kneser-Ney: what counts of 0, 1, 2 and 3 or more lose, from how many things occur one to four times.

    Few things can give estimates out of range, which are replaced by half the count; a discount of zero would leave nothing for what was not seen.
    """
    t = [0.0, *map(float, times)]
    y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
    found = [c - (c + 1) * y * t[c + 1] / t[c] if t[c] else 0.0 for c in (1, 2, 3)]
    return [0.0, *(d if 0 < d <= c else c / 2 for c, d in zip((1, 2, 3), found))]


class PairModel:
    """A language's tables and discounts.

    of pairs it gives log probabilities with the pair's own occurrence left out of all counts, since the texts that are scored are those
    that were counted: what a text alone has is not likely for it.
    """

    def __init__(self, tables: Iterator[tuple[int, np.ndarray]], times: np.ndarray):
        """tables: (k, TABLES * RANGE numbers of the classes from k * RANGE on)."""
        self.d2 = np.array(discounts(times))
        self.total, self.left, self.after = np.zeros(CLASSES, np.int64), np.zeros(CLASSES), np.zeros(CLASSES, np.int32)
        for k, data in tables:
            own = slice(k * RANGE, (k + 1) * RANGE)
            self.total[own], ones, twos, more, self.after[own] = data.reshape(TABLES, RANGE)
            self.left[own] = ones * self.d2[1] + twos * self.d2[2] + more * self.d2[3]
        self.d1 = np.array(discounts([int((self.after == k).sum()) for k in (1, 2, 3, 4)]))
        self.pairs = int(self.after.sum(dtype=np.int64))
        self.rest = float(self.d1[np.minimum(self.after, 3)].sum())

    def logp(self, mixed: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log probability of the second class of each mixed pair after the first; n: how often the pair occurs."""
        return np.concatenate([np.zeros(0), *(self._logp(*split_pair(mixed[k : k + STEP]), n[k : k + STEP]) for k in range(0, len(mixed), STEP))])

    def _logp(self, first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
        d = lambda table, x: table[np.minimum(x, 3)]
        once = (n == 1).astype(np.int64)
        seen = self.after[second].astype(np.int64) - once
        # a pair that occurs once is not known without itself: its second class then ends one pair less
        rest = self.rest - once * (d(self.d1, seen + 1) - d(self.d1, seen))
        short = np.maximum(self.pairs - once, 1)
        low = np.where(self.pairs - once > 0, (seen - d(self.d1, seen)) / short + rest / short / CLASSES, 1 / CLASSES)
        total = self.total[first] - 1
        of = np.maximum(total, 1)
        left = self.left[first] - d(self.d2, n) + d(self.d2, n - 1)
        return np.log(np.where(total > 0, (n - 1 - d(self.d2, n - 1)) / of + left / of * low, low))


def load_model(path: str, lang: str, times: np.ndarray) -> PairModel:
    """A language's tables, of fixed size, from the shared folder."""
    store, top = store_of(path)
    rows = pads.dataset(top, filesystem=store, format="parquet").to_table(filter=pads.field("lang") == lang).to_pylist()
    return PairModel(((row["k"], np.frombuffer(zstandard.decompress(row["data"]), np.int64)) for row in rows), times)


def load_answers(path: str, g: int, part: int) -> np.ndarray:
    """How often each of a chunk's distinct pairs occurs in other chunks, in the order of the mixed pairs."""
    store, top = store_of(path)
    rows = pads.dataset(f"{top}/part={part}", filesystem=store, format="parquet").to_table(columns=["k", "data"], filter=pads.field("g") == g).to_pylist()
    return np.concatenate([unpacked(x["data"]) for x in sorted(rows, key=lambda x: x["k"])])


SCORES = "doc_id string, text_key long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, the five counts, log_perplexity per word and end of text (null for texts without words) for each row of docs."""
    spark = docs.sparkSession
    parts = cut(chunks(docs), "chunks")
    total, many = parts.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.count("*")).head()
    buckets = max(1, -(-total // BUCKET_WORDS))
    middle = buckets // 2  # half of the buckets at a time, so that half of the pairs are shuffled at once
    found = functools.reduce(DataFrame.unionByName, [cut(counted_pairs(parts, buckets, a, b), "pairs") for a, b in ((0, middle), (middle, buckets)) if a < b])
    path, answers = new_dir(spark, "tables"), new_dir(spark, "answers")
    write(summed_tables(found.filter(F.col("kind") == TABLE)), path)
    # a chunk finds its answers in the folder of its part, so that chunks needn't be shuffled
    part = F.pmod(F.xxhash64("g"), F.lit(max(1, many // 8))).cast("int").alias("part")
    told = found.filter(F.col("kind") == ANSWER).select("g", "k", "data", part)
    write(told.repartition(max(1, min(slices(spark), many // 8)), "part").sortWithinPartitions("part", "g"), answers, ("part",))
    # a row for each language
    times: dict[str, np.ndarray] = {}
    for lang, data in found.filter(F.col("kind") == TIMES).groupBy("lang").applyInPandas(lambda f: pd.DataFrame({"lang": f["lang"].head(1), "data": [packed(np.sum([unpacked(x) for x in f["data"]], axis=0))]}), "lang string, data binary").collect():
        times[lang] = unpacked(data)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = None, None  # one language's at a time
        for frame in frames:
            for row in frame.itertuples(index=False):
                n = np.asarray(row.n, np.int64)
                mixed, place, own = np.unique(chunk_pairs(n, row.classes, row.words), return_inverse=True, return_counts=True)
                sums = np.zeros(len(n))
                if len(mixed):
                    if model is None or row.lang != held:
                        model, held = load_model(path, row.lang, times[row.lang]), row.lang
                    logp = model.logp(mixed, own + load_answers(answers, row.g, row.part))[place.ravel()]
                    sums[n > 0] = np.add.reduceat(logp, np.r_[0, np.cumsum(n[n > 0] + 1)[:-1]])
                out = pd.DataFrame({"doc_id": list(row.doc_id), "text_key": np.asarray(row.text_key, np.int64), "lang": row.lang})
                for name, values in zip(COUNTS, np.asarray(row.counts, np.int64).reshape(-1, len(COUNTS)).T):
                    out[name] = values
                yield out.assign(log_perplexity=np.where(n > 0, -sums / (n + 1), np.nan))

    rows = parts.select("*", part).sortWithinPartitions("lang").mapInPandas(score, SCORES)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("log_perplexity", F.nanvl("log_perplexity", F.lit(None)))


def _median(bins: DataFrame) -> DataFrame:
    """lang, mid of bins(lang, bin, n): the bin that holds the middle row. A language has few bins, however many rows."""
    w = Window.partitionBy("lang")
    upto = F.sum("n").over(w.orderBy("bin"))
    return bins.withColumn("in", 2 * upto >= F.sum("n").over(w)).filter("`in`").groupBy("lang").agg(F.min("bin").alias("mid"))


def perplexity_bands(rows: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """lang, low, high: bounds of log perplexity from all rows(lang, log_perplexity, base_failed) that pass the counted rules."""
    bins = rows.filter("NOT base_failed AND log_perplexity IS NOT NULL").groupBy("lang", F.round(F.col("log_perplexity") / GRAIN).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = cut(bins, "bins")  # few rows a language, however many documents
    mid = _median(bins)
    off = bins.join(mid, "lang").groupBy("lang", F.abs(F.col("bin") - F.col("mid")).alias("bin")).agg(F.sum("n").alias("n"))
    spread = _median(off).select("lang", (F.greatest(F.col("mid"), F.lit(10)) * GRAIN * 1.4826).alias("spread"))
    at = F.col("mid") * GRAIN
    return mid.join(spread, "lang").select("lang", (at - lower * F.col("spread")).alias("low"), (at + upper * F.col("spread")).alias("high"))


def quality_rules(docs: DataFrame, lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): doc_id, text_key, lang, five counts, log_perplexity, low, high, base_failed, kept.

    base_failed: fewer than 50 words, or more than half of them in 3-word windows that the text repeats. kept: passed, and the
    log perplexity lies within the bounds of its language (from `lower` scaled median absolute deviations below the median of all
    documents that passed to `upper` above it). The model is counted over all texts. Null text counts as empty, null lang as a language of its
    own; repeated rows count again.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = cut(scored(docs).withColumn("base_failed", failed), "scores")
    rows = rows.join(F.broadcast(perplexity_bands(rows, lower, upper)), "lang", "left")  # a row for each language
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & inside)


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs(doc_id, text, lang) that the quality rules keep, with all their columns, whatever their names are.

    Null and empty texts have fewer words than the rules ask for and go; null doc_ids are told apart by their texts, a null lang is one
    of its own; rows that repeat doc_id, text and lang stay or go together; an empty table stays empty.
    """
    kept = quality_rules(docs, **options).filter("kept").select("doc_id", "text_key", "lang").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_key().alias("text_key"), F.coalesce("lang", F.lit("")).alias("lang"))
    return same_row(keyed, kept, ["doc_id", "text_key", "lang"], "left_semi").select("row.*")

"""Periodic runs of words: stretches that repeat a block of words four times or more, found by a sparse DP over diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldergraph.llm.common import WORD
from foldergraph.llm.words import joined, split_words, steps

#: A run has at least so many words, and its block at least so many times.
LEAST, TIMES = 6, 4
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def emitted(at: np.ndarray, lag: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, period) of the diagonals that end with sufficient length.

    at: words, ascending, that have met their context of `context` words before; lag: how far back. A word right after the last one
    with the same lag makes its diagonal one longer; any other ends it.
    """
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(lag) != 0)]
    first = np.flatnonzero(new)
    length = np.diff(np.r_[first, len(at)])
    q = lag[first]
    # a diagonal's first word stands for `context` equal words, which with the block before them belong to the run
    good = (2 * q > context) & (q <= context) & (length + context - 1 + q >= np.maximum(LEAST, TIMES * q))
    first, length, q = first[good], length[good], q[good]
    return at[first] - context - q + 1, at[first] + length - 1, q


def runs_of(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word, period) of every run, by first word, then period. words: a number for each distinct word, texts one
    after the other; starts: where each text begins, and the end.

    Each word goes on with the lags of its earlier occurrences. Of these only one for each power of two L can lead to a run of a
    period q with L/2 < q <= L: the nearest occurrence of the word with the L - 1 words before it. Inside a run that repeats its block
    four times the block is no power of a shorter one, so the nearest such occurrence is q words back, and no longer lag could end as
    a run; a lag of that kind that lasts has no shorter period. So a diagonal is a stretch of words with one lag, and all others,
    whose number may grow with the square of a text, need not be followed. A context that occurs once has no occurrence in any longer
    one, so the words looked at get few quickly.
    """
    n = len(words)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # a context's name: a number for each distinct one within a text, -1 where it occurs once
    name, key, at, context, found = np.full(n, -1, np.int64), text * (int(words.max(initial=0)) + 1) + words, np.arange(n), 1, []
    longest = int(np.diff(starts).max(initial=0))
    while len(at):
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        same = np.r_[False, key[1:] == key[:-1]]
        again = same | np.r_[same[1:], False]
        label = np.cumsum(~same)
        last = np.r_[0, at[:-1]]
        hit = np.flatnonzero(same)
        by = np.argsort(at[hit], kind="stable")
        if len(hit):
            found.append(emitted(at[hit][by], (at - last)[hit][by], context))
        name[:] = -1
        name[at[again]] = label[again]
        if TIMES * context >= longest:
            break
        at = np.sort(at[again])
        at = at[at >= context]
        before = name[at - context]
        at, before = at[before >= 0], before[before >= 0]
        key = before * (int(label[-1]) + 1) + name[at]
        context *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    first, last, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, first))
    return first[order], last[order], q[order]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, runs (start in words from 0, length, period; by start, then period), collapsed.

    A run is a stretch of words with smallest period q and at least max(LEAST, TIMES * q) words that no neighbouring word extends.
    collapsed: the text's words joined by one space, less those that a run holds after its first q words. Null counts as empty: no
    runs, collapsed empty. Rows of one doc_id are treated each by itself; a text is searched whole, in memory that grows with it alone.
    Other columns are not carried.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            for part in steps(batch):
                words, starts = split_words(part.column("text"))
                ids = np.asarray(words.dictionary_encode().indices, np.int64)
                first, last, q = runs_of(ids, starts)
                inside = np.zeros(len(ids) + 1, np.int32)
                np.add.at(inside, first + q, 1)
                np.add.at(inside, last + 1, -1)
                kept = np.cumsum(inside[:-1]) == 0
                text = np.searchsorted(starts, first, "right") - 1
                rows = pa.StructArray.from_arrays([pa.array(first - starts[text]), pa.array(last - first + 1), pa.array(q)], fields=list(kind))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(starts))), pa.int32()), rows)
                collapsed = joined(words, starts, kept).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(starts)), runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, RUNS)


def with_echo(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs, where a tenth of the texts get a tail that repeats itself.

    With h = crc32(decimal doc_id), g = h div 10 and n words: if h % 10 = 0 and n > 0, the words from number a = g % n on repeat the
    first p = 1 + (n - a) div (3 + g % 8) of them. Such a text has one space between words; the others stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).withColumn("n", F.size("words"))
    g, n = F.floor(F.col("h") / 10), F.col("n").cast("long")
    a = g % F.greatest(n, F.lit(1))
    times = 3 + g % 8
    rows = rows.withColumns({"a": a.cast("int"), "times": times.cast("int"), "p": (1 + F.floor((n - a) / times)).cast("int")})
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.col("times"))), F.lit(1), F.col("n") - F.col("a"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def longest_run(runs: Column) -> Column:
    """The run with the greatest length (ties: smallest start, then period); null if there is none."""
    first = lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))
    return F.array_min(F.transform(runs, first))

"""Keyword profiles: term counts, TF-IDF, and the union of content, name and tag terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.functions.text import extension_tag, stem, terms
from foldergraph.functions.values import STOPWORDS, TAG_SCORE, TOP_PROFILE, TOP_TERMS
from foldergraph.operators.skew import group_totals, salt
from foldergraph.sources.shared import cut, dealt


def top_terms(rows: DataFrame, n: int, key: str = "file_id") -> DataFrame:
    """The n highest scores a key; on a tie the smaller term."""
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "term")
    return rows.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


_WORD, _NO_TERM = re.compile("[a-zA-Z0-9]+"), frozenset(STOPWORDS)


def _most_frequent(texts: Iterable[str], n: int) -> list[tuple[str, float]]:
    """terms() of the texts together, counted: the n most frequent with their counts, in order; on a tie the smaller term."""
    seen, own = Counter(), Counter()
    for text in texts:
        seen.update(_WORD.findall(text))
    for w, k in seen.items():
        if len(w) >= 3 and not w.isdecimal() and (low := w.lower()) not in _NO_TERM:
            own[low] += k
    return [(w, float(k)) for w, k in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:n]]


def _arrays(ends: list[int], **cols: pa.Array) -> pa.Array:
    """An array of arrays of structs of cols; ends: where each begins, and where the last ends."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(cols.values()), names=list(cols)))


def _counted(n: int) -> Callable[[Column], Column]:
    """_most_frequent() of an array of texts."""

    @F.arrow_udf("array<struct<term string, score double>>")
    def count(texts: pa.Array) -> pa.Array:
        ends, found = [0], []
        for row in texts:
            found += _most_frequent((text.as_py() for text in row), n)
            ends.append(len(found))
        return _arrays(ends, term=pa.array([w for w, _ in found], pa.string()), score=pa.array([k for _, k in found], pa.float64()))

    return count


def _one_list(counts: list[tuple[str, float]], names: list[list[str]], tags: list[str], n: int) -> list[tuple[str, float, int]]:
    """term, tf, dup of a file as merged_entries() says."""
    rows = [(-k, 0, at, w) for at, (w, k) in enumerate(counts)]
    rows += [(-1.0, 1, at, w) for name in names for at, w in enumerate(name)] + [(-TAG_SCORE, 2, 0, w) for w in tags]
    by_term: dict[str, list[tuple]] = {}
    for row in sorted(rows)[:n]:
        by_term.setdefault(row[3], []).append(row)
    tf = (lambda own: max(own, key=lambda x: x[1:3])) if len(rows) <= n else max  # beyond n the lowest score, the last of the order
    return [(w, -tf(own)[0], len(own)) for w, own in by_term.items()]


def _merged(n: int) -> Callable[[Column, Column, Column], Column]:
    """_one_list() of arrays of a file's texts, names' terms and tags."""

    @F.arrow_udf("array<struct<term string, tf double, dup bigint>>")
    def merge(texts: pa.Array, names: pa.Array, tags: pa.Array) -> pa.Array:
        ends, found = [0], []
        for own, name, tag in zip(texts, names, tags, strict=True):
            found += _one_list(_most_frequent((text.as_py() for text in own), n), name.as_py(), tag.as_py(), n)
            ends.append(len(found))
        term, tf, dup = zip(*found, strict=True) if found else ((), (), ())
        return _arrays(ends, term=pa.array(term, pa.string()), tf=pa.array(tf, pa.float64()), dup=pa.array(dup, pa.int64()))

    return merge


def term_frequency(contents: DataFrame, n: int = TOP_TERMS, n_files: int | None = None) -> DataFrame:
    """file_id, term, score (count), place: the n most frequent terms of each content. n_files: how many contents there are, if known.

    Contents are dealt by file_id once, to tasks that get more, not larger, as the files do. A file's terms are counted by themselves:
    what a task holds are its texts, not a table of the terms of all its files.
    """
    n_files = contents.count() if n_files is None else n_files
    found = dealt(contents.select("file_id", "content"), "file_id", n_files * n)
    found = found.groupBy("file_id").agg(F.collect_list("content").alias("texts"))  # one text, if ids aren't repeated
    found = found.select("file_id", F.posexplode(_counted(n)(F.col("texts"))).alias("at", "e"))
    return found.select("file_id", "e.term", "e.score", (F.col("at") + 1).alias("place"))


def content_entries(contents: DataFrame, n_files: int | None = None) -> DataFrame:
    """file_id, term, tf, dup from content alone; n_files as in term_frequency()."""
    return term_frequency(contents, n_files=n_files).select("file_id", "term", F.col("score").alias("tf"), F.lit(1).cast("long").alias("dup"))


def merged_entries(files: DataFrame, n: int = TOP_TERMS, contents: DataFrame | None = None) -> DataFrame:
    """file_id, term, tf, dup from files(file_id, name, extension, content), or with their contents from contents(file_id, content).

    Content terms, name terms (1 each) and the extension's tag follow each other as one list. Up to n entries, a term's last entry
    gives tf; beyond, the n highest remain, in their order, and the last and so lowest of a term's gives it. dup: its entries.
    Each file's list is made by itself; entries of many files are never sorted together.
    """
    named = [terms(stem(F.col("name"))).alias("name"), extension_tag(F.col("extension")).alias("tag")]
    lists = [F.collect_list("name").alias("names"), F.collect_list("tag").alias("tags")]  # nulls are left out
    texts = F.collect_list("content").alias("texts")
    if contents is None:
        rows = files.select("file_id", *named, "content").repartition("file_id").groupBy("file_id").agg(texts, *lists)
    else:
        own = files.select("file_id", *named).repartition("file_id").groupBy("file_id").agg(*lists)
        found = contents.select("file_id", "content").repartition("file_id").groupBy("file_id").agg(texts)
        rows = own.join(found, "file_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    return rows.select("file_id", F.inline(_merged(n)(F.col("texts"), F.col("names"), F.col("tags"))))


def document_frequency(entries: DataFrame) -> DataFrame:
    """term, df: how many list entries have it, which may be more than there are files."""
    return entries.groupBy("term").agg(F.sum("dup").alias("df"))


def tfidf(entries: DataFrame, files: DataFrame, n: int = TOP_PROFILE) -> DataFrame:
    """file_id, term, score, place: tf * ln(N / df), the n highest a file; N counts the files, those without terms too."""
    rows = group_totals(entries.withColumn("_salt", salt(entries.sparkSession, "file_id")), ["term"], "_salt", df=("sum", "dup"))
    total = files.agg(F.count("*").alias("n_files"))  # one row
    rows = rows.crossJoin(F.broadcast(total))
    return top_terms(rows.select("file_id", "term", (F.col("tf") * F.log(F.col("n_files") / F.col("df"))).alias("score")), n)


def profiles(entries: DataFrame, files: DataFrame, n: int = TOP_PROFILE) -> tuple[DataFrame, DataFrame]:
    """(entries, tfidf() of them), both written: texts are read once, and tasks get more, not larger, as the files do."""
    entries = cut(entries, "entries", rows=files.count() * TOP_TERMS)
    return entries, cut(tfidf(entries, files, n), "keywords", rows=entries.count())


def keyword_stats(keywords: DataFrame, files: DataFrame) -> DataFrame:
    """files, empty, min (over files that have any), max and mean number of keywords."""
    n = files.select("file_id").join(keywords.groupBy("file_id").agg(F.count("*").alias("n")), "file_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count("*").alias("files"), F.count_if(F.col("n") == 0).alias("empty"), F.coalesce(F.min(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("min_terms"), F.max("n").alias("max_terms"), F.round(F.avg("n"), 6).alias("avg_terms"))

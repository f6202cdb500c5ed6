"""Filters, lists, lookups and counts over the file inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.functions.text import is_supported, normal_path
from foldergraph.functions.values import LIST_LIMIT, SORT_COLUMNS
from foldergraph.operators.skew import rank_in_key
from foldergraph.sources.shared import new_dir, slices, write


def filter_files(files: DataFrame, supported: bool | None = None, **equal) -> DataFrame:
    """Rows that meet every condition given: equality by column name, supported or not."""
    for column, value in equal.items():
        files = files.filter(F.col(column) == value)
    if supported is not None:
        files = files.filter(is_supported(F.col("extension")) if supported else ~is_supported(F.col("extension")))
    return files


def sort_order(by: str | None = None, direction: str = "desc") -> list[Column | str]:
    """By one of SORT_COLUMNS, any other counts as indexed_at; descending unless direction is asc; then by file_id."""
    column = F.col(by if by in SORT_COLUMNS else "indexed_at")
    return [column.asc() if direction.lower() == "asc" else column.desc(), "file_id"]


def sort_files(files: DataFrame, by: str | None = None, direction: str = "desc") -> DataFrame:
    return files.orderBy(*sort_order(by, direction))


def page(files: DataFrame, order: list[Column | str], limit: int = 50, offset: int = 0, direct: int = 1000) -> DataFrame:
    """The rows from number offset on, at most limit, in an order that is total.

    Up to `direct` rows from the first on, every task sends its first ones. Further on, rows are written in ranges of the order, a
    folder each; from the ranges' sizes follows which of them the page meets, and only those are read.
    """
    if offset + limit <= direct:
        return files.orderBy(*order).offset(offset).limit(limit)
    spark, path = files.sparkSession, new_dir(files.sparkSession, "pages")
    placed = files.repartitionByRange(slices(spark), *order).withColumn("_range", F.spark_partition_id())
    write(placed, path, ("_range",))
    sizes = spark.read.schema(placed.select("_range").schema).parquet(path)
    begin, met, before = 0, [], None
    for r in sizes.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # a row for each range
        if begin < offset + limit and begin + r["n"] > offset:
            met.append(r["_range"])
            before = begin if before is None else before
        begin += r["n"]
    rows = spark.read.schema(files.schema).parquet(*[f"{path}/_range={k}" for k in met]) if met else files.limit(0)
    return rows.orderBy(*order).offset(offset - (before or 0)).limit(limit)


def suggestion_summary(members: DataFrame, files: DataFrame, n: int = 5) -> DataFrame:
    """suggestion_id, file_count, preview: the first n names in order of name, joined; null names are left out of the preview.

    Tasks send counts and their own first names only, so a suggestion may have any share of the files.
    """
    rows = members.select("suggestion_id", "file_id").join(files.select("file_id", "name"), "file_id")
    counts = rows.groupBy("suggestion_id").agg(F.count("*").alias("file_count"))
    first = rows.filter("name IS NOT NULL").withColumn("i", F.row_number().over(Window.partitionBy("suggestion_id").orderBy("name"))).filter(F.col("i") <= n)
    names = F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"])
    shown = first.groupBy("suggestion_id").agg(F.array_join(names, ", ").alias("preview"))
    return counts.join(shown, "suggestion_id", "left").select("suggestion_id", "file_count", F.coalesce("preview", F.lit("")).alias("preview"))


def with_processable(files: DataFrame) -> DataFrame:
    return files.withColumn("processable", F.when(F.col("processing_status") == "unprocessed", is_supported(F.col("extension"))))


def lookup_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of table whose key is in keys; a key that is missing gives no row."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def files_in_folders(files: DataFrame, folders: DataFrame, limit: int | None = LIST_LIMIT) -> DataFrame:
    """Active files directly in the folders(path), newest ids first, at most `limit` a folder (None: all, without places)."""
    own = files.filter(F.col("status") == "active").withColumn("folder", normal_path(F.col("parent_dir")))
    own = own.join(folders.select(normal_path(F.col("path")).alias("folder")).distinct(), "folder", "left_semi")
    if limit is None:
        return own
    placed = rank_in_key(own, ["folder"], [F.col("file_id").desc()], "place")
    return placed.withColumn("place", (F.col("place") + 1).cast("int")).filter(F.col("place") <= limit)


def processing_stats(files: DataFrame, guards: DataFrame) -> DataFrame:
    """One row of counts over active files, and of guarded and open folders."""
    active = files.filter(F.col("status") == "active")
    state = lambda name: F.count_if(F.col("processing_status") == name).alias(name)
    ready = F.count_if((F.col("processing_status") == "unprocessed") & is_supported(F.col("extension")))
    counts = active.agg(F.count("*").alias("total"), ready.alias("extractable"), *map(state, ("queued", "processing", "processed", "failed")))
    return counts.crossJoin(guards.agg(F.count_if("guarded").alias("guarded"), F.count_if(~F.col("guarded")).alias("open")))  # one row each


def file_detail(files: DataFrame, comments: DataFrame, contents: DataFrame) -> DataFrame:
    """Files with their comment and content; an empty content is null."""
    said = comments.select("file_id", F.col("content").alias("comment"))
    text = contents.select("file_id", F.nullif(F.col("content"), F.lit("")).alias("content"))
    return files.drop("content").join(said, "file_id", "left").join(text, "file_id", "left")


def fetch_contents(keys: DataFrame, contents: DataFrame) -> DataFrame:
    """file_id, content of every key(file_id): an empty text where contents has no row or a null one. Repeated keys give a row each, of
    several contents of a file the greatest counts."""
    one = contents.groupBy("file_id").agg(F.max("content").alias("content"))
    return keys.select("file_id").join(one, "file_id", "left").select("file_id", F.coalesce("content", F.lit("")).alias("content"))

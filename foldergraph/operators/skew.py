"""Totals and lookups for keys of which one may hold a third of all rows, and numbers for all rows of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldergraph.sources.shared import cut, slices


def bucket(n: int, *cols: str) -> Column:
    """A hash of cols from 0 to n - 1, never null: joins on it add no null filter, so that equal shuffles stay equal and are shared."""
    return F.coalesce(F.pmod(F.xxhash64(*cols), F.lit(n)), F.lit(0).cast("long"))


def salt(spark: SparkSession, *cols: str) -> Column:
    """A number under the count of shuffle partitions, so that a hot key is dealt over as many tasks as there are."""
    return bucket(slices(spark), *cols).cast("int")


def group_totals(df: DataFrame, keys: list[str], salt_col: str, /, **aggs: tuple[str, str]) -> DataFrame:
    """Add totals by keys to every row; no task needs more than a salt's share of a key.

    aggs: name=(kind, column) with kind one of count, sum, min, max. Keys must not be null.
    """
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    parts = df.groupBy(*keys, salt_col).agg(*[first[kind](F.lit(1) if col == "*" else F.col(col)).alias(name) for name, (kind, col) in aggs.items()])
    w = Window.partitionBy(*keys)
    totals = parts.select(*keys, salt_col, *[again[kind](name).over(w).alias(name) for name, (kind, _) in aggs.items()])
    return df.join(totals, [*keys, salt_col])


def lookup(df: DataFrame, table: DataFrame, keys: list[str], salt_col: str) -> DataFrame:
    """Join table, which has a row for each key, to df, where a key may hold any share of the rows."""
    present = df.select(*keys, salt_col).distinct()
    return df.join(present.join(table, keys), [*keys, salt_col])


def _placed(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df in ranges of the order, written once, so that all readers see the same ranges; _range and _at tell a row's range and place in it."""
    placed = df.repartitionByRange(slices(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut(placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), name)


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Number all rows from 0 in the given order: a range sort, then an offset for each range."""
    placed = _placed(df, order, "ranked")
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def rank_in_key(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """Number the rows of each key from 0 in the given order; nulls are a key like any other. A key may hold any share of the rows.

    A range sort by keys and order; a task numbers what one range has of a key. Of the keys that meet in a range only its first and
    last can go on in another, so the offsets to add are two rows a range at most, and are broadcast.
    """
    placed = _placed(df, [*keys, *order], "ranked")
    key = F.struct(*keys)
    ends = placed.groupBy("_range").agg(F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_last"))
    ends = ends.select("_range", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_key"))
    counts = placed.withColumn("_key", key).join(F.broadcast(ends), ["_range", "_key"], "left_semi").groupBy("_range", "_key").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_range")) - F.col("_n")
    offsets = counts.select("_range", "_key", before.alias("_before")).filter("_before > 0").select("_range", F.col("_key").alias("_of"), "_before")
    place = F.row_number().over(Window.partitionBy("_range", *keys).orderBy("_at")) - 1
    rows, same = placed.withColumn(name, place), key.eqNullSafe(F.col("_of"))
    out = rows.join(F.broadcast(offsets), (rows["_range"] == offsets["_range"]) & same, "left")
    return out.select(*df.columns, (F.col(name) + F.coalesce("_before", F.lit(0))).cast("long").alias(name))

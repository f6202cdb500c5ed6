"""Line dedup by overlapping three-line windows: later occurrences of a window go, their covered lines merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.llm.common import NO_ID, same_row, text_key
from foldergraph.operators.skew import group_totals, salt

WINDOW_LINES = 3


def line_windows(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """doc (doc_id, or the least number for null), text_key, at, a, b: the lines from at on by two 64-bit hashes, each of other hashes of the lines,
    so that unlike windows share both about once in 2 ** 128 pairs."""
    split = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key().alias("text_key"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("parts"))
    split = split.filter(F.size("parts") >= lines)
    hashed = split.select("doc", "text_key", F.transform("parts", lambda x: F.xxhash64(x)).alias("h"), F.transform("parts", lambda x: F.xxhash64(F.lit(1), x)).alias("k"))
    hashed = hashed.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - lines)))
    window = lambda col: F.xxhash64(*[F.col(col)[F.col("at") + k] for k in range(lines)])
    return hashed.select("doc", "text_key", "at", window("h").alias("a"), window("k").alias("b"))


def repeated_windows(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """doc, text_key, starts: where the later occurrences of windows begin, for documents that have any."""
    rows = line_windows(docs, lines).withColumn("_salt", salt(docs.sparkSession, "doc"))
    rows = group_totals(rows, ["a", "b"], "_salt", first_doc=("min", "doc"), seen=("count", "*")).filter("seen > 1")
    first = F.min("at").over(Window.partitionBy("doc", "text_key", "a", "b"))
    later = rows.withColumn("first_at", first).filter("doc > first_doc OR at > first_at")
    return later.groupBy("doc", "text_key").agg(F.collect_set("at").alias("starts"))


def line_dedup(docs: DataFrame, lines: int = WINDOW_LINES) -> DataFrame:
    """docs with text less its repeated lines, and n_lines, n_removed; all other columns are carried.

    Lines end at \\n and are compared as they are. A window of three lines is a repetition if it also starts in a row
    with a smaller doc_id or further up in its own text; every line that a repetition covers goes. Rows of one doc_id
    don't act on each other; a null doc_id counts as the smallest. Texts of fewer lines than a window stay whole, null
    becomes empty. n_lines and n_removed replace columns of these names.
    """
    kept_cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*kept_cols).select(F.struct(*kept_cols).alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key().alias("text_key"))
    joined = same_row(keyed, repeated_windows(docs, lines), ["doc", "text_key"], "left")
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(lines)]))))
    split = joined.select("row", F.split(F.coalesce("row.text", F.lit("")), "\n", -1).alias("parts"), covered.alias("covered"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "covered"), lambda k: F.get("parts", k))
    new = F.when(F.col("covered").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(left, "\n"))
    return split.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept_cols], F.size("parts").cast("long").alias("n_lines"), F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"))

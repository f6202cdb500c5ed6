"""Exact dedup by deterministic block naming: blocks are sorted into integer names, adjacent pairs are named again until a document has one name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.llm.common import SPACES, same_row
from foldergraph.operators.skew import bucket, group_totals, salt
from foldergraph.sources.shared import cut, slices

BLOCK_CHARS = 8192


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace keys by name: an integer that two rows share only if all keys are equal; head: a hash of the row that stands for it.

    Rows are dealt to buckets by a hash of the keys, salted by doc_id, and sorted there; one row of each run of equals
    goes on to its bucket, where the runs of all salts are sorted and numbered. A hot block has at most one row a salt there.
    """
    spark, run = rows.sparkSession, ["_bucket", "_salt", "_run"]
    dealt = rows.withColumn("_bucket", bucket(16 * slices(spark), *keys)).withColumn("_salt", salt(spark, "doc_id"))
    local = Window.partitionBy("_bucket", "_salt").orderBy(*keys)
    dealt = dealt.withColumn("_run", F.rank().over(local)).withColumn("_at", F.row_number().over(local))
    # head marks the row that stands for its equals; with it both sides need the same columns, and texts are shuffled once for both
    others = [c for c in rows.columns if c not in keys]
    heads = dealt.filter("_run = _at").select(*run, *keys, F.xxhash64(*others).alias("head"))
    number = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*keys))
    names = heads.select(*run, "head", (F.col("_bucket") * F.lit(1 << 36) + number).alias("name"))
    return dealt.drop("_at", *keys).join(names, run).drop(*run)


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same after each run of white space became one space; null counts as empty, and
    empty texts equal each other. Of equal texts the smallest doc_id stays; a null doc_id stays only if its group has no
    other. Of repeated rows (same doc_id, same text) one stays and each counts. Other columns are not carried.
    """
    norm = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ").alias("norm"))
    blocks = norm.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0)).alias("parts"))
    blocks = blocks.select("doc_id", "digest", F.greatest(F.size("parts"), F.lit(1)).alias("n"), F.posexplode_outer("parts").alias("at", "block"))
    blocks = blocks.select("doc_id", "digest", "n", F.coalesce("at", F.lit(0)).alias("at"), (F.col("n") == 1).alias("whole"), F.coalesce("block", F.lit("")).alias("block"))
    first = level = cut(_named(blocks, ["whole", "block"]).select("doc_id", "digest", "n", "at", "name", "head"), "names")
    most, depth = first.agg(F.max("n")).head()[0] or 1, 0
    whole = first.filter("n = 1").select("doc_id", "digest", F.lit(0).alias("depth"), "name")
    rows = first.filter("n > 1 AND at = 0").select("doc_id", "digest")
    roots = None
    while most > 1:
        most, depth = (most + 1) // 2, depth + 1
        level = cut(_named(_pairs(level).withColumn("whole", F.col("n") == 1), ["whole", "a", "b"]).select("doc_id", "digest", "n", "at", "name", "head"), "names")
        done = level.filter("n = 1").select("doc_id", "digest", F.lit(depth).alias("depth"), "name")
        roots = done if roots is None else roots.unionByName(done)
    if roots is not None:
        whole = whole.unionByName(same_row(rows, roots, ["doc_id", "digest"]))
    whole = group_totals(whole.withColumn("_salt", salt(docs.sparkSession, "doc_id")), ["depth", "name"], "_salt", keep_id=("min", "doc_id"), group_size=("count", "*"))
    again = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("depth"))
    return whole.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (again == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _pairs(level: DataFrame) -> DataFrame:
    """Adjacent names of each document side by side; the last one of an odd row stands alone. Repeated rows become one."""
    side = level.filter("n > 1").select("doc_id", "digest", F.expr("cast((n + 1) div 2 AS int)").alias("n"), F.expr("cast(at div 2 AS int)").alias("at"), (F.col("at") % 2).alias("side"), "name")
    of = lambda k: F.max(F.when(F.col("side") == k, F.col("name")))
    return side.groupBy("doc_id", "digest", "n", "at").agg(of(0).alias("a"), F.coalesce(of(1), F.lit(-1)).alias("b"))

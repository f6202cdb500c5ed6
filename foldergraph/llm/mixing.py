"""Mixing sources to target weights by Efraimidis-Spirakis sampling: exponential keys scaled by document quality, sorted within the source, prefix-summed to the source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldergraph.llm.common import NO_ID, WORD, text_key
from foldergraph.operators.skew import rank_in_key
from foldergraph.sources.shared import cut, slices

#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 7


def text_quality() -> Column:
    """1 for text without markup symbols and repeated lines, less with each symbol per character and each line that was there before."""
    text = F.coalesce("text", F.lit(""))
    symbols, lines = F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.split(text, "\n", -1)
    return F.size(F.array_distinct(lines)) / F.size(lines) / (F.lit(1.0) + F.lit(20.0) * symbols / F.greatest(F.length(text), F.lit(1)))


def uniform(seed: int) -> Column:
    """A number in (0, 1) that only doc_id, text and seed decide: 52 bits of an MD5."""
    name = F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> also target, for a table with a row for each source.

    target = least(most * source_size, level * weight), with the level at which the targets sum to the sum of all sizes:
    resharing what lies over a cap by weight until nothing does ends there. Sources fill up in the order of cap / weight,
    so running sums in that order give the level.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    caps = caps.withColumns({"left": total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "by": F.sum("weight").over(rest)})
    # left / by rises while the next source fills up below it, then falls: the largest is the level at which the rest have room
    level = F.max_by(F.struct("left", "by"), F.col("left") / F.col("by")).over(Window.partitionBy())
    share = level["left"] * F.col("weight") / level["by"]
    return caps.withColumn("target", F.least("cap", share)).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, text_key, source, size, source_size, target, times, taken.

    A source's target holds floor(target / size) complete epochs; for the rest, documents are drawn without replacement
    by ascending -ln(u) / quality, as long as more than half of the next one fits. times counts the copies that the mix takes, taken
    their words. Null text has size 0 and is taken with the epochs only; a null source is a source of its own, put last;
    u depends on doc_id and text, so reruns agree; repeated rows follow each other and are drawn as far as they fit.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    key = -F.log(uniform(seed)) / F.greatest(quality if quality is not None else text_quality(), F.lit(1e-6))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = cut(docs.select("doc_id", text_key().alias("text_key"), "source", source.alias("_source"), size.alias("size"), key.alias("key")), "keys")
    # ranges of the order hold equal shares of the rows, whatever the keys' distribution is; a source's prefix sums go on from range to range
    order = ["_source", "key", "doc_id", "text_key"]
    rows = rows.repartitionByRange(slices(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("_range", F.shiftright("_at", 33)), "ordered")
    by_range = rows.groupBy("_source", "_range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))  # no more rows than ranges and sources
    sizes = by_range.groupBy("_source").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, most).select(source.alias("_source"), "source_size", "target")
    before = F.sum("range_size").over(Window.partitionBy("_source").orderBy("_range")) - F.col("range_size")
    starts = by_range.withColumn("range_start", before).select("_source", "_range", "range_start").join(targets, "_source")
    placed = rows.join(starts, ["_source", "_range"])
    within = Window.partitionBy("_range", "_source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("range_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    drawn = (F.col("start") + F.col("size") / 2 <= F.col("target") - epochs * F.col("source_size")) & (F.col("size") > 0)
    placed = placed.withColumn("times", epochs.cast("long") + drawn.cast("long"))
    return placed.select("doc_id", "text_key", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs(doc_id, text, source) as often as the mix takes them, with all their columns; documents that it doesn't take are left out.

    Of rows that repeat doc_id, text and source each stands for one row of the mix; where some of them are taken once more than the others,
    it is those that are first in order of all their columns as JSON. Null doc_ids are told apart by their texts, a null text counts as
    empty (and is taken with the epochs only), a null source is one of its own. Other columns may have any names; an empty table stays
    empty.
    """
    keys = [F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.col("text_key"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source")]
    names = ["_doc", "text_key", "_source"]
    times = mix(docs, **options).select(*keys, "times").groupBy(*names).agg(F.min("times").alias("least"), (F.sum("times") - F.min("times") * F.count("*")).alias("more"), F.count("*").alias("rows"))  # they differ by one at most
    times = cut(times.filter("least + more > 0"), "times")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_key().alias("text_key"), "source").select("row", *keys)
    alike = rows.join(times.withColumn("least", F.when((F.col("rows") == 1) | (F.col("more") == 0), F.col("least") + F.col("more")).otherwise(F.col("least"))), names)
    own = alike.filter("least > 0").select("row", F.col("least").alias("times"))
    # a place is needed only where repeated rows are not all taken equally often
    uneven = times.filter("rows > 1 AND more > 0").select(*names, "more")
    if not uneven.isEmpty():
        placed = rank_in_key(rows.join(uneven, names).withColumn("_json", F.to_json("row")), names, ["_json"], "_n")
        own = own.unionByName(placed.filter("_n < more").select("row", F.lit(1).cast("long").alias("times")))
    return own.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")

"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt, the rest as two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldergraph.operators.skew import global_rank, lookup, salt
from foldergraph.sources.shared import cut


def conversations_by_turn(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) in order of (turn, role, text). A row without conv_id is a conversation of its own."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    rows = turns.select("conv_id", F.struct("turn", role, text).alias("t"), F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).alias("_own"))
    rows = rows.groupBy("conv_id", "_own").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _spans(turns: Column) -> Column:
    """start:end of each assistant turn's text and end mark in the rendered turns, in characters; only these are learnt."""

    def step(state: Column, turn: Column) -> Column:
        size, head = F.length(_rendered(turn)), F.length(turn["role"]) + F.lit(5)
        span = F.concat_ws(":", state["at"] + head, state["at"] + size)
        return F.struct((state["at"] + size).alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs with c and r (chosen and rejected conversations, arrays of (role, text)) replaced by n_common, prompt, chosen, rejected, chosen_spans,
    rejected_spans.

    n_common: length of the longest common prefix of turns, role and text alike; prompt: these, rendered; chosen, rejected: what follows;
    spans: the assistant parts, which alone count in the loss. A null r gives an empty prompt and no rejected completion.
    """
    both = F.when(F.col("r").isNull(), 0).otherwise(F.least(F.size("c"), F.size("r")))
    differs = F.transform(F.sequence(F.lit(1), both), lambda i: F.get("c", i - 1) != F.get("r", i - 1))
    at = F.when(both == 0, 0).otherwise(F.array_position(differs, True) - 1)
    others = [c for c in pairs.columns if c not in ("c", "r")]
    rows = pairs.withColumn("n_common", F.when(at < 0, both).otherwise(at).cast("int"))
    rest = lambda col: F.slice(col, F.col("n_common") + 1, F.greatest(F.size(col), F.lit(1)))
    rows = rows.select(*others, "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    text = lambda col: F.array_join(F.transform(col, _rendered), "")
    return rows.select(*others, "n_common", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns(conv_id, turn, role, text): conv_id, donor_id, and what formatted() gives.

    The conversation is chosen. Rejected is the same conversation with the answer of another one in it: its last assistant turn after
    the first turn (its last turn if there is none) is replaced by the next different such turn of all conversations, in order of their
    MD5; donor_id is the smallest conv_id that has it. Where all conversations have the same answer, rejected is null. Null role or text
    counts as empty, a row without conv_id is a conversation of its own, repeated rows are turns of their own.
    """
    spark, n = turns.sparkSession, F.size("turns")
    back = F.array_position(F.reverse(F.transform(F.slice("turns", F.lit(2), n), lambda t: t["role"] == "assistant")), True)
    whole = conversations_by_turn(turns).withColumn("at", F.when(back > 0, n - back + 1).otherwise(n).cast("int")).withColumn("answer", F.element_at("turns", F.col("at")))
    whole = cut(whole.withColumn("key", F.md5(F.concat("answer.role", F.lit("\n"), "answer.text"))).withColumn("_salt", salt(spark, "conv_id")), "conversations")
    answers = whole.groupBy("key").agg(F.min("conv_id").alias("donor_id"), F.min("answer").alias("answer"))
    ranks = global_rank(whole.select("key").distinct(), ["key"])
    total = ranks.agg(F.count("*").alias("total"))  # one row
    after = ranks.crossJoin(F.broadcast(total)).filter("total > 1").select("key", ((F.col("rank") + 1) % F.col("total")).alias("rank"))
    after = after.join(ranks.withColumnRenamed("key", "other"), "rank").join(answers.withColumnRenamed("key", "other"), "other").select("key", "donor_id", F.col("answer").alias("donor"))
    ways = lookup(whole, after.unionByName(ranks.crossJoin(F.broadcast(total)).filter("total = 1").select("key", F.lit(None).cast(after.schema["donor_id"].dataType).alias("donor_id"), F.lit(None).cast(after.schema["donor"].dataType).alias("donor"))), ["key"], "_salt")
    other = F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), F.array("donor"), F.slice("turns", F.col("at") + 1, n))
    return formatted(ways.select("conv_id", "donor_id", F.col("turns").alias("c"), F.when(F.col("donor").isNotNull(), other).alias("r")))

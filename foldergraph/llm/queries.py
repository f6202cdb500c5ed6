"""The thin queries opN_<name>: each reads a whole table, runs its operator and derives the columns that are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldergraph.llm.exact_dedup import exact_dedup
from foldergraph.llm.line_dedup import line_dedup
from foldergraph.llm.mixing import mix
from foldergraph.llm.periodic import longest_run, periodic_runs, with_echo
from foldergraph.llm.piece_nbest import encode
from foldergraph.llm.preference import preference_pairs
from foldergraph.llm.quality import quality_rules
from foldergraph.llm.simhash import simhash_groups
from foldergraph.llm.suffix_dedup import suffix_dedup
from foldergraph.llm.token_shards import token_shards
from foldergraph.llm.toxicity import fit, toxicity
from foldergraph.llm.vector_codes import books_sha256, vector_codes
from foldergraph.llm.warc import warc_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir)).drop("spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(_documents(spark, sf_dir)).drop("path")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(_documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(_documents(spark, sf_dir))
    scores = F.transform("nbest", lambda x: F.round(x["score"], 3))
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 2 AS long)").alias("n_pieces"), F.sha2("ids", 256).alias("ids_sha256"), scores.alias("scores"), "round_trip")


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.col("best")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = periodic_runs(with_echo(_documents(spark, sf_dir))).withColumn("best", longest_run(F.col("runs")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_exact_dedup, op2_line_dedup, op3_suffix_dedup, op4_mixing, op5_token_shards, op6_quality_rules, op7_simhash, op8_piece_nbest, op9_preference, op10_warc, op11_vector_codes, op12_periodic_runs, op13_toxicity)
    return {f.__name__: f for f in found}

"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to source weights, SentencePiece encoding.

Each stage reads what the stage before it wrote and returns the columns of documents, but for the last, which returns ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldergraph.llm.line_dedup import line_dedup
from foldergraph.llm.mixing import mixed_documents
from foldergraph.llm.simhash import near_dedup
from foldergraph.llm.piece_nbest import encode
from foldergraph.llm.quality import quality_filter
from foldergraph.sources.shared import new_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counted rules and lie within their language's perplexity bounds; the others go.

    Null, empty and very short texts fail the rules; a null lang is a language of its own; repeated rows stay or go together; other columns
    may have any names.
    """
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines of repeated three-line windows; n_chars follows the text. A document left without text goes.

    A null text becomes empty and goes; rows of one doc_id don't act on each other, a null doc_id counts as the smallest; a document's
    own columns n_lines and n_removed stay.
    """
    own = {c: f"_own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup(docs.withColumnsRenamed(own)).drop("n_lines", "n_removed").filter("text <> ''").withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates: fingerprints of five-word
    shingles find the pairs, of which those with a Jaccard similarity of 0.8 or more are links.

    Texts without words are alike; a group without any doc_id stays whole; rows that repeat the one that stays stay with it.
    """
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own; texts without words take no share of a target; repeated rows are drawn one by one.
    """
    return mixed_documents(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, nbest, round_trip for each document of the mix; a row for each row, null texts as empty ones, other columns not carried."""
    return encode(docs).drop("text_key")


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("pieces", piece_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = new_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}")
            docs = spark.read.parquet(f"{top}/{k}")
    return docs


#: Perplexity models and piece lattices are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None

"""Views of the given tables as file inventories, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldergraph.sources.shared import new_dir, store_of

FILES_SQL = """
SELECT file_id, concat(parent_dir, '/', name) AS path, name, extension, size, parent_dir,
       CAST(1 AS BIGINT) AS watched_dir_id, status, modified_at, processing_status, content
FROM (
  SELECT doc_id AS file_id,
    concat(CASE WHEN doc_id % 3 = 0 THEN 'document_' ELSE 'note-' END, lang, '_report_', CAST(doc_id AS VARCHAR(20)), ext) AS name,
    ext AS extension, n_chars AS size,
    CASE WHEN doc_id % 17 = 0 THEN '/watch' WHEN copies >= 3 THEN concat('/watch/copies/', head) ELSE concat('/watch/', source, '/', lang) END AS parent_dir,
    CASE WHEN doc_id % 29 = 0 THEN 'missing' ELSE 'active' END AS status,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS modified_at,
    CASE doc_id % 6 WHEN 0 THEN 'stale' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' WHEN 3 THEN 'unprocessed' ELSE 'processed' END AS processing_status,
    text AS content
  FROM (
    SELECT *, CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '.py' WHEN 4 THEN '.csv' WHEN 5 THEN '.jpg' ELSE '.docx' END AS ext
    FROM {documents} d0
  ) d1
) d2
"""

#: documents with head, a hash of the text's begin, and copies, how many texts have it; the SQL is DuckDB's alone.
HEADS_SQL = "(SELECT *, count(*) OVER (PARTITION BY head) AS copies FROM (SELECT *, substr(md5(substr(text, 1, 24)), 1, 8) AS head FROM documents) h0)"

PAGES_SQL = """
SELECT page_id AS file_id, regexp_extract(p, '[^/]+$', 0) AS name,
       concat('/web/', replace(regexp_replace(p, '/[^/]*$', ''), '.', '/')) AS parent_dir, html AS content
FROM (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', ''), '/+$', '') AS p FROM {pages}) u
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("head", F.substring(F.md5(F.substring("text", 1, 24)), 1, 8))
    # counted apart, so that only the texts of frequent heads meet a join, and none a window
    heads = docs.groupBy("head").agg(F.count("*").alias("copies")).filter("copies >= 3")
    return spark.sql(FILES_SQL, documents=docs.join(heads, "head", "left"))


def pages_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGES_SQL, pages=table(spark, sf_dir, "pages"))


def page_files(spark: SparkSession, sf_dir: str, underscores: bool = False) -> str:
    """A folder of one file for each page, as tasks write them: every eighth as .dat, every ninth under a hidden name;
    with `underscores`, every tenth under a name that begins with _."""
    top = new_dir(spark, "files")
    kind = F.when(F.col("page_id") % 8 == 0, ".dat").otherwise(".html")
    mark = F.when(F.lit(underscores) & (F.col("page_id") % 10 == 3), "_").otherwise("")
    name = F.concat(mark, F.when(F.col("page_id") % 9 == 0, ".").otherwise(""), F.lit("page-"), F.col("page_id").cast("string"), kind)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = store_of(top)
        for frame in frames:
            for folder, own, html in frame.itertuples(index=False):
                store.create_dir(f"{path}/{folder}", recursive=True)
                with store.open_output_stream(f"{path}/{folder}/{own}", compression=None) as out:
                    out.write(html.encode())
            yield pd.DataFrame({"n": [len(frame)]})

    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).cast("string").alias("folder"), name.alias("name"), F.coalesce("html", F.lit("")).alias("html"))
    rows.mapInPandas(put, "n long").agg(F.sum("n")).collect()
    return top

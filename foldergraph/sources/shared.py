"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a task of a job that says how many it deals.
ROWS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local session gets a temporary one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="foldergraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or path, and the path in it; Spark's names of S3 schemes are known."""
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri("s3://" + rest if mark and scheme in ("s3a", "s3n") else uri)


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def _small_tasks(rows: int) -> dict[str, str]:
    """Settings of a job whose largest shuffle has `rows` rows: its tasks get more, not larger, as the rows do."""
    return {"spark.sql.shuffle.partitions": str(_tasks(rows)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.files.maxPartitionBytes": "8m"}


def write(df: DataFrame, path: str, by: tuple[str, ...] = (), codec: str = "zstd", rows: int | None = None) -> None:
    """Write df, in folders by the values of `by`. The shuffle files of the job go once the table is there.

    With `rows`, about how many the job's largest shuffle has, tasks are as many as leave ROWS to each.
    """
    spark = df.sparkSession
    wanted = {_CLEANUP: "true"} | ({} if rows is None else _small_tasks(rows))
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).partitionBy(*by).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that later jobs don't depend on executors' shuffle files; `rows` as in write()."""
    path = new_dir(df.sparkSession, name)
    write(df, path, codec=codec, rows=rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recut(df: DataFrame, old: DataFrame, name: str) -> DataFrame:
    """cut(df), and then the table of old, which cut() wrote and nothing else reads, goes."""
    out, spark = cut(df, name), df.sparkSession
    if files := old.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by key to the session's shuffle partitions, or to more where `rows`, what comes of df, are over ROWS a partition."""
    n = _tasks(rows)
    return df.repartition(n, key) if n > slices(df.sparkSession) else df.repartition(key)

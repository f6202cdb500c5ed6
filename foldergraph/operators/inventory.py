"""The file inventory as snapshots: scans merged in, missing files marked, deletes cascaded, changes applied."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldergraph.functions.text import normal_path
from foldergraph.operators.folders import under_guard
from foldergraph.operators.skew import global_rank, group_totals, salt
from foldergraph.sources.shared import cut

SCANNED = ("name", "extension", "size", "parent_dir", "watched_dir_id")


def upsert_scan(files: DataFrame, scan: DataFrame, as_of: Column) -> DataFrame:
    """The next snapshot of files after a scan(path, SCANNED, modified_at).

    New paths get ids after the largest and wait for processing; a changed modification time makes a file stale and clears its error
    and indexing time; an unchanged file that wasn't active is active again; indexed_at is set once. Files not scanned stay as they are.
    Of a path that the scan has twice the newest row counts (of equally new ones the one that a hash decides); rows without a path are left out.
    """
    newest = F.struct("modified_at", F.xxhash64(*SCANNED))
    once = scan.filter("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct(*SCANNED, "modified_at"), newest).alias("row")).select("path", "row.*")
    old, new = files.alias("o"), once.alias("s")
    both = old.join(new, F.col("o.path") == F.col("s.path"), "full")
    seen, known = F.col("s.path").isNotNull(), F.col("o.path").isNotNull()
    changed = seen & known & ~F.col("s.modified_at").eqNullSafe(F.col("o.modified_at"))
    take = lambda c: F.when(changed | ~known, F.col(f"s.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    rows = both.select(
        F.col("o.file_id").alias("file_id"),
        F.coalesce("o.path", "s.path").alias("path"),
        *map(take, (*SCANNED, "modified_at")),
        F.when(seen, "active").otherwise(F.col("o.status")).alias("status"),
        F.when(~known, "unprocessed").when(changed, "stale").otherwise(F.col("o.processing_status")).alias("processing_status"),
        F.when(seen, F.coalesce("o.indexed_at", as_of)).otherwise(F.col("o.indexed_at")).alias("indexed_at"),
        F.when(~changed & known, F.col("o.content_indexed_at")).alias("content_indexed_at"),
        F.when(~changed & known, F.col("o.processing_error")).alias("processing_error"),
    )
    rows = cut(rows, "scanned")
    fresh = rows.filter("file_id IS NULL")
    largest = files.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("largest"))  # one row
    fresh = global_rank(fresh, ["path"], "_rank").crossJoin(F.broadcast(largest))
    fresh = fresh.withColumn("file_id", (F.col("largest") + F.col("_rank") + 1).cast("long")).drop("largest", "_rank")
    return rows.filter("file_id IS NOT NULL").unionByName(fresh)


def mark_missing(files: DataFrame, scan: DataFrame, vanished_dirs: bool = False) -> DataFrame:
    """Active files of scanned folders that the scan didn't meet become missing; with vanished_dirs, those of folders not met too."""
    met = scan.select("path").distinct().withColumn("met", F.lit(True))
    dirs = scan.select("parent_dir").distinct().withColumn("dir_met", F.lit(True))
    rows = files.join(met, "path", "left").join(dirs, "parent_dir", "left")
    gone = (F.col("status") == "active") & F.col("met").isNull() & (F.lit(vanished_dirs) | F.col("dir_met").isNotNull())
    return rows.withColumn("status", F.when(gone, "missing").otherwise(F.col("status"))).select(*files.columns)


def cascade_delete(tables: dict[str, DataFrame], watched_dir_id: int) -> dict[str, DataFrame]:
    """All tables less a watched directory: its files and what belongs to them, and guards at or under its path."""
    gone = tables["watched_dirs"].filter(F.col("id") == watched_dir_id)
    files = tables["files"].join(gone.select(F.col("id").alias("watched_dir_id")), "watched_dir_id", "left_anti")
    out = dict(tables) | {"watched_dirs": tables["watched_dirs"].filter(F.col("id") != watched_dir_id), "files": files}
    for name in ("contents", "comments", "embeddings", "suggestion_files"):
        if name in tables:
            out[name] = tables[name].join(files.select("file_id"), "file_id", "left_semi")
    if "guards" in tables:
        out["guards"] = under_guard(tables["guards"], gone.select(normal_path(F.col("path")).alias("path"), F.lit(True).alias("guarded")), "path")
    return out


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The next snapshot of table after changes(keys, columns, op, changed_at, and sequence if it is there), as if applied one by one.

    Order: changed_at, then sequence, then op by name, then a hash of the columns; nulls first. op delete: the row goes. insert: a row
    where there is none at that moment. update: a row that is there; upsert: either. A column that an update or upsert leaves null stays
    as it is; those in `keep` only take the first value that an insert or upsert gives while they are null. Other ops and changes with
    a null key do nothing; rows of table with a null key stay; where a key has several rows in table each of them is changed.

    A fold would walk a key's changes in one task. Here a last delete cuts what was before, and of what follows only the first insert
    or upsert and, for each column, the newest value that isn't null count: aggregates that tasks begin before the shuffle, so that a
    key may have any share of the changes.
    """
    spark, others = table.sparkSession, [c for c in table.columns if c not in keys]
    at = F.struct("changed_at", *(["sequence"] if "sequence" in changes.columns else []), "op", F.xxhash64(*others))
    ops = F.col("op").isin("delete", "insert", "update", "upsert")
    made = changes.filter(ops).dropna(subset=keys).select(*keys, F.struct(*others).alias("_new"), "op", at.alias("_at"))
    made = made.withColumn("_salt", salt(spark, "_at"))
    made = group_totals(made.withColumn("_gone", F.when(F.col("op") == "delete", F.col("_at"))), keys, "_salt", _cut=("max", "_gone"))
    live = (F.col("op") != "delete") & (F.col("_cut").isNull() | (F.col("_at") > F.col("_cut")))
    when = lambda test: F.when(live & test, F.col("_at"))
    sums = [F.max(F.col("_cut").isNotNull()).alias("_deleted"), F.min(when(F.col("op") != "update")).alias("_made_at"), F.min_by("_new", when(F.col("op") != "update")).alias("_made")]
    for c in others:
        given = F.col("_new")[c].isNotNull()
        newest, oldest = when((F.col("op") != "insert") & given), when((F.col("op") == "upsert") & given)
        sums += [F.max(newest).alias(f"_at_{c}"), (F.min_by(F.col("_new")[c], oldest) if c in keep else F.max_by(F.col("_new")[c], newest)).alias(f"_set_{c}")]
    told = cut(made.groupBy(*keys).agg(*sums), "changes")
    there = table.select(*keys, F.struct(*others).alias("_old")).join(told, keys, "left").filter("_deleted IS NULL OR NOT _deleted").withColumn("_there", F.lit(True))
    old = table.select(*[F.col(k).alias(f"_{n}") for n, k in enumerate(keys)])
    same = functools.reduce(operator.and_, [F.col(k) == F.col(f"_{n}") for n, k in enumerate(keys)])
    new = told.filter("_made_at IS NOT NULL").join(old, same & ~F.col("_deleted"), "left_anti").withColumn("_there", F.lit(False))
    rows = there.unionByName(new, allowMissingColumns=True)

    def column(c: str) -> Column:
        old, new, told = F.col("_old")[c], F.col("_made")[c], F.col(f"_set_{c}")
        if c in keep:
            return F.when(F.col("_there"), F.coalesce(old, told)).otherwise(F.coalesce(new, told)).alias(c)
        return F.when(F.col("_there"), F.coalesce(told, old)).otherwise(F.coalesce(F.when(F.col(f"_at_{c}") >= F.col("_made_at"), told), new)).alias(c)

    return rows.select(*keys, *map(column, others))


def merge_extracted(files: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """files after extraction results(file_id, error, file_metadata): processed at as_of, or failed with the error's first 500 characters.

    file_metadata, where both tables have it, replaces what was known of files that were processed.
    """
    told = ["file_metadata"] if "file_metadata" in results.columns and "file_metadata" in files.columns else []
    done = results.select("file_id", F.substring("error", 1, 500).alias("_error"), F.lit(True).alias("_done"), *[F.col(c).alias(f"_{c}") for c in told])
    rows = files.join(done, "file_id", "left")
    ok = F.col("_done") & F.col("_error").isNull()
    new = {"processing_status": F.when(ok, "processed").when(F.col("_done"), "failed"), "content_indexed_at": F.when(ok, as_of)} | {c: F.when(ok, F.col(f"_{c}")) for c in told}
    rows = rows.withColumns({c: F.coalesce(v, F.col(c)) for c, v in new.items()} | {"processing_error": F.when(F.col("_done"), F.col("_error")).otherwise(F.col("processing_error"))})
    return rows.select(*files.columns)


def upsert_contents(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("file_id"), "file_id", "left_anti").unionByName(new)

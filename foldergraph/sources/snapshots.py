"""Tables kept as versions in the shared store: dealt to folders, of which a change writes only those that it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldergraph.sources.shared import cut, store_of, write

POINTER = "current.json"
FOLDERS, MOST_FOLDERS = 64, 10_000


def dealt_by(*keys: str, folders: int = FOLDERS) -> Column:
    """The folder of a row by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(folders)).cast("string")


class Snapshots:
    """The tables under a folder `top`, which readers see as the newest whole version left them.

    A version is a list of the folders of each table and of the files' place of each; one small file, replaced last and in one step,
    says which version counts. What a writer leaves behind before that step is seen by nobody. Folders that a version didn't touch are
    those of the versions before. One writer at a time: a writer that meets another version than it began with stops.

    A table's folders are given by a column over its rows (dealt_by(), a model's name, a watched directory); a null one is a folder
    of its own. There should be few of them, tens or hundreds, MOST_FOLDERS at most: the list of all is read as a whole. A folder
    of any size is written by many tasks.
    """

    def __init__(self, spark: SparkSession, top: str):
        self.spark, self.top = spark, top.rstrip("/")

    def version(self) -> dict:
        """{"version": name, "tables": {table: {"schema": JSON, "folders": {folder: path below top}}}}; without tables before the first commit."""
        store, path = store_of(self.top)
        if store.get_file_info(f"{path}/{POINTER}").type == pafs.FileType.NotFound:
            return {"version": None, "tables": {}}
        with store.open_input_stream(f"{path}/{POINTER}", compression=None) as file:
            return json.loads(file.read())

    def read(self, table: str, folders: list[str] | None = None) -> DataFrame:
        """The rows of a table; with `folders`, of these alone, and nothing else is read."""
        known = self.version()["tables"][table]
        paths = [f"{self.top}/{p}" for f, p in sorted(known["folders"].items()) if folders is None or f in folders]
        schema = StructType.fromJson(known["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, tuple[DataFrame, Column]], only: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
        """Put tables {name: (rows, folder of a row)} in place of what is there, all of them at once; the folders written of each.

        only: {table: folders}: rows are those of these folders, other folders stay as they are. A folder left without rows goes.
        """
        old, only = self.version(), only or {}
        new, wrote = {"version": uuid.uuid4().hex, "tables": dict(old["tables"])}, {}
        for name, (rows, folder) in tables.items():
            place = f"{name}/{new['version']}"
            keyed = rows.withColumn("_folder", F.coalesce(folder.cast("string"), F.lit("none")))
            # names of folders may be any text, so that files are laid out by a number
            found = sorted(r[0] for r in keyed.select("_folder").distinct().collect())
            if len(found) > MOST_FOLDERS:
                raise ValueError(f"{name} has {len(found)} folders; deal it by something that has fewer values")
            if strange := [f for f in found if name in only and f not in only[name]]:
                raise ValueError(f"rows of folders that were not to be written: {strange[:3]}")
            if found:
                number = F.create_map(*[F.lit(x) for k, f in enumerate(found) for x in (f, k)])
                write(keyed.withColumn("_n", F.element_at(number, F.col("_folder"))).drop("_folder").hint("rebalance", "_n"), f"{self.top}/{place}", ("_n",))
            stay = {f: p for f, p in old["tables"].get(name, {}).get("folders", {}).items() if name in only and f not in only[name]}
            new["tables"][name] = {"schema": rows.schema.jsonValue(), "folders": stay | {f: f"{place}/_n={k}" for k, f in enumerate(found)}}
            wrote[name] = found
        self._point(old["version"], new)
        return wrote

    def update(self, table: str, changes: DataFrame, folder: Column, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
        """Put apply(rows, changes) in place of the rows of the folders that changes fall into; the folders written.

        `folder` is a column over changes and over rows alike. Other folders are neither read nor written.
        """
        changes = cut(changes, "changes")
        touched = sorted(r[0] for r in changes.select(F.coalesce(folder.cast("string"), F.lit("none"))).distinct().collect())
        if touched:
            self.commit({table: (cut(apply(self.read(table, touched), changes), "updated"), folder)}, {table: touched})
        return touched

    def _point(self, before: str | None, new: dict) -> None:
        store, path = store_of(self.top)
        if self.version()["version"] != before:
            raise RuntimeError("another writer has put a version in place meanwhile")
        store.create_dir(path, recursive=True)
        own = f"{path}/{new['version']}.json"
        with store.open_output_stream(own, compression=None) as file:
            file.write(json.dumps(new).encode())
        store.move(own, f"{path}/{POINTER}")

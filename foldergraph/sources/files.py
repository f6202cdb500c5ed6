"""Files as tables: the inventory of a directory, texts, and what office documents hold."""

from __future__ import annotations

import functools
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldergraph.functions.text import base_name, file_extension, mime_type, parent_path
from foldergraph.functions.values import MAX_FILE_BYTES, MAX_TEXT_BYTES, TEXT_EXTENSIONS
from foldergraph.sources.shared import cut, slices, store_of


LISTED = "path string, folder boolean, size long, micros long"


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, size, modified_at of all files below a directory; names that begin with . are left out, with what is below them.

    A level of folders is listed at a time, each folder by the task that it was dealt to, and written before the next; so the driver
    lists nothing, and a lost executor costs a level. A folder that can't be listed has no files. One folder's names are held by a task.
    """
    store, top = store_of(directory)
    scheme = directory.partition("://")[0] + "://" if "://" in directory else ""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = store_of(directory)
        for frame in frames:
            for folder in frame["path"]:
                try:
                    found = own.get_file_info(pafs.FileSelector(folder))
                except OSError:
                    continue
                rows = [(x.path, x.type == pafs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1000) for x in found if not x.base_name.startswith(".")]
                yield pd.DataFrame(rows, columns=["path", "folder", "size", "micros"])

    level, files = spark.createDataFrame([(top.rstrip("/") or "/",)], "path string"), []
    while True:
        rows = cut(level.repartition(slices(spark), "path").mapInPandas(listed, LISTED), "listed")
        files.append(rows.filter("NOT folder"))
        level = rows.filter("folder").select("path")
        if level.isEmpty():
            break
    path = F.col("path") if scheme in ("", "file://") else F.concat(F.lit(scheme), "path")
    return functools.reduce(DataFrame.unionByName, files).select(path.alias("path"), "size", F.timestamp_micros("micros").alias("modified_at"))


def scan_directory(spark: SparkSession, directory: str, watched_dir_id: int, since: datetime | None = None) -> DataFrame:
    """The inventory of a directory, contents not read; with `since`, of the files modified after it only.

    Names below the directory that begin with . are left out. A store that only Spark can list is listed by its reader, on the driver,
    which also leaves out names that begin with _.
    """
    root = re.sub("^file:/*", "/", directory).rstrip("/")
    try:
        found = list_files(spark, directory)
    except (pa.ArrowInvalid, NotImplementedError):
        binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
        found = binary.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
        found = found.filter(~F.substring_index("path", root, -1).rlike(r"/\."))
    rows = found if since is None else found.filter(F.col("modified_at") > F.lit(since))
    name = base_name(F.col("path"))
    return rows.select("path", name.alias("name"), file_extension(name).alias("extension"), mime_type(file_extension(name)).alias("mime_type"), "size", parent_path(F.col("path")).alias("parent_dir"), F.lit(watched_dir_id).cast("long").alias("watched_dir_id"), F.lit("active").alias("status"), "modified_at")


#: Noncharacters, which no text has; they stand for a replacement character while invalid bytes are taken out.
_OWN_MARK = "﷐﷑"
#: What a package may hold when unpacked, and what a file that can't be opened raises.
MAX_UNPACKED_BYTES = 8 * MAX_FILE_BYTES
_UNREADABLE = (zipfile.BadZipFile, ElementTree.ParseError, zlib.error, KeyError, ValueError, RuntimeError, NotImplementedError, OSError, EOFError)


def cut_text(content):  # noqa: ANN001, ANN201
    """The first 500 KiB of a binary column as text, bytes that aren't UTF-8 left out; a replacement character that the text has stays."""
    raw = F.replace(F.substring(content, 1, MAX_TEXT_BYTES).cast("string"), F.lit("�"), F.lit(_OWN_MARK))
    return F.replace(F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit("")), F.lit(_OWN_MARK), F.lit("�"))


def _texts(data: bytes, tag: str) -> Iterator[str]:
    for x in ElementTree.fromstring(data).iter():
        if x.tag.rpartition("}")[2] == tag and x.text:
            yield x.text


def _cells(data: bytes, shared: list[str]) -> Iterator[str]:
    for cell in ElementTree.fromstring(data).iter():
        if cell.tag.rpartition("}")[2] != "c":
            continue
        for x in cell:
            if x.tag.rpartition("}")[2] == "v" and x.text:
                if cell.get("t") != "s":
                    yield x.text
                elif x.text.isdigit() and int(x.text) < len(shared):
                    yield shared[int(x.text)]


def office_text(data: bytes, extension: str) -> tuple[str, dict[str, str]]:
    """Text and core properties of a docx, pptx or xlsx package; a slide or sheet that can't be read is left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(z.namelist())
        if sum(x.file_size for x in z.infolist()) > MAX_UNPACKED_BYTES:
            raise ValueError("package too large when unpacked")
        runs: list[str] = []
        if extension == ".docx":
            runs += _texts(z.read("word/document.xml"), "t")
        shared = []
        if extension == ".xlsx" and "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.rpartition("}")[2] == "t") for si in root]
        parts = {".pptx": r"ppt/slides/slide[^/]*\.xml", ".xlsx": r"xl/worksheets/sheet[^/]*\.xml"}.get(extension)
        for name in names if parts else ():
            if re.fullmatch(parts, name):
                try:
                    runs += list(_texts(z.read(name), "t") if extension == ".pptx" else _cells(z.read(name), shared))
                except (ElementTree.ParseError, zlib.error):
                    continue
        meta = {}
        if "docProps/core.xml" in names:
            for x in ElementTree.fromstring(z.read("docProps/core.xml")):
                if x.text and (key := {"creator": "author"}.get(k := x.tag.rpartition("}")[2], k)) in ("title", "author", "subject", "description", "keywords", "lastModifiedBy", "revision"):
                    meta[key] = x.text
    text = "".join(f"{r} " for r in runs).encode()[:MAX_TEXT_BYTES].decode(errors="ignore")
    return text, meta


def extract_directory(spark: SparkSession, directory: str) -> DataFrame:
    """path, extension, content, metadata, error for every file: texts as they are, office documents opened in the tasks.

    A file beyond 50 MiB isn't read and fails, as does a PDF, for which there is no reader here; files of other kinds have an empty content.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    found = found.withColumn("extension", file_extension(base_name(F.col("path"))))
    large = found.filter(F.col("length") > MAX_FILE_BYTES).select("path", "extension", F.lit(None).cast("string").alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit("file too large").alias("error"))
    small = found.filter(F.col("length") <= MAX_FILE_BYTES)
    text = small.filter(F.col("extension").isin(TEXT_EXTENSIONS)).select("path", "extension", cut_text(F.col("content")).alias("content"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit(None).cast("string").alias("error"))

    def opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    content, meta = office_text(row.content, row.extension)
                    out.append((row.path, row.extension, content, meta, None))
                except _UNREADABLE as e:
                    out.append((row.path, row.extension, None, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["path", "extension", "content", "metadata", "error"])

    office = small.filter(F.col("extension").isin(".docx", ".pptx", ".xlsx")).select("path", "extension", "content").mapInPandas(opened, "path string, extension string, content string, metadata map<string,string>, error string")
    none = lambda kind: F.lit(None).cast(kind)
    other = small.filter(~F.col("extension").isin(*TEXT_EXTENSIONS, ".docx", ".pptx", ".xlsx"))
    other = other.select("path", "extension", F.when(F.col("extension") != ".pdf", "").alias("content"), none("map<string,string>").alias("metadata"), F.when(F.col("extension") == ".pdf", "no reader for PDF").alias("error"))
    return large.unionByName(text).unionByName(office).unionByName(other)

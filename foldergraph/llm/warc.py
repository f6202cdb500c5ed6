"""WARC: archives with one gzip member per record, read back one record at a time with framing and digests checked."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldergraph.operators.skew import group_totals, lookup, salt
from foldergraph.sources.shared import cut, new_dir, store_of

LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
CHUNK = 64 << 10
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, payload binary"


def planned(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """pages with digest (hex SHA-1 of the UTF-8 html), size, refers_to (null: the record holds its payload)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    rows = rows.withColumn("_salt", salt(pages.sparkSession, "page_id"))
    rows = group_totals(rows, ["digest", "size"], "_salt", last=("max", "page_id")).drop("_salt")
    revisit = (F.col("size") >= least) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", "html", "digest", "size", F.when(revisit, F.col("last")).alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP head, with the payload's length, but not the payload."""
    b32 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: {b32}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The gzip members of a stream, each inflated chunk by chunk; a member that ends early is an error."""
    unpack, out, rest = zlib.decompressobj(31), [], b""
    while data := rest or stream.read(chunk):
        out.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out = zlib.decompressobj(31), []
    if out:
        raise ValueError("the archive ends inside a record")


def _head(data: bytes) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record's head has no end")
    lines = data[:end].decode().split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, end + 4


def parsed(member: bytes) -> dict:
    """The record in a member: framed by Content-Length, its block and payload digests checked.

    Of a response, bytes and digest are those of the payload that is there; of a revisit, those that it states.
    """
    head, start = _head(member)
    block = member[start : start + int(head["content-length"])]
    if len(block) < int(head["content-length"]) or member[start + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is not as long as it says")
    http, body = _head(block)
    payload = block[body:]
    of = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x[len("<urn:page:") : -1])
    url, kind = head.get("warc-target-uri"), head["warc-type"]
    good, stated = of(block) == head["warc-block-digest"], (head["warc-payload-digest"], int(http["content-length"]))
    if kind == "response":
        good, stated = good and stated == (of(payload), len(payload)), (of(payload), len(payload))
    digest = base64.b32decode(stated[0][5:]).hex()
    url = None if url is None else url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    return {"page_id": number(head["warc-record-id"]), "url": url, "record_type": kind, "refers_to": number(head.get("warc-refers-to")), "payload_bytes": stated[1], "payload_digest": digest, "verified": good, "payload": payload if kind == "response" else None}


def write_archives(plan: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned() rows as archives of about `most` bytes below folder; a row (path, records, bytes) for each.

    Each attempt of a task writes files of its own names, and only those of the attempt that Spark keeps are in the
    manifest, so a lost or repeated task does no harm.
    """

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = store_of(folder)
        store.create_dir(top, recursive=True)
        part, out, path, n, size = TaskContext.get().partitionId(), None, "", 0, 0
        done = []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if out is None:
                    path = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(f"{top}/{path}", compression=None), 0, 0
                at = lambda x: None if pd.isna(x) else int(x)
                data = record(at(row.page_id), row.url, row.html.encode(), row.digest, int(row.size_), at(row.refers_to))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= most:
                    out.close()
                    out = done.append((f"{folder}/{path}", n, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    # ids as strings: pandas would make floats of nullable integers
    rows = plan.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", F.col("size").alias("size_"), F.col("refers_to").cast("string").alias("refers_to"))
    return cut(rows.mapInPandas(put, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of all archives in the manifest, each read from front to end; RECORDS names the columns.

    An archive that ends early or whose framing is wrong is an error; a digest that differs only clears `verified`. Without
    payload that column is left out; all else is checked as before.
    """

    columns = RECORDS if payload else RECORDS.rpartition(", ")[0]
    names = [x.split()[0] for x in columns.split(", ")]

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["path"]:
                store, path = store_of(uri)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parsed(member))
                        size += len(member)
                        if size > 16 << 20:
                            yield _frame(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows, names)

    files = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, F.xxhash64("path"))
    return files.mapInPandas(get, columns)


def checked_revisits(records: DataFrame) -> DataFrame:
    """records with `verified` cleared for revisits without a verified response of the page, digest and size that they name."""
    keys = ["refers_to", "payload_digest", "payload_bytes"]
    there = records.filter("record_type = 'response' AND verified").select(F.col("page_id").alias("refers_to"), *keys[1:], F.lit(True).alias("_there")).distinct()
    again = records.filter("record_type = 'revisit'").withColumn("_salt", salt(records.sparkSession, "page_id"))
    met = again.select(*keys, "_salt").distinct().join(there, keys, "left")
    again = again.join(met, [*keys, "_salt"]).withColumn("verified", F.col("verified") & F.col("_there").isNotNull())
    return records.filter("record_type <> 'revisit'").unionByName(again.select(*records.columns))


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def warc_round_trip(pages: DataFrame, least: int = LEAST_REVISIT_BYTES, payload: bool = True) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) and read the archives back: RECORDS names the columns.

    verified: digests and sizes are those that were written, and a revisit's response is there with the same.

    Null html is an empty payload, null url and null page_id stay null. Of equal payloads of `least` bytes or more the
    largest page_id is the response (if all are null, each is), the others revisit it; repeated rows of that page_id are
    responses too. Other columns are not carried.
    """
    folder = new_dir(pages.sparkSession, "warc")
    records = read_archives(write_archives(planned(pages, least), folder), payload)
    return checked_revisits(records if payload else cut(records, "records"))

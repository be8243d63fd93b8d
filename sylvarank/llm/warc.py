"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, stage, tidy

MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "path string, record_offset long, record_bytes long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_header string, payload binary"
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def shared_open(path: str, mode: str) -> BinaryIO:
    """Opens a file of the shared folder: plain files directly, others by pyarrow."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open(re.sub("^file:/*", "/", path), mode)
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside) if "r" in mode else store.open_output_stream(inside)


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, date: str, refers_to: str | None = None) -> bytes:
    """One gzip member.  A revisit keeps the HTTP header, which tells the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(uri)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """``id, digest, refers_to`` of the pages that revisit another.

    Only ids and digests are shuffled.  Of pages with equal payloads of at least
    ``least_bytes`` the one with the largest id is the response.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keys = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    shared = keys.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("least")).where("least < refers_to").drop("least")
    return keys.join(shared, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes one archive per task; returns ``path, bytes, records`` of the files.

    A null payload is empty and a null url is an empty one.  Rows without an id
    are always responses; repeated rows get a record each; rows that repeat the
    id and payload of the response are responses too.  An empty table gives no
    files.  Every attempt of a task writes a file of its own name, and only what
    the successful attempt returns is listed, so retried and speculative tasks
    leave no half-written archive in the list.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    roles = page_roles(pages, id_col, payload_col, least_bytes)
    rows = rows.join(roles, ["id", "digest"], "left").select("id", "url", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        told = TaskContext.get()
        if "://" not in folder or folder.startswith("file:"):
            os.makedirs(re.sub("^file:/*", "/", folder), exist_ok=True)
        path, out, size, n = f"{folder}/crawl-{told.partitionId():06d}-{told.taskAttemptId()}.warc.gz", None, 0, 0
        for batch in batches:
            for page, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                made = record("response" if first is None else "revisit", f"urn:page:{'' if page is None else page}", url, digest, payload, date, None if first is None else f"urn:page:{first}")
                out = out or shared_open(path, "wb")
                out.write(made)
                size, n = size + len(made), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return stage(rows.mapInArrow(tidy(write), "path string, bytes long, records long"), "warc-files")


def _starts_record(data: bytes) -> bool:
    """Whether a gzip member begins here whose contents begin like a WARC header."""
    try:
        return zlib.decompressobj(31).decompress(data, 8).startswith(b"WARC/1.")
    except zlib.error:
        return False


def records_in(file: BinaryIO, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """``offset, bytes, contents`` of the records that start in ``start..end``.

    Gzip magic is looked for from ``start`` on; a candidate counts when its
    first bytes decode to a WARC header.  A record that begins inside is read to
    its end, however far beyond ``end`` that lies; the next one starts there.
    """
    file.seek(start)
    data, base = file.read(min(READ_BYTES, end - start + 4096)), start
    at = start  # data holds the file from base on
    while at < end:
        hit = data.find(MAGIC, at - base)
        if hit < 0 or len(data) - hit < 512:
            more = file.read(READ_BYTES)
            if more:
                keep = max(at - base, len(data) - 2 if hit < 0 else hit)
                data, base = data[keep:] + more, base + keep
                at = max(at, base)
                continue
            if hit < 0:
                return
        if base + hit >= end:
            return
        if not _starts_record(data[hit : hit + 512]):
            at = base + hit + 1
            continue
        inflate, out, chunk, taken = zlib.decompressobj(31), [], data[hit:], 0
        while chunk:
            out.append(inflate.decompress(chunk))
            taken += len(chunk)
            if inflate.eof:
                break
            chunk = file.read(READ_BYTES)
        rest = inflate.unused_data
        if not inflate.eof:
            raise EOFError(f"the record at {base + hit} is cut off")
        at = base + hit + taken - len(rest)
        yield base + hit, at - base - hit, b"".join(out)
        data, base = rest, at


def parse_record(contents: bytes) -> dict:
    """Header fields in lower case, and the HTTP header and payload of the block."""
    head, _, rest = contents.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, payload = "", block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        http = http.decode("utf-8", "replace")
    return fields | {"http": http, "payload": payload}


def read_warc(files: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """Records of the archives listed as ``path, bytes``; columns as in ``RECORD``.

    Files are cut to byte ranges that tasks read on their own, so one large
    archive is read by many tasks, one for each range.  An empty list gives no
    rows.
    """
    count = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end")).repartition(int(count), "path", "start")
    names = [c.split(" ")[0] for c in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if k == "long" else pa.binary() if k == "binary" else pa.string()) for n, k in (c.split(" ") for c in RECORD.split(", "))])
        rows, held = [], 0
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                with shared_open(path, "rb") as file:
                    for offset, size, contents in records_in(file, start, end):
                        x = parse_record(contents)
                        rows.append((path, offset, size, x.get("warc-type"), x.get("warc-record-id", "").strip("<>"), x.get("warc-target-uri"), x.get("warc-refers-to", "").strip("<>") or None, x.get("warc-payload-digest"), x["http"], x["payload"]))
                        held += len(contents)
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names)

    return ranges.mapInArrow(tidy(read), RECORD)


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of records written by ``write_warc``.

    A response's digest and length are those of the payload read; a revisit's
    are those its headers state.
    """
    response = F.col("record_type") == "response"
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    stated = F.expr("try_cast(regexp_extract(http_header, '(?i)content-length: *([0-9]+)', 1) as bigint)")
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(stated).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )

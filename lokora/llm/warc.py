"""WARC archives: writing with revisit records, and a splittable reader.

Every record is a gzip member of its own.  The reader cuts files into byte
ranges; a task searches its range for the gzip magic, takes a place for a record
only if a WARC header can be decoded there and the whole member is sound, and
owns the records that start inside its range, reading past its end where needed.

Archives are written below the shared folder, through a file system found by
the folder's scheme.  A task writes a file under a name that no other attempt
uses and reports it when complete; only reported files are read, so that a lost
or repeated task leaves at most a file that nothing reads.

Defined cases: a null payload is empty.  A null URL gives a record without
target.  Rows without an id are never referred to.  Repeated rows of the largest
id of a digest are all responses.  Empty tables give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lokora.llm.common import partitions, pick, stage
from lokora.session import stage_path

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Bytes of a file one task looks through, and bytes read at once.
SPLIT_BYTES, READ_BYTES = 4 << 20, 256 << 10
# A file is closed once it has this many bytes.
FILE_BYTES = 1 << 30
ID = "urn:lokora:page:"

RECORD = (
    "page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """One record: an HTTP response, or for a revisit its header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fields(text: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in text.split(b"\r\n")[1:])
    return {name.decode().lower(): value.strip().decode() for name, _, value in pairs}


def parse_record(data: bytes) -> tuple:
    """The columns of ``RECORD``; a response whose payload does not match its digest fails."""
    head, _, rest = data.partition(b"\r\n\r\n")
    own = _fields(head)
    block = rest[: int(own["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = own["warc-payload-digest"].removeprefix("sha1:")
    kind = own["warc-type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {own['warc-record-id']} does not match its digest")

    def number(field: str) -> int | None:
        value = own.get(field, "").strip("<>").removeprefix(ID)
        return int(value) if value else None

    size = len(payload) if kind == "response" else int(_fields(http)["content-length"])
    url = own.get("warc-target-uri")
    if url is not None:
        url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 128 else m[0], url)
    return number("warc-record-id"), url, kind, digest, size, number("warc-refers-to"), payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``(page_id, url, payload, refers_to)`` rows; returns ``(path, bytes, records)``.

    Each task streams its rows to files of about ``FILE_BYTES``.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = arrow_fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        done, out, size, records, name = [], None, 0, 0, ""
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    name, size, records = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                page_id = None if pd.isna(row.page_id) else int(row.page_id)
                refers_to = None if pd.isna(row.refers_to) else int(row.refers_to)
                payload = bytes(row.payload)
                member = gzip_member(record_bytes(page_id, row.url, payload, base32_sha1(payload), refers_to))
                out.write(member)
                size += len(member)
                records += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, records))
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    return pages.mapInPandas(write, "path string, bytes long, records long")


def records_in_range(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """The decoded records that start in ``[start, end)`` of an open file of ``size`` bytes."""
    at, window, base = start, b"", start
    while at < end:
        if at + len(MAGIC) > base + len(window):
            base, window = at, file.read_at(min(READ_BYTES, size - at), at)
            if len(window) < len(MAGIC):
                return
        found = window.find(MAGIC, at - base)
        if found < 0:
            at = base + len(window) - len(MAGIC) + 1
            if base + len(window) >= size:
                return
            continue
        at = base + found
        if at >= end:
            return
        member = _member(file, at, size)
        if member is None:
            at += 1
        else:
            data, length = member
            yield data
            at += length


def _member(file, at: int, size: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at ``at`` and the member's length, if there is one."""
    unpack, parts, got, where, checked = zlib.decompressobj(31), [], 0, at, False
    while not unpack.eof:
        if where >= size:
            return None
        piece = file.read_at(min(READ_BYTES // 8 if where == at else READ_BYTES, size - where), where)
        where += len(piece)
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            return None
        got += len(parts[-1])
        if got >= len(VERSION) and not checked:
            if not b"".join(parts).startswith(VERSION):
                return None
            checked = True
    return (b"".join(parts), where - len(unpack.unused_data) - at) if checked else None


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of ``(path, bytes)`` files, as ``RECORD`` rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in RECORD.split(", ")]
        whole = {"page_id": "Int64", "refers_to": "Int64"}
        for batch in batches:
            for path, start, size in zip(batch["path"], batch["start"], batch["bytes"], strict=True):
                where, name = arrow_fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as file:
                    rows, held = [], 0
                    for data in records_in_range(file, start, min(start + split_bytes, size), size):
                        rows.append(parse_record(data))
                        held += len(data)
                        if held > split_bytes:
                            yield pd.DataFrame(rows, columns=names).astype(whole)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=names).astype(whole)

    starts = F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    # The number is given, so that the few small rows stay as many tasks.
    return ranges.repartition(partitions(files.sparkSession), "path", "start").mapInPandas(read, RECORD)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to`` to ``(page_id, url, payload)``: the largest page_id of the same
    payload, null for that page itself and for payloads under ``min_bytes``.

    Copies are counted by digest before any payload moves; a payload that a third
    of the pages have is one row on one side of the join.
    """
    keyed = pages.withColumn("_digest", F.sha1("payload"))
    first = (
        keyed.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("_digest")
        .agg(F.max("page_id").alias("_keep"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1 and _keep is not null")
        .select("_digest", "_keep")
    )
    joined = keyed.join(first, "_digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_keep")), F.col("_keep"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def archive(
    pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write all pages to archives in the shared folder; returns the files written."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    folder = stage_path(pages.sparkSession, "warc")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return stage(write_archives(with_revisits(rows, min_bytes), uri), "warc-files")

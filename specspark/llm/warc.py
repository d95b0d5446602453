"""WARC archives: a record-compressed writer, and a reader that splits archives at any byte.

Writer: each task writes one ``.warc.gz`` file, one gzip member a record, under a name that no other
attempt uses; only files named by tasks that ended well are in the archive's file list, so lost or repeated
attempts leave at most unread files. Reader: tasks get byte ranges. A task scans its range for the gzip magic,
takes a candidate for a record only if its first bytes inflate to a WARC header, and owns the records that start
inside its range, reading beyond the end to finish the last.

Archives are opened with ``pyarrow.fs``, so the folder may be any store that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, written

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, READ_BYTES = 8 << 20, 1 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A stable id for a page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header(first: str, fields: dict[str, object]) -> bytes:
    lines = [first, *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, whose Content-Length is the full payload's, and no payload."""
    http = _header("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)})
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = _header("WARC/1.1", {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url) if url is not None else None,
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "X-Page-ID": page_id,
        "X-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    })
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): refers_to is the largest page_id of the rows with an equal payload of at
    least ``least`` bytes, null for that row itself, for smaller payloads and for null ids."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    hashes = base.select("page_id", F.sha1("payload").alias("h"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least)
    groups = hashes.groupBy("h", "n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("k"))
    shared = groups.filter("k > 1").select("h", "n", "first")
    links = hashes.join(shared, ["h", "n"]).filter("page_id <> first")
    # by payload, too: rows of one id may have others
    links = links.groupBy(F.col("page_id").alias("__p"), F.col("h").alias("__h"), F.col("n").alias("__n")).agg(F.max("first").alias("refers_to"))
    same = (F.col("page_id") == F.col("__p")) & (F.sha1("payload") == F.col("__h")) & (F.octet_length("payload") == F.col("__n"))
    return base.join(links, same, "left").drop("__p", "__h", "__n")


def write_archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; the archive's file list (path, bytes, records).

    A null html is an empty payload. Rows with a null id are responses. Equal ids are separate records. Other columns are left out.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"]):
                if out is None:
                    store, at = _open(name)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)  # members are compressed already
                payload = bytes(payload)
                ids = [None if pd.isna(x) else int(x) for x in (page_id, refers_to)]
                member = record(ids[0], url, payload, digest(payload), ids[1])
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "bytes": [size], "records": [count]})

    files = with_revisits(pages, least).mapInPandas(write, "path string, bytes bigint, records bigint")
    return written(files, "warc-files")


def _inflate_head(data: bytes) -> bytes | None:
    """The first bytes of a member that starts here, if it is a WARC record."""
    try:
        head = zlib.decompressobj(31).decompress(data, 16)
    except zlib.error:
        return None
    return head if head.startswith(b"WARC/") else None


def members(source, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records, inflated, that start in [start, end) of a file of ``size`` bytes."""
    at = start
    while at < min(end, size):
        source.seek(at)
        window = source.read(READ_BYTES)
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        source.seek(at)
        data = source.read(READ_BYTES)
        if _inflate_head(data) is None:
            at += 1
            continue
        unpack, parts = zlib.decompressobj(31), []
        try:
            consumed = 0
            while True:
                parts.append(unpack.decompress(data))
                consumed += len(data)
                if unpack.eof:
                    break
                data = source.read(READ_BYTES)
                if not data:
                    raise ValueError(f"the record at {at} isn't complete")
        except zlib.error as broken:  # a WARC header doesn't come about by chance
            raise ValueError(f"the record at {at} is damaged") from broken
        yield b"".join(parts)
        at += consumed - len(unpack.unused_data)


def parse(raw: bytes) -> tuple:
    """The fields of ``RECORD`` from an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    ids = [int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
    sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != sha1):
        raise ValueError(f"the payload of page {ids[0]} doesn't match its digest")
    return ids[0], fields.get("WARC-Target-URI"), kind, length, sha1, ids[1], payload if kind == "response" else None


def splits(spark: SparkSession, files: DataFrame, size: int = SPLIT_BYTES) -> DataFrame:
    """(path, bytes, start): the byte ranges of all files, dealt out over the tasks."""
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("bigint"))).alias("start"))
    return ranges.repartition(4 * partitions(spark), "path", "start")


def read_archive(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the archive files (path, bytes), by ``RECORD``; revisits have no payload. Records cut off or damaged are an error."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            for c in ("page_id", "refers_to"):
                out[c] = out[c].astype("Int64")
            return out

        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"]):
                store, at = _open(path)
                rows, held = [], 0
                with store.open_input_file(at) as source:
                    for raw in members(source, int(size), int(start), int(start) + split_bytes):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held > 16 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    return splits(files.sparkSession, files, split_bytes).mapInPandas(read, RECORD)


def as_bytes(members_: list[bytes]) -> io.BytesIO:
    """An archive in memory, for small uses."""
    return io.BytesIO(b"".join(members_))

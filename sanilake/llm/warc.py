"""WARC archives: a writer, and a sequential reader that checks what it reads.

Each record is a gzip member of its own.  The reader inflates members as bytes
come in, frames each record by its content length, and verifies block and
payload digests; it holds one record at a time.

Workers write and read through pyarrow's file systems, in the shared folder.
An archive's name is new at each attempt to write it, and only archives that
the manifest names count.  Spark commits the manifest once for each task, so
a task that is lost or run twice leaves no record out and none twice.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanilake.llm.texts import shared_folder, stored

LEAST_REVISIT = 1000  # payloads from this size are written once
ARCHIVE_BYTES = 128 << 20  # an archive is closed beyond this size
READ_BYTES = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive is not what it says."""


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def sha1_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record; a revisit has the HTTP header of the response but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: {sha1_name(payload)}", f"WARC-Block-Digest: {sha1_name(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, kind, refers_to: of equal payloads the page with the largest id is the response.

    A null html is an empty payload.  Rows with the largest id that occur twice are both
    responses; a row without an id revisits the largest, or is a response if none has one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= least, F.sha1("payload")))
    largest = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(largest, "digest", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.lit("revisit")).otherwise("response").alias("kind"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the records of plan_records(); returns the manifest (path, records, bytes)."""
    spark = records.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        store.create_dir(path, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for page, url, payload, kind, refers in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                address = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = deflate.compress(record(kind, "" if page is None else str(page), address, payload, str(refers))) + deflate.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x[0]}" for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "records", "bytes"])

    return stored(records.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def members(chunks: Iterator[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated bytes of each gzip member, piece by piece as the file is read."""
    waiting = b""

    def one() -> Iterator[bytes]:
        nonlocal waiting
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not waiting:
                waiting = next(chunks, b"")
                if not waiting:
                    raise WarcError("the archive ends inside a member")
            piece, waiting = inflate.decompress(waiting), b""
            if inflate.eof:
                waiting = inflate.unused_data
            if piece:
                yield piece

    while True:
        if not waiting:
            waiting = next(chunks, b"")
            if not waiting:
                return
        yield one()


def read_record(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers and block of the one record of a member, framed by its content length."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise WarcError("a member ends inside a header")
        held += piece
    version, *lines = bytes(held[:end]).decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise WarcError(f"not a WARC record: {version[:20]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    for piece in pieces:
        held += piece
    block = bytes(held[end + 4 : end + 4 + size])
    if len(held) != end + 4 + size + 4 or not held.endswith(b"\r\n\r\n"):
        raise WarcError("a record is not as long as it says")
    if headers["warc-block-digest"] != sha1_name(block):
        raise WarcError(f"block digest of {headers['warc-record-id']}")
    return headers, block


def page_of(name: str | None) -> int | None:
    inner = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner not in ("", "None") else None


def read_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload, payload_digest, refers_to) of every record of the archives.

    payload is null for revisits.  Block and payload digests are verified; an
    archive that is cut off or changed raises WarcError.
    """
    paths = manifest.select("path").repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload", "payload_digest", "refers_to"]
        types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
            out.clear()
            return made

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inside = open_folder(path)
                with store.open_input_stream(inside, compression=None) as file:
                    for pieces in members(iter(lambda: file.read(READ_BYTES), b"")):
                        headers, block = read_record(pieces)
                        payload = block[block.index(b"\r\n\r\n") + 4 :] if headers["warc-type"] == "response" else None
                        if payload is not None and headers["warc-payload-digest"] != sha1_name(payload):
                            raise WarcError(f"payload digest of {headers['warc-record-id']}")
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        out.append((page_of(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], payload, digest, page_of(headers.get("warc-refers-to"))))
                        held += len(payload or b"")
                        if held > 1 << 22 or len(out) >= 5000:
                            yield flush()
                            held = 0
        yield flush()

    return paths.mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long")


def summaries(read: DataFrame) -> DataFrame:
    """One row for each record; a revisit's size is that of the response it refers to, whose digest must be its own."""
    slim = stored(read.select("page_id", "record_type", "payload_digest", "refers_to", F.length("payload").cast("long").alias("payload_bytes")), "records")
    said = slim.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_bytes")).distinct()
    again = slim.where("record_type = 'revisit'").join(said, ["refers_to", "payload_digest"], "left")
    found = F.coalesce("_bytes", F.raise_error(F.lit("a revisit refers to no response of its digest")).cast("long"))
    again = again.select("page_id", found.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return slim.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)

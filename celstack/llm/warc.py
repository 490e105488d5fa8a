"""WARC archives with a Zstandard dictionary: one frame per record, the dictionary in a leading skippable frame.

Writing. A dictionary is trained on a bounded sample of records. Payload digests are compared first: of equal payloads the page
with the largest id becomes the response, the others are revisits that refer to it and carry no payload. Every task then writes
archives of bounded size under the shared folder, each starting with a skippable frame that holds the dictionary, followed by
one frame per record, so any record can be read from its offset. A task writes under a name of its own attempt; only files named
in the returned table count, so a lost or repeated task leaves nothing that is read.

Reading. The table of archives is dealt out, and tasks stream the records of one archive after the other; digests of responses
are recomputed and must match.

Defined cases: a null payload is empty; a null URL is written as about:blank, and characters outside printable ASCII in a URL are
percent-encoded; a null ``page_id`` is a record of its own that is never referred to; of repeated rows of the largest id each is
a response. Only ``page_id``, ``url`` and ``html`` are read. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, work_folder
from .common import hashed_sample, utf8

SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
RECORD = "<urn:page:{}>"
TASK_BYTES = 1 << 27
MANIFEST = "archive string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A response record with its payload, or a revisit of ``refers_to`` that keeps only the HTTP header of its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", RECORD.format(page_id)), ("WARC-Date", date),
              ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="replace") if url else "about:blank"),
              ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", RECORD.format(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(fields) + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises ``ValueError`` where its payload does not have its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": _page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def _page(uri: str | None) -> int | None:
    name = uri[10:-1] if uri else "None"
    return None if name == "None" else int(name)


def train_dictionary(pages: DataFrame, rows: int = 1000, bytes_each: int = 8192, size: int = 1 << 15) -> bytes:
    """A dictionary from at most ``rows`` records, chosen by a hash of their id, and the first ``bytes_each`` bytes of each.

    Too few or too small records to train on give a raw dictionary of the same bytes (empty for an empty table).
    """
    sample = pages.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, bytes_each).alias("html"))
    sample = hashed_sample(sample, "page_id", pages.count(), rows).collect()
    records = [record(r["page_id"], r["url"], utf8(r["html"])[:bytes_each], None) for r in sample]
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:size]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload, of at least ``min_bytes`` bytes, a page of a larger id has too."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    digests = cut(pages.where("page_id is not null").select("page_id", size.alias("size"), content_digest().alias("digest")))
    large = digests.where(F.col("size") >= min_bytes)
    last = cut(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return large.join(last, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def content_digest() -> Column:
    return F.unhex(F.sha2(F.coalesce("html", F.lit("")), 256))


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, archive_bytes: int = 1 << 25, level: int = 3) -> DataFrame:
    """Write every page as a record; a table of (archive, records, bytes) is returned. ``folder`` is a URI every executor reaches."""
    spark = pages.sparkSession
    folder = folder or f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    dictionary = train_dictionary(pages)
    known = cut(revisits(pages, min_bytes))
    marked = pages.select("page_id", "url", "html", content_digest().alias("digest")).join(known, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        out, done, stream, name, written, records = [], [], None, "", 0, 0

        def close() -> None:
            nonlocal stream
            if stream is not None:
                stream.close()
                out.append((f"{folder}/{name}", records, written))
                stream = None

        for batch in batches:
            for page_id, refers_to, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "refers_to", "url", "html")), strict=True):
                if stream is None:
                    name, records = f"{uuid.uuid4().hex}.warc.zst", 0
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                    stream.write(frame := dictionary_frame(dictionary))
                    written = len(frame)
                data = compressor.compress(record(page_id, url, utf8(html), refers_to))
                stream.write(data)
                written, records = written + len(data), records + 1
                if written >= archive_bytes:
                    close()
        close()
        done = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["archive", "records", "bytes"])

    return cut(marked.mapInArrow(run, MANIFEST))


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path there; a path without a scheme is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_records(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of an archive: the leading frame's dictionary, then one frame after the other."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(size)))
    offset, begun, parts, frame, data = 8 + size, 8 + size, [], decompressor.decompressobj(), stream.read(chunk)
    while data:
        parts.append(frame.decompress(data))
        left = frame.unused_data if frame.eof else b""
        offset += len(data) - len(left)
        if frame.eof:
            yield begun, b"".join(parts)
            begun, parts, frame = offset, [], decompressor.decompressobj()
        data = left or stream.read(chunk)
    if parts:
        raise ValueError("the archive ends within a record")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives named in ``archives``; ``payloads`` adds the payload of responses."""
    schema = RECORDS + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = open_store(archive)
                found, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for offset, data in read_records(stream):
                        parsed = parse_record(data) | {"archive": archive, "offset": offset}
                        if not payloads:
                            parsed["payload"] = None
                        found.append(parsed)
                        held += len(data) if payloads else 0
                        if len(found) >= 1024 or held > 1 << 24:
                            yield rows(found)
                            found, held = [], 0
                yield rows(found)

    # archives are bounded in size, so they are dealt out one by one: to as many tasks as run at once, or more if there are more bytes
    sizes = archives.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    tasks = max(archives.sparkSession.sparkContext.defaultParallelism, -(-(sizes["bytes"] or 0) // TASK_BYTES))
    return archives.select("archive").repartition(max(1, min(sizes["n"], tasks))).mapInArrow(run, schema)

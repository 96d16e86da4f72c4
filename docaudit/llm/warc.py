"""WARC archives with dictionary-compressed records.

An archive starts with a skippable frame that holds a Zstandard dictionary, built from records
of the same archive; then every record is a frame of its own, compressed with it. Pages whose
payload is archived already become revisit records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled, shared_dir
from .common import small_batches

LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
"""Bytes of records, uncompressed, after which an archive is closed."""
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
SKIPPABLE = 0x184D2A5D
LEVEL = 3
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, sha256, refers_to) of the pages that revisit another.

    Of equal payloads of LEAST_REVISIT_BYTES bytes or more, the one with the largest page_id is
    archived. Payloads move as digests only.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    light = pages.select("page_id", F.sha2(body, 256).alias("sha256"), F.octet_length(body).alias("bytes"))
    large = light.filter((F.col("bytes") >= LEAST_REVISIT_BYTES) & F.col("page_id").isNotNull())
    copies = large.groupBy("sha256").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    copies = settled(copies.filter("n > 1").select("sha256", "refers_to"), "copies")
    found = large.join(copies, "sha256").filter("page_id <> refers_to")
    return settled(found.select("page_id", "sha256", "refers_to").distinct(), "revisits")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record. Line breaks in a value become blanks."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{name}: {' '.join(value.splitlines())}" for name, value in headers]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    headers = [
        ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()),
        ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if refers_to is None:
        return record("response", headers, _HTTP + payload)
    headers += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _record_id(refers_to)), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return record("revisit", headers, _HTTP)


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on the records, or, where they are too few for that, their bytes."""
    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r[: SAMPLE_BYTES // 8])
        size += len(samples[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(size // 10, 256)), samples, level=LEVEL)
    except zstandard.ZstdError:
        raw = b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1"
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    dictionary = build_dictionary(records)
    embedded = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    frames = [writer.compress(r) for r in records]
    return b"".join([struct.pack("<II", SKIPPABLE, len(embedded)), embedded, *frames])


def read_records(data: bytes):
    """(headers, block) of every record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    dictionary = zstandard.ZstdCompressionDict(
        raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    )
    reader, rest = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(data)[8 + size :]
    while len(rest):
        frame = reader.decompressobj()
        body = frame.decompress(rest)
        rest = rest[len(rest) - len(frame.unused_data) :]
        head, _, block = body.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield headers, block[: int(headers["Content-Length"])]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the archives written to `folder`, which all executors share.

    Each task writes archives of its own, named by partition and attempt; only those of tasks
    that succeeded are listed, so what a lost executor leaves behind is never read.
    """
    small_batches(pages.sparkSession, 128)
    revisits = decide(pages).withColumnsRenamed({"page_id": "__id", "sha256": "__sha"})
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    read = pages.select("page_id", "url", body.alias("payload"))
    same = (F.col("page_id") == F.col("__id")) & (F.sha2("payload", 256) == F.col("__sha"))
    rows = read.join(revisits, same, "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", "refers_to")

    def write(batches):
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        waiting, size, number = [], 0, 0

        def close():
            nonlocal waiting, size, number
            data = archive(waiting)
            path = f"{base}/pages-{context.partitionId():06}-{context.taskAttemptId()}-{number:04}.warc.zst"
            with store.open_output_stream(path, compression=None) as out:
                out.write(data)
            made = pa.RecordBatch.from_pydict({"path": [path], "records": [len(waiting)], "bytes": [len(data)]})
            waiting, size, number = [], 0, number + 1
            return made

        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not waiting:
                    info = f"software: docaudit\r\nformat: WARC File Format 1.1\r\npart: {number}\r\n".encode()
                    name = _record_id(f"{context.partitionId()}-{number}")
                    waiting.append(record("warcinfo", [("WARC-Record-ID", name), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], info))
                waiting.append(page_record(page_id, url, payload, refers_to))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if waiting:
            yield close()

    return settled(rows.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of all page records.

    Payloads of responses are hashed again; a digest that differs from the record's ends the
    run. A revisit has the length and digest that its record states.
    """

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                with store.open_input_file(path) as f:
                    data = f.read()
                rows = []
                for headers, block in read_records(data):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        payload = block[len(_HTTP) :]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(headers["WARC-Payload-Length"]):
                            raise ValueError(f"{path}: the payload of {headers['WARC-Record-ID']} differs from its digest")
                    rows.append((
                        headers.get("WARC-Page-ID"), headers["WARC-Payload-Length"], digest, kind,
                        headers.get("WARC-Refers-To-Page-ID"), headers["WARC-Target-URI"],
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 6, names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    # a given number of partitions, as archives are many megabytes behind a short path
    spread = archives.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(read, ", ".join(f"{n} string" for n in names)).select(
        *[F.col(n).cast("long").alias(n) if n in ("page_id", "payload_bytes", "refers_to") else n for n in names]
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages as archives to the session's shared folder and read them back.

    A row per input row. Null html counts as empty. Payloads of under LEAST_REVISIT_BYTES bytes
    are always responses, as are rows without a page_id. Rows that repeat the page_id and
    payload of a response are responses as well. An empty table gives no archive and no rows;
    extra columns are ignored.
    """
    folder = shared_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)

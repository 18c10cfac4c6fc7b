"""Dictionary-compressed WARC archives.

A writer task takes one partition of records, sorted by page_id, url and digest, and writes one archive
after another. Of the records that begin an archive (up to ``TRAIN_BYTES``, cut into pieces of
``PIECE_BYTES``, so few or large records give as many samples) it builds a Zstandard dictionary; where
they are too few or too plain to train on, the dictionary is their bytes themselves, so every archive
has one. It stands in a skippable frame at the head of the file (magic 0x184D2A5D, then its length),
and every record is a frame of its own under it, so that any record can be read alone by its offset.
An archive is closed at about ``ARCHIVE_BYTES``. What the dictionary learns from changes the size of an
archive, never a record.

An archive's name holds the task attempt that wrote it, and the manifest, which Spark commits once for
each task, names the archives that count: a repeated or speculative attempt neither mixes with another
nor doubles a record (its own files are left unnamed). Write the manifest as a table before reading by it.

Of records whose payloads are equal and at least ``SHARED_BYTES`` long, that with the least page_id is a
response and the others are revisit records, which name it, the digest and the length, but hold no payload.

Digests are compared by a grouped minimum over (digest), so equal payloads, however many, never meet
in one task. Payload bytes move once, by page. Archives are read by as many tasks as there are archives
(``READ_TASKS`` at most), one record at a time.

Defined cases: null html is an empty payload; null urls are empty; rows that share a page_id are
one record each, and equal ones among them are written as often; rows without a page_id keep their
payload as a response and come after all others; a payload over ``ARCHIVE_BYTES`` is one record all the
same; an empty table writes no archive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.combine import spread_join

SHARED_BYTES = 100
ARCHIVE_BYTES = 32 << 20
TRAIN_BYTES = 4 << 20
PIECE_BYTES = 8 << 10
DICTIONARY_BYTES = 64 << 10
READ_TASKS = 20_000
MAGIC = 0x184D2A5D
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html and what its record is: record_type, refers_to, payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.col("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    shared = rows.where((F.col("payload_bytes") >= SHARED_BYTES) & F.col("page_id").isNotNull())
    groups = shared.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    repeats = spread_join(shared.select("page_id", "payload_digest").distinct(), groups, ["payload_digest"], by="page_id")
    repeats = repeats.where("page_id > first").select("page_id", "payload_digest", F.col("first").alias("refers_to"))
    joined = rows.join(repeats, ["page_id", "payload_digest"], "left")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record_bytes(row: dict) -> bytes:
    """A WARC 1.1 record: headers, the HTTP headers with the payload's length, and the payload of a response."""
    page, kind = row["page_id"], row["record_type"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    body = http + ((row["html"] or "").encode() if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {quote(row['url'], safe=':/?#[]@!$&()*+,;=%27~-._')}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    page = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(told["Content-Length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload differs from its digest or length")
    return {
        "page_id": page(fields["WARC-Record-ID"]), "url": unquote(fields["WARC-Target-URI"]), "record_type": kind, "refers_to": page(fields.get("WARC-Refers-To")),
        "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
    return fs, path


def _archive(fs: pafs.FileSystem, path: str, sample: list[bytes], rest: Iterator[bytes], archive_bytes: int = ARCHIVE_BYTES) -> tuple[int, int]:
    """Write one archive: build the dictionary from the sample, then take records from rest until the archive is full. Records and bytes written."""
    held = _dictionary(sample)
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held), write_checksum=True)
    n, size = 0, 0
    with fs.open_output_stream(path, compression=None) as out:
        size += out.write(struct.pack("<II", MAGIC, len(held)) + held)
        for raw in sample:
            size += out.write(press.compress(raw))
            n += 1
        while size < archive_bytes and (raw := next(rest, None)) is not None:
            size += out.write(press.compress(raw))
            n += 1
    return n, size


def _dictionary(sample: list[bytes]) -> bytes:
    pieces = [x[k : k + PIECE_BYTES] for x in sample for k in range(0, len(x), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to learn from: the bytes themselves
        return b"".join(pieces[: DICTIONARY_BYTES // PIECE_BYTES])


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Write planned rows as archives into a shared folder; a lazy manifest with one row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        records = (record_bytes(row) for batch in batches for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist())
        number = 0
        while True:
            sample, size = [], 0
            while size < train_bytes and (raw := next(records, None)) is not None:
                sample.append(raw)
                size += len(raw)
            if not sample:
                return
            name = f"part-{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.zst"
            n, written = _archive(fs, os.path.join(base, name), sample, records, archive_bytes)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [written]})
            number += 1

    told = rows.select("page_id", "url", "html", "record_type", "refers_to", "payload_bytes", "payload_digest")
    return told.sortWithinPartitions(F.asc_nulls_last("page_id"), "url", "payload_digest").mapInArrow(run, MANIFEST)


def read_archive(path: str) -> Iterator[dict]:
    """The records of one archive, one frame at a time."""
    fs, place = _place(path)
    with fs.open_input_stream(place, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError(f"{path}: no dictionary frame at its head")
        kept = zstandard.ZstdCompressionDict(f.read(size))
        left = b""
        press = zstandard.ZstdDecompressor(dict_data=kept).decompressobj()
        out = bytearray()
        while chunk := left or f.read(1 << 20):
            out += press.decompress(chunk)
            left = b""
            if press.eof:
                left = press.unused_data
                yield parse_record(bytes(out))
                out = bytearray()
                press = zstandard.ZstdDecompressor(dict_data=kept).decompressobj()


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in a manifest (a written table: its rows are counted to deal the archives out)."""
    schema = RECORD if payloads else RECORD.removesuffix(", payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[dict] = []
                for record in read_archive(path):
                    rows.append(record)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    return manifest.select("path").repartition(min(max(manifest.count(), 1), READ_TASKS)).mapInArrow(run, schema)

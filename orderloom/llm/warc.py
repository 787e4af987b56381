"""WARC archives written and read as a chunked record table.

A record travels as rows of record identifier and chunk number, each with a few
kilobytes of its payload, so no task holds a whole payload beyond the row that
the source hands over. Writers and readers carry a running SHA-1 from chunk to
chunk; the writer compares it with the digest in the header, and the reader
gives every chunk the digest so far, so that the last one has that of the
payload.

Every task writes archives of its own under a name that no other attempt uses,
and returns one manifest row per record. Only rows of the attempt that Spark
accepted reach the manifest, and reading starts from the manifest; archives of
lost attempts are never read. Records are single gzip members, so a reader can
start at any of them.

Null payloads are empty. Of records with equal payloads, of at least
``min_bytes`` bytes, that with the largest identifier is the response, which the
others revisit; records without an identifier take no part and are responses.
Rows that repeat an identifier give a record each: where it is the largest of
its payload, all of them are responses. An empty table gives no archives. Only
the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import slices, stored
from orderloom.session import shared_folder

CHUNK_BYTES = 1 << 14
#: An archive is closed when it has grown beyond this.
ARCHIVE_BYTES = 1 << 29
#: Archives are read in ranges of about this size.
RANGE_BYTES = 1 << 25
_DATE = "2024-01-01T00:00:00Z"

MANIFEST = "archive string, offset long, length long"
CHUNKS = (
    "record_id long, chunk int, data binary, digest_so_far string, last boolean, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)
_ARROW_CHUNKS = pa.schema(
    [
        ("record_id", pa.int64()),
        ("chunk", pa.int32()),
        ("data", pa.binary()),
        ("digest_so_far", pa.string()),
        ("last", pa.bool_()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def classify(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """record_id, uri, payload, payload_bytes, sha1 and refers_to, which is null for responses."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    records = pages.select(
        F.col(key).cast("long").alias("record_id"),
        (F.col("url") if "url" in pages.columns else F.lit("")).alias("uri"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.unhex(F.sha1(body)).alias("sha1"),
    )
    groups = (
        records.where(F.col("record_id").isNotNull() & (F.col("payload_bytes") >= min_bytes))
        .groupBy("sha1", "payload_bytes")
        .agg(F.max("record_id").alias("response"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    joined = records.join(stored(groups, "copies"), ["sha1", "payload_bytes"], "left")
    return joined.select(
        *records.columns, F.when(F.col("response") != F.col("record_id"), F.col("response")).alias("refers_to")
    )


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk, in order within a partition; an empty payload has one empty chunk, a revisit one without data."""
    number = F.when(F.col("refers_to").isNotNull(), 1).otherwise(
        F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes)).cast("int")
    )
    kept = [c for c in records.columns if c != "payload"]
    listed = records.select("*", number.alias("chunks"), F.explode(F.sequence(F.lit(0), number - 1)).alias("chunk"))
    data = F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes))
    return listed.select(
        *kept, "chunk", (F.col("chunk") == F.col("chunks") - 1).alias("last"), F.when(F.col("refers_to").isNull(), data).alias("data")
    )


def _urn(record_id: int | None) -> str:
    return f"<urn:page:{'none' if record_id is None else record_id}>"


def _from_urn(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name in ("", "none") else int(name)


def _header(row: dict, digest: str) -> bytes:
    revisit = row["refers_to"] is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _urn(row["record_id"]),
        "WARC-Date": _DATE,
        "WARC-Target-URI": re.sub(r"\s", "%20", row["uri"] or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if revisit:
        fields["WARC-Refers-To"] = _urn(row["refers_to"])
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Payload-Length"] = str(row["payload_bytes"])
    fields["Content-Length"] = str(0 if revisit else row["payload_bytes"])
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"


class ArchiveWriter:
    """Writes chunk rows into archives of one task; gives (archive, offset, length) when a record ends."""

    def __init__(self, folder: str, archive_bytes: int = ARCHIVE_BYTES):
        self.archive_bytes = archive_bytes
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder)
        self.sink, self.name, self.at, self.begun = None, "", 0, 0
        self.member = self.running = None

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, row: dict) -> tuple[str, int, int] | None:
        if row["chunk"] == 0:
            if self.sink is None or self.at > self.archive_bytes:
                self.close()
                self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
                self.sink = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.member, self.running, self.begun = zlib.compressobj(1, wbits=31), hashlib.sha1(), self.at
            self._put(self.member.compress(_header(row, base32(row["sha1"]))))
        if row["data"]:
            self.running.update(row["data"])
            self._put(self.member.compress(row["data"]))
        if not row["last"]:
            return None
        if row["refers_to"] is None and self.running.digest() != row["sha1"]:
            raise ValueError(f"the payload of record {row['record_id']} changed while it was written")
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())
        return self.name, self.begun, self.at - self.begun

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write chunk rows and return the stored manifest: archive, offset and length of each record."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in slices(batches):
            for row in batch.to_pylist():
                writer = writer or ArchiveWriter(folder, archive_bytes)
                if (record := writer.add(row)) is not None:
                    done.append(record)
            if len(done) >= 10_000:
                yield _manifest(done)
                done = []
        if writer:
            writer.close()
        yield _manifest(done)

    return stored(chunks.mapInArrow(write, MANIFEST), "manifest")


def _manifest(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    kinds = (pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["archive", "offset", "length"]
    )


class Chunk(NamedTuple):
    record_id: int | None
    chunk: int
    data: bytes
    digest_so_far: str
    last: bool
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def _inflated(source, length: int, step: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The bytes of one gzip member, a few kilobytes at a time."""
    member = zlib.decompressobj(wbits=31)
    while length > 0 and not member.eof:
        packed = source.read(min(step, length))
        if not packed:
            raise EOFError("the archive ends inside a record")
        length -= len(packed)
        while packed and not member.eof:
            yield member.decompress(packed, step)
            packed = member.unconsumed_tail
    if not member.eof:
        raise EOFError("the record ends inside its gzip member")


def read_record(source, length: int, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The chunks of the record that starts where the source stands."""
    stream, buffer = _inflated(source, length), b""
    while b"\r\n\r\n" not in buffer:
        buffer += next(stream)
    head, _, buffer = buffer.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version!r}")
    field = dict(line.split(": ", 1) for line in lines)
    content, running, number = int(field["Content-Length"]), hashlib.sha1(), 0
    revisit = field["WARC-Type"] == "revisit"
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    total = int(field["WARC-Payload-Length"]) if revisit else content
    known = (total, digest, field["WARC-Type"], _from_urn(field["WARC-Refers-To"]) if revisit else None)
    left = content
    while True:
        while len(buffer) < min(left, chunk_bytes):
            buffer += next(stream)
        data, buffer = buffer[: min(left, chunk_bytes)], buffer[min(left, chunk_bytes) :]
        left -= len(data)
        running.update(data)
        so_far = base32(running.digest())
        if not left and not revisit and so_far != digest:
            raise ValueError(f"record {field['WARC-Record-ID']} does not have its digest")
        yield Chunk(_from_urn(field["WARC-Record-ID"]), number, data, digest if revisit else so_far, not left, *known)
        number += 1
        if not left:
            break
    for _ in stream:  # the end of the member, with its checksum
        pass


def read_archives(manifest: DataFrame, folder: str, data: bool = True) -> DataFrame:
    """The chunked record table of all records in the manifest; without ``data``, the last chunk of each and no bytes."""
    ranges = (
        manifest.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).alias("range"))
        .agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
        .select("archive", "records")
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in slices(batches, 1):
            archive, records = batch["archive"][0].as_py(), batch["records"][0].as_py()
            rows: list[Chunk] = []
            with store.open_input_file(f"{root}/{archive}") as source:
                for record in records:
                    source.seek(record["offset"])
                    for chunk in read_record(source, record["length"]):
                        if data or chunk.last:
                            rows.append(chunk if data else chunk._replace(data=None))
                        if len(rows) >= 256:
                            yield _chunks(rows)
                            rows = []
            yield _chunks(rows)

    return ranges.mapInArrow(read, CHUNKS)


def _chunks(rows: list[Chunk]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW_CHUNKS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_CHUNKS)], schema=_ARROW_CHUNKS)


def archived(
    pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> tuple[DataFrame, str]:
    """Write one record per page; the manifest and the folder of the archives."""
    folder = shared_folder(pages.sparkSession, "warc")
    return write_archives(chunked(classify(pages, key, payload, min_bytes)), folder, archive_bytes), folder


def page_records(pages: DataFrame) -> DataFrame:
    """Write the pages' records, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest, folder = archived(pages)
    read = read_archives(manifest, folder, data=False)
    return read.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )

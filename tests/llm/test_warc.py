"""WARC archives against their pages."""

import base64
import gzip
import hashlib
import io

import pytest
from orderloom.llm import warc
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        *(T.StructField(name, T.StringType()) for name in ("chunk", "data", "sha1", "archive", "record_id", "response")),
    ]
)
PAGES = [
    (1, "http://a.example/1", "<p>one</p>"),
    (2, "http://a.example/with space\r\nInjected: x", "<p>one</p>"),
    (3, None, None),
    (4, "u", ""),
    (5, "u", "é漢😀" * 40_000),
    (6, "u", "x" * 100_001),
    (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "u", "<p>one</p>"),
    (8, "u", "<p>one</p>"),
    (None, "u", "<p>one</p>"),
]


@pytest.fixture(scope="module")
def make_pages(spark):
    return lambda rows: spark.createDataFrame([(*r, *"123456") for r in rows], SCHEMA).repartition(3)


def expected(rows, least=0):
    def digest(html):
        return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()

    largest = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            largest[html or ""] = max(i, largest.get(html or "", i))
    out = []
    for i, _, html in rows:
        first = largest.get(html or "") if i is not None else None
        revisit = first is not None and first != i
        out.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(make_pages):
    found = warc.page_records(make_pages(PAGES))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(PAGES)
    assert warc.page_records(make_pages([])).count() == 0


def test_small_payloads_are_all_responses(make_pages):
    manifest, folder = warc.archived(make_pages(PAGES), min_bytes=20)
    read = warc.read_archives(manifest, folder, data=False)
    found = read.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=repr) == expected(PAGES, 20)


def test_chunks_carry_digests_and_give_the_payload(make_pages):
    manifest, folder = warc.archived(make_pages(PAGES[:8]), archive_bytes=1)  # every record closes its archive
    chunks = warc.read_archives(manifest, folder).collect()
    assert manifest.select("archive").distinct().count() > 3
    for page, _, html in PAGES[:8]:
        own = sorted((c for c in chunks if c.record_id == page), key=lambda c: c.chunk)
        assert [c.last for c in own] == [False] * (len(own) - 1) + [True]
        if own[0].record_type == "revisit":
            continue
        running = hashlib.sha1()
        for c in own:
            assert len(c.data) <= warc.CHUNK_BYTES
            running.update(c.data)
            assert c.digest_so_far == base64.b32encode(running.digest()).decode()
        assert b"".join(c.data for c in own).decode() == (html or "")


def test_archives_are_plain_gzip_members(make_pages):
    manifest, folder = warc.archived(make_pages(PAGES[:3]))
    for row in manifest.collect():
        with open(f"{folder.removeprefix('file:')}/{row.archive}", "rb") as file:
            file.seek(row.offset)
            text = gzip.decompress(file.read(row.length))
        head, _, body = text.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert text.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") and b"Injected" not in fields
        assert len(body) == int(fields[b"Content-Length"]) + 4


def test_damaged_records_are_noticed():
    row = {"record_id": 1, "uri": "u", "refers_to": None, "payload_bytes": 3, "sha1": hashlib.sha1(b"abc").digest()}
    good = gzip.compress(warc._header(row, warc.base32(row["sha1"])) + b"abc\r\n\r\n")
    assert [c.data for c in warc.read_record(io.BytesIO(good), len(good))] == [b"abc"]
    bad = gzip.compress(warc._header(row, warc.base32(row["sha1"])) + b"abd\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_record(io.BytesIO(bad), len(bad)))
    with pytest.raises(EOFError):
        list(warc.read_record(io.BytesIO(good[:-9]), len(good) - 9))

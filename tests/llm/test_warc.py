"""WARC archives: what is read back against what was written, and against plain Python."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from waymark.llm import warc
from waymark.llm.queries import op11_warc_archives

COLUMNS = "page_id long, url string, html string, record string"


def sha1(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages, least=0):
    """Rows of the report, by a table of payloads."""
    first, rows = {}, []
    for page, _, html, *_ in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        known = data in first and len(data) >= least
        rows.append((page, len(data), sha1(html), "revisit" if known else "response",
                     first[data] if known else None))
        first.setdefault(data, page)
    return sorted(rows, key=repr)


def report(frame, **options):
    return sorted((tuple(r) for r in warc.archive_round_trip(frame, **options).collect()), key=repr)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = op11_warc_archives(spark, "/root/testdata/sf0.01")
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type",
                             "refers_to"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(
        [tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def odd_pages():
    pages = [(n, f"http://host/{n} é\r\nX: 1", f"<p>é {n % 7}</p>" * (n % 5), "x")
             for n in range(40)]
    pages += [(100, None, None, None), (101, "u", "", None), (None, "u", "", None),
              (None, None, "<p>lost</p>", None), (102, "u", "<p>lost</p>", None)]
    pages += [(200, "u", "z" * 1000, None)] * 4 + [(199, "u", "z" * 1000, None)]
    pages += [(300, "u", "a" * 2500 + "é", None), (301, "u", "a" * 2500 + "é", None)]
    return pages


@pytest.mark.parametrize("least", [0, 30])
def test_odd_pages_in_small_chunks(spark, least):
    frame = spark.createDataFrame(odd_pages(), COLUMNS).repartition(3)
    assert report(frame, least_bytes=least, chunk_bytes=64, archive_bytes=400) == expected(
        odd_pages(), least)


def test_chunk_table_and_files(spark, tmp_path):
    """Chunks read back make the payloads; the files are WARC for any reader."""
    frame = spark.createDataFrame(odd_pages(), COLUMNS)
    index = warc.archived(frame, str(tmp_path), chunk_bytes=64)
    chunks = warc.read_archives(index, split=500)
    parts = {}
    for row in chunks.orderBy("record", "chunk").collect():
        data, digests = parts.setdefault((row["kind"], row["page"], row["record"]), (b"", []))
        parts[row["kind"], row["page"], row["record"]] = (
            data + bytes(row["data"] or b""), [*digests, (row["size"], row["digest"], row["last"])])
    assert len(parts) == len(odd_pages())
    responses = {}
    for (kind, page, record), (data, digests) in parts.items():
        assert [last for _, _, last in digests] == [False] * (len(digests) - 1) + [True]
        if kind == "response":
            responses[record] = data
            assert digests[-1][:2] == (len(data), sha1(data.decode()))
            running = hashlib.sha1(data[:digests[0][0]]).digest()
            assert digests[0][1] == base64.b32encode(running).decode()
    assert sorted(responses.values()) == sorted({(h or "").encode() for _, _, h, _ in odd_pages()})
    for row in chunks.where("kind = 'revisit'").collect():
        assert sha1(responses[row["refers_to"]].decode()) == row["digest"]
    total = 0
    for name in os.listdir(tmp_path):
        text = gzip.open(tmp_path / name).read()
        total += text.count(b"WARC/1.1\r\nWARC-Type: ")
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        assert b"\r\nX: 1" not in text
    assert total == len(odd_pages())


def test_large_payload_is_many_chunks(spark):
    html = "<p>0123456789</p>" * 400_000  # 6.8 MB
    frame = spark.createDataFrame([(1, "u", html, None), (2, "u", html, None)], COLUMNS)
    assert report(frame) == expected([(1, "u", html), (2, "u", html)])
    chunks = warc.payload_chunks(frame)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] == warc.CHUNK
    assert chunks.where("page_id = 1").count() == -(-len(html) // warc.CHUNK)


def test_damage_is_noticed(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "<p>one</p>", None)], COLUMNS)
    index = warc.archived(frame, str(tmp_path))
    file = next(tmp_path.iterdir())
    text = gzip.decompress(file.read_bytes()).replace(b"<p>one", b"<p>two")
    file.write_bytes(gzip.compress(text))
    size = file.stat().st_size
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archives(index.withColumn("end", F.lit(size).cast("long"))).collect()


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "<p>one</p>", None)], COLUMNS)
    index = warc.archived(frame, str(tmp_path))
    (tmp_path / "left-over.warc.gz").write_bytes(b"half a file")
    assert warc.read_archives(index).count() == 1


def test_no_pages(spark):
    assert report(spark.createDataFrame([], COLUMNS)) == []

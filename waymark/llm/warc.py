"""Web pages as WARC archives, written and read as a table of payload chunks.

A payload is never one value: it is rows of (record, chunk number), at most ``CHUNK`` bytes
each, in order. Digests are carried from chunk to chunk; writer and reader hold one chunk.

Writing: a first pass makes the SHA-1 of every payload. Of equal payloads the record of the
smallest page is the response; the others become revisit records without a payload. Records
are then dealt by their key, what is decided about a record before its chunks, and every task
appends to its own archives of about ``ARCHIVE`` bytes, one gzip member per record. What a task
has written is a row of the index; only the rows of successful attempts get into the index, so
files of a lost executor are never read.

Reading: the index is cut into ranges of about ``SPLIT`` bytes; a task reads its ranges member
by member and compares length and digest of every payload with what the record says.

Defined results: a null payload is empty. Equal smallest pages: the smaller record key is the
response, pages without an id come last. Rows that are equal in page, address and payload are
one record and revisits of it. Missing addresses are written as ``urn:unknown``. An empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from waymark.storage import materialize, scratch_path

CHUNK = 256 << 10
ARCHIVE = 1 << 30
SPLIT = 64 << 20
LEAST_BYTES = 0  # smaller payloads are always written in full
HEAD_LIMIT = 1 << 20
LEVEL = 3  # of compression
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS_OUT = 2000  # rows of a batch; chunks leave before they fill more than about CHUNK * 64


def record_key(page_id: str, url: str, payload: str) -> Column:
    """32 hexadecimal digits; equal for rows that are equal in all three."""
    def half(seed: int) -> Column:
        values = [c for name in (page_id, url) for c in (F.col(name).isNull(), F.col(name))]
        return F.hex(F.xxhash64(F.lit(seed), *values, F.col(payload)))

    return F.lower(F.concat(F.lpad(half(1), 16, "0"), F.lpad(half(2), 16, "0")))


def payload_chunks(pages: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """``(record, page_id, url, chunk, last, data)``: the payloads of ``pages`` in pieces; the
    rows of a record follow one another."""
    whole = pages.select(
        "page_id", F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = whole.withColumn("record", record_key("page_id", "url", "payload"))
    top = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)) - 1
    return keyed.withColumn("top", top).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), "top"))).select(
        "record", "page_id", "url", "chunk", (F.col("chunk") == F.col("top")).alias("last"),
        F.substring("payload", (F.col("chunk") * chunk_bytes + 1).cast("int"),
                    F.lit(chunk_bytes)).alias("data"))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def running_digests(chunks: DataFrame) -> DataFrame:
    """``(record, page_id, chunk, last, size, digest)``: bytes and SHA-1 of a payload up to the
    end of each chunk."""
    kind = chunks.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            sizes, digests = [], []
            for chunk, data in zip(batch["chunk"].to_pylist(), batch["data"]):
                if chunk == 0:
                    state, size = hashlib.sha1(), 0
                piece = data.as_buffer()
                state.update(piece)
                size += len(piece)
                sizes.append(size)
                digests.append(base32(state.copy().digest()))
            yield pa.record_batch(
                [batch["record"], batch["page_id"], batch["chunk"], batch["last"],
                 pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                names=["record", "page_id", "chunk", "last", "size", "digest"])

    return chunks.mapInArrow(run, f"record string, page_id {kind}, chunk long, last boolean, "
                                  "size long, digest string")


def decided(chunks: DataFrame, least_bytes: int) -> DataFrame:
    """``(record, page_id, size, digest, copies, first, first_page, shared)`` per record;
    ``first`` and its page are what a revisit refers to, null for a response. ``copies`` counts
    equal rows; of a ``shared`` payload all but one are revisits."""
    heads = running_digests(chunks).where("last").groupBy(
        "record", "page_id", "size", "digest").agg(F.count("*").alias("copies"))
    heads = materialize(heads, "payload-digests")
    place = F.struct(F.col("page_id").isNull().alias("lost"), "page_id", "record")
    firsts = heads.where(F.col("size") >= least_bytes).groupBy(
        F.col("digest").alias("_digest")).agg(F.min(place).alias("place"))
    other = F.col("place.record") != F.col("record")
    return heads.join(firsts, F.col("digest") == F.col("_digest"), "left").select(
        "record", "page_id", "size", "digest", "copies",
        F.when(other, F.col("place.record")).alias("first"),
        F.when(other, F.col("place.page_id")).alias("first_page"),
        (F.col("size") >= least_bytes).alias("shared"))


# --- archives ---------------------------------------------------------------------------

def open_place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


def urn(record: str, copy: int = 0) -> str:
    name = uuid.UUID(record) if not copy else uuid.UUID(
        bytes=hashlib.md5(f"{record}:{copy}".encode()).digest())
    return f"<urn:uuid:{name}>"


def http_head(size: int) -> bytes:
    return ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode("ascii")


class Archives:
    """The archives of one task; a record is begun, given its chunks and ended."""

    def __init__(self, folder: str, archive_bytes: int):
        self.place, self.folder = open_place(folder)
        self.limit, self.file, self.at = archive_bytes, None, 0

    def begin(self, head: dict, copy: int, revisit: bool) -> None:
        if self.file is None or self.at >= self.limit:
            self.close()
            self.place.create_dir(self.folder, recursive=True)
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            self.file, self.at = self.place.open_output_stream(
                self.name, compression=None), 0
        self.start, self.gzip = self.at, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        size = head["size"]
        http = http_head(size)
        fields = [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", urn(head["record"], copy)), ("WARC-Date", DATE),
            ("WARC-Target-URI", quote(head["url"] or "urn:unknown", safe=";/?:@&=+$,#%~!*'()-_.")),
            ("WARC-Payload-Digest", f"sha1:{head['digest']}"),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(http) if revisit else len(http) + size))]
        if head["page"] is not None:
            fields.append(("Page-Id", quote(head["page"])))
        if revisit:
            fields += [("WARC-Profile", PROFILE),
                       ("WARC-Refers-To", urn(head["first"] or head["record"]))]
            page = head["first_page"] if head["first"] else head["page"]
            if page is not None:
                fields.append(("Refers-To-Page-Id", quote(page)))
        lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
        self.put(f"WARC/1.1\r\n{lines}\r\n".encode("utf-8") + http)

    def put(self, data) -> None:
        self.send(self.gzip.compress(data))

    def send(self, packed: bytes) -> None:
        if packed:
            self.file.write(packed)
            self.at += len(packed)

    def end(self) -> tuple[str, int, int]:
        """File, start and end of the record."""
        self.put(b"\r\n\r\n")
        self.send(self.gzip.flush())
        return self.name, self.start, self.at

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def write_archives(chunks: DataFrame, decisions: DataFrame, folder: str,
                   archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes WARC files below ``folder``; returns the index ``(file, start, end)`` by record.

    To be materialised once: evaluating it writes the archives.
    """
    page = F.col("page_id").cast("string").alias("page")
    data = chunks.select("record", "chunk", "last", page, "url", "data", *(
        F.lit(None).cast(kind).alias(name) for name, kind in (
            ("size", "long"), ("digest", "string"), ("copies", "long"), ("first", "string"),
            ("first_page", "string"), ("shared", "boolean"))))
    heads = decisions.select(
        "record", F.lit(-1).cast("long").alias("chunk"), F.lit(False).alias("last"), page,
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("data"), "size",
        "digest", "copies", "first", F.col("first_page").cast("string").alias("first_page"),
        "shared")
    dealt = heads.union(data).repartition("record").sortWithinPartitions("record", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archives(folder, archive_bytes)
        head, written, small = {}, -1, []
        for batch in batches:
            found = []
            rows = zip(*(batch[c].to_pylist() for c in ("record", "chunk", "last", "url")),
                       batch["data"])
            for row, (record, chunk, last, url, piece) in enumerate(rows):
                if chunk < 0:
                    head = {c: batch[c][row].as_py() for c in (
                        "record", "page", "size", "digest", "copies", "first", "first_page",
                        "shared")}
                    written = -1
                    continue
                if chunk <= written:  # a repeat of the row
                    continue
                if chunk == 0:
                    head["url"], small = url, []
                    out.begin(head, 0, head["first"] is not None)
                if head["first"] is None:
                    out.put(piece.as_buffer())
                if not head["shared"]:  # fewer bytes than the limit for revisits
                    small.append(piece.as_py())
                written = chunk
                if last:
                    found.append(out.end())
                    for copy in range(1, head["copies"]):
                        out.begin(head, copy, head["shared"])
                        for part in small:
                            out.put(part)
                        found.append(out.end())
            if found:
                files, starts, ends = zip(*found)
                yield pa.record_batch([pa.array(files), pa.array(starts, pa.int64()),
                                       pa.array(ends, pa.int64())],
                                      names=["file", "start", "end"])
        out.close()

    return dealt.mapInArrow(run, "file string, start long, end long")


class Member:
    """Reads the gzip members of an archive from ``start`` to ``end`` piece by piece."""

    def __init__(self, file, start: int, end: int):
        file.seek(start)
        self.file, self.left = file, end - start
        self.packed, self.buffer = b"", b""

    def next(self) -> bool:
        """Goes to the next member, if there is one."""
        if not self.packed and not self.left:
            return False
        self.gzip, self.buffer = zlib.decompressobj(31), b""
        return True

    def fill(self) -> bool:
        """Unpacks some more of the member; false at its end."""
        while not self.gzip.eof:
            if not self.packed:
                self.packed = self.file.read(min(self.left, CHUNK))
                self.left -= len(self.packed)
                if not self.packed:
                    raise ValueError("archive ends inside a record")
            more = self.gzip.decompress(self.packed, CHUNK)
            self.packed = self.gzip.unused_data if self.gzip.eof else self.gzip.unconsumed_tail
            if more:
                self.buffer += more
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes before ``mark``, which is passed over."""
        while (at := self.buffer.find(mark)) < 0:
            if len(self.buffer) > HEAD_LIMIT or not self.fill():
                raise ValueError("record without an end of its head")
        found, self.buffer = self.buffer[:at], self.buffer[at + len(mark):]
        return found

    def pieces(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, at most ``CHUNK`` at once."""
        while size:
            if not self.buffer and not self.fill():
                raise ValueError("record shorter than its length")
            piece, self.buffer = self.buffer[:min(size, CHUNK)], self.buffer[min(size, CHUNK):]
            size -= len(piece)
            yield piece


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {name.lower(): value.strip() for name, _, value in
            (line.partition(":") for line in lines[1:])}


def records(member: Member) -> Iterator[tuple[dict[str, str], int, Iterator[bytes]]]:
    """Fields, payload length and payload pieces of each record; the pieces are to be read
    before the next record."""
    while member.next():
        fields = fields_of(member.until(b"\r\n\r\n"))
        http = member.until(b"\r\n\r\n")
        size = int(fields_of(http)["content-length"])
        inside = int(fields["content-length"]) - len(http) - 4
        yield fields, size, member.pieces(inside)
        if b"".join(member.pieces(4)) != b"\r\n\r\n" or member.fill():
            raise ValueError(f"record {fields['warc-record-id']} is longer than its length")


def chunk_rows(member: Member, with_data: bool) -> Iterator[tuple]:
    """Rows of the chunk table; a revisit has one chunk without data."""
    for fields, size, pieces in records(member):
        page, to = fields.get("page-id"), fields.get("refers-to-page-id")
        kind, wanted = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
        ids = (fields["warc-record-id"], fields.get("warc-refers-to"))
        pages = (page and unquote(page), to and unquote(to))
        if kind == "revisit":
            yield (*ids, kind, *pages, 0, True, size, wanted, None)
            continue
        state, seen, chunk = hashlib.sha1(), 0, 0
        for piece in pieces:
            state.update(piece)
            seen += len(piece)
            yield (*ids, kind, *pages, chunk, seen == size, seen,
                   base32(state.copy().digest()), piece if with_data else None)
            chunk += 1
        if not chunk:
            yield (*ids, kind, *pages, 0, True, 0, base32(state.digest()), None)
        if seen != size or base32(state.digest()) != wanted:
            raise ValueError(f"payload of {ids[0]} differs from its digest")


def read_archives(index: DataFrame, with_data: bool = True, split: int = SPLIT) -> DataFrame:
    """The chunk table of the archives in ``index``: ``(record, refers_to, kind, page,
    refers_to_page, chunk, last, size, digest, data)``; size and digest up to the end of the
    chunk, of a revisit those of the full payload."""
    ranges = index.groupBy("file", F.floor(F.col("start") / split).alias("part")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    names = ["record", "refers_to", "kind", "page", "refers_to_page", "chunk", "last", "size",
             "digest", "data"]
    schema = pa.schema([(n, {"chunk": pa.int64(), "last": pa.bool_(), "size": pa.int64(),
                             "data": pa.binary()}.get(n, pa.string())) for n in names])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                               schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for file, start, end in zip(*(batch[c].to_pylist() for c in ("file", "start", "end"))):
                place, path = open_place(file)
                with place.open_input_file(path) as source:
                    for row in chunk_rows(Member(source, start, end), with_data):
                        rows.append(row)
                        held += len(row[-1] or b"")
                        if len(rows) >= ROWS_OUT or held >= 64 * CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return ranges.repartition("file", "part").mapInArrow(
        run, "record string, refers_to string, kind string, page string, refers_to_page string, "
             "chunk long, last boolean, size long, digest string, data binary")


def archived(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES,
             chunk_bytes: int = CHUNK, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives below ``folder``; their index."""
    chunks = payload_chunks(pages, chunk_bytes)
    decisions = materialize(decided(chunks, least_bytes), "record-types")
    return materialize(write_archives(chunks, decisions, folder, archive_bytes), "warc-index")


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, **options) -> DataFrame:
    """What the archives of ``pages`` say about each page: ``(page_id, payload_bytes,
    payload_digest, record_type, refers_to)``."""
    folder = scratch_path(pages.sparkSession, "archives")
    kind = pages.schema["page_id"].dataType
    read = read_archives(archived(pages, folder, least_bytes, **options), with_data=False)
    return read.where("last").select(
        F.col("page").cast(kind).alias("page_id"), F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.col("refers_to_page").cast(kind).alias("refers_to"))

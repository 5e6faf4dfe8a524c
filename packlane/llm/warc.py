"""WARC archives as a chunked record table.

Writing: each page becomes a record of its own gzip member. Of pages with
equal payloads the one with the largest page_id is written as a response, the
others as revisits that name it and carry its length and digest. Only payload
digests meet in a shuffle; pages are written where they are read, unless very
many groups of equal payloads exist (then they are dealt by digest and salt).

Reading: an archive is streamed through a fixed buffer, and a payload comes
out as rows of a record and a chunk number, with the bytes so far and their
SHA-1 so far; no payload is held whole, however long it is. The last chunk of
a record carries its full length and digest.

A page_id is the low half of its record's UUID, so it needs no header of its
own. Cases: a null payload counts as empty, and empty payloads are equal; a
null page_id is a record without page_id, a response only if no page of its
group has one; rows repeated with the largest page_id of their group are all
responses; a null url has no target, and control characters in one become
blanks. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payload bytes in a chunk row; compressed bytes read at once; bytes after which an archive is closed and the next one begun.
CHUNK, READ, ROLL = 256 << 10, 64 << 10, 1 << 30
#: High halves of the UUIDs of records with and without a page_id.
NAMED, NAMELESS = 0x7061636B6C616E65, 0x7061636B6C616E66
DATE = "2000-01-01T00:00:00Z"
CONTROL = re.compile(r"[\x00-\x20\x7f]+")


class DamagedArchive(ValueError):
    """An archive that does not hold whole records."""


def record_id(page_id: int | None) -> str:
    high, low = (NAMELESS, 0) if page_id is None else (NAMED, page_id & 0xFFFFFFFFFFFFFFFF)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(record: str) -> int | None:
    n = uuid.UUID(record[len("<urn:uuid:") : -1]).int
    low = n & 0xFFFFFFFFFFFFFFFF
    return None if n >> 64 == NAMELESS else low - (1 << 64) if low >> 63 else low


def sha1_text(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def pieces(page_id: int | None, url: str | None, payload: bytes | memoryview, keeper: int | None, revisit: bool) -> Iterator[bytes | memoryview]:
    """One uncompressed record, its headers and then slices of the payload that copy nothing."""
    view = memoryview(payload)
    sha = hashlib.sha1()
    for at in range(0, len(view), CHUNK):
        sha.update(view[at : at + CHUNK])
    digest = sha1_text(sha.digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(view)}\r\n\r\n".encode()
    size = len(http) + (0 if revisit else len(view))
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {CONTROL.sub(' ', url).strip()}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(keeper)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    for at in range(0, 0 if revisit else len(view), CHUNK):
        yield view[at : at + CHUNK]
    yield b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, revisit: bool) -> bytes:
    """One uncompressed record, whole."""
    return b"".join(pieces(page_id, url, payload, keeper, revisit))


def _view(text: pa.Scalar) -> memoryview:
    """UTF-8 of a string, as it lies in its batch; null counts as empty."""
    held = text.as_buffer()
    return memoryview(b"" if held is None else held)


def _write(uri: str) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        pages = (row for batch in common.batches(rows) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), map(_view, batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()))
        held, part = next(pages, None), 0
        while held is not None:
            name, records = f"part-{task.partitionId():06d}-{part:03d}.warc.gz", 0

            def fill(out):
                nonlocal held, records
                written = 0
                while held is not None and written < ROLL:
                    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                    for piece in pieces(*held):
                        written += out.write(gz.compress(piece)) or 0
                    written += out.write(gz.flush()) or 0
                    records += 1
                    held = next(pages, None)

            common.put_file(uri, name, str(task.taskAttemptId()), fill)
            part += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["name", "records"])

    return run


def write(pages: DataFrame) -> tuple[str, DataFrame]:
    """The folder of the archives of pages(page_id, url, html), and a row for each archive: name, records."""
    spark = common.prepare(pages.sparkSession)
    rows = common.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    groups = common.table(groups, "warc-groups")
    dealt = common.join_small(rows, groups, "digest")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    uri = common.shared_dir(spark, "warc")
    made = dealt.select("page_id", "url", "html", "keeper", revisit.alias("revisit")).mapInArrow(_write(uri), "name string, records long")
    return uri, common.table(made, "warc-files")


class Stream:
    """Decompressed bytes of a file of gzip members, from a buffer of fixed size."""

    def __init__(self, raw) -> None:
        self.raw, self.gz, self.packed, self.plain = raw, None, b"", bytearray()

    def _more(self) -> bool:
        if not self.packed:
            self.packed = self.raw.read(READ)
            if not self.packed:
                if self.gz is not None:
                    raise DamagedArchive("a gzip member is cut short")
                return False
        if self.gz is None:
            self.gz = zlib.decompressobj(31)
        self.plain += self.gz.decompress(self.packed, READ)
        self.packed = self.gz.unconsumed_tail
        if self.gz.eof:
            # the tail may repeat what is unused
            self.packed, self.gz = self.gz.unused_data, None
        return True

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Up to and without mark; None at the end of the file."""
        at = 0
        while (found := self.plain.find(mark, at)) < 0:
            at = max(0, len(self.plain) - len(mark) + 1)
            if len(self.plain) > most:
                raise DamagedArchive("a header is too long")
            if not self._more():
                if self.plain:
                    raise DamagedArchive("a header is cut short")
                return None
        out = bytes(self.plain[:found])
        del self.plain[: found + len(mark)]
        return out

    def take(self, most: int) -> bytes:
        while not self.plain:
            if not self._more():
                raise DamagedArchive("a block is cut short")
        out = bytes(self.plain[:most])
        del self.plain[:most]
        return out

    def exactly(self, size: int) -> bytes:
        out = b""
        while len(out) < size:
            out += self.take(size - len(out))
        return out


def headers(block: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {p[0].strip().lower(): p[1].strip() for p in pairs if len(p) == 2}


def read_records(raw, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive."""
    stream = Stream(raw)
    while (head := stream.until(b"\r\n\r\n", 1 << 20)) is not None:
        h = headers(head)
        left = int(h["content-length"])
        before = 0
        http = stream.until(b"\r\n\r\n", 1 << 20)
        if http is None:
            raise DamagedArchive("a record has no block")
        left -= len(http) + 4
        page = page_of(h["warc-record-id"])
        row = {"record_id": h["warc-record-id"], "page_id": page, "record_type": h["warc-type"], "refers_to": page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None, "url": h.get("warc-target-uri"), "declared_digest": h["warc-payload-digest"].removeprefix("sha1:"), "declared_bytes": int(headers(http)["content-length"])}
        sha, number = hashlib.sha1(), 0
        while True:
            piece = bytearray()
            while left and len(piece) < chunk:
                got = stream.take(min(left, chunk - len(piece)))
                piece += got
                left -= len(got)
            sha.update(piece)
            before += len(piece)
            if not left and row["record_type"] == "response" and (before, sha1_text(sha.digest())) != (row["declared_bytes"], row["declared_digest"]):
                raise DamagedArchive("a payload is not the one that its record declares")
            yield row | {"chunk": number, "last": not left, "bytes": bytes(piece), "bytes_so_far": before, "digest_so_far": sha1_text(sha.digest())}
            number += 1
            if not left:
                break
        if stream.exactly(4) != b"\r\n\r\n":
            raise DamagedArchive("a record does not end where its length says")


CHUNKS = "record_id string, page_id long, record_type string, refers_to long, url string, declared_digest string, declared_bytes long, chunk long, last boolean, bytes binary, bytes_so_far long, digest_so_far string"


def _read(uri: str, chunk: int, payload: bool) -> Callable:
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in CHUNKS.split(", "))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = common.open_fs(uri)
        for batch in rows:
            for name in batch.column(0).to_pylist():
                out, held = [], 0
                with where.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for r in read_records(f, chunk):
                        held += len(r["bytes"])
                        out.append(r if payload else r | {"bytes": None})
                        if held > 8 << 20 or len(out) == 1000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def read(uri: str, files: DataFrame, chunk: int = CHUNK, payload: bool = True) -> DataFrame:
    """Chunk rows of all archives (see CHUNKS); without payload, bytes is null but lengths and digests are still taken from the bytes."""
    n = files.count()
    return files.select("name").repartition(max(1, n)).mapInArrow(_read(uri, chunk, payload), CHUNKS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, files = write(common.prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"))
    response = F.col("record_type") == "response"
    return read(uri, files, payload=False).where("last").select(
        "page_id",
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )

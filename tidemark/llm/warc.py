"""WARC archives: writing with revisit records, normalising monolithic gzip files, reading by offset.

A monolithic file is one gzip stream over all its records, so no record can be read alone. The normaliser
inflates such a stream once, holds one record at a time, and writes each record as its own gzip member,
with a sidecar index of offsets beside the file. File names hold the task attempt, and only files that a
finished task has reported are read, so retried tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import in_batches, pieces
from tidemark.session import materialize, scratch_path

READ_BYTES = 1 << 20
FILE_BYTES = 64 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path for a URI or a plain path; any store that pyarrow knows."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One response or revisit record; a revisit has the HTTP header only."""
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def page(self, name: str) -> int | None:
        value = self.headers.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None


def parse(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k: v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return Record(headers, rest[: int(headers["Content-Length"])])


def inflate(source) -> Iterator[bytes]:
    """Pieces of the inflated stream of an open file, read once; several members count as one stream."""
    engine = zlib.decompressobj(31)
    while data := source.read(READ_BYTES):
        while data:
            if out := engine.decompress(data, READ_BYTES):
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(31)
    if out := engine.flush():
        yield out


def split_records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, as bytes, of a stream of pieces; holds one record."""
    held = bytearray()

    def fill() -> bool:
        piece = next(stream, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while held or fill():
        searched = 0
        while (end := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0:
            searched = len(held)
            if not fill():
                if bytes(held).strip():
                    raise ValueError("a record is cut off in its header")
                return
        names = [x.split(b":", 1) for x in bytes(held[:end]).split(b"\r\n")[1:]]
        size = end + 4 + next(int(v) for k, v in names if k.strip().lower() == b"content-length") + 4
        while len(held) < size:
            if not fill():
                raise ValueError("a record is cut off")
        yield bytes(held[:size])
        del held[:size]


class Members:
    """Writes records as gzip members of one file and remembers their places."""

    def __init__(self, path: str):
        self.path, self.at, self.index = path, 0, []
        store, place = filesystem(path)
        self.file = store.open_output_stream(place, compression=None)

    def add(self, data: bytes, headers: dict[str, str]) -> None:
        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = engine.compress(data) + engine.flush()
        self.file.write(member)
        self.index.append({"id": headers["WARC-Record-ID"], "type": headers["WARC-Type"],
                           "offset": self.at, "length": len(member)})
        self.at += len(member)

    def close(self) -> None:
        self.file.close()
        store, place = filesystem(f"{self.path}.idx")
        with store.open_output_stream(place, compression=None) as out:
            out.write("".join(json.dumps(x) + "\n" for x in self.index).encode())


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def write_monolithic(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
                     min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write each row of ``pages`` (page_id, url, html) as a record; returns (path, records) of the files.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``min_bytes`` bytes the
    one with the largest page_id is the response, the others are revisits of it; smaller ones are all
    responses. A null page_id is never the one referred to, unless there is no other: then all rows of that
    payload are responses, as are rows that repeat the response's page_id. A file holds about
    ``file_bytes`` bytes of payload.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = (pages.where(F.octet_length("html") >= min_bytes).groupBy("digest")
                .agg(F.max("page_id").alias("latest"), F.count("*").alias("times")).where("times > 1").drop("times"))
    pages = pages.join(repeated, "digest", "left").select(
        "page_id", "url", "html", "latest",
        (F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = engine = None
        written = records = number = 0

        def finish():
            file.write(engine.flush())
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])

        for batch in in_batches(batches):
            for piece in pieces(batch, "html"):
                for row in piece.to_pylist():
                    if file is None:
                        path = f"{folder}/{_attempt()}-{number}.warc.gz"
                        store, place = filesystem(path)
                        store.create_dir(place.rpartition("/")[0], recursive=True)
                        file, engine = store.open_output_stream(place, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    payload = row["html"].encode()
                    file.write(engine.compress(
                        record(row["page_id"], row["url"], payload, row["latest"], row["revisit"], date)))
                    written, records = written + len(payload), records + 1
                    if written >= file_bytes:
                        yield finish()
                        file, written, records, number = None, 0, 0, number + 1
        if file is not None:
            yield finish()

    return materialize(pages.mapInArrow(run, "path string, records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the monolithic files in ``archives`` (path) with a member per record and a sidecar index
    (``.idx``: one JSON object per record with id, type, offset and length); returns (path, records)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            for number, source in enumerate(batch.column("path").to_pylist()):
                path = f"{folder}/{source.rpartition('/')[2].removesuffix('.warc.gz')}-{_attempt()}-{number}.warc.gz"
                store, place = filesystem(path)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = Members(path)
                store, place = filesystem(source)
                with store.open_input_stream(place, compression=None) as whole:
                    for data in split_records(inflate(whole)):
                        out.add(data, parse(data).headers)
                out.close()
                yield pa.RecordBatch.from_arrays([[path], pa.array([len(out.index)], pa.int64())], ["path", "records"])

    return materialize(archives.select("path").repartition("path").mapInArrow(run, "path string, records long"), "members")


def read(archives: DataFrame) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of normalised files.

    Every record is read alone, at the place that the sidecar index gives, and checked: a response's digest
    must be that of its payload. A revisit has no payload; its length is that of its HTTP header.
    """
    def row(record: Record) -> dict:
        head, _, payload = record.block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = record.headers["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = record.headers["WARC-Type"]
        if kind == "response" and (payload_digest(payload) != digest or len(payload) != size):
            raise ValueError(f"damaged record {record.headers['WARC-Record-ID']}")
        return {"page_id": record.page("WARC-Record-ID"), "url": record.headers["WARC-Target-URI"],
                "payload_bytes": size, "payload_digest": digest, "record_type": kind,
                "refers_to": record.page("WARC-Refers-To"), "payload": payload if kind == "response" else None}

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            for path in batch.column("path").to_pylist():
                store, place = filesystem(f"{path}.idx")
                with store.open_input_stream(place, compression=None) as lines:
                    index = [json.loads(x) for x in lines.read().splitlines()]
                store, place = filesystem(path)
                held, size = [], 0
                with store.open_input_file(place) as file:
                    for entry in index:
                        file.seek(entry["offset"])
                        held.append(row(parse(zlib.decompress(file.read(entry["length"]), 31))))
                        size += len(held[-1]["payload"] or b"")
                        if size > READ_BYTES or len(held) >= 1000:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("path").repartition("path").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
             "refers_to long, payload binary")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back; an empty table gives no rows. Files go to the shared scratch folder."""
    folder = scratch_path(pages.sparkSession, "warc")
    whole = write_monolithic(pages, f"{folder}/whole", min_bytes=min_bytes)
    return read(normalise(whole, f"{folder}/members"))

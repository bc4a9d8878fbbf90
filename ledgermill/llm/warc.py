"""WARC archives: a writer with revisit records, and a reader that splits files by byte range."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.llm.common import shared_folder, stored

MAGIC = b"\x1f\x8b\x08"
# A task reads the records that start in this many bytes of a file.
RANGE_BYTES = 8 * 1024 * 1024
# Bytes fetched at once.
READ_BYTES = 1024 * 1024
# Payloads of at least this many bytes are written once and revisited after.
LEAST_PAYLOAD = 0
LEVEL = 2
_OPENING, _END = b"WARC/1.", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_first_copy(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Pages (page_id, url, html) with ``payload`` and ``first_id``, the least id with that payload.

    The least id of each payload is found by an aggregation merged before the shuffle, and
    joined back to the pages; it is written before, so a hot payload can be split.
    """
    rows = pages.select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("payload_key", F.sha2("payload", 256))
    first = rows.groupBy("payload_key").agg(F.min("page_id").alias("first_id"))
    joined = rows.join(stored(first), "payload_key").drop("payload_key")
    small = F.octet_length("payload") < least_payload
    return joined.withColumn("first_id", F.when(small, F.col("page_id")).otherwise(F.col("first_id")))


def record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None) -> bytes:
    """One gzip member: a response, or a revisit that names the response's page."""
    revisit = page_id != first_id
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # Line ends in a URL would end its header.
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {target}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(first_id)}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode() + _END
    return squeeze.compress(head + block + _END) + squeeze.flush()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_head(data: bytes) -> dict[str, str] | None:
    """The headers of a record, if ``data`` begins with some."""
    end = data.find(_END)
    if not data.startswith(_OPENING) or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines if ": " in line)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per page, an archive per task, and returns (path, size) of each.

    Call with pages from :func:`with_first_copy`. Each attempt of a task writes a file of
    its own name, and the returned list, which is stored, names those of the attempts
    that counted. So a lost executor costs its tasks, and leaves at most unlisted files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        out, path, size = None, f"{base}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first_id")]
            for row in zip(*columns, strict=True):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                member = record(*row)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            name = path.rsplit("/", 1)[1]
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size]})

    return stored(pages.mapInArrow(run, "path string, size long"))


@dataclass
class _Window:
    """A file read forward; holds the bytes from ``at`` on."""

    file: pa.NativeFile
    size: int
    at: int
    data: bytes = b""

    def more(self) -> bool:
        start = self.at + len(self.data)
        got = self.file.read_at(min(READ_BYTES, self.size - start), start) if start < self.size else b""
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def read_range(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records of a file that start in ``[start, end)``, unpacked.

    The range is scanned for gzip's magic. A place with it begins a record only if it
    unpacks to WARC headers, of any length, and on to the end of a gzip member with the right checksum;
    the magic may also stand inside packed data. After a record the next one is tried
    first where that ended. A record is read to its end, wherever that lies.
    """
    window = _Window(file, size, start)
    while window.at < end:
        place = window.data.find(MAGIC)
        if place < 0:
            window.skip(max(0, len(window.data) - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.skip(place)
        if window.at >= end:
            return
        taken, content = _member(window)
        if content is None:
            window.skip(1)
        else:
            yield content
            window.skip(taken)


def _member(window: _Window) -> tuple[int, bytes | None]:
    """Length and content of the member that the window begins with, None if it is none."""
    unpack, parts, used, opening = zlib.decompressobj(31), [], 0, b""
    while True:
        try:
            parts.append(unpack.decompress(window.data[used:]))
        except zlib.error:
            return 0, None
        used = len(window.data) - len(unpack.unused_data)
        if len(opening) < len(_OPENING):
            opening += parts[-1][: len(_OPENING) - len(opening)]
            if not _OPENING.startswith(opening):
                return 0, None
        if unpack.eof:
            content = b"".join(parts)
            return (0, None) if parse_head(content) is None else (used, content)
        if not window.more():
            return 0, None


def read_archives(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of archives (path, size), read by tasks that each take a byte range.

    ``payload`` is null for a revisit; its size and digest are those of the full payload.
    Records of other types, and bytes that are no record, are passed over. Files of no
    bytes and an empty list give no rows.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("size > 0").select("path", "size", F.explode(starts).alias("start"))
    # One range to a partition, or several where there are more ranges than that.
    count = max(1, min(ranges.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    end = min(row["start"] + range_bytes, row["size"])
                    for content in read_range(file, row["size"], row["start"], end):
                        parsed = parse_record(content)
                        if parsed is None:
                            continue
                        rows.append(parsed)
                        held += len(content)
                        if held > 4 * READ_BYTES:
                            yield _records(rows)
                            rows, held = [], 0
                if rows:
                    yield _records(rows)

    return ranges.repartition(count, "path", "start").mapInArrow(run, RECORDS)


def parse_record(content: bytes) -> tuple | None:
    """A row of ``RECORDS``; None for other record types."""
    head = parse_head(content) or {}
    kind = head.get("WARC-Type")
    if kind not in ("response", "revisit"):
        return None
    begin = content.find(_END) + len(_END)
    block = content[begin : begin + int(head["Content-Length"])]
    http_end = block.find(_END)
    http = block[:http_end].decode("latin-1").split("\r\n")[1:]
    length = int(dict(line.split(": ", 1) for line in http)["Content-Length"])
    payload = block[http_end + len(_END) :] if kind == "response" else None
    url = head.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    refers = head.get("WARC-Refers-To")
    return (
        _page_id(head["WARC-Record-ID"]),
        url,
        kind,
        _page_id(refers) if refers else None,
        length if payload is None else len(payload),
        head["WARC-Payload-Digest"].removeprefix("sha1:") if payload is None else base32_sha1(payload),
        payload,
    )


_KINDS = (
    pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(),
)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=names
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) written as archives in the shared folder and read back.

    Of pages with equal payloads the one with the least page_id is a response and the
    others revisit it. A null html has an empty payload. Rows that repeat that least id
    with the same payload are responses too; a null id comes after all others. Other
    columns are ignored, and no pages give no records.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")
    files = write_archives(with_first_copy(pages), folder)
    return read_archives(spark, files)

"""WARC archives written and read through an index (operator 10).

Writing: every page becomes a record, a gzip member of its own, in archives that tasks write side by side. Of pages with equal payloads (of at
least `min_bytes` bytes) the one with the smallest id is a response; the others are revisits, which hold headers only and refer to it. Equal payloads
are found by SHA-256 with partial minima, so a payload that fills a third of the table is one row per task; pages cross the network
once. While writing, each task notes file, offset, length, URL and digest of its records: the index, a table of its own.

Reading goes from the index: the selected entries are sorted by file and offset and dealt by range, near ones are read with one request
(`gap`, `read_bytes`), and records are parsed from the bytes.

A task that fails or runs twice leaves an archive that no index entry names; entries exist for finished tasks only. Archives are
written and read by pyarrow's file systems, so the folder must be one that these reach from every executor.

Null html is an empty payload. A null id is never the smallest: such a page revisits an equal one that has an id, and is a response otherwise. Rows with
equal ids and payloads are alike: both responses, or both revisits. Null urls are recorded as `urn:unknown`; characters that can't stand in a header
are escaped. An empty table gives an empty index and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.catalog.registry import query
from wardline.llm.common import frugal
from wardline.workdir import new_path, written

ARCHIVE_BYTES = 1 << 30
# Archive bytes that one task reads.
TASK_BYTES = 16 << 20
GAP, READ_BYTES = 1 << 16, 8 << 20
_ID = "urn:page:"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if is_revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])


def _id_in(value: str) -> int | None:
    number = value.removeprefix(f"<{_ID}").removesuffix(">")
    return int(number) if number else None


def parse_record(data: bytes) -> tuple:
    """(page_id, url, payload or None, payload bytes, digest, type, refers_to) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "revisit":
        size, digest, payload = int(_headers(http)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
    else:
        size, digest = len(payload), digest_of(payload)
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    refers = _id_in(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return _id_in(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, size, digest, kind, refers


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, first): `first` is the smallest id of equal payloads, null where there is none or they are too small."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn(
        "key", F.sha2(F.col("html").cast("binary"), 256))
    first = written(rows.where(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first")), "warc-first")
    return rows.join(first, "key", "left").select("page_id", "url", "html", "first")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as archives into `folder` and return the index, written beside them."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, path, place = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, first in zip(*(column.to_pylist() for column in batch.columns)):
                if out is None or place >= archive_bytes:
                    if out is not None:
                        out.close()
                    path = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(path, compression=None, buffer_size=1 << 20)
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {_DATE}\r\n"
                    start = gzip_member((info + "Content-Length: 0\r\n\r\n\r\n\r\n").encode())
                    out.write(start)
                    place = len(start)
                payload = html.encode()
                digest = digest_of(payload)
                revisit = first is not None and (page_id is None or page_id > first)
                url = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "urn:unknown"
                member = gzip_member(record_bytes(page_id, url, payload, digest, first, revisit))
                out.write(member)
                rows.append((page_id, path, place, len(member), url, digest, "revisit" if revisit else "response"))
                place += len(member)
            names = [part.split()[0] for part in INDEX.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if out is not None:
            out.close()

    return written(with_roles(pages, min_bytes).mapInArrow(frugal(write), INDEX), "warc-index")


def coalesced(entries: list[tuple[int, int]], gap: int = GAP, read_bytes: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) -> (first entry, entry after the last, end offset) of requests: near entries share one."""
    requests: list[tuple[int, int, int]] = []
    begin, end = 0, 0
    for k, (offset, length) in enumerate(entries):
        if k and (offset - end > gap or max(end, offset + length) - entries[begin][0] > read_bytes):
            requests.append((begin, k, end))
            begin = k
        end = max(end, offset + length) if k > begin else offset + length
    if entries:
        requests.append((begin, len(entries), end))
    return requests


def read_records(index: DataFrame, folder: str, payloads: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of the index entries given (a selection of them, or all), payloads included on demand.

    The index is narrow, so its own size says nothing about the work: tasks are dealt by the bytes of archives to read.
    """
    total = index.agg(F.sum("length")).first()[0] or 0

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        names = [part.split()[0] for part in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            entries: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*(column.to_pylist() for column in batch.columns)):
                entries.setdefault(file, []).append((offset, length))
            for file, ranges in entries.items():
                with system.open_input_file(file) as source:
                    for first, last, end in coalesced(ranges):
                        start = ranges[first][0]
                        data = source.read_at(end - start, start)
                        rows = [parse_record(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in ranges[first:last]]
                        columns = [list(c) for c in zip(*rows)]
                        if not payloads:
                            columns[2] = [None] * len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return (
        index.select("file", "offset", "length").repartitionByRange(max(1, -(-total // task_bytes)), "file", "offset").sortWithinPartitions("file", "offset")
        .mapInArrow(frugal(read), RECORD)
    )


@query("op10_warc")
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = new_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{folder}/pages.parquet"), archives)
    return read_records(index, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

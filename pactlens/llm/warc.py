"""WARC archives written by tasks with an index of byte ranges, and read back by coalesced ranges of the index."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm.common import columns_of, stored
from pactlens.session import scratch_path

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20  # an archive is closed once it is this long
GAP_BYTES = 64 << 10  # ranges with less between them are read as one
READ_BYTES = 16 << 20  # a coalesced range ends once it is this long
TASK_BYTES = 64 << 20  # archive bytes that a reading task gets, about
RECORDS_PER_BATCH = 128
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def _header_value(text: str) -> str:
    """A URL as it may stand in a header line: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_bytes(page_id, url, digest: str, size: int, kind: str, refers_to, payload: bytes) -> bytes:
    """One gzip member: a ``response`` with its HTTP message, or a ``revisit`` that names the response it repeats."""
    body = b""
    if kind == "response":
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """The fields of :data:`RECORD`; digest and length of a response are those of the payload read."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]

    def page(name: str):
        value = fields.get(name, "")[len("<urn:page:") : -1]
        return int(value) if value else None

    out = {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload_bytes": int(fields["Payload-Length"]),
        "payload": None,
    }
    if out["record_type"] == "response":
        out["payload"] = body.partition(b"\r\n\r\n")[2]
        out["payload_digest"], out["payload_bytes"] = hashlib.sha256(out["payload"]).hexdigest(), len(out["payload"])
    return out


def record_plan(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to``: what each page becomes.

    Pages of one payload combine to their smallest id inside each task; only payloads that at least two pages share go
    into the join, whose large side adaptive execution splits where one payload fills it.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digest = F.sha2(payload, 256)
    rows = columns_of(pages, "page_id", "url", "html")
    shared = (
        rows.where(F.octet_length("html") >= min_bytes)
        .groupBy(digest.alias("shared_digest"))
        .agg(F.min("page_id").alias("first_page"), F.count("page_id").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    rows = rows.select("page_id", "url", payload.alias("payload"), digest.alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    revisit = F.col("first_page").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_page"))
    return rows.join(shared, F.col("payload_digest") == F.col("shared_digest"), "left").select(
        *rows.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"),
    )


def write_archives(plan: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of :func:`record_plan` under ``folder`` and returns the index, itself a stored table.

    Every attempt of a task writes files of its own, and an index row names its file: files of attempts that were lost or
    ran twice are in no index and are never read.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        system.create_dir(root, recursive=True)
        name, out, at = None, None, 0
        try:
            for batch in batches:
                for part in (batch.slice(i, RECORDS_PER_BATCH) for i in range(0, batch.num_rows, RECORDS_PER_BATCH)):
                    index = []
                    for row in part.to_pylist():
                        if out is None or at >= archive_bytes:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{root}/{name}", compression=None)
                        payload = row.pop("payload")
                        data = record_bytes(row["page_id"], row["url"], row["payload_digest"], row["payload_bytes"], row["record_type"], row["refers_to"], payload)
                        out.write(data)
                        index.append(row | {"archive": name, "offset": at, "length": len(data)})
                        at += len(data)
                    yield pa.RecordBatch.from_pylist(index, schema=schema)
        finally:
            if out is not None:
                out.close()

    return stored(plan.mapInArrow(write, INDEX), "warc-index")


def read_records(selected: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = READ_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the index rows ``selected``, in :data:`RECORD` form.

    The ranges are sorted by (archive, offset) across the tasks, of which there are as many as the selected records have
    TASK_BYTES, or as there are cores: the index rows are small, what they stand for is not.  Each task joins neighbouring
    ranges to reads of at most about ``most`` bytes, and holds one read at a time.
    """
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        opened, source = None, None

        def fetch(archive: str, ranges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal opened, source
            if opened != archive:
                opened, source = archive, system.open_input_file(f"{root}/{archive}")
            start, end = ranges[0][0], max(o + n for o, n in ranges)
            data = source.read_at(end - start, start)
            for i in range(0, len(ranges), RECORDS_PER_BATCH):
                rows = [parse_record(data[o - start : o - start + n]) for o, n in ranges[i : i + RECORDS_PER_BATCH]]
                if not with_payload:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        archive, ranges = None, []
        for batch in batches:
            for name, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if ranges and (name != archive or offset > ranges[-1][0] + ranges[-1][1] + gap or offset + length - ranges[0][0] > most):
                    yield from fetch(archive, ranges)
                    ranges = []
                archive = name
                ranges.append((offset, length))
        if ranges:
            yield from fetch(archive, ranges)

    rows = columns_of(selected, "archive", "offset", "length")
    total = rows.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), selected.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Every page written to archives and read back: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes``.

    Defined cases: a null html is an empty payload; payloads under 100 bytes are never revisits; rows that share both
    smallest id and payload are all responses; a page without an id is a response that nothing refers to; a null url
    gives a record without target, control characters in a url come back percent-encoded; an empty table gives no rows;
    further columns are ignored.
    """
    folder = scratch_path(spark, "warc")
    index = write_archives(record_plan(pages), folder)
    return read_records(index, folder, with_payload=False).drop("payload")

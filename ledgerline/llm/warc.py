"""WARC archives in seekable Zstandard bundles.

Each task writes its pages as WARC/1.1 records. Records are grouped into independent
Zstandard frames of about ``frame_bytes``; a bundle is a run of frames with a seek
table (the seekable format's skippable footer: compressed and plain size and checksum of every
frame) and lies as one file in the shared folder. The index, a Parquet table, maps each
record's identifier to its bundle, frame and offset within the plain frame.

Only the index names bundles, and Spark commits its rows with the task: a
bundle that a lost or repeated attempt left behind is in no index and is never read.

Of pages with equal payloads of at least ``min_bytes`` the one with the largest id is a
response record, and the others are revisit records that refer to it (all rows with that id
are responses, should it be repeated). Smaller payloads are responses. A null
payload is empty; a null id or URL is written as an empty one and read back as
null. Other columns are not read; an empty table gives no bundle and no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def open_folder(uri: str):
    """The file system and path of a folder that driver and executors share."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


# --- records -------------------------------------------------------------------


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record when ``refers_to`` is given."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is None:
        body = _HTTP % len(payload) + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        body = b""
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"X-Payload-Length: {len(payload)}",
        ]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), payload and the next record's offset."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(head["content-length"])
    body = data[end + 4 : end + 4 + size]
    if len(body) != size:
        raise ValueError(f"the record at {at} is cut")
    return head, body.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else b"", end + 4 + size + 4


def page_of(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:x-page:").removesuffix(">") or None if urn else None


# --- bundles ---------------------------------------------------------------------


class BundleWriter:
    """Frames of whole records, then the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.stream, self.frame_bytes = stream, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.held: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int, int]] = []

    def add(self, data: bytes) -> tuple[int, int]:
        """The record's frame and its offset in the plain frame."""
        if self.size and self.size + len(data) > self.frame_bytes:
            self._flush()
        at = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        self.written += len(data)
        return at

    def _flush(self) -> None:
        from xxhash import xxh64_intdigest

        plain = b"".join(self.held)
        packed = self.zstd.compress(plain)
        self.stream.write(packed)
        self.frames.append((len(packed), len(plain), xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


class BundleReader:
    def __init__(self, file):
        """``file``: a seekable binary file."""
        self.file = file
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & WITH_CHECKSUMS else 8
        file.seek(end - 9 - count * width)
        table = file.read(count * width)
        self.frames: list[tuple[int, int, int, int | None]] = []
        at = 0
        for i in range(count):
            row = struct.unpack_from("<III" if width == 12 else "<II", table, i * width)
            self.frames.append((at, row[0], row[1], row[2] if width == 12 else None))
            at += row[0]

    def frame(self, n: int) -> bytes:
        import zstandard
        from xxhash import xxh64_intdigest

        at, packed, plain, checksum = self.frames[n]
        self.file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=max(plain, 1))
        if len(data) != plain or checksum is not None and xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {n} is damaged")
        return data


# --- Spark jobs ----------------------------------------------------------------------


def with_responses(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``page, url, payload, digest, response``: the id that a revisit refers to, else null.
    Only payloads that a Bloom filter of the shared digests lets through are shuffled."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), html.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes)
    shared = large.groupBy("digest").agg(F.max("page").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = common.materialize(shared, "warc-shared")
    member = common.bloom(shared.select(F.xxhash64("digest").alias("h")), "h", shared.count())

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(member.value.test(batch.column(4).to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], found], names=[*batch.schema.names[:4], "maybe"])

    kind = common.column_kind(rows, "page")
    tested = rows.withColumn("h", F.xxhash64("digest")).mapInArrow(test, f"page {kind}, url string, payload binary, digest string, maybe boolean")
    alone = tested.where(~F.col("maybe")).withColumn("response", F.lit(None).cast(kind))
    joined = tested.where("maybe").join(shared, "digest", "left")
    response = F.when(~F.col("response").eqNullSafe(F.col("page")), F.col("response")).alias("response")
    return alone.unionByName(joined).select("page", "url", "payload", "digest", response)


def write(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes the bundles below ``folder`` and returns the index: ``record, type, bundle,
    frame, offset, size``."""
    common.prepare(pages.sparkSession)
    rows = with_responses(pages, id_col, url_col, html_col, min_bytes)
    rows = rows.withColumns({"page": F.col("page").cast("string"), "response": F.col("response").cast("string")})
    schema = "record string, type string, bundle string, frame int, offset bigint, size bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        writer, name = None, ""
        for batch in batches:
            out = []
            pages_, urls, payloads, digests, responses = (c.to_pylist() for c in batch.columns)
            for page, url, payload, digest, response in zip(pages_, urls, payloads, digests, responses, strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{path}/{name}", compression=None), frame_bytes)
                data = record(page or "", url, payload, digest, response, date)
                frame, offset = writer.add(data)
                out.append((page, "response" if response is None else "revisit", name, frame, offset, len(data)))
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer = None
            columns = zip(*out, strict=True) if out else [[]] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        if writer is not None:
            writer.close()

    return common.materialize(rows.mapInArrow(run, schema), "warc-index")


_READ = "page string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def _row(head: dict[str, str], payload: bytes) -> tuple:
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {head['warc-record-id']} does not match its digest")
        size = len(payload)
    else:
        size = int(head["x-payload-length"])
    own = payload if head["warc-type"] == "response" else None
    return page_of(head["warc-record-id"]), head["warc-target-uri"] or None, size, digest, head["warc-type"], page_of(head.get("warc-refers-to")), own


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the indexed bundles, one bundle to a task at a time and one frame in
    memory: ``page, url, payload_bytes, payload_digest, record_type, refers_to, payload`` (null for
    revisits, or with ``payloads=False``). Every payload is checked against its digest."""
    common.prepare(index.sparkSession)
    bundles = index.select("bundle").distinct()
    n = bundles.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{path}/{name}") as f:
                    reader = BundleReader(f)
                    for i in range(len(reader.frames)):
                        data, at, rows = reader.frame(i), 0, []
                        while at < len(data):
                            head, payload, at = parse_record(data, at)
                            row = _row(head, payload)
                            rows.append(row if payloads else (*row[:-1], None))
                        yield _batch(rows)

    return bundles.repartition(max(1, n)).mapInArrow(run, _READ)


def fetch(index: DataFrame, folder: str, wanted: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The wanted records only: each task seeks to their frames. Columns as :func:`read`."""
    common.prepare(index.sparkSession)
    ids = wanted.select(F.col(f"`{id_col}`").cast("string").alias("record")).distinct()
    places = index.join(ids, "record", "left_semi").select("bundle", "frame", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        name, file, reader, frame, data = None, None, None, None, b""
        for batch in batches:
            rows = []
            for b, n, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != name:
                    if file is not None:
                        file.close()
                    file = system.open_input_file(f"{path}/{b}")
                    name, reader, frame = b, BundleReader(file), None
                if n != frame:
                    frame, data = n, reader.frame(n)
                head, payload, _ = parse_record(data, offset)
                rows.append(_row(head, payload))
            yield _batch(rows)
        if file is not None:
            file.close()

    return places.repartition("bundle").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, _READ)

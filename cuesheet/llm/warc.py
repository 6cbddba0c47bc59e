"""Operator 8: WARC archives, one gzip member a record, written and read by ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, shared_dir, table, written

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
#: Bytes of one reading task.
SPLIT = 8 << 20
#: Bytes after which a writing task begins a further archive.
ARCHIVE = 1 << 30

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit (``refers_to`` is set) holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_archives(
    pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE
) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``); gives ``path, bytes``.

    Of rows with equal payloads (SHA-1 and length) of at least ``least`` bytes, those with
    the largest ``page_id`` are responses and all others revisits of it; smaller payloads
    are all responses. Null html is an empty payload; a null id cannot be referred to, and a
    payload whose ids are all null is a response each time.

    The largest id per payload comes from a combining aggregate over narrow rows; pages meet
    it in a join that Spark may split where a payload is very frequent. A task writes files
    under names of its own; only the files of tasks that ended are listed, so that the
    leftovers of a lost executor are never read.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("html"), F.sha1(payload).alias("_sha"),
        F.octet_length(payload).cast("long").alias("_size"),
    )
    # written, as Spark can split a frequent payload only where both sides of the join come
    # straight from a shuffle
    first = written(
        rows.groupBy("_sha", "_size").agg(F.max("page_id").alias("_keep")), "payloads"
    )
    revisit = (F.col("_size") >= least) & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    joined = rows.join(first, ["_sha", "_size"]).select(
        "page_id", "url", "html", "_sha", F.when(revisit, F.col("_keep")).alias("_refers")
    )
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64())])

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        done, sink, name, size = [], None, "", 0
        for batch in source:
            plain = [batch.column(n).to_pylist() for n in ("page_id", "url", "_sha", "_refers")]
            for page_id, url, sha, refers, data in zip(*plain, blobs(batch, "html"), strict=True):
                if sink is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    # compression=None: the members are compressed here, one by one
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip_member(
                    record(page_id, url, data, base32(bytes.fromhex(sha)), refers)
                )
                sink.write(member)
                size += len(member)
                if size >= archive_bytes:
                    sink.close()
                    done.append((name, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, size))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{n}" for n, _ in done]), pa.array([s for _, s in done])],
                schema=schema,
            )

    return written(joined.mapInArrow(write, "path string, bytes long"), "archives")


class Window:
    """Bytes of a file from an offset on, read in pieces and dropped when passed."""

    def __init__(self, file, at: int) -> None:
        self.file, self.start, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        piece = self.file.read(CHUNK)
        self.data += piece
        return bool(piece)

    def drop(self, to: int) -> None:
        self.data, self.start = self.data[to - self.start :], to


def _member(window: Window, at: int) -> tuple[bytes, int] | None:
    """The record at ``at`` and where the next member begins; None if none begins there."""
    unpack, out, i = zlib.decompressobj(31), [], at - window.start
    got, begun = 0, False
    while True:
        try:
            out.append(unpack.decompress(window.data[i : i + CHUNK]))
        except zlib.error:
            return None
        i = min(i + CHUNK, len(window.data))
        got += len(out[-1])
        if not begun and got >= 7:
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            begun = True
        if unpack.eof:
            if not begun:
                return None
            return b"".join(out), window.start + i - len(unpack.unused_data)
        if i >= len(window.data) and not window.more():
            return None


def read_range(file, begin: int, end: int) -> Iterator[bytes]:
    """Records whose member begins in ``[begin, end)``; the last may reach beyond ``end``.

    Every gzip magic is a candidate. It counts if it decodes to its end (the trailing sum
    is checked) and the content begins as a WARC record; else the search goes on one byte
    further, so chance hits inside compressed data are passed over.
    """
    window, at = Window(file, begin), begin
    while at < end:
        i = window.data.find(MAGIC, at - window.start)
        if i < 0:
            at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
            window.drop(min(at, window.start + len(window.data)))
            if not window.more():
                return
            continue
        at = window.start + i
        if at >= end:
            return
        window.drop(at)
        found = _member(window, at)
        if found is None:
            at += 1
        else:
            yield found[0]
            at = found[1]
            window.drop(at)


def parse(data: bytes) -> dict:
    """Fields of a response or revisit record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]

    def page(name: str) -> int | None:
        value = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    if kind == "response":
        size, digest = len(payload), base32(hashlib.sha1(payload).digest())
    else:
        sizes = [
            line.split(b":")[1] for line in http.split(b"\r\n")
            if line.lower().startswith(b"content-length:")
        ]
        size, digest = int(sizes[0]), fields["warc-payload-digest"].removeprefix("sha1:")
    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"),
        "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }


def read_archives(archives: DataFrame, split: int = SPLIT, payload: bool = False) -> DataFrame:
    """Records of the listed archives (``path, bytes``), read by byte ranges.

    Each range of ``split`` bytes is a task's; it owns the records that begin in it. One
    record is in memory at a time. Digest and length of responses are taken anew from what
    was read; a revisit holds them in its head. ``payload`` adds the responses' content.
    """
    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ] + [("payload", pa.binary())] * payload
    schema = pa.schema(kinds)

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path, begin, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = _filesystem(path)
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    for data in read_range(file, begin, min(begin + split, size)):
                        rows.append(parse(data))
                        held += len(data)
                        if len(rows) >= 1000 or held > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))
    ranges = archives.where("bytes > 0").select("path", F.explode(starts).alias("begin"), "bytes")
    parts = max(1, ranges.count())
    ddl = (
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long" + ", payload binary" * payload
    )
    return ranges.repartition(parts, "path", "begin").mapInArrow(read, ddl)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    folder = shared_dir(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )

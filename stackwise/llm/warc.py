"""WARC archives: a writer with payload de-duplication and a splittable reader.

Writer: every record is a gzip member of its own. Of the records of one payload (SHA-1 of the
bytes) the one with the largest id is the response, the others are revisits that refer to it.
A task writes its archive under a temporary name and renames it when whole, so that a task
that is run again leaves no half file behind; the manifest names the archives that count.

Reader: archives are cut into byte ranges. A task looks in its range for gzip magic, takes a
candidate for a member only if its first bytes decode to a WARC header, and owns the records
that start inside the range, reading past its end to finish the last one. Payloads are hashed
while they are decoded and must match the digest in their header.

Defined results: null html is an empty payload; null ids come back null; null url leaves the
target out; rows that repeat the largest id of their payload are all responses, and so are
equal payloads that have only null ids; an empty table writes nothing and reads no record.
A long payload is compressed whole by its writer and hashed piece by piece by its reader; a
record may cross any number of ranges. Columns other than page_id, url and html are ignored,
whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stackwise.session import scratch, ship

MAGIC = b"\x1f\x8b\x08"
HEADER = b"WARC/1."
SPLIT_BYTES = 16 << 20
CHUNK = 1 << 20
#: The most tasks that ranges are dealt to; beyond so many ranges a task reads several.
MOST_READERS = 100_000
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ID = re.compile(rb"<urn:page:(-?\d+)>")


def _store(path: str):
    """A file system that tasks can write to, and the path in it; any URI that pyarrow knows, or a local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode("utf-8", "replace")))
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, payload (string), digest (hex) and, for revisits, refers_to and revisit = true.

    Only digests that occur more than once are joined back: one row for each, so a digest that a
    third of all pages share is a skewed join side that the engine splits.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    leaders = p.where(F.octet_length("payload") >= smallest).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("top")).where("n > 1 and top is not null").drop("n")
    out = p.join(leaders, "digest", "left")
    return out.select("page_id", "url", "payload", "digest", F.col("top").alias("refers_to"), (F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))).alias("revisit"))


def write_archives(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes ``rows`` (of with_revisits) and returns the manifest: path, bytes, records; one archive a task."""
    ship(rows.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        own = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        name = f"{top}/{own}"
        n = size = 0
        out = None
        for b in batches:
            for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns)):
                raw = record(page_id, url, payload.encode("utf-8", "surrogatepass"), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to, revisit)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                if out is None:
                    out = store.open_output_stream(f"{name}.tmp")
                out.write(z.compress(raw) + z.flush())
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            store.move(f"{name}.tmp", f"{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{own}.warc.gz"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    return rows.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, "path string, bytes long, records long")


class Member:
    """A gzip member being decoded from ``source`` (an open file) at ``at``."""

    def __init__(self, source, at: int, first: bytes = b""):
        self.source, self.at, self.read_to = source, at, at + len(first)
        self.z = zlib.decompressobj(31)
        self.data = self.z.decompress(first) if first else b""

    def more(self) -> bytes:
        if self.z.eof:
            return b""
        self.source.seek(self.read_to)
        chunk = self.source.read(CHUNK)
        if not chunk:
            raise EOFError("a record ends before its archive does")
        self.read_to += len(chunk)
        return self.z.decompress(chunk)

    @property
    def end(self) -> int:
        return self.read_to - len(self.z.unused_data)


def begins_record(window: bytes) -> bool:
    """Whether the bytes are the begin of a gzip member that holds a WARC header."""
    try:
        head = zlib.decompressobj(31).decompress(window[:512], len(HEADER))
    except zlib.error:
        return False
    return head.startswith(HEADER)


def parsed(member: Member) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; the payload is hashed piece by piece."""
    data = member.data
    while b"\r\n\r\n" not in data:
        data += member.more()
        if member.z.eof and b"\r\n\r\n" not in data:
            raise ValueError("a record without an end to its header")
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    want = int(fields[b"Content-Length"])
    while b"\r\n\r\n" not in block:
        block += member.more()
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
    left = want - len(http) - 4
    kind = fields[b"WARC-Type"].decode()
    digest = fields[b"WARC-Payload-Digest"].partition(b":")[2].decode()
    sha, got = hashlib.sha1(payload[:left]), min(left, len(payload))
    while not member.z.eof:
        piece = member.more()
        sha.update(piece[: left - got])
        got += min(len(piece), left - got)
    if got != left:
        raise ValueError("a record shorter than its Content-Length")
    if kind == "response" and (base64.b32encode(sha.digest()).decode() != digest or left != size):
        raise ValueError("a payload that does not match its digest")
    page = _ID.search(fields[b"WARC-Record-ID"])
    refers = _ID.search(fields.get(b"WARC-Refers-To", b""))
    return (int(page[1]) if page else None, size, digest, kind, int(refers[1]) if refers else None)


def read_range(source, begin: int, end: int):
    """The records that start in [begin, end)."""
    at, buffer, base = begin, b"", begin
    while at < end:
        if at < base or at + 512 > base + len(buffer):
            source.seek(at)
            buffer, base = source.read(CHUNK), at
            if not buffer:
                return
        found = buffer.find(MAGIC, at - base)
        if found < 0 or base + found >= end:
            if found >= 0 or base + len(buffer) >= end:
                return
            at = base + max(at - base + 1, len(buffer) - len(MAGIC) + 1)
            if len(buffer) < CHUNK:
                return
            continue
        at = base + found
        if at + 512 > base + len(buffer) and len(buffer) == CHUNK:
            source.seek(at)
            buffer, base = source.read(CHUNK), at
            found = 0
        if not begins_record(buffer[found : found + 512]):
            at += 1
            continue
        member = Member(source, at, buffer[found : found + 65536])
        yield parsed(member)
        at = member.end


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of all archives of the manifest (path, bytes), by byte ranges."""
    ship(manifest.sparkSession)
    splits = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("bytes") - 1), F.lit(split_bytes).cast("long"))).alias("begin"))
    # a range is a few bytes here and megabytes in its archive: only a stated number of tasks is not coalesced
    readers = max(1, min(MOST_READERS, manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0))
    splits = splits.repartition(readers)

    def run(batches):
        for b in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in b.columns)):
                store, inner = _store(path)
                with store.open_input_file(inner) as source:
                    rows = list(read_range(source, begin, min(size, begin + split_bytes)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return splits.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, smallest: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and reads the archives back."""
    spark = ship(pages.sparkSession)
    folder = scratch(spark, "warc")
    write_archives(with_revisits(pages, smallest), folder + "/archives").write.parquet(folder + "/manifest")
    manifest = spark.read.schema("path string, bytes long, records long").parquet(folder + "/manifest")
    return read_archives(manifest, split_bytes)

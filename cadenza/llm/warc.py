"""WARC archives as chunk tables: payloads pass as (record, chunk number) rows with running digests, never as whole records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, shared_dir

CHUNK_BYTES = 1 << 16
#: Bytes of payloads that a worker is handed at once, about; one larger payload comes alone.
BATCH_BYTES = 8 << 20
_BREAKS = re.compile(r"[\x00-\x1f\x7f]")
CHUNKS = "file string, record_id string, page_id long, record_type string, refers_to long, target_uri string, header_digest string, chunk_no int, chunk_bytes long, bytes_so_far long, digest_so_far string, is_last boolean, data binary"


def base32_sha1(h: hashlib._Hash) -> str:
    return base64.b32encode(h.digest()).decode()


def record_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, digest) of each row: of rows with equal payloads of ``least_bytes`` or more, the smallest page_id keeps the payload, the others refer to it.

    Digests are grouped with a map-side minimum and sent back by a join without payloads; a payload that very many pages
    hold is no single task's work. Rows that repeat the kept page_id are responses too; without any page_id all are.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.sha1(html).alias("hex"))
    seen = save(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("hex"), F.octet_length(html).alias("n")), "digests")
    first = save(seen.where(F.col("n") >= least_bytes).groupBy("hex").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("hex", "first"), "first-pages")
    out = marked.join(first, "hex", "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"), "hex")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _slices(html: memoryview) -> Iterator[memoryview]:
    for at in range(0, len(html), CHUNK_BYTES):
        yield html[at : at + CHUNK_BYTES]


def _record(page_id: int | None, url: str | None, html: memoryview, refers_to: int | None, digest: str, now: str) -> Iterator[bytes | memoryview]:
    """The bytes of a record, the payload in slices."""
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": name(page_id), "WARC-Date": now,
        "WARC-Target-URI": _BREAKS.sub(lambda m: f"%{ord(m[0]):02X}", url or ""), "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http) + (len(html) if refers_to is None else 0)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to)}
    yield b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + http
    if refers_to is None:
        yield from _slices(html)
    yield b"\r\n\r\n"


def write_warc(roles: DataFrame, path: str, level: int = 1) -> DataFrame:
    """Write record_roles() rows as ``.warc.gz`` files under ``path``, one for each task, each record a gzip member of its own.

    Returns (file, records, bytes). A task writes under a name of its own attempt and renames at its end, so a task that is
    lost or run twice leaves one whole file. Payloads are digested and compressed slice by slice from the buffer in which Spark hands
    them over, BATCH_BYTES at a time.
    """
    roles.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = _filesystem(path)
        part = TaskContext.get().partitionId()
        name, made, records = f"{root}/part-{part:05d}.warc.gz", f"{root}/.{uuid.uuid4().hex}", 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(made, compression=None) as out:
            for b in batches:
                for i in range(b.num_rows):
                    page_id, url, refers_to = (b.column(c)[i].as_py() for c in ("page_id", "url", "refers_to"))
                    html, sha, packed = memoryview(b.column("html")[i].as_buffer()), hashlib.sha1(), zlib.compressobj(level, wbits=31)
                    for piece in _slices(html):
                        sha.update(piece)
                    for piece in _record(page_id, url, html, refers_to, base32_sha1(sha), now):
                        out.write(packed.compress(piece))
                    out.write(packed.flush())
                    records += 1
        if records:
            if fs.get_file_info(name).type == pafs.FileType.NotFound:
                fs.move(made, name)
            else:  # an attempt before this one has come to its end
                fs.delete_file(made)
            size = fs.get_file_info(name).size
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}.warc.gz"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])
        else:
            fs.delete_file(made)

    return save(roles.select("page_id", "url", "html", "refers_to").mapInArrow(work, "file string, records long, bytes long"), "warc-files")


class _Stream:
    """Reads lines and counted bytes from gzip members, a block at a time; ``whole`` is false at the end of the file."""

    def __init__(self, raw: pa.NativeFile) -> None:
        self.raw, self.unzip, self.held, self.rest = raw, zlib.decompressobj(wbits=31), bytearray(), b""

    def fill(self) -> bool:
        while True:
            block = self.rest or self.raw.read(CHUNK_BYTES)
            if not block:
                got = b"" if self.unzip.eof else self.unzip.flush()
                self.held += got
                return bool(got)
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(wbits=31)
            got = self.unzip.decompress(block, CHUNK_BYTES)
            self.rest = self.unzip.unconsumed_tail or self.unzip.unused_data
            if got:
                self.held += got
                return True

    def head(self) -> bytes:
        """Up to and with an empty line; nothing at the end of the file."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                if self.held.strip():
                    raise ValueError("an archive ends within a record")
                return b""
        found = bytes(self.held[: end + 4])
        del self.held[: end + 4]
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.fill():
                raise ValueError("an archive ends within a record")
        found = bytes(self.held[:n])
        del self.held[:n]
        return found


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _chunks(file: str, raw: pa.NativeFile, data: bool) -> Iterator[tuple]:
    stream = _Stream(raw)
    while head := stream.head():
        h = _fields(head)
        left = int(h["content-length"])
        http = stream.head() if left else b""
        left -= len(http)
        sha, no, so_far = hashlib.sha1(), 0, 0
        stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
        common = (file, h.get("warc-record-id"), _page(h.get("warc-record-id")), h.get("warc-type"), _page(h.get("warc-refers-to")), h.get("warc-target-uri"), stated)
        while True:
            piece = stream.take(min(left, CHUNK_BYTES))
            left -= len(piece)
            so_far += len(piece)
            sha.update(piece)
            yield (*common, no, len(piece), so_far, base32_sha1(sha), left == 0, piece if data else None)
            no += 1
            if not left:
                break
        if common[3] == "response" and stated and stated != base32_sha1(sha):
            raise ValueError(f"the payload of {common[1]} in {file} does not have its digest")
        stream.take(4)


def read_warc(spark: SparkSession, path: str, files: DataFrame, data: bool = True) -> DataFrame:
    """The archives' chunk table: a row for each slice of a payload (one, empty, where there is none).

    Each row has the record's id, page, type and reference, its chunk number, the bytes and the base32 SHA-1 of the payload up
    to its end, so the last chunk's are those of the whole payload. ``data`` adds the bytes themselves. Files are read as
    streams, a block at a time; a payload whose digest is not the one stated fails the read.
    """
    schema = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in spark.createDataFrame([], CHUNKS).schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(path)
        for b in batches:
            for file in b.column("file").to_pylist():
                with fs.open_input_stream(f"{root}/{file}", compression=None) as raw:
                    held: list[tuple] = []
                    for row in _chunks(file, raw, data):
                        held.append(row)
                        if len(held) >= (64 if data else 4096):
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)

    # With a number of its own, adaptive execution leaves the partitions as they are: about one for each file.
    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(work, CHUNKS)


def round_trip(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC records and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Both payload columns are of the full payload; a revisit's bytes are those of the response that it refers to. Null html is
    an empty payload; a null url an empty one; rows without a page_id have records too. Repeated rows have a record each.
    An empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_warc(record_roles(pages, least_bytes), path)
    ends = save(read_warc(spark, path, files, data=False).where("is_last").drop("data"), "warc-records")
    known = ends.where("record_type = 'response'").groupBy("page_id").agg(F.max("bytes_so_far").alias("known_bytes")).withColumnRenamed("page_id", "refers_to")
    revisits = ends.where("record_type = 'revisit'")
    asked = save(known.join(revisits.select("refers_to").distinct(), "refers_to", "left_semi"), "revisited")
    back = revisits.join(asked, "refers_to").select("page_id", F.col("known_bytes").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), "record_type", "refers_to")
    return ends.where("record_type = 'response'").select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).union(back)

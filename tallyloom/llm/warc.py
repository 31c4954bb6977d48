"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``; each frame is compressed on its own, and the
bundle ends in a seek table (the public seekable Zstandard format: a skippable frame with the sizes of all
frames and a footer).  An index maps each record to its bundle, frame and offset within the decompressed
frame, so one record costs one frame.  Bundles roll over at ``BUNDLE_BYTES``.

Of records with equal payloads of at least ``min_revisit_bytes``, the one with the largest id is the
response and the others revisit it.  Which that is comes from a map-side combined maximum by digest and a
join of (id, digest) rows alone, which the adaptive skew join splits for a payload that very many records
share; the payloads themselves are shuffled once, by id.

Each attempt of a task writes bundles of its own names, and the index, which Spark commits, has the rows of the
successful attempt alone.  Readers take the bundles that the index names, so a lost, repeated or speculative
task neither loses nor repeats a record; files of failed attempts are never read.

Defined results: a null payload is written as an empty one; a null address gives no target header; a null
id is never named as a response if its group has another id; rows that repeat the response's id are all
responses; an empty table gives no bundle and an empty result; extra columns are not read; long payloads
make a frame of their own.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import broadcast_if_small, materialize, scratch_path, values
from tallyloom.session import qualified

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
SEEK_MAGIC = 0x8F92EAB1
SKIPPABLE = 0x184D2A5E
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_INDEX = "bundle string, frame int, at long, length long, record_id string, key long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer for frames of (compressed, decompressed) bytes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame of a bundle of ``size`` bytes."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * width)
    raw, at, out = f.read(n * width), 0, []
    for i in range(n):
        compressed, whole = struct.unpack_from("<II", raw, i * width)
        out.append((at, compressed, whole))
        at += compressed
    return out


def record(key, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> tuple[str, bytes]:
    """Identifier and bytes of a response, or of a revisit of the record of ``refers_to``."""
    name = record_id(key, url, payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if key is not None:
        head.append(f"X-Record-Key: {key}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Key: {refers_to}"]
    return name, "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(key, url: str | None, payload: bytes) -> str:
    """Stable identifier from id, address and payload, so that a repeated task names records alike."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{url}|{digest(payload)}')}"


def parse(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record in a decompressed frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("record is cut short")
        yield at, stop + 4 - at, head, raw[start:stop]
        at = stop + 4


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it; paths without a scheme are local, so writers qualify theirs first."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class _Writer:
    """Streams records of one task into bundles."""

    def __init__(self, folder: str, part: str, frame_bytes: int, bundle_bytes: int):
        self.fs, self.root = file_system(folder)
        self.part, self.frame_bytes, self.bundle_bytes = part, frame_bytes, bundle_bytes
        self.number, self.out, self.frames, self.size = 0, None, [], 0
        self.buffer, self.held, self.zstd = bytearray(), [], zstandard.ZstdCompressor(level=6)

    def _name(self) -> str:
        return f"part-{self.part}-{self.number:04d}.warc.zst"

    def add(self, key, name: str, raw: bytes) -> Iterator[tuple]:
        if self.buffer and len(self.buffer) + len(raw) > self.frame_bytes:
            yield from self.flush()
        self.held.append((self._name(), len(self.frames), len(self.buffer), len(raw), name, key))
        self.buffer += raw

    def flush(self) -> Iterator[tuple]:
        if not self.buffer:
            return
        if self.out is None:
            self.out = self.fs.open_output_stream(f"{self.root}/{self._name()}", compression=None)  # not by the suffix
        packed = self.zstd.compress(bytes(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.buffer)))
        self.size += len(packed)
        yield from self.held
        self.buffer, self.held = bytearray(), []
        if self.size >= self.bundle_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.number, self.out, self.frames, self.size = self.number + 1, None, [], 0


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    names = ["bundle", "frame", "at", "length", "record_id", "key"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _writing(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        writer = _Writer(folder, f"{task.partitionId():05d}-{task.taskAttemptId()}", frame_bytes, bundle_bytes)
        for batch in batches:
            rows: list[tuple] = []
            for key, url, html, refers in values(*batch.columns):
                payload = (html or "").encode("utf-8", "surrogatepass")
                rows += writer.add(key, *record(key, url, payload, refers))
            yield _index_batch(rows)
        rows = list(writer.flush())
        writer.close()
        yield _index_batch(rows)

    return run


def revisited(records: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``records(key, url, payload)`` with ``refers_to``: the response's key for revisits, else null."""
    hashed = records.select("key", F.coalesce("payload", F.lit("")).alias("p"))
    hashed = hashed.select("key", F.sha1(F.encode("p", "utf-8")).alias("d"), F.octet_length("p").alias("n"))
    hashed = hashed.where(F.col("n") >= min_revisit_bytes)
    many = hashed.groupBy("d").agg(F.max("key").alias("response"), F.count("*").alias("c")).where("c > 1").drop("c")
    many = materialize(many, "payloads")  # as a table of its own, so that the join of a frequent payload can be split
    later = hashed.join(many, "d").where(~F.col("key").eqNullSafe(F.col("response")) & F.col("response").isNotNull())
    later = materialize(later.select(F.col("key").alias("k"), F.col("d").alias("kd"), F.col("response").alias("refers_to")).distinct(), "revisits")
    named = records.withColumn("kd0", F.sha1(F.encode(F.coalesce("payload", F.lit("")), "utf-8")))
    # the digest tells rows with one id and several payloads apart
    return named.join(later, named["key"].eqNullSafe(later["k"]) & (named["kd0"] == later["kd"]), "left").select("key", "url", "payload", "refers_to")


def write_bundles(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Writes a record per row to bundles in ``folder`` and returns the written index.

    A folder without a scheme is in the store that Spark takes for it, as the index is.
    """
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload"))
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    index = revisited(rows, min_revisit_bytes).mapInArrow(_writing(folder, frame_bytes, bundle_bytes), _INDEX)
    path = f"{folder}/index"
    index.write.parquet(path)
    return pages.sparkSession.read.schema(_INDEX).parquet(path)


def _frames_of(content: bytes) -> Iterator[bytes]:
    f, zstd = io.BytesIO(content), zstandard.ZstdDecompressor()
    for at, packed, whole in read_seek_table(f, len(content)):
        yield zstd.decompress(content[at : at + packed], max_output_size=whole)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    for batch in batches:
        for (content,) in values(batch.column(0), size=1):
            for frame in _frames_of(content):
                rows = []
                for _, _, head, block in parse(frame):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                    named = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != named):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
                    key, refers = head.get("X-Record-Key"), head.get("X-Refers-To-Key")
                    rows.append((key and int(key), size, named, head["WARC-Type"], refers and int(refers), head.get("WARC-Target-URI")))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, payload_bytes, payload_digest, record_type, refers_to, url)`` of every record.

    The bundles that the index names are read whole by Spark's own reader; each response's payload is checked
    against its digest.
    """
    named = spark.read.schema(_INDEX).parquet(f"{folder}/index").select("bundle").distinct()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("bundle", F.substring_index("path", "/", -1))
    files = files.join(broadcast_if_small(named), "bundle", "left_semi").select("content")
    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return files.mapInArrow(_read, schema)


def fetch(folder: str, bundle: str, frame: int, at: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, by its index row: reads the seek table and one frame.

    Needs no session, so a folder without a scheme is on the local disk; ``session.qualified`` names others.
    """
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{bundle}") as f:
        start, packed, whole = read_seek_table(f, f.size())[frame]
        f.seek(start)
        raw = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=whole)
    _, _, head, block = next(parse(raw[at : at + length]))
    return head, block


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes bundles to the shared folder and reads them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_bundles(pages, folder, **options)
    return read_bundles(pages.sparkSession, folder)

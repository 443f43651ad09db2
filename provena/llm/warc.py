"""WARC archives compressed with Zstandard and a dictionary.

An archive starts with a skippable frame that holds the dictionary; every record follows as a frame of its own, compressed
with it. The reader takes the dictionary from that frame, decodes one frame per record and checks version line, headers,
lengths, digests and the closing line breaks. Every attempt of a task writes archives of names of its own, and the names of those that
count are rows of a table, which Spark commits once a task. Readers go by this table: what an attempt that was lost, or
repeated, has left in the folder is never read.

Of records with equal payloads (SHA-1 and length) of at least ``MIN_REVISIT`` bytes the one with the largest page_id
is a response; the others are revisits with the HTTP head alone.

Cases. Null html: an empty payload. Null url: no target, the page's record id instead. Null page_id: below every other;
its record has no id number and comes back as null. Repeated rows of the largest page_id are all responses. Very long
payloads are one record. An empty table gives no archives and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.text import unit_hash
from provena.runtime import materialize, scratch_path, ship_package, shuffle_width

MIN_REVISIT = 1000
DICTIONARY_MAGIC = 0x184D2A5D  # fixed by the format
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DATE = "2000-01-01T00:00:00Z"
DICTIONARY_ROWS, DICTIONARY_BYTES, SAMPLE_BYTES = 256, 32 << 10, 64 << 10
ARCHIVE_BYTES = 8 << 20


class WarcError(ValueError):
    """An archive or record that is not well formed."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


# --- records --------------------------------------------------------------------------------------------------------


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{page_urn(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url) if url else page_urn(page_id)}",
        f"WARC-Payload-Digest: {sha1_label(digest)}",
        f"WARC-Block-Digest: {sha1_label(hashlib.sha1(block).digest())}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{page_urn(refers_to)}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{what}: header line without a name: {line[:60]!r}")
        key = name.decode("ascii", "replace").lower()
        if key in out and key in ("content-length", "warc-type", "warc-record-id"):
            raise WarcError(f"{what}: header {key} repeats")
        out[key] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(data: bytes) -> Record:
    """The record in one frame's bytes, checked."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of headers")
    first, _, rest = data[:end].partition(b"\r\n")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"not a WARC version line: {first[:40]!r}")
    headers = _headers(rest, "record")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    block, tail = data[end + 4 : end + 4 + n], data[end + 4 + n :]
    if len(block) != n or tail != b"\r\n\r\n":
        raise WarcError(f"the frame does not hold {n} bytes of content and two line breaks")
    digest = headers.get("warc-block-digest")
    if digest and digest.startswith("sha1:") and digest != sha1_label(hashlib.sha1(block).digest()):
        raise WarcError("block digest differs")
    return Record(headers, block)


def http_payload(record: Record) -> tuple[dict[str, str], bytes]:
    """HTTP headers and body of a response or revisit block, with the body's length checked."""
    head, sep, body = record.block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP message")
    headers = _headers(head.partition(b"\r\n")[2], "HTTP")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise WarcError("HTTP Content-Length is no number")
    if record.headers["warc-type"] == "response":
        if int(length) != len(body):
            raise WarcError("HTTP body has another length")
        digest = record.headers.get("warc-payload-digest")
        if digest and digest != sha1_label(hashlib.sha1(body).digest()):
            raise WarcError("payload digest differs")
    elif body:
        raise WarcError("a revisit carries no body")
    return headers, body


# --- archives -------------------------------------------------------------------------------------------------------


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; empty where they are too few or too short."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    def __init__(self, dictionary: bytes, level: int = 3):
        import zstandard

        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._zstd = zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=True)
        self._start = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        self.parts = [self._start]
        self.size = len(self._start)

    def add(self, record: bytes) -> None:
        frame = self._zstd.compress(record)
        self.parts.append(frame)
        self.size += len(frame)


def read_archive(data: bytes) -> Iterator[Record]:
    """Records of an archive, one frame each."""
    import zstandard

    view = memoryview(data)
    held = None
    at = 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        if 8 + n > len(data):
            raise WarcError("the dictionary's frame is cut off")
        dictionary = bytes(view[8 : 8 + n])
        if dictionary[:4] == FRAME_MAGIC:  # the format lets the dictionary itself be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        at = 8 + n
    zstd = zstandard.ZstdDecompressor(dict_data=held)
    while at < len(data):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            if at + 8 <= len(data) and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
                continue
            raise WarcError(f"no frame at byte {at}")
        frame = zstd.decompressobj()
        try:
            record = frame.decompress(view[at:])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        if not frame.eof:
            raise WarcError(f"frame at byte {at} is cut off")
        at = len(data) - len(frame.unused_data)
        yield parse_record(record)


# --- tables ---------------------------------------------------------------------------------------------------------


def plan_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to`` of every page; ``refers_to`` is null for responses."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    groups = rows.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last")).filter("n > 1")
    # written and read again, so that the join deals both sides itself and can split a group of copies
    groups = materialize(groups.select(F.col("digest").alias("_d"), F.col("bytes").alias("_b"), "last"), "warc-groups")
    joined = rows.join(groups, (F.col("digest") == F.col("_d")) & (F.col("bytes") == F.col("_b")), "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``.warc.zst`` files below ``path`` (a folder all machines share); returns ``archive, records, bytes`` as written."""
    spark = pages.sparkSession
    ship_package(spark)
    # about DICTIONARY_ROWS pages by a hash, each of at most SAMPLE_BYTES: what comes to the driver is bounded
    short = F.octet_length(F.coalesce("html", F.lit(""))) <= SAMPLE_BYTES
    share = min(1.0, DICTIONARY_ROWS / max(pages.count(), 1))
    chosen = pages.filter(short & (unit_hash(F.coalesce(F.col("page_id"), F.lit(-1)), seed=2) < share))
    sample = chosen.select("page_id", "url", "html").limit(4 * DICTIONARY_ROWS).collect()
    records = []
    for r in sample:
        payload = (r["html"] or "").encode("utf-8", "surrogatepass")
        records.append(build_record(r["page_id"], r["url"], payload, hashlib.sha1(payload).digest(), None))
    shared = spark.sparkContext.broadcast(train_dictionary(records))  # at most DICTIONARY_BYTES
    planned = plan_revisits(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        attempt = uuid.uuid4().hex
        done: list[tuple[str, int, int]] = []
        current: ArchiveWriter | None = None

        def close(w: ArchiveWriter) -> None:
            name = f"part-{task.partitionId():06d}-{attempt}-{len(done):05d}.warc.zst"
            with store.open_output_stream(f"{folder}/{name}", compression=None) as f:
                for part in w.parts:
                    f.write(part)
            done.append((name, len(w.parts) - 1, w.size))

        for batch in batches:
            ids, urls, html, digests, refers = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                payload = (html[i].as_py() or "").encode("utf-8", "surrogatepass")
                current = current or ArchiveWriter(shared.value)
                current.add(build_record(ids[i].as_py(), urls[i].as_py(), payload, bytes.fromhex(digests[i].as_py()), refers[i].as_py()))
                if current.size >= archive_bytes:
                    close(current)
                    current = None
        if current is not None:
            close(current)
        yield pa.record_batch(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            ["archive", "records", "bytes"],
        )

    return materialize(planned.mapInArrow(write, "archive string, records bigint, bytes bigint"), "warc-written")


_FIELDS = {
    "page_id": ("bigint", pa.int64()),
    "target": ("string", pa.string()),
    "payload_bytes": ("bigint", pa.int64()),
    "payload_digest": ("string", pa.string()),
    "record_type": ("string", pa.string()),
    "refers_to": ("bigint", pa.int64()),
    "payload": ("binary", pa.binary()),
}


def _page_of(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def _record_rows(content, with_payload: bool) -> pa.RecordBatch:
    """Responses and revisits of one archive's bytes."""
    names = [n for n in _FIELDS if with_payload or n != "payload"]
    out: dict[str, list] = {n: [] for n in _FIELDS}
    for record in read_archive(content):
        kind = record.headers["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, body = http_payload(record)
        label = record.headers.get("warc-payload-digest", "")
        out["page_id"].append(_page_of(record.headers["warc-record-id"]))
        out["target"].append(record.headers.get("warc-target-uri"))
        out["payload_bytes"].append(int(http["content-length"]))
        out["payload_digest"].append(base64.b32decode(label[5:]).hex() if label.startswith("sha1:") else None)
        out["record_type"].append(kind)
        out["refers_to"].append(_page_of(record.headers.get("warc-refers-to")))
        out["payload"].append(body if with_payload else None)
    return pa.RecordBatch.from_arrays([pa.array(out[n], _FIELDS[n][1]) for n in names], names=names)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False, archives: DataFrame | None = None) -> DataFrame:
    """``page_id, target, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``) of archives below ``path``.

    ``archives``: a table of their names, as ``write_archives`` returns it; others are not read. Without it all ``*.warc.zst`` files
    of the folder are, whoever wrote them. One row a record; a file that is not well formed is an error.
    """
    ship_package(spark)
    schema = ", ".join(f"{n} {kind}" for n, (kind, _) in _FIELDS.items() if with_payload or n != "payload")
    if archives is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    else:
        width = max(1, min(shuffle_width(spark), archives.count()))
        files = archives.select("archive").repartition(width, F.xxhash64("archive"))

    def read_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    yield _record_rows(f.read(), with_payload)

    def read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield _record_rows(content.as_buffer(), with_payload)

    return files.mapInArrow(read_whole if archives is None else read_named, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page, read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    written = write_archives(pages, path)
    return read_archives(spark, path, archives=written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives in Zstandard: one frame per record behind a dictionary frame."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import narrow
from .store import cut, uri

# Fixed values of the formats.
ZSTD_MAGIC, SKIPPABLE, DICT_MAGIC = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
EMPTY_BLOCK = "application/http; msgtype=response"
#: Payloads of fewer bytes are always stored in full.
REVISIT_BYTES = 1000
#: Payload bytes after which a new archive begins; what one task holds at a time.
ARCHIVE_BYTES = 8 << 20
#: The dictionary of an archive is trained on at most so many of its own records, and has at most so many bytes.
DICT_RECORDS, DICT_BYTES = 256, 16 << 10
FEED = 64 << 10
#: So many digests of repeated payloads are broadcast.
BROADCAST_DIGESTS = 200_000


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP header fields, and what follows them: the payload, if the record has it."""
        head, gap, payload = self.block.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"HTTP/"):
            raise ValueError("the block is no HTTP message")
        return fields(head.split(b"\r\n")[1:]), payload


def fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        out[name.strip().decode("utf-8").lower()] = value.strip().decode("utf-8")
    return out


def serialise(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> Record:
    """The one record of a frame; raises ValueError unless version, headers, length and trailer are right."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version not in VERSIONS:
        raise ValueError("no WARC header")
    headers = fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"{name} is missing")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"content-length {length} doesn't fit a frame with {len(rest)} bytes after the header")
    record = Record(headers, rest[:-4])
    if headers["warc-type"] in ("response", "revisit"):
        http, payload = record.http()
        if headers["warc-type"] == "response":
            if http.get("content-length", str(len(payload))) != str(len(payload)):
                raise ValueError("the payload's length differs from its HTTP header")
            if "warc-payload-digest" in headers and headers["warc-payload-digest"] != "sha1:" + hashlib.sha1(payload).hexdigest():
                raise ValueError("the payload's digest differs")
        elif payload or "warc-refers-to" not in headers:
            raise ValueError("a revisit has no payload of its own and names its response")
    return record


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the response `refers_to`, whose HTTP header still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = f"page:{page_id}" if page_id is not None else "uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"{url}#{digest}"))
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    headers += [("Content-Type", EMPTY_BLOCK), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return serialise(headers, http + (payload if refers_to is None else b""))


def write_archive(records: list[bytes], dict_bytes: int = DICT_BYTES) -> bytes:
    """A dictionary frame, if the records are enough to train one, then a frame for each record."""
    dictionary, out = None, []
    some = [r for r in records[:: max(1, len(records) // DICT_RECORDS)] if len(r) <= FEED]
    if len(some) >= 16:
        try:
            dictionary = zstandard.train_dictionary(dict_bytes, some, level=3)
        except zstandard.ZstdError:  # too few or too similar records
            dictionary = None
    if dictionary is not None:
        content = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", DICT_MAGIC, len(content)) + content)
    packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join(out + [packer.compress(r) for r in records])


def frames(data: bytes) -> Iterator[bytes]:
    """What each frame of an archive holds, with the dictionary of its leading skippable frame, plain or compressed."""
    view, at, dictionary = memoryview(data), 0, None
    while at + 8 <= len(view) and (magic := struct.unpack_from("<I", view, at)[0]) in SKIPPABLE:
        size = struct.unpack_from("<I", view, at + 4)[0]
        if at + 8 + size > len(view):
            raise ValueError("a skippable frame is cut short")
        if at == 0 and magic == DICT_MAGIC:
            content = bytes(view[8 : 8 + size])
            try:
                if content[:4] == struct.pack("<I", ZSTD_MAGIC):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            except zstandard.ZstdError as error:
                raise ValueError(f"bad dictionary: {error}") from error
        at += 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at >= 8 and struct.unpack_from("<I", view, at)[0] in SKIPPABLE:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the last frame is cut short")
            piece = view[at : at + FEED]
            try:
                parts.append(frame.decompress(piece))
            except zstandard.ZstdError as error:
                raise ValueError(f"bad frame: {error}") from error
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def read_archive(data: bytes) -> Iterator[Record]:
    for frame in frames(data):
        yield parse(frame)


ARCHIVES = pa.schema([("archive", pa.string()), ("bytes", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def info_record(name: str) -> bytes:
    """What an archive says of itself."""
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return serialise(headers, b"format: WARC File Format 1.1\r\n")


def _write(folder: str) -> Callable:
    """Archives as files of the shared folder, by any store that pyarrow knows; a row tells of each.

    A file gets its name when it is complete; one that a lost task leaves behind is in no row and so is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def flush(held: list[bytes]) -> pa.RecordBatch:
            name = f"{hashlib.sha1(b''.join(held)).hexdigest()}-{uuid.uuid4().hex}.warc.zst"
            content = write_archive([info_record(name), *held])
            with store.open_output_stream(f"{root}/{name}.part", compression=None) as out:
                out.write(content)
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.record_batch([[f"{folder}/{name}"], [len(content)]], schema=ARCHIVES)

        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                for x in batch.slice(a, 64).to_pylist():
                    held.append(page_record(x["page_id"], x["url"], x["html"].encode(), x["digest"], x["refers_to"]))
                    size += len(x["html"])
                    if size >= ARCHIVE_BYTES:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


def _number(urn: str) -> int | None:
    return int(urn[10:-1]) if urn.startswith("<urn:page:") else None


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("archive").to_pylist():
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_stream(at, compression=None) as source:
                content = source.read()
            rows = []
            for r in read_archive(content):
                h = r.headers
                if h["warc-type"] not in ("response", "revisit"):
                    continue
                http, _ = r.http()
                rows.append({"page_id": _number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": int(http["content-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "record_type": h["warc-type"], "refers_to": _number(h.get("warc-refers-to", ""))})
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=RECORDS)


def archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) -> archive, bytes: the Zstandard WARC files written below `path`, of about ARCHIVE_BYTES of payload.

    Of pages with equal payloads of at least `revisit_bytes` bytes the one with the largest page_id is the response and
    the others revisit it; rows that repeat this page_id are responses too, rows without page_id are revisits, and where
    no row has a page_id all are responses.  A null html is an empty payload, and however long one is, it is one record.  An empty
    table writes no archive; other columns aren't read.  Payloads meet by digest: one pre-aggregated row for each digest that
    repeats, broadcast if there are few (which is counted), else joined with AQE's split of skewed keys; smaller pages don't
    take part."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = narrow(pages, "page_id", "url", "html").select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"))
    large = F.octet_length("html") >= revisit_bytes
    reps = own.filter(large).groupBy(F.col("digest").alias("_d")).agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    reps = cut(reps.filter((F.col("_n") > 1) & F.col("_top").isNotNull()).drop("_n"))
    hint = F.broadcast if reps.count() <= BROADCAST_DIGESTS else (lambda x: x)
    out = own.filter(large).join(hint(reps), F.col("digest") == F.col("_d"), "left").drop("_d").unionByName(own.filter(~large).withColumn("_top", F.lit(None).cast(reps.schema["_top"].dataType)))
    refers = F.when(F.col("_top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_top"))), F.col("_top"))
    out = out.select("page_id", "url", "html", "digest", refers.cast("long").alias("refers_to"))
    return cut(out.mapInArrow(_write(path), "archive string, bytes long"))  # so that no archive is written twice


def read(archives: DataFrame) -> DataFrame:
    """archive (a path in each row) -> page_id, url, payload_bytes, payload_digest, record_type, refers_to of
    every page record.  A broken archive raises ValueError."""
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = archives.select("archive").repartition(tasks)
    return paths.mapInArrow(_unpack, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read(archive(pages, f"{uri(spark)}/warc-{uuid.uuid4().hex}"))

"""WARC archives of web pages, compressed record by record with a dictionary of their own.

A file begins with a skippable frame (0x184D2A5D) that holds its Zstandard dictionary, built from
the first records of the file; every record follows as one frame, so a reader can start at any
of them.  Pages with a payload archived elsewhere become revisit records.
"""

import base64
import hashlib
import io
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.common import checkpointed, shared_folder, text_or_empty
from memspark.session import broadcast_if

_MAGIC = 0x184D2A5D  # of the frame that holds a dictionary, as the format says
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_TRAINING_BYTES, _DICTIONARY_BYTES, _LEVEL = 2 << 20, 64 << 10, 6


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page}/{row}')}>"


def record(page, row, url, payload: bytes, first=None, first_row=None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit of the page ``first`` when ``first_row`` is given."""
    revisit = first_row is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, row)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    if page is not None:
        head.append(f"Page-Id: {page}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(first, first_row)}"]
        head += [f"Refers-To-Page-Id: {first}"] if first is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """Writes records to numbered files of about ``file_bytes`` before compression."""

    def __init__(self, folder: str, file_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.file_bytes, self.waiting, self.size, self.out, self.files = file_bytes, [], 0, None, []
        self.fs.create_dir(self.folder, recursive=True)

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if self.out is None:
            self.waiting.append(data)
            if self.size >= _TRAINING_BYTES:
                self._open()
        else:
            self.out.write(self.zip.compress(data))
        if self.size >= self.file_bytes:
            self.close()

    def _open(self) -> None:
        try:
            book = zstd.train_dictionary(_DICTIONARY_BYTES, [w[:16384] for w in self.waiting], level=_LEVEL)
        except zstd.ZstdError:  # too few records to train on: the records themselves
            book = zstd.ZstdCompressionDict((b"".join(self.waiting)[-_DICTIONARY_BYTES:]).ljust(8, b"\0"), dict_type=zstd.DICT_TYPE_RAWCONTENT)
        self.zip = zstd.ZstdCompressor(level=_LEVEL, dict_data=book, write_checksum=True)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.fs.open_output_stream(f"{self.folder}/{name}", compression=None)
        content = book.as_bytes()
        self.out.write(struct.pack("<II", _MAGIC, len(content)) + content)
        self.files.append([name, 0])
        for w in self.waiting:
            self.out.write(self.zip.compress(w))
        self.waiting = []

    def close(self) -> None:
        if self.out is None and self.waiting:
            self._open()
        if self.out is not None:
            self.out.close()
            self.files[-1][1] = self.size
        self.out, self.size = None, 0


def read_records(data: bytes):
    """(headers, payload) of every record of a file; header names in lower case."""
    magic, size = struct.unpack("<II", data[:8])
    if magic != _MAGIC:
        raise ValueError("the file does not begin with a dictionary")
    content = data[8 : 8 + size]
    kind = zstd.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstd.DICT_TYPE_RAWCONTENT
    stream = io.BufferedReader(zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=kind)).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        head |= {f"http-{n.lower()}": v.strip() for n, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where it should")
        yield head, payload


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Archive every row below ``folder``; returns the manifest (file, bytes before compression).

    Of records with equal payloads of ``min_bytes`` or more, that with the smallest key is the
    response (null keys last; of repeated rows the first read), the others revisit it.  A null payload is
    empty, a null url is left out of the record.  Tasks write files of their own under fresh names; only
    those in the manifest, which is a checkpoint, belong to the archive, so a lost or repeated task does no harm.
    """
    body = text_or_empty(html)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    long = F.octet_length("html") >= min_bytes
    # Payloads too short to be merged get a name of their own.
    rows = rows.withColumn("digest", F.when(long, F.col("digest")).otherwise(F.concat(F.lit("row "), F.col("row").cast("string"))))
    best = F.min(F.struct(F.col("key").isNull().alias("unknown"), "key", "row")).alias("best")
    first = rows.select("digest", "key", "row").groupBy("digest").agg(best)
    rows = rows.join(first, "digest").select("row", "key", "url", "html", F.col("best.key").alias("first"), F.col("best.row").alias("first_row"))

    def write(batches):
        writer = Writer(folder, file_bytes)
        for batch in batches:
            for x in batch.to_pylist():
                own = x["row"] == x["first_row"]
                writer.add(record(x["key"], x["row"], x["url"], x["html"].encode(), *(() if own else (x["first"], x["first_row"]))))
        writer.close()
        yield pa.RecordBatch.from_pylist([{"file": n, "bytes": b} for n, b in writer.files], schema=pa.schema([("file", pa.string()), ("bytes", pa.int64())]))

    return checkpointed(rows.mapInArrow(write, "file string, bytes long"))


def read_archive(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``page_id`` (text), ``url``, ``record_type``, ``payload`` (null for revisits), ``payload_bytes``, ``payload_digest``, ``refers_to`` (text) of every record."""
    schema = "page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"

    def parse(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for head, payload in read_records(data.as_py()):
                    own = head["warc-type"] == "response"
                    rows.append(
                        (head.get("page-id"), head.get("warc-target-uri"), head["warc-type"], payload if own else None, len(payload) if own else int(head["http-content-length"]),
                         payload_digest(payload) if own else head["warc-payload-digest"].partition(":")[2], head.get("refers-to-page-id"))
                    )
                    size += len(payload)
                    if size > 4 << 20 or len(rows) == 4096:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    # The contents stay where they are read: the list of files goes to them, up to a million of them.
    return files.join(broadcast_if(manifest.select("file"), 1_000_000), "file", "left_semi").select("content").mapInArrow(parse, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()))
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write an archive and read it back (see ``write_archive`` and ``read_archive``).  An empty table gives an empty result."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    manifest = write_archive(pages, folder, **options)
    return read_archive(spark, folder, manifest)

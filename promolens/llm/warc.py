"""WARC archives with a Zstandard dictionary, one record per page.

Each task writes its pages to archives of bounded size. The first records of an archive train its
dictionary, which goes into a leading skippable frame (magic 0x184D2A5D, as in the public WARC
dictionary draft); each record is then a frame of its own, so that it can be read alone. Of
pages with equal payloads one is a response and the others are revisit records that name it.

Archives are written under a temporary name and renamed, and a task's table of archives is what
Spark commits, so a lost or repeated attempt leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import fresh_path, open_fs, save, ship_by_value, slices, table, text_or_empty

ship_by_value(__name__)

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # of the records that train an archive's dictionary
ARCHIVE_BYTES = 256 << 20  # of records in an archive
LEVEL = 3
CHUNK = 1 << 14  # bytes read at once; what a record leaves of them is copied, so they are few
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit record, which has the payload's headers only."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _name(refers_to)),
            ("X-Payload-Length", str(len(payload))),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the records, or where they are too few or alike to train on, their text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Archives of one task."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = open_fs(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.done: list[tuple[str, int]] = []
        self._start()

    def _start(self) -> None:
        self.held, self.held_bytes, self.out, self.count, self.size = [], 0, None, 0, 0

    def add(self, data: bytes) -> None:
        self.count += 1
        self.size += len(data)
        if self.out is None:
            self.held.append(data)
            self.held_bytes += len(data)
            if self.held_bytes >= SAMPLE_BYTES:
                self._open()
        else:
            self.out.write(self.pack.compress(data))
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _open(self) -> None:
        words = dictionary(self.held)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
        self.temp = f"{self.path}/.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        frame = words.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        for data in self.held:
            self.out.write(self.pack.compress(data))
        self.held = []

    def close(self) -> None:
        if not self.count:
            return
        if self.out is None:
            self._open()
        self.out.close()
        name = f"{self.path}/{uuid.uuid4().hex}.warc.zst"
        self.fs.move(self.temp, name)
        self.done.append((name, self.count))
        self._start()


def read_archive(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, one frame in memory at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    frame = bytes(stream.read(size))
    trained = frame[:4] == b"\x37\xa4\x30\xec"
    words = zstandard.ZstdCompressionDict(frame, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    unpack = zstandard.ZstdDecompressor(dict_data=words)
    rest = b""
    one = None
    parts: list[bytes] = []
    while data := rest or bytes(stream.read(CHUNK)):
        one = one or unpack.decompressobj()
        parts.append(one.decompress(data))
        rest = b""
        if one.eof:
            rest, one = one.unused_data, None
            yield parse_record(b"".join(parts))
            parts = []
    if one:
        raise ValueError("the archive ends within a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def with_response(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages with __refers_to: null for responses, else the page_id of the response with the same payload.

    Only ids and digests are grouped, and only digests that several rows share are joined. While these
    are few Spark broadcasts them and no payload is shuffled; else the payloads meet them by digest, and
    a payload that many pages share makes a skewed join, which Spark splits.
    """
    html = text_or_empty("html").cast("binary")
    keyed = pages.withColumn("__digest", F.sha1(html))
    firsts = keyed.filter(F.octet_length(html) >= min_bytes).groupBy("__digest").agg(F.max("page_id").alias("__first"), F.count("*").alias("__n"))
    firsts = save(firsts.filter("__n > 1").drop("__n"), "payloads")
    joined = keyed.join(firsts, "__digest", "left").drop("__digest")
    return joined.withColumn(
        "__refers_to", F.when(F.col("page_id") != F.col("__first"), F.col("__first"))
    ).drop("__first")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives; a table (path, records) of them, fixed by Spark's commit.

    Null html is an empty payload; a null url is empty. Rows without page_id are responses, and so
    are rows that repeat the id of their payload's response; each repeated row is a record. Columns
    other than page_id, url and html are left out. An empty table writes no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder)
        for batch in slices(batches):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer.add(record(page_id, url, html, refers_to))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in writer.done], pa.string()), pa.array([n for _, n in writer.done], pa.int64())], ["path", "records"])

    rows = with_response(pages, min_bytes).select("page_id", F.col("url").cast("string"), text_or_empty("html").cast("binary").alias("html"), "__refers_to")
    return save(rows.mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives, from their fields and blocks; responses are verified. As many
    tasks as archives; no archives give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        number = lambda s: None if s is None or s == _name(None) else int(s[len("<urn:page:") : -1])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for fields, block in read_archive(stream):
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                        if kind == "response" and payload_digest(payload) != digest:
                            raise ValueError(f"{path}: a payload doesn't match its digest")
                        size = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                        rows.append((number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To"))))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = archives.repartitionByRange(max(archives.count(), 1), "path")
    return spread.mapInArrow(run, SCHEMA)


def op10_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    return read_archives(write_archives(table(spark, sf_dir, "pages"), folder), folder)


#: Base32 of the digest: each five bits of its 160, from its hex digits.
OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, max(page_id) AS response FROM p GROUP BY d
), coded AS (
  SELECT d, response, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(d || '0', ((i * 5) // 4 + 1)::BIGINT, 2))::INT)
      >> (3 - (i * 5) % 4)::INT) & 31)::BIGINT + 1, 1)), '') AS b32 FROM f
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, b32 AS payload_digest,
       CASE WHEN page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN coded USING (d)
"""

"""WARC archives: a Spark data source that writes gzipped records and reads them by byte ranges.

``spark.read.format("warc")`` plans (file, start, end) ranges of ``split_bytes``. A
task looks for gzip's magic bytes in its range, takes a hit for a record when what
follows decodes to a WARC header block, and owns the records that start inside the
range, wherever they end; from a record's end it goes on, so compressed bytes of a
record it has read are never searched. Only the range's first hits can lie inside a
record of the range before, and those do not decode. One record is in memory at a
time, whatever the file's size.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from roadgrain.llm.shared import shared_folder, stored

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, of one read, and of an archive after which a task opens the next.
SPLIT_BYTES, READ_BYTES, FILE_BYTES = 16 << 20, 256 << 10, 1 << 30
#: Payloads with fewer bytes are always stored again.
LEAST_BYTES = 100
#: A header block longer than this is not taken for one.
HEADER_BYTES = 1 << 16
#: A payload is common when it makes up this share of all rows.
COMMON = 1000
DATE = "2024-01-01T00:00:00Z"
# fixed values: names of the WARC 1.1 standard
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "record_id string, record_type string, target_uri string, record_date string, payload_digest string, refers_to_id string, page_id long, refers_to long, payload_bytes long, payload binary"
PLACED = RECORDS + ", file string, offset long"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, without a time, so that equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_bytes(row: dict) -> bytes:
    """A whole WARC record from a row of RECORDS. A revisit holds only the HTTP header."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row["record_date"]), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("WARC-Refers-To", f"<{row['refers_to_id']}>" if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("X-Page-ID", row["page_id"]), ("X-Refers-To-Page-ID", row["refers_to"]), ("X-Payload-Length", row["payload_bytes"]),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
    ]
    # a line break or a control character in a value would end its field
    head = [VERSION] + [f"{k}: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', str(v))}".encode() for k, v in fields if v is not None]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The row of RECORDS of a whole decoded record. The payload is what follows the HTTP
    header; its digest and length are taken anew, and a revisit's from its fields."""
    head, found, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    length = int(fields.get("content-length", "-1"))
    if not found or length < 0 or len(rest) < length:
        raise ValueError("a record ends before its content does")
    block, kind = rest[:length], fields.get("warc-type")
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d+", fields.get(k, "")) else None
    link = lambda k: fields[k].strip("<>") if k in fields else None
    full = kind != "revisit"
    digest = hashlib.sha256(block).hexdigest() if full else fields.get("warc-payload-digest", "").rpartition(":")[2] or None
    return {
        "record_id": link("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "record_date": fields.get("warc-date"), "payload_digest": digest, "refers_to_id": link("warc-refers-to"),
        "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"), "payload_bytes": len(block) if full else number("x-payload-length"), "payload": block if full else None,
    }


class RangeScan:
    """The records of a file that start in [start, end)."""

    def __init__(self, file, start: int, end: int, read_bytes: int = READ_BYTES):
        self.file, self.start, self.end, self.read_bytes = file, start, end, read_bytes
        self.size = file.size()
        self.buffer, self.base = b"", start  # the bytes from base on

    def _from(self, pos: int, least: int) -> memoryview:
        """What is held of the bytes from pos on: ``least`` or more, or all up to the file's end."""
        if pos < self.base or pos + least > self.base + len(self.buffer):
            self.file.seek(pos)
            self.buffer, self.base = self.file.read(max(least, self.read_bytes)), pos
        return memoryview(self.buffer)[pos - self.base :]

    def next_magic(self, pos: int) -> int:
        """Where the next magic bytes stand from pos on, or -1 if not before the end of the range."""
        while pos < min(self.end, self.size):
            part = self._from(pos, len(MAGIC))
            hit = self.buffer.find(MAGIC, pos - self.base)
            if hit >= 0:
                return self.base + hit if self.base + hit < self.end else -1
            pos += max(1, len(part) - len(MAGIC) + 1)
        return -1

    def decoded(self, pos: int) -> tuple[bytes, int] | None:
        """The record whose member starts at pos, and where the member ends; None if no header
        of a record is found there. A member with a header that is damaged later raises."""
        unpack, parts, held, header = zlib.decompressobj(31), [], 0, False
        at = pos
        while not unpack.eof:
            part = self._from(at, 1)[: 4096 if at == pos else self.read_bytes]
            if not len(part):
                if header:
                    raise ValueError(f"the file ends inside the record at byte {pos}")
                return None
            try:
                out = unpack.decompress(part)
            except zlib.error as e:
                if header:
                    raise ValueError(f"the record at byte {pos} is damaged: {e}") from e
                return None
            parts.append(out)
            held, at = held + len(out), at + len(part)
            if not header:
                seen = b"".join(parts)
                parts = [seen]
                if not seen.startswith(b"WARC/1."[: len(seen)]):
                    return None
                header = b"\r\n\r\n" in seen
                if not header and held > HEADER_BYTES:
                    return None
        return (b"".join(parts), at - len(unpack.unused_data)) if header else None

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        pos = self.next_magic(self.start)
        while pos >= 0:
            got = self.decoded(pos)
            if got is None:
                pos = self.next_magic(pos + 1)
            else:
                yield pos, got[0]
                pos = self.next_magic(got[1])


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI: local, or one that pyarrow reaches (hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri) else (fs.LocalFileSystem(), uri)


class RangeReader(DataSourceReader):
    def __init__(self, uri: str, split_bytes: int):
        self.uri, self.split_bytes = uri, split_bytes

    def partitions(self) -> list[ByteRange]:
        store, root = _located(self.uri)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".warc.gz") and "/_" not in f.path.removeprefix(root))
        return [ByteRange(p, at, min(at + self.split_bytes, n)) for p, n in files for at in range(0, n, self.split_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in PLACED.split(", "))])
        store, _ = _located(self.uri)
        rows, held = [], 0
        with store.open_input_file(partition.path) as file:
            for at, data in RangeScan(file, partition.start, partition.end):
                try:
                    rows.append(parse_record(data) | {"file": partition.path, "offset": at})
                except ValueError as e:
                    raise ValueError(f"{partition.path}, byte {at}: {e}") from e
                held += len(data)
                if held > 4 << 20 or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


class ArchiveWriter(DataSourceArrowWriter):
    """Each attempt writes files of its own name below _attempts; the commit moves those of
    the attempts that count, so that a task that is lost or run twice leaves nothing behind."""

    def __init__(self, uri: str, file_bytes: int):
        self.uri, self.file_bytes = uri.rstrip("/"), file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _located(self.uri)
        part, files, out, held = TaskContext.get().partitionId(), [], None, 0
        store.create_dir(f"{root}/_attempts", recursive=True)
        try:
            for batch in iterator:
                for at in range(batch.num_rows):
                    if out is None or held > self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"part-{part:05d}-{len(files):03d}-{uuid.uuid4().hex}.warc.gz")
                        out, held = store.open_output_stream(f"{root}/_attempts/{files[-1]}", compression=None), 0
                    member = gzip_member(record_bytes(batch.slice(at, 1).to_pylist()[0]))
                    out.write(member)
                    held += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _located(self.uri)
        store.create_dir(root, recursive=True)
        for message in messages:
            for name in message.files if message else ():
                store.move(f"{root}/_attempts/{name}", f"{root}/{name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _located(self.uri)
        if store.get_file_info(f"{root}/_attempts").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_attempts")


class WarcSource(DataSource):
    """Format "warc". Reading: path of an archive (.warc.gz) or a folder of them, option
    split_bytes. Writing: path of a new folder, rows of RECORDS, option file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return PLACED

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)))


def record_id(page_id: Column, digest: Column) -> Column:
    """A UUID from a page's id and its payload's digest."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest).cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12)))


def records_of(pages: DataFrame) -> DataFrame:
    """The rows of RECORDS for pages(page_id, url, html), one for each row.

    Payload: the html in UTF-8 (null: empty). Of equal payloads of LEAST_BYTES or
    more that with the smallest page_id is the response and the others revisit
    it; rows without an id come last, and where no row has one all are responses.
    Rows that repeat the smallest id with the same payload are responses too.
    Equal payloads are told by SHA-256. Payloads that make up a thousandth of all
    rows (at most a thousand) get their response by broadcast, so that no task
    holds all copies of one. Other columns are ignored; a null url gives no
    target; an empty table no records.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload")).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    firsts = hashed.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = stored(firsts, "warc-firsts")
    least = max(COMMON, pages.count() // COMMON)
    common = F.broadcast(firsts.where(F.col("n") >= least).select("payload_digest", F.col("first").alias("common")))
    met = hashed.join(common, "payload_digest", "left")
    # a payload without a response to look for is dealt by its row
    short = (F.col("payload_bytes") < LEAST_BYTES) | F.col("common").isNotNull()
    key = F.when(short, F.concat(F.lit("-"), F.xxhash64("page_id", "target_uri").cast("string"))).otherwise(F.col("payload_digest"))
    met = met.withColumn("key", key).join(firsts.where(F.col("n") < least).select(F.col("payload_digest").alias("key"), "first"), "key", "left")
    first = F.coalesce("common", "first")
    revisit = first.isNotNull() & ~F.col("page_id").eqNullSafe(first)
    return met.select(
        record_id(F.col("page_id"), F.col("payload_digest")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(DATE).alias("record_date"), "payload_digest",
        F.when(revisit, record_id(first, F.col("payload_digest"))).alias("refers_to_id"), "page_id", F.when(revisit, first).alias("refers_to"), "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """records_of(pages) as .warc.gz files, a gzip member for each record, in a new folder."""
    pages.sparkSession.dataSource.register(WarcSource)
    records_of(pages).write.format("warc").option("file_bytes", file_bytes).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of one archive or a folder of them, from any writer, with file and offset."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("split_bytes", split_bytes).load(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """DuckDB SQL for the rows of ``query``."""
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""

"""WARC archives as a PySpark Python data source, and a writer of response and revisit records.

Reading plans partitions over byte ranges of the files (records are gzip members of their own), takes filters on
the record type, target and refers-to headers and parses a record's headers first. The writer notes each member's
length in its gzip header (an extra field), so that the reader goes on behind a member whose payload is not wanted
without inflating it; only members of other writers, which lack the note, have to be inflated to find their end.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import scratch

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, page_id long, content binary"
#: Columns that come from headers alone.
_HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "page_id": "X-Page-ID",
}
_CHUNK = 1 << 20
#: Bytes that are inflated at once until a record's headers are complete.
_HEAD = 2 << 10
_MEMBER = b"\x1f\x8b\x08"
_DATE = "2020-01-01T00:00:00Z"


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: A gzip header with an extra field "SL": the lengths of the member and of what it holds.
_GZIP = struct.Struct("<4sIBBH2sHII")
_LENGTHS = b"SL"


def member(raw: bytes) -> bytes:
    """A gzip member that tells its length, if that fits 32 bits."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = z.compress(raw) + z.flush()
    size = _GZIP.size + len(packed) + 8
    if max(size, len(raw)) >= 1 << 32:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()
    return _GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, _LENGTHS, 8, size, len(raw)) + packed + struct.pack("<II", zlib.crc32(raw), len(raw))


def member_length(head: bytes) -> int | None:
    """The length that a member's header tells."""
    if len(head) < _GZIP.size:
        return None
    magic, _, _, _, extra, name, n, size, _ = _GZIP.unpack_from(head)
    return size if magic == b"\x1f\x8b\x08\x04" and (extra, name, n) == (12, _LENGTHS, 8) else None


def record(headers: dict[str, object], content: bytes) -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return member(f"WARC/1.1\r\n{lines}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n")


def clean(value: str | None) -> str | None:
    """A header value holds no line breaks."""
    return None if value is None else " ".join(value.split())


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.span = options["path"], int(options.get("partitionBytes", 32 << 20))
        self.content = str(options.get("content", "true")).lower() == "true"
        self.only: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute[0] in _HEADERS:
                yield f  # Spark applies it again
            elif isinstance(f, (EqualTo, In)) and f.attribute[0] in _HEADERS and f.attribute[0] not in self.only:
                self.only[f.attribute[0]] = {str(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, path = filesystem(self.path)
        files = [x for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and x.path.endswith(".warc.gz")]
        return [_Range(x.path, a, min(a + self.span, x.size)) for x in sorted(files, key=lambda x: x.path) for a in range(0, x.size, self.span)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = filesystem(self.path)
        rows, size = [], 0
        with store.open_input_file(part.path) as file:
            for headers, payload in members(file, part.start, part.end, self.wanted):
                row = {c: headers.get(h.lower()) for c, h in _HEADERS.items()}
                row |= {c: None if row[c] is None else int(row[c]) for c in ("payload_bytes", "page_id")}
                row["refers_to"] = row["refers_to"] and row["refers_to"].strip("<>")
                row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
                row["content"] = payload
                rows.append(row)
                size += len(payload or b"")
                if len(rows) >= 4096 or size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def wanted(self, headers: dict[str, str]) -> tuple[bool, bool]:
        """Whether a record passes the pushed filters, and whether to inflate its payload."""
        for column, values in self.only.items():
            x = headers.get(_HEADERS[column].lower())
            if x is not None and column == "refers_to":
                x = x.strip("<>")
            if x is not None and column == "payload_digest":
                x = x.removeprefix("sha1:")
            if x not in values:
                return False, False
        return True, self.content


_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def members(file, start: int, end: int, wanted, inflated: list[int] | None = None) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of the records whose gzip member begins in [start, end).

    A range may begin inside a member; the next place that inflates to a record's version line is taken. ``inflated``
    gets the number of inflated bytes of each record.
    """
    buffer, base = b"", start

    def fill(at: int, need: int) -> bool:
        nonlocal buffer, base
        if at > base:
            buffer, base = buffer[at - base :], at
        while len(buffer) < need:
            file.seek(base + len(buffer))
            more = file.read(max(_CHUNK, need - len(buffer)))
            if not more:
                return False
            buffer += more
        return True

    at = start
    if start:
        while True:
            fill(at, 64)
            k = buffer.find(_MEMBER, at - base)
            if k < 0:
                if base + len(buffer) >= end or not fill(base + max(0, len(buffer) - 2), _CHUNK):
                    return
                at = base
                continue
            at = base + k
            if at >= end:
                return
            fill(at, 256)
            try:
                if zlib.decompressobj(31).decompress(buffer[:4096], 7).startswith(b"WARC/1."):
                    break
            except zlib.error:
                pass
            at += 1
    while at < end and fill(at, 1):
        fill(at, _GZIP.size)
        size = member_length(buffer[: _GZIP.size])
        z, raw, fed, total, headers, passes, payload, skip = zlib.decompressobj(31), bytearray(), 0, 0, None, True, True, 0
        while not z.eof:
            if fed >= len(buffer) and not z.unconsumed_tail and not fill(at, len(buffer) + 1):
                raise ValueError("truncated WARC record")
            if z.unconsumed_tail:
                source = z.unconsumed_tail
            else:
                source = buffer[fed : fed + (_HEAD if headers is None else _CHUNK)]
                fed += len(source)
            out = z.decompress(source, _HEAD if headers is None else _CHUNK)
            total += len(out)
            if payload:
                raw += out
            if headers is None and (k := raw.find(b"\r\n\r\n")) >= 0:
                lines = raw[:k].decode().split("\r\n")
                if not lines[0].startswith("WARC/1."):
                    raise ValueError("not a WARC record")
                headers = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}
                passes, payload = wanted(headers)
                payload, skip = passes and payload, k + 4
                if not payload and size is not None:
                    break
        if headers is None:
            raise ValueError("record without headers")
        if inflated is not None:
            inflated.append(total)
        if passes:
            n = int(headers["content-length"])
            if payload and len(raw) < skip + n:
                raise ValueError("truncated WARC content")
            yield headers, bytes(raw[skip : skip + n]) if payload else None
        at += size if size is not None else fed - len(z.unused_data)


class _Commit(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceArrowWriter):
    """Each task writes files of its own under unique names, which get their final names when the job commits.

    What failed attempts and lost executors have left of this job is deleted then, or when it aborts.
    """

    def __init__(self, options: dict):
        self.path, self.most, self.job = options["path"], int(options.get("fileBytes", 256 << 20)), uuid.uuid4().hex

    def write(self, batches) -> WriterCommitMessage:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    files.append(f"{root}/{self.job}-{uuid.uuid4().hex}.warc.gz.part")
                    out, size = store.open_output_stream(files[-1], compression=None), 0
                revisit = row["record_type"] == "revisit"
                data = record({
                    "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{row['record_id']}>", "WARC-Date": _DATE, "WARC-Target-URI": clean(row["target_uri"]),
                    "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "WARC-Refers-To": f"<{row['refers_to']}>" if revisit else None,
                    "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
                    "X-Payload-Length": row["payload_bytes"], "X-Page-ID": row["page_id"], "Content-Type": "text/html",
                }, b"" if revisit else row["content"] or b"")
                size += len(data)
                out.write(data)
        if out is not None:
            out.close()
        return _Commit(files)

    def commit(self, messages) -> None:
        store, _ = filesystem(self.path)
        for m in messages:
            for f in m.files if m else []:
                store.move(f, f.removesuffix(".part"))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = filesystem(self.path)
        for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(self.job) and x.base_name.endswith(".part"):
                store.delete_file(x.path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: ``content`` false skips payloads, ``partitionBytes``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """A row per record of ``pages`` (page_id, url, html): of equal payloads of at least ``min_payload`` bytes the
    row with the largest page_id is the response and the others are revisits that refer to it.

    A null html is an empty payload. A null page_id is smaller than every other. Rows that repeat the largest
    page_id of their payload are responses too. Only digests that occur more than once are joined back, so the
    join is small where copies are few and Spark splits it where one payload is very common.
    """
    rows = pages.select("page_id", F.col("url").alias("target_uri"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("content"))
    rows = rows.withColumn("_sha1", F.sha1("content")).withColumn("payload_bytes", F.octet_length("content").cast("long"))
    narrow = rows.where(F.col("payload_bytes") >= min_payload).groupBy("_sha1").agg(F.max("page_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    tops = narrow.where("_n > 1").select("_sha1", "_top")
    rows = rows.join(tops, "_sha1", "left")
    revisit = F.col("_top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_top"))
    uri = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return rows.select(
        uri(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisit, uri(F.col("_top"))).alias("refers_to"),
        base32(F.col("_sha1")).alias("payload_digest"),
        "payload_bytes",
        "page_id",
        F.when(~revisit, F.col("content")).alias("content"),
    )


def base32(hexed):
    """Base32 of a hexadecimal string of whole 5-byte groups, as SHA-1's, with SQL functions."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", digits)


def archive(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Write the records of ``pages`` as gzip'd WARC files under ``path``."""
    register(pages.sparkSession)
    plan_records(pages, min_payload).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: sizes and digests, of responses from the inflated payload, of revisits from their headers alone."""
    register(spark)
    full = spark.read.format("warc").load(path).where("record_type = 'response'")
    full = full.withColumn("payload_digest", base32(F.sha1("content"))).withColumn("payload_bytes", F.octet_length("content").cast("long"))
    heads = spark.read.format("warc").option("content", "false").load(path).where("record_type = 'revisit'")
    page = F.substring_index("refers_to", ":", -1)
    return full.unionByName(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page).try_cast("long").alias("refers_to"), "target_uri")


def warc_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` as WARC files to the shared folder and read them back."""
    path = scratch(pages.sparkSession, "warc")
    archive(pages, path, min_payload)
    return read_archive(pages.sparkSession, path)

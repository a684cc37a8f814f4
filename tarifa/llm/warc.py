"""WARC archives as a Spark data source, read and written in Python.

Reading (``spark.read.format("warc").load(path)``):

* the driver lists the files and packs them into partitions of about ``split_mb``;
* predicates on record type and headers are pushed down (``=``, ``<=>``, ``IN``, prefix, null tests and
  length comparisons); each record's headers are parsed first and a record that fails is left there;
* the payload of a record is only decoded where it is wanted (``payload`` option, default true) and the
  record passed. Members written by this source carry their compressed length in the gzip header (the
  ``sl`` skip-length field of the WARC specification), so what is skipped is never inflated. Members
  without that field, and plain files, are read too: by inflating, and by Content-Length.

Writing (``df.write.format("warc").save(path)``): a row is a record; a row with ``refers_to`` becomes a
``revisit`` without payload. Each task writes files of its own under a staging folder, and the driver
moves those of the attempts that succeeded, so a lost executor leaves no partial archive.

Paths may be local or any that pyarrow can open; they must be shared by driver and executors.

Edge cases: a null payload is empty; a null target URI leaves the header out and reads back null;
control characters in a URI are percent-encoded; repeated rows are repeated records; an empty
table gives an archive without records; bytes that are no record are an error, not the end of the file. An archive is read
by one task: the writer starts a new one every ``roll_mb``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from tarifa.llm.common import bounded_batches, scratch, table

#: Archives that are moved into place at once.
_MOVES = 32

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, date string, payload_bytes long, payload binary"
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "date")] + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
_FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "date": "warc-date",
}
_HEAD = 4096


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    scheme = path.split(":", 1)[0] if ":" in path else ""
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + path.split(":", 1)[-1].lstrip("/")
    return pafs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class _Written(WriterCommitMessage):
    paths: tuple[str, ...]


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("split_mb", "64")) << 20
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "=", EqualNullSafe: "=", StringStartsWith: "^", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if type(f) in kinds and (column in _FIELDS and kinds[type(f)] in "=^" or column == "payload_bytes" and type(f) is not StringStartsWith) and f.value is not None:
                self.tests.append((column, kinds[type(f)], f.value))
            elif isinstance(f, In) and (column in _FIELDS or column == "payload_bytes"):
                self.tests.append((column, "in", frozenset(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)) and column in _FIELDS:
                self.tests.append((column, "null" if isinstance(f, IsNull) else "there", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=False)) if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and (f.path.endswith((".warc", ".warc.gz"))) and "/_staging" not in f.path)
        packs: list[list[str]] = []
        room = 0
        for name, size in files:
            if not packs or room < size:
                packs.append([])
                room = self.split
            packs[-1].append(name)
            room -= size
        return [_Files(tuple(p)) for p in packs] or [_Files(())]

    def _passes(self, row: dict) -> bool:
        for column, test, value in self.tests:
            x = row[column]
            if test == "null":
                good = x is None
            elif x is None:
                good = False
            elif test == "there":
                good = True
            elif test == "in":
                good = x in value
            elif test == "=":
                good = x == value
            elif test == "^":
                good = x.startswith(value)
            elif test == ">":
                good = x > value
            elif test == ">=":
                good = x >= value
            elif test == "<":
                good = x < value
            else:
                good = x <= value
            if not good:
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for row in self._records(f, path.endswith(".gz"), path):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _records(self, f, packed: bool, name: str) -> Iterator[dict]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            source = _Source(f, packed)
            while source.buffer[:1] in (b"\r", b"\n") or not source.buffer and source.more():  # blank lines before a record
                del source.buffer[:1]
                at += not packed
            if not source.buffer:
                at += source.fed
                continue
            first = True
            while True:
                cut = source.find(b"\r\n\r\n", 0)
                if cut < 0:
                    raise ValueError(f"no WARC record at byte {at} of {name}")
                headers = _headers(bytes(source.buffer[:cut]))
                length = int(headers.get("content-length", 0))
                block = cut + 4
                start, size = block, length
                if headers.get("content-type", "").startswith("application/http"):
                    inner = source.find(b"\r\n\r\n", block, block + length)
                    if inner >= 0:
                        start = inner + 4
                        own = _headers(bytes(source.buffer[block:inner]))
                        size = int(own["content-length"]) if own.get("content-length", "").isdigit() else block + length - start
                row = {c: headers.get(h) for c, h in _FIELDS.items()} | {"payload_bytes": size, "payload": None}
                for c in ("record_id", "refers_to"):
                    if row[c]:
                        row[c] = row[c].strip("<>")
                if row["payload_digest"]:
                    row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
                good = self._passes(row)
                if good and self.payload and row["record_type"] != "revisit":
                    if not source.reach(block + length):
                        raise ValueError(f"the record at byte {at} of {name} ends early")
                    row["payload"] = bytes(source.buffer[start : block + length])
                if good:
                    yield row
                if not packed:
                    at += block + length + 4
                    break
                # a member whose header gives its length is skipped, if that is the length of one record
                if first and source.skip and source.skip[1] == (block + length + 4) % (1 << 32):
                    at += source.skip[0]
                    break
                first = False
                source.drop(block + length)
                while source.buffer[:1] in (b"\r", b"\n") or not source.buffer and source.more():
                    del source.buffer[:1]
                if not source.buffer:  # the member has no further record
                    if not source.inflate.eof:
                        raise ValueError(f"the member at byte {at} of {name} ends early")
                    at += source.fed - len(source.inflate.unused_data)
                    break


class _Source:
    """What is read of a file from a place on; of a packed one, of the gzip member that begins there. ``buffer`` has what is not dropped."""

    def __init__(self, f, packed: bool):
        self.f, self.buffer, self.fed, self.done = f, bytearray(), 0, False
        self.inflate, self.skip = zlib.decompressobj(31) if packed else None, None
        self._take(f.read(_HEAD))

    def _take(self, raw: bytes) -> None:
        if not self.fed and self.inflate:
            self.skip = _skip_length(raw)
        self.fed += len(raw)
        if self.inflate is None:
            self.buffer += raw
            self.done = not raw
        else:
            self.buffer += self.inflate.decompress(raw, 1 << 16)
            self.done = self.inflate.eof

    def more(self) -> bool:
        """Lengthens the buffer; false at the end."""
        if self.done:
            return False
        if self.inflate and self.inflate.unconsumed_tail:
            self.buffer += self.inflate.decompress(self.inflate.unconsumed_tail, 1 << 20)
            self.done = self.inflate.eof
            return True
        raw = self.f.read(1 << 16)
        self._take(raw)
        self.done = self.done or not raw
        return bool(raw)

    def reach(self, n: int) -> bool:
        """Whether the buffer has ``n`` bytes, after reading on."""
        while len(self.buffer) < n and self.more():
            pass
        return len(self.buffer) >= n

    def find(self, what: bytes, start: int, stop: int | None = None) -> int:
        """The first place of ``what`` from ``start`` on that ends before ``stop``; -1 without one."""
        seen = start
        while True:
            had = len(self.buffer)
            at = self.buffer.find(what, seen, had if stop is None else stop)
            if at >= 0 or stop is not None and had >= stop or not self.more():
                return at
            seen = max(start, had - len(what) + 1)

    def drop(self, n: int) -> None:
        """Leaves out the next ``n`` bytes without holding them all."""
        while n:
            gone = min(n, len(self.buffer))
            del self.buffer[:gone]
            n -= gone
            if n and not self.more():
                return


def _skip_length(raw: bytes) -> tuple[int, int] | None:
    """Lengths of the gzip member, compressed and not (modulo 2^32), where its header has them."""
    if len(raw) < 12 or raw[:2] != b"\x1f\x8b" or not raw[3] & 4:
        return None
    extra = raw[12 : 12 + struct.unpack_from("<H", raw, 10)[0]]
    while len(extra) >= 4:
        n = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"sl" and n >= 8:
            packed, plain = struct.unpack_from("<II", extra, 4)
            return (packed, plain) if packed else None
        extra = extra[4 + n :]
    return None


def _headers(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _member(record: bytes) -> bytes:
    """A gzip member whose header says how long it is."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total if total < 2**32 else 0, len(record) % 2**32)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) % 2**32)


def _uri(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(record_id: str, target_uri: str | None, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit of ``refers_to``; the HTTP headers give the payload's full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_uri(target_uri)}")
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_id, target_uri, payload (binary or string), payload_bytes, payload_digest, refers_to, date."""

    def __init__(self, options, overwrite: bool):
        self.path, self.roll = options["path"], int(options.get("roll_mb", "256")) << 20
        self.staging = f"{self.path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, staging = _open(self.staging)
        fs.create_dir(staging, recursive=True)
        done: list[str] = []
        out, size = None, 0
        for b in iterator:
            for r in b.to_pylist():
                if out is None or size > self.roll:
                    if out is not None:
                        out.close()
                    done.append(f"{staging}/{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(done[-1], compression=None), 0
                data = _member(record(r["record_id"], r["target_uri"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"], r["date"]))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return _Written(tuple(done))

    def commit(self, messages) -> None:
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        with ThreadPoolExecutor(_MOVES) as pool:  # a rename each; many at once, as stores take their time
            list(pool.map(lambda p: fs.move(p, f"{path}/{p.rpartition('/')[2]}"), [p for m in messages if m for p in m.paths]))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, staging = _open(self.staging)
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, least_bytes: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages``; payloads of ``least_bytes`` or more are stored once.

    Of the rows with an equal payload the one with the largest page_id is the response, the others
    revisit it (rows that share that id are all responses).
    """
    register(bounded_batches(pages).sparkSession)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("target_uri"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("page_id", "target_uri", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= least_bytes)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("d"), "last")
    # small payloads, of which very many may be equal, look for no response: each has a key of its own
    key = F.when(F.col("payload_bytes") >= least_bytes, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "target_uri").cast("string")))
    joined = rows.withColumn("key", key).join(groups, F.col("key") == F.col("d"), "left")
    again = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    joined.select(
        name("page_id").alias("record_id"),
        "target_uri",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(again, name("last")).alias("refers_to"),
        F.lit(date).alias("date"),
    ).write.format("warc").mode("append").save(path)


def load(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    found = load(spark, path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 12) AS long)")  # noqa: E731  after urn:x-page:
    return found.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )

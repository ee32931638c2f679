"""WARC archives as a PySpark Python data source (operator 7).

Reading plans one partition a file, takes filters on record_type and on other headers, parses a record's headers first
and skips payloads that no row needs: in files of this writer it jumps to the next record by the length that each
compressed member carries, in others it inflates past the block without keeping it.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tidemark.llm.common import discard, scratch_path, small_side, stored

#: Header names of columns; page ids and payload lengths are the writer's own extension headers.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "date": "WARC-Date",
    "profile": "WARC-Profile",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "page_id": "X-Page-ID",
    "payload_bytes": "X-Payload-Length",
}
SCHEMA = "record_type string, record_id string, date string, profile string, target_uri string, payload_digest string, refers_to string, page_id string, payload_bytes string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SLICE = 1 << 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _member(raw: bytes) -> bytes:
    """A gzip member whose extra field `sl` holds its own length and that of the inflated record."""
    z = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    length = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def record_bytes(headers: Sequence[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str
    records: int


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, n = posixpath.join(root, f"_open-{uuid.uuid4().hex}.warc.gz"), 0
        with store.open_output_stream(name, compression=None) as out:
            for row in rows:
                r = row.asDict()
                headers = [(h, str(r[c])) for c, h in HEADERS.items() if r.get(c) is not None]
                block = b"" if r["record_type"] == "revisit" else _HTTP + bytes(r.get("payload") or b"")
                out.write(_member(record_bytes(headers, block)))
                n += 1
        return _Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only files of tasks that succeeded get the name that readers look for."""
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.move(m.path, m.path.replace("/_open-", "/part-")) if m.records else store.delete_file(m.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


@dataclass
class Wanted:
    """What a scan keeps: allowed values by column."""

    values: dict[str, set[str]] = field(default_factory=dict)

    def also(self, column: str, values: set[str]) -> None:
        self.values[column] = self.values[column] & values if column in self.values else values

    def fits(self, row: dict[str, str | None]) -> bool:
        return all(row.get(c) in v for c, v in self.values.items())


class _Stream:
    """Bytes of a .warc or .warc.gz file, member by member, read in slices."""

    def __init__(self, f, zipped: bool):
        self.f, self.zipped = f, zipped

    def records(self, wanted: Wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
        yield from self._zipped(wanted, payloads) if self.zipped else self._plain(wanted, payloads)

    def _zipped(self, wanted: Wanted, payloads: bool):
        at, size = 0, self.f.size()
        while at < size:
            self.f.seek(at)
            start = self.f.read(24)
            own = struct.unpack("<I", start[16:20])[0] if len(start) == 24 and start[3] & 4 and start[12:14] == b"sl" else None
            z, raw = zlib.decompressobj(31), bytearray()
            feed, end = start, at + len(start)

            def more(raw=raw, z=z):
                nonlocal feed, end
                if z.eof:
                    return False
                chunk = feed or self.f.read(_SLICE)
                end += 0 if feed else len(chunk)
                feed = b""
                if not chunk:
                    return False
                raw += z.decompress(chunk)
                return True

            while b"\r\n\r\n" not in raw and more():
                pass
            head, _, _ = bytes(raw).partition(b"\r\n\r\n")
            row, length = parse_headers(head)
            keep = wanted.fits(row)
            if own is None or keep and payloads:
                while more():
                    if not (keep and payloads):
                        del raw[len(head) + 4 :]  # inflated only to find the next member
            if keep:
                yield row, payload_of(row, bytes(raw[len(head) + 4 : len(head) + 4 + length])) if payloads else None
            at = at + own if own is not None else end - len(z.unused_data)

    def _plain(self, wanted: Wanted, payloads: bool):
        at, size = 0, self.f.size()
        while at < size:
            self.f.seek(at)
            raw = b""
            while b"\r\n\r\n" not in raw and (chunk := self.f.read(4096)):
                raw += chunk
            head, found, _ = raw.partition(b"\r\n\r\n")
            if not found:
                return
            row, length = parse_headers(head)
            begin = at + len(head) + 4
            if wanted.fits(row):
                if payloads:
                    self.f.seek(begin)
                    yield row, payload_of(row, self.f.read(length))
                else:
                    yield row, None
            at = begin + length + 4


def parse_headers(head: bytes) -> tuple[dict[str, str], int]:
    """The columns that the headers give, and the block's length."""
    named = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        named[k.strip().lower()] = v.strip()
    return {c: named.get(h.lower()) for c, h in HEADERS.items()}, int(named.get("content-length", 0))


def payload_of(row: dict[str, str | None], block: bytes) -> bytes | None:
    """A response's payload is its block after the HTTP headers; a revisit has none; other records' payload is the block."""
    if row["record_type"] == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.wanted = path, payloads, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.also(column, {f.value})
            elif column in HEADERS and isinstance(f, In):
                self.wanted.also(column, set(f.value))
            elif column == "record_type" and isinstance(f, IsNotNull):
                continue  # every record has a type
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        names = [i.path for i in found if i.is_file and i.path.endswith((".warc", ".warc.gz")) and not i.base_name.startswith(("_", "."))]
        return [_File(n) for n in sorted(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, _File):
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as f:
            for row, payload in _Stream(f, partition.path.endswith(".gz")).records(self.wanted, self.payloads):
                yield (*(row[c] for c in HEADERS), payload)


class WarcSource(DataSource):
    """format("warc"): option payloads=false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true") == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)


def write_pages(pages: DataFrame, path: str, least: int = 100, date: datetime | None = None) -> None:
    """Writes a record for each row of pages(page_id, url, html), dated `date` (UTC; else now).

    Of rows with equal payloads of at least `least` bytes, those of the smallest page_id are responses and the others
    revisit it; shorter payloads are always responses. A null html is empty, a null page_id never revisits nor is
    revisited, a null url has no header. Rows that repeat the smallest page_id are responses too. A record's id follows
    from page_id, url and payload, so only rows that repeat all three share one.

    What repeats is found in digests alone. If that table is counted small, pages stay where they are; else they are
    dealt out by digest, short ones by page.
    """
    register(pages.sparkSession)
    stamp = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    page, payload = F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).cast("binary")
    digest = F.sha2(payload, 256)
    record = F.concat_ws(":", F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("none")), F.lower(F.hex(F.xxhash64("url", digest))))
    slim = pages.select(page, digest.alias("payload_digest"), record.alias("record"), F.octet_length(payload).alias("n"))
    firsts = slim.filter((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min(F.struct("page_id", "record")).alias("first"), F.max("page_id").alias("last")).filter("first.page_id != last").select(F.col("payload_digest").alias("key"), "first")
    firsts = stored(firsts, "firsts")
    rows = pages.select(page, F.col("url").alias("target_uri"), payload.alias("payload"), digest.alias("payload_digest"), record.alias("record"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = rows.withColumn("key", F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(F.concat(F.lit("#"), "record")))  # short payloads never meet
    told = rows.join(small_side(firsts, 300_000), "key", "left").withColumn("again", F.coalesce(F.col("page_id") != F.col("first.page_id"), F.lit(False)))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    records = told.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), urn(F.col("record")).alias("record_id"), F.lit(stamp).alias("date"), F.when(F.col("again"), F.lit(PROFILE)).alias("profile"), "target_uri",
        F.concat(F.lit("sha256:"), F.col("payload_digest")).alias("payload_digest"), F.when(F.col("again"), urn(F.col("first.record"))).alias("refers_to"), F.col("page_id").cast("string").alias("page_id"),
        F.col("payload_bytes").cast("string").alias("payload_bytes"), F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)
    discard(firsts)


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives' pages.

    Responses are measured from the payloads that come back; revisits carry their response's figures in their headers.
    """
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1).cast("long")
    full = read_warc(spark, path).filter("record_type = 'response'").select(F.col("page_id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    slim = read_warc(spark, path, payloads=False).filter("record_type = 'revisit'").select(F.col("page_id").cast("long").alias("page_id"), F.col("payload_bytes").cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return full.unionByName(slim)


def round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    path = path or scratch_path(spark, "warc")
    write_pages(pages, path)
    return archived_pages(spark, path)

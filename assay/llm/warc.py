"""WARC archives: a Python data source that writes and reads them.

Writing: a record is one string (headers, blank line, block), made by DataFrame code; the source's writer puts
each into a gzip member of its own, whose header says how long the member is (extra field WL). A task writes one
file; files count once the driver has listed them (_files-..., one list a write), so those of failed attempts are never read.
Payloads are UTF-8 HTML. A payload that occurs again is a revisit of the record with the smallest
page_id; the digests that occur more than once come from an aggregation and are joined back, few or
many: the optimizer may broadcast them when their measured size is small.

Reading: files are dealt to partitions by size, and compressed ones are cut at byte offsets: a partition begins
at the first member after its offset that inflates to a record. Headers come first; of a record that fails the
pushed-down predicates on type, digest, URI, or id no more than its headers is inflated: the member's length leads to
the next one. The same for all payloads with option payload=false. Members without a length (of
other writers) are inflated to their end, uncompressed files are skipped by a seek.

Defined results: null html is an empty payload; a very long payload is one record and takes memory for itself; html
that is not valid UTF-8 is written as its bytes stand; a null URL has no target URI header, and line
breaks in a URL are percent-encoded; page ids are written as text, and round_trip gives those that are no integers as null; a
null page_id has no number in its record id, never is the first holder, and is a response only if all holders'
ids are null; repeated rows with the smallest page_id are all responses; an empty table gives empty archives, which
read as an empty table; further columns are not read.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from assay.llm.common import shared_path

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = "record_id string, warc_type string, warc_date string, target_uri string, payload_digest string, refers_to string, content_type string, content_length bigint, http_length bigint, payload binary, path string, record_offset bigint"
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "warc_date": "warc-date", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four letters for each five hex digits."""
    code = F.sha1(data)
    out = []
    for i in range(8):
        five = F.conv(F.substring(code, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(five, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def with_first_holder(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, html, ...) with payload, digest, size, first: the page to revisit, or null."""
    rows = pages.withColumn("payload", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload").cast("bigint"))
    again = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("holder")).where("n > 1")
    rows = rows.join(again.select("digest", "holder"), "digest", "left")
    return rows.withColumn("first", F.when(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))


def record_text(date: str) -> Column:
    """One record, without the two line ends after it."""
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.when(F.col("first").isNull(), F.concat(http, "payload")).otherwise(http)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("first").isNull(), "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), page("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(F.col("first").isNotNull(), F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), page("first"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each row of pages, in files under path. Payloads below `least` bytes are never revisits."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    pages.sparkSession.dataSource.register(WarcSource)
    with_first_holder(rows, least).select(record_text(date).alias("value")).write.format("warc").mode("append").option("path", path).save()


def _store(path: str):
    """(file system, path in it): local paths, file:, hdfs:, s3: and the others that Arrow reads."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """A gzip member that says in its header how long it is."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    size = 20 + len(body) + len(tail)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x08\0WL\x04\0" + size.to_bytes(4, "little") + body + tail


class Member:
    """A gzip member of a file as a stream that inflates no more than is asked for."""

    def __init__(self, raw, at: int, size: int):
        self.raw, self.at, self.size = raw, at, size
        head = raw.read_at(min(20, size - at), at)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {at}")
        self.length = int.from_bytes(head[16:20], "little") if head[3:4] == b"\x04" and head[10:16] == b"\x08\0WL\x04\0" else None
        self.flate = zlib.decompressobj(31)
        self.next, self.held, self.inflated, self.over = at, b"", 0, False

    def _more(self, n: int = 1 << 12) -> bool:
        """Inflate about n bytes more; False at the end."""
        if self.over or self.flate.eof:
            return False
        packed = self.flate.unconsumed_tail
        if not packed and self.next < self.size:
            packed = self.raw.read_at(min(1 << 14, self.size - self.next), self.next)
            self.next += len(packed)
        if not packed:
            return False
        got = self.flate.decompress(packed, max(n, 1))
        self.inflated += len(got)
        self.held += got
        return True

    def readline(self, limit: int = -1) -> bytes:
        while b"\n" not in self.held and (limit < 0 or len(self.held) < limit) and self._more():
            pass
        n = self.held.find(b"\n") + 1 or len(self.held)
        return self.read(min(n, limit) if limit >= 0 else n)

    def read(self, n: int) -> bytes:
        parts = [self.held]
        have = len(self.held)
        while have < n:
            self.held = b""
            if not self._more(max(n - have, 1 << 12)):
                break
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        """Past n bytes; all the rest of a member of known length, which holds one record, without inflating it."""
        if self.length is not None:
            self.held, self.over = b"", True
        while n > 0 and (got := self.read(min(n, 1 << 16))):
            n -= len(got)

    def tell(self) -> int:
        return self.at

    def end(self) -> int:
        """Where the next member begins."""
        if self.length is not None:
            return self.at + self.length
        while self._more(1 << 16):
            self.held = b""
        return self.next - len(self.flate.unused_data)


def first_member(raw, at: int, end: int, size: int) -> int | None:
    """The first place from `at`, before `end`, where a member begins that inflates to a record."""
    while at < end:
        part = raw.read_at(min((1 << 20) + 2, size - at), at)
        found = part.find(b"\x1f\x8b\x08")
        while found >= 0:
            if at + found >= end:
                return None
            try:
                if Member(raw, at + found, size).read(5) == b"WARC/":
                    return at + found
            except (ValueError, zlib.error):
                pass
            found = part.find(b"\x1f\x8b\x08", found + 1)
        at += 1 << 20
    return None


def read_members(raw, start: int, end: int, size: int, wanted: dict[str, set], payload: bool = True) -> Iterator[dict]:
    """Records of the members that begin from start up to end."""
    at = first_member(raw, start, end, size) if start else 0
    while at is not None and at < min(end, size):
        member = Member(raw, at, size)
        yield from read_records(member, wanted, payload)
        at = member.end()


@dataclass
class Files(InputPartition):
    parts: list[tuple[str, int, int]]  # path, and the first and last byte where a record may begin


def parse_headers(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """Headers of the next record by lower-case name, None at the end; blank lines before it are skipped."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record begins with {line[:40]!r}")
    out: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:  # a folded line
            out[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def _skip(stream: io.BufferedIOBase, n: int) -> None:
    if isinstance(stream, Member):
        stream.skip(n)
    else:
        stream.seek(n, io.SEEK_CUR)


def _bare(field: str, value: str | None) -> str | None:
    if value and field == "payload_digest":
        return value.removeprefix("sha1:")
    return value.removeprefix("<").removesuffix(">") if value and field in ("record_id", "refers_to") else value


def read_records(stream: io.BufferedIOBase, wanted: dict[str, set], payload: bool = True) -> Iterator[dict]:
    """Records whose header fields are among the wanted values; payload only if it is wanted too."""
    while True:
        at = stream.tell()
        headers = parse_headers(stream)
        if headers is None:
            return
        length = int(headers.get("content-length", 0))
        row = {field: _bare(field, headers.get(name)) for field, name in HEADERS.items()}
        if any(row[field] not in values for field, values in wanted.items()):
            _skip(stream, length)
            continue
        row |= {"content_length": length, "http_length": None, "payload": None, "record_offset": at}
        left = length
        if (row["content_type"] or "").startswith("application/http"):
            while left > 0 and (line := stream.readline(left)):
                left -= len(line)
                if line in (b"\r\n", b"\n"):
                    break
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    row["http_length"] = int(value)
        if payload and row["warc_type"] != "revisit":
            row["payload"] = stream.read(left)
        else:
            _skip(stream, left)
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and IN on header fields; Spark applies all others."""
        for f in filters:
            field = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if field not in HEADERS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[field] = self.wanted.get(field, values) & values

    def partitions(self) -> list[InputPartition]:
        """Ranges of files, the large ones cut, the small ones together."""
        from pyarrow import fs

        store, root = _store(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        lists = [x for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and x.base_name.startswith("_files")]
        if lists:
            listed: set[str] = set()
            for x in lists:
                with store.open_input_stream(x.path) as f:
                    listed.update(f.read().decode().split())
            found = [x for x in found if x.base_name in listed]
        parts = []
        for x in found:
            step = self.size if x.path.endswith(".gz") else max(x.size, 1)
            parts += [(x.path, a, min(a + step, x.size)) for a in range(0, x.size, step)]
        made: list[list] = []
        for part in sorted(parts, key=lambda p: (p[1] - p[2], p)):
            if made and made[-1][0] + part[2] - part[1] <= self.size:
                made[-1][0] += part[2] - part[1]
                made[-1][1].append(part)
            else:
                made.append([part[2] - part[1], [part]])
        return [Files(own) for _, own in made]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = _store(self.path)
        rows, size = [], 0
        for path, start, end in partition.parts:
            with store.open_input_file(path) as raw:
                found = read_members(raw, start, end, raw.size(), self.wanted, self.payload) if path.endswith(".gz") else read_records(io.BufferedReader(raw, 1 << 20), self.wanted, self.payload)
                for row in found:
                    rows.append(row | {"path": path})
                    size += len(row["payload"] or b"") + 400
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"content_length": pa.int64(), "http_length": pa.int64(), "record_offset": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.names], names=self.names)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    """One file a task, a member a record; the driver lists the files of the tasks that count."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(gzip_member(text + CRLF.encode() * 2))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}") as f:  # one list a commit: appending keeps the earlier ones
            f.write("\n".join(m.name for m in messages if m and m.name).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """format("warc"): options path, payload (true or false), partitionbytes; writes one column, the record's text."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("path", path).load()


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: responses with their payload,
    revisits by their headers alone. Columns: page_id, payload_bytes, payload_digest, record_type,
    refers_to, payload."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, least)
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("bigint")
    full = read_warc(spark, path).where(F.col("warc_type") == "response")
    short = read_warc(spark, path, payload=False).where(F.col("warc_type") == "revisit")
    common = [number("record_id").alias("page_id")]
    full = full.select(*common, F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"), "payload")
    short = short.select(*common, F.col("http_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"), "payload")
    return full.unionByName(short)

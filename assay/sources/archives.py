"""Weekly JSONL files, loose or in zips, as a Python data source that reads ranges.

Partitions are planned from the zips' central directories, which stand at their ends: a member is a unit of work, small ones share a
task, and a task seeks to its members and inflates them as it goes. No file is held whole, on the driver or in a task. Names
tell test files of the wanted types and challenge files; others are left out; a loose file wins over a zip's of its name.

Paths are those that Arrow opens (local, file:, hdfs:, s3: and others).
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack, nullcontext
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PARTITION_BYTES, BATCH_BYTES = 32 << 20, 1 << 20
SCHEMA = "path string, name string, split string, file_type string, in_zip boolean, line bigint, value string"
_TEST, _CHALLENGE = re.compile(r"^.+_([A-Za-z0-9]+)_test\.jsonl$"), re.compile(r"^.+_challenge\.jsonl$")


def store_of(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Member:
    path: str
    name: str
    split: str
    file_type: str | None
    in_zip: bool
    size: int  # packed bytes


@dataclass
class Members(InputPartition):
    parts: list[Member]


def kind_of(name: str, types: list[str]) -> tuple[str, str | None] | None:
    """(split, file type) by a file's name; None if it isn't wanted."""
    base = name.rsplit("/", 1)[-1]
    if _CHALLENGE.match(base):
        return "challenge", None
    found = _TEST.match(base)
    return ("test", found[1]) if found and found[1] in types else None


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.types = options["path"], options.get("types", "").split(",")
        self.lines = options.get("lines", "true").lower() == "true"
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))

    def members(self) -> list[Member]:
        from pyarrow import fs

        store, root = store_of(self.path)
        found: dict[str, Member] = {}
        for x in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if not x.is_file:
                continue
            if x.path.endswith(".zip"):
                with store.open_input_file(x.path) as raw, zipfile.ZipFile(raw) as z:
                    own = [(m.filename, True, m.compress_size) for m in z.infolist() if m.filename.endswith(".jsonl")]
            else:
                own = [(x.base_name, False, x.size)] if x.path.endswith(".jsonl") else []
            for name, in_zip, size in own:
                if kind := kind_of(name, self.types):
                    new, base = Member(x.path, name, *kind, in_zip, size), name.rsplit("/", 1)[-1]
                    order = lambda m: (m.in_zip, m.path, m.name)
                    found[base] = min(found.get(base, new), new, key=order)
        return sorted(found.values(), key=lambda m: (-m.size, m.path, m.name))

    def partitions(self) -> list[InputPartition]:
        made: list[list[Member]] = []
        held = 0
        for m in self.members():  # the large ones first, alone; the small ones together
            if made and held + m.size <= self.size:
                made[-1].append(m)
                held += m.size
            else:
                made.append([m])
                held = m.size
        return [Members(own) for own in made]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = store_of(self.path)
        for m in partition.parts:
            if not self.lines:
                yield self._batch(m, [(None, None)])
                continue
            with store.open_input_file(m.path) as raw:
                if not m.in_zip:
                    yield from self._lines(m, _lines_of(raw))
                    continue
                with zipfile.ZipFile(raw) as z, z.open(m.name) as stream:
                    yield from self._lines(m, stream)

    def _lines(self, m: Member, stream) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        for line in stream:
            if not line.strip():
                continue
            held.append((n, line.rstrip(b"\r\n").decode()))
            n, size = n + 1, size + len(line)
            if size >= BATCH_BYTES:
                yield self._batch(m, held)
                held, size = [], 0
        if held:
            yield self._batch(m, held)

    def _batch(self, m: Member, lines: list[tuple]) -> pa.RecordBatch:
        k = len(lines)
        columns = {"path": pa.array([m.path] * k), "name": pa.array([m.name] * k), "split": pa.array([m.split] * k), "file_type": pa.array([m.file_type] * k, pa.string()), "in_zip": pa.array([m.in_zip] * k), "line": pa.array([i for i, _ in lines], pa.int64()), "value": pa.array([v for _, v in lines], pa.string())}
        return pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=self.names)


def _lines_of(raw) -> Iterator[bytes]:
    """Lines of an Arrow file, a block at a time."""
    rest = b""
    while block := raw.read(BATCH_BYTES):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class ArchiveSource(DataSource):
    """format("jsonl_archives"): options path, types (wanted ones, with commas), lines (false: a row for each member), partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options)


def read_archives(spark: SparkSession, path: str, types: list[str], lines: bool = True) -> DataFrame:
    """The lines of the wanted members under path that aren't blank, numbered from 0; or the members."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("jsonl_archives").option("path", path).option("types", ",".join(types)).option("lines", str(lines).lower()).load()


def discover_members(spark: SparkSession, path: str, types: list[str]) -> DataFrame:
    """(path, name, split, file_type, in_zip) of the wanted members."""
    return read_archives(spark, path, types, lines=False).drop("line", "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, list[str]]]:
    """(file, member, values) of sorted rows, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            own = zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)
            for (file, member), run in groupby(own, itemgetter(0, 1)):
                yield file, member, [value for _, _, value in run]


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """rows (file, member, value) to files under path, a task a file: zips with their members, loose files where member is null.
    Rows come sorted and are written as they come, so a file of any size takes a batch's memory. Returns (file, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        store.create_dir(root, recursive=True)
        for file, runs in groupby(_runs(batches), itemgetter(0)):
            n = 0
            with store.open_output_stream(f"{root}/{file}") as out, ExitStack() as zipped:
                z = None
                for member, own in groupby(runs, itemgetter(1)):  # a null member comes first
                    if member is not None:
                        z = z or zipped.enter_context(zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED))
                    with nullcontext(out) if member is None else z.open(member, "w", force_zip64=True) as into:
                        for _, _, values in own:
                            into.write("".join(v + "\n" for v in values).encode())
                            n += len(values)
            yield pa.RecordBatch.from_pydict({"file": pa.array([file]), "n": pa.array([n], pa.int64())})

    dealt = rows.select("file", "member", "value").repartition("file").sortWithinPartitions("file", "member")
    return dealt.mapInArrow(run, "file string, n bigint")

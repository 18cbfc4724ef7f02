"""Model files under a path, scanned where they lie: a Python data source of the scan's rows (functions/pickles.py).

A file is a unit of work, small ones share a task; a task takes a file's head first, then streams what the head calls for, a block at a time. So a
file of any size takes a block's memory, and no file passes through Spark's rows or the driver. Folders that hold no models (version control,
caches, environments) and hidden files are left out, as are files deeper than `depth` folders.

Paths are those that Arrow opens (local, file:, hdfs:, s3: and others).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from assay.functions.pickles import BLOCK, SCAN, SKIPPED_FOLDERS, scan_batch, scan_one
from assay.sources.archives import store_of

PARTITION_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


def wanted(relative: str, depth: int) -> bool:
    *folders, name = relative.split("/")
    return len(folders) <= depth and not name.startswith(".") and not any(f in SKIPPED_FOLDERS or f.startswith(".") for f in folders)


class ArtifactReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.names
        self.path, self.depth = options["path"], int(options.get("depth", 3))
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = store_of(self.path)
        found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and wanted(x.path[len(root.rstrip("/")) + 1 :], self.depth)]
        made: list[list[str]] = []
        held = 0
        for x in sorted(found, key=lambda x: (-x.size, x.path)):  # the large ones first, alone
            if made and held + x.size <= self.size:
                made[-1].append(x.path)
                held += x.size
            else:
                made.append([x.path])
                held = x.size
        return [Files(own) for own in made]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = store_of(self.path)
        for path in partition.paths:
            files = []

            def open_(path=path, files=files):
                files.append(store.open_input_file(path))
                return io.BufferedReader(files[-1], BLOCK)

            try:
                yield scan_batch([scan_one(path, open_)], self.names)
            finally:
                for f in files:
                    f.close()


class ArtifactSource(DataSource):
    """format("model_files"): options path, depth, partitionbytes."""

    @classmethod
    def name(cls) -> str:
        return "model_files"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema: StructType) -> ArtifactReader:
        return ArtifactReader(schema, self.options)


def scan_path(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    """SCAN of the files under path."""
    spark.dataSource.register(ArtifactSource)
    return spark.read.format("model_files").option("path", path).option("depth", depth).load()


def write_files(files: DataFrame, path: str) -> DataFrame:
    """files (path, content) written under path by tasks, at their own paths below it; returns (path, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{root}/{name.lstrip('/')}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_pydict({"path": batch.column(0), "n_bytes": pa.array([len(x or b"") for x in batch.column(1).to_pylist()], pa.int64())})

    return files.select("path", "content").mapInArrow(run, "path string, n_bytes bigint")

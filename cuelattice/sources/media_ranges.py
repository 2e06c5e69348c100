"""A data source of media files that reads the first and last bytes of each and nothing between them.

A media file may be larger than a binary column can be, and its quick hash needs 128 KiB of it. Files are listed by
the driver, dealt to partitions in groups and opened in the tasks by the file system of their address (a shared
folder, ``hdfs://``, ``s3://``, ...), which seeks to the two ranges.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cuelattice.operators.library import SAMPLE_BYTES, quick_hash_of

SCHEMA = "path string, size_bytes long, modified_at_ms long, head binary, tail binary, error string"
#: Files of one partition, and of one Arrow batch (twice 64 KiB each).
FILES_PER_PARTITION, FILES_PER_BATCH = 256, 32


@dataclass
class FileGroup(InputPartition):
    """Files that one task reads: (path, size, time of change)."""

    files: tuple[tuple[str, int, int], ...]


def read_ranges(system: fs.FileSystem, path: str, size: int, sample: int) -> tuple[bytes, bytes | None]:
    """First ``sample`` bytes, and the last ``sample`` bytes of a file that has more."""
    with system.open_input_file(path) as file:
        head = file.read(sample)
        if size <= sample:
            return head, None
        file.seek(size - sample)
        return head, file.read(sample)


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("media_ranges needs a path")
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.sample = int(options.get("samplebytes", SAMPLE_BYTES))
        self.per_partition = int(options.get("filesperpartition", FILES_PER_PARTITION))
        if self.sample < 1 or self.per_partition < 1:
            raise ValueError("samplebytes and filesperpartition must be positive")

    def partitions(self) -> Sequence[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        files = sorted(
            (f.path, f.size, f.mtime_ns // 1_000_000 if f.mtime_ns is not None else 0) for f in found
            if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern))
        return [FileGroup(tuple(files[at : at + self.per_partition])) for at in range(0, len(files), self.per_partition)]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for at in range(0, len(partition.files), FILES_PER_BATCH):
            rows = []
            for path, size, changed in partition.files[at : at + FILES_PER_BATCH]:
                head = tail = error = None
                try:
                    head, tail = read_ranges(system, path, size, self.sample)
                except OSError as problem:
                    # A file that went or may not be read is a row with its error, as in an inspection.
                    error = "missing" if isinstance(problem, FileNotFoundError) else "unreadable"
                rows.append((path, size, changed, head, tail, error))
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
            names = ("path", "size_bytes", "modified_at_ms", "head", "tail", "error")
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], list(names))


class MediaRanges(DataSource):
    """``spark.read.format("media_ranges").load(folder)``; options ``pattern``, ``recursive``, ``sampleBytes``, ``filesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "media_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _RangeReader({key.lower(): value for key, value in self.options.items()})


def media_ranges(spark: SparkSession, path: str, pattern: str = "*", sample_bytes: int = SAMPLE_BYTES, files_per_partition: int = FILES_PER_PARTITION) -> DataFrame:
    """Files below ``path``, whose address a file system of pyarrow opens, with their first and last bytes.

    One row per file: ``path``, ``size_bytes``, ``modified_at_ms``, ``head``, ``tail`` (null if ``head`` is the whole file) and
    ``error`` (``missing`` or ``unreadable``, then without bytes). Whatever the size of a file, a task reads twice
    ``sample_bytes`` of it. The driver keeps the list of names, as Spark's own file sources do.
    """
    spark.dataSource.register(MediaRanges)
    address = path if "://" in path else f"file://{path}"
    return spark.read.format("media_ranges").option("pattern", pattern).option("sampleBytes", sample_bytes).option("filesPerPartition", files_per_partition).load(address)


def quick_hashes(ranges: DataFrame) -> DataFrame:
    """``path``, ``size_bytes``, ``modified_at_ms``, ``quick_hash`` (null for a file with an error) and ``error`` of ``media_ranges`` rows."""
    known = F.when(F.col("error").isNull(), quick_hash_of(F.col("head"), F.col("tail"), F.col("size_bytes")))
    return ranges.select("path", "size_bytes", "modified_at_ms", known.alias("quick_hash"), "error")

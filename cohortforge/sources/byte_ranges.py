"""Files of any size by byte ranges: a Python data source whose partitions are ranges, digested where they are read."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range; part of the digest's name, since another size gives another digest.
RANGE_BYTES = 64 << 20
#: Ranges and bytes that one task takes at most, a single range aside.
TASK_RANGES = 1000
TASK_BYTES = 256 << 20
BLOCK = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


@dataclass
class Ranges(InputPartition):
    """Ranges of files: (path, size, modified, start, length)."""

    items: list[tuple]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.glob = options.get("glob", "*")
        self.step = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        system, root = opened(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        out: list[Ranges] = []
        held: list[tuple] = []
        size = 0
        for info in sorted(infos, key=lambda i: i.path):
            if info.type != fs.FileType.File or not fnmatch(info.base_name, self.glob):
                continue
            for start in range(0, max(info.size, 1), self.step):
                length = min(self.step, info.size - start)
                if held and (size + length > TASK_BYTES or len(held) >= TASK_RANGES):
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((info.path, info.size, info.mtime, start, length))
                size += length
        if held:
            out.append(Ranges(held))
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path, size, modified, start, length in partition.items:
            digest = hashlib.sha256()
            with system.open_input_file(path) as source:
                source.seek(start)
                left = length
                while left:
                    block = source.read(min(BLOCK, left))
                    if not block:
                        raise OSError(f"{path} became shorter while it was read")
                    digest.update(block)
                    left -= len(block)
            yield path, size, modified, start, digest.hexdigest()


class ByteRanges(DataSource):
    """``spark.read.format("byte_ranges")`` with options path, glob and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, n_bytes long, modified timestamp, start long, digest string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_ranges(spark: SparkSession, path: str, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each range of each file below a folder; an empty file has one empty range."""
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").option("glob", glob).option("range_bytes", range_bytes).load(path)


def range_inventory(spark: SparkSession, path: str, glob: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files with a digest over the digests of their ranges: the rows of ``provenance.file_inventory`` plus ``n_ranges``.

    ``checksum`` is ``sha256-ranges-<range_bytes>:`` and the SHA-256 of the newline-joined
    hex digests of the ranges in order. Ranges are read by tasks of their own, so a file may
    have any size; one group holds a file's range digests, some 80 bytes for each 64 MB.
    """
    ranges = read_ranges(spark, path, glob, range_bytes)
    listed = F.array_sort(F.collect_list(F.struct("start", "digest")))
    files = ranges.groupBy("path", "n_bytes", "modified").agg(listed.alias("_ranges"))
    root = F.sha2(F.array_join(F.col("_ranges.digest"), "\n"), 256)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "n_bytes",
        "modified",
        F.concat(F.lit(f"sha256-ranges-{range_bytes}:"), root).alias("checksum"),
        F.size("_ranges").alias("n_ranges"),
    )

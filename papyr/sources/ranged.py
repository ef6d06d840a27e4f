"""Files read by byte ranges: a large file is many rows, read by many tasks.

A data source `ranged` for spark.read.  Where binaryFile gives a file as one
value, this plans ranges of `size` bytes as partitions; a task opens its file,
reads its range and holds no more than that.  Paths are those of pyarrow.fs:
local ones, file://, hdfs://, s3:// and gs://, also folders and patterns of the
last part.  A file over `most` bytes, or one that can't be read, gives one row
with an error and no content.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, start long, content binary, file_size long, error string"
#: Bytes of a range, and of a file at most, unless options say otherwise.
SIZE, MOST = 64 << 20, 1 << 40


@dataclass
class Range(InputPartition):
    path: str
    start: int
    length: int
    file_size: int
    error: str | None = None


def _opened(path: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else posixpath.abspath(path))


class RangedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size, self.most = int(options.get("size", SIZE)), int(options.get("most", MOST))
        if self.size < 1:
            raise ValueError("size must be 1 or more")

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        folder, name = posixpath.split(self.path)
        system, at = _opened(folder if "*" in name or "?" in name else self.path)
        if "*" in name or "?" in name:
            found = [f for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and fnmatch.fnmatchcase(f.base_name, name)]
        else:
            info = system.get_file_info(at)
            if info.type == fs.FileType.NotFound:
                return [Range(self.path, 0, 0, 0, "not found")]
            found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.size > self.most:
                out.append(Range(scheme + f.path, 0, 0, f.size, f"{f.size} bytes; the most is {self.most}"))
            else:
                out += [Range(scheme + f.path, s, min(self.size, f.size - s), f.size) for s in range(0, max(1, f.size), self.size)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        p = partition
        if p.error:
            yield p.path, 0, None, p.file_size, p.error
            return
        try:
            system, at = _opened(p.path)
            with system.open_input_file(at) as f:
                content = f.read_at(p.length, p.start)
        except OSError as e:
            yield p.path, p.start, None, p.file_size, type(e).__name__
        else:
            yield p.path, p.start, content, p.file_size, None if len(content) == p.length else "file changed while it was read"


class RangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ranged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangedReader:
        return RangedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("ranged") known; sent by value, so workers need no copy of this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(RangedFiles)

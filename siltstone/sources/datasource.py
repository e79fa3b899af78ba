"""Line protocol as a Spark data source: spark.read.format("lineproto") and readStream likewise.

Options: path (a file or folder, .gz allowed, of any file system pyarrow knows), database, precision. Columns are
line_id (the number of the record's first line in its file) and those of `siltstone.sources.lineproto.PARSED`.
A newline within a quoted field value belongs to its record. A file is a task, as a record's beginning shows only
from the file's. Files must be complete when they appear: written elsewhere and renamed in, or under a name
that begins with . or _ meanwhile.
"""

from __future__ import annotations

import gzip
import io
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siltstone.sources.lineproto import PARSED, parse_batches, records

CHUNK = 10_000


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _system(path)
    prefix = path[: len(path) - len(at)] if "://" in path and path.endswith(at) else ""
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _read(path: str, options: dict) -> Iterator:
    import pyarrow as pa

    def chunks() -> Iterator:
        now = time.time_ns()
        system, at = _system(path)
        with system.open_input_stream(at, compression=None) as raw, io.TextIOWrapper(gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw), encoding="utf-8", errors="replace", newline="\n") as f:
            ids, some = [], []
            for i, record in records(line.rstrip("\n") for line in f):
                ids.append(i)
                some.append(record)
                if len(some) == CHUNK:
                    yield batch(ids, some, now)
                    ids, some = [], []
            yield batch(ids, some, now)

    def batch(ids: list[int], lines: list[str], now: int):
        n = len(lines)
        text = lambda v: pa.array([v] * n, pa.string())
        columns = [pa.array(ids, pa.int64()), text(options.get("database")), text(options.get("precision", "ns")), pa.array([now] * n, pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["line_id", "db_name", "precision", "received_ns", "line"])

    return parse_batches(chunks())


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(p) for p in _files(self.options["path"])]

    def read(self, partition: FilePartition) -> Iterator:
        return _read(partition.path, self.options)


class _Stream(DataSourceStreamReader):
    """Each trigger reads the files that it lists and the one before did not, whatever their names or times, a
    task per file. The offset is the listing, so a landing folder should be emptied of what was read long ago."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": []}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": _files(self.options["path"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        seen = set(start["files"])
        return [FilePartition(p) for p in end["files"] if p not in seen]

    def read(self, partition: FilePartition) -> Iterator:
        return _read(partition.path, self.options)


class LineProtocol(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lineproto"

    def schema(self) -> str:
        return "line_id bigint, " + PARSED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


#: Parsers by content type; every type falls back to line protocol, as writers send any.
PARSERS: dict[str, type[DataSource]] = {"": LineProtocol}


def parser_for(content_type: str) -> type[DataSource]:
    return next((p for k, p in sorted(PARSERS.items(), reverse=True) if content_type.startswith(k)), LineProtocol)


def register(spark: SparkSession) -> None:
    for parser in {*PARSERS.values()}:
        spark.dataSource.register(parser)

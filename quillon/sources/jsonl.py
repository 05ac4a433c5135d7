"""JSON-lines files as Spark data sources, read in byte ranges, in batch and as a stream.

    spark.dataSource.register(JsonLines)
    spark.read.format("quillon_jsonl").schema(TURN).option("path", folder).load()
    spark.readStream.format("quillon_jsonl").schema(TURN).option("path", folder).load()

A range begins after the first line end at or before its start, so that every line is read once
whatever the ranges. Options: path (a file or folder of any file system that pyarrow opens),
bytes (of a range), suffix (of the files of a folder). The schema may have the columns _file and
_offset, where a line stands."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BYTES = 32 << 20
CHUNK = 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    """Names and sizes, in order of name."""
    system, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    found = [info] if info.type == pafs.FileType.File else [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_"))]
    return sorted((f.path, f.size) for f in found)


def _lines(path: str, file: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end)."""
    system = pafs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else pafs.LocalFileSystem()
    with system.open_input_file(file) as f:
        at = max(0, start - 1)
        f.seek(at)
        held, first = b"", start > 0
        while True:
            chunk = f.read(CHUNK)
            held += chunk
            while (cut := held.find(b"\n")) >= 0:
                line, held = held[:cut], held[cut + 1 :]
                if not first:
                    if at >= end:
                        return
                    yield at, line
                first, at = False, at + cut + 1
            if at >= end and not first:
                return
            if not chunk:
                if held and not first and at < end:
                    yield at, held
                return


def _value(x, kind: T.DataType):
    """A JSON value as its type asks, or null where it isn't of that type."""
    if x is None:
        return None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x)
    if isinstance(kind, T.BooleanType):
        return x if isinstance(x, bool) else None
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return x if isinstance(x, int) and not isinstance(x, bool) else None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    if isinstance(kind, T.ArrayType):
        return [_value(y, kind.elementType) for y in x] if isinstance(x, list) else None
    if isinstance(kind, T.StructType):
        return tuple(_value(x.get(f.name), f.dataType) for f in kind) if isinstance(x, dict) else None
    if isinstance(kind, T.MapType):
        return {k: _value(y, kind.valueType) for k, y in x.items()} if isinstance(x, dict) else None
    raise ValueError(f"no JSON value is read as {kind.simpleString()}")


class _Reader:
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.bytes, self.suffix = int(options.get("bytes", BYTES)), options.get("suffix", "")

    def ranges(self, file: str, start: int, end: int) -> list[Range]:
        return [Range(file, a, min(end, a + self.bytes)) for a in range(start, end, self.bytes)]

    def read(self, part: Range) -> Iterator[tuple]:
        """Rows of a range; lines that are no JSON object are left out."""
        for offset, line in _lines(self.path, part.file, part.start, part.end):
            try:
                found = json.loads(line)
            except ValueError:
                continue
            if isinstance(found, dict):
                at = {"_file": part.file, "_offset": offset}
                yield tuple(at[f.name] if f.name in at else _value(found.get(f.name), f.dataType) for f in self.schema)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for file, size in _files(self.path, self.suffix) for r in self.ranges(file, 0, size)]


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are the bytes of each file that have been read: files may grow by whole lines."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return dict(_files(self.path, self.suffix))

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for file, size in sorted(end.items()) for r in self.ranges(file, start.get(file, 0), size)]

    def commit(self, end: dict) -> None:
        pass


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_jsonl"

    def schema(self) -> str:
        return "role string, content string"

    def reader(self, schema: T.StructType) -> _Batch:
        return _Batch(schema, self.options)

    def streamReader(self, schema: T.StructType) -> _Stream:
        return _Stream(schema, self.options)


def read_lines(spark, path: str, schema: str, **options) -> DataFrame:
    spark.dataSource.register(JsonLines)
    return spark.read.format(JsonLines.name()).schema(schema).options(**{k: str(v) for k, v in options.items()}).option("path", path).load()


def last_lines(spark, path: str, schema: str, keys: list[str], **options) -> DataFrame:
    """The last line of each key, by file and place in it (S21): a cache whose later lines replace earlier ones."""
    rows = read_lines(spark, path, f"{schema}, _file string, _offset long", **options)
    last = Window.partitionBy(*keys).orderBy(F.desc("_file"), F.desc("_offset"))
    return rows.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last", "_file", "_offset")

"""Lines of files that Spark's file sources do not list, because their names begin with ``_`` or ``.``.

The driver lists the files and plans byte ranges; a task opens its file by itself, through Arrow's file
systems (local and mounted folders, HDFS, S3, GCS), and reads the lines that begin in its range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
_STEP = 1 << 20
_SCHEMA = "file string, value string"


@dataclass
class ByteRange(InputPartition):
    uri: str
    file: str
    start: int
    end: int


def _lines(source, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin at ``start`` .. ``end`` - 1, without the line feed; a line begins after a line feed."""
    at = max(start - 1, 0)
    source.seek(at)
    rest, skip = b"", start > 0
    while True:
        block = source.read(_STEP)
        if not block:
            break
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if skip:
                skip = False
            elif at < end:
                yield part
            else:
                return
            at += len(part) + 1
        if at >= end and not skip:
            return
    if rest and not skip and at < end:
        yield rest


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.size = int(options["size"])

    def partitions(self) -> list[ByteRange]:
        return [
            ByteRange(uri, file, start, min(start + self.size, length))
            for uri, file, length in self.files
            for start in range(0, length, self.size)
        ]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.uri)
        with system.open_input_file(path) as source:
            held: list[str] = []
            for line in _lines(source, partition.start, partition.end):
                held.append(line.decode("utf-8", "replace"))
                if len(held) == 4096:
                    yield _batch(partition.file, held)
                    held = []
            if held:
                yield _batch(partition.file, held)


def _batch(file: str, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": pa.array([file] * len(lines)), "value": pa.array(lines)})


class HiddenLines(DataSource):
    """Options: files (JSON list of URI, name, bytes), size (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "hidden_review_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def hidden_lines(spark: SparkSession, files: list[tuple[str, str, int]], size: int = RANGE_BYTES) -> DataFrame:
    """(file, value) of the lines of ``files`` (URI, name, bytes). A file longer than ``size`` is read by several
    tasks."""
    spark.dataSource.register(HiddenLines)
    reader = spark.read.format(HiddenLines.name())
    return reader.option("files", json.dumps(files)).option("size", str(size)).load()

"""CSV files whose quoted fields hold line breaks, read in byte ranges.

Whether a line begins a record depends on every quote before it, so a whole file is usually parsed by one task.
Here the files are read as lines, which the text source splits into byte ranges, in two passes:

1. Every range reports the parity of its quotes, a number. Running over the ranges of a file in order (a
   row per range) the parities tell in which state each range begins: outside of quotes or inside.
2. With that state every range cuts its lines into records. Records that lie in one range are complete. What a range
   cannot complete are the lines before its first record (the rest of one that an earlier range began) and its
   last record if it is open at the end; these pieces, at most two per range, are put together by their order.

The records are stored once, so the texts are cut only once however often the result is read, and
are then parsed by Spark's own CSV parser, one record each. Quotes stand around fields and, doubled, inside them; a
stray quote elsewhere makes records of the wrong width, which stop the read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlytics.operators.lineage import Scratch, written

#: A record of one range; the end of one that an earlier range began; one that is open at the range's end.
COMPLETE, REST, OPEN = 0, 1, 2
_PIECES = "file string, start bigint, kind int, first boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start of the byte range, and the lines in their order, without the line feed."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def range_states(lines: DataFrame) -> DataFrame:
    """file, start, inside: whether the range begins inside quotes, returns: whether the file's first line
    ends with a carriage return, which then belongs to the line break, inside quotes as well."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    ends = F.min_by(F.endswith("value", F.lit("\r")), "nth")
    lines = lines.withColumn("nth", F.monotonically_increasing_id())
    odd = lines.groupBy("file", "start").agg((F.sum(quotes.cast("bigint")) % 2).alias("odd"), ends.alias("ends"))
    ranges = Window.partitionBy("file").orderBy("start")
    inside = F.coalesce(F.sum("odd").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    return odd.select("file", "start", inside.alias("inside"), F.first("ends").over(ranges).alias("returns"))


class _Range:
    """Cuts the lines of one byte range, fed in their order, into (kind, first of its file, record)."""

    def __init__(self, file: str, start: int, inside: bool, returns: bool):
        self.file, self.start, self.returns = file, start, returns
        self.rest: list[str] | None = [] if inside else None
        self.open: list[str] | None = None
        self.first = start == 0

    def feed(self, lines: list[str]) -> list[tuple[int, bool, str]]:
        out = []
        if self.returns:
            lines = [line.removesuffix("\r") for line in lines]
        if self.rest is not None:
            for k, line in enumerate(lines):
                self.rest.append(line)
                if line.count('"') % 2:
                    out.append((REST, False, "\n".join(self.rest)))
                    self.rest, lines = None, lines[k + 1 :]
                    break
            else:
                return out
        for line in lines:
            odd = line.count('"') % 2
            if self.open is not None:
                self.open.append(line)
                if odd:
                    self._add(out, "\n".join(self.open))
                    self.open = None
            elif odd:
                self.open = [line]
            else:
                self._add(out, line)
        return out

    def _add(self, out: list, record: str) -> None:
        if record:
            out.append((COMPLETE, self.first, record))
            self.first = False

    def end(self) -> list[tuple[int, bool, str]]:
        if self.rest is not None:
            return [(REST, False, "\n".join(self.rest))]
        return [] if self.open is None else [(OPEN, self.first, "\n".join(self.open))]

    def rows(self, pieces: list[tuple[int, bool, str]]) -> pa.RecordBatch:
        kind, first, record = zip(*pieces) if pieces else ((), (), ())
        n = len(pieces)
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.array([self.file] * n, pa.string()), "start": pa.array([self.start] * n, pa.int64()),
                "kind": pa.array(kind, pa.int32()), "first": pa.array(first, pa.bool_()),
                "record": pa.array(record, pa.string()),
            }
        )


def _cut(sent):
    """Pieces of the ranges that a task reads one after the other."""

    def begun(file: str, start: int) -> _Range:
        starts, inside, returns = sent.value.get(file, ([], [], False))
        k = int(np.searchsorted(starts, start))
        if k == len(starts) or starts[k] != start:
            raise ValueError(f"the byte ranges of {file} have changed; read it again")
        return _Range(file, start, bool(inside[k]), returns)

    def run(batches):
        now = None
        for batch in batches:
            names, starts, values = batch.column("file").dictionary_encode(), batch.column("start").to_numpy(), batch.column("value")
            code = names.indices.to_numpy()
            cuts = np.flatnonzero((starts[1:] != starts[:-1]) | (code[1:] != code[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(starts)] if len(starts) else [0]
            for a, b in zip(bounds[:-1], bounds[1:]):
                file, start = names.dictionary[int(code[a])].as_py(), int(starts[a])
                if now is None or (now.file, now.start) != (file, start):
                    if now is not None:
                        yield now.rows(now.end())
                    now = begun(file, start)
                yield now.rows(now.feed(values.slice(a, b - a).to_pylist()))
        if now is not None:
            yield now.rows(now.end())

    return run


def _whole(pieces: DataFrame) -> DataFrame:
    """first, record of the records that lie in several ranges. A record is an open piece and the
    rests that follow before the next one; only the keys are put in order as a whole, per file."""
    keys = pieces.select("file", "start", "kind")
    up_to_here = Window.partitionBy("file").orderBy("start", "kind")
    nth = F.sum((F.col("kind") == OPEN).cast("bigint")).over(up_to_here)
    parts = pieces.join(keys.withColumn("nth", nth), ["file", "start", "kind"])
    in_order = F.sort_array(F.collect_list(F.struct("start", "kind", "record")))
    whole = parts.groupBy("file", "nth").agg(F.bool_or("first").alias("first"), in_order.alias("parts"))
    return whole.select("first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))


def read_records(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """first (whether it is its file's first), record: all records of the CSV files under ``path``,
    stored in ``scratch`` or the shared folder. Empty lines are no records."""
    lines = _lines(spark, path)
    # A row per byte range, that is per some 128 MB of input; a file's name and nine bytes a range are sent.
    states = range_states(lines).toArrow().sort_by([("file", "ascending"), ("start", "ascending")])
    files, starts, inside, returns = (states.column(c).to_numpy() for c in ("file", "start", "inside", "returns"))
    cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)] if len(files) else [0]
    known = {files[a]: (starts[a:b], inside[a:b], bool(returns[a])) for a, b in zip(cuts[:-1], cuts[1:])}
    sent = spark.sparkContext.broadcast(known)
    cut = lines.mapInArrow(_cut(sent), _PIECES)
    pieces = scratch.store(cut, "csv-records") if scratch else written(cut, "csv-records")
    sent.destroy()
    complete = pieces.filter(F.col("kind") == COMPLETE).select("first", "record")
    return complete.unionByName(_whole(pieces.filter(F.col("kind") != COMPLETE)))


def read_split_csv(
    spark: SparkSession, path: str, schema: T.StructType, scratch: Scratch | None = None
) -> DataFrame:
    """The rows of CSV files with header, as Spark's own reader with ``multiLine`` gives them, a file of any
    size read by many tasks. Line breaks in quoted fields are kept; where a file's lines end with carriage return and
    line feed, they become line feeds."""
    options = {"mode": "FAILFAST", "quote": '"', "escape": '"', "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    rows = read_records(spark, path, scratch).filter(~F.col("first")).select(F.from_csv("record", ddl, options).alias("row"))
    return rows.select("row.*")

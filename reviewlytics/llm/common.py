"""What several operators share: tables, stored intermediate results, text buffers, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.operators.lineage import scratch_folder

#: Bytes of text that a task works on at once; a longer text is worked on alone.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: no lineage, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again; their disk is free for the next steps."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the jobs of the block; those of before come back after it."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(
    batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``size`` bytes of text each, with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            part = data[offsets[begin] : offsets[end]]
            yield batch.slice(begin, end - begin), part, offsets[begin : end + 1] - offsets[begin]
            begin = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: An odd base of polynomial hashes modulo 2^64 and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        known = np.full(size, np.uint64(base))
        known[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(known, out=known)
        if size <= 1 << 23:
            _POWERS[base] = known
    return known[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums of (byte + 1) * BASE^i; length + 1 values."""
    out = np.zeros(len(data) + 1, np.uint64)
    if len(data):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes begin..end, equal for equal strings wherever they stand."""
    return mix64((prefix[end] - prefix[begin]) * powers(INVERSE, len(prefix))[begin])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


#: Bytes of words of letters: ASCII letters and all signs beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def word_spans(
    data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the words [^\\x20\\x09-\\x0D]+, or of runs of the bytes that ``letters``
    marks, and words before each row (rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data] if letters is None else ~letters[data]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= space[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, offsets)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingle_hashes(
    words: np.ndarray, counts: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and the row of each; short rows give their whole
    sequence as one, rows without words none. ``counts``: words before each row (rows + 1)."""
    n = np.diff(counts)
    runs = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(n)), runs)
    starts = np.repeat(counts[:-1], runs) + ranks(runs)
    length = np.minimum(n, width)[rows]
    out = np.full(len(rows), 0x51ED270B, np.uint64)
    for k in range(width):
        on = length > k
        if on.all():
            out = mix64(out + words[starts + k] * np.uint64(0xD6E8FEB86659FD93))
        else:
            out[on] = mix64(out[on] + words[starts[on] + k] * np.uint64(0xD6E8FEB86659FD93))
    return out, rows


def ranks(sizes: np.ndarray) -> np.ndarray:
    """0 .. size-1 for each size, one after the other."""
    total = int(sizes.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(sizes) - sizes, sizes)


def held_out(docs: DataFrame, folds: int, fold: int):
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``; false without a doc_id."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return F.coalesce(rest == fold, F.lit(False))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, component_id (smallest id reachable) for every id of ``edges``, by contraction.

    Each round every id points to its smallest neighbour, pointers are followed to their roots and
    edges are redrawn between roots; a round at least halves the ids of a component. Rounds are
    stored, minima are combined before the shuffle, joins have one row per id on one side. Null
    ends and loops are ignored; no edges give no rows.
    """
    known = None
    e = edges.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    )
    e = stored(e.distinct(), "edges")
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up"))
        up = stored(up.select("id", F.least("id", "up").alias("up")), "pointers")
        moved = True
        while moved:
            over = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = up.join(over, "up").select("id", F.col("top"), (F.col("top") != F.col("up")).alias("m"))
            jumped = stored(jumped, "pointers")
            moved = not jumped.where("m").isEmpty()
            up = jumped.select("id", F.col("top").alias("up"))
        ends = e.join(up.select(F.col("id").alias("a"), F.col("up").alias("x")), "a")
        ends = ends.join(up.select(F.col("id").alias("b"), F.col("up").alias("y")), "b")
        e = stored(
            ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        if known is None:
            known = up
        else:
            over = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            known = stored(
                known.join(over, "up", "left").select("id", F.coalesce("top", "up").alias("up")), "labels"
            )
    if known is None:
        return edges.sparkSession.createDataFrame([], "id bigint, component_id bigint")
    return known.select("id", F.col("up").alias("component_id"))

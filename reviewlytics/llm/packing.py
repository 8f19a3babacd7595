"""Packing of documents into fixed-length sequences by best-two-fit.

The plan is made on the histogram of piece lengths (at most ``limit`` rows, whatever the corpus):
a bin is filled greedily with the largest length that still fits, then its smallest piece gives way
to two unpacked ones if they fill the enlarged gap more tightly. A plan line is one filling and how
often it is repeated, so its size does not depend on the number of pieces either. Every piece then
finds its place from its rank within its length: ranks are counted per task and shifted by the
totals of earlier tasks, with no global sort and no group that has to be in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.llm.common import chunks, stored
from reviewlytics.llm.encoding import encoder, with_end

LIMIT = 2048
END_ID = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"


def best_two_fit(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(lengths of one bin, number of such bins), using every piece of the histogram once."""
    left = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = []
    lengths = np.arange(limit + 1)
    while left.any():
        left_now = left.copy()
        bin_, gap = [], limit
        while gap > 0:
            fit = np.flatnonzero(left_now[: gap + 1])
            if not len(fit):
                break
            largest = int(fit[-1])
            n = int(min(left_now[largest], gap // largest))
            bin_ += [largest] * n
            left_now[largest] -= n
            gap -= n * largest
        if gap > 0 and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            below = np.maximum.accumulate(np.where(left_now > 0, lengths, 0))
            first = np.flatnonzero(left_now[: room + 1])
            second = below[np.minimum(first, room - first)]
            # A length used for both needs two pieces.
            twice = (second == first) & (left_now[first] < 2)
            second[twice] = below[np.maximum(first[twice] - 1, 0)]
            second[second == 0] = -limit
            if len(first) and (first + second).max() > smallest:
                k = int(np.argmax(first + second))
                bin_ = bin_[:-1] + [int(first[k]), int(second[k])]
        need = Counter(bin_)
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
        plan.append((bin_, times))
    return plan


def _pieces(path: str, limit: int, end_id: int, with_ids: bool):
    def run(batches):
        ranks = np.zeros(limit + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch, data, offsets in chunks(batches, "text"):
            ids, before = with_end(*encoder(path).encode(data, offsets), end_id)
            raw = ids.astype("<u4").tobytes()
            size = np.diff(before)
            n = -(-size // limit)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * limit
            length = np.minimum(size[row] - start, limit)
            at = before[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            run_length = length[order]
            first = np.searchsorted(run_length, run_length, side="left")
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - first + ranks[run_length]
            ranks += np.bincount(length, minlength=limit + 1)
            out = {
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
                "task": pa.array(np.full(len(row), task, np.int32)),
                "rank": pa.array(rank),
            }
            if with_ids:
                cuts = pa.array(np.append(at, before[-1]).astype(np.int32))
                out["ids"] = pa.ListArray.from_arrays(cuts, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _places(plan: list[tuple[list[int], int]]):
    """Per length: first rank, first sequence and offset of each run of equal places."""
    places: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for bin_, times in plan:
        offset = 0
        for length in bin_:
            places.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in places.items()}


def pack(
    docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Every piece of every document and its place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and the ids themselves if asked for.

    A document is its token ids and ``end_id``; one longer than ``limit`` is cut into pieces of
    ``limit`` ids, the last may be shorter. Null and empty texts are the end id alone. Rows are
    packed one by one: repeated rows and null or repeated doc_ids each get a place of their own,
    equal lengths are told apart by the order in which tasks read them. Other columns are ignored.
    An empty table gives no rows.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    pieces = stored(pieces.mapInArrow(_pieces(path, limit, end_id, with_ids), schema), "pieces")
    counts = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(best_two_fit(histogram, limit))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))

    def place(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for v, rows in zip(values.tolist(), np.split(order, first[1:])):
                ranks, sequences, offsets = places[v]
                k = np.searchsorted(ranks, rank[rows], side="right") - 1
                sequence[rows] = sequences[k] + rank[rows] - ranks[k]
                offset[rows] = offsets[k]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in kept]
                + [pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = pieces.join(shift, ["task", "length"]).select(*names, (F.col("rank") + F.col("shift")).alias("rank"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*types, "sequence_id bigint", "offset bigint"]))

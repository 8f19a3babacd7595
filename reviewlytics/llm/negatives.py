"""Hard negatives by Four-Russians scoring.

Components are whole numbers, so a score is an exact inner product. A candidate is kept as the bits
of its components, plane by plane (two's complement), eight dimensions to a byte. For each group of
eight dimensions an anchor has a table of the 256 sums of subsets of its components: indexed by a
candidate's byte it gives what the plane of the group adds. The score is built from the highest plane,
which counts negative, down to the lowest: shift what there is by one bit, add the looked-up sums.

Anchors are a hundredth of the rows and meet all of them, in cells of at most about ``TILE`` candidates and
``BLOCK`` anchors, dealt by hashes of the rows, so no group grows with the data or with a key. Each cell returns
what can be among the first ``FIRST`` of an anchor; positives are settled before negatives are looked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlytics.llm.common import stored

TILE, BLOCK = 16384, 2048
#: Anchors and candidates that are scored at once.
_ANCHORS, _ROWS = 64, 2048
FIRST = 5
#: Squares of a row's components add up to less, so that every score fits a long.
_SQUARES = float(1 << 60)


def planes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of whole numbers (rows x dimensions): rows x planes x groups bytes, lowest plane first,
    and the planes that each row needs; more planes repeat its sign."""
    n, dim = q.shape
    groups = -(-dim // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :dim] = q
    most = np.maximum(wide, ~wide).max(axis=1, initial=0)
    need = np.ones(n, np.int64)
    for k in range(62):
        need += most >> k > 0
    out = np.empty((n, int(need.max(initial=1)), groups), np.uint8)
    for k in range(out.shape[1]):
        out[:, k] = np.packbits((wide >> k & 1).astype(np.uint8), axis=1, bitorder="little")
    return out, need


def numbers(bits: np.ndarray) -> np.ndarray:
    """The whole numbers (rows x 8 groups) of bits (rows x planes x groups)."""
    flat = np.unpackbits(bits, axis=2, bitorder="little").astype(np.int64)
    top = flat.shape[1] - 1
    weight = np.array([1 << k for k in range(top)] + [-(1 << top)], np.int64)
    return np.einsum("npd,p->nd", flat, weight)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: sums of the components that the bits of an index name."""
    n, dim = anchors.shape
    out = np.zeros((dim // 8, 256, n), anchors.dtype)
    for group in range(dim // 8):
        for bit in range(8):
            out[group, 1 << bit : 2 << bit] = out[group, : 1 << bit] + anchors[:, 8 * group + bit]
    return out


def scores(tables: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """candidates x anchors inner products from subset sums and bits (planes x groups x candidates)."""
    top, groups, n = bits.shape
    out = np.zeros((n, tables.shape[2]), tables.dtype)
    part = np.empty((min(n, _ROWS), tables.shape[2]), tables.dtype)
    for first in range(0, n, _ROWS):
        index = bits[:, :, first : first + _ROWS].astype(np.intp)
        own, added = out[first : first + _ROWS], part[: index.shape[2]]
        for k in range(top - 1, -1, -1):
            own <<= 1
            for group in range(groups):
                np.take(tables[group], index[k, group], axis=0, out=added, mode="clip")
                own += added
            if k == top - 1:
                np.negative(own, out=own)
    return out


def _packed(batches):
    for batch in batches:
        lists = batch.column("q")
        for dim in np.unique(batch.column("dim").to_numpy()).tolist():
            of_dim = np.flatnonzero(batch.column("dim").to_numpy() == dim)
            step = max(1, (1 << 18) // max(dim, 1))
            for first in range(0, len(of_dim), step):
                rows = pa.array(of_dim[first : first + step])
                part = lists.take(rows)
                q = part.flatten().to_numpy().reshape(len(part), dim)
                bits, need = planes(q)
                raw = [bits[k, :b].tobytes() for k, b in enumerate(need.tolist())]
                out = {c: batch.column(c).take(rows) for c in ("vec_id", "label", "dim")}
                yield pa.RecordBatch.from_pydict(out | {"planes": pa.array(need), "bits": pa.array(raw, pa.binary())})


def _bits(raw: list[bytes], need: np.ndarray, groups: int) -> np.ndarray:
    """rows x planes x groups, the sign repeated up to the most planes of a row."""
    out = np.empty((len(raw), int(need.max(initial=1)), groups), np.uint8)
    for b in np.unique(need).tolist():
        rows = np.flatnonzero(need == b)
        own = np.frombuffer(b"".join([raw[k] for k in rows.tolist()]), np.uint8).reshape(len(rows), b, groups)
        out[rows, :b] = own
        out[rows, b:] = own[:, -1:]
    return out


def _blocks(cell: pa.Table):
    """For each dimension of a cell, for some anchors at a time: rows of the candidates (by label, then
    vec_id), rows of the anchors, and candidates x anchors scores."""
    dims, need = cell.column("dim").to_numpy(), cell.column("planes").to_numpy()
    looks, label, ids = (cell.column(c).to_numpy() for c in ("looks", "label", "vec_id"))
    raw = cell.column("bits").to_pylist()
    for dim in np.unique(dims).tolist():
        groups = -(-dim // 8)
        asks = np.flatnonzero((dims == dim) & looks)
        found = np.flatnonzero((dims == dim) & ~looks)
        if not len(asks) or not len(found):
            continue
        found = found[np.lexsort((ids[found], label[found]))]
        bits = _bits([raw[k] for k in found.tolist()], need[found], groups)
        bits = np.ascontiguousarray(bits.transpose(1, 2, 0))
        anchors = numbers(_bits([raw[k] for k in asks.tolist()], need[asks], groups))
        longest = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        small = longest * 2.0 ** (bits.shape[0] - 1) * np.sqrt(dim) < 1 << 30
        anchors = anchors.astype(np.int32 if small else np.int64)
        for first in range(0, len(asks), _ANCHORS):
            yield found, asks[first : first + _ANCHORS], scores(subset_sums(anchors[first : first + _ANCHORS]), bits)


def _leading(score: np.ndarray, ids: np.ndarray, first: int) -> np.ndarray:
    """Places of the first by score, ties by smaller id."""
    if len(score) > first:
        at = np.flatnonzero(score >= np.partition(score, -first)[-first])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:first]


def _positives(first: int):
    def run(key, cell):
        label, ids, row = (cell.column(c).to_numpy() for c in ("label", "vec_id", "row"))
        out: list[tuple[int, int, int]] = []
        for found, asks, score in _blocks(cell):
            bounds = label[found]
            for j, a in enumerate(asks.tolist()):
                lo, hi = np.searchsorted(bounds, label[a]), np.searchsorted(bounds, label[a], side="right")
                same = found[lo:hi]
                own = np.flatnonzero(row[same] != row[a])
                at = own[_leading(score[lo:hi, j][own], ids[same][own], first)]
                out += [(row[a], ids[same[k]], score[lo + k, j]) for k in at.tolist()]
        anchor, other, value = zip(*out) if out else ((), (), ())
        return pa.table(
            {"anchor": pa.array(anchor, pa.int64()), "other": pa.array(other, pa.int64()), "score": pa.array(value, pa.int64())}
        )

    return run


def _negatives(first: int, least: int, most: int):
    def run(key, cell):
        label, ids, row = (cell.column(c).to_numpy() for c in ("label", "vec_id", "row"))
        wanted = cell.column("wanted").to_pylist()
        out: list[tuple[int, int, int, int]] = []
        for found, asks, score in _blocks(cell):
            for j, a in enumerate(asks.tolist()):
                differs = np.flatnonzero(label[found] != label[a])
                value = score[differs, j].astype(np.int64)
                for p in wanted[a]:
                    # least * p <= 100 * value <= most * p, in whole numbers of any size
                    low, high = -(-least * p // 100), most * p // 100
                    if low > high:
                        continue
                    near = np.flatnonzero((value >= low) & (value <= high))
                    for k in near[_leading(value[near], ids[found[differs[near]]], first)].tolist():
                        out.append((row[a], p, ids[found[differs[k]]], value[k]))
        anchor, positive, other, value = zip(*out) if out else ((), (), (), ())
        return pa.table(
            {
                "anchor": pa.array(anchor, pa.int64()), "positive_score": pa.array(positive, pa.int64()),
                "other": pa.array(other, pa.int64()), "score": pa.array(value, pa.int64()),
            }
        )

    return run


def quantised(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, dim, planes, bits of the rows that take part; see ``hard_negatives``."""
    x = F.col("embedding")
    given = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), x.cast("array<double>"))
    given = given.where("vec_id is not null and label is not null and embedding is not null")
    given = given.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    whole = given.withColumn("q", F.expr("transform(embedding, x -> floor(256 * x))"))
    squares = F.expr("aggregate(embedding, 0D, (s, x) -> s + pow(floor(256 * x), 2))")
    whole = whole.where(squares < _SQUARES).select("vec_id", "label", F.size("q").alias("dim"), "q")
    bits = whole.mapInArrow(_packed, "vec_id bigint, label bigint, dim int, planes bigint, bits binary")
    return bits.select(F.monotonically_increasing_id().alias("row"), "*")


def hard_negatives(
    vectors: DataFrame, anchors: str = "vec_id % 100 = 0", first: int = FIRST, least: int = 80, most: int = 100
) -> DataFrame:
    """Hard negatives of every row of ``vectors`` (vec_id, label, embedding) that ``anchors`` names:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(256 * x). A score is the inner product with the anchor; higher
    ones come first, ties by smaller vec_id. Positives are the first ``first`` other rows of the anchor's label;
    for each, the first ``first`` rows of other labels are returned whose score s satisfies
    least * p <= 100 * s <= most * p, p being the positive's score. Where there are fewer, all are.

    Rows take no part if vec_id, label or embedding is null, if a component is null or not finite, or if the
    squares of the whole numbers reach 2^60. Rows of different dimensions never meet. Every row counts, so a
    repeated row is another row of its vec_id, and a repeated anchor returns its rows again. Other columns
    are ignored; an empty table gives no rows. All scores are computed; nothing is sampled or cut off.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors), "packed")
    asks = stored(rows.where(anchors), "anchors")
    n, m = rows.count(), asks.count()
    # Smaller cells while there are fewer than cores to work on them.
    tiles = max(-(-n // TILE), min(-(-n // 1024), 2 * spark.sparkContext.defaultParallelism), 1)
    blocks = max(-(-m // BLOCK), 1)
    columns = ["row", "vec_id", "label", "dim", "planes", "bits"]
    hashed = F.xxhash64("row")
    none = F.lit(None).cast("array<bigint>")
    found = rows.select(
        F.pmod(hashed, F.lit(tiles).cast("bigint")).alias("tile"),
        F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"),
        F.lit(False).alias("looks"), *columns, none.alias("wanted"),
    )

    def cells(asking: DataFrame, wanted):
        own = asking.select(
            F.explode(F.expr(f"sequence(0L, {tiles - 1}L)")).alias("tile"),
            F.pmod(hashed, F.lit(blocks).cast("bigint")).alias("block"), F.lit(True).alias("looks"), *columns,
            wanted.alias("wanted"),
        )
        return found.unionByName(own).groupBy("tile", "block")

    scored = cells(asks, none).applyInArrow(_positives(first), "anchor bigint, other bigint, score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    positives = scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= first)
    positives = stored(positives.select("anchor", "k", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = positives.groupBy("anchor").agg(F.collect_set("positive_score").alias("wanted"))
    asking = asks.join(wanted.withColumnRenamed("anchor", "row"), "row")
    scored = cells(asking, F.col("wanted")).applyInArrow(
        _negatives(first, least, most), "anchor bigint, positive_score bigint, other bigint, score bigint"
    )
    order = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "other")
    negatives = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    pairs = positives.join(negatives, ["anchor", "positive_score"])
    return pairs.join(asks.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """``vectors`` where every label of a vec_id divisible by 7 has moved on by one, of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")

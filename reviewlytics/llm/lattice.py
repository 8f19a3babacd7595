"""Near-duplicate vectors by lattice hashing.

Each table projects a unit vector on ``BLOCKS`` times eight random directions, scales it and takes
the nearest points of the E8 lattice; they name its cell. A vector lives in one cell per table and
looks into ``PROBES`` more: those that a step to the nearest other lattice point in one block
leads to. Of a pair the smaller id looks and the larger is found, so a table shows a pair once;
a pair counts in the first table that shows it, which both vectors tell, so no list of pairs is
made: tasks return counts of links and the links of a spanning forest.

Equal vectors are one class and are compared once. A cell is worked on in tiles of at most
``TILE`` lookers and ``TILE`` residents, so no task gathers a cell without bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.common import components, mix64, stored

TABLES, BLOCKS, PROBES = 16, 2, 8
SCALE = 0.56
THRESHOLD = 0.9
TILE = 2048


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for k in range(256):
        v = np.array([0.5 if k >> i & 1 else -0.5 for i in range(8)])
        if bin(k).count("1") % 2 == 0:
            out.append(v)
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=-1) % 2)
    if len(odd):
        off = x[odd] - r[odd]
        worst = np.abs(off).argmax(axis=-1)
        k = np.arange(len(odd))
        r[odd, worst] += np.where(off[k, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 (rows of eight)."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=-1) < ((x - a) ** 2).sum(axis=-1)
    return np.where(closer[:, None], b, a)


def directions(dim: int, tables: int, blocks: int) -> np.ndarray:
    """tables x blocks x dim x 8 projections, the same everywhere."""
    return np.random.default_rng(4).standard_normal((tables, blocks, dim, 8))


_STEPS = minimal_vectors()
_CODE = np.random.default_rng(8).integers(1, 1 << 62, (64, 8), dtype=np.int64) | 1


def _point_hash(points: np.ndarray, block: int) -> np.ndarray:
    """Additive hash of lattice points, so a step only adds the hash of the step."""
    return (np.rint(2 * points).astype(np.int64) * _CODE[block]).sum(axis=-1)


def cells(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE):
    """Keys of each vector: n x tables x (1 + probes), its own cell first."""
    n, dim = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.int64)
    grid = directions(dim, tables, blocks)
    for t in range(tables):
        own = np.full(n, t + 1, np.int64)
        gains, moves = [], []
        for b in range(blocks):
            y = scale * (unit @ grid[t, b])
            point = nearest_e8(y)
            own += _point_hash(point, b)
            gain = (y - point) @ _STEPS.T
            best = np.argpartition(-gain, min(probes, 239), axis=1)[:, :probes]
            gains.append(np.take_along_axis(gain, best, axis=1))
            moves.append(_point_hash(_STEPS, b)[best])
        gain, move = np.concatenate(gains, axis=1), np.concatenate(moves, axis=1)
        order = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        keys = np.concatenate([own[:, None], own[:, None] + np.take_along_axis(move, order, axis=1)], axis=1)
        out[:, t] = mix64(keys.view(np.uint64) + np.uint64(t)).view(np.int64)
    return out


def _vectors(batches):
    """vec_id, and the vector as doubles: null where it cannot be compared."""
    for batch in batches:
        column = batch.column("embedding").cast(pa.large_list(pa.float64()))
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        values = flat.fill_null(0.0).to_numpy()
        ends = np.cumsum(np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes))
        out, at = [], 0
        for end in ends.tolist():
            v = values[at:end]
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((v * v).sum()) if len(v) else 0.0
            fine = len(v) and not bad[at:end].any() and np.isfinite(norm) and norm > 0
            out.append((v + 0.0).tobytes() if fine else None)
            at = end
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "raw": pa.array(out, pa.binary())})


def _unit(raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (rows, unit vectors)."""
    sizes = np.array([len(r) // 8 for r in raw])
    out = {}
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        x = np.frombuffer(b"".join(raw[k] for k in rows.tolist()), np.float64).reshape(len(rows), dim)
        out[dim] = rows, x / np.sqrt((x * x).sum(axis=1))[:, None]
    return out


def _keys(raw: list[bytes], shape: tuple[int, int, int, float]) -> np.ndarray:
    out = np.zeros((len(raw), shape[0], 1 + shape[2]), np.int64)
    for dim, (rows, unit) in _unit(raw).items():
        out[rows] = cells(unit, *shape) + dim
    return out


def _placed(shape):
    tables, _, probes, _ = shape

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                keys = _keys(part.column("raw").to_pylist(), shape)
                n = len(keys)
                c = part.column("c").to_numpy()
                size = 2 + probes
                both = np.concatenate([keys[:, :, :1], keys], axis=2)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(both.reshape(-1)),
                        "t": pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), size), n)),
                        "c": pa.array(np.repeat(c, tables * size)),
                        "looks": pa.array(np.tile(np.arange(size) > 0, n * tables)),
                    }
                )

    return run


def _tile_groups(batches):
    """Tables of complete tiles, several at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def ids(x):
        return np.stack([x.column(n).to_numpy() for n in ("key", "t", "rb", "qb")])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < 4 * TILE:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        same = (ids(whole) == ids(whole)[:, -1:]).all(axis=0)
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield whole.slice(0, cut).combine_chunks()
        held = whole.slice(cut).combine_chunks().to_batches()
        rows = len(whole) - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _within(sizes_a: np.ndarray, sizes_b: np.ndarray, begin_a: np.ndarray, begin_b: np.ndarray, most: int = 1 << 20):
    """Positions of all pairs of small groups, up to about ``most`` at once."""
    pairs = sizes_a * sizes_b
    total = np.cumsum(pairs)
    first = 0
    while first < len(pairs):
        base = total[first - 1] if first else 0
        last = max(int(np.searchsorted(total, base + most, side="right")), first + 1)
        n = pairs[first:last]
        group = np.repeat(np.arange(first, last), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield begin_a[group] + k // sizes_b[group], begin_b[group] + k % sizes_b[group]
        first = last


def _compared(threshold: float, shape):
    def run(batches):
        for whole in _tile_groups(batches):
            ids = np.stack([whole.column(n).to_numpy() for n in ("key", "t", "rb", "qb")])
            looks = whole.column("looks").to_numpy()
            c_all, n_all, t_all = (whole.column(n).to_numpy() for n in ("c", "n", "t"))
            c, row = np.unique(c_all, return_index=True)
            at = np.searchsorted(c, c_all)
            weight = n_all[row]
            raw = whole.column("raw").take(pa.array(row)).to_pylist()
            by_dim = _unit(raw)
            place = np.zeros(len(c), np.int64)
            dims = np.zeros(len(c), np.int64)
            for dim, (rows, _) in by_dim.items():
                place[rows], dims[rows] = np.arange(len(rows)), dim
            cuts = np.append(np.flatnonzero(np.append(True, (ids[:, 1:] != ids[:, :-1]).any(axis=0))), len(looks))
            # Residents come first in a tile (looks is sorted last).
            residents = np.add.reduceat((~looks).astype(np.int64), cuts[:-1])
            sizes = np.diff(cuts)
            found = []
            for q, r in _within(sizes - residents, residents, cuts[:-1] + residents, cuts[:-1]):
                a, b = at[q], at[r]
                once = (c[a] < c[b]) & (dims[a] == dims[b])
                a, b, t = a[once], b[once], t_all[q[once]]
                for dim, (_, unit) in by_dim.items():
                    for k in range(0, len(a), 1 << 16):
                        part = slice(k, k + (1 << 16))
                        on = np.flatnonzero(dims[a[part]] == dim) + k
                        cos = np.einsum("ij,ij->i", unit[place[a[on]]], unit[place[b[on]]])
                        on = on[cos >= threshold]
                        found.append(np.stack([a[on], b[on], t[on]]))
            if not found:
                continue
            a, b, t = np.concatenate(found, axis=1)
            if not len(a):
                continue
            used = np.unique(np.append(a, b))
            keys = _keys([raw[k] for k in used.tolist()], shape)
            x, y = np.searchsorted(used, a), np.searchsorted(used, b)
            first = np.full(len(a), -1)
            for table in range(shape[0]):
                open_ = np.flatnonzero(first < 0)
                if not len(open_):
                    break
                for k in range(0, len(open_), 1 << 16):
                    on = open_[k : k + (1 << 16)]
                    hit = (keys[x[on], table] == keys[y[on], table, :1]).any(axis=1)
                    first[on[hit]] = table
            own = first == t
            links = np.zeros(len(used), np.int64)
            np.add.at(links, x[own], weight[b[own]])
            np.add.at(links, y[own], weight[a[own]])
            label = np.arange(len(used))
            while True:
                low = np.minimum(label[x], label[y])
                new = label.copy()
                np.minimum.at(new, x, low)
                np.minimum.at(new, y, low)
                np.minimum.at(new, label[x], low)
                np.minimum.at(new, label[y], low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            yield pa.RecordBatch.from_pydict(
                {"c": pa.array(c[used]), "links": pa.array(links), "root": pa.array(c[used][label])}
            )

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, blocks: int = BLOCKS,
    probes: int = PROBES, scale: float = SCALE,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Two vectors of one dimension are linked at a cosine (in doubles) >= threshold, as far as a
    table shows them; none below it. n_links counts the other rows linked directly, equal rows
    among them; component_id is the smallest vec_id reachable. Null and zero vectors, vectors with
    null or non-finite components, and rows without vec_id link with nothing; the latter have no
    component and are kept. Other columns are ignored; an empty table gives no rows.
    """
    shape = (tables, blocks, probes, scale)
    given = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    rows = given.mapInArrow(_vectors, "vec_id bigint, raw binary")
    known = F.when(F.col("vec_id").isNotNull(), F.xxhash64("raw"))
    rows = stored(rows.select("vec_id", "raw", F.when(F.col("raw").isNotNull(), known).alias("c")), "vectors")
    classes = rows.where("c is not null").groupBy("c")
    classes = stored(
        classes.agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"), F.first("raw").alias("raw")), "classes"
    )
    placed = classes.select("c", "raw").mapInArrow(_placed(shape), "key bigint, t int, c bigint, looks boolean")
    sizes = placed.groupBy("key", "t").agg(
        F.count(F.lit(1)).alias("all"), F.sum(F.col("looks").cast("bigint")).alias("q")
    )
    sizes = sizes.where("q > 1 and all > q").select(
        "key", "t", F.ceil((F.col("all") - F.col("q")) / TILE).alias("rt"), F.ceil(F.col("q") / TILE).alias("qt")
    )
    # Stored first, so that the join reads plain shuffles on both sides and a hot cell can be split.
    sizes = stored(sizes, "sizes")
    active = stored(placed.join(sizes.hint("merge"), ["key", "t"]), "cells")
    own = F.pmod(F.xxhash64("c", F.lit(1)), F.when(F.col("looks"), F.col("qt")).otherwise(F.col("rt")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("looks"), F.col("rt")).otherwise(F.col("qt")) - 1))
    tiles = active.select("key", "t", "c", "looks", own.alias("own"), other.alias("other"))
    tiles = tiles.select(
        "key", "t", "c", "looks",
        F.when(F.col("looks"), F.col("other")).otherwise(F.col("own")).cast("bigint").alias("rb"),
        F.when(F.col("looks"), F.col("own")).otherwise(F.col("other")).cast("bigint").alias("qb"),
    )
    tiles = tiles.join(classes.select("c", "n", "raw"), "c").repartition("key", "t", "rb", "qb")
    tiles = tiles.sortWithinPartitions("key", "t", "rb", "qb", "looks")
    found = stored(tiles.mapInArrow(_compared(threshold, shape), "c bigint, links bigint, root bigint"), "found")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(found.select("c", "root"), "c", "root").withColumnRenamed("id", "c")
    members = classes.select("c", "n", "rep").join(links, "c", "left").join(groups, "c", "left")
    # Ids of classes are hashes: the component's name is the least vec_id of its classes.
    members = stored(
        members.select(
            "c", "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "c").alias("root"),
        ),
        "members",
    )
    names = members.groupBy("root").agg(F.min("rep").alias("component"))
    members = members.join(names, "root").select("c", "n_links", "component")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return rows.select("vec_id", "c").join(members, "c", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )

"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification.

Documents with equal shingle sets are one class, found by the hash of the sorted set; only classes
are compared. A class stands in one bucket per band. Pairs of a bucket are candidates; their
signatures are compared batch by batch, and a pair is given up as soon as the posterior probability
that its similarity reaches the threshold falls below a bound. Survivors are verified on full sets.

Only connected groups are asked for, so no bucket is turned into all its pairs:

* buckets of at most ``SMALL`` classes give all pairs, a constant number per class;
* a larger bucket links its members to a few centres; where that leaves members outside the main
  group of the bucket, such members meet all others in blocks and are verified within the task,
  however many they are;
* signatures, sets and texts are joined by merging at every size, so that small inputs run the plan
  of large ones;
* of a class's surviving pairs the most promising is verified first, and others only where their
  ends are not connected by then.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.common import (
    chunks, components, lower_ascii, mix64, prefix_hashes, shingle_hashes, span_hashes, stored, word_spans,
)

BANDS, ROWS = 24, 5
WIDTH = 5
THRESHOLD = 80
MISS = 1e-3
SMALL = 8
CENTRES = 3
FEW = 64
#: A task holds about HELD * FEW members of a bucket while others pass.
HELD = 16
SHARE = 4096
BATCH = 20
_SEED = np.random.default_rng(9).integers(1, 1 << 63, (2, 1024), dtype=np.uint64)


def row_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row's words, lower-cased A-Z."""
    data = lower_ascii(data)
    begin, end, counts = word_spans(data, offsets)
    words = span_hashes(prefix_hashes(data), begin, end)
    hashes, rows = shingle_hashes(words, counts, width)
    cuts = np.searchsorted(rows, np.arange(len(offsets)))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima (32 bits) of each set; zeros for empty sets."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), n), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        values = np.concatenate(sets)
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(n):
            hashed = values * (_SEED[0, k] | np.uint64(1)) + _SEED[1, k]
            out[full, k] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
    return out


def _sign(width: int, n: int):
    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            sets = row_sets(data, offsets, width)
            sig = signatures(sets, n)
            prints = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(batch.schema.get_field_index("doc_id")),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "print": pa.array(prints, pa.binary()),
                    "sig": pa.array([s.tobytes() for s in sig], pa.binary()),
                }
            )

    return run


def _matrix(column) -> np.ndarray:
    """Signatures of a binary column as rows."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint32).reshape(len(column), -1)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(7), parts.shape[:2])
    for k in range(rows):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key.astype(np.int64)


def _banded(bands: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column("sig")), bands)
                rep = np.repeat(batch.column("rep").to_numpy(), bands)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.reshape(-1)), "rep": pa.array(rep)})

    return run


def least_matches(n: int, threshold: float, miss: float) -> list[int]:
    """Per batch end: the least number of equal minima at which, from a uniform prior, similarity
    >= threshold still has a posterior probability of miss / batches or more."""
    ends = range(BATCH, n + 1, BATCH)
    out = []
    for compared in ends:
        total, m = 0.0, -1
        while total < miss / len(ends):
            m += 1
            total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        out.append(m)
    return out


def _prune(n: int, threshold: float, miss: float):
    least = least_matches(n, threshold, miss)

    def run(batches):
        for batch in batches:
            left = np.arange(batch.num_rows)
            if len(left):
                a, b = _matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))
                equal = np.zeros(len(left), np.int64)
                for k, m in enumerate(least):
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    equal[left] += (a[left, at] == b[left, at]).sum(axis=1)
                    left = left[equal[left] >= m]
                yield pa.RecordBatch.from_pydict(
                    {
                        "a": batch.column("a").take(pa.array(left)),
                        "b": batch.column("b").take(pa.array(left)),
                        "equal": pa.array(equal[left]),
                    }
                )

    return run


def _sets(width: int):
    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            sets = row_sets(data, offsets, width)
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "set": pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())}
            )

    return run


def _exact(threshold: int):
    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").take(rows), "b": batch.column("b").take(rows)})

    return run


class _Verifier:
    def __init__(self, docs, reps, width: int, n: int, threshold: int, miss: float):
        self.docs, self.reps = docs, reps
        self.width, self.n, self.threshold, self.miss = width, n, threshold, miss

    def links(self, candidates: DataFrame) -> DataFrame:
        """Candidate pairs (a, b) that are confirmed, as far as they join separate groups."""
        left = self.reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
        right = self.reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
        pairs = candidates.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sig_a", "sig_b")
        prune = _prune(self.n, self.threshold / 100, self.miss)
        found = stored(pairs.mapInArrow(prune, "a bigint, b bigint, equal bigint"), "survivors")
        ids = found.select(F.col("a").alias("id")).union(found.select("b")).distinct()
        texts = self.docs.select(F.col("doc_id").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
        texts = texts.dropDuplicates(["id"])
        sets = stored(texts.mapInArrow(_sets(self.width), "id bigint, set binary"), "sets")
        best = found.groupBy("b").agg(F.max_by("a", "equal").alias("a")).select("a", "b")
        first = stored(self._confirmed(best, sets), "links")
        groups = components(first, "a", "b")
        own = lambda c: groups.select(F.col("id").alias(c), F.col("component_id").alias(f"{c}_in"))
        rest = found.join(own("a"), "a", "left").join(own("b"), "b", "left")
        apart = F.coalesce("a_in", "a") != F.coalesce("b_in", "b")
        rest = stored(self._confirmed(rest.where(apart).select("a", "b"), sets), "links")
        return first.unionByName(rest)

    def _confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
        right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "set_a", "set_b")
        return both.mapInArrow(_exact(self.threshold), "a bigint, b bigint")


def _all_pairs(members: DataFrame) -> DataFrame:
    a = members.select("key", F.col("rep").alias("a"))
    b = members.select("key", F.col("rep").alias("b"))
    return a.join(b, "key").where("a < b").select("a", "b")


def _centre_pairs(members: DataFrame) -> DataFrame:
    """Members against the bucket's centres, chosen by hashes of the ids."""
    picks = [F.min(F.struct(F.xxhash64("rep", F.lit(k)), F.col("rep"))).alias(f"c{k}") for k in range(CENTRES)]
    centres = members.groupBy("key").agg(*picks)
    centres = centres.select("key", F.explode(F.array(*[F.col(f"c{k}.rep") for k in range(CENTRES)])).alias("c"))
    pairs = members.join(centres.distinct(), "key").where("rep != c")
    return pairs.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b"))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a document's set are its distinct
    ``width``-word shingles, with fewer words the whole sequence as one. Documents are linked at
    100 * intersection >= threshold * union. Null and empty texts and texts without words have
    empty sets and link with nothing. Repeated
    rows are one document; rows of one doc_id with different texts are found by
    all of them, and one of the texts is the one that links are confirmed on; a row without doc_id links with nothing, has no component and is kept.
    Other columns are ignored; an empty table gives no rows. Links found are exact; a pair at the
    very threshold is missed with a probability of about ``miss``.
    """
    n = bands * rows
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    base = stored(
        docs.mapInArrow(_sign(width, n), "doc_id bigint, n_shingles bigint, print binary, sig binary"), "signatures"
    )
    classes = base.where("print is not null and doc_id is not null").groupBy("print")
    classes = stored(classes.agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    reps = classes.select("rep", "sig")
    banded = reps.mapInArrow(_banded(bands), "key bigint, rep bigint")
    # Stored first, so that the join reads plain shuffles on both sides and a hot bucket can be split.
    sizes = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    members = stored(banded.join(sizes.hint("merge"), "key"), "buckets")
    verifier = _Verifier(docs, reps, width, n, threshold, miss)
    large = members.where(F.col("n") > SMALL)
    candidates = _all_pairs(members.where(F.col("n") <= SMALL)).union(_centre_pairs(large)).distinct()
    links = verifier.links(candidates)
    groups = components(links, "a", "b")
    if not large.isEmpty():
        open_ = _open_members(large, groups)
        if not open_.isEmpty():
            late = stored(_late_links(docs, open_, reps, width, n, threshold, miss), "links")
            groups = components(links.unionByName(late), "a", "b")
    by_class = classes.select("print", "rep").join(
        groups.select(F.col("id").alias("rep"), "component_id"), "rep", "left"
    )
    by_class = by_class.select("print", F.coalesce("component_id", "rep").alias("of_class"))
    out = base.drop("sig").join(by_class, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _open_members(large: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of large buckets that hold more than one group after the first round: key, rep, comp,
    main (the bucket's main group), outside (members beside it), n."""
    known = groups.select(F.col("id").alias("rep"), "component_id")
    placed = large.join(known, "rep", "left")
    placed = stored(placed.select("key", "rep", "n", F.coalesce("component_id", "rep").alias("comp")), "placed")
    counts = placed.groupBy("key", "n", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("key", "n").agg(F.max(F.struct("m", "comp")).alias("top"))
    main = main.select("key", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.m")).alias("outside"))
    placed = placed.join(stored(main.where("outside > 0"), "main"), "key")
    return stored(placed.select("key", "rep", "comp", "main", "outside", "n"), "open")


def _late_links(docs: DataFrame, open_: DataFrame, reps: DataFrame, width: int, n: int, threshold: int, miss: float):
    """Links between groups that still share a bucket. Members outside the main group, in blocks of
    about ``HELD * FEW``, meet all members, in shares of about ``SHARE``; both are dealt to tasks by bucket,
    block and share, so a task holds one block and lets members pass. Pairs are pruned and verified
    there and then, and those of groups that a task has joined are skipped."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    texts = texts.join(open_.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    texts = texts.dropDuplicates(["id"])
    sets = stored(texts.mapInArrow(_sets(width), "id bigint, set binary"), "sets").withColumnRenamed("id", "rep")
    blocks, shares = F.ceil(F.col("outside") / (HELD * FEW)), F.ceil(F.col("n") / SHARE)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))
    own_block, own_share = F.pmod(F.xxhash64("rep"), blocks), F.pmod(F.xxhash64("rep", F.lit(1)), shares)
    fixed = open_.where("comp != main").select(
        "key", "rep", "comp", own_block.alias("block"), every(shares).alias("share"), F.lit(False).alias("passing")
    )
    passing = open_.select(
        "key", "rep", "comp", every(blocks).alias("block"), own_share.alias("share"), F.lit(True).alias("passing")
    )
    rows = fixed.unionByName(passing).join(sets.hint("merge"), "rep").join(reps.hint("merge"), "rep")
    rows = rows.select("key", "block", "share", "passing", "rep", "comp", "set", "sig")
    rows = rows.repartition("key", "block", "share").sortWithinPartitions("key", "block", "share", "passing")
    return rows.mapInArrow(_meet(n, threshold, miss), "a bigint, b bigint")


def _meet(n: int, threshold: int, miss: float):
    least = least_matches(n, threshold / 100, miss)

    def run(batches):
        place, held, sig, up = None, [], None, {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for batch in batches:
            found = []
            columns = {c: batch.column(c) for c in batch.schema.names}
            where = list(zip(*(columns[c].to_pylist() for c in ("key", "block", "share"))))
            passing, reps_, comps = (columns[c].to_pylist() for c in ("passing", "rep", "comp"))
            mine = _matrix(columns["sig"]) if batch.num_rows else None
            for k in range(batch.num_rows):
                if where[k] != place:
                    place, held, sig, up = where[k], [], None, {}
                if not passing[k]:
                    held.append((reps_[k], comps[k], columns["set"][k].as_buffer().to_pybytes(), mine[k]))
                    continue
                if sig is None:
                    sig = np.stack([h[3] for h in held]) if held else np.zeros((0, n), np.uint32)
                left = np.arange(len(held))
                equal = np.zeros(len(held), np.int64)
                for t, m in enumerate(least):
                    part = slice(t * BATCH, (t + 1) * BATCH)
                    equal[left] += (sig[left, part] == mine[k, part]).sum(axis=1)
                    left = left[equal[left] >= m]
                own = None
                for j in left[np.argsort(-equal[left], kind="stable")].tolist():
                    rep, comp, other, _ = held[j]
                    if root(comp) == root(comps[k]):
                        continue
                    if own is None:
                        own = np.frombuffer(columns["set"][k].as_buffer(), np.uint64)
                    x = np.frombuffer(other, np.uint64)
                    both = len(np.intersect1d(x, own, assume_unique=True))
                    if 100 * both >= threshold * (len(x) + len(own) - both):
                        up[root(comp)] = root(comps[k])
                        found.append((min(rep, reps_[k]), max(rep, reps_[k])))
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run

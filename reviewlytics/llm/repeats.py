"""Repeated byte strings: a common-prefix interval tree over a sparse, enhanced suffix array.

A string of ``length`` bytes is looked at from its anchor, the place of the least hash among its
``GRAM``-byte pieces (leftmost of equals). Equal strings have their anchors at the same place, so
only suffixes that begin at anchors have to be sorted, about one in 75 bytes, and only those whose
first ``GRAM`` bytes occur twice. The consecutive strings with one anchor form its context.

* Contexts that occur twice as a whole repeat in full; they need no comparison.
* The other contexts of a gram are sorted by what follows the anchor. A stack scan of their common
  prefixes gives the interval tree: each interval is a set of suffixes with ``l`` bytes in common.
  Its members are sorted by what precedes the anchor, read backwards. Where the bytes to the left
  differ, a common left part of ``e`` bytes ends, and the members that share it are all occurrences
  of a repeat of e + l bytes. It counts from ``length`` bytes on, and unless one child of the
  interval holds all its members, in which case it extends to the right.

``remove_repeats`` needs the covered bytes only: it scans the tree for the longest left part of each
member, without the tests for maximal groups, which ``repeat_groups`` makes.

A repeat much longer than ``length`` appears as overlapping repeats around each of its anchors.
Grams with more than ``HOT`` different contexts are not gathered in one task. For the removed bytes
their strings are counted by hashes, which tells the same strings. For the groups the suffixes at
which a repeat can begin are sorted and scanned in ranges with a common beginning; a range of more
than ``HOT`` suffixes is split at the first byte in which they differ.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlytics.llm.common import chunks, discard, mix64, powers, INVERSE, prefix_hashes, ranks, span_hashes, stored

LENGTH = 200
GRAM = 50
HOT = 1 << 16
ANCHORS = "doc_id bigint, h bigint, at int, span int, back int, gram bigint, ctx bigint"
_HIGH = np.uint64(0xFFFFFFFF00000000)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """row, first string, last string - first, anchor - first, gram and context hash of each anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hashes(data)
    n = len(data) - gram + 1
    grams = mix64((prefix[gram:] - prefix[:n]) * powers(INVERSE, len(prefix))[:n])
    least = sliding_least((grams & _HIGH) | np.arange(n, dtype=np.uint64), length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    row_of = np.repeat(np.arange(len(size)), np.maximum(size - length + 1, 0))
    if not len(row_of):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sizes = np.maximum(size - length + 1, 0)
    starts = np.arange(len(row_of)) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    own = anchor[starts]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (row_of[1:] != row_of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    lo, hi, a = starts[first], starts[last], own[first]
    context = span_hashes(prefix, lo, hi + length) ^ mix64(((a - lo) * 4096 + hi - lo).astype(np.uint64))
    return row_of[first], lo, hi - lo, a - lo, grams[a], context


def _anchors(length: int, gram: int):
    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            row, lo, span, back, grams, context = anchors(data, offsets, length, gram)
            rows = pa.array(row)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(rows),
                    "h": batch.column("h").take(rows),
                    "at": pa.array((lo - offsets[row]).astype(np.int32)),
                    "span": pa.array(span.astype(np.int32)),
                    "back": pa.array(back.astype(np.int32)),
                    "gram": pa.array(grams.view(np.int64)),
                    "ctx": pa.array(context.view(np.int64)),
                }
            )

    return run


def _contents(length: int):
    """Bytes of the contexts that are listed per document."""

    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            raw = data.tobytes()
            wanted = batch.column("wanted")
            items = wanted.flatten()
            sizes = np.diff(wanted.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            at, span = items.field("at").to_numpy(), items.field("span").to_numpy()
            begin = offsets[row] + at
            texts = [raw[b : b + s] for b, s in zip(begin.tolist(), (span + length).tolist())]
            rows = pa.array(row)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(rows),
                    "h": batch.column("h").take(rows),
                    "at": items.field("at"),
                    "span": items.field("span"),
                    "back": items.field("back"),
                    "gram": items.field("gram"),
                    "ctx": items.field("ctx"),
                    "n": items.field("n"),
                    "bytes": pa.array(texts, pa.binary()),
                }
            )

    return run


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the next."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def intervals(common: list[int]):
    """Nodes of the interval tree over sorted suffixes with common[i] between i and i + 1, children
    before parents: common length, first, last and the firsts of its children (leaves included)."""
    stack: list[list] = []  # [length, first, firsts of children]
    for i in range(len(common) + 1):
        now = common[i] if i < len(common) else -1
        left, child = i, i
        while stack and stack[-1][0] > now:
            l, first, children = stack.pop()
            if children[-1] != child and child > children[-1]:
                children.append(child)
            yield l, first, i, children
            left = child = first
        if now >= 0:
            if stack and stack[-1][0] == now:
                if child > stack[-1][2][-1]:
                    stack[-1][2].append(child)
            else:
                stack.append([now, left, [left]])


def group_repeats(right: np.ndarray, left: np.ndarray, length: int, nested: bool):
    """Repeats among the contexts of one gram: (right part, left part, members) of each group.

    right, left: what follows the anchor and what precedes it backwards, one row each, as bytes + 1
    with 0 after the end. Without ``nested`` each member of an interval is given its longest left
    part only. The padding of two rows is equal only where both end, so common parts are cut at the
    ends before intervals are formed, and a longer context that goes on there is a member too.
    """
    ahead, behind = (right > 0).sum(axis=1), (left > 0).sum(axis=1)
    order = np.lexsort(right.T[::-1]) if len(right) > 2 else np.arange(len(right))
    common = np.minimum(_common(right[order]), ahead[order[:-1]]).tolist()
    if len(right) == 2:
        l = common[0]
        e = min(int(_common(left)[0]), int(behind[0]))
        if e + l >= length:
            yield l, e, order
        return
    for l, first, last, children in intervals(common):
        if l + left.shape[1] < length:
            continue
        members = order[first : last + 1]
        child = np.searchsorted(children, np.arange(first, last + 1), side="right")
        by_left = np.lexsort(left[members].T[::-1])
        shared = np.minimum(_common(left[members[by_left]]), behind[members[by_left[:-1]]])
        if not nested:
            best = np.zeros(len(members), np.int64)
            best[:-1] = shared
            best[1:] = np.maximum(best[1:], shared)
            for e in np.unique(best[best + l >= length]).tolist():
                yield l, e, members[by_left[best == e]]
            continue
        for e, a, b, _ in intervals(shared.tolist()):
            if e + l < length:
                continue
            inside = by_left[a : b + 1]
            if l == length or len(np.unique(child[inside])) > 1:
                yield l, e, members[inside]


def _matrices(texts: list[bytes], back: np.ndarray, length: int, gram: int):
    reach = length - gram
    left = np.zeros((len(texts), reach), np.uint8)
    right = np.zeros((len(texts), length), np.uint8)
    for k, (text, b) in enumerate(zip(texts, back.tolist())):
        x = np.frombuffer(text, np.uint8) + np.uint8(1)
        ahead = x[b : b + length]
        right[k, : len(ahead)] = ahead
        if b:
            left[k, :b] = x[:b][::-1]
    return right, left


def _sorted_groups(batches, key: str):
    """Complete groups of equal ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        grams = batch.column(key).to_numpy()
        if grams[0] == grams[-1] and len(held) > 1:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        grams = whole.column(key).to_numpy()
        cut = int(np.searchsorted(grams, grams[-1], side="left"))
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tree(length: int, gram: int, nested: bool):
    def run(batches):
        for whole in _sorted_groups(batches, "gram"):
            often = whole.column("n").to_numpy() > 1
            back = whole.column("back").to_numpy()
            grams = whole.column("gram").to_numpy()
            texts = whole.column("bytes").to_pylist()
            cuts = np.append(np.flatnonzero(np.append(True, grams[1:] != grams[:-1])), len(grams))
            group, member, begin, size = [], [], [], []
            number = 0
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                right, left = _matrices(texts[a:b], back[a:b], length, gram)
                row = np.arange(b - a)
                if nested:  # A context that occurs again is a repeat of its own.
                    row = np.repeat(row, np.where(often[a:b], 2, 1))
                    right, left = right[row], left[row]
                for l, e, members in group_repeats(right, left, length, nested):
                    number += 1
                    for k in np.unique(row[members]).tolist():
                        group.append(number)
                        member.append(a + k)
                        begin.append(-e)
                        size.append(e + l)
            rows = pa.array(member, pa.int64())
            part = whole.select(["doc_id", "h", "at", "back", "gram", "ctx", "n"]).take(rows).combine_chunks()
            out = {c: part.column(c).combine_chunks() for c in part.column_names}
            shift = pa.array(np.array(begin, np.int32))
            out |= {"number": pa.array(group, pa.int64()), "from_anchor": shift, "size": pa.array(size, pa.int32())}
            yield pa.RecordBatch.from_pydict(out)

    return run


TREE = (
    "doc_id bigint, h bigint, at int, back int, gram bigint, ctx bigint, n bigint,"
    " number bigint, from_anchor int, size int"
)


def _strings(length: int):
    """One row per string of a context: its hash."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                data, offsets = b"".join(part.column("bytes").to_pylist()), None
                span = part.column("span").to_numpy().astype(np.int64)
                offsets = np.cumsum(span + length) - span - length
                prefix = prefix_hashes(np.frombuffer(data, np.uint8))
                row = np.repeat(np.arange(len(span)), span + 1)
                shift = np.arange(len(row)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
                begin = offsets[row] + shift
                key = span_hashes(prefix, begin, begin + length)
                rows = pa.array(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(key.view(np.int64)),
                        "doc_id": part.column("doc_id").take(rows),
                        "h": part.column("h").take(rows),
                        "start": pa.array(part.column("at").to_numpy()[row] + shift.astype(np.int32)),
                        "n": part.column("n").take(rows),
                    }
                )

    return run


def _windows(length: int):
    """One row per string of a context: its hash, its place and the byte before it (+ 1; 0 where the
    context begins)."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                data = np.frombuffer(b"".join(part.column("bytes").to_pylist()), np.uint8)
                span = part.column("span").to_numpy().astype(np.int64)
                offsets = np.cumsum(span + length) - span - length
                prefix = prefix_hashes(data)
                row = np.repeat(np.arange(len(span)), span + 1)
                shift = ranks(span + 1)
                begin = offsets[row] + shift
                key = span_hashes(prefix, begin, begin + length)
                before = np.where(shift > 0, data[begin - 1].astype(np.int32) + 1, 0)
                rows = pa.array(row)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(key.view(np.int64)),
                        "gram": part.column("gram").take(rows),
                        "ctx": part.column("ctx").take(rows),
                        "n": part.column("n").take(rows),
                        "shift": pa.array(shift.astype(np.int32)),
                        "e": pa.array((part.column("back").to_numpy()[row] - shift).astype(np.int32)),
                        "before": pa.array(before.astype(np.int32)),
                    }
                )

    return run


WINDOWS = "key bigint, gram bigint, ctx bigint, n bigint, shift int, e int, before int"
GROUPS = "gram bigint, ctx bigint, number bigint, from_anchor int, size int"


def _number(string: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)


def _branches(length: int):
    """Of classes of suffixes: where they branch, and the number of their common string if it is a
    repeat that ends on the left."""

    def run(batches):
        for batch in batches:
            branch, number = [], []
            columns = [batch.column(c).to_pylist() for c in ("low", "high", "least", "most")]
            for low, high, least, most in zip(*columns):
                l = len(os.path.commonprefix([low, high]))
                branch.append(l)
                number.append(_number(low[:l]) if l >= length and (least == 0 or least != most) else None)
            out = {c: batch.column(c) for c in ("e", "prefix")}
            out |= {"branch": pa.array(branch, pa.int32()), "number": pa.array(number, pa.int64())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _scan(length: int):
    """Repeats among whole classes of suffixes with a common beginning: a scan of their sorted order."""

    def run(batches):
        for whole in _sorted_groups(batches, "key"):
            keys, often = whole.column("key").to_numpy(), whole.column("n").to_numpy() > 1
            before = whole.column("before").to_numpy()
            tails = whole.column("tail").to_pylist()
            cuts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
            member, number, size = [], [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                order = np.array(sorted(range(a, b), key=tails.__getitem__))
                order = np.repeat(order, np.where(often[order], 2, 1))
                if len(order) < 2:
                    continue
                ends = np.array([len(tails[k]) for k in order.tolist()])
                rows = np.zeros((len(order), int(ends.max())), np.uint8)
                for k, own in enumerate(order.tolist()):
                    rows[k, : ends[k]] = np.frombuffer(tails[own], np.uint8) + np.uint8(1)
                for l, first, last, _ in intervals(np.minimum(_common(rows), ends[:-1]).tolist()):
                    inside = order[first : last + 1]
                    least = before[inside].min()
                    if l < length or (least != 0 and least == before[inside].max()):
                        continue
                    inside = np.unique(inside)
                    member.append(inside)
                    number += [_number(tails[inside[0]][:l])] * len(inside)
                    size += [l] * len(inside)
            rows = pa.array(np.concatenate(member) if member else np.zeros(0, np.int64))
            part = whole.select(["gram", "ctx", "e"]).take(rows).combine_chunks()
            yield pa.RecordBatch.from_pydict(
                {
                    "gram": part.column("gram").combine_chunks(),
                    "ctx": part.column("ctx").combine_chunks(),
                    "number": pa.array(number, pa.int64()),
                    "from_anchor": pa.array(-part.column("e").to_numpy(), pa.int32()),
                    "size": pa.array(size, pa.int32()),
                }
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))


def _found(keyed: DataFrame, length: int, gram: int, once: bool = True):
    """Anchors of repeated grams with the number of their context's occurrences, and the contents
    of one occurrence per context where a gram has several contexts; with ``once`` only if one of
    them occurs once, which is enough for the covered bytes."""
    every = stored(keyed.where(F.octet_length("text") >= length).mapInArrow(_anchors(length, gram), ANCHORS), "anchors")
    twice = every.groupBy("gram").agg(F.count(F.lit(1)).alias("total")).where("total > 1").select("gram")
    # Stored first, so that the join reads plain shuffles on both sides and a hot gram can be split.
    twice = stored(twice, "grams")
    repeated = stored(every.join(twice.hint("merge"), "gram"), "repeated")
    discard(every, twice)
    one = F.first(F.struct("doc_id", "h", "at", "span", "back")).alias("one")
    contexts = stored(repeated.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), one), "contexts")
    open_ = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("different"), F.min("n").alias("least"))
    open_ = open_.where("different > 1 AND least = 1" if once else "different > 1").select("gram", "different")
    fetch = contexts.join(open_, "gram").select("gram", "ctx", "n", "one.*", "different")
    per_doc = fetch.groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("at", "span", "back", "gram", "ctx", "n")).alias("wanted")
    )
    one_text = keyed.where(F.octet_length("text") >= length)
    text = one_text.join(
        per_doc.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")),
    ).select("doc_id", "h", "text", "wanted")
    schema = ANCHORS + ", n bigint, bytes binary"
    contents = text.mapInArrow(_contents(length), schema)
    # Repeated rows of one document fetch the same contexts.
    contents = contents.join(open_, "gram")
    return repeated, contexts, contents


def _tree_rows(contents: DataFrame, length: int, gram: int, nested: bool) -> DataFrame:
    usual = contents.where(F.col("different") <= HOT).drop("different")
    usual = usual.repartition("gram").sortWithinPartitions("gram")
    return usual.mapInArrow(_tree(length, gram, nested), TREE)


def _hot_groups(hot: DataFrame, length: int) -> DataFrame:
    """The repeats among contexts of grams beyond ``HOT``, as GROUPS.

    A repeat begins with a string of ``length`` bytes that has different bytes before it, or the
    start of a context. What follows such strings to the ends of their contexts, the suffixes, is
    put into classes by a common beginning: small classes are sorted and scanned in a task, the
    common string of a large one is found from its least and greatest suffix, and the class is
    split by the byte that follows.
    """
    windows = stored(hot.mapInArrow(_windows(length), WINDOWS), "windows")
    starts = windows.groupBy("key").agg(
        F.sum("n").alias("all"), F.min("before").alias("least"), F.max("before").alias("most")
    )
    starts = stored(starts.where("all > 1 AND (least = 0 OR least < most)").select("key"), "starts")
    texts = hot.select("gram", "ctx", "bytes")
    rows = windows.join(starts.hint("merge"), "key").join(texts.hint("merge"), ["gram", "ctx"])
    rows = rows.select("gram", "ctx", "n", "e", "before", F.expr("substring(bytes, shift + 1)").alias("tail"))
    rows = stored(rows.withColumn("prefix", F.expr(f"substring(tail, 1, {length})")), "suffixes")
    found = None
    while True:
        classes = rows.groupBy("e", "prefix").agg(
            F.count(F.lit(1)).alias("rows"), F.min("tail").alias("low"), F.max("tail").alias("high"),
            F.min("before").alias("least"), F.max("before").alias("most"),
        )
        classes = classes.where(F.col("rows") > HOT).drop("rows")
        large = stored(classes.mapInArrow(_branches(length), "e int, prefix binary, branch int, number bigint"), "large")
        # At most one row per HOT suffixes.
        small = rows.join(F.broadcast(large.select("e", "prefix")), ["e", "prefix"], "left_anti")
        small = small.select(F.xxhash64("e", "prefix").alias("key"), "gram", "ctx", "n", "e", "before", "tail")
        small = small.repartition("key").sortWithinPartitions("key").mapInArrow(_scan(length), GROUPS)
        found = small if found is None else found.unionByName(small)
        if large.isEmpty():
            return found
        split = rows.join(F.broadcast(large), ["e", "prefix"])
        common = split.where("number is not null").select(
            "gram", "ctx", "number", (-F.col("e")).alias("from_anchor"), F.col("branch").alias("size")
        )
        found = found.unionByName(common)
        # Suffixes that end where the class branches are in no smaller class.
        split = split.where(F.octet_length("tail") > F.col("branch"))
        split = split.withColumn("prefix", F.expr("substring(tail, 1, branch + 1)"))
        rows = stored(split.select(*rows.columns), "suffixes")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Maximal repeats of at least ``length`` bytes around each anchor with all their occurrences:
    repeat (an id), n_bytes, doc_id, start. Documents as in ``remove_repeats``; equal rows of one
    document are separate occurrences with equal places."""
    repeated, contexts, contents = _found(_keyed(docs), length, gram, once=False)
    alone = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("different"), F.min("ctx").alias("ctx"))
    whole = repeated.join(alone.where("different = 1").select("gram", "ctx"), ["gram", "ctx"])
    whole = whole.select(
        F.xxhash64("gram", "ctx").alias("repeat"), (F.col("span") + length).alias("n_bytes"), "doc_id",
        F.col("at").alias("start"),
    )
    contents = stored(contents.dropDuplicates(["gram", "ctx"]), "contents")
    tree = _tree_rows(contents, length, gram, True).select("gram", "ctx", "number", "from_anchor", "size")
    hot = contents.where(F.col("different") > HOT)
    if not hot.isEmpty():
        tree = tree.unionByName(_hot_groups(hot, length))
    places = repeated.select("gram", "ctx", "doc_id", (F.col("at") + F.col("back")).alias("anchor"))
    mixed = tree.join(places, ["gram", "ctx"]).select(
        F.xxhash64("gram", "number", "from_anchor", "size").alias("repeat"), F.col("size").alias("n_bytes"), "doc_id",
        (F.col("anchor") + F.col("from_anchor")).alias("start"),
    )
    return whole.unionByName(mixed)


def _removed(kept: list[str]):
    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            texts, n_removed, n_spans, digests = [], [], [], []
            raw = data.tobytes()
            spans = batch.column(batch.schema.get_field_index("spans"))
            bounds = spans.offsets.to_numpy()
            bounds = bounds - bounds[0]
            items = spans.flatten()
            begins, ends = items.field("a").to_numpy(), items.field("b").to_numpy()
            for k in range(batch.num_rows):
                text = raw[offsets[k] : offsets[k + 1]]
                a, b = begins[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]]
                left = text
                if len(a):
                    order = np.argsort(a, kind="stable")
                    a, reach = a[order], np.maximum.accumulate(b[order])
                    new = np.append(True, a[1:] > reach[:-1])
                    a, b = a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                    left = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                texts.append(left.decode("utf-8", "ignore"))
                n_removed.append(len(text) - len(left))
                n_spans.append(len(a))
                digests.append(hashlib.sha256(left).hexdigest())
            out = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            out += [
                pa.array(texts, pa.string()), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(
                out, names=[*kept, "kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return run


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = True, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) without the bytes that a repeated string covers: the
    columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this or
    another document; strings never cross documents and are judged on the input. Texts are taken
    as UTF-8 bytes, null as empty; a text below ``length`` bytes stays whole. Equal rows, with one
    doc_id or without, repeat each other. kept_text leaves a sign out that lost some of its
    bytes; kept_sha256 is over the bytes. Other columns are ignored, an empty table gives no rows.
    """
    keyed = _keyed(docs)
    repeated, contexts, contents = _found(keyed, length, gram)
    contents = stored(contents, "contents")
    whole = repeated.join(contexts.where("n > 1").select("gram", "ctx"), ["gram", "ctx"])
    spans = whole.select("doc_id", "h", F.col("at").alias("a"), (F.col("at") + F.col("span") + length).alias("b"))
    tree = _tree_rows(contents, length, gram, False).where("n = 1")
    start = F.col("at") + F.col("back") + F.col("from_anchor")
    spans = spans.unionByName(tree.select("doc_id", "h", start.alias("a"), (start + F.col("size")).alias("b")))
    hot = contents.where(F.col("different") > HOT)
    if not hot.isEmpty():
        strings = hot.mapInArrow(_strings(length), "key bigint, doc_id bigint, h bigint, start int, n bigint")
        again = strings.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1")
        places = strings.where("n = 1").join(again, "key")
        spans = spans.unionByName(places.select("doc_id", "h", F.col("start").alias("a"), (F.col("start") + length).alias("b")))
    per_doc = spans.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(
        F.collect_list(F.struct("a", "b")).alias("spans")
    )
    none = F.from_json(F.lit("[]"), "array<struct<a:int,b:int>>")
    # Names of the operator's own, so that no kept column clashes.
    whole = docs.select(
        F.struct(*keep).alias("kept"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    joined = whole.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    joined = joined.select("kept", "text", F.coalesce("spans", none).alias("spans"))
    types = T.StructType.fromDDL("kept_text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    out = joined.mapInArrow(_removed(["kept"]), T.StructType([joined.schema["kept"], *types]))
    names = ["kept_text"] * with_text + ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select("kept.*", *names)

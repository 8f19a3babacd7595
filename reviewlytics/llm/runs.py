"""Periodic runs of words: stretches that repeat a shorter sequence over and over.

The suffixes of a text are sorted by prefix doubling, all texts of a chunk at once, and the common
prefixes of neighbours are read off the ranks of the doublings. Classes of suffixes are then united
by decreasing common prefix, as Kruskal unites trees: while the links of ``l`` words are made, a
class holds positions with ``l`` words and more in common, in ascending order. Positions i < j that
become neighbours in a class at that level have exactly ``l`` words in common. At a distance
d = j - i <= l the words i .. j + l have the period d, and no smaller one: i + d' would have more
than ``l`` words in common with i and stand between them. Every run is seeded by its first two
periods, so seeds with the same word before i and j are left out; what remains are the runs, each once.

The smaller class of a union is put into the larger one. Only links that are long enough for a run
are made, so a text without such repeats ends after one comparison of its word sequences.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlytics.llm.common import chunks, mix64

#: A run has at least so many words, and repeats its period at least so often.
WORDS, TIMES = 6, 4
_BLOCK = 512
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def shortest_link(words: int, times: int) -> int:
    """The least common prefix of two positions that can seed a run."""
    return min(max((times - 1) * d, words - d) for d in range(1, max(words, 2)))


def repeating_rows(ids: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Rows in which some sequence of ``width`` words may occur twice, told by hashes: equal
    sequences have equal hashes, so no row is missed."""
    size = np.diff(offsets)
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    key = mix64(row[:n].astype(np.uint64) + np.uint64(1))
    for k in range(width):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64))
    whole = row[:n] == row[width - 1 :]
    key, row = key[whole], row[:n][whole]
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    return np.unique(row[order[1:][again]])


def suffix_order(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all rows, sorted by row and suffix, and the common prefix of each and the next
    (0 between rows)."""
    n = len(ids)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    end = np.repeat(offsets[1:], size)
    levels = [_dense(row * (int(ids.max()) + 1) + ids)]
    step = 1
    while int(levels[-1].max()) + 1 < n:
        rank = levels[-1].astype(np.int64)
        behind = np.zeros(n, np.int64)
        inside = np.flatnonzero(np.arange(n) + step < end)
        behind[inside] = rank[inside + step] + 1
        levels.append(_dense(rank * (n + 1) + behind))
        step *= 2
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        open_ = np.flatnonzero((row[a] == row[b]) & (i < end[a]) & (j < end[b]))
        same = levels[k][i[open_]] == levels[k][j[open_]]
        common[open_[same]] += 1 << k
    return order, common


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks 0, 1, .. of the different keys."""
    order = np.argsort(keys, kind="stable")
    at = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.append(False, at[1:] != at[:-1]))
    return out


class Places:
    """Ascending positions, in blocks, so that a new one moves few others."""

    def __init__(self, first: int):
        self.blocks, self.last, self.size = [[first]], [first], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def around(self, x: int) -> tuple[int, int]:
        """The next positions before and after x; -1 where there is none."""
        k = bisect_left(self.last, x)
        before = self.last[k - 1] if k else -1
        if k == len(self.last):
            return before, -1
        block = self.blocks[k]
        at = bisect_left(block, x)
        if at:
            before = block[at - 1]
        if block[at] == x:
            at += 1
            if at == len(block):
                return before, self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return before, block[at]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.last, x), len(self.last) - 1)
        block = self.blocks[k]
        block.insert(bisect_left(block, x), x)
        self.last[k] = block[-1]
        self.size += 1
        if len(block) > 2 * _BLOCK:
            self.blocks[k : k + 1] = [block[:_BLOCK], block[_BLOCK:]]
            self.last[k : k + 1] = [block[_BLOCK - 1], block[-1]]


def seeds(ids: np.ndarray, offsets: np.ndarray, words: int, times: int):
    """(start, length, period) of every run, in positions of ``ids``, in no order."""
    order, common = suffix_order(ids, offsets)
    links = np.flatnonzero(common >= shortest_link(words, times))
    links = links[np.argsort(-common[links], kind="stable")]
    level = common[links]
    cuts = np.flatnonzero(np.append(True, level[1:] != level[:-1])).tolist() + [len(links)]
    starts = set(offsets[:-1].tolist())
    word = ids.tolist()
    up: dict[int, int] = {}
    places: dict[int, Places] = {}

    def root(x: int) -> int:
        if x not in up:
            up[x], places[x] = x, Places(x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for first, last in zip(cuts[:-1], cuts[1:]):
        l = int(level[first])
        farthest = min(l // (times - 1), l) if times > 1 else l
        near = []
        for a, b in zip(order[links[first:last]].tolist(), order[links[first:last] + 1].tolist()):
            a, b = root(a), root(b)
            if places[a].size < places[b].size:
                a, b = b, a
            large, small = places[a], list(places.pop(b))
            for k, x in enumerate(small):
                before, after = large.around(x)
                if before >= 0 and x - before <= farthest and (not k or small[k - 1] < before):
                    near.append((before, x))
                if after >= 0 and after - x <= farthest and (k + 1 == len(small) or small[k + 1] > after):
                    near.append((x, after))
            for x in small:
                large.add(x)
            up[b] = a
        for i, j in near:
            d = j - i
            if d + l < words or i not in starts and word[i - 1] == word[j - 1]:
                continue
            # Another class of this level may have come between.
            if places[root(i)].around(i)[1] == j:
                yield i, d + l, d


def runs_of(texts: list[list[bytes]], words: int = WORDS, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64)
    offsets = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    rows = repeating_rows(ids, offsets, shortest_link(words, times))
    if not len(rows):
        return out
    own = [ids[offsets[r] : offsets[r + 1]] for r in rows.tolist()]
    begins = np.append(0, np.cumsum([len(x) for x in own], dtype=np.int64))
    for start, length, period in seeds(np.concatenate(own), begins, words, times):
        k = int(np.searchsorted(begins, start, side="right")) - 1
        out[int(rows[k])].append((start - int(begins[k]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        kept = np.ones(len(text), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        text = [text[k] for k in np.flatnonzero(kept).tolist()]
    return b" ".join(text)


def _found(words: int, times: int):
    def run(batches):
        for batch, data, offsets in chunks(batches, "text"):
            raw = data.tobytes()
            texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            runs = runs_of(texts, words, times)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs]
            collapsed = [_collapsed(t, r).decode("utf-8", "replace") for t, r in zip(texts, runs)]
            struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(struct)), pa.array(collapsed, pa.string())],
                names=["kept", "runs", "collapsed"],
            )

    return run


def periodic_runs(
    docs: DataFrame, words: int = WORDS, times: int = TIMES, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Every row of ``docs`` (text) with its runs and without their repetitions: the columns
    ``keep``, runs (array of start, length, period; by start, then period) and collapsed.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text, numbered from 0 and compared as they are. A run
    is a stretch of at least max(words, times * period) consecutive words whose smallest period
    is ``period`` and which no neighbouring word extends. collapsed holds the words, joined by one space,
    that no run contains after its first period. Null and empty texts have no words, so no runs and an empty
    collapsed. Each row is judged alone, so repeated rows give equal results; other columns, whatever
    their names, are ignored; an empty table gives no rows. Nothing is shuffled; a task's memory
    follows its longest text.
    """
    given = docs.select(F.struct(*keep).alias("kept"), F.col("text").cast("string").alias("text"))
    types = T.StructType.fromDDL(f"runs array<{RUN}>, collapsed string")
    found = given.mapInArrow(_found(words, times), T.StructType([given.schema["kept"], *types]))
    return found.select("kept.*", "runs", "collapsed")


def with_stutter(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by h = crc32(doc_id as text) repeats itself:
    from word a = g mod n on (g = floor(h / 10), n words) its words go round in a circle of
    1 + floor((n - a) / (3 + g mod 8)). Rows without doc_id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    some = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), h.alias("h"))
    some = some.withColumn("w", F.when(F.col("h") % 10 == 0, split))
    turned = F.expr("""
        array_join(transform(sequence(0, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) AS int)]), ' ')""")
    some = some.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    return some.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length (ties: least start, then period) with its
    exponent in thousandths, and the SHA-256 of all runs and of the collapsed text."""
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS p)))")
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

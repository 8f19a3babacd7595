"""Benchmark decontamination by greedy string tiling.

A test item and a document are compared if they share a seed, ``WIDTH`` tokens in a row. Seeds of
the items are joined to the documents inside the scan: the items come in blocks of a fixed size,
each block's seeds go to all tasks, and every document meets every block, so the documents are never
shuffled and nothing that is sent grows with them. A pair is then tiled: the longest common token
strings are marked, longest first, in both texts, and marked tokens do not match again; matches of
at least the search length are found by Karp-Rabin hashes over the tokens still free, and the
search length falls until it reaches ``WIDTH``. Tiles may stand in any order, so a shuffled passage
is found. The share of an item's tokens under tiles is its coverage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.common import LETTERS, chunks, lower_ascii, prefix_hashes, shingle_hashes, span_hashes, word_spans

WIDTH = 5
COVERAGE = 0.5
#: Bytes of item texts in a block.
BLOCK_BYTES = 8 << 20
FIRST_LENGTH = 20
_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E6F
_TOKEN = LETTERS.copy()
_TOKEN[48:58] = True
TYPES = (
    "doc_id bigint, item_id bigint, coverage double, n_tokens int, n_tiles int,"
    " tiles array<struct<doc_start:int,item_start:int,length:int>>"
)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (runs of letters and digits, lower-cased A-Z), and tokens before each row."""
    data = lower_ascii(data)
    begin, end, counts = word_spans(data, offsets, _TOKEN)
    return span_hashes(prefix_hashes(data), begin, end), counts


def _free_runs(marked: list[bool]):
    begin = None
    for k, m in enumerate([*marked, True]):
        if m and begin is not None:
            yield begin, k
            begin = None
        elif not m and begin is None:
            begin = k


def _rolling(x: list[int], a: int, b: int, length: int):
    """Karp-Rabin hashes of the strings of ``length`` tokens in x[a:b]."""
    if b - a < length:
        return
    h, top = 0, pow(_BASE, length - 1, _PRIME)
    for k in range(a, a + length):
        h = (h * _BASE + x[k]) % _PRIME
    yield a, h
    for k in range(a + 1, b - length + 1):
        h = ((h - x[k - 1] * top) * _BASE + x[k + length - 1]) % _PRIME
        yield k, h


def tile(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """(document start, item start, length) of the tiles of two token strings."""
    doc_marked, item_marked = [False] * len(doc), [False] * len(item)
    tiles = []
    length = max(min(FIRST_LENGTH, len(item)), least)
    while True:
        places: dict[int, list[int]] = {}
        for a, b in _free_runs(item_marked):
            for k, h in _rolling(item, a, b, length):
                places.setdefault(h, []).append(k)
        found: list[tuple[int, int, int]] = []
        longest = 0
        if places:
            for a, b in _free_runs(doc_marked):
                for i, h in _rolling(doc, a, b, length):
                    for j in places.get(h, ()):
                        # A match that can be extended to the left has been met from there.
                        if i > a and j and not item_marked[j - 1] and doc[i - 1] == item[j - 1]:
                            continue
                        n = 0
                        while i + n < b and j + n < len(item) and not item_marked[j + n] and doc[i + n] == item[j + n]:
                            n += 1
                        if n >= length:
                            found.append((n, i, j))
                            longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        for n, i, j in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            # What earlier tiles have left of the match; a rest below the length waits.
            while n >= length and (doc_marked[i] or item_marked[j]):
                n, i, j = n - 1, i + 1, j + 1
            k = 0
            while k < n and not doc_marked[i + k] and not item_marked[j + k]:
                k += 1
            if k >= length:
                doc_marked[i : i + k] = [True] * k
                item_marked[j : j + k] = [True] * k
                tiles.append((i, j, k))
        if length == least:
            return sorted(tiles)
        length = max(length // 2, least)


class _Block:
    """Items of one block with the seeds that lead to them."""

    def __init__(self, ids: list[int], texts: list[str], width: int):
        raw = [t.encode() for t in texts]
        words, counts = tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.ids, self.counts, self.width = ids, counts, width
        self.words = words.astype(np.int64) & ((1 << 60) - 1)
        self.lists: dict[int, list[int]] = {}
        sizes = np.diff(counts)
        # Items below the width are found by all their tokens.
        self.widths = sorted({min(width, int(n)) for n in sizes if n})
        self.seeds = {}
        for w in self.widths:
            hashes, rows = shingle_hashes(words, counts, w)
            fit = (sizes[rows] == w) if w < width else (sizes[rows] >= w)
            order = np.argsort(hashes[fit], kind="stable")
            self.seeds[w] = hashes[fit][order], rows[fit][order]

    def candidates(self, words: np.ndarray, counts: np.ndarray):
        """row, token position, width and item of every shared seed."""
        out = []
        for w, (hashes, items) in self.seeds.items():
            got, rows = shingle_hashes(words, counts, w)
            marks = np.zeros(1 << 16, bool)
            marks[(hashes >> np.uint64(48)).astype(np.int64)] = True
            on = np.flatnonzero(marks[(got >> np.uint64(48)).astype(np.int64)])
            a = np.searchsorted(hashes, got[on], side="left")
            b = np.searchsorted(hashes, got[on], side="right")
            on, a, n = on[b > a], a[b > a], (b - a)[b > a]
            # Rows below the width show one string of fewer tokens, which is no seed of this width.
            position = np.arange(len(got)) - np.searchsorted(rows, rows)
            whole = np.diff(counts)[rows[on]] >= w
            on, a, n = on[whole], a[whole], n[whole]
            each = np.repeat(np.arange(len(on)), n)
            pick = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.stack([rows[on[each]], position[on[each]], np.full(len(each), w), items[pick]]))
        return np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)

    def item(self, k: int) -> list[int]:
        if k not in self.lists:
            self.lists[k] = self.words[self.counts[k] : self.counts[k + 1]].tolist()
        return self.lists[k]


def _tiled(block: _Block, coverage: float, clean: bool = False):
    """Matches of each batch with a block; ``clean`` gives the rows without any instead."""

    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            words, counts = tokens(data, offsets)
            row, position, width, item = block.candidates(words, counts)
            order = np.lexsort((position, item, row))
            row, position, width, item = row[order], position[order], width[order], item[order]
            cuts = np.append(np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))), len(row))
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if len(row) else ():
                # Tiles lie where seeds do: the rest of the document is left out of the search.
                r, w, k = int(row[a]), int(width[a]), int(item[a])
                spots = np.unique(position[a:b])
                covered = np.unique((spots[:, None] + np.arange(w)).reshape(-1))
                gap = np.flatnonzero(np.append(True, covered[1:] > covered[:-1] + 1))
                at, doc = [], []
                base = int(counts[r])
                for x, y in zip(gap, np.append(gap[1:], len(covered))):
                    at += [-1, *covered[x:y].tolist()]
                    doc += [-1 - len(doc), *(words[base + covered[x:y]].astype(np.int64) & ((1 << 60) - 1)).tolist()]
                test = block.item(k)
                tiles = tile(doc, test, w)
                share = sum(n for _, _, n in tiles) / len(test)
                if share >= coverage:
                    out.append((r, block.ids[k], share, len(test), len(tiles), [(at[i], j, n) for i, j, n in tiles]))
            if clean:
                free = np.ones(batch.num_rows, bool)
                free[[r for r, *_ in out]] = False
                yield batch.filter(pa.array(free))
                continue
            r, ids, share, size, n, tiles = zip(*out) if out else [()] * 6
            kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("doc_start", "item_start", "length")]))
            named = [[dict(zip(("doc_start", "item_start", "length"), t)) for t in x] for x in tiles]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(r, pa.int64())), pa.array(ids, pa.int64()),
                    pa.array(share, pa.float64()), pa.array(size, pa.int32()), pa.array(n, pa.int32()),
                    pa.array(named, kind),
                ],
                names=["doc_id", "item_id", "coverage", "n_tokens", "n_tiles", "tiles"],
            )

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, item_id, coverage, n_tokens (of the item), n_tiles and tiles of every row of ``docs``
    (doc_id, text) and every row of ``benchmark`` (item_id, text) of which at least ``coverage`` of
    the tokens stand in the document in strings of ``width`` tokens or more, in any order.

    An item of fewer tokens has to stand there as a whole; one without tokens, like null and empty
    texts on either side, matches nothing. Repeated rows on either side are reported for each.
    Other columns are ignored; without documents or items there are no rows.
    """
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = None
    for block in _blocks(benchmark, width, block_bytes):
        found = given.mapInArrow(_tiled(block, coverage), TYPES)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], TYPES) if out is None else out


def _blocks(benchmark: DataFrame, width: int, block_bytes: int):
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-total // block_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for k in range(blocks):
        rows = sorted((r["item_id"] is None, r["item_id"] or 0, r["text"]) for r in items.where(part == k).collect())
        yield _Block([None if null else i for null, i, _ in rows], [t for _, _, t in rows], width)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs``, whole, that ``leaks`` would not report; rows are dropped in the scan
    itself, without a join."""
    out = docs
    for block in _blocks(benchmark, width, block_bytes):
        out = out.mapInArrow(_tiled(block, coverage, clean=True), docs.schema)
    return out

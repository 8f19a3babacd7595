"""Licence scans: MinHash bands over overlapping windows retrieve notices, shingles verify them.

A text is a row of ``WIDTH``-word shingles (words: runs of letters and digits, lower-cased A-Z).
Notices are grouped by length, the longest at most ``SPREAD`` times the shortest; for each group
windows of the longest length start at every quarter of the shortest. Each of ``BANDS * ROWS`` hash
functions gives the least value in a window, for all windows together from the minima of 1, 2, 4,
... values. A notice is retrieved where a band of its signature equals the window's. With 16 bands
of one row the chance to meet a window of similarity s is 1 - (1 - s)^16, that is 0.9999 at
s = 0.45; a notice that stands in a text unchanged has s >= 0.5 even if it is the shortest of its
group and lies between two windows. A retrieved notice is verified exactly: of its shingles at
least ``CONTAINMENT`` have to stand in the window, widened by its length to both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.common import (
    LETTERS, chunks, lower_ascii, mix64, prefix_hashes, shingle_hashes, span_hashes, word_spans,
)
from reviewlytics.llm.license_texts import NOTICES

WIDTH = 5
BANDS, ROWS = 16, 1
CONTAINMENT = 0.8
SPREAD = 1.5
_TOKEN = LETTERS.copy()
_TOKEN[48:58] = True
_SEEDS = np.random.default_rng(10).integers(1, 1 << 62, 256, dtype=np.uint64)
TYPES = "doc_id bigint, license string, containment double, n_places int, places array<struct<start:int,end:int>>"


def shingles(data: np.ndarray, offsets: np.ndarray, width: int):
    """Hashes and rows of all shingles in order, and begin and end of the words with their counts."""
    begin, end, counts = word_spans(data, offsets, _TOKEN)
    words = span_hashes(prefix_hashes(lower_ascii(data)), begin, end)
    hashes, rows = shingle_hashes(words, counts, width)
    return hashes, rows, begin, end, counts


class Index:
    """Notices in classes of similar length, with the bands that lead to them."""

    def __init__(self, notices: dict[str, str], width: int, bands: int, rows: int):
        self.names = sorted(notices)
        self.width, self.bands, self.rows = width, bands, rows
        raw = [notices[n].encode() for n in self.names]
        hashes, of, _, _, _ = shingles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), width)
        self.sets = [np.unique(hashes[of == k]) for k in range(len(raw))]
        length = {k: int((of == k).sum()) for k in range(len(raw)) if len(self.sets[k])}
        #: Class: least and largest length, and per band the keys of its notices.
        self.classes: list[tuple[int, int, list[dict[int, list[int]]]]] = []
        left = sorted(length.items(), key=lambda x: x[1])
        while left:
            low = left[0][1]
            mine = [k for k, n in left if n <= SPREAD * low]
            left = [x for x in left if x[1] > SPREAD * low]
            keys: list[dict[int, list[int]]] = [{} for _ in range(bands)]
            for k in mine:
                least = [h.min(keepdims=True) for h in self._hashed(self.sets[k])]
                for number in range(bands):
                    keys[number].setdefault(int(self.band(least, number)[0]), []).append(k)
            self.classes.append((low, max(length[k] for k in mine), keys))

    def _hashed(self, values: np.ndarray):
        for k in range(self.bands * self.rows):
            yield mix64(values ^ _SEEDS[k])

    def band(self, least: list[np.ndarray], number: int) -> np.ndarray:
        mine = least[number * self.rows : (number + 1) * self.rows]
        key = mine[0]
        for x in mine[1:]:
            key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + x)
        return key

    def retrieve(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(first shingle, window length, notice) of windows with an equal band. Windows run over
        the rows of a chunk as over one text; which row they stand in is settled by verification."""
        found: set[tuple[int, int, int]] = set()
        if not len(hashes) or not self.classes:
            return []
        most = max(high for _, high, _ in self.classes)
        end = np.full(most, np.iinfo(np.uint64).max, np.uint64)
        values = self._hashed(hashes)
        for number in range(self.bands):
            keys: list[np.ndarray] = []
            for x in (next(values) for _ in range(self.rows)):
                ladder = [np.append(x, end)]  # least of 1, 2, 4, ... values from each place
                while 2 ** len(ladder) <= most:
                    step = ladder[-1]
                    half = 2 ** (len(ladder) - 1)
                    ladder.append(np.append(np.minimum(step[:-half], step[half:]), step[-half:]))
                for c, (low, n, _) in enumerate(self.classes):
                    step = n.bit_length() - 1
                    stride = max(low // 4, 1)
                    a = ladder[step][: len(x) : stride]
                    rest = n - 2**step
                    least = np.minimum(a, ladder[step][rest : rest + len(x) : stride]) if rest else a
                    if c == len(keys):
                        keys.append(least)
                    else:
                        keys[c] = mix64(keys[c] * np.uint64(0xD6E8FEB86659FD93) + least)
            for (low, n, mine), key in zip(self.classes, keys):
                stride = max(low // 4, 1)
                for k, notices in mine[number].items():
                    for at in np.flatnonzero(key == np.uint64(k)).tolist():
                        found.update((at * stride, n, notice) for notice in notices)
        return sorted(found)


def _scanned(index: Index, containment: float):
    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            hashes, rows, begin, end, counts = shingles(data, offsets, index.width)
            cuts = np.searchsorted(rows, np.arange(len(offsets)))
            best: dict[tuple[int, int], tuple[float, list]] = {}
            over = [
                (r, at, n, notice)
                for at, n, notice in index.retrieve(hashes)
                for r in np.unique(rows[at : at + n]).tolist()
            ]
            for r, at, n, notice in over:
                a, b = max(at - n, int(cuts[r])), min(at + 2 * n, int(cuts[r + 1]))
                inside = np.flatnonzero(np.isin(hashes[a:b], index.sets[notice]))
                share = len(np.unique(hashes[a:b][inside])) / len(index.sets[notice])
                if share < containment or not len(inside):
                    continue
                word = int(counts[r]) - int(cuts[r])
                from_, to = a + int(inside[0]) + word, a + int(inside[-1]) + word
                last = min(to + index.width - 1, int(counts[r + 1]) - 1)
                place = (int(begin[from_] - offsets[r]), int(end[last] - offsets[r]))
                score, places = best.setdefault((r, notice), (0.0, []))
                best[r, notice] = (max(score, share), places)
                places.append(place)
            found = sorted(best.items())
            merged = []
            for _, (_, places) in found:
                spans: list[list[int]] = []
                for a, b in sorted(set(places)):
                    if spans and a < spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                merged.append([{"start": a, "end": b} for a, b in spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array([r for (r, _), _ in found], pa.int64())),
                    pa.array([index.names[k] for (_, k), _ in found], pa.string()),
                    pa.array([share for _, (share, _) in found], pa.float64()),
                    pa.array([len(m) for m in merged], pa.int32()),
                    pa.array(merged, kind),
                ],
                names=["doc_id", "license", "containment", "n_places", "places"],
            )

    return run


def scan(
    docs: DataFrame, notices: dict[str, str] = NOTICES, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """doc_id, license, containment, n_places and places (bytes of the text) of every row of
    ``docs`` (doc_id, text) and every notice that stands in it: at least ``containment`` of the
    notice's shingles close together.

    A notice or text of fewer words than ``width`` is one shingle of all its words, so such a notice
    is found only as a whole text; one without words matches nothing, as do null and empty texts.
    Repeated rows are reported each. Other columns are ignored; an empty table gives no rows.
    """
    index = Index(notices, width, bands, rows)
    given = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return given.mapInArrow(_scanned(index, containment), TYPES)

"""Text quality by a generalised additive model with pairwise interactions.

Every feature is cut into at most ``BINS`` bins. Boosting goes round the features in a cycle: each
turn fits a tree of at most four leaves to one feature's binned gradients and adds a small part of
it to that feature's table. The pairs that explain most of what is left get a table over both
features' bins, boosted by trees with one cut in each feature. A score is the logistic function of
a sum of table entries, so scoring is a few vectorised look-ups per text, and every table can be
read.

Learning uses the labelled documents of at most ``MOST_ROWS`` ids (those with the least hashes);
scoring reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.common import LETTERS, chunks, held_out, lower_ascii, prefix_hashes, span_hashes, word_spans
from reviewlytics.llm.toxicity import labelled

MOST_ROWS = 50_000
BINS = 32
ROUNDS, PAIR_ROUNDS = 150, 60
PAIRS = 6
RATE = 0.15
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "letters", "digits", "symbols", "points", "capitals", "lines_per_word",
    "repeated_next", "distinct_words", "distinct_pairs", "odd_words", "short_words", "repeated_lines", "ends_per_word",
)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,;:!?'\"-()")] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL &= ~(LETTERS | _DIGIT | _POINT)


def _per_row(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marked) + 1)
    np.cumsum(marked, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row; row is ascending."""
    if not len(row):
        return np.zeros(rows)
    order = np.lexsort((key, row))
    key = key[order]
    new = np.ones(len(row), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows).astype(float)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x features; an empty text has zeros throughout."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    begin, end, counts = word_spans(data, offsets)
    words = np.diff(counts).astype(float)
    row = np.repeat(np.arange(rows), np.diff(counts))
    prefix = prefix_hashes(lower_ascii(data))
    hashes = span_hashes(prefix, begin, end)
    same_row = row[1:] == row[:-1]
    repeated = np.bincount(row[1:][same_row & (hashes[1:] == hashes[:-1])], minlength=rows)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
    two = row[1:][same_row]
    letters = _per_row(LETTERS[data], offsets)
    capitals = _per_row((data >= 65) & (data <= 90), offsets)
    symbol = _SYMBOL[data]
    marks = np.zeros(len(data) + 1)
    np.cumsum(symbol, out=marks[1:])
    odd = np.bincount(row[marks[end] - marks[begin] > 0], minlength=rows)
    short = np.bincount(row[end - begin <= 2], minlength=rows)
    breaks = np.zeros(256, bool)
    breaks[:] = True
    breaks[10] = False
    line_begin, line_end, lines_before = word_spans(data, offsets, breaks)
    lines = np.diff(lines_before).astype(float)
    line_row = np.repeat(np.arange(rows), np.diff(lines_before))
    kinds = _distinct(line_row, span_hashes(prefix, line_begin, line_end), rows)
    part = lambda x, of: np.divide(x, of, out=np.zeros(rows), where=of > 0)
    out = [
        np.log1p(size), np.log1p(words), part(_per_row(data > 32, offsets), words), part(letters, size),
        part(_per_row(_DIGIT[data], offsets), size), part(_per_row(symbol, offsets), size),
        part(_per_row(_POINT[data], offsets), size), part(capitals, letters), part(lines, words),
        part(repeated, words), part(_distinct(row, hashes, rows), words),
        part(_distinct(two, pairs[same_row], rows), words), part(odd, words), part(short, words),
        part(lines - kinds, lines), part(_per_row(_END[data], offsets), words),
    ]
    return np.stack(out, axis=1)


@dataclass
class Model:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), BINS)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS, BINS)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        if self.edges and len(x):
            b = self.bins(x)
            for k in range(b.shape[1]):
                total += self.tables[k, b[:, k]]
            for (i, j), grid in zip(self.pairs, self.grids):
                total += grid[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best place to cut ordered bins in two, and its gain; 0 if none gains."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    fine = (b > 1.0) & (total_h - b > 1.0)
    gain = a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1) - total_g**2 / (total_h + 1)
    gain = np.where(fine, gain, 0.0)
    k = int(gain.argmax()) if len(gain) else 0
    return (k + 1, float(gain[k])) if len(gain) and gain[k] > 0 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of a tree of depth two."""
    out = np.zeros(len(g))
    first, _ = _cut(g, h)
    for a, b in ((0, first), (first, len(g))) if first else ((0, len(g)),):
        second, _ = _cut(g[a:b], h[a:b])
        for c, d in ((a, a + second), (a + second, b)) if second else ((a, b),):
            out[c:d] = -g[c:d].sum() / (h[c:d].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """One cut in each of two features: the four leaf values over the grid, and the gain."""
    G, H = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    parts = []
    for X in (G, H):
        a = X[1:-1, 1:-1]
        b, c, all_ = X[1:-1, -1:] - a, X[-1:, 1:-1] - a, X[-1, -1]
        parts.append((a, b, c, all_ - a - b - c))
    gain = sum(p * p / (q + 1) for p, q in zip(*parts))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for (r, s), p, q in zip(
        ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
         (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), *parts,
    ):
        out[r, s] = -p[i, j] / (q[i, j] + 1)
    return out, float(gain[i, j])


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Model of rows of features and labels 0 or 1; without both labels it scores all texts alike."""
    ones = float(y.sum())
    rate = (ones + 0.5) / (len(y) + 1)
    model = Model(bias=float(np.log(rate / (1 - rate))))
    if not 0 < ones < len(y):
        return model
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, k], quantiles)) for k in range(x.shape[1])]
    b = model.bins(x)
    margin = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b[:, k], g, BINS), np.bincount(b[:, k], h, BINS))
            model.tables[k] += step
            margin += step[b[:, k]]
    g, h = slopes()

    def grid(values, i, j):
        return np.bincount(b[:, i] * BINS + b[:, j], values, BINS * BINS).reshape(BINS, BINS)

    gains = [(_quadrants(grid(g, i, j), grid(h, i, j))[1], i, j) for i in range(x.shape[1]) for j in range(i)]
    model.pairs = [(i, j) for _, i, j in sorted(gains, key=lambda v: (-v[0], v[1], v[2]))[:PAIRS]]
    model.grids = np.zeros((len(model.pairs), BINS, BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(g, i, j), grid(h, i, j))[0]
            model.grids[k] += step
            margin += step[b[:, i], b[:, j]]
    return model


def _measured(batches):
    for batch, data, offsets in chunks(batches, "text", 2 << 20):
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "label": batch.column("label"),
                "x": pa.array(features(data, offsets).tolist(), pa.list_(pa.float64())),
            }
        )


def fit(rows: DataFrame) -> Model:
    """Model from rows of (doc_id, text, label), a bounded sample."""
    given = rows.where(F.col("label").isin(0, 1)).select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("label").cast("int")
    )
    found = given.mapInArrow(_measured, "doc_id bigint, label int, x array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist()).reshape(len(found), len(FEATURES))
    return train(x, found["label"].to_numpy(float))


def _scored(model: Model, kept: list[str]):
    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 2 << 20):
            score = model.score(features(data, offsets))
            out = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            out += [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with score (0 to 1, higher: likelier good) and predicted
    (1 if score >= 0.5). Null and empty texts have all features zero. Other columns are ignored; an
    empty table gives no rows."""
    given = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in keep]
    return given.mapInArrow(_scored(model, list(keep)), ", ".join([*fields, "score double, predicted int"]))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text), from a model of the
    labelled documents that are not held out; rows without doc_id do not count as held out."""
    known = labels.where(~held_out(labels, folds, fold))
    model = fit(labelled(docs, known, "quality", MOST_ROWS))
    return score(docs.withColumn("held_out", held_out(docs, folds, fold)), model, ("doc_id", "held_out"))

"""Toxicity: a sparse linear model that is penalised for reacting to identity terms.

Features are the words of a text and their beginnings (4 to 6 bytes), hashed to ``BUCKETS``;
presence counts, not frequency. The features that are associated with the label are chosen from
counts over the labelled sample, then a logistic regression is fitted on them. For every labelled
sentence that names a group, the same sentence with the term exchanged for another of its kind is
made, and the squared difference of both scores is added to the loss. Terms that are frequent in
toxic sentences, but neutral in themselves, so lose their weight to what is said about them.

Learning uses at most ``MOST_ROWS`` labelled documents, those with the least hashes of doc_id, and
``MOST_FEATURES`` features; scoring reads whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.llm.common import (
    LETTERS, chunks, held_out, lower_ascii, mix64, prefix_hashes, span_hashes, stored, word_spans,
)

BUCKET_BITS = 22
STEMS = (4, 5, 6)
MOST_ROWS = 50_000
MOST_FEATURES = 3000
LEAST_Z = 4.0
COUNTERFACTUAL = 20.0
RIDGE = 1e-3
#: Kinds of identity terms; a term is exchanged for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young", "elderly"),
    ("disabled", "deaf", "blind"),
)


@dataclass
class Model:
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and bucket of every word and stem, with repetitions."""
    data = lower_ascii(data)
    begin, end, counts = word_spans(data, offsets, LETTERS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    prefix = prefix_hashes(data)
    rows, found = [row], [span_hashes(prefix, begin, end)]
    for k in STEMS:
        long = np.flatnonzero(end - begin >= k)
        rows.append(row[long])
        found.append(mix64(span_hashes(prefix, begin[long], begin[long] + k) + np.uint64(k)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, bucket = features(data, offsets)
    both = np.unique(row << BUCKET_BITS | bucket)
    return both >> BUCKET_BITS, both & ((1 << BUCKET_BITS) - 1)


def _counted(batches):
    """Documents with each feature by label, added up within the task."""
    totals = np.zeros((2, 1 << BUCKET_BITS), np.int32)
    for batch, data, offsets in chunks(batches, "text", 2 << 20):
        row, bucket = _distinct(data, offsets)
        toxic = batch.column(batch.schema.get_field_index("label")).to_numpy()[row] == 1
        totals[1] += np.bincount(bucket[toxic], minlength=totals.shape[1]).astype(np.int32)
        totals[0] += np.bincount(bucket[~toxic], minlength=totals.shape[1]).astype(np.int32)
    on = np.flatnonzero(totals.sum(axis=0))
    for k in range(0, len(on), 1 << 16):
        part = on[k : k + (1 << 16)]
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(part),
                "clean": pa.array(totals[0, part].astype(np.int64)),
                "toxic": pa.array(totals[1, part].astype(np.int64)),
            }
        )


def exchange(text: str, terms=IDENTITY_TERMS) -> str | None:
    """The text with every identity term exchanged for the next of its kind; None without any."""
    to = {t: kind[(k + 1) % len(kind)] for kind in terms for k, t in enumerate(kind)}
    pattern = re.compile(r"\b(" + "|".join(sorted(to, key=len, reverse=True)) + r")\b", re.I)
    out, n = pattern.subn(lambda m: to[m[0].lower()], text)
    return out if n else None


_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def _examples(chosen: np.ndarray, terms):
    """Chosen features of each labelled text, and of its sentences with identity terms and their
    counterfactuals."""

    def listed(texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        row, bucket = features(data, offsets)
        at = np.searchsorted(chosen, bucket)
        at[at == len(chosen)] = 0
        fine = chosen[at] == bucket if len(chosen) else np.zeros(0, bool)
        both = np.unique(row[fine] << 32 | at[fine])
        cut = np.searchsorted(both >> 32, np.arange(len(texts) + 1))
        return [(both[a:b] & 0xFFFFFFFF).tolist() for a, b in zip(cut[:-1], cut[1:])]

    any_term = re.compile(rb"(?i)\b(" + "|".join(t for kind in terms for t in kind).encode() + rb")\b")

    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            before, after = [], []
            for text in texts:
                if any_term.search(text):
                    for sentence in _SENTENCE.findall(text.decode()):
                        other = exchange(sentence, terms)
                        if other is not None:
                            before.append(sentence.encode())
                            after.append(other.encode())
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            size = len(texts) + len(before)
            yield pa.RecordBatch.from_pydict(
                {
                    "label": pa.array(labels + [None] * len(before), pa.int32()),
                    "here": pa.array(listed(texts) + listed(before), pa.list_(pa.int32())),
                    "there": pa.array([None] * len(texts) + listed(after), pa.list_(pa.int32())),
                }
            )
            assert size == len(labels) + len(before)

    return run


class _Sparse:
    def __init__(self, lists, width: int):
        sizes = np.array([len(x) for x in lists], np.int64)
        self.row = np.repeat(np.arange(len(lists)), sizes)
        self.column = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        self.shape = (len(lists), width)

    def times(self, w):
        return np.bincount(self.row, w[self.column], self.shape[0]) if self.shape[0] else np.zeros(0)

    def back(self, v):
        return np.bincount(self.column, v[self.row], self.shape[1])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(here, labels, before, after, width: int, strength: float = COUNTERFACTUAL, steps: int = 400):
    """Weights and bias: Adam on the mean logistic loss, plus ``strength`` times the mean squared
    difference of the scores of counterfactual sentences, plus a ridge."""
    x, p, q = _Sparse(here, width), _Sparse(before, width), _Sparse(after, width)
    y = np.asarray(labels, float)
    # Both labels weigh the same.
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = _sigmoid(x.times(w[:-1]) + w[-1])
        d = weight * (s - y)
        g = np.append(x.back(d) + RIDGE * w[:-1], d.sum())
        if p.shape[0]:
            a, b = _sigmoid(p.times(w[:-1]) + w[-1]), _sigmoid(q.times(w[:-1]) + w[-1])
            gap = 2 * strength * (a - b) / p.shape[0]
            da, db = gap * a * (1 - a), -gap * b * (1 - b)
            g += np.append(p.back(da) + q.back(db), da.sum() + db.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame, strength: float = COUNTERFACTUAL, terms=IDENTITY_TERMS) -> Model:
    """Model from rows of (text, label), at most a bounded sample; rows without a label of 0 or 1
    are left out. With one label only every text scores on that label's side, with none 0.5."""
    rows = labelled.where(F.col("label").isin(0, 1)).select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("label").cast("int")
    )
    rows = stored(rows, "labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Model(bias=0.0 if clean == toxic else (2.0 if toxic else -2.0))
    counts = rows.mapInArrow(_counted, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = (F.col("clean") + F.col("toxic") + 1) / (clean + toxic + 2)
    spread = F.sqrt(rate * (1 - rate) * (1 / clean + 1 / toxic))
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / spread
    chosen = counts.select("bucket", F.abs(z).alias("z")).where(F.col("z") >= LEAST_Z)
    chosen = chosen.orderBy(F.desc("z"), "bucket").limit(MOST_FEATURES).collect()
    buckets = np.array(sorted(r["bucket"] for r in chosen), np.int64)
    examples = rows.mapInArrow(_examples(buckets, terms), "label int, here array<int>, there array<int>").toPandas()
    texts, pairs = examples[examples["label"].notna()], examples[examples["label"].isna()]
    weights, bias = train(
        texts["here"].tolist(), texts["label"].tolist(), pairs["here"].tolist(), pairs["there"].tolist(),
        len(buckets), strength,
    )
    return Model(buckets, weights, bias)


def _scored(model: Model, kept: list[str]):
    def run(batches):
        table = np.zeros(1 << BUCKET_BITS, np.float64)
        table[model.buckets] = model.weights
        for batch, data, offsets in chunks(batches, "text", 2 << 20):
            row, bucket = features(data, offsets)
            on = np.flatnonzero(table[bucket])
            both = np.unique(row[on] << BUCKET_BITS | bucket[on])
            weight = table[both & ((1 << BUCKET_BITS) - 1)]
            score = _sigmoid(model.bias + np.bincount(both >> BUCKET_BITS, weight, len(offsets) - 1))
            out = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            out += [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with score (0 to 1, higher: likelier toxic) and predicted
    (1 if score >= 0.5). Null and empty texts have no features and get the model's bias alone.
    Other columns are ignored; an empty table gives no rows."""
    given = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in keep]
    return given.mapInArrow(_scored(model, list(keep)), ", ".join([*fields, "score double, predicted int"]))


def labelled(docs: DataFrame, labels: DataFrame, name: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, text, label of the documents of the ``most_rows`` labelled ids with the least hashes;
    an id with both labels is left out, repeated rows of one doc_id count once."""
    one = labels.where(F.col(name).isin(0, 1)).groupBy("doc_id").agg(
        F.min(name).alias("label"), F.max(name).alias("most")
    )
    one = one.where("label = most").select(F.col("doc_id").cast("bigint"), "label")
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    return docs.select(F.col("doc_id").cast("bigint"), "text").join(one, "doc_id").dropDuplicates(["doc_id"])


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text), from a model of the
    labelled documents that are not held out; rows without doc_id do not count as held out."""
    known = labels.where(~held_out(labels, folds, fold))
    model = fit(labelled(docs, known, "toxic"))
    return score(docs.withColumn("held_out", held_out(docs, folds, fold)), model, ("doc_id", "held_out"))

"""Language identification as inference of a mixture of languages.

The model holds, per language, the smoothed frequencies of byte trigrams of lower-cased letters,
counted over all labelled documents (hashed to ``BUCKETS``; tasks add up before anything is sent).
A document is cut into segments of ``SEGMENT`` trigrams. Expectation-maximisation estimates the
shares of the languages from the segments' likelihoods; then languages are taken out one by one,
smallest share first, as long as the likelihood falls by less than the penalty per language
(``PENALTY`` * log segments). What is left is the document's set of languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlytics.llm.common import LETTERS, chunks, held_out, lower_ascii

BUCKETS = 1 << 16
SEGMENT = 32
ROUNDS, SHORT_ROUNDS = 15, 8
PENALTY = 2.0
#: Languages a model may have; it stays small whatever the corpus.
MOST_LANGUAGES = 500
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the trigram around each byte; a row is framed by spaces, other signs count as one."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + 2 * rows + 1
    framed = np.full(len(data) + 2 * (len(offsets) - 1), 32, np.uint32)
    framed[at] = np.where(LETTERS[data], lower_ascii(data), 32)
    code = framed[at - 1] << np.uint32(16) | framed[at] << np.uint32(8) | framed[at + 1]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _counted(batches):
    totals: dict[str, np.ndarray] = {}
    for batch, data, offsets in chunks(batches, "text"):
        codes = trigrams(data, offsets)
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])
        of = np.repeat(number, np.diff(offsets))
        for k, name in enumerate(names):
            found = np.bincount(codes[of == k], minlength=BUCKETS)
            totals[name] = totals.get(name, 0) + found
    for name, found in totals.items():
        on = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([name] * len(on), pa.string()),
                "bucket": pa.array(on.astype(np.int32)),
                "n": pa.array(found[on].astype(np.int64)),
            }
        )


def fit(labelled: DataFrame) -> Model:
    """Model from all rows of (text, lang); rows with a null in either are left out."""
    known = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).dropna()
    counts = known.mapInArrow(_counted, "lang string, bucket int, n bigint")
    counts = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MOST_LANGUAGES} can be told apart")
    n = np.full((BUCKETS, len(languages)), 0.1)
    place = {x: k for k, x in enumerate(languages)}
    n[counts["bucket"].to_numpy(), counts["lang"].map(place).to_numpy(dtype=np.int64)] += counts["n"].to_numpy()
    return Model(languages, np.log(n / n.sum(axis=0)).astype(np.float32) if languages else n.astype(np.float32))


def _expect(likelihood, segment_row, starts, share, rounds):
    """EM steps; returns shares and each row's log-likelihood under them (up to a constant)."""
    total = None
    n = np.diff(np.append(starts, len(segment_row)))[:, None]
    for k in range(rounds + 1):
        mixed = likelihood * share[segment_row]
        total = np.maximum(mixed.sum(axis=1), 1e-300)
        if k == rounds:
            break
        share = np.add.reduceat(mixed / total[:, None], starts, axis=0) / n
    return share, np.add.reduceat(np.log(total), starts)


def infer(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of the languages in each row (rows x languages); zeros outside the chosen set."""
    rows, width = len(offsets) - 1, len(model.languages)
    out = np.zeros((rows, width))
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    if not len(full) or not width:
        return out
    logs = model.log_p[trigrams(data, offsets)]
    pieces = -(-size[full] // SEGMENT)
    row = np.repeat(np.arange(len(full)), pieces)
    starts = np.cumsum(pieces) - pieces
    begin = offsets[:-1][full][row] + (np.arange(len(row)) - starts[row]) * SEGMENT
    score = np.add.reduceat(logs, begin, axis=0).astype(np.float64)
    likelihood = np.exp(score - score.max(axis=1, keepdims=True))
    active = np.ones((len(full), width), bool)
    share, now = _expect(likelihood, row, starts, np.full((len(full), width), 1 / width), ROUNDS)
    open_ = np.arange(len(full))
    for _ in range(width - 1):
        # Rows that still lose languages are tried without their smallest one.
        smallest = np.where(active[open_], share[open_], np.inf).argmin(axis=1)
        trial = share[open_].copy()
        trial[np.arange(len(open_)), smallest] = 0
        trial = np.maximum(trial, 1e-6) * active[open_]
        trial[np.arange(len(open_)), smallest] = 0
        trial /= trial.sum(axis=1, keepdims=True)
        pick = np.isin(row, open_)
        local = np.searchsorted(open_, row[pick])
        first = np.searchsorted(local, np.arange(len(open_)))
        less, value = _expect(likelihood[pick], local, first, trial, SHORT_ROUNDS)
        fine = now[open_] - value < PENALTY * np.log(pieces[open_] + 1.0)
        won = open_[fine]
        active[won, smallest[fine]] = False
        share[won], now[won] = less[fine], value[fine]
        open_ = won[active[won].sum(axis=1) > 1]
        if not len(open_):
            break
    out[full] = np.where(active, share, 0)
    return out


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    out = np.zeros(rows, bool)
    ascii_letters = np.flatnonzero(LETTERS[data] & (data < 128))
    out[np.searchsorted(offsets, ascii_letters, side="right") - 1] = True
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode()))
    return out


def _predicted(model: Model, kept: list[str]):
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    def run(batches):
        for batch, data, offsets in chunks(batches, "text", 1 << 20):
            share = infer(model, data, offsets)
            known = _has_letter(data, offsets) & (share.sum(axis=1) > 0)
            best = np.where(known, share.argmax(axis=1) if share.shape[1] else 0, len(model.languages))
            score = np.where(known, share.max(axis=1, initial=0.0), 0.0)
            order = np.argsort(-share, axis=1, kind="stable")
            sets = [
                [{"lang": names[k], "share": float(s[k])} for k in o if s[k] > 0] if fine else []
                for o, s, fine in zip(order.tolist(), share, known.tolist())
            ]
            out = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            out += [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0.0, 1.0))]
            out.append(pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "lang_pred", "score", "lang_set"])

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred, score (the share of that language) and
    lang_set (all languages of the text with their shares).

    A null text or one without a letter is ``und`` with score 0 and an empty set, as is every text
    under a model without languages. Ties go to the first language by name. An empty table gives
    no rows; other columns are ignored.
    """
    given = docs.select(*keep, *([] if "text" in keep else ["text"]))
    fields = [f for f in given.schema if f.name in keep]
    types = T.StructType.fromDDL("lang_pred string, score double, lang_set array<struct<lang:string,share:double>>")
    return given.mapInArrow(_predicted(model, list(keep)), T.StructType([*fields, *types]))


def identify(docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_set of every row of (doc_id, text, lang), from a
    model of the rows that are not held out. Rows without doc_id are not learned from and do not
    count as held out."""
    given = docs.withColumn("held_out", held_out(docs, folds, fold))
    model = fit(given.where("doc_id is not null and not held_out"))
    return predict(given, model, ("doc_id", "held_out"))

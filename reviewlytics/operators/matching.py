"""Seed phrases against review texts: the costly operator of the library.

A seed phrase is a case-insensitive regex, and it matches inside words. Every text has to be
tested against every phrase, so the plan is about doing that in one narrow pass:

* Seeds are a dimension. They are collected in batches of a checked size, all of which meet the
  reviews in the same pass, so no seed is ever dropped and texts are read once.
* Plain phrases (printable ASCII, no regex operator; practically all of them) are found by one
  multi-pattern automaton per batch, built once per Python worker and fed with Arrow batches. Its
  cost does not depend on the number of phrases.
* Real regexes stay in the JVM as constant patterns, compiled once per task.
* Texts are never shuffled, exploded or joined: the matches of a review are an array next to
  its ids, and the text is dropped right there.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from reviewlytics.functions.text import fold_text, ignore_case
from reviewlytics.operators.bounded import rows_within

HIT = "struct<seed_id:bigint,feature_id:bigint,weight:bigint,mentions:bigint>"

# Printable ASCII without the characters that mean something in a regex.
_PLAIN = re.compile(r"[ !\"#%&',\-/0-9:;<=>@A-Z_`a-z~]+")


@dataclass(frozen=True)
class MatchLimits:
    """Sizes of one batch of seeds. Larger seed tables make more batches."""

    plain_per_pass: int = 200_000
    regexes_per_pass: int = 200
    # Fewer plain phrases than this are cheaper as regexes in the JVM.
    automaton_from: int = 8


@dataclass(frozen=True)
class SeedBatch:
    plain: tuple[tuple[str, int, int, int], ...]  # folded phrase, seed, feature, weight
    regexes: tuple[tuple[str, int, int, int], ...]  # pattern, seed, feature, weight


def _automaton_available() -> bool:
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return False
    return True


def seed_batches(seed: DataFrame, limits: MatchLimits = MatchLimits()) -> Iterator[SeedBatch]:
    """Collect the seeds, at most one pass' worth at a time."""
    rows = seed.filter(F.col("seed_phrase") != "").select(
        "seed_phrase",
        "seed_id",
        "feature_id",
        F.coalesce(F.col("weight"), F.lit(0)).cast("bigint").alias("weight"),
    )
    use_automaton = _automaton_available()
    room = limits.plain_per_pass if use_automaton else limits.regexes_per_pass
    everything = rows_within(rows, room)
    if everything is not None:
        yield from _split(everything, use_automaton, limits)
        return
    parts = -(-rows.count() // room)
    for part in range(parts):
        mine = rows.filter(F.pmod(F.xxhash64("seed_id"), F.lit(parts)) == part)
        yield from _split(mine.collect(), use_automaton, limits)


def _split(rows: list[Row], use_automaton: bool, limits: MatchLimits) -> Iterator[SeedBatch]:
    plain, regexes = [], []
    for row in rows:
        is_plain = use_automaton and _PLAIN.fullmatch(row.seed_phrase)
        (plain if is_plain else regexes).append(tuple(row))
    if len(plain) < limits.automaton_from:
        regexes, plain = plain + regexes, []
    folded = tuple((phrase.lower(), *rest) for phrase, *rest in plain)
    step = limits.regexes_per_pass
    yield SeedBatch(folded, tuple(regexes[:step]))
    for start in range(step, len(regexes), step):
        yield SeedBatch((), tuple(regexes[start : start + step]))


#: Automata of the seed batches that a Python worker met last; tasks of one query share them.
_AUTOMATA: dict[str, tuple] = {}
_KEPT_AUTOMATA = 16


def _automaton(name: str, seeds: tuple) -> tuple:
    """Automaton over the phrases of a batch, and the seeds of each phrase."""
    if name not in _AUTOMATA:
        import ahocorasick

        by_phrase: dict[str, list[int]] = {}
        for nth, (phrase, *_) in enumerate(seeds):
            by_phrase.setdefault(phrase, []).append(nth)
        automaton = ahocorasick.Automaton()
        for phrase, members in by_phrase.items():
            automaton.add_word(phrase, (len(phrase), members))
        automaton.make_automaton()
        while len(_AUTOMATA) >= _KEPT_AUTOMATA:
            del _AUTOMATA[next(iter(_AUTOMATA))]
        _AUTOMATA[name] = automaton, by_phrase
    return _AUTOMATA[name]


def _count_matches(automaton, folded: str) -> dict[int, int]:
    """Non-overlapping occurrences per phrase, keyed by the phrase's first seed."""
    free_from: dict[int, int] = {}
    counts: dict[int, int] = {}
    for end, (length, members) in automaton.iter(folded):
        phrase = members[0]
        if end - length + 1 >= free_from.get(phrase, 0):
            free_from[phrase] = end + 1
            counts[phrase] = counts.get(phrase, 0) + 1
    return counts


def _hits_of(texts: pa.Array, automata: list[tuple]) -> pa.Array:
    """Hits of each folded text. One text at a time is a Python string, and hits are kept as plain numbers (the place
    of the seed, its mentions): a worker holds what Spark has sent it and little else, however many rows and hits that is."""
    offsets, found, mentions = array("i", [0]), array("q"), array("q")
    for text in texts:
        folded, base = text.as_py() or "", 0
        for automaton, by_phrase, seeds in automata:
            for first, count in _count_matches(automaton, folded).items():
                for nth in by_phrase[seeds[first][0]]:
                    found.append(base + nth)
                    mentions.append(count)
            base += len(seeds)
        offsets.append(len(found))
    places, counts = (pa.Array.from_buffers(pa.int64(), len(c), [None, pa.py_buffer(c)]) for c in (found, mentions))
    # Values of a seed may be null.
    columns = [pa.array([seed[k] for *_, seeds in automata for seed in seeds], pa.int64()).take(places) for k in (1, 2, 3)]
    structs = pa.StructArray.from_arrays([*columns, counts], ["seed_id", "feature_id", "weight", "mentions"])
    ends = pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)])
    return pa.ListArray.from_arrays(ends, structs)


def _plain_hits(text: Column, batches: list[SeedBatch], spark) -> Column:
    sent = [(uuid.uuid4().hex, spark.sparkContext.broadcast(b.plain)) for b in batches]

    @F.arrow_udf(f"array<{HIT}>")
    def hits_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = [(*_automaton(name, seeds.value), seeds.value) for name, seeds in sent]
        for texts in parts:
            yield _hits_of(texts, automata)

    return hits_of(fold_text(text))


def _regex_hits(text: Column, batch: SeedBatch) -> Column:
    found = []
    for pattern, seed_id, feature_id, weight in batch.regexes:
        fixed = (seed_id, feature_id, weight)
        mentions = F.regexp_count(text, F.lit(ignore_case(pattern))).cast("bigint")
        hit = F.struct(*[F.lit(v).cast("bigint") for v in fixed], mentions).cast(HIT)
        found.append(hit)
    return F.filter(F.array(found), lambda hit: hit["mentions"] > 0)


def _attach(review: DataFrame, seed: DataFrame, keep: list[str], text: str, limits: MatchLimits) -> DataFrame:
    """``keep`` and the hits of all seeds, in one pass over the texts."""
    batches = list(seed_batches(seed, limits))
    arrays = [_regex_hits(F.col(text), batch) for batch in batches if batch.regexes]
    plain = [batch for batch in batches if batch.plain]
    if plain:
        arrays.append(_plain_hits(F.col(text), plain, review.sparkSession))
    hits = F.concat(*arrays) if arrays else F.array().cast(f"array<{HIT}>")
    return review.select(*keep, hits.alias("hits"))


def match_seeds(
    review: DataFrame,
    seed: DataFrame,
    keep: list[str],
    text: str = "review_text",
    limits: MatchLimits = MatchLimits(),
) -> DataFrame:
    """One row per (review, matching seed): ``keep`` + seed_id, feature_id, weight, mentions."""
    attached = _attach(review, seed, keep, text, limits)
    # A plain inline makes the optimizer filter on size(hits) > 0 further down, which finds
    # all hits twice. The outer form does not; its row for a text without hits is dropped here.
    rows = attached.select(*keep, F.inline_outer("hits"))
    return rows.filter(F.col("seed_id").isNotNull())


def sentiment_per_feature(
    review: DataFrame,
    seed: DataFrame,
    keep: list[str],
    text: str = "review_text",
    limits: MatchLimits = MatchLimits(),
) -> DataFrame:
    """One row per (review, feature with a match): ``keep`` + feature_id, sentiment.

    The sum over the seeds of a feature is taken inside the review's row, whatever their number.
    """
    attached = _attach(review, seed, keep, text, limits)
    per_feature = F.transform(
        F.array_distinct(F.transform("hits", lambda hit: hit["feature_id"])),
        lambda feature: F.struct(
            feature.alias("feature_id"),
            F.aggregate(
                F.filter("hits", lambda hit: hit["feature_id"] == feature),
                F.lit(0).cast("bigint"),
                lambda total, hit: total + hit["weight"],
            ).alias("sentiment"),
        ),
    )
    rows = attached.select(*keep, F.inline_outer(per_feature))
    return rows.filter(F.col("feature_id").isNotNull())

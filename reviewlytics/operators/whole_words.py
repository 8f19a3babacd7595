"""Seed phrases as whole words: an equi-join on word sequences.

The normal match (``matching``) takes a phrase as a regex that also matches inside words, so every text has to
meet every phrase. Here a phrase is a sequence of words, which occurs where the same words follow one another in a
text, whatever stands between them and whatever the case. Texts are cut into word sequences of the lengths that
phrases have; a Bloom filter over the phrases lets nearly only those pass that are phrases, and what
is left, short rows without any text, is stored and joined to the seeds. So the seeds may be as many as
a table can hold: they are never collected, and no text is compared with a phrase.

A word that many reviews hold would bring all of them to one task. The stored rows are counted
per sequence, and those with more than a thousandth of all rows, at most a thousand, are spread over ``SALTS``
tasks each, their seeds repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.functions.text import fold_text
from reviewlytics.operators.bounded import SALTS
from reviewlytics.operators.lineage import written
from reviewlytics.operators.sketch import BloomFilter

WHOLE_WORD = r"[\p{L}\p{N}_]+"
#: A sequence with more than one in HOT of all rows is spread.
HOT = 1000


def whole_words(text: Column) -> Column:
    """Folded runs of letters, digits and underscores; null for a null text."""
    return F.regexp_extract_all(fold_text(text), F.lit(WHOLE_WORD), F.lit(0))


def _sequences(words: Column, length: int) -> Column:
    """All runs of ``length`` words, joined by a blank."""
    if length == 1:
        return words
    last = F.size(words) - F.lit(length - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, length), " "))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def phrases(seed: DataFrame) -> DataFrame:
    """seed_id, feature_id, weight, _phrase (its words, joined by a blank) and _length; phrases
    without a word are left out, as they match nothing."""
    words = seed.select(
        "seed_id", "feature_id", F.coalesce(F.col("weight"), F.lit(0)).cast("bigint").alias("weight"),
        whole_words(F.col("seed_phrase")).alias("_words"),
    )
    some = words.filter(F.size("_words") > 0)
    return some.select("seed_id", "feature_id", "weight", F.array_join("_words", " ").alias("_phrase"), F.size("_words").alias("_length"))


def _joined(review: DataFrame, seed: DataFrame, keep: list[str], text: str, once: bool) -> DataFrame:
    """``keep``, _row (a number of the review's row), seed_id, feature_id, weight for every place at
    which a phrase occurs; ``once``: for every phrase of a text."""
    listed = phrases(seed)
    # Numbers of words, not seeds.
    lengths = sorted(r[0] for r in listed.select("_length").distinct().collect())
    known = BloomFilter(listed.select("_phrase").distinct(), "_phrase")
    words = review.select(*keep, F.monotonically_increasing_id().alias("_row"), whole_words(F.col(text)).alias("_words"))
    runs = [_sequences(F.col("_words"), n) for n in lengths] or [F.array().cast("array<string>")]
    runs = F.concat(*runs)
    found = words.select(*keep, "_row", F.explode(F.array_distinct(runs) if once else runs).alias("_phrase"))
    found = written(found.filter(known.may_contain(F.col("_phrase"))), "word-sequences")
    per_phrase = found.groupBy("_phrase").agg(F.count(F.lit(1)).alias("_rows"))
    total = found.count()
    # At most HOT rows can be above the share.
    hot = [r[0] for r in per_phrase.filter(F.col("_rows") * HOT > total).filter(F.col("_rows") > SALTS * 1000).collect()]
    spread = F.col("_phrase").isin(hot)
    salt = F.when(spread, F.pmod(F.xxhash64("_row"), F.lit(SALTS).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    salts = F.when(spread, F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.expr("array(0L)"))
    salted = listed.drop("_length").withColumn("_salt", F.explode(salts))
    # Both sides shuffle whatever their size: the optimizer may take repeated seeds, or what it knows of the found
    # sequences, for little enough to broadcast.
    return found.withColumn("_salt", salt).join(salted.hint("merge"), ["_phrase", "_salt"]).drop("_phrase", "_salt")


def match_whole_words(review: DataFrame, seed: DataFrame, keep: list[str], text: str = "review_text") -> DataFrame:
    """One row per (review, seed whose words it holds): ``keep`` + seed_id, feature_id, weight, mentions
    (places at which the phrase begins). Each row of ``review`` is a review of its own."""
    rows = _joined(review, seed, keep, text, once=False)
    rows = rows.groupBy(*keep, "_row", "seed_id", "feature_id", "weight").agg(F.count(F.lit(1)).alias("mentions"))
    return rows.drop("_row")


def whole_word_sentiment(review: DataFrame, seed: DataFrame, keep: list[str], text: str = "review_text") -> DataFrame:
    """One row per (review, feature with a match): ``keep`` + feature_id, sentiment, the sum of the weights of
    its seeds; a seed counts once."""
    rows = _joined(review, seed, keep, text, once=True)
    return rows.groupBy(*keep, "_row", "feature_id").agg(F.sum("weight").alias("sentiment")).drop("_row")

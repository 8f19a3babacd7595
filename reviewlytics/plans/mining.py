"""Seed-term mining: weighted phrases around aspect keywords.

Sentences and phrases are narrow: each text is exploded into sentences, and only sentences
with a keyword go on. The one wide step counts (file, aspect, phrase) with map-side
combination; the merge over files works on its small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.functions.text import (
    POLARITY_PLACES,
    clean_words,
    polarity,
    sentences,
    unscale,
    valence_sum,
    words,
)
from reviewlytics.plans.aspects import WordLookups, WordTables

# Words left and right of the keyword that make up a phrase of two or three.
WINDOWS = ((0, 1), (1, 0), (0, 2), (1, 1), (2, 0))
MIN_ABS_WEIGHT = 1e-6
MIN_PHRASE_FREQ = 2


def sentence_words(
    reviews: DataFrame, look: WordLookups, keys: list[str], text: str = "review"
) -> DataFrame:
    """One row per sentence that has clean words: keys + sentence_no, words, clean. ``keys`` includes
    the columns of the lookups' large tables, if any."""
    sentence = reviews.select(*keys, F.posexplode(sentences(F.col(text))).alias("sentence_no", "s"))
    # explode of a one-element array evaluates the tokeniser once.
    split = sentence.select(*keys, "sentence_no", F.explode(F.array(words(F.col("s")))).alias("words"))
    cleaned = F.array(clean_words(F.col("words"), look.is_stop_word))
    return split.withColumn("clean", F.explode(cleaned)).filter(F.size("clean") > 0)


def _phrases(look: WordLookups) -> Column:
    """Distinct phrases around word ``pos`` of ``clean`` that pass the noun gate."""
    pos, clean = F.col("pos"), F.col("clean")
    keyword = F.get(clean, pos)
    before = F.get(clean, pos - 1)
    after_fitting = F.when(pos >= 1, look.tag(before).rlike("^[JN]")).otherwise(False)
    candidates = []
    for left, right in WINDOWS:
        fits = (pos >= left) & (pos + right < F.size(clean))
        phrase = F.array_join(
            F.slice(clean, F.greatest(pos - left + 1, F.lit(1)), F.lit(left + right + 1)), " "
        )
        starts_with_keyword = F.get(clean, pos - left) == keyword
        candidates.append(F.when(fits & (starts_with_keyword | after_fitting), phrase))
    kept = F.array_distinct(F.array_compact(F.array(*candidates)))
    return F.when(look.tag(keyword).startswith("N"), kept)


def aspect_phrases(
    reviews: DataFrame, tables: WordTables, keys: list[str], text: str = "review"
) -> DataFrame:
    """Per keyword occurrence and phrase: keys + sentence_no, pos, aspect, phrase, polarity.

    ``polarity`` is that of the whole sentence, scaled to a long.
    """
    look = WordLookups(tables)
    carried = [*keys, *look.columns]
    sentence = sentence_words(look.attach(reviews, text), look, carried, text).filter(
        F.exists("clean", look.is_keyword)
    )
    keyword_at = F.filter(
        F.transform("clean", lambda w, i: F.when(look.is_keyword(w), i)),
        lambda i: i.isNotNull(),
    )
    occurrence = sentence.select(
        *carried, "sentence_no", "clean",
        F.explode(F.array(polarity(valence_sum(F.col("words"), look.valence)))).alias("polarity"),
    ).select("*", F.explode(keyword_at).alias("pos"))
    phrase = occurrence.select("*", F.explode(_phrases(look)).alias("phrase"))
    aspects = look.aspects(F.get(F.col("clean"), F.col("pos")))
    return phrase.select(
        *keys, "sentence_no", "pos", F.explode(aspects).alias("aspect"), "phrase", "polarity"
    )


def _supported(df: DataFrame, mean: str, support: str, min_abs: float, min_support: int):
    """Enough support and a mean that is not zero (means are scaled)."""
    return df.filter(
        (F.col(support) >= min_support)
        & (F.abs(mean) / F.lit(float(10**POLARITY_PLACES)) > F.lit(min_abs))
    )


def _mean(total: Column, count: Column) -> Column:
    return total.cast("double") / count.cast("double")


def phrase_scores_by_file(
    reviews: DataFrame,
    tables: WordTables,
    keys: list[str],
    text: str = "review",
    min_abs_weight: float = MIN_ABS_WEIGHT,
    min_phrase_freq: int = MIN_PHRASE_FREQ,
) -> DataFrame:
    """Per file (``keys``), aspect and phrase: support and mean polarity, scaled to a long."""
    found = aspect_phrases(reviews, tables, keys, text)
    scored = (
        found.groupBy(*keys, "aspect", "phrase")
        .agg(F.sum("polarity").alias("total"), F.count(F.lit(1)).alias("support"))
        .withColumn("mean", _mean(F.col("total"), F.col("support")))
    )
    kept = _supported(scored, "mean", "support", min_abs_weight, min_phrase_freq)
    return kept.select(
        *keys, "aspect", "phrase", "support",
        F.round("mean", 0).cast("bigint").alias("weight_scaled"),
    )


def by_hotel_rows(by_file: DataFrame) -> DataFrame:
    """Seed rows per file: hotel, city, feature_name, seed_phrase, weight."""
    return by_file.select(
        "hotel", "city", F.initcap("aspect").alias("feature_name"),
        F.col("phrase").alias("seed_phrase"), unscale(F.col("weight_scaled")).alias("weight"),
    )


def merge_files(
    by_file: DataFrame,
    min_abs_weight: float = MIN_ABS_WEIGHT,
    min_phrase_freq: int = MIN_PHRASE_FREQ,
    weighted: bool = False,
) -> DataFrame:
    """Seeds over all files: feature_name, seed_phrase, weight.

    By default every file counts once: the weight is the plain mean of the files' rounded
    weights and a phrase needs ``min_phrase_freq`` files. ``weighted`` counts a file by the
    phrase's support in it instead.
    """
    votes = F.col("support") if weighted else F.lit(1)
    merged = (
        by_file.groupBy("aspect", "phrase")
        .agg(F.sum(F.col("weight_scaled") * votes).alias("total"), F.sum(votes).alias("support"))
        .withColumn("mean", _mean(F.col("total"), F.col("support")))
    )
    kept = _supported(merged, "mean", "support", min_abs_weight, min_phrase_freq)
    return kept.select(
        F.initcap("aspect").alias("feature_name"),
        F.col("phrase").alias("seed_phrase"),
        unscale(F.round("mean", 0)).alias("weight"),
    )


def seed_terms(
    reviews: DataFrame,
    tables: WordTables,
    text: str = "review",
    min_abs_weight: float = MIN_ABS_WEIGHT,
    min_phrase_freq: int = MIN_PHRASE_FREQ,
    by_hotel: bool = False,
    weighted: bool = False,
) -> DataFrame:
    """Mined seeds of ``reviews`` (file, hotel, city, review), merged or per file."""
    by_file = phrase_scores_by_file(
        reviews, tables, ["file", "hotel", "city"], text, min_abs_weight, min_phrase_freq
    )
    if by_hotel:
        return by_hotel_rows(by_file)
    return merge_files(by_file, min_abs_weight, min_phrase_freq, weighted)

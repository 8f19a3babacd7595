"""Scores of every hotel x feature from the seed matches in its reviews.

One narrow pass over the reviews, map-side aggregation, one shuffle of at most
(tasks x hotels x features) narrow rows. A hotel with a large share of all reviews is
aggregated where its reviews are read, so it makes no hot partition.
"""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.functions.numbers import round_half_up
from reviewlytics.operators.bounded import combine, restrict_to_keys
from reviewlytics.operators.matching import MatchLimits, match_seeds, sentiment_per_feature
from reviewlytics.operators.whole_words import match_whole_words, whole_word_sentiment
from reviewlytics.schema import SCORE_TYPE, Model

# Fixed values of the score: squash bound, prior strength, neutral point, score without
# mentions, and the range.
SQUASH = 0.5
PRIOR_STRENGTH = 20.0
NEUTRAL = 3.0
NO_MENTIONS = 2.5
LOWEST, HIGHEST = 1.0, 5.0


def active_features(feature: DataFrame) -> DataFrame:
    return feature.filter(F.col("is_active") == "Y")


def seed_review_match(
    review: DataFrame, seed: DataFrame, limits: MatchLimits = MatchLimits(), whole_word: bool = False
) -> DataFrame:
    """(review, hotel, seed, feature, weight, mentions) of every matching pair. Phrases are regexes that also
    match inside words; with ``whole_word`` they are sequences of whole words."""
    if whole_word:
        return match_whole_words(review, seed, ["review_id", "hotel_id"])
    return match_seeds(review, seed, ["review_id", "hotel_id"], limits=limits)


def review_feature_sentiment(
    review: DataFrame, seed: DataFrame, limits: MatchLimits = MatchLimits(), whole_word: bool = False
) -> DataFrame:
    """Sum of the weights of the matching seeds per review and feature; a seed counts once."""
    if whole_word:
        return whole_word_sentiment(review, seed, ["hotel_id", "review_id"])
    return sentiment_per_feature(review, seed, ["hotel_id", "review_id"], limits=limits)


def _mentions(total: str = "total_mentions") -> list[Column]:
    """Aggregates over review sentiments. A grid row (NULL sentiment) adds nothing, and the
    positive and negative counts of a pair without any mention stay NULL."""
    s = F.col("sentiment")
    return [
        F.count(s).alias(total),
        F.coalesce(F.sum(s).cast("double") / F.nullif(F.count(s), F.lit(0)), F.lit(0.0)).alias(
            "avg_sentiment"
        ),
        F.sum(F.when(s > 0, 1).when(s.isNotNull(), 0)).alias("positive_mentions"),
        F.sum(F.when(s < 0, 1).when(s.isNotNull(), 0)).alias("negative_mentions"),
    ]


def hotel_feature_mentions(sentiment: DataFrame) -> DataFrame:
    """Reviews with a mention, their mean sentiment, and positive and negative ones."""
    return sentiment.groupBy("hotel_id", "feature_id").agg(*_mentions())


def hotel_feature_grid(hotel: DataFrame, feature: DataFrame) -> DataFrame:
    """Every hotel with every active feature."""
    return combine(hotel.select("hotel_id"), active_features(feature), "feature_id", 10_000)


def shrunk_score(
    mentions: Column,
    avg_sentiment: Column,
    squash: float = SQUASH,
    prior_strength: float = PRIOR_STRENGTH,
    neutral: float = NEUTRAL,
    no_mentions: float = NO_MENTIONS,
) -> Column:
    """Squash the mean sentiment around the neutral point, shrink it by the prior, clamp."""
    n = mentions.cast("double")
    mapped = F.lit(neutral) + F.lit(2.0) * (
        avg_sentiment / (F.lit(squash) + F.abs(avg_sentiment))
    )
    k = F.lit(prior_strength)
    shrunk = (k * F.lit(neutral) + n * mapped) / (k + n)
    score = F.when(mentions == 0, F.lit(no_mentions)).otherwise(shrunk)
    return F.least(F.greatest(score, F.lit(LOWEST)), F.lit(HIGHEST))


def calc_ratings(
    m: Model,
    squash: float = SQUASH,
    prior_strength: float = PRIOR_STRENGTH,
    neutral: float = NEUTRAL,
    no_mentions: float = NO_MENTIONS,
    updated: datetime.date | None = None,
    limits: MatchLimits = MatchLimits(),
    whole_word: bool = False,
) -> DataFrame:
    """A fresh Rating table: one row per hotel and active feature, mentioned or not. ``whole_word`` as
    in ``seed_review_match``."""
    active = active_features(m.feature).select("feature_id")
    seed = m.seed.join(active, "feature_id", "left_semi")
    sentiment = review_feature_sentiment(m.review, seed, limits, whole_word)
    # The grid rides along as rows without a sentiment: one aggregation instead of an
    # aggregation and a join, and reviews of unknown hotels find no grid row.
    grid = hotel_feature_grid(m.hotel, m.feature).select(
        "hotel_id", "feature_id", F.lit(None).cast("bigint").alias("sentiment"),
        F.lit(1).alias("_grid"),
    )
    scored = sentiment.select(
        "hotel_id", "feature_id", "sentiment", F.lit(0).alias("_grid")
    ).unionByName(grid)
    totals = scored.groupBy("hotel_id", "feature_id").agg(
        *_mentions(), F.max("_grid").alias("_grid")
    )
    return _scored(totals, squash, prior_strength, neutral, no_mentions, updated)


def _scored(
    totals: DataFrame,
    squash: float,
    prior_strength: float,
    neutral: float,
    no_mentions: float,
    updated: datetime.date | None,
) -> DataFrame:
    """Rating rows of the pairs that are in the grid."""
    score = shrunk_score(
        F.col("total_mentions"), F.col("avg_sentiment"), squash, prior_strength, neutral,
        no_mentions,
    )
    stamp = F.lit(updated) if updated else F.current_date()
    return totals.filter("_grid = 1").select(
        "hotel_id",
        "feature_id",
        round_half_up(score).cast(SCORE_TYPE).alias("score"),
        "total_mentions",
        "positive_mentions",
        "negative_mentions",
        stamp.alias("last_updated"),
    )


# What a score is made of. Totals of different reviews add up, so they can be kept beside the
# ratings: an added review is matched once, a deleted one is subtracted.
TOTALS = "hotel_id bigint, feature_id bigint, mentions bigint, sentiment bigint, positive bigint, negative bigint"
_COUNTS = ("mentions", "sentiment", "positive", "negative")


def mention_totals(
    review: DataFrame, seed: DataFrame, limits: MatchLimits = MatchLimits(), whole_word: bool = False
) -> DataFrame:
    """TOTALS of ``review``: per hotel and feature with a mention the reviews that mention it, the sum
    of their sentiments, and the positive and negative ones."""
    found = review_feature_sentiment(review, seed, limits, whole_word)
    s = F.col("sentiment")
    counts = [
        F.count(s).alias("mentions"), F.sum(s).alias("sentiment"),
        F.sum((s > 0).cast("bigint")).alias("positive"), F.sum((s < 0).cast("bigint")).alias("negative"),
    ]
    return found.groupBy("hotel_id", "feature_id").agg(*counts)


def merge_totals(*parts: DataFrame) -> DataFrame:
    """The totals of all parts together; a pair without any mention left is no row."""
    both = reduce(DataFrame.unionByName, parts)
    summed = both.groupBy("hotel_id", "feature_id").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return summed.filter("mentions <> 0")


def taken_away(totals: DataFrame) -> DataFrame:
    """The totals to merge when their reviews have gone."""
    return totals.select("hotel_id", "feature_id", *[(-F.col(c)).alias(c) for c in _COUNTS])


def ratings_from_totals(
    hotel: DataFrame,
    feature: DataFrame,
    totals: DataFrame,
    squash: float = SQUASH,
    prior_strength: float = PRIOR_STRENGTH,
    neutral: float = NEUTRAL,
    no_mentions: float = NO_MENTIONS,
    updated: datetime.date | None = None,
) -> DataFrame:
    """A Rating table from stored totals; no text is read. Equals ``calc_ratings`` over the
    reviews that the totals count."""
    grid = hotel_feature_grid(hotel, feature).select(
        "hotel_id", "feature_id", *[F.lit(None).cast("bigint").alias(c) for c in _COUNTS], F.lit(1).alias("_grid")
    )
    placed = totals.select("hotel_id", "feature_id", *_COUNTS, F.lit(0).alias("_grid")).unionByName(grid)
    n = F.coalesce(F.sum("mentions"), F.lit(0).cast("bigint"))
    mean = F.coalesce(F.sum("sentiment").cast("double") / F.nullif(n, F.lit(0)), F.lit(0.0))
    pairs = placed.groupBy("hotel_id", "feature_id").agg(
        n.alias("total_mentions"), mean.alias("avg_sentiment"), F.sum("positive").alias("positive_mentions"),
        F.sum("negative").alias("negative_mentions"), F.max("_grid").alias("_grid"),
    )
    return _scored(pairs, squash, prior_strength, neutral, no_mentions, updated)


def refresh_hotels(m: Model, touched: DataFrame, totals: DataFrame | None = None, **options) -> DataFrame:
    """The Rating table with the ``touched`` hotels (column hotel_id) scored again; all other rows are
    carried over. Equals a full scoring if nothing but the touched hotels changed.

    With ``totals`` (``mention_totals`` of all reviews as they are now) no text is read; without
    them the touched hotels' reviews are matched.
    """
    keys = touched.select("hotel_id").distinct()
    [kept] = restrict_to_keys([m.rating.drop("rating_id")], "hotel_id", keys, exclude=True)
    if totals is not None:
        hotel, part = restrict_to_keys([m.hotel, totals], "hotel_id", keys)
        options = {k: v for k, v in options.items() if k not in ("limits", "whole_word")}
        return kept.unionByName(ratings_from_totals(hotel, m.feature, part, **options))
    hotel, review = restrict_to_keys([m.hotel, m.review], "hotel_id", keys)
    part = m.with_(hotel=hotel, review=review)
    return kept.unionByName(calc_ratings(part, **options))

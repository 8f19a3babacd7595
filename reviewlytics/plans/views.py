"""The standing views: joined ratings, overall scores, seed list, seed-word analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.functions.clean import weight_label
from reviewlytics.functions.numbers import exact_mean, round_half_up, scaled
from reviewlytics.operators.bounded import join_dimension
from reviewlytics.operators.matching import MatchLimits, match_seeds
from reviewlytics.schema import Model


def rating_with_names(m: Model) -> DataFrame:
    """Hotel, rating and feature rows joined on their keys."""
    named = join_dimension(m.rating, m.feature.select("feature_id", "feature_name"), "feature_id")
    return join_dimension(named, m.hotel.select("hotel_id", "hotel_name", "city", "country"), "hotel_id")


def hotel_ratings(m: Model) -> DataFrame:
    """Per hotel and feature: score and mention counts, by hotel and feature name."""
    columns = [
        "hotel_id", "hotel_name", "city", "country", "feature_name",
        F.col("score").cast("double").alias("score"),
        "total_mentions", "positive_mentions", "negative_mentions", "last_updated",
    ]
    return rating_with_names(m).select(*columns).orderBy("hotel_name", "feature_name")


def rating_stats(m: Model) -> DataFrame:
    """Per hotel: exact mean score and the number of rated (existing) features."""
    known = m.feature.select("feature_id", F.lit(1).alias("_known"))
    return (
        join_dimension(m.rating.select("hotel_id", "feature_id", "score"), known, "feature_id", "left")
        .groupBy("hotel_id")
        .agg(
            exact_mean(F.col("score"), 2).alias("mean_score"),
            F.count("_known").alias("features_rated"),
        )
    )


def review_stats(review: DataFrame) -> DataFrame:
    """Per hotel: number of reviews and exact mean of their ratings (NULL ratings ignored)."""
    return review.groupBy("hotel_id").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        exact_mean(F.col("overall_rating"), 1).alias("mean_review"),
    )


def with_hotel_stats(m: Model, hotel: DataFrame | None = None) -> DataFrame:
    """Every hotel row with its rating and review statistics.

    Ratings and reviews are aggregated before they meet: joined first, they would multiply
    each other per hotel.
    """
    return (
        (m.hotel if hotel is None else hotel)
        .join(rating_stats(m), "hotel_id", "left")
        .join(review_stats(m.review), "hotel_id", "left")
        .na.fill(0, ["features_rated", "total_reviews"])
    )


def hotel_overall(m: Model) -> DataFrame:
    """Per hotel: mean score, rated features, reviews; hotels without any are kept."""
    return with_hotel_stats(m).select(
        "hotel_id", "hotel_name", "city", "country",
        round_half_up(F.col("mean_score")).alias("avg_score"),
        "features_rated", "total_reviews",
    )


def feature_seeds(m: Model) -> DataFrame:
    """Seeds with their feature and the name of their weight, strongest first."""
    return (
        m.feature.select("feature_id", "feature_name")
        .join(m.seed, "feature_id")
        .select(
            "feature_name", "seed_phrase", F.col("weight").cast("bigint").alias("weight"),
            weight_label(F.col("weight")).alias("sentiment"),
        )
        .orderBy("feature_name", F.desc("weight"), "seed_phrase")
    )


def seed_mentions(m: Model, limits: MatchLimits = MatchLimits()) -> DataFrame:
    """Per matching seed: occurrences in all reviews and the mean rating of the reviews.

    One pass answers both. Ratings travel as longs, so the sums stay exact.
    """
    rated = m.review.select(
        "review_id", "review_text", scaled(F.col("overall_rating"), 1).alias("_rating")
    )
    hits = match_seeds(rated, m.seed, ["_rating"], limits=limits)
    rating = F.col("_rating")
    return hits.groupBy("seed_id").agg(
        F.sum("mentions").alias("mentions"),
        F.when(
            F.count(rating) > 0,
            F.sum(rating).cast("double") / (F.lit(10.0) * F.count(rating)),
        ).alias("mean_rating"),
    )


def seed_word_analysis(m: Model, limits: MatchLimits = MatchLimits()) -> DataFrame:
    """Per seed: occurrences, mean rating of the reviews it occurs in, weighted impact."""
    mentions = F.coalesce("mentions", F.lit(0))
    return (
        m.seed.join(m.feature.select("feature_id", "feature_name"), "feature_id")
        .join(seed_mentions(m, limits), "seed_id", "left")
        .select(
            "seed_id", "feature_name", "seed_phrase",
            F.col("weight").cast("bigint").alias("assigned_weight"),
            mentions.alias("total_mentions"),
            round_half_up(F.col("mean_rating"), 6).alias("avg_user_rating_when_present"),
            (mentions * F.col("weight").cast("bigint")).alias("total_impact_score"),
        )
    )

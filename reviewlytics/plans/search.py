"""Search: rating card, recent reviews, city and feature lists, city and threshold search.

The hotels asked for are looked up first. Their ids then restrict ratings and reviews as an
IN list that reaches the scans, so a search reads the rows of its hotels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.functions.clean import rating_band, review_defaults, star_string
from reviewlytics.functions.numbers import exact_mean, round_half_even, round_half_up
from reviewlytics.operators.bounded import join_dimension, restrict_to_keys
from reviewlytics.plans.scoring import active_features as active_rows
from reviewlytics.plans.views import review_stats, with_hotel_stats
from reviewlytics.schema import Model

# The result columns and the name fragments that feed them, in priority order.
ASPECT_NAMES = {
    "cleanliness": ("CLEAN",),
    "service": ("SERVICE",),
    "location": ("LOCATION",),
    "comfort": ("COMFORT",),
    "price": ("PRICE", "VALUE"),
}
RECENT_REVIEWS = 50


def name_contains(name: Column, text: str) -> Column:
    """Case-insensitive LIKE; ``%`` and ``_`` typed by the user stay wildcards."""
    return F.upper(name).like(f"%{text}%".upper())


def name_equals(name: Column, text: str) -> Column:
    return F.upper(name) == F.upper(F.lit(text))


def _mentions_any(feature_name: Column, fragments: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for fragment in fragments:
        found = found | F.upper(feature_name).contains(fragment)
    return found


def _for_hotels(m: Model, hotel: DataFrame) -> Model:
    tables = restrict_to_keys([m.hotel, m.rating, m.review], "hotel_id", hotel)
    return m.with_(hotel=tables[0], rating=tables[1], review=tables[2])


def rating_feature_scores(m: Model) -> DataFrame:
    """(hotel_id, feature_id, feature_name, score): ratings with the name of their feature."""
    names = m.feature.select("feature_id", "feature_name")
    return join_dimension(m.rating.select("hotel_id", "feature_id", "score"), names, "feature_id")


def rating_cards(m: Model) -> DataFrame:
    """One card per hotel.

    A feature feeds exactly one column, the first whose fragment its name contains, and the
    highest feature id wins within a column. The overall score is the mean of all scores,
    else of the review ratings, else 0.
    """
    column = F.lit(None).cast("string")
    for aspect, fragments in reversed(list(ASPECT_NAMES.items())):
        column = F.when(_mentions_any(F.col("feature_name"), fragments), aspect).otherwise(column)
    per_aspect = [
        F.coalesce(
            F.max_by(
                F.when(F.col("_column") == aspect, F.col("score")),
                F.when(F.col("_column") == aspect, F.col("feature_id")),
            ).cast("double"),
            F.lit(0.0),
        ).alias(f"{aspect}_score")
        for aspect in ASPECT_NAMES
    ]
    scores = (
        rating_feature_scores(m)
        .withColumn("_column", column)
        .groupBy("hotel_id")
        .agg(exact_mean(F.col("score"), 2).alias("_mean_score"), *per_aspect)
    )
    joined = m.hotel.join(scores, "hotel_id", "left").join(
        review_stats(m.review), "hotel_id", "left"
    )
    overall = round_half_even(F.coalesce("_mean_score", "mean_review", F.lit(0.0)))
    return joined.na.fill(0.0, [f"{a}_score" for a in ASPECT_NAMES]).select(
        "hotel_id", "hotel_name", "city", "country",
        overall.alias("overall_rating"),
        *[f"{a}_score" for a in ASPECT_NAMES],
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
    )


def first_match(hotel: DataFrame, text: str) -> DataFrame:
    """The hotel with the lowest id among those whose name contains ``text``."""
    return hotel.filter(name_contains(F.col("hotel_name"), text)).orderBy("hotel_id").limit(1)


def hotel_rating_card(m: Model, name: str) -> DataFrame:
    """Card of the first hotel whose name contains ``name``; no row if there is none."""
    card = rating_cards(_for_hotels(m, first_match(m.hotel, name)))
    return card.withColumn("band", rating_band(F.col("overall_rating"))).withColumn(
        "stars", star_string(F.col("overall_rating"))
    )


def newest_reviews(review: DataFrame, hotel: DataFrame, n: int = RECENT_REVIEWS) -> DataFrame:
    """Newest ``n`` reviews of the given hotels; undated ones come first."""
    [theirs] = restrict_to_keys([review], "hotel_id", hotel)
    return theirs.orderBy(F.desc_nulls_first("review_date"), "review_id").limit(n)


def recent_reviews(m: Model, name: str, n: int = RECENT_REVIEWS) -> DataFrame:
    """Newest ``n`` reviews of the hotels called ``name``, gaps filled for display."""
    hotel = m.hotel.filter(name_equals(F.col("hotel_name"), name))
    newest = newest_reviews(m.review, hotel, n)
    return newest.select(*[c.alias(name) for name, c in review_defaults().items()])


def cities(m: Model) -> DataFrame:
    return m.hotel.select("city").distinct().filter(F.col("city").isNotNull()).orderBy("city")


def active_features(m: Model) -> DataFrame:
    return active_rows(m.feature).select("feature_name").orderBy("feature_name")


def in_city(hotel: DataFrame, city: str) -> DataFrame:
    return hotel.filter(F.col("city") == city)


def hotels_by_city(m: Model, city: str) -> DataFrame:
    """Hotels of a city by score: mean rating score, else mean review rating, else 0."""
    here = in_city(m.hotel, city)
    listed = with_hotel_stats(_for_hotels(m, here.select("hotel_id")), here)
    score = F.coalesce("mean_score", "mean_review", F.lit(0.0))
    return (
        listed.withColumn("_score", score)
        .orderBy(F.desc("_score"), "hotel_id")
        .select(
            F.col("hotel_name").alias("name"),
            round_half_up(F.col("_score"), 6).alias("rating"),
            F.col("total_reviews").alias("review_count"),
            rating_band(F.col("_score")).alias("band"),
        )
    )


def feature_pivot(m: Model) -> DataFrame:
    """Per rated hotel: exact mean score and the best score per aspect column.

    The columns are independent: one feature may feed two of them.
    """
    best = [
        F.max(F.when(_mentions_any(F.col("feature_name"), fragments), F.col("score")))
        .cast("double")
        .alias(aspect)
        for aspect, fragments in ASPECT_NAMES.items()
    ]
    return (
        rating_feature_scores(m)
        .groupBy("hotel_id")
        .agg(exact_mean(F.col("score"), 2).alias("overall"), *best)
    )


def at_least(df: DataFrame, thresholds: dict[str, float | None]) -> DataFrame:
    """Rows whose measures reach every threshold that is set; a NULL measure fails."""
    measures = {"overall", *ASPECT_NAMES}
    for measure, threshold in thresholds.items():
        if threshold is not None and measure in measures:
            df = df.filter(F.col(measure) >= F.lit(float(threshold)))
    return df


def advanced_search(m: Model, city: str, min_scores: dict[str, float | None]) -> DataFrame:
    """Rated hotels of a city whose scores reach the thresholds, best first."""
    here = in_city(m.hotel, city)
    local = _for_hotels(m, here.select("hotel_id"))
    counts = review_stats(local.review).select("hotel_id", "total_reviews")
    found = (
        at_least(feature_pivot(local), min_scores)
        .join(here.select("hotel_id", "hotel_name", "city", "country"), "hotel_id")
        .join(counts, "hotel_id", "left")
        .orderBy(F.desc("overall"), "hotel_id")
    )
    rounded = [
        F.coalesce(round_half_even(F.col(a)), F.lit(0.0)).alias(f"{a}_score")
        for a in ASPECT_NAMES
    ]
    overall = round_half_even(F.col("overall"))
    return found.select(
        "hotel_name", "city", "country",
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        overall.alias("overall_rating"), *rounded,
        star_string(overall).alias("stars"),
    )

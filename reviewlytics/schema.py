"""Table schemas and the named set of tables every plan works on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RATING_TYPE = T.DecimalType(2, 1)  # star and overall ratings
SCORE_TYPE = T.DecimalType(5, 2)
WEIGHT_TYPE = T.DecimalType(2, 0)

# The day on which a row was stored; frames that were never stored may lack it, as they may lack rating_id.
CREATED = T.StructField("created_date", T.DateType())

HOTEL = T.StructType(
    [
        T.StructField("hotel_id", T.LongType(), False),
        T.StructField("hotel_name", T.StringType(), False),
        T.StructField("address", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("star_rating", RATING_TYPE),
        CREATED,
    ]
)
FEATURE = T.StructType(
    [
        T.StructField("feature_id", T.LongType(), False),
        T.StructField("feature_name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("is_active", T.StringType()),
        CREATED,
    ]
)
SEED = T.StructType(
    [
        T.StructField("seed_id", T.LongType(), False),
        T.StructField("feature_id", T.LongType(), False),
        T.StructField("seed_phrase", T.StringType(), False),
        T.StructField("weight", WEIGHT_TYPE, False),
        CREATED,
    ]
)
REVIEW = T.StructType(
    [
        T.StructField("review_id", T.LongType(), False),
        T.StructField("hotel_id", T.LongType(), False),
        T.StructField("review_text", T.StringType(), False),
        T.StructField("reviewer_name", T.StringType()),
        T.StructField("review_date", T.DateType()),
        T.StructField("overall_rating", RATING_TYPE),
        CREATED,
    ]
)
RATING = T.StructType(
    [
        T.StructField("rating_id", T.LongType()),
        T.StructField("hotel_id", T.LongType(), False),
        T.StructField("feature_id", T.LongType(), False),
        T.StructField("score", SCORE_TYPE),
        T.StructField("total_mentions", T.LongType()),
        T.StructField("positive_mentions", T.LongType()),
        T.StructField("negative_mentions", T.LongType()),
        T.StructField("last_updated", T.DateType()),
    ]
)

TABLES = {"hotel": HOTEL, "feature": FEATURE, "seed": SEED, "review": REVIEW, "rating": RATING}


def raw_schema(*columns: str) -> T.StructType:
    """All-string schema: raw CSVs hold 'NA' in numeric columns, so nothing is inferred."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


RAW_HOTEL = raw_schema("hotel_name", "address", "city", "country", "star_rating")
RAW_FEATURE = raw_schema("feature_name", "description", "is_active")
RAW_SEED = raw_schema("feature_name", "seed_phrase", "weight")
RAW_REVIEW = raw_schema(
    "hotel_name", "review_text", "reviewer_name", "review_date", "overall_rating"
)


@dataclass(frozen=True)
class Model:
    """The five tables. ``rating`` is derived and may be missing before scoring."""

    hotel: DataFrame
    feature: DataFrame
    seed: DataFrame
    review: DataFrame
    rating: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> "Model":
        return replace(self, **tables)

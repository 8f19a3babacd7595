"""Scalar cleaning and labelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlytics.schema import RATING_TYPE, WEIGHT_TYPE

# Thresholds, labels, patterns and defaults of the data model.
MISSING = "NA"
SLASH_DATE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
POSITIVE_FROM = 0.05
NEGATIVE_TO = -0.05
GREEN_FROM = 4.0
ORANGE_FROM = 3.0
MAX_STARS = 5
STAR = "⭐"
ANONYMOUS = "Anonymous"
NO_DATE = "0001-01-01"


def na_to_number(raw: Column, data_type=RATING_TYPE) -> Column:
    """NULL or ``'NA'`` become NULL, everything else a number (a bad number raises)."""
    return F.when(raw != MISSING, raw.cast(data_type))


def parse_review_date(raw: Column) -> Column:
    """``M/D/YY`` or ``YYYY-MM-DD``; any other shape, or an impossible day, is NULL."""
    return F.when(raw.rlike(SLASH_DATE), F.try_to_date(raw, "M/d/yy")).when(
        raw.rlike(ISO_DATE), F.try_to_date(raw, "yyyy-MM-dd")
    )


def seed_weight(raw: Column) -> Column:
    """Two-digit integer weight: 0.42 becomes 0, 0.5 becomes 1."""
    return raw.cast(WEIGHT_TYPE)


def sentiment_label(
    polarity: Column, positive_from: float = POSITIVE_FROM, negative_to: float = NEGATIVE_TO
) -> Column:
    return (
        F.when(polarity >= positive_from, "positive")
        .when(polarity <= negative_to, "negative")
        .otherwise("neutral")
    )


def weight_label(weight: Column) -> Column:
    """Only 1 and -1 have a name."""
    return F.when(weight == 1, "Positive").when(weight == -1, "Negative")


def rating_band(score: Column) -> Column:
    return (
        F.when(score >= GREEN_FROM, "Green").when(score >= ORANGE_FROM, "Orange").otherwise("Red")
    )


def star_string(rating: Column) -> Column:
    whole = F.bround(rating.cast("decimal(18,8)"), 0).cast("int")
    return F.repeat(F.lit(STAR), F.least(F.greatest(whole, F.lit(0)), F.lit(MAX_STARS)))


def parse_threshold(choice: Column) -> Column:
    """``'>3.5'`` is 3.5; ``'Any'``, an empty or an unreadable choice is no threshold."""
    return F.trim(F.replace(choice, F.lit(">"), F.lit(""))).try_cast("double")


def review_defaults() -> dict[str, Column]:
    """Display columns of a review row with its gaps filled."""
    return {
        "reviewer_name": F.coalesce("reviewer_name", F.lit(ANONYMOUS)),
        "review_text": F.coalesce("review_text", F.lit("")),
        "review_date": F.coalesce("review_date", F.lit(NO_DATE).cast("date")),
        "rating": F.coalesce(F.col("overall_rating").cast("double"), F.lit(0.0)),
    }


def empty_to_null(text: Column) -> Column:
    """The source database stores an empty string as NULL."""
    return F.nullif(text, F.lit(""))


def title_case(text: Column) -> Column:
    """Capitalise after every non-letter, not only after blanks: ``o'neil`` -> ``O'Neil``."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")

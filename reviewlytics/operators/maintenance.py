"""Batch appends with rejections, constraint checks, cascading deletes.

Rejected rows are reported per key and reason with their number, so that a batch full of
copies of one row makes one line and no hot group.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.functions.clean import empty_to_null
from reviewlytics.operators.bounded import join_dimension, restrict_to_keys
from reviewlytics.operators.ids import assign_ids, last_id, unique_ids
from reviewlytics.schema import RATING_TYPE, WEIGHT_TYPE, Model

# What the tables allow.
ACTIVE_FLAGS = ("Y", "N")
SEED_WEIGHTS = (-1, 1)
LOWEST_RATING, HIGHEST_RATING = 1, 5


class Appended(NamedTuple):
    """``table`` = existing rows and accepted ones; ``rejected``: key (an array), reason, rows."""

    table: DataFrame
    accepted: DataFrame
    rejected: DataFrame


class AppendedHotels(NamedTuple):
    hotel: DataFrame
    review: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    accepted_reviews: DataFrame


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key (the smallest) and the number of rows it stands for."""
    rest = [c for c in df.columns if c not in keys]
    smallest = F.min(F.struct(*[F.col(c) for c in rest])) if rest else F.min(F.lit(1))
    grouped = df.groupBy(*keys).agg(smallest.alias("_first"), F.count(F.lit(1)).alias("_rows"))
    return grouped.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest], "_rows")


def _key_values(keys: list[str]) -> Column:
    """The key's columns as an array: no separator that a value may hold, nulls stay nulls."""
    return F.array(*[F.col(k).cast("string") for k in keys]).alias("key")


def _rejected(df: DataFrame, keys: list[str], reason: str, rows: Column) -> DataFrame:
    """Counted per key; each row of ``df`` stands for ``rows`` rows."""
    return (
        df.select(_key_values(keys), F.lit(reason).alias("reason"), rows.alias("rows"))
        .groupBy("key", "reason")
        .agg(F.sum("rows").alias("rows"))
    )


def _dedupe(new: DataFrame, existing: DataFrame, keys: list[str]):
    """(rows to accept, rejections) of a batch under a unique key.

    The first of equal keys is accepted unless the key is taken; the others are duplicates.
    Keys compare null-safe.
    """
    one = one_per_key(new, keys)
    taken = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    taken = taken.withColumn("_taken", F.lit(1))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    marked = one.join(taken, same, "left")
    free = marked.filter(F.col("_taken").isNull())
    refused = F.when(F.col("_taken").isNull(), F.col("_rows") - 1).otherwise(F.col("_rows"))
    rejected = _rejected(marked.filter(refused > 0), keys, "duplicate", refused)
    return free.select(*new.columns), rejected


def _as_rows_of(table: DataFrame, rows: DataFrame, day: Column | None = None) -> DataFrame:
    """``rows`` in the columns of ``table``, dated if the table says when a row was stored."""
    if "created_date" in table.columns and "created_date" not in rows.columns:
        rows = rows.withColumn("created_date", F.current_date() if day is None else day)
    return rows.select(*table.columns)


def append_features(m: Model, new: DataFrame) -> Appended:
    """Add features (feature_name, description); a name already present is rejected."""
    described = "description" in new.columns
    description = F.col("description") if described else F.lit(None).cast("string")
    rows = new.select("feature_name", description.alias("description"))
    unnamed = rows.filter(F.col("feature_name").isNull())
    named = rows.filter(F.col("feature_name").isNotNull())
    fresh, rejected = _dedupe(named, m.feature, ["feature_name"])
    numbered = assign_ids(fresh, "feature_id", ["feature_name"], last_id(m.feature, "feature_id"))
    accepted = _as_rows_of(m.feature, numbered.withColumn("is_active", F.lit("Y")))
    missing = _rejected(unnamed, ["feature_name"], "missing name", F.lit(1))
    return Appended(m.feature.unionByName(accepted), accepted, rejected.unionByName(missing))


def append_seeds(m: Model, new: DataFrame) -> Appended:
    """Add seeds (feature_name, seed_phrase, weight): the feature must exist, the weight must be
    1 or -1, and a phrase may occur once per feature."""
    names = m.feature.select("feature_id", "feature_name")
    wanted = new.select("feature_name", "seed_phrase", "weight")
    located = join_dimension(wanted, names, "feature_name", "left")
    keys = ["feature_name", "seed_phrase"]
    unknown = F.col("feature_id").isNull()
    bad_weight = ~unknown & ~F.coalesce(F.col("weight").isin(*SEED_WEIGHTS), F.lit(False))
    usable = located.filter(~unknown & ~bad_weight).select(
        "feature_id", "seed_phrase", F.col("weight").cast(WEIGHT_TYPE).alias("weight"), "feature_name"
    )
    fresh, duplicates = _dedupe(usable.drop("feature_name"), m.seed, ["feature_id", "seed_phrase"])
    numbered = assign_ids(fresh, "seed_id", ["feature_id", "seed_phrase"], last_id(m.seed, "seed_id"))
    accepted = _as_rows_of(m.seed, numbered)
    one = F.lit(1)
    rejected = (
        duplicates.unionByName(_rejected(located.filter(unknown), keys, "unknown feature", one))
        .unionByName(_rejected(located.filter(bad_weight), keys, "weight must be -1 or 1", one))
    )
    return Appended(m.seed.unionByName(accepted), accepted, rejected)


def _bad_rating(rating: Column) -> Column:
    return rating.isNotNull() & ~rating.between(LOWEST_RATING, HIGHEST_RATING)


def append_reviews(m: Model, new: DataFrame, today: datetime.date | None = None) -> Appended:
    """Add reviews by exact hotel name (hotel_name, review_text, reviewer_name, review_date,
    overall_rating). A missing date becomes ``today``. An unknown hotel, a name two hotels
    share, a missing text and a rating outside 1..5 are rejected. Write the accepted rows
    before anything refers to their ids."""
    lookup = m.hotel.groupBy("hotel_name").agg(
        F.min("hotel_id").alias("hotel_id"), F.count(F.lit(1)).alias("_hotels")
    )
    located = join_dimension(new, lookup, "hotel_name", "left").withColumn(
        "_reason",
        F.when(F.col("hotel_id").isNull(), "unknown hotel")
        .when(F.col("_hotels") > 1, "ambiguous hotel")
        .when(empty_to_null(F.col("review_text")).isNull(), "missing text")
        .when(_bad_rating(F.col("overall_rating")), "rating out of range"),
    )
    day = F.lit(today) if today else F.current_date()
    good = located.filter(F.col("_reason").isNull()).select(
        "hotel_id", "review_text", "reviewer_name",
        F.coalesce("review_date", day).alias("review_date"),
        F.col("overall_rating").cast(RATING_TYPE).alias("overall_rating"),
    )
    numbered = unique_ids(good, "review_id", last_id(m.review, "review_id"))
    accepted = _as_rows_of(m.review, numbered, day)
    rejected = (
        located.filter(F.col("_reason").isNotNull())
        .groupBy(_key_values(["hotel_name"]), F.col("_reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return Appended(m.review.unionByName(accepted), accepted, rejected)


def append_hotels_with_review(
    m: Model, new: DataFrame, today: datetime.date | None = None
) -> AppendedHotels:
    """Add hotels (hotel_name, address, city, country, star_rating, review_text,
    reviewer_name), each with its first review if a text is given. A (name, city) already
    present, a missing name and a star rating outside 1..5 are rejected."""
    missing = F.col("hotel_name").isNull()
    bad_star = ~missing & _bad_rating(F.col("star_rating"))
    usable = new.filter(~missing & ~bad_star)
    fresh, duplicates = _dedupe(usable, m.hotel, ["hotel_name", "city"])
    numbered = assign_ids(fresh, "hotel_id", ["hotel_name", "city"], last_id(m.hotel, "hotel_id"))
    star = F.col("star_rating").cast(RATING_TYPE)
    day = F.lit(today) if today else F.current_date()
    hotels = _as_rows_of(m.hotel, numbered.withColumn("star_rating", star), day)
    first = numbered.filter(empty_to_null(F.col("review_text")).isNotNull()).select(
        "hotel_id", "review_text", "reviewer_name", day.alias("review_date"),
        F.lit(None).cast(RATING_TYPE).alias("overall_rating"),
    )
    numbered = assign_ids(first, "review_id", ["hotel_id"], last_id(m.review, "review_id"))
    reviews = _as_rows_of(m.review, numbered, day)
    keys, one = ["hotel_name", "city"], F.lit(1)
    rejected = duplicates.unionByName(
        _rejected(new.filter(missing), keys, "missing name", one)
    ).unionByName(_rejected(new.filter(bad_star), keys, "star rating out of range", one))
    return AppendedHotels(
        m.hotel.unionByName(hotels), m.review.unionByName(reviews), hotels, rejected, reviews
    )


# What a row of a check is: a broken row, a key that may occur once, a reference, or what it refers to.
_BROKEN, _UNIQUE, _REFERENCE, _REFERRED = "broken", "unique", "reference", "referred"


@dataclass(frozen=True)
class _Rules:
    """The constraints of a table: key columns that name a broken row, rules with the condition that breaks
    them, unique keys, and references (column -> table that holds it)."""

    named_by: list[str]
    broken: dict[str, Column]
    unique: list[list[str]]
    references: dict[str, str] = field(default_factory=dict)


def _checks(table: str, df: DataFrame, rules: dict[str, _Rules]) -> DataFrame:
    """table, rule, key, kind for everything that a row has to do with, in one scan."""
    own = rules[table]

    def check(of: str, rule: str, keys: list[str], kind: str, when: Column) -> Column:
        values = [F.lit(of).alias("table"), F.lit(rule).alias("rule"), _key_values(keys), F.lit(kind).alias("kind")]
        return F.when(when, F.struct(*values))

    found = [check(table, rule, own.named_by, _BROKEN, bad) for rule, bad in own.broken.items()]
    for keys in own.unique:  # A key without any value is none.
        has_value = F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull()
        found.append(check(table, f"{', '.join(keys)} unique", keys, _UNIQUE, has_value))
    for column in own.references:
        found.append(check(table, f"{column} exists", [column], _REFERENCE, F.col(column).isNotNull()))
    for child, theirs in rules.items():
        for column, parent in theirs.references.items():
            if parent == table:
                found.append(check(child, f"{column} exists", [column], _REFERRED, F.col(column).isNotNull()))
    return df.select(F.inline(F.array_compact(F.array(*found))))


def validate(m: Model) -> DataFrame:
    """Violations of the table constraints: table, rule, key, rows. Empty if all hold.

    Every table is scanned once: a row reports the rules it breaks, its unique keys, its references and what
    others may refer to; all of that is counted by rule and key in one aggregation, which combines
    references to one parent before they are shuffled.
    """

    def missing(*columns: str) -> dict[str, Column]:
        # An empty text counts as none, as it does for appended rows.
        return {f"{c} not null": empty_to_null(F.col(c).cast("string")).isNull() for c in columns}

    def out_of_range(column: str) -> dict[str, Column]:
        rule = f"{column} between {LOWEST_RATING} and {HIGHEST_RATING}"
        return {rule: _bad_rating(F.col(column))}

    stars = out_of_range("star_rating") if "star_rating" in m.hotel.columns else {}
    flag = {"is_active in Y, N": ~F.col("is_active").isin(*ACTIVE_FLAGS)}
    rules = {
        "hotel": _Rules(
            ["hotel_id"], missing("hotel_id", "hotel_name") | stars, [["hotel_id"], ["hotel_name", "city"]]
        ),
        "feature": _Rules(
            ["feature_id"], missing("feature_id", "feature_name") | flag, [["feature_id"], ["feature_name"]]
        ),
        "seed": _Rules(
            ["seed_id"], missing("seed_id", "feature_id", "seed_phrase", "weight"),
            [["seed_id"], ["feature_id", "seed_phrase"]], {"feature_id": "feature"},
        ),
        "review": _Rules(
            ["review_id"], missing("review_id", "hotel_id", "review_text") | out_of_range("overall_rating"),
            [["review_id"]], {"hotel_id": "hotel"},
        ),
    }
    if m.rating is not None:
        pair = ["hotel_id", "feature_id"]
        numbered = ["rating_id"] if "rating_id" in m.rating.columns else []
        rules["rating"] = _Rules(
            pair, missing(*numbered, *pair, "score"), [pair, *[[c] for c in numbered]],
            {"hotel_id": "hotel", "feature_id": "feature"},
        )
    checks = reduce(DataFrame.unionByName, [_checks(name, getattr(m, name), rules) for name in rules])
    # References and what they refer to meet under one rule and key.
    kind = F.when(F.col("kind") == _REFERRED, _REFERENCE).otherwise(F.col("kind"))
    counted = checks.groupBy("table", "rule", "key", kind.alias("kind")).agg(
        F.count(F.when(F.col("kind") != _REFERRED, 1)).alias("rows"),
        F.bool_or(F.col("kind") == _REFERRED).alias("referred"),
    )
    wrong = (
        (F.col("kind") == _BROKEN)
        | ((F.col("kind") == _UNIQUE) & (F.col("rows") > 1))
        | ((F.col("kind") == _REFERENCE) & (F.col("rows") > 0) & ~F.col("referred"))
    )
    return counted.filter(wrong).select("table", "rule", F.array_join("key", "|").alias("key"), "rows")


def cascade_delete(
    m: Model, hotels: DataFrame | None = None, features: DataFrame | None = None
) -> Model:
    """Delete hotels (hotel_id) and features (feature_id) with everything that refers to them."""

    def without(m: Model, key: str, deleted: DataFrame, *names: str) -> Model:
        present = [n for n in names if getattr(m, n) is not None]
        kept = restrict_to_keys([getattr(m, n) for n in present], key, deleted, exclude=True)
        return m.with_(**dict(zip(present, kept)))

    if hotels is not None:
        m = without(m, "hotel_id", hotels, "hotel", "review", "rating")
    if features is not None:
        m = without(m, "feature_id", features, "feature", "seed", "rating")
    return m

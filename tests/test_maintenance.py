"""Appends with rejections, constraint checks, cascades."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reviewlytics.operators import maintenance
from reviewlytics.plans import scoring

HOTELS = [(1, "Alpha", "Rome"), (2, "Alpha", "Oslo"), (3, "Beta", "Rome"), (4, "Solo", None)]
FEATURES = [(1, "Cleanliness", "Y"), (7, "Parking", "N")]
SEEDS = [(5, 1, "clean", 1)]
REVIEWS = [(10, 1, "clean", None, 4.0), (11, 3, "x", None, 2.0)]
RATINGS = [(1, 1, 3.0), (3, 1, 2.5), (3, 7, 2.5)]
TODAY = datetime.date(2025, 6, 1)


@pytest.fixture
def model(make_model):
    return make_model(HOTELS, FEATURES, SEEDS, REVIEWS, RATINGS)


def rejections(result):
    return {("|".join(x for x in r.key if x is not None), r.reason): r.rows for r in result.rejected.collect()}


def test_keys_with_separators_stay_apart_and_copies_count_once(model, rows):
    existing = model.with_(feature=model.feature.union(model.feature))  # stored twice
    new = rows([("Parking", None)], "feature_name string, description string")
    assert rejections(maintenance.append_features(existing, new)) == {("Parking", "duplicate"): 1}
    hotels = rows(
        [("a|b", "c", None), ("a", "b|c", None), ("a|b", "c", None), ("a", "b|c", None)],
        "hotel_name string, city string, review_text string",
    )
    for column in ("address", "country", "reviewer_name"):
        hotels = hotels.withColumn(column, F.lit(None).cast("string"))
    hotels = hotels.withColumn("star_rating", F.lit(None).cast("decimal(2,1)"))
    got = maintenance.append_hotels_with_review(model, hotels).rejected.collect()
    assert sorted((tuple(r.key), r.rows) for r in got) == [(("a", "b|c"), 1), (("a|b", "c"), 1)]


def test_append_features(model, rows):
    new = rows(
        [("Pool", "b"), ("Pool", "a"), ("Parking", None), ("Bar", None), (None, "z")],
        "feature_name string, description string",
    )
    result = maintenance.append_features(model, new)
    accepted = {r.feature_name: r for r in result.accepted.collect()}
    assert set(accepted) == {"Pool", "Bar"} and accepted["Pool"].description == "a"
    assert sorted(r.feature_id for r in accepted.values()) == [8, 9]
    assert {r.is_active for r in accepted.values()} == {"Y"}
    assert rejections(result) == {("Pool", "duplicate"): 1, ("Parking", "duplicate"): 1, ("", "missing name"): 1}
    assert result.table.count() == 4


def test_append_seeds(model, rows):
    new = rows(
        [("Cleanliness", "dirty", -1), ("Cleanliness", "clean", 1), ("Cleanliness", "dirty", -1),
         ("Cleanliness", "meh", 0), ("Nope", "x", 1), ("Parking", "clean", 1), ("Parking", "car", None)],
        "feature_name string, seed_phrase string, weight int",
    )
    result = maintenance.append_seeds(model, new)
    assert {(r.feature_id, r.seed_phrase, int(r.weight)) for r in result.accepted.collect()} == {
        (1, "dirty", -1), (7, "clean", 1),
    }
    assert sorted(r.seed_id for r in result.accepted.collect()) == [6, 7]
    assert rejections(result) == {
        ("1|clean", "duplicate"): 1, ("1|dirty", "duplicate"): 1, ("Nope|x", "unknown feature"): 1,
        ("Cleanliness|meh", "weight must be -1 or 1"): 1, ("Parking|car", "weight must be -1 or 1"): 1,
    }


REVIEW = "hotel_name string, review_text string, reviewer_name string, review_date date, overall_rating decimal(2,1)"


def test_append_reviews(model, rows):
    d = datetime.date(2024, 2, 3)
    new = rows(
        [("Beta", "good", "Ann", d, Decimal("4.5")), ("Beta", "undated", None, None, None),
         ("Alpha", "which?", None, d, None), ("Gone", "x", None, d, None), ("Gone", "y", None, d, None),
         ("Beta", "", None, d, None), ("Beta", "bad", None, d, Decimal("0.5"))],
        REVIEW,
    )
    result = maintenance.append_reviews(model, new, TODAY)
    got = {r.review_text: r for r in result.accepted.collect()}
    assert set(got) == {"good", "undated"}
    assert got["undated"].review_date == TODAY and got["good"].review_date == d
    assert {r.hotel_id for r in got.values()} == {3} and min(r.review_id for r in got.values()) > 11
    assert rejections(result) == {
        ("Alpha", "ambiguous hotel"): 1, ("Gone", "unknown hotel"): 2, ("Beta", "missing text"): 1,
        ("Beta", "rating out of range"): 1,
    }
    assert result.table.count() == 4


def test_append_hotels_with_review(model, rows):
    new = rows(
        [("New", "Rome", Decimal("3.0"), "lovely"), ("Alpha", "Rome", None, "again"), ("Alpha", "Bern", None, ""),
         ("Solo", None, None, None), ("Twin", None, None, "b"), ("Twin", None, None, "a"),
         (None, "Rome", None, None), ("Bad", "Rome", Decimal("6.0"), None)],
        "hotel_name string, city string, star_rating decimal(2,1), review_text string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("address", "country", "reviewer_name")})
    result = maintenance.append_hotels_with_review(model, new, TODAY)
    accepted = {r.hotel_name: r for r in result.accepted.collect()}
    assert {(r.hotel_name, r.city) for r in accepted.values()} == {("New", "Rome"), ("Alpha", "Bern"), ("Twin", None)}
    assert sorted(r.hotel_id for r in accepted.values()) == [5, 6, 7]
    first = {r.hotel_id: r for r in result.review.filter("review_id > 11").collect()}
    assert set(first) == {accepted["New"].hotel_id, accepted["Twin"].hotel_id}
    assert first[accepted["Twin"].hotel_id].review_date == TODAY
    assert rejections(result) == {
        ("Alpha|Rome", "duplicate"): 1, ("Solo", "duplicate"): 1, ("Twin", "duplicate"): 1,
        ("Rome", "missing name"): 1, ("Bad|Rome", "star rating out of range"): 1,
    }


def test_append_then_refresh_equals_full_scoring(model, rows):
    m = model.with_(rating=scoring.calc_ratings(model, updated=TODAY))
    new = rows([("Beta", "clean clean", None, TODAY, None)], REVIEW)
    added = maintenance.append_reviews(m, new, TODAY)
    m2 = m.with_(review=added.table)
    fresh = scoring.refresh_hotels(m2, added.accepted, updated=TODAY)
    assert sorted(fresh.collect()) == sorted(scoring.calc_ratings(m2, updated=TODAY).collect())


def test_valid_tables_have_no_violations(model):
    assert maintenance.validate(model).collect() == []


def test_violations_are_named(make_model):
    m = make_model(
        [(1, "A", "X"), (1, "B", "X"), (2, "A", "X"), (3, None, "Y")],
        [(1, "F", "Y"), (2, "F", "?")],
        [(1, 1, "p", 1), (2, 1, "p", None), (3, 9, "q", 1)],
        [(1, 1, None, None, 0.5), (1, 8, "t", None, 5.0)],
        [(1, 1, None), (1, 1, 2.0), (9, 1, 2.0)],
    )
    got = {(r.table, r.rule, r.key): r.rows for r in maintenance.validate(m).collect()}
    assert got == {
        ("hotel", "hotel_id unique", "1"): 2, ("hotel", "hotel_name, city unique", "A|X"): 2,
        ("hotel", "hotel_name not null", "3"): 1, ("feature", "feature_name unique", "F"): 2,
        ("feature", "is_active in Y, N", "2"): 1, ("seed", "feature_id, seed_phrase unique", "1|p"): 2,
        ("seed", "weight not null", "2"): 1, ("seed", "feature_id exists", "9"): 1,
        ("review", "review_text not null", "1"): 1, ("review", "review_id unique", "1"): 2,
        ("review", "hotel_id exists", "8"): 1, ("review", "overall_rating between 1 and 5", "1"): 1,
        ("rating", "score not null", "1|1"): 1, ("rating", "hotel_id, feature_id unique", "1|1"): 2,
        ("rating", "hotel_id exists", "9"): 1,
    }


def test_deleting_a_parent_deletes_its_children(model):
    left = maintenance.cascade_delete(
        model, hotels=model.hotel.filter("hotel_name = 'Alpha'"), features=model.feature.filter("feature_id = 7")
    )
    assert {r.hotel_id for r in left.hotel.collect()} == {3, 4}
    assert {r.review_id for r in left.review.collect()} == {11}
    assert {(r.hotel_id, r.feature_id) for r in left.rating.collect()} == {(3, 1)}
    assert left.seed.count() == 1 and left.feature.count() == 1

"""Searches: cards, recent reviews, city list, thresholds, order."""

from __future__ import annotations

import datetime

import pytest

from reviewlytics.plans import search

HOTELS = [
    (1, "Grand Hotel", "Rome"), (2, "Grand_Hotel 100%", "Rome"), (3, "Small Inn", "Rome"),
    (4, "GRAND PALACE", "Oslo"), (5, "Nowhere", None),
]
FEATURES = [
    (1, "Cleanliness", "Y"), (2, "Service Cleanliness", "Y"), (3, "Location", "Y"),
    (4, "Comfort", "N"), (5, "Best Value", "Y"), (6, "Parking", "Y"),
]
D = datetime.date
REVIEWS = [
    (1, 1, "old", D(2020, 1, 1), 4.0), (2, 1, "undated", None, 5.0), (3, 1, "new", D(2024, 1, 1), None),
    (4, 3, "x", D(2021, 1, 1), 2.5), (5, 3, "y", D(2021, 1, 1), 2.0),
]
RATINGS = [
    (1, 1, 3.10), (1, 2, 4.00), (1, 3, 2.50), (1, 5, 3.05), (1, 6, 2.00),
    (2, 1, 3.00), (2, 2, 2.00), (4, 3, 5.00),
]


@pytest.fixture(scope="module")
def model(make_model):
    return make_model(HOTELS, FEATURES, [], REVIEWS, RATINGS)


def test_card_uses_one_column_per_feature_and_the_last_feature_wins(model):
    [card] = search.hotel_rating_card(model, "grand hotel").collect()
    assert card.hotel_id == 1 and card.total_reviews == 3
    # 'Service Cleanliness' counts as cleanliness only, and comes after feature 1
    assert card.cleanliness_score == 4.0 and card.service_score == 0.0
    assert card.price_score == 3.05 and card.comfort_score == 0.0
    assert card.overall_rating == 2.93  # all five scores, also that of Parking
    assert card.band == "Red" and card.stars == "⭐" * 3


def test_card_falls_back_to_review_ratings(model):
    [card] = search.hotel_rating_card(model, "small").collect()
    assert card.overall_rating == 2.25 and card.stars == "⭐⭐"
    [card] = search.hotel_rating_card(model, "nowhere").collect()
    assert card.overall_rating == 0.0 and card.stars == ""
    assert search.hotel_rating_card(model, "zzz").collect() == []


def test_wildcards_of_the_user_stay_wildcards(model):
    def ids(text):
        found = model.hotel.filter(search.name_contains(model.hotel.hotel_name, text))
        return sorted(r.hotel_id for r in found.collect())

    assert ids("grand_hotel") == [1, 2]
    assert ids("g%e") == [1, 2, 4]
    assert ids("inn") == [3]


def test_undated_reviews_come_first_and_gaps_are_filled(model):
    got = search.recent_reviews(model, "GRAND HOTEL").collect()
    assert [r.review_text for r in got] == ["undated", "new", "old"]
    assert got[0].review_date == D(1, 1, 1) and got[1].rating == 0.0
    assert {r.reviewer_name for r in got} == {"Anonymous"}
    assert [r.review_text for r in search.recent_reviews(model, "grand hotel", 1).collect()] == ["undated"]
    assert [r.review_text for r in search.recent_reviews(model, "small inn").collect()] == ["x", "y"]


def test_lists(model):
    assert [r.city for r in search.cities(model).collect()] == ["Oslo", "Rome"]
    assert [r.feature_name for r in search.active_features(model).collect()] == [
        "Best Value", "Cleanliness", "Location", "Parking", "Service Cleanliness",
    ]


def test_city_list_is_ordered_by_score(model):
    got = search.hotels_by_city(model, "Rome").collect()
    assert [(r.name, r.rating, r.review_count) for r in got] == [
        ("Grand Hotel", 2.93, 3), ("Grand_Hotel 100%", 2.5, 0), ("Small Inn", 2.25, 2),
    ]


def test_threshold_search_uses_independent_columns(model):
    [first, second] = search.advanced_search(model, "Rome", {}).collect()
    assert first.cleanliness_score == 4.0 and first.service_score == 4.0
    assert (second.hotel_name, second.total_reviews) == ("Grand_Hotel 100%", 0)

    def names(**thresholds):
        return [r.hotel_name for r in search.advanced_search(model, "Rome", thresholds).collect()]

    assert names(overall=2.5) == ["Grand Hotel", "Grand_Hotel 100%"]  # reached, not exceeded
    assert names(overall=2.51) == ["Grand Hotel"]
    assert names(location=1.0) == ["Grand Hotel"]  # no location score fails
    assert names(comfort=None, price=3.05) == ["Grand Hotel"]
    assert names(unknown=5.0) == ["Grand Hotel", "Grand_Hotel 100%"]


def test_search_reaches_the_scan_as_a_key_list(spark, model, tmp_path):
    path = str(tmp_path / "review")
    model.review.write.parquet(path)
    stored = model.with_(review=spark.read.parquet(path))
    df = search.recent_reviews(stored, "grand hotel")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(hotel_id,1)" in plan or "In(hotel_id, [1])" in plan
    assert "Join" not in plan and "TakeOrderedAndProject" in plan

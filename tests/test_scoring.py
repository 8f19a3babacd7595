"""Scores: formula, missing mentions, grid, partial re-scoring, views over the result."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from reviewlytics.plans import scoring, views
from reviewlytics.operators.matching import MatchLimits

HOTELS = [(1, "Alpha", "Rome"), (2, "Beta", "Rome"), (3, "Gamma", None), (4, "Alpha", "Oslo")]
FEATURES = [(1, "Cleanliness", "Y"), (2, "Service", "Y"), (3, "Parking", "N")]
SEEDS = [(1, 1, "clean", 1), (2, 1, "dirty", -1), (3, 2, "kind", 1), (4, 2, "ok", 0), (5, 3, "park", 1)]
REVIEWS = [
    (1, 1, "clean and clean", None, 4.5), (2, 1, "clean but dirty", None, 3.0),
    (3, 1, "dirty dirty", None, None), (4, 2, "ok, kind staff", None, 5.0),
    (5, 2, "ok", None, 1.0), (6, 3, "nothing", None, 2.5), (7, 99, "clean", None, 4.0),
]
DAY = datetime.date(2025, 1, 1)


@pytest.fixture(scope="module")
def model(make_model):
    return make_model(HOTELS, FEATURES, SEEDS, REVIEWS)


@pytest.fixture(scope="module")
def ratings(model):
    got = scoring.calc_ratings(model, updated=DAY).collect()
    return {(r.hotel_id, r.feature_id): r for r in got}


def score(n, a):
    return round((20 * 3 + n * (3 + 2 * a / (0.5 + abs(a)))) / (20 + n), 2)


def test_every_hotel_meets_every_active_feature(ratings):
    assert set(ratings) == {(h, f) for h in (1, 2, 3, 4) for f in (1, 2)}


def test_scores_follow_the_formula(ratings):
    # hotel 1, cleanliness: sentiments 1, 0, -1 (a seed counts once per review)
    r = ratings[1, 1]
    assert float(r.score) == score(3, 0.0) and r.total_mentions == 3
    assert (r.positive_mentions, r.negative_mentions) == (1, 1)  # a balanced review is neither
    # hotel 2, service: a zero weight is still a mention
    r = ratings[2, 2]
    assert float(r.score) == score(2, 0.5) and r.total_mentions == 2
    assert (r.positive_mentions, r.negative_mentions) == (1, 0)


def test_no_mentions_score_2_5_and_leave_the_counts_null(ratings):
    for pair in ((3, 1), (4, 1), (2, 1), (1, 2)):
        r = ratings[pair]
        assert float(r.score) == 2.5 and r.total_mentions == 0
        assert r.positive_mentions is None and r.negative_mentions is None


def test_scores_stay_in_range(spark):
    extreme = spark.createDataFrame([(10**9, 100.0), (10**9, -100.0), (1, 0.0)], "n bigint, a double")
    got = [r[0] for r in extreme.select(scoring.shrunk_score(F.col("n"), F.col("a"))).collect()]
    assert max(got) <= 5 and min(got) >= 1 and got[2] == 3
    neutral = scoring.shrunk_score(F.col("n"), F.col("a"), neutral=9.0)
    assert extreme.select(F.max(neutral)).first()[0] == 5  # clamped


def test_several_passes_give_the_same_scores(model, ratings):
    limits = MatchLimits(plain_per_pass=2, regexes_per_pass=1, automaton_from=1)
    got = scoring.calc_ratings(model, updated=DAY, limits=limits).collect()
    assert {(r.hotel_id, r.feature_id): r for r in got} == ratings


def test_refresh_of_touched_hotels_equals_a_full_scoring(model, make_model, rows):
    before = model.with_(rating=scoring.calc_ratings(model, updated=DAY))
    more = make_model(HOTELS, FEATURES, SEEDS, REVIEWS + [(8, 4, "dirty", None, 1.0), (9, 1, "clean", None, 5.0)])
    changed = before.with_(review=more.review)
    touched = rows([(4,), (1,), (4,)], "hotel_id bigint")
    fresh = scoring.refresh_hotels(changed, touched, updated=DAY)
    full = scoring.calc_ratings(changed, updated=DAY)
    assert sorted(fresh.collect()) == sorted(full.collect())


def test_one_shuffle_scores_everything(model, plan_of):
    plan = plan_of(scoring.calc_ratings(model, updated=DAY))
    assert plan.count("Exchange") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_hotel_filter_on_the_scores_reaches_the_review_scan(spark, model, plan_of, tmp_path):
    model.review.write.parquet(str(tmp_path / "review"))
    stored = model.with_(review=spark.read.parquet(str(tmp_path / "review")))
    plan = plan_of(scoring.calc_ratings(stored, updated=DAY).filter(F.col("hotel_id").isin(1, 3)))
    scan = next(line for line in plan.splitlines() if "review_text" in line and "FileScan" in line)
    assert "In(hotel_id, [1,3])" in scan


def test_overall_view_is_not_blown_up_by_the_fan_out(model):
    m = model.with_(rating=scoring.calc_ratings(model, updated=DAY))
    got = {r.hotel_id: r for r in views.hotel_overall(m).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].features_rated, got[1].total_reviews) == (2, 3)
    assert got[1].avg_score == pytest.approx((score(3, 0.0) + 2.5) / 2, abs=0.006)
    assert got[4].total_reviews == 0


def test_unrated_hotels_stay_in_the_overall_view(make_model):
    m = make_model(HOTELS, FEATURES, [], [(1, 1, "x", None, 3.0)], ratings=[(1, 1, 3.33), (1, 9, 2.0)])
    got = {r.hotel_id: r for r in views.hotel_overall(m).collect()}
    assert got[2].avg_score is None and got[2].features_rated == 0
    # the score of a vanished feature still counts in the mean, but not as a feature
    assert got[1].avg_score == 2.67 and got[1].features_rated == 1


def test_seed_analysis(model):
    got = {r.seed_id: r for r in views.seed_word_analysis(model).collect()}
    assert got[1].total_mentions == 4  # twice in one review, and the review of no hotel
    assert got[1].avg_user_rating_when_present == pytest.approx((4.5 + 3.0 + 4.0) / 3, abs=1e-6)
    assert got[2].total_mentions == 3 and got[2].total_impact_score == -3
    assert got[2].avg_user_rating_when_present == 3.0  # NULL ratings are left out
    assert got[5].total_mentions == 0 and got[5].avg_user_rating_when_present is None
    assert got[5].total_impact_score == 0


def test_feature_seeds_are_ordered_and_named(model):
    got = [(r.feature_name, r.seed_phrase, r.sentiment) for r in views.feature_seeds(model).collect()]
    assert got == [
        ("Cleanliness", "clean", "Positive"), ("Cleanliness", "dirty", "Negative"),
        ("Parking", "park", "Positive"), ("Service", "kind", "Positive"), ("Service", "ok", None),
    ]

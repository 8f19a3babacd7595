"""Phrases as whole words, against plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlytics.operators import whole_words
from reviewlytics.operators.sketch import BloomFilter
from reviewlytics.plans import scoring

WORD = re.compile(r"\w+")
SEEDS = "seed_id bigint, feature_id bigint, seed_phrase string, weight decimal(2,0)"


def plain(reviews, seeds):
    """(review, hotel, seed, feature, weight, places) by comparing lists of words."""
    out = []
    for review, hotel, text in reviews:
        words = WORD.findall((text or "").lower())
        for seed, feature, phrase, weight in seeds:
            p = WORD.findall((phrase or "").lower())
            n = sum(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1)) if p else 0
            if n:
                out.append((review, hotel, seed, feature, int(weight or 0), n))
    return sorted(out)


REVIEWS = [
    (1, 1, "The air-con was loud. Air, CON! air con"), (2, 1, "aircon place"), (3, 2, "ac in the PLACE"), (4, 2, None),
    (5, 2, ""), (6, 3, "a a a b"), (7, 3, "Été à l'été"), (8, 3, "été2 eté x_y"), (9, 4, "b"), (9, 4, "b b"),
]
PHRASES = [
    (1, 1, "air con", 1), (2, 1, "ac", -1), (3, 1, "the place", 1), (4, 2, "a a", 1), (5, 2, "été", -1), (6, 2, "", 1),
    (7, 2, None, 1), (8, 2, "...", 1), (9, 2, "x_y", 0), (10, 3, "b", None), (11, 3, "AIR  -  CON", -1), (12, 3, "b", 1),
    (13, 3, "clean.*", 1), (14, 3, "in the place", 1),
]


@pytest.fixture
def frames(spark):
    review = spark.createDataFrame(REVIEWS, "review_id bigint, hotel_id bigint, review_text string")
    seed = spark.createDataFrame([(s, f, p, None) for s, f, p, _ in PHRASES], SEEDS)
    weight = F.create_map(*[F.lit(x) for s, _, _, w in PHRASES for x in (s, w)])
    return review, seed.withColumn("weight", weight[F.col("seed_id").cast("int")].cast("decimal(2,0)"))


def test_matches(frames):
    review, seed = frames
    got = whole_words.match_whole_words(review, seed, ["review_id", "hotel_id"])
    assert got.columns == ["review_id", "hotel_id", "seed_id", "feature_id", "weight", "mentions"]
    assert sorted(tuple(r) for r in got.collect()) == plain(REVIEWS, PHRASES)


def test_sentiment_counts_a_seed_once_and_a_row_alone(frames):
    review, seed = frames
    got = sorted(tuple(r) for r in whole_words.whole_word_sentiment(review, seed, ["review_id"]).collect())
    want = {}
    for n, row in enumerate(REVIEWS):
        for review_id, _, _, feature, weight, _ in plain([row], PHRASES):
            want[n, review_id, feature] = want.get((n, review_id, feature), 0) + weight
    assert got == sorted((r, f, s) for (_, r, f), s in want.items())


def test_hot_words_are_spread(spark, monkeypatch):
    monkeypatch.setattr(whole_words, "SALTS", 4)
    rng = random.Random(3)
    reviews = [(k, k % 5, "hot " * rng.randint(1, 3) + rng.choice(["cold", "tea", ""])) for k in range(5000)]
    seeds = [(1, 1, "hot", 1), (2, 1, "hot hot", -1), (3, 2, "tea", 1), (4, 2, "hot", -1)]
    review = spark.createDataFrame(reviews, "review_id bigint, hotel_id bigint, review_text string").repartition(3)
    seed = spark.createDataFrame([(s, f, p) for s, f, p, _ in seeds], "seed_id bigint, feature_id bigint, seed_phrase string")
    seed = seed.withColumn("weight", F.expr("CASE seed_id WHEN 2 THEN -1 WHEN 4 THEN -1 ELSE 1 END"))
    got = whole_words.match_whole_words(review, seed, ["review_id", "hotel_id"])
    assert sorted(tuple(r) for r in got.collect()) == plain(reviews, seeds)


def test_no_seeds_no_reviews(frames):
    review, seed = frames
    assert whole_words.match_whole_words(review, seed.where("false"), ["review_id"]).collect() == []
    assert whole_words.match_whole_words(review.where("false"), seed, ["review_id"]).collect() == []
    assert whole_words.whole_word_sentiment(review, seed.where("seed_phrase = '...'"), ["review_id"]).collect() == []


def test_many_seeds_stay_off_the_driver_and_texts_off_the_network(spark, monkeypatch, plan_of):
    review = spark.createDataFrame(REVIEWS, "review_id bigint, hotel_id bigint, review_text string")
    phrase = F.when(F.col("id") % 3 == 0, F.concat_ws(" ", "id", F.col("id") % 7)).otherwise(F.concat(F.lit("w"), "id"))
    seed = spark.range(2_000_000).select(
        F.col("id").alias("seed_id"), (F.col("id") % 9).alias("feature_id"), phrase.alias("seed_phrase"), F.lit(1).alias("weight")
    )
    some = spark.createDataFrame([(1, 1, "W7 w8 3 3 6 w1 6 5")], review.schema)
    plans, real = [], whole_words.written
    monkeypatch.setattr(whole_words, "written", lambda df, name: plans.append(plan_of(df)) or real(df, name))
    found = whole_words.match_whole_words(review.union(some), seed, ["review_id"])
    text = plan_of(found)
    assert "NestedLoop" not in text and "Cartesian" not in text and "BroadcastHashJoin" not in text
    assert "Exchange" not in plans[0].split("Subquery")[0]
    assert sorted((r.seed_id, r.mentions) for r in found.collect()) == [(1, 1), (3, 1), (7, 1), (8, 1)]


def test_bloom_filter(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    known = BloomFilter(keys, "k")
    tried = spark.range(40_000).select("id", known.may_contain(F.concat(F.lit("k"), "id")).alias("hit"))
    hits = {r.hit: r.n for r in tried.groupBy("hit", (F.col("id") < 20_000).alias("in")).agg(F.count("*").alias("n")).collect()}
    inside = tried.where("id < 20000 AND NOT hit").count()
    assert inside == 0 and hits[False] > 19_000
    assert BloomFilter(keys.where("false"), "k").bits == 1024


def test_scores(make_model):
    m = make_model(
        [(1, "A", "X"), (2, "B", "X")], [(1, "F", "Y"), (2, "G", "N")], [(1, 1, "ac", 1), (2, 2, "ac", 1)],
        [(1, 1, "place with AC", None, None), (2, 2, "place", None, None)],
    )
    assert {r.hotel_id: r.total_mentions for r in scoring.calc_ratings(m).collect()} == {1: 1, 2: 1}
    assert {r.hotel_id: r.total_mentions for r in scoring.calc_ratings(m, whole_word=True).collect()} == {1: 1, 2: 0}

"""Sentiment and seed mining against a word-by-word account of a few texts."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reviewlytics.plans import mining, sentiment
from reviewlytics.plans.aspects import WordTables, default_aspect_keywords, keyword_lemmas

KEYWORDS = [("comfort", "room"), ("comfort", "bed"), ("service", "front desk"), ("price", "room")]
LEXICON = {"great": 2.1, "bad": -1.9, "nice": 0.8}
STOP = ["the", "a", "was", "and"]
LEMMAS = {"rooms": "room", "beds": "bed"}
TAGS = {"great": "JJ", "slept": "VBD", "bed": "VB", "quickly": "RB"}
VOCABULARY = "great bad nice room rooms bed beds front desk slept quickly café the a and was got 2nd lamp".split()
WINDOWS = [(0, 1), (1, 0), (0, 2), (1, 1), (2, 0)]


@pytest.fixture(scope="module")
def words(rows):
    return WordTables(
        aspect_keyword=rows(KEYWORDS, "aspect string, keyword string"),
        lexicon=rows(list(LEXICON.items()), "token string, valence double"),
        stop_word=rows([(w,) for w in STOP], "token string"),
        token_lemma=rows(list(LEMMAS.items()), "token string, lemma string"),
        token_tag=rows(list(TAGS.items()), "token string, tag string"),
    )


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = []
    for i in range(40):
        sentences = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(1, 7))) for _ in range(4)]
        made.append((f"f{i % 5}.txt", f"H{i % 5}", "C", ". ".join(sentences) + "."))
    return made + [("f0.txt", "H0", "C", ""), ("f0.txt", "H0", "C", "Room room great.\nNice bed!")]


@pytest.fixture(scope="module")
def reviews(rows, texts):
    return rows(texts, "file string, hotel string, city string, review string")


def tokens(sentence):
    return re.findall(r"[^\W]+(?:-[^\W]+)*", sentence.lower())


def split(text):
    return re.split(r"[.!?]+\s+|\n+", text)


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


def valence(ts):
    return round(sum(LEXICON.get(t, 0) for t in ts), 4)


def aspects_of(word):
    lemma = LEMMAS.get(word, word)
    return {a for a, k in KEYWORDS if lemma in k.split()}


def mined(texts):
    found = defaultdict(list)
    for file, _, _, text in texts:
        for sentence in split(text):
            score = compound(valence(tokens(sentence)))
            clean = [t for t in tokens(sentence) if re.fullmatch("[a-z]+", t) and t not in STOP + ["got"]]
            for at, word in enumerate(clean):
                phrases = set()
                for left, right in WINDOWS:
                    if at < left or at + right >= len(clean):
                        continue
                    phrase = clean[at - left : at + right + 1]
                    before = TAGS.get(clean[at - 1], "NN") if at else ""
                    if TAGS.get(word, "NN")[0] == "N" and (phrase[0] == word or before[:1] in ("J", "N")):
                        phrases.add(" ".join(phrase))
                for aspect in aspects_of(word):
                    for phrase in phrases:
                        found[file, aspect, phrase].append(score)
    return found


def test_phrases_and_their_file_means(reviews, words, texts):
    got = mining.phrase_scores_by_file(reviews, words, ["file"]).collect()
    want = {
        key: (len(s), round(sum(round(x * 10000) for x in s) / len(s)))
        for key, s in mined(texts).items()
        if len(s) >= 2 and abs(sum(s) / len(s)) > 1e-6
    }
    assert len(want) > 20
    have = {(r.file, r.aspect, r.phrase): (r.support, r.weight_scaled) for r in got}
    assert set(have) == set(want)
    assert all(have[k][0] == want[k][0] and abs(have[k][1] - want[k][1]) <= 1 for k in want)


def test_merge_counts_every_file_once(rows):
    by_file = rows(
        [("f1", "price", "p", 9, 1000), ("f2", "price", "p", 2, 4001), ("f1", "price", "alone", 5, 9),
         ("f1", "price", "zero", 2, 100), ("f2", "price", "zero", 2, -100)],
        "file string, aspect string, phrase string, support bigint, weight_scaled bigint",
    )
    got = {r.seed_phrase: r.weight for r in mining.merge_files(by_file).collect()}
    assert got == {"p": 0.2501}  # one file is not enough, a zero mean is no seed
    by_support = {r.seed_phrase: r.weight for r in mining.merge_files(by_file, weighted=True).collect()}
    assert by_support == {"p": 0.1546, "alone": 0.0009}
    loose = mining.merge_files(by_file, min_phrase_freq=1).count()
    assert loose == 2


def test_seed_terms(reviews, words):
    merged = mining.seed_terms(reviews, words)
    assert merged.columns == ["feature_name", "seed_phrase", "weight"]
    assert {r.feature_name for r in merged.collect()} <= {"Comfort", "Service", "Price"}
    by_hotel = mining.seed_terms(reviews, words, by_hotel=True)
    assert by_hotel.columns == ["hotel", "city", "feature_name", "seed_phrase", "weight"]


def test_review_sentiment(reviews, words, texts):
    got = {r.review: r for r in sentiment.review_sentiment(reviews, words).collect()}
    for _, _, _, text in texts:
        r = got[text]
        assert r.compound == pytest.approx(compound(valence(tokens(text))), abs=1e-9)
        for aspect in ("comfort", "service", "price"):
            scores = [
                compound(valence(tokens(s))) for s in split(text)
                if any(aspect in aspects_of(t) for t in tokens(s))
            ]
            score = r[f"{aspect}_score"]
            if not scores:
                assert score is None and r[f"{aspect}_label"] is None
            else:
                assert score == pytest.approx(sum(scores) / len(scores), abs=1e-4)
                total = sum(round(s * 10_000) for s in scores)
                label = "neutral"
                if abs(total) >= 500 * len(scores):
                    label = "positive" if total > 0 else "negative"
                assert r[f"{aspect}_label"] == label
        assert r.location_score is None


def test_tables_beyond_the_bound_give_the_same_rows(reviews, words):
    """Every table joined instead of made a literal."""
    joined = replace(words, bound=1)
    for run in (
        lambda w: sentiment.review_sentiment(reviews, w),
        lambda w: sentiment.aspect_scores(reviews, w, ["review"]),
        lambda w: mining.aspect_phrases(reviews, w, ["file"]),
        lambda w: mining.seed_terms(reviews, w, by_hotel=True),
    ):
        small, large = run(words), run(joined)
        assert small.columns == large.columns
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_label_is_taken_before_rounding(spark):
    """Means of 0.04995, shown as 0.05, and of 0.05 itself."""
    means = spark.createDataFrame([(499.5,), (500.0,), (-499.5,), (-500.0,), (0.0,)], "mean double")
    mean = F.col("mean")
    got = means.select(sentiment._shown(mean).alias("s"), sentiment._label(mean).alias("l")).collect()
    assert [(r.s, r.l) for r in got] == [
        (0.05, "neutral"), (0.05, "positive"), (-0.05, "neutral"), (-0.05, "negative"), (0.0, "neutral"),
    ]


def test_aspect_scores_equal_the_wide_form(reviews, words):
    wide = sentiment.review_sentiment(reviews, words)
    long = sentiment.aspect_scores(reviews, words, ["review"])
    assert long.filter("aspect = 'price'").count() == wide.filter("price_score is not null").count()


def test_texts_are_not_shuffled_for_sentiment(spark, reviews, words, plan_of):
    assert "Exchange" not in plan_of(sentiment.review_sentiment(reviews, words))
    plan = plan_of(mining.seed_terms(reviews, words))
    assert plan.count("Exchange") == 2 and "Join" not in plan


def test_keywords(spark, rows):
    pairs = {(r.keyword, r.lemma) for r in keyword_lemmas(default_aspect_keywords(spark)).collect()}
    assert {("front desk", "front"), ("front desk", "desk"), ("clean", "clean")} <= pairs
    assert default_aspect_keywords(spark).count() == 55
    lemma = rows([("noisy", "noise")], "token string, lemma string")
    assert keyword_lemmas(default_aspect_keywords(spark), lemma).filter("lemma = 'noise'").count() == 2


def test_without_optional_tables(reviews, words):
    plain = WordTables(words.aspect_keyword, words.lexicon)
    found = mining.aspect_phrases(reviews, plain, ["file"])
    assert found.filter(F.col("phrase").startswith("the ")).count() > 0

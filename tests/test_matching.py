"""Seed matching against a plain Python regex, over every way the operator can run."""

from __future__ import annotations

import random
import re
import string

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlytics.functions.text import fold_text
from reviewlytics.operators import matching
from reviewlytics.operators.matching import MatchLimits, match_seeds, sentiment_per_feature

TEXTS = [
    "The place was CLEAN, clean and cleanish.",
    "aaaa aaa aa",
    "ÉTÉ à la plage; été!",
    "Kelvin ſign and dotless ıs",
    "",
    "nothing here",
    "Very clean.\nNot so clean rooms (100% clean)",
]
SEEDS = [
    (1, 1, "clean", 1), (2, 1, "ac", 1), (3, 2, "aa", -1), (4, 2, "été", 1), (5, 2, "cl[ea]+n", 0),
    (6, 3, "clean room", 1), (7, 3, "%", 1), (8, 3, "never", -1), (9, 1, "KELVIN", 1),
    (10, 3, "sign", 1), (11, 3, "is", -1), (12, 1, "100% clean", 1), (13, 2, "", 1),
    (14, 3, "clean", -1), (15, 1, "so", 1), (16, 1, "very", -1),
]
# What folds to an ASCII letter when case is ignored.
FOLDS = str.maketrans("ſKİı", "skii")


def expected(texts=TEXTS, seeds=SEEDS):
    found = set()
    for review_id, text in enumerate(texts):
        for seed_id, feature_id, phrase, weight in seeds:
            if phrase:
                n = len(re.findall(phrase, text.translate(FOLDS), re.IGNORECASE))
                if n:
                    found.add((review_id, seed_id, feature_id, weight, n))
    return found


@pytest.fixture(scope="module")
def tables(rows):
    review = rows(list(enumerate(TEXTS)), "review_id bigint, review_text string")
    seed = rows(SEEDS, "seed_id bigint, feature_id bigint, seed_phrase string, weight bigint")
    return review, seed


def found(df):
    got = df.select("review_id", "seed_id", "feature_id", "weight", "mentions").collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


WAYS = {
    "one pass": MatchLimits(),
    "regexes only": MatchLimits(automaton_from=10**9),
    "automaton for any number": MatchLimits(automaton_from=1),
    "many passes": MatchLimits(plain_per_pass=3, regexes_per_pass=1, automaton_from=1),
}


@pytest.mark.parametrize("way", WAYS)
def test_matches_equal_plain_regex(tables, way):
    review, seed = tables
    assert found(match_seeds(review, seed, ["review_id"], limits=WAYS[way])) == expected()


def test_without_the_automaton_library(tables, monkeypatch):
    review, seed = tables
    monkeypatch.setattr(matching, "_automaton_available", lambda: False)
    assert found(match_seeds(review, seed, ["review_id"])) == expected()


@pytest.mark.parametrize("way", ["one pass", "many passes"])
def test_sentiment_is_the_sum_of_matching_weights(tables, way):
    review, seed = tables
    sums: dict = {}
    for review_id, _, feature_id, weight, _ in expected():
        sums[review_id, feature_id] = sums.get((review_id, feature_id), 0) + weight
    got = sentiment_per_feature(review, seed, ["review_id"], limits=WAYS[way]).collect()
    assert {(r.review_id, r.feature_id): r.sentiment for r in got} == sums
    assert len(got) == len(sums)


def test_random_texts_and_phrases(rows):
    rng = random.Random(7)
    letters = "ab AB'"
    texts = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(60)]
    phrases = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(80)})
    seeds = [(i, i % 3, p, 1) for i, p in enumerate(phrases)]
    review = rows(list(enumerate(texts)), "review_id bigint, review_text string")
    seed = rows(seeds, "seed_id bigint, feature_id bigint, seed_phrase string, weight bigint")
    assert found(match_seeds(review, seed, ["review_id"])) == expected(texts, seeds)


def test_folding_agrees_with_the_regex_engine(spark):
    """Every letter that a case-insensitive regex takes for an ASCII letter folds to it."""
    all_letters = [(chr(c),) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(all_letters, "c string").coalesce(4)
    wrong = None
    for a in string.ascii_lowercase:
        differs = F.col("c").rlike(f"(?iu)^{a}$") != F.contains(fold_text(F.col("c")), F.lit(a))
        wrong = differs if wrong is None else wrong | differs
    assert df.filter(wrong).count() == 0


@pytest.mark.parametrize("way", ["one pass", "many passes"])
def test_the_text_is_read_once_and_never_shuffled(tables, plan_of, way):
    review, seed = tables
    assert len(list(matching.seed_batches(seed, WAYS[way]))) > (4 if way == "many passes" else 0)
    for df in (
        match_seeds(review, seed, ["review_id"], limits=WAYS[way]),
        sentiment_per_feature(review, seed, ["review_id"], limits=WAYS[way]),
    ):
        plan = plan_of(df)
        assert plan.count("Scan") == 1 and "Union" not in plan
        assert "Exchange" not in plan and "Join" not in plan and "Cartesian" not in plan
        assert plan.count("ArrowEvalPython") == 1


def test_a_worker_holds_one_text_at_a_time():
    batches = ((("ab", 1, 1, 1), ("zz", 2, 1, -1)), (("yy", 4, 1, 1), ("c", 3, None, 0)))
    automata = [(*matching._automaton(f"one text {k}", seeds), seeds) for k, seeds in enumerate(batches)]
    texts = pa.array([None, "", *["xabc " * 4_000] * 2_000])  # 40 MB
    tracemalloc.start()
    hits = matching._hits_of(texts, automata)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    assert hits[:2].to_pylist() == [[], []]
    found = [{"seed_id": i, "feature_id": f, "weight": w, "mentions": 4_000} for i, f, w in ((1, 1, 1), (3, None, 0))]
    assert sorted(hits[2].as_py(), key=lambda h: h["seed_id"]) == found and len(hits) == 2_002

"""Scalar cleaning, rounding and word lookups on edge values."""

from __future__ import annotations

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewlytics.functions import clean, numbers, text
from reviewlytics.operators.dictionary import RowDictionary, collect_dictionary


def evaluate(spark, column, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema).coalesce(1)
    return [r[0] for r in df.select(column).collect()]


def V():
    return F.col("v")


def test_na_to_number(spark):
    got = evaluate(spark, clean.na_to_number(V()).cast("double"), [None, "NA", "4.5", "4.25", "3"])
    assert got == [None, None, 4.5, 4.3, 3.0]
    with pytest.raises(PySparkException):
        evaluate(spark, clean.na_to_number(V()), ["n/a"])


def test_dates(spark):
    raw = ["1/2/24", "12/31/05", "2024-02-29", "2023-02-29", "13/45/20", "31.12.2024", "1/2/2024", None, ""]
    D = datetime.date
    assert evaluate(spark, clean.parse_review_date(V()), raw) == [
        D(2024, 1, 2), D(2005, 12, 31), D(2024, 2, 29), None, None, None, None, None, None,
    ]


def test_weights_become_whole_numbers(spark):
    got = evaluate(spark, clean.seed_weight(V()).cast("int"), ["0.42", "0.5", "-0.5", "1", "-0.49"])
    assert got == [0, 1, -1, 1, 0]
    labels = evaluate(spark, clean.weight_label(V()), [1, -1, 0, 2, None], "v int")
    assert labels == ["Positive", "Negative", None, None, None]


def test_labels_bands_and_stars(spark):
    assert evaluate(spark, clean.sentiment_label(V()), [0.05, 0.0499, -0.05, -0.0499, 0.0], "v double") == [
        "positive", "neutral", "negative", "neutral", "neutral",
    ]
    assert evaluate(spark, clean.rating_band(V()), [4.0, 3.99, 3.0, 2.99], "v double") == [
        "Green", "Orange", "Orange", "Red",
    ]
    stars = evaluate(spark, clean.star_string(V()), [2.5, 3.5, 0.5, -1.0, 7.2, 4.49], "v double")
    assert [len(s) for s in stars] == [2, 4, 0, 0, 5, 4]  # halves go to the even side


def test_thresholds(spark):
    got = evaluate(spark, clean.parse_threshold(V()), ["Any", "", None, ">3.5", "> 4.0 ", "2", ">x"])
    assert got == [None, None, None, 3.5, 4.0, 2.0, None]


def test_title_case_capitalises_after_every_non_letter(spark):
    got = evaluate(spark, clean.title_case(V()), ["o'neil inn", "2nd HOME", "a b-c", "été à", ""])
    assert got == ["O'Neil Inn", "2Nd Home", "A B-C", "Été À", ""]


def test_rounding_near_ties(spark):
    values = [1.005, 2.665, 0.125, 2.675, -1.005]
    up = evaluate(spark, numbers.round_half_up(V()), values, "v double")
    even = evaluate(spark, numbers.round_half_even(V()), values, "v double")
    assert up == [1.01, 2.67, 0.13, 2.68, -1.01]
    assert even == [1.0, 2.66, 0.12, 2.68, -1.0]


def test_means_are_exact_in_any_order(spark):
    df = spark.createDataFrame([(float(x),) for x in (2.3, 2.87, 4.1) * 1000] + [(None,)], "v double")
    for parts in (1, 7):
        total = df.repartition(parts).agg(numbers.exact_mean(V(), 2).alias("m")).first().m
        assert total == 927000 / 300000
    assert df.filter("v > 9").agg(numbers.exact_mean(V(), 2).alias("m")).first().m is None


def test_phrase_count(spark):
    rows = [("ÉTÉ été", "é"), ("aaaa", "aa"), ("abc", ""), ("abc", None), (None, "a"), ("A.b", "a.")]
    df = spark.createDataFrame(rows, "t string, p string").coalesce(1)
    got = [r[0] for r in df.select(text.phrase_count(F.col("t"), F.col("p"))).collect()]
    assert got == [4, 2, 0, 0, 0, 1]


def test_words_and_sentences(spark):
    got = evaluate(spark, text.words(V()), ["Don't STOP, café 2nd well-known!"])
    assert got == [["don", "t", "stop", "café", "2nd", "well-known"]]
    assert evaluate(spark, text.sentences(V()), ["A b. C d?! E\nF"]) == [["A b", "C d", "E", "F"]]
    cleaned = text.clean_words(text.words(V()), lambda w: w == "the")
    assert evaluate(spark, cleaned, ["The quot room, café 2nd got well-known even bed"]) == [["room", "bed"]]


def test_polarity_is_normalised(spark):
    got = evaluate(spark, text.unscale(text.polarity(V())), [0, 10000, -38730, 10**9], "v bigint")
    assert got == [0.0, 0.25, -0.7071, 1.0]


def test_dictionary_lookup(spark, rows):
    words = [(f"w{i}", i) for i in range(500)] + [("it's", -1), ("back\\slash", -2)]
    table = rows(words, "token string, value bigint")
    look = collect_dictionary(table, "token", F.col("value"), "bigint")
    got = evaluate(spark, look.value_of(V()), ["w0", "w499", "it's", "back\\slash", "w500", "", None])
    assert got == [0, 499, -1, -2, None, None, None]
    many = collect_dictionary(
        rows([("x", "b"), ("x", "a"), ("y", "a"), ("x", "b")], "w string, v string"),
        "w", V(), "string", many=True,
    )
    assert evaluate(spark, many.value_of(V()), ["x", "y", "z"]) == [["a", "b"], ["a"], None]
    large = collect_dictionary(table, "token", F.col("value"), "bigint", bound=10)
    assert isinstance(large, RowDictionary)

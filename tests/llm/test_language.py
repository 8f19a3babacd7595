from __future__ import annotations

import numpy as np
import pytest

from reviewlytics.llm import language

EN = "the quick brown fox jumps over the lazy dog and the cat with this thing that they have "
DE = "der schnelle braune fuchs springt über den faulen hund und die katze mit dem ding das sie haben "
FR = "le renard brun rapide saute par dessus le chien paresseux et la chatte avec cette chose que vous avez "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(EN * 5, "en"), (DE * 5, "de"), (FR * 5, "fr"), (None, "en"), ("nothing", None)]
    return language.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_counts_are_whole(spark):
    rows = [("ab", "x"), ("ab", "x"), ("ab", "y")]
    got = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    codes = language.trigrams(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    p = np.exp(got.log_p.astype(np.float64))[codes]
    assert got.languages == ["x", "y"]
    total = 0.1 * language.BUCKETS
    assert np.allclose(p[:, 0], 2.1 / (total + 4), rtol=1e-3) and np.allclose(p[:, 1], 1.1 / (total + 2), rtol=1e-3)


def test_sets_and_shares(spark, model):
    rows = [
        (1, EN), (2, DE.upper().replace("Ü", "ü")), (3, EN * 3 + FR * 3), (4, None), (5, ""), (6, "12 34 !"),
        (7, FR * 20_000), (None, EN), (1, EN),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS lang_pred", "2 AS score")
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["lang_pred"] for k in (1, 2, 4, 5, 6, 7, None)] == ["en", "de", "und", "und", "und", "fr", "en"]
    assert {x["lang"] for x in by_id[3]["lang_set"]} == {"en", "fr"}
    assert abs(sum(x["share"] for x in by_id[3]["lang_set"]) - 1) < 1e-6
    assert all(len(by_id[k]["lang_set"]) == 1 and by_id[k]["score"] == 1 for k in (1, 2, 7))
    assert all(by_id[k]["score"] == 0 and by_id[k]["lang_set"] == [] for k in (4, 5, 6))
    assert language.predict(docs.where("false"), model).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language.identify(docs).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.where("lang = lang_pred").count()
    assert right >= 0.97 * out.count() > 0

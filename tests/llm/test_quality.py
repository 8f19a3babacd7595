from __future__ import annotations

import numpy as np

from reviewlytics.llm import quality


def measured(texts):
    raw = [t.encode() for t in texts]
    return quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_features():
    x = dict(zip(quality.FEATURES, measured(["Aa aa b1 ##\nx. x."])[0]))
    assert x["log_words"] == np.log1p(6) and abs(x["repeated_next"] - 2 / 6) < 1e-12
    assert abs(x["distinct_words"] - 4 / 6) < 1e-12 and abs(x["odd_words"] - 1 / 6) < 1e-12
    assert abs(x["ends_per_word"] - 2 / 6) < 1e-12 and abs(x["lines_per_word"] - 2 / 6) < 1e-12
    assert not measured([""]).any()


def test_tables_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality.train(x, y)
    assert (1, 0) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.93
    one = (x[:, 2] > 0.3).astype(float)
    model = quality.train(x, one)
    assert ((model.score(x) >= 0.5) == one).mean() > 0.97
    assert np.abs(model.tables[2]).max() > 5 * np.abs(model.tables[3]).max()
    lookup = model.bias + sum(model.tables[k, model.bins(x)[:, k]] for k in range(x.shape[1]))
    lookup += sum(g[model.bins(x)[:, i], model.bins(x)[:, j]] for (i, j), g in zip(model.pairs, model.grids))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-np.clip(lookup, -30, 30))))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 400_000), (3, "word"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "5 AS score", "6 AS label")
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0), (1, None, 1), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.classify(docs.where("false"), labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == 5


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    known = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = known[known.quality == 1].score, known[known.quality == 0].score
    assert np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]) > 0.9
    assert ((known.score >= 0.5) == (known.quality == 1)).mean() > 0.92
